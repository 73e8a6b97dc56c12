"""Closed-form signals through filters, detectors and shot metrics."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from percussa.functions import dsp
from percussa.operators import calibration as C
from percussa.operators import hierarchy
from percussa.operators import shots as G
from percussa.operators import spectra as P
from percussa.plans.catalog import rounded


def windows(spark, fs, **signals):
    rows = [(name, int(fs), [float(v) for v in x]) for name, x in signals.items()]
    return spark.createDataFrame(rows, "name string, fs int, samples array<double>")


def sine(fs, f, level, seconds=1.0):
    n = np.arange(int(fs * seconds))
    return np.sqrt(2) * 20e-6 * 10 ** (level / 20) * np.sin(2 * np.pi * f * n / fs)


def blast(fs, peak, duration, total, lead):
    t = np.arange(int(total * fs)) / fs - lead
    return np.where(t >= 0, peak * (1 - t / duration) * np.exp(-np.maximum(t, 0) / duration), 0.0)


@pytest.mark.parametrize("fs", [44100, 48000, 96000])
def test_weighting_curve_and_filter_agree(fs):
    # Nominal A-weighting in dB at a few frequencies.
    for f, want in ((31.5, -39.4), (100, -19.1), (1000, 0.0), (4000, 1.0)):
        got = 20 * np.log10(abs(dsp.weighting_response(np.array([f]), fs, "A")[0]))
        assert got == pytest.approx(want, abs=0.5)


def test_weighted_tone_level():
    x = sine(48000, 100, 94)
    y = dsp.weighted(x[None, :], 48000, "A")[0][4800:]
    assert 20 * np.log10(np.sqrt(np.mean(y**2)) / 20e-6) == pytest.approx(94 - 19.1, abs=0.1)


def test_detectors_follow_their_recurrence():
    rng = np.random.default_rng(2)
    x2, fs, tau = rng.random(5000), 8000.0, 0.01
    a, y, want = 1 - np.exp(-1 / (fs * tau)), 0.0, []
    for v in x2:
        y = a * v + (1 - a) * y
        want.append(y)
    assert dsp.exponential_average(x2, fs, tau) == pytest.approx(want)
    d, y, want = np.exp(-1 / (fs * tau)), 0.0, []
    for v in x2:
        y = max(v, d * y)
        want.append(y)
    assert dsp.decaying_hold(x2, fs, tau) == pytest.approx(want)


def test_detection_band_keeps_a_tone_inside_and_drops_one_outside():
    fs = 48000
    inside = dsp.detection_band(sine(fs, 900, 94)[None, :], fs)[0][5000:-5000]
    outside = dsp.detection_band(sine(fs, 5, 94)[None, :], fs)[0][5000:-5000]
    assert np.sqrt(np.mean(inside**2)) == pytest.approx(20e-6 * 10 ** (94 / 20), rel=0.01)
    assert np.sqrt(np.mean(outside**2)) < 0.02 * 20e-6 * 10 ** (94 / 20)


def test_blast_metrics(spark):
    fs, peak, duration = 192000, 200.0, 0.002
    out = G.shot_metrics(windows(spark, fs, blast=blast(fs, peak, duration, 0.1, 0.02))).first()
    assert out.Lpeak_Z == pytest.approx(140.0, abs=0.1)
    assert out.a_duration_ms == pytest.approx(2.0, abs=0.02)
    assert out.specific_impulse_Pa_s == pytest.approx(peak * duration / np.e, rel=0.01)
    assert out.peak_overpressure_Pa == pytest.approx(peak, rel=0.01)
    assert out.valid and out.snr_dB > 20


def test_b_duration_of_a_decaying_tone(spark):
    fs, tau = 48000, 0.004
    t = np.arange(int(0.1 * fs)) / fs
    x = np.r_[np.zeros(500), np.exp(-t / tau) * np.sin(2 * np.pi * 2000 * t)]
    out = G.shot_metrics(windows(spark, fs, tone=x)).first()
    assert out.b_duration_ms == pytest.approx(tau * np.log(10) * 1000, rel=0.06)


def test_sine_metrics_and_gain(spark):
    fs = 48000
    x = sine(fs, 1000, 94, 0.25)
    bare = windows(spark, fs, one=x).select(G.crest_factor(F.col("samples")).alias("crest"), G.excess_kurtosis(F.col("samples")).alias("kurt"))
    assert tuple(bare.first()) == pytest.approx((20 * np.log10(np.sqrt(2)), -1.5), abs=1e-6)
    rows = {r.name: r for r in G.shot_metrics(windows(spark, fs, one=x, two=2 * x)).collect()}
    one, two = rows["one"], rows["two"]
    # The high-pass sees the sine begin and end abruptly, which lifts the outermost peaks by 0.03 dB; without it nothing does.
    assert one.crest_factor_dB == pytest.approx(3.01, abs=0.05)
    assert G.shot_metrics(windows(spark, fs, one=x), cutoff=None).first().crest_factor_dB == pytest.approx(3.0103, abs=1e-3)
    assert one.kurtosis == pytest.approx(-1.5, abs=0.01)
    assert one.spectral_centroid_Hz == pytest.approx(1000, abs=2)
    assert one.LZE == pytest.approx(94 + 10 * np.log10(0.25), abs=0.06)
    assert one.LAE == pytest.approx(one.LZE, abs=0.1)
    for name in ("Lpeak_Z", "Lpeak_A", "Lpeak_C", "LZE", "LAE", "LCE", "LAFmax", "LZSmax", "LAImax", "LZImax"):
        assert two[name] - one[name] == pytest.approx(20 * np.log10(2), abs=1e-6)


def test_band_exposure_sums_to_the_whole(spark):
    fs = 48000
    rng = np.random.default_rng(4)
    x = dsp.detection_band(rng.normal(0, 1, (1, fs)), fs, 200, 5000)[0]
    bands = windows(spark, fs, noise=x).select(F.inline(G.band_exposure_of("samples", "fs"))).toPandas()
    total = 10 * np.log10(np.sum(10 ** (bands.exposure_dB / 10)))
    assert total == pytest.approx(10 * np.log10(np.sum(x**2) / fs / 4e-10), abs=0.3)
    tone = windows(spark, fs, tone=sine(fs, 1000, 94)).select(F.inline(G.band_exposure_of("samples", "fs"))).toPandas()
    assert tone.loc[tone.exposure_dB.idxmax(), "band_Hz"] == 1000


def test_stft_tone_level(spark):
    fs = 48000
    frames = P.stft_levels(P.stft(windows(spark, fs, tone=sine(fs, 1500, 94, 0.1)), ["name"], 1024, 768))
    top = P.spectral_peak(frames, ["name"]).first()
    assert top.peak_dB == pytest.approx(94, abs=0.01) and top.peak_Hz == 1500


@pytest.mark.parametrize("size", [4000, 1000, 600])
def test_chunked_results_do_not_depend_on_chunks(spark, size):
    fs, rng = 8000, np.random.default_rng(6)
    x = rng.normal(0, 1, 4000)
    chunks = spark.createDataFrame([(0, c, fs, x[c * size:(c + 1) * size].tolist()) for c in range(-(-4000 // size))],
                                   "rec int, chunk_id long, fs int, samples array<double>")

    def whole(df, col):
        return np.concatenate([r[col] for r in df.orderBy("chunk_id").collect()])

    assert whole(P.exponential_chunks(chunks, ["rec"], size, 0.125), "mean_square") == pytest.approx(
        dsp.exponential_average(x * x, fs, 0.125))
    assert whole(P.impulse_chunks(chunks, ["rec"], size), "mean_square") == pytest.approx(dsp.impulse_average(x * x, fs))
    got = P.stft_chunks(chunks, ["rec"], size, 128, 96).toPandas().sort_values(["frame", "bin"])
    _, _, want = dsp.stft_frames(x, fs, 128, 96)
    assert got.value.to_numpy() == pytest.approx(want.ravel())
    near = whole(C.filtered_chunks(chunks, ["rec"], C.weight_a, 2, 0), "samples")
    assert np.abs(near - dsp.weighted(x[None, :], fs, "A")[0]).max() < 0.01


@pytest.mark.parametrize("width", [64, 2])
def test_levels_carry_over_short_chunks_silence_and_gaps(spark, width, monkeypatch):
    """Chunks far shorter than the time constant, a long silence, a missing chunk, two rates: rows stay linear in chunks."""
    monkeypatch.setattr(hierarchy, "WIDTH", width)
    rng, size, tau = np.random.default_rng(7), 20, 0.05
    rows, want, held = [], {}, {}
    for rec, fs in ((0, 1000), (1, 4000)):
        x = rng.normal(0, 1, 6000)
        x[1000:5990] = 0
        x[2000:2020] = 0
        rows += [(rec, c, fs, x[c * size:(c + 1) * size].tolist()) for c in range(300) if c != 100]
        want[rec], held[rec] = dsp.exponential_average(x * x, fs, tau), dsp.impulse_average(x * x, fs)
    chunks = spark.createDataFrame(rows, "rec int, chunk_id long, fs int, samples array<double>")
    for got, full in ((P.exponential_chunks(chunks, ["rec"], size, tau), want), (P.impulse_chunks(chunks, ["rec"], size), held)):
        got = got.collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.mean_square == pytest.approx(full[r.rec][r.chunk_id * size:(r.chunk_id + 1) * size], rel=1e-9, abs=0)
    # After 4 800 silent samples the level is still what exact decay leaves: about e^-96 of the last value.
    late = want[0][5980]
    assert 0 < late < 1e-40


def run_high_pass(x, settled, fs, cutoff):
    """The difference equation of a second-order Butterworth high-pass, after `settled` for ever."""
    k = np.tan(np.pi * cutoff / fs)
    norm = 1 / (1 + np.sqrt(2) * k + k * k)
    out, x1, x2, y1, y2 = [], settled, settled, 0.0, 0.0
    for v in x:
        y = norm * (v - 2 * x1 + x2 - 2 * (k * k - 1) * y1 - (1 - np.sqrt(2) * k + k * k) * y2)
        x1, x2, y1, y2 = v, x1, y, y1
        out.append(y)
    return np.array(out)


def high_passed_over_silence(x, fs, cutoff=10.0):
    x = x - x.mean()
    if len(x) < 32 or not 0 < cutoff < fs / 2:
        return x
    pad = int(np.ceil(5 * fs / (2 * np.pi * cutoff)))
    pad = len(x) if pad >= 10 * len(x) else pad
    once = run_high_pass(np.r_[np.zeros(pad), x, np.zeros(pad)], 0.0, fs, cutoff)
    return run_high_pass(once[::-1], once[-1], fs, cutoff)[::-1][pad:pad + len(x)]


@pytest.mark.parametrize("width, size", [(64, 1), (2, 20), (64, 6000)])
def test_high_pass_runs_over_whole_recordings(spark, width, size, monkeypatch):
    """Chunks far shorter than the time constant, a recording without a name, an offset, short recordings, several rates."""
    monkeypatch.setattr(hierarchy, "WIDTH", width)
    rng = np.random.default_rng(8)
    n = np.arange(3000)
    signals = {("long", 8000): 0.3 + 0.2 * np.sin(2 * np.pi * 3 * n / 8000) + rng.normal(0, 0.1, 3000), ("long", 400): rng.normal(5, 1, 701),
               (None, 8000): rng.normal(0, 1, 1000) + n[:1000] / 500, ("forty", 8000): rng.normal(0, 1, 40),
               ("few", 8000): rng.normal(2, 1, 31), ("slow", 15): rng.normal(2, 1, 50)}
    rows = [(rec, c, fs, x[c * size:(c + 1) * size].tolist()) for (rec, fs), x in signals.items() for c in range(-(-len(x) // size))]
    rows += [("few", 99, 8000, None), ("none", 0, 8000, [])]
    chunks = spark.createDataFrame(rows, "rec string, chunk_id long, fs int, samples array<double>")
    got = {}
    for r in C.high_pass(chunks, ["rec"], size).orderBy("chunk_id").collect():
        got.setdefault((r.rec, r.fs), []).append(r.samples)
    assert got.keys() == signals.keys()
    for k, x in signals.items():
        assert [len(v) for v in got[k]] == [len(r[3]) for r in rows if (r[0], r[2]) == k and r[3]]
        assert np.concatenate(got[k]) == pytest.approx(high_passed_over_silence(x, k[1]), rel=1e-9, abs=1e-11)


def test_high_pass_takes_what_is_missing_for_silence(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "WIDTH", 2)
    rng, size = np.random.default_rng(10), 20
    x = rng.normal(1, 0.5, 990)
    x[[3, 500]] = np.nan
    x[100:160] = x[400:420] = np.nan
    cut = {c: [None if i == 3 else v for i, v in enumerate(x[c * size:(c + 1) * size].tolist(), c * size)] for c in range(50) if c not in (5, 6, 7, 20)}
    chunks = spark.createDataFrame([(0, c, 8000, v) for c, v in cut.items()], "rec int, chunk_id long, fs int, samples array<double>")
    got = {r.chunk_id: r.samples for r in C.high_pass(chunks, ["rec"], size).collect()}
    silent = np.where(np.isnan(x), 0, x - np.nanmean(x))
    want = high_passed_over_silence(silent, 8000)
    assert got.keys() == cut.keys()
    for c, v in got.items():
        at = np.arange(c * size, c * size + len(v))
        assert [i for i, y in zip(at, v) if y is None] == [i for i in at if np.isnan(x[i])]
        assert [y for y in v if y is not None] == pytest.approx(want[at][~np.isnan(x[at])], rel=1e-9, abs=1e-11)


def test_high_pass_query_filters_each_recording_as_one_signal(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(k, (rng.normal(0.1, 0.1, 64) + 0.2 * np.sin(k / 5)).tolist(), 1 if k < 40 else None) for k in range(47)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.recording_id, r.chunk_id): (r.n, r.rms) for r in entry.queries()["high_pass"](spark, str(tmp_path)).collect()}
    want = {}
    for label, at in ((1, range(40)), (None, range(40, 47))):
        x = np.concatenate([np.array(rows[k][1], np.float32).astype(float) * 10 ** (-0.4 * (c % 7)) for c, k in enumerate(at)])
        for c, y in enumerate(high_passed_over_silence(x, 8000).reshape(-1, 64)):
            want[label, c] = (64, pytest.approx(np.sqrt(np.mean(y * y)), abs=1e-9))
    assert got == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert {(r[0], r[1]): (r[2], r[3]) for r in con.execute(entry.oracle_sql()["high_pass"]).fetchall()} == want


def test_scan_has_one_row_a_chunk(spark):
    ends = spark.range(1000).selectExpr("1 AS key", "id AS c", "id * 10 AS begin", "id * 10 + 10 AS at", "1.0D AS v", "1e6D AS scale")
    got = {r.c: r.start for r in hierarchy.decayed_before(ends, ["key"], "c", "at", "v", "scale").collect()}
    assert got == pytest.approx({k: sum(np.exp(-10 * (k - j - 1) / 1e6) for j in range(k)) for k in range(1000)})


def test_tone_calibration(spark):
    fs = 48000
    n = np.arange(fs)
    good, wrong = 0.1 * np.sin(2 * np.pi * 1000 * n / fs), 0.1 * np.sin(2 * np.pi * 300 * n / fs)
    rows = [(k, int(i), float(v)) for k, x in enumerate((good, wrong)) for i, v in enumerate(x)]
    out = {r.rec: r for r in C.calibrate_from_tone(spark.createDataFrame(rows, "rec int, n long, x double"), ["rec"], fs, 1000.0, 94.0).collect()}
    assert out[0].Pa_per_FS == pytest.approx(20e-6 * 10 ** (94 / 20) / (0.1 / np.sqrt(2)), rel=1e-4)
    assert out[1].Pa_per_FS is None and "dominant" in out[1].refusal


@pytest.mark.parametrize("apply", [lambda x: dsp.weighted(x, 8000.0, "C"), lambda x: dsp.high_passed(x, 8000.0),
                                   lambda x: next(dsp.band_signals(x, 8000.0))[1]])
def test_filtered_rows_do_not_keep_their_padding(apply):
    x = np.random.default_rng(5).normal(0, 0.1, (3, 320))
    y = apply(x)
    assert y.shape == x.shape and (y.base is None or y.base.nbytes <= x.nbytes)


def test_equal_windows_are_transformed_in_blocks_of_bounded_size():
    rng = np.random.default_rng(6)
    samples = pd.Series([rng.normal(0, 0.1, n) for n in [64] * 700 + [0] + [20000] * 2])
    fs = pd.Series(8000, index=samples.index)
    seen = []
    for at, x, rate in G.per_shape(samples, fs):
        assert len(x) == 1 or x.size <= G.BLOCK_SAMPLES
        assert rate == 8000.0 and all((samples[i] == row).all() for i, row in zip(at, x))
        seen += list(at)
    assert sorted(seen) == [i for i in samples.index if i != 700]


def test_band_dimension_shows_rounded_edges_but_selects_on_exact_ones(spark):
    rates = spark.createDataFrame([(1, 44100), (2, 8000), (2, 8000), (3, None)], "recording_id long, fs int")
    exact = rounded(P.band_dimension(rates))
    short = P.band_dimension(rates, digits=6)
    assert short.columns == exact.columns
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, exact.collect()))
    plan = short._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan and "POWER(" not in plan.upper()
