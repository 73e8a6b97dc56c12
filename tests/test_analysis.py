"""Files to shots to strings to insertion loss, end to end."""

import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from percussa.operators import calibration as C
from percussa.operators import pairing as P
from percussa.operators import shots as G
from percussa.plans import analysis as A
from percussa.sources import recordings as R

FS, SHOTS = 48000, [0.2, 0.6, 1.0, 1.4, 1.8]


def string(gain, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1e-5, int(2.2 * FS))
    t = np.arange(int(0.1 * FS)) / FS
    for i, s in enumerate(SHOTS):
        a = int(s * FS)
        x[a:a + len(t)] += gain * (1 + 0.02 * (i % 3)) * np.exp(-t / 0.004) * np.sin(2 * np.pi * 900 * t)
    return x


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("range")
    for name, gain, seed in (("ref.wav", 0.8, 1), ("test.wav", 0.2, 2)):
        with wave.open(str(d / name), "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(3)
            f.setframerate(FS)
            v = np.round(string(gain, seed) * (2**23 - 1)).astype("<i4")
            f.writeframes(v.view("u1").reshape(-1, 4)[:, :3].tobytes())
    return d


@pytest.mark.parametrize("chunk_s", [3.0, 0.5])
def test_insertion_loss_of_two_files(spark, folder, chunk_s):
    heads = R.probe_headers(R.list_recordings(spark, str(folder)))
    chunks = R.select_channel(R.read_chunks(heads, chunk_s), 0)
    factors = heads.select(F.col("name").alias("recording_id"), F.lit(100.0).alias("factor"))
    pascals = C.to_pascals(chunks, factors, ["recording_id"])
    s = A.Detection.at_rate(FS, refractory_ms=100.0, pre_ms=20.0, post_ms=150.0)
    found, metrics, stats = A.analyse(pascals, ["recording_id"], int(chunk_s * FS), s)
    shots = found.shots.orderBy("recording_id", "shot_number").collect()
    assert len(shots) == 10
    for r, want in zip(shots[:5], SHOTS):
        assert abs(r.idx / FS - want) < 0.002
    rows = metrics.where("recording_id = 'ref.wav'").orderBy("shot_number").collect()
    assert len(rows) == 5 and all(r.valid and not r.window_truncated for r in rows)
    top = max(abs(np.exp(-t / 0.004) * np.sin(2 * np.pi * 900 * t)) for t in np.arange(200) / FS)
    assert rows[0].Lpeak_Z == pytest.approx(20 * np.log10(80 * top / 20e-6), abs=0.1)
    loss = {r.metric: r for r in P.insertion_loss(
        stats.where("recording_id = 'ref.wav'").drop("recording_id").withColumn("k", F.lit(1)),
        stats.where("recording_id = 'test.wav'").drop("recording_id").withColumn("k", F.lit(1)), ["k"]).collect()}
    for m in ("Lpeak_Z", "LAE", "LZE", "LAImax"):
        assert loss[m].reduction_dB == pytest.approx(20 * np.log10(4), abs=0.05)
        assert loss[m].significant


def test_preview_keeps_every_recording(spark):
    rows = [(0, i, float(v)) for i, v in enumerate(string(0.5, 3)[: FS // 2])] + [(1, i, 0.0) for i in range(10)]
    known = spark.createDataFrame([(0,), (1,), (2,)], "rec int")
    out = {r.rec: r for r in A.preview(spark.createDataFrame(rows, "rec int, n long, x double"), ["rec"], A.Detection.at_rate(FS),
                                       recordings=known).collect()}
    assert out[2].n_shots == 0 and out[2].problem == "no samples could be read"
    assert out[0].n_shots == 1 and len(out[0].envelope) == 1600
    assert out[1].n_shots == 0 and out[1].columns == 10


def test_clipped_shots_stay_out_of_statistics(spark):
    x = string(0.6, 5)
    at = int(SHOTS[1] * FS)
    x[at + 10:at + 16] = 1.0
    size = FS // 2
    chunks = spark.createDataFrame([("r", k, FS, (x[k * size:(k + 1) * size] * 50).tolist()) for k in range(-(-len(x) // size))],
                                   "rec string, chunk_id long, fs int, samples array<double>")
    s = A.Detection.at_rate(FS, refractory_ms=100.0, pre_ms=20.0, post_ms=150.0)
    factor = spark.createDataFrame([("r", 50.0)], "rec string, factor double")
    _, metrics, stats = A.analyse(chunks, ["rec"], size, s, factor)
    rows = metrics.orderBy("shot_number").collect()
    assert [r.clipped for r in rows] == [False, True, False, False, False]
    assert [r.valid for r in rows] == [True, False, True, True, True]
    assert stats.where("metric = 'Lpeak_Z'").first().n == 4
    with pytest.raises(ValueError, match="rate"):
        A.analyse(chunks.withColumn("fs", F.lit(FS // 2)), ["rec"], size, s)


def test_weighting_hears_what_came_before_the_window(spark):
    """A low rumble that ends at the window's edge still rings in the C-weighted window, not in a cold one."""
    t = np.arange(2000) / FS
    led = np.concatenate([20 * np.sin(2 * np.pi * 30 * t[:1000]), np.zeros(400)])
    led[1200] = 1.0
    rows = [(1, led.tolist(), FS, 1000), (2, led[1000:].tolist(), FS, 0)]
    df = spark.createDataFrame(rows, "shot_number int, samples array<double>, fs int, lead int")
    warm, cold = G.shot_metrics(df, lead="lead").orderBy("shot_number").collect()
    assert warm.duration_s == cold.duration_s
    assert warm.LCE > cold.LCE + 3
    note = "weighting filters started without context"
    assert note in cold.notes and note not in warm.notes


def test_windows_are_high_passed(spark):
    """An offset under the window is no level."""
    x = np.zeros(4000)
    x[2000:2040] = np.hanning(40)
    rows = [(1, x.tolist(), FS), (2, (x + 5).tolist(), FS)]
    got = G.shot_metrics(spark.createDataFrame(rows, "shot_number int, samples array<double>, fs int")).orderBy("shot_number").collect()
    assert got[0].Lpeak_Z == pytest.approx(got[1].Lpeak_Z, abs=0.2)
