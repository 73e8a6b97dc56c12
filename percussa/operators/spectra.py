"""Time weighting, spectra and bands."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from percussa.functions import dsp
from percussa.functions import levels as L
from percussa.operators.calibration import with_context
from percussa.operators.hierarchy import decayed_before
from percussa.operators.ordered import neighbours

DOUBLES = T.ArrayType(T.DoubleType())
TIME_CONSTANTS = {"fast": 0.125, "slow": 1.0}


def _detector(fn):
    @F.pandas_udf(DOUBLES)
    def run(samples: pd.Series, fs: pd.Series, start: pd.Series) -> pd.Series:
        return pd.Series([fn(np.asarray(x, float), float(rate), float(y)) if len(x) else x
                          for x, rate, y in zip(samples, fs, start)], dtype=object)

    return run


def exponential_of(tau: float):
    """Array kernel: exponential average of squares, from a start value."""
    return _detector(lambda x, fs, y: dsp.exponential_average(x * x, fs, tau, y))


hold_of = _detector(lambda x, fs, y: dsp.decaying_hold(x, fs, dsp.HOLD_S, y))


def max_exponential(samples: str, fs: str, tau: float, hop: Column) -> Column:
    """Largest exponential average at every hop-th sample, as an array expression."""
    start = F.struct(F.lit(0.0).alias("y"), F.lit(0).alias("i"), F.lit(0.0).alias("top"))

    def walk(a: Column) -> Column:
        def step(acc, x):
            y = a["a"] * x * x + (1 - a["a"]) * acc["y"]
            top = F.when(acc["i"] % a["hop"] == 0, F.greatest(acc["top"], y)).otherwise(acc["top"])
            return F.struct(y.alias("y"), (acc["i"] + 1).alias("i"), top.alias("top"))

        return F.aggregate(samples, start, step, lambda acc: acc["top"])

    share = F.struct((1 - F.exp(-1.0 / (F.col(fs) * tau))).alias("a"), hop.alias("hop"))
    return L.let(share, walk)


def _started(chunks: DataFrame, keys: list[str], chunk: int, tau: float, kernel, how: str) -> DataFrame:
    """Chunks with `start`, what a detector holds when the chunk begins: a prefix scan over the ends of all chunks before."""
    begin = F.col("chunk_id") * chunk
    ends = chunks.where(F.size("samples") > 0).select(
        *keys, "chunk_id", begin.alias("begin"), (begin + F.size("samples")).alias("at"), (F.col("fs") * tau).alias("scale"),
        F.element_at(kernel("samples", "fs", F.lit(0.0)), -1).alias("end"))
    starts = decayed_before(ends, keys, "chunk_id", "at", "end", "scale", how)
    return chunks.join(starts, [*keys, "chunk_id"], "left").withColumn("start", F.coalesce("start", F.lit(0.0)))


def exponential_chunks(chunks: DataFrame, keys: list[str], chunk: int, tau: float) -> DataFrame:
    """Exponential average of squares over a chunked recording, seamless at the borders; each row has its own rate."""
    kernel = exponential_of(tau)
    started = _started(chunks, keys, chunk, tau, kernel, "sum")
    return started.select(*keys, "chunk_id", "fs", kernel("samples", "fs", "start").alias("mean_square"))


def impulse_chunks(chunks: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """35 ms average followed by the decaying hold, over a chunked recording."""
    attack = exponential_chunks(chunks, keys, chunk, dsp.IMPULSE_S).withColumnRenamed("mean_square", "samples")
    started = _started(attack, keys, chunk, dsp.HOLD_S, hold_of, "max")
    return started.select(*keys, "chunk_id", "fs", hold_of("samples", "fs", "start").alias("mean_square"))


def level_curve(averaged: DataFrame, keys: list[str], hop: int, chunk: int, fs: int, curve: str) -> DataFrame:
    """Long level history at every hop-th sample: (keys, curve, t, level)."""
    # The outer form keeps Spark from moving a size test on the kernel's result into the join below it.
    long = averaged.select(*keys, "chunk_id", F.posexplode_outer("mean_square").alias("_p", "_ms")).where("_p IS NOT NULL")
    n = F.col("chunk_id") * chunk + F.col("_p")
    return long.where(n % hop == 0).select(*keys, F.lit(curve).alias("curve"), (n / fs).alias("t"),
                                           L.power_level("_ms").alias("level"))


_FRAMES = T.ArrayType(T.StructType([T.StructField("frame", T.LongType()), T.StructField("values", DOUBLES)]))


def stft_of(nperseg: int, noverlap: int, window: str = "hann", scaling: str = "rms"):
    """Array kernel: frames of one window, (frame, values per bin)."""

    @F.pandas_udf(_FRAMES)
    def run(samples: pd.Series, fs: pd.Series) -> pd.Series:
        out = []
        for x, rate in zip(samples, fs):
            _, _, value = dsp.stft_frames(np.asarray(x, float), float(rate), nperseg, noverlap, window, scaling)
            out.append([{"frame": i, "values": v} for i, v in enumerate(value)])
        return pd.Series(out, dtype=object)

    return run


def stft(windows: DataFrame, keys: list[str], nperseg: int, noverlap: int, window: str = "hann",
         scaling: str = "rms") -> DataFrame:
    """Long spectrogram of windows: (keys, frame, t, bin, frequency, value)."""
    kernel = stft_of(nperseg, noverlap, window, scaling)
    frames = windows.select(*keys, "fs", F.inline(kernel("samples", "fs")))
    return _long_frames(frames, keys, nperseg, noverlap)


def _long_frames(frames: DataFrame, keys: list[str], nperseg: int, noverlap: int) -> DataFrame:
    t = (F.col("frame") * (nperseg - noverlap) + nperseg / 2) / F.col("fs")
    return frames.select(*keys, "fs", "frame", t.alias("t"), F.posexplode("values").alias("bin", "value")).withColumn(
        "frequency", F.col("bin") * F.col("fs") / nperseg)


def stft_chunks(chunks: DataFrame, keys: list[str], chunk: int, nperseg: int, noverlap: int, window: str = "hann",
                scaling: str = "rms") -> DataFrame:
    """Spectrogram of chunked recordings; a frame belongs to the chunk it starts in."""
    hop = nperseg - noverlap
    after = math.ceil(nperseg / chunk)

    @F.pandas_udf(_FRAMES)
    def run(samples: pd.Series, fs: pd.Series, first: pd.Series, core: pd.Series) -> pd.Series:
        out = []
        for x, rate, begin, width in zip(samples, fs, first, core):
            x = np.asarray(x, float)
            skip = -int(begin) % hop
            starts = range(skip, min(int(width), len(x) - nperseg + 1), hop)
            rows = []
            if len(starts):
                used = x[skip:starts[-1] + nperseg]
                _, _, value = dsp.stft_frames(used, float(rate), nperseg, noverlap, window, scaling)
                rows = [{"frame": (int(begin) + s) // hop, "values": v} for s, v in zip(starts, value)]
            elif begin == 0 and len(x) < nperseg:
                rows = [{"frame": 0, "values": dsp.stft_frames(x, float(rate), nperseg, noverlap, window, scaling)[2][0]}]
            out.append(rows)
        return pd.Series(out, dtype=object)

    wide = with_context(chunks, keys, 0, after)
    frames = wide.select(*keys, "fs", F.inline(run("samples", "fs", F.col("chunk_id") * chunk, F.col("core"))))
    return _long_frames(frames, keys, nperseg, noverlap)


def weighting_curve(frequency: Column, kind: str) -> Column:
    """Closed-form A or C weighting in dB; 0 for Z."""
    f = F.greatest(frequency, F.lit(L.EPS))
    f2 = f * f
    q1, q2, q3, q4 = (c * c for c in (dsp.F1, dsp.F2, dsp.F3, dsp.F4))
    if kind == "A":
        ratio = q4 * f2 * f2 / ((f2 + q1) * F.sqrt((f2 + q2) * (f2 + q3)) * (f2 + q4) + L.EPS)
        return 20 * F.log10(ratio + L.EPS) + 2.0
    if kind == "C":
        return 20 * F.log10(q4 * f2 / ((f2 + q1) * (f2 + q4) + L.EPS) + L.EPS) + 0.062
    return F.lit(0.0)


def stft_levels(frames: DataFrame, kind: str = "Z", scaling: str = "rms", floor_dB: float = -20.0) -> DataFrame:
    """Weighted levels of a spectrogram, clamped from below. One transform serves every weighting."""
    base = L.amplitude_level("value") if scaling == "rms" else L.power_level("value")
    level = base + weighting_curve(F.col("frequency"), kind)
    return frames.withColumn("level", F.greatest(level, F.lit(floor_dB)))


def spectral_peak(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Highest level and the frequency of the bin that reaches it."""
    return levels.groupBy(*keys).agg(F.max("level").alias("peak_dB"),
                                     F.max_by("frequency", F.struct("level", -F.col("bin"))).alias("peak_Hz"))


def recommended_nperseg(fs: Column, target_ms: float = 2.0) -> Column:
    """Power of two nearest to `target_ms`, at least 128."""
    target = F.greatest(F.lit(128.0), F.bround(fs * target_ms / 1000))
    return F.pow(F.lit(2.0), F.bround(F.log2(target))).cast("int")


def window_resolution(rates: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Noise bandwidth and gain of every spectral window at every row's fs and nperseg."""
    terms = {"rectangular": [1.0], "hann": [0.5, 0.5], "hamming": [0.54, 0.46], "blackman": [0.42, 0.5, 0.08],
             "flattop": [0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368]}
    rows = F.array(*[F.struct(F.lit(n).alias("window"), F.array(*[F.lit((-1.0) ** i * c) for i, c in enumerate(terms[n])]).alias("_c"))
                     for n in names or list(terms)])
    out = rates.select("*", F.inline(rows))
    n, c = F.col("nperseg"), F.col("_c")
    # Sums of a periodic cosine window in closed form: N c0 and N (c0^2 + half of the other squares).
    squares = F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v / 2) + c[0] * c[0] / 2
    enbw = squares / (c[0] * c[0])
    return out.select(*rates.columns, "window", enbw.alias("enbw_bins"), (enbw * F.col("fs") / n).alias("enbw_Hz"),
                      c[0].alias("coherent_gain"))


def band_dimension(rates: DataFrame, fraction: float = 3.0, digits: int | None = None) -> DataFrame:
    """Nominal, exact centre and edges of the bands every row's fs can carry; `digits` rounds what is shown."""
    g = 10 ** 0.3

    def shown(v: Column) -> Column:
        return v if digits is None else F.round(v, digits) + F.lit(0.0)

    def band(nominal: Column) -> Column:
        centre = 1000 * F.pow(F.lit(g), F.round(fraction * F.ln(nominal / 1000) / math.log(g)) / fraction)
        low, high = centre * g ** (-0.5 / fraction), centre * g ** (0.5 / fraction)
        return F.struct(shown(nominal).alias("nominal_Hz"), shown(centre).alias("centre_Hz"), shown(low).alias("low_Hz"),
                        shown(high).alias("high_Hz"), centre.alias("_centre"), high.alias("_high"))

    # All of it is constant, so Spark works the table out once and only multiplies the rows by it.
    out = rates.select("*", F.inline(F.array(*[band(F.lit(float(v))) for v in dsp.NOMINAL_BANDS])))
    return out.where((F.col("_high") < F.col("fs") / 2) & (F.col("_centre") <= 0.45 * F.col("fs"))).drop("_centre", "_high")


def overall_level(bands: DataFrame, keys: list[str], level: str = "level") -> DataFrame:
    """Level of the summed band power per frame."""
    return bands.groupBy(*keys).agg(L.energy_sum(level).alias("overall_dB"))


def exposure_from_levels(levels: DataFrame, keys: list[str], time_s: str, order: list[str], level: str = "level",
                         limit: int | None = None) -> DataFrame:
    """Exposure and equivalent level of level histories, by the trapezoid rule on power."""
    rows = levels.withColumn("_pw", L.power_of(level))
    seen = neighbours(rows, keys, order, lag={"_t0": time_s, "_p0": "_pw"}, limit=limit)
    area = (F.col("_pw") + F.col("_p0")) / 2 * (F.col(time_s) - F.col("_t0"))
    g = seen.groupBy(*keys).agg(F.count("*").alias("n_frames"), F.sum(area).alias("_e"), F.min(time_s).alias("_a"),
                                F.max(time_s).alias("_b"), F.max("_pw").alias("_one"))
    single = F.col("n_frames") == 1
    energy = F.when(single, F.col("_one") * F.when(F.col("_a") > 0, 2 * F.col("_a")).otherwise(1.0)).otherwise(F.col("_e"))
    duration = F.when(single, 1.0).otherwise(F.greatest(F.col("_b") - F.col("_a"), F.lit(L.EPS)))
    sel = 10 * F.log10(F.greatest(energy, F.lit(L.EPS)))
    return g.select(*keys, "n_frames", sel.alias("exposure_dB"), (sel - 10 * F.log10(duration)).alias("leq_dB"))


def verify_bands(response: DataFrame, bands: DataFrame, keys: list[str], tolerance: float = 0.1) -> DataFrame:
    """-3 dB points of measured band responses against the nominal edges.

    response: (keys, frequency, level); bands: (keys, low_Hz, high_Hz).
    """
    top = response.groupBy(*keys).agg(F.max("level").alias("_top"))
    near = response.join(top, keys).where(F.col("level") >= F.col("_top") - 3)
    edges = near.groupBy(*keys).agg(F.min("frequency").alias("measured_low_Hz"), F.max("frequency").alias("measured_high_Hz"))
    room = tolerance * (F.col("high_Hz") - F.col("low_Hz"))
    return edges.join(bands, keys).withColumn("conforms", (F.abs(F.col("measured_low_Hz") - F.col("low_Hz")) <= room)
                                              & (F.abs(F.col("measured_high_Hz") - F.col("high_Hz")) <= room))


_BAND_LEVELS = T.ArrayType(T.StructType([
    T.StructField("band_Hz", T.DoubleType()), T.StructField("frame", T.LongType()), T.StructField("level", T.DoubleType())]))


def band_levels_of(weighting: str = "fast", hop_ms: float = 10.0, lowest: float = 0.0, highest: float = 1e9):
    """Array kernel: band level histories of one window at frame centres."""

    @F.pandas_udf(_BAND_LEVELS)
    def run(samples: pd.Series, fs: pd.Series, lead: pd.Series) -> pd.Series:
        out = []
        for x, rate, skip in zip(samples, fs, lead):
            x, rate = np.asarray(x, float), float(rate)
            hop = max(1, round(hop_ms * rate / 1000))
            body = len(x) - int(skip)
            centre = (np.arange(math.ceil(body / hop)) + 0.5) * hop + int(skip)
            rows = []
            for nominal, y in dsp.band_signals(x, rate, lowest=lowest, highest=highest):
                y2 = y * y
                if weighting == "none":
                    cut = y2[int(skip):]
                    ms = np.array([cut[i:i + hop].mean() for i in range(0, len(cut), hop)])
                else:
                    d = dsp.impulse_average(y2, rate) if weighting == "impulse" else dsp.exponential_average(
                        y2, rate, TIME_CONSTANTS[weighting])
                    ms = np.interp(centre, np.arange(len(d)), d)
                level = 10 * np.log10(np.maximum(ms, L.EPS) / L.P_REF**2)
                rows += [{"band_Hz": nominal, "frame": i, "level": float(v)} for i, v in enumerate(level)]
            out.append(rows)
        return pd.Series(out, dtype=object)

    return run


def band_levels(chunks: DataFrame, keys: list[str], chunk: int, fs: int, weighting: str = "fast", hop_ms: float = 10.0,
                lead_chunks: int = 1, lowest: float = 0.0, highest: float = 1e9) -> DataFrame:
    """Band level histories of chunked recordings, each chunk warmed up on the chunks before it."""
    kernel = band_levels_of(weighting, hop_ms, lowest, highest)
    wide = with_context(chunks, keys, lead_chunks, 0)
    rows = wide.select(*keys, "chunk_id", F.inline(kernel("samples", "fs", "lead")))
    hop = max(1, round(hop_ms * fs / 1000))
    t = (F.col("chunk_id") * chunk + (F.col("frame") + 0.5) * hop) / fs
    return rows.select(*keys, "band_Hz", t.alias("t"), "level")
