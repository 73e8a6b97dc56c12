"""Pa per full scale of recordings, from one of several sources, and filters on windows and recordings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from percussa.functions import dsp
from percussa.functions import levels as L
from percussa.operators.hierarchy import joined_by, met_from_both_sides
from percussa.operators.shots import per_shape
from percussa.session import checkpointed

SOURCES = ["Pa_per_FS", "chain", "sensitivity_dB", "preset"]


def calibrate(recordings: DataFrame, presets: DataFrame) -> DataFrame:
    """Factor, method and refusal of every recording. No source means uncalibrated.

    Sources: Pa_per_FS; sensitivity_mV_per_Pa with adc_full_scale_V and
    preamp_gain_dB; sensitivity_dB (re 1 V/Pa) with the same; a named preset.
    `presets` is a short dimension (preset, preset_Pa_per_FS).
    """
    rows = recordings.join(presets, "preset", "left")
    c = F.col
    gain = F.pow(F.lit(10.0), F.coalesce(c("preamp_gain_dB"), F.lit(0.0)) / 20)

    def chain(mv: Column) -> Column:
        return c("adc_full_scale_V") / (mv / 1000 * gain)

    factors = {
        "direct": c("Pa_per_FS"), "chain": chain(c("sensitivity_mV_per_Pa")),
        "chain_dB": chain(1000 * F.pow(F.lit(10.0), c("sensitivity_dB") / 20)), "preset": c("preset_Pa_per_FS"),
    }
    given = {"direct": c("Pa_per_FS"), "chain": c("sensitivity_mV_per_Pa"), "chain_dB": c("sensitivity_dB"), "preset": c("preset")}
    count = sum((g.isNotNull().cast("int") for g in given.values()), F.lit(0))
    method = F.coalesce(*[F.when(g.isNotNull(), name) for name, g in given.items()], F.lit("none"))
    factor = F.coalesce(*[F.when(given[n].isNotNull(), f) for n, f in factors.items()])
    refusal = (F.when(count > 1, "more than one calibration source")
               .when((count == 1) & F.coalesce(L.finite(factor) <= 0, F.lit(True)), "factor must be positive and finite"))
    out = recordings.columns
    return rows.select(
        *out, method.alias("method"), refusal.alias("refusal"), ((count == 1) & refusal.isNull()).alias("calibrated"),
        F.when(refusal.isNull(), F.coalesce(factor, F.lit(1.0))).alias("factor"))


def tone_level(samples: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """RMS and peak of the middle 60 percent of a tone recording."""
    n, size = F.col("n"), F.col("size")
    middle = samples.join(sizes, keys).where((n >= F.floor(size * 0.2)) & (n < F.floor(size * 0.8)))
    return middle.groupBy(*keys).agg(F.count("*").alias("n_middle"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"),
                                     F.max(F.abs("x")).alias("peak"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def power_spectrum(samples: pd.Series) -> pd.Series:
    """Power per bin of equal segments under a Hann window."""
    return samples.map(lambda v: np.abs(np.fft.rfft(np.asarray(v, float) * np.hanning(len(v)))) ** 2)


def dominant_frequency(samples: DataFrame, keys: list[str], sizes: DataFrame, fs: int, segment: int = 8192) -> DataFrame:
    """Strongest frequency of the middle of a recording, from summed segment spectra.

    A segment is one row, so a long tone is many small transforms, not one group.
    """
    n, size = F.col("n"), F.col("size")
    lo, hi = F.floor(size * 0.2), F.floor(size * 0.8)
    middle = samples.join(sizes, keys).where((n >= lo) & (n < hi)).withColumn("_s", F.floor((n - lo) / segment))
    packed = middle.groupBy(*keys, "_s").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("_a"))
    full = packed.where(F.size("_a") == segment)
    spectra = full.select(*keys, F.posexplode(power_spectrum(F.transform("_a", lambda v: v["x"]))).alias("bin", "p"))
    total = spectra.where("bin > 0").groupBy(*keys, "bin").agg(F.sum("p").alias("p"))
    return total.groupBy(*keys).agg((F.max_by("bin", F.struct("p", -F.col("bin"))) * (fs / segment)).alias("dominant_Hz"))


def calibrate_from_tone(samples: DataFrame, keys: list[str], fs: int, tone_Hz: float, tone_dB: float,
                        segment: int = 8192) -> DataFrame:
    """Factor from a calibrator tone, or why the tone cannot serve."""
    sizes = samples.groupBy(*keys).agg((F.max("n") + 1).alias("size"))
    level = tone_level(samples, keys, sizes).join(dominant_frequency(samples, keys, sizes, fs, segment), keys, "left")
    out = sizes.join(level, keys, "left")
    refusal = (F.when(F.col("size") < 0.1 * fs, "tone shorter than 100 ms").when(F.col("peak") >= 1 - 1e-4, "tone is clipped")
               .when(F.coalesce("rms", F.lit(0.0)) <= L.EPS, "tone is silent")
               .when(F.abs(F.col("dominant_Hz") - tone_Hz) > 0.05 * tone_Hz, "dominant frequency is not the tone's"))
    return out.select(*keys, "rms", "dominant_Hz", refusal.alias("refusal"),
                      F.when(refusal.isNull(), L.amplitude_of(F.lit(tone_dB)) / F.col("rms")).alias("Pa_per_FS"))


def tone_drift(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Level change between the tones before and after a session."""
    a = before.where("refusal IS NULL").select(*keys, F.col("rms").alias("_a"))
    b = after.where("refusal IS NULL").select(*keys, F.col("rms").alias("_b"))
    drift = 20 * F.log10(F.col("_b") / F.col("_a"))
    return a.join(b, keys).select(*keys, drift.alias("drift_dB"), (F.abs(drift) <= 0.5).alias("stable"))


def to_pascals(chunks: DataFrame, factors: DataFrame, keys: list[str]) -> DataFrame:
    """Samples times the factor of their recording."""
    rows = chunks.join(factors.select(*keys, "factor"), keys)
    return rows.withColumn("samples", L.scaled("samples", F.col("factor"))).drop("factor")


def _filter_udf(apply):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(samples: pd.Series, fs: pd.Series) -> pd.Series:
        return pd.Series([apply(np.asarray(x, float)[None, :], float(rate))[0] if len(x) else x
                          for x, rate in zip(samples, fs)], dtype=object)

    return run


band_limit = _filter_udf(dsp.detection_band)
weight_a = _filter_udf(lambda x, fs: dsp.weighted(x, fs, "A"))
weight_c = _filter_udf(lambda x, fs: dsp.weighted(x, fs, "C"))


def with_context(chunks: DataFrame, keys: list[str], before: int = 1, after: int = 1) -> DataFrame:
    """Chunks with the samples of their neighbours, and how many lead in.

    A chunk is copied to the chunks it is context for and regrouped by
    (keys, chunk_id), so a long recording is still many small groups.
    """
    spread = chunks.withColumn("_for", F.explode(F.sequence(F.col("chunk_id") - after, F.col("chunk_id") + before)))
    packed = spread.groupBy(*keys, "fs", F.col("_for").alias("_id")).agg(
        F.array_sort(F.collect_list(F.struct("chunk_id", "samples"))).alias("_a"))
    own = packed.where(F.exists("_a", lambda p: p["chunk_id"] == F.col("_id")))
    lead = F.aggregate(F.filter("_a", lambda p: p["chunk_id"] < F.col("_id")), F.lit(0), lambda n, p: n + F.size(p["samples"]))
    core = F.filter("_a", lambda p: p["chunk_id"] == F.col("_id"))[0]
    return own.select(*keys, "fs", F.col("_id").alias("chunk_id"), lead.alias("lead"), F.size(core["samples"]).alias("core"),
                      F.flatten(F.transform("_a", lambda p: p["samples"])).alias("samples"))


def filtered_chunks(chunks: DataFrame, keys: list[str], kernel, before: int = 1, after: int = 1) -> DataFrame:
    """A filter over chunks with context; only the core of each result is kept."""
    wide = with_context(chunks, keys, before, after).withColumn("_y", kernel("samples", "fs"))
    return wide.select(*keys, "fs", "chunk_id", F.slice("_y", F.col("lead") + 1, F.col("core")).alias("samples"))


_DOUBLES = T.ArrayType(T.DoubleType())


def _stretch_of(cutoff: float):
    """Array kernel: the map of a chunk between silent ones.

    That is begin, end, sum and count of known samples; then the forward state at the end and the backward state at the begin,
    each for the samples and for ones in their places, real parts first. A mean is taken off by as many of the latter.
    """

    @F.pandas_udf(_DOUBLES)
    def run(samples: pd.Series, fs: pd.Series, begin: pd.Series) -> pd.Series:
        out = [None] * len(samples)
        for at, x, rate in per_shape(samples, fs):
            pole, weight, direct = dsp.high_pass_pole(rate, cutoff)
            n, first, known = x.shape[-1], begin[at].to_numpy(), ~np.isnan(x)
            x = np.where(known, x, 0.0)
            places = (known[:1] if known.all() else known).astype(float)
            ends = []
            for part in (x, places):
                w = dsp.one_pole(part, pole, 0)
                back = (dsp.answered(part, w, weight, direct) * pole ** np.arange(n)).sum(axis=-1)
                ends.append(np.broadcast_to([w[:, -1].real, w[:, -1].imag, back.real, back.imag], (4, len(x))))
            rows = [first, first + n, x.sum(axis=-1), known.sum(axis=-1), *(e[k] for k in range(4) for e in ends)]
            for i, row in zip(at, np.column_stack(rows)):
                out[i] = row
        return pd.Series(out, dtype=object)

    return run


class _Row:
    """Neighbouring stretches in order, from a flat array of their maps, and the silence that a gap leaves after each."""

    def __init__(self, maps, rate, cutoff, mean=None):
        self.pole, self.weight, _ = dsp.high_pass_pole(float(rate), cutoff)
        m = np.asarray(maps, float).reshape(-1, 12)
        self.begin, self.end, self.sum, self.count = m[:, :4].T
        self.on, self.back = m[:, 4:6] + 1j * m[:, 6:8], m[:, 8:10] + 1j * m[:, 10:]
        if mean is not None:
            self.on, self.back = (v[:, :1] - mean * v[:, 1:] for v in (self.on, self.back))
        self.gap = np.maximum(np.r_[self.begin[1:] - self.end[:-1], 0], 0)[:, None]
        self.size = (self.end - self.begin)[:, None]
        self.decay, self.pause = self.pole**self.size, self.pole**self.gap

    def forwards(self, w):
        """The state each stretch begins with, and the one after the last."""
        out = []
        for on, decay, pause in zip(self.on, self.decay, self.pause):
            out.append(w)
            left = on + decay * w
            w = pause * left
        return np.array(out), left

    def backwards(self, met, v):
        """The state that comes back to each stretch, and the one before the first."""
        own = self.back + dsp.returned(self.size, met, self.pole, self.weight)
        rung = dsp.returned(self.gap, self.on + self.decay * met, self.pole, self.weight)
        out = []
        for back, decay, ring, pause in zip(own[::-1], self.decay[::-1], rung[::-1], self.pause[::-1]):
            v = ring + pause * v
            out.append(v)
            v = back + decay * v
        return np.array(out[::-1]), v


def _joined_stretches(cutoff: float):
    """Array kernel: neighbouring stretches as one."""

    @F.pandas_udf(_DOUBLES)
    def run(maps: pd.Series, fs: pd.Series) -> pd.Series:
        out = []
        for m, rate in zip(maps, fs):
            row = _Row(m, rate, cutoff)
            met, on = row.forwards(np.zeros(2, complex))
            _, back = row.backwards(met, np.zeros(2, complex))
            out.append([row.begin[0], row.end[-1], row.sum.sum(), row.count.sum(), *on.real, *on.imag, *back.real, *back.imag])
        return pd.Series(out, dtype=object)

    return run


def _silence_around(cutoff: float):
    """Array kernel: (forward state, backward state) a recording without its mean meets at its ends; its size and mean.

    The silence behind has five time constants (or the samples of the recording, if it has at most a tenth of those); the backward
    run begins there as if the last value had been for ever.
    """

    @F.pandas_udf(_DOUBLES)
    def run(maps: pd.Series, fs: pd.Series) -> pd.Series:
        out = []
        for m, rate in zip(maps, fs):
            mean = m[2] / m[3] if m[3] else 0.0
            row = _Row(m, rate, cutoff, mean)
            size, w, pole = row.size[0, 0], row.on[0, 0], row.pole
            pad = max(np.ceil(5 * rate / (2 * np.pi * cutoff)), 9) if cutoff > 0 else 9
            pad = size if pad >= 10 * size else pad
            last = 2 * (row.weight * pole**pad * w).real
            v = dsp.returned(pad, w, pole, row.weight) + pole**pad * last / (1 - pole)
            out.append([0.0, 0.0, v.real, v.imag, size, mean])
        return pd.Series(out, dtype=object)

    return run


def _handed_to_stretches(cutoff: float):
    """Array kernel: what each of the neighbouring stretches meets at its ends, from what all of them meet."""

    @F.pandas_udf(_DOUBLES)
    def run(maps: pd.Series, states: pd.Series, fs: pd.Series) -> pd.Series:
        out = []
        for m, s, rate in zip(maps, states, fs):
            row = _Row(m, rate, cutoff, s[5])
            w, _ = row.forwards(np.array([complex(s[0], s[1])]))
            v, _ = row.backwards(w, np.array([complex(s[2], s[3])]))
            out.append(np.column_stack([w.real, w.imag, v.real, v.imag, np.tile(s[4:], (len(w), 1))]).ravel())
        return pd.Series(out, dtype=object)

    return run


def _between(cutoff: float):
    """Array kernel: a chunk without the mean of its recording, filtered forwards and back from the states at its ends."""

    @F.pandas_udf(_DOUBLES)
    def run(samples: pd.Series, fs: pd.Series, states: pd.Series) -> pd.Series:
        out = [None] * len(samples)
        for at, x, rate in per_shape(samples, fs):
            pole, weight, direct = dsp.high_pass_pole(rate, cutoff)
            s, unknown = np.stack([states[i] for i in at]), np.isnan(x)
            x = np.where(unknown, 0.0, x - s[:, 5:])
            y = dsp.answered(x, dsp.one_pole(x, pole, s[:, 0] + 1j * s[:, 1]), weight, direct)
            v = dsp.one_pole(y[:, ::-1], pole, s[:, 2] + 1j * s[:, 3])[:, ::-1]
            z = np.where(s[:, 4:5] < 32, x, dsp.answered(y, v, weight, direct))
            for i, row in zip(at, np.where(unknown, np.nan, z)):
                out[i] = row
        return pd.Series(out, dtype=object)

    return run


def high_pass(chunks: DataFrame, keys: list[str], chunk: int, cutoff: float = 10.0) -> DataFrame:
    """Each recording without its mean, then a zero-phase second-order Butterworth high-pass over all of it, seamless at the borders.

    A chunk is an affine map of the states it meets at its ends, the forward run's from all chunks before and the backward
    run's from all after; `met_from_both_sides` composes the maps, so no task holds a recording. Recordings under 32 samples
    only lose their mean. Chunk k begins at sample k * `chunk`; missing samples and chunks are silent, and stay missing.
    """
    whole = [*keys, "fs"]
    # Read twice: both readers must see the same order of what the caller has numbered.
    held = checkpointed(chunks.select(*whole, "chunk_id", "samples").where(F.size("samples") > 0))
    begin = (F.col("chunk_id") * chunk).cast("double")
    maps = held.select(*whole, "chunk_id", _stretch_of(cutoff)("samples", "fs", begin).alias("map"))
    joined, ended, handed = _joined_stretches(cutoff), _silence_around(cutoff), _handed_to_stretches(cutoff)
    states = met_from_both_sides(maps, whole, "chunk_id", lambda m: joined(m, F.col("fs")), lambda m: ended(m, F.col("fs")),
                                 lambda m, s: handed(m, s, F.col("fs")), 6)
    met = joined_by(held, states, [*whole, "chunk_id"])
    return met.select(*whole, "chunk_id", _between(cutoff)("samples", "fs", "state").alias("samples"))


def tolerance_conformance(response: DataFrame, limits: DataFrame, keys: list[str], fs: int) -> DataFrame:
    """Measured response against nominal with its upper and lower limits, below Nyquist."""
    j = response.join(limits, "frequency").where(F.col("frequency") < fs / 2)
    error = F.col("measured_dB") - F.col("nominal_dB")
    return j.groupBy(*keys).agg(
        F.count("*").alias("n_points"), F.max(F.abs(error)).alias("max_error_dB"),
        F.bool_and((error <= F.col("plus_dB")) & (error >= -F.col("minus_dB"))).alias("conforms"))
