"""Metrics of one shot from its sample window.

Windows are array columns, so everything here is local to a row: no shuffle.
Only filters and transforms go through Arrow; the rest are array expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from percussa.functions import dsp
from percussa.functions import levels as L


# Samples that go through the transforms at once; padded spectra are many times larger.
BLOCK_SAMPLES = 1 << 14


def per_shape(samples: pd.Series, fs: pd.Series):
    """Rows of equal length and rate together, a block at a time: (positions, 2-D array, rate)."""
    lengths = samples.map(len)
    for (n, rate), every in lengths.groupby([lengths, fs]).groups.items():
        rows = max(1, BLOCK_SAMPLES // n) if n else len(every)
        for start in range(0, len(every) if n else 0, rows):
            at = every[start:start + rows]
            yield at, np.stack([np.asarray(samples[i], float) for i in at]), float(rate)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def envelope_of(samples: pd.Series) -> pd.Series:
    out = pd.Series([[]] * len(samples), index=samples.index, dtype=object)
    for at, x, _ in per_shape(samples, pd.Series(1, index=samples.index)):
        for i, e in zip(at, dsp.envelope(x)):
            out[i] = e
    return out


_WEIGHTED_FIELDS = ["Lpeak_A", "Lpeak_C", "LAE", "LCE", "LAFmax", "LASmax", "LZFmax", "LZSmax", "LAImax", "LZImax",
                    "spectral_centroid_Hz"]


_TRANSFORMED = T.StructType([T.StructField("envelope", T.ArrayType(T.DoubleType())),
                             *[T.StructField(n, T.DoubleType()) for n in _WEIGHTED_FIELDS]])


def _power(v):
    return 10 * np.log10(np.maximum(v, L.EPS) / L.P_REF**2)


def _transforms(out: pd.DataFrame, envelopes: pd.Series, at, z: np.ndarray, a: np.ndarray, c: np.ndarray, rate: float) -> None:
    """Fill the rows `at` from windows of equal shape: plain, A- and C-weighted."""
    env = dsp.envelope(z)
    start, stop = dsp.energy_bounds(z)
    n = np.arange(z.shape[-1])
    span = (n >= start[:, None]) & (n < stop[:, None])
    hop = max(1, int(rate) // 1000)
    squares = {"A": a * a, "C": c * c, "Z": z * z}
    for kind in ("A", "C"):
        out.loc[at, f"Lpeak_{kind}"] = _power(squares[kind].max(axis=-1))
        out.loc[at, f"L{kind}E"] = _power((squares[kind] * span).sum(axis=-1) / rate)
    for kind in ("A", "Z"):
        for letter, tau in (("F", dsp.FAST_S), ("S", dsp.SLOW_S)):
            y = dsp.exponential_average(squares[kind], rate, tau)[..., ::hop]
            out.loc[at, f"L{kind}{letter}max"] = _power(y.max(axis=-1))
        out.loc[at, f"L{kind}Imax"] = _power(dsp.impulse_average(squares[kind], rate).max(axis=-1))
    first, last = dsp.blast_bounds(env, rate)
    for i, row, e, lo, hi in zip(at, z, env, first, last):
        envelopes[i] = e
        out.loc[i, "spectral_centroid_Hz"] = dsp.centroid(row[lo:hi], rate)


@F.pandas_udf(_TRANSFORMED)
def transforms_of(samples: pd.Series, fs: pd.Series) -> pd.DataFrame:
    """Everything of a window that needs a transform, a filter or a detector, in one pass over Arrow."""
    out = pd.DataFrame(np.nan, index=samples.index, columns=_WEIGHTED_FIELDS)
    envelopes = pd.Series([[]] * len(samples), index=samples.index, dtype=object)
    for at, x, rate in per_shape(samples, fs):
        _transforms(out, envelopes, at, x, dsp.weighted(x, rate, "A"), dsp.weighted(x, rate, "C"), rate)
    out.insert(0, "envelope", envelopes)
    return out


_CONDITIONED = T.StructType([T.StructField("samples", T.ArrayType(T.DoubleType())), *_TRANSFORMED.fields])


def conditioned_of(cutoff: float | None):
    """Transforms of windows that come with `lead` samples before them.

    The window is high-passed at `cutoff`. The weighting filters run over the lead as well, so that what was ringing
    before the window is in them, and the lead is cut off after. `samples` is the conditioned window.
    """
    @F.pandas_udf(_CONDITIONED)
    def run(samples: pd.Series, fs: pd.Series, lead: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(np.nan, index=samples.index, columns=_WEIGHTED_FIELDS)
        envelopes = pd.Series([[]] * len(samples), index=samples.index, dtype=object)
        windows = pd.Series([[]] * len(samples), index=samples.index, dtype=object)

        def clean(x, rate):
            return x if cutoff is None else dsp.high_passed(x, rate, cutoff)

        for k in lead.unique():
            some = samples[lead == k]
            for at, x, rate in per_shape(some, fs[some.index]):
                if x.shape[-1] <= k:
                    continue
                z, whole = clean(x[..., k:], rate), clean(x, rate)
                a, c = (dsp.weighted(whole, rate, kind)[..., k:] for kind in ("A", "C"))
                _transforms(out, envelopes, at, z, a, c, rate)
                for i, row in zip(at, z):
                    windows[i] = row
        out.insert(0, "envelope", envelopes)
        out.insert(0, "samples", windows)
        return out

    return run


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("band_Hz", T.DoubleType()),
                                          T.StructField("exposure_dB", T.DoubleType())])))
def band_exposure_of(samples: pd.Series, fs: pd.Series) -> pd.Series:
    """Exposure of a window in every third-octave band its rate carries."""
    out = pd.Series([[]] * len(samples), index=samples.index, dtype=object)
    for at, x, rate in per_shape(samples, fs):
        rows = {i: [] for i in at}
        for nominal, y in dsp.band_signals(x, rate):
            level = 10 * np.log10(np.maximum((y * y).sum(axis=-1) / rate, L.EPS) / L.P_REF**2)
            for i, v in zip(at, level):
                rows[i].append({"band_Hz": nominal, "exposure_dB": float(v)})
        for i in at:
            out[i] = rows[i]
    return out


def _first(array: Column, test) -> Column:
    """Index from 0 of the first element that passes, or NULL."""
    hit = F.array_position(F.transform(array, test), True)
    return F.when(hit > 0, hit - 1)


def _last(array: Column, test) -> Column:
    return F.size(array) - 1 - _first(F.reverse(array), test)


def integration_span(samples: str = "samples", capture: float = 0.99) -> Column:
    """struct(start, stop): the span holding `capture` of the energy."""
    margin = (1 - capture) / 2
    none = F.lit(None).cast("int")

    def walk(total: Column) -> Column:
        def step(acc, v):
            s = acc["s"] + v * v
            return F.struct(
                s.alias("s"), (acc["i"] + 1).alias("i"),
                F.when(acc["start"].isNull() & (s / total >= margin), acc["i"]).otherwise(acc["start"]).alias("start"),
                F.when(acc["stop"].isNull() & (s / total >= 1 - margin), acc["i"] + 1).otherwise(acc["stop"]).alias("stop"))

        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i"), none.alias("start"), none.alias("stop"))

        def finish(acc):
            ok, n = total > L.EPS, acc["i"]
            start, stop = F.coalesce(acc["start"], n), F.coalesce(acc["stop"], n)
            return F.struct(F.when(ok, start).otherwise(0).alias("start"),
                            F.when(ok, F.least(n, F.greatest(stop, start + 1))).otherwise(n).alias("stop"))

        return F.aggregate(samples, zero, step, finish)

    return L.let(L.sum_squares(samples), walk)


def exposure(samples: Column, fs: Column) -> Column:
    """Exposure level of an array."""
    return L.power_level(L.sum_squares(samples) / fs)


def part(samples, start: Column, stop: Column) -> Column:
    return F.slice(samples, start + 1, F.greatest(stop - start, F.lit(0)))


def blast_span(envelope: str = "envelope", fs: str = "fs", down_dB: float = 20.0, guard_ms: float = 1.0) -> Column:
    """struct(start, stop) around the samples within `down_dB` of the envelope peak."""
    e = F.col(envelope)
    guard = F.floor(F.col(fs) * guard_ms / 1000).cast("int")

    def span(top: Column) -> Column:
        ok, share = top > L.EPS, 10 ** (-abs(down_dB) / 20)
        first, last = _first(e, lambda v: v >= top * share), _last(e, lambda v: v >= top * share)
        return F.struct(
            F.when(ok, F.greatest(F.lit(0), first - guard)).otherwise(0).cast("int").alias("start"),
            F.when(ok, F.least(F.size(e), last + guard + 1)).otherwise(F.size(e)).cast("int").alias("stop"))

    return L.let(F.array_max(e), span)


def b_duration_ms(envelope: str = "envelope", fs: str = "fs", down_dB: float = 20.0) -> Column:
    e, share = F.col(envelope), 10 ** (-abs(down_dB) / 20)
    return L.let(F.array_max(e), lambda top: F.when(
        top > L.EPS, F.size(F.filter(e, lambda v: v >= top * share)) / F.col(fs) * 1000.0).otherwise(0.0))


def crest_factor(blast: Column) -> Column:
    rms, peak = L.rms(blast), L.peak(blast)
    return F.when((rms < L.EPS) | (peak < L.EPS), 0.0).otherwise(20 * F.log10(peak / rms))


def excess_kurtosis(blast: Column) -> Column:
    """Population excess kurtosis of an array."""
    n = F.size(blast)

    def shape(mean: Column) -> Column:
        def moment(p: float) -> Column:
            return F.aggregate(blast, F.lit(0.0), lambda a, x: a + F.pow(x - mean, F.lit(p))) / n

        return L.let(moment(2.0), lambda m2: F.when((n < 4) | (m2 < L.EPS), 0.0).otherwise(moment(4.0) / (m2 * m2) - 3.0))

    return L.let(F.aggregate(blast, F.lit(0.0), lambda a, x: a + x) / n, shape)


def onset_index(envelope: str = "envelope") -> Column:
    """First sample whose envelope reaches half its peak."""
    e = F.col(envelope)
    return L.let(F.array_max(e), lambda top: F.when(top > L.EPS, _first(e, lambda v: v >= 0.5 * top)))


def with_rise_time(df: DataFrame, samples: str = "samples", envelope: str = "envelope", fs: str = "fs") -> DataFrame:
    """rise_time_us and rise_time_resolved of the first front, 10 to 90 percent."""
    x, rate, n = F.col(samples), F.col(fs), F.size(samples)
    out = df.withColumn("_on", onset_index(envelope))
    out = out.withColumn("_base", F.greatest(F.lit(0), F.col("_on") - F.floor(0.001 * rate)).cast("int"))
    stop = F.least(n, F.col("_on") + F.greatest(F.lit(4), F.floor(0.005 * rate))).cast("int")
    out = out.withColumn("_local", part(x, F.col("_base"), stop))
    out = out.withColumn("_up", F.array_max("_local") > L.EPS)
    out = out.withColumn("_sign", F.when(F.col("_up"), 1.0).otherwise(-1.0))
    best = F.when(F.col("_up"), F.array_max("_local")).otherwise(F.array_min("_local"))
    out = out.withColumn("_at", (F.array_position("_local", best) - 1 + F.col("_base")).cast("int"))
    out = out.withColumn("_peak", F.abs(best))
    # Signed samples up to and including the peak, latest first.
    back = L.let("_sign", lambda sign: F.reverse(F.transform(part(x, F.lit(0), F.col("_at") + 1), lambda v: v * sign)))
    out = out.withColumn("_back", back)
    b = F.col("_back")

    def crossing(share: float) -> Column:
        # First k, walking back, with b[k] >= level > b[k + 1].
        level = share * F.col("_peak")
        pairs = L.let(level, lambda at: F.zip_with(
            F.slice(b, F.lit(1), F.greatest(F.size(b) - 1, F.lit(0))),
            F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0))),
            lambda here, before: (here >= at) & (at > before)))
        hit = F.array_position(pairs, True)
        k = F.when(hit > 0, hit.cast("int"))
        here, before = F.get(b, k - 1), F.get(b, k)
        step = here - before
        return F.col("_at") - k + F.when(F.abs(step) > L.EPS, (level - before) / step).otherwise(0.0)

    out = out.withColumn("_x90", crossing(0.9)).withColumn("_x10", crossing(0.1))
    width = F.col("_x90") - F.col("_x10")
    ok = F.coalesce((n >= 3) & (F.col("_peak") > L.EPS) & (width > 0), F.lit(False))
    return out.withColumn("rise_time_us", F.when(ok, width / rate * 1e6).otherwise(0.0)).withColumn(
        "rise_time_resolved", ok & (width >= 2.0)).drop(
        "_on", "_base", "_local", "_up", "_sign", "_at", "_peak", "_back", "_x90", "_x10")


def with_a_duration(df: DataFrame, samples: str = "samples", envelope: str = "envelope", fs: str = "fs") -> DataFrame:
    """Length, impulse and signed peak of the phase that holds the first peak."""
    x, rate, n = F.col(samples), F.col(fs), F.size(samples)
    out = df.withColumn("_on", onset_index(envelope))
    stop = F.least(n, F.col("_on") + F.greatest(F.lit(4), F.floor(0.005 * rate))).cast("int")
    local = part(x, F.col("_on"), stop)
    out = out.withColumn("_sign", F.when(F.abs(F.array_max(local)) >= F.abs(F.array_min(local)), 1.0).otherwise(-1.0))
    out = out.withColumn("_signed", L.let("_sign", lambda sign: F.transform(x, lambda v: v * sign)))
    s = F.col("_signed")
    near = part(s, F.col("_on"), stop)
    out = out.withColumn("_top", F.array_max(near)).withColumn(
        "_at", (F.array_position(near, F.array_max(near)) - 1 + F.col("_on")).cast("int"))
    before = F.reverse(F.slice(s, F.lit(1), F.greatest(F.coalesce(F.col("_at"), F.lit(0)), F.lit(0))))
    start = F.col("_at") - F.coalesce(_first(before, lambda v: v <= 0), F.col("_at"))
    after = part(s, F.col("_at"), n)
    end = F.least(n - 1, F.coalesce(F.col("_at") + _first(after, lambda v: v <= 0), n - 1))
    out = out.withColumn("_start", start.cast("int")).withColumn("_end", end.cast("int"))
    ok = F.coalesce((n >= 3) & (F.col("_top") > L.EPS) & (F.col("_end") > F.col("_start")), F.lit(False))
    out = out.withColumn("_phase", F.when(ok, part(s, F.col("_start"), F.col("_end"))))
    total = F.aggregate("_phase", F.lit(0.0), lambda a, v: a + F.greatest(v, F.lit(0.0)))
    return out.withColumns({
        "a_duration_ms": F.when(ok, (F.col("_end") - F.col("_start")) / rate * 1000.0).otherwise(0.0),
        "specific_impulse_Pa_s": F.when(ok, total / rate).otherwise(0.0),
        "peak_overpressure_Pa": F.when(ok, F.col("_sign") * F.array_max("_phase")).otherwise(0.0),
    }).drop("_on", "_sign", "_signed", "_top", "_at", "_start", "_end", "_phase")


def window_noise(df: DataFrame, samples: str = "samples", fs: str = "fs", span: str = "blast") -> DataFrame:
    """Floor outside the blast and the ratio of the peak to it; NULL below 1 ms of quiet."""
    x, rate = F.col(samples), F.col(fs)
    quiet = F.concat(part(x, F.lit(0), F.col(span)["start"]), part(x, F.col(span)["stop"], F.size(x)))
    enough = F.size(quiet) >= F.floor(rate / 1000)
    floor = F.when(enough & (F.size(quiet) > 0), L.power_level(L.sum_squares(quiet) / F.size(quiet)))
    return df.withColumn("noise_floor_dB", floor).withColumn(
        "snr_dB", L.amplitude_level(L.peak(x)) - F.col("noise_floor_dB"))


def shot_metrics(windows: DataFrame, clipped: str | None = None, truncated: str | None = None, lead: str | None = None,
                 cutoff: float | None = 10.0) -> DataFrame:
    """Every per-shot metric of windows with samples (Pa) and fs.

    `lead` names a column with the number of samples that stand before the window in `samples`; `cutoff` is the
    high-pass in Hz, None for none.
    """
    led = F.lit(0) if lead is None else F.coalesce(F.col(lead), F.lit(0))
    out = windows.withColumn("_led", led.cast("int")).withColumn("_w", conditioned_of(cutoff)("samples", "fs", "_led"))
    out = out.withColumn("samples", F.col("_w")["samples"]).withColumn("envelope", F.col("_w")["envelope"])
    out = out.withColumn("span", integration_span()).withColumn("blast", blast_span())
    out = out.withColumn("_blast", part("samples", F.col("blast")["start"], F.col("blast")["stop"]))
    out = out.withColumns({
        "Lpeak_Z": L.amplitude_level(L.peak("samples")),
        "LZE": exposure(part("samples", F.col("span")["start"], F.col("span")["stop"]), F.col("fs")),
        "b_duration_ms": b_duration_ms(), "crest_factor_dB": crest_factor(F.col("_blast")),
        "kurtosis": excess_kurtosis(F.col("_blast")),
        **{n: F.col("_w")[n] for n in _WEIGHTED_FIELDS},
        "duration_s": F.size("samples") / F.col("fs"), "blast_duration_s": F.size("_blast") / F.col("fs"),
        "integration_window_s": (F.col("span")["stop"] - F.col("span")["start"]) / F.col("fs"),
    })
    out = window_noise(with_a_duration(with_rise_time(out)))
    flags = {"clipped": clipped, "window_truncated": truncated}
    out = out.withColumns({n: F.lit(False) if c is None else F.coalesce(F.col(c), F.lit(False)) for n, c in flags.items()})
    notes = F.array_compact(F.array(
        F.when(~F.col("rise_time_resolved") & (F.col("rise_time_us") > 0), "rise time is an upper bound"),
        F.when(F.col("clipped"), "clipped: levels are understated"),
        F.when(F.col("window_truncated"), "window truncated: exposure under-reports the event"),
        F.when(F.col("_led") == 0, "weighting filters started without context")))
    return out.withColumn("valid", ~F.col("clipped")).withColumn("notes", notes).drop(
        "envelope", "_w", "_blast", "_led", "samples")
