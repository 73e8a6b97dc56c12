"""Recording quality from long samples, mergeable chunk by chunk."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from percussa.functions import levels as L
from percussa.operators.detection import pinned_runs
from percussa.operators.ordered import percentiles

# Fixed limits of the quality rules.
CLIP_TOLERANCE = 1e-4
RAIL_RUN = 2
CEILING_RUN = 3
CEILING_RUNS = 2
MIN_CREST_DB = 6.0
MIN_RATE = 48_000
MIN_SNR_DB = 20.0
MIN_HEADROOM_DB = 1.0


def clipping_runs(samples: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Samples and runs pinned at full scale; every recording has a row."""
    runs = pinned_runs(samples, keys, F.abs("x") >= 1 - CLIP_TOLERANCE, limit).where(F.col("length") >= RAIL_RUN)
    g = runs.groupBy(*keys).agg(F.sum("length").alias("clipped_samples"), F.count("*").alias("clipped_runs"))
    every = samples.select(*keys).distinct()
    return every.join(g, keys, "left").na.fill(0, ["clipped_samples", "clipped_runs"])


def ceiling_clipping(samples: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Plateaus at a recording's own largest value, below full scale."""
    stats = samples.groupBy(*keys).agg(F.max(F.abs("x")).alias("ceiling_FS"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("_rms"))
    near = samples.join(stats.select(*keys, "ceiling_FS"), keys)
    pinned = F.abs(F.abs("x") - F.col("ceiling_FS")) <= F.col("ceiling_FS") * CLIP_TOLERANCE
    runs = pinned_runs(near, keys, pinned, limit)
    long_run = F.col("length") >= CEILING_RUN
    g = runs.groupBy(*keys).agg(F.sum(F.when(long_run, F.col("length")).otherwise(0)).alias("samples"),
                                F.count_if(long_run).alias("runs"), F.max("length").alias("longest_run"))
    out = stats.join(g, keys, "left").na.fill(0, ["samples", "runs", "longest_run"])
    crest = 20 * F.log10(F.greatest("ceiling_FS", F.lit(L.EPS)) / F.greatest("_rms", F.lit(L.EPS)))
    out = out.withColumn("crest_dB", crest)
    found = (F.col("runs") >= CEILING_RUNS) & (F.col("ceiling_FS") < 1 - CLIP_TOLERANCE) & (F.col("crest_dB") >= MIN_CREST_DB)
    return out.withColumn("detected", found).drop("_rms")


def basic_sums(samples: DataFrame, keys: list[str]) -> DataFrame:
    x = F.col("x")
    return samples.groupBy(*keys).agg(
        F.count("*").alias("n_samples"), F.max(F.abs(x)).alias("peak_FS"), F.sum(x).alias("sum_x"), F.sum(x * x).alias("sum_x2"))


def frame_floor(samples: DataFrame, keys: list[str], frame: int, sizes: DataFrame, limit: int | None = None) -> DataFrame:
    """5th percentile of the mean squares of whole frames; the plain mean below 20 frames."""
    whole = F.floor(F.col("n_samples") / frame)
    frames = samples.groupBy(*keys, F.floor(F.col("n") / frame).alias("_f")).agg(F.avg(F.col("x") * F.col("x")).alias("ms"))
    frames = frames.join(sizes.select(*keys, "n_samples"), keys).where(F.col("_f") < whole)
    g = percentiles(frames, keys, "ms", {"_quiet": 0.05}, limit=limit)
    out = sizes.join(g, keys, "left")
    return out.withColumn("noise_ms", F.when(whole >= 20, F.col("_quiet")).otherwise(F.col("sum_x2") / F.col("n_samples"))).drop("_quiet")


def low_frequency_fraction(samples: DataFrame, keys: list[str], sizes: DataFrame, fs: int, cutoff: float = 20.0,
                           segment: int = 1 << 20) -> DataFrame:
    """Share of the energy below `cutoff`: the energies of the spectra of all segments, summed.

    A recording below two segments is one spectrum; a longer one is many groups of bounded size, the last of which takes
    the rest, so every sample counts.
    """
    last = F.greatest(F.lit(0), F.floor(F.col("n_samples") / segment) - 1)
    cut = samples.join(sizes.select(*keys, "n_samples"), keys).where("n_samples >= 16").withColumn(
        "_segment", F.least(F.floor(F.col("n") / segment), last))
    types = {f.name: f.dataType.simpleString() for f in samples.schema.fields}

    def energies(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("n")["x"].to_numpy()
        power = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x)))) ** 2
        low = power[np.fft.rfftfreq(len(x), 1.0 / fs) < cutoff].sum()
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "_low": low, "_all": power.sum()}])

    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", _low double, _all double"
    parts = cut.select(*keys, "_segment", "n", "x").groupBy(*keys, "_segment").applyInPandas(energies, schema)
    found = parts.groupBy(*keys).agg(F.sum("_low").alias("_low"), F.sum("_all").alias("_all"))
    share = F.when(F.col("_all") >= L.EPS, F.col("_low") / F.col("_all")).otherwise(F.lit(0.0))
    return sizes.select(*keys).join(found.select(*keys, share.alias("lf_fraction")), keys, "left").na.fill(0.0, ["lf_fraction"])


def quality_columns(fs: int, pa_per_fs: Column, calibrated: Column) -> dict[str, Column]:
    c = F.col
    rms = F.sqrt(c("sum_x2") / c("n_samples"))
    dc = c("sum_x") / c("n_samples")
    return {
        "duration_s": c("n_samples") / fs, "headroom_dB": -20 * F.log10(F.greatest("peak_FS", F.lit(L.EPS))),
        "clipping_ratio": c("clipped_samples") / c("n_samples"), "dc_offset_FS": dc,
        "dc_offset_dB": 20 * F.log10(F.greatest(F.abs(dc), F.lit(L.EPS)) / F.greatest(rms, F.lit(L.EPS))),
        "peak_level_dB": L.amplitude_level(c("peak_FS") * pa_per_fs),
        "noise_floor_dB": L.power_level(c("noise_ms") * pa_per_fs * pa_per_fs),
        "sample_rate_adequate": F.lit(fs >= MIN_RATE), "calibrated": calibrated,
    }


def quality_rules() -> dict[str, Column]:
    """Errors and warnings of one quality row."""
    c = F.col
    clipped = c("clipped_runs") > 0
    ceiling = c("ceiling_detected")
    return {
        "errors": F.array_compact(F.array(F.when(clipped, "clipped").when(ceiling, "clipped below full scale"))),
        "warnings": F.array_compact(F.array(
            F.when(~clipped & ~ceiling & (c("headroom_dB") < MIN_HEADROOM_DB), "little headroom"),
            F.when(~c("calibrated"), "uncalibrated"), F.when(c("snr_dB") < MIN_SNR_DB, "low signal-to-noise"),
            F.when(F.abs("dc_offset_FS") > 1e-3, "dc offset"), F.when(c("lf_fraction") > 0.5, "energy below 20 Hz"),
            F.when(~c("sample_rate_adequate"), "sample rate too low"))),
    }


def signal_quality(samples: DataFrame, keys: list[str], fs: int, pa_per_fs: float = 1.0, calibrated: bool = True,
                   limit: int | None = None) -> DataFrame:
    """One quality row per recording."""
    sizes = basic_sums(samples, keys)
    floor = frame_floor(samples, keys, max(1, fs // 100), sizes, limit)
    ceiling = ceiling_clipping(samples, keys, limit).select(*keys, F.col("detected").alias("ceiling_detected"))
    out = (floor.join(clipping_runs(samples, keys, limit), keys).join(ceiling, keys)
           .join(low_frequency_fraction(samples, keys, sizes, fs), keys))
    out = out.withColumns(quality_columns(fs, F.lit(pa_per_fs), F.lit(calibrated)))
    return out.withColumn("snr_dB", F.col("peak_level_dB") - F.col("noise_floor_dB")).withColumns(quality_rules())


def merge_quality(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Chunk rows into recording rows: sums and maxima are exact, floors take the quietest chunk."""
    c = F.col
    g = parts.groupBy(*keys).agg(
        F.sum("n_samples").alias("n_samples"), F.max("peak_FS").alias("peak_FS"), F.sum("sum_x").alias("sum_x"),
        F.sum("sum_x2").alias("sum_x2"), F.sum("clipped_samples").alias("clipped_samples"),
        F.sum("clipped_runs").alias("clipped_runs"), F.min("noise_floor_dB").alias("noise_floor_dB"),
        F.avg("lf_fraction").alias("lf_fraction"), F.max("peak_level_dB").alias("peak_level_dB"))
    # Warnings come from a short fixed vocabulary, so their distinct union is small.
    texts = parts.select(*keys, F.explode("warnings").alias("_w")).distinct().groupBy(*keys).agg(
        F.array_sort(F.collect_list("_w")).alias("warnings"))
    out = g.join(texts, keys, "left")
    return out.withColumns({
        "warnings": F.coalesce("warnings", F.array().cast("array<string>")),
        "headroom_dB": -20 * F.log10(F.greatest("peak_FS", F.lit(L.EPS))),
        "dc_offset_FS": c("sum_x") / c("n_samples"), "clipping_ratio": c("clipped_samples") / c("n_samples"),
        "snr_dB": c("peak_level_dB") - c("noise_floor_dB")})


def grade(value: Column, good: float, fair: float, higher_is_better: bool = True) -> Column:
    """PASS, CAUTION or FAIL by two cut-offs; INFO where nothing was measured."""
    if not higher_is_better:
        value, good, fair = -value, -good, -fair
    return F.when(value.isNull(), "INFO").when(value >= good, "PASS").when(value >= fair, "CAUTION").otherwise("FAIL")
