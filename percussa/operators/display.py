"""Reductions that make recordings, strings and matrices small enough to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from percussa.functions import levels as L
from percussa.operators.detection import merged_intervals
from percussa.operators.ordered import neighbours, numbered, percentiles, union_all

PYRAMID = [2048, 8192, 32768]
SHOT_COLUMNS = 4096


def column_of(n: Column, size: Column, columns) -> Column:
    """Display column of sample n: column k holds [floor(k size / C), floor((k + 1) size / C))."""
    c = columns if isinstance(columns, Column) else F.lit(columns)
    return F.floor(((n + 1) * c + size - 1) / size) - 1


def minmax_envelope(samples: DataFrame, keys: list[str], sizes: DataFrame, columns: int) -> DataFrame:
    """Least and greatest sample of every display column."""
    # Hashing the one row a recording has spares sorting its samples.
    rows = samples.join(sizes.hint("shuffle_hash"), keys).withColumn("_c", F.least(F.lit(columns), F.col("size")))
    k = column_of(F.col("n").cast("long"), F.col("size"), F.col("_c"))
    return rows.groupBy(*keys, F.col("_c").alias("columns"), k.alias("k")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def envelope_pyramid(samples: DataFrame, keys: list[str], sizes: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """minmax_envelope at several widths; a width is left out once the one before holds every sample.

    Each width is a multiple of the one before, so where both are below the
    size the coarse columns are rolled up from the fine ones and the samples
    are read once.
    """
    levels = sorted(levels or PYRAMID)
    finest = minmax_envelope(samples, keys, sizes, levels[-1]).join(sizes, keys)
    out = []
    for i, c in enumerate(levels):
        part = finest if i == 0 else finest.where(F.col("size") > levels[i - 1])
        width = F.least(F.lit(c), F.col("size"))
        # The first sample of a fine column lies in the coarse column it belongs to.
        first = F.floor(F.col("k") * F.col("size") / F.col("columns"))
        k = F.when(F.col("columns") == width, F.col("k")).otherwise(column_of(first, F.col("size"), width))
        out.append(part.groupBy(*keys, F.lit(c).alias("level"), width.alias("columns"), k.alias("k")).agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    return union_all(out)


def pick_level(levels: DataFrame, views: DataFrame, keys: list[str]) -> DataFrame:
    """Coarsest width that gives a view at least one column per pixel, else the finest.

    levels: (keys, columns, duration_s); views: (keys, t0, t1, pixels, view).
    """
    j = views.join(levels, keys)
    span = F.greatest(F.lit(1e-9), F.col("t1") - F.col("t0"))
    enough = F.col("columns") * span / F.coalesce(F.nullif("duration_s", F.lit(0.0)), F.lit(1.0)) >= F.greatest(F.lit(1), "pixels")
    return j.groupBy(*keys, "view").agg(
        F.coalesce(F.min(F.when(enough, F.col("columns"))), F.max("columns")).alias("columns"))


def mixed_resolution(samples: DataFrame, shots: DataFrame, sizes: DataFrame, keys: list[str], pre: int, post: int,
                     max_points: int, cell: int = 65536, limit: int | None = None) -> DataFrame:
    """Every sample around shots, every step-th sample of the stretches between them."""
    near = shots.join(sizes, keys).select(
        *keys, F.greatest(F.lit(0), F.col("idx") - pre).alias("start"), F.least("size", F.col("idx") + post).alias("stop")
    ).where("stop > start")
    merged = merged_intervals(near, keys, limit)
    ordered = neighbours(merged, keys, ["start"], lag={"_prev": "stop"}, limit=limit)
    gaps = ordered.select(*keys, F.coalesce("_prev", F.lit(0)).cast("long").alias("start"), F.col("start").alias("stop"))
    ends = merged.groupBy(*keys).agg(F.max("stop").alias("_end"))
    rest = sizes.join(ends, keys, "left").select(*keys, F.coalesce("_end", F.lit(0)).cast("long").alias("start"), F.col("size").alias("stop"))
    full = merged.select(*keys, F.col("start").cast("long").alias("start"), "stop", F.lit(True).alias("full"))
    thin = gaps.unionByName(rest).where("stop > start").withColumn("full", F.lit(False))
    step = F.greatest(F.lit(1), F.floor(F.col("size") / max_points))
    parts = full.unionByName(thin).join(sizes.withColumn("_step", step).drop("size"), keys)
    parts = parts.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("stop") - 1) / cell))))
    cells = samples.withColumn("_cell", F.floor(F.col("n") / cell))
    # Stretches are few next to the samples; hashing them spares sorting the samples.
    j = cells.join(parts.hint("shuffle_hash"), [*keys, "_cell"]).where((F.col("n") >= F.col("start")) & (F.col("n") < F.col("stop")))
    return j.where(F.col("full") | ((F.col("n") - F.col("start")) % F.col("_step") == 0)).select(*keys, "n", "x", "full")


def thin_spectrogram(levels: DataFrame, keys: list[str], max_frames: int = 1500) -> DataFrame:
    """Every k-th frame so that at most `max_frames` remain, levels to a tenth of a dB."""
    last = levels.groupBy(*keys).agg((F.max("frame") + 1).alias("_frames"))
    step = F.ceil(F.col("_frames") / max_frames)
    return levels.join(last, keys).where(F.col("frame") % step == 0).withColumn("level", F.bround("level", 1)).drop("_frames")


def quantised(levels: DataFrame, keys: list[str], level: str = "level", step_dB: float = 0.1) -> DataFrame:
    """Levels as 16-bit counts above an offset; 65535 stands for a missing value."""
    v = L.finite(level)
    low = levels.groupBy(*keys).agg((F.floor(F.min(v) / step_dB) * step_dB).alias("offset_dB"))
    count = F.least(F.lit(65534.0), F.greatest(F.lit(0.0), F.bround((v - F.col("offset_dB")) / step_dB)))
    return levels.join(low, keys).withColumn("count", F.when(v.isNull(), 65535).otherwise(count).cast("int"))


def histogram(values: DataFrame, keys: list[str], value: str, limit: int | None = None) -> DataFrame:
    """Counts per bin, 3 to 24 bins by Freedman-Diaconis, Sturges where the quartiles meet."""
    v = L.finite(value)
    rows = values.withColumn("_v", v).where("_v IS NOT NULL")
    g = percentiles(rows, keys, "_v", {"_q1": 0.25, "_q3": 0.75}, [
        F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")], limit)
    span, iqr, n = F.col("high") - F.col("low"), F.col("_q3") - F.col("_q1"), F.col("n")
    width = F.when(iqr > 0, 2 * iqr / F.cbrt(n)).otherwise(span / (F.ceil(F.log2(n)) + 1))
    bins = F.when(span > 0, F.least(F.lit(24), F.greatest(F.lit(3), F.ceil(span / width)))).otherwise(1)
    g = g.where("n >= 2").withColumn("bins", bins.cast("int")).withColumn("_step", F.when(span > 0, span / bins).otherwise(1.0))
    j = rows.join(g, keys)
    b = F.least(F.col("bins") - 1, F.greatest(F.lit(0), F.floor((F.col("_v") - F.col("low")) / F.col("_step"))))
    return j.groupBy(*keys, "bins", "low", "_step", b.cast("int").alias("bin")).agg(F.count("*").alias("count")).select(
        *keys, "bins", "bin", (F.col("low") + F.col("bin") * F.col("_step")).alias("edge"), "count")


def figure_bins(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts per bin over padded, evenly spaced edges: min(24, max(6, n)) edges."""
    v = L.finite(value)
    g = values.where(v.isNotNull()).groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    pad = F.greatest(F.lit(0.5), 0.08 * (F.col("_hi") - F.col("_lo")))
    g = g.withColumn("low", F.col("_lo") - pad).withColumn("_top", F.col("_hi") + pad)
    bins = F.least(F.lit(24), F.greatest(F.lit(6), F.col("n"))) - 1
    g = g.withColumn("bins", bins.cast("int")).withColumn("_step", (F.col("_top") - F.col("low")) / bins)
    b = F.least(F.col("bins") - 1, F.floor((v - F.col("low")) / F.col("_step")))
    return values.where(v.isNotNull()).join(g, keys).groupBy(*keys, "bins", b.cast("int").alias("bin")).agg(F.count("*").alias("count"))


def ecdf(values: DataFrame, keys: list[str], value: str, order: list[str], limit: int | None = None) -> DataFrame:
    """Share of a string at or below each value, ties in order."""
    rows = values.where(L.finite(value).isNotNull())
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    return numbered(rows, keys, [value, *order], "_rank", limit).join(n, keys).withColumn(
        "share", F.col("_rank") / F.col("_n")).drop("_rank", "_n")


def shared_range(levels: DataFrame, keys: list[str], level: str = "level", span_dB: float = 70.0, round_to: float = 5.0) -> DataFrame:
    """Colour range of each group and the one all groups share."""
    each = levels.groupBy(*keys).agg(F.max(L.finite(level)).alias("_max"))
    top = F.ceil(F.col("_max") / round_to) * round_to
    # One row, the shared top, met through a constant key.
    every = each.agg(F.max(top).alias("_shared")).withColumn("_one", F.lit(1))
    return each.withColumn("_one", F.lit(1)).join(F.broadcast(every), "_one").select(
        *keys, (top - span_dB).alias("low"), top.cast("double").alias("high"), (F.col("_shared") - span_dB).alias("shared_low"),
        F.col("_shared").cast("double").alias("shared_high"))


def shot_overlay(windows: DataFrame, string: list[str], shot: list[str], threshold_dB: float = 3.0, align: str = "peak",
                 limit: int | None = None) -> DataFrame:
    """Traces on a common origin; a shot far from its string's median peak is marked.

    windows: (string, shot, fs, samples). `align`: peak or start.
    """
    loud = L.peak("samples")
    rows = windows.withColumn("peak_dB", L.amplitude_level(loud)).withColumn(
        "_origin", F.array_position(F.transform("samples", lambda x: F.abs(x)), loud) - 1 if align == "peak" else F.lit(0))
    center = percentiles(rows, string, "peak_dB", {"_median": 0.5}, [
        (F.max("peak_dB") - F.min("peak_dB")).alias("peak_spread_dB")], limit)
    out = rows.join(center, string).withColumn("marked", F.abs(F.col("peak_dB") - F.col("_median")) > threshold_dB)
    long = out.select(*string, *shot, "fs", "peak_dB", "peak_spread_dB", "marked", "_origin", F.posexplode("samples").alias("_n", "x"))
    return long.select(*string, *shot, ((F.col("_n") - F.col("_origin")) * 1000.0 / F.col("fs")).alias("t_ms"), "x",
                       "peak_dB", "peak_spread_dB", "marked")


