"""Order-dependent operators that hold when one key owns most of the rows.

A window over a key runs in one task. Every function here first asks for the
size of the largest group (one count, combined map-side). Up to `limit` rows a
plain window is used. Beyond it the rows are range-partitioned on key and
order, so that a hot key spans many partitions; windows run inside
(key, partition) and one summary row per (key, partition) carries the result
across. The cut is checkpointed because both branches must see the same ranges.

`order` must be a total order within a key, and keys must not be NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from percussa.session import GROUP_ROWS, checkpointed


def largest_group(df: DataFrame, keys: list[str]) -> int:
    row = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()
    return row[0] or 0


def is_hot(df: DataFrame, keys: list[str], limit: int | None) -> bool:
    return largest_group(df, keys) > (GROUP_ROWS if limit is None else limit)


def cut_by_range(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with `_cut`, an id that rises with (key, order)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order)
    return checkpointed(ranged.withColumn("_cut", F.spark_partition_id()))


def _summaries(cut: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    return cut.groupBy(*keys, "_cut").agg(*aggs)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str,
             limit: int | None = None) -> DataFrame:
    """Row number within each key, from 1."""
    if not is_hot(df, keys, limit):
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), keys, order,
                       "_one", name, limit=limit, hot=True).drop("_one")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str,
                limit: int | None = None, hot: bool | None = None) -> DataFrame:
    """Inclusive running sum of `value` within each key."""
    if hot is None:
        hot = is_hot(df, keys, limit)
    span = (Window.unboundedPreceding, Window.currentRow)
    if not hot:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*span)
        return df.withColumn(name, F.sum(value).over(w))
    cut = cut_by_range(df, keys, order)
    before = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        _summaries(cut, keys, [F.sum(value).alias("_part")])
        .withColumn("_before", F.coalesce(F.sum("_part").over(before), F.lit(0)))
        .drop("_part")
    )
    w = Window.partitionBy(*keys, "_cut").orderBy(*order).rowsBetween(*span)
    return (
        cut.withColumn(name, F.sum(value).over(w))
        .join(offsets, [*keys, "_cut"])
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop("_before", "_cut")
    )


def running_max(df: DataFrame, keys: list[str], order: list[str], value: str, name: str,
                limit: int | None = None) -> DataFrame:
    """Largest `value` among the EARLIER rows of the key (exclusive)."""
    before = (Window.unboundedPreceding, -1)
    if not is_hot(df, keys, limit):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*before)
        return df.withColumn(name, F.max(value).over(w))
    cut = cut_by_range(df, keys, order)
    w_part = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(*before)
    carried = (
        _summaries(cut, keys, [F.max(value).alias("_part")])
        .withColumn("_before", F.max("_part").over(w_part)).drop("_part")
    )
    w = Window.partitionBy(*keys, "_cut").orderBy(*order).rowsBetween(*before)
    return (
        cut.withColumn(name, F.max(value).over(w))
        .join(carried, [*keys, "_cut"])
        .withColumn(name, F.greatest(name, "_before"))
        .drop("_before", "_cut")
    )


def neighbours(df: DataFrame, keys: list[str], order: list[str],
               lag: dict[str, str] | None = None, lead: dict[str, str] | None = None,
               limit: int | None = None) -> DataFrame:
    """Values of the previous and next row: {new column: source column}."""
    lag, lead = lag or {}, lead or {}
    out = df
    if not is_hot(df, keys, limit):
        w = Window.partitionBy(*keys).orderBy(*order)
        for new, old in lag.items():
            out = out.withColumn(new, F.lag(old).over(w))
        for new, old in lead.items():
            out = out.withColumn(new, F.lead(old).over(w))
        return out
    cut = cut_by_range(df, keys, order)
    rank = F.struct(*order)
    aggs = [F.max_by(old, rank).alias(f"_l_{new}") for new, old in lag.items()]
    aggs += [F.min_by(old, rank).alias(f"_n_{new}") for new, old in lead.items()]
    aggs += [F.min(rank).alias("_first"), F.max(rank).alias("_last")]
    by_cut = Window.partitionBy(*keys).orderBy("_cut")
    edge = _summaries(cut, keys, aggs)
    for new in lag:
        edge = edge.withColumn(f"_l_{new}", F.lag(f"_l_{new}").over(by_cut))
    for new in lead:
        edge = edge.withColumn(f"_n_{new}", F.lead(f"_n_{new}").over(by_cut))
    w = Window.partitionBy(*keys, "_cut").orderBy(*order)
    out = cut
    for new, old in lag.items():
        out = out.withColumn(new, F.lag(old).over(w))
    for new, old in lead.items():
        out = out.withColumn(new, F.lead(old).over(w))
    out = out.join(edge, [*keys, "_cut"])
    for new in lag:
        out = out.withColumn(new, F.when(rank == F.col("_first"), F.col(f"_l_{new}")).otherwise(F.col(new)))
    for new in lead:
        out = out.withColumn(new, F.when(rank == F.col("_last"), F.col(f"_n_{new}")).otherwise(F.col(new)))
    extra = [c for c in out.columns if c.startswith(("_l_", "_n_"))] + ["_first", "_last", "_cut"]
    return out.drop(*extra)


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str,
            lag: dict[str, str], limit: int | None = None) -> DataFrame:
    """Number runs of rows; `starts` (over the lagged columns) opens a run."""
    seen = neighbours(df, keys, order, lag=lag, limit=limit)
    flagged = seen.withColumn("_start", F.when(starts, 1).otherwise(0).cast("long"))
    return running_sum(flagged, keys, order, "_start", name, limit=limit).drop("_start", *lag)


def percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float],
                extra: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per key.

    `extra` are further aggregates of the same groups. Small groups use the
    built-in exact percentile, in the same pass. For a hot group its value map
    would not fit one task, so equal values are counted first and the rank is a
    running sum of the counts over range-cut values.
    """
    extra = extra or []
    if not is_hot(df, keys, limit):
        return df.groupBy(*keys).agg(
            *extra, *[F.percentile(value, F.lit(p)).alias(name) for name, p in points.items()])
    rows = df.where(F.col(value).isNotNull())
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = running_sum(counted, keys, [value], "_n", "_upto", limit=limit)
    ranked = ranked.join(rows.groupBy(*keys).agg(F.count("*").alias("_total")), keys)
    aggs = []
    for name, p in points.items():
        pos = F.lit(p) * (F.col("_total") - 1)
        for end, k in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.min(F.when(F.col("_upto") > k, F.col(value))).alias(f"_{end}_{name}"))
    picked = ranked.groupBy(*keys, "_total").agg(*aggs)
    out = [*keys]
    for name, p in points.items():
        pos = F.lit(p) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (pos - F.floor(pos)) * (hi - lo)).alias(name))
    picked = picked.select(*out)
    if extra:
        return df.groupBy(*keys).agg(*extra).join(picked, keys, "left")
    return picked


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
