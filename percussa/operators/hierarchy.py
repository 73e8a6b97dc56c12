"""Summaries of a long series in levels of WIDTH, so that no task and no row holds more than WIDTH entries of a key.

`decayed_before` is a prefix scan of decaying values; `met_from_both_sides` a scan that comes from both ends of a series;
`lowest_until_higher` looks for the nearest higher value on either side of a point. All climb from a row of WIDTH neighbours to
the row of its summary and come back down, one join a level; the levels grow with the logarithm of the longest series and every level has one row for WIDTH of the level below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from percussa.functions.levels import let
from percussa.session import checkpointed

WIDTH = 64


def _above(place: Column) -> Column:
    return F.floor(place / WIDTH)


def levels_above(largest: int | None) -> int:
    """Levels over the one whose entries are numbered 0 to `largest`, until a single row remains."""
    n, rows = 0, (largest or 0) // WIDTH
    while rows:
        n, rows = n + 1, rows // WIDTH
    return n


def _largest(rows: DataFrame, column: str) -> int | None:
    return rows.agg(F.max(column)).first()[0]


def decayed_before(ends: DataFrame, keys: list[str], order: str, at: str, value: str, scale: str, how: str = "sum") -> DataFrame:
    """(keys, order, start): for every row what all earlier rows of its key still add up to at position `begin`.

    A row says that at position `at` its own stretch has ended with `value`; from there the value decays with exp(-distance /
    `scale`). Each stretch is thus an affine map of what comes before it (factor by its length, offset `value`); maps are
    composed inside rows of WIDTH stretches, the rows' maps again, and the composed maps are handed down to the rows and
    stretches they precede. `how` is "sum" for averages and "max" for holds. `order` counts from 0 and may have gaps, over
    which values decay by the distance of their positions; `begin` must be a column of `ends`.
    """
    join = (lambda x, y: x + y) if how == "sum" else F.greatest

    def after(low, high, c):
        """What two stretches leave together at the end of the later one."""
        gone = F.when(low["v"] > 0, low["v"] * F.exp((low["p"] - high["p"]) / c)).otherwise(F.lit(0.0))
        return F.struct(high["p"].cast("double").alias("p"), join(high["v"], gone).alias("v"))

    nothing = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("v"))
    # Narrow by now, and read by every level.
    ends = checkpointed(ends.select(*keys, F.col(order).cast("long").alias("_r"), F.col(at).cast("double").alias("p"),
                                    F.col(value).alias("v"), F.col(scale).cast("double").alias("c"), "begin"))
    level = ends.drop("begin")
    groups = []
    for _ in range(levels_above(_largest(ends, "_r")) + 1):
        rows = level.groupBy(*keys, _above(F.col("_r")).alias("_up")).agg(
            F.array_sort(F.collect_list(F.struct("_r", "p", "v"))).alias("_kids"), F.max("c").alias("c"))
        groups.append(rows)
        whole = F.aggregate("_kids", nothing, lambda acc, x: after(acc, x, F.col("c")))
        level = rows.select(*keys, F.col("_up").alias("_r"), "c", whole.alias("_w")).select(*keys, "_r", "_w.p", "_w.v", "c")
    # Down again: what precedes a row precedes its first entry; each entry adds itself for the next.
    before = None
    for rows in reversed(groups):
        if before is None:
            met = rows.withColumn("_b", nothing)
        else:
            met = rows.join(before.withColumnRenamed("_r", "_up"), [*keys, "_up"])
        step = F.aggregate(
            "_kids", F.struct(F.col("_b").alias("b"), F.array().cast("array<struct<_r:bigint,_b:struct<p:double,v:double>>>").alias("out")),
            lambda acc, x: F.struct(after(acc["b"], x, F.col("c")).alias("b"),
                                    F.concat(acc["out"], F.array(F.struct(x["_r"].alias("_r"), acc["b"].alias("_b")))).alias("out")),
            lambda acc: acc["out"])
        before = met.select(*keys, F.inline(step))
    out = ends.select(*keys, "_r", "begin", "c").join(before, [*keys, "_r"])
    left = F.when(F.col("_b.v") > 0, F.col("_b.v") * F.exp((F.col("_b.p") - F.col("begin")) / F.col("c"))).otherwise(F.lit(0.0))
    return out.select(*keys, F.col("_r").alias(order), left.alias("start"))


def joined_by(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Inner join on `columns`, where a null meets a null."""
    other = right.withColumnsRenamed({c: f"_of_{c}" for c in columns})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in columns]
    return left.join(other, same).drop(*(f"_of_{c}" for c in columns))


def met_from_both_sides(maps: DataFrame, keys: list[str], order: str, joined: Callable, ended: Callable, handed: Callable,
                        width: int) -> DataFrame:
    """(keys, order, state): what all other stretches of the key leave at the two ends of a stretch.

    `maps` has one array `map` a stretch. `joined` makes one map of a row's maps, which lie one after the other in a flat array;
    `ended` makes of the map of a whole series the state, `width` numbers, that meets its two ends; `handed` makes of a row's maps
    and the state at the row's ends the states of its stretches, flat again. `order` counts from 0 and may have gaps.
    """
    # Narrow by now, and read by every level.
    level = checkpointed(maps.select(*keys, F.col(order).cast("long").alias("_r"), F.col("map").alias("_m")))
    groups = []
    for _ in range(levels_above(_largest(level, "_r")) + 1):
        rows = level.groupBy(*keys, _above(F.col("_r")).alias("_up")).agg(
            F.array_sort(F.collect_list(F.struct("_r", "_m"))).alias("_kids"))
        rows = rows.select(*keys, "_up", F.col("_kids._r").alias("_rs"), F.flatten(F.col("_kids._m")).alias("_ms"))
        groups.append(rows)
        level = rows.select(*keys, F.col("_up").alias("_r"), joined(F.col("_ms")).alias("_m"))
    states = level.select(*keys, "_r", ended(F.col("_m")).alias("_s"))
    for rows in reversed(groups):
        met = joined_by(rows, states.withColumnRenamed("_r", "_up"), [*keys, "_up"])
        met = met.select(*keys, "_rs", handed(F.col("_ms"), F.col("_s")).alias("_all"))
        states = met.select(*keys, F.inline(F.transform("_rs", lambda r, i: F.struct(
            r.alias("_r"), F.slice("_all", i * width + 1, F.lit(width)).alias("_s")))))
    return states.select(*keys, F.col("_r").alias(order), F.col("_s").alias("state"))


def _walk(kids: Column, low: Column, height: Column) -> Column:
    """Along entries (b, max, min), nearest first: the first that rises above `height`, and the lowest before it."""
    def told(near: Column, at: Column) -> Column:
        before = F.slice(near["min"], F.lit(1), F.when(at > 0, at - 1).otherwise(F.size(near)).cast("int"))
        return F.struct(F.least(low, F.array_min(before)).alias("low"), F.when(at > 0, F.get(near["b"], (at - 1).cast("int"))).alias("hit"))

    return let(kids, lambda near: let(F.array_position(F.transform(near["max"], lambda m: m > height), True), lambda at: told(near, at)))


def lowest_until_higher(series: DataFrame, points: DataFrame, keys: list[str], value: str = "env", height: str = "height") -> DataFrame:
    """(keys, k, height, side, low): the lowest value between a point and the nearest higher one on each side (-1, 1).

    `series` is dense (keys, k, value), `points` are some of its places with their height. Without a higher value the side
    reaches to the end of the series. A side that stays open climbs through the extremes of ever wider blocks until one
    rises above the point, then descends into it, nearest part first.
    """
    marked = series.select(*keys, "k", F.col(value).alias("_v")).join(
        points.select(*keys, "k", F.col(height).alias("height")), [*keys, "k"], "left")
    entry = F.struct(F.col("k").alias("b"), F.col("_v").alias("max"), F.col("_v").alias("min"))
    point = F.when(F.col("height").isNotNull(), F.struct("k", "height"))
    base = marked.groupBy(*keys, _above(F.col("k")).alias("_up")).agg(
        F.array_sort(F.collect_list(entry)).alias("_kids"), F.collect_list(point).alias("_points"))
    base = checkpointed(base)
    rows = _largest(base, "_up")
    top = 0 if not rows else 1 + levels_above(rows)
    tables = [base.select(*keys, "_up", "_kids")]
    for _ in range(top):
        last = tables[-1].select(*keys, F.col("_up").alias("b"), F.array_max(F.col("_kids.max")).alias("max"),
                                 F.array_min(F.col("_kids.min")).alias("min"))
        tables.append(last.groupBy(*keys, _above(F.col("b")).alias("_up")).agg(
            F.array_sort(F.collect_list(F.struct("b", "max", "min"))).alias("_kids")))
    sides = F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")
    state = base.select(*keys, "_up", "_kids", F.inline("_points")).select("*", sides).withColumns(
        {"_at": F.col("k"), "low": F.col("height")})
    columns = [*keys, "k", "height", "side"]

    def nearest(kids: Column) -> Column:
        return F.when(F.col("side") < 0, F.reverse(kids)).otherwise(kids)

    hits, done = [], []
    for n in range(top + 1):
        if n:
            state = state.join(tables[n], [*keys, "_up"])
        own = F.array_position("_kids.b", F.col("_at")).cast("int")
        beyond = F.when(F.col("side") < 0, F.slice("_kids", F.lit(1), own - 1)).otherwise(F.slice("_kids", own + 1, F.size("_kids") - own))
        # Written once: what has a hit and what climbs on both read it.
        state = checkpointed(state.withColumn("_w", _walk(nearest(beyond), F.col("low"), F.col("height"))).select(
            *columns, "_up", "_w.low", "_w.hit"))
        hits.append(state.where("hit IS NOT NULL").select(*columns, "low", "hit"))
        state = state.where("hit IS NULL").select(*columns, "low", F.col("_up").alias("_at"), _above(F.col("_up")).alias("_up"))
    done = [state.select(*columns, "low"), hits[0].select(*columns, "low")]
    # A hit of level n names a row of level n - 1, where the search goes on.
    going = None
    for n in range(top, 0, -1):
        going = hits[n] if going is None else going.unionByName(hits[n])
        met = going.withColumnRenamed("hit", "_up").join(tables[n - 1], [*keys, "_up"])
        going = met.withColumn("_w", _walk(nearest(F.col("_kids")), F.col("low"), F.col("height"))).select(
            *columns, "_w.low", "_w.hit")
    if going is not None:
        done.append(going.select(*columns, "low"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
