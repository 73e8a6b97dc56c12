"""Outlier review of a string: robust scores, generalised ESD, flags, worklists."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from percussa.functions import levels as L
from percussa.functions.stats import t_isf
from percussa.operators.ordered import is_hot, numbered, percentiles, union_all
from percussa.session import checkpointed

NORMAL_QUARTILE = 0.6745
FAMILY_ALPHA = 0.05
MAX_FRACTION = 0.1
MIN_SHOTS = 5
MIN_SNR_DB = 10.0
LEVEL_OUTLIERS = ["Lpeak_Z", "LAE"]
CHARACTER_OUTLIERS = ["spectral_centroid_Hz", "a_duration_ms", "rise_time_us"]
RANK = {"info": 0, "review": 1, "exclude": 2}


def robust_center(long: DataFrame, keys: list[str], value: str = "value",
                  limit: int | None = None) -> DataFrame:
    """Median and median absolute deviation of each group."""
    med = percentiles(long, keys, value, {"median": 0.5}, limit=limit)
    dev = long.join(med, keys).withColumn("_dev", F.abs(F.col(value) - F.col("median")))
    mad = percentiles(dev, keys, "_dev", {"mad": 0.5}, limit=limit)
    return med.join(mad, keys)


def z_column(value: Column, median: Column, mad: Column) -> Column:
    """Modified z score; 0 without dispersion or without a value."""
    return F.when((mad > 0) & value.isNotNull(), NORMAL_QUARTILE * (value - median) / mad).otherwise(F.lit(0.0))


def modified_z(long: DataFrame, keys: list[str], value: str = "value", limit: int | None = None) -> DataFrame:
    center = robust_center(long, keys, value, limit)
    return long.join(center, keys).withColumn(
        "modified_z", z_column(F.col(value), F.col("median"), F.col("mad")))


def robust_spread_band(long: DataFrame, keys: list[str], value: str = "value",
                       limit: int | None = None) -> DataFrame:
    """Median +/- 2 * 1.4826 * MAD; no band without dispersion."""
    c = robust_center(long, keys, value, limit)
    half = F.when(F.col("mad") > 0, 2 * 1.4826 * F.col("mad"))
    return c.withColumn("low", F.col("median") - half).withColumn("high", F.col("median") + half)


# Entries of each end that a row of the walk holds; what lies beyond is fetched when the walk gets there.
PORTION = 1024

_STEPS = T.ArrayType(T.StructType([
    T.StructField("value", T.DoubleType()), T.StructField("_nth", T.LongType()),
    T.StructField("step", T.LongType()), T.StructField("esd_statistic", T.DoubleType())]))
_WALKED = T.StructType([
    T.StructField("steps", _STEPS), T.StructField("mean", T.DoubleType()), T.StructField("m2", T.DoubleType()),
    T.StructField("step", T.LongType()), T.StructField("at", T.ArrayType(T.LongType())),
    T.StructField("used", T.ArrayType(T.LongType())), T.StructField("paused", T.BooleanType())])


@F.pandas_udf(_WALKED)
def _esd_walk(n: pd.Series, mean: pd.Series, m2: pd.Series, step: pd.Series, used: pd.Series, low: pd.Series,
              high: pd.Series, most: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_walk(*row) for row in zip(n, mean, m2, step, used, low, high, most)], columns=_WALKED.names)


def _walk(n, mean, m2, done, used, low, high, most):
    """Remove the more deviant of a group's two ends, one step at a time, as far as a portion of both ends reaches.

    `done` steps lie behind, which have used `used` rows of the first entry of each end. `low` and `high` hold the next
    distinct candidate values with their counts and first rows, most extreme first. Beyond the candidates no step can be
    significant, so the walk ends when both ends are used up; it pauses when a full portion (`most` entries) is.
    """
    out, ends, at, used, paused = [], (low, high), [0, 0], list(used), False
    for step in range(int(done) + 1, max(1, min(max(1, int(n * MAX_FRACTION)), n - 2)) + 1):
        left = n - step + 1
        sd = math.sqrt(max(m2, 0.0) / (left - 1)) if left > 1 else 0.0
        paused = any(at[e] == len(ends[e]) == most for e in (0, 1))
        open_ends = [e for e in (0, 1) if at[e] < len(ends[e])]
        if paused or left < 3 or sd <= 1e-12 * max(1.0, abs(mean)) or not open_ends:
            break
        # The larger deviation goes; the earlier row goes first on a tie.
        deviation, _, end = max((abs(ends[e][at[e]]["v"] - mean), -ends[e][at[e]]["f"], e) for e in open_ends)
        x = ends[end][at[end]]["v"]
        used[end] += 1
        out.append({"value": x, "_nth": used[end], "step": step, "esd_statistic": deviation / sd})
        if used[end] == ends[end][at[end]]["c"]:
            at[end], used[end] = at[end] + 1, 0
        done = step
        shifted = mean + (mean - x) / (left - 1)
        m2 -= (x - mean) * (x - shifted)
        mean = shifted
    return out, mean, m2, done, at, used, paused


def _walked(ends: DataFrame, keys: list[str]) -> DataFrame:
    """Steps of every group from its ranked ends (end 0 or 1, _i from 1): no row holds more than a portion of an end.

    The state of a walk is a mean, a sum of squares and two ranks, so a paused walk goes on with the next portion.
    """
    entry = F.when(F.col("_v").isNotNull(), F.struct(F.col("_v").alias("v"), "c", "f"))

    def portions(rows: DataFrame, by: list) -> DataFrame:
        sides = [F.transform(F.array_sort(F.collect_list(F.when(F.col("end") == e, F.struct("_i", entry.alias("x"))))),
                             lambda k: k["x"]).alias(name) for e, name in ((0, "_l"), (1, "_h"))]
        return rows.groupBy(*by).agg(*sides)

    begin = {"_mean": F.col("_sum") / F.col("_n"), "_step": F.lit(0).cast("long"), "_used": F.array(F.lit(0), F.lit(0)).cast("array<long>"),
             "_at": F.array(F.lit(0), F.lit(0)).cast("array<long>")}
    first = ends.where(F.col("_i") <= PORTION)
    open_, out = portions(first, [*keys, "_n", "_sum", "_m2"]).withColumns(begin).drop("_sum"), []
    while True:
        walk = _esd_walk("_n", "_mean", "_m2", "_step", "_used", "_l", "_h", F.lit(PORTION))
        walked = checkpointed(open_.select(*keys, "_n", "_at", walk.alias("_w")))
        out.append(walked.select(*keys, "_n", F.inline("_w.steps")))
        going = walked.where("_w.paused").select(
            *keys, "_n", F.col("_w.mean").alias("_mean"), F.col("_w.m2").alias("_m2"), F.col("_w.step").alias("_step"),
            F.col("_w.used").alias("_used"), F.zip_with("_at", "_w.at", lambda a, b: a + b).alias("_at"))
        if going.isEmpty():
            return union_all(out)
        rows = ends.select(*keys, "end", "_i", "_v", "c", "f").join(going, keys)
        rows = rows.where((F.col("_i") > F.get("_at", F.col("end"))) & (F.col("_i") <= F.get("_at", F.col("end")) + PORTION))
        state = ["_n", "_mean", "_m2", "_step", "_used", "_at"]
        open_ = going.join(portions(rows, keys), keys, "left").select(
            *keys, *state, *[F.coalesce(c, F.array()).alias(c) for c in ("_l", "_h")])


def esd_critical(n: Column, step: Column, t: Column) -> Column:
    """Rosner's critical value of a step, from the quantile t."""
    nu = n - step - 1
    return (n - step) * t / F.sqrt((nu + t * t) * (n - step + 1))


def _least_critical(n: Column, step: Column, alpha: float) -> Column:
    """A bound from below of Rosner's critical value: the normal quantile, which Student's exceeds, in place of t."""
    u = F.sqrt(-2 * F.log(F.lit(alpha) / (2 * (n - step + 1))))
    # Rational approximation of the quantile, off by less than 4.5e-4.
    z = u - (2.515517 + u * (0.802853 + u * 0.010328)) / (1 + u * (1.432788 + u * (0.189269 + u * 0.001308)))
    return esd_critical(n, step, F.greatest(z - 4.5e-4, F.lit(0.0)))


def _measured(rows: DataFrame, keys: list[str], value: str, hot: bool) -> DataFrame:
    """Rows of groups that are tested, with size, sum, squares (_n, _sum, _m2) and the bounds (_below, _above, _core).

    Groups that fit a task are ranked by value once, and every figure comes from windows over that one order; those of a
    table with a hot group are counted apart and joined.
    """
    v, n = F.col(value), F.col("_n")
    if not hot:
        ranks = Window.partitionBy(*keys).orderBy(value)
        whole = ranks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        told = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select("*", F.row_number().over(ranks).alias("_i"), *[
            a.over(whole).alias(name) for a, name in ((F.count("*"), "_n"), (F.sum(value), "_sum"), (F.stddev_samp(value), "_sd"))])
        told = told.where((n >= MIN_SHOTS) & (F.col("_sd") > 0))
        low, high = F.col("_i") > 0.12 * n, F.col("_i") <= 0.88 * n
        core, middle = F.when(low & high, v), 0.5 * (n + 1)
        told = told.select("*", *[a.over(whole).alias(name) for a, name in (
            (F.var_pop(core), "_var"), (F.count(core), "_c"), (F.avg(F.when(high, v)), "_below"), (F.avg(F.when(low, v)), "_above"),
            (F.max(F.when(F.col("_i") == F.floor(middle), v)), "_lo"), (F.max(F.when(F.col("_i") == F.ceil(middle), v)), "_hi"))])
        return told.select(
            *rows.columns, "_n", "_sum", (F.col("_sd") * F.col("_sd") * (n - 1)).alias("_m2"),
            F.coalesce(F.col("_var") * F.col("_c"), F.lit(0.0)).alias("_core"), "_below", "_above",
            (0.5 * F.col("_lo") + 0.5 * F.col("_hi")).alias("median"))
    cut = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.sum(value).alias("_sum"), F.stddev_samp(value).alias("_sd"),
        F.percentile_approx(value, [0.12, 0.88], 10000).alias("_q"))
    cut = cut.where((n >= MIN_SHOTS) & (F.col("_sd") > 0)).select(
        *keys, "_n", "_sum", (F.col("_sd") * F.col("_sd") * (n - 1)).alias("_m2"),
        F.col("_q")[0].alias("_a"), F.col("_q")[1].alias("_b"))
    core = F.when((v > F.col("_a")) & (v < F.col("_b")), v)
    inner = rows.join(cut, keys).groupBy(*keys).agg(
        F.coalesce(F.var_pop(core) * F.count(core), F.lit(0.0)).alias("_core"),
        F.avg(F.when(v < F.col("_b"), v)).alias("_below"), F.avg(F.when(v > F.col("_a"), v)).alias("_above"))
    return rows.join(cut.drop("_a", "_b").join(inner, keys), keys)


def _with_mad(told: DataFrame, keys: list[str], value: str, wanted: Column) -> DataFrame:
    """Wanted rows of `_measured` with `mad`, the median deviation of their group; only its rows go further beside them."""
    dev, middle = F.abs(F.col(value) - F.col("median")), 0.5 * (F.col("_n") + 1)
    ranked = told.withColumn("_dev", dev).withColumn("_j", F.row_number().over(Window.partitionBy(*keys).orderBy("_dev")))
    lo, hi = F.col("_j") == F.floor(middle), F.col("_j") == F.ceil(middle)
    few = ranked.withColumn("_wanted", wanted).where(F.col("_wanted") | lo | hi)
    group = Window.partitionBy(*keys)
    mad = 0.5 * F.max(F.when(lo, F.col("_dev"))).over(group) + 0.5 * F.max(F.when(hi, F.col("_dev"))).over(group)
    return few.withColumn("mad", mad).where("_wanted").drop("_dev", "_j", "_wanted")


def generalised_esd(long: DataFrame, keys: list[str], order: str, alpha: float = FAMILY_ALPHA,
                    value: str = "value", limit: int | None = None, center: bool = False) -> DataFrame:
    """Outlying rows by Rosner's test, with step, statistic and critical value; `center` adds median and mad of their group.

    Only values that can be outliers are walked, in portions of both ends. Bounds: at most a
    tenth of a group is removed, always from its ends, so the values between
    its 12th and 88th percentile stay; their sum of squares bounds every later
    deviation from below, and the means of everything below b and above a
    bound every later mean.
    """
    rows = long.where(F.col(value).isNotNull())
    hot = is_hot(rows, keys, limit)
    told = _measured(rows, keys, value, hot)
    v, n = F.col(value), F.col("_n").cast("double")
    k = F.greatest(F.floor(n * MAX_FRACTION), F.lit(1))
    # Groups so small that the middle is empty keep every value.
    room = _least_critical(n, k, alpha) * F.sqrt(F.col("_core") / (n - 1)) - (F.col("_above") - F.col("_below"))
    room = F.when(n >= 30, room)
    high = F.coalesce(v > F.col("_below") + room, F.lit(True))
    low = F.coalesce(v < F.col("_above") - room, F.lit(True))
    told = told.withColumns({"_high": high, "_low": low})
    wanted = F.col("_high") | F.col("_low")
    middle = []
    if center and not hot:
        told, middle = _with_mad(told, keys, value, wanted), ["median", "mad"]
    # Every row of a value that can be an outlier; the rest of the table isn't read again.
    few = checkpointed(told.where(wanted).select(*long.columns, *middle, "_n", "_sum", "_m2", "_high", "_low"))
    candidates = few.groupBy(*keys, value, "_n", "_sum", "_m2", "_high", "_low").agg(F.count("*").alias("c"), F.min(order).alias("f"))
    flags = F.array_compact(F.array(F.when(F.col("_low"), F.lit(0)), F.when(F.col("_high"), F.lit(1))))
    ends = candidates.withColumn("end", F.explode(flags)).select(*keys, "_n", "_sum", "_m2", "end", F.col(value).alias("_v"), "c", "f")
    # Ranks count from the outermost value of each end.
    outer = ends.withColumn("_from", F.when(F.col("end") == 0, F.col("_v")).otherwise(-F.col("_v")))
    found = _walked(checkpointed(numbered(outer, [*keys, "end"], ["_from"], "_i", limit)), keys)
    n, step = F.col("_n"), F.col("step").cast("double")
    found = found.withColumn("_t", t_isf(F.lit(alpha) / (2 * (n - step + 1)), n - step - 1))
    found = found.withColumn("esd_critical", esd_critical(n, step, F.col("_t"))).drop("_t", "_n")
    last = found.where("esd_statistic > esd_critical").groupBy(*keys).agg(F.max("step").alias("_last"))
    found = checkpointed(found.join(last, keys).where("step <= _last").drop("_last").withColumnRenamed("value", value))
    hit = few.select(*long.columns, *middle).join(found.select(*keys, value).distinct(), [*keys, value], "left_semi")
    out = numbered(hit, [*keys, value], [order], "_nth", limit).join(found, [*keys, value, "_nth"]).drop("_nth")
    return out.join(robust_center(rows, keys, value, limit), keys) if center and hot else out


def statistical_flags(shots: DataFrame, keys: list[str], shot: str, zero_is_missing: bool = True,
                      limit: int | None = None) -> DataFrame:
    """Outliers of five metrics over the valid, unclipped shots.

    `zero_is_missing` keeps a quirk of the numbers this reproduces: a value of
    exactly 0 counts as not measured. A string of fewer than MIN_SHOTS such shots has no group that is tested.
    """
    metrics = LEVEL_OUTLIERS + CHARACTER_OUTLIERS
    usable = shots.where(F.col("valid") & ~F.col("clipped"))

    def value(m):
        c = L.finite(m)
        return F.when(c != 0, c) if zero_is_missing else c

    long = usable.select(*keys, shot, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), value(m).alias("value")) for m in metrics])))
    found = generalised_esd(long.where("value IS NOT NULL"), [*keys, "metric"], shot, FAMILY_ALPHA / len(metrics), limit=limit, center=True)
    prefix = F.when(F.col("metric").isin(LEVEL_OUTLIERS), "level_outlier_").otherwise("character_outlier_")
    return found.select(
        *keys, shot, F.concat(prefix, F.col("metric")).alias("code"), F.lit("review").alias("severity"),
        "metric", "value", z_column(F.col("value"), F.col("median"), F.col("mad")).alias("modified_z"),
        F.col("median").alias("string_median"), "esd_statistic", "esd_critical")


def condition_flags(shots: DataFrame, keys: list[str], shot: str, min_snr_dB: float = MIN_SNR_DB) -> DataFrame:
    """Flags a shot raises by itself."""
    snr = L.finite("snr_dB")

    def flag(when, code, severity, metric=None, value=None):
        return F.when(when, F.struct(
            F.lit(code).alias("code"), F.lit(severity).alias("severity"),
            F.lit(metric).cast("string").alias("metric"),
            (F.lit(None) if value is None else value).cast("double").alias("value")))

    found = F.array_compact(F.array(
        flag(F.coalesce(F.col("clipped"), F.lit(False)), "clipped", "exclude"),
        flag(F.coalesce(F.col("window_truncated"), F.lit(False)), "truncated", "review"),
        flag(snr < min_snr_dB, "low_snr", "review", "snr_dB", snr),
        flag(~F.coalesce(F.col("rise_time_resolved"), F.lit(True)), "rise_time_unresolved", "info",
             "rise_time_us", F.nullif(L.finite("rise_time_us"), F.lit(0.0))),
    ))
    return shots.select(*keys, shot, F.inline(found)).withColumn(
        "error_dB", F.when(F.col("code") == "low_snr",
                           10 * F.log10(1 + F.pow(F.lit(10.0), -F.col("value") / 10))))


def severity_rank(severity: str = "severity") -> Column:
    c = F.col(severity)
    return F.when(c == "exclude", 2).when(c == "review", 1).otherwise(0)


def review_flags(shots: DataFrame, keys: list[str], shot: str, popped: DataFrame | None = None,
                 limit: int | None = None) -> DataFrame:
    """All flags of every string; level outliers of a first shot whose pop is
    established (`popped`: the keys of such strings) become information."""
    parts = [condition_flags(shots, keys, shot), statistical_flags(shots, keys, shot, limit=limit)]
    flags = parts[0].unionByName(parts[1], allowMissingColumns=True)
    if popped is None:
        return flags.withColumn("rank", severity_rank())
    first = shots.groupBy(*keys).agg(F.min(shot).alias("_first")).join(
        popped.select(*keys), keys, "left_semi")
    explained = (F.col(shot) == F.col("_first")) & F.col("code").startswith("level_outlier") & (
        F.col("severity") == "review")
    return (
        flags.join(first, keys, "left")
        .withColumn("_explained", F.coalesce(explained, F.lit(False)))
        .withColumn("code", F.when(F.col("_explained"), F.concat(F.lit("first_round_pop_"), F.col("metric")))
                    .otherwise(F.col("code")))
        .withColumn("severity", F.when(F.col("_explained"), "info").otherwise(F.col("severity")))
        .drop("_first", "_explained").withColumn("rank", severity_rank())
    )


def ordered_flags(flags: DataFrame, keys: list[str], shot: str) -> DataFrame:
    return flags.orderBy(*keys, shot, F.desc("rank"), "code")


def worklists(flags: DataFrame, shots: DataFrame, keys: list[str], shot: str) -> DataFrame:
    """Shots to exclude and shots to review, one row per flagged shot at or above review."""
    worst = flags.groupBy(*keys, shot).agg(F.max("rank").alias("rank")).where("rank >= 1")
    return worst.select(*keys, shot, F.when(F.col("rank") == 2, "exclude").otherwise("review").alias("worklist"))


def sensitivity(shots: DataFrame, keys: list[str]) -> DataFrame:
    """What a clean review of a string of this size is worth."""
    n = F.count_if(F.col("valid") & ~F.col("clipped"))
    g = shots.groupBy(*keys).agg(n.alias("n_evaluated"))
    k = F.col("n_evaluated")
    return g.select(*keys, "n_evaluated", F.when(k < MIN_SHOTS, "none").when(k < 10, "half of large outliers")
                    .when(k < 20, "four in five large outliers").when(k < 30, "nine in ten large outliers")
                    .otherwise("over nine in ten large outliers").alias("sensitivity"))


