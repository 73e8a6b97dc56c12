"""Aggregates over a string of shots (energy means, hazard, first round, trend)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from percussa.functions import levels as L
from percussa.functions.stats import t_isf, t_sf
from percussa.operators.ordered import neighbours, numbered, percentiles

# Fixed list: metrics averaged on an energy basis, and those averaged plainly.
LEVEL_METRICS = ["Lpeak_Z", "Lpeak_A", "Lpeak_C", "LAE", "LZE", "LCE",
                 "LAFmax", "LASmax", "LAImax", "LZImax"]
PLAIN_METRICS = ["rise_time_us", "a_duration_ms", "b_duration_ms", "specific_impulse_Pa_s",
                 "crest_factor_dB", "spectral_centroid_Hz", "kurtosis"]
EIGHT_HOURS_S = 28800.0
CRITERION_DB = 85.0
MIN_SUBSEQUENT = 4
MIN_STRINGS = 3
POP_ALPHA = 0.05


def unpivot_metrics(shots: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Long form (keys, metric, value); non-finite values become NULL."""
    pairs = F.array(*[
        F.struct(F.lit(m).alias("metric"), L.finite(m).alias("value")) for m in metrics])
    return shots.select(*keys, F.inline(pairs))


def metric_stats(long: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Distribution of every metric: energy mean for levels, plain mean otherwise."""
    v = F.col("value")
    extra = [
        F.count(v).alias("n"), L.energy_mean(v).alias("_energy"), F.avg(v).alias("_plain"),
        L.spread(v).alias("std"), F.min(v).alias("minimum"), F.max(v).alias("maximum"),
    ]
    out = percentiles(long, [*keys, "metric"], "value", {"median": 0.5}, extra, limit)
    is_level = F.col("metric").isin(LEVEL_METRICS)
    return out.select(
        *keys, "metric", "n", F.when(is_level, F.col("_energy")).otherwise(F.col("_plain")).alias("mean"),
        "std", "minimum", "maximum", "median",
        F.when(F.col("n") > 1, 1.96 * F.col("std") / F.sqrt("n"))
        .when(F.col("n") == 1, F.lit(0.0)).alias("ci95"),
    )


def aggregate_string(shots: DataFrame, keys: list[str], metrics: list[str],
                     include_invalid: bool = False, limit: int | None = None) -> DataFrame:
    """metric_stats over the valid shots, with n_shots and n_valid."""
    used = shots if include_invalid else shots.where("valid")
    counts = shots.groupBy(*keys).agg(
        F.count("*").alias("n_shots"),
        (F.count("*") if include_invalid else F.count_if("valid")).alias("n_valid"))
    return metric_stats(unpivot_metrics(used, keys, metrics), keys, limit).join(counts, keys, "right")


def same_layout(bands: DataFrame, keys: list[str], shot: list[str]) -> DataFrame:
    """Keys whose shots all have the same number of bands."""
    sizes = bands.groupBy(*keys, *shot).agg(F.count("*").alias("_bands"))
    return (sizes.groupBy(*keys)
            .agg(F.min("_bands").alias("_lo"), F.max("_bands").alias("_hi"))
            .where("_lo = _hi").select(*keys))


def band_stats(bands: DataFrame, keys: list[str], level: str = "level") -> DataFrame:
    """Energy mean, spread, range and standard error per band."""
    v = L.finite(level)
    return bands.groupBy(*keys, "band").agg(
        F.count(v).alias("n"), L.energy_mean(level).alias("mean"), L.spread(level).alias("std"),
        F.min(v).alias("minimum"), F.max(v).alias("maximum"),
    ).withColumn("se", F.when(F.col("n") > 1, F.col("std") / F.sqrt("n")).otherwise(F.lit(0.0)))


def hazard_columns(lae: Column, rounds: Column, criterion: Column) -> dict[str, Column]:
    """Daily dose of `rounds` shots of energy-mean exposure `lae`."""
    day = 10 * F.log10(F.lit(EIGHT_HOURS_S))
    laeq = lae + 10 * F.log10(rounds) - day
    return {
        "LAeq8h_dB": laeq,
        "dose_percent": 100 * L.power_of(laeq - criterion),
        "allowable_rounds": L.power_of(criterion - lae + day),
        "exceeds_limit": laeq > criterion,
    }


def hazard(shots: DataFrame, keys: list[str], criterion_dB: float = CRITERION_DB,
           protection_dB: float = 0.0) -> DataFrame:
    """Hearing hazard of each string from its valid exposures."""
    used = shots.where("valid").groupBy(*keys).agg(
        F.count(L.finite("LAE")).alias("n_rounds"),
        (L.energy_mean("LAE") - protection_dB).alias("LAE_mean"))
    cols = hazard_columns(F.col("LAE_mean"), F.col("n_rounds"), F.lit(criterion_dB))
    return used.where("n_rounds > 0").select("*", *[c.alias(n) for n, c in cols.items()])


def hazard_what_if(shots: DataFrame, keys: list[str], scenarios: list[tuple[int, float]]) -> DataFrame:
    """hazard for given (rounds per day, criterion) pairs; one row per pair and string."""
    used = shots.where("valid").groupBy(*keys).agg(
        F.count(L.finite("LAE")).alias("n_shots_used"), L.energy_mean("LAE").alias("LAE_mean"))
    pairs = F.array(*[F.struct(F.lit(int(r)).alias("n_rounds"), F.lit(float(c)).alias("criterion_dB"))
                      for r, c in scenarios])
    out = used.where("n_shots_used > 0").select("*", F.inline(pairs))
    cols = hazard_columns(F.col("LAE_mean"), F.col("n_rounds"), F.col("criterion_dB"))
    return out.select("*", *[c.alias(n) for n, c in cols.items()])


def without_rejected(shots: DataFrame, rejected: DataFrame, on: list[str]) -> DataFrame:
    """Shots the operator kept; every aggregate can then be taken again."""
    return shots.join(rejected.select(*on).distinct(), on, "left_anti")


def mark_first(shots: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds `is_first`: the first shot of its string. No window over the string."""
    rank = F.struct(*order)
    first = shots.groupBy(*keys).agg(F.min(rank).alias("_first"))
    return shots.join(first, keys).withColumn("is_first", rank == F.col("_first")).drop("_first")


def _first_and_rest(shots: DataFrame, keys: list[str], order: list[str], level: str) -> DataFrame:
    v = L.finite(level)
    rest = F.when(~F.col("is_first"), v)
    return mark_first(shots, keys, order).groupBy(*keys).agg(
        F.count("*").alias("n_shots"),
        F.max(F.when(F.col("is_first"), v)).alias("first_dB"),
        F.count(rest).alias("n_subsequent"), F.avg(rest).alias("subsequent_mean_dB"),
        F.stddev_samp(rest).alias("subsequent_sd_dB"),
        L.energy_mean(v).alias("mean_all_dB"), L.energy_mean(rest).alias("mean_rest_dB"),
    )


def first_round_pop(shots: DataFrame, keys: list[str], order: list[str], level: str = "level",
                    alpha: float = POP_ALPHA) -> DataFrame:
    """First shot against the one-sided prediction interval of the others."""
    g = _first_and_rest(shots, keys, order, level)
    n, sd, mean = F.col("n_subsequent"), F.col("subsequent_sd_dB"), F.col("subsequent_mean_dB")
    refusal = (
        F.when(F.col("first_dB").isNull(), "first shot has no valid level")
        .when(n < MIN_SUBSEQUENT, "too few shots after the first")
        .when(sd <= 0, "no spread after the first shot"))
    g = g.withColumn("refusal", refusal)
    ok = F.col("refusal").isNull()
    se = sd * F.sqrt(1 + 1 / n)
    half = t_isf(F.when(ok, F.lit(alpha)), n.cast("double") - 1) * se
    g = g.withColumn("_half", half)
    return g.select(
        *keys, "n_subsequent", "first_dB",
        F.when(n >= MIN_SUBSEQUENT, mean).alias("subsequent_mean_dB"),
        F.when(n >= MIN_SUBSEQUENT, sd).alias("subsequent_sd_dB"),
        F.when(n >= MIN_SUBSEQUENT, F.col("first_dB") - F.col("mean_rest_dB")).alias("observed_dB"),
        F.when(ok, mean - F.col("_half")).alias("prediction_lower_dB"),
        F.when(ok, mean + F.col("_half")).alias("prediction_upper_dB"),
        t_sf(F.when(ok, (F.col("first_dB") - mean) / se), n.cast("double") - 1).alias("p_value"),
        F.when(ok, F.col("first_dB") > mean + F.col("_half")).otherwise(F.lit(False)).alias("established"),
        "refusal",
    )


def first_round_pop_across(shots: DataFrame, string: list[str], group: list[str], order: list[str],
                           level: str = "level", alpha: float = POP_ALPHA) -> DataFrame:
    """Mean first-round difference over the strings of each group."""
    per = _first_and_rest(shots, [*group, *string], order, level)
    usable = (F.col("n_shots") > MIN_SUBSEQUENT) & F.col("first_dB").isNotNull() & (
        F.col("n_subsequent") >= MIN_SUBSEQUENT)
    d = F.when(usable, F.col("first_dB") - F.col("mean_rest_dB"))
    g = per.groupBy(*group).agg(
        F.count(d).alias("n_strings"), F.count_if(~usable).alias("n_skipped"),
        F.avg(d).alias("_mean"), F.stddev_samp(d).alias("_sd"))
    n, mean, sd = F.col("n_strings"), F.col("_mean"), F.col("_sd")
    enough = n >= MIN_STRINGS
    spread = enough & (sd > 0)
    df = n.cast("double") - 1
    g = g.withColumn("_half", t_isf(F.when(spread, F.lit(alpha / 2)), df) * sd / F.sqrt(n))
    g = g.withColumn("_p", t_sf(F.when(spread, mean / (sd / F.sqrt(n))), df))
    half = F.when(spread, F.col("_half")).when(enough, F.lit(0.0))
    p = F.when(spread, F.col("_p")).when(enough & (mean > 0), F.lit(0.0)).when(enough, F.lit(1.0))
    return g.select(
        *group, "n_strings", "n_skipped",
        F.when(enough, mean).alias("pop_dB"), F.when(enough, sd).alias("sd_dB"),
        (mean - half).alias("ci_low_dB"), (mean + half).alias("ci_high_dB"), p.alias("p_value"),
        F.when(spread, F.col("_p") < alpha).otherwise(F.coalesce(enough & (mean > 0), F.lit(False))).alias("established"),
        F.when(~enough, "too few usable strings").alias("refusal"),
    )


SUMMARY_POINTS = {"p5": 0.05, "p25": 0.25, "median_dB": 0.5, "p75": 0.75, "p95": 0.95}


def string_summary(shots: DataFrame, keys: list[str], level: str = "level",
                   limit: int | None = None) -> DataFrame:
    """Size, means, spread and percentiles of every string."""
    v = L.finite(level)
    extra = [
        F.count("*").alias("n_shots"), F.count(v).alias("n_finite"),
        L.energy_mean(level).alias("energy_mean_dB"), F.avg(v).alias("arithmetic_mean_dB"),
        L.spread(level).alias("sd_dB"), F.min(v).alias("minimum_dB"), F.max(v).alias("maximum_dB"),
    ]
    out = percentiles(shots.withColumn("_v", v), keys, "_v", SUMMARY_POINTS, extra, limit)
    return out.withColumn("range_dB", F.col("maximum_dB") - F.col("minimum_dB")).withColumn(
        "ci95_dB", F.when(F.col("n_finite") > 1, 1.96 * F.col("sd_dB") / F.sqrt("n_finite"))
        .when(F.col("n_finite") == 1, F.lit(0.0)))


def first_round_cost(shots: DataFrame, keys: list[str], order: list[str], level: str = "level") -> DataFrame:
    """What the first round adds to the energy mean of its string."""
    return _first_and_rest(shots, keys, order, level).select(
        *keys, F.col("mean_all_dB").alias("energy_mean_dB"),
        F.col("mean_rest_dB").alias("energy_mean_excluding_first_dB"),
        (F.col("mean_all_dB") - F.col("mean_rest_dB")).alias("first_round_cost_dB"))


def string_trend(shots: DataFrame, keys: list[str], order: list[str], level: str = "level",
                 alpha: float = POP_ALPHA, limit: int | None = None) -> DataFrame:
    """Slope of level on shot index over the shots after the first."""
    at = numbered(shots, keys, order, "_at", limit)
    y = F.when(F.col("_at") > 1, L.finite(level))
    x = F.col("_at").cast("double")
    g = at.groupBy(*keys).agg(
        F.count("*").alias("n_shots"), F.count(y).alias("n_used"), F.regr_slope(y, x).alias("_slope"),
        F.corr(y, F.when(y.isNotNull(), x)).alias("_r"))
    ok = (F.col("n_shots") >= 4) & (F.col("n_used") >= 3)
    r = F.coalesce(F.nanvl("_r", F.lit(0.0)), F.lit(0.0))
    df = F.col("n_used").cast("double") - 2
    t = F.when(ok & (F.abs(r) < 1), F.abs(r) * F.sqrt(df / (1 - r * r)))
    g = g.withColumn("_p", t_sf(t, df))
    p = F.when(ok, F.when(F.abs(r) < 1, 2 * F.col("_p")).otherwise(F.lit(0.0)))
    return g.select(
        *keys, "n_shots", "n_used", F.when(ok, F.col("_slope")).alias("trend_dB_per_shot"),
        p.alias("trend_p_value"), F.coalesce(p < alpha, F.lit(False)).alias("trend_established"))


def reduction_with_and_without_first(shots: DataFrame, keys: list[str], order: list[str],
                                     level: str = "level") -> DataFrame:
    """Reduction against the unsuppressed shots, with and without the first suppressed one."""
    per = _first_and_rest(shots, [*keys, "configuration"], order, level)
    is_ref, is_test = F.col("configuration") == "unsuppressed", F.col("configuration") == "suppressed"
    g = per.groupBy(*keys).agg(
        F.max(F.when(is_ref, F.col("mean_all_dB"))).alias("reference_mean_dB"),
        F.max(F.when(is_test, F.col("mean_all_dB"))).alias("test_mean_dB"),
        F.max(F.when(is_test, F.col("mean_rest_dB"))).alias("test_mean_excluding_first_dB"))
    inc = F.col("reference_mean_dB") - F.col("test_mean_dB")
    exc = F.col("reference_mean_dB") - F.col("test_mean_excluding_first_dB")
    return g.select("*", inc.alias("reduction_including_first_dB"),
                    exc.alias("reduction_excluding_first_dB"),
                    (exc - inc).alias("first_round_penalty_dB"))


def rate_summary(shots: DataFrame, keys: list[str], time_us: str, order: list[str],
                 level: str = "level", limit: int | None = None) -> DataFrame:
    """Count, plain level statistics, intervals and cyclic rate of every string."""
    seen = neighbours(shots, keys, order, lag={"_prev": time_us}, limit=limit)
    gap = (F.col(time_us) - F.col("_prev")) / 1000.0
    v = F.col(level)
    return seen.groupBy(*keys).agg(
        F.count("*").alias("n_shots"), F.max(v).alias("peak_max_dB"), F.min(v).alias("peak_min_dB"),
        F.avg(v).alias("peak_mean_dB"), L.spread(v).alias("peak_std_dB"),
        F.min(gap).alias("min_interval_ms"), F.max(gap).alias("max_interval_ms"),
        F.avg(gap).alias("mean_interval_ms"), (60000.0 / F.avg(gap)).alias("cyclic_rate_rpm"),
        (F.min(time_us) / 1e6).alias("first_shot_s"), (F.max(time_us) / 1e6).alias("last_shot_s"),
        F.count_if("window_truncated").alias("n_truncated"), F.count_if("clipped").alias("n_clipped"))
