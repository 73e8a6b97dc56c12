"""Queries over strings of shots: aggregates, hazard, first round, trend, rate."""

from pyspark.sql import functions as F

from percussa.functions import levels as L
from percussa.operators import strings as S
from percussa.plans import bindings as B
from percussa.plans.catalog import em, query, r, rounded, rs, t_quantile_cte, t_tail_sql

KEY = ["recording_id"]
ORDER = ["t_us", "event_id"]
DAY = "10 * log10(28800.0::DOUBLE)"
MET = B.SHOT_METRICS


def valid(spark, sf):
    return B.shots(spark, sf, number=False).where("valid")


def _unpivot_sql(where: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT recording_id, '{m}' AS metric, "{m}" AS value FROM shot_records {where}""" for m in MET)


def _stats_sql(source: str) -> str:
    return f"""SELECT recording_id, metric, count(value) AS n,
  CASE WHEN metric IN ('Lpeak_Z','LAE') THEN {em("value")} ELSE avg(value) END AS mean,
  CASE WHEN count(value) = 1 THEN 0.0 ELSE stddev_samp(value) END AS std, min(value) AS minimum,
  max(value) AS maximum, median(value) AS median,
  CASE WHEN count(value) > 1 THEN 1.96 * stddev_samp(value) / sqrt(count(value)) ELSE 0.0 END AS ci95
FROM ({source}) GROUP BY 1, 2"""


STATS_COLS = ["mean", "std", "minimum", "maximum", "median", "ci95"]


@query(f"WITH {B.SHOTS_SQL} SELECT recording_id, {r(em('level'), 'energy_mean_dB')} FROM shots GROUP BY 1")
def energy_mean(spark, sf):
    shots = B.shots(spark, sf, number=False)
    return rounded(shots.groupBy(*KEY).agg(L.energy_mean("level").alias("energy_mean_dB")))


@query(f"WITH {B.SHOT_RECORDS_SQL} SELECT recording_id, metric, n, {rs(*STATS_COLS)} "
       f"FROM ({_stats_sql(_unpivot_sql(''))})")
def metric_stats(spark, sf):
    shots = B.shot_records(spark, sf, number=False)
    return rounded(S.metric_stats(S.unpivot_metrics(shots, KEY, MET), KEY))


@query(f"WITH {B.SHOT_RECORDS_SQL} SELECT recording_id, metric, n, {rs(*STATS_COLS)}, n_shots, n_valid "
       f"FROM ({_stats_sql(_unpivot_sql('WHERE valid'))}) RIGHT JOIN "
       "(SELECT recording_id, count(*) AS n_shots, count(*) FILTER (WHERE valid) AS n_valid FROM shots GROUP BY 1) "
       "USING (recording_id)")
def aggregate_string(spark, sf):
    return rounded(S.aggregate_string(B.shot_records(spark, sf, number=False), KEY, MET))


BAND_KEY = "recording_id, configuration, band"
BAND_STATS_SQL = f"""band_stats AS (SELECT {BAND_KEY}, count(level) AS n, {em("level")} AS mean,
  CASE WHEN count(level) = 1 THEN 0.0 ELSE stddev_samp(level) END AS std, min(level) AS minimum, max(level) AS maximum,
  CASE WHEN count(level) > 1 THEN stddev_samp(level) / sqrt(count(level)) ELSE 0.0 END AS se
  FROM bands GROUP BY {BAND_KEY})"""


@query(f"""WITH {B.BANDS_SQL}, laid AS (
  SELECT recording_id FROM (SELECT recording_id, configuration, count(DISTINCT band) AS k FROM bands
    GROUP BY 1, 2) GROUP BY 1 HAVING min(k) = max(k))
  SELECT recording_id, band, {r(em("level"), "mean")} FROM bands JOIN laid USING (recording_id)
  GROUP BY 1, 2""")
def band_energy_mean(spark, sf):
    bands = B.bands(spark, sf)
    distinct = bands.select("recording_id", "configuration", "band").distinct()
    laid = S.same_layout(distinct, ["recording_id"], ["configuration"])
    return rounded(S.band_stats(bands.join(laid, "recording_id", "left_semi"), ["recording_id"])
                   .select("recording_id", "band", "mean"))


@query(f"WITH {B.BANDS_SQL}, {BAND_STATS_SQL} SELECT {BAND_KEY}, {rs('std', 'minimum', 'maximum')} FROM band_stats")
def band_spread(spark, sf):
    s = S.band_stats(B.bands(spark, sf), ["recording_id", "configuration"])
    return rounded(s.select("recording_id", "configuration", "band", "std", "minimum", "maximum"))


@query(f"WITH {B.BANDS_SQL}, {BAND_STATS_SQL} SELECT {BAND_KEY}, n, {rs('mean', 'se')} FROM band_stats")
def band_mean_se(spark, sf):
    s = S.band_stats(B.bands(spark, sf), ["recording_id", "configuration"])
    return rounded(s.select("recording_id", "configuration", "band", "n", "mean", "se"))


def _hazard_sql(mean: str, n: str, criterion: str, extra: str) -> str:
    laeq = f"({mean} + 10 * log10({n}::DOUBLE) - {DAY})"
    return f"""{extra}, {r(mean, "LAE_mean")}, {r(laeq, "LAeq8h_dB")},
  {r(f"log10(100 * power(10.0::DOUBLE, ({laeq} - {criterion}) / 10))", "log_dose_percent")},
  {r(f"log10(power(10.0::DOUBLE, ({criterion} - {mean} + {DAY}) / 10))", "log_allowable_rounds")},
  {laeq} > {criterion} AS exceeds_limit"""


def _log_hazard(df):
    return df.withColumn("log_dose_percent", F.log10("dose_percent")).withColumn(
        "log_allowable_rounds", F.log10("allowable_rounds")).drop("dose_percent", "allowable_rounds")


@query(f"""WITH {B.SHOT_RECORDS_SQL}, used AS (SELECT recording_id, count("LAE") AS n_rounds, {em('"LAE"')} - 25 AS m
  FROM shot_records WHERE valid GROUP BY 1)
  SELECT {_hazard_sql("m", "n_rounds", "85", "recording_id, n_rounds")} FROM used""")
def hazard(spark, sf):
    return rounded(_log_hazard(S.hazard(B.shot_records(spark, sf, number=False), KEY, protection_dB=25.0)))


@query(f"""WITH {B.SHOT_RECORDS_SQL}, used AS (SELECT recording_id, count("LAE") AS n_shots_used, {em('"LAE"')} AS m
  FROM shot_records WHERE valid GROUP BY 1),
  pairs(n_rounds, criterion) AS (VALUES (10, 85.0::DOUBLE), (100, 85.0::DOUBLE), (40, 90.0::DOUBLE))
  SELECT {_hazard_sql("m", "n_rounds", "criterion", 'recording_id, n_shots_used, n_rounds, criterion AS "criterion_dB"')}
  FROM used, pairs""")
def hazard_what_if(spark, sf):
    shots = B.shot_records(spark, sf, number=False)
    return rounded(_log_hazard(S.hazard_what_if(shots, KEY, [(10, 85.0), (100, 85.0), (40, 90.0)])))


@query(f"""WITH {B.SHOT_RECORDS_SQL}, kept AS (SELECT s.* FROM shot_records s ANTI JOIN
  (SELECT user_id AS recording_id, event_id FROM events WHERE event_type = 'error') j USING (recording_id, event_id))
  SELECT recording_id, metric, n, {rs(*STATS_COLS)} FROM (
  {_stats_sql(_unpivot_sql('').replace('shot_records', 'kept'))})""")
def reaggregate_without_rejected(spark, sf):
    kept = S.without_rejected(B.shot_records(spark, sf, number=False), B.rejections(spark, sf),
                              ["recording_id", "event_id"])
    return rounded(S.metric_stats(S.unpivot_metrics(kept, KEY, MET), KEY))


FIRST_SQL = f"""valid_shots AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY t_us, event_id) AS pos
  FROM shots WHERE valid),
per AS (SELECT recording_id, count(*) AS n_shots, max(level) FILTER (WHERE pos = 1) AS first_dB,
  count(*) FILTER (WHERE pos > 1) AS n, avg(level) FILTER (WHERE pos > 1) AS mean,
  stddev_samp(level) FILTER (WHERE pos > 1) AS sd, {em("level")} AS mean_all,
  10 * log10(avg(power(10.0::DOUBLE, level / 10)) FILTER (WHERE pos > 1)) AS mean_rest FROM valid_shots GROUP BY 1)"""


@query(f"""WITH RECURSIVE {B.SHOTS_SQL}, {FIRST_SQL},
judged AS (SELECT *, n - 1 AS df, CASE WHEN n < 4 THEN 'too few shots after the first'
    WHEN sd <= 0 THEN 'no spread after the first shot' END AS refusal, sd * sqrt(1 + 1 / n::DOUBLE) AS se FROM per),
{t_quantile_cte("crit", "SELECT DISTINCT df, 0.05::DOUBLE AS tail FROM judged WHERE refusal IS NULL")},
j AS (SELECT judged.*, crit.t FROM judged LEFT JOIN crit ON judged.df = crit.df AND refusal IS NULL)
SELECT recording_id, n AS n_subsequent, {r("first_dB", "first_dB")},
 {r("CASE WHEN n >= 4 THEN mean END", "subsequent_mean_dB")}, {r("CASE WHEN n >= 4 THEN sd END", "subsequent_sd_dB")},
 {r("CASE WHEN n >= 4 THEN first_dB - mean_rest END", "observed_dB")},
 {r("mean - t * se", "prediction_lower_dB")}, {r("mean + t * se", "prediction_upper_dB")},
 {r("CASE WHEN refusal IS NULL THEN " + t_tail_sql("((first_dB - mean) / se)", "df") + " END", "p_value")},
 coalesce(first_dB > mean + t * se, false) AS established, refusal FROM j""")
def first_round_pop(spark, sf):
    return rounded(S.first_round_pop(valid(spark, sf), KEY, ORDER))


ACROSS_SQL = f"""per AS (SELECT grp, recording_id, count(*) AS n_shots, max(level) FILTER (WHERE pos = 1) AS first_dB,
  count(*) FILTER (WHERE pos > 1) AS n,
  10 * log10(avg(power(10.0::DOUBLE, level / 10)) FILTER (WHERE pos > 1)) AS mean_rest FROM v GROUP BY 1, 2),
d AS (SELECT grp, CASE WHEN n >= 4 THEN first_dB - mean_rest END AS d FROM per),
g AS (SELECT grp, count(d) AS n_strings, count(*) - count(d) AS n_skipped, avg(d) AS mean, stddev_samp(d) AS sd,
  count(d) - 1 AS df, stddev_samp(d) / sqrt(count(d)) AS se FROM d GROUP BY 1),
{t_quantile_cte("crit", "SELECT DISTINCT df, 0.025::DOUBLE AS tail FROM g WHERE n_strings >= 3")},
j AS (SELECT g.*, crit.t FROM g LEFT JOIN crit ON g.df = crit.df AND n_strings >= 3)"""
ACROSS_COLS = f"""n_strings, n_skipped, {r("CASE WHEN n_strings >= 3 THEN mean END", "pop_dB")},
 {r("CASE WHEN n_strings >= 3 THEN sd END", "sd_dB")}, {r("mean - t * se", "ci_low_dB")},
 {r("mean + t * se", "ci_high_dB")},
 {r("CASE WHEN n_strings >= 3 THEN " + t_tail_sql("(mean / se)", "df") + " END", "p_value")},
 coalesce(n_strings >= 3 AND {t_tail_sql("(mean / se)", "df")} < 0.05, false) AS established,
 CASE WHEN n_strings < 3 THEN 'too few usable strings' END AS refusal"""


@query(f"""WITH RECURSIVE {B.SHOTS_SQL}, v AS (SELECT recording_id % 5 AS grp, *,
  row_number() OVER (PARTITION BY recording_id ORDER BY t_us, event_id) AS pos FROM shots WHERE valid), {ACROSS_SQL}
SELECT grp, {ACROSS_COLS} FROM j""")
def first_round_pop_across(spark, sf):
    shots = valid(spark, sf).withColumn("grp", F.col("recording_id") % 5)
    return rounded(S.first_round_pop_across(shots, KEY, ["grp"], ORDER))


@query(f"""WITH {B.SHOTS_SQL} SELECT recording_id, count(*) AS n_shots, count(level) AS n_finite,
 {r(em("level"), "energy_mean_dB")}, {r("avg(level)", "arithmetic_mean_dB")}, {r("stddev_samp(level)", "sd_dB")},
 {r("min(level)", "minimum_dB")}, {r("max(level)", "maximum_dB")},
 {r("quantile_cont(level, 0.05)", "p5")}, {r("quantile_cont(level, 0.25)", "p25")},
 {r("quantile_cont(level, 0.5)", "median_dB")}, {r("quantile_cont(level, 0.75)", "p75")},
 {r("quantile_cont(level, 0.95)", "p95")}, {r("max(level) - min(level)", "range_dB")},
 {r("1.96 * stddev_samp(level) / sqrt(count(level))", "ci95_dB")} FROM shots WHERE valid GROUP BY 1""")
def string_summary(spark, sf):
    return rounded(S.string_summary(valid(spark, sf), KEY))


@query(f"""WITH {B.SHOTS_SQL}, {FIRST_SQL} SELECT recording_id, {r("mean_all", "energy_mean_dB")},
 {r("mean_rest", "energy_mean_excluding_first_dB")}, {r("mean_all - mean_rest", "first_round_cost_dB")} FROM per""")
def first_round_cost(spark, sf):
    return rounded(S.first_round_cost(valid(spark, sf), KEY, ORDER))


@query(f"""WITH {B.SHOTS_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY t_us, event_id) AS pos
  FROM shots WHERE valid),
g AS (SELECT recording_id, count(*) AS n_shots, count(*) FILTER (WHERE pos > 1) AS n_used,
  regr_slope(CASE WHEN pos > 1 THEN level END, pos) AS slope,
  corr(level, pos) FILTER (WHERE pos > 1) AS c FROM v GROUP BY 1),
k AS (SELECT *, n_shots >= 4 AND n_used >= 3 AS ok, n_used - 2 AS df, abs(c) * sqrt((n_used - 2) / (1 - c * c)) AS t FROM g),
p AS (SELECT *, CASE WHEN ok THEN 2 * {t_tail_sql("t", "df")} END AS p FROM k)
SELECT recording_id, n_shots, n_used, {r("CASE WHEN ok THEN slope END", "trend_dB_per_shot")}, {r("p", "trend_p_value")},
 coalesce(p < 0.05, false) AS trend_established FROM p""")
def string_trend(spark, sf):
    return rounded(S.string_trend(valid(spark, sf), KEY, ORDER))


@query(f"""WITH {B.SHOTS_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY recording_id, configuration ORDER BY t_us, event_id) AS pos
  FROM shots WHERE valid),
g AS (SELECT recording_id, 10 * log10(avg(power(10.0::DOUBLE, level / 10)) FILTER (WHERE configuration = 'unsuppressed')) AS a,
 10 * log10(avg(power(10.0::DOUBLE, level / 10)) FILTER (WHERE configuration = 'suppressed')) AS b,
 10 * log10(avg(power(10.0::DOUBLE, level / 10)) FILTER (WHERE configuration = 'suppressed' AND pos > 1)) AS c
 FROM v GROUP BY 1)
SELECT recording_id, {r("a", "reference_mean_dB")}, {r("b", "test_mean_dB")}, {r("c", "test_mean_excluding_first_dB")},
 {r("a - b", "reduction_including_first_dB")}, {r("a - c", "reduction_excluding_first_dB")},
 {r("(a - c) - (a - b)", "first_round_penalty_dB")} FROM g""")
def reduction_with_and_without_first(spark, sf):
    return rounded(S.reduction_with_and_without_first(valid(spark, sf), KEY, ORDER))


@query(f"""WITH {B.SHOT_RECORDS_SQL}, g AS (SELECT *, (t_us - lag(t_us) OVER (PARTITION BY recording_id ORDER BY t_us, event_id)) / 1000.0::DOUBLE AS gap
  FROM shot_records)
SELECT recording_id, count(*) AS n_shots, {r("max(level)", "peak_max_dB")}, {r("min(level)", "peak_min_dB")},
 {r("avg(level)", "peak_mean_dB")}, {r("CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(level) END", "peak_std_dB")},
 {r("min(gap)", "min_interval_ms", 3)}, {r("max(gap)", "max_interval_ms", 3)}, {r("avg(gap)", "mean_interval_ms", 3)},
 {r("60000 / avg(gap)", "cyclic_rate_rpm", 9)}, {r("min(t_us) / 1000000::DOUBLE", "first_shot_s", 3)},
 {r("max(t_us) / 1000000::DOUBLE", "last_shot_s", 3)},
 count(*) FILTER (WHERE window_truncated) AS n_truncated, count(*) FILTER (WHERE clipped) AS n_clipped
 FROM g GROUP BY 1""")
def string_rate_summary(spark, sf):
    shots = B.shot_records(spark, sf, number=False)
    out = S.rate_summary(shots, KEY, "t_us", ORDER)
    return rounded(out, 6, min_interval_ms=3, max_interval_ms=3, mean_interval_ms=3, cyclic_rate_rpm=9,
                   first_shot_s=3, last_shot_s=3)
