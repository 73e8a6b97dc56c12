"""Queries that review the shots of each recording."""

from percussa.operators import review as V
from percussa.operators import strings as S
from percussa.plans import bindings as B
from percussa.plans.catalog import query, r, rounded, t_quantile_cte, t_tail_sql
from percussa.plans.strings_queries import FIRST_SQL, KEY, ORDER

MET = B.SHOT_METRICS
ALPHA = 0.05 / 5


def _long(spark, sf):
    return S.unpivot_metrics(B.shot_records(spark, sf, number=False), KEY + ["event_id"], MET)


_LONG_SQL = " UNION ALL ".join(
    f"""SELECT recording_id, event_id, shot_number, '{m}' AS metric, "{m}" AS value FROM shot_records""" for m in MET)
CENTER_SQL = """center AS (SELECT recording_id, metric, median(value) AS median FROM long GROUP BY 1, 2),
mads AS (SELECT recording_id, metric, any_value(c.median) AS median, median(abs(value - c.median)) AS mad
  FROM long JOIN center c USING (recording_id, metric) GROUP BY 1, 2)"""


@query(f"""WITH {B.SHOT_RECORDS_SQL}, long AS ({_LONG_SQL}), {CENTER_SQL}
SELECT recording_id, event_id, metric, {r("median", "median")}, {r("mad", "mad")},
 {r("CASE WHEN mad > 0 THEN 0.6745 * (value - median) / mad ELSE 0 END", "modified_z")}
FROM long JOIN mads USING (recording_id, metric)""")
def modified_z_scores(spark, sf):
    return rounded(V.modified_z(_long(spark, sf), KEY + ["metric"]).drop("value"))


@query(f"""WITH {B.SHOT_RECORDS_SQL}, long AS ({_LONG_SQL}), {CENTER_SQL}
SELECT recording_id, metric, {r("median", "median")}, {r("mad", "mad")},
 {r("CASE WHEN mad > 0 THEN median - 2 * 1.4826 * mad END", "low")},
 {r("CASE WHEN mad > 0 THEN median + 2 * 1.4826 * mad END", "high")} FROM mads""")
def robust_spread_band(spark, sf):
    return rounded(V.robust_spread_band(_long(spark, sf), KEY + ["metric"]))


def _esd_sql(source: str, alpha: float) -> str:
    """Sequential removal over lists, one recursion step per removed value."""
    return f"""esd_start AS (SELECT recording_id, metric, list(value ORDER BY event_id) AS vals, list(event_id ORDER BY event_id) AS ids,
   count(*) AS n, greatest(1, least(greatest(1, floor(count(*) * 0.1::DOUBLE)::INT), count(*) - 2)) AS k
   FROM ({source}) GROUP BY 1, 2 HAVING count(*) >= 5),
esd_run AS (SELECT recording_id, metric, vals, ids, n, k, 0 AS step, NULL::BIGINT AS gone, NULL::DOUBLE AS stat, NULL::DOUBLE AS gone_value
   FROM esd_start
 UNION ALL
 SELECT recording_id, metric, list_concat(vals[1:w - 1], vals[w + 1:]), list_concat(ids[1:w - 1], ids[w + 1:]), n, k, step + 1,
   ids[w], abs(vals[w] - mu) / sd, vals[w]
 FROM (SELECT *, list_position(list_transform(vals, lambda v: abs(v - mu)), list_max(list_transform(vals, lambda v: abs(v - mu)))) AS w
  FROM (SELECT *, list_avg(vals) AS mu, list_aggregate(vals, 'stddev_samp') AS sd FROM esd_run WHERE step < k AND len(vals) >= 3))
 WHERE sd > 0),
{t_quantile_cte("esd_t", f"SELECT DISTINCT (n - step - 1) AS df, {alpha} / (2 * (n - step + 1)) AS tail FROM esd_run WHERE step > 0")},
esd_all AS (SELECT e.*, (n - step) * t / sqrt((n - step - 1 + t * t) * (n - step + 1)) AS crit FROM esd_run e
  JOIN esd_t ON esd_t.df = n - step - 1 AND esd_t.tail = {alpha} / (2 * (n - step + 1)) WHERE step > 0),
esd AS (SELECT * FROM (SELECT *, max(CASE WHEN stat > crit THEN step END) OVER (PARTITION BY recording_id, metric) AS last FROM esd_all)
  WHERE step <= last)"""


@query(f"""WITH RECURSIVE {B.SHOT_RECORDS_SQL}, long AS ({_LONG_SQL}), {_esd_sql("SELECT * FROM long", 0.05)}
SELECT recording_id, metric, gone AS event_id, {r("gone_value", "value")}, step::BIGINT AS step,
 {r("stat", "esd_statistic")}, {r("crit", "esd_critical")} FROM esd""")
def generalised_esd(spark, sf):
    return rounded(V.generalised_esd(_long(spark, sf), KEY + ["metric"], "event_id"))


FLAGS_SQL = f"""all_long AS ({_LONG_SQL}), long AS (SELECT a.* FROM all_long a JOIN shot_records s USING (recording_id, event_id)
   WHERE s.valid AND NOT s.clipped AND value <> 0), {CENTER_SQL}, {_esd_sql("SELECT * FROM long", ALPHA)},
statistical AS (SELECT recording_id, gone AS event_id,
   CASE WHEN metric IN ('Lpeak_Z', 'LAE') THEN 'level_outlier_' ELSE 'character_outlier_' END || metric AS code, 'review' AS severity,
   metric, gone_value AS value, CASE WHEN mad > 0 THEN 0.6745 * (gone_value - median) / mad ELSE 0 END AS modified_z,
   median AS string_median, stat AS esd_statistic, crit AS esd_critical FROM esd JOIN mads USING (recording_id, metric))"""
CONDITION_SQL = """conditions AS (
 SELECT recording_id, event_id, 'clipped' AS code, 'exclude' AS severity, NULL AS metric, NULL::DOUBLE AS value FROM shot_records WHERE clipped
 UNION ALL SELECT recording_id, event_id, 'truncated', 'review', NULL, NULL FROM shot_records WHERE window_truncated
 UNION ALL SELECT recording_id, event_id, 'low_snr', 'review', 'snr_dB', "snr_dB" FROM shot_records WHERE "snr_dB" < 10
 UNION ALL SELECT recording_id, event_id, 'rise_time_unresolved', 'info', 'rise_time_us', nullif(rise_time_us, 0)
   FROM shot_records WHERE NOT rise_time_resolved)"""


@query(f"""WITH RECURSIVE {B.SHOT_RECORDS_SQL}, {FLAGS_SQL} SELECT recording_id, event_id, code, severity, metric,
 {r("value", "value")}, {r("modified_z", "modified_z")}, {r("string_median", "string_median")},
 {r("esd_statistic", "esd_statistic")}, {r("esd_critical", "esd_critical")} FROM statistical""")
def string_flags(spark, sf):
    return rounded(V.statistical_flags(B.shot_records(spark, sf, number=False), KEY, "event_id"))


@query(f"""WITH {B.SHOT_RECORDS_SQL}, {CONDITION_SQL} SELECT recording_id, event_id, code, severity, metric, {r("value", "value")},
 {r("CASE WHEN code = 'low_snr' THEN 10 * log10(1 + power(10.0::DOUBLE, -value / 10)) END", "error_dB")} FROM conditions""")
def condition_flags(spark, sf):
    return rounded(V.condition_flags(B.shot_records(spark, sf, number=False), KEY, "event_id"))


REVIEW_SQL = f"""{FLAGS_SQL}, {CONDITION_SQL}, {FIRST_SQL},
crit95 AS (SELECT recording_id, n >= 4 AND sd > 0 AND {t_tail_sql("((first_dB - mean) / (sd * sqrt(1 + 1 / n::DOUBLE)))", "(n - 1)")} < 0.05 AS popped FROM per),
firsts AS (SELECT recording_id, min(event_id) AS first_id FROM shot_records JOIN crit95 USING (recording_id) WHERE popped GROUP BY 1),
flags AS (SELECT recording_id, event_id, code, severity, metric FROM conditions
  UNION ALL SELECT recording_id, event_id, code, severity, metric FROM statistical),
restated AS (SELECT f.recording_id, event_id, metric,
  CASE WHEN event_id = first_id AND starts_with(code, 'level_outlier') THEN 'first_round_pop_' || metric ELSE code END AS code,
  CASE WHEN event_id = first_id AND starts_with(code, 'level_outlier') THEN 'info' ELSE severity END AS severity
  FROM flags f LEFT JOIN firsts USING (recording_id)),
ranked AS (SELECT *, CASE severity WHEN 'exclude' THEN 2 WHEN 'review' THEN 1 ELSE 0 END AS rank FROM restated)"""


def _review(spark, sf):
    shots = B.shot_records(spark, sf, number=False)
    popped = S.first_round_pop(shots.where("valid"), KEY, ORDER).where("established")
    return V.review_flags(shots, KEY, "event_id", popped)


@query(f"""WITH RECURSIVE {B.SHOT_RECORDS_SQL}, {REVIEW_SQL} SELECT recording_id, event_id, code, severity, metric, rank FROM ranked""")
def review_flags(spark, sf):
    out = V.ordered_flags(_review(spark, sf), KEY, "event_id")
    return out.select("recording_id", "event_id", "code", "severity", "metric", "rank")


@query(f"""WITH RECURSIVE {B.SHOT_RECORDS_SQL}, {REVIEW_SQL} SELECT recording_id, event_id,
 CASE max(rank) WHEN 2 THEN 'exclude' ELSE 'review' END AS worklist FROM ranked GROUP BY 1, 2 HAVING max(rank) >= 1""")
def review_worklists(spark, sf):
    return V.worklists(_review(spark, sf), None, KEY, "event_id")


@query(f"""WITH {B.SHOT_RECORDS_SQL}, g AS (SELECT recording_id, count(*) FILTER (WHERE valid AND NOT clipped) AS n_evaluated FROM shot_records GROUP BY 1)
SELECT *, CASE WHEN n_evaluated < 5 THEN 'none' WHEN n_evaluated < 10 THEN 'half of large outliers'
 WHEN n_evaluated < 20 THEN 'four in five large outliers' WHEN n_evaluated < 30 THEN 'nine in ten large outliers'
 ELSE 'over nine in ten large outliers' END AS sensitivity FROM g""")
def review_sensitivity(spark, sf):
    return V.sensitivity(B.shot_records(spark, sf, number=False), KEY)


