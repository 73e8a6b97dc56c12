"""Queries over pairs of recordings and over insertion loss."""

from pyspark.sql import functions as F

from percussa.functions import levels as L
from percussa.functions.air import ABSORPTION_SQL
from percussa.operators import pairing as P
from percussa.operators import strings as S
from percussa.plans import bindings as B
from percussa.plans.catalog import query, r, rounded
from percussa.plans.strings_queries import (
    ACROSS_COLS, ACROSS_SQL, BAND_STATS_SQL, KEY, ORDER, _stats_sql, _unpivot_sql)

SESSION = "session_id"
PAIR = ["session_id", "test_recording_id", "ref_recording_id"]
FIELDS = ["recording_id", "configuration", "weapon", "ammunition", "mic_distance_m", "mic_angle_deg", "mic_height_m",
          "mic_model", "mic_serial", "location", "operator", "windscreen", "ground_surface", "temperature_C",
          "humidity_pct", "pressure_kPa", "calibration_pre_dB", "calibration_post_dB", "date", "n_valid", "level"]

PAIRS_SQL = f"""{B.RECORDINGS_SQL},
first_ref AS (SELECT session_id, min(recording_id) AS rid FROM recordings WHERE configuration = 'unsuppressed' GROUP BY 1),
pairs AS (SELECT t.session_id, {", ".join(f't."{c}" AS "test_{c}", f."{c}" AS "ref_{c}"' for c in FIELDS)}
  FROM recordings t JOIN first_ref USING (session_id) JOIN recordings f ON f.recording_id = rid
  WHERE t.configuration = 'suppressed')"""

TOL = {"mic_distance_m": "0.01::DOUBLE", "mic_height_m": "0.01::DOUBLE", "mic_angle_deg": "2.0::DOUBLE"}


def _agree(c, a="ref_", b="test_"):
    if c in TOL:
        return f"coalesce(abs({a}{c} - {b}{c}) <= {TOL[c]}, false)"
    return f"coalesce(lower({a}{c}) = lower({b}{c}), false)"


def score_sql(a="ref_", b="test_"):
    return " + ".join(f"CASE WHEN {_agree(c, a, b)} THEN {w} ELSE 0 END" for c, w in P.SCORE_FIELDS.items())


def pairs(spark, sf):
    return P.designated_pairs(B.recordings(spark, sf), SESSION, "recording_id")


@query(f"""WITH {PAIRS_SQL} SELECT session_id, test_recording_id, ref_recording_id,
 CASE WHEN lower(ref_weapon) <> lower(test_weapon) THEN 'weapon differs'
      WHEN lower(ref_ammunition) <> lower(test_ammunition) THEN 'ammunition differs'
      WHEN ref_configuration <> 'unsuppressed' THEN 'candidate is not unsuppressed' END AS reason FROM pairs""")
def disqualified_references(spark, sf):
    return P.typed(pairs(spark, sf)).select(*PAIR, P.disqualified().alias("reason"))


@query(f"""WITH {PAIRS_SQL} SELECT session_id, test_recording_id, ref_recording_id, ({score_sql()})::DOUBLE AS score FROM pairs""")
def match_score(spark, sf):
    return P.typed(pairs(spark, sf)).select(*PAIR, P.match_score().alias("score"))


@query(f"""WITH {B.RECORDINGS_SQL}, t AS (SELECT * FROM recordings WHERE configuration = 'suppressed'),
f AS (SELECT * FROM recordings WHERE configuration = 'unsuppressed'),
scored AS (SELECT t.session_id, t.recording_id, f.recording_id AS ref_id, ({score_sql("f.", "t.")})::DOUBLE AS score
  FROM t JOIN f USING (session_id) WHERE coalesce(lower(f.weapon) = lower(t.weapon), true)
  AND coalesce(lower(f.ammunition) = lower(t.ammunition), true)),
best AS (SELECT session_id, recording_id, score, count(*) AS n_best, min(ref_id) AS best_id FROM
  (SELECT *, max(score) OVER (PARTITION BY recording_id) AS top FROM scored) WHERE score = top GROUP BY 1, 2, 3),
n AS (SELECT session_id, count(*) AS n_refs FROM f GROUP BY 1)
SELECT t.session_id, t.recording_id, CASE WHEN n_best = 1 THEN best_id END AS reference_id, score, n_best,
 CASE WHEN n_refs IS NULL THEN 'no unsuppressed recording in the session' WHEN score IS NULL THEN 'every reference is disqualified'
  WHEN n_best > 1 THEN n_best || ' references match equally well' END AS refusal
FROM t LEFT JOIN best USING (recording_id) LEFT JOIN n ON n.session_id = t.session_id""")
def auto_pair(spark, sf):
    return P.auto_pair(B.recordings(spark, sf), SESSION)


def _alpha(hz, side):
    return (ABSORPTION_SQL.replace("(tc +", f'("{side}_temperature_C" +').replace("(rh *", f"({side}_humidity_pct *")
            .replace("(kpa /", f'(coalesce("{side}_pressure_kPa", 101.325::DOUBLE) /').replace(" f * f", f" {hz}::DOUBLE * {hz}::DOUBLE"))


def _change(hz):
    return f"(({_alpha(hz, 'test')} - {_alpha(hz, 'ref')}) * path)"


RULES = {
    "configuration": [("ref_configuration IS NULL OR test_configuration IS NULL", "configuration_missing", "'advisory'"),
                      ("ref_configuration = test_configuration", "configuration_identical", "'blocking'"),
                      ("ref_configuration <> test_configuration AND ref_configuration <> 'unsuppressed'",
                       "reference_not_unsuppressed", "'blocking'"),
                      ("ref_weapon IS NULL OR test_weapon IS NULL", "weapon_missing", "'advisory'"),
                      ("lower(ref_weapon) <> lower(test_weapon)", "weapon_differs", "'blocking'"),
                      ("ref_ammunition IS NULL OR test_ammunition IS NULL", "ammunition_missing", "'advisory'"),
                      ("lower(ref_ammunition) <> lower(test_ammunition)", "ammunition_differs", "'blocking'")],
    "geometry": [("ref_mic_distance_m IS NULL OR test_mic_distance_m IS NULL", "distance_missing", "'material'"),
                 ("ref_mic_distance_m <= 0 OR test_mic_distance_m <= 0", "distance_invalid", "'blocking'"),
                 ("abs(ref_mic_distance_m - test_mic_distance_m) > 0.01::DOUBLE AND ref_mic_distance_m > 0 AND test_mic_distance_m > 0",
                  "distance_differs", "'material'", "20 * log10(test_mic_distance_m / ref_mic_distance_m)", "true"),
                 ("ref_mic_angle_deg IS NULL OR test_mic_angle_deg IS NULL", "angle_missing", "'material'"),
                 ("abs(ref_mic_angle_deg - test_mic_angle_deg) > 2", "angle_differs", "'blocking'"),
                 ("abs(ref_mic_height_m - test_mic_height_m) > 0.01::DOUBLE", "height_differs", "'material'"),
                 ("lower(ref_ground_surface) <> lower(test_ground_surface)", "ground_differs", "'material'")],
    "atmosphere": [("no_weather", "weather_missing", "'advisory'"),
                   ("weather AND NOT coalesce(path > 0, false)", "weather_differs", "'advisory'"),
                   ("weather AND path > 0", "weather_differs", "'material'",
                    f"CASE WHEN abs({_change(4000)}) > abs({_change(1000)}) THEN {_change(4000)} ELSE {_change(1000)} END", "true")],
    "chain": [("lower(ref_mic_model) <> lower(test_mic_model)", "mic_model_differs", "'material'"),
              ("ref_mic_serial <> test_mic_serial", "mic_serial_differs", "'advisory'"),
              ('abs("ref_calibration_post_dB" - "ref_calibration_pre_dB") > 0.5::DOUBLE', "reference_calibration_drift", "'material'",
               '"ref_calibration_post_dB" - "ref_calibration_pre_dB"', "false"),
              ('abs("test_calibration_post_dB" - "test_calibration_pre_dB") > 0.5::DOUBLE', "test_calibration_drift", "'material'",
               '"test_calibration_post_dB" - "test_calibration_pre_dB"', "false"),
              ("lower(ref_windscreen) <> lower(test_windscreen)", "windscreen_differs", "'material'"),
              ("gap > 0", "different_day", "CASE WHEN gap <= 1 THEN 'advisory' ELSE 'material' END"),
              ("lower(ref_location) <> lower(test_location)", "location_differs", "'blocking'")],
    "strings": [("ref_n_valid = 0", "reference_empty", "'blocking'"), ("test_n_valid = 0", "test_empty", "'blocking'"),
                ("ref_n_valid BETWEEN 1 AND 4", "reference_short", "'material'"),
                ("test_n_valid BETWEEN 1 AND 4", "test_short", "'material'")],
}


def _rules_sql(groups):
    out = []
    for g in groups:
        for rule in RULES[g]:
            when, code, severity, dB, ok = (*rule, "NULL::DOUBLE", "false")[:5]
            out.append(f"SELECT session_id, test_recording_id, ref_recording_id, '{code}' AS code, {severity} AS severity, "
                       f"{dB} AS dB, {ok} AS correctable FROM facts WHERE {when}")
    return " UNION ALL ".join(out)


_FORMATS = "['%Y-%m-%d', '%Y/%m/%d', '%d/%m/%Y', '%m/%d/%Y']"
FACTS_SQL = f"""{PAIRS_SQL}, facts AS (SELECT *,
  "ref_temperature_C" IS NULL OR "test_temperature_C" IS NULL OR ref_humidity_pct IS NULL OR test_humidity_pct IS NULL AS no_weather,
  coalesce(abs("ref_temperature_C" - "test_temperature_C") > 5 OR abs(ref_humidity_pct - test_humidity_pct) > 20, false)
   AND "ref_temperature_C" IS NOT NULL AND "test_temperature_C" IS NOT NULL AND ref_humidity_pct IS NOT NULL AND test_humidity_pct IS NOT NULL AS weather,
  coalesce(nullif(test_mic_distance_m, 0), ref_mic_distance_m) AS path,
  abs(date_diff('day', try_strptime(ref_date, {_FORMATS}), try_strptime(test_date, {_FORMATS}))) AS gap FROM pairs)"""


def _objection_query(groups):
    return f"""WITH {FACTS_SQL} SELECT session_id, test_recording_id, ref_recording_id, code, severity, {r("dB", "quantified_dB")},
 correctable, CASE severity WHEN 'blocking' THEN 2 WHEN 'material' THEN 1 ELSE 0 END AS rank FROM ({_rules_sql(groups)})"""


CODES = {g: [rule[1] for rule in rules] for g, rules in RULES.items()}


def _objections(spark, sf, groups):
    codes = [c for g in groups for c in CODES[g]]
    return rounded(P.objections(pairs(spark, sf), PAIR).where(F.col("code").isin(codes)))


@query(_objection_query(["configuration"]))
def objections_source(spark, sf):
    return _objections(spark, sf, ["configuration"])


@query(_objection_query(["geometry"]))
def objections_geometry(spark, sf):
    return _objections(spark, sf, ["geometry"])


@query(_objection_query(["atmosphere"]))
def objections_atmosphere(spark, sf):
    return _objections(spark, sf, ["atmosphere"])


@query(_objection_query(["chain"]))
def objections_chain_and_session(spark, sf):
    return _objections(spark, sf, ["chain"])


@query(_objection_query(["strings"]))
def objections_strings(spark, sf):
    return _objections(spark, sf, ["strings"])


@query(f"""WITH {FACTS_SQL}, o AS ({_rules_sql(list(RULES))}),
g AS (SELECT session_id, test_recording_id, ref_recording_id, count(*) AS n, bool_or(severity = 'blocking') AS blocked,
  sum(abs(dB)) AS s, bool_and(correctable) FILTER (WHERE dB IS NOT NULL) AS ok FROM o GROUP BY 1, 2, 3)
SELECT p.session_id, p.test_recording_id, p.ref_recording_id, coalesce(n, 0)::INT AS n_objections,
 NOT coalesce(blocked, false) AS comparable, {r("coalesce(s, 0)", "unexplained_dB")}, coalesce(ok, false) AS all_correctable
FROM pairs p LEFT JOIN g USING (test_recording_id)""")
def comparability(spark, sf):
    return rounded(P.comparability(pairs(spark, sf), PAIR))


CONFIG_SQL = f"""{B.SHOT_RECORDS_SQL}, stats AS (SELECT recording_id AS rc, * FROM (
  {_stats_sql(_unpivot_sql("WHERE valid AND configuration = 'unsuppressed'"))})),
test_stats AS (SELECT * FROM ({_stats_sql(_unpivot_sql("WHERE valid AND configuration = 'suppressed'"))})),
loss AS (SELECT s.recording_id, s.metric, s.mean AS a, s.n AS an, t.mean AS b, t.n AS bn, s.mean - t.mean AS d,
  sqrt(s.ci95 * s.ci95 + t.ci95 * t.ci95) AS ci FROM stats s JOIN test_stats t USING (recording_id, metric)
  WHERE metric IN ('Lpeak_Z', 'LAE'))"""


def shot_losses(spark, sf):
    shots = B.shot_records(spark, sf, number=False).where("valid AND configuration IS NOT NULL")
    stats = S.metric_stats(S.unpivot_metrics(shots, [*KEY, "configuration"], ["Lpeak_Z", "LAE"]), [*KEY, "configuration"])
    return P.insertion_loss(stats.where("configuration = 'unsuppressed'"),
                            stats.where("configuration = 'suppressed'"), KEY)


@query(f"""WITH {CONFIG_SQL} SELECT recording_id, metric, {r("a", "reference_dB")}, an AS reference_n, {r("b", "test_dB")},
 bn AS test_n, {r("d", "reduction_dB")}, {r("ci", "ci95_dB")} FROM loss""")
def insertion_loss(spark, sf):
    return rounded(shot_losses(spark, sf).drop("significant"))


@query(f"""WITH {CONFIG_SQL} SELECT recording_id, metric, {r("d", "reduction_dB")}, abs(d) > ci AS significant FROM loss""")
def significant_loss(spark, sf):
    return rounded(shot_losses(spark, sf).select("recording_id", "metric", "reduction_dB", "significant"))


BAND_LOSS_SQL = f"""{B.BANDS_SQL}, {BAND_STATS_SQL},
pairs AS (SELECT a.recording_id, a.band, a.mean AS am, a.se AS ase, b.mean AS bm, b.se AS bse
  FROM (SELECT * FROM band_stats WHERE configuration = 'unsuppressed') a
  FULL JOIN (SELECT * FROM band_stats WHERE configuration = 'suppressed') b USING (recording_id, band)),
loss AS (SELECT recording_id, band, am, bm, am - bm AS d, 1.96 * sqrt(ase * ase + bse * bse) AS ci FROM pairs
  WHERE recording_id NOT IN (SELECT recording_id FROM pairs WHERE am IS NULL OR bm IS NULL))"""


def band_losses(spark, sf):
    stats = S.band_stats(B.bands(spark, sf).where("configuration != 'other'"), ["recording_id", "configuration"])
    return P.band_insertion_loss(stats, ["recording_id"])


@query(f"""WITH {BAND_LOSS_SQL} SELECT recording_id, band, {r("am", "reference_dB")}, {r("bm", "test_dB")}, {r("d", "loss_dB")} FROM loss""")
def band_insertion_loss(spark, sf):
    return rounded(band_losses(spark, sf).drop("ci95_dB", "finding"))


@query(f"""WITH {BAND_LOSS_SQL} SELECT recording_id, band, {r("d", "loss_dB")}, {r("ci", "ci95_dB")},
 CASE WHEN abs(d) <= ci THEN 'inconclusive' WHEN d < 0 THEN 'increase' ELSE 'reduction' END AS finding FROM loss""")
def band_loss_confidence(spark, sf):
    return rounded(band_losses(spark, sf).select("recording_id", "band", "loss_dB", "ci95_dB", "finding"))


@query(f"""WITH {PAIRS_SQL}, f AS (SELECT *, test_recording_id % 7 <> 0 AS tc, ref_recording_id % 7 <> 0 AS rc FROM pairs)
SELECT session_id, test_recording_id, ref_recording_id,
 CASE WHEN tc <> rc THEN 'level units differ' WHEN ref_n_valid = 0 THEN 'reference has no valid shots' END AS refusal,
 CASE WHEN tc = rc AND ref_n_valid <> 0 THEN list_filter([
  CASE WHEN ref_recording_id % 4 <> test_recording_id % 4 THEN 'calibration factors differ' END,
  CASE WHEN ref_recording_id % 2 <> test_recording_id % 2 THEN 'sample rates differ' END,
  CASE WHEN NOT rc THEN 'reference is uncalibrated' END], lambda x: x IS NOT NULL) END AS warnings FROM f""")
def comparison_guards(spark, sf):
    p = pairs(spark, sf)
    for side in ("ref", "test"):
        k = F.col(f"{side}_recording_id")
        p = p.withColumns({
            f"{side}_calibrated": k % 7 != 0, f"{side}_level_unit": L.level_unit(k % 7 != 0),
            f"{side}_Pa_per_FS": (k % 4).cast("double"), f"{side}_fs": k % 2})
    return P.comparison_guards(p, PAIR)


@query(f"""WITH {B.RECORDINGS_SQL}, e AS (SELECT *, recording_id % 37 = 0 AS failed FROM recordings),
first_ref AS (SELECT session_id, min(recording_id) AS rid FROM recordings WHERE configuration = 'unsuppressed' GROUP BY 1),
p AS (SELECT r.session_id, count(*) FILTER (WHERE recording_id % 5 <> 0) AS n_paired, count(*) FILTER (WHERE recording_id % 5 = 0) AS n_refused
  FROM recordings r JOIN first_ref USING (session_id) WHERE configuration = 'suppressed' GROUP BY 1)
SELECT session_id, count(*) FILTER (WHERE NOT failed) AS n_analysed, count(*) FILTER (WHERE failed) AS n_failed,
 count(*) FILTER (WHERE NOT failed AND configuration IS NULL) AS n_unconfigured,
 count(*) FILTER (WHERE NOT failed AND configuration = 'unsuppressed') AS n_references,
 coalesce(any_value(n_paired), 0) AS n_paired, coalesce(any_value(n_refused), 0) AS n_refused
FROM e LEFT JOIN p USING (session_id) GROUP BY 1""")
def session_rollup(spark, sf):
    recs = B.recordings(spark, sf).withColumn("error", F.when(F.col("recording_id") % 37 == 0, "could not be read"))
    done = pairs(spark, sf).select("session_id", F.when(F.col("test_recording_id") % 5 == 0, "tie").alias("refusal"))
    return P.session_rollup(recs, done, SESSION)


@query(f"""WITH {B.RECORDINGS_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t_us, recording_id) AS pos
  FROM recordings WHERE configuration = 'unsuppressed'),
g AS (SELECT session_id, count(*) AS n_baselines, regr_slope(level, pos) AS s, arg_max(level, pos) - arg_min(level, pos) AS m FROM v GROUP BY 1)
SELECT session_id, n_baselines, {r("CASE WHEN n_baselines >= 3 THEN s END", "trend_dB_per_string", 9)},
 {r("CASE WHEN n_baselines = 2 THEN m END", "moved_dB", 9)} FROM g""")
def baseline_drift(spark, sf):
    base = B.recordings(spark, sf).where("configuration = 'unsuppressed'").select(
        SESSION, "recording_id", "t_us", "level")
    return rounded(P.baseline_drift(base, SESSION, ["t_us", "recording_id"]), 9)


@query(f"""WITH RECURSIVE {B.SHOTS_SQL}, v AS (SELECT recording_id % 7 AS grp, *,
  row_number() OVER (PARTITION BY recording_id ORDER BY t_us, event_id) AS at FROM shots WHERE valid AND configuration = 'suppressed'), {ACROSS_SQL}
SELECT grp AS session_id, {ACROSS_COLS} FROM j""".replace(" AS at FROM", " AS pos FROM"))
def session_pop(spark, sf):
    shots = B.shots(spark, sf, number=False).withColumn("session_id", F.col("recording_id") % 7)
    return rounded(P.session_pop(shots, ["session_id"], KEY, ORDER))


_PROPOSE = ["weapon", "ammunition", "mic_model", "mic_distance_m", "mic_angle_deg"]


@query(f"""WITH {B.RECORDINGS_SQL}, t AS (SELECT * FROM recordings WHERE configuration = 'suppressed'
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY t_us DESC, recording_id DESC) = 1),
s AS (SELECT f.session_id, t.recording_id AS test_id, f.recording_id AS reference_id, f.t_us,
  {" + ".join(f"coalesce(f.{c} = t.{c}, false)::INT" for c in _PROPOSE)} AS shared
  FROM recordings f JOIN t USING (session_id) WHERE f.configuration = 'unsuppressed')
SELECT session_id, test_id, reference_id, shared FROM s
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY shared DESC, t_us DESC, reference_id DESC) = 1""")
def propose_pair(spark, sf):
    return P.propose_pair(B.recordings(spark, sf), [SESSION], _PROPOSE, "t_us")


