"""Queries on air, geometry, microphone arrays and record validity."""

from pyspark.sql import functions as F

from percussa.functions import air
from percussa.functions.air import ABSORPTION_SQL
from percussa.operators import atmosphere as A
from percussa.operators import pairing as P
from percussa.operators import strings as S
from percussa.operators import validity as Q
from percussa.plans import bindings as B
from percussa.plans.catalog import em, query, r, rounded, rs

OCTAVES = [125.0, 250.0, 500.0, 1000.0, 2000.0, 4000.0, 8000.0, 16000.0]
AIR_SQL = """coalesce("temperature_C", 20.0::DOUBLE) AS tc, coalesce(humidity_pct, 50.0::DOUBLE) AS rh,
 coalesce("pressure_kPa", 101.325::DOUBLE) AS kpa"""
DEFAULTED_SQL = """list_filter([CASE WHEN "temperature_C" IS NULL THEN 'temperature_C' END,
 CASE WHEN humidity_pct IS NULL THEN 'humidity_pct' END, CASE WHEN "pressure_kPa" IS NULL THEN 'pressure_kPa' END],
 lambda x: x IS NOT NULL)"""
OCT_SQL = "unnest([" + ",".join(f"{c}::DOUBLE" for c in OCTAVES) + "])"


@query(f"""WITH {B.RECORDINGS_SQL}, a AS (SELECT recording_id, {AIR_SQL}, {DEFAULTED_SQL} AS defaulted, {OCT_SQL} AS f FROM recordings)
SELECT recording_id, f AS "band_Hz", {r(ABSORPTION_SQL, "alpha_dB_per_m", 9)}, defaulted FROM a""")
def absorption(spark, sf):
    out = A.absorption(B.recordings(spark, sf), OCTAVES)
    return rounded(out.select("recording_id", "band_Hz", "alpha_dB_per_m", "defaulted"), 9)


BAND_ROWS_SQL = f"""{B.RECORDINGS_SQL}, rows AS (SELECT l_orderkey AS recording_id, l_linenumber AS band,
  62.5::DOUBLE * power(2.0::DOUBLE, l_linenumber) AS f, l_quantity AS level, mic_distance_m AS d, {AIR_SQL},
  20e-6::DOUBLE * power(10.0::DOUBLE, (l_quantity + 110) / 20) AS peak
  FROM lineitem JOIN recordings ON recording_id = l_orderkey),
judged AS (SELECT *, CASE WHEN d IS NULL THEN 'distance was not recorded' WHEN d <= 0 THEN 'distance must be positive'
  WHEN peak / (1.4::DOUBLE * 101325) > 0.01::DOUBLE THEN 'propagation was not linear' END AS refusal FROM rows)"""


def band_rows(spark, sf):
    recs = B.recordings(spark, sf).select("recording_id", "mic_distance_m", *air.DEFAULT_AIR)
    lines = B.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("recording_id"), F.col("l_linenumber").alias("band"),
        (F.lit(62.5) * F.pow(F.lit(2.0), F.col("l_linenumber"))).alias("band_Hz"), F.col("l_quantity").alias("level"))
    return lines.join(recs, "recording_id")


@query(f"""WITH {BAND_ROWS_SQL} SELECT recording_id, band, {r("level", "level")},
 {r("CASE WHEN refusal IS NULL THEN 20 * log10(d) END", "geometric_dB")},
 {r(f"CASE WHEN refusal IS NULL THEN {ABSORPTION_SQL} * (d - 1) END", "absorption_dB")},
 {r(f"CASE WHEN refusal IS NULL THEN level + 20 * log10(d) + {ABSORPTION_SQL} * (d - 1) END", "normalised_dB")}, refusal FROM judged""")
def normalise_bands(spark, sf):
    rows = band_rows(spark, sf).withColumn("peak_Pa", F.lit(20e-6) * F.pow(F.lit(10.0), (F.col("level") + 110) / 20))
    out = A.normalise_bands(rows, peak_pa="peak_Pa")
    return rounded(out.select("recording_id", "band", "level", "geometric_dB", "absorption_dB", "normalised_dB", "refusal"))


@query(f"""WITH {B.RECORDINGS_SQL} SELECT recording_id,
 CASE WHEN mic_distance_m IS NULL THEN 'distance was not recorded' END AS refusal,
 {r("20 * log10(mic_distance_m / 2)", "geometric_dB", 9)}, {r("level + 20 * log10(mic_distance_m / 2)", "normalised_dB", 9)},
 false AS absorption_applied FROM recordings""")
def normalise_peak(spark, sf):
    out = A.normalise_peak(B.recordings(spark, sf), 2.0)
    return rounded(out.select("recording_id", "refusal", "geometric_dB", "normalised_dB", "absorption_applied"), 9)


def _shift(tc="tc", rh="rh", kpa="kpa"):
    e = ABSORPTION_SQL.replace("(tc +", "(\0t +").replace("(rh *", "(\0h *").replace("(kpa /", "(\0p /")
    return e.replace("\0t", tc).replace("\0h", rh).replace("\0p", kpa)


def _worse(low, high):
    a, b = f"(({low} - {ABSORPTION_SQL}) * d)", f"(({high} - {ABSORPTION_SQL}) * d)"
    return f"CASE WHEN abs({a}) >= abs({b}) THEN {a} ELSE {b} END"


EFFECT_SQL = f"""{B.RECORDINGS_SQL}, a AS (SELECT recording_id, {AIR_SQL}, CASE WHEN mic_distance_m > 0 THEN mic_distance_m END AS d, {OCT_SQL} AS f FROM recordings),
effect AS (SELECT recording_id, f, {ABSORPTION_SQL} * d AS absorption_dB,
  {_worse(_shift(tc="(tc - 5)"), _shift(tc="(tc + 5)"))} AS temperature_sensitivity_dB,
  {_worse(_shift(rh="greatest(0, rh - 20)"), _shift(rh="least(100, rh + 20)"))} AS humidity_sensitivity_dB,
  {_worse(_shift(kpa="greatest(1, kpa - 2)"), _shift(kpa="(kpa + 2)"))} AS pressure_sensitivity_dB FROM a)"""
EFFECT_COLS = ["absorption_dB", "temperature_sensitivity_dB", "humidity_sensitivity_dB", "pressure_sensitivity_dB"]


@query(f"""WITH {EFFECT_SQL} SELECT recording_id, f AS "band_Hz", CASE WHEN absorption_dB IS NULL THEN 'no distance to the source' END AS refusal, {rs(*EFFECT_COLS, digits=9)} FROM effect""")
def atmospheric_effect(spark, sf):
    out = A.atmospheric_effect(B.recordings(spark, sf), OCTAVES)
    return rounded(out.select("recording_id", "band_Hz", "refusal", *EFFECT_COLS), 9)


@query(f"""WITH {EFFECT_SQL} SELECT recording_id, {r("max(absorption_dB)", "worst_absorption_dB", 9)},
 arg_max(f, absorption_dB) AS "worst_band_Hz", {r("max(greatest(abs(temperature_sensitivity_dB), abs(humidity_sensitivity_dB), abs(pressure_sensitivity_dB)))", "largest_sensitivity_dB", 9)},
 max(absorption_dB) >= 0.5::DOUBLE AS matters FROM effect GROUP BY 1""")
def worst_atmospheric_effect(spark, sf):
    return rounded(A.worst_effect(A.atmospheric_effect(B.recordings(spark, sf), OCTAVES), ["recording_id"]), 9)


@query(f"""WITH {B.RECORDINGS_SQL}, first_ref AS (SELECT session_id, min(recording_id) AS rid FROM recordings
  WHERE configuration = 'unsuppressed' GROUP BY 1),
lv AS (SELECT l_orderkey AS recording_id, l_linenumber AS band, {em("l_quantity")} AS level FROM lineitem GROUP BY 1, 2),
n AS (SELECT lv.*, 62.5::DOUBLE * power(2.0::DOUBLE, band) AS f, mic_distance_m AS d, {AIR_SQL}, session_id, configuration FROM lv JOIN recordings USING (recording_id)),
m AS (SELECT *, CASE WHEN d IS NULL THEN 'distance was not recorded' WHEN d <= 0 THEN 'distance must be positive' END AS no,
  level + 20 * log10(d) + {ABSORPTION_SQL} * (d - 1) AS norm FROM n),
j AS (SELECT t.session_id, t.recording_id AS test_recording_id, f.recording_id AS ref_recording_id, t.f, f.level - t.level AS raw, f.norm - t.norm AS loss,
  coalesce('reference: ' || f.no, 'test: ' || t.no) AS refusal
  FROM m t JOIN first_ref USING (session_id) JOIN m f ON f.recording_id = rid AND f.band = t.band WHERE t.configuration = 'suppressed')
SELECT session_id, test_recording_id, ref_recording_id, f AS "band_Hz", {r("raw", "raw_loss_dB")}, {r("loss", "loss_dB")}, {r("loss - raw", "shift_dB")}, refusal FROM j""")
def normalised_insertion_loss(spark, sf):
    recs = B.recordings(spark, sf)
    keys = ["session_id", "test_recording_id", "ref_recording_id"]
    pairs = P.designated_pairs(recs, "session_id", "recording_id").select(*keys)
    lines = B.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("recording_id"), F.col("l_linenumber").alias("band"), F.col("l_quantity").alias("level"))
    means = S.band_stats(lines, ["recording_id"]).select(
        "recording_id", (F.lit(62.5) * F.pow(F.lit(2.0), F.col("band"))).alias("band_Hz"), F.col("mean").alias("level"))
    spectra = means.join(recs.select("recording_id", "mic_distance_m", *air.DEFAULT_AIR), "recording_id")

    def side(name):
        return pairs.join(spectra.withColumnRenamed("recording_id", f"{name}_recording_id"), f"{name}_recording_id")

    return rounded(A.normalised_insertion_loss(side("ref"), side("test"), keys))


_DELAY = """CASE WHEN v > c AND y > 0 AND x - y * tan(mu) >= 0 THEN sqrt(x * x + y * y) / c - ((x - y * tan(mu)) / v + y / cos(mu) / c) END"""


@query(f"""WITH {B.RECORDINGS_SQL}, a AS (SELECT recording_id, (250 + recording_id % 700)::DOUBLE AS v, mic_distance_m AS d,
  radians((recording_id % 60)::DOUBLE) AS th, 343.2::DOUBLE * sqrt((coalesce("temperature_C", 20) + 273.15::DOUBLE) / 293.15::DOUBLE) AS c FROM recordings),
g AS (SELECT *, d * cos(th) AS x, abs(d * sin(th)) AS y, CASE WHEN v > c THEN asin(c / v) END AS mu FROM a)
SELECT recording_id, {r(_DELAY, "crack_delay_s", 9)} FROM g""")
def crack_blast_delay(spark, sf):
    k = F.col("recording_id")
    recs = B.recordings(spark, sf).withColumn("velocity_mps", (250 + k % 700).cast("double")).withColumn(
        "mic_angle_deg", (k % 60).cast("double"))
    return rounded(A.crack_blast_delay(recs).select("recording_id", "crack_delay_s"), 9)


@query(f"""WITH {B.MICS_SQL} SELECT array_id, channel, {r("(distance_m - min(distance_m) OVER (PARTITION BY array_id)) / 343.2::DOUBLE", "delay_s", 9)} FROM mics""")
def array_delays(spark, sf):
    return rounded(A.array_delays(B.microphones(spark, sf), ["array_id"]).select("array_id", "channel", "delay_s"), 9)


ARRAY_SQL = f"""{B.MICS_SQL}, z AS (SELECT *, level + 20 * log10(distance_m) AS norm FROM mics),
g AS (SELECT array_id, median(norm) AS med, count(*) AS n_channels, max(norm) - min(norm) AS spread FROM z GROUP BY 1),
c AS (SELECT z.*, n_channels, n_channels >= 2 AS enough, spread, norm - med AS dev FROM z JOIN g USING (array_id))"""


@query(f"""WITH {ARRAY_SQL} SELECT array_id, channel, n_channels, {r("norm", "normalised_dB")},
 {r("CASE WHEN enough THEN spread END", "spread_dB")}, {r("CASE WHEN enough THEN dev END", "deviation_dB")},
 CASE WHEN enough THEN abs(dev) <= 0.5::DOUBLE END AS agrees, n_channels = 2 AS two_channels_only,
 CASE WHEN NOT enough THEN 'fewer than two channels' END AS refusal FROM c""")
def array_consistency(spark, sf):
    return rounded(A.array_consistency(B.microphones(spark, sf), ["array_id"]).drop("level", "distance_m"))


@query(f"""WITH {ARRAY_SQL} SELECT array_id, max(n_channels) AS n_channels, {r("max(CASE WHEN enough THEN spread END)", "spread_dB")},
 coalesce(bool_and(CASE WHEN enough THEN abs(dev) <= 0.5::DOUBLE END), false) AS consistent,
 max(CASE WHEN NOT enough THEN 'fewer than two channels' END) AS refusal FROM c GROUP BY 1""")
def array_verdict(spark, sf):
    return rounded(A.array_verdict(A.array_consistency(B.microphones(spark, sf), ["array_id"]), ["array_id"]))


MISSING_SQL = "list_filter([" + ", ".join(
    f"""CASE WHEN "{c}" IS NULL OR trim("{c}"::VARCHAR) = '' THEN '{c}' END""" for c in Q.REQUIRED) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH {B.RECORDINGS_SQL} SELECT recording_id, {MISSING_SQL} AS missing, len({MISSING_SQL}) = 0 AS defensible FROM recordings""")
def missing_required(spark, sf):
    return Q.completeness(B.recordings(spark, sf), ["recording_id"])


UNRECORDED_SQL = "array_to_string(list_filter([" + ", ".join(
    f"""CASE WHEN "{c}" IS NULL THEN '{c}' END""" for c in Q.AFFECTS_LEVEL) + "], lambda x: x IS NOT NULL), ', ')"


@query(f"""WITH {B.RECORDINGS_SQL}, m AS (SELECT * REPLACE (CASE WHEN recording_id % 50 = 0 THEN 'other' ELSE configuration END AS configuration,
  CASE WHEN recording_id % 70 = 1 THEN -1 ELSE mic_distance_m END AS mic_distance_m,
  CASE WHEN recording_id % 90 = 1 THEN 120 ELSE humidity_pct END AS humidity_pct) FROM recordings)
SELECT recording_id, 'calibration_drift' AS code, NULL AS detail FROM m WHERE abs("calibration_post_dB" - "calibration_pre_dB") > 0.5::DOUBLE
UNION ALL SELECT recording_id, 'configuration_unknown', configuration FROM m WHERE configuration NOT IN ('suppressed', 'unsuppressed')
UNION ALL SELECT recording_id, 'distance_invalid', NULL FROM m WHERE mic_distance_m <= 0
UNION ALL SELECT recording_id, 'humidity_invalid', NULL FROM m WHERE humidity_pct NOT BETWEEN 0 AND 100
UNION ALL SELECT recording_id, 'level_conditions_missing', {UNRECORDED_SQL} FROM m WHERE {UNRECORDED_SQL} <> ''""")
def metadata_warnings(spark, sf):
    k = F.col("recording_id")
    recs = B.recordings(spark, sf).withColumns({
        "configuration": F.when(k % 50 == 0, "other").otherwise(F.col("configuration")),
        "mic_distance_m": F.when(k % 70 == 1, -1.0).otherwise(F.col("mic_distance_m")),
        "humidity_pct": F.when(k % 90 == 1, 120.0).otherwise(F.col("humidity_pct"))})
    return Q.metadata_warnings(recs, ["recording_id"])


RECORD_SQL = f"""{B.RECORDINGS_SQL}, rec AS (SELECT *, recording_id AS k, recording_id % 11 <> 0 AS calibrated, (recording_id % 9) * 0.1::DOUBLE AS res,
  recording_id % 37 = 0 AS is_clipped, CASE WHEN recording_id % 16 > 0 THEN (recording_id % 16)::DOUBLE - 0.5::DOUBLE END AS head,
  CASE WHEN recording_id % 40 > 0 THEN (recording_id % 40)::DOUBLE + 5 END AS snr, {MISSING_SQL} AS missing FROM recordings),
checks AS (
 SELECT k, 'Calibration' AS c, CASE WHEN calibrated THEN 'ok' ELSE 'fail' END AS s FROM rec
 UNION ALL SELECT k, 'Calibration stability', CASE WHEN abs("calibration_post_dB" - "calibration_pre_dB") > 0.5::DOUBLE THEN 'fail'
   WHEN "calibration_post_dB" - "calibration_pre_dB" IS NOT NULL THEN 'ok' WHEN calibrated THEN 'warn' END FROM rec
 UNION ALL SELECT k, 'Calibrator residual', CASE WHEN abs(res) > 0.5::DOUBLE THEN 'warn' END FROM rec
 UNION ALL SELECT k, 'Clipping', CASE WHEN is_clipped OR k % 41 = 0 THEN 'fail' ELSE 'ok' END FROM rec
 UNION ALL SELECT k, 'Headroom', CASE WHEN head < 1 THEN 'fail' WHEN head < 6 THEN 'warn' WHEN head IS NOT NULL THEN 'ok' ELSE 'warn' END FROM rec
 UNION ALL SELECT k, 'Signal-to-noise', CASE WHEN snr < 10 THEN 'fail' WHEN snr < 20 THEN 'warn' WHEN snr IS NOT NULL THEN 'ok' ELSE 'warn' END FROM rec
 UNION ALL SELECT k, 'Sample rate', CASE WHEN k % 43 = 0 THEN 'fail' WHEN k % 6 = 0 THEN 'warn' ELSE 'ok' END FROM rec
 UNION ALL SELECT k, 'Shot detection', CASE WHEN k % 3 = 0 THEN 'warn' ELSE 'ok' END FROM rec
 UNION ALL SELECT k, 'Detection settings', CASE WHEN k % 2 = 0 THEN 'ok' WHEN k % 4 = 1 THEN 'warn' WHEN k % 8 = 3 THEN 'warn' END FROM rec
 UNION ALL SELECT k, 'Repeated delay', CASE WHEN k % 19 = 0 THEN 'warn' END FROM rec
 UNION ALL SELECT k, 'Rounds expected', CASE WHEN k % 23 = 0 THEN 'warn' END FROM rec
 UNION ALL SELECT k, 'Measured shots', CASE WHEN n_valid = 0 THEN 'fail' WHEN n_valid < n_shots THEN 'warn' END FROM rec
 UNION ALL SELECT k, 'Measurement record', CASE WHEN len(missing) = 0 THEN 'ok' ELSE 'warn' END FROM rec
 UNION ALL SELECT k, 'Signal quality', 'fail' FROM rec WHERE is_clipped
 UNION ALL SELECT k, 'Signal quality', 'warn' FROM rec WHERE snr < 20)"""


def run_records(spark, sf):
    k = F.col("recording_id")
    no = F.array().cast("array<string>")
    recs = B.recordings(spark, sf).withColumns({
        "calibrated": k % 11 != 0, "residual_dB": (k % 9) * 0.1, "is_clipped": k % 37 == 0,
        "n_clipped_shots": (k % 41 == 0).cast("int"), "headroom_dB": F.when(k % 16 > 0, (k % 16) - 0.5),
        "snr_dB": F.when(k % 40 > 0, (k % 40).cast("double") + 5), "sample_rate_adequate": k % 43 != 0,
        "n_unresolved_rise": (k % 6 == 0).cast("int"), "n_detected": F.lit(1),
        "n_detection_warnings": (k % 3 == 0).cast("int"), "tuning_applied": k % 2 == 0, "auto_detect": k % 4 != 1,
        "tuning_reason": F.when(k % 8 == 3, "no stable count"), "reflection_detected": k % 19 == 0,
        "expectation_met": F.when(k % 23 == 0, False)})
    return recs.withColumns({
        "errors": F.when(F.col("is_clipped"), F.array(F.lit("clipped"))).otherwise(no),
        "quality_warnings": F.when(F.col("snr_dB") < 20, F.array(F.lit("low snr"))).otherwise(no)})


@query(f"""WITH {RECORD_SQL} SELECT k AS recording_id, c AS "check", s AS status FROM checks WHERE s IS NOT NULL""")
def validity_checks(spark, sf):
    return Q.validity_checks(run_records(spark, sf), ["recording_id"])


@query(f"""WITH {RECORD_SQL} SELECT k AS recording_id, count(*) FILTER (WHERE s = 'fail')::INT AS n_fail, count(*) FILTER (WHERE s = 'warn')::INT AS n_warn,
 list_sort(coalesce(list(DISTINCT c) FILTER (WHERE s = 'fail'), [])) AS blocking,
 CASE WHEN count(*) FILTER (WHERE s = 'fail') > 0 THEN 'invalid' WHEN count(*) FILTER (WHERE s = 'warn') > 0 THEN 'qualified' ELSE 'valid' END AS verdict
 FROM checks GROUP BY 1""")
def validity_verdict(spark, sf):
    return Q.validity_verdict(run_records(spark, sf), ["recording_id"])
