"""Whether a record is complete and whether a measurement may be reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed lists of metadata fields.
REQUIRED = ["operator", "date", "weapon", "ammunition", "configuration", "mic_model", "mic_distance_m",
            "mic_angle_deg", "temperature_C", "humidity_pct", "pressure_kPa"]
AFFECTS_LEVEL = ["mic_distance_m", "mic_angle_deg", "mic_height_m", "temperature_C", "humidity_pct",
                 "pressure_kPa", "wind_mps"]
STATUS_RANK = {"ok": 0, "warn": 1, "fail": 2}


def missing_required() -> Column:
    """Names of required fields that are NULL or blank."""
    return F.array_compact(F.array(*[
        F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), c) for c in REQUIRED]))


def completeness(recordings: DataFrame, keys: list[str]) -> DataFrame:
    return recordings.select(*keys, missing_required().alias("missing")).withColumn("defensible", F.size("missing") == 0)


def calibration_drift() -> Column:
    return F.col("calibration_post_dB") - F.col("calibration_pre_dB")


def metadata_warnings(recordings: DataFrame, keys: list[str]) -> DataFrame:
    """One row per condition that undermines a record."""
    config = F.lower(F.trim(F.col("configuration")))
    unrecorded = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in AFFECTS_LEVEL]))

    def rule(when: Column, code: str, detail: Column | None = None) -> Column:
        return F.when(when, F.struct(F.lit(code).alias("code"),
                                     (F.lit(None) if detail is None else detail).cast("string").alias("detail")))

    found = F.array_compact(F.array(
        rule(F.abs(calibration_drift()) > 0.5, "calibration_drift"),
        rule((config != "") & ~config.isin("suppressed", "unsuppressed"), "configuration_unknown", config),
        rule(F.col("mic_distance_m") <= 0, "distance_invalid"),
        rule(~F.col("humidity_pct").between(0, 100), "humidity_invalid"),
        rule(F.size(unrecorded) > 0, "level_conditions_missing", F.concat_ws(", ", unrecorded))))
    return recordings.select(*keys, F.inline(found))


def _check(name: str, status: Column) -> Column:
    return F.when(status.isNotNull(), F.struct(F.lit(name).alias("check"), status.alias("status")))


def check_array() -> Column:
    """Every check of a record with its status, as one array inside the row.

    Takes one row per record with calibrated, calibration_pre_dB and
    calibration_post_dB, residual_dB, is_clipped, n_clipped_shots, headroom_dB,
    snr_dB, sample_rate_adequate, n_unresolved_rise, n_detected,
    n_detection_warnings, tuning_applied, auto_detect, tuning_reason,
    reflection_detected, expectation_met, n_shots, n_valid, the required
    metadata, and the arrays errors and quality_warnings.
    """
    c = F.col
    calibrated = F.coalesce(c("calibrated"), F.lit(False))
    drift = calibration_drift()
    checks = F.array(
        _check("Calibration", F.when(calibrated, "ok").otherwise("fail")),
        _check("Calibration stability", F.when(F.abs(drift) > 0.5, "fail").when(drift.isNotNull(), "ok")
               .when(calibrated, "warn")),
        _check("Calibrator residual", F.when(F.abs(c("residual_dB")) > 0.5, "warn")),
        _check("Clipping", F.when(c("is_clipped") | (c("n_clipped_shots") > 0), "fail").otherwise("ok")),
        _check("Headroom", F.when(c("headroom_dB") < 1, "fail").when(c("headroom_dB") < 6, "warn")
               .when(c("headroom_dB").isNotNull(), "ok").otherwise("warn")),
        _check("Signal-to-noise", F.when(c("snr_dB") < 10, "fail").when(c("snr_dB") < 20, "warn")
               .when(c("snr_dB").isNotNull(), "ok").otherwise("warn")),
        _check("Sample rate", F.when(~c("sample_rate_adequate"), "fail").when(c("n_unresolved_rise") > 0, "warn")
               .otherwise("ok")),
        _check("Shot detection", F.when(c("n_detected").isNotNull() & (c("n_detection_warnings") > 0), "warn")
               .when(c("n_detected").isNotNull(), "ok")),
        _check("Detection settings", F.when(c("tuning_applied"), "ok").when(~c("auto_detect"), "warn")
               .when(c("tuning_reason").isNotNull(), "warn")),
        _check("Repeated delay", F.when(c("reflection_detected"), "warn")),
        _check("Rounds expected", F.when(~c("expectation_met"), "warn")),
        _check("Measured shots", F.when(c("n_valid") == 0, "fail").when(c("n_valid") < c("n_shots"), "warn")),
        _check("Measurement record", F.when(F.size(missing_required()) == 0, "ok").otherwise("warn")),
    )

    def listed(column, status):
        return F.transform(F.coalesce(c(column), F.array().cast("array<string>")),
                           lambda x: F.struct(F.lit("Signal quality").alias("check"), F.lit(status).alias("status")))

    return F.concat(F.array_compact(checks), listed("errors", "fail"), listed("quality_warnings", "warn"))


def validity_checks(records: DataFrame, keys: list[str]) -> DataFrame:
    """One row per check of every record; see `check_array` for the columns taken."""
    return records.select(*keys, F.inline(check_array()))


def validity_verdict(records: DataFrame, keys: list[str]) -> DataFrame:
    """invalid on any failed check or without a shot, qualified on any warning, else valid."""
    checks = records.select(*keys, check_array().alias("_c"))
    failed = F.filter("_c", lambda x: x["status"] == "fail")
    warned = F.filter("_c", lambda x: x["status"] == "warn")
    return checks.select(
        *keys, F.size(failed).alias("n_fail"), F.size(warned).alias("n_warn"),
        F.array_sort(F.array_distinct(F.transform(failed, lambda x: x["check"]))).alias("blocking"),
        F.when(F.size(failed) > 0, "invalid").when(F.size(warned) > 0, "qualified").otherwise("valid").alias("verdict"))
