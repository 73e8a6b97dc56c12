"""What the air and the geometry did to levels, and taking it back out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from percussa.functions import air
from percussa.functions import levels as L
from percussa.operators.ordered import percentiles

BAND_CENTRES = [50.0, 63.0, 80.0, 100.0, 125.0, 160.0, 200.0, 250.0, 315.0, 400.0, 500.0, 630.0, 800.0, 1000.0,
                1250.0, 1600.0, 2000.0, 2500.0, 3150.0, 4000.0, 5000.0, 6300.0, 8000.0, 10000.0]
STEPS = {"temperature_C": 5.0, "humidity_pct": 20.0, "pressure_kPa": 2.0}
ARRAY_TOLERANCE_DB = 0.5


def with_air(recordings: DataFrame) -> DataFrame:
    """Weather with standard values where none was recorded, listed in `defaulted`."""
    out = recordings.withColumn("defaulted", F.array_compact(F.array(*[
        F.when(F.col(c).isNull(), c) for c in air.DEFAULT_AIR])))
    return out.withColumns({c: F.coalesce(L.finite(c), F.lit(v)) for c, v in air.DEFAULT_AIR.items()})


def air_terms() -> Column:
    return air.terms(F.col("temperature_C"), F.col("humidity_pct"), F.col("pressure_kPa"))


def range_warnings() -> Column:
    return F.array_compact(F.array(*[
        F.when(~F.col(c).between(lo, hi), f"{c} outside the standard's range")
        for c, (lo, hi) in air.RANGES.items()]))


def absorption(recordings: DataFrame, centres: list[float] | None = None) -> DataFrame:
    """Attenuation of every recording in every band; bands are added inside the row."""
    centres = centres or BAND_CENTRES
    bands = F.explode(F.array(*[F.lit(float(c)) for c in centres]))
    rows = with_air(recordings).withColumn("_air", air_terms()).withColumn("band_Hz", bands)
    return rows.withColumn("alpha_dB_per_m", air.alpha(F.col("band_Hz"), F.col("_air"))).drop("_air")


def _refusal(distance: Column, reference: float, peak_pa: Column | None, allow_nonlinear: bool) -> Column:
    refusal = (F.when(distance.isNull(), "distance was not recorded").when(distance <= 0, "distance must be positive")
               .when(F.lit(reference <= 0), "reference distance must be positive"))
    if peak_pa is not None and not allow_nonlinear:
        refusal = refusal.when(air.is_nonlinear(peak_pa), "propagation was not linear")
    return refusal


def normalise_bands(bands: DataFrame, reference_m: float = 1.0, level: str = "level", peak_pa: str | None = None,
                    allow_nonlinear: bool = False) -> DataFrame:
    """Band levels referred to another distance, each band with its own absorption.

    Takes rows with band_Hz, level, mic_distance_m and the weather. Refused rows
    carry no level.
    """
    rows = with_air(bands)
    d = F.col("mic_distance_m")
    peak = None if peak_pa is None else F.col(peak_pa)
    rows = rows.withColumn("refusal", _refusal(d, reference_m, peak, allow_nonlinear))
    ok = F.col("refusal").isNull()
    rows = rows.withColumn("geometric_dB", F.when(ok, air.spreading(d, F.lit(reference_m))))
    rows = rows.withColumn("absorption_dB", F.when(ok, air.alpha(F.col("band_Hz"), air_terms()) * (d - reference_m)))
    warnings = F.concat(range_warnings(), F.array_compact(F.array(
        F.when(~F.col("band_Hz").between(*air.BAND_RANGE_HZ), "band outside the standard's range"),
        F.lit(None) if peak is None or not allow_nonlinear else F.when(air.is_nonlinear(peak), "propagation was not linear"))))
    return rows.withColumn("normalised_dB", F.col(level) + F.col("geometric_dB") + F.col("absorption_dB")).withColumn(
        "warnings", F.when(ok, warnings))


def normalise_peak(peaks: DataFrame, reference_m: float = 1.0, level: str = "level", peak_pa: str | None = None,
                   allow_nonlinear: bool = False) -> DataFrame:
    """Broadband level referred to another distance by spreading only."""
    d = F.col("mic_distance_m")
    peak = None if peak_pa is None else F.col(peak_pa)
    out = peaks.withColumn("refusal", _refusal(d, reference_m, peak, allow_nonlinear))
    out = out.withColumn("geometric_dB", F.when(F.col("refusal").isNull(), air.spreading(d, F.lit(reference_m))))
    return out.withColumn("normalised_dB", F.col(level) + F.col("geometric_dB")).withColumn(
        "absorption_applied", F.lit(False))


def atmospheric_effect(recordings: DataFrame, centres: list[float] | None = None) -> DataFrame:
    """Absorption over the path per band and how far a wrong reading would move it.

    A recording without a positive distance keeps its rows, with a refusal and no figures.
    """
    d = F.col("mic_distance_m")
    t, h, p = F.col("temperature_C"), F.col("humidity_pct"), F.col("pressure_kPa")
    shifted = {
        "temperature": ((t - STEPS["temperature_C"], h, p), (t + STEPS["temperature_C"], h, p)),
        "humidity": ((t, F.greatest(F.lit(0.0), h - STEPS["humidity_pct"]), p),
                     (t, F.least(F.lit(100.0), h + STEPS["humidity_pct"]), p)),
        "pressure": ((t, h, F.greatest(F.lit(1.0), p - STEPS["pressure_kPa"])), (t, h, p + STEPS["pressure_kPa"])),
    }
    # Seven sets of weather per recording, before it is multiplied by the bands.
    sets = {"_base": air_terms()}
    for name, pair in shifted.items():
        sets[f"_{name}_low"], sets[f"_{name}_high"] = (air.terms(*c) for c in pair)
    centres = centres or BAND_CENTRES
    rows = with_air(recordings).withColumn("refusal", F.when(F.coalesce(d > 0, F.lit(False)), F.lit(None).cast("string")).otherwise(
        "no distance to the source")).withColumns(sets).withColumn(
        "band_Hz", F.explode(F.array(*[F.lit(float(c)) for c in centres])))
    f = F.col("band_Hz")
    rows = rows.withColumns({c: air.alpha(f, F.col(c)) for c in sets})
    base = F.col("_base")
    d = F.when(d > 0, d)
    out = {"alpha_dB_per_m": base, "absorption_dB": base * d}
    for name in shifted:
        low, high = (F.col(f"_{name}_{end}") - base for end in ("low", "high"))
        out[f"{name}_sensitivity_dB"] = F.when(F.abs(low) >= F.abs(high), low).otherwise(high) * d
    return rows.withColumns(out).drop(*sets)


def worst_effect(effect: DataFrame, keys: list[str]) -> DataFrame:
    """Worst band, worst absorption and largest sensitivity of every recording."""
    sensitivity = F.greatest(*[F.abs(f"{n}_sensitivity_dB") for n in ("temperature", "humidity", "pressure")])
    g = effect.groupBy(*keys).agg(
        F.max("absorption_dB").alias("worst_absorption_dB"),
        F.max_by("band_Hz", F.when(F.col("absorption_dB").isNotNull(), F.struct("absorption_dB", -F.col("band_Hz")))).alias("worst_band_Hz"),
        F.max(sensitivity).alias("largest_sensitivity_dB"))
    return g.withColumn("matters", F.col("worst_absorption_dB") >= 0.5)


def normalised_insertion_loss(ref: DataFrame, test: DataFrame, on: list[str], reference_m: float = 1.0) -> DataFrame:
    """Difference of two band tables, each referred to a common distance in its own air."""

    def one(df, side):
        n = normalise_bands(df, reference_m)
        return n.select(*on, "band_Hz", F.col("level").alias(f"_{side}_raw"),
                        F.col("normalised_dB").alias(f"_{side}"), F.col("refusal").alias(f"_{side}_no"))

    j = one(ref, "ref").join(one(test, "test"), [*on, "band_Hz"])
    refusal = F.coalesce(F.concat(F.lit("reference: "), F.col("_ref_no")), F.concat(F.lit("test: "), F.col("_test_no")))
    loss, raw = F.col("_ref") - F.col("_test"), F.col("_ref_raw") - F.col("_test_raw")
    return j.select(*on, "band_Hz", raw.alias("raw_loss_dB"), loss.alias("loss_dB"),
                    (loss - raw).alias("shift_dB"), refusal.alias("refusal"))


def array_delays(mics: DataFrame, array: list[str], temperature_C: float = 20.0) -> DataFrame:
    """Arrival delay of every channel behind the nearest of its array."""
    nearest = mics.groupBy(*array).agg(F.min("distance_m").alias("_near"))
    c = air.sound_speed(F.lit(temperature_C))
    return mics.join(nearest, array).withColumn("delay_s", (F.col("distance_m") - F.col("_near")) / c).drop("_near")


def array_consistency(mics: DataFrame, array: list[str], reference_m: float = 1.0,
                      tolerance_dB: float = ARRAY_TOLERANCE_DB, limit: int | None = None) -> DataFrame:
    """Channels of an array referred to one distance, against their median."""
    rows = mics.where(L.finite("level").isNotNull() & (F.col("distance_m") > 0)).withColumn(
        "normalised_dB", F.col("level") + air.spreading(F.col("distance_m"), F.lit(reference_m)))
    n = F.col("normalised_dB")
    center = percentiles(rows, array, "normalised_dB", {"_median": 0.5}, [
        F.count("*").alias("n_channels"), (F.max(n) - F.min(n)).alias("spread_dB"),
        F.max("distance_m").alias("_far"), F.min("distance_m").alias("_close")], limit)
    dev = n - F.col("_median")
    out = rows.join(center, array).withColumn("deviation_dB", dev)
    enough = F.col("n_channels") >= 2
    return out.select(
        *mics.columns, "n_channels", "normalised_dB", F.when(enough, F.col("spread_dB")).alias("spread_dB"),
        F.when(enough, F.col("deviation_dB")).alias("deviation_dB"),
        F.when(enough, F.abs("deviation_dB") <= tolerance_dB).alias("agrees"),
        (F.col("n_channels") == 2).alias("two_channels_only"),
        F.when(~enough, "fewer than two channels").alias("refusal"))


def array_verdict(agreement: DataFrame, array: list[str]) -> DataFrame:
    """Whether all channels of an array agree."""
    return agreement.groupBy(*array).agg(
        F.max("n_channels").alias("n_channels"), F.max("spread_dB").alias("spread_dB"),
        F.coalesce(F.bool_and("agrees"), F.lit(False)).alias("consistent"),
        F.max("refusal").alias("refusal"))


def crack_blast_delay(recordings: DataFrame) -> DataFrame:
    """Crack lead of every recording with a muzzle velocity; NULL where no crack can arrive."""
    return recordings.withColumn("crack_delay_s", air.crack_delay(
        F.col("mic_distance_m"), F.col("mic_angle_deg"), F.col("velocity_mps"),
        F.coalesce(F.col("temperature_C"), F.lit(20.0))))
