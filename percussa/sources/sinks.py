"""Tables written for readers: shot metrics, insertion loss, curves, records, spectrograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from percussa.functions import levels as L
from percussa.operators.ordered import numbered

# Fixed list: columns of the per-shot table, with the metric behind each.
SHOT_COLUMNS = {
    "shot_number": "shot_number", "time": "time_s", "valid": "valid", "clipped": "clipped",
    "window_truncated": "window_truncated", "rise_time_resolved": "rise_time_resolved",
    "window_duration": "duration_ms", "integration_window": "integration_ms", "Lpeak_Z": "Lpeak_Z", "Lpeak_A": "Lpeak_A",
    "Lpeak_C": "Lpeak_C", "LZE": "LZE", "LAE": "LAE", "LCE": "LCE", "LZFmax": "LZFmax", "LZSmax": "LZSmax",
    "LAFmax": "LAFmax", "LASmax": "LASmax", "LAImax": "LAImax", "LZImax": "LZImax", "rise_time": "rise_time_us",
    "a_duration": "a_duration_ms", "b_duration": "b_duration_ms", "specific_impulse": "specific_impulse_Pa_s",
    "peak_overpressure": "peak_overpressure_Pa", "crest_factor": "crest_factor_dB",
    "spectral_centroid": "spectral_centroid_Hz", "kurtosis": "kurtosis", "noise_floor": "noise_floor_dB",
    "snr": "snr_dB", "notes": "notes"}


def _off_the_tie(v: Column) -> Column:
    """`v`, moved off a tie of two decimals to the side its binary value lies on; an exact tie goes to the even digit.

    The formatter rounds the shortest decimal text of a number half up, so 7.625 (exact) and 2.675 (a little less in
    binary) would both go up. What is left of 1000 v beyond its nearest whole number tells which side is meant.
    """
    a = F.abs(v)
    whole = F.rint(a * 1000.0)
    upper = a * 134217729.0 - (a * 134217729.0 - a)
    lost = (upper * 1000.0 - whole) + (a - upper) * 1000.0
    even = F.floor(whole / 10) % 2 == 0
    down = (lost < 0) | ((lost == 0) & even)
    tie = (a < 1e9) & (F.abs(lost) <= a * 1e-12) & (whole % 10 == 5)
    return F.when(tie, F.signum(v) * (a + F.when(down, -0.001).otherwise(0.001))).otherwise(v)


def number_text(value) -> Column:
    """Two decimals; six significant digits below 1; empty where not finite."""
    v = L.finite(value)
    a = F.abs(v)
    text = F.format_string("%.2f", _off_the_tie(v))
    small = F.format_string("%.5e", v)
    # 1e-4 and above is written plainly, with the decimals its size needs.
    for power in (-4, -3, -2, -1):
        small = F.when(F.round(a, 5 - power) >= 10.0**power, F.format_string(f"%.{5 - power}f", v)).otherwise(small)
    small = F.regexp_replace(F.regexp_replace(small, r"(\.\d*?)0+($|e)", "$1$2"), r"\.($|e)", "$1")
    return F.when(v.isNull(), "").when((v != 0) & (a < 1), small).otherwise(text)


def shot_table(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """The per-shot table as text columns, in its fixed order; a metric that is missing is an error."""
    made = {"duration_ms": ("duration_s", 1000.0), "integration_ms": ("integration_window_s", 1000.0)}
    for name, (source, factor) in made.items():
        if name not in metrics.columns and source in metrics.columns:
            metrics = metrics.withColumn(name, F.col(source) * factor)
    kinds = dict(metrics.dtypes)
    missing = [source for source in SHOT_COLUMNS.values() if source not in kinds]
    if missing:
        raise ValueError(f"the shot table needs the columns {', '.join(missing)}")
    out = []
    for name, source in SHOT_COLUMNS.items():
        kind = kinds[source]
        if kind == "boolean":
            col = F.when(F.col(source), "true").otherwise("false")
        elif kind.startswith("array"):
            col = F.concat_ws("; ", source)
        elif source == "time_s":
            col = F.coalesce(F.format_string("%.5f", F.col(source)), F.lit(""))
        elif kind in ("double", "float"):
            col = number_text(source)
        else:
            col = F.coalesce(F.col(source).cast("string"), F.lit(""))
        out.append(col.alias(name))
    return metrics.select(*keys, *out)


def write_shot_metrics(metrics: DataFrame, run_info: DataFrame, keys: list[str], path: str) -> None:
    """CSV table next to the facts of the run that made it."""
    shot_table(metrics, keys).write.mode("overwrite").csv(f"{path}/shots", header=True)
    run_info.write.mode("overwrite").csv(f"{path}/run_info", header=True)


def write_insertion_loss(losses: DataFrame, band_losses: DataFrame, path: str) -> None:
    losses.write.mode("overwrite").csv(f"{path}/metrics", header=True)
    band_losses.write.mode("overwrite").csv(f"{path}/bands", header=True)


def write_level_curves(curves: DataFrame, path: str) -> None:
    """Long level histories, non-finite as NULL; sorted so that row groups prune by recording."""
    out = curves.withColumn("level", L.finite("level"))
    out.sortWithinPartitions("recording_id").write.mode("overwrite").parquet(path)


def run_record(runs: DataFrame, shots: DataFrame, stats: DataFrame, keys: list[str], order: list[str],
               page: int = 10_000) -> DataFrame:
    """Nested documents of a run: its facts, statistics and shots.

    Shots come in pages of at most `page`, one document per page, so that a run
    of any length stays a set of small documents. Statistics are one entry per
    metric and stand in every page.
    """
    kinds = {**dict(shots.dtypes), **dict(stats.dtypes)}

    def clean(df: DataFrame) -> DataFrame:
        return df.select(*[L.finite(c).alias(c) if kinds[c] == "double" and c not in keys else F.col(c) for c in df.columns])

    numbers = numbered(clean(shots), keys, order, "_rn").withColumn("page", F.floor((F.col("_rn") - 1) / page))
    fields = [c for c in shots.columns if c not in keys]
    paged = numbers.groupBy(*keys, "page").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", F.struct(*fields).alias("s")))), lambda x: x["s"]).alias("shots"))
    entries = [c for c in stats.columns if c not in keys]
    summary = clean(stats).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*entries))).alias("statistics"))
    out = runs.join(paged, keys, "left").join(summary, keys, "left")
    return out.withColumn("schema_version", F.lit("2.0"))


def write_record(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def write_spectrogram(frames: DataFrame, parameters: dict, path: str) -> None:
    """Row per frame with its magnitudes and the parameters that made it."""
    out = frames
    for name, value in parameters.items():
        out = out.withColumn(name, F.lit(value))
    out.sortWithinPartitions("recording_id").write.mode("overwrite").parquet(path)
