"""Views that present the supplied tables as recordings, shots, windows and bands.

Each view exists twice: as a DataFrame and as the SQL text an oracle query puts
in its WITH clause. Both cover every row of the table they read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from percussa.functions import levels as L
from percussa.operators.ordered import numbered

SHOT_METRICS = ["Lpeak_Z", "LAE", "spectral_centroid_Hz", "a_duration_ms", "rise_time_us"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz_micros(col: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session zone."""
    c = F.col(col)
    return (
        F.unix_date(F.to_date(c)).cast("long") * 86_400_000_000
        + F.hour(c) * F.lit(3_600_000_000).cast("long")
        + F.minute(c) * F.lit(60_000_000).cast("long")
        + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    )


def shots(spark: SparkSession, sf_dir: str, number: bool = True) -> DataFrame:
    """One row per event: a shot of recording user_id with level value."""
    out = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("recording_id"),
        "event_id",
        ntz_micros("ts").alias("t_us"),
        F.col("value").alias("level"),
        (F.col("event_type") != "error").alias("valid"),
        F.when(F.col("event_type").isin("click", "view"), "unsuppressed")
        .when(F.col("event_type").isin("purchase", "signup"), "suppressed")
        .alias("configuration"),
    )
    if not number:
        return out
    return numbered(out, ["recording_id"], ["t_us", "event_id"], "shot_number")


SHOTS_SQL = """shots AS (
  SELECT user_id AS recording_id, event_id, epoch_us(ts) AS t_us, value AS level,
         event_type <> 'error' AS valid,
         CASE WHEN event_type IN ('click','view') THEN 'unsuppressed'
              WHEN event_type IN ('purchase','signup') THEN 'suppressed' END AS configuration,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS shot_number
  FROM events)"""


def shot_records(spark: SparkSession, sf_dir: str, number: bool = True) -> DataFrame:
    """Shots with further metrics derived by fixed arithmetic."""
    e = F.col("event_id")
    return shots(spark, sf_dir, number).select(
        "*",
        F.col("level").alias("Lpeak_Z"),
        (F.col("level") * 0.8 + e % 5).alias("LAE"),
        (800 + F.col("level") * 3 + e % 11).alias("spectral_centroid_Hz"),
        (0.5 + (e % 13) / 100 + F.col("level") / 1000).alias("a_duration_ms"),
        (20 + (e % 17) * 0.5 + F.col("level") / 50).alias("rise_time_us"),
        (F.lit(5) + e % 30).cast("double").alias("snr_dB"),
        (e % 37 == 0).alias("clipped"),
        (e % 41 == 0).alias("window_truncated"),
        (e % 7 != 0).alias("rise_time_resolved"),
    )


SHOT_RECORDS_SQL = SHOTS_SQL + """, shot_records AS (
  SELECT *, level AS "Lpeak_Z", level * 0.8::DOUBLE + event_id % 5 AS "LAE",
         800 + level * 3 + event_id % 11 AS "spectral_centroid_Hz",
         0.5::DOUBLE + (event_id % 13) / 100::DOUBLE + level / 1000 AS a_duration_ms,
         20 + (event_id % 17) * 0.5::DOUBLE + level / 50 AS rise_time_us,
         (5 + event_id % 30)::DOUBLE AS "snr_dB",
         event_id % 37 = 0 AS clipped, event_id % 41 = 0 AS window_truncated,
         event_id % 7 <> 0 AS rise_time_resolved
  FROM shots)"""

WINDOW_FS = 8_000


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per embedding: the samples of one shot window at 8 kHz.

    recording_id is the label; even labels count as the unsuppressed set-up.
    """
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("recording_id"),
        F.col("vec_id").alias("shot_number"),
        F.when(F.col("vec_id") % 2 == 0, "unsuppressed").otherwise("suppressed").alias("configuration"),
        F.lit(WINDOW_FS).alias("fs"),
        F.col("embedding").cast("array<double>").alias("samples"),
    )


WINDOWS_SQL = """windows AS (
  SELECT label AS recording_id, vec_id AS shot_number,
         CASE WHEN vec_id % 2 = 0 THEN 'unsuppressed' ELSE 'suppressed' END AS configuration,
         8000 AS fs, embedding::DOUBLE[] AS samples
  FROM embeddings)"""

SAMPLES_SQL = WINDOWS_SQL + """, samples AS (
  SELECT recording_id, shot_number, fs, len(samples) AS n_samples,
         unnest(range(len(samples))) AS n, unnest(samples) AS x
  FROM windows)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of `windows`."""
    return windows(spark, sf_dir).select(
        "recording_id", "shot_number", "fs", F.size("samples").alias("n_samples"),
        F.posexplode("samples").alias("n", "x"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recording as ONE long signal in chunks of 64 samples: its windows in order of vec_id.

    Every seventh window is loud and the next six decay by 8 dB each, so the
    signal has events. The chunk number is a split-safe rank of windows.
    """
    ranked = numbered(windows(spark, sf_dir), ["recording_id"], ["shot_number"], "_rank")
    chunk = F.col("_rank") - 1
    gain = F.pow(F.lit(10.0), (chunk % 7) * -0.4)
    return ranked.select("recording_id", "fs", chunk.alias("chunk_id"), L.scaled("samples", gain).alias("samples"))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of `chunks`: (recording_id, fs, n, x)."""
    exploded = chunks(spark, sf_dir).select("recording_id", "fs", "chunk_id", F.posexplode("samples").alias("_p", "x"))
    return exploded.select("recording_id", "fs", (F.col("chunk_id") * 64 + F.col("_p")).alias("n"), "x")


STREAM_SQL = WINDOWS_SQL + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY shot_number) - 1 AS chunk_id FROM windows
), stream AS (
  SELECT recording_id, fs, chunk_id * 64 + unnest(range(len(samples))) AS n,
         unnest(samples) * power(10.0::DOUBLE, (chunk_id % 7) * -0.4::DOUBLE) AS x FROM ranked)"""


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: a band level of a shot. Bands are octaves from 125 Hz."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("recording_id"),
        F.col("l_linenumber").alias("band"),
        (F.lit(62.5) * F.pow(F.lit(2.0), F.col("l_linenumber"))).alias("band_Hz"),
        F.col("l_quantity").alias("level"),
        F.when(F.col("l_returnflag") == "N", "unsuppressed")
        .when(F.col("l_returnflag") == "R", "suppressed").otherwise("other").alias("configuration"),
        F.col("l_shipdate").alias("shipdate"),
    )


BANDS_SQL = """bands AS (
  SELECT l_suppkey AS recording_id, l_linenumber AS band, 62.5 * power(2.0::DOUBLE, l_linenumber) AS band_Hz,
         l_quantity AS level,
         CASE l_returnflag WHEN 'N' THEN 'unsuppressed' WHEN 'R' THEN 'suppressed' ELSE 'other' END AS configuration
  FROM lineitem)"""


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: a recording whose set-up is derived by fixed arithmetic.

    The customer is the session; about one field in eleven is not recorded.
    """
    k = F.col("o_orderkey")

    def unless(n: int, value: Column) -> Column:
        return F.when(k % n != 0, value)

    def pick(mod: int, *names: str) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in names]), (k % mod % len(names) + 1).cast("int"))

    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        k.alias("recording_id"),
        F.col("o_custkey").alias("session_id"),
        F.concat(F.lit("T-"), k.cast("string")).alias("test_id"),
        F.when(F.col("o_orderstatus") == "F", "unsuppressed")
        .when(F.col("o_orderstatus") == "O", "suppressed").alias("configuration"),
        F.concat(F.lit("W"), (F.col("o_custkey") % 2 + (k % 29 == 0).cast("int")).cast("string")).alias("weapon"),
        unless(13, F.concat(F.lit("A"), (k % 2).cast("string"))).alias("ammunition"),
        unless(11, 1.0 + (k % 3) * 0.5).alias("mic_distance_m"),
        unless(19, 90.0 + (k % 4) * 1.5).alias("mic_angle_deg"),
        (1.5 + (k % 5) * 0.004).alias("mic_height_m"),
        pick(3, "M1", "M2", "m1").alias("mic_model"),
        F.concat(F.lit("S"), (k % 6).cast("string")).alias("mic_serial"),
        unless(17, pick(4, "range", "Range", "field", "range")).alias("location"),
        pick(5, "kim", "lee", "kim", "lee", "pat").alias("operator"),
        unless(7, pick(2, "foam", "none")).alias("windscreen"),
        pick(3, "grass", "concrete", "grass").alias("ground_surface"),
        unless(23, (k % 40 - 5).cast("double")).alias("temperature_C"),
        unless(31, (20 + k % 70).cast("double")).alias("humidity_pct"),
        unless(5, 98.0 + (k % 60) / 10).alias("pressure_kPa"),
        unless(3, (k % 9).cast("double")).alias("wind_mps"),
        unless(9, 93.9 + (k % 3) * 0.1).alias("calibration_pre_dB"),
        unless(9, 93.9 + (k % 8) * 0.1).alias("calibration_post_dB"),
        F.when(k % 4 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(k % 4 == 1, F.date_format(day, "yyyy/MM/dd"))
        .when(k % 4 == 2, F.date_format(day, "dd/MM/yyyy"))
        .otherwise(F.lit("not noted")).alias("date"),
        (F.col("o_totalprice") / 4000 + 40).alias("level"),
        (k % 8).cast("long").alias("n_valid"),
        (k % 8 + k % 3).cast("long").alias("n_shots"),
        ntz_micros("o_orderdate").alias("t_us"),
    )


def _pick_sql(mod: int, *names: str) -> str:
    return "[" + ",".join(f"'{n}'" for n in names) + f"][(k % {mod} % {len(names)} + 1)::INT]"


RECORDINGS_SQL = f"""recordings AS (
  SELECT k AS recording_id, o_custkey AS session_id, 'T-' || k AS test_id,
    CASE o_orderstatus WHEN 'F' THEN 'unsuppressed' WHEN 'O' THEN 'suppressed' END AS configuration,
    'W' || (o_custkey % 2 + (k % 29 = 0)::INT) AS weapon,
    CASE WHEN k % 13 <> 0 THEN 'A' || (k % 2) END AS ammunition,
    CASE WHEN k % 11 <> 0 THEN 1.0::DOUBLE + (k % 3) * 0.5::DOUBLE END AS mic_distance_m,
    CASE WHEN k % 19 <> 0 THEN 90.0::DOUBLE + (k % 4) * 1.5::DOUBLE END AS mic_angle_deg,
    1.5::DOUBLE + (k % 5) * 0.004::DOUBLE AS mic_height_m,
    {_pick_sql(3, "M1", "M2", "m1")} AS mic_model, 'S' || (k % 6) AS mic_serial,
    CASE WHEN k % 17 <> 0 THEN {_pick_sql(4, "range", "Range", "field", "range")} END AS location,
    {_pick_sql(5, "kim", "lee", "kim", "lee", "pat")} AS operator,
    CASE WHEN k % 7 <> 0 THEN {_pick_sql(2, "foam", "none")} END AS windscreen,
    {_pick_sql(3, "grass", "concrete", "grass")} AS ground_surface,
    CASE WHEN k % 23 <> 0 THEN (k % 40 - 5)::DOUBLE END AS "temperature_C",
    CASE WHEN k % 31 <> 0 THEN (20 + k % 70)::DOUBLE END AS humidity_pct,
    CASE WHEN k % 5 <> 0 THEN 98.0::DOUBLE + (k % 60) / 10::DOUBLE END AS "pressure_kPa",
    CASE WHEN k % 3 <> 0 THEN (k % 9)::DOUBLE END AS wind_mps,
    CASE WHEN k % 9 <> 0 THEN 93.9::DOUBLE + (k % 3) * 0.1::DOUBLE END AS "calibration_pre_dB",
    CASE WHEN k % 9 <> 0 THEN 93.9::DOUBLE + (k % 8) * 0.1::DOUBLE END AS "calibration_post_dB",
    CASE k % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
               WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'not noted' END AS date,
    o_totalprice / 4000 + 40 AS level, k % 8 AS n_valid, k % 8 + k % 3 AS n_shots,
    epoch_us(o_orderdate) AS t_us
  FROM (SELECT *, o_orderkey AS k FROM orders))"""


def microphones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier: a channel of the array named by its nation."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("array_id"),
        F.col("s_suppkey").alias("channel"),
        (100 + F.col("s_acctbal") / 10000).alias("level"),
        (1.0 + F.col("s_suppkey") % 4).alias("distance_m"),
    )


MICS_SQL = """mics AS (
  SELECT s_nationkey AS array_id, s_suppkey AS channel, 100 + s_acctbal / 10000 AS level,
         1.0::DOUBLE + s_suppkey % 4 AS distance_m FROM supplier)"""


def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots an operator rejected."""
    return table(spark, sf_dir, "events").where("event_type = 'error'").select(
        F.col("user_id").alias("recording_id"), "event_id")
