"""Streaming queries: the windows table read as a stream of chunks."""

import uuid

from pyspark.sql import functions as F

from percussa.functions import levels as L
from percussa.operators.ordered import numbered
from percussa.plans import analysis as A
from percussa.plans import bindings as B
from percussa.plans import filter_sql as X
from percussa.plans.catalog import query, r, rounded
from percussa.plans.detection_queries import DETECT_SQL
from percussa.plans.shots_queries import pow_sql
from percussa.plans.table_queries import detection_settings
from percussa.session import checkpoint_root
from percussa.streaming import chunks as O


def embedding_stream(spark, sf):
    """The windows table as a stream, be it one file or a folder of files."""
    # A plain path would have to be a folder; a pattern that only fits the table's name serves both.
    schema = B.table(spark, sf, "embeddings").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/embeddings.parque[t]")


def chunk_stream(spark, sf):
    """Each window as a recording of two chunks of 32 samples."""
    return embedding_stream(spark, sf).select(F.col("vec_id").alias("recording_id"), F.lit(0).alias("channel"), F.posexplode(F.array(
        F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))).alias("_c", "_s")).select(
        "recording_id", "channel", F.col("_c").cast("long").alias("chunk_id"), F.lit(8000).alias("fs"),
        F.col("_s").cast("array<double>").alias("samples"))


def place(spark):
    return f"{checkpoint_root(spark)}/streams/{uuid.uuid4().hex}"


@query(f"""SELECT label AS recording_id, 0 AS channel, count(*) * 64 AS n_samples, {r("max(list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))))", "peak_FS")},
 {r("-20 * log10(max(list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x)))))", "headroom_dB")},
 {r("sum(list_sum(embedding::DOUBLE[])) / (count(*) * 64)", "dc_offset_FS", 9)},
 {r(pow_sql("sum(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) / (count(*) * 64)"), "level_dB")} FROM embeddings GROUP BY 1""")
def streaming_quality(spark, sf):
    chunks = embedding_stream(spark, sf).select(F.col("label").alias("recording_id"), F.lit(0).alias("channel"), F.col("embedding").cast("array<double>").alias("samples"))
    out = O.run_available(O.running_quality(chunks), place(spark), "complete")
    return rounded(out.drop("quietest_chunk_dB"), dc_offset_FS=9)


@query("""WITH s AS (SELECT vec_id AS recording_id, unnest(range(64)) AS n, abs(unnest(embedding)::DOUBLE) AS a, embedding FROM embeddings),
t AS (SELECT *, max(a) OVER (PARTITION BY recording_id) AS c FROM s),
g AS (SELECT recording_id, count(*) AS length FROM (SELECT *, n - row_number() OVER (PARTITION BY recording_id ORDER BY n) AS g FROM t WHERE abs(a - c) <= c * 1e-4::DOUBLE) GROUP BY recording_id, g)
SELECT recording_id, 64 AS n_samples, count(*) FILTER (WHERE length >= 3) AS ceiling_runs, max(length)::BIGINT AS longest_run FROM g GROUP BY 1""")
def streaming_ceiling(spark, sf):
    O.use_rocksdb(spark)
    out = O.run_available(O.running_ceiling(chunk_stream(spark, sf)), place(spark))
    last = out.where("chunk_id = 1")
    return last.select("recording_id", F.col("n_samples").cast("int").alias("n_samples"), "ceiling_runs", "longest_run")


@query(f"""WITH {X.kernel_cte("h", X.weighting_sql("A", 8000), 8000, 2048, 64)}, s AS (SELECT vec_id AS recording_id, unnest(range(64)) AS n, unnest(embedding)::DOUBLE AS x FROM embeddings),
y AS (SELECT a.recording_id, a.n, sum(b.x * h) AS y FROM s a JOIN s b ON a.recording_id = b.recording_id AND b.n // 32 <= a.n // 32 JOIN h ON h.d = a.n - b.n GROUP BY 1, 2)
SELECT recording_id, (n // 32)::BIGINT AS chunk_id, count(*)::INT AS n, {r("max(abs(y))", "peak", 9)} FROM y GROUP BY 1, 2""")
def stateful_weighting(spark, sf):
    O.use_rocksdb(spark)
    out = O.run_available(O.stateful_weighting(chunk_stream(spark, sf)), place(spark))
    return rounded(out.select("recording_id", "chunk_id", F.size("samples").alias("n"), L.peak("samples").alias("peak")), 9)


@query(f"""WITH RECURSIVE {DETECT_SQL} SELECT recording_id, shot_number, idx, {r("peak_level", "peak_level")} FROM shots""")
def two_pass_detection(spark, sf):
    stream = embedding_stream(spark, sf).select(
        F.col("label").alias("recording_id"), F.lit(0).alias("channel"), F.col("vec_id").alias("chunk_id"),
        F.col("embedding").cast("array<double>").alias("samples"))

    def detect(stored):
        ranked = numbered(stored, ["recording_id"], ["chunk_id"], "_rank")
        chunk = F.col("_rank") - 1
        loud = ranked.select("recording_id", chunk.alias("chunk_id"), L.scaled("samples", F.pow(F.lit(10.0), (chunk % 7) * -0.4)).alias("samples"))
        return A.detect(A.long_samples(loud, ["recording_id"], 64), ["recording_id"], detection_settings()).shots

    shots = O.two_pass(stream, place(spark), detect)
    return rounded(shots.select("recording_id", "shot_number", "idx", F.col("peak_dB").alias("peak_level")))


@query(f"""WITH s AS (SELECT vec_id AS recording_id, unnest(range(64)) AS n, unnest(embedding)::DOUBLE AS x FROM embeddings),
f AS (SELECT recording_id, n // 32 AS chunk_id, frame, n % 32 - frame * 8 AS i, x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (n % 32 - frame * 8) / 16)) AS y FROM s, (VALUES (0), (1), (2)) u(frame)
  WHERE n % 32 >= frame * 8 AND n % 32 < frame * 8 + 16),
b AS (SELECT recording_id, chunk_id, frame, k, sqrt((sum(y * cos(2 * pi() * k * i / 16)) ** 2 + sum(y * sin(2 * pi() * k * i / 16)) ** 2) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END) / 8 AS v FROM f, range(9) t(k) GROUP BY 1, 2, 3, 4)
SELECT recording_id, chunk_id, frame::BIGINT AS frame, {r("max(v)", "peak", 9)} FROM b GROUP BY 1, 2, 3""")
def chunk_spectrogram(spark, sf):
    frames = O.chunk_spectrogram(chunk_stream(spark, sf), 16, 8)
    out = O.run_available(frames.select("recording_id", "chunk_id", "frame", F.array_max("values").alias("peak")), place(spark))
    return rounded(out, 9)


@query()
def chunk_bands(spark, sf):
    O.use_rocksdb(spark)
    led = O.run_available(O.with_lead_in(chunk_stream(spark, sf), 0.002), place(spark))
    return rounded(O.chunk_bands(led, "fast", 2.0, 500.0))
