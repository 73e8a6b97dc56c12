"""Registered queries of the text operators, one for each, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from percussa.llm import oracles
from percussa.llm.common import table
from percussa.llm.divergence import divergence
from percussa.llm.line_dedup import line_dedup
from percussa.llm.minhash_join import near_duplicates
from percussa.llm.mixing import mix
from percussa.llm.ngram_join import ngram_join
from percussa.llm.order_minhash import edited_fingerprints
from percussa.llm.pieces import encode
from percussa.llm.quality_rules import quality_rules
from percussa.llm.resampling import resample
from percussa.llm.suffix_dedup import suffix_dedup
from percussa.llm.token_codes import coded
from percussa.llm.toxicity import toxicity
from percussa.llm.warc import archived

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


@query("op1_suffix_dedup", oracles.SUFFIX_DEDUP)
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"), length=50)
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_minhash_join", oracles.NEAR_DUPLICATES)
def op3_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), width=5, percent=75)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@query("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "lang", "source", "distance")


@query("op2_order_minhash")
def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op8_mixing", oracles.MIXING)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = mix(docs, quality=labels.groupBy("doc_id").agg((F.lit(0.5) + F.max("quality")).alias("quality")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


@query("op10_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT hex, max(page_id) AS holder FROM p WHERE page_id IS NOT NULL GROUP BY hex),
bits AS (SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (CASE WHEN n % 4 = 0 THEN ('0x' || substr(hex, 1 + 5 * (n // 4), 5))::BIGINT >> 15
          WHEN n % 4 = 1 THEN ('0x' || substr(hex, 1 + 5 * (n // 4), 5))::BIGINT >> 10
          WHEN n % 4 = 2 THEN ('0x' || substr(hex, 1 + 5 * (n // 4), 5))::BIGINT >> 5
          ELSE ('0x' || substr(hex, 1 + 5 * (n // 4), 5))::BIGINT END) % 32 AS INTEGER), 1), '' ORDER BY n) AS b32
  FROM (SELECT DISTINCT hex FROM p), (SELECT unnest(range(32)) AS n) GROUP BY hex)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, b32 AS payload_digest,
       CASE WHEN page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM p LEFT JOIN d USING (hex) JOIN bits USING (hex)""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archived(spark, table(spark, sf_dir, "pages"), least_bytes=0, payloads=False)
    return out.where(F.col("problem").isNull()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_token_codes")
def op6_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query("op4_line_dedup", oracles.LINE_DEDUP)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"), width=5, percent=75)
    return out.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines",
                      F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op7_pieces")
def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")),
                 public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids",
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    def held_out(doc_id):
        return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))

    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    out = toxicity(table(spark, sf_dir, "documents"), labels, "toxic", threshold=0.3)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op13_target_resampling", oracles.RESAMPLING)
def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000,
                    least_words=20, percent=10, seed=2024)


@query("op11_source_divergence", oracles.DIVERGENCE)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"), least_docs=3, most_terms=200)


@query("op12_ngram_join", oracles.NGRAM_JOIN)
def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), width=3, percent=90)
