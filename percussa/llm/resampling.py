"""Draws the documents that look most like a target corpus: importance resampling over hashed n-grams.

1. Two scans count hashed features, one bucket count for each task and bucket: the raw corpus (s of S) and the target
   (t of T). A bucket's gain is floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))); the B gains are the only thing that
   goes through the driver, and B is a parameter.
2. A third scan adds the gains up in arrays: a document's weight is the floored mean gain of its features, its score the
   weight plus a Gumbel number from a hash of its id. Only ids and numbers are stored from here on.
3. Distributed quickselect finds the k-th of the composite keys (score descending, doc_id ascending, row): each round
   takes PIVOTS random keys of what is left, counts exactly how many keys lie below, on and between them, and goes on with
   the one gap that holds the k-th. The gap is stored, so that all rounds together read the keys about once.
4. Keys up to the k-th are the winners. They alone are sorted, over many tasks: ranges of the key, rows numbered inside,
   counts of the ranges before added.

Defined cases: a NULL or wordless text has no features and weight 0; a NULL doc_id is hashed as the empty string and comes
after all ids; rows that repeat a doc_id are rows of their own, told apart by n_features, weight and place in the input;
an empty target gives every bucket its gain by the formula; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from percussa.llm.common import packed, slices, stored

PIVOTS = 32
SLICE = 4 << 20
_ROW = "doc_id long, n_features long, n_words long, gain_sum long"


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _advance(state: np.ndarray, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 states after the bytes data[begin : begin + length], all runs stepping together."""
    state = state.copy()
    order = np.argsort(-length, kind="stable")
    falling = -length[order]
    for k in range(int(length.max(initial=0))):
        at = order[:np.searchsorted(falling, -k)]
        now = state[at]
        state[at] = _CRC[(now ^ data[begin[at] + k]) & 0xFF] ^ (now >> 8)
    return state


def _word_bytes() -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased value of each byte, and whether it belongs to a word: digits, letters and all beyond ASCII."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.zeros(256, bool)
    inside[48:58] = inside[97:123] = inside[128:] = True
    return lower, inside


def features(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every run of 1 to `longest` words, and the number of words of each document."""
    lower, inside = _word_bytes()
    data = lower[data]
    word = inside[data]
    heads = np.zeros(len(data) + 1, bool)
    heads[offsets] = True
    before = np.concatenate([[False], word[:-1]]) & ~heads[:-1]
    after = np.concatenate([word[1:], [False]]) & ~heads[1:]
    begin = np.flatnonzero(word & ~before)
    length = np.flatnonzero(word & ~after) + 1 - begin
    owner = np.searchsorted(offsets, begin, side="right") - 1
    n_words = np.bincount(owner, minlength=len(offsets) - 1)
    docs, found = [], []
    state = np.full(len(begin), 0xFFFFFFFF, np.uint32)
    for n in range(1, longest + 1):
        m = len(begin) - n + 1
        if m <= 0:
            break
        if n > 1:
            state = _CRC[(state[:m] ^ np.uint32(32)) & 0xFF] ^ (state[:m] >> 8)
        state = _advance(state[:m], data, begin[n - 1:], length[n - 1:])
        whole = owner[:m] == owner[n - 1:]
        docs.append(owner[:m][whole])
        found.append((~state[whole]).astype(np.int64) % buckets)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_words
    return np.concatenate(docs), np.concatenate(found), n_words


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """bucket, n: features of all texts in each bucket, counted inside each task first."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = packed(batch.column("text"))
            for a, b in slices(offsets, SLICE):
                _, found, _ = features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], longest, buckets)
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])
    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """The gain of each bucket; `buckets` numbers, whatever the size of the corpora."""
    both = bucket_counts(raw, longest, buckets).withColumn("of", F.lit("s")).unionByName(
        bucket_counts(target, longest, buckets).withColumn("of", F.lit("t")))
    counts = {"s": np.zeros(buckets), "t": np.zeros(buckets)}
    for r in both.collect():
        counts[r.of][r.bucket] = r.n
    s, t = counts["s"], counts["t"]
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, longest: int, seed: int) -> DataFrame:
    """doc_id, n_features, n_words, weight, score and row (a number of its own for each row)."""
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            data, offsets = packed(batch.column("text"))
            ids = batch.column("doc_id")
            for a, b in slices(offsets, SLICE):
                owner, found, n_words = features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], longest, buckets)
                # Sums of whole numbers in doubles are exact here.
                sums = np.bincount(owner, gain[found], b - a).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(a, b - a), pa.array(np.bincount(owner, minlength=b - a)), pa.array(n_words), pa.array(sums)],
                    names=["doc_id", "n_features", "n_words", "gain_sum"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ROW)
    n, total = F.col("n_features"), F.col("gain_sum")
    # Whole division that rounds down: pmod is never negative.
    weight = F.when(n > 0, F.expr("(gain_sum - pmod(gain_sum, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return out.withColumn("weight", weight).withColumn("score", (F.col("weight") + gumbel).cast("long")).withColumn(
        "row", F.monotonically_increasing_id()).select("doc_id", "n_features", "n_words", "weight", "score", "row")


def _key() -> Column:
    """The composite key: earlier is better. NULL ids come last."""
    return F.struct((-F.col("score")).alias("a"), F.col("doc_id").isNull().alias("b"), F.coalesce("doc_id", F.lit(0)).alias("c"),
                    F.col("n_features").alias("d"), F.col("weight").alias("e"), F.col("row").alias("f"))


def _given(key: tuple) -> Column:
    """A composite key that the driver holds."""
    kinds = ("long", "boolean", "long", "long", "long", "long")
    return F.struct(*[F.lit(v).cast(kind).alias(n) for v, kind, n in zip(key, kinds, "abcdef")])


def kth_key(keys: DataFrame, k: int, pivots: int = PIVOTS, seed: int = 1) -> tuple | None:
    """The k-th least of the distinct keys (column `key`), k from 1; None if there are fewer."""
    left, turn = keys, 0
    while True:
        turn += 1
        drawn = left.select("key").orderBy(F.xxhash64(F.lit(seed + turn), "key.f"), "key").limit(pivots).collect()
        marks = sorted(tuple(r.key) for r in drawn)
        if not marks:
            return None
        # Cells 0, 2, 4 ... lie between pivots, 1, 3, 5 ... on them.
        cell = F.lit(0)
        for m in marks:
            cell = cell + (F.col("key") >= _given(m)).cast("int") + (F.col("key") > _given(m)).cast("int")
        counts = {r.cell: r.n for r in left.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}
        for c in range(2 * len(marks) + 1):
            n = counts.get(c, 0)
            if k <= n:
                break
            k -= n
        else:
            return None
        if c % 2:
            return marks[c // 2]
        if c // 2 > 0:
            left = left.where(F.col("key") > _given(marks[c // 2 - 1]))
        if c // 2 < len(marks):
            left = left.where(F.col("key") < _given(marks[c // 2]))
        left = stored(left, "gap")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, least_words: int = 20,
             percent: int = 10, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score of every document of `docs`; rank of those drawn towards the texts of `target`."""
    every = stored(scored(docs, gains(docs, target, longest, buckets), longest, seed), "scored")
    able = every.where(F.col("n_words") >= least_words)
    k = percent * able.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    last = kth_key(able.select(_key().alias("key")), k) if k else None
    if last is None:
        return every.select(*columns, F.lit(None).cast("long").alias("rank"))
    wins = (F.col("n_words") >= least_words) & (_key() <= _given(last))
    parts = every.sparkSession.sparkContext.defaultParallelism
    winners = stored(every.where(wins).withColumn("key", _key()).repartitionByRange(max(parts, 2 + k // 200_000), "key").withColumn(
        "part", F.spark_partition_id()), "winners")
    # One count for each range, so this window has few rows.
    before = winners.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("key"))
    ranked = winners.withColumn("place", place).join(before, "part").select(*columns, (F.col("before") + F.col("place")).cast("long").alias("rank"))
    return ranked.unionByName(every.where(~wins).select(*columns, F.lit(None).cast("long").alias("rank")))
