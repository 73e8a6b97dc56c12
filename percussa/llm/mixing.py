"""Mixing sources to target weights: Efraimidis-Spirakis keys, prefix sums to a budget of words.

A source's target is its share of all words by weight, at most `most_epochs` times what it has; what is cut off is
shared again by weight among the others. Complete epochs take every document of a source; the rest of the target is
filled from its documents in the order of their exponential keys -ln(u) / quality, u from a hash of seed and doc_id. A
document is taken while half of it still fits, so a source ends within half a document of its target.

No source is gathered in one task: keys are counted in CELLS cells a source, a running sum over the cells finds the one
in which the budget ends, and only that cell is put in order. A heavier cell than `cell_rows` is cut again by the next
digits of the key.

Defined cases: a NULL text has 0 words and is never short of its budget; a NULL source is a source of its own, after all
others; a NULL quality counts as 1, and one of 0 or less as the least weight; rows that repeat a doc_id share a key and
are told apart by a hash of the text, equal rows by a number; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from percussa.llm.common import WORD, stored

CELLS = 1 << 12
LEAST_QUALITY = 1e-6


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def uniform(seed: int, doc_id: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most_epochs: float) -> DataFrame:
    """source, source_size, target for each source of (source, source_size); weights repeat in order of code points.

    The largest ratio of target to size that may stay is found by ordering sources by size over weight: the limit binds
    for a beginning of that order, and the others share what is left.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    named = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    cap = F.lit(float(most_epochs)) * F.col("source_size")
    # If the k smallest are held at their limits, the rest share `left` by weight.
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    rate = F.greatest(left, F.lit(0.0)) / F.sum("weight").over(onward)
    out = named.withColumn("cap", cap).withColumn("rate", rate)
    out = out.withColumn("free", F.col("rate") * F.col("weight") <= F.col("cap"))
    common = F.first(F.when(F.col("free"), F.col("rate")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return out.select("source", "source_size", F.least("cap", F.coalesce(common * F.col("weight"), F.col("cap"))).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most_epochs: float = 3.0,
        quality: DataFrame | None = None, seed: int = 17, cells: int = CELLS) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (how often the mix takes the document) and taken (words).

    `quality` has one row (doc_id, quality) for each document that has a weight.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), n_words(F.col("text")).alias("size"),
                       F.xxhash64("text").alias("tie"))
    worth = F.lit(1.0)
    if quality is not None:
        # Texts are left behind before the join.
        rows = rows.join(quality.select(F.col("doc_id").alias("of"), F.col("quality").cast("double").alias("quality")),
                         F.col("doc_id") == F.col("of"), "left")
        worth = F.greatest(F.coalesce("quality", F.lit(1.0)), F.lit(LEAST_QUALITY))
    rows = stored(rows.select("doc_id", "source", "size", "tie",
                              (-F.ln(uniform(seed, F.col("doc_id"))) / worth).alias("key")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, share, most_epochs).withColumn(
        "full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    goal = goal.withColumn("budget", F.col("target") - F.col("full") * F.col("source_size"))
    goal = stored(goal.withColumnRenamed("source", "of"), "targets")
    # key / (1 + key) spreads the keys over [0, 1) in their order.
    keyed = rows.withColumn("cell", F.floor(F.col("key") / (1 + F.col("key")) * cells).cast("long"))
    by_cell = keyed.groupBy("source", "cell").agg(F.sum("size").alias("words")).withColumnRenamed("source", "of")
    running = Window.partitionBy("of").orderBy("cell")
    by_cell = by_cell.withColumn("upto", F.sum("words").over(running))
    edge = by_cell.withColumnRenamed("of", "name").join(goal, _same("name", "of")).where(
        (F.col("upto") - F.col("words") <= F.col("budget")) & (F.col("upto") > F.col("budget"))).groupBy("name").agg(
        F.min("cell").alias("edge"), F.min_by(F.col("upto") - F.col("words"), "cell").alias("before"))
    goal = stored(goal.join(edge, _same("of", "name"), "left").drop("name"), "budgets")
    told = keyed.join(goal, _same("source", "of"))
    inside = Window.partitionBy("of").orderBy("key", F.col("doc_id").asc_nulls_first(), F.col("tie").asc_nulls_first(), "size")
    ordered = told.where(F.col("cell") == F.col("edge")).withColumn(
        "upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("before"))
    ordered = ordered.withColumn("more", (F.col("upto") - F.col("size") / 2 <= F.col("budget")).cast("long")).drop("upto")
    rest = told.where(F.col("edge").isNull() | (F.col("cell") != F.col("edge"))).withColumn(
        "more", F.when(F.col("edge").isNull(), F.lit(0)).otherwise((F.col("cell") < F.col("edge")).cast("long")).cast("long"))
    epochs = F.col("full") + F.col("more")
    return ordered.unionByName(rest).select(
        "doc_id", "source", "size", "source_size", "target", epochs.cast("long").alias("epochs"),
        (F.col("size") * epochs).cast("long").alias("taken"))
