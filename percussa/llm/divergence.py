"""How far the sources of a language lie apart in their use of terms: hash-consed segment trees over term ids.

1. A scan counts terms inside each task, a batch at a time; one shuffle by (lang, term) adds the counts up, tells in how
   many documents of the language a term stands and keeps the terms that reach `least_docs`.
2. The kept terms of a language are dealt into blocks of about BLOCK terms; a term's id is its block and its place there,
   commonest first. For each block every group (lang, source) has a segment tree over its counts, built level by level from
   what is not zero. Equal subtrees of all groups are one node: leaves by count, inner nodes by their two children.
3. Two trees are walked at once from their roots. At each level equal pairs of nodes are one entry with the number of
   places it stands for, so an equal pair is opened and priced once; a pair of empty nodes is dropped. What is left
   are pairs of counts, priced by the groups' totals. Absent terms are added in closed form: V terms less those priced.
4. Blocks are cut further into tiles of TILE by TILE sources, so a task holds at most 2 TILE trees of a block, whatever
   the number of sources. Prices of blocks are added up by Spark.

All arithmetic is exact: p in steps of three digits that stay inside 64 bits while counts are below 9e15.

Defined cases: NULL text, lang and source count as ''; documents are rows, repeats counted; a group without kept terms has
N = 0 and is priced like any other; a language without kept terms has V = 0 and prices of 0; a source alone in its language
has no pairs; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from percussa.llm.common import packed, slices, stored

BLOCK = 4096
TILE = 32
SLICE = 32 << 20
SCALE = 1_000_000_000


def _text(name: str) -> Column:
    return F.coalesce(name, F.lit("")).alias(name)


def _letters() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.zeros(256, bool)
    inside[97:123] = inside[128:] = True
    return lower, inside


def _strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings that lie end to end in `data`."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def batch_counts(text: pa.Array, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of a batch: group, term, its occurrences and the number of texts with it, once for each group and term."""
    data, offsets = packed(text)
    lower, inside = _letters()
    data = lower[data]
    word = inside[data]
    heads = np.zeros(len(data) + 1, bool)
    heads[offsets] = True
    begin = np.flatnonzero(word & ~(np.concatenate([[False], word[:-1]]) & ~heads[:-1]))
    end = np.flatnonzero(word & ~(np.concatenate([word[1:], [False]]) & ~heads[1:])) + 1
    terms = _strings(data[word], np.cumsum(end - begin)).dictionary_encode()
    kinds = max(1, len(terms.dictionary))
    doc = np.searchsorted(offsets, begin, side="right") - 1
    code = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # Once for each document and term, then once for each group and term.
    held, times = np.unique(doc * kinds + code, return_counts=True)
    both = group[held // kinds] * kinds + held % kinds
    order = np.argsort(both, kind="stable")
    both, times = both[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    n = np.add.reduceat(times, first) if len(first) else first
    docs = np.diff(np.concatenate([first, [len(both)]]))
    return both[first] // kinds, terms.dictionary.take(pa.array(both[first] % kinds)), n, docs


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: counted inside batches; rows of one key may come from many batches."""
    fields = "lang string, source string, term string, n long, docs long"

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            _, offsets = packed(text)
            for a, b in slices(offsets, SLICE):
                part = batch.slice(a, b - a)
                lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
                wide = max(1, len(source.dictionary))
                named = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * wide + source.indices.to_numpy(zero_copy_only=False)
                group, term, n, held = batch_counts(part.column("text"), named)
                yield pa.RecordBatch.from_arrays([
                    lang.dictionary.take(pa.array(group // wide)).cast(pa.string()),
                    source.dictionary.take(pa.array(group % wide)).cast(pa.string()),
                    term.cast(pa.string()), pa.array(n, pa.int64()), pa.array(held, pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])

    return docs.select("text", _text("lang"), _text("source")).mapInArrow(run, fields)


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, source, term, n, lang_n and whether the row is its term's first, of the terms that stand in at least `least_docs` documents of their language."""
    # Dealt by (lang, term), both the sums and the window over the language's sources need no further shuffle.
    summed = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    return summed.withColumns({"lang_n": F.sum("n").over(term), "in": F.sum("docs").over(term), "lead": F.min("source").over(term)}).where(
        F.col("in") >= least_docs).select("lang", "source", "term", "n", "lang_n", (F.col("lead") == F.col("source")).alias("lead"))


def _shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), three digits at a time."""
    rest, out = count + 1, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _share(count: Column, total: Column) -> Column:
    """The same on columns; NULL for a total of 0."""
    scaled = F.lit(SCALE).cast("decimal(11,0)") * (count + 1).cast("decimal(19,0)")
    return F.call_function("div", scaled, F.nullif(total, F.lit(0)).cast("decimal(19,0)")) + 1


class Trees:
    """Segment trees of several groups over the same leaves; equal subtrees are one node, 0 is the empty one."""

    def __init__(self, group: np.ndarray, place: np.ndarray, count: np.ndarray, groups: int, leaves: int):
        order = np.lexsort((place, group))
        group, place, count = group[order], place[order], count[order]
        self.counts, node = np.unique(count, return_inverse=True)
        self.counts = np.concatenate([[0], self.counts])
        node = node + 1
        self.levels = []
        width = 1
        while width < leaves:
            up = place >> 1
            fresh = np.ones(len(up), bool)
            fresh[1:] = (group[1:] != group[:-1]) | (up[1:] != up[:-1])
            parent = np.cumsum(fresh) - 1
            pair = np.zeros((2, int(fresh.sum())), np.int64)
            pair[place & 1, parent] = node
            wide = int(node.max(initial=0)) + 1
            known, node = np.unique(pair[0] * wide + pair[1], return_inverse=True)
            node = node + 1
            self.levels.append(np.concatenate([[[0], [0]], [known // wide, known % wide]], axis=1))
            group, place, width = group[fresh], up[fresh], width * 2
        self.roots = np.zeros(groups, np.int64)
        self.roots[group] = node

    def paired(self, one: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Walks the tree of `one` with that of each of `others` at once.

        Returns (index into others, count id of `one`, count id of the other, places) once for each distinct pair of
        counts that are not both 0.
        """
        which = np.arange(len(others))
        a, b = np.full(len(others), self.roots[one]), self.roots[others]
        times = np.ones(len(others), np.int64)
        for depth in range(len(self.levels), -1, -1):
            open_ = (a > 0) | (b > 0)
            which, a, b, times = which[open_], a[open_], b[open_], times[open_]
            if len(which):
                # Equal pairs of one walk become one entry.
                wa, wb = int(a.max()) + 1, int(b.max()) + 1
                key = (which * wa + a) * wb + b
                order = np.argsort(key)
                key = key[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                times = np.add.reduceat(times[order], first)
                which, a, b = which[order][first], a[order][first], b[order][first]
            if depth:
                kids = self.levels[depth - 1]
                which, times = np.concatenate([which, which]), np.concatenate([times, times])
                a, b = np.concatenate([kids[0][a], kids[1][a]]), np.concatenate([kids[0][b], kids[1][b]])
        return which, a, b, times


_PRICED = pa.schema([("lang", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("value", pa.int64()), ("terms", pa.int64())])


def _price(table: pa.Table) -> pa.Table:
    """Prices of all pairs of sources of one tile of one block, both ways, over the terms that either source has.

    Rows without a term name the tile's sources; the others hold the counts.
    """
    heads, rows = table.filter(pc.is_null(table.column("term"))), table.filter(pc.is_valid(table.column("term")))
    number, at = np.unique(np.asarray(heads.column("number")), return_index=True)
    total = np.asarray(heads.column("total"))[at]
    term = rows.column("term").combine_chunks().dictionary_encode()
    code = np.asarray(term.indices).astype(np.int64)
    weight = np.zeros(len(term.dictionary), np.int64)
    weight[code] = np.asarray(rows.column("lang_n"))
    # Commonest first, so that rare terms lie together and their trees are mostly empty.
    place = np.empty(len(weight), np.int64)
    place[np.argsort(-weight, kind="stable")] = np.arange(len(weight))
    group = np.searchsorted(number, np.asarray(rows.column("number")))
    trees = Trees(group, place[code], np.asarray(rows.column("n")), len(number), len(weight))
    share = _shares(trees.counts[None, :], total[:, None])
    side = number // TILE
    low, high = heads.column("ti")[0].as_py(), heads.column("tj")[0].as_py()
    found = []

    def add(i, j, which, value, times):
        sums, seen = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        np.add.at(sums, which, value * times)
        np.add.at(seen, which, times)
        found.append((i, j, sums, seen))

    for k in np.flatnonzero(side == low):
        others = np.flatnonzero((side == high) & (number > number[k]))
        which, a, b, times = trees.paired(k, others)
        p, q = share[k, a], share[others[which], b]
        gap = (p - q) * (p - q)
        own = np.full(len(others), number[k])
        add(own, number[others], which, gap // q, times)
        add(number[others], own, which, gap // p, times)
    i, j, value, terms = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(4))
    lang = pa.array([heads.column("lang")[0].as_py()], pa.string()).take(pa.array(np.zeros(len(i), np.int32)))
    return pa.Table.from_arrays([lang, pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(value, pa.int64()),
                                 pa.array(terms, pa.int64())], schema=_PRICED)


def divergence(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: see the module."""
    kept = stored(kept_terms(docs, least_docs), "terms")
    langs = kept.groupBy("lang").agg(F.count_if("lead").alias("v"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("held"))
    groups = docs.select(_text("lang"), _text("source")).distinct()
    groups = (groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("v", F.lit(0)).alias("v"),
                      F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
              .withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
              .withColumn("total", F.col("held") + F.col("v")))
    groups = stored(groups, "groups")
    return _terms(kept, groups, most_terms).unionByName(_pairs(kept, groups))


def _terms(kept: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """Terms that a group uses more than its language does; the window keeps `most` rows of a group before the shuffle."""
    told = kept.join(groups.select("lang", "source", "total", "v", "lang_total"), ["lang", "source"])
    told = told.withColumn("p", _share(F.col("n"), F.col("total"))).withColumn(
        "q", _share(F.col("lang_n"), F.col("lang_total") + F.col("v"))).where("p > q")
    told = told.withColumn("value", F.expr("(p - q) * (p - q) div q"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return told.withColumn("rank", rank).where(F.col("rank") <= most).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Every ordered pair of sources of a language with its price over all kept terms."""
    numbered = groups.select("lang", "source", "number", "total")
    blocks = F.ceil(F.col("v") / BLOCK).cast("int")
    tiles = groups.groupBy("lang").agg((F.floor(F.max("number") / TILE) + 1).cast("int").alias("tiles"), F.max(blocks).alias("blocks"))
    side = F.floor(F.col("number") / TILE).cast("int")
    # A source belongs to every tile of its row and of its column.
    mine = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(
        F.least(t, side).alias("ti"), F.greatest(t, side).alias("tj")))
    rows = kept.join(numbered, ["lang", "source"]).join(tiles, "lang").withColumn(
        "block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).select(
        "lang", "block", "number", "total", "term", "n", "lang_n", F.inline(mine))
    heads = numbered.join(tiles, "lang").where("blocks > 0").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "number", "total",
        F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("lang_n"),
        "tiles").select("lang", "block", "number", "total", "term", "n", "lang_n", F.inline(mine))
    priced = rows.unionByName(heads).groupBy("lang", "block", "ti", "tj").applyInArrow(_price, "lang string, i int, j int, value long, terms long")
    priced = priced.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    one = groups.select("lang", "source", "v", F.col("number").alias("i"), F.col("total").alias("x"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("j"), F.col("total").alias("y"))
    every = one.join(two, "lang").where(F.col("i") != F.col("j"))
    every = every.withColumns({"p": _share(F.lit(0), F.col("x")), "q": _share(F.lit(0), F.col("y"))})
    absent = F.coalesce((F.col("v") - F.coalesce("terms", F.lit(0))) * F.expr("(p - q) * (p - q) div q"), F.lit(0))
    out = every.join(priced, ["lang", "i", "j"], "left").withColumn("value", (F.coalesce("value", F.lit(0)) + absent).cast("long"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return out.withColumn("rank", rank).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
