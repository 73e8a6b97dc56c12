"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

1. Each document becomes its set of shingles (64-bit hashes) and a signature of COORDINATES minima. Documents with equal
   sets are one node from here on.
2. Every node is posted under each (coordinate, value). Values that one node alone has are counted, not kept.
3. Nodes that agree on MATCHES coordinates share one of the COORDINATES - MATCHES + 1 rarest postings of either, so only
   that prefix of a node's postings, rarest first, brings candidates. A passage that many documents hold is never rare.
4. A posting names its most central member as pivot, and the others are paired with it; agreement of whole signatures
   and set sizes skips most pairs; what is left is confirmed on full sets, and components are settled by least labels.
5. Members of a pivot's neighbourhood that lie in different components are then held against each other in blocks,
   signatures first, full sets after. Pairs inside one component are never looked at, and no pair is ever a row.

With a similarity of 0.75 a pair agrees on 30 of 40 coordinates on average; fewer than 15 has a chance below 1e-6.

Defined cases: NULL, empty and blank texts have no set, stand alone and are kept; with fewer words than a shingle the
whole sequence is the one shingle; rows that repeat a doc_id belong to the component of their own text; a row without
doc_id links nothing and gets the component of documents with the same set, else NULL; extra columns are dropped; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from percussa.llm.common import mix64, packed, slices, stored

COORDINATES = 40
MATCHES = 15
BLOCK = 256
SLICE = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, np.uint64(b))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _factors(n: int) -> np.ndarray:
    return mix64(np.arange(101, 101 + n, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text (UTF-8 bytes end to end); A-Z count as a-z."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    values = _byte_values()[lower]
    gap = np.zeros(256, bool)
    gap[[9, 10, 11, 12, 13, 32]] = True
    longest = max([int(offsets[b] - offsets[a]) for a, b in slices(offsets, SLICE)], default=0)
    up, down = _powers(longest + 1)
    factors = _factors(width)
    for a, b in slices(offsets, SLICE):
        part = data[offsets[a]:offsets[b]]
        ends = offsets[a:b + 1] - offsets[a]
        word = ~gap[part]
        before = np.concatenate([[False], word])[:-1]
        heads = np.zeros(len(part) + 1, bool)
        heads[ends] = True
        before &= ~heads[:-1]
        begin = np.flatnonzero(word & ~before)
        after = np.concatenate([word, [False]])[1:] & ~heads[1:]
        end = np.flatnonzero(word & ~after) + 1
        total = np.concatenate([[np.uint64(0)], np.cumsum(values[part] * up[:len(part)], dtype=np.uint64)])
        hashes = mix64((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
        at = np.searchsorted(begin, ends)
        whole = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
        for k in range(width):
            whole += hashes[k:len(whole) + k] * factors[k]
        whole = mix64(whole)
        for x, y in zip(at, at[1:]):
            if y - x >= width:
                found = np.sort(whole[x:y - width + 1])
                yield found[np.concatenate([[True], found[1:] != found[:-1]])]
            elif y > x:
                short = np.uint64(y - x)
                yield mix64((hashes[x:y] * factors[:y - x]).sum(dtype=np.uint64, keepdims=True) + short)
            else:
                yield np.zeros(0, np.uint64)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row of minima (32 bits each) for each non-empty set."""
    whole = np.concatenate(sets)
    starts = np.cumsum([0] + [len(x) for x in sets[:-1]])
    out = np.empty((len(sets), coordinates), np.uint32)
    for k, f in enumerate(_factors(coordinates + 8)[8:]):
        out[:, k] = np.minimum.reduceat((whole * f) >> np.uint64(32), starts)
    return out


def _digest(found: np.ndarray) -> bytes:
    """16 bytes that name a set."""
    first = mix64(found).sum(dtype=np.uint64)
    second = mix64(found * np.uint64(0xD6E8FEB86659FD93) + np.uint64(7)).sum(dtype=np.uint64)
    return np.array([first, second]).tobytes()


def signed(docs: DataFrame, width: int, coordinates: int) -> DataFrame:
    """doc_id, n_shingles, node (names the set; NULL for none) and the signature's values."""
    def run(batches):
        for batch in batches:
            data, offsets = packed(batch.column("text"))
            ids = batch.column("doc_id")
            at = 0
            for a, b in slices(offsets, 4 * SLICE):
                sets = list(shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], width))
                full = [x for x in sets if len(x)]
                rows = iter(signatures(full, coordinates).astype(np.int64).tolist() if full else [])
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, b - a), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([_digest(x) if len(x) else None for x in sets], pa.binary()),
                    pa.array([next(rows) if len(x) else None for x in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "node", "signature"])
                at += b - a
    return docs.mapInArrow(run, "doc_id long, n_shingles long, node binary, signature array<long>")


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """node and its full set as sorted 8-byte integers, from (node, text); a text with another set is passed over."""
    def run(batches):
        for batch in batches:
            data, offsets = packed(batch.column("text"))
            named = [(n, x) for n, x in zip(batch.column("node").to_pylist(), shingle_sets(data, offsets, width)) if n == _digest(x)]
            yield pa.RecordBatch.from_arrays([
                pa.array([n for n, _ in named], pa.binary()), pa.array([x.tobytes() for _, x in named], pa.binary())],
                names=["node", "members"])
    return docs.mapInArrow(run, "node binary, members binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are alike enough."""
    def run(batches):
        for batch in batches:
            left, right = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            keep = []
            for p, q in zip(left, right):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b"))
    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, label: the least node reachable over `links` (a, b). `nodes` holds one row a node.

    Each round gives every node the least label among itself, its neighbours and its label's label.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "links")
    labels = stored(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("near"))
        stepped = labels.join(near, "node", "left").withColumn(
            "next", F.least("label", F.coalesce("near", "label"))).drop("near")
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = stepped.join(jump, "next").select("node", "label", F.least("next", "far").alias("next"))
        moved = stored(moved, "labels")
        if not moved.where(F.col("label") != F.col("next")).limit(1).count():
            return moved.select("node", "label")
        labels = moved.select("node", F.col("next").alias("label"))


def _agreeing(x: Column, y: Column) -> Column:
    return F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda same: same))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, coordinates: int = COORDINATES,
                    matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id of all documents that links reach."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = stored(signed(docs, width, coordinates), "signed")
    nodes = every.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("size"), F.first("signature").alias("signature"))
    nodes = stored(nodes, "nodes")
    postings = nodes.select("node", "size", F.posexplode("signature").alias("place", "value")).select(
        "node", "size", F.expr("place * 4294967296L + value").alias("token"))
    shared = postings.groupBy("token").count().where("count > 1")
    listed = postings.join(shared, "token").groupBy("node", "size").agg(
        F.sort_array(F.collect_list(F.struct("count", "token"))).alias("tokens"))
    # A document whose values many others share lies in the middle of its group of copies.
    central = F.aggregate("tokens", F.lit(0.0), lambda total, t: total + F.log(t["count"]))
    prefix = listed.where(F.size("tokens") >= matches).select(
        "node", "size", central.alias("central"),
        F.explode(F.slice("tokens", 1, F.size("tokens") - (matches - 1))).alias("t")).select(
        "node", "size", "central", F.col("t.token").alias("token"))
    prefix = stored(prefix, "prefix")
    busy = prefix.select("node").distinct()
    texts = every.join(busy, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    sets = stored(sets_of(docs.join(texts, "doc_id").select("node", "text"), width), "sets")
    signs = nodes.select("node", "signature")
    # A posting's pivot is its most central member; the pairs (pivot, member) are the first candidates.
    middle = F.struct(-F.col("central"), F.col("node").alias("pivot"), F.col("size").alias("pivot_size"))
    pivots = prefix.groupBy("token").agg(F.min(middle).alias("p")).select("token", "p.pivot", "p.pivot_size")
    near = stored(prefix.join(pivots, "token").select("pivot", "pivot_size", "node", "size").distinct(), "near")
    pairs = near.where((F.col("pivot") != F.col("node")) & (
        F.lit(100) * F.least("pivot_size", "size") >= F.lit(percent) * F.greatest("pivot_size", "size")))
    signs = nodes.select("node", F.col("signature"))
    close = (pairs.select(F.col("pivot").alias("a"), F.col("node").alias("b"))
             .join(signs.select(F.col("node").alias("a"), F.col("signature").alias("x")), "a")
             .join(signs.select(F.col("node").alias("b"), F.col("signature").alias("y")), "b")
             .where(_agreeing(F.col("x"), F.col("y")) >= matches).select("a", "b"))
    links = stored(_confirmed(close, sets, percent), "links")
    labels = components(busy, links)
    found = stored(_between(near.select("pivot", "node", "size").join(labels, "node"), signs, sets, percent, matches), "links")
    if found.limit(1).count():
        labels = components(busy, links.unionByName(found))
    least = nodes.join(labels, "node").groupBy("label").agg(F.min("least_id").alias("least_id"))
    reached = labels.join(least, "label").select("node", F.col("least_id").alias("component_id"))
    own = nodes.select("node", "least_id")
    return (every.join(own, "node", "left").join(reached, "node", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "least_id", "doc_id").alias("component_id")))


def _between(members: DataFrame, signs: DataFrame, sets: DataFrame, percent: int, matches: int) -> DataFrame:
    """Links between different components inside the neighbourhood of a pivot, from (pivot, node, size, label).

    Any two nodes that share a posting share its pivot. The members of a neighbourhood outside its commonest component
    are held against all others, in blocks of BLOCK nodes, so no pair is a row: signatures first tell which nodes have a
    likely partner at all, then full sets decide. Members of the commonest component are never held against each other.
    """
    counted = members.groupBy("pivot", "label").count()
    common = counted.groupBy("pivot").agg(F.max_by("label", F.struct("count", "label")).alias("common"),
                                          F.max("count").alias("most"), F.sum("count").alias("n")).where("most < n")
    told = members.join(common, "pivot").withColumns({
        "in": F.col("label") == F.col("common"), "blocks_in": F.ceil(F.col("most") / BLOCK).cast("int"),
        "blocks_out": F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int")})
    block = F.pmod(F.xxhash64("node"), F.when(F.col("in"), F.col("blocks_in")).otherwise(F.col("blocks_out"))).cast("int")
    outs = F.sequence(F.lit(0), F.col("blocks_out") - 1)
    ins = F.sequence(F.lit(0), F.col("blocks_in") - 1)
    mine = F.when(F.col("in"), F.transform(outs, lambda o: F.struct(
        o.alias("i"), F.col("block").alias("j"), F.lit(False).alias("alike")))).otherwise(F.concat(
            F.transform(outs, lambda o: F.struct(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j"),
                                                 F.lit(True).alias("alike"))),
            F.transform(ins, lambda d: F.struct(F.col("block").alias("i"), d.alias("j"), F.lit(False).alias("alike")))))
    placed = told.withColumn("block", block).select("pivot", "node", "size", "label", F.inline(mine))
    cell = ["pivot", "i", "j", "alike"]

    def likely(table):
        kind = np.array([table.column("signature")[k].as_py() for k in range(len(table))], np.uint32)
        label = np.unique(table.column("label").to_pylist(), return_inverse=True)[1]
        size = np.asarray(table.column("size"))
        take = np.zeros(len(table), bool)
        for k in range(len(table)):
            agree = (kind == kind[k]).sum(axis=1) >= matches
            good = agree & (label != label[k]) & (100 * np.minimum(size, size[k]) >= percent * np.maximum(size, size[k]))
            take[k] = good.any()
        return table.select([*cell, "node", "label"]).filter(pa.array(take))

    def linked(table):
        found = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
        names = table.column("node").to_pylist()
        label = np.unique(table.column("label").to_pylist(), return_inverse=True)[1]
        sizes = np.array([len(x) for x in found])
        starts = np.cumsum(sizes) - sizes
        values, place = np.unique(np.concatenate(found), return_inverse=True)
        has = np.zeros(len(values), bool)
        a, b = [], []
        for k in range(len(names)):
            own = place[starts[k]:starts[k] + sizes[k]]
            has[own] = True
            both = np.add.reduceat(has[place], starts)
            has[own] = False
            good = (100 * both >= percent * (sizes + sizes[k] - both)) & (label != label[k])
            for m in np.flatnonzero(good):
                if label[m] != label[k]:
                    # One link joins two components; their other pairs add nothing.
                    a.append(names[k])
                    b.append(names[m])
                    label[label == label[m]] = label[k]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    fields = "pivot binary, i int, j int, alike boolean, node binary, label binary"
    hopeful = placed.join(signs, "node").groupBy(*cell).applyInArrow(likely, fields)
    return hopeful.join(sets, "node").groupBy(*cell).applyInArrow(linked, "a binary, b binary")
