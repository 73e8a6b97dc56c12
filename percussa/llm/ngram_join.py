"""Exact Jaccard join of documents as a metric-space join over their sets of word n-grams.

The Jaccard distance 1 - |x & y| / |x | y| is a metric, so a pivot p and the distances to it bound all others. Pivots drawn
from a corpus are at distance 1 from nearly every document, though, and bound nothing there. So regions are opened where
documents meet, and cut by pivots from then on:

1. Documents with equal sets are one node from here on.
2. Meeting places. The hash space of n-grams is halved again and again; a node notes every part in which it has at most b
   n-grams while the part's parent holds b or more (b = 9 at 90 percent: the largest union in which two sets that alike are
   equal). Of the union of two nodes as alike as asked, at least SLACK = 1 - b (1 - t) of the n-grams lie in noted parts in
   which both are equal: a part in which they differ holds at most b n-grams for each difference, and so does a parent
   below b. A node may therefore leave out the commonest of its parts, while they hold less than SLACK / 2 of its n-grams,
   and still meets every partner. What many documents hold (a passage, a line) is left out this way. A node whose parts are
   met by others with less than SLACK of its n-grams in all has no partner and leaves.
3. Each meeting place elects its least node as pivot; a region holds the pivot and all nodes of its meeting places.
4. A region of more than LEAF nodes is cut: K pivots of its own create Voronoi cells; a node lives in the cell of its
   nearest pivot and is replicated into every cell whose pivot is at most 2e further (e the distance asked for), since a
   partner that lives there is at most e away. Nodes linked with a pivot share its label. Cells are regions of the next
   round; what shares one label is settled.
5. A region of at most LEAF nodes is joined exactly in one task. A region with a cell above SHRINK of it (its nodes lie so
   near each other that windows hold all of them) is opened anew by residuals: its nodes less what they have in common with
   a pivot, met at the n-grams that are rarest inside the region. What such a region still holds together is joined exactly
   in blocks of LEAF nodes, those of its commonest label never against each other.
6. Links are labelled by least reachable node; equal sets give their label to all their documents.

Defined cases: NULL, empty and blank texts have no set and stand alone; with fewer words than n the whole sequence is the
one n-gram; rows that repeat a doc_id belong to the component of their own text; a row without doc_id links nothing and gets
the component of documents with the same set, else NULL; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from percussa.llm.common import mix64, packed, slices, stored
from percussa.llm.minhash_join import _digest, components, shingle_sets, sets_of

LEAF = 512
PIVOTS = 8
SALTS = 16
SHRINK = 0.7
SLICE = 4 << 20
HOLDS = 63


def bounds(percent: int) -> tuple[int, float]:
    """b, the largest union of n-grams in which sets that alike must be equal, and the share of n-grams a node may leave out."""
    b = -(-100 // (100 - percent)) - 1
    if b > HOLDS:
        raise ValueError("similarities above 98 percent aren't supported")
    return b, (1 - b * (100 - percent) / 100) / 2


def meeting_places(sets: list[np.ndarray], b: int) -> list[np.ndarray]:
    """Signed names of the noted parts of each sorted set; the low bits (HOLDS) tell how many n-grams a part holds.

    All sets of the list are halved together, one bit of the hash a step.
    """
    sizes = np.array([len(x) for x in sets])
    value = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    hashed = mix64(value ^ np.uint64(0x5851F42D4C957F2D))
    owners, names = [], []
    above = np.full(len(value), b, np.int64)
    for depth in range(65):
        if not len(value):
            break
        part = value >> np.uint64(64 - depth) if depth else np.zeros(len(value), np.uint64)
        head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])]))
        n = np.diff(np.concatenate([head, [len(value)]]))
        noted = (n <= b) & (above[head] >= b)
        held = np.add.reduceat(hashed, head)[noted]
        name = mix64(held + mix64((part[head][noted] << np.uint64(7)) + np.uint64(depth + 1)))
        owners.append(owner[head][noted])
        names.append((name & ~np.uint64(HOLDS)) | n[noted].astype(np.uint64))
        n = np.repeat(n, n)
        go = n >= b
        value, owner, hashed, above = value[go], owner[go], hashed[go], n[go]
    owners, names = np.concatenate(owners) if owners else np.zeros(0, np.int64), np.concatenate(names) if names else np.zeros(0, np.uint64)
    order = np.argsort(owners, kind="stable")
    cuts = np.searchsorted(owners[order], np.arange(1, len(sets)))
    return np.split(names[order].view(np.int64), cuts)


def noted(docs: DataFrame, width: int, b: int) -> DataFrame:
    """doc_id, n_shingles, node (names the set; NULL for none) and the node's meeting places, once for each batch.

    Rows without doc_id note none.
    """
    nothing = np.zeros(0, np.uint64)

    def run(batches):
        for batch in batches:
            data, offsets = packed(batch.column("text"))
            ids = batch.column("doc_id")
            named, seen = ids.is_valid().to_pylist(), set()
            for x, y in slices(offsets, SLICE):
                sets = list(shingle_sets(data[offsets[x]:offsets[y]], offsets[x:y + 1] - offsets[x], width))
                nodes = [_digest(s) if len(s) else None for s in sets]
                fresh = []
                for k, node in enumerate(nodes):
                    fresh.append(node is not None and named[x + k] and node not in seen)
                    if fresh[-1]:
                        seen.add(node)
                places = meeting_places([s if f else nothing for s, f in zip(sets, fresh)], b)
                ends = np.cumsum([0] + [len(p) for p in places]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(x, y - x), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(places)))],
                    names=["doc_id", "n_shingles", "node", "places"])
    return docs.mapInArrow(run, "doc_id long, n_shingles long, node binary, places array<long>")


def union_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _near(both: np.ndarray, n: np.ndarray, m, percent: int) -> np.ndarray:
    return 100 * both >= percent * (n + m - both)


def _joined(tables: pa.Table, percent: int) -> pa.Table:
    """Links inside a region, as few as join its components: nodes of one label or already joined aren't compared again."""
    nodes = tables.column("node").to_pylist()
    labels = np.unique(tables.column("label").to_pylist(), return_inverse=True)[1]
    found = [np.frombuffer(x, np.uint64) for x in tables.column("members").to_pylist()]
    side = np.asarray(tables.column("side"))
    size = np.array([len(x) for x in found])
    order = np.argsort(size, kind="stable")
    found, size, labels, side = [found[k] for k in order], size[order], labels[order], side[order]
    nodes = [nodes[k] for k in order]
    values, place = np.unique(np.concatenate(found), return_inverse=True)
    starts = np.cumsum(size) - size
    has = np.zeros(len(values), bool)
    a, b = [], []
    for k in range(len(nodes) - 1):
        # Sets in order of size: partners of a larger size lie in one stretch behind.
        end = int(np.searchsorted(size, 100 * size[k] // percent, side="right"))
        if end <= k + 1 or (labels[k + 1:end] == labels[k]).all():
            continue
        own = place[starts[k]:starts[k] + size[k]]
        has[own] = True
        stretch = has[place[starts[k + 1]:starts[end - 1] + size[end - 1]]]
        both = np.add.reduceat(stretch.astype(np.int64), starts[k + 1:end] - starts[k + 1])
        has[own] = False
        good = _near(both, size[k + 1:end], size[k], percent) & (side[k + 1:end] | side[k])
        for m in np.flatnonzero(good) + k + 1:
            if labels[m] != labels[k]:
                a.append(nodes[k])
                b.append(nodes[m])
                labels[labels == labels[m]] = labels[k]
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _beside(large: DataFrame, sets: DataFrame, pivots: int) -> DataFrame:
    """Sets of the nodes of large regions, each part of a region behind the region's pivots (slots below `pivots`).

    A region is dealt into SALTS parts, and each part meets all pivots of the region before its own nodes.
    """
    slot = F.pmod(F.xxhash64("node", "region"), F.lit(pivots)).cast("int")
    drawn = large.groupBy("region", slot.alias("slot")).agg(F.min_by("node", F.xxhash64(F.lit(7), "node")).alias("node"))
    drawn = drawn.select("region", "slot", "node", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(SALTS)).cast("int")
    rows = drawn.unionByName(large.select("region", F.lit(pivots).alias("slot"), "node", salt.alias("salt")))
    placed = rows.join(sets, "node").repartition("region", "salt").sortWithinPartitions("region", "salt", "slot")
    return placed.select("region", "salt", "slot", "node", "members")


def _with_pivots(batches, pivots: int):
    """(region, node, set, pivots as (slot, node, set)) of the rows of `_beside`, batch by batch."""
    at, met = None, []
    for batch in batches:
        out = []
        for region, salt, slot, node, x in zip(*(batch.column(c).to_pylist() for c in ("region", "salt", "slot", "node", "members"))):
            x = np.frombuffer(x, np.uint64)
            if (region, salt) != at:
                at, met = (region, salt), []
            if slot < pivots:
                met.append((slot, node, x))
            else:
                out.append((region, node, x, met))
        yield out


def _cut(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The Voronoi cells of the nodes of large regions: (region, node, slots, linked).

    `slots` lists the home first, then the windows; `linked` is a pivot within reach, if any.
    """
    reach = 1 - percent / 100
    count = PIVOTS

    def run(batches):
        for rows in _with_pivots(batches, count):
            out = []
            for region, node, x, pivots in rows:
                far, link = [], None
                for _, name, p in pivots:
                    place = np.minimum(np.searchsorted(p, x), len(p) - 1)
                    both = int((p[place] == x).sum())
                    far.append(1 - both / (len(x) + len(p) - both))
                    if link is None and name != node and _near(both, len(x), len(p), percent):
                        link = name
                far = np.array(far)
                home = int(far.argmin())
                window = np.flatnonzero(far <= far[home] + 2 * reach + 1e-9)
                out.append((region, node, [pivots[home][0]] + [pivots[w][0] for w in window if w != home], link))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([
                pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.list_(pa.int32())),
                pa.array(columns[3], pa.binary())], names=["region", "node", "slots", "linked"])
    return _beside(large, sets, count).mapInArrow(run, "region long, node binary, slots array<int>, linked binary")


def _exact(members: DataFrame, sets: DataFrame, key: list[str], percent: int) -> DataFrame:
    """Links (a, b) inside each group of at most 2 LEAF nodes; of rows with `side` false only pairs with the others count."""
    def run(table):
        return _joined(table, percent)
    return members.join(sets, "node").groupBy(*key).applyInArrow(run, "a binary, b binary")


def _blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside regions that pivots don't shrink, in blocks: nodes outside a region's commonest label against all.

    Nodes of the commonest label are never held against each other.
    """
    counted = members.groupBy("region", "label").agg(F.count("*").alias("n"))
    common = counted.groupBy("region").agg(F.max_by("label", F.struct("n", "label")).alias("common"), F.max("n").alias("most"),
                                           F.sum("n").alias("all")).where("most < all")
    told = members.join(common, "region").withColumn("side", F.col("label") != F.col("common"))
    n_out, n_in = F.ceil((F.col("all") - F.col("most")) / LEAF).cast("int"), F.ceil(F.col("most") / LEAF).cast("int")
    told = told.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("side"), n_out).otherwise(n_in)).cast("int"))
    outs, ins = F.sequence(F.lit(0), n_out - 1), F.sequence(F.lit(0), n_in - 1)
    cells = F.when(F.col("side"), F.concat(
        F.transform(outs, lambda o: F.struct(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j"), F.lit(True).alias("out"))),
        F.transform(ins, lambda d: F.struct(F.col("block").alias("i"), d.alias("j"), F.lit(False).alias("out"))))).otherwise(
        F.transform(outs, lambda o: F.struct(o.alias("i"), F.col("block").alias("j"), F.lit(False).alias("out"))))
    cell = ["region", "i", "j", "out"]
    return _exact(told.select("region", "node", "label", "side", F.inline(cells)), sets, cell, percent)


def _finer(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(region, node): smaller regions inside regions whose nodes all lie near a pivot p.

    The residual of x is its symmetric difference with p, and residuals differ where the sets do. Partners differ in at most
    d = |x| (1 - t) / t n-grams, so their residuals share all but d of x's, and one of the first d + 1 in any one order; the
    rarest inside the region come first. What the region has in common with p is in no residual. A residual of at most d
    n-grams need not share any: such nodes, nearly all linked with p, are a region of their own.
    """
    def run(batches):
        for rows in _with_pivots(batches, 1):
            found = [np.setxor1d(x, p[0][2], assume_unique=True) for _, _, x, p in rows]
            most = [len(x) * (100 - percent) // percent for _, _, x, _ in rows]
            # One entry without n-gram for each node whose residual may share none.
            grams = [pa.array([None] * (len(f) <= d), pa.int64()) for f, d in zip(found, most)]
            size = np.array([len(f) + len(g) for f, g in zip(found, grams)], np.int64)
            at = pa.array(np.repeat(np.arange(len(rows)), size))
            values = pa.concat_arrays([pa.array([], pa.int64()), *[a for f, g in zip(found, grams) for a in (pa.array(f.view(np.int64)), g)]])
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()).take(at), pa.array([r[1] for r in rows], pa.binary()).take(at), values,
                pa.array([len(f) for f in found], pa.int64()).take(at), pa.array(most, pa.int64()).take(at)],
                names=["region", "node", "gram", "size", "most"])

    rows = _beside(members, sets, 1).mapInArrow(run, "region long, node binary, gram long, size long, most long")
    often = rows.where("gram IS NOT NULL").groupBy("region", "gram").agg(F.count("*").alias("n")).where("n > 1")
    own = Window.partitionBy("region", "node")
    told = rows.join(often, ["region", "gram"]).withColumns({
        "rank": F.row_number().over(own.orderBy("n", "gram")), "shared": F.count("*").over(own)})
    # What one node alone has comes first and opens nothing.
    first = told.where(F.col("rank") + F.col("size") - F.col("shared") <= F.col("most") + 1)
    return first.select("region", "gram", "node").unionByName(rows.where("gram IS NULL").select("region", "gram", "node")).select(
        F.xxhash64("region", "gram").alias("region"), "node")


def ngram_join(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id of all documents that links reach."""
    b, spare = bounds(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = stored(noted(docs, width, b), "noted")
    known = every.where("node IS NOT NULL AND doc_id IS NOT NULL").select("node", "doc_id", "n_shingles")
    nodes = stored(known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size")), "nodes")
    # Numbers stand for nodes until the places that one node alone has are gone; those are counted, not kept.
    posted = every.select(F.xxhash64("node").alias("key"), F.explode("places").alias("place"))
    often = posted.groupBy("place").agg(F.count("*").alias("n")).where("n > 1").select("place")
    shared = stored(posted.join(often, "place").distinct(), "shared")
    met = shared.groupBy("place").agg(F.count("*").alias("n"), F.min("key").alias("region")).where("n > 1")
    holds = F.col("place").bitwiseAND(F.lit(HOLDS))
    told = shared.join(met, "place").join(nodes.select(F.xxhash64("node").alias("key"), "node", "size"), "key")
    own = Window.partitionBy("node")
    told = told.withColumns({"left_out": F.sum(holds).over(own.orderBy(F.desc("n"), "place")), "met": F.sum(holds).over(own)})
    kept = told.where((F.col("left_out") >= F.lit(spare) * F.col("size")) & (F.col("met") >= F.lit(2 * spare * (1 - 1e-9)) * F.col("size")))
    members = stored(kept.select("region", "node").distinct(), "regions")
    busy = members.select("node").distinct()
    where = busy.join(nodes, "node")
    sets = stored(sets_of(docs.join(where, "doc_id").select("node", "text"), width).dropDuplicates(["node"]), "sets")
    members = members.select("region", "node", F.col("node").alias("label"))
    links = []
    while True:
        count = members.groupBy("region").agg(F.count("*").alias("n"))
        sized = stored(members.join(count, "region"), "sized")
        small = sized.where((F.col("n") > 1) & (F.col("n") <= LEAF)).withColumn("side", F.lit(True))
        links.append(stored(_exact(small, sets, ["region"], percent), "links"))
        large = sized.where(F.col("n") > LEAF)
        if large.isEmpty():
            break
        cut = stored(_cut(large, sets, percent), "cut")
        links.append(cut.where("linked IS NOT NULL").select(F.col("node").alias("a"), F.col("linked").alias("b")))
        labels = components(busy, union_of(links))
        cells = cut.join(labels, "node").select("region", "node", "label", F.explode("slots").alias("slot"))
        cells = stored(cells.withColumn("cell", F.xxhash64("region", "slot")), "cells")
        told = cells.groupBy("region", "cell").agg(F.count("*").alias("held"), F.min("label").alias("x"), F.max("label").alias("y"))
        whole = large.groupBy("region").agg(F.count("*").alias("n"))
        own = Window.partitionBy("region")
        told = stored(told.join(whole, "region").withColumns({
            "stuck": F.max(F.col("held") > SHRINK * F.col("n")).over(own), "first": F.min("x").over(own), "last": F.max("y").over(own)}), "told")
        stuck = large.join(told.where("stuck AND first < last").select("region").distinct(), "region", "left_semi")
        fine = stored(_finer(stuck.select("region", "node"), sets, percent), "fine")
        links.append(stored(_blocks(fine.join(labels, "node"), sets, percent), "links"))
        going = told.where(~F.col("stuck") & (F.col("x") < F.col("y"))).select("cell")
        members = cells.join(going, "cell").select(F.col("cell").alias("region"), "node", "label")
    links = union_of(links)
    labels = components(busy, links)
    least = labels.join(nodes, "node").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    reached = labels.join(least, "label").select("node", "component_id")
    own = nodes.select("node", F.col("doc_id").alias("own"))
    return (every.join(own, "node", "left").join(reached, "node", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "own", "doc_id").alias("component_id")))
