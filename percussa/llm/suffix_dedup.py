"""Repeated byte strings across documents, found by suffix arrays of shards.

Each byte is removed that lies in a string of `length` bytes which also starts in a document with a smaller doc_id.

1. Documents are dealt into shards of about SHARD bytes. Every window of `length` bytes has an anchor: the least hash
   of the GRAM-byte strings inside it. Equal windows have equal anchors, wherever they lie.
2. The distinct anchors of each shard meet by value; those that several shards hold go back to them.
3. A shard keeps the stretches whose anchors another shard or another of its documents holds, builds their suffix
   array (Larsson-Sadakane) and common prefixes (Kasai), and so settles what its own documents repeat. The windows of
   the smallest document of each class, once a shard, go on as pieces to the bucket of their anchor.
4. A bucket merges the sorted windows of its shards: binary search places each shard's windows among all others, and
   bytes decide equality. Bits of what a smaller document holds elsewhere go back.
5. Each shard cuts its texts.

Nothing grows with the size of a group of copies: a shard sends a repeated string once.

Defined cases: NULL text counts as empty; a row without doc_id keeps its text and removes nothing; rows that repeat a
doc_id do not remove each other's bytes; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from percussa.llm.common import mix64, packed, pieces_of, slices, total_bytes, words64
from percussa.llm.suffixes import common_prefixes, suffix_array

SHARD = 3 << 20       # bytes of text in a shard
GRAM = 24             # bytes of an anchor; long enough that few unlike windows share one
SLICE = 1 << 20       # bytes hashed at a time
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _rolled(at8: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the `length` bytes at each of the places; bytes behind the end count as zeros."""
    out = np.zeros(len(places), np.uint64)
    last = len(at8) - 1
    for step in sorted({*range(0, length - 7, 8), length - 8}):
        out = out * np.uint64(0x9E3779B97F4A7C15) + at8[np.minimum(places + step, last)]
        out ^= out >> np.uint64(29)
    return mix64(out)


def _anchors(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """For each position the anchor of the window that starts there; NONE where it would leave its document."""
    n = len(data)
    out = np.full(n, NONE)
    span = length - GRAM + 1
    for begin in range(0, n, SLICE):
        part = data[begin:begin + SLICE + length]
        best = _rolled(words64(part), np.arange(len(part)), GRAM)
        width = 1
        while width < span:
            ahead = min(width, span - width)
            rest = max(0, len(best) - ahead)
            best[:rest] = np.minimum(best[:rest], best[ahead:])
            width += ahead
        m = min(SLICE, n - begin)
        out[begin:begin + m] = best[:m]
    # The last length - 1 starts of each document have no whole window.
    begins = np.concatenate([[0], ends[:-1]])
    tail = np.minimum(length - 1, ends - begins)
    many = np.repeat(ends - tail, tail) + (np.arange(tail.sum()) - np.repeat(np.cumsum(tail) - tail, tail))
    whole = out != NONE
    out &= np.uint64((1 << 48) - 1)
    out[~whole] = NONE
    out[many] = NONE
    return out


def _narrow(anchors: np.ndarray) -> bytes:
    """Anchors in the 6 bytes that they have."""
    return anchors.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _rows_in_order(shard: pa.Table) -> pa.Table:
    return shard.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _shard_arrays(shard: pa.Table, length: int):
    """Text bytes, offsets, dense rank of doc_id for each document and the anchors of all windows of a sorted shard."""
    data, offsets = packed(shard.column("text"))
    ids = shard.column("doc_id").combine_chunks()
    known = np.asarray(ids.is_valid())
    values = np.asarray(ids.fill_null(0)).astype(np.int64)
    anchors = _anchors(data, offsets[1:], length)
    for k in np.flatnonzero(~known):
        anchors[offsets[k]:offsets[k + 1]] = NONE
    return data, offsets, values, anchors


def _runs(anchors: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of neighbouring windows of one document with the same anchor: first window, count, document."""
    n = len(anchors)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.concatenate([[True], anchors[1:] != anchors[:-1]])
    cut[offsets[:-1][offsets[:-1] < n]] = True
    first = np.flatnonzero(cut)
    count = np.diff(np.concatenate([first, [n]]))
    good = anchors[first] != NONE
    first, count = first[good], count[good]
    return first, count, np.searchsorted(offsets, first, side="right") - 1


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All positions of the stretches, one after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _squeezed(values: np.ndarray) -> bytes:
    """Bytes or integers, compressed; integers by their differences."""
    if values.dtype == np.uint8:
        return b"b" + len(values).to_bytes(8, "little") + pa.compress(values.tobytes(), codec="zstd", asbytes=True)
    steps = np.diff(values.astype(np.int64), prepend=0)
    return b"i" + steps.nbytes.to_bytes(8, "little") + pa.compress(steps.tobytes(), codec="zstd", asbytes=True)


def _opened(data: bytes) -> np.ndarray:
    plain = pa.decompress(data[9:], int.from_bytes(data[1:9], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(plain, np.uint8) if data[:1] == b"b" else np.cumsum(np.frombuffer(plain, np.int64))


def _bucket_rows(values: np.ndarray, buckets: int):
    """Order of `values` by bucket and where each bucket's part begins."""
    bucket = (values % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    held, begin = np.unique(bucket[order], return_index=True)
    return order, held, np.concatenate([begin, [len(values)]])


def suffix_dedup(docs: DataFrame, length: int = 50, shard_bytes: int = SHARD) -> DataFrame:
    """doc_id, text_bytes (the input), kept (the bytes that stay), spans (removed runs as byte offsets [begin, end))."""
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = pieces_of(total_bytes(docs, "text"), shard_bytes)
    buckets = shards
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))

    def anchors_of(key, shard):
        data, offsets, _, anchors = _shard_arrays(_rows_in_order(shard), length)
        first, _, _ = _runs(anchors, offsets)
        found = np.unique(anchors[first])
        order, held, begin = _bucket_rows(found, buckets)
        found = found[order]
        return pa.table({
            "bucket": pa.array(held, pa.int64()), "shard": pa.array(np.full(len(held), key[0].as_py()), pa.int64()),
            "anchors": pa.array([_narrow(found[a:b]) for a, b in zip(begin, begin[1:])], pa.binary())})

    def shared_anchors(bucket):
        lists = [_wide(x) for x in bucket.column("anchors").to_pylist()]
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        every = np.concatenate(lists)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        same = every[1:] == every[:-1]
        shared = np.zeros(len(every), bool)
        shared[1:] |= same
        shared[:-1] |= same
        every, owner = every[shared], owner[shared]
        order = np.argsort(owner, kind="stable")
        every, owner = every[order], owner[order]
        who, begin = np.unique(owner, return_index=True)
        names = np.asarray(bucket.column("shard"))
        begin = np.concatenate([begin, [len(owner)]])
        return pa.table({"shard": pa.array(names[who], pa.int64()),
                         "anchors": pa.array([_narrow(every[a:b]) for a, b in zip(begin, begin[1:])], pa.binary())})

    def settle(key, shard, shared):
        name = key[0].as_py()
        data, offsets, ids, anchors = _shard_arrays(_rows_in_order(shard), length)
        rank = np.unique(ids, return_inverse=True)[1] if len(ids) else np.zeros(0, np.int64)
        first, count, doc = _runs(anchors, offsets)
        value = anchors[first]
        elsewhere = np.unique(_wide(b"".join(shared.column("anchors").to_pylist())))
        at = np.minimum(np.searchsorted(elsewhere, value), max(len(elsewhere) - 1, 0))
        far = elsewhere[at] == value if len(elsewhere) else np.zeros(len(value), bool)
        order = np.lexsort((rank[doc], value)) if len(value) else np.zeros(0, np.int64)
        v, d = value[order], rank[doc][order]
        starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
        near = np.zeros(len(value), bool)
        if len(starts):
            size = np.diff(np.concatenate([starts, [len(v)]]))
            several = d[starts] != d[starts + size - 1]
            near[order] = np.repeat(several, size)
        use = near | far
        first, count, doc, value, far = first[use], count[use], doc[use], value[use], far[use]
        # Stretches that touch make one string; a byte that UTF-8 never has stands between strings.
        joins = np.zeros(len(first), bool)
        if len(first):
            joins[1:] = (first[1:] == first[:-1] + count[:-1]) & (doc[1:] == doc[:-1])
        heads = np.flatnonzero(~joins)
        begin = first[heads]
        windows = np.add.reduceat(count, heads) if len(heads) else np.zeros(0, np.int64)
        size = windows + length - 1
        text = np.full(int(size.sum()) + len(size), 0xFF, np.uint8)
        into = np.cumsum(size + 1) - (size + 1)
        text[_spread(into, size)] = data[_spread(begin, size)]
        starts = _spread(into, windows)                    # places of whole windows in `text`
        origin = _spread(begin, windows)                   # and in the shard
        del shard
        sa = suffix_array(text, length)
        lcp = common_prefixes(text, sa, length)
        window_at = np.full(len(text), -1, np.int64)
        window_at[starts] = np.arange(len(starts))
        which = window_at[sa]
        whole = which >= 0
        which, lcp = which[whole], lcp[whole]
        group = np.cumsum(lcp < length) - 1 if len(lcp) else np.zeros(0, np.int64)
        owner = rank[np.searchsorted(offsets, origin, side="right") - 1] if len(origin) else np.zeros(0, np.int64)
        least = np.zeros(0, np.int64)
        opens = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        if len(opens):
            least = np.minimum.reduceat(owner[which], opens)
        gone = np.zeros(len(starts), bool)
        if len(opens):
            of_window = np.repeat(least, np.diff(np.concatenate([opens, [len(group)]])))
            gone[which] = owner[which] > of_window
        marks = np.zeros(len(data), np.uint8)
        marks[origin[gone]] = 1
        rows = {"bucket": [], "shard": [], "own": [], "ids": [], "starts": [], "counts": [], "text": []}

        def add(bucket, own, ids_, starts_, counts_, body):
            for k, x in zip(rows, (bucket, name, own, ids_, starts_, counts_, body)):
                rows[k].append(x)

        if gone.any():
            add(name % buckets, np.packbits(marks).tobytes(), b"", b"", b"", b"")
        # What stays and may lie elsewhere goes on, cut at anchors and at windows that are gone already.
        if far.any() and len(starts):
            stays = np.zeros(len(data), bool)
            stays[origin[~gone]] = True
            p = _spread(first[far], count[far])
            run = np.repeat(np.flatnonzero(far), count[far])
            ok = stays[p]
            p, run = p[ok], run[ok]
            if len(p):
                head = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1] + 1) | (run[1:] != run[:-1])]))
                many = np.diff(np.concatenate([head, [len(p)]]))
                p, run = p[head], run[head]
                order, held, at = _bucket_rows(value[run], buckets)
                p, many, run = p[order], many[order], run[order]
                who = ids[doc[run]]
                for b, x, y in zip(held, at, at[1:]):
                    add(int(b), b"", _squeezed(who[x:y]), _squeezed(p[x:y]), _squeezed(many[x:y]),
                        _squeezed(data[_spread(p[x:y], many[x:y] + length - 1)]))
        return pa.table(rows, schema=pieces_schema)

    def merge(bucket):
        own = bucket.column("own").to_pylist()
        shard = np.asarray(bucket.column("shard"))
        out_shard, out_own, out_starts, out_counts, out_bits = [], [], [], [], []
        for k in [k for k, x in enumerate(own) if x]:
            out_shard.append(int(shard[k]))
            out_own.append(own[k])
            out_starts.append(b"")
            out_counts.append(b"")
            out_bits.append(b"")
        lots = [k for k, x in enumerate(own) if not x]
        if lots:
            ids, counts, texts = ([_opened(bucket.column(c)[k].as_py()) for k in lots] for c in ("ids", "counts", "text"))
            count = np.concatenate(counts)
            text = np.concatenate(texts)
            into = np.cumsum(count + length - 1) - (count + length - 1)
            where = _spread(into, count)
            owner = np.repeat(np.concatenate(ids), count)
            lot = np.repeat(np.arange(len(lots), dtype=np.int32), [int(x.sum()) for x in counts])
            del ids, texts
            hidden = _held_by_smaller(text, where, owner, lot, length)
            at = 0
            for k, c in zip(lots, counts):
                m = int(c.sum())
                if hidden[at:at + m].any():
                    out_shard.append(int(shard[k]))
                    out_own.append(b"")
                    out_starts.append(bucket.column("starts")[k].as_py())
                    out_counts.append(bucket.column("counts")[k].as_py())
                    out_bits.append(np.packbits(hidden[at:at + m]).tobytes())
                at += m
        return pa.table({"shard": out_shard, "own": out_own, "starts": out_starts, "counts": out_counts,
                         "bits": out_bits}, schema=answers_schema)

    def cut(shard, answers):
        shard = _rows_in_order(shard)
        data, offsets = packed(shard.column("text"))
        n = len(data)
        marks = np.zeros(n + 1, bool)
        for row in answers.to_pylist():
            if row["own"]:
                marks[:n] |= np.unpackbits(np.frombuffer(row["own"], np.uint8), count=n).astype(bool)
            else:
                count = _opened(row["counts"])
                p = _spread(_opened(row["starts"]), count)
                bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=len(p)).astype(bool)
                marks[p[bits]] = True
        change = np.zeros(n + length + 1, np.int32)
        hit = np.flatnonzero(marks)
        change[hit] += 1
        change[hit + length] -= 1
        covered = np.cumsum(change)[:n] > 0
        kept, spans = [], []
        for a, b in zip(offsets, offsets[1:]):
            c = covered[a:b]
            if not c.any():
                kept.append(data[a:b].tobytes())
                spans.append([])
                continue
            kept.append(data[a:b][~c].tobytes())
            edge = np.flatnonzero(np.diff(np.concatenate([[0], c.view(np.int8), [0]])))
            spans.append([{"begin": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)])
        return pa.table({"doc_id": shard.column("doc_id"),
                         "n_bytes": pa.array(np.diff(offsets), pa.int64()),
                         "kept": pa.array(kept, pa.binary()),
                         "spans": pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))})

    pieces_schema = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("own", pa.binary()), ("ids", pa.binary()),
                               ("starts", pa.binary()), ("counts", pa.binary()), ("text", pa.binary())])
    answers_schema = pa.schema([("shard", pa.int64()), ("own", pa.binary()), ("starts", pa.binary()),
                                ("counts", pa.binary()), ("bits", pa.binary())])
    anchors = dealt.groupBy("shard").applyInArrow(anchors_of, "bucket long, shard long, anchors binary")
    shared = anchors.groupBy("bucket").applyInArrow(shared_anchors, "shard long, anchors binary")
    pieces = dealt.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(
        settle, "bucket long, shard long, own binary, ids binary, starts binary, counts binary, text binary")
    answers = pieces.groupBy("bucket").applyInArrow(
        merge, "shard long, own binary, starts binary, counts binary, bits binary")
    return dealt.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(
        cut, "doc_id long, n_bytes long, kept binary, spans array<struct<begin:long,end:long>>")


def _held_by_smaller(text: np.ndarray, where: np.ndarray, owner: np.ndarray, lot: np.ndarray, length: int) -> np.ndarray:
    """Which windows (at `where` in `text`) also lie in a document with a smaller id.

    The windows of each lot (a shard) are sorted by a hash of their bytes; the sorted runs are merged, and binary search
    places each run in the merged order, where the least id of equal windows stands. Bytes then confirm each match; if
    two different windows ever have one hash, the bytes themselves take its place.
    """
    at8 = words64(text)
    key = _rolled(at8, where, length)
    edges = np.flatnonzero(np.concatenate([[True], lot[1:] != lot[:-1], [True]]))
    order = np.concatenate([a + np.argsort(key[a:b]) for a, b in zip(edges, edges[1:])])
    merged = np.sort(key[order], kind="stable")
    merged = merged[np.concatenate([[True], merged[1:] != merged[:-1]])]
    place = np.empty(len(key), np.int64)
    place[order] = np.searchsorted(merged, key[order])
    least = np.full(len(merged), np.iinfo(np.int64).max)
    np.minimum.at(least, place, owner)
    hidden = owner > least[place]
    holder = np.empty(len(merged), np.int64)
    mine = np.flatnonzero(~hidden)
    holder[place[mine]] = where[mine]
    hit = np.flatnonzero(hidden)
    for step in sorted({*range(0, length - 7, 8), length - 8}):
        if (at8[where[hit] + step] != at8[holder[place[hit]] + step]).any():
            return _held_by_bytes(text, where, owner, length)
    return hidden


def _held_by_bytes(text: np.ndarray, where: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """The same by the bytes of the windows alone."""
    least: dict[bytes, int] = {}
    whole = text.tobytes()
    for at, who in zip(where.tolist(), owner.tolist()):
        window = whole[at:at + length]
        least[window] = min(who, least.get(window, who))
    return np.array([who > least[whole[at:at + length]] for at, who in zip(where.tolist(), owner.tolist())], bool)
