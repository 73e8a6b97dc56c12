"""Token ids as directly addressable codes: chunk levels, continuation bitmaps and rank directories.

A file holds the documents of a range of doc_id. Each id is cut into bytes: level 0 has the low byte of every id and a
bitmap that says which ids go on; level 1 has the next byte of those, and so on. Every bitmap has a directory with the
number of set bits before each BLOCK bits, so the place of a token's next byte is one directory entry and a few
counted words away: any token is read without decoding others.

Texts are cut at single spaces between printable characters, where the byte-level pre-tokenizer always cuts; the
library encodes each distinct piece once, and a bounded table keeps the pieces seen so far. Added tokens of the
tokenizer file are recognised, as the library does unless told otherwise; a text that holds one is encoded whole.

Texts are encoded where they are read; their ids move to ranges of doc_id and are streamed, in order, to files of about
FILE tokens; the table of reports names the files that count, and gives each its first token's place among all.

Defined cases: NULL counts as the empty text, which is its end id alone; a NULL doc_id sorts first; rows that repeat a
doc_id stand side by side, by text; an empty table makes no file; extra columns are dropped; a text of any length lies
whole in one file.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from percussa.llm.common import Recent, file_system, range_cells, scratch, stored, worker_keeps, write_file

FILE = 4 << 20            # tokens in a file
BLOCK = 512               # bits between two entries of a rank directory
PIECES = 700_000          # pieces that a worker keeps
MAGIC = b"DACs0001"
JOINED = 4096             # pieces encoded at a time
_WHOLE = re.compile(r" [!-~À-ÿ](?:[^\s]*[!-~À-ÿ])?")
_MARKED = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]")
_CUT = re.compile(r"(?<=[!-~À-ÿ]) (?=[!-~À-ÿ])")


def pack(ids: np.ndarray) -> bytes:
    """The levels of an array of ids (unsigned 32-bit)."""
    out, rest = [np.uint64(len(ids)).tobytes()], ids.astype(np.uint32)
    levels = max(1, (int(ids.max()).bit_length() + 7) // 8) if len(ids) else 1
    out.append(np.uint64(levels).tobytes())
    for level in range(levels):
        out.append((rest & 0xFF).astype(np.uint8).tobytes())
        rest = rest >> 8
        if level + 1 < levels:
            more = rest > 0
            bits = np.packbits(more, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
            counts = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
            out += [bits.tobytes(), np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32).tobytes()]
            rest = rest[more]
    return b"".join(out)


class Codes:
    """Packed ids: `codes[places]` and `codes.span(a, b)` read tokens where they lie."""

    def __init__(self, data: bytes, offset: int = 0):
        n, levels = (int(x) for x in np.frombuffer(data, np.uint64, 2, offset))
        self.n, self.chunks, self.bits, self.before, at = n, [], [], [], offset + 16
        for level in range(levels):
            self.chunks.append(np.frombuffer(data, np.uint8, n, at))
            at += n
            if level + 1 < levels:
                blocks = -(-n // BLOCK)
                self.bits.append(np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at))
                at += blocks * BLOCK // 8
                self.before.append(np.frombuffer(data, np.uint32, blocks + 1, at))
                at += 4 * (blocks + 1)
                n = int(self.before[-1][-1])
        self.end = at

    def _rank(self, level: int, place: np.ndarray) -> np.ndarray:
        """Set bits of a bitmap before each place."""
        block = place // BLOCK
        held = self.bits[level].reshape(-1, BLOCK // 8)[block]
        inside = (place % BLOCK)[:, None] - 8 * np.arange(BLOCK // 8)
        mask = (1 << np.clip(inside, 0, 8)) - 1
        return self.before[level][block].astype(np.int64) + np.bitwise_count(held & mask.astype(np.uint8)).sum(axis=1, dtype=np.int64)

    def __getitem__(self, places) -> np.ndarray:
        """Ids at an array of places."""
        place = np.atleast_1d(np.asarray(places, np.int64))
        out, live = np.zeros(len(place), np.uint32), np.arange(len(place))
        for level, chunk in enumerate(self.chunks):
            out[live] |= chunk[place].astype(np.uint32) << np.uint32(8 * level)
            if level < len(self.bits):
                more = (self.bits[level][place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                live, place = live[more], self._rank(level, place[more])
        return out

    def span(self, begin: int, end: int) -> np.ndarray:
        """Ids of the places from `begin` to before `end`: one rank for each level."""
        out, live, n = np.zeros(end - begin, np.uint32), np.arange(end - begin), end - begin
        for level, chunk in enumerate(self.chunks):
            out[live] |= chunk[begin:begin + n].astype(np.uint32) << np.uint32(8 * level)
            if level < len(self.bits) and n:
                first = begin >> 3
                bits = np.unpackbits(self.bits[level][first:((begin + n - 1) >> 3) + 1], bitorder="little")
                more = bits[begin - 8 * first:begin - 8 * first + n].astype(bool)
                begin = int(self._rank(level, np.array([begin]))[0])
                live, n = live[more], int(more.sum())
            elif not n:
                break
        return out


def file_bytes(ids: list[int | None], counts: np.ndarray, tokens: np.ndarray) -> bytes:
    """One file: doc_ids and their presence, token counts, then the codes."""
    known = np.array([x is not None for x in ids], np.uint8)
    names = np.array([0 if x is None else x for x in ids], np.int64)
    return b"".join([MAGIC, np.uint64(len(ids)).tobytes(), names.tobytes(), known.tobytes(),
                     counts.astype(np.uint64).tobytes(), pack(tokens)])


def open_file(data: bytes) -> tuple[list[int | None], np.ndarray, Codes]:
    """doc_ids, token counts and codes of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of token codes")
    n = int(np.frombuffer(data, np.uint64, 1, 8)[0])
    names = np.frombuffer(data, np.int64, n, 16)
    known = np.frombuffer(data, np.uint8, n, 16 + 8 * n)
    counts = np.frombuffer(data, np.uint64, n, 16 + 9 * n).astype(np.int64)
    return [int(x) if k else None for x, k in zip(names, known)], counts, Codes(data, 16 + 17 * n)


class Encoder:
    """Encodes texts with a tokenizers file; the bytes of a text's ids.

    `added` recognises the file's added tokens, the library's default; without it their text is cut like any other.
    """

    def __init__(self, path: str, kept: int = PIECES, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        tokens = self.tokenizer.get_added_tokens_decoder().values() if added else ()
        self.added = re.compile("|".join(re.escape(t.content) for t in tokens)) if tokens else None
        # A token that is sought in the normalized text can stand in a text that doesn't hold it literally.
        if self.tokenizer.normalizer is not None and any(t.normalized for t in tokens):
            self.added = re.compile("")
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.seen = Recent(kept)
        # Joining pieces needs a tokenizer with one id for a line feed.
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 and not any("\n" in t.content for t in tokens) else -1

    def __call__(self, texts: list[str]) -> list[bytes]:
        whole = [k for k, x in enumerate(texts) if self.added.search(x)] if self.added else []
        if not whole:
            return self._pieced(texts)
        out = self._pieced(["" if self.added.search(x) else x for x in texts])
        for k, e in zip(whole, self.tokenizer.encode_batch([texts[k] for k in whole], add_special_tokens=False)):
            out[k] = np.array(e.ids, self.kind).tobytes()
        return out

    def _pieced(self, texts: list[str]) -> list[bytes]:
        cut = []
        for text in texts:
            parts = _CUT.split(text)
            parts[1:] = [" " + x for x in parts[1:]]
            cut.append(parts)
        seen = self.seen.turn()
        new = self.seen.missing({x for parts in cut for x in parts})
        # A mark behind a word is a token of its own: the word may be known, or serve others.
        marked = [x for x in new if _MARKED.fullmatch(x)]
        new.difference_update(marked)
        new |= self.seen.missing({x[:-1] for x in marked} | {x[-1] for x in marked})
        whole = [x for x in new if _WHOLE.fullmatch(x)]
        for begin in range(0, len(whole), JOINED):
            # A line feed between two pieces is a token of its own; one call then encodes many pieces.
            some = whole[begin:begin + JOINED]
            ids = np.array(self.tokenizer.encode("\n".join(some) + "\n", add_special_tokens=False).ids, self.kind)
            ends = np.flatnonzero(ids == self.feed)
            if len(ends) == len(some):
                seen.update(zip(some, (x[1:].tobytes() if k else x.tobytes() for k, x in enumerate(np.split(ids, ends)))))
        left = [x for x in new if x not in seen]
        for begin in range(0, len(left), JOINED):
            some = left[begin:begin + JOINED]
            for x, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False)):
                seen[x] = np.array(e.ids, self.kind).tobytes()
        for x in marked:
            seen[x] = seen[x[:-1]] + seen[x[-1]]
        return [b"".join([seen[x] for x in parts]) for parts in cut]


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, tie, cell and the ids (with the end id) of each text as bytes of 2 or 4 each."""
    def run(batches):
        encode = worker_keeps(f"codes {path}", lambda: Encoder(path, added=True))
        last = np.array([end_id], encode.kind).tobytes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for begin in range(0, len(texts), 256):
                some = ["" if x is None else x for x in texts[begin:begin + 256]]
                ids = [x + last for x in encode(some)]
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(begin, len(some)) for c in ("doc_id", "tie", "cell")),
                    pa.array([encode.kind.itemsize] * len(some), pa.int32()), pa.array(ids, pa.binary())],
                    names=["doc_id", "tie", "cell", "width", "ids"])

    return docs.mapInArrow(run, "doc_id long, tie long, cell long, width int, ids binary")


def write_codes(docs: DataFrame, folder: str, path: str, end_id: int = 2, file_tokens: int = FILE) -> DataFrame:
    """Writes the files in the shared folder; returns file, documents, tokens and start, the tokens of all files before."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("cell", range_cells(docs, "doc_id", 4 * file_tokens))
    # Texts become ids before they move to the ranges.
    ranged = encoded(docs, path, end_id).repartition("cell").sortWithinPartitions("cell", F.col("doc_id").asc_nulls_first(), "tie")

    def write(batches):
        names, parts, size, turn, cell = [], [], 0, 0, None

        def flush():
            counts = np.array([len(x) for x in parts], np.int64)
            name = write_file(folder, f"codes-{cell:06d}-{turn:06d}", file_bytes(names, counts, np.concatenate(parts)))
            row = pa.RecordBatch.from_pydict({"cell": [cell], "turn": [turn], "file": [name], "documents": [len(names)],
                                              "tokens": [int(counts.sum())]})
            names.clear()
            parts.clear()
            return row

        for batch in batches:
            for doc_id, at, width, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "cell", "width", "ids"))):
                if names and (at != cell or size >= file_tokens):
                    yield flush()
                    size, turn = 0, turn + 1 if at == cell else 0
                cell = at
                names.append(doc_id)
                parts.append(np.frombuffer(ids, f"<u{width}").astype(np.uint32))
                size += len(parts[-1])
        if names:
            yield flush()

    files = stored(ranged.select("doc_id", "cell", "width", "ids").mapInArrow(
        write, "cell long, turn long, file string, documents long, tokens long"), "files")
    before = Window.orderBy("cell", "turn").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", "documents", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))


def read_codes(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files (file, start)."""
    def read(batches):
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                where, path = file_system(name)
                with where.open_input_file(path) as handle:
                    ids, counts, codes = open_file(handle.read())
                ends = np.cumsum(counts)
                sums = [zlib.crc32(codes.span(int(e - c), int(e)).astype("<u4").tobytes()) for c, e in zip(counts, ends)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                    pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file", "start").repartition(parts, "file").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def coded(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Encodes, writes and reads back: doc_id, start, n_tokens, ids_crc32."""
    return read_codes(write_codes(docs, scratch(docs.sparkSession, "codes"), path, end_id))
