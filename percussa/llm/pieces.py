"""SentencePiece encoding and decoding: a batched numpy Viterbi over the pieces and scores of a model file.

Text becomes units (a word with the white space before it), which no piece crosses. Distinct units of equal length are
the rows of one matrix and advance together: at each place the hashes of all substrings that end there probe the sorted
keys of the pieces, and the best sum of scores so far decides; a column of back pointers is stored. A bounded table
keeps the units seen so far.

The result is the segmentation with the highest sum of scores (of equal ones the one whose last piece is longest, as in
the library's unigram model). For a model that was trained by merging, the library's own merge order may cut a word
differently; the scores and ids are the model's either way, and decoding gives the text back.

Defined cases: NULL counts as empty and has no ids; a character without a piece becomes the ids of its UTF-8 bytes, or
the unknown id where the model has none; the mark of white space (U+2581) in a text decodes as a space, as with the
library; extra columns are dropped; an empty table gives an empty result; texts and units may have any length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from percussa.llm.common import Recent, mix64, worker_keeps

MARK = "▁"
UNITS = 600_000           # units that a worker keeps
ROWS = 1 << 20            # characters of one matrix
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Pieces of a model file, ready for probing."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.unknown = model.unk_id()
        self.byte = np.full(256, -1, np.int64)
        self.bytes_of: list[bytes] = []
        plain = []
        for k in range(n):
            name = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte[int(name[3:5], 16)] = k
                self.bytes_of.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.bytes_of.append(b"")
            else:
                plain.append((name, k, model.get_score(k)))
                self.bytes_of.append(name.encode())
        self.longest = max(len(p) for p, _, _ in plain)
        # Units may be cut at white space only if no piece has any behind another character.
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in plain)
        self.powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(self.longest, _BASE)]))
        keys = np.array([self._key(p) for p, _, _ in plain], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ids = np.array([k for _, k, _ in plain])[order]
        self.scores = np.array([s for _, _, s in plain], np.float32)[order]
        self.unknown_score = np.float32(self.scores.min() - 10)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.unit = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if self.apart else re.compile("(?s:.+)")

    def _key(self, piece: str) -> np.uint64:
        total = np.zeros(1, np.uint64)
        for c in piece:
            total = total * _BASE + np.uint64(ord(c) + 1)
        return mix64(total + np.uint64(len(piece)))[0]

    def best(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Back pointers of rows of equal length: the length and the id of the best piece that ends at each place."""
        n, size = codes.shape
        hashes = np.zeros((size + 1, n), np.uint64)
        for j in range(size):
            hashes[j + 1] = hashes[j] * _BASE + (codes[:, j].astype(np.uint64) + np.uint64(1))
        total = np.full((size + 1, n), -np.inf, np.float32)
        total[0] = 0
        lengths, ids = np.ones((size + 1, n), np.int32), np.full((size + 1, n), -1, np.int32)
        for j in range(1, size + 1):
            got, length, which = total[j], lengths[j], ids[j]
            known = np.zeros(n, bool)
            for m in range(min(self.longest, j), 0, -1):
                key = mix64(hashes[j] - hashes[j - m] * self.powers[m] + np.uint64(m))
                hit = np.flatnonzero(self.maybe[(key >> np.uint64(44)).astype(np.int64)])
                if not len(hit):
                    continue
                at = np.minimum(np.searchsorted(self.keys, key[hit]), len(self.keys) - 1)
                hit, at = (x[self.keys[at] == key[hit]] for x in (hit, at))
                if m == 1:
                    known[hit] = True
                value = total[j - m][hit] + self.scores[at]
                more = value > got[hit]
                hit, at = hit[more], at[more]
                got[hit], length[hit], which[hit] = value[more], m, self.ids[at]
            # A character without a piece of its own stands as unknown, at the least score.
            value = total[j - 1] + self.unknown_score
            rare = ~known & (value > got)
            got[rare], length[rare], which[rare] = value[rare], 1, -1
        return lengths, ids

    def encode_units(self, units: list[str]) -> dict[str, list[int]]:
        """Ids of distinct units."""
        by_size: dict[int, list[str]] = {}
        for u in units:
            by_size.setdefault(len(u), []).append(u)
        out = {}
        for size, some in by_size.items():
            step = max(1, ROWS // size)
            for begin in range(0, len(some), step):
                part = some[begin:begin + step]
                codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), size)
                lengths, ids = self.best(codes)
                # All rows walk back together.
                at, steps = np.full(len(part), size), []
                rows = np.arange(len(part))
                while (at > 0).any():
                    live = at > 0
                    steps.append((np.where(live, ids[at, rows], -2), at.copy()))
                    at = np.where(live, at - lengths[at, rows], 0)
                table = np.stack([s[0] for s in steps[::-1]], axis=1)
                ends = np.stack([s[1] for s in steps[::-1]], axis=1)
                for u, row, end in zip(part, table.tolist(), ends.tolist()):
                    out[u] = [x for x in row if x != -2] if -1 not in row else self._spelled(u, row, end)
        return out

    def _spelled(self, unit: str, row: list[int], ends: list[int]) -> list[int]:
        found, unknown = [], False
        for x, end in zip(row, ends):
            if x == -2:
                continue
            if x >= 0:
                found.append(x)
            else:
                spelled = self.byte[list(unit[end - 1].encode("utf-8", "surrogatepass"))]
                if (spelled >= 0).all():
                    found += spelled.tolist()
                elif not unknown:
                    found.append(self.unknown)
            unknown = x == -1
        return found

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.bytes_of[k] for k in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


class Encoder:
    def __init__(self, pieces: Pieces, kept: int = UNITS):
        self.pieces, self.seen = pieces, Recent(kept)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = [self.pieces.unit.findall((MARK + t).replace(" ", MARK)) if t else [] for t in texts]
        seen = self.seen.turn()
        new = list(self.seen.missing({u for units in cut for u in units}))
        if new:
            seen.update((u, np.array(x, np.int32).tobytes()) for u, x in self.pieces.encode_units(new).items())
        return [np.frombuffer(b"".join([seen[u] for u in units]), np.int32) for units in cut]


def encode(docs: DataFrame, path: str, check: bool = True) -> DataFrame:
    """doc_id, ids and, if `check` is set, `decoded`: the text that the ids give back, else NULL."""
    def run(batches):
        encoder = worker_keeps(f"pieces {path}", lambda: Encoder(Pieces(path)))
        pieces = encoder.pieces
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for begin in range(0, len(texts), 512):
                some = ["" if t is None else t for t in texts[begin:begin + 512]]
                ids = encoder(some)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(begin, len(some)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))),
                    pa.array([pieces.decode(x.tolist()) if check else None for x in ids], pa.string())],
                    names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text from (doc_id, ids); NULL ids give an empty text."""
    def run(batches):
        pieces = Pieces(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([pieces.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())],
                names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
