"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of lexicon entries by class of weight, how near they stand to second-person words, shares of
capitals, of punctuation, of words with digits or symbols inside (obfuscation), of stretched letters, and word counts.
The lexicon, the trees and the calibration are fitted on a bounded sample of labelled rows (FIT_ROWS, by a hash of
doc_id); scoring reads every whole text once, in Arrow batches. Lexicon entries are beginnings of words in UTF-8 bytes
(a whole word counts as one with a space behind it), so that inflected forms are caught.

Defined cases: NULL and empty texts have zero features and a score as any other; labels of rows that repeat a doc_id
count as the largest; without both classes among the labels every score is the share of toxic labels (0 without any);
an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from percussa.llm.common import packed, slices, words64

FIT_ROWS = 6000           # labelled rows that the model is fitted on, at most
LEXICON = 4000            # entries
PREFIX = (4, 5, 6, 8)     # bytes of an entry
SLICE = 1 << 20
#: Second-person words; fixed values.
SECOND_PERSON = ("you", "your", "yours", "u", "du", "dich", "dir", "dein", "deine", "tu", "te", "toi", "ton", "ta", "tes",
                 "vous", "votre", "usted", "ustedes", "ti", "tuyo", "vosotros")
NEAR = 6                  # words


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def _cut_words(data: np.ndarray, offsets: np.ndarray):
    """Begins and ends of words and the first word of each text."""
    gap = np.zeros(256, bool)
    gap[[9, 10, 11, 12, 13, 32]] = True
    heads = np.zeros(len(data) + 1, bool)
    heads[offsets] = True
    word = ~gap[data]
    begin = np.flatnonzero(word & (~np.concatenate([[False], word[:-1]]) | heads[:-1]))
    end = np.flatnonzero(word & (~np.concatenate([word[1:], [False]]) | heads[1:])) + 1
    return begin, end, np.searchsorted(begin, offsets)


def _trimmed(data: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Words without ASCII punctuation at their ends."""
    plain = np.ones(256, bool)
    plain[[ord(c) for c in "!\"'()*,-.:;?[]_`{}~"]] = False
    begin, end = begin.copy(), end.copy()
    for _ in range(3):
        end -= (end > begin) & ~plain[data[np.maximum(end - 1, 0)]]
        begin += (end > begin) & ~plain[data[np.minimum(begin, len(data) - 1)]]
    return begin, end


def _keys(low8: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """For each length of PREFIX the packed beginning of each word; a word that ends there counts with a space behind."""
    first = low8[begin] if len(begin) else np.zeros(0, np.uint64)
    size = end - begin
    out = []
    for n in PREFIX:
        mask = np.where(size >= n, np.uint64((1 << 8 * n) - 1), (np.uint64(1) << (8 * np.minimum(size, 7)).astype(np.uint64)) - np.uint64(1))
        space = np.where(size < n, np.uint64(32) << (8 * np.minimum(size, 7)).astype(np.uint64), np.uint64(0))
        key = (first & mask) | space
        out.append(key * np.uint64(16) + np.uint64(n) if n < 8 else key ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return out


class Features:
    """Features of texts, for a lexicon of keys with weights in order of key."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        self.keys, self.weights = keys, weights
        self.maybe = np.zeros(1 << 16, bool)
        if len(keys):
            self.maybe[self._slot(keys)] = True
        short = np.array([np.frombuffer(w.encode().ljust(8, b" ")[:8], "<u8")[0] for w in SECOND_PERSON])
        self.second = np.unique(short)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        begin, end, at = _cut_words(data, offsets)
        count = np.diff(at)
        safe = np.maximum(count, 1)
        text_of = np.repeat(np.arange(n), count)
        sums = lambda x: np.bincount(text_of, weights=x, minlength=n)
        b, e = _trimmed(data, begin, end) if len(begin) else (begin, end)
        low = _lower_table()[data]
        low8 = words64(low)
        weight = np.zeros(len(b))
        for key in _keys(low8, b, e):
            hit = np.flatnonzero(self.maybe[self._slot(key)])
            where = np.minimum(np.searchsorted(self.keys, key[hit]), max(len(self.keys) - 1, 0))
            if len(self.keys):
                good = self.keys[where] == key[hit]
                np.maximum.at(weight, hit[good], self.weights[where[good]])
        size = e - b
        whole = np.where(size < 8, (low8[b] if len(b) else np.zeros(0, np.uint64)) & ((np.uint64(1) << (8 * np.minimum(size, 7)).astype(np.uint64)) - np.uint64(1)), np.uint64(0))
        fill = np.uint64(0x2020202020202020) << (8 * np.minimum(size, 7)).astype(np.uint64)
        you = np.isin(np.where(size < 8, whole | fill, np.uint64(0)), self.second)
        toxic = weight > 0
        # Distance in words to the nearest second-person word of the same text.
        place = np.flatnonzero(you)
        near = np.zeros(len(b), bool)
        if len(place) and toxic.any():
            t = np.flatnonzero(toxic)
            right = np.minimum(np.searchsorted(place, t), len(place) - 1)
            left = np.maximum(right - 1, 0)
            for other in (place[left], place[right]):
                near[t] |= (np.abs(other - t) <= NEAR) & (text_of[other] == text_of[t])
        byte_of = np.repeat(np.arange(n), np.diff(offsets))
        chars = np.maximum(np.bincount(byte_of, weights=(data & 0xC0) != 0x80, minlength=n), 1)
        of_bytes = lambda flags: np.bincount(byte_of[flags], minlength=n) / chars
        upper = (data >= 65) & (data <= 90)
        digit = (data >= 48) & (data <= 57)
        letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
        odd = np.isin(data, np.frombuffer(b"@$*#!1034579", np.uint8))
        inside = np.zeros(len(data), bool)
        if len(data) > 2:
            inside[1:-1] = odd[1:-1] & letter[:-2] & letter[2:]
        stretched = np.zeros(len(data), bool)
        if len(data) > 2:
            stretched[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (data[2:] < 128)
        strongest = np.zeros(n)
        np.maximum.at(strongest, text_of, weight)
        columns = [sums(toxic) / safe * 100, np.minimum(sums(toxic), 50), sums(weight) / safe * 100, np.minimum(sums(weight), 500), strongest,
                   sums(weight >= 4) / safe * 100, np.minimum(sums(weight >= 4), 50), sums(near) / safe * 100, sums(you) / safe * 100,
                   of_bytes(upper), of_bytes(np.isin(data, np.frombuffer(b"!?", np.uint8))),
                   of_bytes(np.isin(data, np.frombuffer(b".,;:!?-\"'()", np.uint8))), of_bytes(digit), of_bytes(inside),
                   of_bytes(stretched), np.log1p(count), chars / safe]
        return np.stack(columns, axis=1)


def keys_of(text: bytes) -> np.ndarray:
    """Distinct beginnings of the words of a text."""
    data = np.frombuffer(text, np.uint8)
    begin, end, _ = _cut_words(data, np.array([0, len(data)]))
    if not len(begin):
        return np.zeros(0, np.uint64)
    return np.unique(np.concatenate(_keys(words64(_lower_table()[data]), *_trimmed(data, begin, end))))


def fit_lexicon(keys: list[np.ndarray], labels: np.ndarray, most: int = LEXICON) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and weights (log odds of the share of texts that have one) of entries that speak for toxicity."""
    found, with_toxic, without = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for begin in range(0, len(keys), 500):
        some = [found, *keys[begin:begin + 500]]
        toxic = np.repeat(labels[begin:begin + 500] > 0, [len(x) for x in some[1:]])
        merged, inverse = np.unique(np.concatenate(some), return_inverse=True)
        with_toxic = np.bincount(inverse, np.concatenate([with_toxic, toxic]), len(merged))
        without = np.bincount(inverse, np.concatenate([without, ~toxic]), len(merged))
        found = merged
    n1, n0 = max(int(labels.sum()), 1), max(int((labels == 0).sum()), 1)
    odds = np.log((with_toxic + 0.1) / n1) - np.log((without + 0.1) / n0)
    good = np.flatnonzero((with_toxic >= 3) & (odds > 2.5))
    good = np.sort(good[np.argsort(-odds[good] * np.log1p(with_toxic[good]), kind="stable")][:most])
    return found[good], odds[good]


class Trees:
    """Boosted regression trees on logistic loss, cut at quantiles, and the isotonic steps of their margins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: int = 10):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple] = []
        self.start, self.steps = 0.0, (np.zeros(1), np.zeros(1))

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            gradient, weight = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.full(2 ** self.depth - 1, -1), np.zeros(2 ** self.depth - 1)
            for level in range(self.depth):
                for k in range(2 ** level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    best = (1e-6, -1, 0)
                    if len(rows) >= 2 * self.least:
                        g, w = gradient[rows], weight[rows]
                        for f in range(x.shape[1]):
                            size = len(edges[f]) + 1
                            col = binned[rows, f]
                            gl, wl = np.cumsum(np.bincount(col, g, size)), np.cumsum(np.bincount(col, w, size))
                            nl = np.cumsum(np.bincount(col, minlength=size))
                            gain = gl ** 2 / (wl + 1) + (gl[-1] - gl) ** 2 / (wl[-1] - wl + 1) - gl[-1] ** 2 / (wl[-1] + 1)
                            gain[(nl < self.least) | (nl[-1] - nl < self.least)] = 0
                            at = int(gain.argmax())
                            if gain[at] > best[0]:
                                best = (gain[at], f, at)
                    if best[1] >= 0:
                        feature[k], cut[k] = best[1], edges[best[1]][best[2]]
                        node[rows] = 2 * k + 1 + (x[rows, best[1]] > cut[k])
                    else:
                        node[rows] = 2 * k + 1
            leaf = node - (2 ** self.depth - 1)
            n = 2 ** self.depth
            value = self.rate * np.bincount(leaf, gradient, n) / (np.bincount(leaf, weight, n) + 1)
            self.trees.append((feature, cut, value))
            margin += value[leaf]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > cut[node]))
            out += value[node - (2 ** self.depth - 1)]
        return out

    def calibrate(self, margin: np.ndarray, y: np.ndarray) -> None:
        """Isotonic regression of the labels on the margins by pooling neighbours that fall."""
        order = np.argsort(margin, kind="stable")
        blocks: list[list[float]] = []
        for m, v in zip(margin[order], y[order]):
            blocks.append([v, 1.0, m, m])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                last = blocks.pop()
                blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
        at = np.array([x for b in blocks for x in (b[2], b[3])])
        value = np.array([b[0] / b[1] for b in blocks for _ in range(2)])
        self.steps = (at, value)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.margins(x), *self.steps), 0, 1)


def features_of(features: Features, texts: list[bytes]) -> np.ndarray:
    """Features of the texts, about SLICE bytes at a time."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.concatenate([features(np.frombuffer(b"".join(texts[a:b]), np.uint8), offsets[a:b + 1] - offsets[a])
                           for a, b in slices(offsets, SLICE)])


def fit(texts: list[bytes], labels: np.ndarray) -> tuple[Features, Trees | float]:
    """The model of labelled texts; the share of toxic ones where only one class is there.

    The rows are split in two. The lexicon of one half makes the features of the other, so the trees do not learn to
    trust words that only one text has; margins for the calibration come from trees of the half that a row is not in.
    """
    nothing = Features(np.zeros(0, np.uint64), np.zeros(0))
    if not 0 < labels.sum() < len(labels):
        return nothing, float(labels.mean()) if len(labels) else 0.0
    # Both halves get their share of each class.
    half = np.empty(len(labels), np.int64)
    for value in (0, 1):
        rows = np.flatnonzero(labels == value)
        half[rows] = np.arange(len(rows)) % 2
    keys = [keys_of(t) for t in texts]
    parts = [np.flatnonzero(half == k) for k in range(2)]
    x = [features_of(Features(*fit_lexicon([keys[i] for i in parts[1 - k]], labels[parts[1 - k]])), [texts[i] for i in parts[k]])
         if len(parts[k]) else None for k in range(2)]
    y = [labels[rows].astype(float) for rows in parts]
    trees = Trees()
    trees.fit(np.concatenate([v for v in x if v is not None]), np.concatenate(y))
    if min(map(len, y)) and all(0 < v.sum() < len(v) for v in y):
        margin = []
        for k in range(2):
            other = Trees()
            other.fit(x[1 - k], y[1 - k])
            margin.append(other.margins(x[k]))
    else:
        margin = [trees.margins(v) for v in x if v is not None]
    trees.calibrate(np.concatenate(margin), np.concatenate(y))
    return Features(*fit_lexicon(keys, labels)), trees


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = FIT_ROWS, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted for each of `docs`; `labels` (doc_id, `label`) are all used as examples."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("of")).agg(
        F.max(label).cast("int").alias("label"))
    # The least hashes are a sample that does not depend on how rows are dealt.
    chosen = known.orderBy(F.xxhash64("of"), "of").limit(fit_rows)
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["of"]).select("doc_id", "text", "label").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or ""))
    labelled = np.array([r.label for r in rows], np.int64)
    texts = [(rows.pop(0).text or "").encode() for _ in range(len(rows))]
    features, trees = fit(texts, labelled)

    def run(batches):
        for batch in batches:
            data, offsets = packed(batch.column("text"))
            out = [np.zeros(0)]
            for a, b in slices(offsets, SLICE):
                x = features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                out.append(trees.scores(x) if isinstance(trees, Trees) else np.full(b - a, trees))
            score = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, score double, predicted int")
