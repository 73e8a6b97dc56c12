"""Exact n-gram join, source divergence and resampling against brute force, on the rows that pipelines meet."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from percussa.llm import divergence, ngram_join, resampling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "".join(f", {c} string" for c in ("node", "place", "key", "region", "size", "row", "rank", "total", "number", "block", "term"))


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdeilnorstu"), r.integers(1, 5))) for _ in range(n))


def edited(text, *at):
    words = text.split(" ")
    for k in at:
        words[k] = f"w{k}"
    return " ".join(words)


def documents():
    long, passage = prose(1, 260), prose(2, 40)
    texts = [long, long, edited(long, 100), edited(long, 50, 100, 150, 200), edited(long, 50, 100, 150, 200, 220, 240),
             prose(4, 60) + " " + passage, prose(5, 60) + " " + passage, prose(6, 300) + " " + passage, "", None, "  \n\t",
             "one", "one two", "One  TWO", "one two three", "one two three four", "x" * 5000, "aaaa " * 400,
             "é ü ß 日本語 " * 30, prose(7, 20_000), edited(prose(7, 20_000), 77)]
    # A chain whose ends are no pair, and a group of copies that mostly don't link.
    texts += [edited(long, *range(20, 20 + 4 * k, 4)) for k in range(8)]
    texts += [edited(prose(9, 40), k % 40, (7 * k) % 40) for k in range(40)]
    return [(k, t, ["en", "de", None][k % 3] if k else "xx", f"s{k % 4}" if k % 5 else None, 7) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + ("z",) * 11 for r in documents()], SCHEMA + EXTRA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def repeated(spark):
    a, b = prose(11, 80), prose(12, 80)
    rows = [(1, a), (1, a), (1, b), (2, a), (None, a), (None, None), (3, b), (None, prose(13, 30))]
    return spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], SCHEMA)


# N-gram join

def gram_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k:k + n]) for k in range(len(words) - n + 1)) or frozenset([tuple(words)])


def brute_join(rows, n, percent):
    sets = [(i, gram_set(t, n)) for i, t in rows]
    least = {i: i for i, _ in sets}
    for _ in range(len(sets)):
        for i, x in sets:
            for j, y in sets:
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    least[i] = least[j] = min(least[i], least[j])
    return sorted((i, len(x), least[i]) for i, x in sets)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6), st.sampled_from([75, 80, 85, 90, 95]))
def test_partners_meet_after_their_commonest_places_are_left_out(n, seed, percent):
    r = np.random.default_rng(seed)
    b, spare = ngram_join.bounds(percent)
    one = r.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    # As many changes as the limit allows, some of them in one stretch of the hash space.
    other, k = one.copy(), 0
    order = np.argsort(one) if seed % 2 else r.permutation(n)
    while k < n:
        tried = other.copy()
        tried[order[k]] = np.uint64(r.integers(0, 1 << 62))
        if 100 * len(np.intersect1d(one, tried)) < percent * len(np.union1d(one, tried)):
            break
        other, k = tried, k + 1
    places = ngram_join.meeting_places([np.unique(one), np.unique(other)], b)
    both = set(places[0].tolist()) & set(places[1].tolist())
    held = sum(p & ngram_join.HOLDS for p in both)
    assert held >= 2 * spare * n * (1 - 1e-9)
    # The worst choice: each side leaves out shared places as long as it may.
    kept = []
    for own in places:
        out, kept_here = 0, set(own.tolist())
        for p in sorted(both, key=lambda p: (p & ngram_join.HOLDS, p)):
            out += p & ngram_join.HOLDS
            if out < spare * n:
                kept_here.discard(p)
        kept.append(kept_here)
    assert kept[0] & kept[1]


@pytest.mark.parametrize("leaf", [256, 4])
def test_ngram_join(docs, monkeypatch, leaf):
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    monkeypatch.setattr(ngram_join, "PIVOTS", 3)
    got = ngram_join.ngram_join(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_join([r[:2] for r in documents()], 3, 90)


def test_ngram_join_cuts_regions(spark, monkeypatch):
    """Many copies of several texts, far enough apart that most pairs don't link: cells, windows, rare n-grams and blocks."""
    monkeypatch.setattr(ngram_join, "LEAF", 3)
    rows = []
    for k in range(160):
        r = np.random.default_rng(k)
        rows.append((k, edited(prose(k % 2, 60), *r.integers(0, 60, r.integers(0, 3)))))
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_join(rows, 3, 90)


def test_ngram_join_repeats(repeated, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(repeated).collect()]
    assert sorted(got, key=str) == sorted([(1, 78, 1), (1, 78, 1), (1, 78, 1), (2, 78, 1), (None, 78, 1), (None, 0, None), (3, 78, 1),
                                           (None, 28, None)], key=str)
    assert ngram_join.ngram_join(empty).count() == 0


# Divergence

def brute_divergence(rows, least_docs, most):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")))
             for t, lang, source in rows]
    count, held = collections.Counter(), collections.Counter()
    for lang, source, ws in words:
        count.update((lang, source, w) for w in ws)
        held.update((lang, w) for w in set(ws))
    out = []
    groups = sorted({w[:2] for w in words})
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in held.items() if x == lang and n >= least_docs]
        own = [s for x, s in groups if x == lang]
        total = {s: sum(count[lang, s, w] for w in kept) for s in own}

        def p(s, w):
            return 1 + 10**9 * (count[lang, s, w] + 1) // (total[s] + len(kept))

        def q(w):
            return 1 + 10**9 * (sum(count[lang, s, w] for s in own) + 1) // (sum(total.values()) + len(kept))

        for s in own:
            pairs = [(-sum((p(s, w) - p(o, w)) ** 2 // p(o, w) for w in kept), o.encode(), o) for o in own if o != s]
            terms = [(-((p(s, w) - q(w)) ** 2 // q(w)), w.encode(), w) for w in kept if count[lang, s, w] and p(s, w) > q(w)]
            for part, found, end in (("pair", pairs, len(pairs)), ("term", terms, most)):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(found)[:end])]
    return sorted(out)


@pytest.mark.parametrize("block,tile", [(4096, 32), (16, 2)])
def test_divergence(docs, monkeypatch, block, tile):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TILE", tile)
    got = divergence.divergence(docs, least_docs=3, most_terms=20).collect()
    assert sorted(map(tuple, got)) == brute_divergence([(r[1], r[2], r[3]) for r in documents()], 3, 20)


def test_divergence_without_terms(spark, empty, repeated):
    rows = [(1, None, "en", "a"), (2, "x y", "en", None), (3, "", None, None), (4, "123 ..", "de", "a")]
    got = divergence.divergence(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert sorted(map(tuple, got)) == [("en", "", "pair", "a", 0, 1), ("en", "a", "pair", "", 0, 1)]
    assert divergence.divergence(empty).count() == 0
    # Rows are documents: the text stands in four of them.
    assert divergence.divergence(repeated).where("part = 'term'").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=13, max_size=13), min_size=2, max_size=4))
def test_paired_trees_hold_the_pairs_of_counts(counts):
    rows = [(g, k, n) for g, row in enumerate(counts) for k, n in enumerate(row) if n]
    group, place, n = (np.array([r[c] for r in rows], np.int64) for c in range(3))
    trees = divergence.Trees(group, place, n, len(counts), 13)
    which, a, b, times = trees.paired(0, np.arange(1, len(counts)))
    got = {(int(w), int(trees.counts[x]), int(trees.counts[y])): int(t) for w, x, y, t in zip(which, a, b, times)}
    want = collections.Counter((g - 1, x, y) for g in range(1, len(counts)) for x, y in zip(counts[0], counts[g]) if x or y)
    assert got == dict(want)


def test_shares_are_exact_beyond_doubles():
    count, total = np.array([9 * 10**14, 123456789012345, 0]), np.array([9 * 10**14 + 7, 987654321098765, 3])
    assert divergence._shares(count, total).tolist() == [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(count, total)]


# Resampling

def brute_features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[k:k + n]).encode()) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def brute_resample(rows, target, longest, buckets, least, percent, seed):
    held = [brute_features(t, longest) for _, t in rows]
    s = collections.Counter(f % buckets for _, fs in held for f in fs)
    t = collections.Counter(f % buckets for x in target for f in brute_features(x, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())

    def gain(f):
        return math.floor(1000 * math.log((t[f % buckets] + 1) * (all_s + buckets) / ((s[f % buckets] + 1) * (all_t + buckets))))

    out = []
    for (i, _), (n, fs) in zip(rows, held):
        weight = sum(map(gain, fs)) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("longest,buckets,percent,pivots", [(1, 10_000, 10, 32), (3, 97, 60, 2), (2, 50, 100, 3)])
def test_resample(spark, docs, monkeypatch, longest, buckets, percent, pivots):
    monkeypatch.setattr(resampling.kth_key, "__defaults__", (pivots, 1))
    target = [prose(21, 90), None, "", "one two"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(docs, bench, longest=longest, buckets=buckets, percent=percent)
    want = brute_resample([r[:2] for r in documents()], target, longest, buckets, 20, percent, 2024)
    assert sorted(map(tuple, got.collect())) == want


def test_resample_repeats_and_empties(spark, repeated, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = resampling.resample(repeated, bench, percent=50).collect()
    assert len(got) == 8 and sorted(r.rank for r in got if r.rank) == [1, 2, 3]
    again = resampling.resample(repeated, bench, percent=50).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    # Equal rows are told apart, so a draw of all of a thousand equal rows has a thousand ranks.
    same = spark.createDataFrame([(7, prose(3, 30))] * 1000, "doc_id long, text string")
    ranks = [r.rank for r in resampling.resample(same, bench, percent=40).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 401))
    assert resampling.resample(empty, bench).count() == 0


def test_kth_key_by_rounds(spark):
    keys = spark.createDataFrame([(-(k * 7919 % 500), False, k, 0, 0, k) for k in range(500)],
                                 "a long, b boolean, c long, d long, e long, f long").selectExpr("struct(*) AS key")
    every = sorted((-(k * 7919 % 500), False, k, 0, 0, k) for k in range(500))
    assert [resampling.kth_key(keys, k, pivots=4) for k in (1, 250, 500)] == [every[0], every[249], every[499]]
    assert resampling.kth_key(keys, 501, pivots=4) is None
