"""Text operators against brute force, and on the rows that pipelines meet: NULLs, empties, ties, repeats, extra columns."""

import base64
import collections
import hashlib
import io
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from percussa.llm import line_dedup, minhash_join, mixing, order_minhash, pieces, quality_rules, suffix_dedup, token_codes, toxicity, warc
from percussa.llm.common import stored
from percussa.llm.suffixes import common_prefixes, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdeilnorstu"), r.integers(1, 9))) for _ in range(n))


def documents():
    long = prose(1, 260)
    near = long.split(" ")
    near[100] = "changed"
    lines = "\n".join([prose(2, 30), prose(3, 25), prose(2, 30)])
    texts = [long, long, " ".join(near), prose(4, 60) + " " + long[200:900], "", None, "  \n\t", "one", "one two three",
             "x" * 5000, "aaaa " * 400, lines, lines.replace("a", "e", 2), prose(5, 90) + " # $ % <b> | " * 40, "é ü ß 日本語 " * 30,
             prose(6, 3000)]
    return [(k, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, 7) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    # Columns whose names the operators use inside.
    extra = "".join(f", {c} string" for c in ("node", "shard", "size", "key", "cell", "kept", "removed_lines", "of"))
    return spark.createDataFrame([r + ("z",) * 8 for r in documents()], SCHEMA + extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def repeated(spark):
    """Repeated rows, a repeated id with another text, and rows without id."""
    a, b = prose(11, 80), prose(12, 80)
    rows = [(1, a), (1, a), (1, b), (2, a), (None, a), (None, None), (3, b)]
    return spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], SCHEMA)


# Suffix arrays

@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=300), st.integers(1, 9))
def test_suffix_array_and_prefixes(data, lane):
    data = bytes(x % 3 + 97 for x in data)
    text = np.frombuffer(data, np.uint8)
    sa = suffix_array(text, 64)
    heads = [data[i:i + 64].ljust(64, b"\0") for i in sa]
    assert heads == sorted(heads) and sorted(sa) == list(range(len(data)))
    lcp = common_prefixes(text, sa, 50, lane)
    for k in range(1, len(sa)):
        x, y = data[sa[k - 1]:sa[k - 1] + 50], data[sa[k]:sa[k] + 50]
        assert lcp[k] == next((m for m, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def removed_bytes(rows, length=50):
    first, out = {}, []
    for i, t in rows:
        t = (t or "").encode()
        for p in range(len(t) - length + 1):
            first[t[p:p + length]] = min(i, first.get(t[p:p + length], i))
    for i, t in rows:
        t = (t or "").encode()
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if first[t[p:p + length]] < i:
                gone[p:p + length] = True
        out.append((i, len(t), np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [700, 1 << 20])
def test_suffix_dedup(docs, shard_bytes):
    got = suffix_dedup.suffix_dedup(docs, shard_bytes=shard_bytes).collect()
    assert sorted((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got) == removed_bytes([r[:2] for r in documents()])
    for r in got:
        assert r.n_bytes - len(r.kept) == sum(s.end - s.begin for s in r.spans)


def test_suffix_dedup_repeats(repeated, empty):
    got = [(r.doc_id, len(r.kept)) for r in suffix_dedup.suffix_dedup(repeated).collect()]
    a, b = len(prose(11, 80)), len(prose(12, 80))
    assert sorted(got, key=str) == sorted([(1, a), (1, a), (1, b), (2, 0), (None, a), (None, 0), (3, 0)], key=str)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_windows_with_one_hash_fall_back_to_bytes():
    text = np.frombuffer(b"a" * 60 + b"b" * 60, np.uint8)
    where, owner = np.array([0, 5, 60]), np.array([3, 4, 1])
    assert suffix_dedup._held_by_bytes(text, where, owner, 50).tolist() == [False, True, False]
    assert suffix_dedup._held_by_smaller(text, where, owner, np.array([0, 1, 1]), 50).tolist() == [False, True, False]


# Order MinHash

def test_order_minhash(docs):
    got = {r.doc_id: r for r in order_minhash.edited_fingerprints(docs).collect()}
    rows = [(i, t or "") for i, t, *_ in documents()]
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[:len(t) - q] + after[:q]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[0].fingerprint == got[1].fingerprint and got[0].near_next == 1
    assert got[0].near_edited > 0.3 > got[8].near_next
    assert got[4].fingerprint == "" and got[4].fingerprint == got[5].fingerprint


def test_order_minhash_sees_order_and_occurrences(spark):
    words = prose(21, 400).split(" ")
    rows = [(1, " ".join(words)), (2, " ".join(words[200:] + words[:200])), (3, " ".join(sorted(words)))]
    df = spark.createDataFrame(rows, "id long, text string").select("id", order_minhash.fingerprint("text").alias("f"))
    f = {r.id: set(r.f) for r in df.collect()}
    moved, shuffled = len(f[1] & f[2]) / 64, len(f[1] & f[3]) / 64
    assert shuffled < 0.1 < moved < 0.9


def test_order_minhash_rows(repeated, empty):
    assert order_minhash.edited_fingerprints(repeated).count() == 7
    assert order_minhash.edited_fingerprints(empty).count() == 0
    alone = repeated.where("doc_id = 3")
    assert order_minhash.edited_fingerprints(alone).first().near_next == 1


# MinHash join

def near_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    return sorted((i, len(sets[i]), label[i]) for i in sets)


def test_near_duplicates(docs):
    got = minhash_join.near_duplicates(docs).collect()
    assert sorted(map(tuple, got)) == near_components([r[:2] for r in documents()])


def test_near_duplicates_of_a_large_group(spark):
    """Copies of one text with a few words changed: their own links, not all pairs, make the component."""
    r = np.random.default_rng(3)
    base, rows = prose(31, 120).split(" "), []
    for k in range(120):
        own = list(base)
        for p in r.choice(120, r.integers(1, 6), replace=False):
            own[p] = f"w{k}"
        rows.append((k, " ".join(own)))
    got = minhash_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == near_components(rows)


def test_near_duplicates_rows(repeated, empty):
    got = sorted(((r.doc_id, r.component_id) for r in minhash_join.near_duplicates(repeated).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (1, 1), (2, 1), (None, 1), (None, None), (3, 1)], key=str)
    assert minhash_join.near_duplicates(empty).count() == 0


# Line dedup

def removed_lines(rows, width=5):
    seen, sets, out = collections.defaultdict(list), [], {}
    for i, t in sorted(rows):
        gone = []
        for k, line in enumerate((t or "").split("\n")):
            w = WORD.findall(line.lower())
            if not w:
                continue
            s = frozenset(tuple(w[j:j + width]) for j in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])
            common = collections.Counter(j for x in s for j in seen[x])
            if any(100 * n >= 75 * (len(s) + len(sets[j]) - n) for j, n in common.items()):
                gone.append(k)
            for x in s:
                seen[x].append(len(sets))
            sets.append(s)
        out[i] = gone
    return out


def test_line_dedup(docs):
    got = line_dedup.line_dedup(docs).collect()
    want = removed_lines([r[:2] for r in documents()])
    assert {r.doc_id: r.removed_lines for r in got} == want
    texts = {r[0]: r[1] for r in documents()}
    for r in got:
        t = texts[r.doc_id]
        assert r.text == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[r.doc_id]))
        assert r.node == "z" and r.n_chars == 7


def test_similar_lines_of_a_large_group(spark):
    r = np.random.default_rng(5)
    base, rows = prose(41, 30).split(" "), []
    for k in range(80):
        own = list(base)
        for p in r.choice(30, r.integers(0, 4), replace=False):
            own[p] = f"w{k}"
        rows.append((k, prose(100 + k, 12) + "\n" + " ".join(own)))
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed_lines for r in got} == removed_lines(rows)


def test_lines_that_share_a_passage_get_no_token_sets(spark, monkeypatch):
    # One cell for all tokens: as in a large corpus, counts don't tell which of them are rare.
    monkeypatch.setattr(line_dedup, "CELLS", 1)
    seen = {}
    monkeypatch.setattr(line_dedup, "stored", lambda df, what="table": seen.setdefault(what, stored(df, what)) if what == "tokens" else stored(df, what))
    passage = prose(43, 25)
    rows = [(k, prose(200 + k, 30) + " " + passage + " " + prose(300 + k, 30)) for k in range(40)]
    rows += [(50, prose(400, 60) + " " + passage), (51, prose(400, 60) + " x " + passage)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = removed_lines(rows)
    assert {r.doc_id: r.removed_lines for r in got} == want and want[51] == [0]
    assert {r.place.doc_id for r in seen["tokens"].collect()} == {50, 51}


def test_commonest_tokens_are_not_joined(spark, monkeypatch):
    # Lines that share a passage alone leave it out: they leave out a token for each two of theirs.
    monkeypatch.setattr(line_dedup, "SPARE", 2, raising=False)
    seen = {}
    monkeypatch.setattr(line_dedup, "stored", lambda df, what="table": seen.setdefault(what, stored(df, what)) if what == "listed" else stored(df, what))
    passage = prose(43, 25)
    rows = [(k, prose(200 + k, 30) + " " + passage + " " + prose(300 + k, 30)) for k in range(20)]
    rows += [(50, prose(400, 60) + " " + passage), (51, prose(400, 60) + " x " + passage)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = removed_lines(rows)
    assert {r.doc_id: r.removed_lines for r in got} == want and want[51] == [0]
    assert {r.place.doc_id for r in seen["listed"].collect()} == {50, 51}


def test_line_dedup_rows(repeated, empty):
    assert line_dedup.line_dedup(repeated).count() == 7
    # Rows that share an id but not the text keep what nothing repeats.
    a, b = prose(41, 30), prose(42, 30)
    rows = [(1, a), (2, a + "\nzz"), (2, b + "\nyy"), (2, b + "\nyy")]
    got = [r.text for r in line_dedup.line_dedup(repeated.sparkSession.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted([a, "zz", b + "\nyy", b + "\nyy"])
    assert line_dedup.line_dedup(empty).count() == 0


# Quality rules

def statistics(text):
    w, n = WORD.findall(text or ""), 0
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for j in range(3)}
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def test_quality_statistics(docs, empty):
    got = quality_rules.quality_rules(docs).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == statistics(documents()[r.doc_id][1])
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rows = [(k, prose(k, 80 + k % 50), "en", "s") for k in range(300)]
    junk = [(1000 + k, " ".join(w + "#%$" for w in prose(k, 90).split(" ")), "en", "s") for k in range(40)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in got if not r.kept} == {r[0] for r in junk}


@pytest.mark.parametrize("spread", [False, True])
def test_quality_rejects_an_outlier_in_each_value_alone(spark, spread):
    def text(seed, longer=0, symbols=0, lines=0, repeats=0):
        # 100 words of 4 to 6 letters in lines of one; `repeats` words stand in windows that occur twice.
        r = np.random.default_rng(seed)
        size = 4 + longer + (seed % 7 if spread else 0)
        w = ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), size + r.integers(0, 3))) for _ in range(100)]
        w[100 - repeats // 2:] = w[:repeats // 2]
        w = [x + "#" * (k < symbols) for k, x in enumerate(w)]
        # Equal lines of the usual length that stand between others repeat no window.
        return "\n".join(x for k, x in enumerate(w) for x in ((x, "plain"[:size + 1], "queue"[:size + 1]) if k < lines else (x,)))

    odd = {1000: text(1, longer=9 if spread else 4), 1001: text(2, symbols=60), 1002: text(3, lines=100), 1003: text(4, repeats=42)}
    fine = {1100: text(7, longer=1), 1101: text(9, symbols=10), 1102: text(10, lines=15), 1103: text(11, repeats=20)}
    rows = {**{100 + k: text(100 + k) for k in range(300)}, **odd, **fine}
    if spread:
        odd = {k: t for k, t in odd.items() if k != 1000}
        rows.pop(1000)
    assert not any(statistics(t)[5] for t in rows.values())
    got = quality_rules.quality_rules(spark.createDataFrame(
        [(k, t, "en", "s") for k, t in rows.items()], "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in got if not r.kept} == set(odd)


# Token codes

@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.data())
def test_codes(ids, data):
    codes = token_codes.Codes(token_codes.pack(np.array(ids, np.uint32)))
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert codes.span(a, b).tolist() == ids[a:b]
    assert codes[np.arange(len(ids))].tolist() == ids


def test_encoder_is_the_library():
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(BPE)
    plain.encode_special_tokens = True
    texts = ["a  b", "  a b ", " x", "foo \n bar\t baz", "I'm he 's don't 12 34a é à œ ß x", "", "　 a", "a <|endoftext|> b",
             "日本 語 the ½ ¾", "\x1c a \x1c b", "ÿ þ × ÷ « »", " ", "a  b   c"]
    got = token_codes.Encoder(BPE)(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_are_recognised(spark):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(BPE)
    texts = ["a <|endoftext|> b", "plain text, no mark", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "", "<|endoftext| > a", "  a<|endoftext|>  b "]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in want[0]
    got = token_codes.Encoder(BPE, added=True)(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == want
    at, rows = 0, []
    for k, ids in enumerate(want):
        rows.append((k, at, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())))
        at += len(ids) + 1
    assert sorted(map(tuple, token_codes.coded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BPE).collect())) == rows


def test_token_files(docs, repeated, empty, spark):
    got = sorted(map(tuple, token_codes.coded(docs, BPE).collect()))
    encode, at, want = token_codes.Encoder(BPE), 0, []
    for i, t, *_ in documents():
        ids = np.append(np.frombuffer(encode([t or ""])[0], "<u2"), 2).astype("<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    small = token_codes.write_codes(docs, token_codes.scratch(spark, "codes"), BPE, file_tokens=300)
    assert small.count() > 3 and sorted(map(tuple, token_codes.read_codes(small).collect())) == want
    assert token_codes.coded(repeated, BPE).count() == 7
    assert token_codes.coded(empty, BPE).count() == 0


# Pieces

def best_score(model, text):
    scores = {model.id_to_piece(k): model.get_score(k) for k in range(model.get_piece_size())
              if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))}
    least = min(scores.values()) - 10
    text = "▁" + text.replace(" ", "▁")
    best = [0.0] + [-np.inf] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - 16), j):
            if text[i:j] in scores:
                best[j] = max(best[j], best[i] + scores[text[i:j]])
        if text[j - 1] not in scores:
            best[j] = max(best[j], best[j - 1] + least)
    return best[-1]


def test_pieces_reach_the_best_score_and_decode():
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    held = pieces.Pieces(PIECES)
    texts = ["", "a", " a", "a  b", "  ", " \n\t", "日本語ですよ 梦", "naïvé ﬁ", "0123 45", "a" * 100, "\x01", prose(3, 40), "The theaating."]
    for text, ids in zip(texts, pieces.Encoder(held)(texts)):
        assert held.decode(ids.tolist()) == text
        if text and not any(model.is_byte(int(k)) for k in ids):
            assert sum(model.get_score(int(k)) for k in ids) == best_score(model, text)
    assert held.decode(pieces.Encoder(held)(["🙂🙂 x🙂"])[0].tolist()) == "🙂🙂 x🙂"


def test_pieces_rows(docs, empty, repeated):
    encoded = pieces.encode(docs, PIECES)
    for r in encoded.collect():
        assert r.decoded == (documents()[r.doc_id][1] or "")
    back = {r.doc_id: r.text for r in pieces.decode(encoded, PIECES).collect()}
    assert back == {r[0]: r[1] or "" for r in documents()}
    assert pieces.encode(repeated, PIECES).count() == 7 and pieces.encode(empty, PIECES).count() == 0


# Mixing

def test_targets_share_what_limits_cut_off(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 1000)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes, (1.0, 2.0, 3.0), 1.0, 3.0).collect()}
    assert got["a"] == 30 and got["c"] == 30
    assert got["b"] == pytest.approx(1960 * 2 / 3) and got[None] == pytest.approx(1960 / 3)


def test_mix(docs, empty, repeated):
    got = mixing.mix(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
    assert len(got) == 16 and all(r.size == len(WORD.findall(documents()[r.doc_id][1] or "")) for r in got)
    for source in {r.source for r in got}:
        rows = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows) / 2 + 1e-6
        assert all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(repeated).count() == 7 and mixing.mix(empty).count() == 0


def test_mix_prefers_weights(spark):
    rows = [(k, "a b c", "x" if k % 4 else "y") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    quality = spark.createDataFrame([(k, 3.0) for k in range(0, 4000, 2)], "doc_id long, quality double")
    got = mixing.mix(df, weights=(1.0, 3.0), quality=quality, cells=64).where("source = 'x'").collect()
    heavy = [r.taken > 0 for r in got if r.doc_id % 2 == 0]
    light = [r.taken > 0 for r in got if r.doc_id % 2]
    assert sum(heavy) / len(heavy) > 1.5 * sum(light) / len(light)


# Toxicity

def test_toxicity_on_held_out_rows(spark, empty):
    bad = ["stupidness", "trashy", "worthles", "scumbag"]
    r = np.random.default_rng(9)
    rows, labels = [], []
    for k in range(600):
        w = prose(500 + k, 60).split(" ")
        if k % 5 == 0:
            for p in r.choice(60, 4, replace=False):
                w[p] = bad[int(r.integers(4))] + ("", "s")[int(r.integers(2))]
        rows.append((k, " ".join(w)))
        labels.append((k, int(k % 5 == 0)))
    rows += [(600, None), (601, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(df, known).collect()}
    assert len(got) == 602 and all(0 <= x.score <= 1 for x in got.values())
    held = [(got[k].predicted, y) for k, y in labels if k % 3 == 0]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert toxicity.toxicity(empty, known).count() == 0
    assert toxicity.toxicity(df, known.limit(0)).where("score > 0").count() == 0


def test_isotonic_steps_rise():
    trees = toxicity.Trees()
    r = np.random.default_rng(1)
    m = r.normal(size=500)
    trees.calibrate(m, (r.random(500) < 1 / (1 + np.exp(-3 * m))).astype(float))
    assert (np.diff(trees.steps[1]) >= 0).all()


# WARC

class Held(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def archive(compress, n=6):
    made = [warc.record(k, f"http://h/{k}", (f"<p>{prose(k, 200)}</p>").encode(), None, "2000-01-01T00:00:00Z") for k in range(n)]
    return [warc.member(x) if compress else x for x in made]


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("harm", ["flip", "cut", "garbage", "header", "tail"])
def test_salvage(compress, harm):
    parts = archive(compress)
    if harm == "flip":
        x = bytearray(parts[2])
        x[len(x) // 2] ^= 0xFF
        parts[2] = bytes(x)
    elif harm == "cut":
        parts[2] = parts[2][:len(parts[2]) // 2]
    elif harm == "garbage":
        parts[2] = b"\x1f\x8b\x08 WARC/1.1\r\n nonsense" * 3
    elif harm == "header":
        parts[2] = b"XXXX" + parts[2][4:]
    else:
        parts[5] = parts[5][:-30]
    data = b"".join(parts)
    lost = 5 if harm == "tail" else 2
    found = list(warc.salvage(Held(data)))
    assert [f["page_id"] for *_, f in found if f] == [k for k in range(6) if k != lost]
    gaps = [(o, n) for o, n, problem, f in found if f is None]
    assert gaps == [(sum(map(len, parts[:lost])), len(parts[lost]))]
    assert sum(n for _, n, *_ in found) == len(data)


def test_archives(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://c\r\nX: y", ""), (5, "u", "é" * 70000),
            (None, "n", "same"), (2, "http://b", "same"), (6, "v", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in warc.archived(spark, pages).collect()), key=str)
    holder = {"same": 2, "": 4}
    want = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        revisit = page_id is not None and holder.get(html or "", page_id) != page_id
        want.append((page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response",
                     holder[html or ""] if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.archived(spark, pages.limit(0)).count() == 0
    assert warc.archived(spark, pages, least_bytes=5).where("record_type = 'revisit'").count() == 0


# Pipeline

def test_pipeline_against_single_operators(spark):
    import corpus_pipeline

    base = [prose(k, 120) + "\n" + prose(900, 20) for k in range(40)]
    rows = [(k, t, "en", f"s{k % 2}", len(t)) for k, t in enumerate(base)]
    rows += [(50, base[0], "en", "s0", 1), (51, "short", "en", "s0", 5), (52, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = [r for r in rows if not statistics(r[1])[5]]
    names = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, "/root/testdata/sf0.001"), name)
        names[name] = docs.collect()
    assert {r.doc_id for r in names["quality_rules"]} == {r[0] for r in kept}
    gone = removed_lines([r[:2] for r in kept])
    texts = {r[0]: "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone[r[0]]) for r in kept}
    assert {r.doc_id: r.text for r in names["line_dedup"]} == texts
    left = {i for i, _, c in near_components(list(texts.items())) if i == c}
    assert {r.doc_id for r in names["minhash_near_dedup"]} == left
    assert {r.doc_id for r in names["mixing"]} <= left
    held = pieces.Pieces(PIECES)
    assert len(names["sentencepiece"]) == len(names["mixing"])
    assert all(held.decode(r.ids) == texts[r.doc_id] for r in names["sentencepiece"])
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in names["sentencepiece"])
    assert list(corpus_pipeline.STAGES[0][1](spark, spark.createDataFrame([], SCHEMA), "").columns) == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def test_encoders_with_small_tables():
    """Tables that turn over between batches change nothing."""
    texts = [prose(k, 30) + ". " + prose(k // 2, 10) + ", end" for k in range(40)]
    for make in (lambda n: token_codes.Encoder(BPE, n), lambda n: pieces.Encoder(pieces.Pieces(PIECES), n)):
        small, large = make(20), make(10**6)
        assert [bytes(x) for t in texts for x in small([t])] == [bytes(x) for x in large(texts)]


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op3_minhash_join", "op4_line_dedup", "op8_mixing", "op10_warc"])
def test_queries_equal_their_sql(spark, name):
    import oracle_check

    text, ok = oracle_check.compare(spark, oracle_check.database("sf0.001"), "sf0.001", name)
    assert ok, text


@pytest.mark.parametrize("name", ["op2_order_minhash", "op5_quality_rules", "op6_token_codes", "op7_pieces", "op9_toxicity"])
def test_queries_have_a_row_for_each_document(spark, name):
    from percussa.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
