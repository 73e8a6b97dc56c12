"""Near-equal lines across documents: an exact set-similarity join with prefix, length and positional filters.

A line's tokens are its distinct word shingles (lower case; a shorter line is one shingle). A line goes if an earlier
line, by doc_id and place, has at least `percent` of their union in common; lines are judged as the input has them.

1. Lines that are equal in lower case are one class, named by its first occurrence; only its tokens are made, once. They are ordered
   by hash, and a prefix is posted of which two similar lines share 1 + e tokens: all but the least overlap, and 1 + e.
2. Postings are counted exactly. What one class alone has opens nothing, and a class leaves out its d commonest tokens: of the shared
   ones the rarest has e commoner ones beside it in both prefixes, and e is at least the d of any partner. So only the rarest are
   joined, however large the corpus.
3. Each class is compared with the first one of each of its postings, after the length and positional filters; Jaccard
   is verified on full token sets.
4. What is still unmatched is held against all earlier members of its postings in a semi-join, which stops at the first
   match, so a large group of similar lines makes no pairs.
5. Prefixes also meet in passages that lines merely share. Every class has a set of marks, one of 256 for each token: a mark that
   one line has and the other lacks is a token that the other lacks, which bounds the overlap from above. Only what this bound lets
   through gets its full token set.

Native: DataFrame functions only. Tokens are 64-bit hashes.

Defined cases: lines without a word stay; NULL and empty texts have none and come back as they are; rows that repeat a
doc_id with the same text are the same document and lose the same lines; rows that share a doc_id but not the text are
documents of their own, ordered by a hash of the text (32 bits above the line's number; nothing for ids with one text);
a NULL doc_id sorts first; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from percussa.llm.common import WORD, let, stored, words

# A line leaves out its commonest token for each SPARE tokens it has.
SPARE = 32
# Cells of the count table that exact counts replaced; nothing reads it but a test that sets it.
CELLS = 1 << 14
# No text has more lines.
LINES = 1 << 31


def _shingles(line: Column, width: int) -> Column:
    """Hashes of all shingles of a line, in order and with repeats; empty for a line without words."""
    def of(ws: Column) -> Column:
        return F.when(F.size(ws) < width, F.when(F.size(ws) > 0, F.array(F.xxhash64(ws))).otherwise(F.array().cast("array<bigint>"))).otherwise(
            let(F.transform(ws, lambda w: F.xxhash64(w)), lambda hs: F.transform(
                F.slice(hs, 1, F.size(hs) - (width - 1)), lambda h, i: F.xxhash64(h, *[F.get(hs, i + k) for k in range(1, width)]))))

    return let(words(F.lower(line)), of)


def _tokens(line: Column, width: int) -> Column:
    """Distinct tokens of a line, in order."""
    return F.sort_array(F.array_distinct(_shingles(line, width)))


def _marks(tokens: Column) -> Column:
    """The marks of a line's tokens."""
    return F.array_distinct(F.transform(tokens, lambda h: (h.bitwiseAND(F.lit(255)) - 128).cast("tinyint")))


def _bits(marks: Column) -> Column:
    """The marks as a bitmap of four integers."""
    def word(k: int) -> Column:
        return F.aggregate(marks, F.lit(0).cast("long"), lambda seen, m: F.when(
            F.shiftright(m.cast("int"), 6) == k - 2, seen.bitwiseOR(F.call_function(
                "shiftleft", F.lit(1).cast("long"), m.cast("int").bitwiseAND(F.lit(63))))).otherwise(seen))

    return F.array(*[word(k) for k in range(4)])


def _could(n: Column, x: Column, m: Column, y: Column, percent: int) -> Column:
    """Whether sets of n and m tokens with the bitmaps x and y can be alike enough."""
    def lacks(one: Column, other: Column) -> Column:
        return sum((F.bit_count(F.get(one, F.lit(k)).bitwiseAND(F.bitwise_not(F.get(other, F.lit(k))))) for k in range(4)), F.lit(0))

    both = F.least(n - lacks(x, y), m - lacks(y, x))
    return 100 * both >= percent * (n + m - both)


def _named(line: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lower(line))


def _need(n: Column, percent: int) -> Column:
    """Least overlap with a set of any size."""
    return F.ceil(n * percent / 100).cast("int")


def _posted(n: Column, percent: int) -> Column:
    """How many of n tokens are posted: as many more than a prefix needs as the largest partner leaves out."""
    return n - _need(n, percent) + 1 + F.floor(100 * n / (percent * SPARE)).cast("int")


def line_dedup(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """`docs` with `text` without the repeated lines, `n_lines` and `removed_lines` (their places, from 0)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    several_texts = _several_texts(texts)
    texts = _marked(texts, several_texts)
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"), "mark").select(
        "doc_id", (F.col("mark") + F.col("at")).alias("at"), "line").where(F.col("line").rlike(WORD))
    # Which line is the first of its class; repeats of it need no further work.
    place = F.struct("doc_id", "at")
    classes = lines.select(_named(F.col("line"), 1).alias("k1"), _named(F.col("line"), 2).alias("k2"), F.struct(
        place.alias("place"), "line").alias("first")).groupBy("k1", "k2").agg(F.min("first").alias("first"), F.count("*").alias("copies"))
    told = let(_tokens(F.col("first.line"), width), lambda t: F.struct(
        F.size(t).alias("n"), F.slice(t, 1, _posted(F.size(t), percent)).alias("prefix"), _marks(t).alias("marks")))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", F.col("first.place").alias("place"),
                                    "copies", told.alias("told")), "lines")
    postings = classes.select("id", F.col("told.n").alias("n"), F.posexplode("told.prefix").alias("i", "token"))
    met = stored(postings.withColumn("lines", F.count("*").over(Window.partitionBy("token"))).where("lines > 1"), "met")
    commonest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("lines"), "token"))
    rare = met.withColumn("rank", commonest).where(F.col("rank") > F.floor(F.col("n") / SPARE)).select("id", "n", "i", "token")
    # Counting and joining share one exchange by token.
    rare = rare.join(classes.select("id", "place"), "id").select("place", "n", "i", "token").repartition("token")
    several = rare.groupBy("token").agg(F.count("*").alias("lines"), F.min(F.struct("place", "n", "i")).alias("head")).where("lines > 1")
    listed = stored(rare.join(several, "token"), "listed")
    known = classes.select("place", F.col("told.marks").alias("marks")).join(listed.select("place").distinct(), "place")
    known = stored(known.select("place", _bits(F.col("marks")).alias("bits")), "known")

    def fits(n: Column, m: Column, i: Column, j: Column) -> Column:
        """Length filter, and positional filter for tokens at places i and j."""
        low = F.ceil(F.lit(percent) * (n + m) / (100 + percent))
        return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (1 + F.least(n - i - 1, m - j - 1) + F.least(i, j) >= low)

    def with_bits(rows: DataFrame, of: str, name: str) -> DataFrame:
        return rows.join(known.select(F.col("place").alias(of), F.col("bits").alias(name)), of)

    pairs = listed.where((F.col("place") != F.col("head.place")) & fits(
        F.col("n"), F.col("head.n"), F.col("i"), F.col("head.i"))).select(
        "place", "n", F.col("head.place").alias("other"), F.col("head.n").alias("m")).distinct()
    could = _could(F.col("n"), F.col("x"), F.col("m"), F.col("y"), percent)
    pairs = stored(with_bits(with_bits(pairs, "place", "x"), "other", "y").where(could).select("place", "other"), "pairs")
    # Of a posting's two members the first has been compared already.
    listed = listed.where((F.col("lines") > 2) & (F.col("place") != F.col("head.place")))
    late = listed.select("token", "place", "n", "i")
    others = listed.select(F.col("token").alias("by"), F.col("place").alias("other"), F.col("n").alias("m"), F.col("i").alias("j"))
    meet = (F.col("token") == F.col("by")) & (F.col("other") < F.col("place")) & fits(F.col("n"), F.col("m"), F.col("i"), F.col("j"))
    # Rows without any partner go before the bitmaps come in, and those whose bitmaps find none before the token sets do.
    hopeful = stored(late.join(others, meet, "left_semi"), "late")
    partners = stored(others.join(hopeful, meet, "left_semi"), "others")
    near = meet & could
    partners = with_bits(partners, "other", "y")
    hopeful = stored(with_bits(hopeful, "place", "x").join(partners, near, "left_semi"), "late")
    partners = stored(partners.join(hopeful, near, "left_semi"), "others")
    # Full token sets of the lines that a comparison needs.
    busy = reduce(DataFrame.unionByName, [pairs.select("place"), pairs.select(F.col("other").alias("place")), hopeful.select("place"),
                                          partners.select(F.col("other").alias("place"))]).distinct()
    busy = stored(busy, "busy")
    wanted = busy.groupBy(F.col("place.doc_id").alias("of")).agg(F.collect_set("place.at").alias("wanted"))
    held = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["of"])).select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"), "mark", "wanted").select(
        "doc_id", (F.col("mark") + F.col("at")).alias("at"), "line", "wanted").where(F.array_contains("wanted", F.col("at")))
    held = stored(held.select(place.alias("place"), _tokens(F.col("line"), width).alias("tokens"))
                  .groupBy("place").agg(F.first("tokens").alias("tokens")), "tokens")

    def alike(x: Column, y: Column) -> Column:
        return let(F.size(F.array_intersect(x, y)), lambda both: 100 * both >= percent * (F.size(x) + F.size(y) - both))

    left = held.select("place", F.col("tokens").alias("x"))
    right = held.select(F.col("place").alias("other"), F.col("tokens").alias("y"))
    matched = stored(pairs.join(left, "place").join(right, "other").where(alike(F.col("x"), F.col("y"))).select("place").distinct(), "matched")
    hopeful = stored(hopeful.join(matched, "place", "left_anti"), "late")
    partners = stored(partners.join(hopeful, near, "left_semi"), "others")
    left, right = left.withColumnRenamed("x", "mine"), right.withColumnRenamed("y", "theirs")
    more = hopeful.join(left, "place").join(partners.join(right, "other"), near & alike(F.col("mine"), F.col("theirs")), "left_semi")
    more = stored(more.select("place").distinct(), "more")
    gone = matched.unionByName(more).withColumn("gone", F.lit(True))
    verdicts = classes.select("k1", "k2", "place", "copies").join(gone, "place", "left").where("gone OR copies > 1").select(
        "k1", "k2", F.col("place").alias("first"), F.coalesce("gone", F.lit(False)).alias("gone"))
    removed = stored(lines.select("doc_id", "at", _named(F.col("line"), 1).alias("k1"), _named(F.col("line"), 2).alias("k2"))
               .join(verdicts, ["k1", "k2"]).where(F.col("gone") | (place > F.col("first")))
               .groupBy(F.col("doc_id").alias("of"), F.shiftrightunsigned("at", 31).alias("by")).agg(
                   F.sort_array(F.collect_set((F.col("at") % LINES).cast("int"))).alias("removed_lines")), "removed")
    return _cut(docs, removed, several_texts)


def _several_texts(texts: DataFrame) -> DataFrame:
    """Ids that stand for more than one text."""
    mark = F.xxhash64("text")
    ids = texts.groupBy("doc_id").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low < high")
    return stored(ids.select(F.col("doc_id").alias("several")), "several")


def _number(text: Column, several: Column) -> Column:
    """0, or for ids with several texts 32 bits of a hash of the text."""
    return F.when(several.isNotNull(), F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 32)).otherwise(F.lit(0).cast("long"))


def _marked(texts: DataFrame, several: DataFrame) -> DataFrame:
    """Texts with `mark`, which is added to the numbers of their lines."""
    met = several.select("several", F.lit(True).alias("shared"))
    out = texts.join(met, texts["doc_id"].eqNullSafe(met["several"]), "left")
    return out.select("doc_id", "text", (_number(F.col("text"), F.col("shared")) * LINES).alias("mark"))


def _cut(docs: DataFrame, removed: DataFrame, several: DataFrame) -> DataFrame:
    kept = [c for c in docs.columns if c not in ("text", "n_lines", "removed_lines")]
    met = several.select("several", F.lit(True).alias("shared"))
    key = docs["doc_id"].cast("long")
    told = docs.join(met, key.eqNullSafe(met["several"]), "left")
    out = told.join(removed, key.eqNullSafe(removed["of"]) & (_number(docs["text"], met["shared"]) == removed["by"]), "left")
    found = removed["removed_lines"]
    left = let(found, lambda gone: F.array_join(F.filter(
        F.split(docs["text"], "\n", -1), lambda line, i: ~F.array_contains(gone, i)), "\n"))
    return out.select(*[docs[f"`{c}`"] for c in kept],
                      F.when(found.isNull(), docs["text"]).otherwise(left).alias("text"),
                      F.size(F.split(F.coalesce(docs["text"], F.lit("")), "\n", -1)).cast("long").alias("n_lines"),
                      F.coalesce(found, F.array().cast("array<int>")).alias("removed_lines"))
