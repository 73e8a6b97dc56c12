"""Order MinHash fingerprints: sensitive to edit distance, not only to the set of k-mers.

A text is cut into tokens (words, long ones in pieces), each k-mer of tokens gets the number of its occurrence, and the
hash of (k-mer, number) falls into one of BUCKETS ranges. Each range keeps its PICK least hashes, puts them back into
text order and hashes the tuple; that is one coordinate. One hash function split into ranges takes the place of one
function for each coordinate, so a text of n tokens costs n hashes. The likeness of two fingerprints is the share of
coordinates, of those that either has, which are equal.

Native: array expressions on each row; the text itself is shuffled once, to sit beside its neighbour.

Defined cases: NULL counts as the empty text, whose fingerprint is the empty string; two empty texts have likeness 1;
the last k-mers of a text are shorter; a NULL doc_id sorts first, rows that repeat a doc_id sort by text; the only row
of a table is its own neighbour; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from percussa.llm.common import let, range_cells

TOKEN = r"([^\x20\x09-\x0D]{1,12})"
BITS = 6                  # 2^6 coordinates
CELL = 8 << 20            # bytes of text that sort together


def fingerprint(text: Column, k: int = 2) -> Column:
    """Array of longs, one for each coordinate that the text has: its number above 32 bits of its hash."""
    def hashes(ws: Column) -> Column:
        return F.transform(ws, lambda w, i: F.xxhash64(w, *[F.get(ws, i + j) for j in range(1, k)]))

    def numbered(s: Column) -> Column:
        """(hash of k-mer and occurrence, place) from (k-mer, place) in order."""
        heads = F.filter(F.transform(s, lambda x, j: F.when(
            F.coalesce(F.get(s, j - 1)["h"] != x["h"], F.lit(True)), j).otherwise(-1)), lambda j: j >= 0)
        return let(heads, lambda hs: F.flatten(F.transform(hs, lambda j, d: F.transform(
            F.slice(s, j + 1, F.coalesce(F.get(hs, d + 1), F.size(s)) - j),
            lambda x, o: F.struct(F.xxhash64(x["h"], o).alias("v"), x["i"].alias("i"))))))

    def bucket(x: Column) -> Column:
        return F.shiftrightunsigned(x["v"], 64 - BITS)

    def coordinates(s: Column) -> Column:
        """One value for each bucket, from (hash, place) in order of the hash."""
        return F.filter(F.transform(s, lambda x, j: F.when(
            F.coalesce(bucket(F.get(s, j - 1)) == bucket(x), F.lit(False)), F.lit(None)).otherwise(
            let(F.get(s, j + 1), lambda y: F.shiftleft(bucket(x), 32).bitwiseOR(F.when(
                F.coalesce(bucket(y) == bucket(x), F.lit(False)),
                F.when(x["i"] < y["i"], F.xxhash64(x["v"], y["v"])).otherwise(F.xxhash64(y["v"], x["v"]))
            ).otherwise(F.xxhash64(x["v"])).bitwiseAND(F.lit(0xFFFFFFFF)))))), lambda x: x.isNotNull())

    placed = let(F.regexp_extract_all(text, F.lit(TOKEN)), lambda ws: F.sort_array(
        F.transform(hashes(ws), lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ordered = let(placed, lambda s: F.sort_array(numbered(s)))
    return let(ordered, coordinates)


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def likeness(x: Column, y: Column) -> Column:
    """Share of equal coordinates among those that either fingerprint has."""
    places = F.size(F.array_union(F.transform(x, lambda v: F.shiftright(v, 32)), F.transform(y, lambda v: F.shiftright(v, 32))))
    return F.when(places == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / places)


def with_next(docs: DataFrame, cell_bytes: int = CELL) -> DataFrame:
    """doc_id, text, found (the fingerprint), and both of the next row in order of doc_id; the first follows the last."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    celled = docs.withColumn("cell", range_cells(docs, "doc_id", cell_bytes))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    w = Window.partitionBy("cell").orderBy(*order)
    following = F.lead(F.struct("text", "found")).over(w)
    out = celled.withColumn("found", fingerprint(F.col("text"))).withColumn("following", following)
    rank = F.struct(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), F.col("text"))
    heads = celled.groupBy("cell").agg(F.min(rank).alias("head"))
    over = Window.orderBy("cell")
    turns = celled.groupBy("cell").agg(F.count("*").alias("n")).select(
        "cell", F.coalesce(F.lead("cell").over(over), F.min("cell").over(Window.partitionBy())).alias("after"))
    edges = turns.join(heads.select(F.col("cell").alias("after"), F.col("head.text").alias("text")), "after").select(
        "cell", F.struct("text", fingerprint(F.col("text")).alias("found")).alias("edge"))
    return out.join(edges, "cell").select("doc_id", "text", "found", F.coalesce("following", "edge").alias("next"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of the text whose last quarter comes from the next document's beginning."""
    at = with_next(docs)
    n = F.char_length("text")
    q = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - q), F.substring(F.col("next.text"), F.lit(1), q))
    held = at.select("doc_id", n.cast("long").alias("n_chars"), "found", F.col("next.found").alias("next_found"),
                     let(edited, lambda e: F.struct(F.sha2(e.cast("binary"), 256).alias("sha"), fingerprint(e).alias("found"))).alias("edited"))
    return held.select(
        "doc_id", "n_chars", F.col("edited.sha").alias("edited_sha256"), as_text(F.col("found")).alias("fingerprint"),
        as_text(F.col("edited.found")).alias("edited_fingerprint"),
        likeness(F.col("found"), F.col("edited.found")).alias("near_edited"),
        likeness(F.col("found"), F.col("next_found")).alias("near_next"))
