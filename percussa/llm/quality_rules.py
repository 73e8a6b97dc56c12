"""Quality rules with robust multivariate outliers: minimum covariance determinant for each language and source.

Native: one pass of array expressions makes the statistics of each text; no text is shuffled. The estimate runs on
the transformed statistic vectors, which are rounded to integers, so that all sums are exact and reruns agree. It
starts at the group's medians with the least spreads as its spread, and takes concentration steps: the half of the rows
nearest to the current centre gives the next centre and covariance. Distances are counted in cells, so a quantile is a
small table of counts, whatever the size of a group.

Vector: ln(1 + characters a word), ln(1 + symbols a word), share of lines that repeat one, share of words in repeated
windows. Most texts have no symbols and no repeats at all, and the plain estimate would then reject the first one; so
`reach` says how far from the centre a text of a group without spread lies when one value alone rejects it. The least
spread of a value is its reach over the root of the cutoff; a spread is the larger of it and the estimate, never their
sum. The base rule leaves shares of lines below 1 and of words up to 0.5, and each reach lies inside.

Defined cases: a NULL text has no words and fails the base rule; NULL lang or source are values of their own; a group
of fewer than `least_rows` texts that pass the base rule rejects nothing more; repeated rows count as often as they
come; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from percussa.llm.common import WORD, let, stored, words

UNIT = 4096                                  # integers in one unit of a transformed statistic
REACH = (0.4, 0.23, 0.5, 0.35)               # words 1.5 x as long, 0.26 symbols a word, half of the lines, 35 % of the words
CUTOFF = 33.3768                             # 1 - 1e-6 quantile of chi-square with 4 degrees of freedom
MEDIANS = (0.4549, 1.3863, 2.3660, 3.3567)   # medians of chi-square with 1 to 4
DIMS = range(4)
PAIRS = [(i, j) for i in DIMS for j in DIMS if j <= i]


def _repeated_words(ws: Column) -> Column:
    """Words inside windows of three words that occur twice or more."""
    windows = F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))),
                          lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))

    def covered(held: Column) -> Column:
        ordered = F.sort_array(F.transform(held, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(ordered, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: (
            F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))), lambda x: x["i"])))
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - at, F.lit(3)))),
            F.lit(0).cast("long"), lambda total, x: total + x))

    return let(windows, lambda held: F.when(F.size(F.array_distinct(held)) == F.size(held), F.lit(0).cast("long"))
               .otherwise(covered(held)))


def _measures(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    held = F.length(text)
    return F.struct(
        let(words(text), lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            _repeated_words(ws).alias("n_repeat_words"))).alias("w"),
        let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"),
                                       (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))).alias("l"),
        (held - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"))


def text_statistics(docs: DataFrame) -> DataFrame:
    """Counts of each text and the verdict of the base rule; all columns of `docs` stay, the new ones take precedence."""
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    out = docs.withColumn("_m", _measures(F.coalesce("text", F.lit(""))))
    n, r = F.col("_m.w.n_words"), F.col("_m.w.n_repeat_words")
    return out.select(
        *kept, n.alias("n_words"), F.col("_m.w.word_chars"), F.col("_m.n_symbols"), F.col("_m.l.n_lines"),
        F.col("_m.l.n_dup_lines"), r.alias("n_repeat_words"), ((n < 50) | (100 * r > 50 * n)).alias("base_failed"))


def _named(column: str) -> Column:
    c = F.col(column).cast("string")
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def _vector() -> list[Column]:
    n = F.greatest("n_words", F.lit(1))
    values = [F.log1p(F.col("word_chars") / n), F.log1p(F.col("n_symbols") / n),
              F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), F.col("n_repeat_words") / n]
    return [F.round(v * UNIT).cast("long").alias(f"z{k}") for k, v in enumerate(values)]


def _factor(params: DataFrame, least: list[float]) -> DataFrame:
    """Cholesky factor l{i}{j} of the covariance c{i}{j}, and `free`, how many spreads are above the least ones.

    A pivot is a variance given the values before it. Raising those below the least variance adds to the diagonal
    only, and only what is missing, so the matrix stays positive definite.
    """
    out, free = params, F.lit(0)
    for j in DIMS:
        inner = [F.pow(F.col(f"l{j}{k}"), 2) for k in range(j)]
        floor = F.lit((least[j] * UNIT) ** 2)
        out = out.withColumn(f"v{j}", F.col(f"c{j}{j}") - sum(inner, F.lit(0.0)))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"v{j}"), floor)))
        free = free + (F.col(f"v{j}") > floor).cast("int")
        for i in range(j + 1, len(DIMS)):
            cross = [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)]
            out = out.withColumn(f"l{i}{j}", (F.col(f"c{i}{j}") - sum(cross, F.lit(0.0))) / F.col(f"l{j}{j}"))
    return out.select("g", "n", free.alias("free"), *[f"m{k}" for k in DIMS], *[f"c{i}{j}" for i, j in PAIRS],
                      *[f"l{i}{j}" for i, j in PAIRS])


def _with_distance(rows: DataFrame, params: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with their squared Mahalanobis distance `d2`."""
    out = rows.join(params, "g", how)
    for i in DIMS:
        before = [F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)]
        out = out.withColumn(f"y{i}", (F.col(f"z{i}") - F.col(f"m{i}") - sum(before, F.lit(0.0))) / F.col(f"l{i}{i}"))
    return out.withColumn("d2", sum((F.pow(F.col(f"y{k}"), 2) for k in DIMS), F.lit(0.0)))


def _cell() -> Column:
    return F.floor(8 * F.log2(1 + 16 * F.col("d2")))


def _at_rank(cells: DataFrame, by: list[str], need: Column) -> DataFrame:
    """The least cell at which the counts reach `need`; `cells` has one row for each group and cell."""
    w = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("upto", F.sum("n").over(w)).withColumn(
        "all", F.sum("n").over(Window.partitionBy(*by))).where(F.col("upto") >= need).groupBy(*by).agg(F.min("cell").alias("cell"))


def robust_estimate(rows: DataFrame, least: list[float], steps: int, least_rows: int) -> DataFrame:
    """g, centre and factor for each group of `rows` (g, z0..z3)."""
    half = F.floor((F.col("all") + len(DIMS) + 1) / 2)
    spread = rows.select("g", F.posexplode(F.array(*[f"z{k}" for k in DIMS])).alias("dim", "cell"))
    medians = _at_rank(spread.groupBy("g", "dim", "cell").agg(F.count("*").alias("n")), ["g", "dim"], half)
    counts = rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= least_rows)
    centres = medians.groupBy("g").agg(*[F.max(F.when(F.col("dim") == k, F.col("cell"))).cast("double").alias(f"m{k}") for k in DIMS])
    params = centres.join(counts, "g").withColumns({f"c{i}{j}": F.lit(0.0) for i, j in PAIRS})
    params = stored(_factor(params, least), "centre")
    for _ in range(steps):
        far = _with_distance(rows, params)
        limit = _at_rank(far.groupBy("g", _cell().alias("cell")).agg(F.count("*").alias("n")), ["g"], half)
        limit = stored(params.join(limit, "g"), "limit")
        z = [F.col(f"z{k}").cast("decimal(19,0)") for k in DIMS]
        sums = _with_distance(rows, limit).where(_cell() <= F.col("cell")).groupBy("g").agg(
            F.max("n").alias("n"), F.count("*").alias("h"), *[F.sum(z[k]).alias(f"s{k}") for k in DIMS],
            *[F.sum((F.col(f"z{i}") * F.col(f"z{j}")).cast("decimal(19,0)")).alias(f"q{i}{j}") for i, j in PAIRS])
        h = F.col("h").cast("double")
        s = [F.col(f"s{k}").cast("double") for k in DIMS]
        params = sums.select(
            "g", "n", *[(s[k] / h).alias(f"m{k}") for k in DIMS],
            *[(F.col(f"q{i}{j}").cast("double") / h - (s[i] / h) * (s[j] / h)).alias(f"c{i}{j}") for i, j in PAIRS])
        params = stored(_factor(params, least), "centre")
    # Half of the rows lie nearer than the median of chi-square if the spread is right. Values at their least spread
    # hardly add to a distance, so they don't count as degrees of freedom; widening acts before the least spreads do.
    cells = _with_distance(rows, params).groupBy("g", _cell().alias("cell")).agg(F.count("*").alias("n"))
    middle = (F.pow(F.lit(2.0), (F.col("cell") + 1) / 8) - 1) / 16
    wider = F.when(F.col("free") > 0, F.greatest(F.lit(1.0), middle / F.get(F.array(*map(F.lit, MEDIANS)), F.col("free") - 1)))
    params = params.join(_at_rank(cells, ["g"], half), "g").withColumn("wider", F.coalesce(wider, F.lit(1.0)))
    params = params.withColumns({f"c{i}{j}": F.col(f"c{i}{j}") * F.col("wider") for i, j in PAIRS})
    return stored(_factor(params, least), "estimate")


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF, steps: int = 4, least_rows: int = 20,
                  reach: tuple[float, ...] = REACH) -> DataFrame:
    """`docs` with the statistics, `base_failed`, `distance` (NULL where not measured) and `kept`."""
    measured = text_statistics(docs.select("doc_id", "text", "lang", "source")).drop("text")
    measured = measured.withColumn("g", F.concat(_named("lang"), F.lit("|"), _named("source")))
    measured = stored(measured.select("*", *_vector()), "statistics")
    passed = measured.where(~F.col("base_failed")).select("g", *[f"z{k}" for k in DIMS])
    estimate = robust_estimate(passed, [r / cutoff ** 0.5 for r in reach], steps, least_rows)
    out = _with_distance(measured, estimate, "left").withColumn("distance", F.when(~F.col("base_failed"), F.sqrt("d2")))
    return out.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        "base_failed", "distance",
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))).alias("kept"))
