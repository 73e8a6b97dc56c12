"""Registry of the queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Build], Build]:
    """Register a function under its own name, with the SQL that checks it."""

    def register(build: Build) -> Build:
        QUERIES[build.__name__] = build
        if oracle:
            ORACLES[build.__name__] = oracle
        return build

    return register


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Double columns rounded for comparison; -0 becomes 0."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            d = special.get(f.name, digits)
            out.append((F.round(F.col(f.name).cast("double"), d) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def r(expr: str, name: str, digits: int = 6) -> str:
    """SQL twin of `rounded` for one expression."""
    return f'round(({expr})::DOUBLE, {digits}) + 0.0::DOUBLE AS "{name}"'


def rs(*names: str, digits: int = 6) -> str:
    """Several columns rounded under their own names."""
    return ", ".join(r(f'"{n}"', n, digits) for n in names)


def em(expr: str) -> str:
    """SQL energy mean."""
    return f"10 * log10(avg(power(10.0::DOUBLE, ({expr}) / 10)))"


def t_tail_sql(t: str, df: str) -> str:
    """SQL upper tail of Student's t for whole degrees of freedom, by its finite series."""
    c = f"({df} / ({df} + ({t}) * ({t})))"
    sine = f"(({t}) / sqrt({df} + ({t}) * ({t})))"
    theta = f"atan(({t}) / sqrt({df}))"
    even = (f"{sine} * list_reduce(range(({df} / 2 - 1)::INT, 0, -1)::DOUBLE[], "
            f"lambda acc, j: 1 + (2 * j - 1) / (2 * j) * {c} * acc, 1.0::DOUBLE)")
    odd = (f"2 / pi() * ({theta} + {sine} * sqrt({c}) * list_reduce(range((({df} - 3) / 2)::INT, 0, -1)::DOUBLE[], "
           f"lambda acc, j: 1 + 2 * j / (2 * j + 1) * {c} * acc, 1.0::DOUBLE))")
    return (f"((1 - CASE WHEN {df} = 1 THEN 2 / pi() * {theta} WHEN {df} % 2 = 0 THEN {even} "
            f"ELSE {odd} END) / 2)")


def t_quantile_cte(name: str, source: str) -> str:
    """Recursive CTE `name(df, tail, t)` for the (df, tail) pairs of `source`, by bisection."""
    tail = t_tail_sql("((lo + hi) / 2)", "df")
    return f"""{name}_steps AS (
  SELECT df, tail, 0.0::DOUBLE AS lo, 4000.0::DOUBLE AS hi, 0 AS step FROM ({source})
  UNION ALL
  SELECT df, tail, CASE WHEN above THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN above THEN hi ELSE (lo + hi) / 2 END, step + 1
  FROM (SELECT *, {tail} > tail AS above FROM {name}_steps WHERE step < 64)
), {name} AS (SELECT df, tail, (lo + hi) / 2 AS t FROM {name}_steps WHERE step = 64)"""
