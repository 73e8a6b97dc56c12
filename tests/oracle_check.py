"""Run registered queries next to their SQL: python tests/oracle_check.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from percussa.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def normal(v):
    if v is None:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if isinstance(v, bool) or v is True or v is False:
        return bool(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def database(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf, name):
    df = entry.queries()[name](spark, f"/root/testdata/{sf}")
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows {len(got)} (no SQL)", bool(got)
    res = con.execute(sql)
    wcols, want = rows_of([d[0] for d in res.description], res.fetchall())
    if cols != wcols:
        return f"columns {cols} != {wcols}", False
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b]
        return f"rows {len(got)} vs {len(want)}, differing {len(diff)}: {diff[:2]}", False
    return f"equal, {len(got)} rows", bool(got)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    names = sys.argv[2:] or list(entry.queries())
    spark, con, bad = local_session(), database(sf), []
    for name in names:
        start = time.time()
        try:
            text, ok = compare(spark, con, sf, name)
        except Exception as e:  # report and go on with the next query
            text, ok = f"ERROR {str(e)[:600]}", False
        if not ok:
            bad.append(name)
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.1f}s {text}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
