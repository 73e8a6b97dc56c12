"""The split forms give what plain windows give, with one key holding most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from percussa.operators import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    hot = rng.random(3000) < 0.7
    keys = np.where(hot, 0, rng.integers(1, 40, 3000))
    data = [(int(k), int(i), float(np.round(v, 1))) for i, (k, v) in enumerate(zip(keys, rng.normal(0, 2, 3000)))]
    return spark.createDataFrame(data, "key int, pos long, v double").repartition(7)


def same(a, b):
    assert sorted(map(tuple, a.select(*sorted(a.columns)).collect()), key=repr) == sorted(
        map(tuple, b.select(*sorted(b.columns)).collect()), key=repr)


def test_numbered(rows):
    same(O.numbered(rows, ["key"], ["pos"], "rn"), O.numbered(rows, ["key"], ["pos"], "rn", limit=0))


def test_running_sum_of_integers(rows):
    r = rows.withColumn("w", (F.col("pos") % 5).cast("long"))
    same(O.running_sum(r, ["key"], ["pos"], "w", "s"), O.running_sum(r, ["key"], ["pos"], "w", "s", limit=0))


def test_running_max(rows):
    same(O.running_max(rows, ["key"], ["pos"], "v", "m"), O.running_max(rows, ["key"], ["pos"], "v", "m", limit=0))


def test_neighbours(rows):
    args = (rows, ["key"], ["pos"], {"before": "v"}, {"after": "v", "next": "pos"})
    same(O.neighbours(*args), O.neighbours(*args, limit=0))


def test_islands(rows):
    starts = F.col("_p").isNull() | (F.col("pos") - F.col("_p") > 2)
    same(O.islands(rows, ["key"], ["pos"], starts, "i", {"_p": "pos"}),
         O.islands(rows, ["key"], ["pos"], starts, "i", {"_p": "pos"}, limit=0))


def test_percentiles_with_ties(rows):
    points = {"a": 0.05, "b": 0.5, "c": 0.93}
    plain = {r["key"]: r for r in O.percentiles(rows, ["key"], "v", points).collect()}
    split = {r["key"]: r for r in O.percentiles(rows, ["key"], "v", points, limit=0).collect()}
    pdf = rows.toPandas()
    for key, group in pdf.groupby("key"):
        for name, p in points.items():
            want = np.percentile(group["v"], 100 * p)
            assert plain[key][name] == pytest.approx(want)
            assert split[key][name] == pytest.approx(want)
