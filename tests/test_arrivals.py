"""Arrivals inside windows, and the helpers that find them, against one value at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from percussa.functions import dsp
from percussa.operators import arrivals as A
from percussa.operators import detection as D


def brute_prominence(x, p):
    bases = []
    for side in (x[:p][::-1], x[p + 1:]):
        low = x[p]
        for v in side:
            if v > x[p]:
                break
            low = min(low, v)
        bases.append(low)
    return x[p] - max(bases)


def brute_apart(position, value, distance):
    kept = []
    for v, p in sorted(zip(value, position), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    return [p in kept for p in position]


@pytest.mark.parametrize("seed", range(6))
def test_prominences_and_spacing(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, rng.integers(3, 400)).astype(float)
    at = dsp.local_maxima(x)
    assert dsp.prominences(x, at).tolist() == [brute_prominence(x, p) for p in at]
    for distance in (1, 3, 17):
        assert dsp.keep_apart(at, x[at], distance).tolist() == brute_apart(at, x[at], distance)


def test_rows_do_not_meet():
    """Rows of a matrix give what each row alone gives."""
    rng = np.random.default_rng(3)
    env = dsp.envelope(rng.normal(0, 1, (40, 200)) * rng.choice([1e-3, 1, 50], 40)[:, None])
    env[7] = 0
    row, at = A.strongest(env, 48000.0)
    for k in range(40):
        alone = A.strongest(env[k:k + 1], 48000.0)[1]
        assert at[row == k].tolist() == alone.tolist() and len(alone) <= 4
        assert k != 7 or not len(alone)


def test_two_arrivals_and_their_character(spark):
    fs, n = 192000, 4800
    t = np.arange(n) / fs
    crack = np.where(t >= 0.002, 0.35 * np.exp(-(t - 0.002) / 0.00012) * np.sin(2 * np.pi * 9000 * (t - 0.002)), 0.0)
    blast = np.where(t >= 0.010, 0.95 * np.exp(-(t - 0.010) / 0.004) * np.sin(2 * np.pi * 700 * (t - 0.010)), 0.0)
    rows = [("both", fs, (crack + blast).tolist()), ("silent", fs, [0.0] * n), ("short", fs, [1.0] * 63), ("none", fs, [])]
    df = spark.createDataFrame(rows, "name string, fs int, samples array<double>")
    out = df.select("name", A.arrivals_of("samples", "fs").alias("arrivals"))
    got = {r.name: r.arrivals for r in out.collect()}
    assert got["silent"] == got["short"] == got["none"] == []
    first, main = got["both"][0], max(got["both"], key=lambda a: a.peak_Pa)
    assert first.offset_s == pytest.approx(0.002, abs=0.0003) and main.offset_s == pytest.approx(0.010, abs=0.001)
    assert first.centroid_Hz > 2 * main.centroid_Hz and main.decay_ms > 2 * first.decay_ms
    marked = out.where("name = 'both'").select(F.inline(D.classify_arrivals("arrivals"))).collect()
    assert [m.basis for m in marked if m.label == "crack"] == ["spectral"]
