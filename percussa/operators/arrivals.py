"""Separate arrivals inside a shot's window and what each sounds like.

Windows of one length and rate are rows of a matrix; every step below works on all of them at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from percussa.functions import dsp
from percussa.functions import levels as L
from percussa.operators.shots import per_shape

# Fixed values of the search: how many, how far below the top, how far apart, how prominent.
MOST, WITHIN_DB, APART_S, PROMINENT = 4, 20.0, 0.0005, 0.1
# Fixed values of the character: stretch that is looked at, fall that is timed.
STRETCH_S, FALL_DB, LEAST_SAMPLES = 0.002, 10.0, 8
# Samples of all windows that are searched together.
TOGETHER = 1 << 18

_ARRIVAL = T.ArrayType(T.StructType([
    T.StructField("offset_s", T.DoubleType()), T.StructField("peak_Pa", T.DoubleType()),
    T.StructField("centroid_Hz", T.DoubleType()), T.StructField("decay_ms", T.DoubleType())]))


def strongest(env: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, sample) of the arrivals of each row of envelopes, in order of time."""
    rows, n = env.shape
    top = env.max(axis=1)
    # One line of all rows; a wall above every value stands around each.
    line = np.full((rows, n + 1), np.inf)
    line[:, 1:] = env
    line = np.append(line.ravel(), np.inf)
    at = dsp.local_maxima(line)
    row = at // (n + 1)
    tall = np.isfinite(line[at]) & (line[at] >= top[row] * 10 ** (-WITHIN_DB / 20)) & (top[row] > L.EPS)
    at = at[tall]
    at = at[dsp.keep_apart(at + at // (n + 1) * n, line[at], max(1, int(APART_S * rate)))]
    at = at[dsp.prominences(line, at) >= PROMINENT * top[at // (n + 1)]]
    row = at // (n + 1)
    order = np.lexsort((-at, -line[at], row))
    place = np.arange(len(at)) - np.searchsorted(row[order], row[order])
    chosen = np.sort(at[order][place < MOST])
    return chosen // (n + 1), chosen % (n + 1) - 1


def character(x: np.ndarray, env: np.ndarray, rate: float, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Magnitude centroid of the stretch behind each arrival, and the time its envelope takes to fall; NaN for none."""
    n = x.shape[1]
    centroid, fall = np.full(len(row), np.nan), np.full(len(row), np.nan)
    length = np.minimum(n - start, max(LEAST_SAMPLES, int(round(STRETCH_S * rate))))
    for size in np.unique(length[length >= LEAST_SAMPLES]):
        these = np.flatnonzero(length == size)
        part = x[row[these, None], start[these, None] + np.arange(size)]
        magnitude = np.abs(np.fft.rfft(part * np.hanning(size), axis=1))
        whole = magnitude.sum(axis=1)
        heard = whole > L.EPS
        centroid[these[heard]] = (magnitude[heard] @ np.fft.rfftfreq(size, 1 / rate)) / whole[heard]
    height = env[row, start]
    low = (env[row] <= (height * 10 ** (-FALL_DB / 20))[:, None]) & (np.arange(n) >= start[:, None])
    falls = low.any(axis=1) & (height > L.EPS)
    fall[falls] = (low.argmax(axis=1) - start)[falls] * 1000 / rate
    return centroid, fall


@F.pandas_udf(_ARRIVAL)
def arrivals_of(samples: pd.Series, fs: pd.Series) -> pd.Series:
    """The four strongest envelope peaks of each window, in time order, with their character; none below 64 samples."""
    out = pd.Series([[]] * len(samples), index=samples.index, dtype=object)
    for at, x, rate in per_shape(samples, fs):
        if x.shape[1] < 64:
            continue
        step = max(1, TOGETHER // x.shape[1])
        for k in range(0, len(x), step):
            some, env = x[k:k + step], dsp.envelope(x[k:k + step])
            row, start = strongest(env, rate)
            centroid, fall = character(some, env, rate, row, start)
            found = [[] for _ in some]
            for r, s, c, f in zip(row.tolist(), start.tolist(), centroid.tolist(), fall.tolist()):
                found[r].append({"offset_s": s / rate, "peak_Pa": float(env[r, s]), "centroid_Hz": None if c != c else c,
                                 "decay_ms": None if f != f else f})
            for i, rows in zip(at[k:k + step], found):
                out[i] = rows
    return out
