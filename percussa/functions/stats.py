"""Student t without scipy: a vectorised incomplete beta inside pandas UDFs.

Each UDF sees one row per string or per pair, never samples.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lgamma(v):
    flat, inverse = np.unique(v, return_inverse=True)
    return np.array([math.lgamma(x) for x in flat])[inverse].reshape(np.shape(v))


def _beta_fraction(a, b, x, steps: int = 400):
    """Continued fraction of the incomplete beta, by the modified Lentz rule."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            delta = c * d
            h = h * delta
        if np.all(np.abs(delta - 1) < 1e-14):
            break
    return h


def incomplete_beta(a, b, x):
    """Regularised incomplete beta I_x(a, b) over numpy arrays."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(
        _lgamma(a + b) - _lgamma(a) - _lgamma(b)
        + a * np.log(inside) + b * np.log1p(-inside)
    )
    swap = inside > (a + 1) / (a + b + 2)
    aa, bb = np.where(swap, b, a), np.where(swap, a, b)
    xx = np.where(swap, 1 - inside, inside)
    part = front * _beta_fraction(aa, bb, xx) / aa
    out = np.where(swap, 1 - part, part)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_upper_tail(t, df):
    """P(T > t) for Student's t."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    half = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return np.where(t >= 0, half, 1 - half)


def t_quantile_upper(tail, df):
    """t with P(T > t) = tail for tail <= 0.5: bisection, then Newton steps."""
    tail, df = np.broadcast_arrays(np.asarray(tail, float), np.asarray(df, float))
    low, high = np.zeros(tail.shape), np.ones(tail.shape)
    for _ in range(200):
        short = t_upper_tail(high, df) > tail
        if not short.any():
            break
        low, high = np.where(short, high, low), np.where(short, high * 2, high)
    for _ in range(14):
        mid = (low + high) / 2
        above = t_upper_tail(mid, df) > tail
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    t = (low + high) / 2
    scale = _lgamma((df + 1) / 2) - _lgamma(df / 2) - 0.5 * np.log(df * np.pi)
    for _ in range(5):
        density = np.exp(scale - (df + 1) / 2 * np.log1p(t * t / df))
        t = np.clip(t + (t_upper_tail(t, df) - tail) / density, low, high)
    return t


def _masked(fn, first: pd.Series, df: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=first.index, dtype="float64")
    ok = first.notna() & df.notna() & (df >= 1)
    if ok.any():
        out[ok] = fn(first[ok].to_numpy(float), df[ok].to_numpy(float))
    return out.astype(object).where(out.notna(), None)


@F.pandas_udf(T.DoubleType())
def t_sf(t: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of Student's t; NULL where undefined."""
    return _masked(t_upper_tail, t, df)


@F.pandas_udf(T.DoubleType())
def t_isf(tail: pd.Series, df: pd.Series) -> pd.Series:
    """Quantile of Student's t by its upper tail; NULL where undefined."""
    return _masked(t_quantile_upper, tail, df)
