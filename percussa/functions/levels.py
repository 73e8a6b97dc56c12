"""Decibel expressions on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the level definitions.
P_REF = 20e-6        # Pa
EPS = 1e-30          # floor under every logarithm


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value) -> Column:
    """NULL in place of NaN and the infinities."""
    c = _col(value).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def amplitude_level(value) -> Column:
    """Level of a pressure amplitude in Pa."""
    a = F.abs(_col(value))
    return 20 * F.log10(F.when(a.isNotNull(), F.greatest(a, F.lit(EPS))) / F.lit(P_REF))


def power_level(value) -> Column:
    """Level of a mean square pressure or of a squared-pressure integral."""
    p = _col(value)
    return 10 * F.log10(F.when(p.isNotNull(), F.greatest(p, F.lit(EPS))) / F.lit(P_REF * P_REF))


def amplitude_of(level) -> Column:
    """Pressure amplitude in Pa of a level."""
    return F.lit(P_REF) * F.pow(F.lit(10.0), _col(level) / 20)


def full_scale_level(pa_per_fs) -> Column:
    """Level a full-scale sample stands for."""
    return amplitude_level(pa_per_fs)


def level_unit(calibrated) -> Column:
    return F.when(_col(calibrated), "dB SPL").otherwise("dB re FS")


def power_of(level) -> Column:
    """Relative power of a level."""
    return F.pow(F.lit(10.0), _col(level) / 10)


def energy_mean(level) -> Column:
    """Aggregate: energy mean of levels; non-finite levels are left out."""
    return 10 * F.log10(F.avg(power_of(finite(level))))


def energy_sum(level) -> Column:
    """Aggregate: level of the summed power."""
    return 10 * F.log10(F.sum(power_of(finite(level))))


def spread(level) -> Column:
    """Aggregate: sample deviation, 0 for a single value, NULL for none."""
    v = finite(level)
    return F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.stddev_samp(v))


def let(value, body) -> Column:
    """`body` of a value computed once.

    An expression used inside a lambda is evaluated per element; bound as a
    lambda variable it is evaluated once per row.
    """
    return F.transform(F.array(_col(value)), body)[0]


def rms(samples) -> Column:
    """RMS of an array column."""
    return F.sqrt(sum_squares(samples) / F.size(_col(samples)))


def sum_squares(samples) -> Column:
    return F.aggregate(_col(samples), F.lit(0.0), lambda acc, x: acc + x * x)


def peak(samples) -> Column:
    """Largest absolute value of an array column."""
    return F.array_max(F.transform(_col(samples), lambda x: F.abs(x)))


def scaled(samples, factor) -> Column:
    """Array times a factor column; full scale to Pa when the factor is Pa per FS."""
    f = _col(factor)
    return F.transform(_col(samples), lambda x: x * f)
