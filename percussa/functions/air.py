"""Propagation in air as Column expressions (ISO 9613-1 and spherical spreading)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the standard.
P_REF_KPA = 101.325
T_REF_K = 293.15
T_TRIPLE_K = 273.16
T_ZERO_C_K = 273.15
C_REF = 343.2
DEFAULT_AIR = {"temperature_C": 20.0, "humidity_pct": 50.0, "pressure_kPa": 101.325}
RANGES = {"temperature_C": (-20.0, 50.0), "humidity_pct": (10.0, 100.0)}
BAND_RANGE_HZ = (50.0, 10000.0)
GAMMA_AIR = 1.4
P_ATM_PA = 101325.0
NONLINEAR_MACH = 0.01


def vapour_pct(t_k: Column, humidity: Column, pressure: Column) -> Column:
    """Molar concentration of water vapour in percent."""
    saturation = F.pow(F.lit(10.0), -6.8346 * F.pow(T_TRIPLE_K / t_k, F.lit(1.261)) + 4.6151)
    return humidity * saturation / (pressure / P_REF_KPA)


def terms(temperature_C: Column, humidity: Column, pressure: Column) -> Column:
    """The parts of the attenuation that do not depend on frequency, as a struct.

    Compute it once per recording, before the bands are added.
    """
    t_k = temperature_C + T_ZERO_C_K
    p, t = pressure / P_REF_KPA, t_k / T_REF_K
    h = vapour_pct(t_k, humidity, pressure)
    oxygen_Hz = p * (24.0 + 4.04e4 * h * (0.02 + h) / (0.391 + h))
    nitrogen_Hz = p * F.pow(t, F.lit(-0.5)) * (
        9.0 + 280.0 * h * F.exp(-4.170 * (F.pow(t, F.lit(-1.0 / 3.0)) - 1.0)))
    spread = F.pow(t, F.lit(-2.5))
    return F.struct(
        (1.84e-11 / p * F.sqrt(t)).alias("classical"),
        (spread * 0.01275 * F.exp(-2239.1 / t_k)).alias("oxygen"), oxygen_Hz.alias("oxygen_Hz"),
        (spread * 0.1068 * F.exp(-3352.0 / t_k)).alias("nitrogen"), nitrogen_Hz.alias("nitrogen_Hz"))


def alpha(frequency: Column, air: Column) -> Column:
    """Attenuation coefficient in dB/m at a frequency, from `terms`."""
    f2 = frequency * frequency
    return 8.686 * f2 * (air["classical"] + air["oxygen"] / (air["oxygen_Hz"] + f2 / air["oxygen_Hz"])
                         + air["nitrogen"] / (air["nitrogen_Hz"] + f2 / air["nitrogen_Hz"]))


def absorption(frequency: Column, temperature_C: Column, humidity: Column, pressure: Column) -> Column:
    """Attenuation coefficient in dB/m."""
    return alpha(frequency, terms(temperature_C, humidity, pressure))


def spreading(distance: Column, reference: Column) -> Column:
    """Level change from `distance` to `reference` by spherical spreading."""
    return 20 * F.log10(distance / reference)


def sound_speed(temperature_C: Column) -> Column:
    return C_REF * F.sqrt((temperature_C + T_ZERO_C_K) / T_REF_K)


def air_density(temperature_C: Column, pressure: Column) -> Column:
    return pressure * 1000.0 / (287.05 * (temperature_C + T_ZERO_C_K))


def is_nonlinear(peak_pa: Column) -> Column:
    """True where the peak overpressure is beyond linear propagation."""
    return F.coalesce(F.abs(peak_pa) / (GAMMA_AIR * P_ATM_PA) > NONLINEAR_MACH, F.lit(False))


def crack_delay(distance: Column, angle_deg: Column, velocity: Column, temperature_C: Column) -> Column:
    """Seconds by which the ballistic crack leads the muzzle blast, or NULL."""
    c = sound_speed(temperature_C)
    x = distance * F.cos(F.radians(angle_deg))
    y = F.abs(distance * F.sin(F.radians(angle_deg)))
    mu = F.asin(F.when(velocity > c, c / velocity))
    shed = x - y * F.tan(mu)
    delay = F.sqrt(x * x + y * y) / c - (shed / velocity + y / F.cos(mu) / c)
    return F.when((velocity > c) & (distance > 0) & (y > 0) & (shed >= 0), delay)


def _sql_absorption() -> str:
    """The same coefficient as SQL text over columns f, tc, rh, kpa."""
    tk, p, t = "(tc + 273.15::DOUBLE)", "(kpa / 101.325::DOUBLE)", "((tc + 273.15::DOUBLE) / 293.15::DOUBLE)"
    h = f"(rh * power(10::DOUBLE, -6.8346::DOUBLE * power(273.16::DOUBLE / {tk}, 1.261::DOUBLE) + 4.6151::DOUBLE) / {p})"
    o = f"({p} * (24 + 40400::DOUBLE * {h} * (0.02::DOUBLE + {h}) / (0.391::DOUBLE + {h})))"
    n = (f"({p} * power({t}, -0.5::DOUBLE) * (9 + 280::DOUBLE * {h} * "
         f"exp(-4.17::DOUBLE * (power({t}, -1 / 3::DOUBLE) - 1))))")
    return (f"(8.686::DOUBLE * f * f * (1.84e-11::DOUBLE / {p} * sqrt({t}) + power({t}, -2.5::DOUBLE) * ("
            f"0.01275::DOUBLE * exp(-2239.1::DOUBLE / {tk}) / ({o} + f * f / {o}) + "
            f"0.1068::DOUBLE * exp(-3352::DOUBLE / {tk}) / ({n} + f * f / {n}))))")


ABSORPTION_SQL = _sql_absorption()
