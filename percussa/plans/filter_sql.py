"""SQL for frequency filters: the response in closed form, its impulse response by a sum over bins, then a convolution.

Filters run over zero-padded data of `size` points, so the impulse response is a circular one of that size.
"""

from __future__ import annotations

import math

# Weighting poles in Hz.
POLES = {"F1": 20.598997, "F2": 107.65265, "F3": 737.86223, "F4": 12194.217}


def analog(f: float, fs: float) -> float:
    """Angular frequency whose digital image lies at f."""
    return 2 * fs * math.tan(math.pi * f / fs) if f < fs / 2 else 2 * math.pi * f


def padded(n: int) -> int:
    return 1 << (n - 1).bit_length()


def _sigma(fs: float, size: int) -> str:
    return f"(2 * {float(fs)!r}::DOUBLE * tan(least(pi() * k / {size}, pi() / 2 - 1e-9::DOUBLE)))"


def weighting_sql(kind: str, fs: float) -> tuple[str, str]:
    """Magnitude and phase of the A or C weighting at `s` (radians a second)."""
    w1, w2, w3, w4 = (repr(analog(f, fs)) + "::DOUBLE" for f in POLES.values())

    def size(s):
        if kind == "A":
            return f"({s} ** 4 / (({s} ** 2 + {w1} ** 2) * ({s} ** 2 + {w4} ** 2) * sqrt(({s} ** 2 + {w2} ** 2) * ({s} ** 2 + {w3} ** 2))))"
        return f"({s} ** 2 / (({s} ** 2 + {w1} ** 2) * ({s} ** 2 + {w4} ** 2)))"

    one = repr(analog(min(1000.0, fs / 2 * 0.999), fs)) + "::DOUBLE"
    turn = f"- 2 * atan(s / {w1}) - 2 * atan(s / {w4})"
    turn = f"2 * pi() {turn} - atan(s / {w2}) - atan(s / {w3})" if kind == "A" else f"pi() {turn}"
    return f"{size('s')} / {size(one)}", turn


def band_sql(fs: float, low: float, high: float, order: int) -> tuple[str, str]:
    """Magnitude and phase of a causal Butterworth band-pass."""
    w1, w2 = analog(low, fs), analog(high, fs)
    u = f"((s * s - {w1 * w2!r}::DOUBLE) / ({w2 - w1!r}::DOUBLE * greatest(s, 1e-9::DOUBLE)))"
    angles = [math.pi * (2 * k + order - 1) / (2 * order) for k in range(1, order + 1)]
    turn = " - ".join(f"atan2({u} - {math.sin(a)!r}::DOUBLE, {-math.cos(a)!r}::DOUBLE)" for a in angles)
    return f"1 / sqrt(1 + {u} ** {2 * order})", f"-{turn}"


def both_ways_high_pass_sql(fs: float, cutoff: float) -> tuple[str, str]:
    """Second order, forwards and backwards."""
    return f"1 / (1 + ({analog(cutoff, fs)!r}::DOUBLE / greatest(s, 1e-9::DOUBLE)) ** 4)", "0"


def both_ways_band_sql(fs: float, low: float, high: float) -> tuple[str, str]:
    """Second order, forwards and backwards."""
    return band_sql(fs, low, high, 2)[0] + " ** 2", "0"


def kernel_cte(name: str, response: tuple[str, str], fs: float, size: int, reach: int) -> str:
    """CTE name(d, h): the impulse response at distances -reach < d < reach."""
    magnitude, phase = response
    return f"""{name}_f AS (SELECT k, {magnitude} AS m, {phase} AS p FROM (SELECT k, {_sigma(fs, size)} AS s FROM range({size // 2 + 1}) t(k))),
{name} AS (SELECT d, sum(CASE WHEN k IN (0, {size // 2}) THEN m * cos(p) * cos(2 * pi() * k * d / {size}) ELSE 2 * m * cos(2 * pi() * k * d / {size} + p) END) / {size} AS h
  FROM {name}_f, range({1 - reach}, {reach}) t(d) GROUP BY d)"""


def high_pass_size(n: int, fs: float, cutoff: float = 10.0) -> int:
    pad = math.ceil(5 * fs / (2 * math.pi * cutoff))
    return padded(n + 2 * pad + 2 * int(8 / (2 * math.pi * cutoff) * fs) + 1)


def weighting_size(n: int, fs: float) -> int:
    return padded(n + 2 * int(12 / (2 * math.pi * POLES["F1"]) * fs) + 1)


def _one_pole_ctes(name: str, source: str, pole: complex, weight: complex, direct: float, block: int = 1024) -> str:
    """CTE name: `source` (recording_id, i from 0 without gaps, u, rest) with y, what the one-pole filter answers to u after `rest` for ever.

    Powers of the pole are taken from the begin of a block, where they neither vanish nor overflow; blocks meet all earlier ones.
    """
    rate, turn = -math.log(abs(pole)), math.atan2(pole.imag, pole.real)
    settled = 1 / (1 - pole)

    def power(n, re, im):
        size, angle = f"exp({-rate!r}::DOUBLE * ({n}))", f"({turn!r}::DOUBLE * ({n}))"
        return f"{size} * (cos{angle} * ({re}) - sin{angle} * ({im}))", f"{size} * (sin{angle} * ({re}) + cos{angle} * ({im}))"

    first, second = power(f"-(i % {block})", "u", "0")
    carried, turned = power(f"{block} * (b.k - a.k)", "a.re", "a.im")
    own = power(f"i % {block}", "w.re + coalesce(c.re, 0)", "w.im + coalesce(c.im, 0)")
    before = power("i + 1", f"{settled.real!r}::DOUBLE * rest", f"{settled.imag!r}::DOUBLE * rest")
    return f"""{name}_w AS (SELECT *, i // {block} AS k, sum({first}) OVER q AS re, sum({second}) OVER q AS im FROM {source}
  WINDOW q AS (PARTITION BY recording_id, i // {block} ORDER BY i ROWS UNBOUNDED PRECEDING)),
{name}_e AS (SELECT recording_id, k, arg_max(re, i) AS re, arg_max(im, i) AS im FROM {name}_w GROUP BY 1, 2),
{name}_c AS (SELECT b.recording_id, b.k, sum({carried}) AS re, sum({turned}) AS im
  FROM {name}_e b JOIN {name}_e a ON a.recording_id IS NOT DISTINCT FROM b.recording_id AND a.k < b.k GROUP BY 1, 2),
{name} AS (SELECT w.* EXCLUDE (re, im, k), {direct!r}::DOUBLE * u
    + 2 * ({weight.real!r}::DOUBLE * ({own[0]} + {before[0]}) - {weight.imag!r}::DOUBLE * ({own[1]} + {before[1]})) AS y
  FROM {name}_w w LEFT JOIN {name}_c c ON c.recording_id IS NOT DISTINCT FROM w.recording_id AND c.k = w.k)"""


def high_passed_ctes(name: str, source: str, fs: float, cutoff: float) -> str:
    """CTE name(recording_id, n, x, z): each recording of `source` (recording_id, n, x) high-passed as one signal.

    Mean removed, five time constants of silence, second-order Butterworth forwards, then back from its last value.
    """
    s = math.tan(math.pi * cutoff / fs) * complex(-math.sqrt(0.5), math.sqrt(0.5))
    pole = (1 + s) / (1 - s)
    gain = abs(1 + pole) ** 2 / 4
    filtered = pole, gain * (1 - 1 / pole) ** 2 / (1 - pole.conjugate() / pole), gain / abs(pole) ** 2
    pad = max(math.ceil(5 * fs / (2 * math.pi * cutoff)), 9)
    return f"""{name}_known AS (SELECT recording_id, n, CASE WHEN NOT isnan(x) THEN x END AS x FROM {source}),
{name}_size AS (SELECT recording_id, min(n) AS lo, max(n) - min(n) + 1 AS size, coalesce(avg(x), 0) AS mean FROM {name}_known GROUP BY 1),
{name}_places AS (SELECT *, unnest(range(CASE WHEN {pad} >= 10 * size THEN 2 * size ELSE size + {pad} END)) AS i FROM {name}_size),
{name}_in AS (SELECT p.*, k.n, k.x, coalesce(k.x - mean, 0) AS u, 0 AS rest
  FROM {name}_places p LEFT JOIN {name}_known k ON k.recording_id IS NOT DISTINCT FROM p.recording_id AND k.n = p.lo + p.i),
{_one_pole_ctes(f"{name}_once", f"{name}_in", *filtered)},
{name}_back AS (SELECT recording_id, n, x, size, u AS plain, max(i) OVER r - i AS i, y AS u, arg_max(y, i) OVER r AS rest
  FROM {name}_once WINDOW r AS (PARTITION BY recording_id)),
{_one_pole_ctes(f"{name}_twice", f"{name}_back", *filtered)},
{name} AS (SELECT recording_id, n, x, CASE WHEN x IS NULL THEN NULL WHEN size < 32 THEN plain ELSE y END AS z FROM {name}_twice WHERE n IS NOT NULL)"""
