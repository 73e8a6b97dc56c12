"""Queries that measure every window as a shot."""

from pyspark.sql import functions as F

from percussa.functions import levels as L
from percussa.operators import pairing as P
from percussa.operators import shots as G
from percussa.operators import strings as S
from percussa.plans import bindings as B
from percussa.plans import filter_sql as X
from percussa.plans.catalog import em, query, r, rounded, rs

ID = ["recording_id", "shot_number"]
PREF2 = "(20e-6::DOUBLE * 20e-6::DOUBLE)"


def amp_sql(x):
    return f"20 * log10(greatest(abs({x}), 1e-30::DOUBLE) / 20e-6::DOUBLE)"


def pow_sql(x):
    return f"10 * log10(greatest({x}, 1e-30::DOUBLE) / {PREF2})"


# Analytic signal of N samples: the quadrature part is a circular convolution with 2/N cot(pi k / N), odd k.
ENV_SQL = B.SAMPLES_SQL + """, env AS (
  SELECT a.recording_id, a.shot_number, a.n, any_value(a.x) AS x, any_value(a.n_samples) AS n_samples,
    sqrt(any_value(a.x) ** 2 + sum(CASE WHEN (a.n - b.n) % 2 <> 0 THEN b.x * 2 / a.n_samples / tan(pi() * (a.n - b.n) / a.n_samples) ELSE 0 END) ** 2) AS e
  FROM samples a JOIN samples b USING (recording_id, shot_number) GROUP BY 1, 2, 3),
tops AS (SELECT recording_id, shot_number, max(e) AS top, max(abs(x)) AS peak, any_value(n_samples) AS n_samples FROM env GROUP BY 1, 2),
blast AS (SELECT recording_id, shot_number, any_value(t.n_samples) AS n_samples, any_value(peak) AS peak,
    greatest(0, min(n) FILTER (WHERE e >= top * power(10.0::DOUBLE, -1)) - 8)::INT AS start,
    least(any_value(t.n_samples), max(n) FILTER (WHERE e >= top * power(10.0::DOUBLE, -1)) + 9)::INT AS stop,
    count(*) FILTER (WHERE e >= top * power(10.0::DOUBLE, -1)) AS above, min(n) FILTER (WHERE e >= 0.5::DOUBLE * top) AS onset
  FROM env JOIN tops t USING (recording_id, shot_number) GROUP BY 1, 2)"""
IN_BLAST = "env JOIN blast b USING (recording_id, shot_number) WHERE n >= start AND n < stop"


def enveloped(spark, sf):
    return B.windows(spark, sf).withColumn("envelope", G.envelope_of("samples"))


def blasts(spark, sf):
    out = enveloped(spark, sf).withColumn("blast", G.blast_span())
    return out.withColumn("x", G.part("samples", F.col("blast")["start"], F.col("blast")["stop"]))


@query(f"""WITH {B.SAMPLES_SQL} SELECT recording_id, shot_number, {r(amp_sql("max(abs(x))"), "Lpeak_Z")},
 {r("sqrt(avg(x * x))", "rms", 9)}, {r(amp_sql("sqrt(avg(x * x))"), "level_dB")} FROM samples GROUP BY 1, 2""")
def window_levels(spark, sf):
    w = B.windows(spark, sf)
    return rounded(w.select(*ID, L.amplitude_level(L.peak("samples")).alias("Lpeak_Z"), L.rms("samples").alias("rms"),
                            L.amplitude_level(L.rms("samples")).alias("level_dB")), rms=9)


SPAN_SQL = f"""{B.SAMPLES_SQL}, run AS (SELECT *, sum(x * x) OVER (PARTITION BY shot_number ORDER BY n) AS s,
  sum(x * x) OVER (PARTITION BY shot_number) AS t FROM samples),
span AS (SELECT recording_id, shot_number, (min(n) FILTER (WHERE s / t >= (1 - 0.99::DOUBLE) / 2))::INT AS start,
  least(any_value(n_samples), min(n) FILTER (WHERE s / t >= 1 - (1 - 0.99::DOUBLE) / 2) + 1)::INT AS stop FROM run GROUP BY 1, 2)"""


@query(f"WITH {SPAN_SQL} SELECT recording_id, shot_number, start, stop FROM span")
def integration_span(spark, sf):
    w = B.windows(spark, sf).withColumn("span", G.integration_span())
    return w.select(*ID, "span.start", "span.stop")


@query(f"""WITH {SPAN_SQL} SELECT recording_id, shot_number, {r(pow_sql("sum(x * x) / 8000"), "LZE")}
 FROM samples JOIN span USING (recording_id, shot_number) WHERE n >= start AND n < stop GROUP BY 1, 2""")
def exposure_level(spark, sf):
    w = B.windows(spark, sf).withColumn("span", G.integration_span())
    level = G.exposure(G.part("samples", F.col("span")["start"], F.col("span")["stop"]), F.col("fs"))
    return rounded(w.select(*ID, level.alias("LZE")))


@query(f"WITH {ENV_SQL} SELECT recording_id, shot_number, n::INT AS n, {r('e', 'envelope', 9)} FROM env")
def signal_envelope(spark, sf):
    return rounded(enveloped(spark, sf).select(*ID, F.posexplode("envelope").alias("n", "envelope")), 9)


@query(f"WITH {ENV_SQL} SELECT recording_id, shot_number, start, stop FROM blast")
def blast_span(spark, sf):
    return blasts(spark, sf).select(*ID, "blast.start", "blast.stop")


@query(f"WITH {ENV_SQL} SELECT recording_id, shot_number, {r('above / 8000::DOUBLE * 1000', 'b_duration_ms')} FROM blast")
def b_duration(spark, sf):
    return rounded(enveloped(spark, sf).select(*ID, G.b_duration_ms().alias("b_duration_ms")))


@query(f"""WITH {ENV_SQL} SELECT recording_id, shot_number, {r("20 * log10(max(abs(x)) / sqrt(avg(x * x)))", "crest_factor_dB")}
 FROM {IN_BLAST} GROUP BY 1, 2""")
def crest_factor(spark, sf):
    return rounded(blasts(spark, sf).select(*ID, G.crest_factor(F.col("x")).alias("crest_factor_dB")))


@query(f"WITH {ENV_SQL} SELECT recording_id, shot_number, {r('kurtosis_pop(x)', 'kurtosis')} FROM {IN_BLAST} GROUP BY 1, 2")
def kurtosis(spark, sf):
    return rounded(blasts(spark, sf).select(*ID, G.excess_kurtosis(F.col("x")).alias("kurtosis")))


@query(f"""WITH {ENV_SQL}, q AS (SELECT recording_id, shot_number, avg(x * x) FILTER (WHERE n < start OR n >= stop) AS ms,
  count(*) FILTER (WHERE n < start OR n >= stop) AS k, max(abs(x)) AS peak FROM env JOIN blast b USING (recording_id, shot_number) GROUP BY 1, 2)
SELECT recording_id, shot_number, {r("CASE WHEN k >= 8 THEN " + pow_sql("ms") + " END", "noise_floor_dB")},
 {r("CASE WHEN k >= 8 THEN " + amp_sql("peak") + " - " + pow_sql("ms") + " END", "snr_dB")} FROM q""")
def window_noise(spark, sf):
    out = G.window_noise(enveloped(spark, sf).withColumn("blast", G.blast_span()))
    return rounded(out.select(*ID, "noise_floor_dB", "snr_dB"))


RISE_SQL = """, near AS (SELECT recording_id, shot_number, n, x, greatest(0, onset - 8) AS base FROM env
  JOIN blast USING (recording_id, shot_number) WHERE n >= greatest(0, onset - 8) AND n < least(env.n_samples, onset + 40)),
front AS (SELECT recording_id, shot_number, CASE WHEN max(x) > 1e-30 THEN 1 ELSE -1 END AS sg,
  CASE WHEN max(x) > 1e-30 THEN min_by(n, (-x, n)) ELSE min_by(n, (x, n)) END AS peak_at,
  CASE WHEN max(x) > 1e-30 THEN max(x) ELSE -min(x) END AS pk FROM near GROUP BY 1, 2),
seen AS (SELECT e.recording_id, e.shot_number, e.n, e.x * sg AS v, lag(e.x * sg) OVER (PARTITION BY e.shot_number ORDER BY e.n) AS before, peak_at
  FROM env e JOIN front USING (recording_id, shot_number)),
c90 AS (SELECT s.recording_id, s.shot_number, arg_max(n - 1 + (0.9::DOUBLE * pk - before) / (v - before), n) AS x90 FROM seen s
  JOIN front f USING (recording_id, shot_number) WHERE n >= 1 AND n <= s.peak_at AND v >= 0.9::DOUBLE * pk AND before < 0.9::DOUBLE * pk GROUP BY 1, 2),
c10 AS (SELECT s.recording_id, s.shot_number, arg_max(n - 1 + (0.1::DOUBLE * pk - before) / (v - before), n) AS x10 FROM seen s
  JOIN front f USING (recording_id, shot_number) WHERE n >= 1 AND n <= s.peak_at AND v >= 0.1::DOUBLE * pk AND before < 0.1::DOUBLE * pk GROUP BY 1, 2),
rise AS (SELECT f.recording_id, f.shot_number, CASE WHEN x90 > x10 THEN (x90 - x10) / 8000 * 1e6 ELSE 0 END AS rise_time_us,
  coalesce(x90 > x10 AND x90 - x10 >= 2, false) AS rise_time_resolved
  FROM front f LEFT JOIN c90 USING (recording_id, shot_number) LEFT JOIN c10 USING (recording_id, shot_number))"""


@query(f"""WITH {ENV_SQL}{RISE_SQL} SELECT recording_id, shot_number, {r("rise_time_us", "rise_time_us")}, rise_time_resolved FROM rise""")
def rise_time(spark, sf):
    out = G.with_rise_time(enveloped(spark, sf))
    return rounded(out.select(*ID, "rise_time_us", "rise_time_resolved"))


PHASE_SQL = """, loc AS (SELECT recording_id, shot_number, max(x) AS hi, min(x) AS lo FROM env
  JOIN blast USING (recording_id, shot_number) WHERE n >= onset AND n < least(env.n_samples, onset + 40) GROUP BY 1, 2),
sg AS (SELECT *, CASE WHEN abs(hi) >= abs(lo) THEN 1 ELSE -1 END AS s FROM loc),
v AS (SELECT e.recording_id, e.shot_number, e.n, e.x * s AS v, s, b.onset, e.n_samples FROM env e JOIN sg USING (recording_id, shot_number)
  JOIN blast b USING (recording_id, shot_number)),
pk AS (SELECT recording_id, shot_number, min_by(n, (-v, n)) FILTER (WHERE n >= onset AND n < least(n_samples, onset + 40)) AS top FROM v GROUP BY 1, 2),
ed AS (SELECT v.recording_id, v.shot_number, coalesce(max(n) FILTER (WHERE n < top AND v <= 0) + 1, 0) AS a,
  coalesce(min(n) FILTER (WHERE n >= top AND n < n_samples - 1 AND v <= 0), any_value(n_samples) - 1) AS z FROM v JOIN pk USING (recording_id, shot_number) GROUP BY 1, 2),
phase AS (SELECT v.recording_id, v.shot_number, (any_value(z) - any_value(a)) / 8000::DOUBLE * 1000 AS a_duration_ms,
  sum(greatest(v, 0)) / 8000 AS specific_impulse_Pa_s, any_value(s) * max(v) AS peak_overpressure_Pa
  FROM v JOIN ed USING (recording_id, shot_number) WHERE n >= a AND n < z GROUP BY 1, 2)"""


@query(f"""WITH {ENV_SQL}{PHASE_SQL} SELECT recording_id, shot_number, {r("a_duration_ms", "a_duration_ms")}, {r("specific_impulse_Pa_s", "specific_impulse_Pa_s", 9)},
 {r("peak_overpressure_Pa", "peak_overpressure_Pa", 9)} FROM phase""")
def a_duration(spark, sf):
    out = G.with_a_duration(enveloped(spark, sf))
    return rounded(out.select(*ID, "a_duration_ms", "specific_impulse_Pa_s", "peak_overpressure_Pa"),
                   specific_impulse_Pa_s=9, peak_overpressure_Pa=9)


CENTROID_SQL = f""", cut AS (SELECT recording_id, shot_number, n - start AS i, stop - start AS len,
  x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (n - start) / (stop - start - 1))) AS y FROM {IN_BLAST}),
bins AS (SELECT recording_id, shot_number, k, k * 8000::DOUBLE / any_value(len) AS f,
  sum(y * cos(2 * pi() * k * i / len)) ** 2 + sum(y * sin(2 * pi() * k * i / len)) ** 2 AS p
  FROM cut, range(33) t(k) WHERE k <= len // 2 GROUP BY 1, 2, 3),
centroid AS (SELECT recording_id, shot_number, sum(f * p) / sum(p) AS spectral_centroid_Hz FROM bins WHERE f >= 20 GROUP BY 1, 2)"""


@query(f"""WITH {ENV_SQL}{CENTROID_SQL} SELECT recording_id, shot_number, {r("spectral_centroid_Hz", "spectral_centroid_Hz", 4)} FROM centroid""")
def spectral_centroid(spark, sf):
    w = B.windows(spark, sf).withColumn("t", G.transforms_of("samples", "fs"))
    return rounded(w.select(*ID, "t.spectral_centroid_Hz"), 4)


METRICS = [*S.LEVEL_METRICS, *S.PLAIN_METRICS]


def _average_sql(x, tau):
    """Exponential average of squares at a.n, over pairs a.n >= b.n of one window."""
    return f"(1 - exp(-1 / (8000 * {tau}::DOUBLE))) * sum(b.{x} * b.{x} * exp(-(a.n - b.n) / (8000 * {tau}::DOUBLE)))"


# The window high-passed over silence, then everything the other queries measure, on that.
CONDITIONED_SQL = B.SAMPLES_SQL.replace(", samples AS (", ", raw AS (") + f""", {X.kernel_cte("hp", X.both_ways_high_pass_sql(8000, 10.0), 8000, X.high_pass_size(64, 8000), 64)},
centred AS (SELECT *, x - avg(x) OVER (PARTITION BY shot_number) AS u FROM raw),
samples AS (SELECT a.recording_id, a.shot_number, a.n, any_value(a.n_samples) AS n_samples, sum(b.u * h) AS x
  FROM raw a JOIN centred b USING (recording_id, shot_number) JOIN hp ON d = a.n - b.n GROUP BY 1, 2, 3)"""
METRICS_SQL = CONDITIONED_SQL + f"""{SPAN_SQL[len(B.SAMPLES_SQL):]}{ENV_SQL[len(B.SAMPLES_SQL):]}{RISE_SQL}{PHASE_SQL}{CENTROID_SQL},
{X.kernel_cte("ka", X.weighting_sql("A", 8000), 8000, X.weighting_size(64, 8000), 64)},
{X.kernel_cte("kc", X.weighting_sql("C", 8000), 8000, X.weighting_size(64, 8000), 64)},
wt AS (SELECT a.recording_id, a.shot_number, a.n, any_value(a.x) AS z, sum(b.x * ka.h) AS a, sum(b.x * kc.h) AS c
  FROM samples a JOIN samples b USING (recording_id, shot_number) JOIN ka ON ka.d = a.n - b.n JOIN kc ON kc.d = a.n - b.n GROUP BY 1, 2, 3),
lv AS (SELECT recording_id, shot_number, {amp_sql("max(abs(z))")} AS Lpeak_Z, {pow_sql("max(a * a)")} AS Lpeak_A, {pow_sql("max(c * c)")} AS Lpeak_C,
  {pow_sql("sum(z * z) FILTER (WHERE n >= start AND n < stop) / 8000")} AS LZE, {pow_sql("sum(a * a) FILTER (WHERE n >= start AND n < stop) / 8000")} AS LAE,
  {pow_sql("sum(c * c) FILTER (WHERE n >= start AND n < stop) / 8000")} AS LCE, (any_value(stop) - any_value(start)) / 8000::DOUBLE AS integration_window_s
  FROM wt JOIN span USING (recording_id, shot_number) GROUP BY 1, 2),
av AS (SELECT a.recording_id, a.shot_number, a.n, {_average_sql("a", 0.125)} AS af, {_average_sql("a", 1.0)} AS asl, {_average_sql("a", 0.035)} AS ai,
  {_average_sql("z", 0.125)} AS zf, {_average_sql("z", 1.0)} AS zs, {_average_sql("z", 0.035)} AS zi
  FROM wt a JOIN wt b USING (recording_id, shot_number) WHERE b.n <= a.n GROUP BY 1, 2, 3),
tw AS (SELECT recording_id, shot_number, {", ".join(pow_sql(f"max({c}) FILTER (WHERE n % 8 = 0)") + f" AS {n}" for c, n in (
    ("af", "LAFmax"), ("asl", "LASmax"), ("zf", "LZFmax"), ("zs", "LZSmax")))}, {pow_sql("max(ai)")} AS LAImax, {pow_sql("max(zi)")} AS LZImax FROM av GROUP BY 1, 2),
inb AS (SELECT recording_id, shot_number, 20 * log10(max(abs(x)) / sqrt(avg(x * x))) AS crest_factor_dB, kurtosis_pop(x) AS kurtosis,
  (any_value(stop) - any_value(start)) / 8000::DOUBLE AS blast_duration_s, any_value(above) / 8000::DOUBLE * 1000 AS b_duration_ms FROM {IN_BLAST} GROUP BY 1, 2),
qt AS (SELECT recording_id, shot_number, avg(x * x) FILTER (WHERE n < start OR n >= stop) AS ms,
  count(*) FILTER (WHERE n < start OR n >= stop) AS k, max(abs(x)) AS peak FROM env JOIN blast b USING (recording_id, shot_number) GROUP BY 1, 2),
metrics AS (SELECT *, CASE WHEN k >= 8 THEN {pow_sql("ms")} END AS noise_floor_dB, CASE WHEN k >= 8 THEN {amp_sql("peak")} - {pow_sql("ms")} END AS snr_dB,
  64 / 8000::DOUBLE AS duration_s, list_filter([CASE WHEN NOT rise_time_resolved AND rise_time_us > 0 THEN 'rise time is an upper bound' END,
    'weighting filters started without context'], lambda t: t IS NOT NULL) AS notes
  FROM lv {" ".join(f"JOIN {t} USING (recording_id, shot_number)" for t in ("tw", "inb", "qt", "rise", "phase", "centroid"))})"""


@query(f"""WITH {METRICS_SQL} SELECT recording_id, shot_number, {rs(*METRICS, "LZFmax", "LZSmax", "noise_floor_dB", "snr_dB", "duration_s", "blast_duration_s", "integration_window_s")},
 rise_time_resolved, true AS valid, notes FROM metrics""")
def shot_metrics(spark, sf):
    out = G.shot_metrics(B.windows(spark, sf))
    return rounded(out.select(*ID, *METRICS, "LZFmax", "LZSmax", "noise_floor_dB", "snr_dB", "rise_time_resolved",
                              "duration_s", "blast_duration_s", "integration_window_s", "valid", "notes"))


@query(f"""WITH {SPAN_SQL}, lv AS (SELECT recording_id, CASE WHEN shot_number % 2 = 0 THEN 'unsuppressed' ELSE 'suppressed' END AS cfg,
  shot_number, {amp_sql("max(abs(x))")} AS peak, 20 * log10(max(abs(x)) / sqrt(avg(x * x))) AS crest, {pow_sql("sum(x * x) FILTER (WHERE n >= start AND n < stop) / 8000")} AS expo
  FROM samples JOIN span USING (recording_id, shot_number) GROUP BY 1, 2, 3),
long AS (SELECT recording_id, cfg, 'Lpeak_Z' AS metric, peak AS value FROM lv UNION ALL SELECT recording_id, cfg, 'LZE', expo FROM lv
  UNION ALL SELECT recording_id, cfg, 'crest_factor_dB', crest FROM lv),
st AS (SELECT recording_id, cfg, metric, count(*) AS n, CASE WHEN metric = 'crest_factor_dB' THEN avg(value) ELSE {em("value")} END AS mean,
  CASE WHEN count(*) > 1 THEN 1.96 * stddev_samp(value) / sqrt(count(*)) ELSE 0 END AS ci95 FROM long GROUP BY 1, 2, 3),
j AS (SELECT a.recording_id, metric, a.mean AS am, b.mean AS bm, a.n AS an, b.n AS bn, sqrt(a.ci95 ** 2 + b.ci95 ** 2) AS ci
  FROM (SELECT * FROM st WHERE cfg = 'unsuppressed') a JOIN (SELECT * FROM st WHERE cfg = 'suppressed') b USING (recording_id, metric))
SELECT recording_id, metric, {r("am", "reference_dB")}, an AS reference_n, {r("bm", "test_dB")}, bn AS test_n,
 {r("am - bm", "reduction_dB")}, {r("ci", "ci95_dB")}, abs(am - bm) > ci AS significant FROM j""")
def insertion_loss_from_windows(spark, sf):
    w = B.windows(spark, sf).withColumn("span", G.integration_span())
    energy = G.part("samples", F.col("span")["start"], F.col("span")["stop"])
    w = w.select("recording_id", "configuration", L.amplitude_level(L.peak("samples")).alias("Lpeak_Z"),
                 G.exposure(energy, F.col("fs")).alias("LZE"), G.crest_factor(F.col("samples")).alias("crest_factor_dB"))
    keys = ["recording_id", "configuration"]
    stats = S.metric_stats(S.unpivot_metrics(w, keys, ["Lpeak_Z", "LZE", "crest_factor_dB"]), keys)
    return rounded(P.insertion_loss(stats.where("configuration = 'unsuppressed'").drop("configuration"),
                                    stats.where("configuration = 'suppressed'").drop("configuration"), ["recording_id"]))

