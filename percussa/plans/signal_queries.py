"""Queries on calibration, recording quality, time weighting, spectra and bands."""

import math

from pyspark.sql import functions as F

from percussa.functions import dsp
from percussa.functions import levels as L
from percussa.operators import calibration as C
from percussa.operators import quality as Q
from percussa.operators import shots as G
from percussa.operators import spectra as P
from percussa.plans import bindings as B
from percussa.plans import filter_sql as X
from percussa.plans.catalog import query, r, rounded
from percussa.plans.detection_queries import clipped_stream
from percussa.plans.shots_queries import ID, amp_sql, pow_sql
from percussa.plans.strings_queries import KEY

FS = 8000


def plain_stream(spark, sf):
    return B.stream(spark, sf).select("recording_id", "n", "x")


CAL_SQL = f"""{B.RECORDINGS_SQL}, c AS (SELECT recording_id, recording_id AS k, CASE WHEN recording_id % 5 = 0 THEN 100.0::DOUBLE + recording_id % 7 END AS direct,
  CASE WHEN recording_id % 5 IN (1, 4) THEN 2.0::DOUBLE + recording_id % 3 END AS mv, (recording_id % 4) * 10.0::DOUBLE AS gain, 1.0::DOUBLE + recording_id % 2 AS fsv,
  CASE WHEN recording_id % 5 = 2 THEN -40.0::DOUBLE - recording_id % 6 END AS sdb, CASE WHEN recording_id % 5 = 4 OR recording_id % 10 = 3 THEN 'field' END AS preset FROM recordings),
g AS (SELECT *, (direct IS NOT NULL)::INT + (mv IS NOT NULL)::INT + (sdb IS NOT NULL)::INT + (preset IS NOT NULL)::INT AS cnt,
  coalesce(direct, fsv / (mv / 1000 * power(10.0::DOUBLE, gain / 20)), fsv / (power(10.0::DOUBLE, sdb / 20) * power(10.0::DOUBLE, gain / 20)), CASE WHEN preset IS NOT NULL THEN 143.96::DOUBLE END) AS f FROM c)"""


@query(f"""WITH {CAL_SQL} SELECT recording_id, CASE WHEN direct IS NOT NULL THEN 'direct' WHEN mv IS NOT NULL THEN 'chain' WHEN sdb IS NOT NULL THEN 'chain_dB' WHEN preset IS NOT NULL THEN 'preset' ELSE 'none' END AS method,
 CASE WHEN cnt > 1 THEN 'more than one calibration source' END AS refusal, cnt = 1 AS calibrated, {r("CASE WHEN cnt <= 1 THEN coalesce(f, 1) END", "factor")},
 {r("CASE WHEN cnt <= 1 THEN " + amp_sql("coalesce(f, 1)") + " END", "full_scale_dB")} FROM g""")
def calibrate(spark, sf):
    k = F.col("recording_id")
    recs = B.recordings(spark, sf).select(
        k, F.when(k % 5 == 0, 100.0 + k % 7).alias("Pa_per_FS"), F.when((k % 5).isin(1, 4), 2.0 + k % 3).alias("sensitivity_mV_per_Pa"),
        ((k % 4) * 10.0).alias("preamp_gain_dB"), (1.0 + k % 2).alias("adc_full_scale_V"),
        F.when(k % 5 == 2, -40.0 - k % 6).alias("sensitivity_dB"), F.when((k % 5 == 4) | (k % 10 == 3), "field").alias("preset"))
    presets = spark.createDataFrame([("field", 143.96)], "preset string, preset_Pa_per_FS double")
    out = C.calibrate(recs, presets).withColumn("full_scale_dB", L.full_scale_level("factor"))
    return rounded(out.select("recording_id", "method", "refusal", "calibrated", "factor", "full_scale_dB"))


@query(f"""WITH {B.STREAM_SQL}, s AS (SELECT recording_id, max(n) + 1 AS size FROM stream GROUP BY 1)
SELECT recording_id, count(*) AS n_middle, {r("sqrt(avg(x * x))", "rms", 9)}, {r("max(abs(x))", "peak", 9)} FROM stream JOIN s USING (recording_id)
 WHERE n >= floor(size * 0.2::DOUBLE) AND n < floor(size * 0.8::DOUBLE) GROUP BY 1""")
def tone_level(spark, sf):
    samples = plain_stream(spark, sf)
    sizes = samples.groupBy(*KEY).agg((F.max("n") + 1).alias("size"))
    return rounded(C.tone_level(samples, KEY, sizes), 9)


@query(f"""WITH {B.STREAM_SQL}, s AS (SELECT recording_id, max(n) + 1 AS size FROM stream GROUP BY 1),
m AS (SELECT t.recording_id, n, x, floor(size * 0.2::DOUBLE)::BIGINT AS lo FROM stream t JOIN s USING (recording_id) WHERE n >= floor(size * 0.2::DOUBLE) AND n < floor(size * 0.8::DOUBLE)),
seg AS (SELECT recording_id, (n - lo) // 256 AS g, (n - lo) % 256 AS i, x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * ((n - lo) % 256) / 255)) AS y, count(*) OVER (PARTITION BY recording_id, (n - lo) // 256) AS c FROM m),
p AS (SELECT recording_id, g, k, sum(y * cos(2 * pi() * k * i / 256)) ** 2 + sum(y * sin(2 * pi() * k * i / 256)) ** 2 AS p FROM seg, range(1, 129) u(k) WHERE c = 256 GROUP BY 1, 2, 3),
d AS (SELECT recording_id, arg_max(k, tp) * 8000 / 256::DOUBLE AS f FROM (SELECT recording_id, k, sum(p) AS tp FROM p GROUP BY 1, 2) GROUP BY 1),
l AS (SELECT recording_id, sqrt(avg(x * x)) AS rms FROM m GROUP BY 1)
SELECT recording_id, {r("rms", "rms", 9)}, {r("f", "dominant_Hz")}, CASE WHEN abs(f - 1000) > 50 THEN 'dominant frequency is not the tone''s' END AS refusal,
 {r("CASE WHEN abs(f - 1000) <= 50 THEN 20e-6::DOUBLE * power(10.0::DOUBLE, 94 / 20::DOUBLE) / rms END", "Pa_per_FS", 4)} FROM l JOIN d USING (recording_id)""")
def calibrate_from_tone(spark, sf):
    return rounded(C.calibrate_from_tone(plain_stream(spark, sf), KEY, FS, 1000.0, 94.0, 256), 9, dominant_Hz=6, Pa_per_FS=4)


@query(f"""WITH {B.STREAM_SQL}, s AS (SELECT recording_id, max(n) + 1 AS size FROM stream GROUP BY 1),
m AS (SELECT recording_id, 2 * n // size AS part, sqrt(avg(x * x)) AS rms FROM stream JOIN s USING (recording_id) GROUP BY 1, 2)
SELECT a.recording_id, {r("20 * log10(b.rms / a.rms)", "drift_dB")}, abs(20 * log10(b.rms / a.rms)) <= 0.5::DOUBLE AS stable
FROM m a JOIN m b ON a.recording_id = b.recording_id AND a.part = 0 AND b.part = 1""")
def tone_drift(spark, sf):
    samples = plain_stream(spark, sf)
    sizes = samples.groupBy(*KEY).agg((F.max("n") + 1).alias("size"))
    part = samples.join(sizes, KEY).groupBy("recording_id", F.floor(2 * F.col("n") / F.col("size")).alias("part")).agg(
        F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms")).withColumn("refusal", F.lit(None).cast("string"))
    return rounded(C.tone_drift(part.where("part = 0"), part.where("part = 1"), KEY))


@query(f"""WITH {B.STREAM_SQL} SELECT recording_id, n // 64 AS chunk_id, {r("sum(x * (2 + recording_id))", "sum_Pa", 8)}, {r("sqrt(sum(x * x)) * (2 + recording_id)", "root_energy", 8)} FROM stream GROUP BY 1, 2""")
def to_pascals(spark, sf):
    factors = B.windows(spark, sf).select("recording_id").distinct().withColumn("factor", 2.0 + F.col("recording_id"))
    out = C.to_pascals(B.chunks(spark, sf), factors, KEY)
    return rounded(out.select("recording_id", "chunk_id", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("sum_Pa"),
                              F.sqrt(L.sum_squares("samples")).alias("root_energy")), 8)


def _filtered(spark, sf, kernel):
    return _levels_of(C.filtered_chunks(B.chunks(spark, sf), KEY, kernel, before=2, after=2))


def _levels_of(out):
    return rounded(out.select("recording_id", "chunk_id", F.size("samples").alias("n"), L.rms("samples").alias("rms")), 9)


def _filtered_sql(response, size):
    """Twin of `_filtered`: each chunk with two chunks of context on either side, circular convolution, root mean square."""
    return f"""WITH {B.STREAM_SQL}, {X.kernel_cte("h", response, FS, size, 320)},
c AS (SELECT recording_id, n, n // 64 AS id, x FROM stream),
w AS (SELECT recording_id, n, x, id + o AS id FROM c, range(-2, 3) t(o)),
b AS (SELECT *, avg(x) OVER (PARTITION BY recording_id, id) AS mean FROM w),
y AS (SELECT a.recording_id, a.id, a.n, sum(b.x * h) AS y FROM c a JOIN b ON a.recording_id = b.recording_id AND a.id = b.id JOIN h ON h.d = a.n - b.n GROUP BY 1, 2, 3)
SELECT recording_id, id AS chunk_id, count(*)::INT AS n, {r("sqrt(avg(y * y))", "rms", 9)} FROM y GROUP BY 1, 2"""


@query(f"""WITH {B.STREAM_SQL}, {X.high_passed_ctes("hp", "stream", FS, 10.0)}
SELECT recording_id, n // 64 AS chunk_id, count(*)::INT AS n, {r("CASE WHEN count(z) = count(*) THEN sqrt(avg(z * z)) END", "rms", 9)} FROM hp GROUP BY 1, 2""")
def high_pass(spark, sf):
    return _levels_of(C.high_pass(B.chunks(spark, sf), KEY, 64))


@query(_filtered_sql(X.both_ways_band_sql(FS, 50.0, 0.95 * FS / 2), X.padded(320 + 2 * int(8 / (2 * math.pi * 50) * FS) + 1)))
def detection_band(spark, sf):
    return _filtered(spark, sf, C.band_limit)


@query(_filtered_sql(X.weighting_sql("A", FS), X.weighting_size(320, FS)))
def a_weighted(spark, sf):
    return _filtered(spark, sf, C.weight_a)


@query(_filtered_sql(X.weighting_sql("C", FS), X.weighting_size(320, FS)))
def c_weighted(spark, sf):
    return _filtered(spark, sf, C.weight_c)


CLIP_SQL = B.STREAM_SQL + """, clip AS (SELECT recording_id, n, greatest(-1, least(1, x * 4)) AS x FROM stream),
low AS (SELECT recording_id, n, greatest(-0.5::DOUBLE, least(0.5::DOUBLE, x * 4)) AS x FROM stream)"""


def _islands_sql(source, cond):
    return f"""SELECT recording_id, count(*) AS length FROM (SELECT *, n - row_number() OVER (PARTITION BY recording_id ORDER BY n) AS g
  FROM {source} WHERE {cond}) GROUP BY recording_id, g"""


@query(f"""WITH {CLIP_SQL}, i AS ({_islands_sql("clip", "abs(x) >= 1 - 1e-4::DOUBLE")})
SELECT recording_id, coalesce(sum(length) FILTER (WHERE length >= 2), 0)::BIGINT AS clipped_samples, count(*) FILTER (WHERE length >= 2) AS clipped_runs
FROM (SELECT DISTINCT recording_id FROM clip) LEFT JOIN i USING (recording_id) GROUP BY 1""")
def clipping_runs(spark, sf):
    return Q.clipping_runs(clipped_stream(spark, sf), KEY)


@query(f"""WITH {CLIP_SQL}, s AS (SELECT recording_id, max(abs(x)) AS c, sqrt(avg(x * x)) AS rms FROM low GROUP BY 1),
i AS ({_islands_sql("(SELECT low.*, c FROM low JOIN s USING (recording_id))", "abs(abs(x) - c) <= c * 1e-4::DOUBLE")}),
g AS (SELECT recording_id, coalesce(sum(length) FILTER (WHERE length >= 3), 0)::BIGINT AS samples, count(*) FILTER (WHERE length >= 3) AS runs, max(length) AS longest_run FROM i GROUP BY 1)
SELECT recording_id, {r("c", "ceiling_FS")}, samples, runs, longest_run, {r("20 * log10(c / rms)", "crest_dB")},
 runs >= 2 AND c < 1 - 1e-4::DOUBLE AND 20 * log10(c / rms) >= 6 AS detected FROM s JOIN g USING (recording_id)""")
def ceiling_clipping(spark, sf):
    return rounded(Q.ceiling_clipping(clipped_stream(spark, sf, 4.0, 0.5), KEY))


# Energy below 20 Hz by its few bins, total energy by Parseval, both under a symmetric Hann window.
LF_SQL = """tot AS (SELECT recording_id, count(*) AS nn, avg(x) AS mu FROM stream GROUP BY 1),
hw AS (SELECT s.recording_id, n, nn, (x - mu) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * n / (nn - 1))) AS y FROM stream s JOIN tot USING (recording_id)),
lowbins AS (SELECT recording_id, k, sum(y * cos(2 * pi() * k * n / nn)) ** 2 + sum(y * sin(2 * pi() * k * n / nn)) ** 2 AS p
  FROM hw, range(200) t(k) WHERE k * 4800::DOUBLE / nn < 20 GROUP BY 1, 2),
lf AS (SELECT recording_id, (SELECT sum(p) FROM lowbins l WHERE l.recording_id = h.recording_id) /
  ((any_value(nn) * sum(y * y) + sum(y) ** 2 + CASE WHEN any_value(nn) % 2 = 0 THEN sum(y * CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) ** 2 ELSE 0 END) / 2) AS lf_fraction
  FROM hw h GROUP BY 1)"""


@query(f"WITH {B.STREAM_SQL}, {LF_SQL} SELECT recording_id, {r('lf_fraction', 'lf_fraction')} FROM lf")
def low_frequency_fraction(spark, sf):
    samples = plain_stream(spark, sf)
    return rounded(Q.low_frequency_fraction(samples, KEY, Q.basic_sums(samples, KEY), 4800))


@query(f"""WITH {B.STREAM_SQL}, {LF_SQL}, b AS (SELECT recording_id, count(*) AS n_samples, max(abs(x)) AS peak, avg(x) AS dc, sqrt(avg(x * x)) AS rms FROM stream GROUP BY 1),
fr AS (SELECT recording_id, n // 48 AS f, avg(x * x) AS ms FROM stream JOIN b USING (recording_id) WHERE n // 48 < n_samples // 48 GROUP BY 1, 2),
q AS (SELECT recording_id, quantile_cont(ms, 0.05) AS ms FROM fr GROUP BY 1),
a AS (SELECT *, {amp_sql("peak * 50")} AS pk, {pow_sql("ms * 2500")} AS fl FROM b JOIN q USING (recording_id) JOIN lf USING (recording_id))
SELECT recording_id, n_samples, {r("peak", "peak_FS")}, {r("-20 * log10(peak)", "headroom_dB")}, {r("dc", "dc_offset_FS", 9)}, {r("pk", "peak_level_dB")},
 {r("fl", "noise_floor_dB")}, {r("pk - fl", "snr_dB")}, {r("lf_fraction", "lf_fraction")},
 list_filter([CASE WHEN -20 * log10(peak) < 1 THEN 'little headroom' END, CASE WHEN pk - fl < 20 THEN 'low signal-to-noise' END,
  CASE WHEN abs(dc) > 1e-3 THEN 'dc offset' END, CASE WHEN lf_fraction > 0.5::DOUBLE THEN 'energy below 20 Hz' END, 'sample rate too low'], lambda v: v IS NOT NULL) AS warnings FROM a""")
def signal_quality(spark, sf):
    out = Q.signal_quality(plain_stream(spark, sf), KEY, 4800, 50.0)
    return rounded(out.select("recording_id", "n_samples", "peak_FS", "headroom_dB", "dc_offset_FS", "peak_level_dB", "noise_floor_dB",
                              "snr_dB", "lf_fraction", "warnings"), dc_offset_FS=9)


@query(f"""WITH {B.STREAM_SQL}, p AS (SELECT recording_id, n // 640 AS part, count(*) AS n_samples, max(abs(x)) AS peak, sum(x) AS sx, {pow_sql("avg(x * x)")} AS fl, {amp_sql("max(abs(x))")} AS pk FROM stream GROUP BY 1, 2),
w AS (SELECT recording_id, unnest(list_filter([CASE WHEN pk - fl < 10 THEN 'low signal-to-noise' END, CASE WHEN part % 2 = 0 THEN 'even part' END], lambda v: v IS NOT NULL)) AS w FROM p),
u AS (SELECT recording_id, list_sort(list(DISTINCT w)) AS warnings FROM w GROUP BY 1)
SELECT p.recording_id, sum(n_samples)::BIGINT AS n_samples, {r("max(peak)", "peak_FS")}, {r("-20 * log10(max(peak))", "headroom_dB")}, {r("sum(sx) / sum(n_samples)", "dc_offset_FS", 9)},
 {r("min(fl)", "noise_floor_dB")}, {r("max(pk) - min(fl)", "snr_dB")}, coalesce(any_value(warnings), []) AS warnings FROM p LEFT JOIN u USING (recording_id) GROUP BY 1""")
def merge_quality(spark, sf):
    parts = plain_stream(spark, sf).withColumn("part", F.floor(F.col("n") / 640))
    rows = Q.basic_sums(parts, ["recording_id", "part"]).withColumns({
        "clipped_samples": F.lit(0), "clipped_runs": F.lit(0), "lf_fraction": F.lit(0.0),
        "noise_floor_dB": L.power_level(F.col("sum_x2") / F.col("n_samples")), "peak_level_dB": L.amplitude_level("peak_FS")})
    rows = rows.withColumn("warnings", F.array_compact(F.array(
        F.when(F.col("peak_level_dB") - F.col("noise_floor_dB") < 10, "low signal-to-noise"), F.when(F.col("part") % 2 == 0, "even part"))))
    out = Q.merge_quality(rows, KEY)
    return rounded(out.select("recording_id", "n_samples", "peak_FS", "headroom_dB", "dc_offset_FS", "noise_floor_dB", "snr_dB", "warnings"), dc_offset_FS=9)


@query(f"""WITH {B.RECORDINGS_SQL} SELECT recording_id, CASE WHEN wind_mps IS NULL THEN 'INFO' WHEN wind_mps <= 3 THEN 'PASS' WHEN wind_mps <= 6 THEN 'CAUTION' ELSE 'FAIL' END AS wind_grade,
 CASE WHEN level >= 120 THEN 'PASS' WHEN level >= 80 THEN 'CAUTION' ELSE 'FAIL' END AS level_grade FROM recordings""")
def quality_grade(spark, sf):
    return B.recordings(spark, sf).select("recording_id", Q.grade(F.col("wind_mps"), 3.0, 6.0, False).alias("wind_grade"),
                                          Q.grade(F.col("level"), 120.0, 80.0).alias("level_grade"))


def _exp_sql(tau, keys="recording_id, shot_number"):
    return f"(1 - exp(-1 / (8000 * {tau}::DOUBLE))) * sum(b.x * b.x * exp(-(a.n - b.n) / (8000 * {tau}::DOUBLE)))"


@query(f"""WITH {B.SAMPLES_SQL}, f AS (SELECT recording_id, shot_number, a.n, {_exp_sql(0.125)} AS y, {_exp_sql(1.0)} AS s FROM samples a JOIN samples b USING (recording_id, shot_number) WHERE b.n <= a.n GROUP BY 1, 2, 3)
SELECT recording_id, shot_number, n::INT AS n, {r(pow_sql("y"), "fast_dB")}, {r(pow_sql("s"), "slow_dB")} FROM f""")
def exponential_level(spark, sf):
    w = B.windows(spark, sf)
    fast, slow = P.exponential_of(0.125), P.exponential_of(1.0)
    both = w.select(*ID, fast("samples", "fs", F.lit(0.0)).alias("f"), slow("samples", "fs", F.lit(0.0)).alias("s"))
    long = both.select(*ID, F.posexplode(F.arrays_zip("f", "s")).alias("n", "v"))
    return rounded(long.select(*ID, "n", L.power_level(F.col("v.f")).alias("fast_dB"), L.power_level(F.col("v.s")).alias("slow_dB")))


@query(f"""WITH {B.SAMPLES_SQL}, f AS (SELECT recording_id, shot_number, a.n, {_exp_sql(0.035)} AS x FROM samples a JOIN samples b USING (recording_id, shot_number) WHERE b.n <= a.n GROUP BY 1, 2, 3)
SELECT recording_id, shot_number, a.n::INT AS n, {r(pow_sql("max(b.x * exp(-(a.n - b.n) / (8000 * 1.5::DOUBLE)))"), "impulse_dB")} FROM f a JOIN f b USING (recording_id, shot_number) WHERE b.n <= a.n GROUP BY 1, 2, 3""")
def impulse_level(spark, sf):
    w = B.windows(spark, sf).withColumn("samples", P.exponential_of(dsp.IMPULSE_S)("samples", "fs", F.lit(0.0)))
    long = w.select(*ID, F.posexplode(P.hold_of("samples", "fs", F.lit(0.0))).alias("n", "v"))
    return rounded(long.select(*ID, "n", L.power_level("v").alias("impulse_dB")))


@query(f"""WITH {B.SAMPLES_SQL}, f AS (SELECT recording_id, shot_number, a.n, {_exp_sql(0.125)} AS y, {_exp_sql(1.0)} AS s FROM samples a JOIN samples b USING (recording_id, shot_number) WHERE b.n <= a.n GROUP BY 1, 2, 3)
SELECT recording_id, shot_number, {r(pow_sql("max(y)"), "LZFmax")}, {r(pow_sql("max(s)"), "LZSmax")} FROM f WHERE n % 8 = 0 GROUP BY 1, 2""")
def time_weighted_maxima(spark, sf):
    w = B.windows(spark, sf)
    top = {n: L.power_level(P.max_exponential("samples", "fs", t, F.lit(8))) for n, t in (("LZFmax", 0.125), ("LZSmax", 1.0))}
    return rounded(w.select(*ID, *[c.alias(n) for n, c in top.items()]))


@query(f"""WITH {B.STREAM_SQL}, f AS (SELECT recording_id, a.n, (1 - exp(-1 / (8000 * 0.005::DOUBLE))) * sum(b.x * b.x * exp(-(a.n - b.n) / (8000 * 0.005::DOUBLE))) AS y
  FROM (SELECT * FROM stream WHERE n % 80 = 0) a JOIN stream b USING (recording_id) WHERE b.n <= a.n GROUP BY 1, 2)
SELECT recording_id, 'LZF' AS curve, {r("n / 8000::DOUBLE", "t")}, {r(pow_sql("y"), "level")} FROM f""")
def level_curve(spark, sf):
    avg = P.exponential_chunks(B.chunks(spark, sf), KEY, 64, 0.005)
    return rounded(P.level_curve(avg, KEY, 80, 64, FS, "LZF"))


STFT_SQL = B.SAMPLES_SQL + f""", fr AS (SELECT recording_id, shot_number, frame, n - frame * 8 AS i, x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (n - frame * 8) / 32)) AS y
  FROM samples, range(5) t(frame) WHERE n >= frame * 8 AND n < frame * 8 + 32),
bins AS (SELECT recording_id, shot_number, frame, k AS bin, k * 250.0::DOUBLE AS f, sqrt((sum(y * cos(2 * pi() * k * i / 32)) ** 2 + sum(y * sin(2 * pi() * k * i / 32)) ** 2)
  * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END) / 16 AS value FROM fr, range(17) u(k) GROUP BY 1, 2, 3, 4)"""
A_SQL = """(20 * log10(12194.217::DOUBLE ** 2 * greatest(f, 1e-30::DOUBLE) ** 4 / ((f ** 2 + 20.598997::DOUBLE ** 2) * sqrt((f ** 2 + 107.65265::DOUBLE ** 2) * (f ** 2 + 737.86223::DOUBLE ** 2)) * (f ** 2 + 12194.217::DOUBLE ** 2) + 1e-30::DOUBLE) + 1e-30::DOUBLE) + 2.0::DOUBLE)"""


def frames(spark, sf):
    return P.stft(B.windows(spark, sf), ID, 32, 24)


@query(f"""WITH {STFT_SQL} SELECT recording_id, shot_number, frame, bin::INT AS bin, {r("(frame * 8 + 16) / 8000::DOUBLE", "t", 9)}, {r("f", "frequency")}, {r("value", "value", 9)} FROM bins""")
def stft(spark, sf):
    return rounded(frames(spark, sf).drop("fs"), 9, frequency=6)


@query(f"""WITH {STFT_SQL} SELECT recording_id, shot_number, frame, bin::INT AS bin, {r(f"greatest({amp_sql('value')} + {A_SQL}, 20)", "level", 5)} FROM bins""")
def stft_levels(spark, sf):
    out = P.stft_levels(frames(spark, sf), "A", floor_dB=20.0)
    return rounded(out.select(*ID, "frame", "bin", "level"), 5)


@query(f"""WITH {STFT_SQL}, lv AS (SELECT *, greatest({amp_sql('value')}, -20) AS level FROM bins)
SELECT recording_id, shot_number, {r("max(level)", "peak_dB")}, min_by(f, (-level, bin)) AS "peak_Hz" FROM lv GROUP BY 1, 2""")
def spectral_peak(spark, sf):
    return rounded(P.spectral_peak(P.stft_levels(frames(spark, sf)), ID))


@query(f"""WITH {B.STREAM_SQL}, fr AS (SELECT recording_id, frame, n - frame * 32 AS i, x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (n - frame * 32) / 128)) AS y,
  count(*) OVER (PARTITION BY recording_id, frame) AS c FROM (SELECT *, unnest([n // 32, n // 32 - 1, n // 32 - 2, n // 32 - 3]) AS frame FROM stream) WHERE frame >= 0),
b AS (SELECT recording_id, frame, k, sqrt((sum(y * cos(2 * pi() * k * i / 128)) ** 2 + sum(y * sin(2 * pi() * k * i / 128)) ** 2) * CASE WHEN k IN (0, 64) THEN 1 ELSE 2 END) / 64 AS v
  FROM fr, range(65) u(k) WHERE c = 128 GROUP BY 1, 2, 3),
lv AS (SELECT *, greatest({amp_sql("v")}, -20) AS level FROM b)
SELECT recording_id, frame, {r("max(level)", "peak_dB")}, min_by(k, (-level, k)) * 62.5::DOUBLE AS "peak_Hz" FROM lv GROUP BY 1, 2""")
def chunked_stft(spark, sf):
    out = P.stft_chunks(B.chunks(spark, sf), KEY, 64, 128, 96)
    return rounded(P.spectral_peak(P.stft_levels(out), ["recording_id", "frame"]))


@query(f"""WITH f AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 10 AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, {r("f", "frequency", 3)}, {r(A_SQL, "a_dB")}, {r("20 * log10(12194.217::DOUBLE ** 2 * f ** 2 / ((f ** 2 + 20.598997::DOUBLE ** 2) * (f ** 2 + 12194.217::DOUBLE ** 2))) + 0.062::DOUBLE", "c_dB")} FROM f""")
def weighting_curve(spark, sf):
    f = F.col("l_extendedprice") / 10
    return rounded(B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", f.alias("frequency"), P.weighting_curve(f, "A").alias("a_dB"),
                                                         P.weighting_curve(f, "C").alias("c_dB")), frequency=3)


RATES_SQL = """rates AS (SELECT o_orderkey AS recording_id, [44100, 48000, 96000, 192000][(o_orderkey % 4 + 1)::INT] AS fs FROM orders)"""


def rates(spark, sf):
    k = F.col("o_orderkey")
    return B.table(spark, sf, "orders").select(k.alias("recording_id"), F.element_at(
        F.array(*[F.lit(v) for v in (44100, 48000, 96000, 192000)]), (k % 4 + 1).cast("int")).alias("fs"))


@query(f"""WITH {RATES_SQL}, s AS (SELECT *, power(2, round(log2(greatest(128, round_even(fs * 2 / 1000.0::DOUBLE, 0)))))::INT AS nperseg FROM rates),
w AS (SELECT s.*, name, list_transform(range(nperseg), lambda i: a - b * cos(2 * pi() * i / nperseg) + c * cos(4 * pi() * i / nperseg)) AS v
  FROM (SELECT DISTINCT fs, nperseg FROM s) s, (VALUES ('rectangular', 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('hann', 0.5::DOUBLE, 0.5::DOUBLE, 0), ('hamming', 0.54::DOUBLE, 0.46::DOUBLE, 0), ('blackman', 0.42::DOUBLE, 0.5::DOUBLE, 0.08::DOUBLE)) n(name, a, b, c)),
e AS (SELECT fs, nperseg, name, nperseg * list_sum(list_transform(v, lambda x: x * x)) / list_sum(v) ** 2 AS enbw, list_sum(v) / nperseg AS cg FROM w)
SELECT recording_id, s.fs, s.nperseg, name AS "window", {r("enbw", "enbw_bins")}, {r("enbw * s.fs / s.nperseg", "enbw_Hz")}, {r("cg", "coherent_gain")} FROM s JOIN e USING (fs)""")
def window_resolution(spark, sf):
    base = rates(spark, sf).withColumn("nperseg", P.recommended_nperseg(F.col("fs")))
    return rounded(P.window_resolution(base, ["rectangular", "hann", "hamming", "blackman"]))


_NOM = ", ".join(f"({float(v)}::DOUBLE)" for v in dsp.NOMINAL_BANDS)
BAND_DIM_SQL = RATES_SQL + f""", d AS (SELECT recording_id, fs, nominal, 1000 * power(power(10, 0.3::DOUBLE), round(3 * ln(nominal / 1000) / ln(power(10, 0.3::DOUBLE))) / 3) AS c FROM rates, (VALUES {_NOM}) n(nominal)),
dim AS (SELECT recording_id, fs, nominal, c, c * power(power(10, 0.3::DOUBLE), -1 / 6::DOUBLE) AS lo, c * power(power(10, 0.3::DOUBLE), 1 / 6::DOUBLE) AS hi FROM d)"""


@query(f"""WITH {BAND_DIM_SQL} SELECT recording_id, fs, nominal AS "nominal_Hz", {r("c", "centre_Hz")}, {r("lo", "low_Hz")}, {r("hi", "high_Hz")} FROM dim WHERE hi < fs / 2 AND c <= 0.45::DOUBLE * fs""")
def band_dimension(spark, sf):
    return P.band_dimension(rates(spark, sf), digits=6)


def _band_exposure_sql():
    """A quadratic form of the window for each band: the impulse response against itself, summed over the window."""
    bands = dsp.band_table(FS)
    kernels = ",\n".join(X.kernel_cte(f"h{i}", X.band_sql(FS, low, high, 4), FS, X.padded(64 + int(8 * FS / (math.pi * (high - low))) + 1), 64)
                         for i, (_, low, high) in enumerate(bands))
    every = " UNION ALL ".join(f"SELECT {nominal!r}::DOUBLE AS band_Hz, d, h FROM h{i}" for i, (nominal, _, _) in enumerate(bands))
    return f"""WITH {B.SAMPLES_SQL}, {kernels}, h AS ({every}),
g AS (SELECT p.band_Hz, i, j, sum(p.h * q.h) AS g FROM range(64) a(i), range(64) b(j), range(64) c(m), h p, h q WHERE p.d = m - i AND q.d = m - j AND p.band_Hz = q.band_Hz GROUP BY 1, 2, 3),
xx AS (SELECT a.recording_id, a.shot_number, a.n AS i, b.n AS j, a.x * b.x AS xx FROM samples a JOIN samples b USING (recording_id, shot_number))
SELECT recording_id, shot_number, band_Hz AS "band_Hz", {r(pow_sql("sum(xx * g) / 8000"), "exposure_dB")} FROM xx JOIN g USING (i, j) GROUP BY 1, 2, 3"""


@query(_band_exposure_sql())
def band_exposure(spark, sf):
    w = B.windows(spark, sf)
    return rounded(w.select(*ID, F.inline(G.band_exposure_of("samples", "fs"))))


@query()
def band_levels(spark, sf):
    return rounded(P.band_levels(B.chunks(spark, sf), KEY, 64, FS, "fast", 4.0, 4, lowest=500.0))


@query(f"""WITH {B.BANDS_SQL}, l AS (SELECT l_suppkey AS recording_id, l_shipdate AS frame, l_quantity AS level FROM lineitem)
SELECT recording_id, frame::DATE AS frame, {r("10 * log10(sum(power(10.0::DOUBLE, level / 10)))", "overall_dB")} FROM l GROUP BY 1, 2""")
def overall_level(spark, sf):
    rows = B.bands(spark, sf).withColumn("frame", F.to_date("shipdate"))
    return rounded(P.overall_level(rows, ["recording_id", "frame"]))


@query(f"""WITH {B.SHOTS_SQL}, p AS (SELECT recording_id, t_us / 1000000::DOUBLE AS t, power(10.0::DOUBLE, level / 10 / 10) AS pw, lag(t_us / 1000000::DOUBLE) OVER w AS t0, lag(power(10.0::DOUBLE, level / 10 / 10)) OVER w AS p0
  FROM shots WINDOW w AS (PARTITION BY recording_id ORDER BY t_us, event_id)),
e AS (SELECT recording_id, count(*) AS n_frames, 10 * log10(sum((pw + p0) / 2 * (t - t0))) AS s, max(t) - min(t) AS d FROM p GROUP BY 1)
SELECT recording_id, n_frames, {r("s", "exposure_dB")}, {r("s - 10 * log10(d)", "leq_dB")} FROM e""")
def exposure_from_levels(spark, sf):
    shots = B.shots(spark, sf, number=False).select("recording_id", "event_id", "t_us", (F.col("t_us") / 1e6).alias("t"), (F.col("level") / 10).alias("level"))
    return rounded(P.exposure_from_levels(shots, KEY, "t", ["t_us", "event_id"]))


@query(f"""WITH {STFT_SQL}, rsp AS (SELECT shot_number, f, 20 * log10(max(value)) AS level FROM bins GROUP BY 1, 2),
top AS (SELECT shot_number, max(level) AS top FROM rsp GROUP BY 1),
ed AS (SELECT shot_number, min(f) AS lo, max(f) AS hi FROM rsp JOIN top USING (shot_number) WHERE level >= top - 3 GROUP BY 1)
SELECT shot_number, {r("lo", "measured_low_Hz")}, {r("hi", "measured_high_Hz")}, 750.0::DOUBLE AS "low_Hz", 3000.0::DOUBLE AS "high_Hz", abs(lo - 750) <= 225 AND abs(hi - 3000) <= 225 AS conforms FROM ed""")
def verify_bands(spark, sf):
    rsp = frames(spark, sf).groupBy("shot_number", "frequency").agg((20 * F.log10(F.max("value"))).alias("level"))
    bands = B.windows(spark, sf).select("shot_number", F.lit(750.0).alias("low_Hz"), F.lit(3000.0).alias("high_Hz"))
    return rounded(P.verify_bands(rsp, bands, ["shot_number"]))


@query(f"""WITH {STFT_SQL}, rsp AS (SELECT shot_number, f, 20 * log10(max(value)) + 40 AS measured FROM bins WHERE f > 0 GROUP BY 1, 2),
j AS (SELECT *, measured - {A_SQL} AS err FROM rsp WHERE f < 4000)
SELECT shot_number, count(*) AS n_points, {r("max(abs(err))", "max_error_dB", 5)}, bool_and(err <= 12 AND err >= -18) AS conforms FROM j GROUP BY 1""")
def tolerance_conformance(spark, sf):
    rsp = frames(spark, sf).where("frequency > 0").groupBy("shot_number", "frequency").agg((20 * F.log10(F.max("value")) + 40).alias("measured_dB"))
    limits = rsp.select("frequency").distinct().select("frequency", P.weighting_curve(F.col("frequency"), "A").alias("nominal_dB"),
                                                       F.lit(12.0).alias("plus_dB"), F.lit(18.0).alias("minus_dB"))
    return rounded(C.tolerance_conformance(rsp, limits, ["shot_number"], FS), 5)

