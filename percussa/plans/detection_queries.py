"""Queries from samples to events, over each label's windows as one signal."""

from pyspark.sql import functions as F

from percussa.functions import levels as L
from percussa.operators import detection as D
from percussa.operators.arrivals import arrivals_of
from percussa.plans import bindings as B
from percussa.plans.catalog import query, r, rounded, rs
from percussa.plans.shots_queries import ENV_SQL, amp_sql
from percussa.plans.strings_queries import KEY, ORDER
from percussa.session import checkpointed

FS, WINDOW, HOP, SNR = 8000, 8, 2, 3.0
REFRACTORY = 160          # samples, 20 ms
NEAR = REFRACTORY // (2 * HOP)
HALF, PRE, POST = 40, 80, 240

ENVELOPE_SQL = B.STREAM_SQL + """, env AS (SELECT recording_id, n // 2 AS k, n + 4 AS idx, sqrt(s / 8 + 1e-30::DOUBLE) AS env
  FROM (SELECT *, sum(x * x) OVER w AS s, count(*) OVER w AS c FROM stream
    WINDOW w AS (PARTITION BY recording_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n % 2 = 0 AND c = 8)"""
THRESHOLD_SQL = ENVELOPE_SQL + f""", thr0 AS (SELECT recording_id, max(env) AS peak, quantile_cont(env, 0.1) AS noise_floor FROM env GROUP BY 1),
thr AS (SELECT *, {amp_sql("peak")} AS peak_dB, {amp_sql("noise_floor")} AS floor_dB,
  greatest({amp_sql("peak")} - 30, {amp_sql("noise_floor")} + 3) AS threshold_dB, {amp_sql("peak")} - 30 < {amp_sql("noise_floor")} + 3 AS raised FROM thr0)"""
PEAKS_SQL = THRESHOLD_SQL + """, tops AS (SELECT recording_id, k, idx, env AS height FROM (SELECT *, lag(env) OVER w AS a, lead(env) OVER w AS b FROM env
   WINDOW w AS (PARTITION BY recording_id ORDER BY k)) WHERE env > a AND env > b),
walls AS (SELECT t.recording_id, t.k, t.height, max(e.k) FILTER (WHERE e.k < t.k AND e.env > t.height) AS lw,
   min(e.k) FILTER (WHERE e.k > t.k AND e.env > t.height) AS rw FROM tops t JOIN env e USING (recording_id) GROUP BY 1, 2, 3),
peaks AS (SELECT t.recording_id, t.k, any_value(t.idx) AS idx, any_value(t.height) AS height,
   any_value(t.height) - greatest(min(e.env) FILTER (WHERE e.k <= t.k AND e.k > coalesce(lw, -1)), min(e.env) FILTER (WHERE e.k >= t.k AND (rw IS NULL OR e.k < rw))) AS prominence
   FROM tops t JOIN walls w USING (recording_id, k) JOIN env e ON e.recording_id = t.recording_id GROUP BY 1, 2)"""


def greedy_cte(name, source, keys, pos, val, distance):
    """Recursive CTE: the positions of `source` a loudest-first selection keeps."""
    ks = ", ".join(keys)
    return f"""{name}_ranked AS (SELECT *, row_number() OVER (PARTITION BY {ks} ORDER BY {val} DESC, {pos} DESC) AS rk FROM ({source})),
{name}_run AS (SELECT DISTINCT {ks}, 0::BIGINT AS rk, []::BIGINT[] AS kept FROM {name}_ranked
  UNION ALL SELECT {", ".join("q." + k for k in keys)}, q.rk, CASE WHEN len(list_filter(kept, lambda a: abs(a - q.{pos}) < {distance})) > 0
   THEN kept ELSE list_append(kept, q.{pos}::BIGINT) END
  FROM {name}_run s JOIN {name}_ranked q ON q.rk = s.rk + 1 AND {" AND ".join(f"q.{k} = s.{k}" for k in keys)}),
{name}_kept AS (SELECT {ks}, unnest(arg_max(kept, rk)) AS {pos} FROM {name}_run GROUP BY {ks}),
{name} AS (SELECT s.* FROM ({source}) s JOIN {name}_kept USING ({ks}, {pos}))"""


AMP_THRESHOLD = "(20e-6::DOUBLE * power(10.0::DOUBLE, threshold_dB / 20))"
CANDIDATE_SQL = PEAKS_SQL + ", " + greedy_cte(
    "near", f"SELECT p.*, peak, {AMP_THRESHOLD} AS th FROM peaks p JOIN thr USING (recording_id) WHERE height >= {AMP_THRESHOLD}",
    ["recording_id"], "k", "height", NEAR) + """,
cand AS (SELECT * FROM near WHERE prominence >= greatest(0.5::DOUBLE * th, 1e-4::DOUBLE * peak))"""
ACCEPT_SQL = CANDIDATE_SQL + ", " + greedy_cte("acc", "SELECT * FROM cand", ["recording_id"], "idx", "height", REFRACTORY)
DETECT_SQL = ACCEPT_SQL + f""", refined AS (SELECT a.recording_id, a.k, a.idx AS approx, min_by(n, (-abs(x), n)) AS idx, max(abs(x)) AS peak_Pa
  FROM acc a JOIN stream s ON s.recording_id = a.recording_id AND n >= a.idx - 40 AND n < a.idx + 40 GROUP BY 1, 2, 3),
gated AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY idx) AS shot_number FROM (
  SELECT z.*, {amp_sql("peak_Pa")} AS peak_level, {amp_sql("peak_Pa")} - floor_dB AS snr_dB FROM refined z JOIN thr USING (recording_id)) WHERE snr_dB >= 3),
sizes AS (SELECT recording_id, max(n) + 1 AS size FROM stream GROUP BY 1),
shots AS (SELECT g.*, size, greatest(0, idx - 80) AS window_start, least(size, idx + 240) AS window_end, idx - 80 < 0 OR idx + 240 > size AS truncated
  FROM gated g JOIN sizes USING (recording_id))"""


def envelope(spark, sf):
    """The envelope, written once: every later step reads it several times."""
    return checkpointed(D.rms_envelope(B.stream(spark, sf).select("recording_id", "n", "x"), KEY, WINDOW, HOP))


def thresholds(env):
    return D.resolve_threshold(env, KEY, 30.0, SNR)


def all_peaks(env):
    found = D.local_maxima(env, KEY)
    peaks = D.with_prominence(env, found, KEY)
    return checkpointed(peaks.withColumn("idx", F.col("k") * HOP + WINDOW // 2))


def candidates(env, thr):
    return checkpointed(D.candidate_peaks(all_peaks(env), thr, KEY, NEAR))


def accepted(env, thr, cand=None):
    cand = candidates(env, thr) if cand is None else cand
    return D.refractory_select(cand, KEY, "idx", "height", REFRACTORY)


def detected(spark, sf):
    """Numbered shots with their windows."""
    env = envelope(spark, sf)
    thr = thresholds(env)
    return measured(spark, sf, thr, accepted(env, thr))


def measured(spark, sf, thr, events):
    samples = B.stream(spark, sf).select("recording_id", "n", "x")
    refined = checkpointed(D.refine_peaks(events.select("recording_id", "k", "idx"), samples, KEY, HALF))
    leveled = refined.withColumn("peak_level", L.amplitude_level("peak_Pa")).drop("idx").withColumnRenamed("refined", "idx")
    gated = D.gate_and_number(leveled.join(thr.select("recording_id", "noise_floor_dB"), KEY), KEY, ["idx"],
                              "peak_level", "noise_floor_dB", SNR)
    return D.assign_window(gated.join(D.sizes_of(samples, KEY), KEY), PRE, POST)


@query(f"WITH {ENVELOPE_SQL} SELECT recording_id, k, idx, {r('env', 'env', 9)} FROM env")
def rms_envelope(spark, sf):
    return rounded(envelope(spark, sf), 9)


@query(f"""WITH {THRESHOLD_SQL} SELECT recording_id, {r("peak_dB", "peak_dB")}, {r("floor_dB", "noise_floor_dB")},
 {r("threshold_dB", "threshold_dB")}, raised, 'relative' AS mode FROM thr""")
def envelope_threshold(spark, sf):
    return rounded(thresholds(envelope(spark, sf)).select(
        "recording_id", "peak_dB", "noise_floor_dB", "threshold_dB", "raised", "mode"))


@query(f"WITH {PEAKS_SQL} SELECT recording_id, k, idx, {rs('height', 'prominence', digits=9)} FROM peaks")
def envelope_peaks(spark, sf):
    return rounded(all_peaks(envelope(spark, sf)), 9)


@query(f"WITH RECURSIVE {CANDIDATE_SQL} SELECT recording_id, k, idx, {rs('height', 'prominence', digits=9)} FROM cand")
def candidate_peaks(spark, sf):
    env = envelope(spark, sf)
    return rounded(candidates(env, thresholds(env)), 9)


EVENT_GAP = 6 * 3600 * 1_000_000


@query(f"WITH RECURSIVE {B.SHOTS_SQL}, {greedy_cte('kept', 'SELECT * FROM shots', ['recording_id'], 't_us', 'level', EVENT_GAP)} "
       "SELECT recording_id, event_id, t_us, level FROM kept")
def refractory_select(spark, sf):
    shots = B.shots(spark, sf, number=False).select("recording_id", "event_id", "t_us", "level")
    return D.refractory_select(shots, KEY, "t_us", "level", EVENT_GAP)


@query(f"WITH {B.SHOTS_SQL} SELECT recording_id, event_id, t_us FROM shots WHERE shot_number <= 20")
def earliest_shots(spark, sf):
    shots = B.shots(spark, sf, number=False).select("recording_id", "event_id", "t_us")
    return D.limit_shots(shots, KEY, ORDER, 20)


@query(f"WITH RECURSIVE {DETECT_SQL} SELECT recording_id, k, approx, idx AS refined, {r('peak_Pa', 'peak_Pa', 9)} FROM refined")
def refined_peaks(spark, sf):
    env = envelope(spark, sf)
    samples = B.stream(spark, sf).select("recording_id", "n", "x")
    out = D.refine_peaks(accepted(env, thresholds(env)).select("recording_id", "k", "idx"), samples, KEY, HALF)
    return rounded(out.withColumnRenamed("idx", "approx"), 9)


@query(f"""WITH RECURSIVE {DETECT_SQL} SELECT recording_id, shot_number, idx, {r("peak_level", "peak_level")}, {r("snr_dB", "snr_dB")},
 window_start, window_end, truncated FROM shots""")
def detected_shots(spark, sf):
    return rounded(detected(spark, sf).select(
        "recording_id", "shot_number", "idx", "peak_level", "snr_dB", "window_start", "window_end", "truncated"))


RAIL_CTES = """clip AS (SELECT recording_id, n, greatest(-1, least(1, x * 4)) AS x FROM stream),
rail AS (SELECT recording_id, min(n) AS start, max(n) + 1 AS stop, count(*) AS length FROM (
  SELECT *, n - row_number() OVER (PARTITION BY recording_id ORDER BY n) AS g FROM clip WHERE abs(x) >= 1 - 1e-4::DOUBLE)
  GROUP BY recording_id, g)"""


def clipped_stream(spark, sf, gain=4.0, ceiling=1.0):
    x = F.greatest(F.lit(-ceiling), F.least(F.lit(ceiling), F.col("x") * gain))
    return B.stream(spark, sf).select("recording_id", "n", x.alias("x"))


@query(f"""WITH RECURSIVE {DETECT_SQL}, {RAIL_CTES}
SELECT s.recording_id, shot_number, coalesce(bool_or(least(window_end, stop) - greatest(window_start, start) >= 2), false) AS clipped
FROM shots s LEFT JOIN rail USING (recording_id) GROUP BY 1, 2""")
def clipped_shots(spark, sf):
    runs = D.pinned_runs(clipped_stream(spark, sf), KEY, F.abs("x") >= 1 - 1e-4).withColumn("needed", F.lit(2))
    return D.flag_clipped(detected(spark, sf), runs, KEY).select("recording_id", "shot_number", "clipped")


@query(f"""WITH RECURSIVE {DETECT_SQL}, seen AS (SELECT *, lead(window_start) OVER w AS ns, lead(idx) OVER w AS ni, lead(shot_number) OVER w AS next_shot
  FROM shots WINDOW w AS (PARTITION BY recording_id ORDER BY window_start, shot_number))
SELECT recording_id, shot_number, next_shot, ni - idx AS spacing FROM seen WHERE window_end > ns""")
def overlapping_windows(spark, sf):
    out = D.overlapping_windows(detected(spark, sf), KEY, "shot_number")
    return out.select("recording_id", "shot_number", "next_shot", "spacing")


@query(f"""WITH RECURSIVE {DETECT_SQL} SELECT recording_id, {r("threshold_dB", "threshold_dB")},
 (SELECT count(*) FROM cand c WHERE c.recording_id = t.recording_id) AS n_candidates,
 (SELECT count(*) FROM acc c WHERE c.recording_id = t.recording_id) AS n_accepted,
 (SELECT count(*) FROM shots c WHERE c.recording_id = t.recording_id) AS n_detected FROM thr t""")
def detection_report(spark, sf):
    env = envelope(spark, sf)
    thr = thresholds(env)
    cand = candidates(env, thr)
    acc = checkpointed(accepted(env, thr, cand))
    out = D.detection_report(cand, acc, measured(spark, sf, thr, acc), thr, KEY)
    return rounded(out.select("recording_id", "threshold_dB", "n_candidates", "n_accepted", "n_detected"))


_LADDER = [20.0, 25.0, 30.0, 40.0, 50.0, 65.0, 80.0, 100.0, 125.0, 150.0, 200.0, 250.0]
_LADDER_SQL = "(VALUES " + ", ".join(f"({ms}::DOUBLE, {int(ms * 8)}, {max(1, int(ms * 8) // 4)})" for ms in _LADDER) + ") AS l(refractory_ms, rr, nn)"


def _sweep_sql(rels):
    """Sweep CTEs; rels is an SQL list expression over thr."""
    return (PEAKS_SQL + f""", setup AS (SELECT recording_id, peak, rel AS relative_dB, peak * power(10.0::DOUBLE, -rel / 20) AS lv
  FROM thr, unnest({rels}) u(rel)),
low AS (SELECT recording_id, min(lv) AS lo FROM setup GROUP BY 1),
""" + greedy_cte("sn", f"SELECT p.*, refractory_ms, rr, nn FROM peaks p JOIN low USING (recording_id), {_LADDER_SQL} WHERE height >= lo",
                 ["recording_id", "refractory_ms"], "k", "height", "nn") + """,
cells AS (SELECT sn.*, relative_dB FROM sn JOIN setup USING (recording_id) WHERE height >= lv AND prominence >= greatest(0.5::DOUBLE * lv, 1e-4::DOUBLE * peak)),
""" + greedy_cte("won", "SELECT * FROM cells", ["recording_id", "refractory_ms", "relative_dB"], "idx", "height", "rr") + f""",
counted AS (SELECT recording_id, refractory_ms, relative_dB, count(*) AS n_events, min(idx - p) AS tightest FROM (
  SELECT *, lag(idx) OVER (PARTITION BY recording_id, refractory_ms, relative_dB ORDER BY idx) AS p FROM won) GROUP BY 1, 2, 3),
sweep AS (SELECT s.recording_id, l.refractory_ms, s.relative_dB, coalesce(n_events, 0) AS n_events, tightest
  FROM setup s CROSS JOIN {_LADDER_SQL} LEFT JOIN counted c ON c.recording_id = s.recording_id AND c.refractory_ms = l.refractory_ms AND c.relative_dB = s.relative_dB)""")


_RELS = "CASE WHEN least(40, peak_dB - floor_dB - 3) >= 9 THEN list_transform(range(floor(least(40, peak_dB - floor_dB - 3) - 6)::INT + 1), lambda i: 6.0::DOUBLE + i) ELSE [] END"
SWEEP_SQL = _sweep_sql(_RELS)


def swept(spark, sf):
    env = envelope(spark, sf)
    return D.sweep(all_peaks(env), thresholds(env), KEY, HOP, FS, min_snr_dB=SNR)


@query(f"WITH RECURSIVE {SWEEP_SQL} SELECT recording_id, refractory_ms, relative_dB AS \"relative_dB\", n_events, tightest FROM sweep")
def autotune_sweep(spark, sf):
    return swept(spark, sf).select("recording_id", "refractory_ms", "relative_dB", "n_events", "tightest")


PLATEAU_SQL = SWEEP_SQL + """, runs AS (SELECT *, sum(nw) OVER (PARTITION BY recording_id, refractory_ms ORDER BY relative_dB) AS run FROM (
  SELECT *, CASE WHEN n_events = lag(n_events) OVER (PARTITION BY recording_id, refractory_ms ORDER BY relative_dB) THEN 0 ELSE 1 END AS nw FROM sweep)),
plateaus AS (SELECT recording_id, refractory_ms, n_events, min(relative_dB) AS from_dB, max(relative_dB) AS to_dB FROM runs
  WHERE n_events > 0 GROUP BY recording_id, refractory_ms, run, n_events HAVING max(relative_dB) - min(relative_dB) >= 3)"""


@query(f"WITH RECURSIVE {PLATEAU_SQL} SELECT recording_id, refractory_ms, n_events, from_dB AS \"from_dB\", to_dB AS \"to_dB\" FROM plateaus")
def stable_plateaus(spark, sf):
    return D.stable_plateaus(swept(spark, sf), [*KEY, "refractory_ms"])


@query(f"""WITH RECURSIVE {PLATEAU_SQL}, rounds AS (SELECT p.*, round_even((from_dB + to_dB) / 2, 0) AS rel, to_dB - from_dB AS width, s.tightest / 8.0::DOUBLE AS tight
  FROM plateaus p JOIN sweep s ON s.recording_id = p.recording_id AND s.refractory_ms = p.refractory_ms AND s.relative_dB = round_even((from_dB + to_dB) / 2, 0)
  WHERE s.tightest IS NULL OR s.tightest / 8.0::DOUBLE >= p.refractory_ms * 1.2::DOUBLE),
near2 AS (SELECT *, max(width) OVER (PARTITION BY recording_id) AS widest FROM rounds QUALIFY width >= 0.8::DOUBLE * max(width) OVER (PARTITION BY recording_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY n_events DESC, width DESC, refractory_ms DESC, from_dB) AS b FROM near2),
riv AS (SELECT recording_id, count(DISTINCT n_events) - 1 AS n_rival_counts FROM near2 GROUP BY 1)
SELECT recording_id, n_events, from_dB AS "from_dB", to_dB AS "to_dB", width AS "width_dB", rel AS "relative_dB", refractory_ms,
 {r("tight", "tightest_ms")}, n_rival_counts::INT AS n_rival_counts FROM best JOIN riv USING (recording_id) WHERE b = 1""")
def chosen_round(spark, sf):
    return rounded(D.choose_round(swept(spark, sf), KEY, FS))


ADAPTIVE_SQL = _sweep_sql("list_transform(range(11), lambda i: 15.0::DOUBLE + 3 * i)").replace(_LADDER_SQL, "(VALUES (20.0::DOUBLE, 160, 40)) AS l(refractory_ms, rr, nn)")


@query(f"""WITH RECURSIVE {ADAPTIVE_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY n_events >= 8 DESC,
  CASE WHEN n_events >= 8 THEN 0 ELSE -n_events END, relative_dB) AS rk FROM sweep)
SELECT recording_id, relative_dB AS "relative_dB", n_events FROM b WHERE rk = 1""")
def adaptive_threshold(spark, sf):
    env = envelope(spark, sf)
    rels = [15.0 + 3 * i for i in range(11)]
    counts = D.sweep(all_peaks(env), thresholds(env), KEY, HOP, FS, [20.0], rels)
    return D.adaptive_threshold(counts, KEY, 8)


@query(f"""WITH {B.SHOTS_SQL}, c AS (SELECT recording_id, t_us AS idx, t_us // 86400000000 AS own, chunk_id,
  chunk_id * 86400000000 AS core_start, (chunk_id + 1) * 86400000000 AS core_stop
  FROM shots, unnest([t_us // 86400000000 - 1, t_us // 86400000000, t_us // 86400000000 + 1]) u(chunk_id))
SELECT recording_id, idx, chunk_id FROM c WHERE idx >= core_start AND idx < core_stop""")
def chunk_ownership(spark, sf):
    day = 86_400_000_000
    own = F.floor(F.col("t_us") / day)
    seen = B.shots(spark, sf, number=False).select("recording_id", F.col("t_us").alias("idx"), F.explode(
        F.sequence(own - 1, own + 1)).alias("chunk_id"))
    seen = seen.withColumn("core_start", F.col("chunk_id") * day).withColumn("core_stop", (F.col("chunk_id") + 1) * day)
    return D.owned(seen).select("recording_id", "idx", "chunk_id")


@query(f"""WITH RECURSIVE {B.SHOTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY t_us) AS rk FROM shots),
run AS (SELECT recording_id, t_us, rk, t_us AS last, true AS kept FROM o WHERE rk = 1
  UNION ALL SELECT o.recording_id, o.t_us, o.rk, CASE WHEN o.t_us - last >= {EVENT_GAP} THEN o.t_us ELSE last END, o.t_us - last >= {EVENT_GAP}
  FROM run JOIN o ON o.recording_id = run.recording_id AND o.rk = run.rk + 1)
SELECT recording_id, t_us AS idx FROM run WHERE kept""")
def seam_dedupe(spark, sf):
    shots = B.shots(spark, sf, number=False).select("recording_id", F.col("t_us").alias("idx"))
    return D.seam_dedupe(shots, KEY, EVENT_GAP)


@query(f"""WITH RECURSIVE {ACCEPT_SQL}, g AS (SELECT recording_id, k, coalesce(lead(k) OVER (PARTITION BY recording_id ORDER BY k), z) AS stop
  FROM acc JOIN (SELECT recording_id, max(k) + 1 AS z FROM env GROUP BY 1) USING (recording_id)),
w AS (SELECT recording_id, min_by(k, (k - stop, k)) AS k0, min_by(stop, (k - stop, k)) AS k1 FROM g GROUP BY 1),
t AS (SELECT w.*, greatest(e.env * 0.01::DOUBLE, noise_floor * power(10.0::DOUBLE, 3 / 20::DOUBLE)) AS target FROM w JOIN env e ON e.recording_id = w.recording_id AND e.k = k0
  JOIN thr ON thr.recording_id = w.recording_id WHERE k1 > k0 + 1),
h AS (SELECT t.recording_id, any_value(k0) AS k0, any_value(k1) AS k1, min(k) FILTER (WHERE env <= target) AS hit FROM t JOIN env USING (recording_id) WHERE k >= k0 AND k < k1 GROUP BY 1),
m AS (SELECT *, coalesce(hit - k0, k1 - k0 - 1) * 0.25::DOUBLE AS ms FROM h)
SELECT recording_id, {r("ms", "decay_ms")}, hit IS NOT NULL AS complete, {r("least(2000, greatest(100, 10 * ceil(ms / 10)))", "post_ms")} FROM m""")
def shot_decay(spark, sf):
    env = envelope(spark, sf)
    thr = thresholds(env)
    return rounded(D.measure_decay(env, accepted(env, thr), thr, KEY, HOP, FS))


REFLECTION_SQL = ACCEPT_SQL + """, ev AS (SELECT recording_id, idx, height AS level, row_number() OVER (PARTITION BY recording_id ORDER BY idx) AS place FROM acc),
pr AS (SELECT a.recording_id, a.place AS source, b.place AS follower, a.level AS source_level, b.level AS level, b.idx - a.idx AS delay, (b.idx - a.idx) * 0.125::DOUBLE AS ms
  FROM ev a JOIN ev b USING (recording_id) WHERE b.place > a.place AND (b.idx - a.idx) * 0.125::DOUBLE >= 20 AND b.level <= a.level * power(10.0::DOUBLE, -3 / 20::DOUBLE)),
cs AS (SELECT p.recording_id, p.delay, p.ms, count(*) AS size FROM (SELECT DISTINCT recording_id, delay, ms FROM pr) p JOIN pr q ON q.recording_id = p.recording_id
  AND q.ms >= p.ms - greatest(5::DOUBLE, 0.1::DOUBLE * p.ms) AND q.ms <= p.ms + greatest(5::DOUBLE, 0.1::DOUBLE * p.ms) GROUP BY 1, 2, 3),
ce AS (SELECT recording_id, arg_max(ms, (size, -delay)) AS centre FROM cs GROUP BY 1),
mb AS (SELECT pr.*, row_number() OVER (PARTITION BY recording_id ORDER BY source_level DESC, delay, source, follower) AS rk FROM pr JOIN ce USING (recording_id)
  WHERE abs(ms - centre) <= greatest(5::DOUBLE, 0.1::DOUBLE * centre)),
mt AS (SELECT DISTINCT recording_id, 0::BIGINT AS rk, []::BIGINT[] AS used, []::BIGINT[] AS taken FROM mb
  UNION ALL SELECT q.recording_id, q.rk, CASE WHEN list_has_any(used, [source, follower]) THEN used ELSE list_concat(used, [source, follower]) END,
  CASE WHEN list_has_any(used, [source, follower]) THEN taken ELSE list_append(taken, q.rk) END FROM mt JOIN mb q ON q.rk = mt.rk + 1 AND q.recording_id = mt.recording_id),
tk AS (SELECT recording_id, unnest(arg_max(taken, rk)) AS rk FROM mt GROUP BY 1),
rp AS (SELECT recording_id, median(ms) AS delay_ms, max(ms) - min(ms) AS spread_ms, count(*) AS n_pairs, median(level / greatest(source_level, 1e-30::DOUBLE)) AS ratio,
  list(source ORDER BY source, follower) AS sources, list(follower ORDER BY source, follower) AS followers FROM mb JOIN tk USING (recording_id, rk) GROUP BY 1)"""


@query(f"""WITH RECURSIVE {REFLECTION_SQL} SELECT recording_id, {r("delay_ms", "delay_ms")}, {r("spread_ms", "spread_ms")}, n_pairs,
 {r("-20 * log10(greatest(ratio, 1e-30::DOUBLE))", "drop_dB")}, {r("delay_ms / 1000 * 343", "path_m")}, sources, followers
FROM rp WHERE n_pairs >= 2 AND (SELECT count(*) FROM ev WHERE ev.recording_id = rp.recording_id) >= 4""")
def reflection_pattern(spark, sf):
    env = envelope(spark, sf)
    events = accepted(env, thresholds(env)).select("recording_id", "idx", F.col("height").alias("level"))
    return rounded(D.reflection_pattern(events, KEY, float(FS)))


ARRIVAL_SQL = ENV_SQL + """, am AS (SELECT recording_id, shot_number, n AS k, e AS height FROM (SELECT *, lag(e) OVER w AS a, lead(e) OVER w AS b FROM env
   WINDOW w AS (PARTITION BY shot_number ORDER BY n)) WHERE e > a AND e > b),
aw AS (SELECT t.recording_id, t.shot_number, t.k, t.height, max(e.n) FILTER (WHERE e.n < t.k AND e.e > t.height) AS lw,
   min(e.n) FILTER (WHERE e.n > t.k AND e.e > t.height) AS rw FROM am t JOIN env e USING (recording_id, shot_number) GROUP BY 1, 2, 3, 4),
ap AS (SELECT w.recording_id, w.shot_number, w.k, w.height, w.height - greatest(min(e.e) FILTER (WHERE e.n <= w.k AND e.n > coalesce(lw, -1)),
   min(e.e) FILTER (WHERE e.n >= w.k AND (rw IS NULL OR e.n < rw))) AS prominence FROM aw w JOIN env e USING (recording_id, shot_number) GROUP BY 1, 2, 3, 4),
at0 AS (SELECT ap.*, top FROM ap JOIN tops USING (recording_id, shot_number) WHERE height >= 0.1::DOUBLE * top), """ + greedy_cte(
    "apart", "SELECT * FROM at0", ["recording_id", "shot_number"], "k", "height", 4) + """,
strong AS (SELECT * FROM apart WHERE prominence >= 0.1::DOUBLE * top QUALIFY row_number() OVER (PARTITION BY shot_number ORDER BY height DESC, k DESC) <= 4)"""


def arrivals(spark, sf):
    return B.windows(spark, sf).select("recording_id", "shot_number", arrivals_of("samples", "fs").alias("arrivals"))


@query(f"WITH RECURSIVE {ARRIVAL_SQL} SELECT recording_id, shot_number, {r('k / 8000::DOUBLE', 'offset_s', 9)}, {r('height', 'peak_Pa', 9)} FROM strong")
def shot_arrivals(spark, sf):
    out = arrivals(spark, sf).select("recording_id", "shot_number", F.inline("arrivals"))
    return rounded(out.select("recording_id", "shot_number", "offset_s", "peak_Pa"), 9)


CHARACTER_SQL = """, sg AS (SELECT t.recording_id, t.shot_number, t.k, s.n - t.k AS i, least(16, 64 - t.k) AS len,
   s.x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (s.n - t.k) / (least(16, 64 - t.k) - 1))) AS y
   FROM strong t JOIN samples s USING (recording_id, shot_number) WHERE s.n >= t.k AND s.n < t.k + 16 AND 64 - t.k >= 8),
mg AS (SELECT recording_id, shot_number, k, j * 8000::DOUBLE / any_value(len) AS f, sqrt(sum(y * cos(2 * pi() * j * i / len)) ** 2
   + sum(y * sin(2 * pi() * j * i / len)) ** 2) AS m FROM sg, range(9) u(j) WHERE j <= len // 2 GROUP BY recording_id, shot_number, k, j),
ce AS (SELECT recording_id, shot_number, k, CASE WHEN sum(m) > 1e-30 THEN sum(f * m) / sum(m) END AS centroid_Hz FROM mg GROUP BY 1, 2, 3),
de AS (SELECT t.recording_id, t.shot_number, t.k, (min(e.n) - t.k) * 0.125::DOUBLE AS decay_ms FROM strong t JOIN env e USING (recording_id, shot_number)
   WHERE e.n >= t.k AND e.e <= t.height * 10 ** -0.5::DOUBLE AND t.height > 1e-30 GROUP BY 1, 2, 3),
ch AS (SELECT strong.*, centroid_Hz, decay_ms FROM strong LEFT JOIN ce USING (recording_id, shot_number, k) LEFT JOIN de USING (recording_id, shot_number, k))"""


@query(f"""WITH RECURSIVE {ARRIVAL_SQL}{CHARACTER_SQL}
SELECT recording_id, shot_number, {r("k / 8000::DOUBLE", "offset_s", 9)}, {r("centroid_Hz", "centroid_Hz", 6)}, {r("decay_ms", "decay_ms", 6)} FROM ch""")
def arrival_character(spark, sf):
    out = arrivals(spark, sf).select("recording_id", "shot_number", F.inline("arrivals"))
    return rounded(out.select("recording_id", "shot_number", "offset_s", "centroid_Hz", "decay_ms"), 6, offset_s=9)


@query(f"""WITH RECURSIVE {ARRIVAL_SQL}{CHARACTER_SQL}, o AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY shot_number) AS cnt,
   lag(centroid_Hz) OVER w AS c0, lag(decay_ms) OVER w AS d0, (shot_number % 5) * 0.001::DOUBLE AS want, shot_number % 9 = 0 AS slow
   FROM ch WINDOW w AS (PARTITION BY shot_number ORDER BY k)),
lo AS (SELECT shot_number, min_by(i, (-height, i)) AS loud FROM o GROUP BY 1),
sp AS (SELECT shot_number, coalesce(c0 >= 2 * centroid_Hz AND decay_ms >= 2 * d0 AND centroid_Hz > 0 AND d0 > 0, false) AS decisive
  FROM o JOIN lo USING (shot_number) WHERE i = loud),
geo AS (SELECT a.shot_number, a.i AS gi, b.i AS gj FROM o a JOIN o b ON a.shot_number = b.shot_number AND b.i > a.i
  WHERE abs(b.k / 8000::DOUBLE - a.k / 8000::DOUBLE - a.want) <= 0.0005::DOUBLE QUALIFY row_number() OVER (PARTITION BY a.shot_number ORDER BY a.i, b.i) = 1),
m AS (SELECT o.*, loud, gi, gj, decisive FROM o JOIN lo USING (shot_number) JOIN sp USING (shot_number) LEFT JOIN geo USING (shot_number)),
l AS (SELECT *, CASE WHEN slow OR cnt = 1 THEN -1 WHEN gi IS NOT NULL THEN gi ELSE loud - 1 END AS crack,
  CASE WHEN slow THEN loud WHEN cnt = 1 THEN -1 WHEN gj IS NOT NULL THEN gj ELSE loud END AS blast,
  CASE WHEN slow THEN 'subsonic' WHEN cnt = 1 THEN 'none' WHEN gi IS NOT NULL THEN 'geometric' WHEN loud > 0 AND decisive THEN 'spectral' ELSE 'ordering' END AS how FROM m)
SELECT recording_id, shot_number, {r("k / 8000::DOUBLE", "offset_s", 9)}, CASE WHEN i = crack THEN 'crack' WHEN i = blast THEN 'blast' ELSE 'unclassified' END AS label,
 CASE WHEN i = crack OR i = blast THEN how ELSE 'none' END AS basis FROM l""")
def classified_arrivals(spark, sf):
    k = F.col("shot_number")
    marked = D.classify_arrivals("arrivals", (k % 5) * 0.001, F.when(k % 9 == 0, False))
    out = arrivals(spark, sf).select("recording_id", "shot_number", F.inline(marked))
    return rounded(out.select("recording_id", "shot_number", "offset_s", "label", "basis"), 9)


@query(f"""WITH RECURSIVE {DETECT_SQL}, g AS (SELECT recording_id, count(*) AS n_shots, greatest(0, min(window_start) - 100) AS a, least(any_value(size), max(window_end) + 100) AS b FROM shots GROUP BY 1),
j AS (SELECT z.recording_id, size, coalesce(n_shots, 0) AS n_shots, a, b, CASE WHEN n_shots IS NULL THEN 'no shots' WHEN a >= b THEN 'windows outside the recording'
  WHEN a = 0 AND b = size THEN 'nothing to remove' END AS reason FROM sizes z LEFT JOIN g USING (recording_id))
SELECT recording_id, n_shots, CASE WHEN reason IS NULL THEN a ELSE 0 END AS start, CASE WHEN reason IS NULL THEN b ELSE size END AS stop, reason IS NULL AS applied, reason FROM j""")
def string_span(spark, sf):
    sizes = D.sizes_of(B.stream(spark, sf), KEY)
    return D.string_span(detected(spark, sf), sizes, KEY, 100)


@query(f"""WITH RECURSIVE {DETECT_SQL} SELECT s.recording_id, shot_number, count(*) AS n_samples, {r("sum(x * x)", "energy", 9)},
 {r("sum(x * (n - window_start))", "moment", 6)} FROM shots s JOIN stream t ON t.recording_id = s.recording_id AND n >= window_start AND n < window_end GROUP BY 1, 2""")
def extracted_windows(spark, sf):
    shots = detected(spark, sf).select("recording_id", "shot_number", "window_start", "window_end")
    cut = D.extract_windows(shots, B.chunks(spark, sf).select("recording_id", "chunk_id", "samples"), KEY, 64)
    long = cut.select("recording_id", "shot_number", F.posexplode("samples").alias("i", "x"))
    g = long.groupBy("recording_id", "shot_number").agg(
        F.count("*").alias("n_samples"), F.sum(F.col("x") * F.col("x")).alias("energy"), F.sum(F.col("x") * F.col("i")).alias("moment"))
    return rounded(g, energy=9)


@query(f"""WITH {B.RECORDINGS_SQL}, s AS (SELECT recording_id, recording_id % 3 = 0 AS ok, CASE WHEN recording_id % 5 = 0 THEN 80.0::DOUBLE END AS o,
  CASE WHEN recording_id % 2 = 0 THEN 65.0::DOUBLE END AS t FROM recordings)
SELECT recording_id, coalesce(o, CASE WHEN ok THEN t END, 200) AS refractory_ms,
 CASE WHEN o IS NOT NULL THEN 'operator' WHEN ok AND t IS NOT NULL THEN 'measured' ELSE 'default' END AS refractory_ms_source FROM s""")
def resolved_settings(spark, sf):
    k = F.col("recording_id")
    settings = B.recordings(spark, sf).select(
        k, (k % 3 == 0).alias("tuning_applied"), F.when(k % 5 == 0, 80.0).alias("operator_refractory_ms"),
        F.when(k % 2 == 0, 65.0).alias("tuned_refractory_ms"))
    return D.resolve_settings(settings, KEY)
