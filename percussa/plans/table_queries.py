"""Queries on sources, sinks and display reductions."""

from pyspark.sql import functions as F

from percussa.operators import detection as D
from percussa.operators import display as N
from percussa.operators import shots as G
from percussa.operators import spectra as P
from percussa.operators import strings as S
from percussa.plans import analysis as A
from percussa.plans import bindings as B
from percussa.plans.catalog import query, r, rounded
from percussa.plans.detection_queries import DETECT_SQL, FS, HALF, HOP, POST, PRE, REFRACTORY, SNR, WINDOW, detected
from percussa.plans.shots_queries import ID, METRICS_SQL, amp_sql
from percussa.plans.signal_queries import STFT_SQL, frames
from percussa.plans.strings_queries import KEY, _stats_sql, _unpivot_sql
from percussa.sources import recordings as R
from percussa.sources import sinks as W


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return R.content_hash(docs).select("doc_id", "sha256")


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1")
def first_of_each_content(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return R.first_of_each_content(docs, "doc_id")


@query(f"""WITH {B.RECORDINGS_SQL}, f AS (SELECT recording_id, 1000 + recording_id % 7001 AS frames FROM recordings),
c AS (SELECT *, unnest(range(0, frames, 1200)) AS core_start FROM f)
SELECT recording_id, core_start // 1200 AS chunk_id, core_start, least(frames, core_start + 1200) AS core_stop,
 greatest(0, core_start - 20) AS read_start, least(frames, core_start + 1220) AS read_stop FROM c""")
def plan_chunks(spark, sf):
    recs = B.recordings(spark, sf).select("recording_id", (1000 + F.col("recording_id") % 7001).alias("frames"))
    out = R.plan_chunks(recs, F.lit(1200).cast("long"), F.lit(20).cast("long"))
    return out.select("recording_id", "chunk_id", "core_start", "core_stop", "read_start", "read_stop")


def channel_chunks(spark, sf):
    halves = F.array(F.slice("samples", 1, 32), F.slice("samples", 33, 32))
    return B.windows(spark, sf).select("recording_id", F.col("shot_number").alias("chunk_id"), F.posexplode(halves).alias("channel", "samples"))


@query(f"""SELECT label AS recording_id, vec_id AS chunk_id, {r("list_sum(embedding[33:64]::DOUBLE[])", "total", 8)} FROM embeddings""")
def select_channel(spark, sf):
    out = R.select_channel(channel_chunks(spark, sf), 1)
    return rounded(out.select("recording_id", "chunk_id", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total")), 8)


@query(f"""SELECT label AS recording_id, vec_id AS chunk_id, unnest(range(32))::INT AS n, {r("unnest(list_transform(range(1, 33), lambda i: (embedding[i]::DOUBLE + embedding[i + 32]::DOUBLE) / 2))", "x", 9)} FROM embeddings""")
def mono_mix(spark, sf):
    out = R.mono_mix(channel_chunks(spark, sf), KEY)
    return rounded(out.select("recording_id", "chunk_id", F.posexplode("samples").alias("n", "x")), 9)


@query(f"""WITH {B.RECORDINGS_SQL} SELECT test_id AS stem, CASE WHEN configuration IS NOT NULL THEN configuration END AS configuration, weapon, mic_distance_m FROM recordings""")
def metadata_sidecars(spark, sf):
    recs = B.recordings(spark, sf)
    good = F.to_json(F.struct(F.upper("configuration").alias("configuration"), "weapon", "mic_distance_m", F.lit(1).alias("unknown_key")))
    poor = F.to_json(F.struct(F.lit("other").alias("configuration"), F.lit(1.0).alias("mic_distance_m")))
    texts = recs.select(F.concat("test_id", F.lit(".metadata.json")).alias("path"), good.alias("value")).unionByName(
        recs.select(F.concat("test_id", F.lit(".json")).alias("path"), poor.alias("value")))
    return R.parse_sidecars(texts).select("stem", "configuration", "weapon", "mic_distance_m")


HISTORY_SQL = f"""{B.RECORDINGS_SQL}, runs AS (SELECT recording_id AS run_id, CASE WHEN recording_id % 3 = 0 THEN '2.0' END AS schema_version,
  CASE recording_id % 4 WHEN 0 THEN make_timestamp(t_us) WHEN 1 THEN make_timestamp(t_us) WHEN 2 THEN date_trunc('second', make_timestamp(t_us)) ELSE make_timestamp(t_us + 1000000) END AS analysed_at,
  'file-' || recording_id AS input_file, n_shots FROM recordings)"""


@query(f"""WITH {HISTORY_SQL} SELECT run_id, coalesce(schema_version, '1.0') AS schema_version, epoch_us(analysed_at) AS analysed_us, input_file, n_shots FROM runs""")
def run_history(spark, sf):
    recs = B.recordings(spark, sf)
    k = F.col("recording_id")
    at = F.timestamp_micros("t_us")
    stamp = (F.when(k % 4 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).when(k % 4 == 1, F.date_format(at, "yyyyMMdd_HHmmss"))
             .when(k % 4 == 2, F.date_format(at, "yyyy-MM-dd HH:mm:ss")))
    nested = k % 3 == 0
    text = F.concat(F.lit("file-"), k.cast("string"))
    records = recs.select(
        k.alias("run_id"), F.when(nested, "2.0").alias("schema_version"),
        F.when(nested, F.struct(stamp.alias("timestamp"), text.alias("input_file"))).alias("analysis"),
        F.when(~nested, stamp).alias("timestamp"), F.when(~nested, text).alias("input_file"),
        F.struct(F.lit(48000).alias("sample_rate")).alias("source"), F.lit(None).cast("int").alias("sample_rate"),
        F.when(nested, F.struct("n_shots")).alias("aggregate"), "n_shots", F.struct(F.lit("dB SPL").alias("level_unit")).alias("calibration"),
        F.struct("test_id").alias("test_metadata"), F.timestamp_micros(F.col("t_us") + 1_000_000).alias("modified_at"))
    out = R.run_history(records)
    return out.select("run_id", "schema_version", F.unix_micros("analysed_at").alias("analysed_us"), "input_file", "n_shots")


@query(f"""WITH {B.RECORDINGS_SQL} SELECT recording_id, configuration FROM recordings WHERE configuration = 'suppressed'
 AND contains(lower(concat_ws(' ', nullif(weapon, ''), nullif(operator, ''), nullif(ammunition, ''), nullif(location, ''), configuration)), 'kim a1 range')""")
def history_filter(spark, sf):
    runs = B.recordings(spark, sf).select("recording_id", "configuration", "weapon", "operator", "ammunition", "location")
    return R.history_filter(runs, "suppressed", " KIM a1 range ").select("recording_id", "configuration")


@query(f"""WITH {B.SHOT_RECORDS_SQL}, st AS ({_stats_sql(_unpivot_sql(""))})
SELECT recording_id, {r("max(mean) FILTER (WHERE metric = 'Lpeak_Z')", "Lpeak_Z_mean")}, {r("max(ci95) FILTER (WHERE metric = 'LAE')", "LAE_ci95")}, count(*)::INT AS n_metrics FROM st GROUP BY 1""")
def reference_aggregate(spark, sf):
    stats = S.metric_stats(S.unpivot_metrics(B.shot_records(spark, sf, number=False), KEY, B.SHOT_METRICS), KEY)
    out = R.reference_aggregate(stats, "recording_id")
    return rounded(out.select("recording_id", F.col("stats")["Lpeak_Z"]["mean"].alias("Lpeak_Z_mean"),
                              F.col("stats")["LAE"]["ci95"].alias("LAE_ci95"), F.size("stats").alias("n_metrics")))


@query("""WITH v AS (SELECT event_id, value / 7 AS a, value / 7000 AS b, value / 7000000 AS c FROM events)
SELECT event_id, CASE WHEN a <> 0 AND a < 1 THEN format('{:.6g}', a) ELSE format('{:.2f}', a) END AS a_text,
 CASE WHEN b <> 0 AND b < 1 THEN format('{:.6g}', b) ELSE format('{:.2f}', b) END AS b_text,
 CASE WHEN c <> 0 AND c < 1 THEN format('{:.6g}', c) ELSE format('{:.2f}', c) END AS c_text FROM v""")
def number_texts(spark, sf):
    e = B.table(spark, sf, "events")
    return e.select("event_id", W.number_text(F.col("value") / 7).alias("a_text"), W.number_text(F.col("value") / 7000).alias("b_text"),
                    W.number_text(F.col("value") / 7000000).alias("c_text"))


def _text_sql(value, name):
    return f"CASE WHEN {value} IS NULL THEN '' WHEN {value} <> 0 AND abs({value}) < 1 THEN format('{{:.6g}}', {value}) ELSE format('{{:.2f}}', {value}) END AS \"{name}\""


def _shot_table_sql():
    truth = {"valid": "'true'", "clipped": "'false'", "window_truncated": "'false'", "rise_time_resolved": "rise_time_resolved::VARCHAR",
             "time": "format('{:.5f}', shot_number * 64 / 8000::DOUBLE)", "notes": "array_to_string(notes, '; ')", "shot_number": "shot_number::VARCHAR"}
    made = {"duration_ms": "(duration_s * 1000)", "integration_ms": "(integration_window_s * 1000)"}
    columns = [f'{truth[name]} AS "{name}"' if name in truth else _text_sql(made.get(source, source), name) for name, source in W.SHOT_COLUMNS.items()]
    return f"WITH {METRICS_SQL} SELECT recording_id, {', '.join(columns)} FROM metrics"


@query(_shot_table_sql())
def shot_table(spark, sf):
    metrics = G.shot_metrics(B.windows(spark, sf))
    return W.shot_table(metrics.withColumn("time_s", F.col("shot_number") * 64 / F.col("fs")), ["recording_id"])


@query(f"""WITH {B.SHOT_RECORDS_SQL}, p AS (SELECT *, (row_number() OVER (PARTITION BY recording_id ORDER BY t_us, event_id) - 1) // 25 AS page FROM shot_records)
SELECT recording_id, page, count(*)::INT AS n_in_page, {r("sum(level)", "sum_level", 4)}, 5 AS n_statistics FROM p GROUP BY 1, 2""")
def run_record(spark, sf):
    shots = B.shot_records(spark, sf, number=False)
    runs = shots.groupBy(*KEY).agg(F.count("*").alias("n_shots"))
    stats = S.metric_stats(S.unpivot_metrics(shots, KEY, B.SHOT_METRICS), KEY)
    out = W.run_record(runs, shots.select("recording_id", "t_us", "event_id", "Lpeak_Z", "LAE"), stats, KEY, ["t_us", "event_id"], 25)
    total = F.aggregate("shots", F.lit(0.0), lambda a, x: a + x["Lpeak_Z"])
    return rounded(out.select("recording_id", "page", F.size("shots").alias("n_in_page"), total.alias("sum_level"),
                              F.size("statistics").alias("n_statistics")), 4)


SIZE_SQL = B.STREAM_SQL + ", sz AS (SELECT recording_id, max(n) + 1 AS size FROM stream GROUP BY 1)"


def sized(spark, sf):
    samples = B.stream(spark, sf).select("recording_id", "n", "x")
    return samples, D.sizes_of(samples, KEY)


def detection_settings():
    return A.Detection(fs=FS, window=WINDOW, hop=HOP, refractory=REFRACTORY, pre=PRE, post=POST, half=HALF, min_snr_dB=SNR)


def _columns_sql(c):
    return f"((n + 1) * least({c}, size) + size - 1) // size - 1"


@query(f"""WITH {SIZE_SQL} SELECT recording_id, least(200, size) AS columns, {_columns_sql(200)} AS k, {r("min(x)", "lo", 9)}, {r("max(x)", "hi", 9)} FROM stream JOIN sz USING (recording_id) GROUP BY 1, 2, 3""")
def minmax_envelope(spark, sf):
    samples, sizes = sized(spark, sf)
    return rounded(N.minmax_envelope(samples, KEY, sizes, 200), 9)


@query(f"""WITH {SIZE_SQL}, l AS (SELECT *, unnest([64, 256, 1024]) AS level FROM sz)
SELECT recording_id, level, least(level, size) AS columns, ((n + 1) * least(level, size) + size - 1) // size - 1 AS k, {r("min(x)", "lo", 9)}, {r("max(x)", "hi", 9)}
FROM stream JOIN l USING (recording_id) WHERE level = 64 OR (level = 256 AND size > 64) OR (level = 1024 AND size > 256) GROUP BY 1, 2, 3, 4""")
def envelope_pyramid(spark, sf):
    samples, sizes = sized(spark, sf)
    return rounded(N.envelope_pyramid(samples, KEY, sizes, [64, 256, 1024]), 9)


@query(f"""WITH RECURSIVE {DETECT_SQL}, c AS (SELECT recording_id, count(*) AS n_shots FROM shots GROUP BY 1)
SELECT t.recording_id, coalesce(n_shots, 0) AS n_shots, {r("threshold_dB - " + amp_sql("1"), "threshold_dB")}, {r("peak_dB - " + amp_sql("1"), "peak_dB")},
 least(1600, size) AS columns, NULL::VARCHAR AS problem FROM thr t JOIN sizes USING (recording_id) LEFT JOIN c USING (recording_id)""")
def detection_preview(spark, sf):
    out = A.preview(B.stream(spark, sf).select("recording_id", "n", "x"), KEY, detection_settings())
    return rounded(out.select("recording_id", "n_shots", "threshold_dB", "peak_dB", "columns", "problem"))


@query(f"""WITH RECURSIVE {DETECT_SQL} SELECT recording_id, shot_number, idx, {r("peak_level", "peak_level")} FROM shots""")
def detect_recordings(spark, sf):
    found = A.detect(B.stream(spark, sf).select("recording_id", "n", "x"), KEY, detection_settings())
    return rounded(found.shots.select("recording_id", "shot_number", "idx", F.col("peak_dB").alias("peak_level")))


@query(f"""WITH {SIZE_SQL}, v AS (SELECT o_orderkey AS view, o_orderkey % 10 AS recording_id, (o_orderkey % 50) / 1000::DOUBLE AS t0, (o_orderkey % 50) / 1000::DOUBLE + (o_orderkey % 97) / 500::DOUBLE AS t1, 10 + o_orderkey % 300 AS pixels FROM orders)
SELECT recording_id, view, coalesce(min(c) FILTER (WHERE c * greatest(1e-9::DOUBLE, t1 - t0) / (size / 8000::DOUBLE) >= pixels), max(c)) AS columns FROM v JOIN sz USING (recording_id), (VALUES (64), (256), (1024)) l(c) GROUP BY 1, 2""")
def pick_level(spark, sf):
    _, sizes = sized(spark, sf)
    levels = sizes.select("recording_id", (F.col("size") / 8000).alias("duration_s"), F.explode(F.array(F.lit(64), F.lit(256), F.lit(1024))).alias("columns"))
    k = F.col("o_orderkey")
    views = B.table(spark, sf, "orders").select(k.alias("view"), (k % 10).alias("recording_id"), ((k % 50) / 1000).alias("t0"),
                                                ((k % 50) / 1000 + (k % 97) / 500).alias("t1"), (10 + k % 300).alias("pixels"))
    return N.pick_level(levels, views, KEY)


@query(f"""WITH RECURSIVE {DETECT_SQL}, iv AS (SELECT recording_id, greatest(0, idx - 10) AS a, least(size, idx + 20) AS z FROM shots),
o AS (SELECT *, max(z) OVER (PARTITION BY recording_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY a, z) AS grp FROM o),
m AS (SELECT recording_id, min(a) AS a, max(z) AS z FROM g GROUP BY recording_id, grp),
t AS (SELECT s.recording_id, n, x, size, bool_or(n >= a AND n < z) AS fr, coalesce(max(z) FILTER (WHERE z <= n), 0) AS origin FROM stream s JOIN sizes USING (recording_id) LEFT JOIN m ON m.recording_id = s.recording_id GROUP BY 1, 2, 3, 4)
SELECT recording_id, n, {r("x", "x", 9)}, coalesce(fr, false) AS "full" FROM t WHERE coalesce(fr, false) OR (n - origin) % greatest(1, size // 100) = 0""")
def mixed_resolution_waveform(spark, sf):
    samples, sizes = sized(spark, sf)
    shots = detected(spark, sf).select("recording_id", "idx")
    return rounded(N.mixed_resolution(samples, shots, sizes, KEY, 10, 20, 100), 9)


@query(f"""WITH {STFT_SQL} SELECT recording_id, shot_number, frame, bin::INT AS bin, round_even(greatest({amp_sql("value")}, -20), 1) + 0.0::DOUBLE AS level FROM bins WHERE frame % 3 = 0""")
def thin_spectrogram(spark, sf):
    out = N.thin_spectrogram(P.stft_levels(frames(spark, sf)), ID, 2)
    return rounded(out.select(*ID, "frame", "bin", "level"), 1)


@query(f"""WITH {STFT_SQL}, lv AS (SELECT recording_id, shot_number, frame, bin, greatest({amp_sql("value")}, -20) AS level FROM bins),
o AS (SELECT shot_number, floor(min(level) * 10) / 10 AS off FROM lv GROUP BY 1)
SELECT recording_id, shot_number, frame, bin::INT AS bin, least(65534, greatest(0, round_even((level - off) / 0.1::DOUBLE, 0)))::INT AS count FROM lv JOIN o USING (shot_number)""")
def quantised_matrix(spark, sf):
    out = N.quantised(P.stft_levels(frames(spark, sf)), ID)
    return out.select(*ID, "frame", "bin", "count")


HIST_SQL = f"""{B.SHOTS_SQL}, g AS (SELECT recording_id, count(*) AS n, min(level) AS lo, max(level) AS hi, quantile_cont(level, 0.75) - quantile_cont(level, 0.25) AS iqr FROM shots GROUP BY 1),
b AS (SELECT *, CASE WHEN hi > lo THEN least(24, greatest(3, ceil((hi - lo) / CASE WHEN iqr > 0 THEN 2 * iqr / cbrt(n) ELSE (hi - lo) / (ceil(log2(n)) + 1) END))) ELSE 1 END AS bins FROM g WHERE n >= 2),
s AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / bins ELSE 1 END AS step FROM b)"""


@query(f"""WITH {HIST_SQL}, h AS (SELECT recording_id, bins::INT AS bins, least(bins - 1, greatest(0, floor((level - lo) / step)))::INT AS bin, lo, step, count(*) AS count FROM shots JOIN s USING (recording_id) GROUP BY 1, 2, 3, 4, 5)
SELECT recording_id, bins, bin, {r("lo + bin * step", "edge")}, count FROM h""")
def histogram(spark, sf):
    return rounded(N.histogram(B.shots(spark, sf, number=False), KEY, "level"))


@query(f"""WITH {B.SHOTS_SQL}, g AS (SELECT recording_id, count(*) AS n, min(level) AS a, max(level) AS z, greatest(0.5::DOUBLE, 0.08::DOUBLE * (max(level) - min(level))) AS pad FROM shots GROUP BY 1),
s AS (SELECT *, least(24, greatest(6, n)) - 1 AS bins, a - pad AS lo, (z + pad - (a - pad)) / (least(24, greatest(6, n)) - 1) AS step FROM g)
SELECT recording_id, bins::INT AS bins, least(bins - 1, floor((level - lo) / step))::INT AS bin, count(*) AS count FROM shots JOIN s USING (recording_id) GROUP BY 1, 2, 3""")
def figure_bins(spark, sf):
    return N.figure_bins(B.shots(spark, sf, number=False), KEY, "level")


@query(f"""WITH {B.SHOTS_SQL} SELECT recording_id, event_id, {r("row_number() OVER (PARTITION BY recording_id ORDER BY level, event_id) / count(*) OVER (PARTITION BY recording_id)::DOUBLE", "share", 9)} FROM shots""")
def ecdf(spark, sf):
    shots = B.shots(spark, sf, number=False).select("recording_id", "event_id", "level")
    return rounded(N.ecdf(shots, KEY, "level", ["event_id"]).select("recording_id", "event_id", "share"), 9)


@query(f"""WITH {B.SHOTS_SQL}, g AS (SELECT recording_id, ceil(max(level) / 5) * 5 AS top FROM shots GROUP BY 1)
SELECT recording_id, top - 70.0::DOUBLE AS low, top AS high, max(top) OVER () - 70.0::DOUBLE AS shared_low, max(top) OVER () AS shared_high FROM g""")
def shared_range(spark, sf):
    return N.shared_range(B.shots(spark, sf, number=False), KEY)


@query(f"""WITH {B.SAMPLES_SQL}, p AS (SELECT recording_id, shot_number, max(abs(x)) AS pk, min_by(n, (-abs(x), n)) AS origin FROM samples GROUP BY 1, 2),
l AS (SELECT *, {amp_sql("pk")} AS db FROM p), m AS (SELECT recording_id, median(db) AS med, max(db) - min(db) AS spread FROM l GROUP BY 1)
SELECT s.recording_id, s.shot_number, {r("(n - origin) * 1000 / 8000::DOUBLE", "t_ms")}, {r("x", "x", 9)}, {r("spread", "peak_spread_dB")}, abs(db - med) > 3 AS marked
FROM samples s JOIN l USING (recording_id, shot_number) JOIN m ON m.recording_id = s.recording_id""")
def shot_overlay(spark, sf):
    out = N.shot_overlay(B.windows(spark, sf), ["recording_id"], ["shot_number"])
    return rounded(out.select(*ID, "t_ms", "x", "peak_spread_dB", "marked"), x=9)


