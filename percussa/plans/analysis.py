"""From samples or files to shots, metrics, strings and comparisons, for many recordings at once.

detect      samples -> events with windows (two passes: thresholds are global to a recording)
preview     detect without calibration, with a display envelope; failures are rows
analyse     chunks in Pa -> shots, per-shot metrics, string statistics
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from percussa.functions import levels as L
from percussa.operators import calibration as C
from percussa.operators import detection as D
from percussa.operators import display as N
from percussa.operators import quality as Q
from percussa.operators import shots as G
from percussa.operators import strings as S
from percussa.session import checkpointed


@dataclass(frozen=True)
class Detection:
    """Settings in samples; `at_rate` gives them for a sample rate and times in ms."""

    fs: int
    window: int
    hop: int
    refractory: int
    pre: int
    post: int
    half: int
    relative_dB: float = 30.0
    min_snr_dB: float = 15.0
    max_shots: int | None = None

    @staticmethod
    def at_rate(fs: int, refractory_ms: float = 200.0, pre_ms: float = 50.0, post_ms: float = 200.0, **more) -> Detection:
        def samples(ms: float) -> int:
            return max(1, int(ms * fs / 1000))

        return Detection(fs, samples(1.0), samples(0.25), samples(refractory_ms), samples(pre_ms), samples(post_ms), samples(5.0), **more)


@dataclass(frozen=True)
class Found:
    """Tables of one detection: thresholds, candidates, accepted peaks, numbered shots."""

    thresholds: DataFrame
    candidates: DataFrame
    accepted: DataFrame
    shots: DataFrame
    sizes: DataFrame


def detect(samples: DataFrame, keys: list[str], s: Detection, detection_samples: DataFrame | None = None) -> Found:
    """Events of every recording. Samples are (keys, n, x).

    `detection_samples` is the band-limited twin the envelope is taken from.
    The envelope and the peaks are written once, as each is read several times.
    """
    sizes = D.sizes_of(samples, keys)
    source = samples if detection_samples is None else detection_samples
    env = checkpointed(D.rms_envelope(source, keys, s.window, s.hop, sizes))
    thr = checkpointed(D.resolve_threshold(env, keys, s.relative_dB, s.min_snr_dB))
    peaks = D.with_prominence(env, D.local_maxima(env, keys), keys)
    peaks = checkpointed(peaks.withColumn("idx", F.col("k") * s.hop + s.window // 2))
    cand = checkpointed(D.candidate_peaks(peaks, thr, keys, max(1, s.refractory // (2 * s.hop))))
    accepted = D.refractory_select(cand, keys, "idx", "height", s.refractory)
    if s.max_shots:
        accepted = D.limit_shots(accepted, keys, ["idx"], s.max_shots)
    accepted = checkpointed(accepted)
    refined = D.refine_peaks(accepted.select(*keys, "k", "idx"), samples, keys, s.half).drop("idx")
    leveled = refined.withColumnRenamed("refined", "idx").withColumn("peak_dB", L.amplitude_level("peak_Pa"))
    leveled = checkpointed(leveled.join(thr.select(*keys, "noise_floor_dB"), keys))
    shots = D.gate_and_number(leveled, keys, ["idx"], "peak_dB", "noise_floor_dB", s.min_snr_dB)
    return Found(thr, cand, accepted, D.assign_window(shots.join(sizes, keys), s.pre, s.post), sizes)


def preview(samples: DataFrame, keys: list[str], s: Detection, columns: int = 1600,
            recordings: DataFrame | None = None) -> DataFrame:
    """Counts, threshold and a display envelope per recording, in dB re full scale.

    `recordings` (keys) names those that must have a row; one without samples keeps it, with the problem named.
    """
    found = detect(samples, keys, s)
    shots = found.shots.groupBy(*keys).agg(F.count("*").alias("n_shots"))
    full_scale = L.full_scale_level(F.lit(1.0))
    drawn = N.minmax_envelope(samples, keys, found.sizes, columns).groupBy(*keys).agg(
        F.max("columns").alias("columns"), F.array_sort(F.collect_list(F.struct("k", "lo", "hi"))).alias("envelope"))
    every = found.sizes if recordings is None else recordings.select(*keys).distinct().join(found.sizes, keys, "left")
    out = every.join(found.thresholds, keys, "left").join(shots, keys, "left").join(drawn, keys, "left")
    problem = F.when(F.col("size").isNull(), "no samples could be read").when(
        F.col("threshold_dB").isNull(), "too short for an envelope")
    return out.na.fill(0, ["n_shots"]).select(
        *keys, "n_shots", (F.col("threshold_dB") - full_scale).alias("threshold_dB"), (F.col("peak_dB") - full_scale).alias("peak_dB"),
        "columns", "envelope", problem.alias("problem"))


def long_samples(chunks: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """(keys, n, x) of chunks of equal size."""
    rows = chunks.select(*keys, "chunk_id", F.posexplode("samples").alias("_p", "x"))
    return rows.select(*keys, (F.col("chunk_id") * chunk + F.col("_p")).alias("n"), F.col("x").cast("double").alias("x"))


def clipped_runs(samples: DataFrame, keys: list[str], full_scale: DataFrame) -> DataFrame:
    """Runs pinned at full scale or at a recording's own ceiling, with the overlap that flags a shot.

    `full_scale` is (keys, factor): the pressure that a full-scale sample stands for.
    """
    scaled = samples.join(full_scale, keys).select(*keys, "n", (F.col("x") / F.col("factor")).alias("x"))
    rail = Q.pinned_runs(scaled, keys, F.abs("x") >= 1 - Q.CLIP_TOLERANCE).where(F.col("length") >= Q.RAIL_RUN)
    top = Q.ceiling_clipping(scaled, keys).where("detected").select(*keys, "ceiling_FS")
    near = scaled.join(top, keys)
    low = Q.pinned_runs(near, keys, F.abs(F.abs("x") - F.col("ceiling_FS")) <= F.col("ceiling_FS") * Q.CLIP_TOLERANCE).where(
        F.col("length") >= Q.CEILING_RUN)
    return rail.withColumn("needed", F.lit(Q.RAIL_RUN)).unionByName(low.withColumn("needed", F.lit(Q.CEILING_RUN)))


def analyse(chunks: DataFrame, keys: list[str], chunk: int, s: Detection, full_scale: DataFrame | None = None,
            lead_ms: float = 200.0) -> tuple[Found, DataFrame, DataFrame]:
    """(events, per-shot metrics, string statistics) of chunked recordings in Pa.

    `chunks` is (keys, chunk_id, fs, samples) with `chunk` samples each, all at the rate of `s`; another rate is an
    error. With `full_scale` (keys, factor) shots that touch clipping are flagged and stay out of the statistics.
    Windows carry up to `lead_ms` of what came before, for the weighting filters.
    """
    other = chunks.where(F.col("fs") != s.fs).limit(1).count()
    if other:
        raise ValueError(f"all chunks must have the rate of the settings, {s.fs}")
    rows = chunks.select(*keys, "chunk_id", "fs", F.col("samples").cast("array<double>").alias("samples"))
    limited = C.filtered_chunks(rows, keys, C.band_limit)
    found = detect(long_samples(rows, keys, chunk), keys, s, long_samples(limited, keys, chunk))
    if full_scale is None:
        shots = found.shots.withColumn("_clipped", F.lit(False))
    else:
        runs = clipped_runs(long_samples(rows, keys, chunk), keys, full_scale)
        shots = D.flag_clipped(found.shots, runs, keys).withColumnRenamed("clipped", "_clipped")
    before = F.least(F.lit(int(lead_ms * s.fs / 1000)), F.col("window_start")).cast("int")
    shots = shots.withColumn("_lead", before).withColumn("window_start", F.col("window_start") - F.col("_lead"))
    windows = D.extract_windows(shots.select(*keys, "shot_number", "idx", "window_start", "window_end", "truncated", "_clipped", "_lead"),
                                rows.select(*keys, "chunk_id", "samples"), keys, chunk)
    made = G.shot_metrics(windows.withColumn("fs", F.lit(s.fs)), "_clipped", "truncated", "_lead")
    made = made.withColumn("window_start", F.col("window_start") + F.col("_lead")).withColumn("time_s", F.col("idx") / F.col("fs"))
    metrics = checkpointed(made.drop("_clipped", "_lead"))
    names = [*S.LEVEL_METRICS, *S.PLAIN_METRICS]
    return found, metrics, S.aggregate_string(metrics, keys, names)
