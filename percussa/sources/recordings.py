"""Listing, probing and reading recordings; sidecars, hashes and run history.

Bytes are read inside tasks by range, so a long file is many small reads and
never one row.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from percussa.operators.ordered import numbered

EXTENSIONS = [".wav", ".flac", ".aiff", ".aif", ".mp4", ".mov", ".mkv", ".avi", ".mts", ".mxf"]
CHUNK_S, CONTEXT_S = 120.0, 2.0
MIN_RATE = 48_000
META_TEXT = ["test_id", "weapon", "ammunition", "suppressor", "configuration", "mic_model", "mic_serial", "ground_surface",
             "windscreen", "location", "operator", "date", "calibrator_model", "notes"]
META_NUMBER = ["barrel_length_in", "calibrator_level_dB", "mic_distance_m", "mic_angle_deg", "mic_height_m", "temperature_C",
               "humidity_pct", "pressure_kPa", "wind_mps", "calibration_pre_dB", "calibration_post_dB"]
META_SCHEMA = ", ".join([f"{c} string" for c in META_TEXT] + [f"{c} double" for c in META_NUMBER])


def list_recordings(spark: SparkSession, directory: str) -> DataFrame:
    """Recordings of one folder with their place in name order; contents are not read."""
    files = spark.read.format("binaryFile").load(directory).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    found = files.select("*", name.alias("name"), F.lower(name).alias("_sort"), F.lit(directory).alias("directory")).where(
        suffix.isin(EXTENSIONS))
    return numbered(found, ["directory"], ["_sort", "path"], "seq").drop("_sort")


def _open(path: str):
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
    return where.open_input_file(inner)


def riff_header(handle) -> dict:
    """Rate, channels, sample format and data range of a PCM or float RIFF file."""
    size = handle.size()
    handle.seek(0)
    head = handle.read(12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise ValueError("not a RIFF wave file")
    at, out = 12, {}
    while at + 8 <= size:
        handle.seek(at)
        tag, length = struct.unpack("<4sI", handle.read(8))
        if tag == b"fmt ":
            body = handle.read(length)
            kind, channels, rate, _, block, bits = struct.unpack("<HHIIHH", body[:16])
            if kind == 0xFFFE and length >= 26:
                kind = struct.unpack("<H", body[24:26])[0]
            out.update(kind=kind, n_channels=channels, fs=rate, block=block, bits=bits)
        elif tag == b"data":
            out.update(data_start=at + 8, data_bytes=min(length, size - at - 8))
            break
        at += 8 + length + length % 2
    if "kind" not in out or "data_start" not in out:
        raise ValueError("no format or data chunk")
    if out["kind"] not in (1, 3) or (out["kind"], out["bits"]) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)}:
        raise ValueError("sample format is not PCM or float")
    out["frames"] = out["data_bytes"] // out["block"]
    return out


def decode(raw: bytes, kind: int, bits: int, channels: int) -> np.ndarray:
    """Full-scale floats, frames by channels."""
    if kind == 3:
        x = np.frombuffer(raw, "<f4" if bits == 32 else "<f8").astype("float64")
    elif bits == 8:
        x = (np.frombuffer(raw, "u1").astype("float64") - 128) / 128
    elif bits == 24:
        b = np.frombuffer(raw, "u1").reshape(-1, 3).astype("int32")
        v = b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)
        x = np.where(v >= 1 << 23, v - (1 << 24), v) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{bits // 8}").astype("float64") / float(1 << (bits - 1))
    return x.reshape(-1, channels)


HEADER_SCHEMA = ("path string, name string, seq long, size long, fs int, n_channels int, bits int, kind int, block int,"
                 " data_start long, frames long, duration_s double, nyquist_Hz double, sample_rate_adequate boolean,"
                 " readable boolean, problem string")


def probe_headers(listing: DataFrame) -> DataFrame:
    """Header facts of every file; a file that cannot be read is a row with its problem."""

    def probe(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                row = {"path": r.path, "name": r.name, "seq": r.seq, "size": r.length, "readable": True, "problem": None}
                try:
                    with _open(r.path) as handle:
                        h = riff_header(handle)
                    row.update({k: h[k] for k in ("fs", "n_channels", "bits", "kind", "block", "data_start", "frames")})
                    row.update(duration_s=h["frames"] / h["fs"], nyquist_Hz=h["fs"] / 2, sample_rate_adequate=h["fs"] >= MIN_RATE)
                except (OSError, ValueError, struct.error) as e:
                    row.update(readable=False, problem=str(e))
                rows.append(row)
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in HEADER_SCHEMA.split(", ")])
            for c in ("fs", "n_channels", "bits", "kind", "block", "data_start", "frames"):
                out[c] = out[c].astype("Int64")
            yield out

    return listing.select("path", "name", "seq", "length").mapInPandas(probe, HEADER_SCHEMA.replace(",  ", ", "))


def plan_chunks(recordings: DataFrame, chunk: Column, context: Column, frames: str = "frames") -> DataFrame:
    """Read and core spans that tile every recording."""
    n = F.col(frames)
    rows = recordings.where(n > 0).withColumn("core_start", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, chunk)))
    start = F.col("core_start")
    stop = F.least(n, start + chunk)
    return rows.withColumns({
        "chunk_id": F.floor(start / chunk), "core_stop": stop,
        "read_start": F.greatest(F.lit(0).cast("long"), start - context), "read_stop": F.least(n, stop + context)})


def read_chunks(headers: DataFrame, chunk_s: float = CHUNK_S, context_s: float = 0.0) -> DataFrame:
    """Samples of every chunk and channel, read by byte range inside the tasks."""
    fs = F.col("fs").cast("double")
    plan = plan_chunks(headers.where("readable"), F.greatest(F.lit(1), F.floor(fs * chunk_s)).cast("long"),
                       F.floor(fs * context_s).cast("long"))
    plan = plan.withColumnRenamed("name", "recording_id").repartition("recording_id", "chunk_id")

    def read(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                with _open(r.path) as handle:
                    handle.seek(int(r.data_start + r.read_start * r.block))
                    raw = handle.read(int((r.read_stop - r.read_start) * r.block))
                x = decode(raw, r.kind, r.bits, r.n_channels)
                yield pd.DataFrame({
                    "recording_id": r.recording_id, "channel": np.arange(r.n_channels), "chunk_id": r.chunk_id, "fs": r.fs,
                    "start_frame": r.read_start, "core_start": r.core_start, "core_stop": r.core_stop,
                    "samples": [x[:, c].astype("float32") for c in range(r.n_channels)]})

    return plan.mapInPandas(read, "recording_id string, channel int, chunk_id long, fs int, start_frame long,"
                                  " core_start long, core_stop long, samples array<float>")


def select_channel(chunks: DataFrame, channel: int) -> DataFrame:
    return chunks.where(F.col("channel") == channel)


def mono_mix(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over the channels of each chunk; a chunk has few channels."""
    g = chunks.groupBy(*keys, "chunk_id").agg(F.collect_list("samples").alias("_all"))
    n = F.size("_all")
    total = F.aggregate(F.slice("_all", F.lit(2), n), F.transform(F.col("_all")[0], lambda x: x.cast("double")),
                        lambda acc, s: F.zip_with(acc, s, lambda a, b: a + b))
    return g.select(*keys, "chunk_id", F.transform(total, lambda x: x / n).alias("samples"))


def channel_out_of_range(headers: DataFrame, channel: int) -> DataFrame:
    """Recordings that do not have the requested channel."""
    return headers.where(F.col("readable") & (F.col("n_channels") <= channel)).select(
        "path", F.lit("channel out of range").alias("problem"))


def read_sidecars(spark: SparkSession, directory: str) -> DataFrame:
    """Metadata per recording stem; the preferred of its candidate files that can be read."""
    texts = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(directory)
    return parse_sidecars(texts.withColumn("path", F.input_file_name()))


def parse_sidecars(texts: DataFrame) -> DataFrame:
    """(path, value) JSON documents to one metadata row per stem; unknown keys are ignored."""
    name = F.element_at(F.split("path", "/"), -1)
    preferred = name.endswith(".metadata.json")
    stem = F.regexp_replace(name, r"(\.metadata)?\.json$", "")
    rows = texts.select(stem.alias("stem"), F.when(preferred, 0).otherwise(1).alias("_rank"),
                        F.from_json("value", META_SCHEMA).alias("m"), F.col("value").rlike(r"^\s*\{").alias("_object"))
    rows = rows.where("_object AND m IS NOT NULL")
    best = rows.groupBy("stem").agg(F.min_by("m", "_rank").alias("m")).select("stem", "m.*")
    return best.withColumn("configuration", F.lower(F.trim("configuration")))


def content_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("sha256", F.sha2(content, 256))


def first_of_each_content(files: DataFrame, order: str) -> DataFrame:
    """One file per content; only hashes are shuffled, combined map-side."""
    keep = files.groupBy("sha256").agg(F.min(order).alias(order), F.count("*").alias("n_copies"))
    return keep


def run_timestamp(stamp: str, fallback: Column) -> Column:
    """When a run was analysed: ISO text, compact text, else the file's time."""
    return F.coalesce(F.try_to_timestamp(stamp), F.try_to_timestamp(F.col(stamp), F.lit("yyyyMMdd_HHmmss")), fallback)


def run_history(records: DataFrame) -> DataFrame:
    """Digest of every stored run, schema v1 (flat) or v2 (nested), newest first."""
    c = F.col
    out = records.withColumn("analysed_at", run_timestamp("_stamp", c("modified_at"))) if "_stamp" in records.columns else (
        records.withColumn("_stamp", F.coalesce("analysis.timestamp", "timestamp")).withColumn(
            "analysed_at", run_timestamp("_stamp", c("modified_at"))))
    return out.select(
        "run_id", F.coalesce("schema_version", F.lit("1.0")).alias("schema_version"), "analysed_at",
        F.coalesce("analysis.input_file", "input_file", F.lit("")).alias("input_file"),
        F.coalesce("source.sample_rate", "sample_rate").alias("sample_rate"),
        F.coalesce("aggregate.n_shots", "n_shots").alias("n_shots"),
        F.coalesce("calibration.level_unit", F.lit("dB")).alias("level_unit"),
        F.coalesce("test_metadata.test_id", F.lit("")).alias("test_id"),
    ).orderBy(F.desc("analysed_at"), "run_id")


def history_filter(runs: DataFrame, configuration: str = "all", needle: str = "") -> DataFrame:
    """Runs of one configuration whose text fields contain the needle."""
    fields = ["name", "input_file", "weapon", "suppressor", "operator", "ammunition", "location", "configuration"]
    texts = F.lower(F.concat_ws(" ", *[F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields if f in runs.columns]))
    out = runs if configuration == "all" else runs.where(F.col("configuration") == configuration)
    return out.where(texts.contains(needle.strip().lower())) if needle.strip() else out


def reference_aggregate(stats: DataFrame, run: str) -> DataFrame:
    """A stored aggregate rebuilt as one row per run: metric name to statistics."""
    entry = F.struct("n", "mean", "std", "minimum", "maximum", "median", "ci95")
    return stats.groupBy(run).agg(F.map_from_entries(F.collect_list(F.struct("metric", entry))).alias("stats"))
