"""Chunks of live recordings: ordered state, seamless filters, running quality.

Chunks carry (recording_id, channel, chunk_id, fs, samples). State is per
(recording_id, channel): the next chunk expected, chunks that came early, and
what the operator carries. A chunk seen before is dropped; one that comes early
waits. Filters use RocksDB-backed state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from percussa.functions import dsp
from percussa.functions import levels as L
from percussa.operators.quality import CEILING_RUN, CEILING_RUNS, CLIP_TOLERANCE, MIN_CREST_DB

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ["recording_id", "channel"]


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class InOrder(StatefulProcessor):
    """Feeds the chunks of a key to `step` in order of chunk_id, once each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._next = handle.getValueState("next", "chunk_id long")
        self._early = handle.getMapState("early", "chunk_id long", "fs int, samples array<double>")
        self._carried = handle.getValueState("carried", "body string, tail array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        expected = self._next.get()[0] if self._next.exists() else 0
        for pdf in rows:
            for r in pdf.itertuples():
                if r.chunk_id >= expected and not self._early.containsKey((int(r.chunk_id),)):
                    self._early.updateValue((int(r.chunk_id),), (int(r.fs), [float(v) for v in r.samples]))
        out = []
        body, tail = self._carried.get() if self._carried.exists() else ("{}", [])
        carried = (json.loads(body), np.asarray(tail, float))
        while self._early.containsKey((int(expected),)):
            fs, samples = self._early.getValue((int(expected),))
            result, carried = self.step(expected, int(fs), np.asarray(samples, float), carried)
            out.append({**dict(zip(KEYS, key)), **result})
            self._early.removeKey((int(expected),))
            expected += 1
        self._next.update((int(expected),))
        self._carried.update((json.dumps(carried[0]), [float(v) for v in carried[1]]))
        if out:
            yield pd.DataFrame(out)

    def step(self, chunk_id: int, fs: int, x: np.ndarray, carried):
        raise NotImplementedError

    def close(self) -> None:
        pass


class Weighting(InOrder):
    """Frequency weighting without seams: the tail of what came before warms the filter up."""

    def __init__(self, kind: str) -> None:
        self._kind = kind

    def step(self, chunk_id, fs, x, carried):
        context = int(np.ceil(12 * fs / (2 * np.pi * dsp.F1)))
        wide = np.concatenate([carried[1], x])
        y = dsp.weighted(wide, fs, self._kind)[len(carried[1]):]
        return {"chunk_id": chunk_id, "fs": fs, "samples": y}, ({}, wide[-context:])


class LeadIn(InOrder):
    """Chunks with the last `lead_s` seconds before them, for detectors that need settling."""

    def __init__(self, lead_s: float) -> None:
        self._lead_s = lead_s

    def step(self, chunk_id, fs, x, carried):
        wide = np.concatenate([carried[1], x])
        keep = max(1, int(self._lead_s * fs))
        return {"chunk_id": chunk_id, "fs": fs, "lead": len(carried[1]), "samples": wide}, ({}, wide[-keep:])


class RunningCeiling(InOrder):
    """Peak, sums and plateaus at the highest level so far, as chunks arrive.

    A louder chunk starts the tally again; one that cannot reach the ceiling
    only adds to the sums. A plateau that crosses a border stays one run.
    """

    def step(self, chunk_id, fs, x, carried):
        s = {"n": 0, "sum_x": 0.0, "sum_x2": 0.0, "peak": 0.0, "ceiling": 0.0, "samples": 0, "runs": 0, "longest": 0, "open": 0}
        s.update(carried[0])
        a = np.abs(x)
        top = float(a.max()) if len(a) else 0.0
        s["n"] += len(x)
        s["sum_x"] += float(x.sum())
        s["sum_x2"] += float((x * x).sum())
        s["peak"] = max(s["peak"], top)
        if top > s["ceiling"] * (1 + CLIP_TOLERANCE):
            s.update(ceiling=top, samples=0, runs=0, longest=0, open=0)
        if top >= s["ceiling"] * (1 - CLIP_TOLERANCE):
            at = np.abs(a - s["ceiling"]) <= s["ceiling"] * CLIP_TOLERANCE
            edges = np.flatnonzero(np.diff(np.r_[False, at, False]))
            for i, (start, stop) in enumerate(zip(edges[::2], edges[1::2])):
                before = s["open"] if start == 0 else 0
                length = stop - start + before
                if length >= CEILING_RUN:
                    s["samples"] += int(length if before < CEILING_RUN else stop - start)
                    s["runs"] += int(before < CEILING_RUN)
                s["longest"] = max(s["longest"], int(length))
            last = edges[-1] if len(edges) else -1
            joined = len(at) > 0 and at.all()
            s["open"] = int((last - edges[-2] + (s["open"] if joined else 0)) if len(edges) and last == len(at) else 0)
        else:
            s["open"] = 0
        crest = 20 * np.log10(max(s["peak"], L.EPS) / max(np.sqrt(s["sum_x2"] / max(s["n"], 1)), L.EPS))
        found = s["runs"] >= CEILING_RUNS and s["ceiling"] < 1 - CLIP_TOLERANCE and crest >= MIN_CREST_DB
        row = {"chunk_id": chunk_id, "n_samples": s["n"], "peak_FS": s["peak"], "dc_offset_FS": s["sum_x"] / max(s["n"], 1),
               "ceiling_FS": s["ceiling"], "ceiling_samples": s["samples"], "ceiling_runs": s["runs"],
               "longest_run": s["longest"], "crest_dB": float(crest), "ceiling_detected": bool(found)}
        return row, (s, carried[1])


_CHUNK_OUT = "recording_id long, channel int, chunk_id long, fs int, samples array<double>"


def _ordered(chunks: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    return chunks.groupBy(*KEYS).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="none")


def stateful_weighting(chunks: DataFrame, kind: str = "A") -> DataFrame:
    return _ordered(chunks, Weighting(kind), _CHUNK_OUT)


def with_lead_in(chunks: DataFrame, lead_s: float = 1.0) -> DataFrame:
    return _ordered(chunks, LeadIn(lead_s), _CHUNK_OUT.replace("samples", "lead int, samples"))


def running_ceiling(chunks: DataFrame) -> DataFrame:
    return _ordered(chunks, RunningCeiling(), "recording_id long, channel int, chunk_id long, n_samples long, peak_FS double,"
                    " dc_offset_FS double, ceiling_FS double, ceiling_samples long, ceiling_runs long, longest_run long,"
                    " crest_dB double, ceiling_detected boolean")


def running_quality(chunks: DataFrame) -> DataFrame:
    """Peak, offset and mean square per recording so far, as a plain streaming aggregate."""
    rows = chunks.select(*KEYS, F.size("samples").alias("_n"), L.peak("samples").alias("_peak"),
                         F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("_s"), L.sum_squares("samples").alias("_q"))
    g = rows.groupBy(*KEYS).agg(F.sum("_n").alias("n_samples"), F.max("_peak").alias("peak_FS"),
                                F.sum("_s").alias("_s"), F.sum("_q").alias("_q"), F.min(F.col("_q") / F.col("_n")).alias("_quiet"))
    return g.select(*KEYS, "n_samples", "peak_FS", (-20 * F.log10("peak_FS")).alias("headroom_dB"),
                    (F.col("_s") / F.col("n_samples")).alias("dc_offset_FS"),
                    L.power_level(F.col("_q") / F.col("n_samples")).alias("level_dB"), L.power_level("_quiet").alias("quietest_chunk_dB"))


def chunk_spectrogram(chunks: DataFrame, nperseg: int, noverlap: int, thin: int = 1) -> DataFrame:
    """Stateless: the spectrogram of each chunk by itself; `thin` keeps every so many-th frame."""
    from percussa.operators.spectra import stft_of

    frames = chunks.select(*KEYS, "chunk_id", "fs", F.inline(stft_of(nperseg, noverlap)("samples", "fs")))
    return frames.where(F.col("frame") % thin == 0)


def chunk_bands(led: DataFrame, weighting: str = "fast", hop_ms: float = 10.0, lowest: float = 0.0) -> DataFrame:
    """Band histories of chunks with their lead-in; the frames of the lead-in are not reported."""
    from percussa.operators.spectra import band_levels_of

    kernel = band_levels_of(weighting, hop_ms, lowest)
    return led.select(*KEYS, "chunk_id", F.inline(kernel("samples", "fs", "lead")))


def keep_batch(batch: DataFrame, number: int, path: str) -> None:
    """Write a micro-batch where only this number writes."""
    batch.write.mode("overwrite").parquet(f"{path}/out/micro_batch={number}")


def run_available(stream: DataFrame, path: str, mode: str = "append", pick: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Process what is there, write every micro-batch as a table, and return what was written.

    In append mode the batches add up, each in a folder of its number, so a batch that is tried again replaces itself;
    in complete mode the last one stands.
    """
    def save(batch: DataFrame, number: int) -> None:
        keep_batch(pick(batch) if pick else batch, number if mode == "append" else 0, path)

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/progress")
             .trigger(availableNow=True).foreachBatch(save).start())
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out").drop("micro_batch")


def two_pass(stream: DataFrame, path: str, detect: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Detection over a stream: thresholds are global, so chunks are stored first and looked at after.

    Pass one writes the chunks as they come, dropping repeats; pass two runs
    `detect` over the stored table.
    """
    stored = run_available(stream, path)
    return detect(stored.dropDuplicates([*KEYS, "chunk_id"]))
