"""Files on disk and chunks as streams."""

import json
import struct
import uuid
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from percussa.functions import dsp
from percussa.operators import quality as Q
from percussa.plans import stream_queries
from percussa.sources import recordings as R
from percussa.sources import sinks as W
from percussa.streaming import chunks as O


def write_wav(path, x, fs, width=2):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(x.shape[1])
        f.setsampwidth(width)
        f.setframerate(fs)
        scaled = np.round(x * ((1 << (8 * width - 1)) - 1)).astype("<i8")
        raw = scaled.reshape(-1)
        f.writeframes(b"".join(int(v).to_bytes(width, "little", signed=True) for v in raw))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("session")
    rng = np.random.default_rng(7)
    signals = {"B.wav": rng.uniform(-0.9, 0.9, (1000, 2)), "a.WAV": rng.uniform(-0.9, 0.9, (701, 1))}
    write_wav(d / "B.wav", signals["B.wav"], 48000, 3)
    write_wav(d / "a.WAV", signals["a.WAV"], 8000, 2)
    (d / "c.wav").write_bytes(b"RIFF" + struct.pack("<I", 4) + b"WAVEjunk")
    (d / "notes.txt").write_text("no recording")
    (d / "B.metadata.json").write_text(json.dumps({"weapon": "W", "configuration": " Suppressed ", "mic_distance_m": 1.5, "other": 1}))
    (d / "B.json").write_text(json.dumps({"weapon": "wrong"}))
    (d / "a.json").write_text(json.dumps({"weapon": "V"}))
    return d, signals


def test_listing_and_headers(spark, folder):
    d, _ = folder
    listing = R.list_recordings(spark, str(d))
    assert [r.name for r in listing.orderBy("seq").collect()] == ["a.WAV", "B.wav", "c.wav"]
    heads = {r.name: r for r in R.probe_headers(listing).collect()}
    assert (heads["B.wav"].fs, heads["B.wav"].n_channels, heads["B.wav"].frames, heads["B.wav"].bits) == (48000, 2, 1000, 24)
    assert heads["B.wav"].sample_rate_adequate and not heads["a.WAV"].sample_rate_adequate
    assert not heads["c.wav"].readable and heads["c.wav"].problem


@pytest.mark.parametrize("chunk_s", [10.0, 0.011, 0.003])
def test_chunks_join_to_the_file(spark, folder, chunk_s):
    d, signals = folder
    chunks = R.read_chunks(R.probe_headers(R.list_recordings(spark, str(d))), chunk_s)
    for name, x in signals.items():
        for c in range(x.shape[1]):
            rows = R.select_channel(chunks, c).where(F.col("recording_id") == name).orderBy("chunk_id").collect()
            got = np.concatenate([r.samples for r in rows])
            assert len(got) == len(x) and np.abs(got - x[:, c]).max() < 1e-4
    mono = R.mono_mix(chunks.where("recording_id = 'B.wav'"), ["recording_id"]).orderBy("chunk_id").collect()
    assert np.abs(np.concatenate([r.samples for r in mono]) - signals["B.wav"].mean(axis=1)).max() < 1e-4


def test_sidecars(spark, folder):
    d, _ = folder
    got = {r.stem: r for r in R.read_sidecars(spark, str(d)).collect()}
    assert got["B"].weapon == "W" and got["B"].configuration == "suppressed" and got["B"].mic_distance_m == 1.5
    assert got["a"].weapon == "V" and got["a"].configuration is None


def test_written_tables_read_back(spark, tmp_path):
    short = spark.createDataFrame([("r", 1.0)], "recording_id string, Lpeak_Z double")
    with pytest.raises(ValueError, match="time_s"):
        W.shot_table(short, ["recording_id"])
    m = spark.createDataFrame([("r", 1, 123.456, 0.000123456789, float("nan"), True, ["x", "y"])],
                              "recording_id string, shot_number int, Lpeak_Z double, specific_impulse_Pa_s double, kurtosis double, valid boolean, notes array<string>")
    for c in W.SHOT_COLUMNS.values():
        if c not in m.columns:
            m = m.withColumn(c, F.lit(None).cast("double"))
    m = m.withColumn("duration_ms", F.lit(64.0))
    assert len(W.shot_table(m, []).columns) == 31
    W.write_shot_metrics(m, spark.createDataFrame([("r", "dB SPL")], "recording_id string, level_unit string"), ["recording_id"], str(tmp_path))
    row = spark.read.csv(f"{tmp_path}/shots", header=True).first()
    assert (row.Lpeak_Z, row.specific_impulse, row.kurtosis, row.valid, row.notes) == ("123.46", "0.000123457", None, "true", "x; y")


def stream_of(spark, path, rows):
    df = spark.createDataFrame(rows, "recording_id long, channel int, chunk_id long, fs int, samples array<double>")
    df.write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def test_streamed_weighting_has_no_seams_and_mends_order(spark, tmp_path):
    rng = np.random.default_rng(10)
    x = rng.normal(0, 0.1, 16000)
    rows = [(1, 0, c, 8000, x[c * 4000:(c + 1) * 4000].tolist()) for c in (2, 0, 1, 1, 3)]
    O.use_rocksdb(spark)
    out = O.run_available(O.stateful_weighting(stream_of(spark, tmp_path / "in", rows), "A"), str(tmp_path / uuid.uuid4().hex))
    got = out.orderBy("chunk_id").collect()
    assert [r.chunk_id for r in got] == [0, 1, 2, 3]
    y = np.concatenate([r.samples for r in got])
    assert np.abs(y - dsp.weighted(x[None, :], 8000.0, "A")[0]).max() < 1e-4


def test_running_ceiling_equals_the_batch_answer(spark, tmp_path):
    rng = np.random.default_rng(11)
    x = np.clip(rng.normal(0, 0.05, 6000), -0.2, 0.2)
    x[995:1004] = 0.6       # crosses a border
    x[4000:4005] = -0.6
    x[5998:6000] = 0.6
    rows = [(1, 0, c, 8000, x[c * 1000:(c + 1) * 1000].tolist()) for c in range(6)]
    O.use_rocksdb(spark)
    out = O.run_available(O.running_ceiling(stream_of(spark, tmp_path / "in", rows)), str(tmp_path / uuid.uuid4().hex))
    last = out.orderBy(F.desc("chunk_id")).first()
    long = spark.createDataFrame([(1, int(i), float(v)) for i, v in enumerate(x)], "recording_id long, n long, x double")
    batch = Q.ceiling_clipping(long, ["recording_id"]).first()
    assert (last.ceiling_runs, last.ceiling_samples, last.longest_run) == (batch.runs, batch.samples, batch.longest_run) == (2, 14, 9)
    assert last.ceiling_detected == batch.detected and last.crest_dB == pytest.approx(batch.crest_dB)


def test_a_batch_that_is_tried_again_is_kept_once(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "chunk_id")
    for number in (0, 1, 1):
        O.keep_batch(df, number, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10


@pytest.mark.parametrize("name", ["chunk_spectrogram", "streaming_quality", "two_pass_detection"])
def test_stream_queries_read_a_table_that_is_a_folder(spark, tmp_path, name):
    rng = np.random.default_rng(12)
    rows = [(i, i % 2, [float(v) for v in rng.normal(0, 0.2, 64)]) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    df.repartition(2).write.parquet(str(tmp_path / "folder" / "embeddings.parquet"))
    df.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "file" / "embeddings.parquet")
    folder, file = (sorted(map(tuple, getattr(stream_queries, name)(spark, str(tmp_path / d)).collect())) for d in ("folder", "file"))
    assert len(folder) > 0 and folder == file
