"""Written tables read back."""

import numpy as np
from pyspark.sql import functions as F

from percussa.operators import spectra as P
from percussa.sources import sinks as W


def test_losses_curves_records_and_spectrograms(spark, tmp_path):
    loss = spark.createDataFrame([("r", "LAE", 12.0)], "recording_id string, metric string, reduction_dB double")
    bands = spark.createDataFrame([("r", 1000.0, 11.0)], "recording_id string, band_Hz double, loss_dB double")
    W.write_insertion_loss(loss, bands, f"{tmp_path}/loss")
    assert spark.read.csv(f"{tmp_path}/loss/metrics", header=True).first().reduction_dB == "12.0"
    assert spark.read.csv(f"{tmp_path}/loss/bands", header=True).first().loss_dB == "11.0"

    curves = spark.createDataFrame([("r", "LAF", 0.0, float("-inf")), ("r", "LAF", 0.1, 90.0)],
                                   "recording_id string, curve string, t double, level double")
    W.write_level_curves(curves, f"{tmp_path}/curves")
    assert [r.level for r in spark.read.parquet(f"{tmp_path}/curves").orderBy("t").collect()] == [None, 90.0]

    runs = spark.createDataFrame([("r", "dB SPL")], "recording_id string, level_unit string")
    shots = spark.createDataFrame([("r", i, float("nan") if i == 2 else 100.0 + i) for i in range(1, 8)],
                                  "recording_id string, shot_number int, Lpeak_Z double")
    stats = spark.createDataFrame([("r", "Lpeak_Z", 7)], "recording_id string, metric string, n int")
    W.write_record(W.run_record(runs, shots, stats, ["recording_id"], ["shot_number"], page=3), f"{tmp_path}/record")
    back = spark.read.json(f"{tmp_path}/record").orderBy("page").collect()
    assert [len(r.shots) for r in back] == [3, 3, 1] and back[0].schema_version == "2.0"
    assert [s.shot_number for r in back for s in r.shots] == list(range(1, 8))
    assert spark.read.json(f"{tmp_path}/record").select(F.explode("shots").alias("s")).where("s.Lpeak_Z IS NULL").count() == 1

    x = np.sin(np.arange(256)).tolist()
    frames = P.stft(spark.createDataFrame([("r", 8000, x)], "recording_id string, fs int, samples array<double>"), ["recording_id"], 64, 32)
    W.write_spectrogram(frames, {"nperseg": 64, "window": "hann"}, f"{tmp_path}/stft")
    read = spark.read.parquet(f"{tmp_path}/stft")
    assert read.count() == 7 * 33 and read.first().window == "hann"


def test_number_text_rounds_as_binary_values_lie(spark):
    values = [7.625, 7.635, 2.675, 1.005, 1.125, 1.375, -7.625, -2.675, 1000000.125, 12.345, 99.995, 0.5, 0.0, 3.0, 123456.785]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(W.number_text(F.col("v"))).collect()
    assert [r[0] for r in got] == [f"{v:.6g}" if v and abs(v) < 1 else f"{v:.2f}" for v in values]
