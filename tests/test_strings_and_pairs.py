"""String statistics, outliers and pairing on small cases with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from percussa.functions import levels as L
from percussa.functions import stats
from percussa.operators import pairing as P
from percussa.operators import review as V
from percussa.operators import strings as S
from percussa.plans import bindings as B

SF = "/root/testdata/sf0.001"


def test_student_t():
    # Tabled values of the upper quantile.
    for df, tail, want in ((4, 0.05, 2.13185), (10, 0.025, 2.22814), (1, 0.05, 6.31375), (200, 0.005, 2.60063)):
        assert stats.t_quantile_upper(tail, df) == pytest.approx(want, abs=1e-5)
        assert stats.t_upper_tail(want, df) == pytest.approx(tail, abs=1e-6)


def test_energy_mean_and_hazard(spark):
    levels = spark.createDataFrame([(100.0,), (110.0,), (float("-inf"),), (float("nan"),)], "l double")
    assert levels.agg(L.energy_mean("l")).first()[0] == pytest.approx(100 + 10 * math.log10(5.5))
    shots = spark.createDataFrame([(0, 100.0, True)] * 100, "rec int, LAE double, valid boolean")
    h = S.hazard(shots, ["rec"]).first()
    assert h.allowable_rounds == pytest.approx(910.736, abs=0.01)
    assert S.hazard(shots, ["rec"], protection_dB=25.0).first().allowable_rounds == pytest.approx(910.736 * 10**2.5, rel=1e-5)


def esd_by_definition(x, alpha):
    x, gone, last = list(enumerate(x)), [], 0
    n = len(x)
    for step in range(1, max(1, int(n * 0.1)) + 1):
        v = np.array([a for _, a in x])
        j = int(np.argmax(np.abs(v - v.mean())))
        if v.std(ddof=1) == 0:
            break
        r = abs(v[j] - v.mean()) / v.std(ddof=1)
        t = float(stats.t_quantile_upper(alpha / (2 * (n - step + 1)), n - step - 1))
        if r > (n - step) * t / math.sqrt((n - step - 1 + t * t) * (n - step + 1)):
            last = step
        gone.append(x.pop(j)[0])
    return sorted(gone[:last])


@pytest.mark.parametrize("limit,portion", [(None, 1024), (0, 1024), (None, 3), (None, 1)])
def test_esd_on_large_and_small_groups(spark, limit, portion, monkeypatch):
    monkeypatch.setattr(V, "PORTION", portion)
    rng = np.random.default_rng(12)
    groups = {0: np.r_[rng.normal(0, 1, 900), 9, 9, -11, 8.5, 14], 1: rng.normal(0, 1, 40), 2: np.r_[rng.normal(5, 0.1, 11), 9.0],
              3: np.ones(20), 4: np.r_[np.ones(200), 5.0], 5: np.r_[rng.normal(0, 1, 30), [50.0] * 3],
              6: np.r_[rng.normal(0, 1, 90), rng.normal(300, 9, 5), rng.normal(-200, 9, 4)]}
    rows = [(k, i, float(v)) for k, x in groups.items() for i, v in enumerate(x)]
    got = V.generalised_esd(spark.createDataFrame(rows, "rec int, shot int, value double"), ["rec"], "shot", 0.05, limit=limit).toPandas()
    for k, x in groups.items():
        want = esd_by_definition(x, 0.05) if np.std(x) > 0 else []
        assert sorted(got[got.rec == k].shot) == want, k


@pytest.fixture(scope="module")
def base():
    return {"recording_id": 0, "session_id": 1, "configuration": "unsuppressed", "weapon": "W", "ammunition": "A",
            "mic_distance_m": 1.0, "mic_angle_deg": 90.0, "mic_height_m": 1.6, "mic_model": "M", "mic_serial": "S1",
            "location": "range", "operator": "kim", "windscreen": "foam", "ground_surface": "grass", "date": "2026-08-12",
            "temperature_C": 20.0, "humidity_pct": 50.0, "pressure_kPa": 101.325, "calibration_pre_dB": 94.0,
            "calibration_post_dB": 94.1, "n_valid": 8}


def table(spark, *rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(
        f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in rows[0].items()))


def codes(spark, base, **change):
    test = {**base, "recording_id": 1, "configuration": "suppressed", **change}
    pairs = P.designated_pairs(table(spark, base, test), "session_id", "recording_id")
    return {r.code: r for r in P.objections(pairs, ["session_id"]).collect()}


def test_rules_one_field_at_a_time(spark, base):
    assert codes(spark, base) == {}
    far = codes(spark, base, mic_distance_m=1.5)
    assert far["distance_differs"].quantified_dB == pytest.approx(20 * math.log10(1.5)) and far["distance_differs"].correctable
    assert codes(spark, base, mic_angle_deg=95.0)["angle_differs"].severity == "blocking"
    assert codes(spark, base, weapon="X")["weapon_differs"].severity == "blocking"
    assert codes(spark, base, weapon="w") == {}
    assert codes(spark, base, date="13/08/2026")["different_day"].severity == "advisory"
    assert codes(spark, base, date="2026/08/20")["different_day"].severity == "material"
    assert codes(spark, base, temperature_C=40.0)["weather_differs"].severity == "material"
    assert codes(spark, base, calibration_post_dB=95.0)["test_calibration_drift"].quantified_dB == pytest.approx(1.0)
    assert codes(spark, base, n_valid=0)["test_empty"].severity == "blocking"
    assert codes(spark, base, location="  ") == {}


def test_score_and_tie(spark, base):
    test = {**base, "recording_id": 1, "configuration": "suppressed"}
    twin = {**base, "recording_id": 2}
    pairs = P.typed(P.designated_pairs(table(spark, base, test), "session_id", "recording_id"))
    assert pairs.select(P.match_score().alias("s")).first().s == 19.0
    for limit in (250_000, 0):
        got = P.auto_pair(table(spark, base, test, twin), "session_id", limit).first()
        assert got.reference_id is None and got.n_best == 2 and "2 references" in got.refusal
        got = P.auto_pair(table(spark, base, test, {**twin, "location": "field"}), "session_id", limit).first()
        assert got.reference_id == 0 and got.score == 19.0


def test_subset_index_gives_the_pairs_of_the_comparison(spark):
    recs = B.recordings(spark, SF)
    # One session holds a third of all recordings.
    hot = recs.withColumn("session_id", F.when(F.col("recording_id") % 3 == 0, -1).otherwise(F.col("session_id")))
    few = hot.where("session_id = -1 OR session_id < 40")
    a = sorted(map(tuple, P.auto_pair(few, "session_id").collect()))
    b = sorted(map(tuple, P.auto_pair(few, "session_id", 0).collect()), key=lambda r: r[:2])
    assert sorted(a, key=lambda r: r[:2]) == b


def test_esd_reads_its_rows_once(spark, tmp_path):
    """Figures of a group, candidates and the flags' center come from one pass over the rows, and one to size the groups."""
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(100, 1, 60), [130.0, 60.0]]
    rows = [(None if i == 5 else i % 2, i, float(v), float(v), 1000.0 + i, 0.5, 20.0 + i % 7, True, False) for i, v in enumerate(x)]
    names = "rec int, event_id long, Lpeak_Z double, LAE double, spectral_centroid_Hz double, a_duration_ms double, rise_time_us double, " \
            "valid boolean, clipped boolean"
    reads = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    shots = spark.createDataFrame(rows, names).mapInArrow(told, names)
    got = sorted((r.rec, r.event_id, r.metric, r.string_median, r.modified_z) for r in V.statistical_flags(shots, ["rec"], "event_id").collect())
    assert reads.value <= 2 * len(rows)
    want = []
    for rec in (0, 1):
        mine = np.array([v for i, v in enumerate(x) if i % 2 == rec and i != 5])
        mid = np.median(mine)
        far = 60 if rec == 0 else 61
        z = 0.6745 * (x[far] - mid) / np.median(np.abs(mine - mid))
        want += [(rec, far, m, pytest.approx(mid), pytest.approx(z)) for m in ("LAE", "Lpeak_Z")]
    assert got == want
    split = V.statistical_flags(spark.createDataFrame(rows, names), ["rec"], "event_id", limit=0).collect()
    assert sorted((r.rec, r.event_id, r.metric, r.string_median, r.modified_z) for r in split) == want
