"""A few registered queries next to their SQL; tests/oracle_check.py runs them all."""

import pytest

import __spark_entry__ as entry
import oracle_check

NAMES = ["insertion_loss_from_windows", "metric_stats", "string_trend", "auto_pair", "comparability", "absorption",
         "validity_verdict", "rise_time", "candidate_peaks", "seam_dedupe", "stft", "envelope_pyramid"]


@pytest.fixture(scope="module")
def con():
    return oracle_check.database("sf0.001")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    text, ok = oracle_check.compare(spark, con, "sf0.001", name)
    assert ok, text


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
