"""Registered queries against their SQL on the smallest tables; all of them: check_queries.py."""

import os

import pytest

import __spark_entry__ as entry
from tidewatch.plans.oracles import STATIC
from tidewatch.plans.queries import QUERIES
from tests.check_queries import checker, compare

SF_DIR = "/root/testdata/sf0.001"
FAST = (
    "flow_clean window_state_1h window_state_moments signed_log_scale_clip sequence_frames "
    "hybrid_risk fit_scaler fit_benign_baseline eval_binary fitted_detection detection_summary risk_band forecast_points top_features rolling_buffer_sensors "
    "rolling_buffer_reinserted buffer_stats flow_summary zeek_parse zeek_conn zeek_generic "
    "scenario_metadata slot_keys normalize_names flow_csv_scan epoch_parse log_times"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return checker(SF_DIR)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    assert compare(got, con.execute(entry.oracle_sql()[name]).df()) == ""


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(STATIC)


def test_entry(spark):
    assert entry.entry(spark).count() == 4
