"""Registered queries against their SQL in DuckDB.

A representative part runs by default; set TIDEWATCH_ALL=1 for every query (also
``python check.py``).
"""

import os

import pytest

import __spark_entry__ as entry_point
from check import compare, connect
from conftest import SF

DEFAULT = [
    "series_scan", "expand_6", "calibration_znorm", "threshold_trimmed", "causal_jump", "causal_gradual", "causal_structural",
    "causal_kernel", "jump_vote", "window_positions", "mask_runs", "mask_adaptive", "jump_sync_matrix", "jump_clusters",
    "drift_static_cusum", "path_topology_jumps", "path_entropy_parts", "reconstruction_error", "eval_auc", "eval_benchmark_sweep",
    "period_dominant", "vote_by_regime", "stream_jump_vote",
]
ORACLES = entry_point.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("TIDEWATCH_ALL") else DEFAULT


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    got = entry_point.queries()[name](spark, SF).toPandas()
    verdict = compare(got, con.execute(ORACLES[name]).df())
    assert verdict.startswith("ok"), verdict


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry_point.queries())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"series_id", "idx", "score", "flag"}
