"""Registered queries against DuckDB on the smallest data set."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = ["d06_d14_validation_report", "u01_u02_listing_audit", "p06_p10_candidate_diagnostics",
         "p12_benjamini_hochberg_by_family", "x07_lagged_zscores", "f01_f13_features", "m03_arima",
         "g06_signals", "b06_admitted_trades", "b12_daily_pnl", "b13_exposure", "a04_a13_backtest_metrics",
         "r03_r06_robustness_results", "e09_e10_regime_performance", "e12_e14_regime_summary"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_twin(spark, name):
    ok, n, message = compare(spark, connect(SF), name, SF)
    assert ok, message


def test_entry_and_registry(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
