"""Registered queries at the smallest scale against their SQL. ``python tests/oracle.py DIR`` runs all at any scale."""

import pytest
from conftest import SF
from oracle import compare, duck

from tickloom.plans.registry import all_queries, all_sql

NAMES = ["flagship_bars_features", "c4_time_interpolation", "j1_asof_backward", "q2_quarantine", "w5_ema", "w7_macd", "a3_exact_quantiles", "i7_phase",
         "g8_pnl_pipeline", "x11_walk_book", "r6_tail_risk", "d7_ks_statistic", "t1_stream_bars", "f5_stream_materialise", "k1_sessions", "p8_symbol_normalize",
         "t2_source_watermark", "t3_backlog_counts", "t5_backlog_release", "t6_lag_summary", "t10_online_arbitrage", "t11_offsets", "t13_retry_routes", "t14_live_book", "t14_book_events", "x15_order_states",
         "x18_arbitrage", "d6_psi", "d8_drift_summary", "d12_budget_alerts", "d13_slo_alerts", "c9_normalize_ohlcv_interpolate", "c9_inferred_cadence", "g2_kuramoto_strategy", "g16_ridge_folds", "s17_envelopes"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    got = all_queries()[name](spark, SF).toPandas()
    assert compare(got, duck(SF).execute(all_sql()[name]).df(), tol=1.1e-6) is None


def test_every_sql_has_a_query():
    assert set(all_sql()) <= set(all_queries()) and len(all_queries()) > 200


def test_partition_filters_reach_the_scan(spark):
    plan = all_queries()["s7_partition_pruning"](spark, SF)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
