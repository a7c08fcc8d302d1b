"""Queries next to their check SQL on the smallest tables.

A quick selection by default; CHECK_ALL=1 runs every query that has SQL.
"""

import os

import pytest
from compare import connect, run

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = ["rolling_stats", "wallet_ratios", "contra_asof", "expanding_zscore", "wallet_labels", "infer_resolution", "bucket_graph", "find_jumps",
         "jump_interval_join", "recluster_ticks", "parse_trade_json", "normalize_transfers", "split_by_close_time", "prior_trade_counts",
         "book_asof_join", "orderbook_consumption", "book_states", "timing_heuristic", "random_baseline", "wallet_evaluations", "mann_whitney",
         "stream_dedup", "book_stream", "setting_candidates", "causal_jump_multiplier", "cluster_state_snapshot", "stream_recluster_ticks"]
NAMES = [n for n in entry.queries() if n in entry.oracle_sql()] if os.environ.get("CHECK_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    _, _, error = run(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert error is None, error


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_causal_clusters_tick_by_the_default_clocks(spark):
    from tapescope.config import make_config
    from tapescope.operators import causal
    from tapescope.sources import tables

    got = entry.queries()["causal_cluster_multiplier"](spark, SF).groupBy("market_id").agg({"tick": "max"}).collect()
    assert sum(n for _, n in got) == causal.recluster_ticks(tables.tape(spark, SF), make_config()).count()
