"""A cross-section of the registered queries against their SQL, and plan rules for all areas.

``python -m tests.oracle --sf 0.01`` runs every query.
"""

import re

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SAMPLE = [
    "flagship_hourly_bars", "ts_02_sample_by_from_first", "ts_07_value_bars", "ts_11_asof_align", "win_02_counter_delta_by_key", "win_06_rolling_std_population",
    "aff_03_ew_mean_variance", "aff_12_blended_weights", "of_05_vpin", "ml_02_barrier_events", "ml_06_purged_split_roles", "stat_09_contender_metrics", "stat_15_net_sharpe",
    "risk_07_loss_halt", "risk_10_pid_multiplier", "agg_05_exact_percentiles", "agg_12_confidence_vote_by_user", "rel_06_incident_windows", "rel_08_elite_cut", "join_04_position_reconciliation",
    "join_08_lineage_roots", "reg_06_rolling_entropy", "sec_05_abuse_alerts", "sec_09_alert_states", "txt_06_state_as_of", "ing_09_upsert_columns", "str_05_stateful_ema",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    cur = connect(sf_dir).execute(entry.oracle_sql()[name])
    assert compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall()) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["win_05_rolling_std_sample", "aff_01_ema_hot_key", "of_01_tick_rule", "rel_06_incident_windows", "rel_14_exposure", "risk_06_pre_trade_audit", "join_09_attach_windows", "sec_03_order_stuffing", "agg_14_quartile_buckets"])
def test_no_cross_joins_and_no_whole_key_windows(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # a window either is cut by a block column or runs over block summaries, which it orders by block
    for parts, order in re.findall(r"Window \[.*?\], \[(.*?)\], \[(.*?)\]", plan):
        assert "_blk" in parts or "_rb" in parts or order.startswith(("_blk", "_cell"))


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = entry.queries()["join_01_inner"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,300000.0)" in plan
    assert not re.search(r"ReadSchema: struct<[^>]*l_extendedprice", plan)
