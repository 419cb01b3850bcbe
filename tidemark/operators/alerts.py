"""Alert rules evaluated over metric series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from .blocks import running

# Fixed values: (rule, metric, comparison, threshold, seconds the breach must last, severity, no-data state).
RULES = (
    ("Daemon Down", "daemon_metric_count_2m", "lt", 1, 120, "critical", "Alerting"),
    ("Daemon High Memory Usage", "daemon_memory_mb", "gt", 800, 300, "warning", "OK"),
    ("Daemon Critical Memory Usage", "daemon_memory_mb", "gt", 1200, 120, "critical", "OK"),
    ("Daemon High Error Rate", "daemon_errors_5m", "gt", 25, 300, "warning", "OK"),
    ("Exchange Disconnected", "exchange_connected", "lt", 1, 30, "critical", "Alerting"),
    ("Exchange High Latency", "exchange_latency_ms", "gt", 300, 300, "warning", "OK"),
    ("Exchange Frequent Reconnections", "exchange_reconnects_1h", "gt", 5, 0, "warning", "OK"),
    ("Exchange Stale Data", "exchange_staleness_seconds", "gt", 60, 60, "warning", "OK"),
    ("Pipeline Data Gap Detected", "pipeline_gap_count", "gt", 0, 0, "warning", "OK"),
    ("Pipeline Large Data Gap", "pipeline_max_gap_seconds", "gt", 300, 60, "critical", "OK"),
    ("Pipeline Low Throughput", "pipeline_records_10m", "lt", 1, 600, "warning", "Alerting"),
    ("Pipeline High Latency", "pipeline_latency_ms", "gt", 500, 300, "warning", "OK"),
    ("Agent High Error Rate", "agent_errors_1h", "gt", 10, 300, "warning", "OK"),
    ("Hook High Latency", "hook_latency_ms", "gt", 500, 600, "warning", "OK"),
    ("Agent Low Success Rate", "agent_success_pct", "lt", 80, 900, "warning", "OK"),
    ("Daily Cost Spike", "daily_cost", "gt", 50, 0, "critical", "OK"),
    ("Tool High Failure Rate", "tool_failure_pct", "gt", 20, 600, "warning", "OK"),
    ("Container Down", "container_up", "lt", 1, 120, "critical", "Alerting"),
    ("Container High CPU Usage", "container_cpu_pct", "gt", 80, 300, "warning", "OK"),
    ("Container High Memory Usage", "container_memory_gb", "gt", 2, 300, "warning", "OK"),
    ("Scrape Target Down", "targets_down", "gt", 0, 60, "critical", "OK"),
    ("Slow Scrape", "slow_scrapes", "gt", 0, 300, "warning", "OK"),
    ("System CPU High", "system_cpu_pct", "gt", 90, 300, "critical", "OK"),
    ("System Memory High", "system_memory_pct", "gt", 90, 300, "critical", "OK"),
    ("System Disk Space Low", "system_disk_pct", "gt", 85, 300, "warning", "OK"),
    ("System Disk Space Critical", "system_disk_pct", "gt", 95, 120, "critical", "OK"),
    ("Brute Force Attack Detected", "failed_logins", "gt", 10, 0, "critical", "OK"),
    ("Suspicious IP Activity", "blocked_ips", "gt", 3, 0, "high", "OK"),
    ("Daily Loss Limit Breach", "daily_pnl_pct", "lt", -3, 0, "critical", "OK"),
    ("Position Size Limit Breach", "position_size_pct", "gt", 10, 0, "high", "OK"),
    ("Leverage Limit Breach", "leverage", "gt", 3, 0, "high", "OK"),
    ("Trading Automatically Halted", "trading_halted", "gt", 0, 0, "critical", "OK"),
    ("Drawdown Warning (10%)", "drawdown_pct", "gt", 10, 0, "warning", "OK"),
    ("Kill Switch Drawdown (15%)", "drawdown_pct", "gt", 15, 0, "critical", "OK"),
    ("High Order Rejection Rate", "order_rejection_pct", "gt", 20, 300, "medium", "OK"),
    ("Unusual Order Volume", "orders_1h", "gt", 500, 0, "medium", "OK"),
    ("Model Invalid Signature", "invalid_signatures", "gt", 0, 0, "critical", "OK"),
    ("Model Load Failures", "model_load_failures", "gt", 3, 300, "high", "OK"),
    ("API Rate Limit Exceeded", "rate_limited", "gt", 10, 0, "medium", "OK"),
    ("API Error Rate Spike", "api_error_pct", "gt", 10, 120, "high", "OK"),
    ("Non-Whitelisted Withdrawal Attempt", "non_whitelisted", "gt", 0, 0, "critical", "OK"),
    ("Large Withdrawal Requested", "max_withdrawal", "gt", 10000, 0, "high", "OK"),
    ("Drawdown Warning", "max_drawdown_pct_5m", "gt", 5, 120, "warning", "OK"),
    ("Drawdown Critical", "max_drawdown_pct_5m", "gt", 10, 60, "critical", "OK"),
    ("Error Rate Warning", "error_rate_pct", "gt", 1, 300, "warning", "OK"),
    ("Position Size Critical", "max_position_pct", "gt", 10, 0, "critical", "OK"),
    ("Connection Lost", "connection_up", "lt", 1, 0, "critical", "Alerting"),
    ("Reconciliation Not Complete", "reconciliation_status", "lt", 1, 300, "critical", "OK"),
    ("Position Discrepancies Detected", "position_discrepancies", "gt", 0, 60, "warning", "OK"),
    ("High In-Flight Order Count", "inflight_orders", "gt", 10, 120, "warning", "OK"),
    ("Reconciliation Duration Too Long", "reconciliation_duration_seconds", "gt", 30, 60, "warning", "OK"),
    ("External Orders Detected", "external_orders_increase_5m", "gt", 0, 0, "info", "OK"),
    ("Fill Reconciliation Failures", "fills_missed_rate_5m", "gt", 0, 60, "critical", "OK"),
    ("CRITICAL: Drawdown > 10%", "last_drawdown_pct", "gt", 10, 60, "critical", "OK"),
    ("WARNING: Drawdown > 5%", "last_drawdown_pct", "gt", 5, 120, "warning", "OK"),
    ("High Error Rate", "errors_10m", "gt", 0, 60, "warning", "OK"),
    ("System Component Down", "components_down", "gt", 0, 60, "critical", "Alerting"),
    ("Position Size Warning", "position_exposure_pct", "gt", 10, 30, "warning", "OK"),
    ("CRITICAL: Daily Loss Limit", "last_daily_pnl_pct", "lt", -2, 30, "critical", "OK"),
)
RULE_SCHEMA = "rule string, metric string, op string, threshold double, for_seconds long, severity string, no_data string"


def rule_table(spark: SparkSession, rules: Sequence[tuple] = RULES) -> DataFrame:
    return spark.createDataFrame([(r[0], r[1], r[2], float(r[3]), int(r[4]), r[5], r[6]) for r in rules], RULE_SCHEMA)


def evaluate_rules(series: DataFrame, rules: DataFrame, labels: Sequence[str], us: str, block, metric: str = "metric", value: str = "value") -> DataFrame:
    """State of every rule at every point of its metric: ok, pending or firing.

    ``series`` is long: (metric, labels, time in microseconds, value); a null value is missing data and
    breaches when the rule's no-data state is Alerting. A breach fires once it has lasted the rule's
    duration. The rules table is small by construction and joined by metric name.
    """
    j = series.join(rules, metric)
    v = F.col(value)
    breach = F.when(v.isNull(), F.col("no_data") == "Alerting").when(F.col("op") == "gt", v > F.col("threshold")).otherwise(v < F.col("threshold"))
    keys = ["rule", *labels]
    out = running(j.withColumn("breach", breach), keys, [us], block, {"_was": ("lag", F.col("breach"))})
    out = checkpointed(out)
    start = F.when(F.col("breach") & ~F.coalesce("_was", F.lit(False)), F.col(us))
    out = running(out, keys, [us], block, {"_since": ("last", start)})
    lasted = F.when(F.col("breach"), F.col(us) - F.col("_since"))
    state = F.when(~F.col("breach"), "ok").when(lasted >= F.col("for_seconds") * 1_000_000, "firing").otherwise("pending")
    return out.withColumn("state", state).drop("_was", "_since")


def firing_intervals(states: DataFrame, labels: Sequence[str], us: str, block) -> DataFrame:
    """First and last firing point of every uninterrupted firing stretch."""
    keys = ["rule", "severity", *labels]
    on = F.col("state") == "firing"
    prev = running(states.withColumn("_on", on), keys, [us], block, {"_was": ("lag", F.col("_on"))})
    starts = F.when(F.col("_on") & ~F.coalesce("_was", F.lit(False)), 1).otherwise(0)
    isl = running(checkpointed(prev), keys, [us], block, {"_isl": ("sum", starts)})
    return isl.where("_on").groupBy(*keys, "_isl").agg(F.min(us).alias("start_us"), F.max(us).alias("end_us"), F.count("*").alias("n_points")).drop("_isl")
