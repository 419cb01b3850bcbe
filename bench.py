"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is forced completely (noop sink) and timed once after a short warm-up. ``records_per_sec``
gives the CSV-to-catalog and scan throughputs that the reference quotes.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tidemark import plans  # noqa: E402
from tidemark.session import build_session, scratch_path  # noqa: E402
from tidemark.sources import catalog, market_files  # noqa: E402

HEADLINE = [
    "flagship_hourly_bars",
    "ts_01_sample_by_1h",
    "ts_03_sample_by_fill_null",
    "ts_04_latest_by",
    "ts_06_ohlcv_1m",
    "ts_07_volume_bars",
    "win_03_moving_average_11",
    "win_05_rolling_std_sample",
    "aff_01_ema",
    "aff_05_variance_regime",
    "aff_09_hawkes",
    "of_05_vpin",
    "of_06_flow_state",
    "ml_01_triple_barrier",
    "ml_04_meta_features",
    "reg_01_change_points",
    "stat_02_moments",
    "stat_09_pairwise_comparison",
    "stat_15_transaction_cost",
    "risk_04_circuit_breaker",
    "risk_06_pre_trade_audit",
    "agg_05_exact_percentiles",
    "join_04_position_reconciliation",
    "join_07_citation_chain",
    "rel_04_audit_time_range",
    "sec_05_abuse_alerts",
    "sec_06_hash_chain_verify",
    "txt_01_cosine_top_k",
    "txt_09_formula_extraction",
    "str_02_tumbling_windows",
]


def force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    force(plans.QUERIES["ts_01_sample_by_1d"](spark, sf_dir))
    force(plans.QUERIES["aff_02_high_pass"](spark, sf_dir))
    times, rates, failed = {}, {}, {}
    for name in HEADLINE:
        t0 = time.time()
        try:
            force(plans.QUERIES[name](spark, sf_dir))
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e)[:200]
    # CSV -> typed, partitioned Parquet
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    src, dst = scratch_path(spark, "bench-csv"), scratch_path(spark, "bench-catalog")
    ms = F.unix_millis(F.col("l_shipdate").cast("timestamp")) + F.col("l_orderkey") % 86_400_000
    items.select("l_orderkey", "l_extendedprice", "l_quantity", F.lit(0), ms, F.col("l_linenumber") % 2 == 0).write.csv(src)
    n = items.count()
    t0 = time.time()
    trades = market_files.read_trades_csv(spark, src)
    trades.write.parquet(dst)
    times["csv_to_parquet"] = round(time.time() - t0, 3)
    rates["csv_to_parquet"] = round(n / times["csv_to_parquet"])
    t0 = time.time()
    month = spark.read.parquet(dst).withColumns({"symbol": F.lit("X"), "venue": F.lit("V")}).where("timestamp between timestamp'1997-01-01' and timestamp'1997-01-31'")
    cat = scratch_path(spark, "bench-month")
    catalog.write_catalog(month, cat)
    times["catalog_write_month"] = round(time.time() - t0, 3)
    t0 = time.time()
    force(catalog.read_catalog(spark, cat, "X", "V", "1997-01-10", "1997-01-20").orderBy("timestamp"))
    times["catalog_read_range"] = round(time.time() - t0, 3)
    out = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "records_per_sec": rates,
        "lineitem_rows": n,
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
