"""Readers, catalog round trips, and streaming forms equal to the batch forms."""

import json
import os

from pyspark.sql import functions as F

from tidemark.operators import regime as reg
from tidemark.plans.streaming_plans import drain, replay
from tidemark.plans.registry import Tables
from tidemark.sources import catalog as cat
from tidemark.sources import market_files as mf
from tidemark.sources import messages
from tidemark.streaming import stateful as st


def test_csv_with_and_without_header(spark, tmp_path):
    body = "1700000000000,1,2,0.5,1.5,10,0,0,0,0,0,0\n1700000060000,1,bad,0.5,1.5,10,0,0,0,0,0,0\n"
    (tmp_path / "a.csv").write_text(body)
    (tmp_path / "b.csv").write_text(",".join(mf.KLINES) + "\n" + body)
    out = mf.read_klines_csv(spark, str(tmp_path)).collect()
    assert len(out) == 4 and sum(r["high"] is None for r in out) == 2 and {r["close"] for r in out} == {1.5}


def test_aggtrades_drop_incomplete(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1,10,1,1,1,1700000000000,True\n2,oops,1,1,1,1700000000001,false\n3,11,1,1,1,,true\n")
    out = mf.read_aggtrades_csv(spark, str(tmp_path)).collect()
    assert [(r["trade_id"], r["buyer_maker"]) for r in out] == [("1", True)]
    assert mf.read_aggtrades_csv(spark, str(tmp_path), drop_incomplete=False).count() == 3


def test_file_discovery_and_manifest(spark, tmp_path):
    for d in ("2024-01-01", "2024-01-02", "2024-02-01", "latest"):
        (tmp_path / f"BTC-aggTrades-{d}.csv").write_text("1,1,1,1,1,1700000000000,true\n")
    files = mf.discover_files(spark, str(tmp_path), start="2024-01-02", end="2024-01-31")
    names = sorted(os.path.basename(r["path"]) for r in files.collect())
    assert names == ["BTC-aggTrades-2024-01-02.csv", "BTC-aggTrades-latest.csv"]
    done = files.where("day is not null")
    assert [os.path.basename(r["path"]) for r in mf.pending_files(files, done).collect()] == ["BTC-aggTrades-latest.csv"]
    assert mf.pending_files(files, None).count() == 2


def test_catalog_round_trip_and_pruning(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = [("2024-01-0%d 12:00:00" % d, s, "V", float(d)) for d in (1, 2, 3) for s in ("A", "AB")]
    df = spark.createDataFrame(rows, "timestamp string, symbol string, venue string, x double").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    cat.write_catalog(df, path)
    cat.write_catalog(df.limit(0), path)
    got = cat.read_catalog(spark, path, "A", "V", "2024-01-02 00:00:00", "2024-01-03 12:00:00")
    assert sorted(r["x"] for r in got.collect()) == [2.0, 3.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "dt#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert cat.last_timestamps(cat.read_catalog(spark, path)).count() == 2


def test_jsonl_compaction_and_retention(spark, tmp_path):
    day = 86_400_000_000_000
    lines = [json.dumps({"ts_event": 19723 * day + i * day, "event_type": "x"}) for i in range(5)]
    (tmp_path / "log.jsonl").write_text("\n".join([lines[0], "", "{broken", *lines[1:]]) + "\n")
    out = str(tmp_path / "cold")
    cat.compact_jsonl(spark, str(tmp_path / "log.jsonl"), out, "ts_event long, event_type string")
    assert spark.read.parquet(out).count() == 5
    assert cat.drop_expired(spark, out, "2024-01-05", 2) == ["2024-01-01", "2024-01-02"]
    back = spark.read.parquet(out)
    assert back.count() == 3 and cat.live_partitions(back, "2024-01-05", 2).count() == 3
    assert {r["rows"] for r in cat.partition_stats(back).collect()} == {1}


def test_upsert_keeps_unlisted_columns(spark):
    cur = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k long, n string, v double")
    upd = spark.createDataFrame([(2, "z", None), (3, "c", 3.0)], "k long, n string, v double")
    out = {r["k"]: (r["n"], r["v"]) for r in cat.upsert_columns(cur, upd, ["k"], ["v"]).collect()}
    assert out == {1: ("a", 1.0), 2: ("b", None), 3: ("c", 3.0)}


def test_liquidation_messages(spark):
    raw = [
        '{"e":"forceOrder","E":5,"o":{"s":"BTCUSDT","S":"SELL","q":"2","p":"9","ap":"10","T":1000}}',
        '{"e":"forceOrder","E":5,"o":{"s":"ETHUSDT","S":"BUY","q":"2","p":"9"}}',
        '{"topic":"liquidation.ETHUSDT","ts":7,"data":{"symbol":"ETHUSDT","side":"Buy","size":"1","price":"3"}}',
        '{"channel":"trades","data":[{"coin":"S","side":"A","px":"0","sz":"1","time":1,"liquidation":true},{"coin":"S","side":"B","px":"4","sz":"1","time":2000,"liquidation":true}]}',
        "not json",
        '{"topic":"other"}',
    ]
    out = messages.normalize_liquidations(spark.createDataFrame([(r,) for r in raw], "raw string"), symbols=["BTC-USDT"])
    got = {(r["venue"], r["symbol"], r["side"], r["value"], int(r["timestamp"].timestamp() * 1000)) for r in out.collect()}
    assert {g[:4] for g in got} == {("BINANCE", "BTCUSDT-PERP", "LONG", 20.0), ("BYBIT", "ETHUSDT-PERP", "SHORT", 3.0), ("HYPERLIQUID", "SUSDT-PERP", "SHORT", 4.0)}


def test_stream_change_points_equal_batch(spark, sf_dir):
    t = Tables(spark, sf_dir)
    src = t.ticks.select("symbol", "event_id", "us", "price", "ts")
    params = dict(hazard=0.01, mu0=50.0, beta0=500.0)
    batch = reg.change_points(src, ["symbol"], ["us", "event_id"], "price", ["event_id"], **params)
    s = replay(t, src, "ts")
    schema = st.schema_of(s, ["symbol"], ["event_id"], "cp_prob double, run_length long, changepoint boolean")
    live = drain(t, st.run_stateful(s.drop("ts"), ["symbol"], ["us", "event_id"], lambda: reg._ChangeSweep(["event_id"], "price", params), schema))
    cols = ["event_id", "cp_prob", "run_length", "changepoint"]
    assert sorted(map(tuple, batch.select(cols).collect())) == sorted(map(tuple, live.select(cols).collect()))
