"""Blocked operators must give what a plain window gives, whatever the block size."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.blocks import running, settle, spread, with_seq
from tidemark.operators.scan import Maps, affine_scan
from tidemark.operators.timeseries import asof_join, latest_by, sample_by

SCHEMA = "k string, t long, id long, x double"


def series(n=400, keys=("a", "b"), seed=1, hot=True):
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rnd.choice([0, 1, 1, 3, 50])
        k = keys[0] if hot and rnd.random() < 0.7 else rnd.choice(keys)
        rows.append((k, t, i, None if rnd.random() < 0.2 else round(rnd.uniform(-5, 5), 3)))
    return rows


@pytest.mark.parametrize("block", [1, 7, 1000, 10**9])
def test_running_equals_plain_window(spark, block):
    df = spark.createDataFrame(series(), SCHEMA)
    w = Window.partitionBy("k").orderBy("t", "id")
    u = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "id",
        F.sum("x").over(u).alias("s"),
        F.max("x").over(u).alias("m"),
        F.min("x").over(u).alias("n"),
        F.last("x", True).over(u).alias("l"),
        F.lag("x").over(w).alias("p"),
        F.lead("x").over(w).alias("q"),
        F.first("x").over(u).alias("f"),
        F.row_number().over(w).cast("long").alias("c"),
    )
    x = F.col("x")
    got = running(
        df,
        ["k"],
        ["t", "id"],
        block,
        {"s": ("sum", x), "m": ("max", x), "n": ("min", x), "l": ("last", x), "p": ("lag", x), "q": ("lead", x), "f": ("first", x), "c": ("count", F.lit(1))},
    ).select(want.columns)
    a, b = (sorted(d.collect()) for d in (want, got))
    for r, s in zip(a, b):
        assert r["id"] == s["id"]
        for c in want.columns[1:]:
            assert (r[c] is None and s[c] is None) or r[c] == pytest.approx(s[c]), (c, r, s)


def test_running_without_keys_and_on_empty_input(spark):
    df = spark.createDataFrame(series(50), SCHEMA)
    got = running(df, [], ["t", "id"], 5, {"c": ("count", F.lit(1))}).orderBy("c").collect()
    assert [r["id"] for r in got] == [r["id"] for r in df.orderBy("t", "id").collect()]
    assert running(df.where("false"), ["k"], ["t", "id"], 5, {"c": ("count", F.lit(1))}).count() == 0


@pytest.mark.parametrize("rows", [1, 3, 10_000])
def test_spread_row_frames(spark, rows):
    df = with_seq(spark.createDataFrame(series(120), SCHEMA), ["k"], ["t", "id"], 20)
    w0 = Window.partitionBy("k").orderBy("seq").rowsBetween(-6, 2)
    want = {r["id"]: (r["n"], r["s"]) for r in df.select("id", F.count("*").over(w0).alias("n"), F.sum("x").over(w0).alias("s")).collect()}
    h, w = spread(df, ["k"], "seq", rows, back=6, ahead=2)
    f = w.rowsBetween(-6, 2)
    got = settle(h.withColumns({"n": F.count("*").over(f), "s": F.sum("x").over(f)})).collect()
    assert len(got) == 120
    for r in got:
        n, s = want[r["id"]]
        assert r["n"] == n and (r["s"] == pytest.approx(s) if s is not None else r["s"] is None)


def brute(rows, a, lo=None, hi=None):
    out, state = {}, {}
    for k, t, i, x in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        x = x or 0.0
        y = x if k not in state else a * state[k] + x
        if k in state and lo is not None:
            y = min(max(y, lo), hi)
        state[k] = out[i] = y
    return out


@pytest.mark.parametrize("block", [1, 7, 1000, 10**9])
@pytest.mark.parametrize("bounds", [None, (-2.0, 1.5)])
def test_affine_scan_blocks(spark, block, bounds):
    rows = series(600, seed=3)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.coalesce("x", F.lit(0.0))).repartition(5)
    rec = (F.lit(0.8), F.col("x"), F.col("x"))
    if bounds:
        rec = (*rec, F.lit(bounds[0]), F.lit(bounds[1]))
    got = {r["id"]: r["y"] for r in affine_scan(df, ["k"], ["t", "id"], block, {"y": rec}).collect()}
    want = brute(rows, 0.8, *(bounds or ()))
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-9)


def test_affine_scan_small_arrow_batches(spark):
    """Segments that span many Arrow batches carry their state over."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = series(300, keys=("a",), seed=5)
        df = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.coalesce("x", F.lit(0.0)))
        got = {r["id"]: r["y"] for r in affine_scan(df, ["k"], ["t", "id"], 400, {"y": (F.lit(0.9), F.col("x"), F.col("x"))}).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = brute(rows, 0.9)
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_maps_compose_is_sequential_application():
    rng = np.random.default_rng(0)
    n = 200
    a, b = rng.uniform(0, 1.2, n), rng.normal(size=n)
    lo, hi = np.full(n, -1.0), np.full(n, 1.0)
    start = rng.random(n) < 0.05
    start[0] = True
    m = Maps(a, b, lo, hi).compose(start)
    y = 0.0
    for i in range(n):
        y = 0.3 if start[i] else y
        y = min(max(a[i] * y + b[i], -1.0), 1.0)
        assert m.apply(i, 0.3) == pytest.approx(y)


def test_sample_by_fill_latest_and_asof(spark):
    t = "timestamp'2024-01-01 00:{:02d}:00'"
    df = spark.sql(" union all ".join(f"select '{k}' k, {t.format(m)} ts, {v} v" for k, m, v in (("a", 0, 1), ("a", 12, 2), ("b", 3, 5))))
    filled = sample_by(df, "ts", "5 minutes", [F.sum("v").alias("v")], ["k"], fill=True)
    assert filled.count() == 6 and filled.where("v is null").count() == 3
    assert sample_by(df, "ts", "5 minutes", [F.sum("v").alias("v")], align="first").count() == 2
    assert {(r["k"], r["v"]) for r in latest_by(df, ["k"], ["ts"]).collect()} == {("a", 2), ("b", 5)}
    left = df.select("k", "ts").where("k = 'a'")
    right = df.where("k = 'a' and v = 1")
    assert [r["v"] for r in asof_join(left, right, ["k"], "ts", ["v"], "5 minutes").orderBy("ts").collect()] == [1, 1]
