"""Blocks from row counts: bounded whatever the spread of rows over time, and the same results as one window."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.blocks import BLK, RowBlocks, running, with_block
from tidemark.operators.scan import affine_scan


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(6)
    rows = [("hot", int(rnd.expovariate(1 / 40)), i, rnd.random()) for i in range(3000)] + [("cold", i * 1000, 3000 + i, 1.0) for i in range(5)]
    return spark.createDataFrame(rows, "k string, t long, id long, x double")


def test_one_day_of_one_key_is_cut_evenly(skewed):
    blocks = with_block(skewed, ["k"], ["t", "id"], RowBlocks(rows=100, grain=1))
    cell = skewed.groupBy("k", "t").count().agg(F.max("count")).first()[0]
    sizes = {(r["k"], r[BLK]): r["count"] for r in blocks.groupBy("k", BLK).count().collect()}
    assert max(sizes.values()) <= 100 + cell and len(sizes) >= 3000 / (100 + cell)
    w = Window.partitionBy("k").orderBy("t", "id")
    assert blocks.withColumn("p", F.lag(BLK).over(w)).where(F.col("p") > F.col(BLK)).count() == 0


@pytest.mark.parametrize("rows", [1, 37, 100_000])
def test_running_and_scan_agree_with_a_window(skewed, rows):
    blocks = RowBlocks(rows=rows, grain=1)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r["id"]: (r["s"], r["n"]) for r in skewed.select("id", F.sum("x").over(w).alias("s"), F.count("*").over(w).alias("n")).collect()}
    got = running(skewed, ["k"], ["t", "id"], blocks, {"s": ("sum", F.col("x")), "n": ("count", F.lit(1))})
    assert {r["id"]: r["n"] for r in got.collect()} == {i: n for i, (_, n) in want.items()}
    total = affine_scan(skewed, ["k"], ["t", "id"], blocks, {"y": (F.lit(1.0), F.col("x"), F.col("x"))})
    assert {r["id"]: r["y"] for r in total.collect()} == pytest.approx({i: s for i, (s, _) in want.items()})


def test_no_keys_and_empty(skewed):
    got = running(skewed, [], ["t", "id"], RowBlocks(rows=50, grain=10), {"n": ("count", F.lit(1))})
    assert sorted(r["n"] for r in got.collect()) == list(range(1, 3006))
    assert running(skewed.limit(0), ["k"], ["t", "id"], RowBlocks(), {"n": ("count", F.lit(1))}).collect() == []
