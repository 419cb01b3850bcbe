"""Inputs beyond limits that operators must not have: long chains, many contenders, tiny noise, large levels."""

import random
import time

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from tidemark.operators import graph, labels, orderflow
from tidemark.operators import performance as perf
from tidemark.operators import recurrences as rec
from tidemark.operators import regime as reg
from tidemark.operators import relational as rel
from tidemark.operators.grouped import Sweep, sequential
from tidemark.plans import join_plans
from tidemark.plans.registry import Tables


def test_lineage_of_a_long_chain(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(200)], "id long, parent_id long")
    got = graph.lineage_of(nodes, 150).orderBy("depth").collect()
    assert [(r["id"], r["depth"]) for r in got] == [(150 - d, d) for d in range(151)]
    assert graph.lineage_of(nodes, 999).collect() == []
    ring = spark.createDataFrame([(i, (i + 1) % 5) for i in range(5)], "id long, parent_id long")
    with pytest.raises(ValueError):
        graph.lineage_of(ring, 2)


@pytest.mark.parametrize("q, r", [(1e-8, 1.0), (0.01, 0.1), (0.0, 1.0), (5.0, 0.2)])
def test_kalman_gains_at_any_step(spark, q, r):
    p, want, steps = 1.0, {}, {1, 2, 10, 1000, 5000, 90_000}
    for n in range(1, 90_001):
        k = (p + q) / (p + q + r)
        if n in steps:
            want[n] = k
        p = (1 - k) * (p + q)
    df = spark.createDataFrame([(n,) for n in sorted(steps)], "n long")
    got = {x["n"]: x["k"] for x in df.select("n", rec.kalman_gain(F.col("n"), q, r).alias("k")).collect()}
    assert got == pytest.approx(want, rel=1e-7)


def test_small_variance_on_a_large_level(spark):
    rng = np.random.default_rng(1)
    x = 60_000 + rng.normal(0, 0.001, 500)
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "k string, t long, x double")
    mean, var, want = x[0], 0.0, []
    for v in x:
        d = v - mean
        mean, var = mean + 0.1 * d, 0.9 * (var + 0.1 * d * d)
        want.append(var)
    got = [r["e_var"] for r in rec.ew_moments(df, ["k"], ["t"], "x", 50, {"e": 0.1}).orderBy("t").collect()]
    assert got[20:] == pytest.approx(want[20:], rel=1e-4)


def test_only_the_last_volume_bucket_is_incomplete(spark):
    rng = np.random.default_rng(2)
    v = rng.uniform(0, 6e6, 4000).round(7)
    df = spark.createDataFrame([("k", i, float(x), "BUY" if i % 3 else "SELL") for i, x in enumerate(v)], "k string, t long, v double, side string")
    got = orderflow.volume_buckets(df, ["k"], ["t"], "v", "side", 500, bucket_size=1_000_000.0).orderBy("bucket").collect()
    assert [r["bucket"] for r in got] == list(range(len(got))) and sum(v) > 1e9
    assert [r["complete"] for r in got] == [True] * (len(got) - 1) + [False]
    assert all(r["buy"] + r["sell"] == pytest.approx(1_000_000.0, abs=1e-6) for r in got[:-1])


def test_contenders_come_from_the_data(spark):
    rnd = random.Random(4)
    names = [f"c{i}" for i in range(9)]
    rows = [(n, w, rnd.random(), rnd.uniform(-0.1, 0.1), rnd.random(), 1) for n in names for w in range(12)]
    df = spark.createDataFrame(rows, "contender string, window_id int, sharpe double, ret double, drawdown double, trade_count int")
    pairs = perf.compare_contenders(df).collect()
    assert {(r["a"], r["b"]) for r in pairs} == {(a, b) for a in names for b in names if a < b} and {r["n"] for r in pairs} == {12}
    series = df.select(F.col("contender").alias("s"), (F.col("window_id") + 1).alias("q"), "ret")
    corr = {(r["a"], r["b"]): r["corr"] for r in perf.correlation_matrix(series, "s", "q", "ret").collect()}
    by = {n: [x[3] for x in rows if x[0] == n] for n in names}
    assert len(corr) == 45 and corr["c2", "c7"] == pytest.approx(np.corrcoef(by["c2"], by["c7"])[0, 1])


def test_every_split_is_scored(spark):
    rng = np.random.default_rng(3)
    n = 460
    x = rng.normal(size=(n, 2))
    rows = [(k, i, n, float(x[i, 0]), float(x[i, 1]), int(x[i, 0] + 0.3 * x[i, 1] > 0)) for k in ("a", "b") for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, pos long, n long, f double, g double, y int")
    roles = labels.split_roles(df, "pos", "n", purge=10)
    got = labels.score_splits(roles, ["symbol"], ["f", "g"], "y", "pos", trees=30).collect()
    assert sorted((r["symbol"], r["split"]) for r in got) == sorted((r["symbol"], r["split"]) for r in roles.select("symbol", "split").distinct().collect())
    assert min(r["accuracy"] for r in got) > 0.75


@pytest.mark.parametrize("together", [1, 4, 32])
def test_splits_that_share_a_group(spark, together):
    rng = np.random.default_rng(9)
    rows = [(k, i, n, float(rng.normal()), float(rng.normal()) if i % 37 else None, int(rng.random() < 0.4)) for k, n in (("a", 523), ("b", 331), ("c", 90)) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, pos long, n long, f double, g double, y int").repartition(3)
    want = labels.score_splits(labels.split_roles(df, "pos", "n", purge=10), ["symbol"], ["f", "g"], "y", "pos", trees=12).collect()
    got = labels.score_walk_forward(df, ["symbol"], "pos", "n", ["f", "g"], "y", purge=10, trees=12, together=together)
    assert sorted(got.collect()) == sorted(want) and len(want) == 17
    assert got.schema == labels.score_splits(labels.split_roles(df, "pos", "n"), ["symbol"], ["f"], "y", "pos").schema


def test_rows_are_not_copied_for_every_split(spark):
    df = spark.range(20_000).selectExpr("id AS pos", "20000L AS n")
    groups = labels.split_groups(df, "pos", "n", 320, 21, F.lit((20_000 - 258) // 21), 32)
    assert 20_000 <= groups.count() < 1.6 * 20_000  # a row for each of its splits: 15 times
    assert groups.groupBy("_group").count().agg(F.max("count")).first()[0] == 31 * 21 + 320


def plain_forest(x, y, at, trees, depth, seed):
    """Node by node, with the draws of a level in the order of its nodes."""
    rng, n, d = np.random.default_rng(seed), *x.shape
    nodes, total = [(b, np.arange(len(at))) for b in rng.integers(0, n, (trees, n))], np.zeros(len(at))
    for left in range(depth, -1, -1):
        after, order = [], rng.random((len(nodes), d)).argsort(axis=1) if left else [[]] * len(nodes)
        for (here, there), features in zip(nodes, order):
            found = []
            for f in sorted(features[: int(d**0.5)]):
                values = np.unique(x[here, f]) if len(there) and 0 < y[here].sum() < len(here) else []
                for a, b in zip(values, values[1:]):
                    sides = [y[here][x[here, f] <= a], y[here][x[here, f] > a]]
                    found.append((sum(s.sum() * (len(s) - s.sum()) / len(s) for s in sides), f, (a + b) / 2))
            if not found:
                total[there] += y[here].mean()
                continue
            _, f, cut = min(found, key=lambda t: t[0])
            after += [(here[x[here, f] <= cut], there[at[there, f] <= cut]), (here[x[here, f] > cut], there[at[there, f] > cut])]
        nodes = after
        if not nodes:
            break
    return total / trees


@pytest.mark.parametrize("seed, digits", [(1, 1), (2, 6)])
def test_forest_grown_by_levels(seed, digits):
    rng = np.random.default_rng(seed)
    x, at = rng.normal(size=(60, 5)).round(digits), rng.normal(size=(9, 5))
    y = (x[:, 0] + rng.normal(size=60) > 0).astype(int)
    assert labels.forest_votes(x, y, at, 12, 4, seed) == pytest.approx(plain_forest(x, y, at, 12, 4, seed), abs=1e-12)
    assert (labels.forest_votes(x, y * 0 + 1, at, 5, 4, seed) == 1).all()


def test_forest_of_a_split_is_quick():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(252, 6))
    y, took = (x[:, 0] + rng.normal(size=252) > 0).astype(int), []
    for _ in range(5):
        began = time.process_time()
        labels.forest_votes(x, y, x[:63], 100, 5, 42)
        took.append(time.process_time() - began)
    assert min(took) < 0.12  # node by node: 0.22 s


def test_spectra_on_every_row(spark):
    df = spark.createDataFrame([("k", i, float(np.sin(i / 2.5))) for i in range(150)], "k string, t long, x double")
    one = reg.spectral_regime(df, ["k"], ["t"], "x", 40, n=64, min_rows=64, rows=60).orderBy("t").collect()
    four = reg.spectral_regime(df, ["k"], ["t"], "x", 40, n=64, min_rows=64, hop=4, rows=60).orderBy("t").collect()
    assert [r["regime"] == "unknown" for r in one] == [True] * 63 + [False] * 87
    assert len(four) == 150 and four[101]["alpha"] == four[99]["alpha"] == pytest.approx(one[99]["alpha"])


def test_seeded_uniforms_have_52_bits(spark):
    u = [r["u"] for r in spark.range(2000).select(rel.hash_uniform(F.col("id").cast("string")).alias("u")).collect()]
    assert len(set(u)) == 2000 and 0.45 < np.mean(u) < 0.55 and any((x * 2**40) % 1 for x in u)


def test_correlations_of_strategies_found_in_the_data(spark):
    rng, names = np.random.default_rng(4), [f"{k}-S" for k in range(1, 7)]
    x = rng.normal(size=(40, 6)) * 0.05
    rows = [(d, s, float(x[d, k])) for d in range(40) for k, s in enumerate(names)]
    df = spark.createDataFrame(rows, "day long, strategy string, ret double")
    known = spark.createDataFrame([(s,) for s in [*names, "7-NONE", names[0]]], "strategy string")
    got = {(r["a"], r["b"]): r["corr"] for r in rec.ema_correlations(df, "strategy", "day", "ret", known, 10).collect()}
    x = np.hstack([x, np.zeros((40, 1))])
    mean, cov = x[0].copy(), np.zeros((7, 7))
    for row in x[1:]:
        mean = 0.99 * mean + 0.01 * row
        cov = 0.99 * cov + 0.01 * np.outer(row - mean, row - mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
    names.append("7-NONE")
    want = {(names[i], names[j]): 1.0 if i == j else 0.9 * cov[i, j] / max(sd[i] * sd[j], 1e-6) for i in range(7) for j in range(i, 7)}
    assert got == pytest.approx(want, abs=1e-9)


class Partition(Sweep):
    """Where a key is worked on."""

    def push(self, rows):
        return {"p": [TaskContext.get().partitionId()]}


def test_python_work_keeps_its_partitions(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 20)
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        got = sequential(df, ["k"], ["id"], Partition, "p int, k long")
        assert len({r["p"] for r in got.collect()}) > 4 and got.rdd.getNumPartitions() == 11
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_pairs_are_told_apart_in_tasks_of_bounded_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(join_plans, "PAIRS", 500)
    t = Tables(spark, sf_dir)
    dealt = join_plans._uses(t, "l_partkey", "l_orderkey")
    assert dealt.rdd.getNumPartitions() == t.lineitem.count() // 500 + 1
