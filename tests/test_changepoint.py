"""Change points in blocks against the plain run over a whole key."""

import time

import numpy as np
import pytest

from tidemark.operators import changepoint as cp


def plain(xs, **params):
    state = cp.RunLength(**params)
    return [state.update(float(x)) for x in xs]


def blocked(spark, xs, rows, **params):
    df = spark.createDataFrame([("k", t, float(x), 2**60 + t) for t, x in enumerate(xs)], "k string, t long, x double, id long").repartition(7)
    got = cp.change_points(df, ["k"], ["t"], "x", ["t", "id"], block=100, rows=rows, **params).orderBy("t").collect()
    assert [(r["t"], r["id"]) for r in got] == [(t, 2**60 + t) for t in range(len(xs))]
    return [(r["cp_prob"], r["run_length"], r["changepoint"]) for r in got]


def same(got, want):
    assert [g[1:] for g in got] == [w[1:] for w in want]
    assert np.abs(np.array([g[0] for g in got]) - [w[0] for w in want]).max() < 1e-9


def series(seed, n, shifts):
    rng = np.random.default_rng(seed)
    return rng.standard_normal(n) + np.repeat(rng.normal(0, 6, shifts), -(-n // shifts))[:n]


@pytest.mark.parametrize("rows", [37, 100, 350])
def test_blocks_equal_the_whole_key(spark, rows):
    xs = series(1, 700, 5)
    params = {"hazard": 0.01, "max_run": 60}
    same(blocked(spark, xs, rows, **params), plain(xs, **params))


def test_blocks_without_any_change(spark):
    xs = np.random.default_rng(2).standard_normal(500)  # old run lengths are told apart for long
    same(blocked(spark, xs, 90, hazard=0.01, max_run=50), plain(xs, hazard=0.01, max_run=50))


def test_blocks_shorter_than_the_longest_run(spark):
    xs = series(3, 300, 3)
    same(blocked(spark, xs, 20, hazard=0.05, max_run=120), plain(xs, hazard=0.05, max_run=120))


def test_rows_that_nothing_explains(spark):
    xs = series(4, 240, 2)
    xs[[61, 62, 150]] = [1e160, -1e170, 1e200]  # below 1e-300 under every run length: the posterior starts anew
    with np.errstate(over="ignore", invalid="ignore"):
        want = plain(xs, hazard=0.01, max_run=40)
    same(blocked(spark, xs, 50, hazard=0.01, max_run=40), want)


def test_vectors_agree_before_the_block_ends():
    params = {"hazard": 0.05, "max_run": 30}
    fold = cp._Fold("x", params)
    xs = series(5, 4000, 40)
    n = len(xs)
    fold.push({"x": xs, "_home": np.where(np.arange(n) < 30, 0, 1), "_rb": np.ones(n)})
    part = fold.finish()
    assert len(part["scale"][0]) == 31 and len(part["flat"][0]) == 31  # one vector, not 31


def test_rows_at_once_equal_row_by_row():
    xs = series(6, 400, 4)
    params = {"hazard": 0.05, "max_run": 30}
    state = cp.RunLength(**params)
    got = [r for part in (xs[:7], xs[7:150], xs[150:151], xs[151:]) for r in state.updates(part)]
    same(got, plain(xs, **params))


def test_rows_at_once_are_quick():
    """A row of full run lengths took 73 microseconds one by one, and twice that on a busy machine."""
    xs, state, took = series(7, 3000, 3), cp.RunLength(hazard=0.01), []
    state.updates(xs[:600])
    for i in range(600, 3000, 600):
        began = time.process_time()
        state.updates(xs[i : i + 600])
        took.append((time.process_time() - began) / 600)
    assert min(took) < 60e-6
