"""Hidden regimes in blocks against EM over a whole key in one pass."""

import numpy as np
import pytest

from tidemark.operators import hidden as hd


def em(x, k, iters, seed):
    """(log likelihood, means, state probabilities) row by row."""
    n, d = x.shape
    cuts = np.array_split(np.argsort(x[:, -1], kind="stable"), k)
    mean = np.array([x[c].mean(0) for c in cuts]) + (np.random.default_rng(seed).normal(0, 0.1, (k, d)) if seed else 0)
    var, start, trans = np.ones((k, d)), np.full(k, 1 / k), np.full((k, k), 0.1 / (k - 1))
    np.fill_diagonal(trans, 0.9)
    last = -np.inf
    for _ in range(iters):
        b = np.exp(-0.5 * ((x[:, None] - mean) ** 2 / var + np.log(2 * np.pi * var)).sum(2))
        alpha, beta, c = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
        for t in range(n):
            a = (start if t == 0 else alpha[t - 1] @ trans) * b[t]
            c[t] = a.sum()
            alpha[t] = a / c[t]
        for t in range(n - 2, -1, -1):
            beta[t] = trans @ (b[t + 1] * beta[t + 1]) / c[t + 1]
        gamma = alpha * beta / (alpha * beta).sum(1, keepdims=True)
        xi = sum(np.outer(alpha[t - 1], b[t] * beta[t]) * trans / c[t] for t in range(1, n)) + 1e-6
        start, trans = gamma[0], xi / xi.sum(1, keepdims=True)
        w = gamma.sum(0)[:, None]
        mean = gamma.T @ x / w
        var = np.maximum(gamma.T @ (x * x) / w - mean**2, 1e-3)
        score = np.log(c).sum()
        if score - last < 1e-4:
            break
        last = score
    return score, mean, gamma


def plain(rows, k, inits, iters):
    raw = np.array(rows)
    mu, sd = raw.mean(0), raw.std(0)
    _, mean, gamma = max((em((raw - mu) / sd, k, iters, s) for s in range(inits)), key=lambda r: r[0])
    names = np.array(hd.name_states(mean[:, 0] * sd[0] + mu[0], mean[:, 1] * sd[1] + mu[1]))
    return names[gamma.argmax(1)], gamma.max(1)


def series(seed, n):
    rng = np.random.default_rng(seed)
    state = np.repeat(rng.integers(0, 3, 1 + n // 20), 20)[:n]
    ret = rng.normal(np.array([0.02, -0.02, 0.0])[state], np.array([0.01, 0.01, 0.1])[state])
    return list(zip(ret.tolist(), (np.abs(ret) + rng.random(n) * 0.01).tolist()))


@pytest.mark.parametrize("rows", [50, 1000])
def test_blocks_equal_one_pass(spark, rows):
    data = {"a": series(1, 260), "b": series(2, 173), "short": series(3, 30)}
    df = spark.createDataFrame([(k, t, 2**60 + t, *x) for k, xs in data.items() for t, x in enumerate(xs)], "k string, t long, id long, r double, v double").repartition(5)
    got = hd.hidden_regimes(df, ["k"], ["t"], "r", "v", ["t", "id"], 100, inits=3, iters=12, rows=rows).orderBy("k", "t").collect()
    assert [(r["k"], r["id"] - 2**60) for r in got] == [(k, t) for k in data for t in range(len(data[k]))]
    for key in ("a", "b"):
        names, sure = plain(data[key], 3, 3, 12)
        mine = [r for r in got if r["k"] == key]
        assert [r["regime"] for r in mine] == names.tolist()
        assert np.abs(np.array([r["confidence"] for r in mine]) - sure).max() < 1e-6
    assert {(r["regime"], r["confidence"]) for r in got if r["k"] == "short"} == {("UNKNOWN", 0.0)}


@pytest.mark.parametrize("n, first", [(1, True), (2, False), (17, True), (100, False)])
def test_a_block_against_row_by_row(n, first):
    rng = np.random.default_rng(n)
    x, params = rng.normal(size=(n, 2)), hd.Params.first(np.array([[0, -1.0], [0, 0], [0, 1.0]]), 4)
    params.var = rng.uniform(0.1, 2, params.var.shape)
    entering, leaving = rng.dirichlet(np.ones(3), 4), rng.dirichlet(np.ones(3), 4)
    block = hd.Block(x.ravel(), params, first)
    gamma, xi = block.posterior(entering, leaving)
    rows, sums = block.by_row(gamma), block.sums(gamma)
    for s in range(4):
        b = np.exp(-0.5 * ((x[:, None] - params.mean[s]) ** 2 / params.var[s] + np.log(2 * np.pi * params.var[s])).sum(2))
        ops = params.trans[s] * b[:, None]
        if first:
            ops[0] = np.diag(b[0])
        heads, tails = [entering[s]], [leaving[s]]
        for op in ops:
            heads.append(heads[-1] @ op)
        for op in ops[::-1]:
            tails.append(op @ tails[-1])
        tails = tails[::-1]
        want = np.array(heads[1:]) * np.array(tails[1:])
        want /= want.sum(1, keepdims=True)
        pairs = [h[:, None] * op * t for h, op, t in zip(heads, ops, tails[1:])]
        assert np.allclose(rows[:, s], want) and np.allclose(xi[s], sum(p / p.sum() for p in pairs[int(first) :]) if n > first else 0)
        assert np.allclose(sums[s], want.T @ np.concatenate([np.ones((n, 1)), x, x * x], axis=1))


@pytest.mark.parametrize("halo, ways", [(512, 1), (8, 5)])
def test_rows_around_a_block_stand_for_its_key(spark, monkeypatch, halo, ways):
    """Vectors around blocks are gathered by key for the last posterior only, unless the rows around a block are too few."""
    monkeypatch.setattr(hd, "HALO", halo)
    data, asked, around = {"a": series(5, 1500), "b": series(6, 830)}, [], hd.Fit.around  # the last block of b has 30 rows
    monkeypatch.setattr(hd.Fit, "around", lambda self, params: asked.append(1) or around(self, params))
    df = spark.createDataFrame([(k, t, *x) for k, xs in data.items() for t, x in enumerate(xs)], "k string, t long, r double, v double")
    got = hd.hidden_regimes(df, ["k"], ["t"], "r", "v", ["t"], 1000, inits=2, iters=4, rows=400).orderBy("k", "t").collect()
    assert len(asked) == ways
    for key, xs in data.items():
        names, sure = plain(xs, 3, 2, 4)
        mine = [r for r in got if r["k"] == key]
        assert [r["regime"] for r in mine] == names.tolist()
        assert np.abs(np.array([r["confidence"] for r in mine]) - sure).max() < 1e-6
