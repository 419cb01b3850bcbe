"""Hand-computed and brute-force cases, including the edges: empty, one row, constant, short, ties."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.functions.stats_expr import norm_cdf, norm_ppf
from tidemark.operators import aggregates as agg
from tidemark.operators import corpus as cp
from tidemark.operators import graph
from tidemark.operators import labels as ml
from tidemark.operators import orderflow as of
from tidemark.operators import performance as perf
from tidemark.operators import recurrences as rec
from tidemark.operators import regime as reg
from tidemark.operators import risk
from tidemark.operators import surveillance as sv
from tidemark.operators import windows as win
from tidemark.streaming.stateful import BreakerSweep


def frame(spark, values, col="p", key="k"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], f"k string, t long, {col} double")


def column(df, name, order="t"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_norm_cdf_matches_erf(spark):
    zs = [-40.0, -8.5, -3.2, -1.0, -0.1, 0.0, 0.5, 2.0, 7.5]
    got = column(spark.createDataFrame([(z,) for z in zs], "z double").withColumn("p", norm_cdf(F.col("z"))), "p", "z")
    for z, p in zip(zs, got):
        assert p == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=1e-14)
    q = spark.createDataFrame([(0.025,), (0.5,), (0.975,)], "p double").withColumn("z", norm_ppf(F.col("p")))
    assert column(q, "z", "p") == pytest.approx([-1.96, 0.0, 1.96], abs=2e-3)


def test_log_return_rejects_non_positive_prices(spark):
    assert column(win.log_return(frame(spark, [1, 2, 4]), ["k"], ["t"], "p", 1, first=0.0), "ret") == pytest.approx([0, math.log(2), math.log(2)])
    with pytest.raises(Exception, match="positive"):
        win.log_return(frame(spark, [1, 0, 4]), ["k"], ["t"], "p", 10).collect()


def test_pivots_ties_disqualify(spark):
    bars = frame(spark, [1, 2, 5, 2, 1, 5, 5, 1, 0], "high").withColumn("low", F.col("high"))
    out = win.pivots(bars, ["k"], ["t"], "high", "low", 100, rows=3)
    assert column(out, "pivot_high") == [False, False, True, False, False, False, False, False, False]


def test_zone_cap_drops_oldest(spark):
    highs = [1, 2, 9, 2, 1, 2, 8, 2, 1, 2, 7, 2, 1, 1]
    bars = frame(spark, highs, "high").withColumns({"low": F.col("high") - 0.1, "volume": F.lit(1.0), "atr": F.lit(0.4)})
    z = win.liquidation_zones(bars, ["k"], ["t"], 100, max_zones=2).where("side = 'above'").orderBy("start_seq").collect()
    assert [(r["start_seq"], r["status"]) for r in z][0] == (3, "dropped")
    assert all(r["bottom"] < r["top"] for r in z)


def test_atr_warm_up_and_short_series(spark):
    bars = frame(spark, [10, 11, 12, 13], "close").withColumns({"high": F.col("close") + 1, "low": F.col("close") - 1})
    assert column(rec.atr(bars, ["k"], ["t"], 2, period=2), "atr") == [None, None, 2.0, 2.0]
    assert column(rec.atr(bars, ["k"], ["t"], 2, period=14), "atr") == [None] * 4


def test_kalman_against_loop(spark):
    z = [random.Random(4).uniform(0, 9) for _ in range(60)]
    x, p, want = z[0], 1.0, [z[0]]
    for v in z[1:]:
        pp = p + 0.01
        k = pp / (pp + 0.1)
        x, p = x + k * (v - x), (1 - k) * pp
        want.append(x)
    assert column(rec.kalman(frame(spark, z), ["k"], ["t"], "p", 7), "kalman") == pytest.approx(want)


def test_tape_speed_ignores_equal_times(spark):
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate([0, 1_000_000, 1_000_000, 3_000_000])], "k string, i long, us long")
    out = rec.tape_speed(df, ["k"], ["us", "i"], F.col("us"), 10_000_000)
    assert column(out, "rate", "i") == pytest.approx([1.0, 1.0, 1.0, 0.1 * 0.5 + 0.9])


def test_tick_rule_zero_ticks(spark):
    out = of.tick_rule(frame(spark, [5, 5, 6, 6, 4, 4]), ["k"], ["t"], "p", 2)
    assert column(out, "side") == ["UNKNOWN", "UNKNOWN", "BUY", "BUY", "SELL", "SELL"]


def test_volume_bucket_overflow(spark):
    df = spark.createDataFrame([("k", 1, 250.0, "BUY"), ("k", 2, 100.0, "SELL"), ("k", 3, 0.0, "SELL"), ("k", 4, 9.0, "UNKNOWN")], "k string, t long, v double, side string")
    b = of.volume_buckets(df, ["k"], ["t"], "v", "side", 1, bucket_size=100.0).orderBy("bucket").collect()
    assert [(r["buy"], r["sell"], r["complete"]) for r in b] == [(100, 0, True), (100, 0, True), (50, 50, True), (0, 50, False)]
    assert column(of.vpin(of.volume_buckets(df, ["k"], ["t"], "v", "side", 1, 100.0), ["k"], 3), "vpin", "bucket") == pytest.approx([0, 0, 2 / 3])


def test_triple_barrier_cases(spark):
    df = frame(spark, [100, 101, 104, 99, 98, 98]).withColumns({"atr": F.lit(2.0), "s": F.when(F.col("t") == 0, -1).when(F.col("t") == 1, 0).otherwise(1)})
    assert column(ml.triple_barrier(df, ["k"], ["t"], 3, price="p", rows=2), "label") == [1, -1, -1, -1, 0, 0]
    assert column(ml.triple_barrier(df, ["k"], ["t"], 3, price="p", signal="s"), "label") == [-1, 0, -1, -1, 0, 0]
    short = ml.barrier_events(df, ["k"], ["t"], 3, price="p", horizon=1)
    assert column(short, "barrier")[0] == "timeout" and column(short, "label")[0] == 1


def test_splits_need_full_first_window(spark):
    n = spark.createDataFrame([(319,), (320,), (400,)], "n long")
    got = {r["n"]: r["c"] for r in ml.walk_forward_splits(n, "n").groupBy("n").agg(F.count("*").alias("c")).collect()}
    want = {}
    for size in (319, 320, 400):
        c = i = 0
        while size >= 320 and i + 257 < size:
            c, i = c + 1, i + 21
        if c:
            want[size] = c
    assert got == want


def test_exact_percentiles_against_numpy(spark):
    rnd = random.Random(2)
    data = [("a" if rnd.random() < 0.8 else "b", float(rnd.choice([1, 1, 1, 2, 3, 50, 51.5, 99]))) for _ in range(300)]
    df = spark.createDataFrame(data, "k string, x double")
    for width in (0.5, 7.0, 1e6):
        for r in agg.exact_percentiles(df, ["k"], "x", {"p50": 0.5, "p99": 0.99}, width).collect():
            xs = [x for k, x in data if k == r["k"]]
            assert r["p50"] == pytest.approx(np.percentile(xs, 50)) and r["p99"] == pytest.approx(np.percentile(xs, 99))


def test_statistics_edges(spark):
    df = spark.createDataFrame([("flat", 0.1)] * 3 + [("one", 0.5)] + [("up", v) for v in (0.1, 0.3)], "s string, r double")
    got = {r["s"]: r["x"] for r in df.groupBy("s").agg(perf.sharpe_agg("r").alias("x")).collect()}
    assert got["flat"] == 0 and got["one"] == 0 and got["up"] == pytest.approx(2 * math.sqrt(252))
    assert {r["psr"] for r in perf.probabilistic_sharpe(df, ["s"], "r").collect()} == {0.5}
    row = spark.range(1).select(
        perf.deflated_sharpe_extreme(F.lit(2.0), F.lit(100)).alias("a"),
        perf.deflated_sharpe_log(F.lit(2.0), F.lit(100)).alias("b"),
        perf.minimum_track_record(F.lit(-1.0), F.lit(0.0), F.lit(3.0)).alias("c"),
        perf.cagr(F.lit(-1.5), F.lit(30)).alias("d"),
        perf.calmar(F.lit(0.1), F.lit(0.0)).alias("e"),
    ).first()
    assert row["a"] == 0 and row["b"] == pytest.approx(2 - 0.15 * math.log(100)) and row["c"] == float("inf") and row["d"] == -1 and row["e"] == float("inf")


def test_ensemble_against_greedy_loop(spark):
    rnd = random.Random(8)
    names = list("abcdef")
    sharpe = {n: rnd.random() for n in names}
    rho = {(x, y): rnd.uniform(-0.6, 0.6) for x, y in itertools.combinations(names, 2)}
    corr = spark.createDataFrame([(x, y, c) for (x, y), c in rho.items()] + [(n, n, 1.0) for n in names], "a string, b string, corr double")
    picked = []
    for n in sorted(names, key=sharpe.get, reverse=True):
        if len(picked) < 3 and all(abs(rho[tuple(sorted((n, p)))]) <= 0.3 for p in picked):
            picked.append(n)
    got = perf.select_ensemble(spark.createDataFrame(sharpe.items(), "strategy string, sharpe double"), corr, n_select=3)
    assert [r["strategy"] for r in got.orderBy("rank").collect()] == picked


def test_change_point_is_found(spark):
    rng = np.random.default_rng(1)
    xs = np.concatenate([rng.normal(0, 1, 120), rng.normal(8, 1, 80)])
    out = reg.change_points(frame(spark, xs, "x"), ["k"], ["t"], "x", ["t"], hazard=0.01)
    hits = [r["t"] for r in out.where("changepoint").orderBy("t").collect()]
    assert any(120 <= h <= 126 for h in hits) and len(hits) <= 3


def test_run_length_posterior_against_scalar_loop():
    """Posterior of every run length recomputed from the raw observations of that run."""
    xs, hazard = [0.3, -1.0, 0.4, 5.0, 5.5, 4.8], 0.05
    state = reg.RunLength(hazard=hazard)

    def predictive(past, x):
        mu, kappa, alpha, beta = 0.0, 1.0, 1.0, 1.0
        for v in past:
            beta += 0.5 * kappa * (v - mu) ** 2 / (kappa + 1)
            mu, kappa, alpha = (kappa * mu + v) / (kappa + 1), kappa + 1, alpha + 0.5
        s2 = beta * (kappa + 1) / (alpha * kappa)
        c = math.gamma(alpha + 0.5) / math.gamma(alpha) / math.sqrt(2 * alpha * math.pi * s2)
        return c * (1 + (x - mu) ** 2 / (2 * alpha * s2)) ** -(alpha + 0.5)

    p = {0: 1.0}
    for t, x in enumerate(xs):
        w = {r: q * predictive(xs[t - r : t], x) for r, q in p.items()}
        grown = {0: sum(w.values()) * hazard, **{r + 1: v * (1 - hazard) for r, v in w.items()}}
        total = sum(grown.values())
        p = {r: v / total for r, v in grown.items()}
        cp, run, _ = state.update(x)
        assert cp == pytest.approx(p[0]) and run == max(p, key=p.get)
        assert state.p == pytest.approx([p[r] for r in range(len(p))])


def test_welch_and_cycles(spark):
    t = np.arange(256)
    x = np.sin(2 * np.pi * t / 16)
    f, psd = reg.welch(x[None, :], 64)
    assert f[psd[0].argmax()] == pytest.approx(1 / 16)
    df = frame(spark, x, "x")
    s = reg.spectral_regime(df, ["k"], ["t"], "x", 50, n=256, min_rows=200, hop=256, rows=60).orderBy("t").collect()
    assert len(s) == df.count() and s[0]["regime"] == "unknown" and s[-1]["dominant_period"] == pytest.approx(16)
    assert sum(r["alpha"] is not None for r in s) == len(s) - 255
    c = reg.dominant_cycles(df, ["k"], ["t"], "x", 50, n=64, hop=64, rows=60).orderBy("t").collect()
    assert c[-1]["modes"][0]["period"] == pytest.approx(16)


def test_hidden_regimes_separate_volatility(spark):
    rng = np.random.default_rng(0)
    ret = np.concatenate([rng.normal(0.01, 0.002, 150), rng.normal(0, 0.2, 100), rng.normal(-0.01, 0.002, 150)])
    vol = np.abs(ret) + np.repeat([0.01, 0.3, 0.01], [150, 100, 150])
    df = spark.createDataFrame([("k", i, float(a), float(b)) for i, (a, b) in enumerate(zip(ret, vol))], "k string, t long, r double, v double")
    out = reg.hidden_regimes(df, ["k"], ["t"], "r", "v", ["t"], 1000, inits=3, iters=40).orderBy("t").collect()
    mid = [r["regime"] for r in out[150:250]]
    assert mid.count("VOLATILE") > 90 and [r["regime"] for r in out[:150]].count("VOLATILE") < 10
    assert {r["regime"] for r in reg.hidden_regimes(df.limit(20), ["k"], ["t"], "r", "v", ["t"], 1000, inits=1).collect()} == {"UNKNOWN"}


def test_breaker_downgrade_and_manual_mode(spark):
    eq = frame(spark, [100, 79, 88, 92, 96, 85, 96], "e")
    assert column(risk.circuit_breaker(eq, ["k"], ["t"], "e", 2), "state") == ["ACTIVE", "HALTED", "WARNING", "WARNING", "ACTIVE", "REDUCING", "ACTIVE"]
    eq = frame(spark, [100, 79, 97, 88, 97], "e")
    assert column(risk.circuit_breaker(eq, ["k"], ["t"], "e", 2, auto_recovery=False), "state") == ["ACTIVE", "HALTED", "HALTED", "WARNING", "ACTIVE"]


BELOW_ZERO = [-100.0, -250.0, -50.0, 0.0, -1.0, 100.0, 75.0, 99.0]


def quotients(auto):
    """Drawdowns as plain quotients, also under peaks at or below zero, and their states."""
    return [0.0, -1.5, 0.0, math.nan, math.inf, 0.0, 0.25, 0.01], ["ACTIVE"] * 3 + ["HALTED"] * 2 + (["ACTIVE", "HALTED", "ACTIVE"] if auto else ["HALTED"] * 3)


@pytest.mark.parametrize("auto", [True, False])
def test_breaker_below_zero(spark, auto):
    eq, (want, states) = frame(spark, BELOW_ZERO, "e"), quotients(auto)
    out = risk.circuit_breaker(eq, ["k"], ["t"], "e", 2, auto_recovery=auto, signed=True)
    assert column(out, "drawdown") == pytest.approx(want, nan_ok=True) and column(out, "state") == states
    assert column(risk.circuit_breaker(eq, ["k"], ["t"], "e", 2), "drawdown")[:5] == [0.0] * 5


@pytest.mark.parametrize("auto", [True, False])
def test_streamed_breaker_below_zero(auto):
    rows, (want, states) = {"e": np.array(BELOW_ZERO)}, quotients(auto)
    live = BreakerSweep([], "e", auto_recovery=auto, signed=True).push(rows)
    assert live["drawdown"] == pytest.approx(want, nan_ok=True) and live["state"] == states
    assert BreakerSweep([], "e").push(rows)["drawdown"][:5] == [0.0] * 5


@pytest.mark.parametrize("width", ["1 hour", "30 seconds"])
def test_wash_pairs_against_brute_force(spark, width):
    rnd = random.Random(6)
    rows, t = [], 0
    for i in range(250):
        t += rnd.randrange(0, 20_000_000)
        rows.append((i, "u" if rnd.random() < 0.8 else "w", "S", t, rnd.choice(["buy", "sell", "other"]), round(rnd.uniform(99.9, 100.1), 2)))
    df = spark.createDataFrame(rows, "id long, u string, s string, us long, side string, price double")
    got = {r["id"]: r for r in sv.recent_order_stats(df, "u", "s", "us", "id", window="2 minutes", width=width).collect()}
    assert len(got) == 250
    for i, u, _, us, _, _ in rows:
        recent = [r for r in rows if r[1] == u and us - 120_000_000 < r[3] <= us and (r[3], r[0]) <= (us, i)]
        pairs = sum(abs(b[5] - s[5]) / b[5] < 0.001 for b in recent if b[4] == "buy" for s in recent if s[4] == "sell")
        levels = len({r[5] for r in recent if r[4] == "buy"})
        assert (got[i]["recent"], got[i]["matches"], got[i]["buy_levels"]) == (len(recent), pairs, levels)


def test_hash_chain_accepts_a_valid_log(spark):
    import json

    prev, rows = sv.GENESIS, []
    for i in range(5):
        e = dict(event_id=f"e{i}", event_type="t", timestamp=f"2024-01-0{i + 1}", actor='a"b', resource="r", action="x", details={"k": i}, previous_hash=prev)
        h = hashlib.sha256(json.dumps(e, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        rows.append((i, e["event_id"], "t", e["timestamp"], e["actor"], "r", "x", json.dumps(e["details"], separators=(",", ":")), prev, h))
        prev = h
    cols = "n long, event_id string, event_type string, timestamp string, actor string, resource string, action string, details string, previous_hash string, hash string"
    df = spark.createDataFrame(rows, cols)
    assert sv.verify_chain(df, ["n"], 2).count() == 0
    forged = df.withColumn("action", F.when(F.col("n") == 2, "y").otherwise(F.col("action")))
    assert [(r["event_id"], r["error"]) for r in sv.verify_chain(forged, ["n"], 2).collect()] == [("e2", "HASH_MISMATCH")]
    cut = df.where("n <> 2")
    assert [(r["event_id"], r["error"]) for r in sv.verify_chain(cut, ["n"], 2).collect()] == [("e3", "CHAIN_BREAK")]


def test_graph_walks(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (9, 8)], "src long, dst long")
    assert {(r["node"], r["distance"]) for r in graph.reach(e, 1, 2).collect()} == {(2, 1), (3, 2)}
    n = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (7, 99)], "id long, parent_id long")
    assert {(r["id"], r["root"], r["depth"]) for r in graph.lineage_roots(n).collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 1, 3), (7, 7, 0)}
    assert [(r["id"], r["depth"]) for r in graph.lineage_of(n, 3).orderBy("depth").collect()] == [(3, 0), (2, 1), (1, 2)]


def test_formula_extraction(spark):
    text = "intro\nThe Sharpe is $SR = x$ and $$\\frac{p - q}{b}$$\n$x$ alone $$$\nprice $5 or $6 now"
    out = cp.extract_formulas(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").orderBy("line_number", "latex").collect()
    assert [(r["line_number"], r["display_mode"], r["latex"], r["known_type"], r["domain"]) for r in out] == [
        (2, False, "SR = x", "sharpe_ratio", "trading"),
        (2, True, "\\frac{p - q}{b}", "sharpe_ratio", "trading"),
        (4, False, "5 or", None, "general"),
    ]


def test_parse_helpers(spark):
    df = spark.createDataFrame([(s,) for s in ("12.9", " -3.7 ", "x", "NaN", "inf", None)], "s string")
    assert [r["f"] for r in df.select(parse.safe_float(F.col("s")).alias("f")).collect()] == [12.9, -3.7, 0.0, 0.0, 0.0, 0.0]
    assert [r["i"] for r in df.select(parse.safe_int(F.col("s"), 7).alias("i")).collect()] == [12, -3, 7, 7, 7, 7]
    names = spark.createDataFrame([(s,) for s in ("BTCUSDT-PERP", "BTC-USDT-PERP", "BTC/USDT:USDT", "ethusd", "A-B-C")], "s string")
    assert [r["u"] for r in names.select(parse.normalize_symbol(F.col("s")).alias("u")).collect()] == ["BTC/USDT:USDT", "BTC/USDT:USDT", "BTC/USDT:USDT", "ETH/USD:USD", "A-B-C"]


def test_operators_on_empty_and_single_rows(spark):
    one, none = frame(spark, [5.0]), frame(spark, [5.0]).where("false")
    for df, n in ((one, 1), (none, 0)):
        assert rec.ema(df, ["k"], ["t"], "p", 5, {"e": 5}).count() == n
        assert win.moving_average(df, ["k"], ["t"], "p", 5).count() == n
        assert ml.triple_barrier(df.withColumn("atr", F.lit(1.0)), ["k"], ["t"], 5, price="p").count() == n
        assert reg.rolling_entropy(df, ["k"], ["t"], "p", 5).count() == n
        assert risk.circuit_breaker(df, ["k"], ["t"], "p", 5).count() == n
