"""Recursive filters, all as affine scans (see ``scan``): a hot key runs on many tasks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .blocks import running
from .scan import affine_scan
from .windows import ROWS, rolling


def ema_alpha(period: int) -> float:
    return 2.0 / (period + 1)


def _ema(x: Column, alpha: float) -> tuple[Column, Column, Column]:
    return F.lit(1 - alpha), F.lit(alpha) * x, x


def ema(df, keys, order, col: str, block, periods: dict[str, int]) -> DataFrame:
    """Low-pass filters ``{name: period}`` in one pass: y = a x + (1-a) y, first value x."""
    return affine_scan(df, keys, order, block, {n: _ema(F.col(col), ema_alpha(p)) for n, p in periods.items()})


def high_pass(df, keys, order, col: str, block, period: int, name: str = "hp") -> DataFrame:
    """y = a (y + x - previous x), first value 0."""
    a = ema_alpha(period)
    prev = running(df, keys, order, block, {"_x": ("lag", F.col(col))})
    step = F.lit(a) * (F.col(col) - F.coalesce("_x", F.col(col)))
    return affine_scan(prev, keys, order, block, {name: (F.lit(a), step, F.lit(0.0))}).drop("_x")


def _innovation(x: Column, mean: Column, alpha: float) -> Column:
    """a (1-a) (x - previous mean)^2 from the new mean, whose distance to x is (1-a) times the old one's.

    No large numbers are subtracted but x and a mean near it, so small variances survive large levels.
    """
    d = x - mean
    return F.lit(alpha / (1 - alpha)) * d * d


def ew_moments(df, keys, order, col: str, block, alphas: dict[str, float]) -> DataFrame:
    """Exponentially weighted mean and variance per ``{name: alpha}``: two chained scans.

    First the means, then v = (1-a) (v + a d^2) with d from the old mean.
    """
    x = F.col(col)
    means = affine_scan(df, keys, order, block, {f"{n}_mean": _ema(x, a) for n, a in alphas.items()})
    spread = {f"{n}_var": (F.lit(1 - a), _innovation(x, F.col(f"{n}_mean"), a), F.lit(0.0)) for n, a in alphas.items()}
    return affine_scan(means, keys, order, block, spread)


def atr(df, keys, order, block, high="high", low="low", close="close", period: int = 14, name: str = "atr", rows: int = ROWS) -> DataFrame:
    """Wilder average true range: seeded with the mean of the first ``period`` ranges, null before."""
    prev = F.lag(close)

    def build(d, w):
        pc = prev.over(w)
        tr = F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - pc), F.abs(F.col(low) - pc))
        d = d.withColumn("_tr", F.when(pc.isNotNull(), tr))
        return d.withColumn("_seed", F.avg("_tr").over(w.rowsBetween(-(period - 1), 0)))

    src = checkpointed(rolling(df, keys, order, block, period + 1, build, rows=rows, keep_seq=True))
    a = 1.0 / period
    s = F.col("seq")
    rec = (
        F.when(s <= period + 1, 0.0).otherwise(1 - a),
        F.when(s <= period, 0.0).when(s == period + 1, F.col("_seed")).otherwise(F.lit(a) * F.col("_tr")),
        F.lit(0.0),
    )
    out = affine_scan(src, keys, order, block, {name: rec})
    return out.withColumn(name, F.when(s > period, F.col(name))).drop("_tr", "_seed", *([] if "seq" in df.columns else ["seq"]))


def variance_regime(df, keys, order, ret: str, block, fast: int = 10, slow: int = 50, momentum: int = 20, trend: float = 1.5, revert: float = 0.7) -> DataFrame:
    """Regime from fast / slow variance, with filtered momentum and volatility, in two chained scans."""
    x = F.col(ret)
    fa, sa = ema_alpha(fast), ema_alpha(slow)
    means = {"_mf": _ema(x, fa), "_ms": _ema(x, sa), "momentum": _ema(x, ema_alpha(momentum))}
    out = affine_scan(df, keys, order, block, means)
    spread = {f"_q{k}": (F.lit(1 - a), _innovation(x, F.col(f"_m{k}"), a), F.lit(0.0)) for k, a in (("f", fa), ("s", sa))}
    out = affine_scan(out, keys, order, block, spread)
    fv, sv = F.col("_qf"), F.col("_qs")
    quiet = sv < 1e-10
    ratio = F.when(quiet, 1.0).otherwise(fv / F.when(~quiet, sv))
    regime = F.when(quiet, "unknown").when(ratio > trend, "trending").when(ratio < revert, "mean_reverting").otherwise("normal")
    return out.withColumns({"variance_ratio": ratio, "regime": regime, "volatility": F.sqrt(sv)}).drop("_mf", "_ms", "_qf", "_qs")


def kalman_gain(n: Column, q: float, r: float) -> Column:
    """Gain of step ``n`` (from 1, prior variance 1), for any n.

    The posterior variance follows p -> r (p + q) / (p + q + r). Around its fixed points p1 > p2 the ratio
    (p - p1) / (p - p2) shrinks by a constant factor, which gives the variance before step n in closed form; it
    tends to the steady state p1. Without process noise the fixed points meet and 1 / p grows by 1 / r.
    """
    steps = n - 1
    if q == 0:
        p = F.lit(1.0) / (1 + steps / F.lit(float(r)))
    else:
        root = math.sqrt(q * q + 4 * q * r)
        p1, p2 = (root - q) / 2, (-root - q) / 2
        left = F.lit((1 - p1) / (1 - p2)) * F.pow(F.lit((r / (p1 + q + r)) ** 2), steps)
        p = (F.lit(p1) - F.lit(p2) * left) / (1 - left)
    return (p + q) / (p + q + r)


def kalman(df, keys, order, col: str, block, process_noise: float = 0.01, measurement_noise: float = 0.1, name: str = "kalman") -> DataFrame:
    """Random-walk Kalman filter: data-independent gains make it an affine recurrence."""
    src = running(df, keys, order, block, {"_n": ("count", F.lit(1))})
    src = src.withColumn("_k", kalman_gain(F.greatest(F.col("_n") - 1, F.lit(1)), process_noise, measurement_noise))
    return affine_scan(src, keys, order, block, {name: (1 - F.col("_k"), F.col("_k") * F.col(col), F.col(col))}).drop("_n", "_k")


def _upper_median(col: Column) -> Column:
    """Element n div 2 of the sorted values (not interpolated)."""
    arr = F.sort_array(col)
    return F.get(arr, F.floor(F.size(arr) / 2).cast("int"))


def tape_speed(df, keys, order, time: Column, block, count: Column | None = None, alpha: float = 0.1, base: float = 1.0, fast: float = 1.5, slow: float = 0.5, rows: int = ROWS, scale: float = 1e6) -> DataFrame:
    """Arrival-rate EMA against the upper median of its last 100 values (at least 20).

    Rows that share a timestamp with their predecessor leave the state unchanged. ``time`` is an integer
    clock with ``scale`` ticks per unit, so differences stay exact.
    """
    n = F.lit(1.0) if count is None else count.cast("double")
    src = running(df.withColumns({"_t": time, "_cnt": n}), keys, order, block, {"_pt": ("lag", F.col("_t"))})
    src = src.withColumn("_dt", (F.col("_t") - F.col("_pt")) / F.lit(scale))
    src = checkpointed(src.withColumn("_live", F.coalesce(F.col("_dt") > 1e-10, F.lit(False))))
    inst = F.col("_cnt") / F.col("_dt")
    live = affine_scan(src.where("_live"), keys, order, block, {"_lam": _ema(inst, alpha)})
    live = rolling(
        checkpointed(live),
        keys,
        order,
        block,
        99,
        lambda d, w: d.withColumn(
            "_base", F.when(F.count("*").over(w.rowsBetween(-99, 0)) >= 20, _upper_median(F.collect_list("_lam").over(w.rowsBetween(-99, 0))))
        ),
        rows=rows,
    )
    both = live.withColumn("_st", F.struct("_lam", "_base")).drop("_lam", "_base").unionByName(src.where("not _live"), allowMissingColumns=True)
    out = running(both, keys, order, block, {"_st": ("last", F.col("_st"))})
    lam = F.coalesce(F.col("_st._lam"), F.lit(base))
    baseline = F.coalesce(F.col("_st._base"), F.lit(base))
    ratio = F.when(baseline > 1e-10, lam / baseline).otherwise(1.0)
    norm = F.least(F.lit(2.0), F.greatest(F.lit(0.0), ratio))
    regime = F.when(ratio > fast, "fast").when(ratio < slow, "slow").otherwise("normal")
    return out.withColumns({"rate": lam, "speed": norm, "tape": regime, "tape_weight": F.sqrt(norm)}).drop("_st", "_t", "_pt", "_dt", "_live", "_cnt")


def adaptive_k(df, keys, order, ret: str, block, k0: float = 1.0, alpha: float = 0.1, lookback: int = 20, name: str = "k", rows: int = ROWS) -> DataFrame:
    """k0 / (1 + EMA|r| / median|r|), clamped to 0.1..5; the median needs 10 values, else the EMA."""
    a = F.abs(F.col(ret))
    src = checkpointed(affine_scan(df.withColumn("_a", a), keys, order, block, {"_ema": _ema(F.col("_a"), alpha)}))
    frame = -(lookback - 1)

    def build(d, w):
        f = w.rowsBetween(frame, 0)
        return d.withColumn("_med", F.when(F.count("*").over(f) >= 10, _upper_median(F.collect_list("_a").over(f))).otherwise(F.col("_ema")))

    out = rolling(src, keys, order, block, lookback - 1, build, rows=rows)
    quiet = F.col("_med") <= 1e-10
    k = F.lit(k0) / (1 + F.col("_ema") / F.when(~quiet, F.col("_med")))
    return out.withColumn(name, F.when(quiet, k0).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(5.0), k)))).drop("_a", "_ema", "_med")


def hawkes(df, keys, order, side: str, us: str, block, beta: float = 1.0, mu: float = 0.1, alpha: float = 0.5, refit: int = 100) -> DataFrame:
    """Exponential-kernel intensities of buys and sells and their imbalance, per distinct timestamp.

    Only strictly earlier events excite; trades sharing a timestamp are one row. The imbalance is 0
    until ``refit`` ticks have been seen. No lookback cut: with beta times any real span large, what a
    cut removes is below double precision.
    """
    ticks = df.groupBy(*keys, us).agg(
        F.count_if(F.col(side) == "BUY").cast("double").alias("_nb"), F.count_if(F.col(side) == "SELL").cast("double").alias("_ns"), F.count("*").alias("_n")
    )
    block_us = block
    st = running(ticks, keys, [us], block_us, {"_pu": ("lag", F.col(us)), "_pb": ("lag", F.col("_nb")), "_ps": ("lag", F.col("_ns")), "_ticks": ("sum", F.col("_n"))})
    st = checkpointed(st)
    decay = F.exp(-F.lit(beta) * (F.col(us) - F.coalesce("_pu", F.col(us))) / 1e6)
    st = st.withColumn("_d", decay)
    rec = {s: (F.col("_d"), F.coalesce(F.col("_d") * alpha * F.col(p), F.lit(0.0)), F.lit(0.0)) for s, p in (("_buy", "_pb"), ("_sell", "_ps"))}
    out = affine_scan(st, keys, [us], block_us, rec)
    b, s = F.col("_buy") + mu, F.col("_sell") + mu
    ofi = F.when(F.col("_ticks") >= refit, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (b - s) / (b + s + 1e-10)))).otherwise(0.0)
    return out.select(*keys, us, b.alias("buy_intensity"), s.alias("sell_intensity"), ofi.alias("ofi"))


def decay_from_ratio(variance_ratio: Column, low: float = 0.95, high: float = 0.99) -> Column:
    """Discount factor: ``high`` up to a variance ratio of 0.7, ``low`` from 1.5, linear between."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (variance_ratio - 0.7) / 0.8))
    return F.lit(high) - F.lit(high - low) * x


def discounted_posteriors(df, arm: str, order, ret: str, block, decay: Column) -> DataFrame:
    """Success / failure pseudo-counts of the arm in each row after global discounting, and their mean.

    Every step discounts all arms. Instead of a row per arm and step, the running sum of log decays
    tells each arm how much it faded between its own rows.
    """
    g = running(df.withColumn("_ld", F.log(decay)), [], order, block, {"_L": ("sum", F.col("_ld"))})
    g = running(checkpointed(g), [arm], order, block, {"_PL": ("lag", F.col("_L"))})
    r = F.col(ret)
    gain = F.least(F.lit(1.0), F.abs(r) * 10)
    up, down = F.when(r >= 0, gain).otherwise(0.0), F.when(r < 0, gain).otherwise(0.0)
    fade = F.exp(F.col("_L") - F.coalesce(F.col("_PL"), F.lit(0.0)))
    out = affine_scan(g, [arm], order, block, {"successes": (fade, up, fade + up), "failures": (fade, down, fade + down)})
    return out.withColumn("mean", F.col("successes") / (F.col("successes") + F.col("failures"))).drop("_ld", "_L", "_PL")


def ema_correlations(
    df: DataFrame, strategy: str, step: str, ret: str, strategies: DataFrame, block, decay: float = 0.99, shrink: float = 0.1, min_samples: int = 30, eps: float = 1e-6
) -> DataFrame:
    """Latest shrunk EMA correlation of every strategy pair: (a, b, corr).

    ``strategies`` holds all strategies in a column of the same name, those without any return too. Missing
    returns are 0, deviations are taken from the updated mean. Means are one scan keyed by strategy, covariances
    one keyed by pair; a pair has a row for each step, as its recurrence has.
    """
    names = strategies.agg(F.array_sort(F.collect_set(strategy))).scalar()
    sums = df.groupBy(step, strategy).agg(F.sum(ret).alias("_x"))
    steps = sums.groupBy(step).agg(F.map_from_entries(F.collect_list(F.when(F.col(strategy).isNotNull(), F.struct(strategy, "_x")))).alias("_xs"))
    grid = steps.select(step, "_xs", F.explode(names).alias("_s")).select(step, "_s", F.coalesce(F.element_at("_xs", F.col("_s")), F.lit(0.0)).alias("_x"))
    m = affine_scan(grid, ["_s"], [step], block, {"_m": _ema(F.col("_x"), 1 - decay)})
    dev = checkpointed(m.select(step, "_s", (F.col("_x") - F.col("_m")).alias("_d")))
    other = dev.select(step, F.col("_s").alias("b"), F.col("_d").alias("_e"))
    pairs = dev.join(other, step).where(F.col("_s") <= F.col("b")).select(step, F.col("_s").alias("a"), "b", (F.lit(1 - decay) * F.col("_d") * F.col("_e")).alias("_p"))
    c = affine_scan(pairs, ["a", "b"], [step], block, {"_c": (F.lit(decay), F.col("_p"), F.lit(0.0))})
    last = checkpointed(c.groupBy("a", "b").agg(F.count("*").alias("n"), F.max_by("_c", step).alias("_c")))
    own = last.where("a = b").select(F.col("a").alias("_k"), F.sqrt(F.greatest(F.col("_c"), F.lit(eps))).alias("_sd"))
    out = last.join(own.toDF("a", "_sa"), "a").join(own.toDF("b", "_sb"), "b")
    raw = F.col("_c") / F.greatest(F.col("_sa") * F.col("_sb"), F.lit(eps))
    corr = F.when(F.col("n") < min_samples, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw * (1 - shrink))))
    return out.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(corr).alias("corr"))


def blended_weights(df, keys, order, target: str, block, rate: float = 0.1, low: float = 0.0, high: float = 1.0, start: float = 0.5, name: str = "weight") -> DataFrame:
    """w = clamp((1 - rate) w + rate * target) each step: a clamped affine scan from ``start``."""
    step = F.lit(rate) * F.col(target)
    first = F.greatest(F.lit(low), F.least(F.lit(high), F.lit((1 - rate) * start) + step))
    return affine_scan(df, keys, order, block, {name: (F.lit(1 - rate), step, first, F.lit(low), F.lit(high))})


def pid_multiplier(df, keys, order, drawdown: str, block, target: float = 0.02, kp: float = 2.0, ki: float = 0.1, kd: float = 0.5, limit: float = 0.5, low: float = 0.0, high: float = 1.0, name: str = "multiplier") -> DataFrame:
    """Risk multiplier 1 / (1 + PID of drawdown above target); the clamped integral is a clamped scan."""
    e = F.col(drawdown) - F.lit(target)
    src = running(df.withColumn("_e", e), keys, order, block, {"_pe": ("lag", F.col("_e"))})
    first = F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col("_e")))
    out = affine_scan(src, keys, order, block, {"_i": (F.lit(1.0), F.col("_e"), first, F.lit(-limit), F.lit(limit))})
    pid = F.lit(kp) * F.col("_e") + F.lit(ki) * F.col("_i") + F.lit(kd) * F.coalesce(F.col("_e") - F.col("_pe"), F.lit(0.0))
    mult = F.when(1 + pid != 0, 1 / F.nullif(1 + pid, F.lit(0.0)))
    return out.withColumn(name, F.greatest(F.lit(low), F.least(F.lit(high), mult))).drop("_e", "_pe", "_i")


def wiener_shrink(df, keys, order, col: str, block, snr: float, name: str = "shrunk") -> DataFrame:
    """First-order IIR with gain snr / (snr + 1)."""
    return affine_scan(df, keys, order, block, {name: _ema(F.col(col), snr / (snr + 1))})
