"""Return statistics, overfitting measures, comparisons and costs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats_expr import norm_cdf, t_two_sided, z_value
from ..session import checkpointed, stored
from .blocks import running, value_blocks
from .relational import hash_uniform
from .windows import ROWS, cumulative_return, drawdown, rolling

INF = float("inf")


def sharpe_agg(ret: str, periods: int = 252) -> Column:
    """mean / population std * sqrt(periods); 0 for fewer than two rows or no variance."""
    sd = F.stddev_pop(ret)
    return F.when((F.count(ret) < 2) | (sd == 0), 0.0).otherwise(F.avg(ret) / F.nullif(sd, F.lit(0.0)) * math.sqrt(periods))


def moments(df: DataFrame, keys: Sequence[str], ret: str) -> DataFrame:
    """n, mean, population std, Sharpe, skewness (0 below 3 rows) and kurtosis (3 below 4 rows)."""
    g = df.groupBy(*keys).agg(
        F.count(ret).alias("n"), F.avg(ret).alias("mean"), F.stddev_pop(ret).alias("std"), sharpe_agg(ret).alias("sharpe"), F.skewness(ret).alias("_s"), F.kurtosis(ret).alias("_k")
    )
    flat = F.col("std") <= 0
    return g.withColumns(
        {
            "skew": F.when((F.col("n") < 3) | flat, 0.0).otherwise(F.col("_s")),
            "kurt": F.when(F.col("n") < 4, 3.0).when(flat, 0.0).otherwise(F.col("_k") + 3),
        }
    ).drop("_s", "_k")


def probabilistic_sharpe(df: DataFrame, keys: Sequence[str], ret: str, benchmark: float = 0.0, periods: int = 252) -> DataFrame:
    """P(true Sharpe > benchmark) given skewness and excess kurtosis; 0.5 when undecidable."""
    m = moments(df, keys, ret)
    sr = F.when(F.col("std") > 0, F.col("mean") / F.nullif("std", F.lit(0.0)) * math.sqrt(periods))
    years = F.greatest(F.col("n") / F.lit(periods), F.lit(0.1))
    var = (1 + 0.5 * sr * sr - F.col("skew") * sr + (F.col("kurt") - 3) / 4 * sr * sr) / years
    # staged columns keep the generated code small: the tail formula repeats its argument
    out = m.withColumn("_z", (sr - F.lit(benchmark)) / F.sqrt(F.when(var > 0, var)))
    psr = F.when((F.col("n") < 10) | F.col("_z").isNull(), 0.5).otherwise(norm_cdf(F.col("_z")))
    return out.withColumn("psr", psr).drop("_z")


def deflated_sharpe_extreme(sharpe: Column, trials: Column) -> Column:
    """max(0, SR - sqrt(2 ln N)); SR for one trial."""
    return F.when(trials <= 1, sharpe).otherwise(F.greatest(F.lit(0.0), sharpe - F.sqrt(2 * F.log(F.greatest(trials, F.lit(1))))))


def deflated_sharpe_log(sharpe: Column, trials: Column) -> Column:
    """SR - 0.15 ln N, N at most 1e15; SR for one trial."""
    return F.when(trials <= 1, sharpe).otherwise(sharpe - 0.15 * F.log(F.least(F.greatest(trials.cast("double"), F.lit(1.0)), F.lit(1e15))))


def minimum_track_record(sharpe: Column, skew: Column, kurt: Column, confidence: float = 0.95) -> Column:
    """Months of track record needed; infinite for a Sharpe of 0 or less."""
    years = (1 + skew * sharpe + (kurt - 3) * sharpe * sharpe / 4) * (z_value(confidence) / F.when(sharpe > 0, sharpe)) ** 2
    return F.when(sharpe <= 0, INF).otherwise(years * 12)


def probability_of_luck(sharpe: Column, trials: Column, months: Column, null_sharpe: float = 0.0) -> Column:
    """Bonferroni-corrected one-sided p-value of the Sharpe ratio."""
    se = F.sqrt((1 + sharpe * sharpe / 2) / F.greatest(months / 12, F.lit(0.1)))
    p = 1 - norm_cdf((sharpe - null_sharpe) / se)
    return F.when(sharpe <= null_sharpe, 1.0).otherwise(F.least(F.lit(1.0), p * trials))


def degradation_overfit_probability(df: DataFrame, keys: Sequence[str], ret: str, in_sample: Column) -> DataFrame:
    """1 - OOS/IS Sharpe clipped to 0..1; 0.5 below 10 rows a side or for a non-positive IS Sharpe."""
    src = df.withColumns({"_i": F.when(in_sample, F.col(ret)), "_o": F.when(~in_sample, F.col(ret))})
    g = src.groupBy(*keys).agg(F.count("_i").alias("n_is"), F.count("_o").alias("n_oos"), sharpe_agg("_i").alias("is_sharpe"), sharpe_agg("_o").alias("oos_sharpe"))
    short = (F.col("n_is") < 10) | (F.col("n_oos") < 10) | (F.col("is_sharpe") <= 0)
    pbo = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("oos_sharpe") / F.nullif("is_sharpe", F.lit(0.0))))
    return g.withColumn("pbo", F.when(short, 0.5).otherwise(pbo))


def overfit_alert(train: Column, test: Column, warning: float = 1.5, critical: float = 2.0) -> Column:
    """struct(ratio, severity) of a train / test Sharpe pair."""
    ratio = F.when(test <= 0, F.when(train > 0, INF).otherwise(1.0)).otherwise(train / F.nullif(test, F.lit(0.0)))
    severity = F.when(test <= 0, "critical").when(ratio >= critical, "critical").when(ratio >= warning, "warning").otherwise("none")
    return F.struct(ratio.alias("ratio"), severity.alias("severity"))


def overfit_trend(df, keys, order, train: str, test: str, block, rows: int = ROWS) -> DataFrame:
    """Mean finite ratio of the last five checks against the five before (or the first five)."""
    r = F.when(F.col(test) > 0, F.col(train) / F.nullif(test, F.lit(0.0)))

    def build(d, w):
        d = d.withColumn("_r", r)
        return d.withColumns(
            {
                "recent": F.coalesce(F.avg("_r").over(w.rowsBetween(-4, 0)), F.lit(INF)),
                "_before": F.coalesce(F.avg("_r").over(w.rowsBetween(-9, -5)), F.lit(INF)),
                # with 5..9 checks the first five: rows 1..5 of the key, still inside the frame
                "_first": F.coalesce(F.avg(F.when(F.col("seq") <= 5, F.col("_r"))).over(w.rowsBetween(-8, 0)), F.lit(INF)),
            }
        )

    out = rolling(df, keys, order, block, 9, build, rows=rows, keep_seq=True)
    earlier = F.when(F.col("seq") >= 10, F.col("_before")).otherwise(F.col("_first"))
    trend = (
        F.when(F.col("seq") < 5, "insufficient_data").when(F.col("recent") < earlier * 0.9, "improving").when(F.col("recent") > earlier * 1.1, "deteriorating").otherwise("stable")
    )
    return out.withColumn("trend", trend).drop("_r", "_before", "_first", "recent")


def robustness(results: DataFrame, keys: Sequence[str], train="train_sharpe", test="test_sharpe", ret="test_return") -> DataFrame:
    """0..100: 30 consistency + 40 profitability + 30 degradation of walk-forward windows."""
    tr, te, r = F.col(train), F.col(test), F.col(ret)
    deg = F.when(tr <= 0, F.when(te > 0, 1.0).when(te < tr, 0.0).otherwise(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(te / F.nullif(tr, F.lit(0.0)), F.lit(1.0))))
    g = results.groupBy(*keys).agg(
        F.count("*").alias("n_windows"),
        F.avg(F.abs(r)).alias("_abs"),
        F.stddev_samp(r).alias("_std"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("profitable_pct"),
        F.avg(deg).alias("degradation"),
        F.avg(te).alias("avg_test_sharpe"),
        F.avg(r).alias("avg_test_return"),
    )
    cons = F.when(F.col("_abs") < 1e-10, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.least(F.col("_std") / F.when(F.col("_abs") >= 1e-10, F.col("_abs")), F.lit(1.0))))
    score = F.when(F.col("n_windows") == 1, F.when(F.col("profitable_pct") > 0, 40.0).otherwise(0.0)).otherwise(
        (cons * 0.3 + F.col("profitable_pct") * 0.4 + F.col("degradation") * 0.3) * 100
    )
    return g.withColumn("robustness", score).drop("_abs", "_std")


def permutation_overfit_probability(results: DataFrame, keys: Sequence[str], window: str, permutations: int = 100, seed: int = 0, train="train_sharpe", test="test_sharpe") -> DataFrame:
    """Share of random halvings in which either half degrades below 0.5 on average.

    Halves come from an MD5 order of (seed, permutation, window), so reruns agree. The windows of one
    strategy are few by construction, so ``permutations`` copies of that small table are cheap.
    """
    tr, te, eps = F.col(train), F.col(test), 1e-10
    ratio = (
        F.when(tr > eps, te / F.when(tr > eps, tr))
        .when(tr < -eps, F.when(te < -eps, tr / F.when(te < -eps, te)).otherwise(0.0))
        .otherwise(F.when(te >= 0, 1.0).otherwise(0.0))
    )
    copies = results.select(*keys, window, ratio.alias("_d"), F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("_perm"))
    u = hash_uniform(F.lit(str(seed)), F.col("_perm").cast("string"), F.col(window).cast("string"))
    w = Window.partitionBy(*keys, "_perm")
    half = copies.withColumns({"_rank": F.row_number().over(w.orderBy(u, window)), "_n": F.count("*").over(w)})
    first = F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 2))
    per = half.groupBy(*keys, "_perm").agg(F.max("_n").alias("_n"), F.avg(F.when(first, F.col("_d"))).alias("_a"), F.avg(F.when(~first, F.col("_d"))).alias("_b"))
    bad = (F.coalesce(F.col("_a"), F.lit(1.0)) < 0.5) | (F.coalesce(F.col("_b"), F.col("_a")) < 0.5)
    return per.groupBy(*keys).agg(F.when(F.max("_n") < 2, 0.0).otherwise(F.avg(bad.cast("double"))).alias("pbo"))


def gate(results: DataFrame, keys: Sequence[str], min_windows: int = 4, min_profitable: float = 0.75, min_sharpe: float = 0.5, max_dd: float = 0.30, min_robustness: float = 60.0) -> DataFrame:
    """All walk-forward acceptance criteria per strategy."""
    results = checkpointed(results)
    rob = robustness(results, keys).select(*keys, "robustness", "profitable_pct", "n_windows")
    g = results.groupBy(*keys).agg(F.max("max_drawdown").alias("worst_drawdown"), F.count_if(F.col("test_sharpe") >= min_sharpe).alias("_ok"))
    ok = (
        (F.col("n_windows") >= min_windows)
        & (F.col("robustness") >= min_robustness)
        & (F.col("profitable_pct") >= min_profitable)
        & (F.col("worst_drawdown") <= max_dd)
        & (F.col("_ok") > F.col("n_windows") / 2)
    )
    return rob.join(g, list(keys)).withColumn("passed", ok).drop("_ok")


def contender_metrics(results: DataFrame, name: str = "contender") -> DataFrame:
    """Per contender: means, sample stds (0 for one window), drawdowns, win rate, trades; ranked."""
    std = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    g = results.groupBy(name).agg(
        F.avg("sharpe").alias("avg_sharpe"),
        std("sharpe").alias("std_sharpe"),
        F.avg("ret").alias("avg_return"),
        std("ret").alias("std_return"),
        F.avg("drawdown").alias("avg_drawdown"),
        F.max("drawdown").alias("max_drawdown"),
        F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.sum("trade_count").alias("total_trades"),
        F.count("*").alias("window_count"),
    )
    # one row per contender: a single ranking task is bounded by the number of contenders
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("avg_sharpe"), F.asc(name))).cast("long"))


def compare_contenders(results: DataFrame, name: str = "contender", window: str = "window_id", significance: float = 0.05, edge: float = 0.2) -> DataFrame:
    """Every unordered pair of contenders found in the results, over the windows both have.

    An equi join on the window pairs the contenders of each window (pairs are this report's rows) and is
    aggregated per pair, so the number of contenders is the data's. Equal windows of one contender count once.
    """
    one = results.groupBy(window, name).agg(*[F.max(c).alias(c) for c in ("sharpe", "ret", "drawdown")]).where(F.col("ret").isNotNull())
    left, right = (one.select(F.col(window).alias("_w"), F.col(name).alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("sharpe", "ret", "drawdown")]) for x in "ab")
    d = F.col("ret_a") - F.col("ret_b")
    p = left.join(right, "_w").where("a < b").groupBy("a", "b").agg(
        F.count(d).alias("n"),
        F.avg(d).alias("mean"),
        F.stddev_samp(d).alias("sd"),
        F.count_if(d > 0).alias("wins"),
        F.count_if(d < 0).alias("losses"),
        F.avg("sharpe_a").alias("sa"),
        F.avg("sharpe_b").alias("sb"),
        F.avg("drawdown_a").alias("da"),
        F.avg("drawdown_b").alias("db"),
    )
    p = p.withColumn("_se", F.col("sd") / F.sqrt("n")).withColumn("_t", F.col("mean") / F.when(F.col("_se") >= 1e-10, F.col("_se")))
    p = p.withColumn("_p", t_two_sided(F.col("_t"), F.col("n") - 1))
    degenerate = F.col("_se") < 1e-10
    t = F.when((F.col("n") < 2) | (degenerate & (F.abs("mean") < 1e-10)), 0.0).when(degenerate, F.signum("mean") * INF).otherwise(F.col("_t"))
    pv = F.when((F.col("n") < 2) | (degenerate & (F.abs("mean") < 1e-10)), 1.0).when(degenerate, 0.0).otherwise(F.col("_p"))
    win_loss = F.when(F.col("losses") == 0, F.when(F.col("wins") > 0, INF).otherwise(1.0)).otherwise(F.col("wins") / F.nullif("losses", F.lit(0)))
    rel_dd = F.when(F.col("db") > 1e-10, F.col("da") / F.when(F.col("db") > 1e-10, F.col("db"))).when(F.col("da") < 1e-10, 1.0).otherwise(INF)
    level = F.abs("sb")
    percent = F.when(level > 1e-10, (F.col("sa") - F.col("sb")) / F.when(level > 1e-10, level) * 100).when(F.col("sa") != 0, F.signum("sa") * INF).otherwise(0.0)
    out = p.select("a", "b", "n", (F.col("sa") - F.col("sb")).alias("sharpe_difference"), percent.alias("sharpe_difference_pct"), win_loss.alias("win_loss_ratio"), rel_dd.alias("relative_drawdown"), t.alias("t_statistic"), pv.alias("p_value"))
    sig = F.col("p_value") < significance
    return out.withColumns({"significant": sig, "a_beats_b": sig & (F.col("sharpe_difference") > edge) & (F.col("t_statistic") > 0)})


def verdict(adaptive_sharpe: Column, fixed_sharpe: Column, adaptive_dd: Column, fixed_dd: Column, edge: float = 0.2, tolerance: float = 1.5) -> Column:
    """GO, WAIT or STOP."""
    nan = F.isnan(adaptive_sharpe) | F.isnan(fixed_sharpe)
    heavy = (fixed_dd > 0) & (adaptive_dd / F.when(fixed_dd > 0, fixed_dd) > tolerance)
    return F.when(nan, "WAIT").when(fixed_sharpe > adaptive_sharpe, "STOP").when(adaptive_sharpe - fixed_sharpe < edge, "WAIT").when(heavy, "WAIT").otherwise("GO")


def verdict_confidence(n: Column, mean_sharpe: Column, std_sharpe: Column, p_value: Column) -> Column:
    """0..1 from window count, significance and consistency; 0.1 below two windows."""
    cv = F.when(mean_sharpe != 0, F.abs(std_sharpe / F.nullif(mean_sharpe, F.lit(0.0)))).otherwise(1.0)
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p_value))
    total = F.least(n / 20, F.lit(1.0)) * 0.4 + F.greatest(F.lit(0.0), 1 - p * 2) * 0.4 + F.greatest(F.lit(0.0), 1 - cv) * 0.2
    return F.when(n < 2, 0.1).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def average_ranks(df: DataFrame, col: str, width: float, name: str) -> DataFrame:
    """Ranks with ties averaged, over the whole table, without one task holding it.

    Values are counted, counted values are ranked by a blocked running sum, and the rank of a value is
    joined back to its rows.
    """
    freq = df.groupBy(col).agg(F.count("*").alias("_c"))
    cum = running(freq, [], [col], value_blocks(F.col(col), width), {"_cum": ("sum", F.col("_c"))})
    return df.join(cum.select(col, (F.col("_cum") - (F.col("_c") - 1) / 2).alias(name)), col)


def correlations(df: DataFrame, x: str, y: str, width_x: float, width_y: float) -> DataFrame:
    """Pearson and Spearman correlation of two columns."""
    src = checkpointed(df.select(x, y).na.drop())
    r = average_ranks(average_ranks(src, x, width_x, "_rx"), y, width_y, "_ry")
    return r.agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))


def lead_correlations(df, keys, order, x: str, y: str, block, lags: Sequence[int] = (1, 2, 3, 6, 12), rows: int = ROWS) -> DataFrame:
    """corr(x now, y later) per lag as one row."""
    out = rolling(df, keys, order, block, 0, lambda d, w: d.withColumns({f"_y{k}": F.lead(y, k).over(w) for k in lags}), ahead=max(lags), rows=rows)
    return out.agg(*[F.corr(x, f"_y{k}").alias(f"lag_{k}") for k in lags])


def correlation_matrix(df: DataFrame, strategy: str, seq: str, ret: str) -> DataFrame:
    """Pairwise correlations over the rows every strategy reaches: (a, b, corr), NaN as 0.

    ``seq`` numbers each strategy's returns from 1; rows past the shortest strategy drop out. Strategies meet by an
    equi join on ``seq``, one partial aggregate per pair, however many strategies the data has.
    """
    sizes = df.groupBy(strategy).agg(F.max(seq).alias("n"))
    short = sizes.agg(F.min("n").alias("n")).select("n").scalar()
    whole = df.where(F.col(seq) <= short)
    left, right = (whole.select(F.col(seq).alias("_s"), F.col(strategy).alias(x), F.col(ret).cast("double").alias(f"r{x}")) for x in "ab")
    c = F.corr("ra", "rb")
    return left.join(right, "_s").where("a <= b").groupBy("a", "b").agg(c.alias("corr")).withColumn("corr", F.coalesce(F.when(F.isnan("corr"), 0.0).otherwise(F.col("corr")), F.lit(0.0)))


def select_ensemble(sharpes: DataFrame, corr: DataFrame, strategy: str = "strategy", n_select: int = 5, max_corr: float = 0.3, min_sharpe: float = 0.0) -> DataFrame:
    """Greedy pick by Sharpe (ties: the last name), skipping strategies too correlated with one already picked.

    ``n_select`` rounds over the strategies that are still possible: the best is picked, its pairs raise the others'
    largest correlation, and those above ``max_corr`` leave. A pair that ``corr`` does not hold has correlation 0.
    """
    pairs = corr.select("a", "b", F.abs("corr").alias("_rho"))
    pairs = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "_rho")).where("a <> b"), "ensemble")
    left = sharpes.where((F.col("sharpe") >= min_sharpe) & (F.lit(max_corr) >= 0)).select(F.col(strategy).alias("b"), F.col("sharpe").cast("double").alias("sharpe"), F.lit(0.0).alias("max_corr"))
    left = stored(left, "ensemble")
    picks = []
    for rank in range(1, n_select + 1):
        pick = stored(left.orderBy(F.desc("sharpe"), F.desc("b")).limit(1).withColumn("rank", F.lit(rank)), "ensemble")
        if pick.isEmpty():
            break
        picks.append(pick)
        near = pairs.join(pick.select(F.col("b").alias("a")), "a").groupBy("b").agg(F.max("_rho").alias("_rho"))
        rest = left.join(pick.select("b"), "b", "left_anti").join(near, "b", "left")
        rest = rest.select("b", "sharpe", F.greatest("max_corr", F.coalesce("_rho", F.lit(0.0))).alias("max_corr"))
        left = stored(rest.where(F.col("max_corr") <= max_corr), "ensemble")
    out = left.limit(0).withColumn("rank", F.lit(0))
    for pick in picks:
        out = out.unionByName(pick)
    return out.select(F.col("b").alias(strategy), "sharpe", "max_corr", "rank", F.lit(1 / max(1, len(picks))).alias("weight"))


def ensemble_summary(picked: DataFrame, corr: DataFrame, strategy: str = "strategy") -> DataFrame:
    """Portfolio Sharpe of the equally weighted picks and the sum-of-Sharpes ratio."""
    both = corr.unionByName(corr.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
    inside = both.join(picked.select(F.col(strategy).alias("a")), "a", "left_semi").join(picked.select(F.col(strategy).alias("b")), "b", "left_semi")
    total = inside.agg(F.sum(F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.col("corr"))).alias("v")).select("v").scalar()
    g = picked.agg(F.count("*").alias("n"), F.avg("sharpe").alias("_m"), F.sum("sharpe").alias("_s"))
    vol = F.sqrt(total) / F.col("n")
    p = F.when(vol > 0, F.col("_m") / F.nullif(vol, F.lit(0.0))).otherwise(F.col("_m"))
    return g.withColumn("portfolio_sharpe", p).withColumn("diversification_ratio", F.when(F.col("portfolio_sharpe") > 0, F.col("_s") / F.nullif("portfolio_sharpe", F.lit(0.0))).otherwise(1.0)).drop("_m", "_s")


def concentration(weights: DataFrame, corr: DataFrame, strategy: str = "strategy", weight: str = "weight") -> DataFrame:
    """Herfindahl index, effective number, largest and mean correlation, covariance penalty."""
    tot = weights.agg(F.sum(weight).alias("t"), F.count("*").alias("n"))
    t_, n_ = tot.select("t").scalar(), tot.select("n").scalar()
    w = weights.select(F.col(strategy), F.when(t_ > 0, F.col(weight) / F.nullif(t_, F.lit(0.0))).otherwise(1 / n_).alias("_w"))
    h = w.agg(F.sum(F.col("_w") ** 2).alias("herfindahl"))
    off = corr.where("a != b").join(w.select(F.col(strategy).alias("a"), F.col("_w").alias("_wa")), "a").join(w.select(F.col(strategy).alias("b"), F.col("_w").alias("_wb")), "b")
    c = off.agg(F.max(F.abs("corr")).alias("max_corr"), F.avg("corr").alias("avg_corr"), F.sum(2 * F.col("_wa") * F.col("_wb") * F.col("corr")).alias("penalty"))
    return c.withColumn("herfindahl", h.select("herfindahl").scalar()).select(
        "herfindahl",
        (1 / F.nullif("herfindahl", F.lit(0.0))).alias("effective_n"),
        F.coalesce("max_corr", F.lit(0.0)).alias("max_corr"),
        F.coalesce("avg_corr", F.lit(0.0)).alias("avg_corr"),
        F.coalesce("penalty", F.lit(0.0)).alias("penalty"),
    )


def score_hypotheses(returns: DataFrame, strategy: str, ret: str, hypotheses: dict[str, dict[str, float]]) -> tuple[DataFrame, DataFrame]:
    """Softmax weights of fixed portfolio hypotheses by cumulative return, and the consensus weights.

    Cumulative fitness needs only the total return per strategy, so returns are aggregated before they
    meet the (literal, small) hypotheses. Second table: weighted mean and std per strategy plus the
    effective sample size.
    """
    names = sorted({s for h in hypotheses.values() for s in h})
    entry = lambda h, s: F.struct(F.lit(h).alias("hypothesis"), F.lit(s).alias("strategy"), F.lit(float(hypotheses[h].get(s, 0.0))).alias("w"))
    grid = returns.sparkSession.range(1).select(F.explode(F.array(*[entry(h, s) for h in hypotheses for s in names])).alias("_g")).select("_g.*")
    total = checkpointed(returns.groupBy(F.col(strategy).alias("strategy")).agg(F.sum(ret).alias("_t")))
    fit = grid.join(total, "strategy", "left").groupBy("hypothesis").agg(F.sum(F.col("w") * F.coalesce("_t", F.lit(0.0))).alias("fitness"))
    peak = fit.agg(F.max("fitness").alias("m")).select("m").scalar()
    raw = fit.withColumn("_e", F.exp(F.col("fitness") - peak))
    norm = raw.agg(F.sum("_e").alias("s")).select("s").scalar()
    weights = raw.select("hypothesis", "fitness", (F.col("_e") / norm).alias("weight"))
    ess = weights.agg((1 / F.sum(F.col("weight") ** 2)).alias("e")).select("e").scalar()
    j = grid.join(weights, "hypothesis")
    g = j.groupBy("strategy").agg(F.sum(F.col("weight") * F.col("w")).alias("consensus"), F.sum(F.col("weight") * F.col("w") ** 2).alias("_q"))
    cons = g.select("strategy", "consensus", F.sqrt(F.greatest(F.lit(0.0), F.col("_q") - F.col("consensus") ** 2)).alias("uncertainty"), ess.alias("effective_samples"))
    return weights, cons


# Cost profiles (commission rate, spread bps, slippage base bps, volatility sensitivity,
# size exponent), reference volatility and size.
COST_PROFILES = {
    "binance_spot": (0.001, 1.0, 2.0, 1.0, 0.5),
    "binance_futures": (0.0004, 0.5, 1.5, 1.0, 0.5),
    "bybit_futures": (0.0006, 0.5, 1.5, 1.0, 0.5),
    "hyperliquid": (0.00025, 0.3, 1.0, 0.8, 0.5),
    "generic": (0.001, 2.0, 3.0, 1.5, 0.5),
}
REF_VOLATILITY, REF_SIZE, ANNUAL_VOL, SHARPE_FLOOR = 0.02, 10_000.0, 0.16, -10.0


def transaction_cost(profile: Column, notional: Column, volatility: Column, market_order: Column) -> Column:
    """struct(commission, spread, slippage, total, bps); all 0 for a non-positive notional."""
    table = F.create_map(*[x for k, v in COST_PROFILES.items() for x in (F.lit(k), F.struct(*[F.lit(float(c)).alias(f"c{i}") for i, c in enumerate(v)]))])
    p = F.try_element_at(table, profile)
    n = F.when(notional > 0, notional)
    commission = n * p["c0"]
    spread = F.when(market_order, n * p["c1"] / 10000).otherwise(0.0)
    slip = n * p["c2"] / 10000 * F.pow(volatility / REF_VOLATILITY, p["c3"]) * F.pow(n / REF_SIZE, p["c4"])
    z = lambda c: F.coalesce(c, F.lit(0.0))
    total = commission + spread + slip
    return F.struct(z(commission).alias("commission"), z(F.when(notional > 0, spread)).alias("spread"), z(slip).alias("slippage"), z(total).alias("total"), z(total / n * 10000).alias("bps"))


def net_sharpe(gross: Column, cost_per_trade: Column, trades_per_year: Column, account: float = 100_000.0) -> Column:
    """Sharpe after annual costs over a 16 % volatility, at least -10."""
    return F.greatest(F.lit(SHARPE_FLOOR), gross - cost_per_trade * trades_per_year / F.lit(account) / ANNUAL_VOL)


def breakeven_sharpe(cost_per_trade: Column, trades_per_year: Column, account: float = 100_000.0) -> Column:
    return -net_sharpe(F.lit(0.0), cost_per_trade, trades_per_year, account)


def net_return(gross: Column, notional: Column, total_cost: Column, legs: int = 2) -> Column:
    return gross - F.when(notional > 0, total_cost * legs / F.nullif(notional, F.lit(0.0))).otherwise(0.0)


def cagr(total_return: Column, days: Column) -> Column:
    bad = (days <= 0) | F.isnan(total_return) | (F.abs(total_return) == INF)
    years = F.when(days > 0, days) / 365.0
    return F.when(bad, 0.0).when(total_return <= -1, -1.0).otherwise(F.pow(F.greatest(1 + total_return, F.lit(0.0)), 1 / years) - 1)


def calmar(cagr_: Column, max_dd: Column) -> Column:
    bad = F.isnan(cagr_) | (F.abs(cagr_) == INF) | F.isnan(max_dd) | (F.abs(max_dd) == INF)
    return F.when(bad, 0.0).when(max_dd == 0, F.when(cagr_ <= 0, 0.0).otherwise(INF)).otherwise(cagr_ / F.abs(F.nullif(max_dd, F.lit(0.0))))


def fitness(df, keys, date: str, ret: str, block) -> DataFrame:
    """Per strategy: total return, drawdown, CAGR, Calmar, Sharpe, PSR, win rate, trades."""
    df = checkpointed(df.select(*keys, date, ret))
    cum = checkpointed(cumulative_return(df, keys, [date], ret, block, "_c"))
    dd = drawdown(cum, keys, [date], "_c", block, "_dd")
    g = dd.groupBy(*keys).agg(
        (F.max_by("_c", date) - 1).alias("total_return"),
        F.datediff(F.max(date), F.min(date)).alias("days"),
        F.abs(F.min("_dd")).alias("max_dd"),
        F.avg(F.when(F.col(ret) > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.count("*").alias("trade_count"),
    )
    g = g.join(probabilistic_sharpe(df, keys, ret).select(*keys, "sharpe", "psr"), list(keys))
    g = g.withColumn("cagr", cagr(F.col("total_return"), F.col("days")))
    return g.withColumn("calmar", calmar(F.col("cagr"), F.col("max_dd")))


def sanity_flags(results: DataFrame, keys: Sequence[str], k_sigma: float = 5.0, min_windows: int = 12, sharpe="sharpe", ret="ret", trades="trade_count") -> DataFrame:
    """Long table of issues per strategy: (keys, issue, severity)."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == INF)
    src = results.withColumn("_r", F.when(~bad(ret), F.col(ret)))
    m = src.groupBy(*keys).agg(F.avg("_r").alias("_m"), F.stddev_pop("_r").alias("_s"))
    j = src.join(m, list(keys))
    g = j.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.count_if(F.isnan(ret) | F.isnan(sharpe)).alias("_nan"),
        F.count_if((F.abs(F.col(ret)) == INF) | (F.abs(F.col(sharpe)) == INF)).alias("_inf"),
        F.count_if(F.col(trades) == 0).alias("_zero"),
        F.max("_s").alias("_s"),
        F.count_if(F.abs(F.col("_r") - F.col("_m")) > F.lit(k_sigma) * F.col("_s")).alias("_ext"),
        F.max(sharpe).alias("_best"),
        F.max(ret).alias("_top"),
    )
    flag = lambda cond, name, sev: F.when(cond, F.struct(F.lit(name).alias("issue"), (F.lit(sev) if isinstance(sev, str) else sev).alias("severity")))
    issues = F.array_compact(
        F.array(
            flag(F.col("_nan") > 0, "NAN_VALUES", "error"),
            flag((F.col("_nan") == 0) & (F.col("_inf") > 0), "INF_VALUES", "error"),
            flag(F.col("_zero") > 0, "ZERO_TRADES", F.when(F.col("_zero") / F.col("_n") < 0.25, "warning").otherwise("error")),
            flag((F.col("_n") >= 2) & (F.col("_s") == 0), "ZERO_RETURNS", "warning"),
            flag((F.col("_n") >= 2) & (F.col("_s") > 0) & (F.col("_ext") > 0), "EXTREME_VOLATILITY", "warning"),
            flag(F.col("_best") < 0, "ALL_NEGATIVE_SHARPE", "warning"),
            flag(F.col("_top") < 0, "ALL_LOSSES", "warning"),
            flag(F.col("_n") < min_windows, "INSUFFICIENT_DATA", "error"),
        )
    )
    return g.select(*keys, F.explode(issues).alias("_i")).select(*keys, "_i.*")


def series_flags(daily: DataFrame, keys: Sequence[str], trades: str, years: float = 10.0, per_day: float = 1000.0) -> DataFrame:
    """Long-history and high-frequency notes per strategy (252 rows a year)."""
    g = daily.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(trades).alias("_t"))
    flag = lambda cond, name: F.when(cond, F.lit(name))
    notes = F.array_compact(F.array(flag(F.col("_n") / 252 >= years, "LONG_BACKTEST"), flag(F.col("_t") / F.greatest(F.col("_n"), F.lit(1)) >= per_day, "HIGH_FREQUENCY"), flag(F.col("_t") == 0, "ZERO_TRADES")))
    return g.select(*keys, F.explode(notes).alias("note"))
