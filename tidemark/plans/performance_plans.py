"""Queries for return statistics, validation and costs (STAT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats_expr import norm_cdf_sql, z_value
from ..operators import labels as ml
from ..operators import performance as perf
from ..operators import timeseries as ts
from ..session import checkpointed
from .flow_plans import STRATEGIES, _buckets, _VB, _VP
from .label_plans import DR, SPAN, returns, span, windows_sql
from .registry import TICKS, query, rnd, rounded
from .window_plans import CUM, daily_returns

R = "x AS (SELECT strategy, day, ret FROM dr WHERE ret IS NOT NULL)"
MOM = """m AS (SELECT strategy, count(*) AS n, avg(ret) AS mu, stddev_pop(ret) AS sd FROM x GROUP BY 1),
 mm AS (SELECT strategy, n, mu, sd, mu / sd * sqrt(252) AS sr, (SELECT avg(pow(ret - mu, 3)) FROM x WHERE x.strategy = m.strategy) / pow(sd, 3) AS sk, (SELECT avg(pow(ret - mu, 4)) FROM x WHERE x.strategy = m.strategy) / pow(sd, 4) AS ku FROM m)"""


def _moments(t):
    return perf.moments(daily_returns(t), ["strategy"], "ret")


@query("stat_01_sharpe", f"WITH {DR}, {R} SELECT strategy, {rnd('avg(ret) / stddev_pop(ret) * sqrt(252)')} AS sharpe FROM x GROUP BY 1")
def _(t):
    return daily_returns(t).groupBy("strategy").agg(rounded(perf.sharpe_agg("ret")).alias("sharpe"))


@query("stat_01_sharpe_by_customer", f"WITH x AS (SELECT o_custkey AS k, o_totalprice / 100000 - 2 AS ret FROM orders) SELECT k, {rnd('CASE WHEN count(*) < 2 OR stddev_pop(ret) = 0 THEN 0 ELSE avg(ret) / stddev_pop(ret) * sqrt(252) END')} AS sharpe FROM x GROUP BY 1")
def _(t):
    x = t.orders.select(F.col("o_custkey").alias("k"), (F.col("o_totalprice") / 100000 - 2).alias("ret"))
    return x.groupBy("k").agg(rounded(perf.sharpe_agg("ret")).alias("sharpe"))


@query("stat_02_moments", f"WITH {DR}, {R}, {MOM} SELECT strategy, n, {rnd('mu')} AS mean, {rnd('sd')} AS std, {rnd('sr')} AS sharpe, {rnd('sk')} AS skew, {rnd('ku')} AS kurt FROM mm")
def _(t):
    return _moments(t).select("strategy", "n", *[rounded(c).alias(c) for c in ("mean", "std", "sharpe", "skew", "kurt")])


@query(
    "stat_03_probabilistic_sharpe",
    f"""WITH {DR}, {R}, {MOM}, v AS (SELECT *, (1 + 0.5 * sr * sr - sk * sr + (ku - 3) / 4 * sr * sr) / greatest(n / 252, 0.1) AS v FROM mm),
 z AS (SELECT strategy, n, (sr - 1) / sqrt(CASE WHEN v > 0 THEN v END) AS z FROM v) SELECT strategy, {rnd(f'CASE WHEN n < 10 OR z IS NULL THEN 0.5 ELSE {norm_cdf_sql("z")} END')} AS psr FROM z""",
)
def _(t):
    return perf.probabilistic_sharpe(daily_returns(t), ["strategy"], "ret", benchmark=1.0).select("strategy", rounded("psr").alias("psr"))


PROG = "pg AS (SELECT o_orderkey AS id, o_totalprice / 100000 - 1 AS sharpe, o_custkey % 40 AS trials, o_orderkey % 36 + 1 AS months, (o_custkey % 11 - 5) / 10e0 AS skew, 3 + o_orderkey % 7 / 2e0 AS kurt FROM orders)"


def _programs(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        k.alias("id"),
        (F.col("o_totalprice") / 100000 - 1).alias("sharpe"),
        (c % 40).alias("trials"),
        (k % 36 + 1).alias("months"),
        ((c % 11 - 5) / 10.0).alias("skew"),
        (3 + (k % 7) / 2.0).alias("kurt"),
    )


@query(
    "stat_04_deflated_sharpe",
    f"""WITH {PROG} SELECT id, {rnd('CASE WHEN trials <= 1 THEN sharpe ELSE greatest(0, sharpe - sqrt(2 * ln(greatest(trials, 1)))) END')} AS dsr_extreme,
 {rnd('CASE WHEN trials <= 1 THEN sharpe ELSE sharpe - 0.15 * ln(greatest(trials, 1)) END')} AS dsr_log FROM pg""",
)
def _(t):
    p = _programs(t)
    return p.select("id", rounded(perf.deflated_sharpe_extreme(F.col("sharpe"), F.col("trials"))).alias("dsr_extreme"), rounded(perf.deflated_sharpe_log(F.col("sharpe"), F.col("trials"))).alias("dsr_log"))


@query(
    "stat_05_track_record_and_luck",
    f"""WITH {PROG}, z AS (SELECT *, sharpe / sqrt((1 + sharpe * sharpe / 2) / greatest(months / 12, 0.1)) AS z FROM pg)
 SELECT id, {rnd(f'CASE WHEN sharpe > 0.05 THEN (1 + skew * sharpe + (kurt - 3) * sharpe * sharpe / 4) * pow({z_value(0.95)!r} / sharpe, 2) * 12 END', 4)} AS min_months, {rnd(f'CASE WHEN sharpe <= 0 THEN 1 ELSE least(1, (1 - {norm_cdf_sql("z")}) * trials) END')} AS luck FROM z""",
)
def _(t):
    """Months of records are shown for Sharpe ratios above 0.05 (smaller ones need millions of months)."""
    s = F.col("sharpe")
    months = F.when(s > 0.05, perf.minimum_track_record(s, F.col("skew"), F.col("kurt")))
    return _programs(t).select("id", rounded(months, 4).alias("min_months"), rounded(perf.probability_of_luck(s, F.col("trials"), F.col("months"))).alias("luck"))


WF = f"""{DR}, {SPAN}, {windows_sql(90)}, j AS (SELECT strategy, window_id, day < train_end AS tr, ret, n_orders FROM dr JOIN wn ON (day >= train_start AND day < train_end) OR (day >= test_start AND day < test_end) WHERE ret IS NOT NULL),
 wf AS (SELECT strategy, window_id, coalesce(avg(ret) FILTER (tr) / stddev_pop(ret) FILTER (tr) * sqrt(252), 0) AS train_sharpe, coalesce(avg(ret) FILTER (NOT tr) / stddev_pop(ret) FILTER (NOT tr) * sqrt(252), 0) - 1 AS test_sharpe,
   coalesce(sum(ret) FILTER (NOT tr), 0) - 0.3 AS test_return, coalesce(-min(ret) FILTER (NOT tr), 0) * 20 AS max_drawdown, CAST(sum(n_orders) FILTER (NOT tr) AS BIGINT) AS trade_count FROM j GROUP BY 1, 2)"""


def walk_forward_results(t):
    w = ml.calendar_windows(span(t), "a", "b", after=None)
    j = ml.attach_windows(returns(t), "day", w).withColumns({"_a": F.when(F.col("role") == "train", F.col("ret")), "_b": F.when(F.col("role") == "test", F.col("ret"))})
    return j.groupBy("strategy", "window_id").agg(
        perf.sharpe_agg("_a").alias("train_sharpe"),
        (perf.sharpe_agg("_b") - 1).alias("test_sharpe"),
        (F.coalesce(F.sum("_b"), F.lit(0.0)) - 0.3).alias("test_return"),
        (F.coalesce(-F.min("_b"), F.lit(0.0)) * 20).alias("max_drawdown"),
        F.sum(F.when(F.col("role") == "test", F.col("n_orders"))).alias("trade_count"),
    )


@query(
    "stat_06_overfit_alert",
    f"""WITH {WF} SELECT strategy, window_id, {rnd('CASE WHEN test_sharpe > 0 THEN train_sharpe / test_sharpe WHEN train_sharpe > 0 THEN 999 ELSE 1 END')} AS ratio,
 CASE WHEN test_sharpe <= 0 THEN 'critical' WHEN train_sharpe / test_sharpe >= 2 THEN 'critical' WHEN train_sharpe / test_sharpe >= 1.5 THEN 'warning' ELSE 'none' END AS severity FROM wf""",
)
def _(t):
    a = perf.overfit_alert(F.col("train_sharpe"), F.col("test_sharpe"))
    out = walk_forward_results(t).select("strategy", "window_id", a.alias("_a")).select("strategy", "window_id", "_a.*")
    return out.withColumn("ratio", rounded(F.when(F.col("ratio") == float("inf"), 999.0).otherwise(F.col("ratio"))))


@query(
    "stat_06_overfit_trend",
    f"""WITH {WF}, s AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY window_id) AS seq, CASE WHEN test_sharpe > 0 THEN train_sharpe / test_sharpe END AS r FROM wf),
 a AS (SELECT strategy, window_id, seq, coalesce(avg(r) OVER (PARTITION BY strategy ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 'inf') AS rc, CASE WHEN seq >= 10 THEN coalesce(avg(r) OVER (PARTITION BY strategy ORDER BY seq ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING), 'inf')
   ELSE coalesce(avg(CASE WHEN seq <= 5 THEN r END) OVER (PARTITION BY strategy ORDER BY seq), 'inf') END AS ea FROM s)
 SELECT strategy, window_id, CASE WHEN seq < 5 THEN 'insufficient_data' WHEN rc < ea * 0.9 THEN 'improving' WHEN rc > ea * 1.1 THEN 'deteriorating' ELSE 'stable' END AS trend FROM a""",
)
def _(t):
    return perf.overfit_trend(checkpointed(walk_forward_results(t)), ["strategy"], ["window_id"], "train_sharpe", "test_sharpe", 1000).select("strategy", "window_id", "trend")


ROB = """g AS (SELECT strategy, count(*) AS n, avg(abs(test_return)) AS ma, stddev_samp(test_return) AS sd, avg(CASE WHEN test_return > 0 THEN 1e0 ELSE 0 END) AS pp,
   avg(CASE WHEN train_sharpe <= 0 THEN CASE WHEN test_sharpe > 0 THEN 1e0 WHEN test_sharpe < train_sharpe THEN 0 ELSE 0.5 END ELSE greatest(0, least(1, test_sharpe / train_sharpe)) END) AS dg, max(max_drawdown) AS wd, count(*) FILTER (test_sharpe >= 0.5) AS ok FROM wf GROUP BY 1),
 rb AS (SELECT *, CASE WHEN n = 1 THEN CASE WHEN pp > 0 THEN 40e0 ELSE 0 END ELSE (CASE WHEN ma < 1e-10 THEN 1 ELSE greatest(0, 1 - least(sd / ma, 1)) END * 0.3 + pp * 0.4 + dg * 0.3) * 100 END AS rob FROM g)"""


@query("stat_07_robustness", f"WITH {WF}, {ROB} SELECT strategy, n AS n_windows, {rnd('pp')} AS profitable_pct, {rnd('dg')} AS degradation, {rnd('rob')} AS robustness FROM rb")
def _(t):
    out = perf.robustness(walk_forward_results(t), ["strategy"])
    return out.select("strategy", "n_windows", *[rounded(c).alias(c) for c in ("profitable_pct", "degradation", "robustness")])


@query(
    "stat_08_permutation_overfit",
    f"""WITH {WF}, d AS (SELECT strategy, window_id, CASE WHEN train_sharpe > 1e-10 THEN test_sharpe / train_sharpe WHEN train_sharpe < -1e-10 THEN CASE WHEN test_sharpe < -1e-10 THEN train_sharpe / test_sharpe ELSE 0 END WHEN test_sharpe >= 0 THEN 1 ELSE 0 END AS d FROM wf),
 p AS (SELECT *, unnest(range(1, 101)) AS perm FROM d),
 r AS (SELECT *, row_number() OVER (PARTITION BY strategy, perm ORDER BY CAST('0x' || substr(md5('0:' || perm || ':' || window_id), 1, 8) AS UBIGINT), window_id) AS rk, count(*) OVER (PARTITION BY strategy, perm) AS n FROM p),
 h AS (SELECT strategy, perm, avg(d) FILTER (rk <= greatest(1, n // 2)) AS a, avg(d) FILTER (rk > greatest(1, n // 2)) AS b FROM r GROUP BY 1, 2)
 SELECT strategy, {rnd('avg(CASE WHEN a < 0.5 OR b < 0.5 THEN 1 ELSE 0 END)')} AS pbo FROM h GROUP BY 1""",
)
def _(t):
    return perf.permutation_overfit_probability(walk_forward_results(t), ["strategy"], "window_id").withColumn("pbo", rounded("pbo"))


@query(
    "stat_08_degradation_overfit",
    f"""WITH {DR}, {R}, g AS (SELECT strategy, avg(ret) FILTER (day < '1998-01-01') / stddev_pop(ret) FILTER (day < '1998-01-01') * sqrt(252) AS i, avg(ret) FILTER (day >= '1998-01-01') / stddev_pop(ret) FILTER (day >= '1998-01-01') * sqrt(252) AS o FROM x GROUP BY 1)
 SELECT strategy, {rnd('i')} AS is_sharpe, {rnd('o')} AS oos_sharpe, {rnd('CASE WHEN i <= 0 THEN 0.5 ELSE least(1, greatest(0, 1 - o / i)) END')} AS pbo FROM g""",
)
def _(t):
    out = perf.degradation_overfit_probability(daily_returns(t), ["strategy"], "ret", F.col("day") < F.lit("1998-01-01").cast("date"))
    return out.select("strategy", *[rounded(c).alias(c) for c in ("is_sharpe", "oos_sharpe", "pbo")])


CT = f"""{WF}, ct AS (SELECT strategy AS contender, window_id, test_sharpe AS sharpe, test_return AS ret, max_drawdown AS drawdown, trade_count FROM wf)"""


def _contenders(t):
    return walk_forward_results(t).select(F.col("strategy").alias("contender"), "window_id", F.col("test_sharpe").alias("sharpe"), F.col("test_return").alias("ret"), F.col("max_drawdown").alias("drawdown"), "trade_count")


CM = """cm AS (SELECT contender, avg(sharpe) AS avg_sharpe, stddev_samp(sharpe) AS std_sharpe, avg(ret) AS avg_return, stddev_samp(ret) AS std_return, avg(drawdown) AS avg_drawdown, max(drawdown) AS max_drawdown,
 avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS win_rate, CAST(sum(trade_count) AS BIGINT) AS total_trades, count(*) AS window_count FROM ct GROUP BY 1)"""
_CMC = ("avg_sharpe", "std_sharpe", "avg_return", "std_return", "avg_drawdown", "max_drawdown", "win_rate")


@query("stat_09_contender_metrics", f"WITH {CT}, {CM} SELECT contender, {', '.join(f'{rnd(c)} AS {c}' for c in _CMC)}, total_trades, window_count, row_number() OVER (ORDER BY avg_sharpe DESC, contender) AS rank FROM cm")
def _(t):
    return perf.contender_metrics(_contenders(t)).withColumns({c: rounded(c) for c in _CMC})


_PV = f"CASE WHEN se < 1e-10 THEN CASE WHEN abs(md) < 1e-10 THEN 1 ELSE 0 END ELSE greatest(0, least(1, 2 * (1 - {norm_cdf_sql('z')}))) END"
PAIR = f"""pr AS (SELECT a.contender AS a, b.contender AS b, count(*) AS n, avg(a.ret - b.ret) AS md, stddev_samp(a.ret - b.ret) / sqrt(count(*)) AS se, count(*) FILTER (a.ret > b.ret) AS wins, count(*) FILTER (a.ret < b.ret) AS losses,
  avg(a.sharpe) - avg(b.sharpe) AS sd, avg(b.sharpe) AS sb, avg(a.drawdown) AS da, avg(b.drawdown) AS db FROM ct a JOIN ct b ON a.window_id = b.window_id AND a.contender < b.contender GROUP BY 1, 2),
 pz AS (SELECT *, md / se AS t, abs(md / se) / CASE WHEN n - 1 >= 30 THEN 1 ELSE 1 + 3 / (n - 1) END AS z FROM pr), pp AS (SELECT *, {_PV} AS p FROM pz)"""


@query(
    "stat_09_pairwise_comparison",
    f"""WITH {CT}, {PAIR} SELECT a, b, n, {rnd('sd')} AS sharpe_difference, {rnd('CASE WHEN abs(sb) > 1e-10 THEN sd / abs(sb) * 100 ELSE 0 END', 4)} AS sharpe_difference_pct, {rnd('wins / losses')} AS win_loss_ratio, {rnd('CASE WHEN db > 1e-10 THEN da / db ELSE 1 END')} AS relative_drawdown,
 {rnd('t')} AS t_statistic, {rnd('p')} AS p_value, p < 0.05 AS significant, p < 0.05 AND sd > 0.2 AND t > 0 AS a_beats_b FROM pp""",
)
def _(t):
    out = perf.compare_contenders(_contenders(t))
    out = out.withColumn("sharpe_difference_pct", rounded("sharpe_difference_pct", 4))
    return out.withColumns({c: rounded(c) for c in ("sharpe_difference", "win_loss_ratio", "relative_drawdown", "t_statistic", "p_value")})


@query(
    "stat_09_verdict",
    f"""WITH {CT}, {CM}, {PAIR} SELECT pp.a, pp.b, CASE WHEN y.avg_sharpe > x.avg_sharpe THEN 'STOP' WHEN x.avg_sharpe - y.avg_sharpe < 0.2 THEN 'WAIT' WHEN y.max_drawdown > 0 AND x.max_drawdown / y.max_drawdown > 1.5 THEN 'WAIT' ELSE 'GO' END AS verdict,
 {rnd('least(1, greatest(0, least(x.window_count / 20, 1) * 0.4 + greatest(0, 1 - p * 2) * 0.4 + greatest(0, 1 - abs(x.std_sharpe / x.avg_sharpe)) * 0.2))')} AS confidence FROM pp JOIN cm x ON pp.a = x.contender JOIN cm y ON pp.b = y.contender""",
)
def _(t):
    c = checkpointed(_contenders(t))
    m = perf.contender_metrics(c)
    p = perf.compare_contenders(c).select("a", "b", "p_value")
    j = p.join(m.select(F.col("contender").alias("a"), F.col("avg_sharpe").alias("sa"), F.col("std_sharpe").alias("ss"), F.col("max_drawdown").alias("da"), "window_count"), "a")
    j = j.join(m.select(F.col("contender").alias("b"), F.col("avg_sharpe").alias("sb"), F.col("max_drawdown").alias("db")), "b")
    v = perf.verdict(F.col("sa"), F.col("sb"), F.col("da"), F.col("db"))
    return j.select("a", "b", v.alias("verdict"), rounded(perf.verdict_confidence(F.col("window_count"), F.col("sa"), F.col("ss"), F.col("p_value"))).alias("confidence"))


@query(
    "join_10_all_pairs",
    f"WITH {CT} SELECT a.contender AS a, b.contender AS b, count(*) AS n FROM ct a JOIN ct b ON a.window_id = b.window_id AND a.contender < b.contender GROUP BY 1, 2",
)
def _(t):
    return perf.compare_contenders(_contenders(t)).select("a", "b", "n")


_VV = f"""WITH {TICKS}, {_VB}, {_VP}, c AS (SELECT symbol, bucket, end_us, vpin, row_number() OVER (PARTITION BY symbol ORDER BY bucket) AS seq FROM vp),
 hb AS (SELECT symbol, (us // 3600000000 + 1) * 3600000000 AS close_us, round(stddev_samp(price), 9) AS vol FROM ticks GROUP BY symbol, us // 3600000000),
 al AS (SELECT hb.symbol, hb.close_us, hb.vol, round(c.vpin, 9) AS vpin FROM hb ASOF JOIN c ON hb.symbol = c.symbol AND hb.close_us >= c.end_us WHERE vol IS NOT NULL AND c.vpin > 0)"""


def _aligned(t):
    """Hourly volatility with the newest VPIN known at the end of the hour."""
    from ..operators.orderflow import vpin
    v = vpin(_buckets(t), ["symbol"]).select("symbol", F.unix_micros("end_ts").alias("close_us"), "vpin", "bucket")
    v = checkpointed(v).groupBy("symbol", "close_us").agg(F.round(F.max_by("vpin", "bucket"), 9).alias("vpin"))
    h = t.ticks.groupBy("symbol", ((F.floor(F.col("us") / 3600000000) + 1) * 3600000000).alias("close_us")).agg(F.round(F.stddev_samp("price"), 9).alias("vol"))
    return ts.asof_join(h, v, ["symbol"], "close_us", ["vpin"], "1 day").where("vol is not null and vpin > 0")


@query(
    "stat_10_vpin_volatility_correlation",
    f"""{_VV}, r AS (SELECT vpin, vol, rank() OVER (ORDER BY vpin) + (count(*) OVER (PARTITION BY vpin) - 1) / 2 AS rx, rank() OVER (ORDER BY vol) + (count(*) OVER (PARTITION BY vol) - 1) / 2 AS ry FROM al)
 SELECT count(*) AS n, {rnd('corr(vpin, vol)')} AS pearson, {rnd('corr(rx, ry)')} AS spearman FROM r""",
)
def _(t):
    out = perf.correlations(_aligned(t), "vpin", "vol", 0.01, 5.0)
    return out.withColumns({c: rounded(c) for c in ("pearson", "spearman")})


@query(
    "stat_10_lead_correlations",
    f"""{_VV}, q AS (SELECT vpin, {', '.join(f'lead(vol, {k}) OVER w AS y{k}' for k in (1, 2, 3, 6, 12))} FROM al WINDOW w AS (PARTITION BY symbol ORDER BY close_us))
 SELECT {', '.join(f"{rnd(f'corr(vpin, y{k})')} AS lag_{k}" for k in (1, 2, 3, 6, 12))} FROM q""",
)
def _(t):
    out = perf.lead_correlations(_aligned(t), ["symbol"], ["close_us"], "vpin", "vol", "1 week", rows=100)
    return out.select(*[rounded(c).alias(c) for c in out.columns])


_CORR = f"""{DR}, {R}, s AS (SELECT strategy, ret, row_number() OVER (PARTITION BY strategy ORDER BY day) AS seq FROM x), mn AS (SELECT min(n) AS n FROM (SELECT max(seq) AS n FROM s GROUP BY strategy)),
 cr AS (SELECT a.strategy AS a, b.strategy AS b, corr(a.ret, b.ret) AS corr FROM s a JOIN s b ON a.seq = b.seq AND a.strategy <= b.strategy, mn WHERE a.seq <= mn.n GROUP BY 1, 2)"""


def _corr(t):
    from ..operators.blocks import with_seq

    s = with_seq(checkpointed(daily_returns(t)), ["strategy"], ["day"], "52 weeks")
    return checkpointed(perf.correlation_matrix(s, "strategy", "seq", "ret"))


@query("stat_11_correlation_matrix", f"WITH {_CORR} SELECT a, b, {rnd('corr')} AS corr FROM cr")
def _(t):
    return _corr(t).withColumn("corr", rounded("corr"))


@query(
    "stat_12_ensemble_selection",
    f"""WITH RECURSIVE {_CORR}, c AS (SELECT strategy, avg(ret) / stddev_pop(ret) * sqrt(252) AS sharpe FROM x GROUP BY 1),
 m AS (SELECT map_from_entries(list({{'k': a || '|' || b, 'v': rho}})) AS m FROM (SELECT a, b, abs(corr) AS rho FROM cr UNION SELECT b, a, abs(corr) FROM cr)),
 r AS (SELECT 0 AS rank, []::VARCHAR[] AS names, NULL::VARCHAR AS strategy, NULL::DOUBLE AS sharpe, NULL::DOUBLE AS max_corr
  UNION ALL
  SELECT rank + 1, list_append(names, strategy), strategy, sharpe, worst FROM (
   SELECT r.rank, r.names, c.strategy, c.sharpe, coalesce(list_max(list_transform(r.names, lambda n: coalesce(m.m[c.strategy || '|' || n], 0))), 0) AS worst
   FROM r, c, m WHERE r.rank < 3 AND c.sharpe >= 0 AND NOT list_contains(r.names, c.strategy))
  WHERE worst <= 0.02 QUALIFY row_number() OVER (ORDER BY sharpe DESC, strategy DESC) = 1)
 SELECT strategy, {rnd('sharpe')} AS sharpe, {rnd('max_corr')} AS max_corr, rank, {rnd('1e0 / (SELECT max(rank) FROM r)')} AS weight FROM r WHERE rank > 0""",
)
def _(t):
    """Greedy choice in rounds."""
    sh = daily_returns(t).groupBy("strategy").agg(perf.sharpe_agg("ret").alias("sharpe"))
    out = perf.select_ensemble(sh, _corr(t), n_select=3, max_corr=0.02)
    return out.withColumns({"sharpe": rounded("sharpe"), "max_corr": rounded("max_corr"), "weight": rounded("weight")})


@query(
    "stat_12_ensemble_summary",
    f"""WITH {_CORR}, p AS (SELECT strategy, avg(ret) / stddev_pop(ret) * sqrt(252) AS sharpe FROM x GROUP BY 1), v AS (SELECT sum(CASE WHEN a = b THEN 1 ELSE 2 * corr END) AS v FROM cr)
 SELECT count(*) AS n, {rnd('avg(sharpe) / (sqrt(max(v.v)) / count(*))')} AS portfolio_sharpe, {rnd('sum(sharpe) / (avg(sharpe) / (sqrt(max(v.v)) / count(*)))')} AS diversification_ratio FROM p, v""",
)
def _(t):
    sh = daily_returns(t).groupBy("strategy").agg(perf.sharpe_agg("ret").alias("sharpe"))
    out = perf.ensemble_summary(sh, _corr(t))
    return out.withColumns({c: rounded(c) for c in ("portfolio_sharpe", "diversification_ratio")})


@query(
    "stat_13_concentration",
    f"""WITH {_CORR}, w AS (SELECT o_orderpriority AS s, sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders) AS w FROM orders GROUP BY 1), o AS (SELECT * FROM cr WHERE a <> b)
 SELECT {rnd('(SELECT sum(w * w) FROM w)')} AS herfindahl, {rnd('1 / (SELECT sum(w * w) FROM w)')} AS effective_n, {rnd('max(abs(corr))')} AS max_corr, {rnd('avg(corr)')} AS avg_corr,
  {rnd('sum(2 * wa.w * wb.w * corr)')} AS penalty FROM o JOIN w wa ON wa.s = o.a JOIN w wb ON wb.s = o.b""",
)
def _(t):
    w = t.orders.groupBy(F.col("o_orderpriority").alias("strategy")).agg(F.sum("o_totalprice").alias("weight"))
    out = perf.concentration(w, _corr(t))
    return out.select(*[rounded(c).alias(c) for c in out.columns])


HYP = {
    "equal": dict.fromkeys(STRATEGIES, 0.2),
    "urgent": {"1-URGENT": 0.7, "2-HIGH": 0.3},
    "slow": {"4-NOT SPECIFIED": 0.5, "5-LOW": 0.5},
    "barbell": {"1-URGENT": 0.5, "5-LOW": 0.5},
}
_HYP = f"""{DR}, {R}, g AS (SELECT * FROM (VALUES {', '.join(f"('{h}', '{s}', {float(HYP[h].get(s, 0))}e0)" for h in HYP for s in STRATEGIES)}) v(hypothesis, strategy, w)),
 t AS (SELECT strategy, sum(ret) AS t FROM x GROUP BY 1), f AS (SELECT hypothesis, sum(w * t) AS fitness FROM g JOIN t USING (strategy) GROUP BY 1),
 hw AS (SELECT hypothesis, fitness, exp(fitness - max(fitness) OVER ()) / sum(exp(fitness - (SELECT max(fitness) FROM f))) OVER () AS weight FROM f)"""


@query("stat_14_hypothesis_weights", f"WITH {_HYP} SELECT hypothesis, {rnd('fitness')} AS fitness, {rnd('weight')} AS weight FROM hw")
def _(t):
    w, _c = perf.score_hypotheses(daily_returns(t), "strategy", "ret", HYP)
    return w.withColumns({"fitness": rounded("fitness"), "weight": rounded("weight")})


@query(
    "stat_14_consensus",
    f"""WITH {_HYP} SELECT strategy, {rnd('sum(weight * w)')} AS consensus, {rnd('sqrt(greatest(0, sum(weight * w * w) - pow(sum(weight * w), 2)))', 5)} AS uncertainty, {rnd('(SELECT 1 / sum(weight * weight) FROM hw)')} AS effective_samples FROM g JOIN hw USING (hypothesis) GROUP BY 1""",
)
def _(t):
    _w, c = perf.score_hypotheses(daily_returns(t), "strategy", "ret", HYP)
    return c.withColumns({"consensus": rounded("consensus"), "uncertainty": rounded("uncertainty", 5), "effective_samples": rounded("effective_samples")})


_PROFILES = ", ".join(f"('{k}', {', '.join(f'{float(x)}e0' for x in v)})" for k, v in perf.COST_PROFILES.items())
_PNAMES = list(perf.COST_PROFILES)
COST = f"""pf AS (SELECT * FROM (VALUES {_PROFILES}) v(profile, c0, c1, c2, c3, c4)),
 td AS (SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice AS notional, 0.01 + l_discount AS vol, l_returnflag <> 'N' AS mkt, {_PNAMES}[l_suppkey % 5 + 1] AS profile FROM lineitem),
 cs AS (SELECT td.*, notional * c0 AS commission, CASE WHEN mkt THEN notional * c1 / 10000 ELSE 0 END AS spread, notional * c2 / 10000 * pow(vol / 0.02, c3) * pow(notional / 10000, c4) AS slippage FROM td JOIN pf USING (profile))"""


def _trades(t):
    prof = F.element_at(F.array(*[F.lit(n) for n in _PNAMES]), (F.col("l_suppkey") % 5 + 1).cast("int"))
    c = perf.transaction_cost(prof, F.col("l_extendedprice"), 0.01 + F.col("l_discount"), F.col("l_returnflag") != "N")
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_extendedprice").alias("notional"), c.alias("c")).select("l_orderkey", "l_partkey", "l_linenumber", "notional", "c.*")


@query(
    "stat_15_transaction_cost",
    f"WITH {COST} SELECT l_orderkey, l_partkey, l_linenumber, {rnd('commission')} AS commission, {rnd('spread')} AS spread, {rnd('slippage', 5)} AS slippage, {rnd('(commission + spread + slippage) / notional * 10000')} AS bps, {rnd('0.02 - (commission + spread + slippage) * 2 / notional')} AS net_return FROM cs",
)
def _(t):
    out = _trades(t).withColumn("net_return", perf.net_return(F.lit(0.02), F.col("notional"), F.col("total")))
    return out.select("l_orderkey", "l_partkey", "l_linenumber", rounded("commission").alias("commission"), rounded("spread").alias("spread"), rounded("slippage", 5).alias("slippage"), rounded("bps").alias("bps"), rounded("net_return").alias("net_return"))


@query(
    "stat_15_net_sharpe",
    f"""WITH {COST}, a AS (SELECT l_partkey, avg(commission + spread + slippage) AS c, count(*) AS n FROM cs GROUP BY 1)
 SELECT l_partkey, {rnd('greatest(-10, 1.5 - c * n / 100000 / 0.16)')} AS net_sharpe, {rnd('-greatest(-10, 0 - c * n / 100000 / 0.16)')} AS breakeven FROM a""",
)
def _(t):
    a = _trades(t).groupBy("l_partkey").agg(F.avg("total").alias("c"), F.count("*").alias("n"))
    return a.select("l_partkey", rounded(perf.net_sharpe(F.lit(1.5), F.col("c"), F.col("n"))).alias("net_sharpe"), rounded(perf.breakeven_sharpe(F.col("c"), F.col("n"))).alias("breakeven"))


@query(
    "stat_16_fitness",
    f"""WITH {CUM}, d AS (SELECT strategy, day, ret, cum, cum / max(cum) OVER (PARTITION BY strategy ORDER BY day) - 1 AS dd FROM cu),
 g AS (SELECT strategy, ln(arg_max(cum, day)) AS lt, max(day) - min(day) AS days, -min(dd) AS mdd, avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS wr, count(*) AS n FROM d GROUP BY 1)
 SELECT strategy, {rnd('lt')} AS log_total, CAST(days AS INT) AS days, {rnd('mdd')} AS max_dd, {rnd('wr')} AS win_rate, n AS trade_count, {rnd('exp(lt * 365 / days) - 1')} AS cagr, {rnd('(exp(lt * 365 / days) - 1) / mdd', 4)} AS calmar FROM g""",
)
def _(t):
    out = perf.fitness(daily_returns(t), ["strategy"], "day", "ret", "52 weeks")
    return out.select("strategy", rounded(F.log(1 + F.col("total_return"))).alias("log_total"), "days", *[rounded(c).alias(c) for c in ("max_dd", "win_rate", "cagr")], "trade_count", rounded("calmar", 4).alias("calmar"))


_SF = """r AS (SELECT o_custkey AS k, o_totalprice / 100000 - 2 AS ret, CASE WHEN o_orderkey % 301 = 0 THEN 'nan'::DOUBLE WHEN o_orderkey % 401 = 0 THEN 'inf'::DOUBLE ELSE 2.5 - o_totalprice / 100000 END AS sharpe, o_orderkey % 6 AS trade_count FROM orders),
 m AS (SELECT k, avg(ret) AS mu, stddev_pop(ret) AS sd FROM r GROUP BY 1),
 g AS (SELECT k, count(*) AS n, count(*) FILTER (isnan(sharpe)) AS nn, count(*) FILTER (isinf(sharpe)) AS ni, count(*) FILTER (trade_count = 0) AS nz, max(sd) AS sd, count(*) FILTER (abs(ret - mu) > 2 * sd) AS nx, max(sharpe) AS best, max(ret) AS top FROM r JOIN m USING (k) GROUP BY 1)"""


@query(
    "stat_17_sanity_flags",
    f"""WITH {_SF} SELECT k, 'NAN_VALUES' AS issue, 'error' AS severity FROM g WHERE nn > 0 UNION ALL SELECT k, 'INF_VALUES', 'error' FROM g WHERE nn = 0 AND ni > 0
 UNION ALL SELECT k, 'ZERO_TRADES', CASE WHEN nz / n < 0.25 THEN 'warning' ELSE 'error' END FROM g WHERE nz > 0 UNION ALL SELECT k, 'ZERO_RETURNS', 'warning' FROM g WHERE n >= 2 AND sd = 0
 UNION ALL SELECT k, 'EXTREME_VOLATILITY', 'warning' FROM g WHERE n >= 2 AND sd > 0 AND nx > 0 UNION ALL SELECT k, 'ALL_NEGATIVE_SHARPE', 'warning' FROM g WHERE best < 0
 UNION ALL SELECT k, 'ALL_LOSSES', 'warning' FROM g WHERE top < 0 UNION ALL SELECT k, 'INSUFFICIENT_DATA', 'error' FROM g WHERE n < 12""",
)
def _(t):
    k = F.col("o_orderkey")
    sharpe = F.when(k % 301 == 0, float("nan")).when(k % 401 == 0, float("inf")).otherwise(2.5 - F.col("o_totalprice") / 100000)
    r = t.orders.select(F.col("o_custkey").alias("k"), (F.col("o_totalprice") / 100000 - 2).alias("ret"), sharpe.alias("sharpe"), (k % 6).alias("trade_count"))
    return perf.sanity_flags(r, ["k"], k_sigma=2.0)


@query(
    "stat_17_series_flags",
    f"""WITH {DR}, g AS (SELECT strategy, count(*) AS n, sum(n_orders) AS t FROM dr GROUP BY 1) SELECT strategy, 'LONG_BACKTEST' AS note FROM g WHERE n / 252 >= 5 UNION ALL SELECT strategy, 'HIGH_FREQUENCY' FROM g WHERE t / n >= 1.5""",
)
def _(t):
    return perf.series_flags(t.daily, ["strategy"], "n_orders", years=5.0, per_day=1.5)


@query(
    "stat_18_walk_forward_gate",
    f"""WITH {WF}, {ROB} SELECT strategy, {rnd('rob')} AS robustness, {rnd('pp')} AS profitable_pct, n AS n_windows, {rnd('wd')} AS worst_drawdown, n >= 4 AND rob >= 60 AND pp >= 0.75 AND wd <= 0.3 AND ok > n / 2 AS passed FROM rb""",
)
def _(t):
    out = perf.gate(walk_forward_results(t), ["strategy"])
    return out.withColumns({c: rounded(c) for c in ("robustness", "profitable_pct", "worst_drawdown")})




@query(
    "fn_normal_and_t_tails",
    f"""WITH x AS (SELECT event_id, value / 60 - 2 AS z, 1 + user_id % 40 AS df, (event_id % 997 + 1) / 999e0 AS p FROM events), q AS (SELECT *, least(p, 1 - p) AS m, abs(z) / CASE WHEN df >= 30 THEN 1 ELSE 1 + 3 / df END AS tz FROM x), s AS (SELECT *, sqrt(-2 * ln(m)) AS t FROM q),
 n AS (SELECT *, t - ((0.010328 * t + 0.802853) * t + 2.515517) / (((0.001308 * t + 0.189269) * t + 1.432788) * t + 1) AS w FROM s)
 SELECT event_id, {rnd(norm_cdf_sql('z'), 9)} AS cdf, {rnd('CASE WHEN abs(p - 0.5) < 1e-10 THEN 0 WHEN p > 0.5 THEN w ELSE -w END', 9)} AS ppf, {rnd(f"greatest(0, least(1, 2 * (1 - {norm_cdf_sql('tz')})))", 9)} AS p_two_sided FROM n""",
)
def _(t):
    from ..functions.stats_expr import norm_cdf, norm_ppf, t_two_sided

    x = t.events.select("event_id", (F.col("value") / 60 - 2).alias("z"), (1 + F.col("user_id") % 40).alias("df"), ((F.col("event_id") % 997 + 1) / 999.0).alias("p"))
    return x.select(
        "event_id", rounded(norm_cdf(F.col("z")), 9).alias("cdf"), rounded(norm_ppf(F.col("p")), 9).alias("ppf"), rounded(t_two_sided(F.col("z"), F.col("df")), 9).alias("p_two_sided")
    )
