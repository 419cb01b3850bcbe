"""Queries for aggregates, percentiles and data quality (AGG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import sketches as sk
from ..session import stored
from .registry import TICKS, query, rnd, rounded


@query(
    "agg_01_count_by_type",
    "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS synced, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1",
)
def _(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("synced"), F.max(F.unix_micros("ts")).alias("last_us")).orderBy(F.desc("n"))


@query("agg_02_conditional_rate", f"SELECT user_id, {rnd('100.0e0 * count(*) FILTER (event_type = ' + chr(39) + 'error' + chr(39) + ') / count(*)')} AS error_pct FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(rounded(agg.rate(F.col("event_type") == "error")).alias("error_pct"))


@query(
    "agg_03_having_guard",
    f"SELECT user_id, event_type, count(*) AS n, {rnd('avg(value)')} AS mean FROM events GROUP BY 1, 2 HAVING count(*) >= 15",
)
def _(t):
    return agg.guarded(t.events, ["user_id", "event_type"], 15, rounded(F.avg("value")).alias("mean"))


@query("agg_04_count_distinct", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS sessions, count(DISTINCT l_suppkey) AS strategies FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("sessions"), F.countDistinct("l_suppkey").alias("strategies"))


@query(
    "agg_05_exact_percentiles",
    f"""SELECT l_returnflag AS venue, count(*) AS n, {rnd('quantile_cont(l_extendedprice, 0.5)')} AS p50, {rnd('quantile_cont(l_extendedprice, 0.95)')} AS p95,
 {rnd('quantile_cont(l_extendedprice, 0.99)')} AS p99 FROM lineitem GROUP BY 1""",
)
def _(t):
    src = t.lineitem.select(F.col("l_returnflag").alias("venue"), "l_extendedprice")
    out = agg.exact_percentiles(src, ["venue"], "l_extendedprice", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, 2000.0)
    return out.select("venue", "n", *[rounded(c).alias(c) for c in ("p50", "p95", "p99")])


@query(
    "agg_06_approx_percentile_per_hour",
    f"""WITH {TICKS} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, quantile_disc(price, 0.5) AS p50, quantile_disc(price, 0.95) AS p95, quantile_disc(price, 0.99) AS p99 FROM ticks GROUP BY 1""",
)
def _(t):
    """Exact while a bucket has fewer than 1 / accuracy distinct values, bounded-error sketch beyond."""
    g = t.ticks.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"))
    return g.agg(*[F.percentile_approx("price", q, 100000).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


_QS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _trade_hours(t):
    """One stored sketch row per hour and symbol: distinct traders and order ids, price quantiles."""
    ticks = t.ticks.withColumn("hour", F.date_trunc("hour", "ts"))
    return stored(sk.sketch(ticks, ["hour", "symbol"], ["trader", "event_id"], ["price"]), "hourly-sketches")


@query("agg_04_distinct_from_sketches")
def _(t):
    """Distinct traders and events per symbol, answered from the hourly rows alone."""
    return sk.answers(sk.merge(_trade_hours(t).drop("kll_price"), ["symbol"]))


@query("agg_06_daily_percentiles_from_sketches")
def _(t):
    """Price percentiles per day, answered from the hourly rows alone."""
    hours = _trade_hours(t).drop("hll_trader", "hll_event_id").withColumn("day", F.date_format("hour", "yyyy-MM-dd"))
    return sk.answers(sk.merge(hours, ["day"]), _QS)


@query(
    "agg_06_sketch_error_bounds",
    f"""WITH {TICKS} SELECT symbol, count(*) AS n, count(DISTINCT trader) AS exact_trader, count(DISTINCT event_id) AS exact_event_id, true AS distinct_ok, true AS quantiles_ok
 FROM ticks GROUP BY 1""",
)
def _(t):
    """The answers from the hourly rows held against the rows themselves: all within the sketches' error bounds."""
    found = sk.answers(sk.merge(_trade_hours(t), ["symbol"]), _QS)
    return sk.within_bounds(t.ticks, found, ["symbol"], ["trader", "event_id"], ["price"], _QS)


@query("agg_07_counter_span", f"WITH {TICKS} SELECT trader, max(us) - min(us) AS span_us, max(event_id) - min(event_id) AS messages FROM ticks GROUP BY 1")
def _(t):
    return t.ticks.groupBy("trader").agg(agg.counter_span("us", "span_us"), agg.counter_span("event_id", "messages"))


@query(
    "agg_08_breakdown_by_year",
    f"""SELECT year(o_orderdate) AS year, count(*) AS n, count(DISTINCT o_orderpriority) AS methods, {rnd('avg(o_totalprice)', 4)} AS mean,
 count(*) FILTER (o_orderstatus = 'F') AS validated FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1""",
)
def _(t):
    g = t.orders.where("o_orderdate is not null").groupBy(F.year("o_orderdate").cast("long").alias("year"))
    return g.agg(
        F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("methods"), rounded(F.avg("o_totalprice"), 4).alias("mean"), F.count_if(F.col("o_orderstatus") == "F").alias("validated")
    )


@query(
    "agg_08_methodology_breakdown",
    f"""SELECT s_nationkey % 5 AS methodology, count(DISTINCT s_suppkey) AS strategies, {rnd('avg(l_discount)')} AS avg_sharpe, {rnd('avg(l_tax)')} AS avg_drawdown
 FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1""",
)
def _(t):
    j = t.supplier.join(t.lineitem, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return j.groupBy((F.col("s_nationkey") % 5).alias("methodology")).agg(
        F.countDistinct("s_suppkey").alias("strategies"), rounded(F.avg("l_discount")).alias("avg_sharpe"), rounded(F.avg("l_tax")).alias("avg_drawdown")
    )


@query(
    "agg_09_gap_summary",
    f"""WITH {TICKS}, g AS (SELECT symbol, trader % 3 AS venue, (us - lag(us) OVER (PARTITION BY symbol ORDER BY ts, event_id)) / 1e6 AS gap FROM ticks)
 SELECT symbol, venue, count(*) AS gap_count, {rnd('avg(gap)', 3)} AS avg_gap, {rnd('max(gap)')} AS max_gap, {rnd('sum(gap)', 3)} AS total_gap FROM g WHERE gap > 1800 GROUP BY 1, 2""",
)
def _(t):
    from ..operators.windows import counter_delta

    g = counter_delta(t.ticks, ["symbol"], ["ts", "event_id"], "us", "1 day", "d").withColumn("gap", F.col("d") / 1e6).where("gap > 1800")
    return g.groupBy("symbol", (F.col("trader") % 3).alias("venue")).agg(
        F.count("*").alias("gap_count"), rounded(F.avg("gap"), 3).alias("avg_gap"), rounded(F.max("gap")).alias("max_gap"), rounded(F.sum("gap"), 3).alias("total_gap")
    )


@query(
    "agg_10_session_rollup",
    f"""WITH {TICKS} SELECT trader, CAST(CAST(ts AS DATE) AS VARCHAR) AS session, count(*) AS n, max(volume) AS max_iteration, max(price) AS max_cost, min(us) AS start_us, max(us) AS end_us
 FROM ticks GROUP BY 1, 2 ORDER BY end_us DESC LIMIT 100""",
)
def _(t):
    g = t.ticks.groupBy("trader", F.to_date("ts").cast("string").alias("session"))
    out = g.agg(F.count("*").alias("n"), F.max("volume").alias("max_iteration"), F.max("price").alias("max_cost"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    return out.orderBy(F.desc("end_us")).limit(100)


_PROFILE = f"""SELECT count(*) AS record_count, {rnd('100.0e0 * (count(*) - count(doc_id) + count(*) - count(quality) + count(*) - count(toxic) + count(*) - count(ts)) / (count(*) * 4)')} AS missing_pct,
 {rnd('100.0e0 * (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM x))) / count(*)')} AS duplicates_pct, CAST(min(ts) AS VARCHAR) AS range_start, CAST(max(ts) AS VARCHAR) AS range_end FROM x"""
_X = """x AS (SELECT nullif(l_orderkey % 50, 0) AS doc_id, l_linenumber AS quality, CAST(l_quantity AS INTEGER) % 5 AS toxic, CAST(l_shipdate AS DATE) AS ts FROM lineitem)"""


def _x(t):
    return t.lineitem.select(F.nullif(F.col("l_orderkey") % 50, F.lit(0)).alias("doc_id"), F.col("l_linenumber").alias("quality"), (F.col("l_quantity").cast("int") % 5).alias("toxic"), F.to_date("l_shipdate").alias("ts"))


@query("agg_11_quality_profile", f"WITH {_X} {_PROFILE}")
def _(t):
    return agg.quality_profile(_x(t)).withColumns({c: rounded(c) for c in ("missing_pct", "duplicates_pct")})


@query(
    "agg_12_quality_checks_and_vote",
    f"""WITH {_X}, p AS ({_PROFILE}), c AS (SELECT 'record_count' AS "check", record_count >= 100 AS ok, least(1.0e0, record_count / 100) AS score FROM p
  UNION ALL SELECT 'data_source', true, 1.0 UNION ALL SELECT 'missing_values', missing_pct <= 5, greatest(0, 1 - missing_pct / 5) FROM p
  UNION ALL SELECT 'duplicates', duplicates_pct <= 1, greatest(0, 1 - duplicates_pct / 1) FROM p),
 g AS (SELECT count(*) AS n, avg(score) AS s, greatest(count(*) FILTER (ok), count(*) FILTER (NOT ok)) / count(*) AS a, avg(score) FILTER (ok) AS sp, avg(score) FILTER (NOT ok) AS sf FROM c)
 SELECT 'lineitem' AS source, n, {rnd('s')} AS mean_score, {rnd('a')} AS agreement, CASE WHEN sp >= 0.65 AND sf >= 0.65 THEN 'CONFLICT' WHEN s >= 0.85 AND a >= 0.9 THEN 'HIGH_CONFIDENCE'
  WHEN s >= 0.65 AND a >= 0.7 THEN 'MEDIUM_CONFIDENCE' WHEN s >= 0.4 THEN 'LOW_CONFIDENCE' ELSE 'UNSOLVABLE' END AS confidence FROM g""",
)
def _(t):
    votes = agg.confidence_vote(agg.quality_checks(agg.quality_profile(_x(t)), "lineitem"), ["source"])
    return votes.withColumns({"mean_score": rounded("mean_score"), "agreement": rounded("agreement")})


@query(
    "agg_12_confidence_vote_by_user",
    f"""WITH g AS (SELECT user_id, count(*) AS n, avg(least(1.0, value / 60)) AS s, greatest(count(*) FILTER (ok), count(*) FILTER (NOT ok)) / count(*) AS a,
  avg(least(1.0, value / 60)) FILTER (ok) AS sp, avg(least(1.0, value / 60)) FILTER (NOT ok) AS sf FROM (SELECT *, event_type <> 'error' AS ok FROM events) GROUP BY 1)
 SELECT user_id, n, {rnd('s')} AS mean_score, {rnd('a')} AS agreement, CASE WHEN n > 1 AND sp >= 0.65 AND sf >= 0.65 THEN 'CONFLICT' WHEN s >= 0.85 AND a >= 0.9 THEN 'HIGH_CONFIDENCE'
  WHEN s >= 0.65 AND a >= 0.7 THEN 'MEDIUM_CONFIDENCE' WHEN s >= 0.4 THEN 'LOW_CONFIDENCE' ELSE 'UNSOLVABLE' END AS confidence FROM g""",
)
def _(t):
    checks = t.events.select("user_id", (F.col("event_type") != "error").alias("passed"), F.least(F.lit(1.0), F.col("value") / 60).alias("score"))
    return agg.confidence_vote(checks, ["user_id"]).withColumns({"mean_score": rounded("mean_score"), "agreement": rounded("agreement")})


def _versions(t):
    return agg.version_statistics(t.events.select(F.col("user_id").alias("entity_id"), "event_type", F.col("ts").alias("created_at")))


@query("agg_13_version_totals", "SELECT count(*) AS total_events, count(DISTINCT user_id) AS unique_entities FROM events")
def _(t):
    return _versions(t)["totals"]


@query("agg_13_events_by_type", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return _versions(t)["by_type"]


@query("agg_13_most_modified", "SELECT user_id AS entity_id, count(*) AS versions FROM events GROUP BY 1 HAVING count(*) > 1 ORDER BY versions DESC, entity_id LIMIT 10")
def _(t):
    return _versions(t)["most_modified"]


@query("agg_13_timeline", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY day DESC LIMIT 30")
def _(t):
    return _versions(t)["timeline"].withColumn("day", F.col("day").cast("string"))


_Q = """q AS (SELECT quantile_cont(l_quantity * l_discount, [0.25, 0.5, 0.75]) AS c FROM lineitem),
 b AS (SELECT 1 + CAST(l_quantity * l_discount > c[1] AS INT) + CAST(l_quantity * l_discount > c[2] AS INT) + CAST(l_quantity * l_discount > c[3] AS INT) AS bucket, l_extendedprice AS v FROM lineitem, q),
 m AS (SELECT bucket, avg(v) AS mean, stddev_samp(v) AS std, count(v) AS n FROM b GROUP BY 1)"""


def _quartiles(t):
    return agg.quantile_buckets(t.lineitem.select((F.col("l_quantity") * F.col("l_discount")).alias("x"), "l_extendedprice"), "x", "l_extendedprice", 0.1)


@query("agg_14_quartile_buckets", f"WITH {_Q} SELECT bucket, {rnd('mean', 4)} AS mean, {rnd('std', 4)} AS std, n FROM m")
def _(t):
    return _quartiles(t).withColumns({"mean": rounded("mean", 4), "std": rounded("std", 4)})


@query(
    "agg_14_quartile_trend",
    f"WITH {_Q} SELECT bool_and(mean >= p) AS monotonic, {rnd('max(mean) FILTER (bucket = 4) / max(mean) FILTER (bucket = 1)')} AS ratio FROM (SELECT *, lag(mean, 1, -1e300) OVER (ORDER BY bucket) AS p FROM m)",
)
def _(t):
    return agg.bucket_trend(_quartiles(t)).withColumn("ratio", rounded("ratio"))


