"""Queries for time bucketing, latest values and bars (TS)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as ts
from ..operators.blocks import RowBlocks, running, settle, spread
from .registry import DAILY, TICKS, query, rnd, rounded

ORD = ["ts", "event_id"]
BLOCKS = RowBlocks()


def _fmt(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


_OHLC = "arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close, sum(volume) AS volume, count(*) AS n_ticks"


@query(
    "flagship_hourly_bars",
    f"""WITH {TICKS}, bars AS (SELECT symbol, date_trunc('hour', ts) AS bucket, {_OHLC} FROM ticks WHERE price > 0 GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER w AS seq, ln(close / lag(close) OVER w) AS log_ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bucket)),
 v AS (SELECT *, CASE WHEN count(log_ret) OVER f = 20 THEN stddev_samp(log_ret) OVER f END AS vol FROM r
   WINDOW f AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
 SELECT symbol, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, open, high, low, close, volume, n_ticks, {rnd('log_ret', 8)} AS log_ret, {rnd('vol', 8)} AS vol
 FROM v QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bucket DESC) = 1""",
)
def _(t):
    bars = ts.time_bars(t.ticks.where("price > 0"), ["symbol"], ORD, "1 hour")
    r = running(bars, ["symbol"], ["bucket"], BLOCKS, {"prev": ("lag", F.col("close")), "seq": ("count", F.lit(1))})
    r = r.withColumn("log_ret", F.log(F.col("close") / F.col("prev")))
    h, w = spread(r, ["symbol"], "seq", 65536, back=19)
    f = w.rowsBetween(-19, 0)
    v = settle(h.withColumn("vol", F.when(F.count("log_ret").over(f) == 20, F.stddev_samp("log_ret").over(f))))
    return ts.latest_by(v, ["symbol"], ["bucket"]).select(
        "symbol", _fmt("bucket").alias("bucket"), "open", "high", "low", "close", "volume", "n_ticks", rounded("log_ret", 8).alias("log_ret"), rounded("vol", 8).alias("vol")
    )


for _n, _every, _sec in (("1m", "1 minute", 60), ("5m", "5 minutes", 300), ("10m", "10 minutes", 600), ("1h", "1 hour", 3600), ("1d", "1 day", 86400)):

    @query(
        f"ts_01_sample_by_{_n}",
        f"""WITH {TICKS} SELECT symbol, strftime(time_bucket(INTERVAL {_sec} SECOND, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS bucket,
 {rnd('sum(price)', 4)} AS total, count(*) AS n, {rnd('avg(price)')} AS mean, max(price) AS hi FROM ticks GROUP BY 1, 2""",
    )
    def _(t, _every=_every):
        aggs = [rounded(F.sum("price"), 4).alias("total"), F.count("*").alias("n"), rounded(F.avg("price")).alias("mean"), F.max("price").alias("hi")]
        return ts.sample_by(t.ticks, "ts", _every, aggs, ["symbol"]).withColumn("bucket", _fmt("bucket"))


@query(
    "ts_02_sample_by_from_first",
    f"""WITH {TICKS}, o AS (SELECT min(us) AS o FROM ticks)
 SELECT symbol, CAST((us - o) // 3600000000 * 3600000000 + o AS BIGINT) AS bucket_us, count(*) AS n, {rnd('sum(price)', 4)} AS total FROM ticks, o GROUP BY 1, 2""",
)
def _(t):
    out = ts.sample_by(t.ticks, "ts", "1 hour", [F.count("*").alias("n"), rounded(F.sum("price"), 4).alias("total")], ["symbol"], align="first")
    return out.select("symbol", F.unix_micros("bucket").alias("bucket_us"), "n", "total")


@query(
    "ts_03_sample_by_fill_null",
    f"""WITH {TICKS}, b AS (SELECT symbol, time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') AS bucket, count(*) AS n, {rnd('avg(price)')} AS mean FROM ticks GROUP BY 1, 2),
 g AS (SELECT symbol, unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b), INTERVAL 10 MINUTE)) AS bucket FROM (SELECT DISTINCT symbol FROM b))
 SELECT symbol, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, n, mean FROM g LEFT JOIN b USING (symbol, bucket)""",
)
def _(t):
    out = ts.sample_by(t.ticks, "ts", "10 minutes", [F.count("*").alias("n"), rounded(F.avg("price")).alias("mean")], ["symbol"], fill=True)
    return out.withColumn("bucket", _fmt("bucket"))


@query(
    "ts_04_latest_by",
    f"""WITH {TICKS} SELECT symbol, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(trader, (ts, event_id)) AS trader,
 arg_max(price, (ts, event_id)) AS price FROM ticks GROUP BY symbol""",
)
def _(t):
    return ts.latest_by(t.ticks.select("symbol", "event_id", "ts", "trader", "price"), ["symbol"], ORD).drop("ts")


@query(
    "ts_04_latest_by_then_aggregate",
    f"""WITH {TICKS}, l AS (SELECT trader, symbol, arg_max(price, (ts, event_id)) AS price FROM ticks GROUP BY 1, 2)
 SELECT symbol, {rnd('sum(price)', 4)} AS total, count(*) AS n_traders, max(price) AS hi FROM l GROUP BY symbol""",
)
def _(t):
    newest = ts.latest_by(t.ticks.select("trader", "symbol", "ts", "event_id", "price"), ["trader", "symbol"], ORD)
    return newest.groupBy("symbol").agg(rounded(F.sum("price"), 4).alias("total"), F.count("*").alias("n_traders"), F.max("price").alias("hi"))


@query(
    "ts_05_last_expr_in_window",
    f"""WITH {TICKS} SELECT trader, arg_max(price * volume, (ts, event_id)) AS last_notional, arg_max(symbol, (ts, event_id)) AS last_symbol
 FROM ticks WHERE ts > (SELECT max(ts) FROM ticks) - INTERVAL 7 DAY GROUP BY trader""",
)
def _(t):
    newest = t.ticks.agg(F.max("ts").alias("m")).select("m").scalar()
    recent = t.ticks.where(F.col("ts") > newest - F.expr("interval 7 days"))
    return recent.groupBy("trader").agg(
        ts.last_value(F.col("price") * F.col("volume"), ORD).alias("last_notional"), ts.last_value(F.col("symbol"), ORD).alias("last_symbol")
    )


for _n, _every, _sec in (("1m", "1 minute", 60), ("5m", "5 minutes", 300), ("15m", "15 minutes", 900)):

    @query(
        f"ts_06_ohlcv_{_n}",
        f"WITH {TICKS} SELECT symbol, strftime(time_bucket(INTERVAL {_sec} SECOND, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS bucket, {_OHLC} FROM ticks GROUP BY 1, 2",
    )
    def _(t, _every=_every):
        return ts.time_bars(t.ticks, ["symbol"], ORD, _every).withColumn("bucket", _fmt("bucket"))


@query(
    "ts_06_ohlcv_hour_from_minute",
    f"""WITH {TICKS} SELECT symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket, {_OHLC} FROM ticks GROUP BY 1, 2""",
)
def _(t):
    """Bar-to-bar aggregation: hour bars out of minute bars equal hour bars out of ticks."""
    m = ts.time_bars(t.ticks, ["symbol"], ORD, "1 minute").withColumnRenamed("bucket", "m")
    hour = ts.sample_by(
        m,
        "m",
        "1 hour",
        [
            ts.first_value(F.col("open"), ["m"]).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            ts.last_value(F.col("close"), ["m"]).alias("close"),
            F.sum("volume").alias("volume"),
            F.sum("n_ticks").alias("n_ticks"),
        ],
        ["symbol"],
    )
    return hour.withColumn("bucket", _fmt("bucket"))


@query(
    "ts_07_tick_bars",
    f"""WITH {TICKS}, s AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) - 1) // 50 AS bar FROM ticks)
 SELECT symbol, bar, {_OHLC} FROM s GROUP BY 1, 2""",
)
def _(t):
    return ts.tick_bars(t.ticks, ["symbol"], ORD, 50, BLOCKS)


for _n, _m, _thr in (("volume", "volume", 1000.0), ("value", "price * volume", 50000.0)):
    # values are compared in whole cents so both engines place borders alike
    @query(
        f"ts_07_{_n}_bars",
        f"""WITH {TICKS}, c AS (SELECT *, CAST(round(({_m}) * 100) AS BIGINT) AS m FROM ticks),
 s AS (SELECT *, sum(m) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS cum FROM c)
 SELECT symbol, CAST((cum - m) // {int(_thr * 100)} AS BIGINT) AS bar, {_OHLC} FROM s GROUP BY 1, 2""",
    )
    def _(t, _m=_m, _thr=_thr):
        return ts.threshold_bars(t.ticks, ["symbol"], ORD, F.round(F.expr(_m) * 100).cast("long"), _thr * 100, BLOCKS)


@query(
    "ts_08_staleness",
    f"""WITH {TICKS} SELECT trader, {rnd("(max(max(us)) OVER () - max(us)) / 1e6")} AS age_seconds FROM ticks GROUP BY trader""",
)
def _(t):
    as_of = t.ticks.agg(F.max("ts").alias("m")).select("m").scalar()
    return ts.staleness(t.ticks, ["trader"], "ts", as_of).select("trader", rounded("age_seconds").alias("age_seconds"))


@query(
    "ts_09_monthly_compounded_returns",
    f"""WITH {DAILY}, r AS (SELECT strategy, day, (equity / lag(equity) OVER (PARTITION BY strategy ORDER BY day) - 1) * 0.01 AS ret FROM daily)
 SELECT strategy, strftime(date_trunc('month', day), '%Y-%m') AS month, {rnd('product(1 + ret) - 1')} AS ret FROM r WHERE ret IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    prev = running(t.daily, ["strategy"], ["day"], "52 weeks", {"prev": ("lag", F.col("equity"))})
    r = prev.select("strategy", "day", ((F.col("equity") / F.col("prev") - 1) * 0.01).alias("ret")).where("ret is not null")
    return ts.compounded_returns(r, ["strategy"], "day", "ret").select("strategy", F.date_format("period", "yyyy-MM").alias("month"), rounded("ret").alias("ret"))


@query(
    "ts_10_display_resolution",
    """WITH n AS (SELECT event_type AS symbol, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM lineitem)
 SELECT symbol, n, CASE WHEN n > 100000 THEN '1 week' WHEN n > 50000 THEN '1 day' WHEN n > 10000 THEN '4 hours' ELSE '1 hour' END AS every FROM n""",
)
def _(t):
    n = t.ticks.groupBy("symbol").agg(F.count("*").alias("n")).union(t.lineitem.agg(F.count("*").alias("n")).select(F.lit("all"), "n"))
    return n.withColumn("every", ts.display_resolution(F.col("n")))


@query(
    "ts_11_asof_align",
    f"""WITH {TICKS}, l AS (SELECT * FROM ticks WHERE symbol = 'purchase'), r AS (SELECT * FROM ticks WHERE symbol = 'view')
 SELECT l.event_id, l.trader, r.price AS view_price, r.event_id AS view_id FROM l ASOF LEFT JOIN r ON l.trader = r.trader AND l.ts >= r.ts""",
)
def _(t):
    left = t.ticks.where("symbol = 'purchase'").select("event_id", "trader", "ts")
    right = t.ticks.where("symbol = 'view'").select("trader", "ts", F.col("price").alias("view_price"), F.col("event_id").alias("view_id"))
    return ts.asof_join(left, right, ["trader"], "ts", ["view_price", "view_id"], "1 day").drop("ts")


