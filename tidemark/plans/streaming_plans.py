"""Streaming queries (STR): the tables are replayed as files in event order and drained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.corpus import event_checksum
from ..operators.regime import _ChangeSweep
from ..session import scratch_path
from ..streaming import daily, jobs
from ..streaming import stateful as st
from .flow_plans import _VB, _VP, SER, ema_step, recur
from .ingest_plans import AUDIT, LIQ, raw_messages
from .regime_plans import CHANGE_POINTS
from .registry import TICKS, query, rnd, rounded
from .risk_plans import BRK, EQ, equity_curve

FAR = "60 days"  # duplicates farther apart than this are not looked for
LATE = "1 hour"  # slices arrive in event order, so nothing is later than this


def replay(t, df: DataFrame, order: str, parts: int = 3, flush: str | None = None) -> DataFrame:
    """Stream of a table that ``drain`` feeds in time slices, oldest first; each slice is a micro-batch of its own.

    Slice borders are scalar subqueries and slices are written by all tasks. ``flush`` adds a last row that much
    after the newest one: it moves the watermark past every open window and stays in an open one itself.
    """
    path = scratch_path(t.spark, "replay")
    edge = lambda f: df.agg(F.unix_micros(f(order).cast("timestamp")).alias("e")).select("e").scalar()
    lo, hi = edge(F.min), edge(F.max)
    slot = F.least(F.lit(parts - 1), F.floor((F.unix_micros(F.col(order).cast("timestamp")) - lo) * parts / F.greatest(hi - lo, F.lit(1))))
    slices = [df.where(slot == i) for i in range(parts)]
    if flush:
        newest = df.orderBy(F.desc(order)).limit(1)
        slices.append(newest.withColumn(order, F.col(order) + F.expr(f"interval {flush}")))
    df.limit(0).write.parquet(path)  # a stream wants its folder to be there
    t.slices, t.slice_path = slices, path
    return t.spark.readStream.schema(df.schema).parquet(path)


def feed(t, run) -> None:
    """Write the slices one by one and run the stream over each; its checkpoint makes it go on where it was."""
    for part in t.slices:
        part.write.mode("append").parquet(t.slice_path)
        run().awaitTermination()


def drain(t, stream: DataFrame) -> DataFrame:
    """Run an append stream over all slices and return its rows as a table."""
    out, ck = scratch_path(t.spark, "sink"), scratch_path(t.spark, "sink-ck")
    sink = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True)
    feed(t, sink.start)
    return t.spark.read.schema(stream.schema).parquet(out)


@query("str_01_liquidation_stream", f"WITH {TICKS}, {LIQ} SELECT symbol, venue, side, CAST(make_timestamp(ms * 1000) :: DATE AS VARCHAR) AS dt, count(*) AS n, {rnd('sum(value)', 3)} AS total FROM lq GROUP BY 1, 2, 3, 4")
def _(t):
    src = replay(t, raw_messages(t).select("event_id", "ts", "raw"), "ts")
    out, ck = scratch_path(t.spark, "liq"), scratch_path(t.spark, "liq-ck")
    feed(t, lambda: jobs.to_parquet(jobs.liquidation_rows(src.drop("ts"), symbols=["BTC"]), out, ck))
    back = t.spark.read.parquet(out)
    return back.groupBy("symbol", "venue", "side", F.col("dt").cast("string").alias("dt")).agg(F.count("*").alias("n"), rounded(F.sum("value"), 3).alias("total"))


@query(
    "str_02_tumbling_windows",
    f"WITH {TICKS} SELECT symbol, us // 3600000000 * 3600000000 AS start_us, count(*) AS n, {rnd('sum(price)', 4)} AS total, max(price) AS hi FROM ticks GROUP BY 1, 2",
)
def _(t):
    src = replay(t, t.ticks.select("symbol", "ts", "price"), "ts", flush="2 days")
    w = jobs.windowed(src, "ts", LATE, "1 hour", [F.count("*").alias("n"), F.sum("price").alias("total"), F.max("price").alias("hi")], ["symbol"])
    return drain(t, w).select("symbol", F.unix_micros("start").alias("start_us"), "n", rounded("total", 4).alias("total"), "hi")


@query(
    "str_02_sliding_order_rate",
    f"WITH {TICKS}, w AS (SELECT symbol, unnest([us // 3600000000, us // 3600000000 - 1]) * 3600000000 AS start_us FROM ticks) SELECT symbol, start_us, count(*) AS orders FROM w GROUP BY 1, 2 HAVING count(*) > 8",
)
def _(t):
    src = replay(t, t.ticks.select("symbol", "ts"), "ts", flush="2 days")
    out = drain(t, jobs.order_rate(src, "ts", LATE, ["symbol"], "2 hours", "1 hour", 8))
    return out.select("symbol", F.unix_micros("start").alias("start_us"), "orders")


@query(
    "str_03_activity_sessions",
    f"""WITH {TICKS}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY trader ORDER BY us) < 21600000000 THEN 0 ELSE 1 END AS nw FROM ticks), s AS (SELECT *, sum(nw) OVER (PARTITION BY trader ORDER BY us) AS sid FROM g)
 SELECT trader, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY trader, sid""",
)
def _(t):
    src = replay(t, t.ticks.select("trader", "ts"), "ts", flush="2 days")
    out = drain(t, jobs.activity_sessions(src, "ts", LATE, ["trader"], "6 hours"))
    return out.select("trader", "n", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query("str_04_unique_events", "SELECT count(*) AS n, count(DISTINCT checksum) AS u FROM (SELECT DISTINCT sha256(event_type || ':' || user_id || ':' || json(props)) AS checksum FROM events)")
def _(t):
    src = replay(t, t.events.select("event_id", "ts", "event_type", "user_id", "props"), "ts")
    u = jobs.unique_events(src, "ts", FAR, event_checksum(F.col("event_type"), F.col("user_id"), F.col("props")))
    return drain(t, u).agg(F.count("*").alias("n"), F.countDistinct("checksum").alias("u"))


@query("str_05_stateful_ema", f"WITH RECURSIVE {TICKS}, {SER}, {recur({'e': 'price'}, {'e': ema_step(2 / 21, 's.price', 'e')})} SELECT event_id, {rnd('e')} AS ema FROM s JOIN y USING (trader, seq)")
def _(t):
    src = replay(t, t.ticks.select("trader", "event_id", "us", "price", "ts"), "ts")
    schema = st.schema_of(src, ["trader"], ["event_id"], "ema double")
    out = st.run_stateful(src.drop("ts"), ["trader"], ["us", "event_id"], lambda: st.EmaSweep(["event_id"], "price", 20), schema)
    return drain(t, out).select("event_id", rounded("ema").alias("ema"))


@query("str_05_stateful_vpin", f"WITH {TICKS}, {_VB}, {_VP} SELECT symbol, bucket, {rnd('vpin')} AS vpin FROM vp")
def _(t):
    src = replay(t, t.ticks.select("symbol", "event_id", "us", "price", "volume", "ts"), "ts")
    schema = st.schema_of(src, ["symbol"], [], "bucket long, vpin double")
    out = st.run_stateful(src.drop("ts"), ["symbol"], ["us", "event_id"], lambda: st.VpinSweep("price", "volume", 1000.0, 50), schema)
    return drain(t, out).select("symbol", "bucket", rounded("vpin").alias("vpin"))


@query("str_05_stateful_breaker", f"WITH {EQ}, {BRK} SELECT strategy, CAST(day AS VARCHAR) AS day, {rnd('dd')} AS drawdown, ev AS state FROM v")
def _(t):
    src = replay(t, equity_curve(t), "day")
    schema = st.schema_of(src, ["strategy"], ["day"], "drawdown double, state string, multiplier double")
    out = st.run_stateful(src, ["strategy"], ["day"], lambda: st.BreakerSweep(["day"], "e", signed=True), schema)
    return drain(t, out).select("strategy", F.col("day").cast("string").alias("day"), rounded("drawdown").alias("drawdown"), "state")


@query("str_05_stateful_change_points", CHANGE_POINTS)
def _(t):
    """The same state machine as the batch form."""
    src = replay(t, t.ticks.select("symbol", "event_id", "us", "price", "ts"), "ts")
    schema = st.schema_of(src, ["symbol"], ["event_id"], "cp_prob double, run_length long, changepoint boolean")
    params = dict(hazard=0.01, mu0=50.0, beta0=500.0)
    out = st.run_stateful(src.drop("ts"), ["symbol"], ["us", "event_id"], lambda: _ChangeSweep(["event_id"], "price", params), schema)
    return drain(t, out).select("event_id", "symbol", rounded("cp_prob").alias("cp_prob"), "run_length", "changepoint")


@query(
    "str_06_daily_loss_latch",
    f"""WITH {TICKS}, r AS (SELECT *, CAST(ts AS DATE) AS day, sum(price - 60) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, event_id) AS rt FROM ticks), x AS (SELECT *, rt + volume - 50 AS tt FROM r)
 SELECT event_id, {rnd('tt', 4)} AS total_today, max(CASE WHEN tt <= -150 THEN 1 ELSE 0 END) OVER w = 1 AS warned, max(CASE WHEN tt <= -300 THEN 1 ELSE 0 END) OVER w = 1 AS limited FROM x WINDOW w AS (PARTITION BY symbol, day ORDER BY ts, event_id)""",
)
def _(t):
    src = replay(t, t.ticks.select("symbol", "event_id", "us", (F.col("price") - 60).alias("r"), (F.col("volume") - 50).alias("u"), "ts"), "ts")
    schema = st.schema_of(src, ["symbol"], ["event_id"], "total_today double, warned boolean, limited boolean")
    out = st.run_stateful(src.drop("ts"), ["symbol"], ["us", "event_id"], lambda: st.LossLatchSweep(["event_id"], "us", "r", "u", 300.0), schema)
    return drain(t, out).select("event_id", rounded("total_today", 4).alias("total_today"), "warned", "limited")


@query(
    "str_06_daily_reset",
    f"""WITH {TICKS}, r AS (SELECT *, CAST(ts AS DATE) AS day, sum(price - 60) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, event_id) AS rt FROM ticks), x AS (SELECT *, rt + volume - 50 AS tt FROM r)
 SELECT symbol, datediff('day', DATE '1970-01-01', day) AS day, count(*) AS n, {rnd('sum(price - 60)', 4)} AS total, {rnd('min(tt)', 4)} AS lowest, min(tt) <= -150 AS warned, min(tt) <= -300 AS limited FROM x GROUP BY symbol, day""",
)
def _(t):
    """Days are closed by timers: the row that moves the watermark past the last day belongs to one symbol only."""
    src = replay(t, t.ticks.select("symbol", "event_id", (F.col("price") - 60).alias("r"), (F.col("volume") - 50).alias("u"), "ts"), "ts", flush="2 days")
    out = drain(t, daily.daily_loss_latch(src, ["symbol"], "ts", "event_id", "r", "u", 300.0, delay=LATE))
    return out.where("kind = 'reset'").select("symbol", "day", "n", rounded("total_today", 4).alias("total"), rounded("lowest", 4).alias("lowest"), "warned", "limited")


@query("str_07_jsonl_tail", f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, count(*) AS n, {rnd('sum(value)', 4)} AS total FROM events WHERE event_id % 19 <> 0 GROUP BY 1")
def _(t):
    src, dst, ck = (scratch_path(t.spark, x) for x in ("tail", "cold", "cold-ck"))
    e = t.events.select((F.unix_micros("ts") * 1000).alias("ts_event"), "event_type", F.lit("s").alias("source"), F.col("event_id").alias("sequence"), "value")
    line = F.when(F.col("sequence") % 19 == 0, F.lit('{"ts_event": 12, broken')).otherwise(F.to_json(F.struct(*e.columns)))
    e.select(line.alias("value")).write.text(src)
    jobs.tail_jsonl(t.spark, src, dst, ck, AUDIT).awaitTermination()
    return t.spark.read.parquet(dst).groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count("*").alias("n"), rounded(F.sum("value"), 4).alias("total"))
