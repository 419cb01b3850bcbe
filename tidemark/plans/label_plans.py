"""Queries for labels, features and splits (ML, JOIN-9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as ml
from ..operators import windows as win
from ..operators.blocks import RowBlocks, with_seq
from .registry import DAILY, TICKS, query, rnd, rounded
from .window_plans import daily_returns

ORD = ["ts", "event_id"]
BLOCKS = RowBlocks()
ROWS = win.ROWS

S = """s AS (SELECT *, row_number() OVER w AS seq, count(*) OVER (PARTITION BY symbol) AS n, price * 0.3 + 10 AS atr, CAST(volume AS INT) % 3 - 1 AS signal FROM ticks
 WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id))"""
B = """b AS (SELECT s.*, list({'s': seq, 'p': price}) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS f FROM s),
 h AS (SELECT *, list_filter(f, lambda x: x.p >= price + 2 * atr OR x.p <= price - atr)[1] AS hit, f[-1] AS e FROM b),
 l AS (SELECT *, CASE WHEN e IS NULL THEN 0 WHEN hit IS NULL THEN CAST(sign(e.p - price) AS INT) WHEN hit.p >= price + 2 * atr THEN 1 ELSE -1 END AS raw FROM h)"""


def entries(t):
    v = F.col("volume").cast("int")
    return t.ticks.withColumns({"atr": F.col("price") * 0.3 + 10, "signal": v % 3 - 1})


@query("ml_01_triple_barrier", f"WITH {TICKS}, {S}, {B} SELECT event_id, raw AS label FROM l")
def _(t):
    return ml.triple_barrier(entries(t), ["symbol"], ORD, BLOCKS, rows=ROWS).select("event_id", "label")


@query("ml_01_triple_barrier_signals", f"WITH {TICKS}, {S}, {B} SELECT event_id, CASE WHEN signal = 0 THEN 0 WHEN signal = -1 THEN -raw ELSE raw END AS label FROM l")
def _(t):
    return ml.triple_barrier(entries(t), ["symbol"], ORD, BLOCKS, signal="signal", rows=ROWS).select("event_id", "label")


@query(
    "ml_02_barrier_events",
    f"""WITH {TICKS}, {S}, {B} SELECT event_id, seq, coalesce(e.s, seq) AS timeout_seq, coalesce(hit.s, e.s, seq) AS exit_seq, coalesce(hit.p, e.p, price) AS exit_price,
 {rnd('coalesce(hit.p, e.p, price) / price - 1')} AS exit_return, CASE WHEN e IS NULL THEN 'none' WHEN hit IS NULL THEN 'timeout' WHEN hit.p >= price + 2 * atr THEN 'take_profit' ELSE 'stop_loss' END AS barrier, raw AS label FROM l""",
)
def _(t):
    out = ml.barrier_events(entries(t), ["symbol"], ORD, BLOCKS, rows=ROWS)
    return out.select("event_id", "seq", "timeout_seq", "exit_seq", "exit_price", rounded("exit_return").alias("exit_return"), "barrier", "label")


@query(
    "ml_03_meta_label",
    f"""WITH {TICKS}, {S}, {B}, y AS (SELECT event_id, signal, CASE WHEN signal = 0 THEN 0 WHEN signal = -1 THEN -raw ELSE raw END AS label FROM l)
 SELECT event_id, CASE WHEN signal = label AND signal <> 0 THEN 1 ELSE 0 END AS meta, signal <> 0 AS valid FROM y""",
)
def _(t):
    out = ml.triple_barrier(entries(t), ["symbol"], ORD, BLOCKS, signal="signal", rows=ROWS)
    return out.select("event_id", ml.meta_label(F.col("signal"), F.col("label")).alias("meta"), (F.col("signal") != 0).alias("valid"))


def _fr(n, k="symbol"):
    return f"(PARTITION BY {k} ORDER BY seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(
    "ml_04_meta_features",
    f"""WITH {TICKS}, {S}, r AS (SELECT *, coalesce(ln(price / lag(price) OVER w), 0) AS ret, coalesce(price / lag(price, 20) OVER w - 1, 0) AS mom FROM s WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
 v AS (SELECT *, CASE WHEN seq >= 20 THEN stddev_pop(ret) OVER {_fr(20)} ELSE 0 END AS vol, avg(price) OVER {_fr(20)} AS m, avg(volume) OVER {_fr(20)} AS mv FROM r),
 x AS (SELECT *, CASE WHEN seq >= 20 THEN stddev_pop(vol) OVER {_fr(20)} ELSE 0 END AS vov, CASE WHEN vol > 1e-10 THEN vol ELSE 1e-10 END AS safe FROM v)
 SELECT event_id, {rnd('vol')} AS volatility, {rnd('atr / price')} AS normalized_atr, {rnd('mom', 4)} AS momentum, {rnd('vov')} AS vol_of_vol, {rnd('abs(mom) / safe', 3)} AS trend_strength,
  {rnd('CASE WHEN vol > 1e-10 THEN (price - m) / m / safe END')} AS mean_reversion, {rnd('volume / CASE WHEN mv > 0 THEN mv ELSE 1 END')} AS volume_ratio, signal * 1e0 AS regime_feature FROM x""",
)
def _(t):
    """Warm-up rows divide by 1e-10, which leaves no stable digits: their mean_reversion is shown as null."""
    out = ml.meta_features(entries(t), ["symbol"], ORD, BLOCKS, atr="atr", volume="volume", regime="signal", rows=ROWS)
    out = out.withColumn("mean_reversion", F.when(F.col("volatility") > 1e-10, F.col("mean_reversion")))
    digits = {"volatility": 6, "normalized_atr": 6, "momentum": 4, "vol_of_vol": 6, "trend_strength": 3, "mean_reversion": 6, "volume_ratio": 6}
    return out.select("event_id", "regime_feature", *[rounded(c, d).alias(c) for c, d in digits.items()])


SPLIT = """k AS (SELECT symbol, n, unnest(range(0, (n - 252 - 5 - 1) // 21 + 1)) AS split FROM (SELECT symbol, count(*) AS n FROM ticks GROUP BY 1) WHERE n >= 320),
 sp AS (SELECT symbol, split, split * 21 AS train_start, split * 21 + 252 AS train_end, split * 21 + 257 AS test_start, least(split * 21 + 257 + 63, n) AS test_end FROM k)"""


@query("ml_05_walk_forward_splits", f"WITH {TICKS}, {SPLIT} SELECT * FROM sp")
def _(t):
    return ml.walk_forward_splits(t.ticks.groupBy("symbol").agg(F.count("*").alias("n")), "n").drop("n")


def _numbered(t):
    src = with_seq(t.ticks, ["symbol"], ORD, BLOCKS)
    return src.join(t.ticks.groupBy("symbol").agg(F.count("*").alias("n")), "symbol").withColumn("pos", F.col("seq") - 1)


_ROLE = f"""WITH {TICKS}, {S}, {SPLIT} SELECT s.symbol, sp.split, CASE WHEN seq - 1 < train_end THEN 'train' ELSE 'test' END AS role, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi, sum(event_id) :: BIGINT AS chk
 FROM s JOIN sp ON s.symbol = sp.symbol AND (seq - 1 BETWEEN train_start AND {{}} - 1 OR seq - 1 BETWEEN test_start AND test_end - 1) GROUP BY 1, 2, 3"""


def _roles(t, purge):
    out = ml.split_roles(_numbered(t).select("symbol", "event_id", "pos", "n"), "pos", "n", purge=purge)
    return out.groupBy("symbol", "split", "role").agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"), F.sum("event_id").alias("chk"))


@query("ml_05_split_roles", _ROLE.format("train_end"))
def _(t):
    return _roles(t, 0)


@query("ml_06_purged_split_roles", _ROLE.format("least(train_end, test_start - 10)"))
def _(t):
    return _roles(t, 10)


SPAN = "sn AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders)"


def span(t):
    return t.orders.agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))


def windows_sql(step: int) -> str:
    return f"""wn AS (SELECT CAST(k + 1 AS INT) AS window_id, a + CAST(k * {step} AS INT) AS train_start, a + CAST(k * {step} + 180 AS INT) AS train_end, a + CAST(k * {step} + 185 AS INT) AS test_start, a + CAST(k * {step} + 275 AS INT) AS test_end
 FROM (SELECT a, b, unnest(range(0, (b - a - 275) // {step} + 1)) AS k FROM sn))"""


_WSEL = "SELECT window_id, CAST(train_start AS VARCHAR) AS train_start, CAST(train_end AS VARCHAR) AS train_end, CAST(test_start AS VARCHAR) AS test_start, CAST(test_end AS VARCHAR) AS test_end FROM wn"


def _show(w):
    return w.select("window_id", *[F.col(c).cast("string").alias(c) for c in ("train_start", "train_end", "test_start", "test_end")])


@query("ml_07_calendar_windows", f"WITH {SPAN}, {windows_sql(278)} {_WSEL}")
def _(t):
    return _show(ml.calendar_windows(span(t), "a", "b"))


@query("ml_07_calendar_windows_overlapping", f"WITH {SPAN}, {windows_sql(90)} {_WSEL}")
def _(t):
    return _show(ml.calendar_windows(span(t), "a", "b", after=None))


DR = f"{DAILY}, dr AS (SELECT strategy, day, n_orders, (equity / lag(equity) OVER (PARTITION BY strategy ORDER BY day) - 1) * 0.01 AS ret FROM daily)"


def returns(t):
    """Daily returns with the order count."""
    return daily_returns(t).join(t.daily.select("strategy", "day", "n_orders"), ["strategy", "day"])


@query(
    "join_09_attach_windows",
    f"""WITH {DR}, {SPAN}, {windows_sql(90)} SELECT strategy, window_id, CASE WHEN day < train_end THEN 'train' ELSE 'test' END AS role, count(*) AS n, CAST(min(day) AS VARCHAR) AS lo, CAST(max(day) AS VARCHAR) AS hi
 FROM dr JOIN wn ON (day >= train_start AND day < train_end) OR (day >= test_start AND day < test_end) WHERE ret IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(t):
    w = ml.calendar_windows(span(t), "a", "b", after=None)
    j = ml.attach_windows(daily_returns(t), "day", w)
    return j.groupBy("strategy", "window_id", "role").agg(F.count("*").alias("n"), F.min("day").cast("string").alias("lo"), F.max("day").cast("string").alias("hi"))


FEATURES = ["volatility", "normalized_atr", "momentum", "vol_of_vol", "trend_strength", "mean_reversion"]


def _meta_rows(t):
    f = ml.meta_features(entries(t), ["symbol"], ORD, BLOCKS)
    y = ml.triple_barrier(entries(t), ["symbol"], ORD, BLOCKS, signal="signal").select("event_id", ml.meta_label(F.col("signal"), F.col("label")).alias("meta"))
    return f.where("signal != 0").join(y, "event_id")


@query("ml_08_secondary_classifier")
def _(t):
    from ..session import checkpointed

    rows = checkpointed(_meta_rows(t).select("event_id", "meta", *FEATURES))
    model = ml.secondary_classifier(rows, FEATURES, "meta")
    return ml.with_confidence(model, rows).select("event_id", "meta", rounded("confidence").alias("confidence"))


@query("ml_09_score_splits")
def _(t):
    from ..session import checkpointed

    rows = checkpointed(with_seq(_meta_rows(t), ["symbol"], ORD, BLOCKS).withColumn("pos", F.col("seq") - 1))
    rows = rows.join(rows.groupBy("symbol").agg(F.count("*").alias("n")), "symbol")
    return ml.score_walk_forward(rows, ["symbol"], "pos", "n", FEATURES, "meta", purge=10).withColumn("accuracy", rounded("accuracy"))
