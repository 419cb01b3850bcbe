"""Queries for row-window indicators (WIN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as ts
from ..operators import windows as win
from ..operators.blocks import RowBlocks
from .registry import DAILY, TICKS, query, rnd, rounded

ORD = ["ts", "event_id"]
BLOCKS = RowBlocks()
ROWS = win.ROWS
SYM = "(PARTITION BY symbol ORDER BY ts, event_id)"
RET = f"r AS (SELECT *, row_number() OVER w AS seq, ln(price / lag(price) OVER w) AS ret FROM ticks WINDOW w AS {SYM})"


def _ret(t):
    return win.log_return(t.ticks, ["symbol"], ORD, "price", BLOCKS)


@query("win_01_counter_rate", f"WITH {TICKS} SELECT event_id, volume - lag(volume) OVER (ORDER BY ts, event_id) AS delta FROM ticks")
def _(t):
    return win.counter_delta(t.ticks, [], ORD, "volume", BLOCKS).select("event_id", "delta")


@query(
    "win_01_counter_rate_sampled",
    f"""WITH {TICKS}, d AS (SELECT ts, volume - lag(volume) OVER (ORDER BY ts, event_id) AS delta FROM ticks)
 SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, {rnd('avg(delta)')} AS rate FROM d GROUP BY 1""",
)
def _(t):
    d = win.counter_delta(t.ticks, [], ORD, "volume", BLOCKS)
    out = ts.sample_by(d, "ts", "1 hour", [rounded(F.avg("delta")).alias("rate")])
    return out.select(F.date_format("bucket", "yyyy-MM-dd HH").alias("hour"), "rate")


@query(
    "win_02_counter_delta_by_key",
    f"""WITH {TICKS}, d AS (SELECT event_id, volume, volume - lag(volume) OVER {SYM} AS delta FROM ticks)
 SELECT event_id, delta, CASE WHEN delta < 0 THEN volume ELSE delta END AS reset_delta FROM d""",
)
def _(t):
    d = win.counter_delta(t.ticks, ["symbol"], ORD, "volume", BLOCKS)
    return win.counter_delta(d, ["symbol"], ORD, "volume", BLOCKS, "reset_delta", reset_aware=True).select("event_id", "delta", "reset_delta")


@query("win_03_moving_average_11", f"WITH {TICKS} SELECT event_id, {rnd('avg(price) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)')} AS ma FROM ticks")
def _(t):
    out = win.moving_average(t.ticks, ["symbol"], ORD, "price", BLOCKS, rows=ROWS)
    return out.select("event_id", rounded("ma").alias("ma"))


@query("win_04_log_return", f"WITH {TICKS}, {RET} SELECT event_id, {rnd('ret', 8)} AS ret FROM r WHERE ret IS NOT NULL")
def _(t):
    return _ret(t).where("ret is not null").select("event_id", rounded("ret", 8).alias("ret"))


@query("win_04_log_return_zero_first", f"WITH {TICKS}, {RET} SELECT event_id, {rnd('coalesce(ret, 0)', 8)} AS ret FROM r")
def _(t):
    out = win.log_return(t.ticks, ["symbol"], ORD, "price", BLOCKS, first=0.0)
    return out.select("event_id", rounded("ret", 8).alias("ret"))


def _frame(n):
    return f"(PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(
    "win_05_rolling_std_sample",
    f"""WITH {TICKS}, {RET} SELECT event_id, {rnd(f'CASE WHEN count(ret) OVER {_frame(20)} >= 20 THEN stddev_samp(ret) OVER {_frame(20)} END')} AS vol20,
 {rnd(f'CASE WHEN count(ret) OVER {_frame(30)} >= 30 THEN stddev_samp(ret) OVER {_frame(30)} * sqrt(252) END')} AS vol30_annual,
 {rnd(f'CASE WHEN count(ret) OVER {_frame(12)} >= 12 THEN stddev_samp(ret) OVER {_frame(12)} * sqrt(105120) END', 4)} AS vol12_5m FROM r""",
)
def _(t):
    def build(d, w):
        return d.select(
            "*",
            rounded(win.std_sample(w, "ret", 20)).alias("vol20"),
            rounded(win.std_sample(w, "ret", 30, 252**0.5)).alias("vol30_annual"),
            rounded(win.std_sample(w, "ret", 12, 105120**0.5), 4).alias("vol12_5m"),
        )

    return win.rolling(_ret(t), ["symbol"], ORD, BLOCKS, 29, build, rows=ROWS).select("event_id", "vol20", "vol30_annual", "vol12_5m")


@query(
    "win_06_rolling_std_population",
    f"""WITH {TICKS}, {RET} SELECT event_id, {rnd(f'CASE WHEN count(*) OVER {_frame(20)} >= 20 THEN stddev_pop(coalesce(ret, 0)) OVER {_frame(20)} ELSE 0 END')} AS vol FROM r""",
)
def _(t):
    r = win.log_return(t.ticks, ["symbol"], ORD, "price", BLOCKS, first=0.0)
    out = win.rolling(r, ["symbol"], ORD, BLOCKS, 19, lambda d, w: d.withColumn("vol", win.std_population(w, "ret", 20)), rows=ROWS)
    return out.select("event_id", rounded("vol").alias("vol"))


@query(
    "win_07_rolling_mean_expanding",
    f"""WITH {TICKS} SELECT event_id, {rnd("CASE WHEN count(*) OVER (PARTITION BY trader) < 60 THEN price ELSE avg(price) OVER (PARTITION BY trader ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) END")} AS m FROM ticks""",
)
def _(t):
    src = win.with_key_rows(t.ticks, ["trader"])
    out = win.rolling(src, ["trader"], ORD, BLOCKS, 59, lambda d, w: d.withColumn("m", win.mean_expanding(w, "price", 60, F.col("_key_rows"))), rows=ROWS)
    return out.select("event_id", rounded("m").alias("m"))


@query("win_08_rolling_return", f"WITH {TICKS} SELECT event_id, {rnd(f'coalesce(price / lag(price, 20) OVER {SYM} - 1, 0)', 4)} AS r FROM ticks")
def _(t):
    out = win.rolling(t.ticks, ["symbol"], ORD, BLOCKS, 20, lambda d, w: d.withColumn("r", win.rolling_return(w, "price", 20)), rows=ROWS)
    return out.select("event_id", rounded("r", 4).alias("r"))


@query(
    "win_09_volume_ratio",
    f"""WITH {TICKS}, m AS (SELECT event_id, volume, avg(volume) OVER {_frame(20)} AS m FROM ticks)
 SELECT event_id, {rnd('volume / CASE WHEN m > 0 THEN m ELSE 1 END')} AS ratio FROM m""",
)
def _(t):
    src = win.with_key_rows(t.ticks, ["symbol"])
    out = win.rolling(src, ["symbol"], ORD, BLOCKS, 19, lambda d, w: d.withColumn("ratio", win.volume_ratio(w, "volume", 20, F.col("_key_rows"))), rows=ROWS)
    return out.select("event_id", rounded("ratio").alias("ratio"))


CUM = f"""{DAILY}, dr AS (SELECT strategy, day, (equity / lag(equity) OVER (PARTITION BY strategy ORDER BY day) - 1) * 0.01 AS ret FROM daily),
 cu AS (SELECT strategy, day, ret, product(1 + ret) OVER (PARTITION BY strategy ORDER BY day) AS cum FROM dr WHERE ret IS NOT NULL)"""


def daily_returns(t):
    d = win.counter_delta(t.daily, ["strategy"], ["day"], "equity", "52 weeks", "_d")
    return d.select("strategy", "day", (F.col("_d") / (F.col("equity") - F.col("_d")) * 0.01).alias("ret")).where("ret is not null")


@query(
    "win_10_cumulative_return",
    f"""WITH {CUM} SELECT strategy, CAST(day AS VARCHAR) AS day, {rnd('ln(cum)')} AS log_cum, {rnd('ln(cum / first(cum) OVER (PARTITION BY strategy ORDER BY day))')} AS log_cum_norm FROM cu""",
)
def _(t):
    out = win.cumulative_return(daily_returns(t), ["strategy"], ["day"], "ret", "52 weeks")
    return out.select("strategy", F.col("day").cast("string").alias("day"), rounded(F.log("cum")).alias("log_cum"), rounded(F.log("cum_norm")).alias("log_cum_norm"))


@query(
    "win_11_drawdown",
    f"""WITH {CUM} SELECT strategy, CAST(day AS VARCHAR) AS day, {rnd('(cum - max(cum) OVER w) / max(cum) OVER w')} AS dd FROM cu WINDOW w AS (PARTITION BY strategy ORDER BY day)""",
)
def _(t):
    cum = win.cumulative_return(daily_returns(t), ["strategy"], ["day"], "ret", "52 weeks")
    return win.drawdown(cum, ["strategy"], ["day"], "cum", "52 weeks").select("strategy", F.col("day").cast("string").alias("day"), rounded("dd").alias("dd"))


@query(
    "win_12_zscore",
    f"""WITH {TICKS} SELECT event_id, {rnd('(price - avg(price) OVER (PARTITION BY symbol)) / CASE WHEN stddev_pop(price) OVER (PARTITION BY symbol) = 0 THEN 1 ELSE stddev_pop(price) OVER (PARTITION BY symbol) END')} AS z FROM ticks""",
)
def _(t):
    return win.zscore(t.ticks, ["symbol"], "price").select("event_id", rounded("z").alias("z"))


BARS = f"""bars AS (SELECT symbol, date_trunc('hour', ts) AS bucket, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low,
 arg_max(price, (ts, event_id)) AS close, sum(volume) AS volume FROM ticks GROUP BY 1, 2),
 sb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket) AS seq FROM bars)"""


def hour_bars(t):
    return ts.time_bars(t.ticks, ["symbol"], ORD, "1 hour")


PIV = """pv AS (SELECT *, count(*) OVER l = 2 AND count(*) OVER r = 2 AND high > max(high) OVER l AND high > max(high) OVER r AS ph,
 count(*) OVER l = 2 AND count(*) OVER r = 2 AND low < min(low) OVER l AND low < min(low) OVER r AS pl FROM sb
 WINDOW l AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))"""


@query("win_13_pivots", f"WITH {TICKS}, {BARS}, {PIV} SELECT symbol, strftime(bucket, '%Y-%m-%d %H') AS bucket, ph AS pivot_high, pl AS pivot_low FROM pv WHERE ph OR pl")
def _(t):
    out = win.pivots(hour_bars(t), ["symbol"], ["bucket"], "high", "low", BLOCKS)
    return out.where("pivot_high or pivot_low").select("symbol", F.date_format("bucket", "yyyy-MM-dd HH").alias("bucket"), "pivot_high", "pivot_low")


@query(
    "win_14_liquidation_zones",
    f"""WITH {TICKS}, {BARS}, {PIV},
 x AS (SELECT *, lead(high - low, 2) OVER w * 0.25 AS pad, avg(volume) OVER h AS va, max(volume) OVER h AS vm FROM pv
   WINDOW w AS (PARTITION BY symbol ORDER BY bucket), h AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 497 PRECEDING AND 2 FOLLOWING)),
 z AS (SELECT symbol, seq, 'above' AS side, high + pad AS top, high AS bottom, volume, va, vm FROM x WHERE ph
   UNION ALL SELECT symbol, seq, 'below', low, low - pad, volume, va, vm FROM x WHERE pl),
 e AS (SELECT z.symbol, z.seq, z.side, min(b.seq) AS end_seq FROM z JOIN sb b ON z.symbol = b.symbol AND b.seq >= z.seq + 2
   AND b.high > (z.top + z.bottom) / 2 AND b.low < (z.top + z.bottom) / 2 GROUP BY ALL)
 SELECT z.symbol, z.seq AS start_seq, z.side, {rnd('top')} AS top, {rnd('bottom')} AS bottom,
  {rnd('CASE WHEN vm > 0 THEN CASE WHEN volume > va THEN least(1.0, volume / vm) WHEN va > 0 THEN volume / (va * 2) ELSE 0.5 END ELSE 0.5 END')} AS intensity,
  end_seq, CASE WHEN end_seq IS NULL THEN 'open' ELSE 'consumed' END AS status FROM z LEFT JOIN e USING (symbol, seq, side)""",
)
def _(t):
    b = hour_bars(t).withColumn("atr", F.col("high") - F.col("low"))
    z = win.liquidation_zones(b, ["symbol"], ["bucket"], BLOCKS)
    return z.select("symbol", "start_seq", "side", rounded("top").alias("top"), rounded("bottom").alias("bottom"), rounded("intensity").alias("intensity"), "end_seq", "status")


@query(
    "win_15_trend_counter",
    f"""WITH RECURSIVE {TICKS}, {BARS},
 c AS (SELECT *, (high + low) / 2 > (max(high) OVER f + min(low) OVER f) / 2 AS up FROM sb WINDOW f AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 rr AS (SELECT symbol, seq, CAST(least(seq - coalesce(max(CASE WHEN NOT up THEN seq END) OVER (PARTITION BY symbol ORDER BY seq), 19), 20) AS DOUBLE) AS raw FROM c WHERE seq >= 20),
 e AS (SELECT symbol, seq, raw, raw AS ema FROM rr WHERE seq = 20 UNION ALL
   SELECT rr.symbol, rr.seq, rr.raw, rr.raw / 3 + e.ema * 2 / 3 FROM e JOIN rr ON rr.symbol = e.symbol AND rr.seq = e.seq + 1),
 v AS (SELECT symbol, seq, raw, round_even(ema, 0) AS value FROM e WHERE seq >= 24),
 a AS (SELECT *, avg(value) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS m FROM v)
 SELECT symbol, seq, raw, value, {rnd('m')} AS avg50, CASE WHEN value > m * 1.5 THEN 'STRONG_UP' WHEN value > m THEN 'UP'
  WHEN value < m * 0.5 THEN CASE WHEN value < 2 THEN 'STRONG_DOWN' ELSE 'DOWN' END WHEN value < m THEN 'DOWN' ELSE 'NEUTRAL' END AS trend,
  {rnd('least(1.0, value / 20)')} AS strength FROM a""",
)
def _(t):
    out = win.trend_counter(hour_bars(t), ["symbol"], ["bucket"], BLOCKS)
    return out.select("symbol", "seq", "raw", "value", rounded("avg50").alias("avg50"), "trend", rounded("strength").alias("strength"))


@query(
    "win_16_sequence_gaps",
    f"""WITH {TICKS}, g AS (SELECT trader, event_id AS s, us, lag(event_id) OVER w AS ps, lag(us) OVER w AS pus FROM ticks WINDOW w AS (PARTITION BY trader ORDER BY ts, event_id))
 SELECT trader, 'sequence' AS kind, ps + 1 AS start_seq, s - 1 AS end_seq, pus AS start_us, us AS end_us FROM g WHERE s - ps > 1
 UNION ALL SELECT trader, 'time', ps, s, pus, us FROM g WHERE us - pus > 1800000000""",
)
def _(t):
    return win.sequence_gaps(t.ticks, ["trader"], ORD, "event_id", "us", BLOCKS)


@query(
    "win_17_wave_features",
    f"""WITH RECURSIVE {TICKS}, s AS (SELECT *, row_number() OVER w AS seq, lag(price) OVER w AS p1, lag(price, 2) OVER w AS p2 FROM ticks WINDOW w AS (PARTITION BY trader ORDER BY ts, event_id)),
 e AS (SELECT trader, seq, price AS eq FROM s WHERE seq = 1 UNION ALL SELECT s.trader, s.seq, 0.01 * s.price + 0.99 * e.eq FROM e JOIN s ON s.trader = e.trader AND s.seq = e.seq + 1),
 x AS (SELECT s.*, e.eq, count(*) OVER f AS n, list(price) OVER f AS recent, (max(price) OVER f - min(price) OVER f) / 2 AS amp FROM s JOIN e USING (trader, seq)
   WINDOW f AS (PARTITION BY trader ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
 SELECT event_id, {rnd('eq')} AS equilibrium, {rnd('coalesce(price - p1, 0)')} AS velocity, {rnd('coalesce((price - p1) - (p1 - p2), 0)')} AS acceleration, {rnd('price - eq')} AS displacement,
  {rnd("CASE WHEN n = 50 AND len([i FOR i IN range(1, 50) IF (recent[i] - eq) * (recent[i + 1] - eq) < 0]) > 3.5 THEN amp END")} AS standing_wave FROM x""",
)
def _(t):
    out = win.wave_features(t.ticks, ["trader"], ORD, "price", BLOCKS)
    cols = ("equilibrium", "velocity", "acceleration", "displacement", "standing_wave")
    return out.select("event_id", *[rounded(c).alias(c) for c in cols])


@query(
    "win_18_crossing_frequency",
    f"""WITH {TICKS}, m AS (SELECT *, price - avg(price) OVER (PARTITION BY symbol) AS d FROM ticks), l AS (SELECT symbol, d, lag(d) OVER {SYM} AS pd FROM m),
 a AS (SELECT symbol, count(*) AS n, count(*) FILTER (pd * d < 0) AS crossings FROM l GROUP BY 1)
 SELECT symbol, n, crossings, {rnd('CASE WHEN n >= 10 THEN crossings / n END')} AS nyquist, CASE WHEN n >= 10 AND crossings > 0 THEN 5 ELSE 1 END AS factor FROM a""",
)
def _(t):
    return win.crossing_frequency(t.ticks, ["symbol"], ORD, "price", BLOCKS).withColumn("nyquist", rounded("nyquist"))
