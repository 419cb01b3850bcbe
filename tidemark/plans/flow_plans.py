"""Queries for recursive filters (AFF) and order flow (OF)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import orderflow as of
from ..operators import recurrences as rec
from ..operators import timeseries as ts
from ..operators import windows as win
from ..operators.blocks import RowBlocks
from .registry import DAILY, TICKS, query, rnd, rounded
from .window_plans import daily_returns

ORD = ["ts", "event_id"]
BLOCKS = RowBlocks()
ROWS = win.ROWS

# trader series: seq, previous price and time, simple return (0 first)
SER = """s AS (SELECT *, row_number() OVER w AS seq, lag(price) OVER w AS p1, lag(us) OVER w AS u1, coalesce(price / lag(price) OVER w - 1, 0) * 0.01 AS r
 FROM ticks WINDOW w AS (PARTITION BY trader ORDER BY ts, event_id))"""


def recur(first: dict[str, str], step: dict[str, str], src: str = "s", key: str = "trader", name: str = "y") -> str:
    """Recursive CTE over a numbered series: y(seq=1) = first, later y = step (may use y.<col>)."""
    f = ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in first.items())
    st = ", ".join(f"CAST({e} AS DOUBLE)" for e in step.values())
    return f"{name} AS (SELECT {key}, seq, {f} FROM {src} WHERE seq = 1 UNION ALL SELECT s.{key}, s.seq, {st} FROM {name} y JOIN {src} s ON s.{key} = y.{key} AND s.seq = y.seq + 1)"


def series(t):
    """Ticks with the scaled simple return per trader."""
    d = win.counter_delta(t.ticks, ["trader"], ORD, "price", BLOCKS, "_d")
    r = F.coalesce(F.col("price") / (F.col("price") - F.col("_d")) - 1, F.lit(0.0)) * 0.01
    return d.withColumn("r", r).drop("_d")


def ema_step(alpha, x, y):
    return f"{alpha} * {x} + (1 - {alpha}) * y.{y}"


A20 = 2 / 21


@query(
    "aff_01_ema",
    f"""WITH RECURSIVE {TICKS}, {SER}, {recur({'e5': 'price', 'e20': 'price'}, {'e5': ema_step(1 / 3, 's.price', 'e5'), 'e20': ema_step(A20, 's.price', 'e20')})}
 SELECT event_id, {rnd('e5')} AS ema5, {rnd('e20')} AS ema20 FROM s JOIN y USING (trader, seq)""",
)
def _(t):
    out = rec.ema(t.ticks, ["trader"], ORD, "price", BLOCKS, {"ema5": 5, "ema20": 20})
    return out.select("event_id", rounded("ema5").alias("ema5"), rounded("ema20").alias("ema20"))


@query(
    "aff_01_ema_hot_key",
    f"""WITH {TICKS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS seq FROM ticks)
 SELECT a.event_id, {rnd('sum(b.price * CASE WHEN b.seq = 1 THEN 1 ELSE 1e0 / 3 END * pow(2e0 / 3, a.seq - b.seq))')} AS ema FROM n a JOIN n b ON a.symbol = b.symbol AND b.seq <= a.seq AND b.seq > a.seq - 120 GROUP BY 1""",
)
def _(t):
    """Same filter on keys that hold a fifth of all rows each; weights older than 120 rows are below 1e-20."""
    return rec.ema(t.ticks, ["symbol"], ORD, "price", BLOCKS, {"ema": 5}).select("event_id", rounded("ema").alias("ema"))


@query(
    "aff_02_high_pass",
    f"""WITH RECURSIVE {TICKS}, {SER}, {recur({'h': '0'}, {'h': f'{A20} * (y.h + s.price - s.p1)'})} SELECT event_id, {rnd('h')} AS hp FROM s JOIN y USING (trader, seq)""",
)
def _(t):
    return rec.high_pass(t.ticks, ["trader"], ORD, "price", BLOCKS, 20).select("event_id", rounded("hp").alias("hp"))


@query(
    "aff_03_ew_mean_variance",
    f"""WITH RECURSIVE {TICKS}, {SER}, {recur({'m': 'price', 'v': '0'}, {'m': 'y.m + 0.05 * (s.price - y.m)', 'v': '0.95 * (y.v + 0.05 * (s.price - y.m) * (s.price - y.m))'})}
 SELECT event_id, {rnd('m')} AS ew_mean, {rnd('v', 4)} AS ew_var FROM s JOIN y USING (trader, seq)""",
)
def _(t):
    out = rec.ew_moments(t.ticks, ["trader"], ORD, "price", BLOCKS, {"ew": 0.05})
    return out.select("event_id", rounded("ew_mean").alias("ew_mean"), rounded("ew_var", 4).alias("ew_var"))


@query(
    "aff_04_atr",
    f"""WITH RECURSIVE {TICKS}, b AS (SELECT trader, CAST(ts AS DATE) AS day, max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close FROM ticks GROUP BY 1, 2),
 q AS (SELECT *, row_number() OVER w AS seq, lag(close) OVER w AS pc FROM b WINDOW w AS (PARTITION BY trader ORDER BY day)),
 q2 AS (SELECT *, CASE WHEN seq > 1 THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM q),
 s AS (SELECT *, avg(tr) OVER (PARTITION BY trader ORDER BY seq ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS seed FROM q2),
 y AS (SELECT trader, seq, seed AS a FROM s WHERE seq = 15 UNION ALL SELECT s.trader, s.seq, s.tr / 14 + y.a * 13 / 14 FROM y JOIN s ON s.trader = y.trader AND s.seq = y.seq + 1)
 SELECT s.trader, CAST(s.day AS VARCHAR) AS day, {rnd('a')} AS atr FROM s LEFT JOIN y USING (trader, seq)""",
)
def _(t):
    bars = ts.time_bars(t.ticks, ["trader"], ORD, "1 day")
    out = rec.atr(bars, ["trader"], ["bucket"], BLOCKS, rows=ROWS)
    return out.select("trader", F.to_date("bucket").cast("string").alias("day"), rounded("atr").alias("atr"))


_EW = {"mf": "r", "vf": "0", "ms": "r", "vs": "0", "mo": "r"}
_EWS = {
    "mf": "y.mf + 2e0 / 11 * (s.r - y.mf)",
    "vf": "9e0 / 11 * (y.vf + 2e0 / 11 * (s.r - y.mf) * (s.r - y.mf))",
    "ms": "y.ms + 2e0 / 51 * (s.r - y.ms)",
    "vs": "49e0 / 51 * (y.vs + 2e0 / 51 * (s.r - y.ms) * (s.r - y.ms))",
    "mo": "2e0 / 21 * s.r + 19e0 / 21 * y.mo",
}


@query(
    "aff_05_variance_regime",
    f"""WITH RECURSIVE {TICKS}, {SER}, {recur(_EW, _EWS)}
 SELECT event_id, {rnd('mo', 8)} AS momentum, {rnd('sqrt(vs)')} AS volatility, {rnd('CASE WHEN vs < 1e-10 THEN 1 ELSE vf / vs END')} AS variance_ratio,
  CASE WHEN vs < 1e-10 THEN 'unknown' WHEN vf / vs > 1.5 THEN 'trending' WHEN vf / vs < 0.7 THEN 'mean_reverting' ELSE 'normal' END AS regime FROM s JOIN y USING (trader, seq)""",
)
def _(t):
    out = rec.variance_regime(series(t), ["trader"], ORD, "r", BLOCKS)
    return out.select("event_id", rounded("momentum", 8).alias("momentum"), rounded("volatility").alias("volatility"), rounded("variance_ratio").alias("variance_ratio"), "regime")


_K = "((y.p + 0.01) / (y.p + 0.01 + 0.1))"


@query(
    "aff_06_kalman",
    f"""WITH RECURSIVE {TICKS}, {SER}, {recur({'x': 'price', 'p': '1'}, {'x': f'y.x + {_K} * (s.price - y.x)', 'p': f'(1 - {_K}) * (y.p + 0.01)'})}
 SELECT event_id, {rnd('x')} AS kalman FROM s JOIN y USING (trader, seq)""",
)
def _(t):
    return rec.kalman(t.ticks, ["trader"], ORD, "price", BLOCKS).select("event_id", rounded("kalman").alias("kalman"))


@query(
    "aff_07_tape_speed",
    f"""WITH RECURSIVE {TICKS}, {SER}, q AS (SELECT *, seq - 1 AS k, 1e9 / (us - u1) AS inst FROM s WHERE seq > 1),
 y AS (SELECT trader, k, inst AS lam FROM q WHERE k = 1 UNION ALL SELECT q.trader, q.k, 0.1 * q.inst + 0.9 * y.lam FROM y JOIN q ON q.trader = y.trader AND q.k = y.k + 1),
 l AS (SELECT trader, k, lam, list(lam) OVER (PARTITION BY trader ORDER BY k ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS ls FROM y),
 b AS (SELECT s.event_id, coalesce(lam, 1e0) AS lam, CASE WHEN len(ls) >= 20 THEN list_sort(ls)[len(ls) // 2 + 1] ELSE 1e0 END AS base FROM s LEFT JOIN l ON l.trader = s.trader AND l.k = s.seq - 1)
 SELECT event_id, {rnd('lam')} AS rate, {rnd('least(2e0, lam / base)')} AS speed, CASE WHEN lam / base > 1.5 THEN 'fast' WHEN lam / base < 0.5 THEN 'slow' ELSE 'normal' END AS tape, {rnd('sqrt(least(2e0, lam / base))')} AS tape_weight FROM b""",
)
def _(t):
    out = rec.tape_speed(t.ticks, ["trader"], ORD, F.col("us"), BLOCKS, rows=ROWS, scale=1e9)
    return out.select("event_id", rounded("rate").alias("rate"), rounded("speed").alias("speed"), "tape", rounded("tape_weight").alias("tape_weight"))


_AK = f"""{recur({'v': 'abs(r)'}, {'v': '0.1 * abs(s.r) + 0.9 * y.v'})},
 m AS (SELECT trader, seq, list(abs(r)) OVER (PARTITION BY trader ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l FROM s),
 b AS (SELECT s.*, v, CASE WHEN len(l) >= 10 THEN list_sort(l)[len(l) // 2 + 1] ELSE v END AS base FROM s JOIN y USING (trader, seq) JOIN m USING (trader, seq)),
 ak AS (SELECT *, CASE WHEN base <= 1e-10 THEN 1e0 ELSE greatest(0.1, least(5.0, 1 / (1 + v / base))) END AS k FROM b)"""


@query("aff_08_adaptive_k", f"WITH RECURSIVE {TICKS}, {SER}, {_AK} SELECT event_id, {rnd('k')} AS k FROM ak")
def _(t):
    return rec.adaptive_k(series(t), ["trader"], ORD, "r", BLOCKS, rows=ROWS).select("event_id", rounded("k").alias("k"))


_SIDE = """sd AS (SELECT *, coalesce(last_value(CASE WHEN price > p THEN 'BUY' WHEN price < p THEN 'SELL' END IGNORE NULLS) OVER (PARTITION BY {k} ORDER BY ts, event_id), 'UNKNOWN') AS side
 FROM (SELECT *, lag(price) OVER (PARTITION BY {k} ORDER BY ts, event_id) AS p FROM ticks))"""


@query(
    "aff_09_hawkes",
    f"""WITH {TICKS}, {_SIDE.format(k='trader')}, n AS (SELECT *, row_number() OVER (PARTITION BY trader ORDER BY us) AS ticks FROM sd),
 i AS (SELECT a.event_id, a.trader, a.us, a.ticks, 0.1 + coalesce(sum(0.5 * exp(-0.00001 * (a.us - b.us) / 1e6)) FILTER (b.side = 'BUY'), 0) AS bi,
   0.1 + coalesce(sum(0.5 * exp(-0.00001 * (a.us - b.us) / 1e6)) FILTER (b.side = 'SELL'), 0) AS si FROM n a LEFT JOIN n b ON a.trader = b.trader AND b.us < a.us GROUP BY ALL)
 SELECT trader, us, {rnd('bi')} AS buy_intensity, {rnd('si')} AS sell_intensity, {rnd('CASE WHEN ticks >= 30 THEN (bi - si) / (bi + si + 1e-10) ELSE 0 END')} AS ofi FROM i""",
)
def _(t):
    sides = of.tick_rule(t.ticks, ["trader"], ORD, "price", BLOCKS)
    out = rec.hawkes(sides, ["trader"], ORD, "side", "us", BLOCKS, beta=0.00001, refit=30)
    return out.select("trader", "us", *[rounded(c).alias(c) for c in ("buy_intensity", "sell_intensity", "ofi")])


@query(
    "aff_10_discounted_posteriors",
    f"""WITH RECURSIVE {DAILY}, dr AS (SELECT strategy, day, (equity / lag(equity) OVER (PARTITION BY strategy ORDER BY day) - 1) * 0.01 AS ret FROM daily),
 x AS (SELECT *, row_number() OVER (ORDER BY day, strategy) AS step, ln(0.99 - 0.04 * greatest(0, least(1, (0.5 + abs(ret) * 20 - 0.7) / 0.8))) AS ld FROM dr WHERE ret IS NOT NULL),
 l AS (SELECT *, sum(ld) OVER (ORDER BY step) AS big FROM x),
 s AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY step) AS seq, exp(big - coalesce(lag(big) OVER (PARTITION BY strategy ORDER BY step), 0)) AS f,
   CASE WHEN ret >= 0 THEN least(1, ret * 10) ELSE 0 END AS up, CASE WHEN ret < 0 THEN least(1, -ret * 10) ELSE 0 END AS dn FROM l),
 {recur({'a': 'f + up', 'b': 'f + dn'}, {'a': 's.f * y.a + s.up', 'b': 's.f * y.b + s.dn'}, key='strategy')}
 SELECT strategy, CAST(day AS VARCHAR) AS day, {rnd('a')} AS successes, {rnd('b')} AS failures, {rnd('a / (a + b)')} AS mean FROM s JOIN y USING (strategy, seq)""",
)
def _(t):
    r = daily_returns(t).withColumn("ratio", 0.5 + F.abs("ret") * 20)
    out = rec.discounted_posteriors(r, "strategy", ["day", "strategy"], "ret", "52 weeks", rec.decay_from_ratio(F.col("ratio")))
    return out.select("strategy", F.col("day").cast("string").alias("day"), rounded("successes").alias("successes"), rounded("failures").alias("failures"), rounded("mean").alias("mean"))


STRATEGIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "aff_11_ema_correlations",
    f"""WITH RECURSIVE {DAILY}, dr AS (SELECT strategy, day, (equity / lag(equity) OVER (PARTITION BY strategy ORDER BY day) - 1) * 0.01 AS ret FROM daily),
 d AS (SELECT day, 1 AS one, row_number() OVER (ORDER BY day) AS seq FROM (SELECT DISTINCT day FROM dr WHERE ret IS NOT NULL)),
 g AS (SELECT d.day, d.seq, p.strategy, coalesce(dr.ret, 0) AS x FROM d CROSS JOIN (SELECT DISTINCT strategy FROM daily) p LEFT JOIN dr ON dr.day = d.day AND dr.strategy = p.strategy AND dr.ret IS NOT NULL),
 m AS (SELECT strategy, seq, x, x AS mu FROM g WHERE seq = 1 UNION ALL SELECT g.strategy, g.seq, g.x, 0.99 * m.mu + 0.01 * g.x FROM m JOIN g ON g.strategy = m.strategy AND g.seq = m.seq + 1),
 n AS (SELECT max(seq) AS n FROM d),
 c AS (SELECT a.strategy AS a, b.strategy AS b, sum(CASE WHEN a.seq = 1 THEN 0 ELSE 0.01 * pow(0.99, n.n - a.seq) * (a.x - a.mu) * (b.x - b.mu) END) AS c FROM m a JOIN m b ON a.seq = b.seq AND a.strategy <= b.strategy, n GROUP BY 1, 2)
 SELECT c.a, c.b, {rnd('CASE WHEN c.a = c.b THEN 1 ELSE 0.9 * c.c / greatest(sqrt(greatest(va.c, 1e-6)) * sqrt(greatest(vb.c, 1e-6)), 1e-6) END')} AS corr
 FROM c JOIN c va ON va.a = c.a AND va.b = c.a JOIN c vb ON vb.a = c.b AND vb.b = c.b""",
)
def _(t):
    out = rec.ema_correlations(daily_returns(t), "strategy", "day", "ret", t.daily.select("strategy"), "52 weeks")
    return out.withColumn("corr", rounded("corr"))


@query(
    "aff_12_blended_weights",
    f"""WITH RECURSIVE {TICKS}, {SER}, {recur({'w': 'greatest(0.15, least(0.4, 0.45 + 0.1 * volume / 100))'}, {'w': 'greatest(0.15, least(0.4, 0.9 * y.w + 0.1 * s.volume / 100))'})}
 SELECT event_id, {rnd('w')} AS weight FROM s JOIN y USING (trader, seq)""",
)
def _(t):
    src = t.ticks.withColumn("p", F.col("volume") / 100)
    return rec.blended_weights(src, ["trader"], ORD, "p", BLOCKS, low=0.15, high=0.4).select("event_id", rounded("weight").alias("weight"))


@query("of_01_tick_rule", f"WITH {TICKS}, {_SIDE.format(k='symbol')} SELECT event_id, side FROM sd")
def _(t):
    return of.tick_rule(t.ticks, ["symbol"], ORD, "price", BLOCKS).select("event_id", "side")


_HB = """hb AS (SELECT symbol, date_trunc('hour', ts) AS bucket, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low,
 arg_max(price, (ts, event_id)) AS close FROM ticks GROUP BY 1, 2)"""


@query(
    "of_02_bulk_volume_side",
    f"""WITH {TICKS}, {_HB} SELECT symbol, strftime(bucket, '%Y-%m-%d %H') AS bucket, CASE WHEN (close - low) / (high - low + 1e-10) > 0.5 THEN 'BUY' ELSE 'SELL' END AS side,
 {rnd('abs(0.5 - (close - low) / (high - low + 1e-10)) * 2')} AS confidence FROM hb""",
)
def _(t):
    b = ts.time_bars(t.ticks, ["symbol"], ORD, "1 hour")
    s = of.bulk_volume_side(F.col("close"), F.col("high"), F.col("low"))
    return b.select("symbol", F.date_format("bucket", "yyyy-MM-dd HH").alias("bucket"), s["side"].alias("side"), rounded(s["confidence"]).alias("confidence"))


@query(
    "of_03_close_vs_open_side",
    f"WITH {TICKS}, {_HB} SELECT symbol, strftime(bucket, '%Y-%m-%d %H') AS bucket, CASE WHEN close > open THEN 'BUY' WHEN close < open THEN 'SELL' ELSE 'UNKNOWN' END AS side FROM hb",
)
def _(t):
    b = ts.time_bars(t.ticks, ["symbol"], ORD, "1 hour")
    return b.select("symbol", F.date_format("bucket", "yyyy-MM-dd HH").alias("bucket"), of.close_vs_open_side(F.col("close"), F.col("open")).alias("side"))


_VB = f"""{_SIDE.format(k='symbol')}, cu AS (SELECT *, sum(volume) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS c FROM sd WHERE side <> 'UNKNOWN' AND volume > 0),
 pt AS (SELECT *, unnest(range(CAST(floor((c - volume) / 1000) AS BIGINT), CAST(ceil(c / 1000) AS BIGINT))) AS bucket FROM cu),
 vb AS (SELECT symbol, bucket, sum(CASE WHEN side = 'BUY' THEN least(c, (bucket + 1) * 1000) - greatest(c - volume, bucket * 1000) ELSE 0e0 END) AS buy,
   sum(CASE WHEN side = 'SELL' THEN least(c, (bucket + 1) * 1000) - greatest(c - volume, bucket * 1000) ELSE 0e0 END) AS sell, max(us) AS end_us FROM pt GROUP BY 1, 2)"""


def _buckets(t):
    return of.volume_buckets(of.tick_rule(t.ticks, ["symbol"], ORD, "price", BLOCKS), ["symbol"], ORD, "volume", "side", BLOCKS)


@query("of_04_volume_buckets", f"WITH {TICKS}, {_VB} SELECT symbol, bucket, buy, sell, end_us, buy + sell >= 1000 AS complete FROM vb")
def _(t):
    return _buckets(t).select("symbol", "bucket", "buy", "sell", F.unix_micros("end_ts").alias("end_us"), "complete")


_VP = """vp AS (SELECT *, CASE WHEN count(*) OVER f >= 50 THEN avg(abs(buy - sell) / (buy + sell)) OVER f ELSE 0 END AS vpin FROM vb WHERE buy + sell >= 1000
 WINDOW f AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"""


@query(
    "of_05_vpin",
    f"WITH {TICKS}, {_VB}, {_VP} SELECT symbol, bucket, {rnd('vpin')} AS vpin, CASE WHEN vpin < 0.3 THEN 'LOW' WHEN vpin < 0.7 THEN 'MEDIUM' ELSE 'HIGH' END AS toxicity FROM vp",
)
def _(t):
    return of.vpin(_buckets(t), ["symbol"], rows=40).select("symbol", "bucket", rounded("vpin").alias("vpin"), "toxicity")


@query(
    "of_06_flow_state",
    f"""WITH {TICKS}, q AS (SELECT *, (volume - (100 - volume)) / 100 AS imb, price / lag(price) OVER w - 1 AS r FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)),
 f AS (SELECT event_id, avg(imb) OVER a AS pressure, CASE WHEN avg(volume) OVER a > 0 THEN volume / avg(volume) OVER a ELSE 1 END AS flow_rate, coalesce(stddev_pop(r) OVER b, 0) AS turbulence FROM q
  WINDOW a AS (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN 18 PRECEDING AND CURRENT ROW))
 SELECT event_id, {rnd('pressure')} AS pressure, {rnd('flow_rate')} AS flow_rate, {rnd('turbulence', 5)} AS turbulence, {rnd('abs(flow_rate * pressure) / 0.1')} AS reynolds,
  CASE WHEN abs(flow_rate * pressure) / 0.1 < 0.5 THEN 'laminar' WHEN abs(flow_rate * pressure) / 0.1 < 1.5 THEN 'transitional' ELSE 'turbulent' END AS regime FROM f""",
)
def _(t):
    q = t.ticks.withColumns({"bid": F.col("price") * 0.999, "ask": F.col("price") * 1.001, "bid_size": F.col("volume"), "ask_size": 100 - F.col("volume")})
    out = of.flow_state(q, ["symbol"], ORD, BLOCKS, rows=ROWS)
    cols = {"pressure": 6, "flow_rate": 6, "turbulence": 5, "reynolds": 6}
    return out.select("event_id", "regime", *[rounded(c, d).alias(c) for c, d in cols.items()])


_DW = f"""{_SIDE.format(k='symbol')}, w AS (SELECT symbol, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') AS bucket, (count(*) FILTER (side = 'BUY') - count(*) FILTER (side = 'SELL'))
  / (count(*) FILTER (side = 'BUY') + count(*) FILTER (side = 'SELL') + 1e-10) AS ofi, arg_max(price, (ts, event_id)) AS close FROM sd GROUP BY 1, 2),
 l AS (SELECT *, lag(ofi) OVER x AS prev_ofi, lag(close) OVER x AS prev_close FROM w WINDOW x AS (PARTITION BY symbol ORDER BY bucket)),
 p AS (SELECT *, CAST(sign(prev_ofi) AS INT) AS predicted, CAST(sign(close - prev_close) AS INT) AS actual FROM l WHERE abs(prev_ofi) > 0.001)"""


def _windows(t):
    return of.direction_windows(of.tick_rule(t.ticks, ["symbol"], ORD, "price", BLOCKS), ["symbol"], ORD, "side", "price", BLOCKS, "2 hours")


@query(
    "of_07_direction_accuracy",
    f"""WITH {TICKS}, {_DW}, m AS (SELECT unnest(['all', CASE WHEN predicted > 0 THEN 'up' ELSE 'down' END]) AS direction, predicted = actual AS ok FROM p WHERE actual <> 0)
 SELECT direction, count(*) AS n, {rnd('avg(CAST(ok AS INT))')} AS accuracy FROM m GROUP BY 1""",
)
def _(t):
    return of.direction_accuracy(_windows(t)).withColumn("accuracy", rounded("accuracy"))


@query(
    "of_07_accuracy_by_quartile",
    f"""WITH {TICKS}, {_DW}, m AS (SELECT abs(prev_ofi) AS x, CAST(predicted = actual AS INT) AS ok FROM p WHERE actual <> 0), q AS (SELECT quantile_cont(x, [0.25, 0.5, 0.75]) AS c FROM m)
 SELECT 1 + CAST(x > c[1] AS INT) + CAST(x > c[2] AS INT) + CAST(x > c[3] AS INT) AS bucket, {rnd('avg(ok)')} AS mean, count(*) AS n FROM m, q GROUP BY 1""",
)
def _(t):
    from ..operators.aggregates import quantile_buckets

    m = _windows(t).where("actual != 0").select(F.abs("prev_ofi").alias("x"), F.col("correct").cast("double").alias("ok"))
    return quantile_buckets(m, "x", "ok", 0.01).select("bucket", rounded("mean").alias("mean"), "n")


@query(
    "of_08_information_decay",
    f"""WITH RECURSIVE {TICKS}, {SER}, {recur({'l': '0.95 * volume / 100'}, {'l': '0.95 * (y.l + s.volume / 100)'})} SELECT event_id, {rnd('l')} AS level, l > 0.1 AS informed FROM s JOIN y USING (trader, seq)""",
)
def _(t):
    out = of.information_decay(t.ticks.withColumn("shock", F.col("volume") / 100), ["trader"], ORD, "shock", BLOCKS)
    return out.select("event_id", rounded("level").alias("level"), "informed")


@query(
    "reg_10_wiener_shrink",
    f"WITH RECURSIVE {TICKS}, {SER}, {recur({'w': 'price'}, {'w': '2e0 / 3 * s.price + 1e0 / 3 * y.w'})} SELECT event_id, {rnd('w')} AS shrunk FROM s JOIN y USING (trader, seq)",
)
def _(t):
    return rec.wiener_shrink(t.ticks, ["trader"], ORD, "price", BLOCKS, 2.0).select("event_id", rounded("shrunk").alias("shrunk"))
