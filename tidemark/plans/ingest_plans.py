"""Queries for readers, catalog and parsing (ING). File round trips go through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse
from ..session import scratch_path
from ..sources import catalog as cat
from ..sources import market_files as mf
from ..sources import messages
from .registry import TICKS, query, rnd, rounded

SYMS = "CASE symbol WHEN 'view' THEN 'BTCUSDT-PERP' WHEN 'click' THEN 'eth-usdt-perp' WHEN 'error' THEN 'SOL/USDT:USDT' WHEN 'signup' THEN 'XRPUSD' ELSE 'DOGE' END"


def market(t):
    s = F.col("symbol")
    sym = F.when(s == "view", "BTCUSDT-PERP").when(s == "click", "eth-usdt-perp").when(s == "error", "SOL/USDT:USDT").when(s == "signup", "XRPUSD").otherwise("DOGE")
    return t.ticks.select("event_id", "us", F.col("ts").alias("timestamp"), sym.alias("symbol"), F.concat(F.lit("V"), F.col("trader") % 3).alias("venue"), "price", "volume", "trader")


def csv_of(t, df, name: str) -> str:
    """Write text columns as headerless CSV, plus one file that has a header."""
    path = scratch_path(t.spark, name)
    df.where("part = 0").drop("part").write.csv(path)
    df.where("part = 1").drop("part").write.mode("append").option("header", "true").csv(path)
    return path


def _text(*cols):
    return [c.cast("string").alias(n) for c, n in cols]


def _odd():
    return (F.col("event_id") % 2).alias("part")


@query(
    "ing_01_klines_csv",
    f"""WITH {TICKS} SELECT us // 1000 AS ms, price AS open, CASE WHEN event_id % 10 <> 0 THEN price + 1 END AS high, price - 1 AS low, price AS close, volume FROM ticks""",
)
def _(t):
    p = F.col("price")
    hi = F.when(F.col("event_id") % 10 == 0, "oops").otherwise((p + 1).cast("string"))
    cols = _text((F.expr("us div 1000"), "open_time"), (p, "open"), (hi, "high"), (p - 1, "low"), (p, "close"), (F.col("volume"), "volume"))
    rest = [F.lit("0").alias(c) for c in mf.KLINES[6:]]
    out = mf.read_klines_csv(t.spark, csv_of(t, t.ticks.select(*cols, *rest, _odd()), "klines"))
    return out.select(F.unix_millis("timestamp").alias("ms"), "open", "high", "low", "close", "volume")


@query(
    "ing_02_aggtrades_csv",
    f"""WITH {TICKS} SELECT CAST(event_id AS VARCHAR) AS trade_id, us // 1000 AS ms, price, volume AS quantity, event_id % 3 = 0 AS buyer_maker FROM ticks WHERE event_id % 11 <> 0""",
)
def _(t):
    e = F.col("event_id")
    price = F.when(e % 11 == 0, "n/a").otherwise(F.col("price").cast("string"))
    maker = F.when(e % 3 == 0, F.when(e % 2 == 0, "True").otherwise("true")).otherwise("false")
    cols = _text((e, "agg_trade_id"), (price, "price"), (F.col("volume"), "quantity"), (e, "first_trade_id"), (e, "last_trade_id"), (F.expr("us div 1000"), "transact_time"), (maker, "is_buyer_maker"))
    out = mf.read_aggtrades_csv(t.spark, csv_of(t, t.ticks.select(*cols, _odd()), "aggtrades"))
    return out.select("trade_id", F.unix_millis("timestamp").alias("ms"), "price", "quantity", "buyer_maker")


@query("ing_03_trades_csv", f"WITH {TICKS} SELECT CAST(event_id AS VARCHAR) AS trade_id, us // 1000 AS ms, price, volume AS quantity, event_id % 3 = 0 AS buyer_maker FROM ticks")
def _(t):
    e = F.col("event_id")
    cols = _text((e, "id"), (F.col("price"), "price"), (F.col("volume"), "qty"), (F.col("price") * F.col("volume"), "quote_qty"), (F.expr("us div 1000"), "time"), (e % 3 == 0, "is_buyer_maker"))
    out = mf.read_trades_csv(t.spark, csv_of(t, t.ticks.select(*cols, _odd()), "trades"))
    return out.select("trade_id", F.unix_millis("timestamp").alias("ms"), "price", "quantity", "buyer_maker")


@query(
    "ing_04_funding_csv",
    f"""WITH {TICKS} SELECT us // 1000 * 1000000 AS ts_event, 8 AS funding_interval_hours, price / 100000 AS funding_rate, us // 1000 * 1000000 + 8 * 3600000000000 AS next_funding_ns FROM ticks WHERE event_id % 13 <> 0""",
)
def _(t):
    ms = F.when(F.col("event_id") % 13 == 0, F.lit(16725225600001)).otherwise(F.expr("us div 1000"))
    cols = _text((ms, "calc_time"), (F.lit(8), "funding_interval_hours"), (F.col("price") / 100000, "last_funding_rate"))
    return mf.read_funding_csv(t.spark, csv_of(t, t.ticks.select(*cols, _odd()), "funding")).withColumn("funding_interval_hours", F.col("funding_interval_hours").cast("int"))


def _daily_files(t) -> str:
    """One text file per day and symbol, dated in its name."""
    path = scratch_path(t.spark, "files")
    src = t.ticks.select("symbol", F.to_date("ts").alias("d"), F.concat_ws(",", "event_id", "us", "price").alias("line"))
    src.repartition("symbol", "d").write.partitionBy("symbol", "d").text(path)
    return path


@query(
    "ing_05_discover_files",
    "SELECT event_type AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, 1 AS files FROM events WHERE CAST(ts AS DATE) BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY 1, 2",
)
def _(t):
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_daily_files(t)).select("path")
    day = F.try_to_date(F.regexp_extract("path", r"d=(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    f = files.select(F.regexp_extract("path", "symbol=([^/]+)", 1).alias("symbol"), day.alias("day")).where("day between '2024-01-05' and '2024-01-20'")
    return f.groupBy("symbol", F.col("day").cast("string").alias("day")).agg(F.count("*").cast("int").alias("files"))


@query(
    "ing_06_incremental_manifest",
    """SELECT event_type AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS records, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events WHERE event_type <> 'view' GROUP BY 1, 2""",
)
def _(t):
    """Files of one symbol are in the manifest already; the others are pending and get their rows."""
    path = _daily_files(t)
    name = lambda c: F.struct(F.regexp_extract(c, "symbol=([^/]+)", 1).alias("symbol"), F.regexp_extract(c, r"d=(\d{4}-\d{2}-\d{2})", 1).alias("day"))
    lines = t.spark.read.text(path).withColumn("path", F.col("_metadata.file_path"))
    rows = lines.select("path", F.split("value", ",")[1].cast("long").alias("us"))
    manifest = mf.manifest_rows(rows, "us", F.col("path"))
    pending = mf.pending_files(manifest, manifest.where(F.col("path").contains("symbol=view")))
    return pending.select(name(F.col("path")).alias("n"), "records", F.col("first_ts").alias("first_us"), F.col("last_ts").alias("last_us")).select("n.*", "records", "first_us", "last_us")


def _catalog(t) -> str:
    path = scratch_path(t.spark, "catalog")
    # a folder name holds no slash: such symbols are filed with a dash
    m = market(t).withColumn("symbol", F.replace("symbol", F.lit("/"), F.lit("-"))).withColumn("funding_rate", F.col("price") / 100000)
    cat.write_catalog(m, path)
    return path


CATALOG = "event_id long, timestamp timestamp, price double, funding_rate double, venue string, symbol string, dt date"


@query(
    "ing_07_catalog_write",
    f"""WITH {TICKS}, m AS (SELECT *, replace({SYMS}, '/', '-') AS s FROM ticks) SELECT 'V' || trader % 3 AS venue, s AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, count(*) AS n, {rnd('sum(price)', 4)} AS total FROM m GROUP BY 1, 2, 3""",
)
def _(t):
    back = t.spark.read.parquet(_catalog(t))
    return back.groupBy("venue", "symbol", F.col("dt").cast("string").alias("dt")).agg(F.count("*").alias("n"), rounded(F.sum("price"), 4).alias("total"))


@query(
    "ing_08_catalog_read",
    f"WITH {TICKS} SELECT event_id, price FROM ticks WHERE symbol = 'view' AND trader % 3 = 1 AND ts BETWEEN '2024-01-05 06:00:00' AND '2024-01-17 12:00:00'",
)
def _(t):
    return cat.read_catalog(t.spark, _catalog(t), "BTCUSDT-PERP", "V1", "2024-01-05 06:00:00", "2024-01-17 12:00:00", schema=CATALOG).select("event_id", "price")


@query("ing_08_recent_funding", f"WITH {TICKS} SELECT event_id, {rnd('price / 100000 * 3 * 365 * 100')} AS annualized FROM ticks WHERE symbol = 'view' ORDER BY ts DESC, event_id DESC LIMIT 20")
def _(t):
    return cat.recent_funding(cat.read_catalog(t.spark, _catalog(t), "BTCUSDT-PERP", schema=CATALOG), tie=["event_id"]).select("event_id", rounded("annualized").alias("annualized"))


@query("ing_09_upsert_dedup", f"WITH {TICKS} SELECT trader, symbol, arg_max(price, event_id) AS price, max(event_id) AS event_id FROM ticks GROUP BY 1, 2")
def _(t):
    return cat.upsert_dedup(t.ticks.select("trader", "symbol", "price", "event_id"), ["trader", "symbol"], ["event_id"])


@query(
    "ing_09_upsert_columns",
    """WITH u AS (SELECT o_custkey AS k, max(o_totalprice) AS bal FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT 1000000 + o_custkey, max(o_totalprice) FROM orders WHERE o_totalprice > 400000 GROUP BY 1)
 SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN c_custkey IS NULL THEN 'new' ELSE c_name END AS c_name, coalesce(bal, c_acctbal) AS c_acctbal FROM customer FULL JOIN u ON c_custkey = k""",
)
def _(t):
    cur = t.customer.select("c_custkey", "c_name", "c_acctbal")
    o = t.orders
    a = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    b = o.where("o_totalprice > 400000").groupBy((F.col("o_custkey") + 1000000).alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    upd = a.union(b).withColumn("c_name", F.lit("new"))
    return cat.upsert_columns(cur, upd, ["c_custkey"], ["c_acctbal"])


@query("ing_10_last_timestamps", f"WITH {TICKS} SELECT symbol, 'V' || trader % 3 AS venue, max(us) AS last_us FROM ticks GROUP BY 1, 2")
def _(t):
    m = t.ticks.select("symbol", F.concat(F.lit("V"), F.col("trader") % 3).alias("venue"), F.col("ts").alias("timestamp"))
    return cat.last_timestamps(m).select("symbol", "venue", F.unix_micros("last_ts").alias("last_us"))


AUDIT = "ts_event long, event_type string, source string, sequence long, value double"


def _audit_table(t) -> str:
    """JSON lines with blank and broken ones, compacted to Parquet."""
    src, dst = scratch_path(t.spark, "jsonl"), scratch_path(t.spark, "audit")
    e = t.events.select((F.unix_micros("ts") * 1000).alias("ts_event"), "event_type", F.lit("s").alias("source"), F.col("event_id").alias("sequence"), "value")
    good = F.to_json(F.struct(*e.columns))
    line = F.when(F.col("sequence") % 17 == 0, F.lit("")).when(F.col("sequence") % 19 == 0, F.lit('{"ts_event": 12, broken')).otherwise(good)
    e.select(line.alias("value")).write.text(src)
    cat.compact_jsonl(t.spark, src, dst, AUDIT)
    return dst


_KEPT = "event_id % 17 <> 0 AND event_id % 19 <> 0"


@query(
    "ing_11_jsonl_compaction",
    f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, event_type, count(*) AS n, {rnd('sum(value)', 4)} AS total FROM events WHERE {_KEPT} GROUP BY 1, 2",
)
def _(t):
    return t.spark.read.parquet(_audit_table(t)).groupBy(F.col("dt").cast("string").alias("dt"), "event_type").agg(F.count("*").alias("n"), rounded(F.sum("value"), 4).alias("total"))


@query("ing_12_retention", f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, count(*) AS n FROM events WHERE {_KEPT} AND CAST(ts AS DATE) >= DATE '2024-01-31' - 10 GROUP BY 1")
def _(t):
    path = _audit_table(t)
    cat.drop_expired(t.spark, path, "2024-01-31", 10)
    return cat.live_partitions(t.spark.read.parquet(path), "2024-01-31", 10).groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count("*").alias("n"))


@query("ing_13_partition_stats", f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, count(*) AS rows, true AS has_files FROM events WHERE {_KEPT} GROUP BY 1")
def _(t):
    st = cat.partition_stats(t.spark.read.parquet(_audit_table(t)))
    return st.select(F.col("dt").cast("string").alias("dt"), "rows", ((F.col("files") > 0) & (F.col("bytes") > 0)).alias("has_files"))


@query("ing_14_table_export", "SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_custkey) AS keys FROM customer GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "export")
    cat.export_table(t.customer, path, "csv")
    back = t.spark.read.option("header", "true").csv(path)
    return back.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("keys"))


@query(
    "ing_15_funding_updates",
    f"WITH {TICKS} SELECT symbol || '.V' || trader % 3 AS instrument_id, price / 100000 AS rate, us * 1000 AS ts_event, (us + 28800000000) * 1000 AS next_funding_ns FROM ticks WHERE event_id % 5 <> 0",
)
def _(t):
    m = t.ticks.select(
        "symbol",
        F.concat(F.lit("V"), F.col("trader") % 3).alias("venue"),
        F.col("ts").alias("timestamp"),
        F.when(F.col("event_id") % 5 != 0, F.col("price") / 100000).alias("funding_rate"),
        (F.col("ts") + F.expr("interval 8 hours")).alias("next_funding_time"),
    )
    return cat.funding_updates(m)


def raw_messages(t):
    """Venue messages built from ticks: three layouts, some unrelated, some with size 0."""
    e, ms = F.col("event_id"), F.expr("us div 1000")
    qty = F.when(e % 23 == 0, "0").otherwise(F.col("volume").cast("int").cast("string"))
    px = F.col("price").cast("decimal(12,2)").cast("string")
    a = F.format_string('{"e":"forceOrder","E":1,"o":{"s":"BTCUSDT","S":"%s","q":"%s","p":"1","ap":"%s","T":%d}}', F.when(e % 2 == 0, "SELL").otherwise("BUY"), qty, px, ms)
    b = F.format_string('{"topic":"liquidation.ETHUSDT","ts":1,"data":{"updatedTime":%d,"symbol":"ETHUSDT","side":"%s","size":"%s","price":"%s"}}', ms, F.when(e % 2 == 0, "Sell").otherwise("Buy"), qty, px)
    c = F.format_string(
        '{"channel":"trades","data":[{"coin":"SOL","side":"B","px":"1","sz":"1","time":1},{"coin":"SOL","side":"%s","px":"%s","sz":"%s","time":%d,"liquidation":true}]}', F.when(e % 2 == 0, "A").otherwise("B"), px, qty, ms
    )
    raw = F.when(e % 4 == 0, a).when(e % 4 == 1, b).when(e % 4 == 2, c).otherwise('{"e":"ping"}')
    return t.ticks.select("event_id", "ts", raw.alias("raw"))


LIQ = """lq AS (SELECT event_id, us // 1000 AS ms, ['BTCUSDT-PERP', 'ETHUSDT-PERP', 'SOLUSDT-PERP'][event_id % 4 + 1] AS symbol, ['BINANCE', 'BYBIT', 'HYPERLIQUID'][event_id % 4 + 1] AS venue,
 CASE WHEN event_id % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side, volume AS quantity, price, price * volume AS value FROM ticks WHERE event_id % 4 <> 3 AND event_id % 23 <> 0 AND volume > 0)"""


@query("ing_16_liquidation_messages", f"WITH {TICKS}, {LIQ} SELECT event_id, ms, symbol, venue, side, quantity, price, {rnd('value', 4)} AS value FROM lq")
def _(t):
    out = messages.normalize_liquidations(raw_messages(t), symbols=["BTCUSDT-PERP"])
    return out.select("event_id", F.unix_millis("timestamp").alias("ms"), "symbol", "venue", "side", "quantity", "price", rounded("value", 4).alias("value"))


@query(
    "ing_17_symbol_names",
    f"WITH {TICKS} SELECT symbol, CASE symbol WHEN 'view' THEN 'BTC/USDT:USDT' WHEN 'click' THEN 'ETH/USDT:USDT' WHEN 'error' THEN 'SOL/USDT:USDT' WHEN 'signup' THEN 'XRP/USD:USD' ELSE 'DOGE' END AS unified, count(*) AS n FROM ticks GROUP BY 1",
)
def _(t):
    j = market(t).select("event_id", parse.normalize_symbol(F.col("symbol")).alias("unified")).join(t.ticks.select("event_id", "symbol"), "event_id")
    return j.groupBy("symbol", "unified").agg(F.count("*").alias("n"))


@query(
    "ing_18_safe_parse",
    """WITH x AS (SELECT event_id, value, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'nan' WHEN 2 THEN 'oops' WHEN 3 THEN 'inf' ELSE CAST(value AS VARCHAR) END AS s, event_id % 6 >= 4 AS ok FROM events)
 SELECT event_id, CASE WHEN ok THEN value ELSE -1e0 END AS f, CAST(CASE WHEN ok THEN trunc(value) ELSE 0 END AS BIGINT) AS i, coalesce(CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'x' END, 'N/A') AS s FROM x""",
)
def _(t):
    e = F.col("event_id") % 6
    s = F.when(e == 0, F.lit(None).cast("string")).when(e == 1, "nan").when(e == 2, "oops").when(e == 3, "inf").otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", parse.safe_float(s, -1.0).alias("f"), parse.safe_int(s).alias("i"), parse.safe_str(F.when(e != 0, "x"), "N/A").alias("s"))


@query(
    "ing_19_row_validation",
    f"""WITH {TICKS}, v AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'empty_symbol' END AS a, CASE WHEN ts > '2024-01-25' THEN 'future_timestamp' END AS b, CASE WHEN volume <= 20 THEN 'quantity_not_positive' END AS c FROM ticks)
 SELECT coalesce(a, '') || '|' || coalesce(b, '') || '|' || coalesce(c, '') AS code, count(*) AS n FROM v GROUP BY 1""",
)
def _(t):
    src = t.ticks.select(F.when(F.col("event_id") % 9 == 0, " ").otherwise("btc").alias("symbol"), F.col("ts").alias("timestamp"), (F.col("volume") - 20).alias("quantity"), F.lit(1.0).alias("price"), F.lit(1.0).alias("value"))
    v = parse.validate(src, "liquidations", F.lit("2024-01-25").cast("timestamp"))
    has = lambda r: F.when(F.array_contains("errors", r), r).otherwise("")
    return v.groupBy(F.concat_ws("|", has("empty_symbol"), has("future_timestamp"), has("quantity_not_positive")).alias("code")).agg(F.count("*").alias("n"))
