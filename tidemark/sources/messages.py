"""Raw venue messages to typed liquidation rows; usable on batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Message layouts of the three venues (the order layout has keys that differ only in
# case, e/E and s/S, so it is read by path instead).
TOPIC_LAYOUT = "topic string, ts long, data struct<updatedTime:long, symbol:string, side:string, size:string, price:string>"
TRADE_LAYOUT = "channel string, data array<struct<coin:string, side:string, px:string, sz:string, time:long, liquidation:boolean>>"


def _row(ms: Column, symbol: Column, venue: str, side: Column, price: Column, qty: Column) -> Column:
    return F.struct(
        F.timestamp_millis(ms).alias("timestamp"), symbol.alias("symbol"), F.lit(venue).alias("venue"), side.alias("side"), qty.alias("quantity"), price.alias("price"), (price * qty).alias("value")
    )


def normalize_liquidations(df: DataFrame, raw: str = "raw", symbols: list[str] | None = None) -> DataFrame:
    """One typed row per valid message; other messages and non-positive prices or sizes are dropped.

    A forced SELL closes a LONG. A trade batch yields its first valid liquidation. ``symbols`` keeps
    only these base assets on the order layout, whose stream carries every symbol.
    """
    text = F.col(raw)
    # a message is parsed only for the layout whose marker it holds
    marked = lambda marker, parsed: F.when(F.contains(text, F.lit(marker)), parsed)
    d = df.withColumns(
        {
            "_o": marked('"forceOrder"', F.try_parse_json(text)),
            "_t": marked('"liquidation.', F.from_json(text, TOPIC_LAYOUT)),
            "_c": marked('"trades"', F.from_json(text, TRADE_LAYOUT)),
        }
    )
    num = lambda x: x.try_cast("double")
    o = lambda path, kind="string": F.try_variant_get(F.col("_o"), path, kind)
    order_ok = o("$.e") == "forceOrder"
    if symbols is not None:
        base = F.regexp_replace(F.regexp_replace(o("$.o.s"), "USDT", ""), "USD", "")
        names = F.array(*[F.lit(s.upper().replace("-", "").replace("/", "")) for s in symbols])
        order_ok = order_ok & F.exists(names, lambda n: F.contains(n, base))
    px = num(F.coalesce(o("$.o.ap"), o("$.o.p")))
    side = F.when(o("$.o.S") == "SELL", "LONG").otherwise("SHORT")
    order = _row(F.coalesce(o("$.o.T", "long"), o("$.E", "long")), F.concat(o("$.o.s"), F.lit("-PERP")), "BINANCE", side, px, num(o("$.o.q")))
    topic_ok = F.col("_t.topic").startswith("liquidation.") & F.col("_t.data").isNotNull()
    topic = _row(
        F.coalesce("_t.data.updatedTime", "_t.ts"), F.concat("_t.data.symbol", F.lit("-PERP")), "BYBIT", F.when(F.col("_t.data.side") == "Buy", "SHORT").otherwise("LONG"), num(F.col("_t.data.price")), num(F.col("_t.data.size"))
    )
    first = F.get(F.filter("_c.data", lambda x: F.coalesce(x["liquidation"], F.lit(False)) & (num(x["px"]) > 0) & (num(x["sz"]) > 0)), 0)
    trade = _row(first["time"], F.concat(first["coin"], F.lit("USDT-PERP")), "HYPERLIQUID", F.when(first["side"] == "A", "LONG").otherwise("SHORT"), num(first["px"]), num(first["sz"]))
    row = F.when(order_ok, order).when(topic_ok, topic).when(F.col("_c.channel") == "trades", trade)
    keep = [x for x in df.columns if x != raw]
    valid = F.filter(F.array(row), lambda r: (r["price"] > 0) & (r["quantity"] > 0))
    return d.select(*keep, F.explode(valid).alias("_row")).select(*keep, "_row.*")
