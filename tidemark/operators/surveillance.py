"""Order-abuse patterns, rate limits and audit-trail verification."""

from __future__ import annotations

import bisect
from collections import Counter, deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import micros, running, spread
from .grouped import Sweep, sequential

# Default abuse thresholds.
WASH_BAND, WASH_MATCHES, SPOOF_RATIO, SPOOF_ORDERS, BURST, LAYER_ORDERS, LAYER_LEVELS = 0.001, 3, 0.9, 5, 10, 10, 5


class _RecentOrders(Sweep):
    """Orders of one user and symbol inside the sliding window.

    Buy and sell prices are kept sorted, so the number of matching pairs is updated by two binary
    searches per order: pairs are counted, never listed.
    """

    def __init__(self, keep: Sequence[str], window: int, burst: int, band: float):
        self.keep, self.window, self.burst, self.band = list(keep), window, burst, band
        self.orders: deque = deque()
        self.close: deque = deque()
        self.sides: dict[str, list[float]] = {"buy": [], "sell": []}
        self.levels: dict[str, Counter] = {"buy": Counter(), "sell": Counter()}
        self.matches = 0

    def _partners(self, side: str, price: float) -> int:
        """Orders on the other side within the band of the buy price."""
        if side == "buy":
            other, lo, hi = self.sides["sell"], price * (1 - self.band), price * (1 + self.band)
        else:
            # |b - s| < band * b  <=>  s / (1 + band) < b < s / (1 - band)
            other, lo, hi = self.sides["buy"], price / (1 + self.band), price / (1 - self.band) if self.band < 1 else float("inf")
        a, b = bisect.bisect_left(other, lo), bisect.bisect_right(other, hi)
        # the band is open and rounding may blur its ends: settle the ends by the rule itself
        # (a non-positive buy price matches nothing)

        def near(o: float) -> bool:
            buy, sell = (price, o) if side == "buy" else (o, price)
            return buy > 0 and abs(buy - sell) / buy < self.band

        while a < b and not near(other[a]):
            a += 1
        while b > a and not near(other[b - 1]):
            b -= 1
        while a > 0 and near(other[a - 1]):
            a -= 1
        while b < len(other) and near(other[b]):
            b += 1
        return b - a

    def _drop(self) -> None:
        _, side, price = self.orders.popleft()
        if side in self.sides:
            prices = self.sides[side]
            prices.pop(bisect.bisect_left(prices, price))
            self.matches -= self._partners(side, price)
            self.levels[side][price] -= 1
            if not self.levels[side][price]:
                del self.levels[side][price]

    def push(self, rows):
        got = []
        for us, side, price in zip(rows["_us"], rows["_side"], rows["_price"]):
            while self.orders and self.orders[0][0] <= us - self.window:
                self._drop()
            if side in self.sides:
                self.matches += self._partners(side, price)
                bisect.insort(self.sides[side], price)
                self.levels[side][price] += 1
            self.orders.append((us, side, price))
            self.close.append(us)
            while self.close[0] <= us - self.burst:
                self.close.popleft()
            got.append((len(self.orders), self.matches, len(self.close), len(self.levels["buy"]), len(self.levels["sell"])))
        return {**{c: rows[c] for c in self.keep}, **dict(zip(("recent", "matches", "burst", "buy_levels", "sell_levels"), zip(*got)))}


def recent_order_stats(orders: DataFrame, user: str, symbol: str, us: str, order_id: str, side="side", price="price", window: str | int = "5 minutes", burst: str | int = "1 second", band: float = WASH_BAND, width: str | int | None = None) -> DataFrame:
    """Per order: recent orders, matching buy/sell pairs, last-second orders, price levels per side.

    The timeline of a user and symbol is cut into blocks with a window-long halo, so one busy pair is
    shared by many tasks and each holds only one window of orders.
    """
    w = micros(window)
    src = orders.select(user, symbol, order_id, F.col(us).alias("_us"), F.col(side).alias("_side"), F.col(price).cast("double").alias("_price"))
    h, _ = spread(src, [user, symbol], "_us", micros(width) if width else 20 * w, back=w)
    h = h.withColumn("_core", F.col("_home") == F.col("_rb")).drop("_home")
    keep = [order_id, "_core"]
    ints = [T.StructField(c, T.LongType()) for c in ("recent", "matches", "burst", "buy_levels", "sell_levels")]
    keys = [user, symbol, "_rb"]
    schema = T.StructType([h.schema[c] for c in keep] + ints + [h.schema[c] for c in keys])
    out = sequential(h, keys, ["_us", order_id], lambda: _RecentOrders(keep, w, micros(burst), band), schema)
    return out.where("_core").drop("_core", "_rb")


def abuse_alerts(orders: DataFrame, user: str, symbol: str, us: str, order_id: str, block, status="status", wash_matches: int = WASH_MATCHES, spoof_ratio: float = SPOOF_RATIO, spoof_orders: int = SPOOF_ORDERS, max_burst: int = BURST, layer_orders: int = LAYER_ORDERS, layer_levels: int = LAYER_LEVELS, **recent) -> DataFrame:
    """Wash trading, spoofing, order stuffing and layering alerts as one long table.

    Event time replaces the wall clock, so replaying history gives the alerts of that history.
    """
    st = recent_order_stats(orders, user, symbol, us, order_id, **recent)
    is_ = lambda s: F.when(F.col(status) == s, 1).otherwise(0)
    sp = running(orders, [user], [us, order_id], block, {"_o": ("sum", is_("submitted")), "_c": ("sum", is_("cancelled")), "_f": ("sum", is_("filled"))})
    j = sp.select(user, order_id, "_o", "_c", "_f").join(st.drop(user), order_id)
    ratio = F.col("_c") / F.greatest(F.lit(1), F.col("_c") + F.col("_f"))

    def alert(cond: Column, kind: str, severity: str, confidence: Column, evidence: Column) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("alert"), F.lit(severity).alias("severity"), confidence.cast("double").alias("confidence"), evidence.cast("double").alias("evidence")))

    levels = F.greatest("buy_levels", "sell_levels")
    alerts = F.array_compact(
        F.array(
            alert((F.col("recent") >= wash_matches) & (F.col("matches") >= wash_matches), "WASH_TRADING", "HIGH", F.least(F.lit(0.9), F.col("matches") / 10), F.col("matches")),
            alert((F.col("_o") >= spoof_orders) & (ratio > spoof_ratio), "SPOOFING", "HIGH", F.least(F.lit(0.95), ratio), ratio),
            alert(F.col("burst") > max_burst, "ORDER_STUFFING", "MEDIUM", F.lit(0.7), F.col("burst")),
            alert((F.col("recent") >= layer_orders) & (levels >= layer_levels), "LAYERING", "MEDIUM", F.lit(0.6), levels),
        )
    )
    return j.select(user, symbol, order_id, F.explode(alerts).alias("_a")).select(user, symbol, order_id, "_a.*")


def session_alerts(orders: DataFrame, user: str, user_id, symbol: str, us: str, order_id: str, block, hours: int = 24, **params) -> DataFrame:
    """Replay of one user's last hours (before the newest order of the table)."""
    last = orders.agg(F.max(us).alias("m")).select("m").scalar()
    recent = orders.where((F.col(user) == user_id) & (F.col(us) > last - F.lit(hours * 3_600_000_000)))
    return abuse_alerts(recent, user, symbol, us, order_id, block, **params)


def json_text(c: Column) -> Column:
    """JSON string literal of a text column."""
    boxed = F.to_json(F.array(c.cast("string")))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def json_object(fields: dict[str, Column], order: Sequence[str] | None = None) -> Column:
    """Compact JSON object from ready JSON values, keys in ``order`` (sorted by default)."""
    names = list(order) if order else sorted(fields)
    parts = [F.concat(F.lit(f'"{n}":'), fields[n]) for n in names]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


GENESIS = "0" * 64


def chain_hash(previous: Column, details="details") -> Column:
    """SHA-256 of an audit event's canonical JSON. ``details`` is canonical (sorted, compact) JSON text.

    Text is hashed as UTF-8; a writer that escapes non-ASCII characters must have done so in ``details``.
    """
    text = {n: json_text(F.col(n)) for n in ("event_id", "event_type", "timestamp", "actor", "resource", "action")}
    return F.sha2(json_object({**text, "details": F.coalesce(F.col(details), F.lit("{}")), "previous_hash": json_text(previous)}), 256)


def verify_chain(events: DataFrame, order: Sequence[str], block, keys: Sequence[str] = ()) -> DataFrame:
    """Errors of a hash-chained log: HASH_MISMATCH and CHAIN_BREAK rows.

    Hashes are recomputed row by row and links need only the previous row's hash, so the check is
    parallel over the whole log.
    """
    prev = running(events, keys, order, block, {"_prev": ("lag", F.col("hash"))})
    expected = F.coalesce("_prev", F.lit(GENESIS))
    errors = F.array_compact(
        F.array(
            F.when(F.col("hash") != chain_hash(F.col("previous_hash")), F.lit("HASH_MISMATCH")),
            F.when(F.col("previous_hash") != expected, F.lit("CHAIN_BREAK")),
        )
    )
    return prev.select(*keys, "event_id", F.explode(errors).alias("error"))


def checksum(fields: dict[str, Column], order: Sequence[str]) -> Column:
    """First 16 hex digits of the SHA-256 of compact JSON in a fixed field order."""
    return F.substring(F.sha2(json_object(fields, order), 256), 1, 16)


def verify_checksums(events: DataFrame, stored: str, computed: Column) -> DataFrame:
    """Each row marked valid, invalid or missing."""
    s = F.col(stored)
    return events.withColumn("check", F.when(s.isNull() | (s == ""), "missing").when(s == computed, "valid").otherwise("invalid"))
