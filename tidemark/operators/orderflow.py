"""Trade sides, volume-synchronised toxicity and flow state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .blocks import running, settle, spread
from .relational import band
from .scan import affine_scan
from .timeseries import sample_by
from .windows import ROWS, mean_by_panes, rolling

BUY, SELL, UNKNOWN = "BUY", "SELL", "UNKNOWN"
#: Cumulative volumes: 24 digits before the point, 12 after.
EXACT = "decimal(36,12)"


def tick_rule(df, keys, order, price: str, block, name: str = "side") -> DataFrame:
    """Up tick BUY, down tick SELL, equal price the previous side, UNKNOWN before the first move."""
    p = F.col(price)
    moved = checkpointed(running(df, keys, order, block, {"_p": ("lag", p)}))
    side = F.when(p > F.col("_p"), BUY).when(p < F.col("_p"), SELL)
    out = running(moved.withColumn("_s", side), keys, order, block, {name: ("last", F.col("_s"))})
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(UNKNOWN))).drop("_p", "_s")


def bulk_volume_side(close: Column, high: Column, low: Column) -> Column:
    """struct(side, confidence) from where the close sits in the bar's range."""
    ratio = (close - low) / (high - low + 1e-10)
    known = high.isNotNull() & low.isNotNull()
    side = F.when(known, F.when(ratio > 0.5, BUY).otherwise(SELL)).otherwise(UNKNOWN)
    conf = F.when(known, F.abs(0.5 - ratio) * 2).otherwise(0.0)
    return F.struct(side.alias("side"), conf.alias("confidence"))


def close_vs_open_side(close: Column, open_: Column) -> Column:
    return F.when(close > open_, BUY).when(close < open_, SELL).otherwise(UNKNOWN)


def volume_buckets(df, keys, order, volume: str, side: str, block, bucket_size: float = 1000.0) -> DataFrame:
    """Equal-volume buckets: a trade fills the current bucket and spills over into the next ones.

    Cumulative volume says which buckets a trade covers, so the split is one explode and one partial
    aggregate. Volumes are summed as decimals (``EXACT``), so a bucket's border is the same however much came
    before it, and a bucket is complete once the cumulative volume has reached its end: all but the last one of a
    key. Returns (keys, bucket, buy, sell, complete, end_ts).
    """
    size = F.lit(bucket_size).cast(EXACT)
    # the sides usually come from another blocked operator
    known = checkpointed(df).where((F.col(side) != UNKNOWN) & (F.col(volume) > 0)).withColumn("_vol", F.col(volume).cast(EXACT))
    cum = running(known, keys, order, block, {"_cum": ("sum", F.col("_vol"))}).withColumn("_cum", F.col("_cum").cast(EXACT))
    cum = cum.withColumns({"_start": (F.col("_cum") - F.col("_vol")).cast(EXACT), "_size": size})
    # whole-number division: a rounded quotient could point to the next bucket
    first, last = F.expr("_start div _size"), F.expr("_cum div _size - if(_cum % _size = 0, 1, 0)")
    parts = cum.select(*keys, F.col(order[0]).alias("_ts"), F.col(side).alias("_side"), "_cum", "_start", F.explode(F.sequence(first, last)).alias("bucket"))
    low, high = (F.col("bucket").cast("decimal(20,0)") * size).cast(EXACT), ((F.col("bucket") + 1).cast("decimal(20,0)") * size).cast(EXACT)
    share = (F.least(F.col("_cum"), high) - F.greatest(F.col("_start"), low)).cast("double")
    out = parts.withColumns({"_v": share, "_full": F.col("_cum") >= high}).groupBy(*keys, "bucket").agg(
        F.sum(F.when(F.col("_side") == BUY, F.col("_v")).otherwise(0.0)).alias("buy"),
        F.sum(F.when(F.col("_side") == SELL, F.col("_v")).otherwise(0.0)).alias("sell"),
        F.max("_ts").alias("end_ts"),
        F.bool_or("_full").alias("complete"),
    )
    return out.select(*keys, "bucket", "buy", "sell", "end_ts", "complete")


def vpin(buckets: DataFrame, keys: Sequence[str], n_buckets: int = 50, rows: int = ROWS) -> DataFrame:
    """Mean |buy - sell| / (buy + sell) of the last n complete buckets (0 before), with its level.

    Summed in a stated order, as a level's border can be met exactly; a key's buckets are numbered from 0 without gaps.
    """
    total = F.col("buy") + F.col("sell")
    done = buckets.where("complete").withColumn("oi", F.when(total > 0, F.abs(F.col("buy") - F.col("sell")) / total).otherwise(0.0))
    h, w = spread(done, keys, "bucket", rows, back=n_buckets - 1)
    h = mean_by_panes(h, w, "oi", n_buckets, "_mean", F.col("bucket") + 1)
    v = F.when(F.count("*").over(w.rowsBetween(-(n_buckets - 1), 0)) >= n_buckets, F.col("_mean")).otherwise(0.0)
    return settle(h.withColumn("vpin", v).drop("_mean")).withColumn("toxicity", band(F.col("vpin"), 0.3, 0.7))


def flow_state(df, keys, order, block, bid="bid", ask="ask", bid_size="bid_size", ask_size="ask_size", price="price", volume="volume", n: int = 20, viscosity: float = 0.1, rows: int = ROWS) -> DataFrame:
    """Pressure, flow rate, resistance, turbulence and their Reynolds-like regime.

    Pressures are summed in a stated order, as a regime's border can be met exactly; whole-number volumes need none.
    """
    size = F.col(bid_size) + F.col(ask_size)
    mid = (F.col(bid) + F.col(ask)) / 2
    src = df.withColumns(
        {
            "_imb": F.when(size > 0, (F.col(bid_size) - F.col(ask_size)) / size).otherwise(0.0),
            "resistance": F.when(mid > 0, (F.col(ask) - F.col(bid)) / mid).otherwise(0.0),
        }
    )

    def build(d, w):
        f, fr = w.rowsBetween(-(n - 1), 0), w.rowsBetween(-(n - 2), 0)
        d = d.withColumn("_r", F.col(price) / F.nullif(F.lag(price).over(w), F.lit(0.0)) - 1)
        d = mean_by_panes(d, w, "_imb", n, "pressure", F.col("seq"))
        mean_v = F.avg(volume).over(f)
        return d.withColumns(
            {
                "flow_rate": F.when(mean_v > 0, F.col(volume) / mean_v).otherwise(1.0),
                "turbulence": F.coalesce(F.stddev_pop("_r").over(fr), F.lit(0.0)),
            }
        )

    out = rolling(src, keys, order, block, n, build, rows=rows).drop("_imb", "_r")
    re = F.abs(F.col("flow_rate") * F.col("pressure")) / F.lit(viscosity) if viscosity > 0 else F.lit(0.0)
    return out.withColumn("reynolds", re).withColumn("regime", band(F.col("reynolds"), 0.5, 1.5, ("laminar", "transitional", "turbulent")))


def direction_windows(df, keys, order, side: str, price: str, block, every: str = "1 second", dead_band: float = 0.001) -> DataFrame:
    """Prediction table: sign of the previous window's imbalance against this window's price move.

    Windows are calendar buckets, so they do not depend on where the data starts.
    """
    v = lambda s: F.sum(F.when(F.col(side) == s, 1.0).otherwise(0.0))
    win = sample_by(
        checkpointed(df),
        order[0],
        every,
        [((v(BUY) - v(SELL)) / (v(BUY) + v(SELL) + 1e-10)).alias("ofi"), F.max_by(price, F.struct(*order)).alias("close")],
        keys,
    )
    out = running(win, keys, ["bucket"], block, {"prev_ofi": ("lag", F.col("ofi")), "prev_close": ("lag", F.col("close"))})
    predicted = F.signum("prev_ofi")
    actual = F.signum(F.col("close") - F.col("prev_close"))
    return out.where(F.abs("prev_ofi") > dead_band).withColumns(
        {"predicted": predicted.cast("int"), "actual": actual.cast("int"), "correct": (predicted == actual) & (actual != 0)}
    )


def direction_accuracy(windows: DataFrame) -> DataFrame:
    """Hit rate of non-flat windows overall and per predicted direction."""
    moved = windows.where("actual != 0")
    long = moved.select(F.explode(F.array(F.lit("all"), F.when(F.col("predicted") > 0, "up").otherwise("down"))).alias("direction"), "correct")
    return long.groupBy("direction").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def information_decay(df, keys, order, shock: str, block, rate: float = 0.05, threshold: float = 0.1) -> DataFrame:
    """level = (level + shock) * (1 - rate); informed while above the threshold."""
    keep = F.lit(1 - rate)
    out = affine_scan(df, keys, order, block, {"level": (keep, keep * F.col(shock), keep * F.col(shock))})
    return out.withColumn("informed", F.col("level") > threshold)
