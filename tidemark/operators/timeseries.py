"""Time bucketing, latest-value and bar operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import micros, running, with_seq


def bucket_start(ts: str | Column, every: str) -> Column:
    """Start of the calendar-aligned bucket holding ``ts``."""
    width = micros(every)
    us = F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)
    return F.timestamp_micros((F.floor(us / F.lit(width)) * F.lit(width)).cast("long"))


def sample_by(
    df: DataFrame,
    ts: str,
    every: str,
    aggs: Sequence[Column],
    keys: Sequence[str] = (),
    align: str = "calendar",
    fill: bool = False,
    bucket: str = "bucket",
) -> DataFrame:
    """Aggregate into fixed time buckets.

    ``align="calendar"`` starts buckets at multiples of the width since the epoch; ``"first"`` starts
    them at the earliest timestamp of the input. ``fill`` emits empty buckets (null aggregates) for
    every key between the input's first and last bucket.

    One shuffle with map-side partial aggregation, so a hot key costs one row per bucket and task.
    """
    width = micros(every)
    us = F.unix_micros(F.col(ts))
    if align == "calendar":
        start = F.floor(us / F.lit(width)) * F.lit(width)
    elif align == "first":
        origin = df.agg(F.min(F.unix_micros(F.col(ts))).alias("o"))
        o = origin.select("o").scalar()
        start = F.floor((us - o) / F.lit(width)) * F.lit(width) + o
    else:
        raise ValueError("align is 'calendar' or 'first'")
    out = df.groupBy(*keys, F.timestamp_micros(start.cast("long")).alias(bucket)).agg(*aggs)
    if not fill:
        return out
    span = out.agg(F.min(bucket).alias("lo"), F.max(bucket).alias("hi"))
    step = F.expr(f"interval {width} microseconds")
    if keys:
        grid = out.select(*keys).distinct().withColumns({"_lo": span.select("lo").scalar(), "_hi": span.select("hi").scalar()})
    else:
        grid = span.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    grid = grid.select(*keys, F.explode(F.sequence("_lo", "_hi", step)).alias(bucket))
    return grid.join(out, [*keys, bucket], "left")


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key: one partial aggregate, no sort. ``order`` should end in a unique column."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def last_value(expr: Column, order: Sequence[str]) -> Column:
    return F.max_by(expr, F.struct(*order))


def first_value(expr: Column, order: Sequence[str]) -> Column:
    return F.min_by(expr, F.struct(*order))


def ohlcv_aggs(price: str, volume: str, order: Sequence[str]) -> list[Column]:
    p = F.col(price)
    return [
        first_value(p, order).alias("open"),
        F.max(p).alias("high"),
        F.min(p).alias("low"),
        last_value(p, order).alias("close"),
        F.sum(volume).alias("volume"),
        F.count("*").alias("n_ticks"),
    ]


def time_bars(df: DataFrame, keys: Sequence[str], order: Sequence[str], every: str, price: str = "price", volume: str = "volume") -> DataFrame:
    """OHLCV bars from ticks."""
    return sample_by(df, order[0], every, ohlcv_aggs(price, volume, order), keys)


def tick_bars(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, block: str, price: str = "price", volume: str = "volume") -> DataFrame:
    """Bars of ``n`` ticks; the last bar of a key may be short."""
    seq = with_seq(df, keys, order, block)
    return seq.groupBy(*keys, F.floor((F.col("seq") - 1) / n).cast("long").alias("bar")).agg(*ohlcv_aggs(price, volume, order))


def threshold_bars(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measure: Column,
    threshold: float,
    block: str,
    price: str = "price",
    volume: str = "volume",
) -> DataFrame:
    """Volume or value bars: a tick belongs to the bar in which its cumulative measure starts."""
    cum = running(df.withColumn("_m", measure), keys, order, block, {"_cum": ("sum", F.col("_m"))})
    bar = F.floor((F.col("_cum") - F.col("_m")) / F.lit(threshold)).cast("long").alias("bar")
    return cum.groupBy(*keys, bar).agg(*ohlcv_aggs(price, volume, order))


def staleness(df: DataFrame, keys: Sequence[str], ts: str, as_of: Column) -> DataFrame:
    """Seconds between ``as_of`` and the newest timestamp of each key."""
    newest = df.groupBy(*keys).agg(F.max(ts).alias("last_ts"))
    return newest.withColumn("age_seconds", (F.unix_micros(as_of) - F.unix_micros("last_ts")) / F.lit(1e6))


def compounded_returns(df: DataFrame, keys: Sequence[str], date: str, ret: str, unit: str = "month") -> DataFrame:
    """Product of (1 + r) minus one per calendar unit."""
    return df.groupBy(*keys, F.date_trunc(unit, F.col(date)).alias("period")).agg((F.product(1 + F.col(ret)) - 1).alias("ret"))


# Point counts above which the display resolution coarsens.
RESOLUTIONS = ((100_000, "1 week"), (50_000, "1 day"), (10_000, "4 hours"), (-1, "1 hour"))


def display_resolution(n: Column) -> Column:
    """Bucket width to display ``n`` points with."""
    out = F.when(n > RESOLUTIONS[0][0], RESOLUTIONS[0][1])
    for limit, width in RESOLUTIONS[1:]:
        out = out.when(n > limit, width)
    return out


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: Sequence[str],
    block: str,
) -> DataFrame:
    """Attach to each left row the right row with the greatest ``ts`` not after it.

    Union of both sides and a running last non-null: one shuffle, parallel within a key.
    """
    l = left.withColumns({"_side": F.lit(1), "_r": F.lit(None).cast(f"struct<{','.join(f'{v}:{right.schema[v].dataType.simpleString()}' for v in values)}>")})
    r = right.select(*keys, ts, F.lit(0).alias("_side"), F.struct(*values).alias("_r"))
    both = l.unionByName(r, allowMissingColumns=True)
    filled = running(both, keys, [ts, "_side"], block, {"_last": ("last", F.col("_r"))})
    return filled.where("_side = 1").select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])


