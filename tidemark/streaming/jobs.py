"""Structured Streaming forms of the table operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import catalog as cat
from ..sources.messages import normalize_liquidations


def liquidation_rows(messages: DataFrame, raw: str = "raw", symbols: list[str] | None = None) -> DataFrame:
    """Typed liquidation rows with a day column, ready for a partitioned sink."""
    return normalize_liquidations(messages, raw, symbols).withColumn("dt", F.to_date("timestamp"))


def to_parquet(rows: DataFrame, path: str, checkpoint: str, partitions: Sequence[str] = cat.PARTITIONS, once: bool = True):
    """Append a stream to partitioned Parquet, exactly once through the checkpoint.

    ``once`` processes what is there and stops (a scheduled job); otherwise it keeps running.
    """
    w = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*partitions).outputMode("append")
    return w.trigger(availableNow=True).start() if once else w.start()


def windowed(stream: DataFrame, ts: str, delay: str, width: str, aggs: Sequence[Column], keys: Sequence[str] = (), slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) event-time windows; rows later than ``delay`` are dropped."""
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = stream.withWatermark(ts, delay).groupBy(win.alias("_w"), *keys).agg(*aggs)
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *[c for c in out.columns if c != "_w"])


def order_rate(stream: DataFrame, ts: str, delay: str, keys: Sequence[str], width: str = "1 second", slide: str = "500 milliseconds", limit: int = 10) -> DataFrame:
    """Sliding windows with more orders than ``limit``."""
    return windowed(stream, ts, delay, width, [F.count("*").alias("orders")], keys, slide).where(F.col("orders") > limit)


def activity_sessions(stream: DataFrame, ts: str, delay: str, keys: Sequence[str], gap: str = "30 minutes") -> DataFrame:
    """Bursts of activity per key separated by silence of at least ``gap``."""
    out = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("_w"), *keys).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return out.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n", "first_ts", "last_ts")


def unique_events(stream: DataFrame, ts: str, delay: str, checksum: Column) -> DataFrame:
    """Each checksum once while its duplicates arrive within the watermark delay."""
    return stream.withColumn("checksum", checksum).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["checksum"])


def tail_jsonl(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, files_per_batch: int = 100):
    """New JSON-lines files to day-partitioned Parquet (malformed lines skipped), then stop."""
    rows = spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch).json(source)
    rows = rows.where(F.col("ts_event").isNotNull()).withColumn("dt", cat.event_day(F.col("ts_event")))
    return to_parquet(rows, target, checkpoint, ["dt"])
