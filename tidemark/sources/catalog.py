"""Partitioned Parquet catalog: write, read, upsert, compaction, retention and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Catalog schemas.
OPEN_INTEREST = "timestamp timestamp, symbol string, venue string, open_interest double, open_interest_value double"
FUNDING_RATE = "timestamp timestamp, symbol string, venue string, funding_rate double, next_funding_time timestamp, predicted_rate double"
LIQUIDATIONS = "timestamp timestamp, symbol string, venue string, side string, quantity double, price double, value double"
PARTITIONS = ("venue", "symbol", "dt")


def write_catalog(df: DataFrame, path: str, ts: str = "timestamp", mode: str = "append", max_rows_per_file: int = 5_000_000) -> None:
    """Append to ``venue=/symbol=/dt=`` folders.

    The rebalance hint lets adaptive execution size the write tasks: a hot symbol-day is split over
    several, small ones share one, and files stay bounded.
    """
    day = df.withColumn("dt", F.to_date(ts)).hint("rebalance", *[F.col(c) for c in PARTITIONS])
    day.write.mode(mode).option("maxRecordsPerFile", max_rows_per_file).partitionBy(*PARTITIONS).parquet(path)


def read_catalog(spark: SparkSession, path: str, symbol: str | None = None, venue: str | None = None, start: str | None = None, end: str | None = None, ts: str = "timestamp", schema: str | T.StructType | None = None) -> DataFrame:
    """Rows of one symbol (exact name), venue and time range, both ends inclusive.

    Bounds go on the day folders too, so files of other days are never opened. ``schema`` (one of the fixed ones
    above, with the partition columns) saves reading a footer; columns that older files lack are null. Without it
    the schema is that of one file.
    """
    df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    if symbol is not None:
        df = df.where(F.col("symbol") == symbol)
    if venue is not None:
        df = df.where(F.col("venue") == venue)
    if start is not None:
        lo = F.lit(start).cast("timestamp")
        df = df.where((F.col("dt") >= F.to_date(lo)) & (F.col(ts) >= lo))
    if end is not None:
        hi = F.lit(end).cast("timestamp")
        df = df.where((F.col("dt") <= F.to_date(hi)) & (F.col(ts) <= hi))
    return df


def recent_funding(df: DataFrame, limit: int = 20, ts: str = "timestamp", tie: Sequence[str] = ()) -> DataFrame:
    """Newest rows (``tie`` columns descending among equal times) with the 8-hour rate annualised in percent."""
    return df.orderBy(F.desc(ts), *[F.desc(c) for c in tie]).limit(limit).withColumn("annualized", F.col("funding_rate") * 3 * 365 * 100)


def last_timestamps(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Resume point of every (symbol, venue)."""
    return df.groupBy("symbol", "venue").agg(F.max(ts).alias("last_ts"))


def upsert_dedup(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Last write wins per key: one partial aggregate, so duplicates collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_r")).select(*keys, "_r.*")


def upsert_columns(current: DataFrame, updates: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """Insert new keys and overwrite only the ``update`` columns of existing ones.

    ``updates`` has one row per key (see ``upsert_dedup``).
    """
    cur = current.select(*keys, F.struct(*[c for c in current.columns if c not in keys]).alias("_c"))
    new = updates.select(*keys, F.struct(*[c for c in current.columns if c not in keys]).alias("_u"))
    j = cur.join(new, list(keys), "full_outer")

    def pick(c: str) -> Column:
        if c in update:
            return F.when(F.col("_u").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(f"_c.{c}"))
        return F.when(F.col("_c").isNotNull(), F.col(f"_c.{c}")).otherwise(F.col(f"_u.{c}"))

    return j.select(*keys, *[pick(c).alias(c) for c in current.columns if c not in keys])


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Audit log lines; blank and malformed lines are skipped. ``dt`` is the UTC day of ``ts_event`` (ns)."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df.where(F.col("ts_event").isNotNull()).withColumn("dt", event_day(F.col("ts_event")))


def event_day(ts_ns: Column) -> Column:
    return F.to_date(F.timestamp_micros(F.floor(ts_ns / 1000).cast("long")))


def compact_jsonl(spark: SparkSession, source: str, target: str, schema: str | T.StructType) -> None:
    """JSON lines to day-partitioned Parquet."""
    df = read_jsonl(spark, source, schema)
    df.hint("rebalance", F.col("dt")).write.mode("append").partitionBy("dt").parquet(target)


def live_partitions(df: DataFrame, as_of: str, days: int = 90, dt: str = "dt") -> DataFrame:
    """Rows of day partitions not older than ``days`` before ``as_of`` (cutoff day kept)."""
    return df.where(F.col(dt) >= F.date_sub(F.lit(as_of).cast("date"), days))


def drop_expired(spark: SparkSession, path: str, as_of: str, days: int = 90) -> list[str]:
    """Delete ``dt=`` folders strictly older than the cutoff; returns the dropped days."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    cutoff = spark.range(1).select(F.date_sub(F.lit(as_of).cast("date"), days).cast("string").alias("c")).first()["c"]
    dropped = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if name.startswith("dt=") and name[3:] < cutoff:
            fs.delete(st.getPath(), True)
            dropped.append(name[3:])
    return sorted(dropped)


def partition_stats(df: DataFrame, dt: str = "dt") -> DataFrame:
    """Rows, files and bytes per day of a table read from files."""
    per_file = df.groupBy(dt, F.col("_metadata.file_path").alias("_f")).agg(F.count("*").alias("_n"), F.max("_metadata.file_size").alias("_b"))
    return per_file.groupBy(dt).agg(F.sum("_n").alias("rows"), F.count("*").alias("files"), F.sum("_b").alias("bytes"))


def export_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Whole table to Parquet, or CSV with a header."""
    w = df.write.mode(mode)
    w.option("header", "true").csv(path) if fmt == "csv" else w.parquet(path)


def funding_updates(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Catalog funding rows as instrument updates with nanosecond times; rows without a rate are dropped."""
    ns = lambda c: F.unix_micros(c) * 1000
    rate = F.col("funding_rate")
    return df.where(rate.isNotNull() & ~F.isnan(rate)).select(
        F.concat_ws(".", "symbol", "venue").alias("instrument_id"), rate.alias("rate"), ns(ts).alias("ts_event"), ns("next_funding_time").alias("next_funding_ns")
    )
