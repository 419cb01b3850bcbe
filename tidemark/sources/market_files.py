"""Readers for market-data CSV files, file discovery and the incremental-load manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column order of each file kind.
KLINES = "open_time open high low close volume close_time quote_volume count taker_buy_volume taker_buy_quote_volume ignore".split()
AGG_TRADES = "agg_trade_id price quantity first_trade_id last_trade_id transact_time is_buyer_maker".split()
TRADES = "id price qty quote_qty time is_buyer_maker".split()
FUNDING = "calc_time funding_interval_hours last_funding_rate".split()
MAX_FUNDING_MS = 16725225600000  # year 2500


def _raw(spark: SparkSession, path, columns: list[str], typed: dict[str, str]) -> DataFrame:
    """Typed rows; fields that do not parse become null in the CSV parser itself.

    The first column stays text: a header row (first cell equal to its column name) is dropped from
    any file, since files with and without one are mixed.
    """
    schema = ", ".join(f"{c} {typed.get(c, 'string')}" for c in columns)
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true")
    rows = reader.csv(path)
    return rows.where(F.col(columns[0]).isNull() | (F.col(columns[0]) != columns[0]))


def _doubles(*names: str) -> dict[str, str]:
    return dict.fromkeys(names, "double")


def read_klines_csv(spark: SparkSession, path) -> DataFrame:
    """Bars: timestamp, open, high, low, close, volume (unparsable numbers become null)."""
    bars = ("open", "high", "low", "close", "volume")
    rows = _raw(spark, path, KLINES, _doubles(*bars))
    return rows.select(F.timestamp_millis(F.col("open_time").try_cast("long")).alias("timestamp"), *bars)


def _trades(rows: DataFrame, ms: str, quantity: str, trade_id: str) -> DataFrame:
    return rows.select(
        F.timestamp_millis(ms).alias("timestamp"),
        "price",
        F.col(quantity).alias("quantity"),
        F.coalesce(F.col("is_buyer_maker"), F.lit(False)).alias("buyer_maker"),
        F.col(trade_id).alias("trade_id"),
    )


def read_aggtrades_csv(spark: SparkSession, path, drop_incomplete: bool = True) -> DataFrame:
    """Aggregated trades; rows without price, quantity or time are dropped unless asked otherwise."""
    rows = _raw(spark, path, AGG_TRADES, {**_doubles("price", "quantity"), "transact_time": "long", "is_buyer_maker": "boolean"})
    out = _trades(rows, "transact_time", "quantity", "agg_trade_id")
    return out.na.drop(subset=["price", "quantity", "timestamp"]) if drop_incomplete else out


def read_trades_csv(spark: SparkSession, path) -> DataFrame:
    rows = _raw(spark, path, TRADES, {**_doubles("price", "qty"), "time": "long", "is_buyer_maker": "boolean"})
    return _trades(rows, "time", "qty", "id")


def read_funding_csv(spark: SparkSession, path) -> DataFrame:
    """Funding updates with nanosecond times; times past the year 2500 are dropped."""
    raw = _raw(spark, path, FUNDING, {"funding_interval_hours": "long", "last_funding_rate": "double"})
    ms = F.col("calc_time").try_cast("long")
    ts = F.col("_ms") * 1_000_000
    return raw.withColumn("_ms", ms).where(F.col("_ms") <= MAX_FUNDING_MS).select(
        ts.alias("ts_event"), "funding_interval_hours", F.col("last_funding_rate").alias("funding_rate"), (ts + F.col("funding_interval_hours") * 3_600_000_000_000).alias("next_funding_ns")
    )


def discover_files(spark: SparkSession, folder: str, pattern: str = "*.csv", start: str | None = None, end: str | None = None) -> DataFrame:
    """Files of a folder with the date in their name; files out of range are left out, undated kept.

    Only names are listed: file contents are pruned from the binary source.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")
    day = F.try_to_date(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})\.[A-Za-z]+$", 1), "yyyy-MM-dd")
    files = files.withColumn("day", day)
    if start:
        files = files.where(F.col("day").isNull() | (F.col("day") >= F.lit(start).cast("date")))
    if end:
        files = files.where(F.col("day").isNull() | (F.col("day") <= F.lit(end).cast("date")))
    return files


def available_range(files: DataFrame) -> DataFrame:
    return files.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def pending_files(files: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Files not yet in the manifest."""
    return files if manifest is None else files.join(manifest.select("path"), "path", "left_anti")


def manifest_rows(loaded: DataFrame, ts: str, path: Column | None = None) -> DataFrame:
    """One row per loaded file: record count, first and last timestamp. Append it to the manifest table."""
    p = F.col("_metadata.file_path") if path is None else path
    return loaded.groupBy(p.alias("path")).agg(F.count("*").alias("records"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
