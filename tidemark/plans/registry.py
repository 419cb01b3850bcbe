"""Registry that keeps each Spark query beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """Parquet tables of one scale folder plus the market-data views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)

    def read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        for f in df.schema.fields:
            if f.dataType.typeName() == "timestamp_ntz":
                df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.read(name)
        raise AttributeError(name)

    @cached_property
    def ticks(self) -> DataFrame:
        """events as trades: symbol = event_type, trader = user_id, price = value (at least one cent, as
        prices must be positive), volume = props.k."""
        return self.read("events").select(
            "event_id",
            "ts",
            F.unix_micros("ts").alias("us"),
            F.col("user_id").alias("trader"),
            F.col("event_type").alias("symbol"),
            F.greatest("value", F.lit(0.01)).alias("price"),
            F.get_json_object("props", "$.k").cast("double").alias("volume"),
        )

    @cached_property
    def daily(self) -> DataFrame:
        """Daily revenue per order priority: one row per (strategy, day)."""
        return self.read("orders").groupBy(F.col("o_orderpriority").alias("strategy"), F.to_date("o_orderdate").alias("day")).agg(
            F.round(F.sum("o_totalprice"), 2).alias("equity"), F.count("*").alias("n_orders")
        )


# The same views for the SQL side.
TICKS = """ticks AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id AS trader, event_type AS symbol, greatest(value, 0.01e0) AS price,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events)"""
DAILY = """daily AS (SELECT o_orderpriority AS strategy, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS equity,
  count(*) AS n_orders FROM orders GROUP BY 1, 2)"""


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its reference SQL."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


# Engines sum in different orders, so a value whose exact decimal ends on a rounding tie (averages of
# prices in cents do) could round either way. Both sides shift it off the tie by the same tiny amount.
_OFF_TIE = 0.0314159


def rnd(expr: str, digits: int = 6) -> str:
    """SQL rounding that never yields negative zero and never meets a tie."""
    return f"(round({expr} + {_OFF_TIE / 10**digits:.12e}, {digits}) + 0e0)"


def rounded(c, digits: int = 6):
    """Column counterpart of ``rnd``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(float(f"{_OFF_TIE / 10**digits:.12e}")), digits) + F.lit(0.0)
