"""Safe parsing, symbol names and row validation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_float(c: Column, default: float | None = 0.0) -> Column:
    """Number or ``default`` for null, unparsable, NaN and infinite input."""
    v = F.trim(c.cast("string")).try_cast("double")
    return F.coalesce(F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v), F.lit(default))


def safe_int(c: Column, default: int | None = 0) -> Column:
    """Truncated integer or ``default``."""
    v = safe_float(c, None)
    whole = F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v))
    return F.coalesce(whole.cast("long"), F.lit(default).cast("long"))


def safe_str(c: Column, default: str = "") -> Column:
    return F.coalesce(c.cast("string"), F.lit(default))


def normalize_symbol(c: Column) -> Column:
    """BTCUSDT-PERP or BTC-USDT-PERP -> BTC/USDT:USDT; names with '/' and ':' pass through."""
    s = F.regexp_replace(F.upper(c), "-PERP$", "")
    s = F.regexp_replace(s, "^([^-]*)-([^-]*)$", "$1$2")
    unified = F.when(s.endswith("USDT"), F.regexp_replace(s, "USDT$", "/USDT:USDT")).when(s.endswith("USD"), F.regexp_replace(s, "USD$", "/USD:USD")).otherwise(s)
    return F.when(c.contains("/") & c.contains(":"), c).otherwise(unified)


def instrument_id(symbol: Column, venue: Column) -> Column:
    return F.concat_ws(".", symbol, venue)


def validate(df: DataFrame, kind: str, as_of: Column, ts: str = "timestamp") -> DataFrame:
    """Add ``errors`` (array of broken rules) and clean ``symbol``; keep every row.

    ``kind``: liquidations (quantity, price, value > 0), open_interest (values >= 0) or funding_rate.
    """
    sym = F.upper(F.trim("symbol"))
    rules = [F.when(sym.isNull() | (sym == ""), "empty_symbol"), F.when(F.col(ts) > as_of, "future_timestamp")]
    positive = {"liquidations": ("quantity", "price", "value")}.get(kind, ())
    non_negative = {"open_interest": ("open_interest", "open_interest_value")}.get(kind, ())
    rules += [F.when(F.col(c).isNull() | ~(F.col(c) > 0), f"{c}_not_positive") for c in positive]
    rules += [F.when(F.col(c).isNull() | ~(F.col(c) >= 0), f"{c}_negative") for c in non_negative]
    return df.withColumn("errors", F.array_compact(F.array(*rules))).withColumn("symbol", sym)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their errors)."""
    return df.where(F.size("errors") == 0).drop("errors"), df.where(F.size("errors") > 0)
