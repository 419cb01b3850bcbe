"""Comparing a cached state with the authoritative one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timeseries import latest_by


def _paired(cached: DataFrame, exchange: DataFrame, key: str, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key on both sides, full outer joined, columns prefixed ``c_`` / ``x_``."""

    def side(df, p):
        newest = latest_by(df.select(key, *cols, *order), [key], order)
        return newest.select(key, F.lit(True).alias(f"{p}here"), *[F.col(c).alias(f"{p}{c}") for c in cols])

    return side(cached, "c_").join(side(exchange, "x_"), key, "full_outer")


def reconcile_positions(cached: DataFrame, exchange: DataFrame, key: str, order: Sequence[str], qty: str = "quantity", side: str = "side") -> DataFrame:
    """One row per discrepancy; quantity and side can both differ for one instrument."""
    j = _paired(cached, exchange, key, [qty, side], order)
    both = F.col("c_here").isNotNull() & F.col("x_here").isNotNull()
    codes = F.array_compact(
        F.array(
            F.when(both & (F.col(f"c_{qty}") != F.col(f"x_{qty}")), F.lit("QTY_MISMATCH")),
            F.when(both & (F.col(f"c_{side}") != F.col(f"x_{side}")), F.lit("SIDE_MISMATCH")),
            F.when(F.col("c_here").isNull(), F.lit("EXTERNAL")),
            F.when(F.col("x_here").isNull(), F.lit("CLOSED")),
        )
    )
    return j.select(key, F.explode(codes).alias("code"), *[f"{p}_{c}" for c in (qty, side) for p in ("c", "x")])


def reconcile_balances(cached: DataFrame, exchange: DataFrame, key: str, order: Sequence[str], total: str = "total", locked: str = "locked", threshold: float = 10.0) -> DataFrame:
    """One row per currency on either side: change code, deltas and significance.

    A total mismatch hides a locked mismatch. Percent change is 100 for a non-zero total that was 0.
    """
    j = _paired(cached, exchange, key, [total, locked], order)
    ct, xt, cl, xl = (F.coalesce(F.col(c), F.lit(0)) for c in (f"c_{total}", f"x_{total}", f"c_{locked}", f"x_{locked}"))
    new, gone = F.col("c_here").isNull(), F.col("x_here").isNull()
    code = F.when(new, "NEW").when(gone, "REMOVED").when(ct != xt, "TOTAL_MISMATCH").when(cl != xl, "LOCKED_MISMATCH").otherwise("MATCH")
    pct = F.when(ct != 0, (xt - ct) / F.nullif(ct, F.lit(0)) * 100).when(xt != 0, 100).otherwise(0).cast("double")
    return j.select(
        key,
        code.alias("code"),
        (xt - ct).alias("total_change"),
        (xl - cl).alias("locked_change"),
        pct.alias("pct_change"),
        (new | gone | (F.abs(pct) >= threshold)).alias("significant"),
    )
