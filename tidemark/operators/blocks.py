"""Order-dependent operators that stay parallel inside one key.

A plain ``Window.partitionBy(key).orderBy(ts)`` puts a whole key into one task. Everything here cuts
each key into blocks along the order axis, works per (key, block), and carries only one small summary
row per block across block borders:

* ``running``  prefix sum/count/min/max, last non-null, lag and lead, for keys of any size;
* ``spread`` / ``settle``  bounded row or range frames: rows near a border are copied to the
  neighbouring block (a halo), evaluated there, and dropped again.

Keys must be non-null. ``block`` is best a ``RowBlocks``, which cuts keys after so many rows however they are
spread over time. It may also be an interval such as ``"1 day"`` for a timestamp order column, or a number of
units for a numeric one; a block should be comfortably one task's work and a key should have at most about a
million blocks: the summary table holds one row per (key, block).

Each such operator reads its input twice (rows and summary), so operators that chain several of them
cut the lineage with a checkpoint in between instead of recomputing 2^k times.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

_UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}

BLK = "_blk"


def micros(interval: str | int) -> int:
    """``"5 minutes"`` -> 300000000."""
    if isinstance(interval, int):
        return interval
    n, unit = interval.split()
    return int(n) * _UNITS[unit.rstrip("s")]


def axis(df: DataFrame, name: str) -> Column:
    """Order column as a long: microseconds for timestamps and dates, the value itself for integers."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp"))
    return c.cast("long")


@dataclass(frozen=True)
class RowBlocks:
    """Blocks of about ``rows`` rows of a key, from the row counts of cells along the order.

    A cell is ``grain`` wide on the order axis and never split, so a block has at most ``rows`` rows plus one cell.
    Choose the grain so that the rows of one key in a cell stay well below ``rows``. ``along`` replaces the first
    order column as the axis (a number that never decreases along the order).
    """

    rows: int = 500_000
    grain: str | float = "1 minute"
    along: Column | None = None


def value_blocks(value: Column, width: float) -> RowBlocks:
    """Row blocks along a value; ``width`` is a coarse band of it, cut into a thousand cells."""
    return RowBlocks(along=value, grain=width / 1024)


def with_block(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: str | int | Column | RowBlocks) -> DataFrame:
    """``block`` may also be a column expression that never decreases along the order.

    ``RowBlocks`` take one counting pass; the cells (not the rows) of a key are numbered in one task, and Spark
    broadcasts them to the rows when they are few.
    """
    if isinstance(block, RowBlocks):
        place = axis(df, order[0]) if block.along is None else block.along
        width = micros(block.grain) if isinstance(block.grain, str) and block.along is None else block.grain
        src = df.withColumn("_cell", F.floor(place / F.lit(width)).cast("long"))
        before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = src.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
        cells = cells.select(*keys, "_cell", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / block.rows).cast("long").alias(BLK))
        return src.join(cells, [*keys, "_cell"]).select(*df.columns, BLK)
    if isinstance(block, Column):
        return df.withColumn(BLK, block.cast("long"))
    return df.withColumn(BLK, F.floor(axis(df, order[0]) / F.lit(micros(block))).cast("long"))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: str | int | Column | RowBlocks,
    aggs: dict[str, tuple[str, Column | str]],
) -> DataFrame:
    """Add running columns ``{name: (kind, column)}``.

    Kinds: ``count`` (rows so far), ``sum``, ``min``, ``max``, ``last`` (last non-null so far),
    ``first`` (first row of the key), ``lag`` / ``lead`` (neighbouring row).

    One shuffle of the rows by (keys, block); the block summary is a partial aggregate, and joining it
    back reuses the rows' own partitioning.
    """
    keys, order = list(keys), list(order)
    src = with_block(df, keys, order, block)
    names = list(aggs)
    for n in names:
        kind, c = aggs[n]
        c = F.col(c) if isinstance(c, str) else c
        src = src.withColumn(f"_v_{n}", F.lit(1).cast("long") if kind == "count" else c)

    def v(n: str) -> Column:
        return F.col(f"_v_{n}")

    local = Window.partitionBy(*keys, BLK).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    position = F.struct(*order)
    rows, totals, carries = src, [], []
    past = Window.partitionBy(*keys).orderBy(BLK)
    before = past.rowsBetween(Window.unboundedPreceding, -1)
    finals: dict[str, Column] = {}
    fold = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    join2 = {"count": lambda a, b: a + b, "sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}
    for n in names:
        kind = aggs[n][0]
        lc, tc, cc = f"_l_{n}", f"_t_{n}", f"_c_{n}"
        if kind in fold:
            rows = rows.withColumn(lc, fold[kind](v(n)).over(upto))
            totals.append(fold[kind](v(n)).alias(tc))
            carries.append(fold[kind](F.col(tc)).over(before).alias(cc))
            both = join2[kind](F.col(lc), F.col(cc))
            finals[n] = F.coalesce(both, F.col(lc), F.col(cc))
        elif kind == "last":
            rows = rows.withColumn(lc, F.last(v(n), ignorenulls=True).over(upto))
            totals.append(F.max(F.when(v(n).isNotNull(), F.struct(*order, v(n).alias("_x")))).alias(tc))
            carries.append(F.last(F.col(f"{tc}._x"), ignorenulls=True).over(before).alias(cc))
            finals[n] = F.coalesce(F.col(lc), F.col(cc))
        elif kind == "first":
            rows = rows.withColumn(lc, F.first(F.struct(v(n).alias("_x"))).over(upto))
            totals.append(F.min(F.struct(*order, v(n).alias("_x"))).alias(tc))
            carries.append(F.first(F.struct(F.col(f"{tc}._x").alias("_x"))).over(before).alias(cc))
            finals[n] = F.coalesce(F.col(cc), F.col(lc))["_x"]
        elif kind in ("lag", "lead"):
            step = F.lag if kind == "lag" else F.lead
            edge = F.max if kind == "lag" else F.min
            rows = rows.withColumn(lc, step(F.struct(v(n).alias("_x"))).over(local))
            totals.append(edge(F.struct(*order, v(n).alias("_x"))).alias(tc))
            carries.append(step(F.struct(F.col(f"{tc}._x").alias("_x"))).over(past).alias(cc))
            finals[n] = F.coalesce(F.col(lc), F.col(cc))["_x"]
        else:
            raise ValueError(f"unknown running kind {kind!r}")
    del position
    summary = src.groupBy(*keys, BLK).agg(*totals)
    carry = summary.select(*keys, BLK, *carries)
    joined = rows.join(carry, [*keys, BLK], "left")
    return joined.select(*[F.col(c) for c in df.columns if c not in finals], *[finals[n].alias(n) for n in names])


def with_seq(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: str | int, name: str = "seq") -> DataFrame:
    """Dense 1-based row number per key without gathering a key in one task."""
    return running(df, keys, order, block, {name: ("count", F.lit(1))})


def spread(
    df: DataFrame,
    keys: Sequence[str],
    along: str,
    width: int,
    back: int,
    ahead: int = 0,
) -> tuple[DataFrame, WindowSpec]:
    """Copy each row into every block whose rows may look at it; return the rows and their window.

    ``along`` is an integer column (a dense ``seq`` for row frames, microseconds for range frames) and
    ``back`` / ``ahead`` how far frames reach. Evaluate any frame within that reach over the returned
    window, then call ``settle``. A block holds ``width + back + ahead`` units of the axis, whatever
    the size of its key.
    """
    pos = F.col(along).cast("long")
    lo = F.floor((pos - F.lit(ahead)) / F.lit(width)).cast("long")
    hi = F.floor((pos + F.lit(back)) / F.lit(width)).cast("long")
    home = F.floor(pos / F.lit(width)).cast("long")
    out = df.withColumn("_home", home).withColumn("_rb", F.explode(F.sequence(lo, hi)))
    return out, Window.partitionBy(*keys, "_rb").orderBy(along)


def settle(df: DataFrame) -> DataFrame:
    """Drop the halo copies made by ``spread``."""
    return df.where(F.col("_home") == F.col("_rb")).drop("_home", "_rb")
