"""Affine scan: ``y[t] = a[t] * y[t-1] + b[t]`` per key, optionally clamped, parallel inside a key.

Affine maps compose associatively, and so do clamped ones with ``a >= 0`` (a clamp of an affine map
stays one), so a block of rows folds to one map. Three steps:

1. fold every (key, block) to its map: the only output is one row per block;
2. run the recurrence over the block maps of each key to get the value entering every block;
3. replay the rows of each block from its entering value.

Steps 1 and 3 stream Arrow batches sorted by (key, block), so memory is one batch whatever the block
size. Inside a batch, all segments are composed at once by a log-step numpy scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .blocks import BLK, RowBlocks, with_block

_WIDE = 1e300  # stands for "no bound": finite, so that 0 * bound stays 0


class Maps:
    """Row maps ``y -> clip(a*y + b, lo, hi)`` as arrays; ``lo``/``hi`` are absent when unclamped."""

    def __init__(self, a: np.ndarray, b: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None):
        self.a, self.b, self.lo, self.hi = a, b, lo, hi

    def apply(self, i, y):
        v = self.a[i] * y + self.b[i]
        return v if self.lo is None else np.minimum(np.maximum(v, self.lo[i]), self.hi[i])

    def constant(self, i, y) -> None:
        """Make rows ``i`` ignore what came before and give ``y``."""
        self.a[i], self.b[i] = 0.0, y
        if self.lo is not None:
            self.lo[i], self.hi[i] = -_WIDE, _WIDE

    def after(self, i: int, prev: tuple) -> None:
        """Compose row ``i`` with an earlier single map."""
        a, b, lo, hi = prev
        if self.lo is not None:
            new_lo, new_hi = self.apply(i, lo), self.apply(i, hi)
        self.b[i] = self.a[i] * b + self.b[i]
        self.a[i] = self.a[i] * a
        if self.lo is not None:
            self.lo[i], self.hi[i] = new_lo, new_hi

    def row(self, i: int) -> tuple:
        lo, hi = (-_WIDE, _WIDE) if self.lo is None else (float(self.lo[i]), float(self.hi[i]))
        return float(self.a[i]), float(self.b[i]), lo, hi

    def compose(self, start: np.ndarray) -> Maps:
        """Inclusive prefix composition inside the segments that ``start`` opens."""
        a, b = self.a.copy(), self.b.copy()
        lo, hi = (None, None) if self.lo is None else (self.lo.copy(), self.hi.copy())
        idx = np.arange(len(a))
        first = np.maximum.accumulate(np.where(start, idx, 0))
        d, n = 1, len(a)
        while d < n:
            ok = idx[d:] - d >= first[d:]
            if not ok.any():
                break
            later = np.flatnonzero(ok) + d
            early = later - d
            if lo is not None:
                l2 = np.clip(a[later] * lo[early] + b[later], lo[later], hi[later])
                h2 = np.clip(a[later] * hi[early] + b[later], lo[later], hi[later])
            b2 = a[later] * b[early] + b[later]
            a2 = a[later] * a[early]
            a[later], b[later] = a2, b2
            if lo is not None:
                lo[later], hi[later] = l2, h2
            d *= 2
        return Maps(a, b, lo, hi)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.array(batch.column(name).to_numpy(zero_copy_only=False), dtype=np.float64)


def _flags(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name).to_numpy(zero_copy_only=False)).astype(bool)


def _maps(batch: pa.RecordBatch, name: str, clamped: bool) -> Maps:
    bounds = (_numbers(batch, f"_lo_{name}"), _numbers(batch, f"_hi_{name}")) if clamped else ()
    return Maps(_numbers(batch, f"_a_{name}"), _numbers(batch, f"_b_{name}"), *bounds)


def _replay(names: dict[str, bool], fields: Sequence[str]):
    """Sorted batches with ``_start`` flags and entry values ``_e_*`` -> batches with the y columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = dict.fromkeys(names, 0.0)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            start = _flags(batch, "_start")
            cols = {}
            for n, clamped in names.items():
                m = _maps(batch, n, clamped)
                m.constant(start, _numbers(batch, f"_e_{n}")[start])
                if not start[0]:
                    m.constant(0, m.apply(0, last[n]))
                done = m.compose(start | (np.arange(len(start)) == 0))
                y = done.b if done.lo is None else np.clip(done.b, done.lo, done.hi)
                last[n] = float(y[-1])
                cols[n] = pa.array(y)
            yield pa.RecordBatch.from_arrays([cols[f] if f in cols else batch.column(f) for f in fields], names=list(fields))

    return run


def _fold(keys: Sequence[str], names: dict[str, bool], fields: Sequence[str]):
    """Sorted batches -> one row per segment: its map, and its end value if the key starts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = {n: ((1.0, 0.0, -_WIDE, _WIDE), 0.0) for n in names}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            start, end = _flags(batch, "_start"), _flags(batch, "_end")
            opens = start | (np.arange(len(start)) == 0)
            idx = np.flatnonzero(end)
            arrays = [batch.column(k).take(pa.array(idx)) for k in [*keys, BLK]]
            for n, clamped in names.items():
                m, f = _maps(batch, n, clamped), _maps(batch, n, clamped)
                f.constant(start, _numbers(batch, f"_e_{n}")[start])
                if not start[0]:
                    m.after(0, carry[n][0])
                    f.constant(0, f.apply(0, carry[n][1]))
                m, f = m.compose(opens), f.compose(opens)
                value = f.b if f.lo is None else np.clip(f.b, f.lo, f.hi)
                carry[n] = (m.row(-1), float(value[-1]))
                arrays += [pa.array(m.a[idx]), pa.array(m.b[idx])]
                if clamped:
                    arrays += [pa.array(m.lo[idx]), pa.array(m.hi[idx])]
                arrays.append(pa.array(value[idx]))
            if len(idx):
                yield pa.RecordBatch.from_arrays(arrays, names=list(fields))

    return run


def affine_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: str | int | Column | RowBlocks,
    recurrences: dict[str, tuple],
) -> DataFrame:
    """Add ``{name: (a, b, first)}``: ``y = first`` on a key's first row, then ``a*y_prev + b``.

    ``(a, b, first, lo, hi)`` clamps every value but the first to [lo, hi] and needs ``a >= 0``. All
    are column expressions of the current row and must not be null. Independent recurrences share one
    pass.
    """
    keys, order = list(keys), list(order)
    names = {n: len(r) == 5 for n, r in recurrences.items()}
    parts: dict[str, list[str]] = {}
    src = with_block(df, keys, order, block)
    for n, r in recurrences.items():
        cols = {f"_a_{n}": r[0], f"_b_{n}": r[1], f"_f_{n}": r[2]}
        if names[n]:
            cols |= {f"_lo_{n}": r[3], f"_hi_{n}": r[4]}
        parts[n] = [c for c in cols if not c.startswith("_f_")]
        src = src.withColumns({c: e.cast("double") for c, e in cols.items()})
    maps = [c for n in names for c in parts[n]]
    local = Window.partitionBy(*keys, BLK).orderBy(*order)
    rows = src.withColumns({"_start": F.row_number().over(local) == 1, "_end": F.lead(F.lit(1)).over(local).isNull()})

    # 1. fold blocks
    feed = rows.select(*keys, BLK, "_start", "_end", *maps, *[F.col(f"_f_{n}").alias(f"_e_{n}") for n in names])
    doubles = [f for n in names for f in (*parts[n], f"_e_{n}")]
    block_schema = T.StructType([rows.schema[k] for k in keys] + [rows.schema[BLK]] + [T.StructField(f, T.DoubleType()) for f in doubles])
    blocks = feed.mapInArrow(_fold(keys, names, block_schema.names), block_schema)

    # 2. recurrence over the block maps (one small row per block)
    per_key = Window.partitionBy(*keys).orderBy(BLK)
    ends_in = blocks.withColumn("_start", F.row_number().over(per_key) == 1)
    end_schema = T.StructType([rows.schema[k] for k in keys] + [rows.schema[BLK]] + [T.StructField(n, T.DoubleType()) for n in names])
    ends = ends_in.mapInArrow(_replay(names, end_schema.names), end_schema)
    carry = ends.select(*keys, BLK, *[F.lag(n).over(per_key).alias(f"_in_{n}") for n in names])

    # 3. replay rows
    joined = rows.join(carry, [*keys, BLK], "left")
    for n in names:
        entry = F.col(f"_a_{n}") * F.col(f"_in_{n}") + F.col(f"_b_{n}")
        if names[n]:
            entry = F.when(entry.isNotNull(), F.least(F.greatest(entry, F.col(f"_lo_{n}")), F.col(f"_hi_{n}")))
        joined = joined.withColumn(f"_e_{n}", F.when(F.col("_start"), F.coalesce(entry, F.col(f"_f_{n}"))))
    keep = [c for c in df.columns if c not in names]
    out_schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in names])
    ready = joined.sortWithinPartitions(*keys, BLK, *order)
    return ready.select(*keep, "_start", *maps, *[f"_e_{n}" for n in names]).mapInArrow(_replay(names, out_schema.names), out_schema)
