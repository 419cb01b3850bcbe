"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, ship_package

#: White space of the contracts: space and tab to carriage return, nothing of Unicode's.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a scale folder, read by Spark (any store it reaches)."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whole(text: Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(text, F.lit(""))


def held_out(doc_id: Column) -> Column:
    """True for the rows no label may be learned from: crc32 of the id as text divides by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def seeded_order(seed: int, *parts: Column) -> Column:
    """Repeatable random order: md5 hex of the seed and the parts (the same in every SQL engine)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def smallest(df: DataFrame, n: int, order: Column) -> DataFrame:
    """The ``n`` first rows of a seeded order: a bounded, repeatable sample (per-task heaps, then one merge of n rows each)."""
    return df.orderBy(order).limit(n)


def give_back() -> None:
    """Return freed memory to the system at the end of a task, as workers live on into the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def _bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of each row's texts."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return sizes


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in short pieces, so that only few rows and about ``size`` bytes of text are Python objects at a time;
    a longer text is a piece of its own."""
    for batch in batches:
        before = np.cumsum(_bytes(batch))
        at = 0
        while at < batch.num_rows:
            used = before[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(before, used + size, "right"))))
            yield batch.slice(at, end - at)
            at = end
    give_back()


__all__ = ["SPACE", "checkpointed", "give_back", "held_out", "lower_ascii", "seeded_order", "slices", "smallest", "table", "whole"]
