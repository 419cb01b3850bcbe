"""Functions of the last ``n`` values on every row, without an array per row.

Rows are dealt to blocks with the ``n - 1`` rows before them (a halo) and stream through a task as sorted Arrow
batches. Frames are overlapping views of one array of values, so memory is a batch and a halo, whatever ``n`` is, and
all other columns pass by untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .blocks import spread, with_seq

#: Frames that a function gets at a time.
CHUNK = 1024


def strided(df: DataFrame, keys: Sequence[str], order: Sequence[str], block, col: str, n: int, compute: Callable[[np.ndarray], Sequence], ddl: str, need: int = 1, hop: int = 1, rows: int = 50_000) -> DataFrame:
    """Add ``seq`` and the columns of ``ddl``: ``compute`` gets frames as rows of a matrix and returns one sequence for
    each column.

    The columns are null before ``need`` values have been seen and between the rows of a ``hop``. A key's first rows
    have shorter frames. Values must not be null.
    """
    had = "seq" in df.columns
    src = df if had else with_seq(df, keys, order, block)
    dealt, _ = spread(src, keys, "seq", rows, n - 1)
    added = T._parse_datatype_string(ddl).fields
    schema = T.StructType([*src.schema.fields, *added])
    passed = src.columns
    sample = df.sparkSession.createDataFrame([], T.StructType(added)).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tail = None, np.empty(0)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            seq, rb, home = (batch.column(c).to_numpy() for c in ("seq", "_rb", "_home"))
            value = batch.column(col).cast(pa.float64()).to_numpy(zero_copy_only=False)
            new = np.ones(len(seq), dtype=bool)
            new[1:] = (seq[1:] != seq[:-1] + 1) | (rb[1:] != rb[:-1])
            new[0] = last is None or (seq[0], rb[0]) != (last[0] + 1, last[1])
            starts = np.flatnonzero(new)
            found: list[list] = [[None] * len(seq) for _ in added]
            for at, end in zip([0, *starts[starts > 0]], [*starts[starts > 0], len(seq)]):
                held = np.empty(0) if new[at] else tail
                v = np.concatenate([held, value[at:end]])
                own = seq[at:end]
                due = np.flatnonzero((home[at:end] == rb[at:end]) & (own >= need) & (own % hop == 0))
                for size in np.unique(np.minimum(own[due], n)):
                    places = due[np.minimum(own[due], n) == size]
                    views = np.lib.stride_tricks.sliding_window_view(v, size)
                    for c in range(0, len(places), CHUNK):
                        part = places[c : c + CHUNK]
                        for out, got in zip(found, compute(views[part + len(held) - size + 1])):
                            for i, g in zip((part + at).tolist(), got):
                                out[i] = g
                tail = v[max(0, len(v) - n + 1) :]
            last = seq[-1], rb[-1]
            mine = pa.array(np.flatnonzero(home == rb))
            if len(mine):
                columns = [pa.array(f, sample.field(a.name).type).take(mine) for f, a in zip(found, added)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(mine) for c in passed], *columns], names=schema.names)

    ready = dealt.repartition(*keys, "_rb").sortWithinPartitions(*keys, "_rb", "seq")
    return ready.mapInArrow(run, schema)
