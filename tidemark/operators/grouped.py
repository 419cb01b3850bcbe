"""Sequential operators whose state neither composes nor has a window form.

Rows are shuffled by key, sorted, and streamed through the task batch by batch; only the operator's
own state is held, never the group. Parallel across keys, one task per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


Columns = dict[str, Sequence]


class Sweep:
    """One key's state. ``push`` gets consecutive rows of the key as arrays, ``finish`` ends the key;
    both return output columns (equal lengths) or None."""

    def push(self, rows: dict[str, np.ndarray]) -> Columns | None:
        raise NotImplementedError

    def finish(self) -> Columns | None:
        return None


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows by key in a given number of partitions, for work that takes longer than its bytes tell.

    Adaptive execution would merge partitions by their bytes and leave cores idle; it keeps a number that is asked for.
    """
    spark = df.sparkSession
    return df.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def sequential(df: DataFrame, keys: Sequence[str], order: Sequence[str], make: Callable[[], Sweep], schema: str | T.StructType) -> DataFrame:
    """Stream each key in order through a fresh ``Sweep``; key columns are added to its output."""
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, sweep = None, None
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            cols = {c: pdf[c].to_numpy() for c in pdf.columns}
            begins = np.zeros(n, dtype=bool)
            begins[0] = True
            for k in keys:
                begins[1:] |= cols[k][1:] != cols[k][:-1]
            starts = [*np.flatnonzero(begins), n]
            out: dict[str, list] = {}

            def emit(got: Columns | None, key: tuple) -> None:
                if not got:
                    return
                size = len(next(iter(got.values())))
                for c, v in got.items():
                    out.setdefault(c, []).extend(v)
                for c, v in zip(keys, key):
                    out.setdefault(c, []).extend([v] * size)

            for s, e in zip(starts, starts[1:]):
                key = tuple(cols[k][s] for k in keys)
                if key != current:
                    if sweep is not None:
                        emit(sweep.finish(), current)
                    current, sweep = key, make()
                emit(sweep.push({c: v[s:e] for c, v in cols.items()}), key)
            if out:
                yield pd.DataFrame(out)
        if sweep is not None:
            out = {}
            last = sweep.finish()
            if last:
                size = len(next(iter(last.values())))
                yield pd.DataFrame({**last, **{k: [v] * size for k, v in zip(keys, current)}})

    ordered = dealt(df, keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInPandas(run, schema)
