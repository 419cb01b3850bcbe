"""Daily loss latch on event-time timers.

Rows wait in the state store, as they come, until the watermark says that nothing older can follow; a timer at the end
of each slot of time then settles them in event order, whatever the order of files and micro-batches was. A timer at
midnight UTC closes a key's day, with or without a new row, and clears its state, so idle keys leave the store.

State is typed (a list of waiting rows and one row for the day), so a restart does not depend on a pickled class. A
key's waiting rows are those of one slot and the watermark's delay.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.blocks import micros
from .stateful import STATE_STORE

DAY_US = micros("1 day")
#: Rows that come out at once.
PIECE = 10_000
WAITING = "us long, realized double, unrealized double"
TODAY = "day long, n long, total double, lowest double, warned boolean, limited boolean"
OUT = "kind string, us long, day long, n long, total_today double, lowest double, warned boolean, limited boolean"


def _in_order(us: array, ids: list) -> Iterator[int]:
    """Places of rows by time, ties by id."""
    times = np.asarray(us)
    order = np.argsort(times, kind="stable")
    borders = np.flatnonzero(np.diff(times[order])) + 1
    first = 0
    for end in itertools.chain(map(int, borders), [len(order)]):
        places = order[first:end].tolist()
        yield from sorted(places, key=ids.__getitem__) if end - first > 1 else places
        first = end


class DailyLatch(StatefulProcessor):
    def __init__(self, keys: Sequence[str], row_id: str, id_type: str, slot: int, limit: float, warning: float):
        self.keys, self.row_id, self.id_type = list(keys), row_id, id_type
        self.slot, self.limit, self.warn_at = slot, limit, limit * warning

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"id {self.id_type}, {WAITING}")
        self.today = handle.getValueState("today", TODAY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        oldest = None
        for pdf in rows:
            first = int(pdf["us"].min())
            oldest = first if oldest is None else min(oldest, first)
            self.waiting.appendList(list(pdf[["id", "us", "realized", "unrealized"]].itertuples(index=False, name=None)))
        self._wake(oldest)
        return iter(())

    def _wake(self, us: int) -> None:
        """A timer at the end of the slot of the oldest row that waits; later slots get theirs when it fires."""
        self.handle.registerTimer((us // self.slot + 1) * self.slot // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # rows of all slots that the watermark has passed are settled at once
        now = timerValues.getCurrentWatermarkInMs() * 1000
        upto = now // self.slot * self.slot
        # numbers wait in arrays, and rows come out in pieces: a row as a tuple takes many times its bytes
        ids, us, realized, unrealized, later = [], array("q"), array("d"), array("d"), []
        if self.waiting.exists():
            for row in self.waiting.get():
                if row[1] < upto:
                    for held, value in zip((ids, us, realized, unrealized), row):
                        held.append(value)
                else:
                    later.append(tuple(row))
        today = tuple(self.today.get()) if self.today.exists() else None
        out: list[tuple] = []
        for i in _in_order(us, ids):
            if today is not None and us[i] // DAY_US != today[0]:
                out.append(self._closed(today))
                today = None
            today = self._apply((ids[i], us[i], realized[i], unrealized[i]), today, out)
            if len(out) >= PIECE:
                yield self._frame(key, out)
                out = []
        if today is not None and (today[0] + 1) * DAY_US <= now:
            out.append(self._closed(today))
            today = None
        self._keep(len(ids) > 0, later, today)
        if out:
            yield self._frame(key, out)

    def _frame(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        ids, *rest = zip(*out)
        names = [f.split()[0] for f in OUT.split(", ")]
        return pd.DataFrame({**{k: [v] * len(out) for k, v in zip(self.keys, key)}, self.row_id: pd.Series(ids, dtype=object), **dict(zip(names, rest))})

    def _apply(self, row: tuple, today: tuple | None, out: list) -> tuple:
        row_id, us, realized, unrealized = row
        day, n, total, lowest, warned, limited = today or (us // DAY_US, 0, 0.0, float("inf"), False, False)
        total += realized
        now = total + unrealized
        today = day, n + 1, total, min(lowest, now), warned or now <= -self.warn_at, limited or now <= -self.limit
        out.append((row_id, "row", us, day, n + 1, now, *today[3:]))
        return today

    @staticmethod
    def _closed(today: tuple) -> tuple:
        day, n, total, lowest, warned, limited = today
        return None, "reset", (day + 1) * DAY_US, day, n, total, lowest, warned, limited

    def _keep(self, settled: bool, later: list, today: tuple | None) -> None:
        if settled and later:
            self.waiting.put(later)
        elif settled:
            self.waiting.clear()
        if later:
            self._wake(min(row[1] for row in later))
        if today is None:
            self.today.clear()
        else:
            self.today.update(today)
            self.handle.registerTimer((today[0] + 1) * DAY_US // 1000)

    def close(self) -> None:
        pass


def daily_loss_latch(stream: DataFrame, keys: Sequence[str], ts: str, row_id: str, realized: str, unrealized: str, limit: float, warning: float = 0.5, delay: str = "10 minutes", slot: str = "1 hour") -> DataFrame:
    """Each row with its day's total and latches (kind ``row``), and each finished day of a key (kind ``reset``).

    ``lowest`` is the day's lowest total so far; a ``reset`` carries the realised total and stands at midnight. Rows
    come out once the watermark (``delay`` behind the newest row) has passed their slot, which must divide a day; rows
    later than the watermark are dropped. Ties in time are settled by ``row_id``.
    """
    width = micros(slot)
    if DAY_US % width:
        raise ValueError("a slot must divide a day")
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    src = stream.withWatermark(ts, delay).select(
        *keys, ts, F.col(row_id).alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(realized).cast("double").alias("realized"), F.col(unrealized).cast("double").alias("unrealized")
    )
    schema = T.StructType([*[stream.schema[k] for k in keys], T.StructField(row_id, stream.schema[row_id].dataType), *T._parse_datatype_string(OUT).fields])
    latch = DailyLatch(keys, row_id, stream.schema[row_id].dataType.simpleString(), width, limit, warning)
    return src.groupBy(*keys).transformWithStateInPandas(statefulProcessor=latch, outputStructType=schema, outputMode="Append", timeMode="EventTime")
