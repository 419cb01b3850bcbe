"""Zones that the first later bar through their midpoint ends, parallel inside a key.

Younger zones never feel older ones: a zone ends by a bar through its midpoint or, as the oldest goes first, by the
number of younger ones. So a block of bars can be swept on its own, and what it does to zones from before it is a
short summary:

* the first bar to reach each price: pieces of the price axis, a new one only where a bar goes beyond all before it;
* the first bar at which the block's own active zones number 1, 2, ... up to the cap.

A chain over the blocks of a key holds the active zones (at most the cap) and ends them from these summaries alone.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed
from .grouped import Sweep, sequential

#: Bars of a block.
ROWS = 20_000
NEVER = np.iinfo(np.int64).max
FIELDS = ["start_seq", "side", "top", "bottom", "intensity"]
ZONE = "start_seq long, side string, top double, bottom double, intensity double, end_seq long, status string"


class ZoneSweep(Sweep):
    """The streaming form: active zones of one key, oldest first."""

    def __init__(self, k: int, max_zones: int):
        self.k, self.max_zones = k, max_zones
        self.zones: list[tuple] = []
        self.mids = np.empty(0)

    def _close(self, mask: np.ndarray, seq: int | None, status: str, out: list) -> None:
        keep = []
        for zone, gone in zip(self.zones, mask):
            if gone:
                out.append((*zone, seq, status))
            else:
                keep.append(zone)
        self.zones, self.mids = keep, self.mids[~mask]

    def push(self, rows):
        out: list = []
        for seq, h, lo_, ph, pl, inten, pad in zip(*(rows[c] for c in ("seq", "_h", "_l", "_hi", "_lo", "_int", "_pad"))):
            if not np.isnan(ph):
                self.zones.append((int(seq) - self.k, "above", ph + pad, ph, inten))
                self.mids = np.append(self.mids, (ph + pad + ph) / 2)
            if not np.isnan(pl):
                self.zones.append((int(seq) - self.k, "below", pl, pl - pad, inten))
                self.mids = np.append(self.mids, (pl + (pl - pad)) / 2)
            through = (self.mids < h) & (self.mids > lo_)
            if through.any():
                self._close(through, int(seq), "consumed", out)
            surplus = len(self.zones) - self.max_zones
            if surplus > 0:
                self._close(np.arange(len(self.zones)) < surplus, int(seq), "dropped", out)
            self.note(int(seq), h, lo_)
        return self._columns(out)

    def note(self, seq: int, high: float, low: float) -> None:
        """A bar has been applied."""

    def finish(self):
        return self._columns([(*z, None, "open") for z in self.zones])

    def _columns(self, out: list):
        return dict(zip([*FIELDS, "end_seq", "status"], zip(*out))) if out else None


class _BlockZones(ZoneSweep):
    """A block by itself: zones that end inside it (part -1), its summary (part 0), zones it leaves (part 1, 2, ...).

    A bar's open range is held half-open, from the next double above its low up to its high, so ranges that leave out
    a single price between them stay apart.
    """

    def __init__(self, k: int, max_zones: int):
        super().__init__(k, max_zones)
        self.low: list[float] = []
        self.high: list[float] = []
        self.pieces: list[tuple] = []
        self.reached: list[int] = []

    def note(self, seq, high, low):
        a, b = float(np.nextafter(low, np.inf)), float(high)
        while len(self.reached) < len(self.zones):
            self.reached.append(seq)
        if not a < b:
            return
        i, j = bisect.bisect_left(self.high, a), bisect.bisect_right(self.low, b)
        at = a
        for lo, hi in zip(self.low[i:j], self.high[i:j]):
            if at < lo:
                self.pieces.append((at, min(lo, b), seq))
            at = max(at, hi)
        if at < b:
            self.pieces.append((at, b, seq))
        if i < j:
            a, b = min(a, self.low[i]), max(b, self.high[j - 1])
        self.low[i:j], self.high[i:j] = [a], [b]

    def _columns(self, out):
        got = super()._columns(out)
        return got and self._rows(got, [-1] * len(out))

    @staticmethod
    def _rows(zones: dict, parts: list, summary: tuple | None = None) -> dict:
        n = len(parts)
        return {**zones, "part": parts, **{c: [s] + [None] * (n - 1) for c, s in zip(("piece", "until", "first", "reached"), summary or [None] * 4)}}

    def finish(self):
        self.pieces.sort()
        piece, until, first = zip(*self.pieces) if self.pieces else ((), (), ())
        blank = (0, "", 0.0, 0.0, 0.0)
        rows = [(*z, 0, "") for z in (blank, *self.zones)]
        return self._rows(dict(zip([*FIELDS, "end_seq", "status"], zip(*rows))), list(range(len(rows))), (piece, until, first, self.reached))


class _ZoneChain(Sweep):
    """Zones that outlive their block, ended from the summaries of later ones."""

    def __init__(self, max_zones: int):
        self.max_zones = max_zones
        self.zones: list[tuple] = []

    def push(self, rows):
        out: list = []
        for zone in zip(*(rows[c] for c in (*FIELDS, "part", "piece", "until", "first", "reached"))):
            if zone[5] == 0:
                self._pass(*zone[6:], out)
            else:
                self.zones.append(zone[:5])
        return dict(zip([*FIELDS, "end_seq", "status"], zip(*out))) if out else None

    def _pass(self, piece, until, first, reached, out: list) -> None:
        n = len(self.zones)
        if n == 0:
            return
        mids = np.array([(z[2] + z[3]) / 2 for z in self.zones])
        hit = np.full(n, NEVER)
        if len(piece):
            at = np.searchsorted(piece, mids, "right") - 1
            within = (at >= 0) & (mids < np.asarray(until)[at])
            hit[within] = np.asarray(first)[at[within]]
        dropped = np.full(n, NEVER)
        if len(reached):
            marks = np.asarray(reached)
            alive = (hit[:, None] > marks).astype(np.int64)
            younger = np.cumsum(alive[::-1], axis=0)[::-1] - alive
            full = younger + np.arange(1, len(marks) + 1) >= self.max_zones
            some = full.any(axis=1)
            dropped[some] = marks[full.argmax(axis=1)[some]]
        keep = []
        for zone, h, d in zip(self.zones, hit.tolist(), dropped.tolist()):
            if h == d == NEVER:
                keep.append(zone)
            else:
                out.append((*zone, min(h, d), "consumed" if h <= d else "dropped"))
        self.zones = keep

    def finish(self):
        return dict(zip([*FIELDS, "end_seq", "status"], zip(*[(*z, None, "open") for z in self.zones]))) if self.zones else None


def sweep_zones(feed: DataFrame, keys: list[str], k: int, max_zones: int, rows: int = ROWS) -> DataFrame:
    """Zones of a feed of numbered bars (``seq, _h, _l, _hi, _lo, _int, _pad``), equal to ``ZoneSweep`` over whole keys."""
    dealt = feed.withColumn("_blk", F.floor((F.col("seq") - 1) / rows).cast("long"))
    cells = [*keys, "_blk"]
    zone = T._parse_datatype_string(ZONE).fields
    more = T._parse_datatype_string("part long, piece array<double>, until array<double>, first array<long>, reached array<long>").fields
    fold_schema = T.StructType([*zone, *more, *[dealt.schema[c] for c in cells]])
    parts = checkpointed(sequential(dealt, cells, ["seq"], lambda: _BlockZones(k, max_zones), fold_schema))
    names = [f.name for f in zone]
    ended = parts.where("part < 0").select(*names, *keys)
    carried = parts.where("part >= 0").drop("end_seq", "status")
    chain_schema = T.StructType([*zone, *[dealt.schema[c] for c in keys]])
    return ended.unionByName(sequential(carried, keys, ["_blk", "part"], lambda: _ZoneChain(max_zones), chain_schema))
