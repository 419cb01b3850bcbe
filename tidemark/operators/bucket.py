"""Token buckets, parallel inside an identifier.

A request first fills the bucket, ``t -> min(capacity, t + gain)``, and takes its cost if that much is there, so what it
leaves is, piece by piece, the tokens it found plus a number, or a fixed number once the bucket has been full. Such
functions compose, and a block of requests is one of them:

1. fold: each block carries every content that its bucket may have at once. A bucket that has been full for sure is one
   number from there on; where requests are refused, contents come together within one cost;
2. chain: the tokens that enter each block, by one search in each block's pieces;
3. replay: each block runs as the streaming form does, from the tokens that enter it.

Tokens are whole multiples of the capacity's last binary digit, so sums do not depend on their grouping and the blocks
give exactly what one run over the whole identifier gives. With one cost for all requests, a block has about
``capacity / cost`` pieces at most, whatever its size; with ever different costs up to one a request.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import RowBlocks, running
from .grouped import Sweep, sequential

#: Requests of a block: a folded request costs some ten times a plain one while a block has several pieces.
ROWS = 20_000


class Pieces:
    """A function of the tokens in ``[low, high]``: from ``at[i]`` on they grow by ``add[i]`` or, where ``flat``, are
    ``add[i]``."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high
        self.at, self.add, self.flat = np.array([low]), np.array([0]), np.array([False])

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The smallest and largest result of each piece."""
        until = np.append(self.at[1:] - 1, self.high)
        return np.where(self.flat, self.add, self.at + self.add), np.where(self.flat, self.add, until + self.add)

    def cut(self, level: int) -> None:
        """Split the pieces that pass ``level`` where they reach it."""
        least, most = self.ends()
        across = np.flatnonzero((least < level) & (level <= most))
        if len(across):
            self.at = np.insert(self.at, across + 1, level - self.add[across])
            self.add = np.insert(self.add, across + 1, self.add[across])
            self.flat = np.insert(self.flat, across + 1, False)

    def request(self, gain: int, want: int, capacity: int) -> None:
        self.add = self.add + gain
        self.cut(capacity)
        full = self.ends()[0] >= capacity
        self.flat, self.add = self.flat | full, np.where(full, capacity, self.add)
        self.cut(want)
        self.add = self.add - np.where(self.ends()[0] >= want, want, 0)
        if len(self.at) > 1:
            new = np.append(True, (self.add[1:] != self.add[:-1]) | (self.flat[1:] != self.flat[:-1]))
            self.at, self.add, self.flat = self.at[new], self.add[new], self.flat[new]

    @property
    def fixed(self) -> bool:
        return len(self.at) == 1 and bool(self.flat[0])


class _Fold(Sweep):
    """A block as a few ``Pieces`` one after the other: where all results lie within half of what may enter, the next
    ones start anew from that range, so pieces that have come together count once."""

    def __init__(self, capacity: int):
        self.capacity, self.done, self.now = capacity, [], Pieces(0, capacity)

    def push(self, rows):
        capacity = self.capacity
        for gain, want in zip(rows["_gain"].tolist(), rows["_want"].tolist()):
            now = self.now
            if now.fixed:
                tokens = min(capacity, int(now.add[0]) + gain)
                now.add = np.array([tokens - want if tokens >= want else tokens])
                continue
            now.request(gain, want, capacity)
            if now.fixed:
                self.done = []
            elif len(now.at) > 2:
                least, most = now.ends()
                low, high = int(least.min()), int(most.max())
                if 2 * (high - low) <= now.high - now.low:
                    self.done.append(now)
                    self.now = Pieces(low, high)
        return None

    def finish(self):
        parts = [*self.done, self.now]
        return {"part": range(len(parts)), **{c: [getattr(p, c) for p in parts] for c in ("at", "add", "flat")}}


class _Chain(Sweep):
    """The tokens that enter each block of an identifier."""

    def __init__(self, capacity: int):
        self.tokens = capacity

    def push(self, rows):
        blocks, entering = [], []
        for block, part, at, add, flat in zip(rows["_blk"], rows["part"], rows["at"], rows["add"], rows["flat"]):
            if part == 0:
                blocks.append(block)
                entering.append(self.tokens)
            i = int(np.searchsorted(np.asarray(at), self.tokens, "right")) - 1
            self.tokens = int(add[i]) + (0 if flat[i] else self.tokens)
        return {"_blk": blocks, "entering": entering} if blocks else None


class Bucket(Sweep):
    """The streaming form: requests in order, from a full bucket."""

    def __init__(self, keep: Sequence[str], capacity: int, unit: float):
        self.keep, self.capacity, self.unit, self.tokens = list(keep), capacity, unit, capacity

    def push(self, rows):
        allowed, left = [], []
        for gain, want in zip(rows["_gain"].tolist(), rows["_want"].tolist()):
            self.tokens = min(self.capacity, self.tokens + gain)
            ok = self.tokens >= want
            if ok:
                self.tokens -= want
            allowed.append(ok)
            left.append(self.tokens * self.unit)
        return {**{c: rows[c] for c in self.keep}, "allowed": allowed, "tokens": left}


class _Replay(Bucket):
    """A block from the tokens that enter it, which come as its first row."""

    def push(self, rows):
        if rows["_seq"][0] > 0:
            return super().push(rows)
        self.tokens = int(rows["_gain"][0])
        rest = {c: v[1:] for c, v in rows.items()}
        return super().push(rest) if len(rest["_seq"]) else None


def token_bucket_audit(requests: DataFrame, keys: Sequence[str], us: str, request_id: str, capacity: float, rate: float, cost: Column | None = None, block=RowBlocks(), rows: int = ROWS) -> DataFrame:
    """Which requests a token bucket per identifier would have allowed, and the tokens after each.

    ``rate`` is tokens a second; a bucket is full at its first request. Costs (1 if not given) must be zero or more and
    not null; one above the capacity is always refused. ``block`` numbers the requests of an identifier, ``rows`` is
    the size of the blocks that tasks fold and replay.
    """
    if not 0 < capacity < math.inf or not 0 <= rate < math.inf:
        raise ValueError("a bucket needs a positive capacity and a rate of zero or more")
    keys, unit = list(keys), math.ulp(float(capacity))
    full = round(capacity / unit)

    def units(tokens: Column, most: int) -> Column:
        return F.rint(F.least(tokens / F.lit(unit), F.lit(float(most)))).cast("long")

    want = units(F.lit(1.0) if cost is None else cost.cast("double"), full + 1)
    src = requests.select(*keys, request_id, F.col(us).alias("_us"), want.alias("_want"))
    placed = running(src, keys, ["_us", request_id], block, {"_seq": ("count", F.lit(1)), "_before": ("lag", F.col("_us"))})
    gain = F.coalesce(units((F.col("_us") - F.col("_before")) / F.lit(1e6) * F.lit(float(rate)), full), F.lit(0).cast("long"))
    dealt = placed.select(*keys, F.floor((F.col("_seq") - 1) / rows).cast("long").alias("_blk"), "_seq", request_id, gain.alias("_gain"), "_want")
    cells = [*keys, "_blk"]
    key_fields = [dealt.schema[c] for c in cells]
    fold_schema = T.StructType([*T._parse_datatype_string("part int, at array<long>, add array<long>, flat array<boolean>").fields, *key_fields])
    parts = sequential(dealt.select(*cells, "_seq", "_gain", "_want"), cells, ["_seq"], lambda: _Fold(full), fold_schema)
    chain_schema = T.StructType([dealt.schema["_blk"], T.StructField("entering", T.LongType()), *[dealt.schema[k] for k in keys]])
    entries = sequential(parts, keys, ["_blk", "part"], lambda: _Chain(full), chain_schema)
    # the entering tokens are the first row of their block; its id is filled so that integer ids stay integers
    kind = dealt.schema[request_id].dataType
    blank = F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else F.lit(None).cast(kind)
    first = entries.select(*cells, F.lit(0).cast("long").alias("_seq"), blank.alias(request_id), F.col("entering").alias("_gain"), F.lit(0).cast("long").alias("_want"))
    schema = T.StructType([src.schema[request_id], T.StructField("allowed", T.BooleanType()), T.StructField("tokens", T.DoubleType()), *key_fields])
    return sequential(dealt.unionByName(first), cells, ["_seq"], lambda: _Replay([request_id], full, unit), schema).drop("_blk")
