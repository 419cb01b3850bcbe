"""Hard negatives by a vertical scan of columns (BOND).

Every anchor meets every vector, in cells of one block of anchors and one block of vectors, so no task holds more
than one block of anchors and one Arrow batch of vectors. Inside a cell a batch is turned into columns, one for each
dimension. An anchor reads them in the order of its own components' size, largest first, a few at a time, and keeps
for each vector the score so far. What the unread columns can still add lies between the sums of their smallest and
largest products, taken from the columns' minima and maxima; a vector whose possible scores miss the window leaves
the anchor's candidate bitmap. Those that stay until the last column have exact scores.

The scan runs twice: for the best rows of the anchor's own label (the window's floor is the last of the best so far),
then for the rows of other labels inside the windows that the positives' scores open. A cell gives out its best few
rows of each anchor, and Spark merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, slices

POSITIVES = 5
NEGATIVES = 3
#: Rows of a cell: vectors stream; anchors are held, so many numbers of them at most.
VECTOR_ROWS, ANCHOR_NUMBERS = 4096, 1 << 20
#: Columns read between two looks at the bitmap.
STEP = 8
_EXACT = float(2**53)
_LEAST, _MOST = -(2**63), 2**63 - 1


def prepared(df: DataFrame, label: Column, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row, vec_id, label, dims, v) of the rows that take part; ``row`` names a row by its content."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.where(label.isNotNull() & v.isNotNull() & finite).select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.size(v).alias("dims"), v.alias("v"))
    return rows.select(F.xxhash64("vec_id", "label", "v").alias("row"), "*").dropDuplicates(["row", "vec_id", "label", "v"])


def _whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles, or Python integers where a double could not hold them exactly."""
    if not len(x) or np.abs(x).max(initial=0.0) * scale < _EXACT:
        return np.floor(x * scale)
    exact = [int(v) * scale if abs(v) >= _EXACT else int(np.floor(v * scale)) for v in x.ravel()]
    return np.array(exact, dtype=object).reshape(x.shape)


def vertical_scan(anchor: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, among: np.ndarray, floor, ceiling) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of those of ``among`` whose inner product with the anchor lies within [floor, ceiling].

    ``columns`` has a row for each dimension, ``low`` and ``high`` are their least and greatest values.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    a = anchor[order]
    ends = a * low[order], a * high[order]
    least = np.append(np.cumsum(np.minimum(*ends)[::-1])[::-1], 0)  # what the columns from here on add at least
    most = np.append(np.cumsum(np.maximum(*ends)[::-1])[::-1], 0)
    score = np.zeros(len(among), dtype=columns.dtype)
    for at in range(0, len(a), STEP):
        if not len(among):
            break
        read = order[at : at + STEP]
        score = score + a[at : at + STEP] @ (columns[read] if len(among) == columns.shape[1] else columns[np.ix_(read, among)])
        after = min(at + STEP, len(a))
        alive = (score + most[after] >= floor) & (score + least[after] <= ceiling)
        if not alive.all():
            among, score = among[alive], score[alive]
    return among, score


def _longs(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        return np.array([min(max(int(s), _LEAST), _MOST) for s in scores], dtype=np.int64)
    return scores.astype(np.int64)


class _Best:
    """The first ``n`` of (score down, id up, null id last, row) among the entries offered so far."""

    def __init__(self, n: int, floor):
        self.n, self.floor = n, floor
        self.score, self.id, self.none, self.row = (np.empty(0, dtype=t) for t in (np.int64, np.int64, bool, np.int64))

    def offer(self, *entries: np.ndarray) -> None:
        joined = [np.concatenate(p) for p in zip((self.score, self.id, self.none, self.row), entries)]
        score, ids, none, row = joined
        first = np.lexsort((row, ids, none, ~score))[: self.n]
        self.score, self.id, self.none, self.row = (c[first] for c in joined)
        if len(first) == self.n:
            self.floor = max(self.floor, int(self.score[-1]))


class _Positives:
    """Best rows of the anchor's own label."""

    def __init__(self, anchor: dict):
        self.anchor, self.best = anchor, [_Best(POSITIVES, _LEAST)]

    def among(self, labels, ids, none, rows) -> np.ndarray:
        own = (rows == self.anchor["row"]) & (ids == self.anchor["vec_id"]) & ~none
        return np.flatnonzero((labels == self.anchor["label"]) & ~own)

    def window(self) -> tuple:
        floor = self.best[0].floor
        return (float("-inf") if floor == _LEAST else floor), float("inf")

    def take(self, score, ids, none, rows) -> None:
        self.best[0].offer(score, ids, none, rows)


class _Negatives:
    """Best rows of other labels in the window that each positive opens."""

    def __init__(self, anchor: dict):
        self.anchor = anchor
        scores = anchor["positive_scores"]
        self.best = [_Best(NEGATIVES, -(-50 * p // 100)) for p in scores]
        self.top = [95 * p // 100 for p in scores]

    def among(self, labels, ids, none, rows) -> np.ndarray:
        return np.flatnonzero(labels != self.anchor["label"])

    def window(self) -> tuple:
        open_ = [(b.floor, top) for b, top in zip(self.best, self.top) if b.floor <= top]
        return (min(f for f, _ in open_), max(t for _, t in open_)) if open_ else (1, 0)

    def take(self, score, ids, none, rows) -> None:
        for b, top in zip(self.best, self.top):
            inside = (score >= b.floor) & (score <= top)
            if inside.any():
                b.offer(score[inside], ids[inside], none[inside], rows[inside])


_FOUND = "anchor_row long, anchor_id long, place int, row long, vec_id long, score long"
_FIELDS = [("anchor_row", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]


def _cells(kind: type, scale: int):
    """Rows sorted by (dims, anchor block, vector block, anchors first) -> the best rows of each anchor of a cell."""

    def found(anchors: list) -> pa.RecordBatch:
        out = [(s.anchor["row"], s.anchor["vec_id"], place, r, None if gone else i, v) for s, _ in anchors for place, b in enumerate(s.best) for r, i, gone, v in zip(b.row.tolist(), b.id.tolist(), b.none.tolist(), b.score.tolist())]
        columns = list(zip(*out)) if out else [()] * len(_FIELDS)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], names=[f for f, _ in _FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, anchors = None, []
        for batch in slices(batches, VECTOR_ROWS):
            place = np.stack([batch.column(c).to_numpy() for c in ("dims", "near", "far", "side")], axis=1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1), batch.num_rows]
            for at, end in zip(cuts, cuts[1:]):
                if at == end:
                    continue
                dims, *_, side = here = place[at].tolist()
                part = batch.slice(at, end - at)
                matrix = _whole_numbers(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(end - at, dims), scale)
                if here[:3] != cell:
                    if anchors:
                        yield found(anchors)
                    cell, anchors = here[:3], []
                if side == 0:
                    names = [c for c in ("row", "vec_id", "label", "positive_scores") if c in part.schema.names]
                    anchors += [(kind(a), q) for a, q in zip(part.select(names).to_pylist(), matrix)]
                elif anchors:
                    _scan_batch(anchors, part, matrix)
        if anchors:
            yield found(anchors)

    return run


def _scan_batch(anchors: list, part: pa.RecordBatch, matrix: np.ndarray) -> None:
    labels, rows = part.column("label").to_numpy(), part.column("row").to_numpy()
    none = part.column("vec_id").is_null().to_numpy(zero_copy_only=False)
    ids = part.column("vec_id").fill_null(_MOST).to_numpy()
    columns = np.ascontiguousarray(matrix.T)
    low, high = columns.min(axis=1), columns.max(axis=1)
    reach = max(np.abs(columns).max(initial=0), 1) * max(len(columns), 1)
    for state, q in anchors:
        floor, ceiling = state.window()
        if floor > ceiling:
            continue
        c, lo, hi = columns, low, high
        if c.dtype == object or q.dtype == object or float(reach) * float(max(np.abs(q).max(initial=0), 1)) >= _EXACT:
            q, c, lo, hi = (np.array([int(x) for x in m.ravel()], dtype=object).reshape(m.shape) for m in (q, c, lo, hi))
        at, score = vertical_scan(q, c, lo, hi, state.among(labels, ids, none, rows), floor, ceiling)
        if len(at):
            state.take(_longs(score), ids[at], none[at], rows[at])


def _best(found: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of each (anchor, place) over all cells, numbered from 1."""
    w = Window.partitionBy("anchor_row", "anchor_id", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def hard_negatives(df: DataFrame, label: Column, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of floor(scale * x). An anchor's positives are its first five other rows of the same
    label by (score down, id up); for each positive, its first three rows of another label with
    50 * positive_score <= 100 * negative_score <= 95 * positive_score come out. A positive without any gives no row.

    Rows with a null label or vector, or a null or non-finite component, take no part. ``anchor`` is a condition on
    ``vec_id``; a null id is never an anchor, may be a positive or a negative, and comes last among ties. Rows that
    repeat an id with another label or vector are rows of their own; a row repeated whole counts once. Vectors of
    different lengths never meet. Whole numbers too large for a double are scored as integers; scores beyond a long
    are given as the nearest long. Other columns are not read. An empty table gives an empty result.
    """
    rows = checkpointed(prepared(df, label, vec_id, vector))
    anchors = rows.where(anchor & F.col("vec_id").isNotNull())
    n, n_anchors, dims = rows.agg(F.count("*"), F.count_if(anchor & F.col("vec_id").isNotNull()), F.max("dims")).first()
    near = max(1, -(-n_anchors * (dims or 1) // ANCHOR_NUMBERS))
    far = max(1, -(-n // VECTOR_ROWS))

    def grid(anchors: DataFrame) -> DataFrame:
        held = anchors.withColumns({"side": F.lit(0), "near": F.pmod("row", F.lit(near)).cast("int"), "far": F.explode(F.sequence(F.lit(0), F.lit(far - 1)))})
        met = rows.withColumns({"side": F.lit(1), "near": F.explode(F.sequence(F.lit(0), F.lit(near - 1))), "far": F.pmod("row", F.lit(far)).cast("int")})
        cell = ("dims", "near", "far")
        return held.unionByName(met, allowMissingColumns=True).repartition(*cell).sortWithinPartitions(*cell, "side")

    best = _best(grid(anchors).mapInArrow(_cells(_Positives, scale), _FOUND), POSITIVES)
    per_anchor = best.groupBy("anchor_row", "anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))
    positives = checkpointed(per_anchor.select(F.col("anchor_row").alias("row"), F.col("anchor_id").alias("vec_id"), "p"))
    asked = anchors.join(positives, ["row", "vec_id"]).withColumn("positive_scores", F.col("p.score")).drop("p")
    found = _best(grid(asked).mapInArrow(_cells(_Negatives, scale), _FOUND), NEGATIVES)
    named = found.join(positives.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"), "p"), ["anchor_row", "anchor_id"])
    positive = F.element_at("p", F.col("place") + 1)
    return named.select("anchor_id", positive["vec_id"].alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def mined(df: DataFrame) -> DataFrame:
    """The registered query: labels of ids divisible by 7 are moved on by one; anchors are ids divisible by 50."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(df, label, F.col("vec_id") % 50 == 0)


SQL = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, a.label as anchor_label, e.vec_id, e.label, cast(list_dot_product(a.q, e.q) as bigint) as score
  from e a join e on e.vec_id <> a.vec_id where a.vec_id % 50 = 0),
p as (
  select anchor_id, anchor_label, vec_id as positive_id, score as positive_score from s where label = anchor_label
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over w as int) as rank, s.vec_id as negative_id, positive_score, s.score as negative_score
from p join s using (anchor_id)
where s.label <> p.anchor_label and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score
window w as (partition by anchor_id, positive_id order by s.score desc, s.vec_id)
qualify row_number() over w <= 3
"""
