"""Embedding near-deduplication by collision counting over one-dimensional projections.

Unit vectors are projected on random directions. The projections of two vectors at cosine c differ by a normal
deviate of variance 2 (1 - c), so near vectors fall into each other's query-centred window on almost every
projection. A pair is verified (cosine in double precision) when it collides in at least ``need`` of the counted
projections; ``need`` follows from the binomial law at the threshold cosine and the wanted recall.

Counting windows for all pairs would be quadratic, so pairs are only counted inside blocks: ``tables`` times,
vectors are dealt by the cells of ``depth`` projections. Depth grows with the logarithm of the number of vectors
(blocks stay about the same size) and the number of tables follows from the recall. Inside a block the counted
projections are sorted, a window is a range of ranks, and a pair is the business of the first table in which its
vectors meet. A block with more vectors than a tile is cut into tiles, every two of which meet in a task of their
own. Tasks give out link counts and a spanning forest of their links, never the pairs. Equal vectors are one
class before any of this.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed
from .components import Forest, connected_components

THRESHOLD = 0.95
RECALL = 0.9995
#: Width of a cell, half-width of a window in standard deviations at the threshold, projections that are counted.
CELL, WINDOW, COUNTED = 2.5, 2.0, 32
#: Vectors to a block at full spread; vectors to a tile.
BLOCK, TILE = 512, 1024
SEED = 7


def same_cell(cosine: float, width: float = CELL) -> float:
    """Chance that two unit vectors share a randomly shifted cell of one projection."""
    s = math.sqrt(2 * (1 - cosine))
    return math.erf(width / (s * math.sqrt(2))) - s / width * math.sqrt(2 / math.pi) * (1 - math.exp(-(width**2) / (2 * s * s)))


def needed_collisions(counted: int, window: float, recall: float) -> int:
    """Largest count that a pair at the threshold reaches with at least the wanted chance."""
    p, below = math.erf(window / math.sqrt(2)), 0.0
    for n in range(counted + 1):
        below += math.comb(counted, n) * p**n * (1 - p) ** (counted - n)
        if below > 1 - recall:
            return n
    return counted


def plan_tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(depth, tables) for n vectors."""
    depth = max(1, round(math.log(max(n, 1) / BLOCK) / math.log(1 / same_cell(0.0)))) if n > BLOCK else 1
    return depth, math.ceil(math.log(1 - recall) / math.log(1 - same_cell(threshold) ** depth))


def _units(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _directions(dim: int, n: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, part, dim])
    return rng.standard_normal((dim, n)), rng.uniform(0, CELL, n)


def _vectors(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector in an Arrow list column."""
    sizes = np.asarray(column.value_lengths())
    flat, starts = np.asarray(column.flatten()), np.concatenate(([0], np.cumsum(sizes)))[:-1]
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield at, flat[starts[at][:, None] + np.arange(dim)]


def _keys(depth: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list = [None] * batch.num_rows
            for at, rows in _vectors(batch.column("v")):
                a, shift = _directions(rows.shape[1], depth * tables, 0)
                cells = np.floor((_units(rows) @ a + shift) / CELL).astype(np.int32).reshape(len(at), tables, depth)
                for i, own in zip(at, cells):
                    keys[i] = [xxhash.xxh3_64_intdigest(own[t].tobytes(), rows.shape[1]) - (1 << 63) for t in range(tables)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], names=["v", "rep", "size", "keys"])

    return run


def _meet(rep, size, unit, keys, table: int, left: np.ndarray, right: np.ndarray, same: bool, threshold: float, need: int):
    """Links between two tiles (or inside one): link counts per row and a forest of links."""
    n = len(rep)
    links, forest = np.zeros(n, np.int64), Forest()
    a, _ = _directions(unit.shape[1], COUNTED, 1)
    p = unit @ a
    half = WINDOW * math.sqrt(2 * (1 - threshold))
    lo, wide, rank = (np.empty((COUNTED, k), np.int32) for k in (len(left), len(left), len(right)))
    for m in range(COUNTED):
        order = np.argsort(p[right, m], kind="stable")
        there = p[right, m][order]
        rank[m, order] = np.arange(len(right))
        lo[m] = np.searchsorted(there, p[left, m] - half, "left")
        wide[m] = np.searchsorted(there, p[left, m] + half, "right") - lo[m]
    lo, wide, rank = lo.astype(np.uint32), wide.astype(np.uint32), rank.astype(np.uint32)
    for at in range(0, len(left), 256):
        rows = slice(at, at + 256)
        hits = np.zeros((len(left[rows]), len(right)), np.uint8)
        for m in range(COUNTED):  # a window is a range of ranks: lo <= rank < lo + wide, unsigned
            hits += (rank[m][None, :] - lo[m, rows][:, None]) < wide[m, rows][:, None]
        i, j = np.nonzero(hits >= need)
        i, j = left[rows][i], right[j]
        if same:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 65536):
            x, y = i[s : s + 65536], j[s : s + 65536]
            ok = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
            x, y = x[ok], y[ok]
            if table and len(x):
                first = ~(keys[x, :table] == keys[y, :table]).any(axis=1)
                x, y = x[first], y[first]
            np.add.at(links, x, size[y])
            np.add.at(links, y, size[x])
            for u, v in zip(rep[x].tolist(), rep[y].tolist()):
                forest.link(u, v)
    return links, forest


def _blocks(threshold: float, need: int):
    """Rows sorted by (table, key, pair of tiles) in; (rep, other, links) out, other set for forest links only."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        out_u, out_v, out_n = [], [], []
        rep, size, part = (np.asarray(t[c].combine_chunks()) for c in ("rep", "size", "part"))
        keys = np.array(t["keys"].to_pylist(), dtype=np.int64)
        low, high, table = t["low"][0].as_py(), t["high"][0].as_py(), t["table"][0].as_py()
        for at, mat in _vectors(t["v"].combine_chunks()):
            mine = part[at]
            left, right = np.flatnonzero(mine == low), np.flatnonzero(mine == high)
            links, forest = _meet(rep[at], size[at], _units(mat), keys[at], table, left, right, low == high, threshold, need)
            some = np.flatnonzero(links)
            u, v = forest.links()
            out_u += [rep[at][some], u]
            out_v += [np.full(len(some), -1), v]
            out_n += [links[some], np.zeros(len(u), np.int64)]
        other, count = np.concatenate(out_v), np.concatenate(out_n)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_u)), pa.array(other, mask=count > 0), pa.array(count)], names=["rep", "other", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            tags = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("table", "key", "low", "high")])
            cuts = [0, *(np.flatnonzero((tags[:, 1:] != tags[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                tag = tags[:, s].tolist()
                if tag != now and held:
                    yield solve(held)
                    held = []
                now = tag
                held.append(batch.slice(s, e - s))
        if held:
            yield solve(held)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector.

    Vectors with cosine >= ``threshold`` link; a pair exactly at the threshold is found with chance ``recall`` or
    more, nearer ones with higher chance, and no pair below it links. Vectors that are null, empty, zero or hold a
    null or non-finite component link with nothing, nor do vectors of different length. Rows that repeat an id with
    an equal vector are one vector; with different vectors they are vectors of their own. A null id links and counts like any other but names no component. An empty
    table gives an empty result; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).distinct()
    x = F.col("v")
    broken = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(math.inf)))
    good = x.isNotNull() & (F.size(x) > 0) & ~broken & F.exists(x, lambda e: e != 0)
    good = F.coalesce(good, F.lit(False))
    kind = dict(vectors.select(vec_col).dtypes)[vec_col]
    classes = rows.where(good).groupBy("v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("size")).withColumn("hash", F.xxhash64("v"))
    # a class is named by its vector, as an id may have several; vectors that share a hash are told apart by their order
    turn = F.row_number().over(Window.partitionBy("hash").orderBy("v"))
    classes = checkpointed(classes.withColumn("turn", turn).withColumn("rep", F.when(F.col("turn") == 1, F.col("hash")).otherwise(F.xxhash64("hash", "turn"))).drop("hash", "turn"))
    depth, tables = plan_tables(classes.count(), threshold, recall)
    points = checkpointed(classes.select("v", "rep", "size").mapInArrow(_keys(depth, tables), f"v {kind}, rep long, size long, keys array<long>"))
    light = points.select("rep", F.posexplode("keys").alias("table", "key")).withColumn("salt", F.pmod(F.xxhash64("rep", "table"), F.lit(8)).cast("int"))
    sizes = light.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    placed = light.join(sizes, ["table", "key", "salt"]).withColumn("parts", F.ceil(F.col("n") / tile).cast("int"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("rep", "key"), F.col("parts")).cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("rep", "table", "key", "part", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"))
    dealt = placed.join(points, "rep").repartition("table", "key", "low", "high").sortWithinPartitions("table", "key", "low", "high", "part", "rep")
    found = checkpointed(dealt.mapInArrow(_blocks(threshold, needed_collisions(COUNTED, WINDOW, recall)), "rep long, other long, links long"))
    counts = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    joined = connected_components(found.where("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v"))).withColumnRenamed("id", "rep")
    # a component is named by the smallest id in it
    named = classes.join(counts, "rep", "left").join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("least_id").alias("least"))
    named = named.join(least, "component").select("v", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.col("least").alias("component_id"))
    named = checkpointed(named)
    linked = rows.where(good).join(named, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
