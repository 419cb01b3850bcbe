"""Connected components of a link table by alternating star contraction.

Every partition first reduces its links to a spanning forest (union-find over what the partition holds), so
that dense groups shrink to one link per node before anything is shuffled. Then large-star and small-star
steps alternate until no link changes. A node's neighbours are never gathered: the smallest neighbour is an
aggregate, and it is joined back over salted keys, so that a hub is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

SALTS = 16


class Forest:
    """Union-find over int64 ids whose roots are the smallest ids."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (nxt := up.get(top, top)) != top:
            top = nxt
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def link(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            lo, hi = (ra, rb) if ra < rb else (rb, ra)
            self.up[hi] = lo

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        nodes = np.fromiter(self.up, dtype=np.int64, count=len(self.up))
        return nodes, np.fromiter((self.root(int(x)) for x in nodes), dtype=np.int64, count=len(nodes))


def forest_of_batches(batches: Iterable[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Spanning links (u > v) of the links in the batches; gives out what it has after ``most`` nodes and starts anew."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.link(a, b)
        if len(forest.up) > most:
            yield _batch(forest)
            forest = Forest()
    yield _batch(forest)


def _batch(forest: Forest) -> pa.RecordBatch:
    u, v = forest.links()
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def spanning_links(links: DataFrame) -> DataFrame:
    """The links (u, v) of each partition reduced to a forest with the same components; no shuffle."""
    return links.select("u", "v").mapInArrow(forest_of_batches, "u long, v long")


def _with_least(links: DataFrame) -> DataFrame:
    """Both directions of every link with the smallest id among a node's neighbours and itself as ``m``."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    spread = least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return both.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(spread, ["u", "s"])


def connected_components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Component (smallest id reachable) of every id in the link table (u, v).

    Ids without a link to another id are not returned. Nulls and self links are ignored; repeated links and
    either direction are fine; an empty table gives an empty result. Raises if ``max_rounds`` do not settle it
    (the rounds needed grow with the logarithm of the largest component).
    """
    clean = links.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).select(F.col("u").cast("long"), F.col("v").cast("long"))
    now = checkpointed(spanning_links(clean).distinct())
    before = None
    for _ in range(max_rounds):
        large = _with_least(now).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
        small = down.groupBy("u").agg(F.min("v").alias("m"))
        # small-star: all smaller neighbours and the node itself hang below the smallest neighbour
        spread = small.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = down.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(spread, ["u", "s"])
        star = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        now = checkpointed(star)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (seen["n"], seen["h"]):
            members = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return members.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
        before = (seen["n"], seen["h"])
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
