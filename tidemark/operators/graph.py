"""Bounded traversals of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def reach(edges: DataFrame, start, depth: int = 3, src: str = "src", dst: str = "dst") -> DataFrame:
    """Nodes reached from ``start`` over undirected edges with their least distance (1..depth).

    Depths outside 1..10 fall back to 3. Each level joins the frontier to the edges, keeps
    distinct new nodes and drops those already met: one pass over the edges per level, never all paths.
    """
    depth = depth if isinstance(depth, int) and 1 <= depth <= 10 else 3
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).union(edges.select(F.col(dst), F.col(src)))
    seen = both.sparkSession.range(1).select(F.lit(start).cast(edges.schema[src].dataType).alias("node"), F.lit(0).alias("distance"))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(both, frontier["node"] == both["a"]).select(F.col("b").alias("node")).distinct()
        step = checkpointed(step.join(seen, "node", "left_anti").withColumn("distance", F.lit(d)))
        seen = seen.union(step)
        frontier = step
    return seen.where("distance > 0")


def lineage_roots(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id", max_depth: int = 1 << 20) -> DataFrame:
    """Root and depth of every node by pointer doubling: log2(longest chain) self-joins.

    A parent that is not a node ends the chain, as a missing row would. Raises after ``max_depth``.
    """
    ids = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("p"))
    known = ids.select(F.col("id").alias("p"))
    live = ids.join(known, "p", "left_semi").select("id", F.col("p").alias("up"), F.lit(1).cast("long").alias("hops"))
    roots = ids.join(known.withColumn("_k", F.lit(1)), "p", "left").where("_k is null").select("id", F.col("id").alias("up"), F.lit(0).cast("long").alias("hops"))
    cur = checkpointed(live.union(roots))
    jumped = 1
    while jumped <= max_depth:
        nxt = cur.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("h2"))
        cur = checkpointed(cur.join(nxt, "up").select("id", F.col("up2").alias("up"), (F.col("hops") + F.col("h2")).alias("hops"), (F.col("h2") > 0).alias("_moved")))
        moved = cur.where("_moved").limit(1).count()
        cur = cur.drop("_moved")
        if not moved:
            return cur.select("id", F.col("up").alias("root"), F.col("hops").alias("depth"))
        jumped *= 2
    raise ValueError("lineage deeper than max_depth or cyclic")


def lineage_of(nodes: DataFrame, start, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """Chain from one node up to its root, however long: (id, depth).

    The known part of the chain doubles with every join: round k adds the ancestors 2^k steps above it. A parent
    that is not a node ends the chain. Raises on a cycle, where an ancestor comes back at a second depth.
    """
    tab = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("p"))
    ids = tab.select(F.col("id").alias("p"))
    up = checkpointed(tab.join(ids, "p", "left_semi").select("id", F.col("p").alias("up")))
    out, jump = checkpointed(tab.where(F.col("id") == start).select("id", F.lit(0).cast("long").alias("depth"))), 1
    while True:
        above = checkpointed(out.join(up, "id").select(F.col("up").alias("id"), (F.col("depth") + jump).alias("depth")))
        if above.isEmpty():
            return out.select("id", F.col("depth").cast("int").alias("depth"))
        out = checkpointed(out.union(above))
        if out.groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError("the lineage is cyclic")
        nxt = up.select(F.col("id").alias("up"), F.col("up").alias("up2"))
        up, jump = checkpointed(up.join(nxt, "up").select("id", F.col("up2").alias("up"))), jump * 2
