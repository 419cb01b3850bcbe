"""Merkle manifest of a dataset that persists only every few levels and recomputes the rest when proofs are drawn.

Rows are leaves of a tree per source, three nodes to a parent; the sources' roots are the leaves of one more tree.
Stored are the leaves and each ``every``-th level (a 3 ** every-th of the nodes below it). An aligned subtree between
two stored levels is small (243 leaves) and belongs to one task: on the way up its interior nodes are hashed and
forgotten; proof extraction hashes them again from the stored nodes below, gives each of these its siblings, adds the
siblings from above, and forgets the interior once more. A source with a third of all rows is many such subtrees.

A path is one text: levels from the leaf up, separated by commas, each ``left|right`` with the digests of the run's
other nodes on either side of the own one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path
from .common import slices

RUN = 3
EVERY = 5
_NODES = "grp string, idx long, digest string, n long, done boolean"
_PATHS = "grp string, idx long, path string, subroot string, root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves: runs of three, the last one shorter, until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


def fold(leaf: str, path: str) -> str:
    """The root that a leaf and a path lead to."""
    for level in path.split(",") if path else ():
        left, right = level.split("|")
        leaf = digest(left + leaf + right)
    return leaf


def siblings(path: str) -> str:
    """The digests of a path, level by level and from left to right."""
    return path.replace("|", "").replace(",", "")


def leaf_hash(*values: Column) -> Column:
    """Hash of a row's values: ``-`` for null, else byte count, colon and value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]).cast("binary"), 256)


def group_key(source: Column) -> Column:
    """The source as a text without nulls that sorts null first and then by bytes."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))


class Level0:
    """Leaves in order, written once: a row's place follows from its row number in its file and the counts before."""

    def __init__(self, rows: DataFrame, order: list[str], path: str):
        """``rows``: grp, digest and further columns; ``order`` breaks no tie that a digest leaves."""
        spark = rows.sparkSession
        keys = ["grp", *order, "digest"]
        ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
        ordered.write.parquet(f"{path}/leaves")
        stored = spark.read.parquet(f"{path}/leaves").withColumn("_part", F.shiftright("_at", 33))
        counts = stored.groupBy("grp", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
        per_group = Window.partitionBy("grp")
        before = per_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        places = counts.select("grp", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(per_group).alias("n"))
        places.write.parquet(f"{path}/places")
        self.places = spark.read.parquet(f"{path}/places")
        self.rows = stored.join(self.places, ["grp", "_part"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")

    def tallest(self) -> int:
        return height(self.places.agg(F.max("n")).first()[0] or 1)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows sorted by (grp, block) -> one list for each subtree, at most 3 ** every nodes and one path row."""
    key, rows = None, []
    for batch in slices(batches):
        for row in batch.to_pylist():
            if (row["grp"], row["block"]) != key:
                if rows:
                    yield key, rows
                key, rows = (row["grp"], row["block"]), []
            rows.append(row)
    if rows:
        yield key, rows


def _raised(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a subtree, level by level, its lowest level first."""
    found = [nodes]
    for _ in range(levels):
        now = found[-1]
        found.append([digest("".join(now[i : i + RUN])) for i in range(0, len(now), RUN)])
    return found


def _own_path(levels: list[list[str]], at: int) -> str:
    """The part of a path that lies within the subtree, for its node ``at``."""
    parts = []
    for now in levels[:-1]:
        run = at - at % RUN
        parts.append("".join(now[run:at]) + "|" + "".join(now[at + 1 : run + RUN]))
        at //= RUN
    return ",".join(parts)


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[f for f, _ in fields])


def _grouped(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]], size: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, fields)
            held = []
    yield _batch(held, fields)


_S, _L, _B = pa.string(), pa.int64(), pa.bool_()


def _up(stage: int, every: int):
    """Nodes of a stored level -> the nodes of the next one; a group's last node comes out as ``done``."""

    def found(batches):
        for (grp, block), rows in _subtrees(batches):
            n = rows[0]["n"]
            left = height(n) - stage * every
            top = _raised([r["digest"] for r in rows], min(left, every))[-1]
            yield grp, block, top[0], n, left <= every

    fields = [("grp", _S), ("idx", _L), ("digest", _S), ("n", _L), ("done", _B)]
    return lambda batches: _grouped(found(batches), fields)


def _extracted(batches, stage: int, every: int) -> Iterator[tuple[dict, dict, str]]:
    """(node, the path row of its subtree, its whole path); the path row comes first in each subtree."""
    for _, rows in _subtrees(batches):
        above, nodes = rows[0], rows[1:]
        if above["path"] is None or not nodes:
            raise RuntimeError("a stored subtree and its path do not fit")
        levels = _raised([r["digest"] for r in nodes], min(height(nodes[0]["n"]) - stage * every, every))
        for at, node in enumerate(nodes):
            yield node, above, ",".join(p for p in (_own_path(levels, at), above["path"]) if p)


def _down(stage: int, every: int):
    """Stored nodes with the paths of the stored nodes above them -> their own paths."""
    fields = [("grp", _S), ("idx", _L), ("path", _S), ("subroot", _S), ("root", _S)]
    return lambda batches: _grouped(((v["grp"], v["idx"], path, a["subroot"], a["root"]) for v, a, path in _extracted(batches, stage, every)), fields)


def _proved(every: int):
    """Leaves with the paths above -> proofs, folded from the claimed leaf."""

    def found(batches):
        for leaf, above, path in _extracted(batches, 0, every):
            folded = fold(leaf["claim"], path)
            yield leaf["doc_id"], leaf["digest"], above["subroot"], above["root"], digest(siblings(path)), folded, folded == above["root"], path

    fields = [("doc_id", _L), ("leaf", _S), ("subroot", _S), ("root", _S), ("proof_sha256", _S), ("folded_root", _S), ("verified", _B), ("path", _S)]
    return lambda batches: _grouped(found(batches), fields)


def _block(every: int) -> Column:
    return F.floor(F.col("idx") / F.lit(RUN**every)).cast("long").alias("block")


class Tree:
    """A tree per group over ``Level0`` leaves: ``stored[k]`` holds level ``k * every``, ``roots`` one row a group."""

    def __init__(self, leaves: Level0, path: str, every: int):
        spark = leaves.places.sparkSession
        self.every, self.stored = every, [leaves.rows]
        roots = []
        for k in range(max(1, -(-leaves.tallest() // every))):
            feed = self.stored[k].select("grp", _block(every), "idx", "n", "digest").repartition("grp", "block").sortWithinPartitions("grp", "block", "idx")
            feed.mapInArrow(_up(k, every), _NODES).write.parquet(f"{path}/level-{(k + 1) * every}")
            level = spark.read.parquet(f"{path}/level-{(k + 1) * every}")
            roots.append(level.where("done").select("grp", "digest", "n", F.lit(k).alias("stage")))
            self.stored.append(level.where("not done").drop("done"))
        self.roots = roots[0]
        for more in roots[1:]:
            self.roots = self.roots.unionByName(more)

    def feed(self, k: int, nodes: DataFrame, above: DataFrame) -> DataFrame:
        """Each subtree's path row, then its nodes, together and in order."""
        nodes = nodes.withColumns({"block": _block(self.every), "path": F.lit(None).cast("string"), "subroot": F.lit(None).cast("string"), "root": F.lit(None).cast("string")})
        both = nodes.unionByName(above.withColumn("idx", F.lit(-1).cast("long")), allowMissingColumns=True)
        return both.repartition("grp", "block").sortWithinPartitions("grp", "block", "idx")

    def above(self, k: int, tops: DataFrame, paths: DataFrame | None) -> DataFrame:
        """(grp, block, path, subroot, root) of the subtrees of stage ``k``: from the stage above, or from the group's root."""
        ended = tops.where(F.col("stage") == k).select("grp", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
        return ended if paths is None else ended.unionByName(paths.withColumnRenamed("idx", "block"))

    def descend(self, tops: DataFrame, last: int) -> DataFrame | None:
        """Paths of the nodes stored at level ``last * every``, from the paths of the groups' roots (``tops``)."""
        paths = None
        for k in range(len(self.stored) - 2, last - 1, -1):
            nodes = self.stored[k].select("grp", "idx", "n", "digest")
            paths = self.feed(k, nodes, self.above(k, tops, paths)).mapInArrow(_down(k, self.every), _PATHS)
        return paths


def manifest_proofs(docs: DataFrame, tampered: Column | None = None, path: str | None = None, every: int = EVERY) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, path), one row per document row.

    Builds the manifest of ``docs`` (doc_id, source, lang, n_chars, text; other columns are not read) under ``path``
    (a fresh table in the shared folder if not given) and draws every row's proof from it. ``tampered`` is the text a
    holder presents; its leaf is folded along the row's proof, and ``verified`` says whether that leads to the root.

    Null is hashed as ``-``, which no value gives, so null and empty text differ. Null sources form a group of their
    own before all others. Leaves ascend by doc_id (null first), then by hash, so that rows with a repeated id have a
    defined place and a row repeated whole is as many leaves with equal hashes. A lone leaf is its own subroot and a
    lone source's subroot the root; the proof is then the hash of no text. An empty table has no rows and no root.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "manifest")
    kept = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    leaf = leaf_hash(*kept, text)
    claim = leaf if tampered is None else F.when(tampered.eqNullSafe(text), leaf).otherwise(leaf_hash(*kept, tampered))
    rows = docs.select(group_key(F.col("source")).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("digest"), claim.alias("claim"))
    tree = Tree(Level0(rows, ["doc_id"], f"{path}/rows"), f"{path}/rows", every)

    subroots = tree.roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest", "stage", F.col("digest").alias("subroot"))
    sources = Level0(subroots, ["name"], f"{path}/sources")
    top = Tree(sources, f"{path}/sources", every)
    root = top.roots.select("grp", "stage", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    over = top.descend(root, 0).select("idx", "path", "root")
    tops = sources.rows.select("idx", F.col("name").alias("grp"), "stage", "subroot").join(over, "idx").drop("idx")
    tops.write.parquet(f"{path}/subroots")  # small: a row for each source
    tops = spark.read.parquet(f"{path}/subroots")

    above = tree.above(0, tops, tree.descend(tops, 1))
    feed = tree.feed(0, tree.stored[0].select("grp", "idx", "n", "digest", "doc_id", "claim"), above)
    return feed.mapInArrow(_proved(every), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, path string")


def line_feeds_lost(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The tampering of the registered query: rows with an even crc32 of the decimal id lose their line feeds."""
    even = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))


def manifest_check(docs: DataFrame) -> DataFrame:
    """The registered query: every row's proof against a copy of the table that has lost line feeds."""
    return manifest_proofs(docs, line_feeds_lost()).drop("path")


#: crc32 is computed bit by bit; nodes by a recursion over levels; folding by reducing over a row's levels.
SQL = r"""
with recursive t as (
  select doc_id, source, text,
    case when doc_id is null then '-' else concat(strlen(doc_id::varchar), ':', doc_id) end || case when source is null then '-' else concat(strlen(source), ':', source) end
    || case when lang is null then '-' else concat(strlen(lang), ':', lang) end || case when n_chars is null then '-' else concat(strlen(n_chars::varchar), ':', n_chars) end as head,
    list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)) as crc
  from documents),
h as (
  select doc_id, source, sha256(head || case when text is null then '-' else concat(strlen(text), ':', text) end) as leaf,
    case when text is null then sha256(head || '-') when xor(crc, 4294967295) % 2 = 0 then sha256(head || concat(strlen(replace(text, chr(10), '')), ':', replace(text, chr(10), '')))
      else sha256(head || concat(strlen(text), ':', text)) end as claim
  from t),
d as (
  select *, case when source is null then '' else '=' || source end as g from h),
o as (
  select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n from d),
up as (
  select g, 0 as l, i, leaf as x, n from o
  union all
  select g, l + 1, i // 3, sha256(string_agg(x, '' order by i)), (any_value(n) + 2) // 3 from up where n > 1 group by g, l, i // 3),
s as (select g, x as subroot, row_number() over (order by g) - 1 as i, count(*) over () as n from up where n = 1),
top as (
  select 0 as l, i, subroot as x, n from s
  union all
  select l + 1, i // 3, sha256(string_agg(x, '' order by i)), (any_value(n) + 2) // 3 from top where n > 1 group by l, i // 3),
r as (select x as root from top where n = 1),
runs as (select g, l, i // 3 as p, list(x order by i) as xs from up where n > 1 group by g, l, i // 3),
trun as (select l, i // 3 as p, list(x order by i) as xs from top where n > 1 group by l, i // 3),
spath as (
  select s.g, list(array_to_string(xs[1:(s.i // power(3, l)::bigint) % 3], '') || '|' || array_to_string(xs[(s.i // power(3, l)::bigint) % 3 + 2:], '') order by l) as path
  from s join trun on trun.p = s.i // power(3, l + 1)::bigint group by s.g),
lpath as (
  select o.g, o.i, list(array_to_string(xs[1:(o.i // power(3, l)::bigint) % 3], '') || '|' || array_to_string(xs[(o.i // power(3, l)::bigint) % 3 + 2:], '') order by l) as path
  from o join runs on runs.g = o.g and runs.p = o.i // power(3, l + 1)::bigint group by o.g, o.i),
p as (
  select o.doc_id, o.leaf, o.claim, s.subroot, r.root, list_concat(coalesce(lpath.path, []), coalesce(spath.path, [])) as path
  from o join s on s.g = o.g cross join r left join lpath on lpath.g = o.g and lpath.i = o.i left join spath on spath.g = o.g),
f as (
  select *, sha256(replace(array_to_string(path, ''), '|', '')) as proof_sha256,
    list_reduce(list_prepend(claim, path), lambda a, b: sha256(split_part(b, '|', 1) || a || split_part(b, '|', 2))) as folded_root
  from p)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from f
"""
