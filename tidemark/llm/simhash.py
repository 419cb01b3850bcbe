"""SimHash near-deduplication with pigeonring filtering.

A 64-bit fingerprint is cut into five segments that form a ring. Two fingerprints that differ in at most four
bits have a start segment from which every chain of l consecutive segments differs in at most l * 4 / 5 bits
(0, 1, 2, 3 and 4). The first two links of that chain are an equi join: each distinct fingerprint is stored
under its segment pairs and looked up under the pairs with at most one bit changed in the second segment. The
longer chains are checked on what meets, then the whole distance; a pair counts only at the first start at
which it passes, so no pair is found twice. Equal fingerprints are one class before any of this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import slices
from .components import connected_components, spanning_links
from .exact_dedup import row_key

#: Bits of each segment (low bits first) and the budget of a chain of 1..5 segments for a distance of 4.
WIDTHS = (13, 13, 13, 13, 12)
LOW = tuple(sum(WIDTHS[:i]) for i in range(len(WIDTHS)))
BUDGET = tuple(n * 4 // len(WIDTHS) for n in range(1, len(WIDTHS) + 1))
SEED = 42
SHINGLE = 4
#: ASCII letters lowered, and the six white-space bytes as one.
_SPACES = bytes(range(9, 14)) + b" "
_TABLE = bytes(32 if b in _SPACES else b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of one whole text; 0 when it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, 65536):  # memory stays bounded for very long texts
        s, e = starts[at : min(n, at + 65536)].tolist(), ends[np.minimum(np.arange(at, min(n, at + 65536)) + shingle - 1, len(words) - 1)].tolist()
        h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(s, e)), np.uint64, len(s))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(ones * 2 > n).tolist())


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp long): the fingerprint's 64 bits as a signed long; the hash tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = np.array([fingerprint_of(t) for t in part.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _segment(fp: Column, i: int) -> Column:
    i %= len(WIDTHS)
    return F.shiftrightunsigned(fp, LOW[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1))


def _key(start: int, first: Column, second: Column) -> Column:
    return F.lit(start << 26).bitwiseOR(F.shiftleft(first, 13)).bitwiseOR(second)


def _chain_holds(diff: list[Column], start: int) -> Column:
    total, holds = None, None
    for n in range(len(WIDTHS)):
        d = diff[(start + n) % len(WIDTHS)]
        total = d if total is None else total + d
        ok = total <= BUDGET[n]
        holds = ok if holds is None else holds & ok
    return holds


def near_pairs(fps: DataFrame) -> DataFrame:
    """(u, v), u < v: all pairs of distinct fingerprints of ``fps`` (column fp) at four differing bits or fewer."""
    fp = F.col("fp")
    stored = F.array(*[_key(i, _segment(fp, i), _segment(fp, i + 1)) for i in range(len(WIDTHS))])
    probes = F.array(
        *[
            _key(i, _segment(fp, i), _segment(fp, i + 1).bitwiseXOR(F.lit(flip)))
            for i in range(len(WIDTHS))
            for flip in [0, *[1 << b for b in range(WIDTHS[(i + 1) % len(WIDTHS)])]]
        ]
    )
    a = fps.select(F.col("fp").alias("u"), F.explode(probes).alias("key"))
    b = fps.select(F.col("fp").alias("v"), F.explode(stored).alias("key"))
    start = F.shiftright(a["key"], 26)
    x = F.col("u").bitwiseXOR(F.col("v"))
    diff = [F.bit_count(_segment(x, i)) for i in range(len(WIDTHS))]
    passes = [_chain_holds(diff, i) for i in range(len(WIDTHS))]
    first = F.lit(len(WIDTHS))
    for i in reversed(range(len(WIDTHS))):
        first = F.when(passes[i], F.lit(i)).otherwise(first)
    return a.join(b, (a["key"] == b["key"]) & (F.col("u") < F.col("v")) & (F.bit_count(x) <= BUDGET[-1]) & (first == start)).select("u", "v")


def components_of(prints: DataFrame) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint: the smallest doc_id reachable; null only if no id is there."""
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = spanning_links(near_pairs(classes.select("fp")))
    joined = connected_components(links).select(F.col("id").alias("fp"), F.col("component"))
    # components are named by a fingerprint so far; the smallest document of all their classes names them now
    named = classes.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return checkpointed(named.select("fp", "component").join(names, "component").select("fp", "component", "component_id"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    Null and word-less texts have fingerprint zero and link like any other. ``component_id`` is the smallest id
    reachable over links of at most four differing bits, itself included. A null id keeps its row; it links
    others but names a component only if no id is there. Rows that repeat an id have one row each. An empty
    table gives an empty result; other columns are not read.
    """
    prints = checkpointed(with_fingerprints(docs, id_col, text_col))
    return prints.join(components_of(prints), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each near-duplicate component: the smallest id (null ids
    last, then the text's hash). A row repeated whole stays once."""
    prints = checkpointed(with_fingerprints(docs, id_col, text_col))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    first = prints.join(components_of(prints), "fp").groupBy("component").agg(F.min(rank).alias("w"))
    kept = first.select(row_key(F.col("w.doc_id"), F.col("w.text_hash")).alias("_key"))
    rows = docs.withColumn("_key", row_key(F.col(id_col).cast("long"), F.xxhash64(text_col)))
    return rows.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)
