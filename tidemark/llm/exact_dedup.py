"""Exact deduplication by skew-safe combining.

Copies are merged three times, always by digest *and* full normalised text, so that equal digests of different
texts never merge:

1. inside each input task: a copy of a text that the task has met travels on without its text, to the place of
   the text's first row there;
2. within a salted digest group: rows sorted by digest stream through a task, which holds one text at a time
   (more only if digests collide) and gives one winner per distinct text, with its smallest id and its count;
3. over the salt winners of a digest, at most ``salts`` for each text.

A text that a third of all rows share is spread over the salts, and its copies leave the first task without
text. Each row's text is shuffled once, each salt winner's once more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, slices, whole

SALTS = 64
#: Texts that a task remembers in step 1, in bytes; when full it starts anew, which only merges less there.
REMEMBER = 24 << 20


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(whole(text), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _rows(fields: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=fields)


_LOCAL = (["doc_id", "digest", "content", "leader", "variant"], [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32()])
_SALTED = (["doc_id", "digest", "salt", "variant", "content", "least", "n"], [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()])
_GLOBAL = (["digest", "salt", "variant", "keep_id", "group_size", "text"], [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, content) in; leader is the id of the text's first row in this task, a copy's content is null."""
    met: dict[str, list[tuple[str, int | None]]] = {}
    held = 0
    for batch in slices(batches):
        out = []
        for doc_id, digest, content in zip(*[c.to_pylist() for c in batch.columns]):
            texts = met.setdefault(digest, [])
            at = next((k for k, (text, _) in enumerate(texts) if text == content), None)
            if at is None:
                at = len(texts)
                texts.append((content, doc_id))
                held += len(content) + 200
                out.append((doc_id, digest, content, doc_id, at))
            else:
                out.append((doc_id, digest, None, texts[at][1], at))
        if held > REMEMBER:
            met, held = {}, 0
        yield _rows(*_LOCAL, out)


def _salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (digest, salt, leader, local variant, copies last): one member row each, without text, and one
    winner row (text, smallest id, count) for each distinct text of a salted digest."""
    now, texts, leader, at = None, [], None, 0

    def winners() -> list[tuple]:
        return [(None, *now, k, content, least, n) for k, (content, least, n) in enumerate(texts)]

    for batch in slices(batches):
        out = []
        for doc_id, digest, salt, content, lead, local in zip(*[c.to_pylist() for c in batch.columns]):
            if (digest, salt) != now:
                out += winners()
                now, texts, leader = (digest, salt), [], None
            if content is not None:
                at = next((k for k, t in enumerate(texts) if t[0] == content), len(texts))
                if at == len(texts):
                    texts.append([content, doc_id, 0])
                leader = (lead, local)
            elif leader != (lead, local):
                raise RuntimeError("a copy came without its text")
            best = texts[at]
            best[1] = doc_id if best[1] is None else best[1] if doc_id is None else min(best[1], doc_id)
            best[2] += 1
            out.append((doc_id, digest, salt, at, None, None, None))
        yield _rows(*_SALTED, out)
    yield _rows(*_SALTED, winners())


def _global(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Salt winners sorted by digest: the smallest id and the count of each distinct text, for each of its winners."""
    now, texts, rows = None, [], []

    def combined() -> list[tuple]:
        found = []
        for salt, variant, k in rows:
            _, least, n = texts[k]
            found.append((now, salt, variant, least, n, k))
        return found

    for batch in slices(batches):
        out = []
        for digest, salt, variant, content, least, n in zip(*[c.to_pylist() for c in batch.columns]):
            if digest != now:
                out += combined()
                now, texts, rows = digest, [], []
            at = next((k for k, t in enumerate(texts) if t[0] == content), len(texts))
            if at == len(texts):
                texts.append([content, least, 0])
            best = texts[at]
            best[1] = least if best[1] is None else best[1] if least is None else min(best[1], least)
            best[2] += n
            rows.append((salt, variant, at))
        yield _rows(*_GLOBAL, out)
    yield _rows(*_GLOBAL, combined())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document, dropped ones too.

    Of equal normalised texts the row with the smallest id stays. Null text is empty text and takes part.
    Rows that repeat an id with an equal text are one document (one result row); ``group_size`` counts rows.
    A null id ranks behind all others. One id with two different texts gives two rows. Only the two named
    columns are read, so further columns may have any name. An empty table gives an empty result.
    ``text_sha256`` is the digest itself; another ``digest`` (tests use weak ones) changes only that column.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("content"))
    local = rows.select("doc_id", digest(F.col("content")).alias("digest"), "content").mapInArrow(_local, "doc_id long, digest string, content string, leader long, variant int")
    dealt = local.withColumn("salt", F.pmod(F.xxhash64("leader"), F.lit(salts)).cast("int")).repartition("digest", "salt")
    dealt = dealt.sortWithinPartitions("digest", "salt", "leader", "variant", F.col("content").isNull(), "doc_id")
    salted = dealt.select("doc_id", "digest", "salt", "content", "leader", "variant").mapInArrow(_salted, "doc_id long, digest string, salt int, variant int, content string, least long, n long")
    winners = salted.where("n is not null").select("digest", "salt", "variant", "content", "least", "n").repartition("digest").sortWithinPartitions("digest", "salt", "variant")
    groups = winners.mapInArrow(_global, "digest string, salt int, variant int, keep_id long, group_size long, text int")
    members = salted.where("n is null").select("doc_id", "digest", "salt", "variant").distinct()
    return members.join(groups, ["digest", "salt", "variant"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"), F.col("text").alias("_text")
    ).dropDuplicates(["doc_id", "text_sha256", "_text"]).drop("_text")


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_dedup`` keeps; a row repeated whole stays once."""
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("_key"))
    rows = docs.withColumn("_key", row_key(F.col(id_col).cast("long"), sha256(normalised(F.col(text_col)))))
    return rows.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)


def row_key(doc_id: Column, text_hash: Column) -> Column:
    """One text for an id (null included) and a text's hash: join and duplicate removal share its partitioning."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(" "), text_hash.cast("string"))


SQL = r"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as content
  from documents),
g as (select content, min(doc_id) as keep_id, count(*) as group_size from d group by content)
select distinct d.doc_id, g.keep_id, cast(g.group_size as bigint) as group_size, d.doc_id is not distinct from g.keep_id as kept, d.text_sha256
from d join g using (content)
"""
