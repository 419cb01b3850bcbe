"""Secrets by linking the parts of a credential.

A text is searched once for strong spans, which are reported as they are, and for weak parts, which look like a piece
of a credential but as often are not:

* ``id``        a field that names an account, client or user and its value,
* ``opaque``    a random-looking token, or a short password field's value,
* ``endpoint``  a URL, or a host with a port.

Parts are intervals of code points within a scope: a paragraph, or a section of a configuration. Two parts of a scope
are linked when the gap between them is at most ``reach``. A weak part is reported only if its complement is linked to
it: an ``opaque`` needs an identifier or an endpoint, an ``id`` needs a secret, an ``endpoint`` needs both.

The links are an interval join: each part is copied to the stretches of text that it or its reach touches, and parts
that share a (text, stretch) meet there. A stretch holds a bounded number of parts, as the parts of a kind do not overlap, so
neither a text of millions of parts nor a long scope makes a large group.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, slices, whole

#: Order of kinds: the strong ones, then the weak ones.
KINDS = ("assign", "access", "hex", "id", "opaque", "endpoint")
WEAK = KINDS[3:]
REACH = 240
#: Code points of a stretch.
STRETCH = 512
SALTS = 32

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ID = re.compile(r"""(?<![A-Za-z0-9])(?:(?:client|app|application|account|user|tenant|project|access_?key)[_-]?(?:id|name)|username|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{3,64})""", re.IGNORECASE | re.ASCII)
PASS = re.compile(r"""(?<![A-Za-z0-9])(?:pwd|pass|passphrase|credentials?|private_?key|auth)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=@!#$%^&*-]{6,})""", re.IGNORECASE | re.ASCII)
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s\"'<>()]{4,}|(?<![A-Za-z0-9.@-])(?:[a-z0-9-]{1,63}\.){1,8}[a-z]{2,24}:[0-9]{2,5}(?![0-9])", re.ASCII)
#: A blank line, a section heading in brackets, or a rule ends a scope.
BORDER = re.compile(r"\n[\x20\t\r]*\n|\n\[[^\]\n]{1,80}\][\x20\t\r]*(?=\n)|\n(?:---|===|```|\*\*\*)")


def random_looking(token: str) -> bool:
    """Small letters, capitals and digits mixed without a long stretch of one class, and few repeated characters."""
    if not (any(c.islower() for c in token) and any(c.isupper() for c in token) and sum(c.isdigit() for c in token) >= 2):
        return False
    n = len(token)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(token).values())
    return entropy >= min(3.5, 0.8 * math.log2(n)) and max(map(len, re.findall(r"[a-z]+|[A-Z]+|[0-9]+", token))) <= max(6, n // 3)


def strong_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the spans that are reported without a link."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def weak_spans(text: str, strong: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The weak parts that no strong span overlaps."""
    found = [(m.start(), 3, m.end()) for m in ID.finditer(text)]
    values = [(m.start(1), m.end(1)) for m in PASS.finditer(text)]
    values += [(m.start(), m.end()) for m in OPAQUE.finditer(text) if random_looking(m[0])]
    found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    end = -1
    for start, stop in sorted(values, key=lambda v: (v[0], -v[1])):  # an opaque value once
        if start >= end:
            found.append((start, 4, stop))
            end = stop
    clear, at, reached = [], 0, 0
    for span in sorted(found):
        while at < len(strong) and strong[at][0] < span[2]:
            reached = max(reached, strong[at][2])
            at += 1
        # strong spans that begin before this one's end; the last end among them decides
        if reached <= span[0]:
            clear.append(span)
    return clear


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("scope", pa.int64())]))
    for batch in slices(batches, 64):
        keys, parts = [], []
        for text in batch.column("text").to_pylist():
            strong = strong_spans(text)
            spans = sorted(strong + weak_spans(text, strong))
            borders = [m.start() for m in BORDER.finditer(text)] if spans else []
            scope, row = 0, []
            for start, k, end in spans:
                while scope < len(borders) and borders[scope] < start:
                    scope += 1
                row.append({"start": start, "kind": k, "end": end, "scope": scope})
            keys.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() if any(p["kind"] >= 3 for p in row) else None)
            parts.append(row)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.string()), pa.array(parts, kind)], names=["doc_id", "text_key", "parts"])


def linked_weak_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """(text_key, start, kind, end) of the weak parts whose complement is linked, from (text_key, scope, start, kind, end).

    A role is a bit: 1 identifier, 2 secret, 4 endpoint.
    """
    k = F.col("kind")
    role = F.when(k.isin(1, 3), 1).when(k == 5, 4).otherwise(2)
    here = parts.withColumn("role", role)
    stretches = F.explode(F.sequence(F.floor((F.col("start") - reach) / STRETCH), F.floor((F.col("end") + reach) / STRETCH)))
    asked = here.where(k >= 3).withColumn("at", stretches)
    others = here.withColumn("at", F.explode(F.sequence(F.floor(F.col("start") / STRETCH), F.floor((F.col("end") - 1) / STRETCH))))
    near = others.select("text_key", "scope", "at", *[F.col(c).alias(f"o_{c}") for c in ("start", "kind", "end", "role")])
    met = asked.join(near, ["text_key", "scope", "at"]).where(
        (F.col("o_start") - F.col("end") <= reach) & (F.col("start") - F.col("o_end") <= reach) & (F.col("o_role") != F.col("role")) & ((F.col("o_end") <= F.col("start")) | (F.col("o_start") >= F.col("end")))
    )
    found = met.groupBy("text_key", "start", "kind", "end").agg(F.bit_or("o_role").alias("roles"))
    enough = F.when(k == 4, F.col("roles").bitwiseAND(5) != 0).when(k == 3, F.col("roles").bitwiseAND(2) != 0).otherwise(F.col("roles").bitwiseAND(3) == 3)
    return found.where(enough).drop("roles")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(doc_id, spans) with spans an array of (start, kind, end), sorted; kind is a place in ``KINDS``.

    One row per input row. Null text is empty text and has no spans; a null or repeated id changes nothing, as texts
    are joined by their hash. Positions are code points, ends exclusive. Texts are read whole and may be of any length.
    Other columns are not read. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"))
    schema = "doc_id long, text_key string, parts array<struct<start:long,kind:int,end:long,scope:long>>"
    searched = checkpointed(texts.mapInArrow(_parts, schema))
    single = searched.where("text_key is not null").dropDuplicates(["text_key"])  # equal texts have equal parts
    parts = single.select("text_key", F.inline("parts"))
    linked = linked_weak_parts(parts, reach)
    per_text = linked.groupBy("text_key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("weak"))
    strong = F.transform(F.filter("parts", lambda p: p["kind"] < 3), lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))
    # copies of a text, and the texts without weak parts, are spread over the tasks of the join
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    alone = F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string"))
    spread = searched.withColumn("_key", F.when(F.col("text_key").isNull(), alone).otherwise(F.concat_ws(":", "text_key", salt)))
    copies = per_text.select(F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), "text_key", "weak").select(F.concat_ws(":", "text_key", "_salt").alias("_key"), "weak")
    joined = spread.join(copies, "_key", "left")
    return joined.select("doc_id", F.sort_array(F.concat(strong, F.coalesce("weak", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))).alias("spans"))


def _listed(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """The registered query: counts and a hash of the strong spans, and all spans, one row per document."""
    found = secret_spans(docs)
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def count(k: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
