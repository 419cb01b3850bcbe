"""Queries for history, similarity and text (TXT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as cp
from .registry import TICKS, query, rnd, rounded

_COS = "list_sum(list_transform(list_zip(e.embedding, t.v), lambda x: CAST(x[1] AS DOUBLE) * x[2])) / (sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(t.v, lambda x: CAST(x AS DOUBLE) * x))))"
SIM = f"t AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7), sm AS (SELECT e.vec_id, e.label, {_COS} AS similarity FROM embeddings e, t WHERE e.embedding IS NOT NULL)"


def _target(t):
    return t.embeddings.where("vec_id = 7").select("embedding").scalar()


@query("txt_01_similar", f"WITH {SIM} SELECT vec_id, {rnd('similarity')} AS similarity FROM sm WHERE similarity >= 0.3 AND vec_id <> 7")
def _(t):
    return cp.similar(t.embeddings.where("vec_id <> 7"), _target(t), "embedding").select("vec_id", rounded("similarity").alias("similarity"))


@query("txt_01_cosine_top_k", f"WITH {SIM} SELECT vec_id, {rnd('similarity')} AS similarity FROM sm WHERE vec_id <> 7 ORDER BY sm.similarity DESC, vec_id LIMIT 10")
def _(t):
    out = cp.similar(t.embeddings.where("vec_id <> 7"), _target(t), "embedding", min_similarity=-1.0)
    return out.orderBy(F.desc("similarity"), "vec_id").limit(10).select("vec_id", rounded("similarity").alias("similarity"))


@query(
    "txt_02_hybrid_search",
    f"WITH {SIM} SELECT vec_id, {rnd('similarity * 0.7 + coalesce(quality * 10, 0) / 10 * 0.3')} AS combined_score FROM sm LEFT JOIN labels ON doc_id = vec_id WHERE similarity >= 0.1 ORDER BY similarity * 0.7 + coalesce(quality * 10, 0) / 10 * 0.3 DESC, vec_id LIMIT 20",
)
def _(t):
    src = t.embeddings.join(t.labels, F.col("doc_id") == F.col("vec_id"), "left")
    return cp.search(src, _target(t), "embedding", F.col("quality") * 10.0, "vec_id", 20, 0.1).select("vec_id", rounded("combined_score").alias("combined_score"))


@query(
    "txt_02_rerank",
    f"WITH {SIM} SELECT vec_id, {rnd('similarity')} AS similarity, {rnd('similarity * 0.7 + coalesce(quality * 10, 5) / 10 * 0.3')} AS combined_score FROM sm LEFT JOIN labels ON doc_id = vec_id",
)
def _(t):
    src = t.embeddings.join(t.labels, F.col("doc_id") == F.col("vec_id"), "left")
    return cp.rerank(src, _target(t), "embedding", F.col("quality") * 10.0).select("vec_id", rounded("similarity").alias("similarity"), rounded("combined_score").alias("combined_score"))


@query(
    "txt_03_event_dedup",
    """WITH c AS (SELECT event_id, sha256(event_type || ':' || user_id || ':' || json(props)) AS checksum FROM events) SELECT checksum, min(event_id) AS event_id FROM c GROUP BY 1""",
)
def _(t):
    e = t.events.select("event_id", "event_type", "user_id", "props")
    return cp.dedup_events(e, "event_type", "user_id", "props", ["event_id"]).select("checksum", "event_id")


@query("txt_03_document_dedup", "SELECT sha256(lang || ':' || text) AS checksum, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def _(t):
    key = F.sha2(F.concat_ws(":", "lang", "text"), 256).alias("checksum")
    return t.documents.groupBy(key).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def _queue(t):
    return t.events.select("event_id", (F.col("event_type") == "purchase").alias("processed"), (F.col("user_id") % 5).alias("retry_count"))


@query("txt_04_retry_batch", "SELECT event_id, user_id % 5 AS retry_count FROM events WHERE event_type <> 'purchase' AND user_id % 5 < 3")
def _(t):
    return cp.route_retries(_queue(t))[0].select("event_id", "retry_count")


@query("txt_04_dead_letters", "SELECT event_id, user_id % 5 AS retry_count FROM events WHERE event_type <> 'purchase' AND user_id % 5 >= 3")
def _(t):
    return cp.route_retries(_queue(t))[1].select("event_id", "retry_count")


@query("txt_05_entity_history", "SELECT event_id, event_type, value FROM events WHERE user_id = 17 ORDER BY event_id")
def _(t):
    return cp.entity_history(t.events, "user_id", 17, "event_id").select("event_id", "event_type", "value")


@query("txt_05_conversation_history", "SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations WHERE conv_id = 3 ORDER BY turn")
def _(t):
    return cp.entity_history(t.conversations, "conv_id", 3, "turn").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


def _log(t):
    kv = F.create_map(F.lit("k"), F.col("volume").cast("long").cast("string"), F.col("symbol"), F.col("price").cast("decimal(12,2)").cast("string"))
    kind = F.when(F.col("symbol") == "signup", "entity_created").otherwise(F.concat(F.lit("entity_"), "symbol"))
    return t.ticks.select("event_id", "ts", F.col("trader").alias("entity_id"), kind.alias("event_type"), kv.alias("data"))


KV = """lg AS (SELECT event_id, ts, us, trader AS entity_id, CASE WHEN symbol = 'signup' THEN 'entity_created' ELSE 'entity_' || symbol END AS event_type, volume, symbol, price FROM ticks WHERE ts <= '2024-01-20'),
 kv AS (SELECT entity_id, event_id, 'k' AS key, CAST(CAST(volume AS BIGINT) AS VARCHAR) AS value FROM lg UNION ALL SELECT entity_id, event_id, symbol, CAST(CAST(price AS DECIMAL(12, 2)) AS VARCHAR) FROM lg)"""


def _at():
    return F.lit("2024-01-20").cast("timestamp")


@query("txt_06_state_as_of", f"WITH {TICKS}, {KV} SELECT entity_id, key, arg_max(value, event_id) AS value FROM kv GROUP BY 1, 2")
def _(t):
    return cp.state_as_of(_log(t), "entity_id", "event_id", "ts", "event_type", "data", _at())[0]


@query(
    "txt_06_state_header",
    f"""WITH {TICKS}, {KV} SELECT entity_id, arg_max(us, event_id) FILTER (event_type LIKE '%_created') AS created_us, arg_max(us, event_id) AS modified_us, arg_max(event_type, event_id) AS last_event FROM lg GROUP BY 1""",
)
def _(t):
    head = cp.state_as_of(_log(t), "entity_id", "event_id", "ts", "event_type", "data", _at())[1]
    return head.select("entity_id", F.unix_micros("created_at").alias("created_us"), F.unix_micros("last_modified").alias("modified_us"), "last_event")


@query(
    "txt_07_version_diff",
    f"""WITH {TICKS}, {KV}, a AS (SELECT entity_id, key, arg_max(value, event_id) AS v FROM kv WHERE event_id < 2000 GROUP BY 1, 2), b AS (SELECT entity_id, key, arg_max(value, event_id) AS v FROM kv WHERE event_id >= 2000 GROUP BY 1, 2)
 SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, coalesce(a.key, b.key) AS key, a.v AS old, b.v AS new, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change
 FROM a FULL JOIN b ON a.entity_id = b.entity_id AND a.key = b.key WHERE a.v IS DISTINCT FROM b.v""",
)
def _(t):
    log = _log(t).where(F.col("ts") <= _at())
    old = cp.state_as_of(log.where("event_id < 2000"), "entity_id", "event_id", "ts", "event_type", "data")[0]
    new = cp.state_as_of(log.where("event_id >= 2000"), "entity_id", "event_id", "ts", "event_type", "data")[0]
    return cp.version_diff(old, new, ["entity_id"]).select("entity_id", "key", "old", "new", "change")


@query(
    "txt_08_find_duplicates",
    """SELECT p_partkey, CASE WHEN 'A' || p_partkey = 'A12' OR 'paper-A' || p_partkey || '-v1' LIKE '%A12%' THEN 'arxiv_id' WHEN p_brand = 'Brand#12' THEN 'doi' WHEN p_name ILIKE '%red widget%' THEN 'title' END AS match_type
 FROM part WHERE match_type IS NOT NULL""",
)
def _(t):
    p = t.part.select("p_partkey", F.concat(F.lit("A"), "p_partkey").alias("arxiv_id"), F.concat(F.lit("paper-A"), "p_partkey", F.lit("-v1")).alias("paper_id"), F.col("p_brand").alias("doi"), F.col("p_name").alias("title"))
    return cp.find_duplicates(p, "A12", "Brand#12", "red widget").select("p_partkey", "match_type")


def _cls(expr_a, expr_b):
    return "CASE " + " ".join(f"WHEN regexp_matches({expr_a}, '{cp.class_pattern(n)}') OR regexp_matches({expr_b}, '{cp.class_pattern(n)}') THEN '{n}'" for n in cp.FORMULA_CLASSES) + " END"


_DOM = "CASE " + " ".join(f"WHEN known_type IN ({', '.join(repr(x) for x in ts)}) THEN '{d}'" for d, ts in cp.FORMULA_DOMAINS.items()) + " ELSE 'general' END"


@query(
    "txt_09_formula_extraction",
    rf"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE contains(text, '$')), i AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS n FROM l),
 c AS (SELECT doc_id, n, ls[n] AS line, array_to_string(ls[greatest(1, n - 1):n + 2], ' ') AS ctx FROM i WHERE contains(ls[n], '$')),
 f AS (SELECT doc_id, n, ctx, true AS display_mode, unnest(regexp_extract_all(line, '\$\$(.+?)\$\$', 1)) AS x FROM c
   UNION ALL SELECT doc_id, n, ctx, false, unnest(regexp_extract_all(regexp_replace(line, '\$\$+', chr(1), 'g'), '\$([^$\x01]+)\$', 1)) FROM c),
 g AS (SELECT doc_id, n, ctx, display_mode, regexp_replace(x, '^\s+|\s+$', '', 'g') AS latex FROM f), k AS (SELECT *, {_cls('latex', 'ctx')} AS known_type FROM g WHERE length(latex) > 3)
 SELECT doc_id, CAST(n AS INT) AS line_number, display_mode, latex, known_type, {_DOM} AS domain, substr(ctx, 1, 200) AS context FROM k""",
)
def _(t):
    return cp.extract_formulas(t.documents, "doc_id", "text")


@query(
    "txt_10_embedding_text",
    "SELECT p_partkey, concat_ws(' ', p_name, p_type, 'methodology: ' || p_brand) AS text FROM part",
)
def _(t):
    return t.part.select("p_partkey", cp.embedding_text(F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("text"))


