"""Event-sourced history, similarity search and text extraction over a research corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def similar(df: DataFrame, target: Column, vec: str, min_similarity: float = 0.3, name: str = "similarity") -> DataFrame:
    """Rows whose cosine with ``target`` (an array column or scalar subquery) reaches the threshold.

    Null and zero vectors never match. One narrow pass: the target travels as a scalar.
    """
    v = F.col(vec)
    scored = df.where(v.isNotNull()).withColumn("_t", target)
    n = norm(v) * norm(F.col("_t"))
    scored = scored.withColumn("_n", n).where("_n > 0").withColumn(name, dot(v, F.col("_t")) / F.col("_n"))
    return scored.where(F.col(name) >= min_similarity).drop("_t", "_n")


def hybrid_score(similarity: Column, relevance: Column, weight: float = 0.7, missing: float = 0.0) -> Column:
    """weight * similarity + (1 - weight) * relevance / 10."""
    return similarity * weight + F.coalesce(relevance, F.lit(missing)) / 10 * (1 - weight)


def search(df: DataFrame, target: Column, vec: str, relevance: Column, tie: str, k: int = 10, min_similarity: float = 0.3) -> DataFrame:
    """Best k rows by hybrid score."""
    out = similar(df, target, vec, min_similarity).withColumn("combined_score", hybrid_score(F.col("similarity"), relevance))
    return out.orderBy(F.desc("combined_score"), F.asc(tie)).limit(k)


def rerank(results: DataFrame, target: Column, vec: str, relevance: Column, weight: float = 0.7) -> DataFrame:
    """Rescore given results; rows without a usable vector get similarity 0 and only their relevance / 10."""
    t = results.withColumn("_t", target)
    n = norm(F.col(vec)) * norm(F.col("_t"))
    ok = F.coalesce(n > 0, F.lit(False))
    sim = F.when(ok, dot(F.col(vec), F.col("_t")) / F.nullif(n, F.lit(0.0))).otherwise(0.0)
    rel = F.coalesce(relevance, F.lit(5.0))
    out = t.withColumn("similarity", sim)
    return out.withColumn("combined_score", F.when(ok, F.col("similarity") * weight + rel / 10 * (1 - weight)).otherwise(rel / 10)).drop("_t")


def canonical_json(c: Column) -> Column:
    """JSON text with sorted keys and no spaces (variant objects keep their keys sorted)."""
    return F.to_json(F.parse_json(c))


def event_checksum(event_type: Column, entity_id: Column, data: Column) -> Column:
    """SHA-256 of ``type:id:canonical json``."""
    return F.sha2(F.concat_ws(":", event_type, entity_id.cast("string"), canonical_json(data)), 256)


def dedup_events(df: DataFrame, event_type: str, entity_id: str, data: str, order: Sequence[str]) -> DataFrame:
    """First event of each checksum: a partial aggregate, so copies collapse before the shuffle."""
    rows = df.withColumn("checksum", event_checksum(F.col(event_type), F.col(entity_id), F.col(data)))
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r")
    return rows.groupBy("checksum").agg(first).select("_r.*", "checksum")


def route_retries(df: DataFrame, processed: str = "processed", retries: str = "retry_count", max_retries: int = 3) -> tuple[DataFrame, DataFrame]:
    """(events to process again, events for the dead-letter queue)."""
    todo = df.where(~F.col(processed))
    return todo.where(F.col(retries) < max_retries), todo.where(F.col(retries) >= max_retries)


def entity_history(df: DataFrame, entity: str, entity_id, order: str) -> DataFrame:
    return df.where(F.col(entity) == entity_id).orderBy(order)


def state_as_of(df: DataFrame, entity: str, event_id: str, created: str, event_type: str, data: str, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Entity state at a time: (entity, key, value) with the newest value of each key, and one row per
    entity with created_at, last_modified and last_event.

    Merging payloads in event order equals taking, per key, the value of the newest event carrying it,
    which is a partial aggregate. ``data`` is a map column.
    """
    src = df if at is None else df.where(F.col(created) <= at)
    kv = src.select(entity, F.col(event_id).alias("_e"), F.explode(data).alias("key", "value"))
    values = kv.groupBy(entity, "key").agg(F.max_by("value", "_e").alias("value"))
    birth = F.col(event_type).endswith("_discovered") | F.col(event_type).endswith("_created")
    head = src.groupBy(entity).agg(
        F.max_by(F.when(birth, F.col(created)), F.when(birth, F.col(event_id))).alias("created_at"),
        F.max_by(created, event_id).alias("last_modified"),
        F.max_by(event_type, event_id).alias("last_event"),
    )
    return values, head


def version_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], key: str = "key", value: str = "value") -> DataFrame:
    """added / removed / changed keys between two (keys, key, value) tables."""
    j = old.withColumnRenamed(value, "old").withColumn("_o", F.lit(True)).join(new.withColumnRenamed(value, "new").withColumn("_n", F.lit(True)), [*keys, key], "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return j.withColumn("change", change).where("change is not null").drop("_o", "_n")


def find_duplicates(papers: DataFrame, record_id: str | None = None, doi: str | None = None, title: str | None = None, paper="paper_id", rid="arxiv_id", doi_col="doi", title_col="title") -> DataFrame:
    """Existing records matching by identifier (equal or contained), DOI or title; first kind wins."""
    kind = F.lit(None).cast("string")
    if title:
        kind = F.when((F.col(title_col) == title) | F.col(title_col).ilike(f"%{title}%"), "title").otherwise(kind)
    if doi:
        kind = F.when(F.col(doi_col) == doi, "doi").otherwise(kind)
    if record_id:
        kind = F.when((F.col(rid) == record_id) | F.col(paper).like(f"%{record_id}%"), "arxiv_id").otherwise(kind)
    return papers.withColumn("match_type", kind).where("match_type is not null")


def embedding_text(title: Column, abstract: Column, methodology: Column) -> Column:
    return F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(abstract, F.lit("")), F.concat(F.lit("methodology: "), F.nullif(methodology, F.lit(""))))


# Formula classes in order of precedence with their patterns, and the domain of each class.
FORMULA_CLASSES = {
    "sharpe_ratio": (r"\\frac\{.*[Rr].*-.*[Rr]_f\}\{\\sigma", r"SR\s*=", r"Sharpe"),
    "kelly_criterion": (r"f\^?\*?\s*=\s*\\frac\{.*p.*-.*q\}", r"Kelly", r"\\frac\{p\s*-\s*q\}\{b\}"),
    "sortino_ratio": (r"Sortino", r"\\frac\{.*-.*\}\{.*downside"),
    "max_drawdown": (r"[Dd]rawdown", r"MDD", r"\\max.*\\min"),
    "volatility": (r"\\sigma\^2", r"\\sqrt\{.*variance", r"[Vv]olatility"),
    "returns": (r"[Rr]_t", r"\\log.*[Pp]_\{?t", r"\\frac\{[Pp]_\{?t.*\}\{[Pp]_\{?t-1"),
    "ema": (r"EMA", r"\\alpha.*\(1-\\alpha\)", r"exponential.*moving"),
    "position_sizing": (r"[Pp]osition.*[Ss]ize", r"\\frac\{.*[Rr]isk\}\{"),
    "var": (r"VaR", r"[Vv]alue.*[Aa]t.*[Rr]isk", r"\\Phi\^\{-1\}"),
    "cvar": (r"CVaR", r"ES\s*=", r"[Ee]xpected.*[Ss]hortfall"),
    "covariance": (r"\\Sigma", r"[Cc]ov\(", r"[Cc]ovariance"),
    "correlation": (r"\\rho", r"[Cc]orr\(", r"[Cc]orrelation"),
    "regression": (r"\\beta", r"[Rr]egression", r"y\s*=.*x.*\\epsilon"),
    "optimization": (r"\\arg\\min", r"\\arg\\max", r"\\nabla", r"[Mm]inimize", r"[Mm]aximize"),
    "probability": (r"[Pp]\(.*\|", r"\\mathbb\{P\}", r"\\mathbb\{E\}", r"[Ee]xpectation"),
    "bayesian": (r"[Pp]osterior", r"[Pp]rior", r"[Ll]ikelihood", r"\\propto"),
    "bandit": (r"UCB", r"Thompson", r"[Rr]egret", r"[Aa]rm", r"\\mu_"),
}
FORMULA_DOMAINS = {
    "trading": ("sharpe_ratio", "kelly_criterion", "sortino_ratio", "max_drawdown", "position_sizing", "var", "cvar", "returns"),
    "statistics": ("volatility", "covariance", "correlation", "regression", "probability", "bayesian"),
    "optimization": ("optimization", "bandit"),
    "indicators": ("ema",),
}


def class_pattern(name: str) -> str:
    """One case-insensitive alternation per class (works in Java and RE2 alike)."""
    return "(?i)" + "|".join(f"(?:{p})" for p in FORMULA_CLASSES[name])


def class_index(text: Column) -> Column:
    """Position of the first class matching the text, or null."""
    out = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(FORMULA_CLASSES))):
        out = F.when(text.rlike(class_pattern(name)), i).otherwise(out)
    return out


def extract_formulas(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Display ($$..$$) and inline ($..$) formulas of every line with class and domain.

    Only lines holding a ``$`` are exploded, with their context (one line before, two after). A class
    matches in the formula or in its context; the first class in table order wins. The shown context
    is its first 200 characters, the whole context is searched.
    """
    d = docs.select(key, F.split(text, "\n").alias("_l"))
    hits = F.filter(F.sequence(F.lit(0), F.size("_l") - 1), lambda i: F.contains(F.get("_l", i), F.lit("$")))
    d = d.withColumn("_i", F.explode(hits))
    line = F.get("_l", F.col("_i"))
    begin = F.greatest(F.col("_i") - 1, F.lit(0))
    context = F.array_join(F.slice("_l", begin + 1, F.col("_i") + 3 - begin), " ")
    d = d.select(key, (F.col("_i") + 1).alias("line_number"), line.alias("_line"), context.alias("_ctx"))
    # a line's context is searched once, however many formulas the line holds
    d = d.withColumn("_in_ctx", class_index(F.col("_ctx")))

    def found(pattern: str, display: bool) -> Column:
        return F.transform(F.regexp_extract_all("_line", F.lit(pattern), F.lit(1)), lambda x: F.struct(F.regexp_replace(x, r"^\s+|\s+$", "").alias("latex"), F.lit(display).alias("display_mode")))

    both = F.concat(found(r"\$\$(.+?)\$\$", True), found(r"(?<!\$)\$([^$]+?)\$(?!\$)", False))
    f = d.select(key, "line_number", "_ctx", "_in_ctx", F.explode(F.filter(both, lambda x: F.length(x["latex"]) > 3)).alias("_f"))
    f = f.select(key, "line_number", "_ctx", "_in_ctx", "_f.*").withColumn("_k", F.least(F.col("_in_ctx"), class_index(F.col("latex"))))
    f = f.withColumn("known_type", F.get(F.array(*[F.lit(n) for n in FORMULA_CLASSES]), F.col("_k")))
    domain = F.lit("general")
    for dom, types in FORMULA_DOMAINS.items():
        domain = F.when(F.col("known_type").isin(*types), dom).otherwise(domain)
    return f.select(key, "line_number", "display_mode", "latex", "known_type", domain.alias("domain"), F.substring("_ctx", 1, 200).alias("context"))
