"""Mixing sources to target weights by hierarchical budgeting.

Weights sit on the nodes of a domain - language - source tree. A node's budget is divided among its children
in proportion to their weights; a child that cannot use its share (its subtree holds fewer tokens, all epochs
counted) is filled, and what it leaves goes to its siblings in proportion to their weights. As a node is never
given more than its subtree holds, a shortage leaves a family only when all siblings are full, and is then
shared by the ancestor's siblings: siblings first, ancestors after. That fill level is a closed form over the
children in order of capacity / weight, so every level is one pass of window sums over the (small) node table.

A leaf takes the prefix of its epochs that fits its budget: whole epochs first, then documents of the next
epoch in a seeded order while their running token sum stays within what is left. The running sum is taken in
two steps (sums of order buckets, then rows of the one bucket that the cut falls into), so that a leaf with a
third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import seeded_order, whole

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def path_of(columns: Sequence[Column]) -> Column:
    """Level values joined by "/"; "/", "%" and "∅" inside a value are escaped as in a URL, null is "∅"."""
    values = []
    for c in columns:
        text = c.cast("string")
        for sign, code in (("%", "%25"), ("/", "%2F"), ("∅", "%E2%88%85")):
            text = F.replace(text, F.lit(sign), F.lit(code))
        values.append(F.coalesce(text, F.lit("∅")))
    return F.concat_ws("/", *values)


def budgets(leaves: DataFrame, weights: DataFrame | None, total: Column, epochs: int, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Leaf budgets: ``levels``, tokens, budget (double).

    ``leaves`` has the levels and ``tokens`` of one epoch; ``weights`` may give (path, weight) for any node, path
    being its level values joined by "/" (see ``path_of``). A node without a weight has weight 1; weight 0 takes nothing. ``total``
    is the budget of the root, an aggregate over leaves. Null level values are a node of their own.
    """
    nodes = leaves.select(*levels, "tokens", (F.col("tokens") * epochs).cast("double").alias("cap"))
    root = nodes.agg(F.least(total.cast("double"), F.sum("cap")).alias("share"))
    above = root.withColumn("_path", F.lit(""))
    for depth, level in enumerate(levels):
        named = [F.col(c) for c in levels[: depth + 1]]
        path, parent = path_of(named), path_of(named[:-1]) if depth else F.lit("")
        family = nodes.groupBy(path.alias("path"), parent.alias("_path")).agg(F.sum("cap").alias("cap"))
        if weights is None:
            family = family.withColumn("weight", F.lit(1.0))
        else:
            family = family.join(weights.select("path", F.col("weight").cast("double").alias("weight")), "path", "left").fillna({"weight": 1.0})
        family = family.withColumn("usable", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0))
        kin = family.join(above, "_path").withColumn("ratio", F.when(F.col("weight") > 0, F.col("usable") / F.col("weight")).otherwise(-1.0))
        order = W.partitionBy("_path").orderBy("ratio", "path").rowsBetween(W.unboundedPreceding, 0)
        after = W.partitionBy("_path").orderBy("ratio", "path").rowsBetween(1, W.unboundedFollowing)
        kin = kin.withColumns({"below": F.sum("usable").over(order), "rest": F.coalesce(F.sum("weight").over(after), F.lit(0.0))})
        kin = kin.withColumn("full", (F.col("weight") <= 0) | (F.col("below") + F.col("ratio") * F.col("rest") <= F.col("share")))
        everyone = W.partitionBy("_path")
        kin = kin.withColumns(
            {
                "taken": F.sum(F.when(F.col("full"), F.col("usable")).otherwise(0.0)).over(everyone),
                "open": F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).over(everyone),
            }
        )
        given = F.when(F.col("full"), F.col("usable")).otherwise((F.col("share") - F.col("taken")) * F.col("weight") / F.col("open"))
        above = kin.select(F.col("path").alias("_path"), F.least(given, F.col("usable")).alias("share"))
    return nodes.withColumn("_path", path_of([F.col(c) for c in levels])).join(above, "_path").select(*levels, "tokens", F.col("share").alias("budget"))


def mix(
    docs: DataFrame, levels: dict[str, Column], weights: DataFrame | None = None, fraction: float = 0.8, epochs: int = 2, seed: int = 42, id_col: str = "doc_id", tokens: Column | None = None
) -> DataFrame:
    """(doc_id, epoch, tokens, leaf levels, budget): one row per selected document and epoch.

    ``levels`` names the tree's levels from the top and the column of ``docs`` behind each. ``tokens`` counts a
    document's tokens (words by default; null text 0). The root's budget is ``fraction`` of all tokens. Epoch e
    of a leaf is an order of its documents seeded by (seed, e). A document goes in if the running sum with it
    stays within the budget left; equal sums cannot part as the order is total (id breaks ties; rows that
    repeat an id stand next to each other in no stated order, with equal outcome when their tokens agree).
    Documents without tokens never use budget: they follow the prefix in which they stand. An empty table gives
    an empty result.
    """
    names = list(levels)
    count = n_words(F.col("text")) if tokens is None else tokens
    rows = docs.select(F.col(id_col).alias("doc_id"), count.alias("tokens"), *[c.alias(n) for n, c in levels.items()])
    leaves = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    leaf = path_of([F.col(c) for c in names])
    shares = budgets(leaves, weights, F.sum("tokens") * F.lit(fraction), epochs, names)
    # whole epochs are taken at once; the epoch in which the budget ends is cut
    shares = shares.withColumn("leaf", leaf).withColumn("whole", F.least(F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0), F.lit(epochs)))
    shares = shares.select("leaf", F.col("budget"), F.col("whole").cast("int").alias("whole"), (F.col("budget") - F.col("whole") * F.col("tokens")).alias("left"))
    rows = rows.withColumn("leaf", leaf).withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int"))
    spread = shares.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    at = rows.join(spread, ["leaf", "_salt"]).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).where(F.col("epoch") <= F.col("whole"))
    at = at.withColumn("ord", seeded_order(seed, F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("bucket", F.substring("ord", 1, 3))
    sums = at.where(F.col("epoch") == F.col("whole")).groupBy("leaf", "bucket").agg(F.sum("tokens").alias("in_bucket"), F.first("left").alias("left"))
    upto = W.partitionBy("leaf").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("in_bucket").over(upto))
    # every leaf's first bucket that does not fit whole; null: all of them fit
    cuts = sums.groupBy("leaf").agg(F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", (F.col("upto") - F.col("in_bucket")).alias("before")))).alias("cut"))
    cuts = cuts.select("leaf", F.col("cut.bucket").alias("cut"), F.col("cut.before").alias("before")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    at = at.join(cuts, ["leaf", "_salt"], "left")
    out = [F.col("doc_id"), F.col("epoch"), F.col("tokens"), *[F.col(n) for n in names], F.col("budget")]
    taken = at.where((F.col("epoch") < F.col("whole")) | F.col("cut").isNull() | (F.col("bucket") < F.col("cut"))).select(*out)
    edge = at.where((F.col("epoch") == F.col("whole")) & (F.col("bucket") == F.col("cut")))
    inside = W.partitionBy("leaf", "bucket").orderBy("ord", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.col("before") + F.sum("tokens").over(inside)).where(F.col("upto") <= F.col("left")).select(*out)
    return taken.unionByName(edge)


#: Domains of the registered tree: sources are grouped by the last digit of their number.
def tree() -> dict[str, Column]:
    last = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), r"(\d)$", 1)
    domain = F.when(last == "", "other").when(last < "4", "web").when(last < "7", "books").otherwise("forums")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


#: Target weights of the registered tree; a path without one has weight 1 among its siblings.
WEIGHTS = {"web": 0.5, "books": 0.3, "forums": 0.2, "other": 0.1, "web/en": 3.0, "books/en": 2.0, "forums/en": 2.0}


def target_weights(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame(list(WEIGHTS.items()), "path string, weight double")


_LEVEL = """
{name}_kin as (
  select n.path, n.parent, n.cap, n.weight, p.share, case when n.weight > 0 then n.cap / n.weight else -1.0 end as ratio
  from (select {path} as path, {parent} as parent, sum(cap) as cap0, coalesce(any_value(w.weight), 1.0) as weight,
               case when coalesce(any_value(w.weight), 1.0) > 0 then sum(cap) else 0.0 end as cap
        from leaves l left join weights w on w.path = {path} group by 1, 2) n
  join {above} p on p.path = n.parent),
{name}_sum as (
  select *, sum(cap) over (partition by parent order by ratio, path rows unbounded preceding) as below,
         coalesce(sum(weight) over (partition by parent order by ratio, path rows between 1 following and unbounded following), 0.0) as rest
  from {name}_kin),
{name}_full as (select *, weight <= 0 or below + ratio * rest <= share as is_full from {name}_sum),
{name} as (
  select path, least(case when is_full then cap else (share - taken) * weight / open_w end, cap) as share
  from (select *, sum(case when is_full then cap else 0.0 end) over (partition by parent) as taken,
               sum(case when is_full then 0.0 else weight end) over (partition by parent) as open_w from {name}_full))"""


def sql(fraction: float = 0.8, epochs: int = 2, seed: int = 42) -> str:
    weights = ", ".join(f"('{p}', {float(w)!r}::double)" for p, w in WEIGHTS.items())
    d, la, s = "coalesce(l.domain, '∅')", "coalesce(l.lang, '∅')", "coalesce(l.source, '∅')"
    levels = [
        _LEVEL.format(name="by_domain", path=d, parent="''", above="root"),
        _LEVEL.format(name="by_lang", path=f"{d} || '/' || {la}", parent=d, above="by_domain"),
        _LEVEL.format(name="by_source", path=f"{d} || '/' || {la} || '/' || {s}", parent=f"{d} || '/' || {la}", above="by_lang"),
    ]
    return f"""
with weights(path, weight) as (values {weights}),
docs as (
  select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as tokens, lang, source,
         regexp_extract(coalesce(source, ''), '(\\d)$', 1) as last_digit from documents),
rows_ as (
  select doc_id, tokens, lang, source,
         case when last_digit = '' then 'other' when last_digit < '4' then 'web' when last_digit < '7' then 'books' else 'forums' end as domain from docs),
leaves as (select domain, lang, source, sum(tokens) as tokens, cast(sum(tokens) * {epochs} as double) as cap from rows_ group by all),
root as (select '' as path, least(cast(sum(tokens) * {fraction} as double), sum(cap)) as share from leaves),
{",".join(levels)},
shares as (
  select l.*, b.share as budget,
         least(case when l.tokens > 0 then floor(b.share / l.tokens) else 0 end, {epochs}) as whole
  from leaves l join by_source b on b.path = {d} || '/' || {la} || '/' || {s}),
at_ as (
  select r.*, e.epoch, s.budget, s.whole, s.budget - s.whole * s.tokens as left_,
         sum(r.tokens) over (partition by r.domain, r.lang, r.source, e.epoch
                             order by md5('{seed}:' || e.epoch || ':' || coalesce(r.doc_id::varchar, '')), r.doc_id rows unbounded preceding) as upto
  from rows_ r join shares s on r.domain is not distinct from s.domain and r.lang is not distinct from s.lang and r.source is not distinct from s.source
  cross join (select unnest(range({epochs})) as epoch) e)
select doc_id, cast(epoch as integer) as epoch, cast(tokens as bigint) as tokens, domain, lang, source, round(budget, 3) as budget
from at_ where epoch < whole or (epoch = whole and upto <= left_)
"""


def keep_mixed(docs: DataFrame, levels: dict[str, Column], weights: DataFrame | None = None, fraction: float = 0.8, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, that one epoch of ``mix`` selects.

    Rows that repeat an id share their place in the order; they all stay when the last of them fits the budget,
    else none does.
    """
    picked = mix(docs, levels, weights, fraction, 1, seed, id_col).groupBy("doc_id").agg(F.count("*").alias("_in"))
    rows = docs.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_all"))
    whole_ids = rows.join(picked, F.col("_id").eqNullSafe(F.col("doc_id"))).where("_in = _all").select("_id")
    return docs.join(whole_ids, F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")
