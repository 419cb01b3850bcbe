"""Queries for joins, reconciliation and graph walks (JOIN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, reconcile
from .registry import query, rnd, rounded


@query("join_01_inner", "SELECT o_orderkey, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 300000")
def _(t):
    o = t.orders.where("o_totalprice > 300000").select("o_orderkey")
    return o.join(t.lineitem.select("l_orderkey", "l_partkey", "l_quantity"), F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@query(
    "join_02_left_null_filter",
    f"SELECT c_custkey, count(o_orderkey) AS n, {rnd('coalesce(sum(o_totalprice), 0)', 2)} AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY 1",
)
def _(t):
    o = t.orders.where("o_orderstatus = 'F'")
    j = t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), rounded(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))


@query("join_03_left_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


_POS = "SELECT o_custkey AS instrument_id, o_orderkey AS seq, o_totalprice AS quantity, CASE WHEN o_orderkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side FROM orders WHERE o_orderstatus IN ({})"


def _positions(t, states):
    return t.orders.where(F.col("o_orderstatus").isin(*states)).select(
        F.col("o_custkey").alias("instrument_id"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").alias("quantity"),
        F.when(F.col("o_orderkey") % 2 == 0, "LONG").otherwise("SHORT").alias("side"),
    )


def _last(states):
    return f"(SELECT instrument_id, arg_max(quantity, seq) AS quantity, arg_max(side, seq) AS side FROM ({_POS.format(states)}) GROUP BY 1)"


@query(
    "join_04_position_reconciliation",
    f"""WITH j AS (SELECT coalesce(c.instrument_id, x.instrument_id) AS instrument_id, c.instrument_id IS NULL AS ext, x.instrument_id IS NULL AS closed,
  c.quantity AS c_quantity, x.quantity AS x_quantity, c.side AS c_side, x.side AS x_side FROM {_last("'F','P'")} c FULL JOIN {_last("'O','P'")} x ON c.instrument_id = x.instrument_id)
 SELECT instrument_id, 'QTY_MISMATCH' AS code, c_quantity, x_quantity, c_side, x_side FROM j WHERE c_quantity <> x_quantity
 UNION ALL SELECT instrument_id, 'SIDE_MISMATCH', c_quantity, x_quantity, c_side, x_side FROM j WHERE c_side <> x_side
 UNION ALL SELECT instrument_id, 'EXTERNAL', c_quantity, x_quantity, c_side, x_side FROM j WHERE ext
 UNION ALL SELECT instrument_id, 'CLOSED', c_quantity, x_quantity, c_side, x_side FROM j WHERE closed""",
)
def _(t):
    return reconcile.reconcile_positions(_positions(t, ["F", "P"]), _positions(t, ["O", "P"]), "instrument_id", ["seq"])


def _balances(t, states):
    return _positions(t, states).select(F.col("instrument_id").alias("currency"), "seq", F.round(F.col("quantity") / 1000).alias("total"), (F.col("seq") % 3).cast("double").alias("locked"))


def _lastb(states):
    return f"(SELECT instrument_id AS currency, round(arg_max(quantity, seq) / 1000) AS total, CAST(arg_max(seq % 3, seq) AS DOUBLE) AS locked FROM ({_POS.format(states)}) GROUP BY 1)"


@query(
    "join_05_balance_reconciliation",
    f"""WITH j AS (SELECT coalesce(c.currency, x.currency) AS currency, c.currency IS NULL AS isnew, x.currency IS NULL AS gone, coalesce(c.total, 0) AS ct, coalesce(x.total, 0) AS xt,
  coalesce(c.locked, 0) AS cl, coalesce(x.locked, 0) AS xl FROM {_lastb("'F','P'")} c FULL JOIN {_lastb("'O','P'")} x ON c.currency = x.currency),
 p AS (SELECT *, CASE WHEN ct <> 0 THEN (xt - ct) / ct * 100 WHEN xt <> 0 THEN 100 ELSE 0 END AS pct FROM j)
 SELECT currency, CASE WHEN isnew THEN 'NEW' WHEN gone THEN 'REMOVED' WHEN ct <> xt THEN 'TOTAL_MISMATCH' WHEN cl <> xl THEN 'LOCKED_MISMATCH' ELSE 'MATCH' END AS code,
  {rnd('xt - ct')} AS total_change, {rnd('xl - cl')} AS locked_change, {rnd('pct')} AS pct_change, isnew OR gone OR abs(pct) >= 10 AS significant FROM p""",
)
def _(t):
    out = reconcile.reconcile_balances(_balances(t, ["F", "P"]), _balances(t, ["O", "P"]), "currency", ["seq"])
    return out.withColumns({c: rounded(c) for c in ("total_change", "locked_change", "pct_change")})


def _edges(t):
    return t.lineitem.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


#: Rows whose pairs one task tells apart.
PAIRS = 1_000_000


def _uses(t, key, *others):
    """Columns of lineitem dealt by ``key`` before pairs are told apart: nearly all pairs differ, so counting them first
    where they are read would only hold them in memory. The number of tasks follows from the rows."""
    rows = t.lineitem.select(key, *others)
    return rows.repartition(max(t.spark.sparkContext.defaultParallelism, rows.count() // PAIRS + 1), key)


@query(
    "join_06_strategy_formulas",
    """SELECT s_suppkey AS strategy_id, s_name AS name, p_name AS formula, max(n_name) AS source_paper, count(DISTINCT l_partkey) AS uses
 FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3""",
)
def _(t):
    """One row per distinct formula of a strategy (kept long: a hot strategy's list never forms one row)."""
    uses = _uses(t, "l_partkey", "l_suppkey").distinct().join(t.part.select("p_partkey", "p_name").distinct(), F.col("l_partkey") == F.col("p_partkey"), "left")
    named = uses.groupBy("l_suppkey", F.col("p_name").alias("formula")).agg(F.count("l_partkey").alias("uses"))
    origin = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("s_suppkey", "s_name").agg(F.max("n_name").alias("source_paper"))
    j = origin.join(named, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return j.select(F.col("s_suppkey").alias("strategy_id"), F.col("s_name").alias("name"), "formula", "source_paper", F.coalesce("uses", F.lit(0)).alias("uses"))


@query(
    "join_06_formula_usage",
    """SELECT p_partkey AS formula_id, count(DISTINCT l_orderkey) AS papers, count(DISTINCT l_suppkey) AS strategies FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1""",
)
def _(t):
    uses = _uses(t, "l_partkey", "l_orderkey", "l_suppkey").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("papers"), F.countDistinct("l_suppkey").alias("strategies"))
    j = t.part.select("p_partkey").distinct().join(uses, F.col("p_partkey") == F.col("l_partkey"), "left")
    return j.select(F.col("p_partkey").alias("formula_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("papers", "strategies")])


@query(
    "join_07_citation_chain",
    """WITH RECURSIVE e AS (SELECT DISTINCT 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 r AS (SELECT 'o0' AS node, 0 AS distance UNION SELECT u.b, r.distance + 1 FROM r JOIN u ON r.node = u.a WHERE r.distance < 3)
 SELECT node, min(distance) AS distance FROM r WHERE node <> 'o0' GROUP BY 1""",
)
def _(t):
    return graph.reach(_edges(t), "o0", 3)


@query(
    "join_08_lineage_roots",
    """WITH RECURSIVE n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderkey // 2 END AS p FROM orders),
 r AS (SELECT id, id AS root, 0 AS depth FROM n WHERE p IS NULL UNION ALL SELECT n.id, r.root, r.depth + 1 FROM n JOIN r ON n.p = r.id)
 SELECT id, root, CAST(depth AS BIGINT) AS depth FROM r""",
)
def _(t):
    k = F.col("o_orderkey")
    return graph.lineage_roots(t.orders.select(k.alias("id"), F.when(k % 97 != 0, F.expr("o_orderkey div 2")).alias("parent_id")))


@query(
    "join_08_lineage_of_one",
    """WITH RECURSIVE n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderkey // 2 END AS p FROM orders),
 r AS (SELECT id, p, 0 AS depth FROM n WHERE id = 1403 UNION ALL SELECT n.id, n.p, r.depth + 1 FROM n JOIN r ON n.id = r.p) SELECT id, depth FROM r""",
)
def _(t):
    k = F.col("o_orderkey")
    return graph.lineage_of(t.orders.select(k.alias("id"), F.when(k % 97 != 0, F.expr("o_orderkey div 2")).alias("parent_id")), 1403)


@query(
    "join_11_gap_enrichment",
    f"""SELECT s.user_id, s.event_type, s.n, coalesce(g.errors, 0) AS errors, coalesce(g.duration, 0e0) AS duration FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) s
 LEFT JOIN (SELECT user_id, event_type, count(*) AS errors, {rnd('sum(value)', 4)} AS duration FROM events WHERE value > 150 GROUP BY 1, 2) g USING (user_id, event_type)""",
)
def _(t):
    keys = ["user_id", "event_type"]
    s = t.events.groupBy(*keys).agg(F.count("*").alias("n"))
    g = t.events.where("value > 150").groupBy(*keys).agg(F.count("*").alias("errors"), rounded(F.sum("value"), 4).alias("duration"))
    return s.join(g, keys, "left").select(*keys, "n", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("duration", F.lit(0.0)).alias("duration"))


@query(
    "join_12_full_report",
    f"""SELECT s_suppkey AS strategy_id, s_name AS name, n_name AS origin, b.n AS n_backtests, b.mean AS avg_return, a.label,
  CASE WHEN b.n IS NULL THEN 'no analytics' WHEN a.label IS NULL THEN 'no embedding' END AS error
 FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT l_suppkey, count(*) AS n, {rnd('avg(l_discount)')} AS mean FROM lineitem WHERE l_quantity > 10 GROUP BY 1) b ON s_suppkey = b.l_suppkey
 LEFT JOIN embeddings a ON a.vec_id = s_suppkey * 7""",
)
def _(t):
    b = t.lineitem.where("l_quantity > 10").groupBy("l_suppkey").agg(F.count("*").alias("n_backtests"), rounded(F.avg("l_discount")).alias("avg_return"))
    j = (
        t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(b, F.col("s_suppkey") == F.col("l_suppkey"), "left")
        .join(t.embeddings.select("vec_id", "label"), F.col("vec_id") == F.col("s_suppkey") * 7, "left")
    )
    err = F.when(F.col("n_backtests").isNull(), "no analytics").when(F.col("label").isNull(), "no embedding")
    return j.select(F.col("s_suppkey").alias("strategy_id"), F.col("s_name").alias("name"), F.col("n_name").alias("origin"), "n_backtests", "avg_return", "label", err.alias("error"))


@query(
    "join_06_paper_formula_counts",
    "SELECT o_orderkey AS paper_id, count(l_partkey) AS formula_count FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority LIKE '%URGENT%' GROUP BY 1",
)
def _(t):
    p = t.orders.where(F.col("o_orderpriority").contains("URGENT")).select(F.col("o_orderkey").alias("paper_id"))
    j = p.join(t.lineitem.select("l_orderkey", "l_partkey"), F.col("paper_id") == F.col("l_orderkey"), "left")
    return j.groupBy("paper_id").agg(F.count("l_partkey").alias("formula_count"))


@query(
    "set_01_union_by_name",
    "SELECT doc_id AS id, lang, CAST(NULL AS VARCHAR) AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages",
)
def _(t):
    """Files with different optional columns read as one table."""
    a, b = t.documents.select(F.col("doc_id").alias("id"), "lang"), t.pages.select(F.col("page_id").alias("id"), "url")
    return a.unionByName(b, allowMissingColumns=True)


@query("set_02_only_in_cache", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def _(t):
    """Keys of the cached side that the exchange side lacks."""
    side = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return side("F").join(side("O"), "k", "left_anti").distinct()


@query("set_02_in_both", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def _(t):
    side = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return side("F").join(side("O"), "k", "left_semi").distinct()
