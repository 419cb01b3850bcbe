"""Queries for lookups, ranking, sampling and labels (REL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as rel
from .registry import TICKS, query, rnd, rounded

PROGRAMS = "programs AS (SELECT o_orderkey AS id, o_custkey % 7 AS experiment, o_totalprice / 1000 - 100 AS calmar FROM orders)"


def programs(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).alias("experiment"), (F.col("o_totalprice") / 1000 - 100).alias("calmar"))


def market(t):
    return t.ticks.select("event_id", "symbol", F.col("ts").alias("timestamp"), F.concat(F.lit("V"), F.col("trader") % 3).alias("venue"), F.when(F.col("volume") % 2 == 0, "LONG").otherwise("SHORT").alias("side"), F.col("price").alias("value"))


@query(
    "rel_01_history_open_interest",
    f"WITH {TICKS} SELECT event_id, us // 1000 AS epoch_ms, price AS value FROM ticks WHERE symbol = 'purchase' AND ts >= '2024-01-05' AND ts <= '2024-01-13' ORDER BY ts, event_id LIMIT 1000",
)
def _(t):
    return rel.history(market(t), "purchase", "2024-01-05", "2024-01-12", limit=1000, tie=["event_id"]).select("event_id", "epoch_ms", "value")


@query(
    "rel_01_history_funding_by_venue",
    f"WITH {TICKS} SELECT event_id, us // 1000 AS epoch_ms, price AS value FROM ticks WHERE symbol = 'view' AND trader % 3 = 1 AND ts >= '2024-01-02' AND ts <= '2024-01-21'",
)
def _(t):
    return rel.history(market(t), "view", "2024-01-02", "2024-01-20", venue="V1").select("event_id", "epoch_ms", "value")


@query(
    "rel_01_history_liquidations",
    f"WITH {TICKS} SELECT event_id, us // 1000 AS epoch_ms, price AS value FROM ticks WHERE symbol = 'error' AND volume % 2 = 0 AND price >= 40 AND ts >= '2024-01-02' AND ts <= '2024-01-26'",
)
def _(t):
    return rel.history(market(t), "error", "2024-01-02", "2024-01-25", side="LONG", min_value=40.0).select("event_id", "epoch_ms", "value")


@query("rel_02_relative_window", f"WITH {TICKS} SELECT symbol, count(*) AS n FROM ticks WHERE ts > (SELECT max(ts) FROM ticks) - INTERVAL 36 HOUR GROUP BY symbol")
def _(t):
    return rel.within(t.ticks, "ts", rel.newest(t.ticks, "ts"), "36 hours").groupBy("symbol").agg(F.count("*").alias("n"))


@query("rel_03_wildcard_filter", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus LIKE '%' AND l_returnflag LIKE 'N%' GROUP BY 1")
def _(t):
    return rel.like(t.lineitem, l_linestatus="%", l_returnflag="N%").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query(
    "rel_04_audit_time_range",
    "SELECT event_id, user_id FROM events WHERE ts BETWEEN '2024-01-03 06:00:00' AND '2024-01-19 18:00:00' AND event_type = 'click' ORDER BY ts, event_id LIMIT 10000",
)
def _(t):
    out = rel.time_range(t.events, "ts", F.lit("2024-01-03 06:00:00").cast("timestamp"), F.lit("2024-01-19 18:00:00").cast("timestamp"), event_type="click", tie=["event_id"])
    return out.select("event_id", "user_id")


@query(
    "rel_05_parameter_history",
    "SELECT event_id, 'param.' || event_type AS event_type, value FROM events WHERE event_type IN ('view', 'click') AND user_id % 10 = 3",
)
def _(t):
    ev = t.events.select(
        "event_id", "ts", "value", F.when(F.col("event_type").isin("view", "click"), F.concat(F.lit("param."), "event_type")).otherwise(F.col("event_type")).alias("event_type"), (F.col("user_id") % 10).alias("param_name")
    )
    return rel.parameter_history(ev, "ts", 3).select("event_id", "event_type", "value")


@query(
    "rel_06_incident_windows",
    f"""WITH {TICKS} SELECT i.event_id AS incident_id, e.event_id FROM ticks i JOIN ticks e ON e.us BETWEEN i.us - 1800000000 AND i.us + 1800000000
 WHERE i.symbol = 'error' AND i.price > 120""",
)
def _(t):
    inc = t.ticks.where("symbol = 'error' and price > 120").select(F.col("event_id").alias("incident_id"), F.col("ts").alias("its"))
    return rel.incident_windows(t.ticks.select("event_id", "ts"), "ts", inc, "incident_id", "its", "30 minutes").select("incident_id", "event_id")


@query("rel_07_top_k", f"WITH {PROGRAMS} SELECT * FROM programs WHERE calmar IS NOT NULL ORDER BY calmar DESC, id LIMIT 25")
def _(t):
    return rel.top_k(programs(t), "calmar", 25, "id")


@query(
    "rel_07_top_k_per_experiment",
    f"WITH {PROGRAMS} SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY calmar DESC, id) AS rank FROM programs QUALIFY rank <= 5",
)
def _(t):
    return rel.top_k(programs(t), "calmar", 5, "id", ["experiment"]).withColumn("rank", F.col("rank").cast("long"))


@query(
    "rel_08_elite_cut",
    f"WITH {PROGRAMS} SELECT id, row_number() OVER (ORDER BY calmar DESC, id) AS rank FROM programs QUALIFY rank <= greatest(1, CAST(floor(0.1 * count(*) OVER ()) AS BIGINT))",
)
def _(t):
    return rel.elite_cut(programs(t), "calmar", "id", 5.0).select("id", "rank")


@query(
    "rel_08_elite_cut_per_experiment",
    f"WITH {PROGRAMS} SELECT id, experiment, row_number() OVER (PARTITION BY experiment ORDER BY calmar DESC, id) AS rank FROM programs QUALIFY rank <= greatest(1, CAST(floor(0.1 * count(*) OVER (PARTITION BY experiment)) AS BIGINT))",
)
def _(t):
    return rel.elite_cut(programs(t), "calmar", "id", 20.0, keys=["experiment"]).select("id", "experiment", "rank")


_U = "((CAST('0x' || substr(md5('{seed}:' || id), 1, 13) AS UBIGINT) + 0.5e0) / 4503599627370496.0e0)"


@query(
    "rel_09_population_prune",
    f"""WITH {PROGRAMS}, e AS (SELECT id FROM programs ORDER BY calmar DESC, id LIMIT 50), n AS (SELECT count(*) AS n FROM programs),
 r AS (SELECT id, row_number() OVER (ORDER BY {_U.format(seed=7)}, id) AS r, count(*) OVER () AS nr FROM programs WHERE id NOT IN (FROM e))
 SELECT id FROM e UNION ALL SELECT id FROM r, n WHERE r > least(greatest(n - 500, 0), nr)""",
)
def _(t):
    return rel.prune_population(programs(t), "calmar", "id", 500, 50, seed=7).select("id")


@query(
    "rel_10_weighted_sample",
    f"""WITH {PROGRAMS} SELECT id FROM programs WHERE calmar > 0 ORDER BY ln({_U.format(seed=3)}) / calmar DESC, id LIMIT 40""",
)
def _(t):
    return rel.weighted_sample(programs(t), "calmar", "id", 40, seed=3).select("id")


@query("rel_10_uniform_sample", f"WITH {PROGRAMS} SELECT id FROM programs ORDER BY ln({_U.format(seed=5)}) DESC, id LIMIT 40")
def _(t):
    return rel.weighted_sample(programs(t).withColumn("w", F.lit(0.0)), "w", "id", 40, seed=5).select("id")


@query("rel_11_distinct_values", "SELECT DISTINCT p_brand, p_type FROM part")
def _(t):
    return t.part.select("p_brand", "p_type").distinct()


@query(
    "rel_12_filtered_search",
    "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_name ILIKE '%WIDGET%' AND p_type = 'ECONOMY' AND p_size >= 10 ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 50",
)
def _(t):
    hit = t.part.where(F.col("p_name").ilike("%WIDGET%") & (F.col("p_type") == "ECONOMY") & (F.col("p_size") >= 10))
    return hit.orderBy(F.desc_nulls_last("p_retailprice"), "p_partkey").limit(50).select("p_partkey", "p_name", "p_retailprice")


@query(
    "rel_13_scalar_ratio",
    f"WITH {TICKS} SELECT {rnd(chr(40) + 'SELECT count(*) FROM ticks WHERE symbol = ' + chr(39) + 'error' + chr(39) + ') / nullif((SELECT count(*) FROM ticks WHERE symbol = ' + chr(39) + 'purchase' + chr(39) + '), 0)')} AS error_rate",
)
def _(t):
    return rel.scalar_ratio(t.ticks.where("symbol = 'error'"), t.ticks.where("symbol = 'purchase'"), "error_rate").select(rounded("error_rate").alias("error_rate"))


@query(
    "rel_14_exposure",
    f"""WITH b AS (SELECT arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS b FROM orders)
 SELECT {rnd('sum(abs(l_extendedprice - 40000) / nullif(b, 0) * 100)', 2)} AS exposure_pct, {rnd('max(abs(l_extendedprice - 40000) / nullif(b, 0) * 100)')} AS max_position_pct FROM lineitem, b""",
)
def _(t):
    pos = t.lineitem.select((F.col("l_extendedprice") - 40000).alias("notional"))
    out = rel.exposure(pos, "notional", t.orders, "o_totalprice", ["o_orderdate", "o_orderkey"])
    return out.select(rounded("exposure_pct", 2).alias("exposure_pct"), rounded("max_position_pct").alias("max_position_pct"))


@query("rel_15_status_projection", "SELECT event_id, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS up, 0.5e0 AS warn_line, 0.9e0 AS critical_line FROM events")
def _(t):
    return t.events.select("event_id", F.when(F.col("event_type") != "error", 1).otherwise(0).alias("up"), F.lit(0.5).alias("warn_line"), F.lit(0.9).alias("critical_line"))


@query("rel_16_bands", "SELECT event_id, CASE WHEN value / 500 < 0.3 THEN 'LOW' WHEN value / 500 < 0.7 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM events")
def _(t):
    return t.events.select("event_id", rel.band(F.col("value") / 500, 0.3, 0.7).alias("level"))
