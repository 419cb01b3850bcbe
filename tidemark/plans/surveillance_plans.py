"""Queries for abuse patterns, audit checks and alert rules (SEC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as al
from ..operators import surveillance as sv
from ..operators.blocks import RowBlocks
from ..operators.bucket import token_bucket_audit
from .flow_plans import recur
from .registry import TICKS, query, rnd, rounded

ORD = ["ts", "event_id"]
BLOCKS = RowBlocks()
# A user has few events a day here, so windows are widened to days; the logic is that of seconds.
O = """o AS (SELECT event_id, us, trader AS user_id, CASE WHEN trader % 2 = 0 THEN 'A' ELSE 'B' END AS symbol, CASE WHEN volume % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, round(greatest(price, 5) / 5) AS price,
 CASE symbol WHEN 'purchase' THEN 'filled' WHEN 'error' THEN 'cancelled' WHEN 'view' THEN 'cancelled' ELSE 'submitted' END AS status FROM ticks)"""
W3, D1 = 3 * 86400000000, 86400000000


def orders(t):
    s = F.col("symbol")
    return t.ticks.select(
        "event_id",
        "us",
        F.col("trader").alias("user_id"),
        F.when(F.col("trader") % 2 == 0, "A").otherwise("B").alias("symbol"),
        F.when(F.col("volume") % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.round(F.greatest("price", F.lit(5.0)) / 5).alias("price"),
        F.when(s == "purchase", "filled").when(s.isin("error", "view"), "cancelled").otherwise("submitted").alias("status"),
    )


RECENT = dict(window="3 days", burst="1 day", band=0.2)
ST = f"""st AS (SELECT a.event_id, a.user_id, a.symbol, (SELECT count(*) FROM o b WHERE b.user_id = a.user_id AND b.us > a.us - {W3} AND b.us <= a.us) AS recent,
  (SELECT count(*) FROM o b JOIN o s ON s.user_id = b.user_id WHERE b.user_id = a.user_id AND b.side = 'buy' AND s.side = 'sell' AND b.us > a.us - {W3} AND b.us <= a.us AND s.us > a.us - {W3} AND s.us <= a.us AND abs(b.price - s.price) / b.price < 0.2) AS matches,
  (SELECT count(*) FROM o b WHERE b.user_id = a.user_id AND b.us > a.us - {D1} AND b.us <= a.us) AS burst,
  (SELECT count(DISTINCT price) FROM o b WHERE b.user_id = a.user_id AND b.side = 'buy' AND b.us > a.us - {W3} AND b.us <= a.us) AS buy_levels,
  (SELECT count(DISTINCT price) FROM o b WHERE b.user_id = a.user_id AND b.side = 'sell' AND b.us > a.us - {W3} AND b.us <= a.us) AS sell_levels FROM o a)"""


@query("sec_01_recent_order_stats", f"WITH {TICKS}, {O}, {ST} SELECT event_id, recent, matches, burst, buy_levels, sell_levels FROM st")
def _(t):
    out = sv.recent_order_stats(orders(t), "user_id", "symbol", "us", "event_id", width="5 days", **RECENT)
    return out.select("event_id", "recent", "matches", "burst", "buy_levels", "sell_levels")


_CUM = """cu AS (SELECT event_id, sum(CASE WHEN status = 'submitted' THEN 1 ELSE 0 END) OVER w AS so, sum(CASE WHEN status = 'cancelled' THEN 1 ELSE 0 END) OVER w AS sc, sum(CASE WHEN status = 'filled' THEN 1 ELSE 0 END) OVER w AS sf FROM o
 WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))"""
_AL = """al AS (SELECT st.*, so, sc / greatest(1, sc + sf) AS ratio FROM st JOIN cu USING (event_id)),
 alerts AS (SELECT event_id, user_id, symbol, 'WASH_TRADING' AS alert, 'HIGH' AS severity, least(0.9, matches / 10) AS confidence, matches * 1e0 AS evidence FROM al WHERE recent >= 3 AND matches >= 3
 UNION ALL SELECT event_id, user_id, symbol, 'SPOOFING', 'HIGH', least(0.95, ratio), ratio FROM al WHERE so >= 5 AND ratio > 0.75
 UNION ALL SELECT event_id, user_id, symbol, 'ORDER_STUFFING', 'MEDIUM', 0.7, burst FROM al WHERE burst > 4
 UNION ALL SELECT event_id, user_id, symbol, 'LAYERING', 'MEDIUM', 0.6, greatest(buy_levels, sell_levels) FROM al WHERE recent >= 8 AND greatest(buy_levels, sell_levels) >= 5)"""
PARAMS = dict(spoof_ratio=0.75, max_burst=4, layer_orders=8, width="5 days", **RECENT)


@query("sec_02_spoofing_ratio", f"WITH {TICKS}, {O}, {_CUM} SELECT event_id, {rnd('sc / greatest(1, sc + sf)')} AS cancel_ratio FROM cu WHERE so >= 5 AND sc / greatest(1, sc + sf) > 0.7")
def _(t):
    from ..operators.blocks import running

    is_ = lambda s: F.when(F.col("status") == s, 1).otherwise(0)
    r = running(orders(t), ["user_id"], ["us", "event_id"], BLOCKS, {"so": ("sum", is_("submitted")), "sc": ("sum", is_("cancelled")), "sf": ("sum", is_("filled"))})
    r = r.withColumn("cancel_ratio", F.col("sc") / F.greatest(F.lit(1), F.col("sc") + F.col("sf")))
    return r.where("so >= 5 and cancel_ratio > 0.7").select("event_id", rounded("cancel_ratio").alias("cancel_ratio"))


@query("sec_03_order_stuffing", f"WITH {TICKS}, c AS (SELECT event_id, count(*) OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN 1799999999 PRECEDING AND CURRENT ROW) AS n FROM ticks) SELECT event_id, n FROM c WHERE n > 4")
def _(t):
    from ..operators.risk import range_count

    return range_count(t.ticks, ["symbol"], "us", "30 minutes", "n", width="6 hours").where("n > 4").select("event_id", "n")


@query("sec_04_layering", f"WITH {TICKS}, {O}, {ST} SELECT event_id, greatest(buy_levels, sell_levels) AS levels FROM st WHERE recent >= 8 AND greatest(buy_levels, sell_levels) >= 5")
def _(t):
    st = sv.recent_order_stats(orders(t), "user_id", "symbol", "us", "event_id", width="5 days", **RECENT)
    return st.where("recent >= 8").select("event_id", F.greatest("buy_levels", "sell_levels").alias("levels")).where("levels >= 5")


@query("sec_05_abuse_alerts", f"WITH {TICKS}, {O}, {ST}, {_CUM}, {_AL} SELECT event_id, user_id, symbol, alert, severity, {rnd('confidence')} AS confidence, {rnd('evidence')} AS evidence FROM alerts")
def _(t):
    out = sv.abuse_alerts(orders(t), "user_id", "symbol", "us", "event_id", BLOCKS, **PARAMS)
    return out.withColumns({"confidence": rounded("confidence"), "evidence": rounded("evidence")})


@query(
    "sec_05_session_alerts",
    f"""WITH {TICKS}, {O.replace("FROM ticks)", "FROM ticks WHERE trader = 41 AND us > (SELECT max(us) FROM ticks) - 240 * 3600000000)")}, {ST}, {_CUM}, {_AL} SELECT event_id, alert, {rnd('evidence')} AS evidence FROM alerts""",
)
def _(t):
    out = sv.session_alerts(orders(t), "user_id", 41, "symbol", "us", "event_id", BLOCKS, hours=240, **PARAMS)
    return out.select("event_id", "alert", rounded("evidence").alias("evidence"))


_CANON = """'{"action":"' || event_type || '","actor":"u' || user_id || '","details":' || json(props) || ',"event_id":"' || event_id || '","event_type":"audit.' || event_type || '","previous_hash":"' || previous_hash || '","resource":"r' || user_id % 7 || '","timestamp":"' || epoch_us(ts) || '"}'"""


@query(
    "sec_06_hash_chain_verify",
    f"""WITH p AS (SELECT *, lag(event_id) OVER (ORDER BY ts, event_id) AS pid FROM events), q AS (SELECT *, CASE WHEN pid IS NULL THEN repeat('0', 64) ELSE sha256('e' || pid) END AS previous_hash FROM p),
 h AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN sha256('e' || event_id) ELSE sha256({_CANON}) END AS hash FROM q),
 v AS (SELECT event_id, hash <> sha256({_CANON}) AS bad, previous_hash <> coalesce(lag(hash) OVER (ORDER BY ts, event_id), repeat('0', 64)) AS brk FROM h)
 SELECT event_id, 'HASH_MISMATCH' AS error FROM v WHERE bad UNION ALL SELECT event_id, 'CHAIN_BREAK' FROM v WHERE brk""",
)
def _(t):
    """A log whose every fifth hash is forged; forged hashes are also the only ones the next row links to."""
    from ..operators.blocks import running

    e = running(t.events, [], ORD, BLOCKS, {"pid": ("lag", F.col("event_id"))})
    sha = lambda c: F.sha2(F.concat(F.lit("e"), c.cast("string")), 256)
    e = e.select(
        "ts",
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit("audit."), "event_type").alias("event_type"),
        F.unix_micros("ts").cast("string").alias("timestamp"),
        F.concat(F.lit("u"), "user_id").alias("actor"),
        F.concat(F.lit("r"), F.col("user_id") % 7).alias("resource"),
        F.col("event_type").alias("action"),
        F.to_json(F.parse_json("props")).alias("details"),
        F.coalesce(sha(F.col("pid")), F.lit(sv.GENESIS)).alias("previous_hash"),
    )
    n = F.col("event_id").cast("long")
    e = e.withColumn("hash", F.when(n % 5 == 0, sha(n)).otherwise(sv.chain_hash(F.col("previous_hash"))))
    return sv.verify_chain(e, ORD, BLOCKS).select(F.col("event_id").cast("long").alias("event_id"), "error")


_CK = """substr(sha256('{"ts_event":' || epoch_us(ts) * 1000 || ',"event_type":"' || event_type || '","source":"s' || user_id % 3 || '","trader_id":"T' || user_id || '","sequence":' || event_id || ',"value":"' || CAST(value AS DECIMAL(12, 2)) || '"}'), 1, 16)"""


@query(
    "sec_07_row_checksums",
    f"""WITH c AS (SELECT event_id, {_CK} AS ck, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'deadbeefdeadbeef' ELSE {_CK} END AS stored FROM events)
 SELECT CASE WHEN stored IS NULL THEN 'missing' WHEN stored = ck THEN 'valid' ELSE 'invalid' END AS "check", count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM c GROUP BY 1""",
)
def _(t):
    fields = {
        "ts_event": (F.unix_micros("ts") * 1000).cast("string"),
        "event_type": sv.json_text(F.col("event_type")),
        "source": sv.json_text(F.concat(F.lit("s"), F.col("user_id") % 3)),
        "trader_id": sv.json_text(F.concat(F.lit("T"), "user_id")),
        "sequence": F.col("event_id").cast("string"),
        "value": sv.json_text(F.col("value").cast("decimal(12,2)")),
    }
    ck = sv.checksum(fields, ["ts_event", "event_type", "source", "trader_id", "sequence", "value"])
    e = t.events.select("event_id", ck.alias("ck"), "ts").withColumn("stored", F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 11 == 0, "deadbeefdeadbeef").otherwise(F.col("ck")))
    return sv.verify_checksums(e, "stored", F.col("ck")).groupBy("check").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "sec_08_token_bucket",
    f"""WITH RECURSIVE {TICKS}, s AS (SELECT *, row_number() OVER w AS seq, (us - lag(us) OVER w) / 1e6 AS dt FROM ticks WINDOW w AS (PARTITION BY trader ORDER BY us, event_id)),
 {recur({'t': '2'}, {'t': 'least(3, y.t + s.dt * 0.00002) - CASE WHEN least(3, y.t + s.dt * 0.00002) >= 1 THEN 1 ELSE 0 END', 'a': 'CASE WHEN least(3, y.t + s.dt * 0.00002) >= 1 THEN 1 ELSE 0 END'}).replace('CAST(2 AS DOUBLE) AS t FROM', 'CAST(2 AS DOUBLE) AS t, 1e0 AS a FROM')}
 SELECT event_id, a = 1 AS allowed, {rnd('t')} AS tokens FROM s JOIN y USING (trader, seq)""",
)
def _(t):
    out = token_bucket_audit(t.ticks, ["trader"], "us", "event_id", 3.0, 0.00002)
    return out.select("event_id", "allowed", rounded("tokens").alias("tokens"))


RULES = (
    ("Error rate high", "error_rate", "gt", 30, 0, "warning", "OK"),
    ("Error rate critical", "error_rate", "gt", 25, 3600, "critical", "Alerting"),
    ("Low value", "avg_value", "lt", 45, 7200, "warning", "OK"),
    ("Volume", "n_events", "gt", 18, 0, "medium", "OK"),
)
_RULES = ", ".join(f"('{r[0]}', '{r[1]}', '{r[2]}', {r[3]}e0, {r[4]}, '{r[5]}', '{r[6]}')" for r in RULES)
SERIES = """h AS (SELECT us // 3600000000 * 3600000000 AS us, 100.0e0 * count(*) FILTER (symbol = 'error') / count(*) AS er, avg(price) AS av, count(*) * 1e0 AS n FROM ticks GROUP BY 1),
 sr AS (SELECT us, 'error_rate' AS metric, CASE WHEN n >= 8 THEN er END AS value FROM h UNION ALL SELECT us, 'avg_value', av FROM h UNION ALL SELECT us, 'n_events', n FROM h)"""
EV = f"""rl AS (SELECT * FROM (VALUES {_RULES}) v(rule, metric, op, threshold, fs, severity, nd)), j AS (SELECT *, CASE WHEN value IS NULL THEN nd = 'Alerting' WHEN op = 'gt' THEN value > threshold ELSE value < threshold END AS b FROM sr JOIN rl USING (metric)),
 w AS (SELECT *, last_value(CASE WHEN b AND NOT coalesce(pb, false) THEN us END IGNORE NULLS) OVER (PARTITION BY rule ORDER BY us) AS since FROM (SELECT *, lag(b) OVER (PARTITION BY rule ORDER BY us) AS pb FROM j)),
 ev AS (SELECT rule, severity, us, CASE WHEN NOT b THEN 'ok' WHEN us - since >= CAST(fs AS BIGINT) * 1000000 THEN 'firing' ELSE 'pending' END AS state FROM w)"""


def _states(t):
    h = t.ticks.groupBy(F.expr("us div 3600000000 * 3600000000").alias("us")).agg(
        (F.count_if(F.col("symbol") == "error") * 100.0 / F.count("*")).alias("er"), F.avg("price").alias("av"), F.count("*").cast("double").alias("n")
    )
    pts = F.array(
        F.struct(F.lit("error_rate").alias("metric"), F.when(F.col("n") >= 8, F.col("er")).alias("value")),
        F.struct(F.lit("avg_value").alias("metric"), F.col("av").alias("value")),
        F.struct(F.lit("n_events").alias("metric"), F.col("n").alias("value")),
    )
    series = h.select("us", F.explode(pts).alias("p")).select("us", "p.*")
    return al.evaluate_rules(series, al.rule_table(t.spark, RULES), [], "us", BLOCKS)


@query("sec_09_alert_states", f"WITH {TICKS}, {SERIES}, {EV} SELECT rule, us, state FROM ev")
def _(t):
    return _states(t).select("rule", "us", "state")


@query(
    "sec_09_firing_intervals",
    f"""WITH {TICKS}, {SERIES}, {EV}, i AS (SELECT *, sum(CASE WHEN state = 'firing' AND coalesce(ps, '') <> 'firing' THEN 1 ELSE 0 END) OVER (PARTITION BY rule ORDER BY us) AS g FROM (SELECT *, lag(state) OVER (PARTITION BY rule ORDER BY us) AS ps FROM ev))
 SELECT rule, severity, min(us) AS start_us, max(us) AS end_us, count(*) AS n_points FROM i WHERE state = 'firing' GROUP BY rule, severity, g""",
)
def _(t):
    return al.firing_intervals(_states(t).select("rule", "severity", "us", "state"), [], "us", BLOCKS)


@query(
    "sec_10_failed_logins_by_hour",
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS failed FROM events WHERE event_type = 'error' GROUP BY 1",
)
def _(t):
    return t.events.where("event_type = 'error'").groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("failed"))


@query("sec_10_top_sources", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def _(t):
    last = t.events.agg(F.max("ts").alias("m")).select("m").scalar()
    return t.events.where("event_type = 'error'").where(F.col("ts") > last - F.expr("interval 7 days")).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("sec_10_status_mix", f"SELECT l_returnflag AS status, l_linestatus AS kind, count(*) AS n, {rnd('100.0e0 * count(*) / (SELECT count(*) FROM lineitem)')} AS pct FROM lineitem GROUP BY 1, 2")
def _(t):
    total = t.lineitem.agg(F.count("*").alias("n")).select("n").scalar()
    return t.lineitem.groupBy(F.col("l_returnflag").alias("status"), F.col("l_linestatus").alias("kind")).agg(F.count("*").alias("n")).withColumn("pct", rounded(F.col("n") * 100.0 / total))
