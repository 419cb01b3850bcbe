"""Queries for regimes, change points and information measures (REG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regime as reg
from ..operators import windows as win
from ..operators.blocks import RowBlocks, with_seq
from ..session import checkpointed
from .registry import TICKS, query, rnd, rounded

ORD = ["ts", "event_id"]
BLOCKS = RowBlocks()
ROWS = win.ROWS


def _ret(t):
    return win.log_return(t.ticks, ["symbol"], ORD, "price", BLOCKS, "ret", first=0.0)


#: The recursion row by row, all symbols at once; lists are indexed by run length + 1.
CHANGE_POINTS = f"""WITH RECURSIVE {TICKS}, x AS (SELECT symbol, event_id, price AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS t FROM ticks),
 s AS (SELECT symbol, 0::BIGINT AS t, NULL::BIGINT AS event_id, [1e0] AS p, [50e0] AS mu, [500e0] AS beta, 0::BIGINT AS before, 0::BIGINT AS run_length FROM (SELECT DISTINCT symbol FROM ticks)
  UNION ALL
  SELECT symbol, t, event_id, list_transform(grown, lambda v: v / list_sum(grown)), list_concat([50e0], new_mu)[1:501], list_concat([500e0], new_beta)[1:501], run_length, list_position(grown, list_max(grown)) - 1
  FROM (SELECT *, list_concat([0.01e0 * list_sum(joint)], list_transform(joint, lambda v: v * 0.99e0))[1:501] AS grown FROM (
   SELECT s.symbol, x.t, x.event_id, s.run_length,
    list_transform(s.p, lambda v, r: v * exp(greatest(-700, least(0, lgamma(1 + r / 2e0) - lgamma((1 + r) / 2e0) - 0.5 * ln((1 + r) * pi()) - 0.5 * ln(s.beta[r] * (r + 1) / ((1 + r) / 2e0 * r))
      - (1 + r / 2e0) * ln(1 + (x.x - s.mu[r]) ** 2 / (s.beta[r] * (r + 1) / ((1 + r) / 2e0 * r)) / (1 + r)))))) AS joint,
    list_transform(s.mu, lambda m, r: m + (x.x - m) / (r + 1)) AS new_mu, list_transform(s.beta, lambda b, r: b + 0.5 * r / (r + 1) * (x.x - s.mu[r]) ** 2) AS new_beta
   FROM s JOIN x ON x.symbol = s.symbol AND x.t = s.t + 1)))
 SELECT event_id, symbol, {rnd("p[1]")} AS cp_prob, run_length, before - run_length > greatest(5, before * 0.5) AS changepoint FROM s WHERE t > 0"""


@query("reg_01_change_points", CHANGE_POINTS)
def _(t):
    out = reg.change_points(t.ticks, ["symbol"], ORD, "price", ["event_id"], hazard=0.01, mu0=50.0, beta0=500.0)
    return out.select("event_id", "symbol", rounded("cp_prob").alias("cp_prob"), "run_length", "changepoint")


@query("reg_02_hidden_regimes")
def _(t):
    r = checkpointed(win.log_return(t.ticks.select("symbol", *ORD, "price"), ["symbol"], ORD, "price", BLOCKS, "ret", first=0.0))
    r = win.rolling(r, ["symbol"], ORD, BLOCKS, 19, lambda d, w: d.withColumn("vol", win.std_population(w, "ret", 20)), rows=ROWS, keep_seq=True)
    out = reg.hidden_regimes(r, ["symbol"], ORD, "ret", "vol", ["event_id"], BLOCKS)
    return out.select("symbol", "event_id", "regime", rounded("confidence", 4).alias("confidence"))


REG = ("TRENDING_UP", "TRENDING_DOWN", "RANGING", "VOLATILE")
CLU = ("LOW", "MEDIUM", "HIGH")


def _pick(names, i):
    return F.element_at(F.array(*[F.lit(x) for x in names]), (i % len(names) + 1).cast("int"))


@query(
    "reg_03_regime_weight",
    f"""WITH {TICKS}, x AS (SELECT event_id, {list(REG)}[event_id % 4 + 1] AS r, {list(CLU)}[trader % 3 + 1] AS c, volume / 100 AS f FROM ticks)
 SELECT event_id, {rnd("greatest(0, least(1, CASE r WHEN 'RANGING' THEN 0.5e0 WHEN 'VOLATILE' THEN 0.3e0 ELSE 1e0 END * CASE c WHEN 'LOW' THEN 1e0 WHEN 'MEDIUM' THEN 0.8e0 ELSE 0.5e0 END * (0.5 + 0.5 * f)))")} AS w FROM x""",
)
def _(t):
    w = reg.regime_weight(_pick(REG, F.col("event_id")), _pick(CLU, F.col("trader")), F.col("volume") / 100)
    return t.ticks.select("event_id", rounded(w).alias("w"))


@query("reg_04_spectral_regime")
def _(t):
    out = reg.spectral_regime(_ret(t), ["symbol"], ORD, "ret", BLOCKS, n=128, rows=ROWS)
    return out.select("event_id", "symbol", *[rounded(c, 4).alias(c) for c in ("alpha", "confidence", "dominant_period")], "regime")


@query("reg_05_dominant_cycles")
def _(t):
    out = reg.dominant_cycles(t.ticks, ["symbol"], ORD, "price", BLOCKS, n=64, max_period=32.0, rows=ROWS)
    m = F.transform("modes", lambda x: F.struct(F.round(x["period"], 4).alias("period"), F.round(x["amplitude"], 4).alias("amplitude")))
    return out.select("event_id", F.to_json(m).alias("modes"), rounded("coherence", 4).alias("coherence"), "resonance")


@query(
    "reg_06_rolling_entropy",
    f"""WITH {TICKS}, a AS (SELECT event_id, list(price) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS l FROM ticks),
 w AS (SELECT event_id, l, list_min(l) AS lo, (list_max(l) - list_min(l)) / 20 AS wd FROM a),
 b AS (SELECT event_id, l, wd, list_transform(l, lambda v: least(19, CAST(floor((v - lo) / nullif(wd, 0)) AS INT))) AS bs FROM w),
 c AS (SELECT event_id, l, wd, list_transform(range(0, 20), lambda i: len(list_filter(bs, lambda z: z = i)) + 0.1e0) AS cs FROM b),
 e AS (SELECT event_id, CASE WHEN len(l) < 20 OR wd = 0 THEN 0 ELSE -list_sum(list_transform(cs, lambda x: x / (len(l) + 2e0) * log2(x / (len(l) + 2e0)))) END AS e FROM c)
 SELECT event_id, {rnd('e')} AS entropy, {rnd('e / log2(20)')} AS normalized, {rnd('CASE WHEN e / log2(20) > 0.8 THEN greatest(0, 1 - (e / log2(20) - 0.8) / 0.2 * 0.5) ELSE 1 END')} AS risk_multiplier FROM e""",
)
def _(t):
    out = reg.rolling_entropy(t.ticks, ["symbol"], ORD, "price", BLOCKS, rows=ROWS)
    return out.select("event_id", *[rounded(c).alias(c) for c in ("entropy", "normalized", "risk_multiplier")])


@query(
    "reg_07_mutual_information",
    f"""WITH {TICKS}, s AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) - 1) // 100 AS blk FROM ticks),
 r AS (SELECT symbol, blk, min(price) AS x0, max(price) AS x1, min(volume) AS y0, max(volume) AS y1, count(*) AS n FROM s GROUP BY 1, 2),
 b AS (SELECT s.symbol, s.blk, n, CASE WHEN x1 = x0 THEN 0 ELSE least(9, floor((price - x0) / ((x1 - x0) / 10))) END AS i, CASE WHEN y1 = y0 THEN 0 ELSE least(9, floor((volume - y0) / ((y1 - y0) / 10))) END AS j FROM s JOIN r USING (symbol, blk)),
 g AS (SELECT symbol, blk, i, j, max(n) AS n, count(*) AS c FROM b GROUP BY 1, 2, 3, 4), h AS (SELECT *, sum(c) OVER (PARTITION BY symbol, blk, i) AS cx, sum(c) OVER (PARTITION BY symbol, blk, j) AS cy FROM g)
 SELECT symbol, blk, max(n) AS n, {rnd('CASE WHEN max(n) < 20 THEN 0 ELSE greatest(0, sum(c / n * log2(c * n / (cx * cy)))) END')} AS mi FROM h GROUP BY 1, 2""",
)
def _(t):
    s = checkpointed(with_seq(t.ticks, ["symbol"], ORD, BLOCKS).select("symbol", "price", "volume", F.floor((F.col("seq") - 1) / 100).cast("long").alias("blk")))
    return reg.mutual_information(s, ["symbol", "blk"], "price", "volume").withColumn("mi", rounded("mi"))


VR = ("trending", "mean_reverting", "turbulent", "normal")


@query(
    "reg_08_detector_vote",
    f"""WITH {TICKS}, d AS (SELECT us // 3600000000 AS hour, {list(VR)}[CAST(volume AS INT) // 28 % 4 + 1] AS r, least(1, price / 80) AS c FROM ticks),
 g AS (SELECT hour, count(*) AS n, avg(c) AS ac, {', '.join(f"count(*) FILTER (r = '{v}') AS v{i}, coalesce(sum(c) FILTER (r = '{v}'), 0) AS w{i}" for i, v in enumerate(VR))} FROM d GROUP BY 1),
 a AS (SELECT *, greatest(v0, v1, v2, v3) / n AS ag, CASE WHEN w0 >= greatest(w1, w2, w3) THEN 'TRENDING' WHEN w1 >= greatest(w2, w3) THEN 'MEAN_REVERTING' WHEN w2 >= w3 THEN 'TURBULENT' ELSE 'TRANSITIONAL' END AS wi FROM g),
 k AS (SELECT *, ac * ag AS cf, CASE WHEN ag >= 0.75 THEN wi WHEN ag >= 0.5 THEN 'TRANSITIONAL' ELSE 'CONFLICT' END AS cs FROM a)
 SELECT hour, cs AS consensus, {rnd('ag')} AS agreement, {rnd('cf')} AS confidence, {rnd('CASE WHEN ag < 0.5 THEN 0.3 ELSE 0.5 + 0.5 * cf END')} AS risk_multiplier, ag >= 0.5 AND cf >= 0.3 AND cs <> 'CONFLICT' AS should_trade, v0 AS trending_votes, v1 AS reverting_votes, v2 AS turbulent_votes FROM k""",
)
def _(t):
    d = t.ticks.select(F.expr("us div 3600000000").alias("hour"), _pick(VR, F.floor(F.col("volume") / 28)).alias("regime"), F.least(F.lit(1.0), F.col("price") / 80).alias("confidence"))
    return reg.detector_vote(d, ["hour"]).withColumns({c: rounded(c) for c in ("agreement", "confidence", "risk_multiplier")})


SP = ("trending", "normal", "mean_reverting", "unknown")


@query(
    "reg_09_combined_regime",
    f"""WITH {TICKS}, x AS (SELECT event_id, {list(REG)}[event_id % 4 + 1] AS h, {list(SP)}[trader % 4 + 1] AS s, volume / 100 AS hw, least(1, price / 100) AS sc FROM ticks),
 a AS (SELECT *, CASE WHEN (h LIKE 'TRENDING%' AND s = 'trending') OR (h = 'RANGING' AND s = 'mean_reverting') THEN 1e0 WHEN s = 'normal' THEN 0.5e0 ELSE 0e0 END AS ag FROM x),
 w AS (SELECT *, hw * 0.6 + CASE s WHEN 'trending' THEN 1 WHEN 'normal' THEN 0.7 WHEN 'mean_reverting' THEN 0.5 ELSE 0.3 END * 0.4 * sc AS w FROM a)
 SELECT event_id, CASE WHEN s = 'unknown' THEN 'UNKNOWN' WHEN ag >= 0.9 THEN CASE WHEN s = 'trending' THEN 'STRONG_TREND' ELSE 'MEAN_REVERT' END WHEN s = 'trending' THEN 'WEAK_TREND' WHEN h = 'VOLATILE' THEN 'VOLATILE' ELSE 'MIXED' END AS regime,
  {rnd('greatest(0, least(1, CASE WHEN ag >= 0.9 THEN least(1, w + 0.2) ELSE w END))')} AS weight, ag AS agreement FROM w""",
)
def _(t):
    c = reg.combine_regimes(_pick(REG, F.col("event_id")), F.col("volume") / 100, _pick(SP, F.col("trader")), F.least(F.lit(1.0), F.col("price") / 100))
    return t.ticks.select("event_id", c.alias("c")).select("event_id", "c.regime", rounded("c.weight").alias("weight"), "c.agreement")


@query(
    "reg_11_digital_roots",
    f"""WITH {TICKS}, r AS (SELECT symbol, CASE WHEN CAST(floor(price) AS BIGINT) > 0 THEN 1 + (CAST(floor(price) AS BIGINT) - 1) % 9 ELSE 0 END AS root FROM ticks WHERE price > 0),
 g AS (SELECT symbol, root, count(*) AS n FROM r GROUP BY 1, 2), t AS (SELECT symbol, sum(n) AS t, sum(n) FILTER (root IN (1, 2, 4, 8, 7, 5)) AS v, sum(n) FILTER (root IN (3, 6, 9)) AS r3 FROM g GROUP BY 1)
 SELECT g.symbol, root, n, {rnd('v / t')} AS vortex_ratio, {rnd('r3 / t')} AS trinity_ratio FROM g JOIN t ON g.symbol = t.symbol""",
)
def _(t):
    return reg.digital_roots(t.ticks, ["symbol"], "price").withColumns({c: rounded(c) for c in ("vortex_ratio", "trinity_ratio")})


@query("ml_10_volatility_clusters")
def _(t):
    r = checkpointed(_ret(t))
    v = win.rolling(r, ["symbol"], ORD, BLOCKS, 19, lambda d, w: d.withColumn("vol", win.std_sample(w, "ret", 20)), rows=ROWS).where("vol is not null")
    return reg.volatility_clusters(checkpointed(v.select("event_id", "symbol", "vol")), "vol").select("event_id", "symbol", rounded("vol").alias("vol"), "cluster")
