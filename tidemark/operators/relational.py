"""History lookups, window filters, ranking, sampling and label bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import micros, value_blocks, with_seq


def history(
    df: DataFrame,
    symbol: str,
    start: str,
    end: str,
    ts: str = "timestamp",
    venue: str | None = None,
    side: str | None = None,
    min_value: float | None = None,
    limit: int | None = None,
    partition: str | None = None,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Rows of one symbol from ``start`` up to and including midnight after ``end``, oldest first.

    ``partition`` names a day partition column: the same bounds are put on it so that whole folders
    are skipped. ``tie`` columns order equal times, which makes a ``limit`` repeatable.
    """
    lo = F.lit(start).cast("timestamp")
    hi = F.lit(end).cast("timestamp") + F.expr("interval 1 day")
    out = df.where((F.col("symbol") == symbol) & (F.col(ts) >= lo) & (F.col(ts) <= hi))
    if partition:
        out = out.where(F.col(partition).between(F.to_date(lo), F.to_date(hi)))
    if venue is not None:
        out = out.where(F.col("venue") == venue)
    if side is not None:
        out = out.where(F.col("side") == side)
    if min_value is not None:
        out = out.where(F.col("value") >= min_value)
    out = out.withColumn("epoch_ms", F.unix_millis(ts)).orderBy(ts, *tie)
    return out.limit(limit) if limit else out


def newest(df: DataFrame, ts: str) -> Column:
    """The latest timestamp of a table as a scalar subquery (the explicit ``as_of``)."""
    return df.agg(F.max(ts).alias("m")).select("m").scalar()


def within(df: DataFrame, ts: str, as_of: Column, interval: str) -> DataFrame:
    """Rows strictly newer than ``as_of - interval``."""
    return df.where(F.col(ts) > as_of - F.expr(f"interval {interval}"))


def like(df: DataFrame, **patterns: str) -> DataFrame:
    for c, p in patterns.items():
        df = df.where(F.col(c).like(p))
    return df


def time_range(df: DataFrame, ts: str, start, end, event_type: str | None = None, source: str | None = None, limit: int = 10_000, tie: Sequence[str] = ()) -> DataFrame:
    """Audit log slice, both ends inclusive, oldest first; ``tie`` columns order equal times."""
    out = df.where(F.col(ts).between(start, end))
    if event_type is not None:
        out = out.where(F.col("event_type") == event_type)
    if source is not None:
        out = out.where(F.col("source") == source)
    return out.orderBy(ts, *tie).limit(limit)


def parameter_history(df: DataFrame, ts: str, param: str | None = None) -> DataFrame:
    out = df.where(F.col("event_type").startswith("param."))
    if param is not None:
        out = out.where(F.col("param_name") == param)
    return out.orderBy(ts)


def incident_windows(events: DataFrame, ts: str, incidents: DataFrame, incident_id: str, incident_ts: str, around: str) -> DataFrame:
    """All events within ``around`` of each incident, both ends inclusive.

    A range join turned into an equi join: time is cut into ``around``-wide buckets, so an incident
    meets only its own bucket and the two beside it.
    """
    w = micros(around)
    ev = events.withColumn("_b", F.floor(F.unix_micros(ts) / F.lit(w)).cast("long"))
    center = F.floor(F.unix_micros(incident_ts) / F.lit(w)).cast("long")
    inc = incidents.select(incident_id, F.col(incident_ts).alias("_its"), F.explode(F.array(center - 1, center, center + 1)).alias("_b"))
    hit = F.abs(F.unix_micros(ts) - F.unix_micros("_its")) <= F.lit(w)
    return ev.join(inc, "_b").where(hit).drop("_b", "_its")


def top_k(df: DataFrame, metric: str, k: int, tie: str, keys: Sequence[str] = ()) -> DataFrame:
    """Best k rows by a non-null metric, overall or per group.

    Overall it is a TakeOrderedAndProject; per group Spark limits each partition to k rows of every
    group before the shuffle, so a hot group sends k rows per task.
    """
    rows = df.where(F.col(metric).isNotNull())
    if not keys:
        return rows.orderBy(F.desc(metric), F.asc(tie)).limit(k)
    w = Window.partitionBy(*keys).orderBy(F.desc(metric), F.asc(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked(df: DataFrame, score: Column, tie: str, width: float, keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Rank by descending score without one task seeing a whole group: blocks of rows along the score."""
    src = df.withColumn("_neg", -score)
    out = with_seq(src, keys, ["_neg", tie], value_blocks(F.col("_neg"), width), name)
    return out.drop("_neg")


def elite_cut(df: DataFrame, metric: str, tie: str, width: float, share: float = 0.1, keys: Sequence[str] = ()) -> DataFrame:
    """Top ``max(1, int(share * n))`` rows by metric."""
    rows = df.where(F.col(metric).isNotNull())
    ranks = ranked(rows, F.col(metric), tie, width, keys)
    if keys:
        n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
        ranks = ranks.join(n, list(keys))
    else:
        ranks = ranks.withColumn("_n", rows.agg(F.count("*").alias("n")).select("n").scalar())
    return ranks.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(share)))).drop("_n")


def hash_uniform(*cols: Column) -> Column:
    """Repeatable uniform number in (0, 1) from column values (first 13 hex digits, 52 bits, of an MD5)."""
    digest = F.md5(F.concat_ws(":", *cols))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(4503599627370496.0)


def prune_population(df: DataFrame, metric: str, tie: str, population: int, protect: int, seed: int = 0) -> DataFrame:
    """Rows that survive pruning to ``population``: the top ``protect`` always, others by seeded hash."""
    elite = top_k(df, metric, protect, tie).select(F.col(tie))
    kept = df.join(elite, tie, "left_semi")
    rest = df.join(elite, tie, "left_anti")
    u = hash_uniform(F.lit(str(seed)), F.col(tie).cast("string"))
    order = with_seq(rest.withColumn("_u", u), [], ["_u", tie], value_blocks(F.col("_u"), 0.001), "_r")
    total = df.agg(F.count("*").alias("n")).select("n").scalar()
    n_rest = rest.agg(F.count("*").alias("n")).select("n").scalar()
    excess = F.least(F.greatest(total - F.lit(population), F.lit(0)), n_rest)
    return kept.unionByName(order.where(F.col("_r") > excess).drop("_u", "_r"))


def weighted_sample(df: DataFrame, weight: str, tie: str, k: int, seed: int = 0) -> DataFrame:
    """k rows without replacement, chance proportional to max(0, weight); uniform if all are 0."""
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))
    total = df.agg(F.sum(w).alias("s")).select("s").scalar()
    eff = F.when(total == 0, F.lit(1.0)).otherwise(w)
    key = F.log(hash_uniform(F.lit(str(seed)), F.col(tie).cast("string"))) / F.nullif(eff, F.lit(0.0))
    return df.withColumn("_key", key).where(F.col("_key").isNotNull()).orderBy(F.desc("_key"), F.asc(tie)).limit(k).drop("_key")


def scalar_ratio(numerator: DataFrame, denominator: DataFrame, name: str = "ratio") -> DataFrame:
    """count(numerator) / nullif(count(denominator), 0) as one row."""
    d = denominator.agg(F.count("*").alias("d")).select("d").scalar()
    return numerator.agg(F.count("*").alias("n")).select((F.col("n") / F.nullif(d, F.lit(0))).alias(name))


def exposure(positions: DataFrame, notional: str, balances: DataFrame, balance: str, order: Sequence[str]) -> DataFrame:
    """Total and largest |notional| in percent of the newest balance."""
    latest = balances.agg(F.max_by(balance, F.struct(*order)).alias("b")).select("b").scalar()
    pct = F.abs(F.col(notional)) / F.nullif(latest, F.lit(0.0)) * 100
    return positions.agg(F.sum(pct).alias("exposure_pct"), F.max(pct).alias("max_position_pct"))


def band(value: Column, low: float, high: float, labels: Sequence[str] = ("LOW", "MEDIUM", "HIGH")) -> Column:
    """Two-threshold label: below ``low``, below ``high``, else."""
    return F.when(value < low, labels[0]).when(value < high, labels[1]).otherwise(labels[2])
