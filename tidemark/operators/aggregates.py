"""Rates, percentiles, profiles and quality votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import running, value_blocks


def count_by(df: DataFrame, key: str, **flags: Column) -> DataFrame:
    """Rows per key, most frequent first, with optional conditional counts."""
    return df.groupBy(key).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()]).orderBy(F.desc("n"), key)


def rate(condition: Column, percent: bool = True) -> Column:
    """Share of rows meeting a condition."""
    return F.count_if(condition) * F.lit(100.0 if percent else 1.0) / F.nullif(F.count("*"), F.lit(0))


def guarded(df: DataFrame, keys: Sequence[str], min_rows: int, *aggs: Column) -> DataFrame:
    """Aggregates only for groups with at least ``min_rows`` rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *aggs).where(F.col("n") >= min_rows)


def counter_span(counter: str, name: str) -> Column:
    """max - min of a counter. Ignores resets; ``windows.counter_delta(reset_aware=True)`` does not."""
    return (F.max(counter) - F.min(counter)).alias(name)


def exact_percentiles(df: DataFrame, keys: Sequence[str], col: str, qs: dict[str, float], width: float) -> DataFrame:
    """Interpolated percentiles, exact, for groups of any size.

    Equal values collapse to one counted row first (map-side), blocks of such rows
    along the value carry a running count, and each wanted order statistic is then a plain conditional maximum. No task
    holds a group, unlike the built-in exact percentile.
    """
    v = F.col(col)
    freq = df.where(v.isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("_c"))
    cum = running(freq, keys, [col], value_blocks(v, width), {"_cum": ("sum", F.col("_c"))})
    if keys:
        n = df.where(v.isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
        cum = cum.join(n, list(keys))
    else:
        cum = cum.withColumn("_n", df.agg(F.count(col).alias("n")).select("n").scalar())

    def stat(rank: Column) -> Column:
        return F.max(F.when((F.col("_cum") - F.col("_c") <= rank) & (rank < F.col("_cum")), v))

    aggs = []
    for name, q in qs.items():
        pos = F.lit(q) * (F.col("_n") - 1)
        aggs += [stat(F.floor(pos)).alias(f"_lo_{name}"), stat(F.ceil(pos)).alias(f"_hi_{name}"), F.max(pos - F.floor(pos)).alias(f"_f_{name}")]
    out = cum.groupBy(*keys).agg(F.max("_n").alias("n"), *aggs)
    return out.select(*keys, "n", *[(F.col(f"_lo_{m}") + (F.col(f"_hi_{m}") - F.col(f"_lo_{m}")) * F.col(f"_f_{m}")).alias(m) for m in qs])


def quality_profile(df: DataFrame) -> DataFrame:
    """One row: record count, % null cells, % exact duplicate rows, range of the first time column."""
    cols = df.columns
    stamps = [c for c in cols if any(k in c.lower() for k in ("time", "date", "ts"))]
    nulls = sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0))
    span = [F.min(stamps[0]).cast("string").alias("range_start"), F.max(stamps[0]).cast("string").alias("range_end")] if stamps else []
    base = df.agg(F.count("*").alias("record_count"), nulls.alias("_nulls"), *span)
    uniq = df.groupBy(*cols).agg(F.count("*").alias("_c")).agg(F.count("*").alias("u")).select("u").scalar()
    n = F.nullif("record_count", F.lit(0))
    return base.withColumn("_u", uniq).select(
        "record_count",
        F.coalesce(F.col("_nulls") / (n * len(cols)) * 100, F.lit(0.0)).alias("missing_pct"),
        F.coalesce((F.col("record_count") - F.col("_u")) / n * 100, F.lit(0.0)).alias("duplicates_pct"),
        *([F.col("range_start"), F.col("range_end")] if stamps else []),
    )


# Default data-quality limits and confidence thresholds.
MIN_RECORDS, MAX_MISSING_PCT, MAX_DUPLICATES_PCT = 100, 5.0, 1.0
HIGH, MEDIUM, LOW, AGREE_HIGH, AGREE_MEDIUM = 0.85, 0.65, 0.40, 0.9, 0.7


def quality_checks(profile: DataFrame, source: str, min_records: int = MIN_RECORDS, max_missing: float = MAX_MISSING_PCT, max_dup: float = MAX_DUPLICATES_PCT) -> DataFrame:
    """Long table of checks: (source, check, passed, score)."""
    n, miss, dup = F.col("record_count"), F.col("missing_pct"), F.col("duplicates_pct")

    def check(name: str, passed: Column, score: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), passed.alias("passed"), score.cast("double").alias("score"))

    checks = F.array(
        check("record_count", n >= min_records, F.least(F.lit(1.0), n / F.lit(min_records)) if min_records > 0 else F.lit(1.0)),
        check("data_source", F.lit(True), F.lit(1.0)),
        check("missing_values", miss <= max_missing, F.greatest(F.lit(0.0), 1 - miss / F.lit(max_missing)) if max_missing > 0 else F.lit(1.0)),
        check("duplicates", dup <= max_dup, F.greatest(F.lit(0.0), 1 - dup / F.lit(max_dup)) if max_dup > 0 else F.lit(1.0)),
    )
    return profile.select(F.lit(source).alias("source"), F.explode(checks).alias("_c")).select("source", "_c.*")


def confidence_vote(checks: DataFrame, keys: Sequence[str], passed: str = "passed", score: str = "score") -> DataFrame:
    """Verdict per group from mean score and majority rate; conflict when both sides score high."""
    ok = F.col(passed)
    g = checks.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(ok).alias("_p"),
        F.avg(score).alias("mean_score"),
        F.avg(F.when(ok, F.col(score))).alias("_sp"),
        F.avg(F.when(~ok, F.col(score))).alias("_sf"),
    )
    agreement = F.when(F.col("n") <= 1, 1.0).otherwise(F.greatest(F.col("_p"), F.col("n") - F.col("_p")) / F.col("n"))
    s = F.col("mean_score")
    verdict = (
        F.when(s.isNull(), "UNSOLVABLE")
        .when((F.col("n") > 1) & (F.col("_sp") >= MEDIUM) & (F.col("_sf") >= MEDIUM), "CONFLICT")
        .when((s >= HIGH) & (agreement >= AGREE_HIGH), "HIGH_CONFIDENCE")
        .when((s >= MEDIUM) & (agreement >= AGREE_MEDIUM), "MEDIUM_CONFIDENCE")
        .when(s >= LOW, "LOW_CONFIDENCE")
        .otherwise("UNSOLVABLE")
    )
    return g.select(*keys, "n", "mean_score", agreement.alias("agreement"), verdict.alias("confidence"))


def quantile_buckets(df: DataFrame, by: str, value: str, width: float, n: int = 4) -> DataFrame:
    """Mean, sample std and count of ``value`` per quantile bucket of ``by`` (right-closed bounds)."""
    qs = {f"q{i}": i / n for i in range(1, n)}
    cuts = exact_percentiles(df, [], by, qs, width)
    cut = cuts.select(F.struct(*qs).alias("q")).select("q").scalar()
    bounds = [cut[k] for k in qs]
    bucket = F.lit(1)
    for b in bounds:
        bucket = bucket + F.when(F.col(by) > b, 1).otherwise(0)
    return df.where(F.col(by).isNotNull()).groupBy(bucket.alias("bucket")).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n")
    )


def bucket_trend(buckets: DataFrame, n: int = 4) -> DataFrame:
    """Is the mean non-decreasing over the (at most n) buckets, and the last-to-first ratio."""
    means = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "mean"))), lambda s: s["mean"])
    one = buckets.agg(means.alias("m"))
    steps = F.zip_with(F.slice("m", 1, n - 1), F.slice("m", 2, n - 1), lambda a, b: (b >= a) | b.isNull())
    return one.select(F.forall(steps, lambda x: x).alias("monotonic"), (F.element_at("m", -1) / F.element_at("m", 1)).alias("ratio"))


def version_statistics(events: DataFrame, entity: str = "entity_id", created: str = "created_at") -> dict[str, DataFrame]:
    """Totals, events per type, ten most modified entities, thirty newest days."""
    known = events.where(F.col(entity).isNotNull())
    return {
        "totals": events.agg(F.count("*").alias("total_events"), F.countDistinct(entity).alias("unique_entities")),
        "by_type": count_by(events, "event_type"),
        "most_modified": known.groupBy(entity).agg(F.count("*").alias("versions")).where("versions > 1").orderBy(F.desc("versions"), entity).limit(10),
        "timeline": events.where(F.col(created).isNotNull()).groupBy(F.to_date(created).alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(30),
    }
