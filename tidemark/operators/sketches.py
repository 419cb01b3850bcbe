"""Roll-ups from mergeable sketches: one pass keeps a small row per fine group, coarser answers read these rows alone.

Distinct counts are HyperLogLog sketches and quantiles are KLL sketches; both merge without loss, so an hour's row serves
days, keys and totals alike, and late hours are added without reading the earlier rows again. Sketching is a partial
aggregate (map-side), so a hot group costs one small row a task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base-two logarithm of the registers of a distinct sketch, and the size of a quantile sketch.
LG_K, K = 12, 400


def distinct_error(lg_k: int = LG_K, deviations: float = 4.0) -> float:
    """Relative error of a distinct count that is passed about once in 16,000 at four deviations."""
    return deviations * 1.04 / math.sqrt(2**lg_k)


def rank_error(k: int = K) -> float:
    """Error of a quantile's rank, as a share of the rows (four times the mean error of a sketch of this size)."""
    return 4 * 0.6 / k


def sketch(df: DataFrame, keys: Sequence[str | Column], distinct: Sequence[str] = (), quantile: Sequence[str] = (), lg_k: int = LG_K, k: int = K) -> DataFrame:
    """(keys, n, hll_<column>..., kll_<column>...), one row per group.

    Nulls, and in quantiles NaN, are not counted; rows with a null key form a group of their own. ``n`` counts all rows.
    """
    hll = [F.hll_sketch_agg(F.col(c), F.lit(lg_k)).alias(f"hll_{c}") for c in distinct]
    kll = [F.kll_sketch_agg_double(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(k)).alias(f"kll_{c}") for c in quantile]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *hll, *kll)


def merge(sketches: DataFrame, keys: Sequence[str | Column] = ()) -> DataFrame:
    """The same columns for coarser groups, from the sketches alone."""
    aggs = [F.coalesce(F.sum("n"), F.lit(0)).alias("n")]
    for c in sketches.columns:
        if c.startswith("hll_"):
            aggs.append(F.hll_union_agg(c).alias(c))
        elif c.startswith("kll_"):
            aggs.append(F.kll_merge_agg_double(c).alias(c))
    return sketches.groupBy(*keys).agg(*aggs)


def answers(sketches: DataFrame, quantiles: Mapping[str, float] | None = None) -> DataFrame:
    """(other columns, distinct_<column>..., <column>_<name>...): estimates read off each row's sketches.

    A group without any value has 0 distinct ones and null quantiles.
    """
    out: list[Column] = []
    for c in sketches.columns:
        if c.startswith("hll_"):
            out.append(F.coalesce(F.hll_sketch_estimate(c), F.lit(0)).alias(f"distinct_{c[4:]}"))
        elif c.startswith("kll_"):
            some = F.kll_sketch_get_n_double(c) > 0
            out += [F.when(some, F.kll_sketch_get_quantile_double(F.col(c), F.lit(q))).alias(f"{c[4:]}_{name}") for name, q in (quantiles or {}).items()]
        else:
            out.append(F.col(c))
    return sketches.select(*out)


def within_bounds(df: DataFrame, estimates: DataFrame, keys: Sequence[str], distinct: Sequence[str], quantile: Sequence[str], quantiles: Mapping[str, float], lg_k: int = LG_K, k: int = K) -> DataFrame:
    """(keys, n, <column> exact distinct, distinct_ok, quantiles_ok): the estimates of each group held against its rows.

    A quantile is right when the share of rows below it and the share up to it hold its rank between them, give or take
    the rank error. Two aggregates over the rows, which meet one row of estimates per group; null keys are left out.
    """
    exact = df.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.countDistinct(c).alias(f"exact_{c}") for c in distinct])
    near = [F.abs(F.col(f"distinct_{c}") - F.col(f"exact_{c}")) <= F.greatest(F.lit(1.0), distinct_error(lg_k) * F.col(f"exact_{c}")) for c in distinct]
    ranks = [
        (F.count_if(F.col(c) < F.col(f"{c}_{name}")) <= (q + rank_error(k)) * F.count(c)) & (F.count_if(F.col(c) <= F.col(f"{c}_{name}")) >= (q - rank_error(k)) * F.count(c))
        for c in quantile
        for name, q in quantiles.items()
    ]
    wanted = estimates.select(*keys, *[f"{c}_{name}" for c in quantile for name in quantiles])
    right = df.join(wanted, list(keys)).groupBy(*keys).agg(_all(ranks).alias("quantiles_ok"))
    out = exact.join(estimates.select(*keys, *[f"distinct_{c}" for c in distinct]), list(keys)).join(right, list(keys))
    return out.select(*keys, F.col("rows").alias("n"), *[f"exact_{c}" for c in distinct], _all(near).alias("distinct_ok"), "quantiles_ok")


def _all(tests: Sequence[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out
