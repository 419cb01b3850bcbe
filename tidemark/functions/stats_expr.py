"""Normal and t distribution helpers as column expressions."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the normal tail (double precision), highest power first.
HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
HART_SPLIT, ROOT_2PI = 7.07106781186547, 2.506628274631
# Abramowitz and Stegun 26.2.23 for the normal quantile.
AS_TOP, AS_BOTTOM = (0.010328, 0.802853, 2.515517), (0.001308, 0.189269, 1.432788, 1.0)


def _poly(coef, x):
    return reduce(lambda acc, c: acc * x + c, coef[1:], F.lit(coef[0]))


def norm_cdf(z: Column) -> Column:
    """Standard normal CDF, about 15 digits."""
    x = F.abs(z)
    e = F.exp(-x * x / 2)
    near = e * _poly(HART_TOP, x) / _poly(HART_BOTTOM, x)
    frac = x + 0.65
    for k in (4, 3, 2, 1):
        frac = x + F.lit(float(k)) / frac
    tail = F.when(x > 37, 0.0).when(x < HART_SPLIT, near).otherwise(e / frac / ROOT_2PI)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def norm_cdf_sql(z: str) -> str:
    """The same formula as SQL text (``z`` should be a plain column)."""
    x = f"abs({z})"

    def poly(coef):
        out = f"{coef[0]:.15e}"
        for c in coef[1:]:
            out = f"({out} * {x} + {c:.15e})"
        return out

    frac = f"({x} + 0.65e0)"
    for k in (4, 3, 2, 1):
        frac = f"({x} + {k}e0 / {frac})"
    tail = f"(CASE WHEN {x} > 37 THEN 0e0 WHEN {x} < {HART_SPLIT:.15e} THEN exp(-{x} * {x} / 2) * {poly(HART_TOP)} / {poly(HART_BOTTOM)} ELSE exp(-{x} * {x} / 2) / {frac} / {ROOT_2PI:.15e} END)"
    return f"(CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END)"


def norm_ppf(p: Column) -> Column:
    """Normal quantile, about 3 digits; infinite at 0 and 1."""
    q = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(F.when((q > 0) & (q < 1), q)))
    x = t - _poly(AS_TOP, t) / _poly(AS_BOTTOM, t)
    mid = F.abs(p - 0.5) < 1e-10
    inf = F.lit(float("inf"))
    return F.when(p <= 0, -inf).when(p >= 1, inf).when(mid, 0.0).when(p > 0.5, x).otherwise(-x)


def z_value(confidence: float) -> float:
    """Exact quantile of a fixed confidence level."""
    return NormalDist().inv_cdf(confidence)


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value: normal tail, with t damped by 1 + 3/df below 30 degrees of freedom."""
    z = F.when(df >= 30, F.abs(t)).otherwise(F.abs(t) / (1 + 3 / F.when(df > 0, df)))
    return F.when(df <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * (1 - norm_cdf(z)))))
