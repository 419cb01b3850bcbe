"""Change points, hidden regimes, spectra, information measures and their votes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import running
from .changepoint import RunLength, _ChangeSweep, change_points  # noqa: F401 (part of this module's interface)
from .hidden import REGIMES, hidden_regimes, name_states  # noqa: F401
from .frames import strided
from .windows import ROWS


def regime_weight(regime: Column, cluster: Column, confidence: Column) -> Column:
    """Base weight by regime x volatility adjustment x (0.5 + 0.5 confidence), within 0..1."""
    # Base weights and volatility adjustments.
    base = F.when(regime.isin("TRENDING_UP", "TRENDING_DOWN"), 1.0).when(regime == "RANGING", 0.5).when(regime == "VOLATILE", 0.3).otherwise(0.5)
    adj = F.when(cluster == "LOW", 1.0).when(cluster == "MEDIUM", 0.8).when(cluster == "HIGH", 0.5).otherwise(0.8)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * adj * (0.5 + 0.5 * confidence)))


def volatility_clusters(df: DataFrame, vol: str, k: int = 3, seed: int = 42) -> DataFrame:
    """Gaussian-mixture cluster of each row named by the rank of its mean volatility."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    asm = VectorAssembler(inputCols=[vol], outputCol="_v", handleInvalid="skip")
    model = Pipeline(stages=[asm, GaussianMixture(k=k, featuresCol="_v", predictionCol="_c", probabilityCol="_p", seed=seed)]).fit(df)
    means = [g.mean[0] for g in model.stages[-1].gaussians]
    rank = {c: r for r, c in enumerate(sorted(range(k), key=lambda i: means[i]))}

    def name(r: int) -> str:
        if k == 2:
            return "LOW" if r == 0 else "HIGH"
        return "LOW" if r < k / 3 else "MEDIUM" if r < 2 * k / 3 else "HIGH"

    table = F.create_map(*[x for c in range(k) for x in (F.lit(c), F.lit(name(rank[c])))])
    return model.transform(df).withColumn("cluster", F.try_element_at(table, F.col("_c"))).drop("_v", "_c", "_p")


def held(df, keys, order, block, cols: Sequence[str], hop: int) -> DataFrame:
    """Values computed on every ``hop``-th row, held until the next one."""
    return df if hop == 1 else running(df, keys, order, block, {c: ("last", F.col(c)) for c in cols})


def welch(x: np.ndarray, nperseg: int) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density of each row: Hann window, constant detrend, half overlap."""
    step = nperseg - nperseg // 2
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    segs = np.stack([x[:, s : s + nperseg] for s in range(0, x.shape[1] - nperseg + 1, step)], axis=1)
    segs = (segs - segs.mean(2, keepdims=True)) * win
    psd = (np.abs(np.fft.rfft(segs)) ** 2 / (win**2).sum()).mean(1)
    psd[:, 1 : None if nperseg % 2 else -1] *= 2
    return np.fft.rfftfreq(nperseg), psd


def spectral_regime(df, keys, order, col: str, block, n: int = 256, min_rows: int = 64, hop: int = 1, rows: int = ROWS) -> DataFrame:
    """PSD slope of the last ``n`` values on every row: alpha, R squared, dominant period and regime.

    Analysed anew every ``hop`` rows and held in between; unknown (and null) before ``min_rows`` values.
    """

    def slope(x: np.ndarray) -> list[np.ndarray]:
        f, psd = welch(x, min(x.shape[1], 64))
        f, psd = f[1:], psd[:, 1:]
        lf, lp = np.log10(f), np.log10(psd + 1e-10)
        dx = lf - lf.mean()
        b = (lp - lp.mean(1, keepdims=True)) @ dx / (dx @ dx)
        fit = lp.mean(1, keepdims=True) + b[:, None] * dx
        tot = ((lp - lp.mean(1, keepdims=True)) ** 2).sum(1)
        r2 = np.where(tot > 0, 1 - ((lp - fit) ** 2).sum(1) / np.where(tot > 0, tot, 1), 0.0)
        return [-b, np.maximum(r2, 0), 1 / f[psd.argmax(1)]]

    out = strided(df, keys, order, block, col, n, slope, "alpha double, confidence double, dominant_period double", min_rows, hop, rows)
    cols = ("alpha", "confidence", "dominant_period")
    out = held(out, keys, order, block, cols, hop)
    unknown = F.col("alpha").isNull()
    return out.withColumn("regime", F.when(unknown, "unknown").when(F.col("alpha") < 0.5, "mean_reverting").when(F.col("alpha") < 1.5, "normal").otherwise("trending"))


def dominant_cycles(df, keys, order, col: str, block, n: int = 256, min_period: float = 4.0, max_period: float = 128.0, top: int = 3, hop: int = 1, rows: int = ROWS) -> DataFrame:
    """Strongest cycles of the last ``n`` values (array of period, amplitude, phase) and their coherence,
    on every row; analysed anew every ``hop`` rows and held in between, null before ``n`` values."""

    def cycles(x: np.ndarray) -> list:
        m = x.shape[1]
        trend = x[:, :1] + (x[:, -1:] - x[:, :1]) * np.linspace(0, 1, m)
        spec = np.fft.rfft((x - trend) * np.hanning(m))[:, 1:]
        period = 1 / np.fft.rfftfreq(m)[1:]
        ok = np.flatnonzero((period >= min_period) & (period <= max_period))
        amp, ph = np.abs(spec[:, ok]) / m, np.angle(spec[:, ok])
        best = np.argsort(-amp, axis=1, kind="stable")[:, :top]
        modes = [[{"period": period[ok[j]], "amplitude": amp[i, j], "phase": ph[i, j]} for j in row] for i, row in enumerate(best)]
        together = np.take_along_axis(ph, best, axis=1)
        return [modes, np.abs(np.exp(1j * together).mean(1)) if best.shape[1] >= 2 else np.zeros(len(x))]

    ddl = "modes array<struct<period:double,amplitude:double,phase:double>>, coherence double"
    out = held(strided(df, keys, order, block, col, n, cycles, ddl, n, hop, rows), keys, order, block, ("modes", "coherence"), hop)
    return out.withColumn("resonance", F.col("coherence") > 0.7)


def rolling_entropy(df, keys, order, col: str, block, n: int = 100, bins: int = 20, smoothing: float = 0.1, high: float = 0.8, penalty: float = 0.5, rows: int = ROWS) -> DataFrame:
    """Shannon entropy (bits) of the last ``n`` values over equal-width bins, with the risk multiplier.

    0 until ``bins`` values have been seen and for constant frames.
    """

    def entropy(x: np.ndarray) -> list[np.ndarray]:
        lo, width = x.min(1, keepdims=True), (x.max(1, keepdims=True) - x.min(1, keepdims=True)) / bins
        live = (width > 0)[:, 0] & (x.shape[1] >= bins)
        b = np.minimum(((x - lo) / np.where(width > 0, width, 1)).astype(int), bins - 1)
        flat = b + bins * np.arange(len(x))[:, None]
        cnt = np.bincount(flat.ravel(), minlength=bins * len(x)).reshape(len(x), bins) + smoothing
        p = cnt / cnt.sum(1, keepdims=True)
        return [np.where(live, -(p * np.log2(np.where(p > 0, p, 1))).sum(1), 0.0)]

    out = strided(df, keys, order, block, col, n, entropy, "entropy double", rows=rows)
    norm = F.col("entropy") / math.log2(bins)
    mult = F.when(norm > high, F.greatest(F.lit(0.0), 1 - (norm - high) / (1 - high) * penalty)).otherwise(1.0)
    return out.withColumns({"normalized": norm, "risk_multiplier": mult})


def mutual_information(df: DataFrame, keys: Sequence[str], x: str, y: str, bins: int = 10) -> DataFrame:
    """Mutual information (bits) per group over equal-width bins; 0 for constant or tiny groups.

    Bin counts collapse map-side to at most bins x bins rows per group, so group size does not matter.
    """
    rng = df.groupBy(*keys).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"), F.count("*").alias("_n"))
    j = df.join(rng, list(keys))

    def bin_of(c: str, lo: str, hi: str) -> Column:
        width = (F.col(hi) - F.col(lo)) / bins
        return F.when(F.col(hi) == F.col(lo), 0).otherwise(F.least(F.floor((F.col(c) - F.col(lo)) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).cast("int")

    joint = j.groupBy(*keys, bin_of(x, "_x0", "_x1").alias("_i"), bin_of(y, "_y0", "_y1").alias("_j")).agg(F.count("*").alias("_c"))
    mx = joint.groupBy(*keys, "_i").agg(F.sum("_c").alias("_cx"))
    my = joint.groupBy(*keys, "_j").agg(F.sum("_c").alias("_cy"))
    full = joint.join(mx, [*keys, "_i"]).join(my, [*keys, "_j"]).join(rng.select(*keys, "_n"), list(keys))
    term = F.col("_c") / F.col("_n") * F.log2(F.col("_c") * F.col("_n") / (F.col("_cx") * F.col("_cy")))
    g = full.groupBy(*keys).agg(F.max("_n").alias("n"), F.greatest(F.lit(0.0), F.sum(term)).alias("_mi"))
    return g.select(*keys, "n", F.when(F.col("n") < bins * 2, 0.0).otherwise(F.col("_mi")).alias("mi"))


VOTES = ("trending", "mean_reverting", "turbulent", "transitional", "normal", "unknown")


def detector_vote(df: DataFrame, keys: Sequence[str], regime="regime", confidence="confidence", min_agreement: float = 0.5, penalty: float = 0.3) -> DataFrame:
    """Consensus of several detectors per group from a long (detector, regime, confidence) table."""
    r = F.lower(F.col(regime))
    g = df.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.avg(confidence).alias("_conf"),
        *[F.count_if(r == v).alias(f"_v{i}") for i, v in enumerate(VOTES)],
        *[F.coalesce(F.sum(F.when(r == v, F.col(confidence))), F.lit(0.0)).alias(f"_w{i}") for i, v in enumerate(VOTES)],
    )
    best = F.greatest(*[F.col(f"_w{i}") for i in range(len(VOTES))])
    winner = F.coalesce(*[F.when(F.col(f"_w{i}") == best, v) for i, v in enumerate(VOTES)])
    agreement = F.greatest(*[F.col(f"_v{i}") for i in range(len(VOTES))]) / F.col("_n")
    out = g.withColumns({"winner": winner, "agreement": agreement})
    out = out.withColumn("confidence", F.col("_conf") * F.col("agreement"))
    strong = F.when(F.col("winner").isin("trending", "mean_reverting", "turbulent"), F.upper("winner")).otherwise("TRANSITIONAL")
    consensus = F.when(F.col("agreement") >= 0.75, strong).when(F.col("agreement") >= 0.5, "TRANSITIONAL").otherwise("CONFLICT")
    out = out.withColumn("consensus", consensus)
    agreed = F.col("agreement") >= min_agreement
    return out.select(
        *keys,
        "consensus",
        "agreement",
        "confidence",
        F.when(agreed, 0.5 + 0.5 * F.col("confidence")).otherwise(F.lit(penalty)).alias("risk_multiplier"),
        (agreed & (F.col("confidence") >= 0.3) & (F.col("consensus") != "CONFLICT")).alias("should_trade"),
        F.col("_v0").alias("trending_votes"),
        F.col("_v1").alias("reverting_votes"),
        F.col("_v2").alias("turbulent_votes"),
    )


def combine_regimes(hidden: Column, hidden_weight: Column, spectral: Column, spectral_confidence: Column, spectral_weight: float = 0.4, bonus: float = 0.2) -> Column:
    """struct(regime, weight, agreement) of a hidden-state and a spectral regime."""
    trend, revert = hidden.isin("TRENDING_UP", "TRENDING_DOWN"), hidden == "RANGING"
    agree = F.when((trend & (spectral == "trending")) | (revert & (spectral == "mean_reverting")), 1.0).when(spectral == "normal", 0.5).otherwise(0.0)
    regime = (
        F.when(spectral == "unknown", "UNKNOWN")
        .when(agree >= 0.9, F.when(spectral == "trending", "STRONG_TREND").otherwise("MEAN_REVERT"))
        .when(spectral == "trending", "WEAK_TREND")
        .when(hidden == "VOLATILE", "VOLATILE")
        .otherwise("MIXED")
    )
    # Base weight of each spectral regime.
    base = F.when(spectral == "trending", 1.0).when(spectral == "normal", 0.7).when(spectral == "mean_reverting", 0.5).when(spectral == "unknown", 0.3).otherwise(0.5)
    w = hidden_weight * (1 - spectral_weight) + base * spectral_weight * spectral_confidence
    w = F.when(agree >= 0.9, F.least(F.lit(1.0), w + bonus)).otherwise(w)
    return F.struct(regime.alias("regime"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), w)).alias("weight"), agree.alias("agreement"))


def digital_roots(df: DataFrame, keys: Sequence[str], price: str) -> DataFrame:
    """Digital-root histogram of whole prices with the shares of the two cycles."""
    n = F.col(price).cast("long")
    root = F.when(n > 0, 1 + (n - 1) % 9).otherwise(0)
    r = df.where(F.col(price) > 0).select(*keys, root.alias("root"))
    g = r.groupBy(*keys, "root").agg(F.count("*").alias("n"))
    tot = g.groupBy(*keys).agg(
        F.sum("n").alias("_t"),
        F.sum(F.when(F.col("root").isin(1, 2, 4, 8, 7, 5), F.col("n")).otherwise(0)).alias("_v"),
        F.sum(F.when(F.col("root").isin(3, 6, 9), F.col("n")).otherwise(0)).alias("_3"),
    )
    j = g.join(tot, list(keys)) if keys else g.withColumns({c: tot.select(c).scalar() for c in ("_t", "_v", "_3")})
    return j.select(*keys, "root", "n", (F.col("_v") / F.col("_t")).alias("vortex_ratio"), (F.col("_3") / F.col("_t")).alias("trinity_ratio"))
