"""Triple-barrier labels, meta features and leakage-safe splits."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grouped import dealt
from .windows import ROWS, full, log_return, mean_expanding, rolling, rolling_return, std_population, volume_ratio, with_key_rows


def barrier_events(df, keys, order, block, price="price", atr="atr", signal: str | None = None, take: float = 2.0, stop: float = 1.0, horizon: int = 10, rows: int = ROWS) -> DataFrame:
    """Exit, return, barrier and label of every entry (rows with a zero signal keep null details).

    The future is a bounded frame of ``horizon`` prices, searched with array functions: no join. Take
    profit is tested before stop loss. A timeout carries the sign of its final return, the last row 0,
    and a short signal inverts the label.
    """
    p = F.col(price)
    upper, lower = p + F.lit(take) * F.col(atr), p - F.lit(stop) * F.col(atr)

    def build(d, w):
        ahead = F.collect_list(F.struct(F.col("seq").alias("s"), p.alias("p"))).over(w.rowsBetween(1, horizon))
        return d.withColumns({"_f": ahead, "_up": upper, "_lo": lower})

    out = rolling(df, keys, order, block, 0, build, ahead=horizon, rows=rows, keep_seq=True)
    hit = F.get(F.filter("_f", lambda x: (x["p"] >= F.col("_up")) | (x["p"] <= F.col("_lo"))), 0)
    end = F.element_at("_f", -1)
    out = out.withColumns({"_hit": hit, "_end": F.when(F.size("_f") > 0, end)})
    exit_ = F.coalesce("_hit", "_end")
    kind = F.when(F.col("_end").isNull(), "none").when(F.col("_hit").isNull(), "timeout").when(F.col("_hit.p") >= F.col("_up"), "take_profit").otherwise("stop_loss")
    raw = (
        F.when(F.col("_end").isNull(), 0)
        .when(F.col("_hit").isNull(), F.signum(F.col("_end.p") - p).cast("int"))
        .when(F.col("_hit.p") >= F.col("_up"), 1)
        .otherwise(-1)
    )
    entered = F.lit(True) if signal is None else F.col(signal) != 0
    label = raw if signal is None else F.when(F.col(signal) == 0, 0).when(F.col(signal) == -1, -raw).otherwise(raw)
    exit_price = F.coalesce(exit_["p"], p)
    return out.withColumns(
        {
            "tp_barrier": F.when(entered, F.col("_up")),
            "sl_barrier": F.when(entered, F.col("_lo")),
            "timeout_seq": F.when(entered, F.coalesce(F.col("_end.s"), F.col("seq"))),
            "exit_seq": F.when(entered, F.coalesce(exit_["s"], F.col("seq"))),
            "exit_price": F.when(entered, exit_price),
            "exit_return": F.when(entered, exit_price / F.nullif(p, F.lit(0.0)) - 1),
            "barrier": F.when(entered, kind),
            "label": label.cast("int"),
        }
    ).drop("_f", "_up", "_lo", "_hit", "_end")


def triple_barrier(df, keys, order, block, **params) -> DataFrame:
    """Only the label of ``barrier_events``."""
    out = barrier_events(df, keys, order, block, **params)
    return out.drop("tp_barrier", "sl_barrier", "timeout_seq", "exit_seq", "exit_price", "exit_return", "barrier")


def meta_label(signal: Column, label: Column) -> Column:
    """1 when a non-zero signal agrees with the label."""
    return F.when((signal == label) & (signal != 0), 1).otherwise(0)


def _clean(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def meta_features(df, keys, order, block, price="price", atr: str | None = None, volume: str | None = None, regime: str | None = None, n: int = 20, rows: int = ROWS) -> DataFrame:
    """Volatility, ATR ratio, momentum, vol of vol, trend strength, mean reversion (+ volume, regime).

    All features share one row-block shuffle; the frames reach 2n rows back.
    """
    src = with_key_rows(log_return(df, keys, order, price, block, "_ret", first=0.0), keys)

    def build(d, w):
        d = d.withColumn("volatility", std_population(w, "_ret", n))
        d = d.withColumns(
            {
                "momentum": rolling_return(w, price, n),
                "vol_of_vol": full(w, "volatility", n, F.stddev_pop("volatility").over(w.rowsBetween(-(n - 1), 0)), F.lit(0.0)),
                "_mean": mean_expanding(w, price, n, F.col("_key_rows")),
            }
        )
        return d.withColumn("volume_ratio", volume_ratio(w, volume, n, F.col("_key_rows"))) if volume else d

    out = rolling(src, keys, order, block, 2 * n, build, rows=rows)
    safe = F.when(F.col("volatility") > 1e-10, F.col("volatility")).otherwise(1e-10)
    natr = F.col(atr) / F.nullif(price, F.lit(0.0)) if atr else F.col("volatility") * 252**0.5
    out = out.withColumns(
        {
            "normalized_atr": natr,
            "trend_strength": F.abs("momentum") / safe,
            "mean_reversion": (F.col(price) - F.col("_mean")) / F.nullif("_mean", F.lit(0.0)) / safe,
        }
    )
    names = ["volatility", "normalized_atr", "momentum", "vol_of_vol", "trend_strength", "mean_reversion"] + (["volume_ratio"] if volume else [])
    out = out.withColumns({c: _clean(F.col(c)) for c in names})
    if regime:
        out = out.withColumn("regime_feature", F.col(regime).cast("double"))
    return out.drop("_ret", "_mean", "_key_rows")


def walk_forward_splits(counts: DataFrame, n: str, train: int = 252, test: int = 63, step: int = 21, embargo: int = 5) -> DataFrame:
    """Rolling index splits per row of ``counts`` (0-based, ends exclusive); the last test may be short."""
    last = F.floor((F.col(n) - F.lit(train + embargo + 1)) / F.lit(step))
    ok = F.col(n) >= train + embargo + test
    out = counts.where(ok).withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    start = F.col("split") * step
    return out.withColumns(
        {
            "train_start": start,
            "train_end": start + train,
            "test_start": start + train + embargo,
            "test_end": F.least(start + train + embargo + test, F.col(n)),
        }
    )


def split_roles(df: DataFrame, seq: str, n: str, train: int = 252, test: int = 63, step: int = 21, embargo: int = 5, purge: int = 0) -> DataFrame:
    """Every row once per split it belongs to: (row, split, role).

    The splits of a row follow from its own number by arithmetic, so nothing is joined. ``purge`` drops
    training rows whose label horizon of that many rows reaches the first test row.
    """
    s, size = F.col(seq), F.col(n)
    final = F.floor((size - F.lit(train + embargo + 1)) / F.lit(step))

    def spans(lo: int, length: int) -> Column:
        """Splits k with k*step + lo <= s < k*step + lo + length."""
        first = F.greatest(F.lit(0), F.ceil((s - F.lit(lo + length - 1)) / F.lit(step)))
        last = F.least(final, F.floor((s - F.lit(lo)) / F.lit(step)))
        return F.when(last >= first, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<long>"))

    kept = train - max(0, purge - embargo)
    roles = F.concat(
        F.transform(spans(0, kept), lambda k: F.struct(k.alias("split"), F.lit("train").alias("role"))),
        F.transform(spans(train + embargo, test), lambda k: F.struct(k.alias("split"), F.lit("test").alias("role"))),
    )
    return df.where(size >= train + embargo + test).withColumn("_r", F.explode(roles)).select(*df.columns, "_r.*")


def calendar_windows(span: DataFrame, start: str, end: str, train_months: int = 6, test_months: int = 3, step_months: int = 3, before: int = 5, after: int | None = 3) -> DataFrame:
    """Date windows in 30-day months, one row per window.

    With ``after`` the next start also waits for the previous test to end plus ``after`` days; with
    ``after=None`` windows advance by the plain step and may overlap.
    """
    train, test, step = train_months * 30, test_months * 30, step_months * 30
    if after is not None:
        step = max(step, train + before + test + after)
    room = F.datediff(F.col(end), F.col(start)) - F.lit(train + before + test)
    k = F.explode(F.sequence(F.lit(0), F.floor(room / F.lit(step)).cast("int")))
    out = span.where(room >= 0).withColumn("_k", k)
    first = F.date_add(F.col(start), F.col("_k") * step)
    return out.select(
        *[c for c in span.columns if c not in (start, end)],
        (F.col("_k") + 1).alias("window_id"),
        first.alias("train_start"),
        F.date_add(first, train).alias("train_end"),
        F.date_add(first, train + before).alias("test_start"),
        F.date_add(first, train + before + test).alias("test_end"),
    )


def attach_windows(df: DataFrame, day: str, windows: DataFrame) -> DataFrame:
    """Rows joined to the [train) and [test) ranges holding their day.

    Windows are exploded to days (a small calendar table), which turns the range join into an equi join.
    """

    def days(a: str, b: str, role: str) -> DataFrame:
        span = F.sequence(F.col(a), F.date_sub(F.col(b), 1))
        return windows.select("window_id", F.lit(role).alias("role"), F.explode(span).alias(day))

    return df.join(days("train_start", "train_end", "train").union(days("test_start", "test_end", "test")), day)


def secondary_classifier(train: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 5, seed: int = 42):
    """Random forest estimating whether the primary signal is right; returns the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_vec", handleInvalid="skip"),
        RandomForestClassifier(labelCol=label, featuresCol="_vec", numTrees=trees, maxDepth=depth, seed=seed),
    ]
    return Pipeline(stages=stages).fit(train)


def with_confidence(model, df: DataFrame, name: str = "confidence") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    return out.withColumn(name, vector_to_array("probability")[1]).drop("_vec", "rawPrediction", "probability")


def score_splits(roles: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, order: str, trees: int = 100, depth: int = 5, seed: int = 42) -> DataFrame:
    """(keys, split, n, accuracy): every split of every key is fitted and scored, each in a group of its own.

    A split holds at most its training and test rows, a few hundred whatever the table's size, so the groups are
    bounded and their number grows with the rows. A split whose training rows have one class predicts that class.
    """
    keys, features = list(keys), list(features)
    src = roles.select(*keys, "split", "role", order, label, *features).na.drop(subset=[label, *features])
    schema = T.StructType([*[roles.schema[k] for k in keys], roles.schema["split"], T.StructField("n", T.LongType()), T.StructField("accuracy", T.DoubleType())])

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order], kind="stable")
        train, test = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "test"]
        x, y = (p[features].to_numpy(float) for p in (train, test)), (p[label].to_numpy(int) for p in (train, test))
        return pd.DataFrame([(*key, len(test), _accuracy(*x, *y, trees, depth, seed))], columns=schema.names)

    return dealt(src, [*keys, "split"]).groupBy(*keys, "split").applyInPandas(fit, schema)


def _accuracy(x: np.ndarray, at: np.ndarray, y: np.ndarray, there: np.ndarray, trees: int, depth: int, seed: int) -> float | None:
    """Share of the test rows ``at`` whose class ``there`` a forest fitted to ``x`` and ``y`` tells."""
    if not len(x) or not len(at):
        return None
    return float(((forest_votes(x, y, at, trees, depth, seed) >= 0.5).astype(int) == there).mean())


def split_groups(df: DataFrame, seq: str, n: str, span: int, step: int, last: Column, together: int) -> DataFrame:
    """Every row once per ``_group`` it reaches into: group g has the rows of the splits g * together and on, ``span`` rows each."""
    s, wide = F.col(seq), together * step
    first = F.greatest(F.lit(0), F.ceil((s - F.lit(span - 1 + wide - step)) / F.lit(wide))).cast("long")
    final = F.least(F.floor(last / F.lit(together)), F.floor(s / F.lit(wide))).cast("long")
    return df.where(F.col(n) >= span).withColumn("_group", F.explode(F.when(final >= first, F.sequence(first, final))))


def score_walk_forward(
    df: DataFrame, keys: Sequence[str], seq: str, n: str, features: Sequence[str], label: str, train: int = 252, test: int = 63, step: int = 21, embargo: int = 5,
    purge: int = 0, trees: int = 100, depth: int = 5, seed: int = 42, together: int = 32,
) -> DataFrame:
    """``score_splits`` of ``split_roles``: (keys, split, n, accuracy) of every walk-forward split, one row number in a key once.

    ``together`` splits that follow each other share a group, so a row is copied for the groups it reaches into (about 1.5)
    and not for each of its splits (15). A group holds ``together * step`` rows and those of one split more, whatever the
    table's size.
    """
    keys, features = list(keys), list(features)
    span, kept = train + embargo + test, train - max(0, purge - embargo)
    src = df.select(*keys, seq, n, label, *features).na.drop(subset=[label, *features])
    src = split_groups(src, seq, n, span, step, F.floor((F.col(n) - F.lit(train + embargo + 1)) / F.lit(step)), together)
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("split", T.LongType()), T.StructField("n", T.LongType()), T.StructField("accuracy", T.DoubleType())])

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([seq], kind="stable")
        at, x, y = pdf[seq].to_numpy(), pdf[features].to_numpy(float), pdf[label].to_numpy(int)
        begin, rows = int(key[-1]) * together, []
        for split in range(begin, min(begin + together, (int(pdf[n].iat[0]) - train - embargo - 1) // step + 1)):
            a = split * step
            a, b, c, e = np.searchsorted(at, (a, a + kept, a + train + embargo, a + span))
            if a < b or c < e:
                rows.append((*key[:-1], split, e - c, _accuracy(x[a:b], x[c:e], y[a:b], y[c:e], trees, depth, seed)))
        return pd.DataFrame(rows, columns=schema.names)

    return dealt(src, [*keys, "_group"]).groupBy(*keys, "_group").applyInPandas(fit, schema)


@lru_cache(maxsize=16)
def _bootstraps(n: int, trees: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """(tree, row, times drawn) of the rows that bootstraps of ``n`` rows hold, and the state that the generator is left in."""
    rng = np.random.default_rng(seed)
    drawn = rng.integers(0, n, (trees, n)) + n * np.arange(trees)[:, None]
    weight = np.bincount(drawn.ravel(), minlength=trees * n)
    tree, row = np.divmod(np.flatnonzero(weight), n)
    return tree, row, weight[weight > 0], rng.bit_generator.state


def _gini(packed: np.ndarray, n: int) -> np.ndarray:
    """Size times Gini impurity, halved, of nodes given as size * (n + 1) + ones."""
    k, c = np.divmod(packed, n + 1)
    return c * (k - c) / np.maximum(k, 1)


@lru_cache(maxsize=16)
def _gini_table(n: int) -> np.ndarray:
    return _gini(np.arange((n + 1) ** 2), n)


def forest_votes(x: np.ndarray, y: np.ndarray, at: np.ndarray, trees: int, depth: int, seed: int) -> np.ndarray:
    """Mean class-1 share over bootstrapped Gini trees, the square root of the features tried at each node.

    All trees grow together, level by level: a bootstrap is a weight for each row, and a level is searched in one sort of
    whole numbers that hold node, feature, rank of the value, weight and class of a row, in that order. Rows and ones are
    counted together, as rows * (n + 1) + ones. Nodes that hold no row of ``at`` are not grown on.
    """
    n, d = x.shape
    some = max(1, int(math.sqrt(d)))
    node, row, weight, state = _bootstraps(n, trees, seed)
    rng = np.random.default_rng(seed)
    rng.bit_generator.state = state
    gini = _gini_table(n).take if n <= 512 else partial(_gini, n=n)
    order = np.argsort(x, axis=0)
    values = np.take_along_axis(x, order, axis=0)
    rises = values[1:] > values[:-1]
    dense = np.zeros((n, d), dtype=np.int64)
    np.cumsum(rises, axis=0, out=dense[1:])
    ranks = np.empty_like(dense)
    np.put_along_axis(ranks, order, dense, axis=0)
    np.put_along_axis(values, dense, values.copy(), axis=0)
    x, at, ranks, values = x.T.ravel(), at.ravel(), ranks.T.ravel(), values.T.ravel()
    of_rank, of_weight = n.bit_length(), n.bit_length() + 1
    kind = np.int32 if (some * (trees << depth)).bit_length() + of_rank + of_weight < 32 else np.int64
    ranks = (ranks << of_weight).astype(kind)
    held = (weight * 2 + y[row]).astype(kind)
    counted = np.repeat(np.arange(n + 1), 2) * np.tile([n + 1, n + 2], n + 1)  # what a weight and class count for
    count = counted[held].astype(float)
    points = len(at) // d
    there, point = np.divmod(np.arange(trees * points), points)
    total, nodes = np.zeros(points), trees
    for left in range(depth, -1, -1):
        whole = np.bincount(node, count, nodes).astype(np.int64)
        size, hits = np.divmod(whole, n + 1)
        by, cut = np.full(nodes, -1), np.zeros(nodes)
        if left:
            mixed = np.flatnonzero((hits > 0) & (hits < size) & (np.bincount(there, minlength=nodes) > 0))
            drawn, tried = rng.random((nodes, d))[mixed], np.empty((len(mixed), some), dtype=np.int64)
            for j in range(some):  # the features with the smallest numbers
                tried[:, j] = drawn.argmin(axis=1)
                np.put_along_axis(drawn, tried[:, j : j + 1], 1.0, axis=1)
            tried.sort(axis=1)
            number = np.full(nodes, -1)
            number[mixed] = np.arange(len(mixed))
            small = number[node]
            e = np.flatnonzero(small >= 0)
            small, here, payload = small[e], row[e], held[e]
            keys, groups = np.empty((some, len(e)), dtype=kind), np.arange(tried.size, dtype=kind).reshape(-1, some) << (of_rank + of_weight)
            for j in range(some):
                np.add(ranks[(tried[:, j] * n)[small] + here], payload, out=keys[j])
                keys[j] += groups[:, j].copy()[small]
            keys = np.sort(keys, axis=None)
            place = keys >> of_weight
            group = place >> of_rank
            # a cut is never best between two rows of one class, as impurity is concave there, unless one shares its value
            tied, apart = place[1:] == place[:-1], (keys[1:] ^ keys[:-1]) & 1 == 1
            apart[1:] |= tied[:-1]
            apart[:-1] |= tied[1:]
            ends = np.flatnonzero(apart & ~tied & (group[1:] == group[:-1]))
            if len(ends):
                group = group[ends].astype(np.intp)
                every = np.repeat(whole[mixed], some)
                below = np.cumsum(counted[keys & ((1 << of_weight) - 1)])[ends] - (np.cumsum(every) - every)[group]
                impurity = gini(below) + gini(every[group] - below)
                owner = group // some
                new = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1))
                least = np.minimum.reduceat(impurity, new)
                lowest = np.flatnonzero(impurity == np.repeat(least, np.diff(new, append=len(owner))))
                lowest = lowest[np.searchsorted(lowest, new)]
                found, f, ends = mixed[owner[lowest]], tried.ravel()[group[lowest]], ends[lowest]
                low, high = (place[p] & ((1 << of_rank) - 1) for p in (ends, ends + 1))
                by[found], cut[found] = f, (values[f * n + low] + values[f * n + high]) / 2
        grows = by >= 0
        go = grows[there]
        total += np.bincount(point[~go], (hits / np.maximum(size, 1))[there[~go]], points)
        nodes = 2 * int(grows.sum())
        if not nodes:
            break
        number = 2 * (np.cumsum(grows) - 1)
        stay = np.flatnonzero(grows[node])
        node, row, held, count = node[stay], row[stay], held[stay], count[stay]
        there, point = there[go], point[go]
        node = number[node] + (x[(by * n)[node] + row] > cut[node])
        there = number[there] + (at[point * d + by[there]] > cut[there])
    return total / trees
