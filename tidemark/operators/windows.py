"""Row-window indicators. Every function keeps a key spread over many tasks (see ``blocks``)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..session import checkpointed
from .blocks import running, settle, spread, with_seq
from .scan import affine_scan
from .zones import ROWS as ZONE_ROWS
from .zones import sweep_zones

ROWS = 100_000  # rows of one key handled by one task in bounded frames
PANE = 16  # rows that a stated order of summing adds up first


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: str | int,
    back: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    ahead: int = 0,
    rows: int = ROWS,
    keep_seq: bool = False,
) -> DataFrame:
    """Run ``build(df, window)``, whose frames reach at most ``back`` rows back and ``ahead`` rows on.

    ``build`` may use ``seq`` (dense row number in the key). Two shuffles: one to number the rows, one
    to the row blocks; every frame of ``build`` shares the second one and its sort.
    """
    had = "seq" in df.columns
    src = df if had else with_seq(df, keys, order, block)
    h, w = spread(src, keys, "seq", rows, back, ahead)
    out = settle(build(h, w))
    return out if had or keep_seq else out.drop("seq")


def counter_delta(df, keys, order, counter: str, block, name: str = "delta", reset_aware: bool = False) -> DataFrame:
    """Increase of a counter since the previous row; a reset counts as the new value if asked."""
    c = F.col(counter)
    out = running(df, keys, order, block, {"_prev": ("lag", c)})
    d = c - F.col("_prev")
    if reset_aware:
        d = F.when(d < 0, c).otherwise(d)
    return out.withColumn(name, d).drop("_prev")


def moving_average(df, keys, order, col: str, block, n: int = 11, name: str = "ma", rows: int = ROWS) -> DataFrame:
    return rolling(df, keys, order, block, n - 1, lambda d, w: d.withColumn(name, F.avg(col).over(w.rowsBetween(-(n - 1), 0))), rows=rows)


def log_return(df, keys, order, price: str, block, name: str = "ret", first: float | None = None) -> DataFrame:
    """ln(p / previous p). Non-positive prices raise; the first row gets ``first`` (null drops nothing)."""
    p = F.col(price)
    checked = F.when(p > 0, p).otherwise(F.raise_error(F.lit("prices must be positive")).cast("double"))
    out = running(df, keys, order, block, {"_prev": ("lag", p)})
    ret = F.log(checked / F.col("_prev"))
    if first is not None:
        ret = F.coalesce(ret, F.lit(float(first)))
    return out.withColumn(name, ret).drop("_prev")


def full(w: WindowSpec, col: str, n: int, value: Column, empty: Column | None = None) -> Column:
    """``value`` once the frame holds ``n`` non-null inputs."""
    got = F.when(F.count(col).over(w.rowsBetween(-(n - 1), 0)) >= n, value)
    return got if empty is None else got.otherwise(empty)


def std_sample(w: WindowSpec, col: str, n: int, scale: float = 1.0) -> Column:
    """Sample standard deviation, null until the window is full."""
    return full(w, col, n, F.stddev_samp(col).over(w.rowsBetween(-(n - 1), 0)) * F.lit(scale))


def std_population(w: WindowSpec, col: str, n: int) -> Column:
    """Population standard deviation, zero until the window is full."""
    return full(w, col, n, F.stddev_pop(col).over(w.rowsBetween(-(n - 1), 0)), F.lit(0.0))


def mean_by_panes(d: DataFrame, w: WindowSpec, col: str, n: int, name: str, seq: Column, pane: int = PANE) -> DataFrame:
    """Mean of the last n rows in a stated order of summing, for labels with a border: sums of doubles depend on it.

    A key's rows are cut into panes of ``pane`` rows from its first one on (``seq`` 1, no gaps). First come the
    frame's rows before a whole pane, then the sum of each whole pane, then the rows after the last one.
    """
    frame, x = w.rowsBetween(1 - n, 0), F.coalesce(F.col(col), F.lit(0.0))
    d = d.withColumns({"_x0": x, "_pane": F.sum(x).over(w.rowsBetween(1 - pane, 0))})
    after = range(min(pane, n - pane + 1))  # rows after the last whole pane; with more of them the frame holds none
    parts, total = {f"_x{j}": F.lag("_x0", j).over(w) for j in after[1:-1]}, F.col("_all")
    for r in after:
        panes, before = divmod(n - r, pane)
        sums = [F.sum("_x0").over(w.rowsBetween(1 - n, before - n))] if before else []
        sums += [F.lag("_pane", r + i * pane).over(w) for i in reversed(range(panes))]
        # a key's first frames lack the rows before and some panes
        parts |= {f"_s{r}_{i}": F.coalesce(c, F.lit(0.0)) for i, c in enumerate(sums)}
        inside = [f"_s{r}_{i}" for i in range(len(sums))] + [f"_x{j}" for j in reversed(range(r))]
        total = F.when(seq % pane == r, reduce(add, map(F.col, inside))).otherwise(total)
    parts |= {"_all": F.sum("_x0").over(frame), "_n": F.count(col).over(frame)}
    return d.withColumns(parts).withColumn(name, total / F.nullif("_n", F.lit(0))).drop("_x0", "_pane", *parts)


def mean_expanding(w: WindowSpec, col: str, n: int, key_rows: Column) -> Column:
    """Mean of the last n rows, expanding at the start; a key shorter than n keeps its input."""
    return F.when(key_rows < n, F.col(col)).otherwise(F.avg(col).over(w.rowsBetween(-(n - 1), 0)))


def rolling_return(w: WindowSpec, col: str, n: int) -> Column:
    """Simple return over n rows, zero for the first n."""
    return F.coalesce(F.col(col) / F.lag(col, n).over(w) - 1, F.lit(0.0))


def with_key_rows(df: DataFrame, keys: Sequence[str], name: str = "_key_rows") -> DataFrame:
    return df.join(df.groupBy(*keys).agg(F.count("*").alias(name)), list(keys), "left")


def volume_ratio(w: WindowSpec, volume: str, n: int, key_rows: Column) -> Column:
    m = mean_expanding(w, volume, n, key_rows)
    return F.col(volume) / F.when(m > 0, m).otherwise(1.0)


def cumulative_return(df, keys, order, ret: str, block, name: str = "cum") -> DataFrame:
    """Product of (1 + r); also ``{name}_norm`` divided by the first value (kept when that is 0)."""
    r = 1 + F.col(ret)
    out = affine_scan(df, keys, order, block, {name: (r, F.lit(0.0), r), "_first": (F.lit(1.0), F.lit(0.0), r)})
    return out.withColumn(f"{name}_norm", F.when(F.col("_first") == 0, F.col(name)).otherwise(F.col(name) / F.nullif("_first", F.lit(0.0)))).drop("_first")


def drawdown(df, keys, order, level: str, block, name: str = "dd") -> DataFrame:
    """(level - running max) / running max; 0 where undefined."""
    out = running(df, keys, order, block, {"_peak": ("max", F.col(level))})
    dd = F.coalesce((F.col(level) - F.col("_peak")) / F.nullif("_peak", F.lit(0.0)), F.lit(0.0))
    return out.withColumn(name, dd).drop("_peak")


def zscore(df: DataFrame, keys: Sequence[str], col: str, name: str = "z") -> DataFrame:
    """(x - mean) / population std per key, ignoring NaN; std 0 counts as 1."""
    clean = F.when(~F.isnan(col), F.col(col))
    stats = df.groupBy(*keys).agg(F.avg(clean).alias("_m"), F.stddev_pop(clean).alias("_s"))
    s = F.when((F.col("_s") == 0) | F.col("_s").isNull(), 1.0).otherwise(F.col("_s"))
    return df.join(stats, list(keys), "left").withColumn(name, (F.col(col) - F.col("_m")) / s).drop("_m", "_s")


def pivots(df, keys, order, high: str, low: str, block, k: int = 2, rows: int = ROWS) -> DataFrame:
    """Strict centred extremes: ``pivot_high`` / ``pivot_low`` flags (ties and borders disqualify)."""

    def build(d, w):
        left, right = w.rowsBetween(-k, -1), w.rowsBetween(1, k)
        whole = (F.count("*").over(left) == k) & (F.count("*").over(right) == k)
        hi = whole & (F.col(high) > F.max(high).over(left)) & (F.col(high) > F.max(high).over(right))
        lo = whole & (F.col(low) < F.min(low).over(left)) & (F.col(low) < F.min(low).over(right))
        return d.withColumns({"pivot_high": hi, "pivot_low": lo})

    return rolling(df, keys, order, block, k, build, ahead=k, rows=rows)


def liquidation_zones(
    df,
    keys,
    order,
    block,
    high="high",
    low="low",
    volume="volume",
    atr="atr",
    k: int = 2,
    width: float = 0.25,
    max_zones: int = 500,
    rows: int = ROWS,
    zone_rows: int = ZONE_ROWS,
) -> DataFrame:
    """Zones opened at confirmed pivots: one row per zone with its end and status.

    A pivot at row s is confirmed at row s+k, where the ATR and the volume history are taken. A zone is
    ``consumed`` by the first row from s+k on whose range strictly holds its midpoint, ``dropped`` when
    more than ``max_zones`` are active (oldest first), else ``open``. Pivots and intensities are
    windows; zones run in blocks of ``zone_rows`` bars (see ``zones``).
    """

    def build(d, w):
        left, right = w.rowsBetween(-k, -1), w.rowsBetween(1, k)
        whole = (F.count("*").over(left) == k) & (F.count("*").over(right) == k)
        hi = whole & (F.col(high) > F.max(high).over(left)) & (F.col(high) > F.max(high).over(right))
        lo = whole & (F.col(low) < F.min(low).over(left)) & (F.col(low) < F.min(low).over(right))
        hist = w.rowsBetween(-(max_zones - 1) + k, k)
        v, avg, top = F.col(volume), F.avg(volume).over(hist), F.max(volume).over(hist)
        intensity = F.when(top > 0, F.when(v > avg, F.least(F.lit(1.0), v / top)).when(avg > 0, v / (avg * 2)).otherwise(0.5)).otherwise(0.5)
        return d.withColumns(
            {
                "_hi": F.lag(F.when(hi, F.col(high)), k).over(w),
                "_lo": F.lag(F.when(lo, F.col(low)), k).over(w),
                "_int": F.lag(intensity, k).over(w),
                "_pad": F.coalesce(F.col(atr), F.lit(0.0)) * width,
            }
        )

    base = rolling(df, keys, order, block, max_zones + 2 * k, build, ahead=k, rows=rows, keep_seq=True)
    feed = base.select(*keys, "seq", F.col(high).alias("_h"), F.col(low).alias("_l"), "_hi", "_lo", "_int", "_pad")
    return sweep_zones(feed, list(keys), k, max_zones, zone_rows)


def trend_counter(df, keys, order, block, high="high", low="low", length: int = 20, smooth: int = 5, rows: int = ROWS) -> DataFrame:
    """Run length of closing-range midpoints above the channel middle, smoothed, against its average.

    Columns: ``raw`` run length, ``value`` smoothed and rounded half-even, ``avg50``, ``trend``.
    Rows before the channel and the smoothing are warmed up are dropped.
    """

    def channel(d, w):
        f = w.rowsBetween(-(length - 1), 0)
        mid = (F.max(high).over(f) + F.min(low).over(f)) / 2
        return d.withColumn("_up", (F.col(high) + F.col(low)) / 2 > mid)

    ready = checkpointed(rolling(df, keys, order, block, length - 1, channel, rows=rows, keep_seq=True).where(F.col("seq") >= length))
    runs = running(ready, keys, order, block, {"_fail": ("last", F.when(~F.col("_up"), F.col("seq")))})
    run = F.col("seq") - F.coalesce(F.col("_fail"), F.lit(length - 1))
    raw = F.least(run, F.lit(length), F.lit(400)).cast("double")
    a = 2.0 / (smooth + 1)
    runs = checkpointed(runs.withColumn("raw", raw).drop("_up", "_fail"))
    sm = affine_scan(runs, keys, order, block, {"_ema": (F.lit(1 - a), F.lit(a) * F.col("raw"), F.col("raw"))})
    warm = checkpointed(sm.where(F.col("seq") >= length + smooth - 1).withColumn("value", F.rint("_ema")).drop("_ema"))
    out = rolling(warm, keys, order, block, 49, lambda d, w: d.withColumn("avg50", F.avg("value").over(w.rowsBetween(-49, 0))), rows=rows)
    v, m = F.col("value"), F.col("avg50")
    trend = (
        F.when(v > m * 1.5, "STRONG_UP")
        .when(v > m, "UP")
        .when(v < m * 0.5, F.when(v < 2, "STRONG_DOWN").otherwise("DOWN"))
        .when(v < m, "DOWN")
        .otherwise("NEUTRAL")
    )
    strength = F.least(F.lit(1.0), v / F.lit(float(min(length, 100))))
    return out.withColumns({"trend": trend, "strength": strength})


def sequence_gaps(df, keys, order, seq_col: str, ts_us: str, block, max_gap_seconds: float = 1800.0) -> DataFrame:
    """Missing sequence numbers (kind ``sequence``) and long silences (kind ``time``)."""
    prev = running(df, keys, order, block, {"_ps": ("lag", F.col(seq_col)), "_pt": ("lag", F.col(ts_us))})
    s, p = F.col(seq_col), F.col("_ps")
    kinds = F.array_compact(
        F.array(
            F.when(s - p > 1, F.struct(F.lit("sequence").alias("kind"), (p + 1).alias("start_seq"), (s - 1).alias("end_seq"))),
            F.when(
                F.col(ts_us) - F.col("_pt") > F.lit(int(max_gap_seconds * 1_000_000)),
                F.struct(F.lit("time").alias("kind"), p.alias("start_seq"), s.alias("end_seq")),
            ),
        )
    )
    return prev.where(F.size(kinds) > 0).select(*keys, F.explode(kinds).alias("_g"), F.col("_pt").alias("start_us"), F.col(ts_us).alias("end_us")).select(
        *keys, "_g.*", "start_us", "end_us"
    )


def wave_features(df, keys, order, price: str, block, window: int = 50, alpha: float = 0.01, rows: int = ROWS) -> DataFrame:
    """Velocity, acceleration, displacement from a slow equilibrium, standing-wave amplitude.

    The equilibrium used for crossings is its current value, so the crossing test runs over the
    collected price frame of each row (``window`` values).
    """
    p = F.col(price)
    eq = affine_scan(df, keys, order, block, {"equilibrium": (F.lit(1 - alpha), F.lit(alpha) * p, p)})

    def build(d, w):
        v = p - F.lag(price, 1).over(w)
        pv = F.lag(price, 1).over(w) - F.lag(price, 2).over(w)
        frame = w.rowsBetween(-(window - 1), 0)
        return d.withColumns(
            {
                "velocity": F.coalesce(v, F.lit(0.0)),
                "acceleration": F.coalesce(v - pv, F.lit(0.0)),
                "displacement": p - F.col("equilibrium"),
                "_recent": F.when(F.count("*").over(frame) == window, F.collect_list(price).over(frame)),
                "_amp": (F.max(price).over(frame) - F.min(price).over(frame)) / 2,
            }
        )

    out = rolling(checkpointed(eq), keys, order, block, window, build, rows=rows)
    gap = F.transform("_recent", lambda x: x - F.col("equilibrium"))
    pairs = F.zip_with(F.slice(gap, 1, window - 1), F.slice(gap, 2, window - 1), lambda x, y: F.when(x * y < 0, 1).otherwise(0))
    crossings = F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x)
    return out.withColumn("standing_wave", F.when(crossings > F.lit(window / 10 * 0.7), F.col("_amp"))).drop("_recent", "_amp")


def crossing_frequency(df, keys, order, col: str, block, target: float = 0.1) -> DataFrame:
    """Mean-crossing rate per key: Nyquist estimate and the downsampling factor for ``target``."""
    mean = df.groupBy(*keys).agg(F.avg(col).alias("_m"))
    d = df.join(mean, list(keys), "left").withColumn("_d", F.col(col) - F.col("_m"))
    d = running(d, keys, order, block, {"_pd": ("lag", F.col("_d"))})
    out = d.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("_pd") * F.col("_d") < 0).alias("crossings"))
    nyq = F.when(F.col("n") >= 10, F.col("crossings") / F.col("n"))
    factor = int(1 / (2 * target)) if target > 0 else 1
    return out.withColumns({"nyquist": nyq, "factor": F.when(F.coalesce(nyq, F.lit(0.0)) <= 0, 1).otherwise(max(1, factor))})
