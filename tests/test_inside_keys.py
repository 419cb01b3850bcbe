"""Token buckets and zones in blocks against the plain run over a whole key."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bucket, zones


def bucket_run(us, wants, capacity, rate):
    """Requests one by one, in whole units."""
    unit = math.ulp(float(capacity))
    full = tokens = round(capacity / unit)
    out, before = [], None
    for t, want in zip(us, wants):
        if before is not None:
            tokens = min(full, tokens + int(np.rint(min((t - before) / 1e6 * rate / unit, full))))
        before = t
        cost = int(np.rint(min(want / unit, full + 1)))
        ok = tokens >= cost
        tokens -= cost if ok else 0
        out.append((ok, tokens * unit))
    return out


def audited(spark, us, wants, capacity, rate, rows, ids="long"):
    df = spark.createDataFrame([("k", int(t), 2**60 + i, float(w)) for i, (t, w) in enumerate(zip(us, wants))], "k string, us long, id long, w double")
    df = df.withColumn("id", F.col("id").cast(ids)).repartition(5)
    got = bucket.token_bucket_audit(df, ["k"], "us", "id", capacity, rate, F.col("w"), block=10**9, rows=rows).orderBy("id").collect()
    assert [int(r["id"]) for r in got] == [2**60 + i for i in range(len(us))]
    return [(r["allowed"], r["tokens"]) for r in got]


def times(seed, n, mean):
    return np.cumsum(np.random.default_rng(seed).exponential(mean, n) * 1e6).astype(int)


@pytest.mark.parametrize("mean", [0.3, 1.0, 3.0])  # three times too many requests, just as many as fit, a third of them
@pytest.mark.parametrize("rows", [7, 90])
def test_bucket_blocks_equal_the_whole_key(spark, mean, rows):
    us = times(1, 400, mean)
    assert audited(spark, us, [1.0] * 400, 10.0, 1.0, rows) == bucket_run(us, [1.0] * 400, 10.0, 1.0)


def test_bucket_with_many_costs_and_exact_ties(spark):
    rng = np.random.default_rng(2)
    us = np.arange(300) * 100_000  # a tenth of a token each: sums meet the costs exactly
    wants = rng.choice([0.0, 0.3, 0.1, 2.5, 7.0], 300)
    got = audited(spark, us, wants, 4.7, 1.0, 40, "string")
    assert got == bucket_run(us, wants, 4.7, 1.0)
    assert not any(ok for (ok, _), w in zip(got, wants) if w == 7.0)


def test_bucket_near_plain_doubles(spark):
    us, tokens, want, before = times(3, 500, 0.4), 5.0, [], None
    for t in us:
        tokens = min(5.0, tokens + ((t - before) / 1e6 * 1.3 if before is not None else 0))
        before, ok = t, tokens >= 1
        tokens -= ok
        want.append((ok, tokens))
    got = audited(spark, us, [1.0] * 500, 5.0, 1.3, 60)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-9)


def test_bucket_edges(spark):
    assert audited(spark, [5], [1.0], 1.0, 0.0, 10) == [(True, 0.0)]
    us = [3] * 6  # all at once
    assert audited(spark, us, [1.0] * 6, 2.0, 5.0, 2) == [(True, 1.0), (True, 0.0)] + [(False, 0.0)] * 4
    empty = spark.createDataFrame([], "k string, us long, id long")
    assert bucket.token_bucket_audit(empty, ["k"], "us", "id", 2.0, 1.0).count() == 0
    with pytest.raises(ValueError):
        bucket.token_bucket_audit(empty, ["k"], "us", "id", 0.0, 1.0)


def test_bucket_pieces_stay_few():
    unit = math.ulp(100.0)
    full, one = round(100 / unit), round(1 / unit)
    for gain in (0.1, 0.5, 0.99, 2.0):
        fold = bucket._Fold(full)
        rng = np.random.default_rng(4)
        gains = np.rint(rng.exponential(gain, 3000) / unit).astype(np.int64)
        fold.push({"_gain": gains, "_want": np.full(3000, one)})
        assert sum(len(p) for p in fold.finish()["at"]) < 250


def feed_of(seed, n, jump):
    rng = np.random.default_rng(seed)
    price = 100 + np.cumsum(rng.normal(0, jump, n)).round(1)
    high, low = price + rng.integers(0, 4, n) / 10, price - rng.integers(0, 4, n) / 10
    peak, trough = rng.random(n) < 0.2, rng.random(n) < 0.2
    cols = [np.arange(1, n + 1), high, low, np.where(peak, high, np.nan), np.where(trough, low, np.nan), rng.random(n), rng.integers(0, 8, n) / 10]
    return dict(zip(("seq", "_h", "_l", "_hi", "_lo", "_int", "_pad"), cols))


def swept(feed, cap):
    sweep, rows = zones.ZoneSweep(2, cap), []
    for got in (sweep.push(feed), sweep.finish()):
        if got:
            rows += zip(*(got[c] for c in (*zones.FIELDS, "end_seq", "status")))
    return sorted(rows, key=lambda r: r[:2])


@pytest.mark.parametrize("cap", [1, 3, 12, 500])
@pytest.mark.parametrize("jump", [0.3, 3.0])  # bars that overlap, bars that leave gaps between them
def test_zone_blocks_equal_the_whole_key(spark, cap, jump):
    feed = feed_of(cap, 400, jump)
    rows = [("k", int(r[0]), *map(float, r[1:])) for r in zip(*feed.values())]
    df = spark.createDataFrame(rows, "k string, seq long, _h double, _l double, _hi double, _lo double, _int double, _pad double").repartition(5)
    for size in (9, 70):
        got = zones.sweep_zones(df, ["k"], 2, cap, size).collect()
        have = sorted([tuple(r[c] for c in (*zones.FIELDS, "end_seq", "status")) for r in got], key=lambda r: r[:2])
        assert have == swept(feed, cap)
    assert len({r[-1] for r in have}) > 1


def test_a_price_left_out_between_two_bars_stays_open():
    block = zones._BlockZones(2, 9)
    for seq, (low, high) in enumerate([(1.0, 2.0), (2.0, 3.0), (5.0, 5.0), (1.5, 2.5)], 1):
        block.note(seq, high, low)
    assert [p[2] for p in sorted(block.pieces)] == [1, 4, 2]
    assert block.low == [np.nextafter(1.0, 2)] and block.high == [3.0]
