"""Hard negatives against all pairs, and the vertical scan against whole products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows):
    """All pairs by plain integers; a row repeated whole counts once."""
    use = []
    for i, v, label in dict.fromkeys((i, tuple(v) if v is not None else None, label) for i, v, label in rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        use.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    for k, (a, q, label) in enumerate(use):
        if a is None or a % 50:
            continue
        scored = [(sum(x * y for x, y in zip(q, r)), i, other) for j, (i, r, other) in enumerate(use) if j != k and len(r) == len(q)]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for p, pid, _ in [s for s in scored if s[2] == label][:5]:
            hits = [s for s in scored if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p][:3]
            out += [(a, pid, n, s[1], p, s[0]) for n, s in enumerate(hits, 1)]
    return sorted(out, key=str)


def mined(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({n: F.lit(1) for n in ("row", "dims", "v", "near", "far", "side", "p", "rank", "score", "positive_scores")})
    return sorted((tuple(r) for r in hn.mined(df).collect()), key=str)


def random_rows(rng, n, dims, grid=None):
    def x():
        return rng.randrange(-grid, grid + 1) / 256 if grid else rng.gauss(0, 1)

    return [(i, [x() for _ in range(dims)], rng.choice([0, 0, 0, 1, 2, 9])) for i in range(n)]


def test_equals_all_pairs(spark):
    rows = random_rows(random.Random(3), 400, 20)
    want = plain(rows)
    assert want and mined(spark, rows) == want


def test_ties_follow_the_smaller_id(spark):
    rows = random_rows(random.Random(4), 300, 3, grid=2)  # few different scores
    want = plain(rows)
    assert len({r[4] for r in want}) < len(want) and mined(spark, rows) == want


def test_blocks_change_nothing(spark, monkeypatch):
    rows = random_rows(random.Random(5), 260, 6)
    want = mined(spark, rows)
    monkeypatch.setattr(hn, "VECTOR_ROWS", 37)
    monkeypatch.setattr(hn, "ANCHOR_NUMBERS", 12)
    assert mined(spark, rows) == want == plain(rows)


def test_odd_rows(spark):
    rng = random.Random(6)
    rows = random_rows(rng, 120, 4) + [
        (None, [1.0, 1.0, 1.0, 1.0], 0), (200, None, 1), (250, [], 2), (251, [], 3), (252, [], 3), (300, [1.0, None, 0.0, 0.0], 1), (350, [1.0, float("nan"), 0.0, 0.0], 1),
        (400, [1.0, float("inf"), 0.0, 0.0], 1), (450, [1.0, 2.0], 1), (451, [1.0, 2.0], 1), (452, [0.7, 1.4], 2), (500, [1.0, 1.0, 1.0, 1.0], None), (-50, [0.5, 0.5, 0.5, 0.5], 0), (0, [0.0] * 4, 5),
        (100, [1.0, 1.0, 1.0, 1.0], 0), (100, [1.0, 1.0, 1.0, 1.0], 0), (450, [1.0, 2.0], 1),
    ]
    assert mined(spark, rows) == plain(rows)


def test_numbers_beyond_a_double(spark):
    rows = [(50, [2.0**38, 1.0], 1), (51, [2.0**8, 3.0], 1), (52, [2.0**7 + 1, -1.0], 2), (53, [2.0**7, 1.0], 2), (54, [2.0**8, 2.0], 2)]
    got = mined(spark, rows)
    assert got == plain(rows) and any(abs(r[4]) > 2**53 for r in got)
    assert mined(spark, [(50, [1e300, 1e300], 1), (51, [1e300, 1.0], 1), (52, [1e300, 2.0], 2)]) == []  # all scores are the greatest long


def test_nothing_to_find(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []  # no anchor
    assert mined(spark, [(50, [1.0], 0), (1, [1.0], 1)]) == []  # no positive


@pytest.mark.parametrize("seed", range(5))
def test_vertical_scan_keeps_exactly_the_window(seed):
    rng = np.random.default_rng(seed)
    columns = np.floor(rng.normal(0, 100, (29, 500)))
    anchor = np.floor(rng.normal(0, 100, 29) * (rng.random(29) < 0.5))
    scores = anchor @ columns
    floor, ceiling = np.quantile(scores, [0.7, 0.9])
    among = np.flatnonzero(rng.random(500) < 0.6)
    at, got = hn.vertical_scan(anchor, columns, columns.min(1), columns.max(1), among, floor, ceiling)
    want = among[(scores[among] >= floor) & (scores[among] <= ceiling)]
    assert at.tolist() == want.tolist() and got.tolist() == scores[want].tolist()
