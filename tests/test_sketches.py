"""Roll-ups from sketches against exact counts and ranks."""

import bisect
import random

from pyspark.sql import functions as F

from tidemark.operators import sketches as sk


def test_merged_hours_answer_days_within_the_bounds(spark):
    rng = random.Random(4)
    # one day holds most rows
    rows = [(rng.choice("aaaab"), rng.randrange(24), rng.randrange(9000), rng.lognormvariate(0, 2)) for _ in range(60_000)]
    df = spark.createDataFrame(rows, "day string, hour int, who long, x double").repartition(7)
    days = sk.answers(sk.merge(sk.sketch(df, ["day", "hour"], ["who"], ["x"]), ["day"]), {"p50": 0.5, "p99": 0.99})
    for r in days.collect():
        mine = [row for row in rows if row[0] == r["day"]]
        who, xs = len({row[2] for row in mine}), sorted(row[3] for row in mine)
        assert r["n"] == len(mine) and abs(r["distinct_who"] - who) <= sk.distinct_error() * who
        for name, q in (("x_p50", 0.5), ("x_p99", 0.99)):
            assert abs(bisect.bisect_right(xs, r[name]) / len(xs) - q) <= sk.rank_error()
    checked = sk.within_bounds(df, days, ["day"], ["who"], ["x"], {"p50": 0.5, "p99": 0.99}).collect()
    assert len(checked) == 2 and all(r["distinct_ok"] and r["quantiles_ok"] for r in checked)
    # wrong estimates are told
    off = days.withColumns({"distinct_who": F.col("distinct_who") * 2, "x_p50": F.col("x_p99")})
    assert not any(r["distinct_ok"] or r["quantiles_ok"] for r in sk.within_bounds(df, off, ["day"], ["who"], ["x"], {"p50": 0.5, "p99": 0.99}).collect())


def test_nulls_and_empty_tables(spark):
    fields = "day string, who long, x double"
    df = spark.createDataFrame([("a", None, None), ("a", None, float("nan")), (None, 1, 2.0), (None, 1, 2.0)], fields)
    got = {r["day"]: r for r in sk.answers(sk.merge(sk.sketch(df, ["day"], ["who"], ["x"]), ["day"]), {"p50": 0.5}).collect()}
    assert (got["a"]["n"], got["a"]["distinct_who"], got["a"]["x_p50"]) == (2, 0, None)
    assert (got[None]["n"], got[None]["distinct_who"], got[None]["x_p50"]) == (2, 1, 2.0)
    nothing = sk.sketch(df.limit(0), ["day"], ["who"], ["x"])
    assert sk.answers(sk.merge(nothing, ["day"]), {"p50": 0.5}).collect() == []
    (total,) = sk.answers(sk.merge(nothing), {"p50": 0.5}).collect()
    assert (total["n"], total["distinct_who"], total["x_p50"]) == (0, 0, None)
