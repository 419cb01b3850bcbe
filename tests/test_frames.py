"""Frames as views of blocks against frames cut from the whole key."""

import numpy as np
import pytest

from tidemark.operators.frames import strided


@pytest.mark.parametrize("n,need,hop,rows", [(5, 1, 1, 7), (5, 5, 1, 3), (20, 3, 4, 50), (1, 1, 1, 4), (64, 10, 3, 16)])
def test_strided_equals_whole_key(spark, n, need, hop, rows):
    rng = np.random.default_rng(n)
    data = {k: rng.standard_normal(size) for k, size in (("a", 130), ("b", 61), ("c", 2))}
    df = spark.createDataFrame([(k, t, float(x), 2**60 + t, None) for k, xs in data.items() for t, x in enumerate(xs)], "k string, t long, x double, id long, empty string").repartition(6)

    def compute(x):
        assert x.shape[0] <= 1024
        return [x.sum(1), [[{"first": float(r[0])}] for r in x]]

    got = strided(df, ["k"], ["t"], 40, "x", n, compute, "total double, parts array<struct<first:double>>", need, hop, rows).orderBy("k", "t").collect()
    assert len(got) == 193
    for r in got:
        frame = data[r["k"]][max(0, r["t"] - n + 1) : r["t"] + 1]
        due = r["t"] + 1 >= need and (r["t"] + 1) % hop == 0
        assert r["seq"] == r["t"] + 1 and r["id"] == 2**60 + r["t"] and r["empty"] is None
        assert (r["total"] == pytest.approx(frame.sum()) and r["parts"][0]["first"] == frame[0]) if due else (r["total"] is None and r["parts"] is None)


def test_plan_has_no_array_per_row(spark):
    from tidemark.operators import regime as reg

    df = spark.createDataFrame([("k", i, float(i % 7)) for i in range(50)], "k string, t long, x double")
    out = reg.spectral_regime(df, ["k"], ["t"], "x", 100, n=16, min_rows=16)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "PythonUDF" not in plan
