"""Means in a stated order of summing, bit for bit, and labels of rows that lie on a border."""

import datetime as dt
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.oracle import compare
from tidemark.operators.windows import mean_by_panes, rolling


def folded(xs, end, n, pane):
    """Mean of xs[max(0, end - n):end]: rows before a whole pane, whole panes as one number, rows after."""
    at, total, got = max(0, end - n), 0.0, [x for x in xs[max(0, end - n) : end] if x is not None]
    while at < end:
        size = pane if at % pane == 0 and at + pane <= end else 1
        part = 0.0
        for x in xs[at : at + size]:
            part += x or 0.0
        total, at = total + part, at + size
    return total / len(got) if got else None


@pytest.mark.parametrize("n,pane,rows", [(20, 16, 7), (50, 16, 40), (20, 16, 1000), (5, 16, 9), (32, 16, 33), (12, 4, 5), (1, 4, 3), (3, 1, 2)])
def test_mean_by_panes_equals_fold(spark, n, pane, rows):
    rng = random.Random(n * pane)
    data = {k: [None if rng.random() < 0.05 else rng.uniform(-1, 1) for _ in range(size)] for k, size in (("a", 140), ("b", 37), ("c", 2))}
    data["d"] = [None, None, 0.5]
    df = spark.createDataFrame([(k, t, x) for k, xs in data.items() for t, x in enumerate(xs)], "k string, t long, x double").repartition(5)
    got = rolling(df, ["k"], ["t"], 50, n, lambda d, w: mean_by_panes(d, w, "x", n, "m", F.col("seq"), pane), rows=rows)
    assert got.columns == ["k", "t", "x", "m"]
    found = got.collect()
    assert len(found) == sum(map(len, data.values()))
    for r in found:
        assert r["m"] == folded(data[r["k"]], r["t"] + 1, n, pane), r


def events(path, rows, ks, seed):
    rng, start = random.Random(seed), dt.datetime(2024, 1, 1)
    table = {
        "event_id": list(range(rows)),
        "ts": [start + dt.timedelta(seconds=20 * i) for i in range(rows)],
        "user_id": [i % 7 for i in range(rows)],
        "event_type": [rng.choice(["click", "view"]) for _ in range(rows)],
        "value": [round(rng.uniform(1, 500), 2) for _ in range(rows)],
        "props": [f'{{"k": {rng.choice(ks)}}}' for _ in range(rows)],
    }
    pq.write_table(pa.table(table), f"{path}/events.parquet")


def same_as_sql(spark, path, name):
    df = entry.queries()[name](spark, str(path))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{path}/events.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    return compare(df.columns, [tuple(r) for r in df.collect()], [d[0] for d in cur.description], cur.fetchall())


def test_flow_state_on_its_borders(spark, tmp_path):
    # a volume of 65 in a frame of 1,040 lies exactly on the border 0.5, one of 45 in a frame of 1,200 on 1.5
    events(tmp_path, 6000, [15, 20, 45, 65, 70, 90], 3)
    assert same_as_sql(spark, tmp_path, "of_06_flow_state") is None


def test_vpin_on_its_borders(spark, tmp_path):
    # buckets are out of balance by whole tenths, so means of 50 meet 0.3 and 0.7 exactly
    events(tmp_path, 8000, [100, 200, 300, 400], 5)
    assert same_as_sql(spark, tmp_path, "of_05_vpin") is None
