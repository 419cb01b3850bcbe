"""Event-time timers of the daily latch: days close without a new row, order of arrival does not matter, state leaves."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from tidemark.streaming import daily

START = datetime(2024, 3, 1, tzinfo=timezone.utc)
SCHEMA = "k string, ts timestamp, id long, r double, u double"


def at(hours):
    return START + timedelta(hours=hours)


def plain(rows, limit):
    """Rows and resets of finished days, key by key in event order."""
    out, state = {}, {}
    for k, ts, i, r, u in sorted(rows, key=lambda x: (x[1], x[2])):
        day = (ts - datetime(1970, 1, 1, tzinfo=timezone.utc)).days
        n, total, low, warned, limited = state.get((k, day), (0, 0.0, float("inf"), False, False))
        total += r
        low = min(low, total + u)
        state[k, day] = n + 1, total, low, warned or total + u <= -limit / 2, limited or total + u <= -limit
        out[k, i] = (total + u, low, *state[k, day][3:])
    return out, state


def run(spark, tmp_path, batches, limit=10.0, slot="1 hour"):
    """Each batch is a file; the stream stops after it and starts again for the next."""
    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        s = daily.daily_loss_latch(spark.readStream.schema(SCHEMA).parquet(src), ["k"], "ts", "id", "r", "u", limit, slot=slot)
        s.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).collect(), ck


def test_days_close_without_a_new_row_and_keys_leave(spark, tmp_path):
    first = [("a", at(1), 1, -4.0, -2.0), ("a", at(2), 2, -1.0, -6.0), ("a", at(3), 3, 9.0, 0.0), ("b", at(2), 4, 1.0, 0.0)]
    then = [("b", at(30), 5, -2.0, 0.0), ("b", at(2), 6, -99.0, 0.0)]  # row 6 is later than the watermark of the first batch
    got, ck = run(spark, tmp_path, [first, then])
    resets = {r["k"]: (r["n"], r["total_today"], r["lowest"], r["warned"], r["limited"]) for r in got if r["kind"] == "reset"}
    assert resets == {"a": (3, 4.0, -11.0, True, True), "b": (1, 1.0, 1.0, False, False)}
    assert {r["us"] for r in got if r["kind"] == "reset"} == {int(at(24).timestamp() * 1e6)}
    assert [r["id"] for r in sorted((r for r in got if r["kind"] == "row"), key=lambda r: r["id"])] == [1, 2, 3, 4]  # 5 waits
    for name in ("today", "waiting"):
        held = spark.read.format("statestore").option("stateVarName", name).load(ck)
        assert "a" not in {r["key"]["k"] for r in held.select("key").collect()}


@pytest.mark.parametrize("slot", ["1 hour", "1 day"])
def test_any_order_of_arrival_equals_the_plain_run(spark, tmp_path, slot):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), at(rng.randrange(60)), i, float(rng.randint(-6, 5)), float(rng.randint(-3, 3))) for i in range(150)]
    rng.shuffle(rows)
    end = [("z", at(200), 999, 0.0, 0.0)]
    got, _ = run(spark, tmp_path, [rows, end], slot=slot)
    want, days = plain(rows, 10.0)
    assert {(r["k"], r["id"]): (r["total_today"], r["lowest"], r["warned"], r["limited"]) for r in got if r["kind"] == "row"} == want
    assert {(r["k"], r["day"]): (r["n"], r["total_today"], r["lowest"], r["warned"], r["limited"]) for r in got if r["kind"] == "reset"} == days


def test_a_slot_must_divide_a_day(spark, tmp_path):
    (tmp_path / "src").mkdir()
    with pytest.raises(ValueError):
        daily.daily_loss_latch(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "src")), ["k"], "ts", "id", "r", "u", 1.0, slot="7 hours")


def test_rows_come_out_in_pieces(spark, tmp_path, monkeypatch):
    import tracemalloc

    n, latch = 60_000, daily.DailyLatch(["k"], "id", "bigint", daily.micros("1 day"), 10.0, 0.5)

    class Held:
        def __init__(self, rows):
            self.rows = rows

        exists = lambda self: True
        get = lambda self: self.rows
        clear = update = lambda self, *a: None

    class Now:
        getCurrentWatermarkInMs = staticmethod(lambda: 86_400_000)

    latch.waiting, latch.today = Held((n - i, i // 2, 1.0, 0.0) for i in range(n)), Held((0, 0, 0.0, 0.0, False, False))
    tracemalloc.start()
    sizes, ids = [], []
    for pdf in latch.handleExpiredTimer(("a",), Now, None):
        sizes.append(len(pdf))
        ids += pdf["id"].tolist()[:2]
    assert sum(sizes) == n + 1 and max(sizes) <= 10_000 and ids[:2] == [n - 1, n]
    assert tracemalloc.get_traced_memory()[1] < n * 250  # tuples: over 600 bytes a row
    tracemalloc.stop()
