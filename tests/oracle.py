"""Compare registered Spark queries with their SQL on DuckDB.

    python -m tests.oracle --sf 0.001 [--show] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import sys
import time
import traceback

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return ("f", repr(v))
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, int):
        return ("i", v)
    return v


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(cols, rows, dcols, drows):
    """None when equal, else a description of the first difference."""
    if sorted(cols) != sorted(dcols):
        return f"columns {sorted(cols)} vs {sorted(dcols)}"
    order = sorted(cols)
    si, di = [cols.index(c) for c in order], [dcols.index(c) for c in order]
    a = sorted((tuple(norm(r[i]) for i in si) for r in rows), key=repr)
    b = sorted((tuple(norm(r[i]) for i in di) for r in drows), key=repr)
    if len(a) != len(b):
        extra = f"spark {a[:2]} sql {b[:2]}"
        return f"rows {len(a)} vs {len(b)} {order} {extra}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ {order}: {bad[0][0]} vs {bad[0][1]}"
    return None


def main() -> int:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="0.001")
    p.add_argument("--show", action="store_true")
    p.add_argument("--slow", type=float, default=6.0)
    p.add_argument("names", nargs="*")
    args = p.parse_args()
    import __spark_entry__ as entry
    from tidemark.session import build_session

    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session("oracle", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not args.names or any(n.startswith(a) for a in args.names)]
    bad = []
    for n in names:
        t0 = time.time()
        try:
            df = qs[n](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            t1 = time.time()
            if args.show:
                df.show(5, False)
            if n not in sqls:
                print(f"ROWS {n} {len(rows)} {t1 - t0:.1f}s", flush=True)
                continue
            cur = con.execute(sqls[n])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
            t2 = time.time()
            diff = compare(df.columns, rows, dcols, drows)
            slow = " SLOW" if t1 - t0 > args.slow or t2 - t1 > args.slow else ""
            if diff:
                bad.append(n)
                print(f"FAIL {n} {t1 - t0:.1f}s/{t2 - t1:.1f}s {diff[:700]}", flush=True)
            else:
                print(f"ok   {n} rows={len(rows)} {t1 - t0:.1f}s/{t2 - t1:.1f}s{slow}{' EMPTY' if not rows else ''}", flush=True)
        except Exception as e:  # noqa: BLE001
            bad.append(n)
            msg = str(e).split("JVM stacktrace")[0][:900]
            tb = traceback.extract_tb(e.__traceback__)
            where = [f"{f.filename.split('/')[-1]}:{f.lineno}" for f in tb if "/repo/" in f.filename]
            print(f"ERR  {n} {type(e).__name__} {where} {msg}", flush=True)
    print(f"{len(names) - len(bad)}/{len(names)} good; bad: {' '.join(bad)}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
