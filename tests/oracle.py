"""Compare registered queries with their SQL in DuckDB.

``python -m tests.oracle [name-part ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(int(v)) if v == int(v) else repr(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def compare(spark, con, folder, name, fn, sql):
    df = fn(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return got, None
    cur = con.execute(sql)
    return got, rows_of([d[0] for d in cur.description], cur.fetchall())


def main(parts):
    from recordloom.plans import ORACLES, QUERIES
    from recordloom.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con, bad = local_session("8"), duck(folder), []
    for name, fn in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            got, want = compare(spark, con, folder, name, fn, ORACLES.get(name))
        except Exception as e:  # noqa: BLE001
            print("ERROR", name, str(e)[:1500], flush=True)
            bad.append(name)
            continue
        took = f"{time.time() - t:.1f}s"
        if want is None:
            print("rows ", name, len(got[1]), took, flush=True)
        elif got == want:
            print("ok   ", name, len(got[1]), took, "" if got[1] else "EMPTY", flush=True)
        else:
            bad.append(name)
            print("DIFF ", name, len(got[1]), len(want[1]), got[0], want[0], took)
            diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:2]
            print("   ", str(diff)[:1500], flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
