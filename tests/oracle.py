"""Run a registered query and its SQL on the same Parquet files and compare.

`python -m tests.oracle [--sf DIR] [name ...]` prints one line per query.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import threading
import time

import duckdb

from vereda import session
from vereda.plans import catalog

DATA = "/root/testdata"
SQL_LIMIT = 60


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in session.TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return ("n", f + 0.0)
    if isinstance(v, (dt.datetime, dt.date)):
        return ("t", str(v))
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return ("l", tuple(canon(x) for x in v))
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return ("d", tuple(sorted((k, canon(x)) for k, x in v.items())))
    return ("s", str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str):
    """(ok, message, seconds, rows)"""
    t0 = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    cols, rows = df.columns, df.collect()
    took = time.time() - t0
    if name not in catalog.ORACLES:
        return len(rows) > 0, f"rows only: {len(rows)}", took, len(rows)
    t1 = time.time()
    timer = threading.Timer(SQL_LIMIT, con.interrupt)
    timer.start()
    try:
        cur = con.execute(catalog.ORACLES[name])
    finally:
        timer.cancel()
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - t1
    got_c, got_r = rows_of(cols, rows)
    want_c, want_r = rows_of(want_cols, want)
    if got_c != want_c:
        return False, f"columns {got_c} != {want_c}", took, len(rows)
    if got_r != want_r:
        only_g = [r for r in got_r if r not in set(want_r)][:3] if len(got_r) < 200000 else []
        only_w = [r for r in want_r if r not in set(got_r)][:3] if len(want_r) < 200000 else []
        return False, f"rows {len(got_r)} vs {len(want_r)}\n   spark {only_g}\n   sql   {only_w}", took, len(rows)
    return True, f"{len(rows)} rows equal (sql {sql_took:.1f}s)", took, len(rows)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default=f"{DATA}/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = session.local()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    names = args.names or sorted(catalog.QUERIES)
    names = [n for a in names for n in (sorted(q for q in catalog.QUERIES if q.startswith(a[:-1])) if a.endswith("*") else [a])]
    bad = []
    for name in names:
        try:
            ok, msg, took, _ = compare(spark, con, name, args.sf)
        except Exception as e:  # noqa: BLE001
            ok, msg, took = False, f"{type(e).__name__}: {str(e)[:700]}", 0
        print(f"{'ok ' if ok else 'BAD'} {name:34s} {took:6.1f}s  {msg}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} ok; bad: {bad}")


if __name__ == "__main__":
    main()
