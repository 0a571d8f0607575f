"""Run registered queries against their SQL twins: ``python -m tests.oracle_check [names]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

import __spark_entry__ as entry
from metricloom.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: str = "8"):
    return build_session(
        "metricloom-check", f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows), order


def kinds(rows, order):
    out = []
    for i in order:
        v = next((r[i] for r in rows if r[i] is not None), None)
        out.append(type(v).__name__)
    return out


def compare(spark, con, name, sf):
    fn, sql = entry.queries()[name], entry.oracle_sql().get(name)
    start = time.time()
    df = fn(spark, sf)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return None, f"{len(got)} rows (no SQL)", took
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    gc, gr, go = rows_of(df.columns, got)
    wc, wr, wo = rows_of(want_cols, want)
    if gc != wc:
        return False, f"columns {gc} != {wc}", took
    if len(gr) != len(wr):
        return False, f"rows {len(gr)} != {len(wr)}", took
    if kinds(got, go) != kinds(want, wo):
        return False, f"types {list(zip(gc, kinds(got, go), kinds(want, wo)))}", took
    bad = [(a, b) for a, b in zip(gr, wr) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(gr)} rows differ, first {bad[0]} in {gc}", took
    return True, f"{len(gr)} rows", took


def main(argv):
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = [n for n in entry.queries() if not argv or any(a in n for a in argv)]
    spark, con = local_session(), duck(sf)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for n in names:
        try:
            ok, note, took = compare(spark, con, n, sf)
        except Exception as e:  # report and go on with the next query
            ok, note, took = False, f"{type(e).__name__}: {str(e)[:1500]}", 0.0
        if ok is False:
            failed += 1
        print(f"{'ok  ' if ok else '--  ' if ok is None else 'FAIL'} {n:42s} {took:6.2f}s  {note}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
