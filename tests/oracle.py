"""Runs registered queries against their SQL in DuckDB: ``python tests/oracle.py [sf_dir] [prefix ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{directory}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, int):
        return float(f"{float(value):.15g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    return value


def compare(columns, rows, want_columns, want_rows) -> str | None:
    """None when equal, else what differs."""
    if sorted(columns) != sorted(want_columns):
        return f"columns {sorted(columns)} != {sorted(want_columns)}"
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    want_order = sorted(range(len(want_columns)), key=lambda i: want_columns[i])
    got = sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)
    want = sorted((tuple(plain(r[i]) for i in want_order) for r in want_rows), key=repr)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def check(spark, directory: str, name: str, con) -> tuple[str | None, int, float]:
    from plumbline.plans.catalogue import ORACLES, QUERIES

    start = time.time()
    df = QUERIES[name](spark, directory)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if name not in ORACLES:
        return None, len(rows), took
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    return compare(df.columns, rows, names, want.fetchall()), len(rows), took


if __name__ == "__main__":
    from plumbline.plans.catalogue import ORACLES, QUERIES
    from plumbline.session import build_session

    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(directory)
    bad = 0
    for name in QUERIES:
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            problem, n, took = check(spark, directory, name, con)
        except Exception as error:  # report and go on with the next query
            problem, n, took = f"ERROR {type(error).__name__}: {str(error)[:700]}", -1, 0.0
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name} rows={n} {took:.2f}s{'' if name in ORACLES else ' (no sql)'} {problem or ''}"[:1200], flush=True)
    print("problems:", bad)
