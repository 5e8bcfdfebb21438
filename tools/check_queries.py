"""Runs registered queries beside their SQL in DuckDB and compares the rows.

    python tools/check_queries.py [--sf DIR] [--skewed] [name ...]

``--skewed`` switches automatic broadcasts off and calls every key above a handful
of rows hot, so the balanced join paths run instead of the planner's broadcasts.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

import duckdb  # noqa: E402

from basket_engine import settings  # noqa: E402
from basket_engine.catalog import ORACLES, QUERIES  # noqa: E402
from basket_engine.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, name, sf):
    began = time.perf_counter()
    df = QUERIES[name](spark, sf)
    got = df.collect()
    took = time.perf_counter() - began
    if name not in ORACLES:
        return f"rows={len(got)}", took, len(got) > 0
    found = con.sql(ORACLES[name])
    want = found.fetchall()
    if sorted(df.columns) != sorted(found.columns):
        return f"columns {sorted(df.columns)} != {sorted(found.columns)}", took, False
    a, b = rows_of(df.columns, got), rows_of(found.columns, want)
    if a == b:
        types = {c: t for c, t in df.dtypes}
        return f"rows={len(a)} ok {types if '-v' in sys.argv else ''}", took, True
    off = [(x, y) for x, y in zip(a, b) if x != y]
    return f"rows {len(a)}/{len(b)}, {len(off)} differ, first {off[:2]}", took, False


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--skewed", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    if args.skewed:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set(settings.SKEW_SLICES, "50")
        spark.conf.set(settings.SKEW_MIN_ROWS, "5")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    failed = []
    for name in args.names or QUERIES:
        try:
            message, took, fine = compare(spark, con, name, args.sf)
        except Exception as error:  # keep going: one report for all queries
            message, took, fine = f"{type(error).__name__}: {str(error)[:900]}", 0.0, False
        print(f"{'PASS' if fine else 'FAIL'} {name:30s} {took:6.2f}s {message}", flush=True)
        if not fine:
            failed.append(name)
    print("failed:", failed)
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
