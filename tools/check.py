"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows.

    python tools/check.py [--sf DIR] [name or prefix* ...]
"""

from __future__ import annotations

import argparse
import decimal
import fnmatch
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from latticeqc.queries import all_queries
from latticeqc.session import build_session, clear_work

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    return repr(value)


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf):
    start = time.time()
    df = all_queries.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if name not in all_queries.ORACLES:
        return f"ROWS  {name} rows={len(rows)} {took:.1f}s", True
    start = time.time()
    cursor = con.execute(all_queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    duck = time.time() - start
    a, b = normalized(df.columns, rows), normalized(columns, expected)
    if a == b:
        nulls = "" if rows else "  EMPTY"
        return f"OK    {name} rows={len(rows)} {took:.1f}s duck={duck:.1f}s{nulls}", True
    text = [f"FAIL  {name} rows={len(rows)}/{len(expected)} {took:.1f}s"]
    if a[0] != b[0]:
        text.append(f"   columns {a[0]} / {b[0]}")
    else:
        only_a = sorted(set(a[1]) - set(b[1]))[:3]
        only_b = sorted(set(b[1]) - set(a[1]))[:3]
        text.append(f"   cols  {a[0]}")
        text += [f"   spark {r}" for r in only_a] + [f"   duck  {r}" for r in only_b]
    return "\n".join(text), False


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*", default=["*"])
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{args.sf}/{table}.parquet'")
    bad = []
    chosen = [n for n in all_queries.QUERIES if any(fnmatch.fnmatch(n, p) for p in args.names)]
    for name in chosen:
        try:
            text, ok = compare(spark, con, name, args.sf)
        except Exception as error:  # report and go on with the next query
            lines = str(error).strip().splitlines()
            text, ok = f"ERROR {name}: {type(error).__name__} " + "\n      ".join(lines[:6]), False
        print(text, flush=True)
        if not ok:
            bad.append(name)
    clear_work(spark)
    print(f"{len(chosen) - len(bad)}/{len(chosen)} good; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
