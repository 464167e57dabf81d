"""Run registered queries beside their DuckDB counterparts.

``python tests/oracle.py [-f folder] [key ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corelode.plans import catalog  # noqa: E402
from corelode.session import build_session, forget  # noqa: E402

TABLES = ["lineitem", "supplier", "events", "conversations", "orders", "part", "customer", "nation", "region"]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, key: str) -> tuple[bool, str]:
    df = catalog.spark_query(key)(spark, folder)
    got = [tuple(r) for r in df.collect()]
    sql = catalog.duckdb_query(key)
    if sql is None:
        return True, f"{len(got)} rows (no oracle)"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return True, f"{len(a)} rows"
    different = [(x, y) for x, y in zip(a, b) if x != y]
    return False, f"{len(a)} vs {len(b)} rows, {len(different)} differ; columns {sorted(names)}; first {different[:2]}"


def main() -> int:
    args = sys.argv[1:]
    folder = "/root/testdata/sf0.001"
    if args[:1] == ["-f"]:
        folder, args = args[1], args[2:]
    spark, con = build_session("oracle"), connect(folder)
    bad = []
    for key in args or list(catalog.CATALOG):
        start = time.time()
        try:
            ok, text = compare(spark, con, folder, key)
        except Exception as error:  # report and go on
            ok, text = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if ok else 'FAIL'} {key} {time.time() - start:.1f}s {text}", flush=True)
        if not ok:
            bad.append(key)
    print("failed:", bad)
    forget(spark)
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
