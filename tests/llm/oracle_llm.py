"""Run queries of the subpackage beside DuckDB: ``python tests/llm/oracle_llm.py [-f folder] [key ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle import rows_of  # noqa: E402

from corelode.llm.queries import ORACLES, QUERIES  # noqa: E402

TABLES = ["documents", "pages", "benchmark", "labels", "conversations", "embeddings"]


def compare(spark, folder: str, key: str) -> tuple[bool, str]:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    df = QUERIES[key](spark, folder)
    got = [tuple(r) for r in df.collect()]
    if key not in ORACLES:
        return True, f"{len(got)} rows (no oracle)"
    result = con.execute(ORACLES[key])
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    different = [(x, y) for x, y in zip(a, b) if x != y]
    return a == b, f"{len(a)} and {len(b)} rows, {len(different)} differ; {str(different[:2])[:1500]}"


def main() -> int:
    from corelode.session import build_session, forget

    args, folder = sys.argv[1:], "/root/testdata/sf0.01"
    if args[:1] == ["-f"]:
        folder, args = args[1], args[2:]
    spark, bad = build_session("oracle"), 0
    for key in args or list(QUERIES):
        start = time.time()
        ok, text = compare(spark, folder, key)
        print("ok  " if ok else "FAIL", key, f"{time.time() - start:.1f}s", text, flush=True)
        bad += not ok
    forget(spark)
    return bad


if __name__ == "__main__":
    sys.exit(main())
