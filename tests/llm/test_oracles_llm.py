"""Every query with SQL gives DuckDB's rows; queries and SQL belong together."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle_llm import compare  # noqa: E402

from corelode.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("key", list(ORACLES))
def test_same_rows(spark, folder, key):
    ok, text = compare(spark, folder, key)
    assert ok, text


def test_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
    numbers = {k.split("_")[0] for k in QUERIES}
    assert numbers == {"pipeline", *(f"op{n}" for n in range(1, 14))}
