"""Every registered query with a DuckDB counterpart gives the same rows."""

import pytest
from oracle import compare, connect

from corelode.plans import catalog

WITH_SQL = [k for k in catalog.CATALOG if catalog.CATALOG[k].sql is not None]


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("key", WITH_SQL)
def test_same_rows(spark, duck, folder, key):
    ok, text = compare(spark, duck, folder, key)
    assert ok, text


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(WITH_SQL) <= set(entry.oracle_sql())
