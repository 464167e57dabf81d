"""Registry of named queries and their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corelode.sources.fixture import VIEWS, relation, with_views

Runner = Callable[["Inputs"], DataFrame]


@dataclass(frozen=True)
class Inputs:
    """The relations of one data folder."""

    spark: SparkSession
    folder: str
    opened: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self.opened:
            self.opened[name] = relation(self.spark, self.folder, name)
        return self.opened[name]


@dataclass(frozen=True)
class Query:
    run: Runner
    sql: str | None
    digits: dict[str, int]


CATALOG: dict[str, Query] = {}


def register(key: str, run: Runner, sql: str | None = None, **digits: int) -> None:
    """Add a query; ``digits`` rounds the named columns on both sides."""
    if key in CATALOG:
        raise ValueError(f"query {key} is registered twice")
    CATALOG[key] = Query(run, sql, digits)


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()}) if digits else df


def spark_query(key: str) -> Callable[[SparkSession, str], DataFrame]:
    query = CATALOG[key]
    return lambda spark, folder: rounded(query.run(Inputs(spark, folder)), query.digits)


def duckdb_query(key: str) -> str | None:
    """The oracle with the relations it names and the same rounding."""
    query = CATALOG[key]
    if query.sql is None:
        return None
    body = query.sql.strip()
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    if query.digits:
        # adding zero turns a negative zero into zero
        changes = ", ".join(f'round("{c}", {d}) + 0.0 AS "{c}"' for c, d in query.digits.items())
        if body[:5].upper() == "WITH ":
            head, tail = _split_with(body)
            body = f"{head} SELECT * REPLACE ({changes}) FROM ({tail})"
        else:
            body = f"SELECT * REPLACE ({changes}) FROM ({body})"
    if not used:
        return body
    views = with_views(*used).rstrip()
    if body[:5].upper() == "WITH ":
        return f"{views},\n{body[5:]}"
    return f"{views}\n{body}"


def _split_with(body: str) -> tuple[str, str]:
    """Split ``WITH a AS (…), b AS (…) SELECT …`` before its final SELECT."""
    depth = 0
    for at, char in enumerate(body):
        depth += {"(": 1, ")": -1}.get(char, 0)
        if depth == 0 and re.match(r"\bSELECT\b", body[at:], re.IGNORECASE) and not body[at - 1].isalnum():
            return body[:at], body[at:]
    raise ValueError("no final SELECT")


def identity_sql(seed: int, texts: list[str], numbers: list[str]) -> str:
    """``prep.identity_hash`` in DuckDB: text columns first, then numbers in whole thousandths."""
    parts = ", ".join([*texts, *(f"CAST(CAST(round({c} * 1000) AS BIGINT) AS VARCHAR)" for c in numbers)])
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {parts})), 1, 15) AS BIGINT)"
