"""All registered queries (importing a plan module registers its queries)."""

from corelode.plans import depth, features, learning, profile, quality, roundtrips, rows, spatial  # noqa: F401
from corelode.plans.registry import CATALOG, duckdb_query, spark_query

__all__ = ["CATALOG", "duckdb_query", "spark_query"]
