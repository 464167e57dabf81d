"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelode.session import keep


def _towards_minimum(pairs: DataFrame) -> DataFrame:
    """(node, neighbour) rows with the least id among a node and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _are_stars(pairs: DataFrame) -> bool:
    """Whether every ``u`` has one ``v`` and no ``v`` is a ``u``."""
    ends = pairs.select(F.col("u").alias("node"), "v").unionByName(pairs.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v")))
    seen = ends.groupBy("node").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max(F.col("v").isNull()).alias("is_v"))
    return seen.filter("low <> high OR (is_v AND low IS NOT NULL)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): the least id it is connected to.

    Alternates two rewritings of the edge table until it is a set of stars:
    every greater neighbour is tied to the least id around a node, then every
    smaller one. Each needs one minimum per node and one join, never a node's
    neighbours in one place; the number of rounds grows with the logarithm of
    the longest path. Each round is a table in the shared folder.
    """
    stars = keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(stars):
        both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = _towards_minimum(large)
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        stars = keep(small)
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
