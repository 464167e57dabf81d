"""Ordered work (running totals, row numbers, moving frames) that survives hot groups.

A plain ``Window.partitionBy(key)`` sorts each key in one task. That is the best
plan while every key is small and fails when one key holds a third of all rows.
Each function here measures the largest key first: if it fits one task the plain
window is used, otherwise rows are range-partitioned on (key, order) and the
parts are stitched together from per-part totals.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from corelode.session import ROWS_PER_TASK, keep, limit_of

Order = Sequence[str | Column]


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match null keys, keeping the left key columns."""
    if not keys:
        raise ValueError("join_on needs at least one key")
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the biggest group (one partial aggregation)."""
    if not keys:
        return df.count()
    row = df.groupBy(*keys).count().agg(F.max("count")).first()
    return int(row[0] or 0)


def fits_one_task(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> bool:
    """True when each group of ``keys`` may be sorted by one task."""
    limit = limit or limit_of(df.sparkSession, "rowsPerTask", ROWS_PER_TASK)
    if not keys:
        # one group means one task for everything: only worth it for small inputs
        limit = min(limit, 20_000)
    return largest_group(df, keys) <= limit


def _range_parts(df: DataFrame, keys: Sequence[str], order: Order, limit: int | None, left: Sequence[str] = ()) -> DataFrame:
    """Rows in parts that are ranges of (key, order), with the part's number and the
    row's place in that order; the columns ``left`` only serve to order them."""
    spark = df.sparkSession
    limit = limit or limit_of(spark, "rowsPerTask", ROWS_PER_TASK)
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(df.count() / limit))
    spread = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    # an id rises along the rows of a part: the places in the order need no window and no further shuffle
    return keep(spread.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}).drop(*left))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    sums: dict[str, Column],
    limit: int | None = None,
) -> DataFrame:
    """Add, per ``keys``, running sums in ``order`` up to and including the row.

    ``order`` must be total (end with a tie-break), or ties sum in any order.
    """
    keys = list(keys)
    if fits_one_task(df, keys, limit):
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(c).over(frame) for name, c in sums.items()})
    spread = _range_parts(keep(df), keys, order, limit)
    part = [*keys, "_part"]
    frame = Window.partitionBy(*part).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    within = spread.withColumns({name: F.sum(c).over(frame) for name, c in sums.items()})
    # one row per (group, part): at most the number of parts in a group
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # written, so that Spark sees how small it is and does not shuffle the rows to meet it
    before = keep(
        spread.groupBy(*part)
        .agg(*[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()])
        .select(*part, *[F.sum(f"_t_{name}").over(earlier).alias(f"_b_{name}") for name in sums])
    )
    both = join_on(within, before, part)
    return both.withColumns(
        # sums skip nulls: a part without values adds nothing to what came before
        {name: F.when(F.col(f"_b_{name}").isNull(), F.col(name))
         .when(F.col(name).isNull(), F.col(f"_b_{name}"))
         .otherwise(F.col(name) + F.col(f"_b_{name}")) for name in sums}
    ).drop("_part", "_place", *[f"_b_{name}" for name in sums])


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Order, name: str = "row_number", limit: int | None = None
) -> DataFrame:
    """Add 1, 2, 3 … per ``keys`` in ``order``."""
    keys = list(keys)
    if fits_one_task(df, keys, limit):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return _numbered(keep(df), keys, order, name, limit)


def _numbered(df: DataFrame, keys: list[str], order: Order, name: str, limit: int | None, left: Sequence[str] = ()) -> DataFrame:
    """Row numbers across parts: the place in the part and the rows of the key in earlier parts."""
    spread = _range_parts(df, keys, order, limit, left)
    part = [*keys, "_part"]
    # one row per (group, part), written so that Spark sees how small it is
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = keep(
        spread.groupBy(*part).agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
        .select(*part, (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift")))
    return join_on(spread, before, part).withColumn(name, F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")


def moving(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    before: int,
    after: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    limit: int | None = None,
    block: int = 50_000,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Add columns whose frame spans ``before`` rows back and ``after`` rows ahead.

    ``columns`` receives an ordered window without a frame and returns the
    columns to add. Groups too big for one task are cut into blocks of row
    numbers; the rows next to a border are copied into the neighbouring block.
    With ``carry`` the result has the keys, these columns and the added ones;
    the others order the rows and go no further.
    """
    keys = list(keys)
    left = [] if carry is None else [c for c in df.columns if c not in (*keys, *carry)]
    if fits_one_task(df, keys, limit):
        return df.withColumns(columns(Window.partitionBy(*keys).orderBy(*order))).drop(*left)
    block = max(block if limit is None else min(block, limit), before + after + 1)
    numbered = _numbered(keep(df), keys, order, "_idx", limit, left)
    at = F.col("_idx") - 1
    own = F.floor(at / block)
    copies = F.array_compact(F.array(
        own,
        F.when(at % block >= block - before, own + 1),
        F.when((at % block < after) & (own > 0), own - 1),
    ))
    blocks = numbered.withColumn("_own", own).withColumn("_block", F.explode(copies))
    ordered = Window.partitionBy(*keys, "_block").orderBy("_idx")
    return (
        blocks.withColumns(columns(ordered))
        .filter(F.col("_block") == F.col("_own"))
        .drop("_idx", "_own", "_block")
    )
