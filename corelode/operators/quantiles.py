"""Exact linear-interpolated quantiles for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelode.operators.ordered import join_on, largest_group, running_totals
from corelode.session import VALUES_PER_TASK, keep, limit_of

Wanted = dict[str, tuple[Column, float]]


def quantiles(
    df: DataFrame, keys: Sequence[str], wanted: Wanted, limit: int | None = None, weight: Column | None = None,
) -> DataFrame:
    """One row per ``keys`` with each wanted quantile ``name: (column, p)``;
    ``weight`` counts a row several times.

    The built-in ``percentile`` keeps every distinct value of a group in one
    task. It is used while the largest group is small enough; beyond that the
    values are counted, ordered across tasks and picked by their rank.
    """
    keys = list(keys)
    limit = limit or limit_of(df.sparkSession, "valuesPerTask", VALUES_PER_TASK)
    if largest_group(df, keys) <= limit:
        # one aggregate, and so one table of values, for all quantiles of a column
        shares: dict[str, tuple[Column, list[float]]] = {}
        for c, p in wanted.values():
            shares.setdefault(str(c), (c, []))[1].append(p)
        at = {c: f"_q{i}" for i, c in enumerate(shares)}
        found = df.groupBy(*keys).agg(*[
            F.percentile(c, F.array(*map(F.lit, ps)), *([] if weight is None else [weight])).alias(at[name]) for name, (c, ps) in shares.items()])
        taken = {name: F.col(at[str(c)])[shares[str(c)][1].index(p)] for name, (c, p) in wanted.items()}
        return found.select(*keys, *[c.alias(name) for name, c in taken.items()])
    return _by_rank(df, keys, wanted, limit, weight)


def _by_rank(df: DataFrame, keys: list[str], wanted: Wanted, limit: int, weight: Column | None) -> DataFrame:
    distinct: dict[str, tuple[int, Column]] = {}
    for c, _ in wanted.values():
        distinct.setdefault(str(c), (len(distinct), c))
    tagged = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), c.cast("double").alias("v")) for i, c in distinct.values()
    ]))
    every = keep(
        df.select(*keys, tagged.alias("_x"), (F.lit(1) if weight is None else weight).cast("long").alias("_w"))
        .select(*keys, F.col("_x.i").alias("_i"), F.col("_x.v").alias("_v"), "_w")
        .groupBy(*keys, "_i", "_v")
        .agg(F.sum("_w").alias("_n")))
    counts = every.filter(F.col("_v").isNotNull() & (F.col("_n") > 0))
    ranked = running_totals(counts, [*keys, "_i"], ["_v"], {"_upto": F.col("_n")}, limit)
    sizes = counts.groupBy(*keys, "_i").agg(F.sum("_n").alias("_size"))
    ranked = join_on(ranked, sizes, [*keys, "_i"])
    picks = []
    for name, (c, p) in wanted.items():
        i = distinct[str(c)][0]
        at = (F.col("_size") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(
                F.min(F.when((F.col("_i") == i) & (F.col("_upto") > rank), F.col("_v"))).alias(f"_{side}_{name}")
            )
        picks.append(F.max(F.when(F.col("_i") == i, at - F.floor(at))).alias(f"_f_{name}"))
    found = ranked.groupBy(*keys).agg(*picks)
    if keys:  # groups without any value have null quantiles
        found = join_on(every.groupBy(*keys).agg(F.count("*").alias("_rows")), found, keys, "left")
    return found.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in wanted
        ],
    )


def medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``<column>`` medians per ``keys``."""
    return quantiles(df, keys, {c: (F.col(c), 0.5) for c in columns})


def modes(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent value (the smallest on ties) of each column, in long form.

    Values are counted before they meet, so an identifier column with many
    distinct values stays spread over tasks.
    """
    keys = list(keys)
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns
    ]))
    counted = (
        df.select(*keys, cells.alias("_c")).select(*keys, "_c.field", "_c.value")
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "field", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.groupBy(*keys, "field").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("most_common"),
        F.max("n").alias("most_common_count"),
        F.count(F.lit(1)).alias("unique_count"),
    )


def any_of(conditions: Sequence[Column]) -> Column:
    """True when one of the conditions holds (null counts as false)."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def corrected_skewness(c: Column) -> Column:
    """Bias-corrected skewness; null below three values."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def corrected_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values."""
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))
