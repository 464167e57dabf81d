"""Ordered intervals down a hole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelode.functions import predicates as P
from corelode.functions.predicates import GRADE
from corelode.operators.ordered import join_on, moving, running_totals
from corelode.session import keep

SERIES = ["Hole_ID", "Element"]
ORDER = ["Depth_From", "Depth_To", "SampleID", GRADE]


def _valid(samples: DataFrame) -> DataFrame:
    return samples.filter(P.valid_training())


def depth_series(samples: DataFrame, hole: str | None = None) -> DataFrame:
    """Valid rows with their relative depth in the hole.

    The deepest start is a grouped maximum joined back, so that a hole with very
    many rows is not gathered in one task.
    """
    rows = samples.filter(P.valid_sample() & F.col("Depth_From").isNotNull())
    if hole is not None:
        rows = rows.filter(F.col("Hole_ID") == hole)
    deepest = rows.groupBy("Hole_ID").agg(F.max("Depth_From").alias("_deepest"))
    return rows.join(deepest, "Hole_ID").withColumn(
        "depth_progression", F.try_divide("Depth_From", "_deepest")
    ).drop("_deepest")


def depth_cumulative(samples: DataFrame, limit: int | None = None) -> DataFrame:
    """Running grade and length per hole and element."""
    return running_totals(_valid(samples), SERIES, ORDER, {
        "cumulative_grade": F.col(GRADE), "cumulative_length": F.col("Interval_Length"),
    }, limit)


def depth_moving3(samples: DataFrame, limit: int | None = None) -> DataFrame:
    """Centred mean and deviation of three rows; null at the ends of a series."""

    def columns(w):
        frame = w.rowsBetween(-1, 1)
        full = F.count(GRADE).over(frame) == 3
        return {
            "grade_ma3": F.when(full, F.avg(GRADE).over(frame)),
            "grade_std3": F.when(full, F.stddev_samp(GRADE).over(frame)),
        }

    return moving(_valid(samples), SERIES, ORDER, 1, 1, columns, limit)


def interval_overlaps(samples: DataFrame, limit: int | None = None) -> DataFrame:
    """Per hole: consecutive intervals in which the first ends below the next start."""
    known = samples.filter(F.col("Depth_From").isNotNull()).select("Hole_ID", "Element", *ORDER)
    order = ["Depth_From", "Depth_To", "SampleID", "Element", GRADE]
    following = moving(
        known, ["Hole_ID"], order, 0, 1,
        lambda w: {"_next": F.max("Depth_From").over(w.rowsBetween(1, 1))}, limit,
    )
    return following.groupBy("Hole_ID").agg(
        F.count_if(F.col("Depth_To") > F.col("_next")).alias("overlaps"), F.count("*").alias("intervals"),
    )


def between_sorted(values: str, p: float) -> Column:
    """Quantile of a sorted array by linear interpolation; null if it is empty."""
    at = (F.size(values) - 1) * F.lit(p)
    low = F.try_element_at(values, (F.floor(at) + 1).cast("int"))
    high = F.try_element_at(values, (F.ceil(at) + 1).cast("int"))
    return F.when(F.size(values) > 0, low + (high - low) * (at - F.floor(at)))


def rolling_grades(samples: DataFrame, rows: int = 10, limit: int | None = None) -> DataFrame:
    """Trailing statistics over the rows in order of latitude and longitude."""
    valid = samples.filter(P.valid_sample())
    order = ["latitude", "longitude", "SampleID", "Element", "Depth_From", "Depth_To", GRADE]

    def columns(w):
        frame = w.rowsBetween(1 - rows, 0)
        g = F.col(GRADE)
        return {
            "grade_rolling_mean": F.avg(g).over(frame),
            "grade_rolling_std": F.stddev_samp(g).over(frame),
            "_q": F.sort_array(F.collect_list(g).over(frame)),  # as many values as the frame has rows
        }

    moved = moving(valid, [], order, rows - 1, 0, columns, limit)
    return moved.withColumns({
        "grade_rolling_median": between_sorted("_q", 0.5),
        "grade_rolling_q25": between_sorted("_q", 0.25),
        "grade_rolling_q75": between_sorted("_q", 0.75),
        "local_iqr": between_sorted("_q", 0.75) - between_sorted("_q", 0.25),
        "local_coefficient_variation": F.try_divide("grade_rolling_std", "grade_rolling_mean"),
    }).drop("_q")


def tonnage_curve(samples: DataFrame, density: float, limit: int | None = None) -> DataFrame:
    """Cumulative tonnage, metal and grade per element from the highest grade down."""
    rows = samples.filter(P.positive_grade() & (F.col("Interval_Length") > 0)).select(
        "SampleID", "Element", "Depth_To", GRADE, "Interval_Length")
    curve = running_totals(
        rows, ["Element"], [F.desc(GRADE), "SampleID", "Depth_To", "Interval_Length"],
        {"_length": F.col("Interval_Length"), "_content": F.col(GRADE) * F.col("Interval_Length")}, limit,
    )
    return curve.withColumns({
        "cumulative_tonnage": F.col("_length") * density, "cumulative_metal": F.col("_content") * density / 1e6,
        "cumulative_grade": F.col("_content") / F.col("_length")}).drop("_length", "_content")


def latest_model(models: DataFrame) -> DataFrame:
    """Newest model per element."""
    w = Window.partitionBy("element").orderBy(F.desc("trained"))
    return models.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str = "rank", limit: int | None = None) -> DataFrame:
    """Ranks from 1 with ties at their mean rank.

    Equal values are counted first; only distinct values are put in order.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = running_totals(counts, keys, [value], {"_upto": F.col("_n")}, limit)
    ranks = upto.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return join_on(df, ranks, [*keys, value], "left")


def lag_products(
    df: DataFrame, keys: list[str], order: list[str], value: str, lags: int = 50, limit: int | None = None,
) -> DataFrame:
    """Per series and lag: the sum of products of deviations from the mean.

    Lags run from 0 to ``min(lags, n / 4) - 1``. The lagged values come from one
    ordered pass with a frame of ``lags`` rows, not from a self-join.
    """
    present = df.filter(F.col(value).isNotNull()).select(*dict.fromkeys([*keys, *order, value]))
    means = present.groupBy(*keys).agg(F.avg(value).alias("_m"))
    if keys:  # written, so that Spark sees how small it is
        centred = join_on(present, keep(means), keys)
    else:
        centred = present.withColumn("_m", means.scalar())
    deviations = centred.withColumn("_d", F.col(value) - F.col("_m")).drop("_m")
    lagged = moving(
        deviations, keys, order, lags - 1, 0,
        lambda w: {f"_l{lag}": F.lag("_d", lag).over(w) for lag in range(1, lags)}, limit, carry=["_d"])
    sums = lagged.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("_p0"),
        *[F.sum(F.col("_d") * F.col(f"_l{lag}")).alias(f"_p{lag}") for lag in range(1, lags)])
    rows = F.inline(F.array(*[
        F.struct(F.lit(lag).cast("long").alias("lag"), F.col(f"_p{lag}").alias("product")) for lag in range(lags)]))
    return sums.select(*keys, "n", F.col("_p0").alias("power"), rows).filter(
        F.col("lag") < F.least(F.lit(lags), F.floor(F.col("n") / 4)))
