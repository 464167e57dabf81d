"""Model metrics, hypothesis tests, fits and resampling."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelode.functions import probability as B
from corelode.functions.scalars import correlation
from corelode.operators.depth import average_ranks, lag_products
from corelode.operators.ordered import join_on, running_totals
from corelode.operators.quantiles import quantiles
from corelode.schema import CUTOFFS, Z_95
from corelode.session import keep

Y, P = "y_true", "y_pred"


def _pairs(df: DataFrame) -> DataFrame:
    return df.filter(F.col(Y).isNotNull() & F.col(P).isNotNull())


def _explained(y: Column, error: Column) -> Column:
    """1 - sum of squared errors over total squares."""
    return 1 - F.try_divide(F.sum(error * error), F.var_pop(y) * F.count(y))


def _mape(y: Column, error: Column) -> Column:
    """Mean absolute percentage error over the rows whose true value is not zero."""
    return F.avg(F.try_divide(F.abs(error), F.abs(y))) * 100


def regression_metrics(df: DataFrame, keys: Sequence[str] = (), std: str | None = None) -> DataFrame:
    """Errors, bias, correlations, residual moments and error quantiles per group.

    ``std`` names a column with prediction deviations and adds the coverage of
    the 95 % interval.
    """
    keys = list(keys)
    rows = _pairs(df)
    y, p = F.col(Y), F.col(P)
    e = p - y
    aggregates = [
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        _explained(y, e).alias("r2"), _mape(y, e).alias("mape"),
        (F.avg(F.try_divide(2 * F.abs(e), F.abs(y) + F.abs(p))) * 100).alias("smape"),
        F.avg(e).alias("mean_bias"), F.avg(e).alias("residual_mean"), (F.try_divide(F.avg(e), F.avg(y)) * 100).alias("bias_percentage"),
        correlation(y, p).alias("pearson_r"), F.stddev_pop(e).alias("residual_std"),
        F.skewness(e).alias("residual_skewness"), F.kurtosis(e).alias("residual_kurtosis")]
    if std:
        half = Z_95 * F.col(std)
        aggregates += [
            F.avg((F.abs(e) <= half).cast("double")).alias("coverage_95"), F.avg(2 * half).alias("mean_pi_width"),
            F.try_divide(F.avg(2 * half), F.stddev_pop(y)).alias("pi_width_normalized")]
    metrics = rows.groupBy(*keys).agg(*aggregates)
    marks = quantiles(rows, keys, {f"abs_error_q{int(q * 100)}": (F.abs(e), q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)})
    ranked = average_ranks(average_ranks(rows.select(*keys, Y, P), keys, Y, "_ry"), keys, P, "_rp")
    spearman = ranked.groupBy(*keys).agg(correlation(F.col("_ry"), F.col("_rp")).alias("spearman_r"))
    for more in (marks, spearman):
        if keys:
            metrics = join_on(metrics, more, keys)
        else:
            metrics = metrics.withColumn("_m", more.select(F.struct("*")).scalar()).select("*", "_m.*").drop("_m")
    return metrics


def model_metrics(df: DataFrame, keys: Sequence[str] = (), cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """Fit, bias and agreement on each side of the cutoff grades."""
    y, p = F.col(Y), F.col(P)
    e = p - y
    return _pairs(df).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), _explained(y, e).alias("r2_score"),
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
        (1 - F.try_divide(F.var_pop(e), F.var_pop(y))).alias("explained_variance"), _mape(y, e).alias("mape"),
        F.avg(e).alias("bias"), (F.try_divide(F.avg(e), F.avg(y)) * 100).alias("relative_bias_percent"),
        *[F.avg(((y >= c) == (p >= c)).cast("double")).alias(f"cutoff_{c}ppm_accuracy") for c in cutoffs])


def grade_class(c: Column) -> Column:
    """Class of a grade with right-closed limits; nothing at or below zero."""
    return (
        F.when(c <= 0, F.lit(None)).when(c <= 0.1, "very_low").when(c <= 0.5, "low").when(c <= 1.0, "medium")
        .when(c <= 2.0, "high").otherwise("very_high"))


def grade_class_metrics(df: DataFrame, keys: Sequence[str] = (), high: float = 1.0) -> DataFrame:
    y, p = F.col(Y), F.col(P)
    same = F.coalesce(grade_class(y) == grade_class(p), F.lit(False))
    hit = F.count_if((y > high) & (p > high))

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))

    total = F.sum(y)
    return _pairs(df).groupBy(*keys).agg(
        F.avg(same.cast("double")).alias("grade_classification_accuracy"),
        share(hit, F.count_if(p > high)).alias("high_grade_precision"), share(hit, F.count_if(y > high)).alias("high_grade_recall"),
        F.when(total > 0, F.abs(total - F.sum(p)) / total).otherwise(0.0).alias("resource_estimation_error"),
        correlation(y, p).alias("grade_continuity_correlation"))


# The distribution function of the Poisson law with mean one, up to the largest weight
# that a chance in steps of 1e-12 can draw.
POISSON_ONE = [c for c in (sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(30)) if c < 1 - 1e-12]

Statistic = Callable[[Column, Column], Column]


def _replicate_weight(chance: Column) -> Column:
    """The Poisson weight of a chance: how many values of the distribution function it exceeds."""
    weight = F.when(chance <= POISSON_ONE[0], 0)
    for k, c in enumerate(POISSON_ONE[1:], 1):
        weight = weight.when(chance <= c, k)
    return weight.otherwise(len(POISSON_ONE))


# Chances are in steps of 1e-12; a table over their upper bits gives the weight, except next to a step of the distribution function.
CHANCES = 10**12
CELL_BITS = 20
BETWEEN = 255
# Chances that one numpy pass handles: small enough for a core's cache.
PASS_CHANCES = 1 << 15


def _weight_table() -> tuple[np.ndarray, np.ndarray]:
    """The greatest chance of each weight but the last, and the weight of each cell of chances (BETWEEN where it has several)."""
    at = [int(c * CHANCES) for c in POISSON_ONE]
    steps = np.array([max(u for u in range(u - 2, u + 3) if u / 1e12 <= c) for u, c in zip(at, POISSON_ONE)])
    first = np.arange((CHANCES >> CELL_BITS) + 1, dtype=np.int64) << CELL_BITS
    low, high = (np.searchsorted(steps, u) for u in (first, first + (1 << CELL_BITS) - 1))
    return steps, np.where(low == high, low, BETWEEN).astype(np.uint8)


def _replicate_weights(hashes: np.ndarray, replicates: int, steps: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Weights (rows, replicates): :func:`_replicate_weight` of Spark's xxhash64 of a row's hash and the replicate's number.

    ``hashes`` are xxhash64 of the row's hash alone, from which the number is hashed on.
    """
    u = np.uint64
    numbers = np.arange(1, replicates + 1, dtype=u) * u(0x9E3779B185EBCA87)
    x = (hashes.view(u) + u(0x27D4EB2F165667C5 + 4))[:, None] ^ numbers
    x = ((x << u(23)) | (x >> u(41))) * u(0xC2B2AE3D27D4EB4F) + u(0x165667B19E3779F9)
    x ^= x >> u(33)
    x *= u(0xC2B2AE3D27D4EB4F)
    x ^= x >> u(29)
    x *= u(0x165667B19E3779F9)
    x ^= x >> u(32)
    chance = x.view(np.int64)
    chance -= chance // CHANCES * CHANCES
    weight = table[chance >> CELL_BITS]
    open_ = np.nonzero(weight == BETWEEN)
    weight[open_] = np.searchsorted(steps, chance[open_])
    return weight


def _replicate_sums(rows: DataFrame, seed: int, id_columns: Sequence[str], replicates: int) -> DataFrame:
    """One row of arrays over the replicates: sums of w, w x and w x² of ``x``.

    A task makes the weights of its rows in blocks of a bounded size and adds
    them up there: no row is copied, and a task sends three numbers a replicate.
    """
    steps, table = _weight_table()
    width = max(1, PASS_CHANCES // replicates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, replicates))
        for batch in batches:
            x, hashes = np.asarray(batch.column("x")), np.array(batch.column("h"))
            powers = np.stack([np.ones(len(x)), x, x * x])
            for at in range(0, len(x), width):
                weight = _replicate_weights(hashes[at:at + width], replicates, steps, table)
                sums += powers[:, at:at + width] @ weight.astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([s.tolist()], pa.list_(pa.float64())) for s in sums], names=["s0", "s1", "s2"])

    names = [f"s{k}" for k in range(3)]
    hashed = rows.select("x", F.xxhash64(F.xxhash64(F.lit(seed), *id_columns)).alias("h"))
    summed = hashed.mapInArrow(run, ", ".join(f"{n} array<double>" for n in names))
    # a row of zeros: the sums of no rows
    none = rows.sparkSession.range(1).select(*[F.array_repeat(F.lit(0.0), replicates).alias(n) for n in names])
    return summed.unionByName(none).agg(*[vector_to_array(Summarizer.sum(array_to_vector(n))).alias(n) for n in names])


# Statistics of the sums of weights, weighted values and weighted squares.
SUMMED: dict[str, Callable[[Column, Column, Column], Column]] = {
    "mean": lambda w, wx, wxx: F.try_divide(wx, w),
    "sum": lambda w, wx, wxx: wx,
    "std": lambda w, wx, wxx: F.sqrt(F.greatest(F.lit(0.0), F.try_divide(wxx, w) - F.try_divide(wx, w) * F.try_divide(wx, w))),
    "cv": lambda w, wx, wxx: F.try_divide(SUMMED["std"](w, wx, wxx), F.try_divide(wx, w)),
}


def _quantile_of(ordered: Column, p: float) -> Column:
    """The linear-interpolated quantile of a sorted array."""
    at = (F.size(ordered) - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    value = lambda i: F.get(ordered, i)
    return value(low) + (F.coalesce(value(low + 1), value(low)) - value(low)) * (at - low)


def bootstrap_ci(
    df: DataFrame, column: str, id_columns: Sequence[str], statistic: str | Statistic = "mean",
    replicates: int = 1000, level: float = 0.95, seed: int = 42,
) -> DataFrame:
    """Percentile bootstrap with Poisson weights.

    A row's weight in a replicate comes from a hash of its identity, so the
    result does not depend on partitioning. The named statistics follow from
    sums that every task adds up over its rows (:func:`_replicate_sums`). A
    median, or a statistic of one's own, needs the values of each replicate:
    there rows are copied, and summed or counted by value where they are.
    """
    rows = df.filter(F.col(column).isNotNull()).withColumn("x", F.col(column).cast("double"))
    tail = (1 - level) / 2
    if isinstance(statistic, str) and statistic != "median":
        if statistic not in SUMMED:
            raise ValueError(f"unknown statistic {statistic}")
        f, x = SUMMED[statistic], F.col("x")
        original = rows.agg(f(F.count("x").cast("double"), F.sum(x), F.sum(x * x)).alias("s"))
        s = F.transform(F.arrays_zip("s0", "s1", "s2"), lambda z: F.when(z["s0"] > 0, f(z["s0"], z["s1"], z["s2"])))
        found = _replicate_sums(rows, seed, id_columns, replicates).select(F.array_sort(F.array_compact(s)).alias("s"))
        mean = F.aggregate("s", F.lit(0.0), lambda a, v: a + v) / F.size("s")
        spread = F.aggregate("s", F.lit(0.0), lambda a, v: a + (v - F.col("bootstrap_mean")) * (v - F.col("bootstrap_mean"))) / F.size("s")
        repeated = found.withColumn("bootstrap_mean", F.when(F.size("s") > 0, mean)).select(
            _quantile_of(F.col("s"), tail).alias("ci_lower"), _quantile_of(F.col("s"), 1 - tail).alias("ci_upper"), "bootstrap_mean",
            F.when(F.size("s") > 0, F.sqrt(spread)).alias("bootstrap_std"), F.coalesce(F.size("s"), F.lit(0)).cast("long").alias("replicates"))
        return repeated.select(original.scalar().alias("statistic"), "*", F.lit(level).alias("confidence_level"))
    draws = rows.select("x", F.xxhash64(F.lit(seed), *id_columns).alias("_h"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("b"))
    chance = F.pmod(F.xxhash64("_h", "b"), F.lit(10**12)) / 1e12
    weighted = draws.withColumn("_u", chance).withColumn("w", _replicate_weight(F.col("_u")).cast("long")).filter("w > 0").select("b", "x", "w")
    if statistic == "median":
        original = quantiles(rows, [], {"s": (F.col("x"), 0.5)})
        repeated = quantiles(weighted, ["b"], {"s": (F.col("x"), 0.5)}, weight=F.col("w"))
    else:
        original = rows.agg(statistic(F.col("x"), F.lit(1)).alias("s"))
        repeated = weighted.groupBy("b").agg(statistic(F.col("x"), F.col("w")).alias("s"))
    return repeated.agg(
        F.percentile("s", F.lit(tail)).alias("ci_lower"), F.percentile("s", F.lit(1 - tail)).alias("ci_upper"),
        F.avg("s").alias("bootstrap_mean"), F.stddev_pop("s").alias("bootstrap_std"), F.count("*").alias("replicates"),
    ).select(original.scalar().alias("statistic"), "*", F.lit(level).alias("confidence_level"))


# Fixed value: the level of the verdicts.
ALPHA = 0.05


def ttest_statistics(df: DataFrame, group: str, first: str, second: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Student's and Welch's t with degrees of freedom, two-sided p-values and verdicts."""
    a = F.when(F.col(group) == first, F.col(value))
    b = F.when(F.col(group) == second, F.col(value))
    one = df.groupBy(*keys).agg(
        F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"),
        F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "v1", "v2"))
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    gap = F.col("m1") - F.col("m2")
    e1, e2 = v1 / n1, v2 / n2
    found = one.select(
        *keys, "n1", "n2", F.try_divide(gap, F.sqrt(pooled * (1 / n1 + 1 / n2))).alias("ttest_stat"),
        (n1 + n2 - 2).cast("double").alias("ttest_df"), F.try_divide(gap, F.sqrt(e1 + e2)).alias("welch_stat"),
        F.try_divide((e1 + e2) * (e1 + e2), e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)).alias("welch_df"))
    p = {name: B.student_p_value(F.col(f"{name}_stat"), F.col(f"{name}_df")) for name in ("ttest", "welch")}
    return found.withColumns({
        "ttest_p_value": p["ttest"], "welch_p_value": p["welch"],
        "means_different": p["ttest"] < ALPHA, "means_different_welch": p["welch"] < ALPHA})


def ttest(df: DataFrame, group: str, first: str, second: str, value: str) -> dict[str, float | bool]:
    """Both tests of one group as a dictionary."""
    return ttest_statistics(df, group, first, second, value).first().asDict()


def _two_counts(df: DataFrame, group: str, first: str, second: str, value: str, keys: Sequence[str]) -> DataFrame:
    """Distinct values with their number in both samples."""
    return df.filter(F.col(value).isNotNull() & F.col(group).isin(first, second)).groupBy(*keys, value).agg(
        F.count_if(F.col(group) == first).alias("a"), F.count_if(F.col(group) == second).alias("b"))


def _sizes(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))


def _with_sizes(ordered: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    sizes = _sizes(counts, keys)
    if keys:
        return join_on(ordered, sizes, list(keys))
    return ordered.withColumn("_s", sizes.select(F.struct("*")).scalar()).select("*", "_s.*").drop("_s")


def ks_statistics(df: DataFrame, group: str, first: str, second: str, value: str, keys: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Greatest distance between two empirical distribution functions, its p-value and the verdict."""
    counts = _two_counts(df, group, first, second, value, keys)
    ordered = running_totals(counts, list(keys), [value], {"_a": F.col("a"), "_b": F.col("b")}, limit)
    both = _with_sizes(ordered, counts, keys)
    gap = F.abs(F.try_divide(F.col("_a"), F.col("n1")) - F.try_divide(F.col("_b"), F.col("n2")))
    found = both.groupBy(*keys).agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.max(gap).alias("ks_statistic"))
    size = F.sqrt(F.try_divide(F.col("n1").cast("double") * F.col("n2"), F.col("n1") + F.col("n2")))
    return found.withColumn("p_value", B.kolmogorov_p_value(F.col("ks_statistic") * size)).withColumn("distributions_different", F.col("p_value") < ALPHA)


def drift_ks(reference: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """KS statistic and p-value per column between two relations, in one job."""
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in columns]))
    tall = reference.select(F.lit("old").alias("side"), cells).unionByName(new.select(F.lit("new").alias("side"), cells))
    return ks_statistics(tall, "side", "old", "new", "value", ["field"])


def mann_whitney_statistics(df: DataFrame, group: str, first: str, second: str, value: str, keys: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """U of the first sample, the z of its tie-corrected normal approximation, its p-value and the verdict."""
    counts = _two_counts(df, group, first, second, value, keys).withColumn("_t", F.col("a") + F.col("b"))
    ordered = running_totals(counts, list(keys), [value], {"_upto": F.col("_t")}, limit)
    both = _with_sizes(ordered, counts, keys)
    rank = F.col("_upto") - (F.col("_t") - 1) / 2
    t = F.col("_t").cast("double")
    sums = both.groupBy(*keys).agg(
        F.max("n1").cast("double").alias("n1"), F.max("n2").cast("double").alias("n2"), F.sum(F.col("a") * rank).alias("r"), F.sum(t * t * t - t).alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("r") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    top = F.greatest(u, n1 * n2 - u)
    found = sums.select(*keys, n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), u.alias("mannwhitney_stat"),
                        F.try_divide(top - n1 * n2 / 2 - 0.5, spread).alias("z"))
    return found.withColumn("mannwhitney_p_value", B.normal_p_value(F.col("z"))).withColumn("distributions_different", F.col("mannwhitney_p_value") < ALPHA)


def mann_whitney(df: DataFrame, group: str, first: str, second: str, value: str) -> dict[str, float]:
    return mann_whitney_statistics(df, group, first, second, value).first().asDict()


def _distinct_positions(df: DataFrame, value: str, keys: Sequence[str], limit: int | None) -> DataFrame:
    """Distinct values with count ``_n``, cumulative count ``_upto`` and moments of the group."""
    known = df.filter(F.col(value).isNotNull())
    counts = known.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ordered = running_totals(counts, list(keys), [value], {"_upto": F.col("_n")}, limit)
    moments = known.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.stddev_samp(value).alias("s1"))
    if keys:
        return join_on(ordered, moments, list(keys))
    return ordered.withColumn("_s", moments.select(F.struct("*")).scalar()).select("*", "_s.*").drop("_s")


def _ks_distance(cdf: Column) -> Column:
    above = F.col("_upto") / F.col("n") - cdf
    below = cdf - (F.col("_upto") - F.col("_n")) / F.col("n")
    return F.max(F.greatest(above, below))


# The most values that the test below is made for.
SHAPIRO_MOST = 5_000
# Fixed values of Royston's approximation (1995), the highest power first: the two outer coefficients in 1 / root n, and the
# mean and log deviation of the transformed statistic in n up to 11 values and in ln n above.
SHAPIRO_OUTER = [-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0.0]
SHAPIRO_NEXT = [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0]
SHAPIRO_FEW = ([-6.714e-4, 0.025054, -0.39978, 0.544], [-0.0020322, 0.062767, -0.77857, 1.3822])
SHAPIRO_MANY = ([0.0038915, -0.083751, -0.31082, -1.5861], [0.0030302, -0.082676, -0.4803])


def shapiro_wilk(df: DataFrame, value: str, keys: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """W and its p-value per group of 3 to SHAPIRO_MOST values; other groups and constant ones have nulls.

    A value's weight is the expected normal value of its rank, so one ordered
    numbering and three aggregations suffice.
    """
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    sizes = known.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_x").alias("_m"))

    def with_group(rows: DataFrame, group: DataFrame) -> DataFrame:
        return join_on(rows, group, keys) if keys else rows.withColumn("_g", group.select(F.struct("*")).scalar()).select("*", "_g.*").drop("_g")

    fit = with_group(known, sizes).filter(F.col("n").between(3, SHAPIRO_MOST))
    placed = running_totals(fit, keys, ["_x"], {"_i": F.lit(1).cast("long")}, limit)
    n = F.col("n").cast("double")
    expected = lambda i: B.normal_quantile((i - 0.375) / (n + 0.25))
    placed = placed.withColumn("_e", expected(F.col("_i")))
    power = placed.groupBy(*keys, "n").agg(F.sum(F.col("_e") * F.col("_e")).alias("_p")).withColumn("_1", -expected(F.lit(1))).withColumn("_2", -expected(F.lit(2)))
    root = 1 / F.sqrt(n)
    outer = F.when(F.col("n") == 3, F.lit(math.sqrt(0.5))).otherwise(B.polynomial(SHAPIRO_OUTER, root) + F.col("_1") / F.sqrt("_p"))
    following = F.when(F.col("n") > 5, B.polynomial(SHAPIRO_NEXT, root) + F.col("_2") / F.sqrt("_p"))
    a1, a2, m1, m2 = F.col("_a1"), F.col("_a2"), F.col("_1"), F.col("_2")
    rest = F.when(F.col("n") > 5, (F.col("_p") - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)).otherwise(
        (F.col("_p") - 2 * m1 * m1) / (1 - 2 * a1 * a1))
    weights = power.withColumns({"_a1": outer, "_a2": following}).withColumn("_f", F.when(F.col("n") > 3, F.sqrt(rest))).drop("_p", "_1", "_2", "n")
    from_end = F.least(F.col("_i"), F.col("n") + 1 - F.col("_i"))
    size = F.when(from_end == 1, a1).when((from_end == 2) & (F.col("n") > 5), a2).otherwise(F.coalesce(F.abs("_e") / F.col("_f"), F.lit(0.0)))
    signed = F.when(2 * F.col("_i") < F.col("n") + 1, -size).when(2 * F.col("_i") > F.col("n") + 1, size).otherwise(0.0)
    away = F.col("_x") - F.col("_m")
    w = F.try_divide(F.pow(F.sum(signed * F.col("_x")), F.lit(2)), F.sum(away * away))
    tested = with_group(placed, weights).groupBy(*keys, "n").agg(w.alias("_w")).withColumn("shapiro_stat", F.when(F.col("_w") < 1, F.col("_w")).when(F.col("_w") >= 1, F.lit(1.0))).drop("_w")
    log_n, left = F.ln(n), F.ln(1 - F.col("shapiro_stat"))
    bound = 0.459 * n - 2.273
    few = (-F.ln(bound - left) - B.polynomial(SHAPIRO_FEW[0], n)) / F.exp(B.polynomial(SHAPIRO_FEW[1], n))
    many = (left - B.polynomial(SHAPIRO_MANY[0], log_n)) / F.exp(B.polynomial(SHAPIRO_MANY[1], log_n))
    three = F.greatest(F.lit(0.0), 6 / math.pi * (F.asin(F.sqrt("shapiro_stat")) - math.asin(math.sqrt(0.75))))
    p = F.when(F.col("n") == 3, three).when(F.col("shapiro_stat") >= 1, F.lit(1.0)).when(F.col("n") > 11, B.normal_upper(many)).when(
        left >= bound, F.lit(0.0)).otherwise(B.normal_upper(few))
    told = tested.withColumn("shapiro_p_value", F.when(F.col("shapiro_stat").isNotNull(), p)).drop("n")
    every = sizes.drop("_m")
    return join_on(every, told, keys, "left") if keys else every.withColumn("_g", told.select(F.struct("*")).scalar()).select("n", "_g.*")


def normality(df: DataFrame, value: str, keys: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """KS distance and Anderson-Darling statistic against the fitted normal law, and Shapiro-Wilk."""
    placed = _distinct_positions(df, value, keys, limit)
    x = F.col(value)
    upto, n, k = F.col("_upto").cast("double"), F.col("n").cast("double"), F.col("_n").cast("double")
    z = F.try_divide(x - F.col("m"), F.col("s1"))
    low = (upto * upto - (upto - k) * (upto - k)) * F.ln(B.normal_cdf(z))
    high = ((n - upto + k) * (n - upto + k) - (n - upto) * (n - upto)) * F.ln(B.normal_upper(z))
    size = F.max("n").cast("double")
    # Fixed value: the 5 % point of the normal case, before its size correction.
    critical = 0.787 / (1 + 4 / size - 25 / size / size)
    tested = placed.groupBy(*keys).agg(
        F.max("n").alias("n"), _ks_distance(B.normal_cdf(F.try_divide(x - F.col("m"), F.col("s")))).alias("ks_stat"),
        (-size - F.sum(low + high) / size).alias("anderson_stat"), critical.alias("anderson_5pct_critical"),
    ).withColumns({
        "ks_p_value": B.kolmogorov_p_value(F.col("ks_stat") * F.sqrt("n")), "is_normal_anderson": F.col("anderson_stat") < F.col("anderson_5pct_critical"),
    }).withColumn("is_normal_ks", F.col("ks_p_value") > ALPHA)
    shapiro = shapiro_wilk(df, value, keys, limit).drop("n").withColumn("is_normal_shapiro", F.col("shapiro_p_value") > ALPHA)
    if keys:
        return join_on(tested, shapiro, list(keys))
    return tested.withColumn("_s", shapiro.select(F.struct("*")).scalar()).select("*", "_s.*").drop("_s")


def _fit_gamma(mean: float, log_mean: float) -> tuple[float, float]:
    """Shape and scale by Newton's method on the one-row statistics."""
    s = math.log(mean) - log_mean
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        step = (math.log(k) - B.digamma(k) - s) / (1 / k - B.trigamma(k))
        k -= step
        if abs(step) < 1e-12 * k:
            return k, mean / k
    raise ArithmeticError("the gamma fit does not settle")


def _fit_weibull(rows: DataFrame, x: Column, weight: Column, log_mean: float, log_std: float) -> tuple[float, float]:
    """Shape and scale; every Newton step is one aggregation of the kept counts."""
    mean = lambda c: F.sum(c * weight) / F.sum(weight)
    k = math.pi / (log_std * math.sqrt(6))
    unit = math.exp(log_mean)
    for _ in range(25):
        ln = F.ln(x / unit)
        power = F.exp(ln * k)
        a, b, c = rows.agg(mean(power), mean(power * ln), mean(power * ln * ln)).first()
        f = b / a - 1 / k
        slope = (c * a - b * b) / (a * a) + 1 / (k * k)
        step = f / slope
        k -= step
        if abs(step) < 1e-10 * k:
            break
    else:
        raise ArithmeticError("the Weibull fit does not settle")
    mean_power = rows.agg(mean(F.exp(F.ln(x / unit) * k))).first()[0]
    return k, unit * mean_power ** (1 / k)


def fit_distributions(df: DataFrame, value: str, limit: int | None = None) -> DataFrame:
    """Fits of five laws to positive values: parameters, likelihood, AIC, BIC, KS
    and the best by AIC. The location is fixed at zero (except for the normal)."""
    rows = df.filter(F.col(value) > 0).select(F.col(value).cast("double").alias("x"))
    x = F.col("x")
    placed = keep(_distinct_positions(rows, "x", [], limit))  # different values and their counts: all that the fits read
    weight = F.col("_n").cast("double")
    s = placed.agg(F.max("n").alias("n"), F.max("m").alias("m"), F.max("s").alias("sd"), (F.sum(F.ln(x) * weight) / F.sum(weight)).alias("lm")).first()
    centred = F.ln(x) - s["lm"]
    s = s.asDict() | {"ls": placed.agg(F.sqrt(F.sum(centred * centred * weight) / F.sum(weight))).first()[0]}
    n, m, sd, lm, ls = s["n"], s["m"], s["sd"], s["lm"], s["ls"]
    k, theta = _fit_gamma(m, lm)
    w, lam = _fit_weibull(placed, x, weight, lm, ls)
    half = 0.5 * math.log(2 * math.pi)
    mean_log_likelihood = {
        "norm": -half - math.log(sd) - 0.5,
        "lognorm": -lm - math.log(ls) - half - 0.5,
        "gamma": (k - 1) * lm - m / theta - k * math.log(theta) - math.lgamma(k),
        "expon": -math.log(m) - 1,
        "weibull_min": math.log(w) - w * math.log(lam) + (w - 1) * lm - 1,
    }
    parameters = {
        "norm": [m, sd], "lognorm": [ls, 0.0, math.exp(lm)], "gamma": [k, 0.0, theta], "expon": [0.0, m], "weibull_min": [w, 0.0, lam]}
    cdfs = {
        "norm": B.normal_cdf((x - m) / sd), "lognorm": B.normal_cdf((F.ln(x) - lm) / ls), "gamma": B.gamma_cdf(x / theta, k),
        "expon": 1 - F.exp(-x / m), "weibull_min": 1 - F.exp(-F.exp(F.ln(x / lam) * w))}
    distances = placed.withColumns({f"_f_{name}": c for name, c in cdfs.items()}).agg(*[_ks_distance(F.col(f"_f_{name}")).alias(name) for name in cdfs]).first()
    out = []
    for name, params in parameters.items():
        total, size = mean_log_likelihood[name] * n, len(params)
        p = B.kolmogorov_upper(distances[name] * math.sqrt(n))
        out.append((name, [float(v) for v in params], total, 2 * size - 2 * total, size * math.log(n) - 2 * total, distances[name], p, p > 0.05))
    best = min(out, key=lambda r: r[3])[0]
    return df.sparkSession.createDataFrame(
        [(*r, r[0] == best) for r in out],
        "distribution string, parameters array<double>, log_likelihood double, aic double, bic double, ks_statistic double, "
        "ks_p_value double, fits_well boolean, best boolean")


def trend(df: DataFrame, at: Column, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of the values over ``at`` with the p-value of its slope and the verdict."""
    y = F.col(value)
    line = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(y, at).alias("trend_slope"), F.regr_intercept(y, at).alias("trend_intercept"),
        F.regr_r2(y, at).alias("trend_r_squared"))
    r2, free = F.col("trend_r_squared"), F.col("n") - 2
    t = F.sqrt(F.try_divide(r2 * free, 1 - r2))
    p = F.when(r2 >= 1, F.lit(0.0)).when(free > 0, B.student_p_value(t, free))
    return line.withColumn("trend_p_value", p).withColumn("trend_significant", F.col("trend_p_value") < ALPHA)


def autocorrelation(df: DataFrame, keys: Sequence[str], order: list[str], value: str, lags: int = 50, limit: int | None = None) -> DataFrame:
    """Correlation at every lag beside lag-1 correlation, variance and coefficient
    of variation of the series."""
    products = keep(lag_products(df, list(keys), order, value, lags, limit).withColumn(
        "autocorrelation", F.try_divide("product", "power")).drop("product", "power"))  # read twice
    spread = df.groupBy(*keys).agg(
        F.var_pop(value).alias("variance"), F.try_divide(F.stddev_pop(value), F.avg(value)).alias("coefficient_of_variation"))
    first = products.filter("lag = 1").select(*keys, F.col("autocorrelation").alias("autocorr_lag1"))
    return join_on(join_on(products, spread, list(keys)), first, list(keys), "left")


def compare_models(metrics: dict[str, DataFrame], by: str = "r2_score") -> DataFrame:
    """Metric rows of several models, best first."""
    table = None
    for name, m in metrics.items():
        row = m.withColumn("model", F.lit(name))
        table = row if table is None else table.unionByName(row)
    best_is_low = by in ("rmse", "mae", "mse", "mape")
    return table.orderBy(F.asc(by) if best_is_low else F.desc(by))
