"""Resource statistics: tonnage, cutoffs, distribution of grades, anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelode.functions import predicates as P
from corelode.functions.predicates import GRADE
from corelode.operators.ordered import join_on
from corelode.operators.quantiles import corrected_kurtosis, corrected_skewness, quantiles
from corelode.schema import CUTOFFS, ROCK_DENSITY


def grade_tonnage(samples: DataFrame, density: float = ROCK_DENSITY) -> DataFrame:
    """Tonnage, metal, weighted grade and grade variance (population) per element."""
    tonnes = F.col("Interval_Length") * density
    g = F.col(GRADE)
    return samples.filter(P.positive_grade() & (F.col("Interval_Length") > 0)).groupBy("Element").agg(
        F.sum(tonnes).alias("total_tonnage"), F.sum(g * tonnes / 1e6).alias("total_metal_content"),
        F.try_divide(F.sum(g * tonnes), F.sum(tonnes)).alias("average_grade"), F.var_pop(g).alias("grade_variance"))


def cutoff_curve(samples: DataFrame, cutoffs=CUTOFFS, density: float = ROCK_DENSITY) -> DataFrame:
    """Rows, tonnage and mean grade at or above each cutoff per element.

    One pass of conditional sums; the cutoffs become rows only afterwards.
    """
    g, tonnes = F.col(GRADE), F.col("Interval_Length") * density
    aggregates = [F.count("*").alias("_rows")]
    for c in cutoffs:
        hit = g >= c
        aggregates += [
            F.count_if(hit).alias(f"_n{c}"), F.sum(F.when(hit, tonnes)).alias(f"_t{c}"), F.avg(F.when(hit, g)).alias(f"_g{c}")]
    wide = samples.filter(P.positive_grade()).groupBy("Element").agg(*aggregates)
    points = F.inline(F.array(*[
        F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"_n{c}").alias("samples"),
                 (F.col(f"_n{c}") * 100.0 / F.col("_rows")).alias("percent"),
                 F.coalesce(f"_t{c}", F.lit(0.0)).alias("tonnage"), F.col(f"_g{c}").alias("mean_grade")) for c in cutoffs]))
    return wide.select("Element", points)


def geological_statistics(samples: DataFrame) -> DataFrame:
    """Moments, quantiles and, where all grades are positive, log statistics per element."""
    g = F.col(GRADE)
    known = samples.filter(g.isNotNull())
    log = F.when(g > 0, F.ln(g))
    stats = known.groupBy("Element").agg(
        F.count(g).alias("count"), F.avg(g).alias("mean"), F.stddev_samp(g).alias("std"), F.min(g).alias("min"), F.max(g).alias("max"),
        corrected_skewness(g).alias("skewness"), corrected_kurtosis(g).alias("kurtosis"),
        F.avg(log).alias("log_mean"), F.stddev_samp(log).alias("log_std"))
    marks = quantiles(known, ["Element"], {
        "q25": (g, 0.25), "median": (g, 0.5), "q75": (g, 0.75), "p90": (g, 0.9), "p95": (g, 0.95), "p99": (g, 0.99)})
    positive = F.col("min") > 0
    return join_on(stats, marks, ["Element"]).withColumns({
        "cv": F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0),
        "geometric_mean": F.when(positive, F.exp("log_mean")),
        "log_mean": F.when(positive, F.col("log_mean")), "log_std": F.when(positive, F.col("log_std"))})


def anomalies(samples: DataFrame, threshold: float = 2.0, elements=None) -> DataFrame:
    """Valid rows with their distance from the element's mean in deviations."""
    valid = samples.filter(P.all_of([P.valid_sample(), P.of_elements(elements)]))
    stats = valid.groupBy("Element").agg(F.avg(GRADE).alias("mean_grade"), F.stddev_samp(GRADE).alias("std_grade"))
    z = F.try_divide(F.abs(F.col(GRADE) - F.col("mean_grade")), F.col("std_grade"))
    return valid.join(stats, "Element").select(
        "Hole_ID", "SampleID", "Element", GRADE, "latitude", "longitude", "DataSet", "LabCode", "mean_grade", "std_grade",
        z.alias("z_score"), F.when(z > threshold, "anomaly").otherwise("normal").alias("anomaly_flag"))
