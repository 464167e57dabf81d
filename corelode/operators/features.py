"""Feature columns for models.

Statistics of the whole relation enter as scalar subqueries, group statistics as
joins with aggregates; nothing is ordered in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelode.functions import predicates as P
from corelode.functions.predicates import GRADE
from corelode.functions.scalars import degrees_apart
from corelode.operators.depth import rolling_grades
from corelode.operators.neighbours import nearest
from corelode.operators.prep import category_codes, fit_impute, impute, label_codes, label_encode, with_row
from corelode.operators.profile import group_stats_join
from corelode.operators.quantiles import quantiles
from corelode.operators.spatial import as_references, as_targets, point_id
from corelode.schema import EPSILON
from corelode.session import keep

IDENTITY = ["SampleID", "Element", "Depth_From", "Depth_To", GRADE]

# The 35 columns of the full feature set, in order.
REFERENCE_FEATURES = [
    "latitude", "longitude", "elevation", "mid_depth", "Interval_Length", "grade_tonnage", "lat_lon_ratio",
    "distance_from_center", "depth_ratio", "interval_ratio", "log_grade", "grade_per_meter", "element_encoded",
    "dataset_encoded", "labcode_encoded", "sample_mean", "sample_std", "sample_min", "sample_max", "sample_count",
    "hole_mean", "hole_std", "hole_min", "hole_max", "hole_count", "element_mean", "element_std", "element_count",
    "dataset_mean", "dataset_std", "dataset_count", "depth_normalized", "elevation_normalized", "Depth_From", "Depth_To",
]
# the columns that do not depend on the value to predict
LEAK_FREE_FEATURES = [
    "latitude", "longitude", "elevation", "mid_depth", "Interval_Length", "lat_lon_ratio", "distance_from_center",
    "depth_ratio", "interval_ratio", "element_encoded", "dataset_encoded", "labcode_encoded", "depth_normalized",
    "elevation_normalized", "Depth_From", "Depth_To",
]

SPATIAL = ["lat_norm", "lon_norm", "distance_to_center", "angle_from_center", "quadrant"]


def features_spatial(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Standardised coordinates, distance, angle and quadrant from the mean centre of
    the ``known`` rows (the rows themselves by default)."""
    stats = (df if known is None else known).agg(
        F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"),
        F.stddev_samp("latitude").alias("lat_sd"), F.stddev_samp("longitude").alias("lon_sd"))
    dlat, dlon = F.col("latitude") - F.col("_p.lat"), F.col("longitude") - F.col("_p.lon")
    return with_row(df, stats).withColumns({
        "lat_norm": F.try_divide(dlat, F.col("_p.lat_sd")), "lon_norm": F.try_divide(dlon, F.col("_p.lon_sd")),
        "distance_to_center": F.sqrt(dlat * dlat + dlon * dlon), "angle_from_center": F.atan2(dlat, dlon),
        "quadrant": (dlat > 0).cast("long") * 2 + (dlon > 0).cast("long")}).drop("_p")


def features_neighbors(samples: DataFrame, k: int = 5, known: DataFrame | None = None) -> DataFrame:
    """Distances to and mean grade of the ``k`` nearest other samples, which are
    looked for among the ``known`` samples (the samples themselves by default).

    Samples of a hole share its collar, so at one distance the first samples (in
    order of their identity) are taken. No more than ``k + 1`` samples of a
    location can be anyone's neighbours; those stand for the location, and each
    location's neighbourhood is found once for all its samples.
    """
    valid = samples.filter(P.valid_sample())
    plain = valid if known is None else known.filter(P.valid_sample())
    first = Window.partitionBy("latitude", "longitude").orderBy(*IDENTITY)
    leaders = (
        plain.select("latitude", "longitude", *[c for c in IDENTITY]).withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= k + 1)
        .select(point_id().alias("r_id"), F.struct(*IDENTITY).alias("who")))
    sites = plain.select("latitude", "longitude").distinct().withColumn("site", point_id())
    near = nearest(as_targets(sites, "site"), as_references(sites, "site"), k + 1).drop("position")
    by_distance = Window.partitionBy("t_id").orderBy("distance", "who")
    around = (
        near.join(leaders, "r_id").withColumn("_n", F.row_number().over(by_distance)).filter(F.col("_n") <= k + 1)
        .groupBy("t_id").agg(F.sort_array(F.collect_list(F.struct("distance", "who"))).alias("_around")))  # k + 1 entries

    def mean(values: Column) -> Column:
        return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))

    def summary(position: Column) -> Column:
        """Statistics of the first k neighbours without the one at a position."""
        others = F.slice(F.filter("_around", lambda x, i: (i + 1) != position), 1, k)
        distances, grades = F.transform(others, lambda x: x["distance"]), F.transform(others, lambda x: x["who"][GRADE])
        return F.struct(
            mean(distances).alias("avg_neighbor_distance"), F.array_min(distances).alias("min_neighbor_distance"),
            F.array_max(distances).alias("max_neighbor_distance"), mean(grades).alias("avg_neighbor_grade"))

    # per location: the result for rows that are not in the list, then for each that is
    results = around.select(
        F.col("t_id").alias("site"), F.transform("_around", lambda x: x["who"]).alias("_who"),
        F.transform(F.sequence(F.lit(0), F.size("_around")), summary).alias("_results"))
    picked = F.element_at("_results", F.array_position("_who", F.struct(*IDENTITY)).cast("int") + 1)
    return (
        valid.withColumn("site", point_id()).join(results, "site").withColumn("_picked", picked)
        .select(*valid.columns, "_picked.*").withColumn("grade_vs_neighbors", F.col(GRADE) - F.col("avg_neighbor_grade")))


def features_grade(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Transforms, quartile class with its code, and anomaly score of the grade; the
    statistics are those of the ``known`` rows (the rows themselves by default)."""
    g = F.col(GRADE)
    known = df if known is None else known
    marks = quantiles(known, [], {"q1": (g, 0.25), "q2": (g, 0.5), "q3": (g, 0.75)})
    stats = with_row(known.agg(F.avg(g).alias("m"), F.stddev_samp(g).alias("s")), marks, "_q").select("m", "s", "_q.*")
    away = F.abs(g - F.col("_p.m"))
    level = (
        F.when(g <= F.col("_p.q1"), "low").when(g <= F.col("_p.q2"), "medium").when(g <= F.col("_p.q3"), "high").otherwise("very_high"))
    return with_row(df, stats).withColumns({
        "grade_log": F.log1p(g), "grade_sqrt": F.sqrt(g), "grade_squared": g * g, "grade_category": level,
        "is_anomaly": (away > 2 * F.col("_p.s")).cast("long"), "anomaly_score": F.try_divide(away, F.col("_p.s")),
    }).withColumn("grade_category_encoded", category_codes("grade_category", ["high", "low", "medium", "very_high"])).drop("_p")


def fit_location(df: DataFrame) -> DataFrame:
    """Statistics that the location features need, to be reused on new data."""
    return df.agg(
        F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"), F.min("mid_depth").alias("depth_min"),
        F.max("mid_depth").alias("depth_max"), F.max("Interval_Length").alias("interval_max"),
        F.min("elevation").alias("elevation_min"), F.max("elevation").alias("elevation_max"))


def features_location(df: DataFrame, fitted: DataFrame) -> DataFrame:
    p = lambda c: F.col(f"_p.{c}")
    return with_row(df, fitted).withColumns({
        "lat_lon_ratio": F.col("latitude") / (F.col("longitude") + EPSILON),
        "distance_from_center": degrees_apart(F.col("latitude"), F.col("longitude"), p("lat"), p("lon")),
        "depth_ratio": F.col("mid_depth") / (p("depth_max") + EPSILON),
        "interval_ratio": F.col("Interval_Length") / (p("interval_max") + EPSILON),
        "depth_normalized": (F.col("mid_depth") - p("depth_min")) / (p("depth_max") - p("depth_min") + EPSILON),
        "elevation_normalized": (F.col("elevation") - p("elevation_min")) / (p("elevation_max") - p("elevation_min") + EPSILON),
    }).drop("_p")


CODED = ["Element", "DataSet", "LabCode"]


def features_prediction(df: DataFrame, fitted: DataFrame | None = None, codes: dict[str, DataFrame] | None = None) -> DataFrame:
    """Features that need no grade; ``fitted`` and ``codes`` come from training data."""
    fitted = fitted if fitted is not None else fit_location(df)
    return features_location(label_encode(df, CODED, codes), fitted)


def features_training(
    df: DataFrame, fitted: DataFrame | None = None, codes: dict[str, DataFrame] | None = None, known: DataFrame | None = None,
) -> DataFrame:
    """Prediction features, grade features and group statistics of training rows.

    Everything fitted is taken from the plain rows (``known`` for the group
    statistics), before features widen them.
    """
    fitted = fitted if fitted is not None else fit_location(df)
    codes = codes if codes is not None else {c: keep(label_codes(df, c)) for c in CODED}
    rows = features_prediction(group_stats_join(df, known), fitted, codes)
    return rows.withColumns({
        "log_grade": F.log1p(GRADE), "grade_per_meter": F.col(GRADE) / (F.col("Interval_Length") + EPSILON)})


def features_extract(df: DataFrame) -> DataFrame:
    """Depth, grade and cell features with the distance from the median centre."""
    centre = quantiles(df, [], {"lat": (F.col("latitude"), 0.5), "lon": (F.col("longitude"), 0.5)})
    return with_row(df, centre).withColumns({
        "mid_depth": (F.col("Depth_From") + F.col("Depth_To")) / 2, "depth_range": F.col("Depth_To") - F.col("Depth_From"),
        "log_grade": F.log1p(GRADE), "grade_intensity": F.col(GRADE) * F.col("Interval_Length"),
        "spatial_hash": F.format_string("%.3f_%.3f", "latitude", "longitude"),
        "distance_from_center": degrees_apart(F.col("latitude"), F.col("longitude"), F.col("_p.lat"), F.col("_p.lon"))}).drop("_p")


def features_all(samples: DataFrame, neighbors: bool = True, k: int = 5) -> DataFrame:
    """Spatial, moving, grade and neighbour features; a sample without neighbours has null ones.

    Statistics and neighbours come from the plain samples, so the moving features
    are made once; what a row gives by itself is added after the last shuffle.
    """
    valid = samples.filter(P.valid_sample())
    moved = rolling_grades(valid)
    around = features_neighbors(moved, k, valid) if neighbors else moved
    rows = features_grade(features_spatial(around, valid), valid)
    later = [c for c in around.columns if c not in valid.columns]
    own = [c for c in rows.columns if c not in around.columns]
    moving = [c for c in later if c in moved.columns]
    grade = [c for c in own if c not in SPATIAL]
    return rows.select(*valid.columns, *[c for c in own if c in SPATIAL], *moving, *grade, *[c for c in later if c not in moving])


def feature_names(df: DataFrame) -> list[str]:
    """Columns that are features, not identifiers or the value to predict."""
    skip = {"Hole_ID", "Element", "DataSet", GRADE, "latitude", "longitude", "SampleID", "LabCode", "sampled_at"}
    return [c for c in df.columns if c not in skip]


def feature_columns(df: DataFrame, names: Sequence[str] = REFERENCE_FEATURES, carry: Sequence[str] = ()) -> DataFrame:
    """Those of the named features that exist and the value to predict as ``label``."""
    present = [c for c in names if c in df.columns]
    label = [F.col(GRADE).alias("label")] if GRADE in df.columns else []
    return df.select(
        *[F.col(c).cast("double").alias(c) for c in present], *label, *[c for c in carry if c not in present])


def feature_matrix(df: DataFrame, names: Sequence[str] = REFERENCE_FEATURES, fitted: DataFrame | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Feature columns with missing values filled by the (fitted) medians."""
    rows = feature_columns(df, names, carry)
    present = [c for c in names if c in rows.columns]
    if fitted is None:
        rows = keep(rows)  # read twice: for the medians and for the result
        fitted = fit_impute(rows, "median", present, [])
    return fill_features(rows, fitted, present)


def fill_features(rows: DataFrame, fitted: DataFrame, names: Sequence[str]) -> DataFrame:
    """Missing features replaced by the fitted values; a feature that had no
    value at all when fitted becomes zero, since trees take no gaps."""
    return impute(rows, fitted.select(*names)).fillna(0.0, subset=list(names))


def align_features(df: DataFrame, names: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """The trained features in their order; absent ones are zero."""
    return df.select(*carry, *[
        (F.col(c).cast("double") if c in df.columns else F.lit(0.0)).alias(c) for c in names])


def hole_table(samples: DataFrame) -> DataFrame:
    """Located holes of the training rows with their elevation: what scoring needs of the samples."""
    from corelode.operators.rows import training_rows

    return training_rows(samples).groupBy("Hole_ID", "latitude", "longitude").agg(F.avg("elevation").alias("elevation"))


def point_features(points: DataFrame, holes: DataFrame, location: DataFrame, key: str = "point_id") -> DataFrame:
    """Features of unseen points (key, latitude, longitude, depth_from, depth_to).

    ``holes`` (:func:`hole_table`) gives the elevation of the nearest hole and
    its distance, ``location`` the statistics fitted on the training rows.
    """
    near = nearest(as_targets(points, key), as_references(holes, "Hole_ID"), 1).join(holes.select(F.col("Hole_ID").alias("r_id"), "elevation"), "r_id")
    around = near.select(F.col("t_id").alias(key), F.col("distance").alias("min_neighbor_distance"), "elevation")
    placed = points.join(around, key, "left").withColumns({
        "Depth_From": F.col("depth_from"), "Depth_To": F.col("depth_to"),
        "mid_depth": (F.col("depth_from") + F.col("depth_to")) / 2, "Interval_Length": F.col("depth_to") - F.col("depth_from")})
    return features_location(placed, location)
