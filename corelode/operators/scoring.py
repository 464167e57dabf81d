"""Applying models to points, files, grids and held-out samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corelode.functions import scalars as S
from corelode.functions.predicates import GRADE
from corelode.operators.depth import latest_model
from corelode.operators.features import LEAK_FREE_FEATURES, align_features, fill_features, point_features
from corelode.operators.models import Trained, predict_interval, train_workflow
from corelode.operators.spatial import extent_of, grid_axes, grid_points, point_id, steps_for_metres

# what a point's features can be; a model for points is trained on these
POINT_FEATURES = [f for f in LEAK_FREE_FEATURES if not f.endswith("_encoded")]


def model_lookup(requests: DataFrame, models: DataFrame, fallback: str = "CU") -> DataFrame:
    """Requests with the newest model of their element, else that of ``fallback``."""
    newest = latest_model(models)
    spare = newest.filter(F.col("element") == fallback).agg(
        F.max("trained").alias("trained"), F.max_by("r2", "trained").alias("r2"))
    found = newest.select(F.col("element").alias("model_element"), "trained", "r2")
    joined = requests.join(found, F.upper(requests["element"]) == F.col("model_element"), "left")
    spared = joined.withColumn("_f", spare.select(F.struct("*")).scalar())
    return spared.withColumn("is_fallback", F.col("model_element").isNull()).withColumns({
        "model_element": F.coalesce("model_element", F.when(F.col("_f.trained").isNotNull(), F.lit(fallback))),
        "trained": F.coalesce("trained", "_f.trained"), "r2": F.coalesce("r2", "_f.r2")}).drop("_f")


def registry_summary(models: DataFrame) -> DataFrame:
    """Models per element with the newest one and its R², and the best R²."""
    return models.groupBy("element").agg(
        F.count("*").alias("models"), F.max("trained").alias("latest"), F.max_by("r2", "trained").alias("latest_r2"), F.max("r2").alias("best_r2"))


def since_last_model(models: DataFrame, now: str, active_seconds: int = 300) -> DataFrame:
    """Age of the newest model (``trained`` as yyyyMMdd_HHmmss) and whether training is active."""
    newest = F.max(F.to_timestamp("trained", "yyyyMMdd_HHmmss"))
    age = F.unix_seconds(F.to_timestamp(F.lit(now))) - F.unix_seconds("newest")
    return models.agg(newest.alias("newest")).select("newest", age.alias("age_seconds"), (age < active_seconds).alias("is_active"))


def with_depths(points: DataFrame) -> DataFrame:
    """Points with the default interval 0 to 10 m where none is given."""
    for name, default in (("depth_from", 0.0), ("depth_to", 10.0)):
        value = F.coalesce(name, F.lit(default)) if name in points.columns else F.lit(default)
        points = points.withColumn(name, value)
    return points


AT = ["latitude", "longitude", "depth_from", "depth_to"]


def score_points(points: DataFrame, trained: Trained, key: str = "point_id", strict: bool = True) -> DataFrame:
    """A prediction record for each row of ``points``, in one model's element.

    Every row comes back once, with its own columns (unless a column of the
    record has the same name): valid ones with a prediction and its interval,
    others with null ones and their ``errors``. Equal points are scored once.
    Features use what was fitted in training: location statistics, fill values
    and the holes.
    """
    ready = with_depths(points).withColumn("errors", S.request_errors(strict_order=strict))
    if key not in ready.columns:
        ready = ready.withColumn(key, F.concat_ws("|", point_id(), "depth_from", "depth_to"))
    valid = ready.filter(F.size("errors") == 0).select(*AT).distinct().withColumn("_at", F.concat_ws("|", *[F.col(c).cast("string") for c in AT]))
    wide = point_features(valid, trained.holes, trained.location, "_at")
    matrix = fill_features(align_features(wide, trained.features, [F.col(c).alias(f"_{c}") for c in AT]), trained.fills, trained.features)
    scored = predict_interval(trained.score(matrix), trained.residuals, "rmse").select(
        *[F.col(f"_{c}").alias(c) for c in AT], "predicted", F.struct("lower", "upper").alias("_interval"))
    record = {
        "element": F.lit(trained.element), "predicted_grade_ppm": F.col("predicted"), "coordinates": F.struct("latitude", "longitude"),
        "depth": F.struct(F.col("depth_from").alias("from"), F.col("depth_to").alias("to")), "confidence_interval": F.col("_interval"),
        "metadata": F.struct(
            F.lit(trained.kind).alias("model_type"), F.lit(len(trained.features)).alias("features_used"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("prediction_timestamp"))}
    own = [c for c in ready.columns if c not in (*record, *AT, "errors")]
    return ready.join(scored, AT, "left").select(*own, *[c.alias(n) for n, c in record.items()], "errors")


def score_elements(points: DataFrame, models: dict[str, Trained], key: str = "point_id") -> DataFrame:
    """Points scored for each of several elements."""
    return reduce(DataFrame.unionByName, [score_points(points, m, key) for m in models.values()])


def score_grid(samples: DataFrame, trained: Trained, metres: float, depth: tuple[float, float] = (0.0, 10.0), edge: str = "inclusive") -> tuple[DataFrame, DataFrame]:
    """Predictions over a grid on the samples' extent for one depth range, and one
    row on the grid: its size and the spread of the predictions."""
    bounds = extent_of(samples)
    steps = steps_for_metres(metres, bounds[0], bounds[1])
    n_lat, _, n_lon, _ = grid_axes(bounds, *steps, edge)
    grid = grid_points(samples.sparkSession, bounds, *steps, edge)
    records = score_points(grid.withColumns({"depth_from": F.lit(float(depth[0])), "depth_to": F.lit(float(depth[1]))}), trained, "grid_id")
    p = F.col("predicted_grade_ppm")
    summary = records.agg(F.min(p).alias("min"), F.max(p).alias("max"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("std")).select(
        F.lit(n_lat).alias("n_lat"), F.lit(n_lon).alias("n_long"), F.lit(n_lat * n_lon).alias("total_points"), F.lit(float(metres)).alias("resolution_m"),
        F.lit(trained.element).alias("element"), F.struct("min", "max", "mean", "std").alias("statistics"))
    return records, summary


def score_csv(path: str, out: str, spark: SparkSession, trained: Trained, mapping: dict[str, str] | None = None) -> DataFrame:
    """File of points to file of predictions, a line for each line; returns counts and the spread of the predictions."""
    from corelode.operators.profile import prediction_stats
    from corelode.sources.readers import points_from_csv
    from corelode.sources.writers import flat_predictions, write_csv

    records = score_points(points_from_csv(spark, path, mapping), trained)
    carried = [c for c in records.columns if c not in ("coordinates", "depth", "confidence_interval", "metadata", "errors", "element", "predicted_grade_ppm")]
    flat = flat_predictions(records, carried)
    write_csv(flat, out)
    written = spark.read.csv(out, header=True, schema=flat.schema)
    counts = written.groupBy("element").agg(F.count("*").alias("lines"), F.count("predicted_grade_ppm").alias("successful"))
    return prediction_stats(written, "predicted_grade_ppm", ["element"]).join(counts, "element")


def verify_samples(held_out: DataFrame, predictions: DataFrame, ids: list[str]) -> DataFrame:
    """Actual against predicted grades with errors, accuracy and its level."""
    joined = held_out.select(*ids, F.col(GRADE).alias("actual")).join(predictions.select(*ids, "predicted"), ids)
    accuracy = S.sample_accuracy(F.col("actual"), F.col("predicted"))
    return joined.withColumns({
        "absolute_error": F.abs(F.col("actual") - F.col("predicted")),
        "relative_error": S.relative_error(F.col("actual"), F.col("predicted")), "accuracy": accuracy}).withColumn(
        "level", S.accuracy_level(F.col("accuracy")))


def confidence_metrics(records: DataFrame) -> DataFrame:
    """Records with the class of their interval's width and of their region."""
    lower, upper = F.col("confidence_interval.lower"), F.col("confidence_interval.upper")
    return records.withColumns({
        "interval_width": upper - lower, "confidence_level": S.interval_confidence(lower, upper),
        "region_level": S.region_confidence(F.col("coordinates.latitude"), F.col("coordinates.longitude"))})


def compare_predictions(first: DataFrame, second: DataFrame, keys: list[str], column: str, tolerance: float = 0.01) -> DataFrame:
    """Two predictions of the same points, their difference and whether they agree."""
    a = first.select(*keys, F.col(column).alias("first"))
    b = second.select(*keys, F.col(column).alias("second"))
    gap = F.abs(F.col("first") - F.col("second"))
    return a.join(b, keys).withColumns({"difference": gap, "identical": gap < tolerance})


def train_for_points(samples: DataFrame, element: str, **options) -> Trained:
    return train_workflow(samples, element, features=POINT_FEATURES, **options)
