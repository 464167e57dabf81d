"""Writing predictions, maps, grids, models and reports.

Every writer leaves a folder with one file per partition; small documents
(metadata, reports) are written by a single partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelode.schema import PREDICTION_COLUMNS


def flat_predictions(records: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Prediction records as the nine flat columns, then ``errors`` as text and the carried columns."""
    more = [F.array_join("errors", "; ").alias("errors")] if "errors" in records.columns else []
    taken = [c for c in carry if c not in PREDICTION_COLUMNS and c != "errors"]
    return records.select(
        F.col("coordinates.latitude").alias("latitude"), F.col("coordinates.longitude").alias("longitude"),
        F.col("depth.from").alias("depth_from"), F.col("depth.to").alias("depth_to"), "element", "predicted_grade_ppm",
        F.col("confidence_interval.lower").alias("confidence_lower"), F.col("confidence_interval.upper").alias("confidence_upper"),
        F.col("metadata.prediction_timestamp").alias("prediction_timestamp"), *more, *taken).select(
        *PREDICTION_COLUMNS, *(["errors"] if more else []), *taken)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def feature(latitude: Column, longitude: Column, concentration: Column) -> Column:
    """A point feature as a struct."""
    return F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(longitude, latitude).alias("coordinates")).alias("geometry"),
        F.struct(concentration.alias("concentration")).alias("properties"))


def geojson_lines(points: DataFrame) -> DataFrame:
    """One feature per row as JSON text (a GeoJSON sequence)."""
    return points.select(F.to_json(feature(F.col("latitude"), F.col("longitude"), F.col("concentration"))).alias("value"))


def write_geojson(points: DataFrame, path: str) -> None:
    geojson_lines(points).write.mode("overwrite").text(path)


def write_grid(scored: DataFrame, path: str, summary: DataFrame) -> None:
    """Grid rows beside a document with the grid's size and statistics (one row)."""
    write_csv(scored, f"{path}/grid")
    write_document(summary, f"{path}/metadata")


def write_document(one_row: DataFrame, path: str) -> None:
    one_row.coalesce(1).write.mode("overwrite").json(path)


def write_text_report(metrics: DataFrame, path: str, title: str) -> None:
    """Metrics as lines ``name: value`` under a title (one line per column and row)."""
    numbers = [f.name for f in metrics.schema.fields if f.dataType.simpleString() in ("double", "bigint", "int", "float")]
    lines = metrics.select(F.explode(F.concat(
        F.array(F.lit(title)), F.array(*[F.concat(F.lit(f"{c}: "), F.format_string("%.4f", F.col(c).cast("double"))) for c in numbers]),
    )).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_element_report(metrics: DataFrame, path: str, title: str, key: str = "Element") -> None:
    """A section per element, in its order: the element, then ``name: value`` for each of its numbers."""
    numbers = [f.name for f in metrics.schema.fields if f.name != key and f.dataType.simpleString() in ("double", "bigint", "int", "float")]
    section = F.array(F.concat(F.lit("element: "), key), *[F.concat(F.lit(f"{c}: "), F.format_string("%.4f", F.col(c).cast("double"))) for c in numbers])
    lines = metrics.select(F.col(key).alias("_k"), F.posexplode(section).alias("_n", "value"))
    head = metrics.sparkSession.range(1).select(F.lit(None).cast("string").alias("_k"), F.lit(0).alias("_n"), F.lit(title).alias("value"))
    head.unionByName(lines).coalesce(1).sortWithinPartitions(F.col("_k").asc_nulls_first(), "_n").select("value").write.mode("overwrite").text(path)


def batch_report(outcomes: DataFrame) -> DataFrame:
    """One row on a run over several elements (element, success, r2): tried, successful, share, best and mean R²."""
    done = F.col("success")
    return outcomes.agg(
        F.count("*").alias("elements"), F.count_if(done).alias("successful"), F.count_if(~done).alias("failed"),
        F.avg(done.cast("double")).alias("success_rate"), F.avg(F.when(done, F.col("r2"))).alias("mean_r2"),
        F.max_by("element", F.when(done, F.col("r2"))).alias("best_element"))


def append_history(metrics: DataFrame, path: str) -> None:
    """Add performance lines to a history table."""
    metrics.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(path)


def save_parameters(fitted: dict[str, DataFrame], path: str) -> None:
    """Fitted one-row parameters (scalers, fills, bounds), one table each."""
    for name, one_row in fitted.items():
        one_row.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def load_parameters(spark, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def fitted_summary(fitted: dict[str, DataFrame], spark) -> DataFrame:
    """What is fitted: name and number of parameters."""
    return spark.createDataFrame([(n, len(df.columns)) for n, df in fitted.items()], "name string, parameters int")
