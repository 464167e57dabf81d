"""Reading samples, points, maps and model documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corelode.schema import SAMPLES

METRICS = T.MapType(T.StringType(), T.DoubleType())
MODEL_DOCUMENT = T.StructType([
    T.StructField("pipeline_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("model_path", T.StringType()),
    T.StructField("scaler_path", T.StringType()),
    T.StructField("element", T.StringType()),
    T.StructField("elements", T.ArrayType(T.StringType())),
    T.StructField("configuration", T.MapType(T.StringType(), T.StringType())),
    T.StructField("split_sizes", T.MapType(T.StringType(), T.LongType())),
    T.StructField("evaluation_results", T.StructType([
        T.StructField("test_metrics", METRICS),
        T.StructField("train_metrics", METRICS),
        T.StructField("validation_metrics", METRICS),
        T.StructField("cv_metrics", METRICS),
        T.StructField("feature_importance", T.ArrayType(T.StructType([
            T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())]))),
    ])),
    T.StructField("feature_names", T.ArrayType(T.StringType())),
])
GEOJSON = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("geometry", T.StructType([
            T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.DoubleType()))])),
        T.StructField("properties", T.StructType([T.StructField("concentration", T.DoubleType())])),
    ]))),
])
MENU = T.StructType([
    T.StructField("validTables", T.ArrayType(T.StringType())),
    T.StructField("sidebarStructure", T.ArrayType(T.StructType([
        T.StructField("title", T.StringType()),
        T.StructField("subItems", T.ArrayType(T.StructType([
            T.StructField("title", T.StringType()), T.StructField("tables", T.ArrayType(T.StringType()))]))),
    ]))),
])


def samples_from_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLES).parquet(path)


def samples_from_jdbc(
    spark: SparkSession, url: str, table: str, split_column: str, low: int, high: int, parts: int, **options: str,
) -> DataFrame:
    """Partitioned JDBC scan; Spark pushes filters and columns to the database."""
    return (
        spark.read.format("jdbc").options(url=url, dbtable=table, **options)
        .option("partitionColumn", split_column).option("lowerBound", low).option("upperBound", high)
        .option("numPartitions", parts).load())


def save_samples(samples: DataFrame, path: str) -> None:
    """Sample table laid out by element, so that element filters prune files."""
    samples.write.mode("overwrite").partitionBy("Element").parquet(path)


def points_from_csv(spark: SparkSession, path: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Points of a CSV file. ``mapping`` names the file's columns for latitude,
    longitude, depth_from and depth_to; absent depths are 0 and 10 m."""
    wanted = {"latitude": "latitude", "longitude": "longitude", "depth_from": "depth_from", "depth_to": "depth_to"} | (mapping or {})
    raw = spark.read.csv(path, header=True)
    absent = [wanted[c] for c in ("latitude", "longitude") if wanted[c] not in raw.columns]
    if absent:
        raise ValueError(f"missing columns {absent}")
    default = {"depth_from": 0.0, "depth_to": 10.0}
    carried = [c for c in raw.columns if c not in wanted.values()]
    columns = [
        (F.expr(f"try_cast(`{source}` AS DOUBLE)") if source in raw.columns else F.lit(default[name])).alias(name)
        for name, source in wanted.items()]
    return raw.select(*columns, *carried)


def test_rows_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """Sample rows of a CSV file for an evaluation."""
    return spark.read.schema(SAMPLES).csv(path, header=True, enforceSchema=False)


def model_registry(spark: SparkSession, folder: str, default: str = "CU") -> DataFrame:
    """Model documents of a folder: file, time from the file name, element
    (else the first of ``elements``, else the default), R² and feature names."""
    documents = spark.read.schema(MODEL_DOCUMENT).option("multiLine", True).json(f"{folder}/model_metadata_*.json")
    return registry_rows(documents, default)


def registry_rows(documents: DataFrame, default: str = "CU") -> DataFrame:
    stamp = F.regexp_extract(F.input_file_name(), r"model_metadata_([0-9]{8}_[0-9]{6})", 1)
    name = F.when(stamp == "", F.col("pipeline_id")).otherwise(stamp)  # a file of another name
    element = F.upper(F.coalesce("element", F.try_element_at("elements", F.lit(1)), F.lit(default)))
    metrics = F.col("evaluation_results.test_metrics")
    r2 = F.coalesce(F.try_element_at(metrics, F.lit("r2_score")), F.try_element_at(metrics, F.lit("r2")))
    return documents.select(
        element.alias("element"), name.alias("trained"), "pipeline_id", "model_type", "model_path", r2.alias("r2"),
        F.coalesce(F.size("feature_names"), F.lit(0)).alias("feature_count"), "feature_names", "configuration", "split_sizes", "evaluation_results")


def geojson_points(spark: SparkSession, path: str, sequence: bool = False) -> DataFrame:
    """Points of feature collections as rows. A collection is one document, read
    by one task; large maps come as a ``sequence`` with one feature per line."""
    if sequence:
        one = GEOJSON["features"].dataType.elementType
        features = spark.read.schema(one).json(path).select(F.struct("type", "geometry", "properties").alias("f"))
    else:
        collection = spark.read.schema(GEOJSON).option("multiLine", True).json(path)
        features = collection.select(F.explode("features").alias("f"))
    return features.filter(F.col("f.geometry.type") == "Point").select(
        F.col("f.geometry.coordinates")[1].alias("latitude"), F.col("f.geometry.coordinates")[0].alias("longitude"),
        F.col("f.properties.concentration").alias("concentration"))


def table_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The menu document as rows (section, item, table)."""
    menu = spark.read.schema(MENU).option("multiLine", True).json(path)
    allowed = menu.select(F.explode("sidebarStructure").alias("s"), "validTables")
    items = allowed.select(F.col("s.title").alias("section"), F.explode("s.subItems").alias("i"), "validTables")
    return items.select("section", F.col("i.title").alias("item"), F.explode_outer("i.tables").alias("table"), "validTables").select(
        "section", "item", "table", F.coalesce(F.array_contains("validTables", F.col("table")), F.lit(False)).alias("is_valid"))
