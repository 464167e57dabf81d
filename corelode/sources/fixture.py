"""Assay relations derived from the driver tables.

The expressions are plain SQL that Spark and DuckDB read alike, so that an
oracle starts from the very same relation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_HOLE_LATITUDE = "CAST(-15.24 AS DOUBLE) + CAST(({key} * 7919) % 10007 AS DOUBLE) / 100070"
_HOLE_LONGITUDE = "CAST(-71.88 AS DOUBLE) + CAST(({key} * 4729) % 7001 AS DOUBLE) / 100014"

HOLE_SAMPLES = f"""SELECT concat('S', l_orderkey, '-', l_linenumber) AS SampleID,
 concat('H', l_suppkey) AS Hole_ID,
 CASE l_returnflag WHEN 'A' THEN 'Drilling_BF' WHEN 'N' THEN 'Drilling_INF' ELSE 'Drilling_OP' END AS DataSet,
 CASE l_partkey % 6 WHEN 0 THEN 'Cu' WHEN 1 THEN 'Au' WHEN 2 THEN 'Zn' WHEN 3 THEN 'Pb' WHEN 4 THEN 'Fe' ELSE 'Ag' END AS Element,
 CASE WHEN l_orderkey % 97 = 5 THEN NULL WHEN l_orderkey % 89 = 3 THEN CAST(0 AS DOUBLE)
      WHEN l_orderkey % 113 = 7 THEN CAST(-1 AS DOUBLE) ELSE CAST(floor(l_extendedprice * 4) AS DOUBLE) / 4 END AS standardized_grade_ppm,
 CASE WHEN l_orderkey % 101 = 9 THEN NULL ELSE CAST(l_orderkey % 200 AS DOUBLE) END AS Depth_From,
 CAST(l_orderkey % 200 AS DOUBLE) + CAST(CAST(l_quantity AS INT) % 12 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS Depth_To,
 CAST(CAST(l_quantity AS INT) % 12 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS Interval_Length,
 CASE WHEN l_suppkey % 23 = 7 THEN NULL ELSE {_HOLE_LATITUDE.format(key='l_suppkey')} END AS latitude,
 CASE WHEN l_suppkey % 23 = 7 THEN NULL ELSE {_HOLE_LONGITUDE.format(key='l_suppkey')} END AS longitude,
 CAST(800 + (l_suppkey * 131) % 2400 AS DOUBLE) AS elevation,
 CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE concat('LAB', l_partkey % 5) END AS LabCode,
 l_shipdate AS sampled_at
FROM lineitem"""

# Suppliers in the red have no surveyed collar: some holes lack one.
COLLARS = f"""SELECT concat('H', s_suppkey) AS Hole_ID,
 CASE WHEN s_suppkey % 23 = 7 THEN NULL ELSE {_HOLE_LATITUDE.format(key='s_suppkey')} END AS LL_Lat,
 CASE WHEN s_suppkey % 23 = 7 THEN NULL ELSE {_HOLE_LONGITUDE.format(key='s_suppkey')} END AS LL_Long,
 CAST(800 + (s_suppkey * 131) % 2400 AS DOUBLE) AS Elevation
FROM supplier WHERE s_acctbal >= 0"""

HOLE_GRADES = """SELECT Hole_ID, Element, DataSet,
 SUM(standardized_grade_ppm * Interval_Length) / SUM(Interval_Length) AS weighted_grade,
 MIN(Depth_From) AS From_m, MAX(Depth_To) AS To_m, SUM(Interval_Length) AS Interval_m
FROM hole_samples WHERE standardized_grade_ppm > 0
GROUP BY Hole_ID, Element, DataSet"""

REQUESTS = """SELECT event_id, user_id, ts,
 CASE event_id % 6 WHEN 0 THEN 'CU' WHEN 1 THEN 'AU' WHEN 2 THEN 'ZN' WHEN 3 THEN 'PB' WHEN 4 THEN 'FE' ELSE 'AG' END AS element,
 CASE WHEN event_id % 41 = 0 THEN CAST(95 AS DOUBLE)
      ELSE CAST(-15.24 AS DOUBLE) + CAST((user_id * 613) % 1009 AS DOUBLE) / 10090 END AS latitude,
 CAST(-71.88 AS DOUBLE) + CAST((user_id * 389) % 701 AS DOUBLE) / 10014 AS longitude,
 CASE WHEN event_id % 37 = 0 THEN CAST(60 AS DOUBLE) ELSE CAST(10 AS DOUBLE) END AS depth_from,
 CAST(50 AS DOUBLE) AS depth_to
FROM events"""

SCORED = """SELECT SampleID, Element, DataSet, standardized_grade_ppm AS y_true,
 CAST(0.9 AS DOUBLE) * standardized_grade_ppm + 50 * Interval_Length AS y_pred, sampled_at
FROM hole_samples WHERE standardized_grade_ppm > 0"""

QUESTIONS = "SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'"

# One model per element and month, with its fit; silver has none yet.
MODELS = """SELECT upper(Element) AS element,
 CAST(extract(year FROM sampled_at) * 100 + extract(month FROM sampled_at) AS BIGINT) AS trained,
 round(regr_r2(y_true, y_pred), 6) AS r2, CAST(count(*) AS BIGINT) AS samples
FROM scored WHERE Element <> 'Ag' GROUP BY 1, 2"""

# relation -> (query, relations or tables it reads)
VIEWS: dict[str, tuple[str, list[str]]] = {
    "hole_samples": (HOLE_SAMPLES, ["lineitem"]),
    "collars": (COLLARS, ["supplier"]),
    "hole_grades": (HOLE_GRADES, ["hole_samples"]),
    "requests": (REQUESTS, ["events"]),
    "scored": (SCORED, ["hole_samples"]),
    "models": (MODELS, ["scored"]),
    "questions": (QUESTIONS, ["conversations"]),
}


# Bytes of a file that one task reads at most, by Spark's default.
SPLIT = 128 << 20


def _bytes(spark: SparkSession, file: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()


def relation(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One derived relation, or a driver table, as a lazy DataFrame."""
    if name not in VIEWS:
        table = spark.read.parquet(f"{folder}/{name}.parquet")
        # The fact table of the test data is a single small file with one row group, which
        # one task would read and evaluate alone. A table of several files stays as it is,
        # and so does a file that is larger than a split: several tasks read it anyway, and
        # a fixed number of parts would grow with it.
        if name == "lineitem" and len(files := table.inputFiles()) == 1 and _bytes(spark, files[0]) <= SPLIT:
            return table.repartition(spark.sparkContext.defaultParallelism)
        return table
    query, inputs = VIEWS[name]
    frames = {i: relation(spark, folder, i) for i in inputs}
    for i in inputs:
        query = query.replace(f"FROM {i}", f"FROM {{{i}}}")
    return spark.sql(query, **frames)


def with_views(*names: str) -> str:
    """``WITH`` prefix that defines the relations for an oracle."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for i in VIEWS[name][1]:
                add(i)
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][0]})" for n in ordered) + "\n"
