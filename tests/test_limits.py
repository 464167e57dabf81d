"""Results do not depend on limits, and no row is lost at an edge."""

import math

import pytest
from pyspark.sql import functions as F

from corelode.operators.neighbours import element_correlations, pairs_within_km
from corelode.operators.quantiles import quantiles
from corelode.operators.spatial import cluster_dbscan


@pytest.mark.parametrize("limit", [1, 2**40])
def test_groups_without_values_stay(spark, limit):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), (None, 5.0)], "k string, v double")
    got = {r["k"]: r["m"] for r in quantiles(df, ["k"], {"m": (F.col("v"), 0.5)}, limit).collect()}
    assert got == {"a": 1.5, "b": None, None: 5.0}


def _points(spark, tag, rows):
    return spark.createDataFrame(rows, f"{tag}_id long, {tag}_lat double, {tag}_lon double")


def test_pairs_across_the_date_line_and_at_the_poles(spark):
    rows = [(1, 0.0, 179.999), (2, 0.0, -179.999), (3, 89.99, 0.0), (4, 89.99, 120.0), (5, -90.0, 0.0), (6, -89.999, 77.0), (7, 45.0, 10.0)]
    got = {(r["a_id"], r["b_id"]) for r in pairs_within_km(_points(spark, "a", rows), _points(spark, "b", rows), 3.0).collect()}

    def km(p, q):
        a, b, c, d = map(math.radians, (p[1], p[2], q[1], q[2]))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    assert got == {(p[0], q[0]) for p in rows for q in rows if km(p, q) <= 3.0}
    assert {(1, 2), (3, 4), (5, 6)} <= got


def test_long_chain_is_one_cluster(spark):
    points = spark.range(2000).select(F.col("id").alias("n"), (F.col("id") * 1.0).alias("x"), F.lit(0.0).alias("y"))
    labels = cluster_dbscan(points, ["x", "y"], 1.5, 2).select("cluster").distinct().collect()
    assert [r["cluster"] for r in labels] == [0]


def test_correlation_of_large_grades(spark):
    rows = [(f"H{i}", 0.0, 1.0, e, 1e6 + v, 0.0, 0.0) for i in range(200) for e, v in (("Au", math.sin(i)), ("Cu", math.sin(i) * 0.2 + math.cos(7 * i)))]
    df = spark.createDataFrame(rows, "Hole_ID string, Depth_From double, Depth_To double, Element string, standardized_grade_ppm double, latitude double, longitude double")
    a, b = ([r[4] - 1e6 for r in rows if r[3] == e] for e in ("Au", "Cu"))
    ma, mb = sum(a) / 200, sum(b) / 200
    want = sum((x - ma) * (y - mb) for x, y in zip(a, b)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))
    assert element_correlations(df).first()["correlation"] == pytest.approx(want, abs=1e-7)


@pytest.mark.parametrize("kind", ["totals", "moving", "quantiles"])
def test_split_runs_read_their_input_twice_at_most(spark, kind):
    """Once to measure and once to keep it; all else reads the kept table."""
    from corelode.operators.depth import rolling_grades
    from corelode.operators.ordered import running_totals

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    n = 400
    base = spark.range(n).select(
        F.col("id").cast("string").alias("SampleID"), F.lit("Cu").alias("Element"), (F.col("id") % 7 + 1.0).alias("standardized_grade_ppm"), F.lit(0.0).alias("Depth_From"),
        F.lit(1.0).alias("Depth_To"), F.lit(1.0).alias("Interval_Length"), (F.col("id") / 1e4).alias("latitude"), F.lit(1.0).alias("longitude"), F.lit("H").alias("Hole_ID"))
    df = base.mapInArrow(counted, base.schema)
    if kind == "totals":
        out = running_totals(df, ["Hole_ID"], ["SampleID"], {"t": F.col("standardized_grade_ppm")}, 50)
    elif kind == "moving":
        out = rolling_grades(df, limit=50)
    else:
        out = quantiles(df, ["Hole_ID"], {"m": (F.col("standardized_grade_ppm"), 0.5)}, 50)
    out.collect()
    assert seen.value <= 2 * n


def test_element_filter_reaches_the_scan(spark, tmp_path):
    from corelode.functions.predicates import of_elements

    spark.createDataFrame([("Cu",), ("CU",), ("au",), ("Zn",)], "Element string").write.parquet(str(tmp_path / "e"))
    found = spark.read.parquet(str(tmp_path / "e")).filter(of_elements(["cu", "Au"]))
    assert sorted(r["Element"] for r in found.collect()) == ["CU", "Cu", "au"]
    assert "In(Element" in found._jdf.queryExecution().executedPlan().toString()
