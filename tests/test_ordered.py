"""The split forms of ordered work equal the plain window, also for a hot key."""

import pytest
from support import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from corelode.operators import depth as D
from corelode.operators import quantiles as Q
from corelode.operators import ordered as O
from corelode.functions.predicates import GRADE


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one key, ties in the value, some nulls."""
    return spark.range(900).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"),
        F.when(F.col("id") % 11 != 0, (F.col("id") * 37 % 50).cast("double")).alias("v")).persist()


def test_running_totals_split(skewed):
    order = ["v", "id"]
    plain = O.running_totals(skewed, ["k"], order, {"s": F.col("v"), "n": F.lit(1)}, limit=10_000)
    split = O.running_totals(skewed, ["k"], order, {"s": F.col("v"), "n": F.lit(1)}, limit=40)
    assert rows(plain, "id", "s", "n") == rows(split, "id", "s", "n")


def test_row_numbers_without_keys(skewed):
    numbered = O.row_numbers(skewed, [], ["v", "id"], "n", limit=50)
    expected = skewed.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("v", "id")))
    assert rows(numbered, "id", "n") == rows(expected, "id", "n")


@pytest.mark.parametrize("keys", [["k"], []])
def test_moving_blocks(skewed, keys):
    def columns(w):
        return {"m": F.sum("v").over(w.rowsBetween(-3, 2)), "l": F.lag("id", 2).over(w), "nx": F.max("id").over(w.rowsBetween(1, 1))}

    split = O.moving(skewed, keys, ["v", "id"], 3, 2, columns, limit=25)
    plain = skewed.withColumns(columns(Window.partitionBy(*keys or [F.lit(1)]).orderBy("v", "id")))
    assert rows(split, "id", "m", "l", "nx") == rows(plain, "id", "m", "l", "nx")


def _shuffles(df):
    """Exchanges in the plan of the rows as they are now (tables kept before are scans)."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_row_numbers_split_without_a_further_shuffle(skewed):
    order = ["v", "id"]
    numbered = O.row_numbers(skewed, ["k"], order, "n", limit=40)
    expected = skewed.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    assert rows(numbered, "id", "n") == rows(expected, "id", "n")
    assert _shuffles(numbered) == 0


def test_moving_carries_only_what_is_named(skewed):
    def columns(w):
        return {"l": F.lag("id", 2).over(w)}

    wide = skewed.withColumn("text", F.col("id").cast("string"))
    plain = O.moving(wide, ["k"], ["v", "text", "id"], 2, 0, columns, limit=10_000, carry=["id"])
    split = O.moving(wide, ["k"], ["v", "text", "id"], 2, 0, columns, limit=25, carry=["id"])
    assert plain.columns == ["id", "k", "l"] and sorted(split.columns) == sorted(plain.columns)
    assert rows(split, "k", "id", "l") == rows(plain, "k", "id", "l")
    assert _shuffles(split) == 1


def test_lag_products_split(skewed):
    for keys in ([], ["k"]):
        got = [rows(D.lag_products(skewed, keys, ["id"], "v", 6, limit), *keys, "lag", "n", "product", "power") for limit in (25, 100_000)]
        assert got[0] and got[0] == got[1]


def test_quantiles_by_rank(skewed):
    wanted = {"a": (F.col("v"), 0.25), "b": (F.col("v"), 0.5), "c": (F.col("id"), 0.9)}
    for keys in ([], ["k"]):
        assert rows(Q.quantiles(skewed, keys, wanted)) == rows(Q.quantiles(skewed, keys, wanted, limit=20))


def test_weighted_quantiles_by_rank(skewed):
    wanted = {"a": (F.col("v"), 0.3)}
    w = F.col("id") % 4
    assert rows(Q.quantiles(skewed, ["k"], wanted, weight=w)) == rows(Q.quantiles(skewed, ["k"], wanted, limit=20, weight=w))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=30), st.floats(0, 1))
def test_quantile_matches_linear_interpolation(spark, values, p):
    import numpy as np

    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = Q.quantiles(df, [], {"q": (F.col("v"), p)}, limit=0 or 1).first()[0]
    assert got == pytest.approx(float(np.quantile(values, p)), rel=1e-9, abs=1e-6)


def test_null_keys_meet(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, y int")
    assert rows(O.join_on(left, right, ["k"]), "x", "y") == [(1, 10), (2, 20)]


def test_modes_take_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert Q.modes(df, ["c"]).first()["most_common"] == "a"


def test_corrected_moments(spark):
    values = [1.0, 2.0, 2.5, 9.0, 4.0, 4.5]
    import pandas as pd

    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.agg(Q.corrected_skewness(F.col("v")), Q.corrected_kurtosis(F.col("v"))).first()
    assert got[0] == pytest.approx(pd.Series(values).skew()) and got[1] == pytest.approx(pd.Series(values).kurt())


def test_depth_operators_split(samples):
    for f in (D.depth_cumulative, D.depth_moving3):
        plain, split = f(samples), f(samples, limit=30)
        assert rows(plain.drop("sampled_at"), digits=3) == rows(split.drop("sampled_at").select(*plain.drop("sampled_at").columns), digits=3)
    assert rows(D.interval_overlaps(samples)) == rows(D.interval_overlaps(samples, limit=100))


def test_tonnage_curve_split(samples):
    assert rows(D.tonnage_curve(samples, 2.7), digits=3) == rows(D.tonnage_curve(samples, 2.7, limit=150), digits=3)


def test_average_ranks(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 3.0), (3, 5.0), (4, 9.0)], "id int, v double")
    assert rows(D.average_ranks(df, [], "v"), "id", "rank") == [(1, 2.5), (2, 1.0), (3, 2.5), (4, 4.0)]
    assert rows(D.average_ranks(df, [], "v", limit=1), "id", "rank") == [(1, 2.5), (2, 1.0), (3, 2.5), (4, 4.0)]


def test_moving3_needs_three_rows(spark, samples):
    one = spark.createDataFrame(
        [("S1", "H1", "D", "Cu", 5.0, 0.0, 1.0, 1.0, -15.0, -71.0, 1.0, None)],
        "SampleID string, Hole_ID string, DataSet string, Element string, standardized_grade_ppm double, Depth_From double, Depth_To double, "
        "Interval_Length double, latitude double, longitude double, elevation double, LabCode string")
    row = D.depth_moving3(one).first()
    assert row["grade_ma3"] is None and row["grade_std3"] is None


def test_lag_products_split(samples):
    series = samples.filter(F.col(GRADE) > 0)
    args = (["Element"], ["sampled_at", "SampleID", "Depth_To", GRADE], GRADE, 6)
    a = D.lag_products(series, *args).withColumn("r", F.col("product") / F.col("power"))
    b = D.lag_products(series, *args, limit=200).withColumn("r", F.col("product") / F.col("power"))
    assert rows(a, "Element", "lag", "r") == rows(b, "Element", "lag", "r")
