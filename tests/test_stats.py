"""Tests and fits against textbook values and closed forms."""

import math

import numpy as np
import pytest
from support import rows
from pyspark.sql import functions as F

from corelode.functions import probability as B
from corelode.operators import stats as T


def test_student_p_values():
    # tabulated 5 % and 1 % points
    assert B.student_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert B.student_two_sided(2.845, 20) == pytest.approx(0.01, abs=1e-4)
    assert B.student_two_sided(0.0, 5) == pytest.approx(1.0)


def test_p_values_as_columns(spark):
    cases = [(t, v) for t in (0.0, 0.3, 1.0, 2.228, 5.0, -2.845, 30.0) for v in (1.0, 3.5, 10.0, 20.0, 500.0, 20_000.0)]
    df = spark.createDataFrame(cases, "t double, v double")
    got = df.select("t", "v", B.student_p_value(F.col("t"), F.col("v")).alias("p"), B.normal_p_value(F.col("t")).alias("z"), B.kolmogorov_p_value(F.abs("t")).alias("k")).collect()
    for r in got:
        assert r["p"] == pytest.approx(B.student_two_sided(r["t"], r["v"]), abs=1e-9)
        assert r["z"] == pytest.approx(B.normal_two_sided(r["t"]), abs=1e-6)
        assert r["k"] == pytest.approx(B.kolmogorov_upper(abs(r["t"])), abs=1e-9)


def test_kolmogorov_points():
    assert B.kolmogorov_upper(1.358) == pytest.approx(0.05, abs=1e-3)
    assert B.kolmogorov_upper(1.628) == pytest.approx(0.01, abs=1e-3)


def test_gamma_functions():
    assert B.digamma(1.0) == pytest.approx(-0.5772156649, abs=1e-9)
    assert B.trigamma(1.0) == pytest.approx(math.pi**2 / 6, abs=1e-9)


@pytest.mark.parametrize("shape", [1, 2, 3, 17, 80])
def test_gamma_law_as_a_column(spark, shape):
    x = [0.0, 1e-6, 0.3, 1.0, 2.0, 7.5, 16.9, 18.1, 40.0, 79.0, 83.0, 160.0, 900.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", B.gamma_cdf(F.col("x"), float(shape)).alias("p")).collect()
    for v, p in got:  # whole shapes: the tail of the Poisson law
        term, upper = math.exp(-v), 0.0
        for k in range(shape):
            upper += term
            term *= v / (k + 1)
        assert p == pytest.approx(1 - upper, abs=1e-10)


def test_gamma_law_of_a_half_is_the_error_function(spark):
    x = [0.01, 0.5, 1.4, 1.6, 3.0, 12.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", B.gamma_cdf(F.col("x"), 0.5).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([math.erf(math.sqrt(r.x)) for r in got], abs=1e-10)


def test_normal_quantiles(spark):
    p = [1e-9, 0.001, 0.02, 0.03, 0.3, 0.5, 0.8, 0.99, 0.999999]
    got = spark.createDataFrame([(v,) for v in p], "p double").select("p", B.normal_quantile(F.col("p")).alias("z")).collect()
    assert [math.erfc(-r.z / math.sqrt(2)) / 2 for r in got] == pytest.approx(p, rel=2e-7)


# Shapiro and Wilk's own example of eleven weights, and small ones with the values printed by statistical packages.
SHAPIRO = {
    "weights": ([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], 0.78881, 0.006704),
    "even": ([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], 0.97016, 0.89237),
    "three": ([1, 2, 4], 0.96429, 0.63689),
}


def test_shapiro_wilk_gives_textbook_values(spark):
    rows = [(k, float(v)) for k, (values, _, _) in SHAPIRO.items() for v in values] + [("same", 2.0)] * 6 + [("two", 1.0), ("two", 2.0), ("none", None)]
    got = {r.g: r for r in T.shapiro_wilk(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", ["g"]).collect()}
    for name, (values, w, p) in SHAPIRO.items():
        assert (got[name].shapiro_stat, got[name].shapiro_p_value, got[name].n) == (pytest.approx(w, abs=1e-4), pytest.approx(p, abs=1e-4), len(values))
    assert got["same"].shapiro_stat is None and got["two"].shapiro_stat is None and "none" not in got
    alone = T.shapiro_wilk(spark.createDataFrame([(float(v),) for v in SHAPIRO["weights"][0]], "v double"), "v").first()
    assert alone.shapiro_stat == pytest.approx(SHAPIRO["weights"][1], abs=1e-4)


def test_shapiro_wilk_stops_at_its_largest_size(spark):
    df = spark.range(5001).select(F.lit("big").alias("g"), F.col("id").cast("double").alias("v")).unionByName(
        spark.range(2000).select(F.lit("fits").alias("g"), F.col("id").cast("double").alias("v")))
    got = {r.g: r for r in T.shapiro_wilk(df, "v", ["g"], limit=300).collect()}
    assert got["big"].n == 5001 and got["big"].shapiro_stat is None
    assert 0.9 < got["fits"].shapiro_stat < 0.96 and got["fits"].shapiro_p_value < 1e-10


def test_normal_columns(spark):
    z = [-8.0, -3.0, -1.0, 0.0, 0.5, 1.96, 6.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select(B.normal_cdf(F.col("z")), B.normal_upper(F.col("z"))).collect()
    for v, (low, high) in zip(z, got):
        assert low == pytest.approx(math.erfc(-v / math.sqrt(2)) / 2, rel=5e-7)
        assert high == pytest.approx(math.erfc(v / math.sqrt(2)) / 2, rel=5e-7)


@pytest.fixture(scope="module")
def two(spark):
    a = [5.1, 4.9, 6.2, 5.8, 6.0, 5.5, 5.3, 6.7, 5.9, 6.1]
    b = [6.8, 6.1, 7.2, 6.5, 7.0, 7.4, 6.2, 6.9, 7.1, 6.0]
    return a, b, spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double")


def test_ttests(two):
    a, b, df = two
    got = T.ttest(df, "g", "a", "b", "v")
    va, vb = np.var(a, ddof=1), np.var(b, ddof=1)
    t = (np.mean(a) - np.mean(b)) / math.sqrt((va + vb) / 2 * 2 / 10)
    assert got["ttest_stat"] == pytest.approx(t) and got["welch_stat"] == pytest.approx(t)
    assert got["ttest_df"] == 18 and got["welch_df"] <= 18 and got["ttest_p_value"] < 0.01 and got["means_different"]


@pytest.mark.parametrize("limit", [None, 3])
def test_ks_and_mann_whitney(two, limit):
    a, b, df = two
    grid = sorted(a + b)
    d = max(abs(sum(x <= v for x in a) / 10 - sum(x <= v for x in b) / 10) for v in grid)
    assert T.ks_statistics(df, "g", "a", "b", "v", limit=limit).first()["ks_statistic"] == pytest.approx(d)
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert T.mann_whitney_statistics(df, "g", "a", "b", "v", limit=limit).first()["mannwhitney_stat"] == pytest.approx(u)
    assert T.mann_whitney(df, "g", "a", "b", "v")["mannwhitney_p_value"] < 0.05


def test_drift(spark):
    a = spark.range(200).select(F.col("id").cast("double").alias("x"), (F.col("id") % 10).cast("double").alias("y"))
    b = a.withColumn("x", F.col("x") + 150)
    got = {r["field"]: r for r in T.drift_ks(a, b, ["x", "y"]).collect()}
    assert got["x"]["p_value"] < 1e-6 and got["y"]["ks_statistic"] == 0 and got["y"]["p_value"] == 1


def test_metrics_of_a_perfect_and_a_constant_model(spark):
    perfect = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (4.0, 4.0)], "y_true double, y_pred double")
    row = T.regression_metrics(perfect).first()
    assert row["rmse"] == 0 and row["r2"] == 1 and row["spearman_r"] == pytest.approx(1) and row["mape"] == 0
    flat = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (0.0, 2.0)], "y_true double, y_pred double")
    row = T.regression_metrics(flat).first()
    assert row["pearson_r"] is None and row["mape"] == pytest.approx(50)  # the zero is left out
    assert T.model_metrics(flat).first()["n"] == 3


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "y_true double, y_pred double")
    assert T.model_metrics(empty).first()["rmse"] is None


def test_bootstrap_weights_are_those_of_the_column_expression(spark):
    df = spark.range(300).select(F.xxhash64("id").alias("h"))
    chance = F.pmod(F.xxhash64("h", "b"), F.lit(10**12)) / 1e12
    slow = df.select("h", F.explode(F.sequence(F.lit(1), F.lit(90))).alias("b")).withColumn("w", T._replicate_weight(chance)).orderBy("h", "b")
    expected = np.array([r["w"] for r in slow.collect()]).reshape(300, 90)
    hashes = np.array([r[0] for r in df.orderBy("h").select(F.xxhash64("h")).collect()])
    steps, table = T._weight_table()
    assert (T._replicate_weights(hashes, 90, steps, table) == expected).all()
    assert (T._replicate_weights(hashes, 90, steps, np.full_like(table, T.BETWEEN)) == expected).all()  # next to a step
    assert [u / 1e12 <= c < (u + 1) / 1e12 for u, c in zip(steps.tolist(), T.POISSON_ONE)] == [True] * len(steps)


def test_bootstrap_weights_are_not_made_row_by_row(spark):
    """Weights in interpreted lambdas took half an hour at 36 million rows."""
    plan = T.bootstrap_ci(spark.range(9).withColumn("v", F.lit(1.0)), "v", ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "transform(sequence" not in plan


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("v"))
    row = T.bootstrap_ci(df, "v", ["id"], "mean", 200).first()
    assert row["statistic"] == pytest.approx(9.5) and row["ci_lower"] < 9.5 < row["ci_upper"]
    assert row["bootstrap_std"] == pytest.approx(np.std(np.arange(20)) / 20, rel=0.25)
    again = T.bootstrap_ci(df.repartition(7), "v", ["id"], "mean", 200).first()
    assert again["ci_lower"] == pytest.approx(row["ci_lower"])
    plan = T.bootstrap_ci(df, "v", ["id"], "mean", 200)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    middle = T.bootstrap_ci(df, "v", ["id"], "median", 50).first()
    assert middle["ci_lower"] <= 9.5 <= middle["ci_upper"]
    own = T.bootstrap_ci(df, "v", ["id"], lambda x, w: F.sum(x * w) / F.sum(w), 200).first()
    for name in ("statistic", "ci_lower", "ci_upper", "bootstrap_mean", "bootstrap_std", "replicates"):
        assert own[name] == pytest.approx(row[name])
    for name in ("std", "cv", "sum"):
        assert T.bootstrap_ci(df, "v", ["id"], name, 100).first()["replicates"] == 100
    nothing = T.bootstrap_ci(df.limit(0), "v", ["id"], "mean", 10).first()
    assert nothing["replicates"] == 0 and nothing["ci_lower"] is None


def test_normality_tells_normal_from_skewed(spark):
    rng = np.random.default_rng(1)
    x = [float(v) for v in rng.normal(10, 2, 400)]
    df = spark.createDataFrame([(v, math.exp(v)) for v in x], "a double, b double")
    good, bad = T.normality(df, "a").first(), T.normality(df, "b").first()
    assert good["is_normal_anderson"] and not bad["is_normal_anderson"]
    s = np.sort(x)
    z = (s - np.mean(s)) / np.std(s, ddof=1)
    cdf = np.array([math.erfc(-v / math.sqrt(2)) / 2 for v in z])
    i = np.arange(1, 401)
    a2 = -400 - np.mean((2 * i - 1) * (np.log(cdf) + np.log(1 - cdf[::-1])))
    assert good["anderson_stat"] == pytest.approx(a2, abs=1e-4)


def test_fits_find_the_law(spark):
    rng = np.random.default_rng(3)
    laws = {"gamma": rng.gamma(3, 2, 2000), "weibull_min": rng.weibull(2.5, 2000) * 4, "lognorm": rng.lognormal(1, 0.6, 2000)}
    for name, values in laws.items():
        fits = {r["distribution"]: r for r in T.fit_distributions(spark.createDataFrame([(float(v),) for v in values], "v double"), "v").collect()}
        assert fits[name]["best"], name
        assert fits[name]["ks_p_value"] > 0.01
    assert fits["lognorm"]["parameters"][0] == pytest.approx(0.6, rel=0.05)


def test_trend_and_its_p_value(spark):
    df = spark.range(50).select((F.col("id") * 2.0 + 1 + F.col("id") % 3).alias("y"), F.col("id").cast("double").alias("x"))
    row = T.trend(df, F.col("x"), "y").first()
    slope, intercept = np.polyfit(range(50), [i * 2.0 + 1 + i % 3 for i in range(50)], 1)
    assert row["trend_slope"] == pytest.approx(slope) and row["trend_intercept"] == pytest.approx(intercept)
    assert row["trend_p_value"] < 1e-10 and row["trend_significant"]


def test_compare_models_puts_the_best_first(spark):
    good = spark.createDataFrame([(1.0, 1.1), (2.0, 2.1)], "y_true double, y_pred double")
    bad = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "y_true double, y_pred double")
    assert T.compare_models({"bad": T.model_metrics(bad), "good": T.model_metrics(good)}).first()["model"] == "good"
