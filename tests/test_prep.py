"""Preparation, validation and features on small hand-written frames."""

import pytest
from support import rows
from pyspark.sql import functions as F

from corelode.functions import predicates as P
from corelode.functions import scalars as S
from corelode.functions.predicates import GRADE, FilterSpec
from corelode.operators import features as E
from corelode.operators import isolation as I
from corelode.operators import prep as X
from corelode.operators import profile as A
from corelode.operators import rows as R
from corelode.operators import validate as V
from corelode.schema import SAMPLES

EDGE = [
    ("S1", "H1", "D", "Cu", 5.0, 0.0, 1.0, 1.0, -15.0, -71.0, 900.0, "L1"),
    ("S1", "H1", "D", "Cu", 5.0, 0.0, 1.0, 1.0, -15.0, -71.0, 900.0, "L1"),
    ("S2", "H1", "D", "Au", None, 2.0, 1.0, 1.0, -15.0, -71.0, 900.0, None),
    ("S3", "H2", "E", "Cu", 0.0, None, 4.0, 2.0, None, None, 1500.0, "L2"),
    ("S4", "H2", "E", "Cu", -1.0, 3.0, 5.0, 2.5, 95.0, -71.0, 2500.0, ""),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SAMPLES).persist()


def value(report, field, metric):
    return report.filter((F.col("field") == field) & (F.col("metric") == metric)).first()


def test_filters(edge):
    assert R.drilling_query(edge, ["CU"]).count() == 2
    assert P.apply_filters(edge, [FilterSpec("Element", "LIKE", "C%"), FilterSpec("Depth_To", "<=", 4.0)]).count() == 3
    with pytest.raises(ValueError):
        FilterSpec("nope", "=", 1).on(edge)
    with pytest.raises(ValueError):
        FilterSpec("Element", "; DROP", 1).on(edge)
    with pytest.raises(ValueError):
        R.table_preview("users", edge)
    assert P.grade_range() is None and edge.filter(P.all_of([None])).count() == 5


def test_request_errors(spark):
    df = spark.createDataFrame([(0.0, 0.0, 5.0, 5.0), (95.0, None, 9.0, 2.0)], "latitude double, longitude double, depth_from double, depth_to double")
    assert [len(r[0]) for r in df.select(S.request_errors()).collect()] == [0, 3]
    assert [len(r[0]) for r in df.select(S.request_errors(strict_order=True)).collect()] == [1, 3]
    assert df.select(S.request_errors(depth=(6.0, 10.0))).first()[0] != []


def test_duration_text(spark):
    df = spark.createDataFrame([(5.0,), (90.0,), (7200.0,)], "s double")
    assert [r[0] for r in df.select(S.duration_text(F.col("s"))).collect()] == ["5.0s", "1.5m", "2.0h"]


def test_whole_word_mentions(spark):
    df = spark.createDataFrame([("because of that",), ("where is Cu found",)], "q string")
    assert [r[0] for r in df.select(S.element_mention(F.col("q"))).collect()] == ["Au", "Cu"]
    assert [r[0] for r in df.select(S.element_mention(F.col("q"), True)).collect()] == [None, "Cu"]


def test_checks(edge):
    coordinates = V.validate_coordinates(edge)
    assert value(coordinates, "latitude", "null_count")["value"] == 1
    assert value(coordinates, "latitude", "out_of_range")["passed"] is False
    assert value(V.validate_depths(edge), "interval", "from_not_before_to")["value"] == 1
    assert value(V.duplicate_intervals(edge), "interval", "duplicate_count")["value"] == 1
    assert V.overall(V.validation_lines(edge)).first()["overall_status"] == "FAILED"
    assert V.validate_samples(edge).first()["is_valid"] is False
    assert V.validate_coordinates(edge.drop("latitude")).first()["passed"] is False
    assert V.validate_samples(edge.drop("Element")).first()["missing_columns"] == ["Element"]


def test_clean_rows_pass(spark):
    good = spark.createDataFrame([
        (f"S{i}", "H1", "D", "Cu", 5.0 + i, float(i), i + 1.0, 1.0, -15.0, -71.0, 900.0, "L1") for i in range(8)], SAMPLES)
    assert V.overall(V.validation_lines(good)).first()["overall_status"] == "PASSED"
    assert V.validation_report(good).filter("status = 'FAILED'").count() == 0


def test_empty_input(spark):
    empty = spark.createDataFrame([], SAMPLES)
    assert A.quality_metrics(empty).first()["coord_completeness_pct"] is None
    assert A.quality_check(empty).filter("check_type = 'Total Records'").first()["count_value"] == 0
    assert V.validation_lines(empty).count() > 0


def test_single_pass_checks_equal_the_union(edge):
    assert rows(A.quality_check(edge)) == rows(A.quality_union(edge))


def test_schema_reports(spark, edge):
    report = V.schema_validation(spark, {"hole_samples": edge.drop("LabCode")})
    assert report.filter("relation = 'hole_samples'").first()["missing"] == "LabCode"
    assert report.filter("relation = 'overall'").first()["valid"] is False
    assert V.schema_info(spark, {"x": edge}).count() == 12 and R.missing_columns(edge, ["Element", "nope"]) == ["nope"]


@pytest.mark.parametrize("method", ["standard", "robust", "minmax"])
def test_scale_and_back(edge, method):
    fitted = X.fit_scale(edge, ["elevation", "Depth_To"], method)
    back = X.unscale(X.scale(edge, fitted, ["elevation", "Depth_To"]), fitted, ["elevation", "Depth_To"])
    assert rows(back) == rows(edge.select(*back.columns))


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "a double")
    assert rows(X.scale(df, X.fit_scale(df, ["a"]), ["a"])) == [(0.0,), (0.0,)]


def test_impute_strategies(spark):
    df = spark.createDataFrame([(1.0, "b"), (1.0, "a"), (4.0, "a"), (None, None)], "n double, t string")
    for strategy, expected in (("mean", 2.0), ("median", 1.0), ("mode", 1.0)):
        filled = X.impute(df, X.fit_impute(df, strategy)).filter("t = 'a'").agg(F.count("*")).first()[0]
        assert filled == 3
        assert (expected, "a") in rows(X.impute(df, X.fit_impute(df, strategy)))
    assert X.impute(spark.createDataFrame([(None, "x")], "n double, t string"), X.fit_impute(df, "mean")).first()["n"] == 2.0


def test_drop_columns(spark):
    df = spark.range(50).select(
        F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), (F.col("id") * 37 % 11).cast("double").alias("c"), F.lit(1.0).alias("flat"))
    assert X.drop_low_variance(df).columns == ["a", "b", "c"]
    assert X.drop_correlated(df).columns == ["b", "c", "flat"]
    assert set(X.preprocess(df, df.columns).columns) == {"b", "c"}


def test_modified_z_without_spread(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (9.0,)], "v double")
    assert X.outliers_modified_z(df, "v").filter("modified_z IS NOT NULL").count() == 0


def test_transform_skew_needs_clean_columns(spark):
    df = spark.createDataFrame([(1.0, 0.0, -1.0), (2.0, 1.0, 2.0)], "a double, b double, c double")
    assert X.transform_skew(df).columns == ["a", "b", "c", "a_log", "a_sqrt", "b_sqrt"]


def test_split_fractions_and_stability(spark):
    df = spark.range(20_000)
    parts = {r["part"]: r["count"] for r in X.split(df, ["id"]).groupBy("part").count().collect()}
    assert abs(parts["test"] / 20_000 - 0.2) < 0.01 and abs(parts["validation"] / 20_000 - 0.16) < 0.01
    assert X.split_stability(df, ["id"]).first()["stable"]


def test_new_labels_get_no_code(spark):
    known = spark.createDataFrame([("b",), ("a",)], "Element string")
    codes = {"Element": X.label_codes(known, "Element")}
    new = spark.createDataFrame([("a",), ("z",), (None,)], "Element string")
    assert rows(X.label_encode(new, ["Element"], codes)) == [("a", 0), ("z", -1), (None, -1)]


def test_isolation_forest_finds_the_far_points(spark):
    df = spark.range(500).select("id", F.when(F.col("id") < 5, 900.0 + F.col("id")).otherwise((F.col("id") * 37 % 100).cast("double")).alias("v"))
    found = I.isolation_forest(df, ["v"], ["id"], contamination=0.02, trees=40)
    flagged = {r["id"] for r in found.filter("is_outlier").collect()}
    assert {0, 1, 2, 3, 4} <= flagged and len(flagged) <= 11
    again = I.isolation_forest(df.repartition(5), ["v"], ["id"], contamination=0.02, trees=40)
    assert flagged == {r["id"] for r in again.filter("is_outlier").collect()}


def test_feature_matrix_and_alignment(samples):
    wide = E.features_training(R.training_rows(samples))
    matrix = E.feature_matrix(wide)
    assert [c for c in matrix.columns if c != "label"] == E.REFERENCE_FEATURES
    assert matrix.dropna().count() == matrix.count()
    aligned = E.align_features(matrix.select("latitude"), ["elevation", "latitude"])
    assert aligned.columns == ["elevation", "latitude"] and aligned.first()["elevation"] == 0.0


def test_all_features(samples):
    wide = E.features_all(samples)
    assert {"lat_norm", "grade_rolling_q75", "grade_category_encoded", "avg_neighbor_grade"} <= set(E.feature_names(wide))
    assert wide.count() == samples.filter(P.valid_sample()).count()
    assert "avg_neighbor_grade" not in E.features_all(samples, neighbors=False).columns


def _shuffled(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_codes_are_small_tables_of_their_own(samples):
    rows_of = R.prediction_rows(samples, ["Cu"])
    wide = E.features_prediction(rows_of)
    assert _shuffled(wide) == 0  # no row is dealt by its element, dataset or laboratory
    codes = {r["LabCode"]: r["labcode_encoded"] for r in wide.select("LabCode", "labcode_encoded").distinct().collect()}
    known = sorted(c for c in codes if c is not None)
    assert [codes[c] for c in known] == [*range(len(known))] and codes[None] == -1


def test_group_statistics_are_small_tables_of_their_own(samples):
    wide = E.features_training(R.training_rows(samples))
    assert _shuffled(wide) <= 3  # the statistics of the samples, and the rows that meet them
    assert wide.count() == R.training_rows(samples).count()


def test_a_file_of_several_splits_is_not_dealt_again(spark, folder, monkeypatch):
    from corelode.sources import fixture

    dealt = lambda: "Repartition" in fixture.relation(spark, folder, "lineitem")._jdf.queryExecution().optimizedPlan().toString()
    assert dealt()
    monkeypatch.setattr(fixture, "SPLIT", 1)
    assert not dealt()


def test_preprocess_fits_each_step_once(spark, monkeypatch):
    kept, keep = [], X.session.keep
    monkeypatch.setattr(X.session, "keep", lambda df: kept.append(df.columns) or keep(df))
    df = spark.range(200).select(F.when(F.col("id") % 9 > 0, F.col("id").cast("double")).alias("a"), (F.col("id") * 37 % 11).cast("double").alias("c"))
    done = X.preprocess(df, ["a", "c"])
    assert kept == [["_fitted_rows", "a", "c"], ["a_lower", "a_upper", "c_lower", "c_upper"], ["a_shift", "a_width", "c_shift", "c_width"]]
    assert "ercentile" not in done._jdf.queryExecution().optimizedPlan().toString()
    ends = done.agg(*[F.round(f(c), 9) for c in ("a", "c") for f in (F.avg, F.stddev_pop)]).first()
    assert [v + 0.0 for v in ends] == [0.0, 1.0, 0.0, 1.0]


def test_quartiles_of_a_column_share_their_values(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("v"), (F.col("id") % 2).alias("k"))
    got = X.quantiles(df, ["k"], {"q1": (F.col("v"), 0.25), "q3": (F.col("v"), 0.75), "same": (F.col("v"), 0.25)})
    assert rows(got) == [(0, 2.0, 6.0, 2.0), (1, 3.0, 7.0, 3.0)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("percentile(") == 1


@pytest.mark.parametrize("labs", [3, 150])  # bits of one word, of several
def test_summary_counts_without_copies_of_rows(spark, labs):
    samples = spark.range(400).select(
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("S"), F.col("id") % 90)).alias("SampleID"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("H"), F.col("id") % 13)).alias("Hole_ID"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("E"), F.col("id") % 3)).alias("Element"), F.concat(F.lit("D"), F.col("id") % 2).alias("DataSet"),
        F.when(F.col("id") % 6 > 0, F.concat(F.lit("L"), F.col("id") % labs)).alias("LabCode"), F.when(F.col("id") % 11 > 0, F.col("id").cast("double")).alias(GRADE))
    present = samples.filter(F.col(GRADE).isNotNull())
    got = A.data_summary(samples)
    assert rows(got) == rows(A._data_summary_expanded(present))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Expand" in line and ("SampleID" in line or "Hole_ID" in line)]
    assert A.data_summary(samples.limit(0)).isEmpty()


def test_summary_beyond_the_bits(spark, monkeypatch):
    samples = spark.createDataFrame(EDGE, "SampleID string, Hole_ID string, DataSet string, Element string, standardized_grade_ppm double, a double, b double, c double, d double, e double, f double, LabCode string")
    small = rows(A.data_summary(samples))
    monkeypatch.setattr(A, "BITS", 2)
    assert rows(A.data_summary(samples)) == small
