"""Training, cross-validation, saving, scoring, sources and sinks on a planted trend."""

import json

import pytest
from support import rows
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from corelode.functions.predicates import GRADE
from corelode.operators import models as M
from corelode.operators import scoring as I
from corelode.operators import stats as T
from corelode.sources import readers as SR
from corelode.sources import writers as SW

TINY = dict(maxIter=8, maxDepth=3)


@pytest.fixture(scope="module")
def planted(spark):
    """label = 3 x1 - 2 x2 + small noise."""
    u = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10_000)) / 10_000
    return spark.range(1200).select(
        "id", u(1).alias("x1"), u(2).alias("x2"), u(3).alias("x3"),
        (20 + 30 * u(1) - 20 * u(2) + u(4) - 0.5).alias("label"), F.col("id").alias("day")).persist()


@pytest.fixture(scope="module")
def trend_samples(spark):
    """Holes on a lattice whose grade grows to the north and with depth."""
    i = F.col("id")
    hole = i % 60
    lat, lon, start = -15.2 + (hole % 10) / 200, -71.85 + F.floor(hole / 10) / 200, (F.floor(i / 60) % 12).cast("double") * 5
    return spark.range(1440).select(
        F.concat(F.lit("S"), i).alias("SampleID"), F.concat(F.lit("H"), hole).alias("Hole_ID"), F.lit("Drilling_BF").alias("DataSet"),
        F.when(i % 4 == 3, "Au").otherwise("Cu").alias("Element"), (1000 + 20000 * (lat + 15.2) * 5 + start * 10 + i % 7).alias(GRADE),
        start.alias("Depth_From"), (start + 5).alias("Depth_To"), F.lit(5.0).alias("Interval_Length"), lat.alias("latitude"), lon.alias("longitude"),
        (1000 + hole).cast("double").alias("elevation"), F.lit("L1").alias("LabCode")).persist()


X = ["x1", "x2", "x3"]


def test_gbt_learns_the_trend(spark, planted):
    model = M.train_gbt(planted, X, maxIter=30, maxDepth=4)
    scored = M.predict_nonneg(model, planted)
    assert T.model_metrics(M.as_scored(scored)).first()["r2_score"] > 0.9
    importance = M.feature_importance(model, X, spark)
    assert importance.agg(F.sum("importance")).first()[0] == pytest.approx(1)
    assert M.top_features(importance, 1).first()["feature"] == "x1"
    low = M.predict_interval(scored, M.residual_row(scored)).filter("lower < 0 OR lower > predicted OR upper < predicted")
    assert low.count() == 0


def test_folds(planted):
    folds = M.kfold_cv(planted, X, LinearRegression, ["id"], 4)
    assert folds.filter("part = 'test'").agg(F.sum("n")).first()[0] == 1200 and folds.count() == 8
    summary = M.cv_summary(folds).filter("part = 'test'").first()
    assert summary["r2_mean"] > 0.99 and summary["rmse_std"] < summary["rmse_mean"]


def test_stratified_folds_are_balanced(planted):
    folded = M.with_stratified_folds(planted, ["id"], 4)
    ends = planted.agg(F.min("label"), F.max("label")).first()
    bins = folded.withColumn("bin", F.floor((F.col("label") - ends[0]) / ((ends[1] - ends[0]) / 10)))
    spread = bins.groupBy("bin", "fold").count().groupBy("bin").agg((F.max("count") - F.min("count")).alias("gap"))
    assert spread.filter("bin < 10").agg(F.max("gap")).first()[0] <= 2
    assert M.stratified_cv(planted, X, LinearRegression, ["id"], 3).count() == 6


def test_expanding_folds_test_on_later_rows(planted):
    folds = M.expanding_cv(planted, X, LinearRegression, "day", 3).filter("part = 'train'").orderBy("fold_number").collect()
    assert [f["n"] for f in folds] == sorted(f["n"] for f in folds) and len(folds) == 3


def test_searches(planted):
    grid = M.grid_search(planted, X, ["id"], {"maxDepth": [1, 3]}, 2, dict(maxIter=5))
    assert grid.first()["parameters"] == {"maxDepth": "3"}
    some = M.random_search(planted, X, ["id"], {"maxDepth": [1, 2, 3]}, 2, 2, base=dict(maxIter=3))
    assert some.count() == 2
    both = M.progressive_search(planted, X, ["id"], [("grid", {"grid": {"maxDepth": [1]}}), ("random", {"grid": {"maxDepth": [2, 3]}, "n": 1})], 2, dict(maxIter=3))
    assert rows(both, "stage") == [(0,), (1,)]


def test_ensembles(spark, planted):
    ensemble = M.voting_ensemble(planted, X, ["id"], folds=2, best=3, trees=5, depth=3)
    assert len(ensemble.members) == 3
    assert set(ensemble.scores) == {"random_forest", "gradient_boosting", "extra_trees", "linear", "ridge", "lasso", "radial_basis"}
    assert all(r2 > 0.7 for r2 in ensemble.scores.values())
    scored = ensemble.transform(planted)
    assert T.model_metrics(M.as_scored(scored)).first()["r2_score"] > 0.8 and scored.filter("prediction_std < 0").count() == 0
    assert ensemble.importance(spark).agg(F.sum("importance")).first()[0] == pytest.approx(1)
    stack = M.stacking(planted, X, ["id"], ("random_forest", "ridge"), 2, trees=5, depth=3)
    assert T.model_metrics(M.as_scored(stack.transform(planted))).first()["r2_score"] > 0.95


@pytest.fixture(scope="module")
def trained(trend_samples):
    return I.train_for_points(trend_samples, "cu", **TINY)


def test_workflow_beats_the_mean(trained):
    assert trained.metrics.filter("part = 'test'").first()["r2_score"] > 0.5
    assert {r["part"] for r in trained.metrics.collect()} == {"train", "validation", "test"}


def test_full_feature_set_is_an_option(trend_samples):
    from corelode.operators.features import REFERENCE_FEATURES

    found = M.train_workflow(trend_samples, "cu", features=REFERENCE_FEATURES, **TINY)
    assert found.features == REFERENCE_FEATURES


def test_one_failing_element_does_not_stop_the_others(trend_samples):
    done, table = M.train_elements(trend_samples, ["Cu", "Zn"], **TINY)
    assert set(done) == {"CU"} and rows(table, "element", "success") == [("CU", True), ("ZN", False)]


def test_save_load_registry_and_scoring(spark, trained, trend_samples, tmp_path):
    folder = str(tmp_path)
    M.save_model(trained, folder, "20250102_030405")
    loaded = M.load_model(spark, folder, "20250102_030405")
    points = spark.createDataFrame(
        [("p1", -15.18, -71.84, 0.0, 5.0), ("p2", -15.15, -71.83, None, None), ("bad", 99.0, 0.0, 0.0, 5.0)],
        "point_id string, latitude double, longitude double, depth_from double, depth_to double")
    a, b = (rows(I.score_points(points, m), "point_id", "predicted_grade_ppm") for m in (trained, loaded))
    assert a == b and [(r[0], r[1] is None) for r in a] == [("bad", True), ("p1", False), ("p2", False)]
    entry = SR.model_registry(spark, folder).first()
    assert entry["element"] == "CU" and entry["trained"] == "20250102_030405" and entry["feature_count"] == len(trained.features)
    assert entry["r2"] == pytest.approx(trained.metrics.filter("part = 'test'").first()["r2_score"])
    assert M.model_info(loaded).first()["trees"] == TINY["maxIter"]
    assert M.evaluate_saved(loaded, trend_samples).first()["r2_score"] > 0.5
    age = I.since_last_model(SR.model_registry(spark, folder), "2025-01-02 03:05:05").first()
    assert age["age_seconds"] == 60 and age["is_active"]


def test_points_file_to_prediction_file(spark, trained, trend_samples, tmp_path):
    (tmp_path / "in.csv").write_text("y,x,name\n-15.18,-71.84,a\n-15.16,-71.83,b\n,-71.8,c\n")
    stats = I.score_csv(str(tmp_path / "in.csv"), str(tmp_path / "out"), spark, trained, {"latitude": "y", "longitude": "x"}).first()
    assert stats["lines"] == 3 and stats["successful"] == 2 and stats["count"] == 2 and stats["min"] <= stats["median"] <= stats["max"]
    with pytest.raises(ValueError):
        SR.points_from_csv(spark, str(tmp_path / "in.csv"))
    points = SR.points_from_csv(spark, str(tmp_path / "in.csv"), {"latitude": "y", "longitude": "x"})
    assert points.columns == ["latitude", "longitude", "depth_from", "depth_to", "name"] and points.first()["depth_to"] == 10.0


def test_grid_scoring_and_confidence(trained, trend_samples, tmp_path):
    scored, summary = I.score_grid(trend_samples, trained, 1500.0)
    assert scored.count() > 4 and scored.filter("predicted_grade_ppm < 0").count() == 0
    classes = I.confidence_metrics(scored)
    assert classes.filter("interval_width < 0").count() == 0 and {"confidence_level", "region_level"} <= set(classes.columns)
    flat = SW.flat_predictions(scored)
    SW.write_grid(flat, str(tmp_path / "g"), summary)
    size = scored.sparkSession.read.json(str(tmp_path / "g/metadata")).first()
    assert size["total_points"] == scored.count() == size["n_lat"] * size["n_long"]
    assert size["statistics"]["min"] <= size["statistics"]["mean"] <= size["statistics"]["max"]
    SW.write_json(flat, str(tmp_path / "j"))
    assert scored.sparkSession.read.json(str(tmp_path / "j")).count() == flat.count()


def test_every_line_comes_back_with_its_columns(spark, trained):
    rows_in = [(1, -15.18, -71.84, 0.0, 5.0, "x")] * 2 + [(2, 99.0, -71.84, 0.0, 5.0, "y"), (3, None, -71.8, 0.0, 5.0, None), (4, -15.18, -71.84, 5.0, 5.0, "z")]
    points = spark.createDataFrame(rows_in, "point_id long, latitude double, longitude double, depth_from double, depth_to double, note string")
    got = rows(I.score_points(points, trained).select("point_id", "note", F.col("predicted_grade_ppm").isNotNull(), F.size("errors")))
    assert got == sorted([(1, "x", True, 0), (1, "x", True, 0), (2, "y", False, 1), (3, None, False, 1), (4, "z", False, 1)], key=str)


def test_a_training_row_scores_as_in_training(trained, trend_samples):
    """Same features, hence the same prediction, whether a row is in the training matrix or a point to score."""
    from corelode.operators import features as E
    from corelode.operators.rows import training_rows

    known = training_rows(trend_samples, ["Cu"])
    matrix = E.fill_features(E.feature_columns(E.features_location(known, trained.location), trained.features, ["SampleID"]), trained.fills, trained.features)
    want = rows(trained.score(matrix), "SampleID", "predicted")
    points = known.select("SampleID", "latitude", "longitude", F.col("Depth_From").alias("depth_from"), F.col("Depth_To").alias("depth_to"))
    got = rows(I.score_points(points, trained, "SampleID"), "SampleID", "predicted_grade_ppm")
    assert got == want


def test_several_elements(trained, spark, trend_samples):
    points = spark.createDataFrame([("p1", -15.18, -71.84)], "point_id string, latitude double, longitude double")
    both = I.score_elements(points, {"CU": trained, "AU": trained})
    assert both.count() == 2


def test_verification(spark):
    held = spark.createDataFrame([(1, 100.0), (2, 50.0)], f"id int, {GRADE} double")
    found = I.verify_samples(held, spark.createDataFrame([(1, 95.0), (2, 100.0)], "id int, predicted double"), ["id"])
    assert rows(found, "id", "accuracy", "level") == [(1, 95.0, "EXCELLENT"), (2, 0.0, "POOR")]


def test_registry_fallbacks(spark, tmp_path):
    documents = {
        "20250101_000000": {"element": "AU", "evaluation_results": {"test_metrics": {"r2_score": 0.9}}, "feature_names": ["a", "b"]},
        "20250103_000000": {"element": "au", "evaluation_results": {"test_metrics": {"r2": 0.7}}},
        "20250102_000000": {"elements": ["Cu", "Au"]},
        "20250104_000000": {"pipeline_id": "x"},
    }
    for stamp, d in documents.items():
        (tmp_path / f"model_metadata_{stamp}.json").write_text(json.dumps(d, indent=1))
    (tmp_path / "notes.json").write_text("{}")
    registry = SR.model_registry(spark, str(tmp_path))
    assert rows(registry, "element", "trained", "r2", "feature_count") == [
        ("AU", "20250101_000000", 0.9, 2), ("AU", "20250103_000000", 0.7, 0), ("CU", "20250102_000000", None, 0), ("CU", "20250104_000000", None, 0)]
    wanted = spark.createDataFrame([("au",), ("Fe",)], "element string")
    found = rows(I.model_lookup(wanted, registry), "element", "model_element", "trained", "is_fallback")
    assert found == [("Fe", "CU", "20250104_000000", True), ("au", "AU", "20250103_000000", False)]
    assert rows(I.registry_summary(registry), "element", "models", "best_r2") == [("AU", 2, 0.9), ("CU", 2, None)]


def test_maps_and_menus(spark, tmp_path):
    feature = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-71.8, -15.2]}, "properties": {"concentration": 3.5}}
    (tmp_path / "map.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, feature]}, indent=1))
    points = SR.geojson_points(spark, str(tmp_path / "map.json"))
    assert rows(points) == [(-15.2, -71.8, 3.5)] * 2
    SW.write_geojson(points, str(tmp_path / "lines"))
    assert json.loads(spark.read.text(str(tmp_path / "lines")).first()[0]) == feature
    menu = {"validTables": ["a"], "sidebarStructure": [{"title": "S", "subItems": [{"title": "I", "tables": ["a", "b"]}, {"title": "J", "tables": []}]}]}
    (tmp_path / "menu.json").write_text(json.dumps(menu))
    assert rows(SR.table_catalog(spark, str(tmp_path / "menu.json"))) == [("S", "I", "a", True), ("S", "I", "b", False), ("S", "J", None, False)]


def test_parameters_reports_and_history(spark, planted, tmp_path):
    from corelode.operators import prep as XP

    fitted = {"scale": XP.fit_scale(planted, ["x1"]), "bounds": XP.fit_iqr(planted, ["x1"])}
    SW.save_parameters(fitted, str(tmp_path / "p"))
    again = SW.load_parameters(spark, str(tmp_path / "p"), ["scale", "bounds"])
    assert rows(XP.scale(planted, again["scale"], ["x1"])) == rows(XP.scale(planted, fitted["scale"], ["x1"]))
    assert rows(SW.fitted_summary(fitted, spark)) == [("bounds", 2), ("scale", 2)]
    metrics = T.model_metrics(planted.select(F.col("label").alias("y_true"), F.col("label").alias("y_pred")))
    SW.write_text_report(metrics, str(tmp_path / "r"), "Report")
    assert "mae: 0.0000" in [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()]
    for _ in range(2):
        SW.append_history(metrics, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2
    SW.write_document(metrics, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).first()["n"] == 1200


def test_sample_files(spark, trend_samples, tmp_path):
    SR.save_samples(trend_samples, str(tmp_path / "s"))
    plan = spark.read.parquet(str(tmp_path / "s")).filter("Element = 'Cu'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Element" in plan
    from corelode.operators import rows as R

    near = R.rows_in_bounds(SR.samples_from_parquet(spark, str(tmp_path / "s")), -15.2, -15.1, -71.9, -71.8, ["Cu"])
    plan = near.select("SampleID")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "elevation" not in plan.split("ReadSchema")[1]
    trend_samples.select(*[f.name for f in __import__("corelode.schema", fromlist=["SAMPLES"]).SAMPLES.fields]).write.csv(str(tmp_path / "c"), header=True)
    assert SR.test_rows_from_csv(spark, str(tmp_path / "c")).count() == 1440


def test_kept_tables_lie_in_the_applications_folder(spark):
    from corelode import session

    table = session.keep(spark.range(3))
    files = table.inputFiles()
    assert table.count() == 3 and spark.sparkContext.applicationId in files[0]


def test_registered_predictions_are_numbers(spark, folder):
    """Predictions, bounds and metrics come back; a constant zero would not pass."""
    from corelode.plans import catalog

    for key, column in (("interval_predictions", "predicted"), ("point_predictions", "predicted_grade_ppm"), ("verified_predictions", "predicted"), ("saved_predictions", "predicted")):
        got = [r[column] for r in catalog.spark_query(key)(spark, folder).collect() if r[column] is not None]
        assert len(set(got)) > 1 and max(got) > 0, key
    (saved,) = catalog.spark_query("saved_models")(spark, folder).collect()
    assert saved.r2 <= 1
    (scored,) = catalog.spark_query("saved_evaluation")(spark, folder).collect()
    assert scored.n > 0 and scored.r2_score <= 1 and scored.rmse > 0
