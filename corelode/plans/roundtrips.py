"""Registered sources, sinks, ensembles and streams: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corelode.functions import predicates as P
from corelode.functions.predicates import GRADE
from corelode.operators import features as E
from corelode.operators import models as M
from corelode.operators import prep as X
from corelode.operators import profile as A
from corelode.operators import rows as R
from corelode.operators import scoring as I
from corelode.operators import stats as T
from corelode.operators import validate as V
from corelode.operators.ordered import join_on
from corelode.operators.spatial import METRES_PER_DEGREE
from corelode.operators.surrogate import Range
from corelode.plans.features import _request_points
from corelode.plans.learning import AT_POINTS, IDS, LINE, PARTED, SIMPLE, SMALL, _line, _line_scored, _matrix, _trained
from corelode.plans.registry import identity_sql, register
from corelode.plans.rows import _POINTS, G, TRAINING, VALID
from corelode.schema import SAMPLES
from corelode.session import keep, new_path
from corelode.sources import readers as SR
from corelode.sources import writers as SW
from corelode.streaming import jobs as J

STAMP = "20250101_000000"


def _points(t):
    return R.heatmap_points(t.hole_grades, t.collars).withColumn("concentration", F.round("concentration", 4))


def _csv(t):
    path, points = new_path(t.spark), _points(t)
    SW.write_csv(points, path)
    return t.spark.read.schema(points.schema).csv(path, header=True)


def _json(t):
    path, points = new_path(t.spark), _points(t)
    SW.write_json(points, path)
    return t.spark.read.schema(points.schema).json(path)


def _geojson(t):
    path = new_path(t.spark)
    SW.write_geojson(_points(t), path)
    return SR.geojson_points(t.spark, path, sequence=True)


register("write_csv", _csv, _POINTS, concentration=4)
register("write_json", _json, _POINTS, concentration=4)


def _lines(t):
    path = new_path(t.spark)
    SW.write_geojson(_points(t), path)
    one = SR.GEOJSON["features"].dataType.elementType
    f = F.from_json("value", one)
    return t.spark.read.text(path).select(f.alias("f")).select(
        F.col("f.type").alias("type"), F.col("f.geometry.coordinates")[0].alias("longitude"), F.col("f.geometry.coordinates")[1].alias("latitude"),
        F.col("f.properties.concentration").alias("concentration"))


register("write_geojson", _lines, f"SELECT 'Feature' AS type, longitude, latitude, concentration FROM ({_POINTS})", concentration=4)
register("scan_geojson", _geojson, f"SELECT latitude, longitude, concentration FROM ({_POINTS})", concentration=4)


def _points_file(t):
    path = new_path(t.spark)
    t.requests.select(F.col("latitude").alias("y"), F.col("longitude").alias("x"), "event_id").write.csv(path, header=True)
    return SR.points_from_csv(t.spark, path, {"latitude": "y", "longitude": "x"})


register(
    "scan_points_csv", _points_file,
    "SELECT latitude, longitude, 0.0::DOUBLE AS depth_from, 10.0::DOUBLE AS depth_to, CAST(event_id AS VARCHAR) AS event_id FROM requests",
)


def _sample_file(t):
    path = new_path(t.spark)
    t.hole_samples.select(*[f.name for f in SAMPLES.fields]).write.csv(path, header=True)
    return A.elements_summary(SR.test_rows_from_csv(t.spark, path))


register(
    "load_test_csv", _sample_file,
    f"""SELECT Element, count(*) AS total_records, count(DISTINCT Hole_ID) AS unique_holes, count(DISTINCT SampleID) AS unique_samples,
    avg({G}) AS avg_grade, min({G}) AS min_grade, max({G}) AS max_grade, stddev_samp({G}) AS std_grade FROM hole_samples WHERE {G} > 0 GROUP BY Element""",
    avg_grade=4, std_grade=4,
)


def _documents(t):
    """Model documents, one per model of the derived registry."""
    path = new_path(t.spark)
    cells = F.when(F.col("r2").isNotNull(), F.create_map(F.lit("r2_score"), F.col("r2")))
    rows = t.models.select(
        F.concat("element", F.lit("-"), "trained").alias("pipeline_id"), "element", F.struct(cells.alias("test_metrics")).alias("evaluation_results"),
        F.array(F.lit("latitude"), F.lit("longitude")).alias("feature_names"), F.concat("trained", F.lit("01_000000")).alias("stamp"))
    rows.write.partitionBy("stamp").json(f"{path}/documents")
    documents = t.spark.read.schema(SR.MODEL_DOCUMENT).json(f"{path}/documents/stamp=*")
    return SR.registry_rows(documents).select("element", "pipeline_id", "r2", "feature_count")


register(
    "model_registry", _documents,
    "SELECT element, concat(element, '-', trained) AS pipeline_id, r2, CAST(2 AS INT) AS feature_count FROM models",
)
register(
    "since_last_model",
    lambda t: I.since_last_model(t.models.withColumn("trained", F.concat("trained", F.lit("01_000000"))), "2030-01-01 00:00:00").select("age_seconds", "is_active"),
    """WITH a AS (SELECT date_diff('second', max(strptime(trained || '01', '%Y%m%d')), TIMESTAMP '2030-01-01') AS age_seconds FROM models)
    SELECT age_seconds, age_seconds < 300 AS is_active FROM a""",
)


def _every_element(t):
    """Each valid grade against the mean and deviation of its element (one small row an element)."""
    valid = t.hole_samples.filter(P.valid_sample()).select("SampleID", "Element", GRADE)
    stats = keep(valid.groupBy("Element").agg(F.avg(GRADE).alias("mean_grade"), F.stddev_samp(GRADE).alias("std_grade")))
    return join_on(valid, stats, ["Element"]).select(
        "SampleID", "Element", GRADE, F.try_divide(F.abs(F.col(GRADE) - F.col("mean_grade")), F.col("std_grade")).alias("z_score"))


register(
    "stats_cross", _every_element,
    f"""WITH s AS (SELECT Element, avg({G}) AS mean_grade, stddev_samp({G}) AS std_grade FROM hole_samples WHERE {VALID} GROUP BY Element)
    SELECT SampleID, Element, {G}, abs({G} - mean_grade) / nullif(std_grade, 0) AS z_score FROM hole_samples JOIN s USING (Element) WHERE {VALID}""", z_score=7,
)


def _menu(t):
    """A menu document made of the samples (sections: data sets, items: elements, tables: laboratories), read as rows."""
    path = new_path(t.spark)
    named = t.hole_samples.filter("LabCode IS NOT NULL").select("DataSet", "Element", "LabCode").distinct()
    items = named.groupBy("DataSet", "Element").agg(F.array_sort(F.collect_set("LabCode")).alias("tables"))
    sections = items.groupBy("DataSet").agg(F.array_sort(F.collect_list(F.struct(F.col("Element").alias("title"), "tables"))).alias("subItems"))
    valid = named.filter("LabCode <> 'LAB0'").agg(F.array_sort(F.collect_set("LabCode")).alias("validTables"))
    SW.write_document(sections.agg(F.collect_list(F.struct(F.col("DataSet").alias("title"), "subItems")).alias("sidebarStructure")).select(
        valid.scalar().alias("validTables"), "sidebarStructure"), path)
    return SR.table_catalog(t.spark, path)


register(
    "table_catalog", _menu,
    """SELECT DISTINCT DataSet AS section, Element AS item, LabCode AS "table", LabCode <> 'LAB0' AS is_valid FROM hole_samples WHERE LabCode IS NOT NULL""",
)


def _stored_scaler(t):
    path, columns = new_path(t.spark), [GRADE, "Depth_From"]
    rows = t.hole_samples.select("SampleID", "Element", "Depth_To", *columns)
    SW.save_parameters({"scale": X.fit_scale(rows, columns)}, path)
    return X.scale(rows, SW.load_parameters(t.spark, path, ["scale"])["scale"], columns)


register(
    "save_preprocessor", _stored_scaler,
    "SELECT SampleID, Element, Depth_To, " + ", ".join(
        f"({c} - (SELECT avg({c}) FROM hole_samples)) / (SELECT stddev_pop({c}) FROM hole_samples) AS {c}" for c in (G, "Depth_From")) + " FROM hole_samples",
    standardized_grade_ppm=7, Depth_From=7,
)


def _history(t):
    """Lines of all elements, appended run after run (one a data set)."""
    path = new_path(t.spark)
    for name in ("Drilling_BF", "Drilling_INF", "Drilling_OP"):
        SW.append_history(T.model_metrics(t.scored.filter(F.col("DataSet") == name), ["DataSet", "Element"]), path)
    return t.spark.read.parquet(path).select("DataSet", "Element", "n", "rmse", "mae")


_ERRORS_OF = """count(*) AS n, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse, avg(abs(y_pred - y_true)) AS mae FROM scored"""
register("perf_history", _history, f"SELECT DataSet, Element, {_ERRORS_OF} GROUP BY DataSet, Element", rmse=4, mae=4)


def _report(t):
    path = new_path(t.spark)
    SW.write_text_report(T.model_metrics(t.scored).select("n", "mae"), path, "Evaluation")
    return t.spark.read.text(path)


register(
    "write_reports", _report,
    """WITH m AS (SELECT count(*) AS n, avg(abs(y_pred - y_true)) AS mae FROM scored)
    SELECT 'Evaluation' AS value UNION ALL SELECT printf('n: %.4f', n::DOUBLE) FROM m UNION ALL SELECT printf('mae: %.4f', mae) FROM m""",
)


def _element_report(t):
    path = new_path(t.spark)
    SW.write_element_report(T.model_metrics(t.scored, ["Element"]).select("Element", "n", "rmse", "mae"), path, "Elements")
    return t.spark.read.text(path)


register(
    "write_element_report", _element_report,
    f"""WITH m AS (SELECT Element, {_ERRORS_OF} GROUP BY Element) SELECT 'Elements' AS value UNION ALL SELECT 'element: ' || Element FROM m
    UNION ALL SELECT printf('n: %.4f', n::DOUBLE) FROM m UNION ALL SELECT printf('rmse: %.4f', rmse) FROM m UNION ALL SELECT printf('mae: %.4f', mae) FROM m""",
)


def _metric_export(t):
    """Metrics of every element as a CSV file, read back."""
    path = new_path(t.spark)
    metrics = T.model_metrics(t.scored, ["Element"])
    SW.write_csv(metrics, path)
    return t.spark.read.schema(metrics.schema).csv(path, header=True).select("Element", "n", "rmse", "mae")


register("write_metric_table", _metric_export, f"SELECT Element, {_ERRORS_OF} GROUP BY Element", rmse=4, mae=4)


def _batch_file(t):
    """The document of a run over the elements: a line of grade on depth for each, one that fits is a success."""
    path = new_path(t.spark)
    outcomes = t.scored.groupBy(F.col("Element").alias("element")).agg(F.regr_r2("y_true", "y_pred").alias("r2")).withColumn("success", F.col("r2") > 0.99)
    SW.write_document(SW.batch_report(outcomes), path)
    return t.spark.read.schema("elements long, successful long, failed long, success_rate double, mean_r2 double, best_element string").json(path)


register(
    "write_batch_report", _batch_file,
    """WITH o AS (SELECT Element, regr_r2(y_true, y_pred) AS r2 FROM scored GROUP BY Element), d AS (SELECT *, r2 > 0.99 AS success FROM o)
    SELECT count(*) AS elements, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, avg(CAST(success AS INT)) AS success_rate,
    avg(r2) FILTER (success) AS mean_r2, arg_max(Element, CASE WHEN success THEN r2 END) AS best_element FROM d""",
    success_rate=6, mean_r2=6,
)


def _grid_file(t):
    """The size as written in the document beside the grid, and the rows of the grid file."""
    path = new_path(t.spark)
    scored, summary = I.score_grid(t.hole_samples, _trained(t), 1500.0)
    SW.write_grid(SW.flat_predictions(scored), path, summary)
    rows = t.spark.read.csv(f"{path}/grid", header=True).agg(F.count("*").alias("rows"), F.count("predicted_grade_ppm").alias("predicted"))
    document = t.spark.read.json(f"{path}/metadata").select(F.col("n_lat").cast("int"), F.col("n_long").cast("int"), F.col("total_points").cast("int"), "element")
    return document.select("*", rows.select("rows").scalar().alias("rows"), rows.select("predicted").scalar().alias("predicted"))


_METRES = 1500.0
register(
    "write_grid", _grid_file,
    f"""WITH b AS (SELECT min(latitude) AS a, max(latitude) AS b, min(longitude) AS c, max(longitude) AS d FROM hole_samples WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
    s AS (SELECT *, {_METRES}::DOUBLE / {METRES_PER_DEGREE} AS step FROM b),
    n AS (SELECT CAST(floor((b - a) / step) AS INTEGER) + 1 AS n_lat, CAST(floor((d - c) / (step / cos(radians((a + b) / 2)))) AS INTEGER) + 1 AS n_long FROM s)
    SELECT n_lat, n_long, n_lat * n_long AS total_points, 'CU' AS element, CAST(n_lat * n_long AS BIGINT) AS rows, CAST(n_lat * n_long AS BIGINT) AS predicted FROM n""",
)


def _stored(t, trained):
    path = new_path(t.spark)
    M.save_model(trained, path, STAMP)
    return path


def _loaded(t, trained):
    return M.load_model(t.spark, _stored(t, trained), STAMP)


_FIT = """SELECT count(*) AS n, 1 - sum((predicted - label) * (predicted - label)) / (var_pop(label) * count(*)) AS r2_score,
 sqrt(avg((predicted - label) * (predicted - label))) AS rmse, avg(abs(predicted - label)) AS mae FROM fitted WHERE {part}"""


def _document(t):
    """What the saved document says of the line: its kind, configuration, sizes, and the metrics of both other parts."""
    rows = SR.model_registry(t.spark, _stored(t, _line(t)))
    metrics = F.col("evaluation_results")
    return rows.select(
        "element", "trained", "model_type", F.col("feature_count").cast("int"), "r2", F.col("configuration")["solver"].alias("solver"),
        *[F.col("split_sizes")[p].alias(f"{p}_rows") for p in ("train", "validation", "test")],
        metrics["train_metrics"]["rmse"].alias("train_rmse"), metrics["validation_metrics"]["mae"].alias("validation_mae"))


register(
    "save_model", _document,
    f"""WITH {PARTED} SELECT 'CU' AS element, '{STAMP}' AS trained, 'LinearRegression' AS model_type, CAST({len(LINE)} AS INTEGER) AS feature_count,
    t.r2_score AS r2, 'normal' AS solver, f.n AS train_rows, v.n AS validation_rows, t.n AS test_rows, f.rmse AS train_rmse, v.mae AS validation_mae
    FROM ({_FIT.format(part="place < 2000")}) t, ({_FIT.format(part="place BETWEEN 2000 AND 3599")}) v, ({_FIT.format(part="place >= 3600")}) f""",
    r2=6, train_rmse=3, validation_mae=3,
)


def _newest(t):
    """Documents of all models of the relation, streamed, and the newest of each element."""
    documents, out, state = new_path(t.spark), new_path(t.spark), new_path(t.spark)
    t.models.select(
        "element", F.concat(F.col("trained").cast("string"), F.lit("01_000000")).alias("pipeline_id"), F.col("trained").cast("string").alias("model_path"),
        F.struct(F.create_map(F.lit("r2_score"), F.col("r2")).alias("test_metrics")).alias("evaluation_results")).write.json(documents)
    J.stream_registry(t.spark, documents, out, state, once=True, one_per_file=False).awaitTermination()
    return J.newest_registry(t.spark, out).select("element", "model_path")


register("stream_registry", _newest, "SELECT element, CAST(max(trained) AS VARCHAR) AS model_path FROM models GROUP BY element")
register(
    "load_model", lambda t: _line_scored(t, _loaded(t, _line(t))).select("SampleID", "label", "predicted", "lower", "upper"),
    f"""WITH {PARTED} SELECT SampleID, label, predicted, greatest(0, predicted - 1.96 * sd) AS lower, predicted + 1.96 * sd AS upper
    FROM fitted, spread WHERE place < 2000""",
    predicted=3, lower=3, upper=3,
)
register("saved_models", lambda t: SR.model_registry(t.spark, _stored(t, _trained(t))).select("element", "trained", F.col("feature_count").cast("int"), "r2"))
register("saved_predictions", lambda t: _loaded(t, _trained(t)).score(_point_matrix(t)).select("label", "predicted"))


def _test_part(t):
    return X.split(R.training_rows(t.hole_samples, ["Cu"]), ["SampleID", "Element", "Depth_From", "Depth_To", GRADE]).filter("part = 'test'")


register(
    "evaluate_saved", lambda t: M.evaluate_saved(_loaded(t, _line(t)), _test_part(t)).select("n", "r2_score", "rmse", "mae"),
    f"WITH {PARTED} {_FIT.format(part='place < 2000')}", r2_score=6, rmse=3, mae=3,
)
register("saved_evaluation", lambda t: M.evaluate_saved(_loaded(t, _trained(t)), _test_part(t)).select("n", "r2_score", "rmse", "mse"))
register("model_info", lambda t: M.model_info(_trained(t)))


def _point_matrix(t):
    wide = E.features_prediction(R.training_rows(t.hole_samples, ["Cu"]))
    return E.feature_matrix(wide, I.POINT_FEATURES)


def _tuned(t):
    path = new_path(t.spark)
    found = M.random_search(_matrix(t), SIMPLE, IDS, {"maxDepth": [2, 3, 4]}, 3, 3, base=SMALL)
    SW.write_json(found, path)
    return t.spark.read.schema(found.schema).json(path).select("candidate", F.col("parameters")["maxDepth"].alias("maxDepth"), "rmse_mean", "rmse_std", "r2_mean", "mae_mean")


register("save_tuning", _tuned)
register("random_search", lambda t: M.random_search(_matrix(t), SIMPLE, IDS, {"maxDepth": [2, 3, 4]}, 2, 2, base=SMALL).drop("parameters"))
register("progressive_search", lambda t: M.progressive_search(
    _matrix(t), SIMPLE, IDS, [("grid", {"grid": {"maxDepth": [2]}}), ("random", {"grid": {"maxDepth": [3, 4]}, "n": 1}),
                       ("model", {"space": {"maxDepth": Range(2, 4, whole=True), "stepSize": Range(0.05, 0.3, log=True)}, "n": 2})], 2, SMALL).drop("parameters"))
_LIGHT = dict(trees=3, depth=3)


def _held_out(t, fit):
    """The test part scored by what ``fit`` makes of the train part."""
    parted = keep(X.split(_matrix(t), IDS))
    return fit(parted.filter("part = 'train'")).transform(parted.filter("part = 'test'"))


register("voting_ensemble", lambda t: T.model_metrics(M.as_scored(_held_out(t, lambda train: M.voting_ensemble(train, SIMPLE, IDS, folds=2, best=5, **_LIGHT)))))
register("ensemble_uncertainty", lambda t: _held_out(t, lambda train: M.voting_ensemble(train, SIMPLE, IDS, folds=2, best=2, **_LIGHT)).select(
    "SampleID", "predicted", "prediction_std"))
register("stacking", lambda t: T.model_metrics(M.as_scored(_held_out(t, lambda train: M.stacking(train, SIMPLE, IDS, folds=2, **_LIGHT)))))
register("train_pipeline", lambda t: M.train_workflow(t.hole_samples, "Au", features=E.REFERENCE_FEATURES, **SMALL).metrics)


def _scored_file(t):
    """A file with good and bad lines and a column of its own: each line comes back."""
    source, out = new_path(t.spark), new_path(t.spark)
    t.requests.select("latitude", "longitude", "depth_from", "depth_to", "event_id").write.csv(source, header=True)
    return I.score_csv(source, out, t.spark, _line(t)).select("element", "lines", "successful", "count", "min", "max", "mean", "std", "median")


register(
    "score_csv", _scored_file,
    f"""WITH {PARTED}, {AT_POINTS} SELECT 'CU' AS element, count(*) AS lines, count(p) AS successful, count(p) AS count, min(p) AS min, max(p) AS max,
    avg(p) AS mean, stddev_pop(p) AS std, quantile_cont(p, 0.5) AS median FROM answered""",
    min=3, max=3, mean=3, std=3, median=3,
)
register("confidence_metrics", lambda t: I.confidence_metrics(I.score_points(_request_points(t), _trained(t))).select(
    "point_id", "predicted_grade_ppm", "interval_width", "confidence_level", "region_level"))


def _stream_source(t, df):
    """Rows as a folder of files, read as a stream of several batches."""
    path = new_path(t.spark)
    df.write.parquet(path)
    files = len(t.spark.read.parquet(path).inputFiles())
    return J.file_stream(t.spark, path, df.schema, files_per_batch=max(1, files // 2))


def _quality_stream(t):
    """A file and so a batch for each year, whatever the number of cores; the history has a line for each."""
    source, history, state = new_path(t.spark), new_path(t.spark), new_path(t.spark)
    year = F.year("sampled_at").alias("year")
    dated = t.hole_samples.select("*", year)
    dated.repartition("year").write.partitionBy("year").parquet(source)
    stream = J.file_stream(t.spark, source, dated.schema, files_per_batch=1)
    J.stream_quality(stream, history, state, once=True).awaitTermination()
    return J.read_history(t.spark, history).select("rows", "status")


register(
    "stream_quality", _quality_stream,
    f"""WITH k AS (SELECT extract(year FROM sampled_at) AS year, count(*) AS n,
    count(*) FILTER (latitude NOT BETWEEN -90 AND 90 OR longitude NOT BETWEEN -180 AND 180 OR Depth_From >= Depth_To) AS wrong
    FROM hole_samples GROUP BY year, Hole_ID, Element, Depth_From, Depth_To)
    SELECT CAST(sum(n) AS BIGINT) AS rows, CASE WHEN sum(n - 1) + sum(wrong) > 0 THEN 'FAILED' ELSE 'PASSED' END AS status FROM k GROUP BY year""",
)


def _score_stream(t):
    """Requests of the stream by outcome, from the written scores."""
    out, bad, state = new_path(t.spark), new_path(t.spark), new_path(t.spark)
    requests = t.requests.select("event_id", "latitude", "longitude", "depth_from", "depth_to")
    J.stream_score(_stream_source(t, requests), _trained(t), out, bad, state, once=True).awaitTermination()
    scores, errors = t.spark.read.parquet(out), t.spark.read.parquet(bad)
    known = errors.groupBy("errors").agg(F.count("*").alias("in_error_table"))
    return scores.groupBy("errors").agg(F.count("*").alias("requests"), F.count("predicted_grade_ppm").alias("predicted"), F.sum("event_id").alias("ids")).join(
        known, "errors", "left").select("errors", "requests", "predicted", "ids", F.coalesce("in_error_table", F.lit(0)).alias("in_error_table"))


register(
    "stream_score", _score_stream,
    """WITH e AS (SELECT event_id, CASE WHEN latitude > 90 AND depth_from > depth_to THEN 'latitude outside -90..90; depth_from after depth_to'
    WHEN latitude > 90 THEN 'latitude outside -90..90' WHEN depth_from > depth_to THEN 'depth_from after depth_to' ELSE '' END AS errors FROM requests)
    SELECT errors, count(*) AS requests, count(*) FILTER (errors = '') AS predicted, CAST(sum(event_id) AS BIGINT) AS ids,
    count(*) FILTER (errors <> '') AS in_error_table FROM e GROUP BY errors""",
)
