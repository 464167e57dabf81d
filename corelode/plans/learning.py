"""Registered models, scoring, sinks and streams.

Small models: the point of these queries is the whole way over whole tables,
not the best fit (the fixture's grades are noise).
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from corelode.functions.predicates import GRADE
from corelode.operators import boosting as G_B
from corelode.operators import features as E
from corelode.operators import models as M
from corelode.operators import prep as X
from corelode.operators import rows as R
from corelode.operators import scoring as I
from corelode.operators import spatial as G_
from corelode.operators import stats as T
from corelode.operators.boosting import RegularisedBoosting
from corelode.plans.features import _request_points
from corelode.plans.registry import identity_sql, register
from corelode.plans.rows import G, TRAINING
from corelode.session import keep, new_path
from corelode.sources import writers as W
from corelode.streaming import jobs as J

SMALL = dict(maxIter=4, maxDepth=3)
SIMPLE = ["latitude", "longitude", "elevation", "mid_depth", "Interval_Length"]
IDS = ["SampleID", "Depth_From", "label"]

_LATEST = "SELECT * FROM models QUALIFY row_number() OVER (PARTITION BY element ORDER BY trained DESC) = 1"
register(
    "model_lookup",
    lambda t: I.model_lookup(t.requests.select("event_id", "element"), t.models).select(
        "event_id", "element", "model_element", "trained", "r2", "is_fallback"),
    f"""WITH m AS ({_LATEST}) SELECT event_id, r.element, coalesce(m.element, 'CU') AS model_element, coalesce(m.trained, c.trained) AS trained,
    coalesce(m.r2, c.r2) AS r2, m.element IS NULL AS is_fallback FROM requests r LEFT JOIN m ON m.element = r.element, (SELECT * FROM m WHERE element = 'CU') c""",
)
register(
    "registry_summary", lambda t: I.registry_summary(t.models),
    """SELECT element, count(*) AS models, max(trained) AS latest, (array_agg(r2 ORDER BY trained DESC))[1] AS latest_r2, max(r2) AS best_r2 FROM models GROUP BY element""",
)
register(
    "compare_predictions",
    lambda t: I.compare_predictions(
        t.scored.groupBy("Element", "DataSet").agg(F.avg("y_true").alias("grade")), t.scored.groupBy("Element", "DataSet").agg(F.avg("y_pred").alias("grade")),
        ["Element", "DataSet"], "grade", 5000.0),
    """SELECT Element, DataSet, avg(y_true) AS first, avg(y_pred) AS second, abs(avg(y_true) - avg(y_pred)) AS difference,
    abs(avg(y_true) - avg(y_pred)) < 5000 AS identical FROM scored GROUP BY ALL""",
    first=4, second=4, difference=4,
)
register(
    "geojson_features",
    lambda t: W.geojson_lines(R.heatmap_points(t.hole_grades, t.collars, "Cu").withColumn("concentration", F.round("concentration", 2))),
)


def _matrix(t, *carry):
    rows = R.training_rows(t.hole_samples, ["Cu"])
    return keep(E.feature_columns(rows, SIMPLE, ["SampleID", "Depth_From", *carry]))


def _small():
    return GBTRegressor(**(M.GBT | SMALL))


def _trained(t):
    return I.train_for_points(t.hole_samples, "Cu", **SMALL)


register("train_gbt", lambda t: M.train_workflow(t.hole_samples, "Cu", **SMALL).metrics)
# Regularised boosting at its defaults: 100 trees of depth six over all features.
register("train_regularised", lambda t: M.train_workflow(t.hole_samples, "Cu", estimator=RegularisedBoosting).metrics)
_CUT = ["Interval_Length", "mid_depth", "elevation"]


def _assembled(t, names):
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(_matrix(t))


register(
    "split_gains", lambda t: G_B.root_gains(_assembled(t, _CUT), _CUT, G_B.Boosting(maxBins=8)).filter("NOT missing_left").select(
        "feature", "cut", (F.col("gain") / 1e9).alias("gain")),
    f"""WITH rows AS (SELECT *, (Depth_From + Depth_To) / 2 AS mid_depth, {G} AS label FROM hole_samples WHERE {TRAINING} AND Element = 'Cu'),
    long AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, label FROM rows" for c in _CUT)}),
    centred AS (SELECT feature, x, (SELECT avg(label) FROM rows) - label AS g FROM long),
    cuts AS (SELECT DISTINCT feature, unnest(quantile_cont(x, [{", ".join(f"{i}/8" for i in range(1, 8))}])) AS cut, max(x) AS top FROM centred GROUP BY feature),
    sides AS (SELECT feature, cut, sum(g) FILTER (x <= cut) AS gl, count(*) FILTER (x <= cut) AS nl, sum(g) AS g, count(*) AS n
     FROM cuts JOIN centred USING (feature) WHERE cut < top GROUP BY feature, cut)
    SELECT feature, cut, 0.5 * (gl * gl / (nl + 1) + (g - gl) * (g - gl) / (n - nl + 1) - g * g / (n + 1)) / 1e9 AS gain FROM sides""",
    cut=6, gain=4,
)


def _error_history(t):
    """Errors of the train and validation part before the first of 20 trees and after each."""
    parted = keep(X.split(_assembled(t, SIMPLE), IDS)).filter("part <> 'test'").withColumn("held", F.col("part") == "validation")
    return G_B.fit(parted, G_B.Boosting(maxIter=20), held="held").history_table(t.spark)


register("boosting_history", _error_history)
register("train_elements", lambda t: M.train_elements(t.hole_samples, ["Au", "Zn"], **SMALL)[1].drop("seconds"))


def _intervals(t):
    """Test rows with intervals from the validation residuals of a model fitted on the train part."""
    parted = keep(X.split(_matrix(t), IDS))
    model = M.train_gbt(parted.filter("part = 'train'"), SIMPLE, **SMALL)
    scored = keep(M.predict_nonneg(model, parted.filter("part <> 'train'")))
    return M.predict_interval(scored.filter("part = 'test'"), M.residual_row(scored.filter("part = 'validation'")))


# Oracles for the way from samples to predictions: a model with a closed form, the line of grade on latitude, goes the same
# way as the trees, and SQL fits it by its sums.
LINE = ["latitude"]


def _line(t):
    return M.train_workflow(t.hole_samples, "Cu", LINE, estimator=LinearRegression, solver="normal")


def _line_scored(t, trained):
    """The test rows of the line's split with its predictions and intervals."""
    parted = X.split(R.training_rows(t.hole_samples, ["Cu"]), ["SampleID", "Element", "Depth_From", "Depth_To", GRADE])
    wide = E.features_prediction(parted.filter("part = 'test'"), trained.location, trained.codes)
    matrix = E.feature_matrix(wide, trained.features, trained.fills, ["SampleID", "Depth_From", "mid_depth", GRADE])
    return M.predict_interval(trained.score(matrix), trained.residuals)


PARTED = f"""rows AS (SELECT *, {G} AS label, {identity_sql(42, ['SampleID', 'Element'], ['Depth_From', 'Depth_To', G])} % 10000 AS place
 FROM hole_samples WHERE {TRAINING} AND Element = 'Cu'),
line AS (SELECT regr_slope(label, latitude) AS slope, regr_intercept(label, latitude) AS base FROM rows WHERE place >= 3600),
fitted AS (SELECT rows.*, greatest(0, base + slope * latitude) AS predicted FROM rows, line),
spread AS (SELECT stddev_pop(label - predicted) AS sd, sqrt(avg((label - predicted) * (label - predicted))) AS rmse FROM fitted WHERE place BETWEEN 2000 AND 3599)"""
register(
    "predict_interval", lambda t: _line_scored(t, _line(t)).select("SampleID", "label", "predicted", "lower", "upper"),
    f"""WITH {PARTED} SELECT SampleID, label, predicted, greatest(0, predicted - 1.96 * sd) AS lower, predicted + 1.96 * sd AS upper
    FROM fitted, spread WHERE place < 2000""",
    predicted=3, lower=3, upper=3,
)


def _around_mean(t):
    """A line of the grades' distances from their mean: about half of what it says is negative."""
    rows = X.with_row(_matrix(t), _matrix(t).agg(F.avg("label").alias("mean"))).withColumn("label", F.col("label") - F.col("_p.mean")).drop("_p")
    return M.predict_nonneg(M.with_estimator(LINE, LinearRegression(solver="normal")).fit(rows), rows).select("SampleID", "predicted")


register(
    "predict_nonneg", _around_mean,
    f"""WITH rows AS (SELECT SampleID, latitude, {G} - avg({G}) OVER () AS label FROM hole_samples WHERE {TRAINING} AND Element = 'Cu'),
    line AS (SELECT regr_slope(label, latitude) AS slope, regr_intercept(label, latitude) AS base FROM rows)
    SELECT SampleID, greatest(0, base + slope * latitude) AS predicted FROM rows, line""",
    predicted=3,
)
# The numbers of the boosted trees themselves.
register("interval_predictions", lambda t: _intervals(t).select("SampleID", "label", "predicted", "lower", "upper"))
register("feature_importance", lambda t: M.feature_importance(M.train_gbt(_matrix(t), SIMPLE, **SMALL), SIMPLE, t.spark))
register("top_features", lambda t: M.top_features(M.feature_importance(M.train_gbt(_matrix(t), SIMPLE, **SMALL), SIMPLE, t.spark), 3))
register("kfold_cv", lambda t: M.kfold_cv(_matrix(t), SIMPLE, _small, IDS, 5))
register("stratified_cv", lambda t: M.stratified_cv(_matrix(t), SIMPLE, _small, IDS, 5))


def _dated(t):
    rows = R.training_rows(t.hole_samples, ["Cu"], carry=["sampled_at"])
    dated = rows.withColumn("day", F.date_diff(F.to_date("sampled_at"), F.lit("1970-01-01").cast("date")).cast("double"))
    return keep(E.feature_columns(dated, SIMPLE, ["SampleID", "Depth_From", "day"]))


register("expanding_cv", lambda t: M.expanding_cv(_dated(t), SIMPLE, _small, "day", 5))
# The ways of folding compared, with a model that fits in one pass.
register("compare_cv", lambda t: M.compare_cv(_dated(t), SIMPLE, lambda: LinearRegression(), IDS, "day", 5))
register("grid_search", lambda t: M.grid_search(_matrix(t), SIMPLE, IDS, {"maxDepth": [2, 3]}, 2, SMALL))


ERRORS = """CASE WHEN latitude > 90 AND depth_from >= depth_to THEN 'latitude outside -90..90; depth_from after depth_to'
 WHEN latitude > 90 THEN 'latitude outside -90..90' WHEN depth_from >= depth_to THEN 'depth_from after depth_to' ELSE '' END"""
AT_POINTS = f"""answered AS (SELECT event_id, user_id, {ERRORS} AS errors, CASE WHEN {ERRORS} = '' THEN greatest(0, base + slope * latitude) END AS p
 FROM requests, line)"""
register(
    "score_points", lambda t: I.score_points(t.requests, _line(t), "event_id").select(
        "event_id", "user_id", "element", "predicted_grade_ppm", F.col("confidence_interval.lower").alias("lower"),
        F.col("confidence_interval.upper").alias("upper"), F.array_join("errors", "; ").alias("errors")),
    f"""WITH {PARTED}, {AT_POINTS} SELECT event_id, user_id, 'CU' AS element, p AS predicted_grade_ppm,
    CASE WHEN p IS NOT NULL THEN greatest(0, p - 1.96 * rmse) END AS lower, p + 1.96 * rmse AS upper, errors FROM answered, spread""",
    predicted_grade_ppm=3, lower=3, upper=3,
)
register("point_predictions", lambda t: I.score_points(t.requests, _trained(t), "event_id").select(
    "event_id", "element", "predicted_grade_ppm", F.col("confidence_interval.lower").alias("lower"), F.col("confidence_interval.upper").alias("upper")))
register("score_grid", lambda t: W.flat_predictions(I.score_grid(t.hole_samples, _trained(t), 800.0)[0]).drop("prediction_timestamp"))


def _verified(t):
    ids = ["SampleID", "Depth_From", "mid_depth", "grade_key"]
    rows = R.training_rows(t.hole_samples, ["Cu"]).withColumn("grade_key", F.col(GRADE))
    return I.verify_samples(rows, _intervals(t).withColumn("grade_key", F.col("label")), ids)


register("verified_predictions", lambda t: _verified(t).select("SampleID", "actual", "predicted", "absolute_error", "level"))
register(
    "verify_samples",
    lambda t: I.verify_samples(
        R.training_rows(t.hole_samples, ["Cu"]).withColumn("grade_key", F.col(GRADE)),
        _line_scored(t, _line(t)).withColumn("grade_key", F.col(GRADE)), ["SampleID", "Depth_From", "mid_depth", "grade_key"],
    ).select("SampleID", "actual", "predicted", "absolute_error", "relative_error", "accuracy", "level"),
    f"""WITH {PARTED}, e AS (SELECT SampleID, label AS actual, predicted, abs(label - predicted) AS absolute_error,
    abs(label - predicted) / label * 100 AS relative_error FROM fitted WHERE place < 2000 AND Depth_From IS NOT NULL)
    SELECT *, greatest(0, 100 - relative_error) AS accuracy, CASE WHEN relative_error <= 10 THEN 'EXCELLENT' WHEN relative_error <= 20 THEN 'GOOD'
    WHEN relative_error <= 30 THEN 'FAIR' ELSE 'POOR' END AS level FROM e""",
    predicted=3, absolute_error=3, relative_error=3, accuracy=3,
)


def _dedup(t):
    base = new_path(t.spark)
    schema = t.spark.read.parquet(f"{t.folder}/events.parquet").schema
    from corelode.sources.fixture import REQUESTS

    events = J.file_stream(t.spark, t.folder, schema, pattern="events.parquet")
    requests = t.spark.sql(REQUESTS.replace("FROM events", "FROM {events}"), events=events)
    J.request_dedup(requests, f"{base}/out", f"{base}/state", once=True).awaitTermination()
    return t.spark.read.parquet(f"{base}/out").groupBy("request_key").agg(
        F.count("*").alias("requests"), F.count_if("served").alias("served"))


register("stream_request_dedup", _dedup)
