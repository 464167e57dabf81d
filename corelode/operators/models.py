"""Regression models per element, their errors, cross-validation and search."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product
from math import prod

from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corelode.functions.predicates import GRADE
from corelode.functions.scalars import r2_level
from corelode.operators import stats
from corelode.operators.boosting import RegularisedBoosting
from corelode.operators.extra_trees import ExtraTrees
from corelode.operators.features import (
    CODED, LEAK_FREE_FEATURES, feature_columns, feature_matrix, features_prediction, features_training, fill_features,
    fit_location, hole_table,
)
from corelode.operators.fourier import RadialBasisRegression
from corelode.operators.ordered import row_numbers
from corelode.operators.prep import fit_impute, label_codes, split, with_row
from corelode.operators.quantiles import quantiles
from corelode.operators.rows import training_rows
from corelode.operators.surrogate import Range, propose
from corelode.schema import CUTOFFS, Z_95
from corelode.session import keep

# The boosted-tree parameters of the default model.
GBT = dict(maxDepth=6, stepSize=0.1, maxIter=100, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)
ROW_ID = ["SampleID", "Element", "Depth_From", "Depth_To", "label"]

# The boosting grids by name, over nine parameters.
REGULARISED_GRIDS: dict[str, dict[str, list]] = {
    "default": {
        "maxIter": [100, 200, 300, 500], "maxDepth": [3, 4, 5, 6, 7, 8], "stepSize": [0.01, 0.05, 0.1, 0.15, 0.2],
        "subsamplingRate": [0.7, 0.8, 0.9, 1.0], "columnSampling": [0.7, 0.8, 0.9, 1.0], "regAlpha": [0.0, 0.1, 0.5, 1.0],
        "regLambda": [0.0, 0.1, 0.5, 1.0, 2.0], "minChildWeight": [1.0, 3.0, 5.0, 7.0], "minSplitGain": [0.0, 0.1, 0.2, 0.5]},
    "quick": {
        "maxIter": [100, 200, 300], "maxDepth": [4, 5, 6], "stepSize": [0.05, 0.1, 0.15], "subsamplingRate": [0.8, 0.9],
        "columnSampling": [0.8, 0.9], "regAlpha": [0.0, 0.1], "regLambda": [0.0, 1.0]},
    "domain": {
        "maxIter": [200, 300, 500], "maxDepth": [5, 6, 7, 8], "stepSize": [0.05, 0.1, 0.15], "subsamplingRate": [0.8, 0.9],
        "columnSampling": [0.7, 0.8, 0.9], "regAlpha": [0.1, 0.5, 1.0], "regLambda": [1.0, 2.0, 5.0], "minChildWeight": [3.0, 5.0, 7.0],
        "minSplitGain": [0.1, 0.2, 0.5]},
}
# The space of the model-based search; zero is the least penalty, so those are spread by their square root.
SPACE: dict[str, Range] = {
    "maxIter": Range(100, 1000, whole=True), "maxDepth": Range(3, 10, whole=True), "stepSize": Range(0.01, 0.3, log=True),
    "subsamplingRate": Range(0.6, 1.0), "columnSampling": Range(0.6, 1.0), "regAlpha": Range(0.0, 10.0, power=2.0),
    "regLambda": Range(0.0, 10.0, power=2.0), "minChildWeight": Range(1, 10, whole=True), "minSplitGain": Range(0.0, 5.0),
}
# This library's own, smaller grids for GBTRegressor, by name.
GRIDS: dict[str, dict[str, list]] = {
    "quick": {"maxIter": [50, 100], "maxDepth": [4, 6], "stepSize": [0.1, 0.2]},
    "small": {"maxIter": [50, 100], "maxDepth": [4, 6]},
    "default": {"maxIter": [100, 200], "maxDepth": [4, 6, 8], "stepSize": [0.05, 0.1, 0.2], "subsamplingRate": [0.8, 1.0]},
    "domain": {"maxIter": [100, 200], "maxDepth": [6, 8], "stepSize": [0.05, 0.1], "minInstancesPerNode": [1, 5]},
}


def with_estimator(features: Sequence[str], estimator) -> Pipeline:
    """Assembler and estimator; rows with missing features keep NaN slots."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"),
        estimator.setFeaturesCol("features").setLabelCol("label").setPredictionCol("prediction")])


def train_gbt(matrix: DataFrame, features: Sequence[str], **parameters) -> PipelineModel:
    return with_estimator(features, GBTRegressor(**(GBT | parameters))).fit(matrix)


def predict_nonneg(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``predicted``: the model's value, at least zero."""
    scored = model.transform(df).withColumn("predicted", F.greatest("prediction", F.lit(0.0)))
    return scored.drop("features", "prediction")


def residual_row(scored: DataFrame) -> DataFrame:
    """Deviation (population) and root mean square of the residuals, in one row."""
    e = F.col("label") - F.col("predicted")
    return scored.agg(F.stddev_pop(e).alias("residual_std"), F.sqrt(F.avg(e * e)).alias("rmse"))


def predict_interval(scored: DataFrame, residuals: DataFrame, by: str = "residual_std", z: float = Z_95) -> DataFrame:
    """``lower`` (at least zero) and ``upper`` around the prediction."""
    half = F.col(f"_p.{by}") * z
    return with_row(scored, residuals).withColumns({
        "lower": F.greatest(F.lit(0.0), F.col("predicted") - half), "upper": F.col("predicted") + half}).drop("_p")


def feature_importance(model: PipelineModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """Features with their share of importance, greatest first."""
    values = _weights(model)
    total = sum(values) or 1.0
    rows = [(f, float(v) / total) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def _weights(model: PipelineModel) -> list[float]:
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        return [float(v) for v in last.featureImportances.toArray()]
    return [abs(float(v)) for v in last.coefficients.toArray()]


def top_features(importance: DataFrame, n: int = 10) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def as_scored(scored: DataFrame) -> DataFrame:
    return scored.withColumnsRenamed({"label": stats.Y, "predicted": stats.P})


# ensembles

def base_learners(rows: int, trees: int = 100, depth: int = 6, seed: int = 42) -> dict[str, Callable]:
    """Constructors of the ensemble's members. Ridge and lasso take their
    penalties (1.0 and 0.1) in the scale of the mean squared error."""
    return {
        "random_forest": lambda: RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed),
        "gradient_boosting": lambda: GBTRegressor(**(GBT | dict(maxIter=trees, maxDepth=depth, seed=seed))),
        "extra_trees": lambda: ExtraTrees(trees=trees, depth=depth, seed=seed),
        "linear": lambda: LinearRegression(),
        "ridge": lambda: LinearRegression(regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False),
        "lasso": lambda: LinearRegression(regParam=0.1, elasticNetParam=1.0, standardization=False),
        "radial_basis": lambda: RadialBasisRegression(seed=seed),
    }


@dataclass
class Ensemble:
    """Members whose predictions are averaged."""

    features: list[str]
    members: dict[str, PipelineModel]
    scores: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        """Mean (at least zero) and deviation (population) of the members."""
        names = list(self.members)
        for name, model in self.members.items():
            df = model.transform(df).withColumnRenamed("prediction", f"_y_{name}").drop("features")
        values = F.array(*[F.col(f"_y_{n}") for n in names])
        mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / len(names)
        spread = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / len(names))
        return df.withColumn("_mean", mean).withColumns({
            "predicted": F.greatest("_mean", F.lit(0.0)), "prediction_std": spread}).drop("_mean", *[f"_y_{n}" for n in names])

    def importance(self, spark: SparkSession) -> DataFrame:
        """Mean of the members' normalised importances."""
        total = [0.0] * len(self.features)
        for model in self.members.values():
            w = _weights(model)
            s = sum(w) or 1.0
            total = [a + b / s / len(self.members) for a, b in zip(total, w)]
        return spark.createDataFrame(list(zip(self.features, total)), "feature string, importance double").orderBy(F.desc("importance"))


def voting_ensemble(matrix: DataFrame, features: Sequence[str], ids: Sequence[str], folds: int = 5, best: int = 5, **options) -> Ensemble:
    """Members with the best cross-validated R², each fitted on all rows."""
    makers = base_learners(matrix.count(), **options)
    scores = {}
    for name, make in makers.items():
        summary = kfold_cv(matrix, features, make, ids, folds)
        scores[name] = cv_summary(summary).filter("part = 'test'").first()["r2_mean"]
    chosen = sorted(scores, key=lambda n: -(scores[n] if scores[n] is not None else float("-inf")))[:best]
    members = {n: with_estimator(features, makers[n]()).fit(matrix) for n in chosen}
    return Ensemble(list(features), members, scores)


@dataclass
class Stack:
    """Members and the linear model on their predictions."""

    names: list[str]
    members: dict[str, PipelineModel]
    meta: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        for name, model in self.members.items():
            df = model.transform(df).withColumnRenamed("prediction", f"m_{name}").drop("features")
        return predict_nonneg(self.meta, df).drop(*[f"m_{n}" for n in self.names])


def stacking(matrix: DataFrame, features: Sequence[str], ids: Sequence[str], members: Sequence[str] = ("random_forest", "gradient_boosting", "ridge"), folds: int = 5, **options) -> Stack:
    """Linear model fitted on out-of-fold predictions of the members."""
    makers = base_learners(matrix.count(), **options)
    folded = keep(with_folds(matrix, ids, folds))
    out = None
    for k in range(folds):
        train, test = folded.filter(F.col("fold") != k), folded.filter(F.col("fold") == k)
        for name in members:
            test = with_estimator(features, makers[name]()).fit(train).transform(test).withColumnRenamed("prediction", f"m_{name}").drop("features")
        out = test if out is None else out.unionByName(test)
    meta = with_estimator([f"m_{n}" for n in members], LinearRegression()).fit(keep(out))
    fitted = {n: with_estimator(features, makers[n]()).fit(folded) for n in members}
    return Stack(list(members), fitted, meta)


# cross-validation

def with_folds(df: DataFrame, ids: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """``fold`` from a hash of the row's identity."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(k)).cast("int"))


def with_stratified_folds(df: DataFrame, ids: Sequence[str], k: int, bins: int = 10, seed: int = 42) -> DataFrame:
    """Folds with the same share of each of ``bins`` equally wide label ranges."""
    ends = df.agg(F.min("label").alias("low"), F.max("label").alias("high"))
    width = (F.col("_p.high") - F.col("_p.low")) / bins
    at = F.coalesce(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("label") - F.col("_p.low"), width))), F.lit(0))
    binned = with_row(df, ends).withColumn("_bin", at).drop("_p").withColumn("_h", F.xxhash64(F.lit(seed), *ids))
    numbered = row_numbers(binned, ["_bin"], ["_h", *ids], "_n")
    return numbered.withColumn("fold", F.pmod("_n", F.lit(k)).cast("int")).drop("_n", "_bin", "_h")


def _score_folds(folded: DataFrame, features: Sequence[str], make: Callable, tests: Iterable[tuple[int, Column, Column]]) -> DataFrame:
    """Scored train and test rows of every fold of a kept table, as one relation."""
    scored = []
    for k, train, test in tests:
        model = with_estimator(features, make()).fit(folded.filter(train))
        for part, rows in (("train", train), ("test", test)):
            scored.append(predict_nonneg(model, folded.filter(rows)).select(
                F.lit(k).alias("fold_number"), F.lit(part).alias("part"), F.col("label").alias(stats.Y), F.col("predicted").alias(stats.P)))
    return reduce(DataFrame.unionByName, scored)


def _fold_metrics(scored: DataFrame) -> DataFrame:
    return stats.model_metrics(scored, ["fold_number", "part"])


def kfold_cv(matrix: DataFrame, features: Sequence[str], make: Callable, ids: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Metrics per fold and part; one fit per fold, one aggregation for all."""
    return folded_cv(keep(with_folds(matrix, ids, k, seed)), features, make, k)


def folded_cv(folded: DataFrame, features: Sequence[str], make: Callable, k: int) -> DataFrame:
    """:func:`kfold_cv` of a kept table that has its ``fold``."""
    tests = [(i, F.col("fold") != i, F.col("fold") == i) for i in range(k)]
    return _fold_metrics(_score_folds(folded, features, make, tests))


def stratified_cv(matrix: DataFrame, features: Sequence[str], make: Callable, ids: Sequence[str], k: int = 5, bins: int = 10, seed: int = 42) -> DataFrame:
    folded = keep(with_stratified_folds(matrix, ids, k, bins, seed))
    tests = [(i, F.col("fold") != i, F.col("fold") == i) for i in range(k)]
    return _fold_metrics(_score_folds(folded, features, make, tests))


def expanding_cv(matrix: DataFrame, features: Sequence[str], make: Callable, time_column: str, k: int = 5) -> DataFrame:
    """Train on all rows up to a point in time and test on the next stretch."""
    at = F.col(time_column).cast("double")
    cuts = quantiles(matrix, [], {f"c{i}": (at, i / (k + 1)) for i in range(1, k + 2)}).first()
    tests = []
    for i in range(1, k + 1):
        low, high = cuts[f"c{i}"], cuts[f"c{i + 1}"]
        tests.append((i - 1, at <= low, (at > low) & (at <= high)))
    return _fold_metrics(_score_folds(keep(matrix), features, make, tests))


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean, deviation, least and greatest of the metrics over the folds, and the mean accuracy at every cutoff."""
    spread = []
    for name, c in (("rmse", "rmse"), ("mae", "mae"), ("r2", "r2_score")):
        spread += [F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std"), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max")]
    cutoffs = [F.avg(f"cutoff_{c}ppm_accuracy").alias(f"cutoff_{c}ppm_accuracy_mean") for c in CUTOFFS]
    return folds.groupBy("part").agg(F.count("*").alias("folds"), *spread, *cutoffs)


def compare_cv(matrix: DataFrame, features: Sequence[str], make: Callable, ids: Sequence[str], time_column: str, k: int = 5) -> DataFrame:
    """:func:`cv_summary` of the test rows by each way of folding: by hash, by label range, by time."""
    matrix = keep(matrix)
    ways = {
        "kfold": kfold_cv(matrix, features, make, ids, k), "stratified": stratified_cv(matrix, features, make, ids, k),
        "expanding": expanding_cv(matrix, features, make, time_column, k)}
    tables = [cv_summary(folds).filter("part = 'test'").withColumn("method", F.lit(name)) for name, folds in ways.items()]
    return reduce(DataFrame.unionByName, tables).drop("part").orderBy(F.desc("r2_mean"))


# parameter search

def combinations_of(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def _measured(folded: DataFrame, features: Sequence[str], parameters: dict, k: int, make: Callable) -> tuple:
    row = cv_summary(folded_cv(folded, features, lambda: make(**parameters), k)).filter("part = 'test'").first()
    return {n: str(v) for n, v in parameters.items()}, row["rmse_mean"], row["rmse_std"], row["r2_mean"], row["mae_mean"]


_TRIED = "candidate int, parameters map<string,string>, rmse_mean double, rmse_std double, r2_mean double, mae_mean double"


def maker_of(base: dict | None, regularised: bool) -> Callable:
    """Estimators of one kind from the parameters of a candidate over ``base``."""
    if regularised:
        return lambda **p: RegularisedBoosting(**((base or {}) | p))
    return lambda **p: GBTRegressor(**(GBT | (base or {}) | p))


def search(matrix: DataFrame, features: Sequence[str], candidates: list[dict], ids: Sequence[str], k: int = 3, base: dict | None = None, regularised: bool = False) -> DataFrame:
    """Cross-validated error of every candidate, best first. Rows are folded and written once."""
    folded = keep(with_folds(matrix, ids, k))
    make = maker_of(base, regularised)
    results = [(at, *_measured(folded, features, parameters, k, make)) for at, parameters in enumerate(candidates)]
    return matrix.sparkSession.createDataFrame(results, _TRIED).orderBy("rmse_mean", "candidate")


def _grid(grid: str | dict, regularised: bool) -> dict[str, list]:
    return (REGULARISED_GRIDS if regularised else GRIDS)[grid] if isinstance(grid, str) else grid


def grid_search(matrix, features, ids, grid: str | dict = "quick", k: int = 3, base: dict | None = None, regularised: bool = False) -> DataFrame:
    return search(matrix, features, combinations_of(_grid(grid, regularised)), ids, k, base, regularised)


def random_search(matrix, features, ids, grid: str | dict = "default", n: int = 10, k: int = 3, seed: int = 42, base: dict | None = None, regularised: bool = False) -> DataFrame:
    """``n`` different combinations of the grid, drawn by their number: the grid itself is never written out."""
    values = _grid(grid, regularised)
    total = prod(len(v) for v in values.values())
    chosen = []
    for number in sorted(random.Random(seed).sample(range(total), min(n, total))):
        candidate = {}
        for name, options in values.items():
            number, at = divmod(number, len(options))
            candidate[name] = options[at]
        chosen.append(candidate)
    return search(matrix, features, chosen, ids, k, base, regularised)


def model_search(matrix, features, ids, space: dict[str, Range] | None = None, n: int = 20, k: int = 3, seed: int = 42, base: dict | None = None, regularised: bool = True) -> DataFrame:
    """Settings proposed one after another by a surrogate of the errors so far (:func:`propose`).

    Each trial is a cross-validation in Spark; the driver holds the ``n`` settings and errors.
    """
    space = SPACE if space is None else space
    folded, make = keep(with_folds(matrix, ids, k)), maker_of(base, regularised)
    units, results = [], []
    for at in range(n):
        units.append(propose(units, [r[2] for r in results], len(space), seed))
        parameters = {name: extent.at(u) for (name, extent), u in zip(space.items(), units[-1])}
        results.append((at, *_measured(folded, features, parameters, k, make)))
    return matrix.sparkSession.createDataFrame(results, _TRIED).orderBy("rmse_mean", "candidate")


def progressive_search(matrix, features, ids, stages: Sequence[tuple[str, dict]], k: int = 3, base: dict | None = None, regularised: bool = False) -> DataFrame:
    """Stages (``grid``, ``random`` or ``model``, options) in order; all results, best first."""
    tables = []
    for number, (kind, options) in enumerate(stages):
        run = {"grid": grid_search, "random": random_search, "model": model_search}[kind]
        tables.append(run(matrix, features, ids, k=k, base=base, regularised=regularised, **options).withColumn("stage", F.lit(number)))
    return reduce(DataFrame.unionByName, tables).orderBy("rmse_mean", "stage", "candidate")


# the whole way from samples to a saved model

@dataclass
class Trained:
    """A fitted model with all that scoring needs."""

    element: str
    features: list[str]
    model: PipelineModel
    residuals: DataFrame
    metrics: DataFrame
    location: DataFrame
    codes: dict[str, DataFrame]
    fills: DataFrame
    holes: DataFrame
    seconds: float = 0.0
    kind: str = "GBTRegressor"
    configuration: dict[str, str] = field(default_factory=dict)
    cv: DataFrame | None = None

    def score(self, df: DataFrame) -> DataFrame:
        return predict_nonneg(self.model, df)


def train_workflow(
    samples: DataFrame, element: str, features: Sequence[str] = LEAK_FREE_FEATURES, seed: int = 42,
    estimator: Callable | None = None, folds: int = 0, **parameters,
) -> Trained:
    """Rows, features, split 64/16/20, fit on the train part, metrics per part.

    Fill values and location statistics come from the train part alone. The
    matrix is written once and read by the fit and by the scoring. ``estimator``
    makes the regressor from the parameters (default: ``GBTRegressor``);
    ``folds`` adds that many cross-validation folds of the train part.
    """
    started = time.monotonic()
    rows = training_rows(samples, [element])
    parted = keep(split(rows, ["SampleID", "Element", "Depth_From", "Depth_To", GRADE], seed=seed))
    train = parted.filter("part = 'train'")
    location = keep(fit_location(train))
    codes = {c: keep(label_codes(train, c)) for c in CODED}
    grouped = any(f not in LEAK_FREE_FEATURES for f in features)
    wide = features_training(parted, location, codes, train) if grouped else features_prediction(parted, location, codes)
    used = [f for f in features if f in wide.columns]
    raw = keep(feature_columns(wide, used, ["part"]))
    fills = keep(fit_impute(raw.filter("part = 'train'"), "median", used, []))
    matrix = fill_features(raw, fills, used)
    settings = parameters if estimator else GBT | parameters
    make = lambda: (estimator or GBTRegressor)(**settings)
    model = with_estimator(used, make()).fit(matrix.filter("part = 'train'"))
    scored = keep(predict_nonneg(model, matrix))
    residuals = keep(residual_row(scored.filter("part = 'validation'")))
    metrics = keep(stats.model_metrics(as_scored(scored), ["part"]))
    cv = keep(cv_summary(kfold_cv(matrix.filter("part = 'train'"), used, make, [*used, "label"], folds, seed))) if folds else None
    return Trained(
        element.upper(), used, model, residuals, metrics, location, codes, fills, keep(hole_table(samples)), time.monotonic() - started,
        type(make()).__name__, {k: str(v) for k, v in settings.items()}, cv)


def train_elements(samples: DataFrame, elements: Sequence[str], **options) -> tuple[dict[str, Trained], DataFrame]:
    """One model per element and a line on each: success, seconds, R², level."""
    done: dict[str, Trained] = {}
    lines = []
    for element in elements:
        started = time.monotonic()
        try:
            done[element.upper()] = found = train_workflow(samples, element, **options)
            row = found.metrics.filter("part = 'test'").first()
            lines.append((element.upper(), True, time.monotonic() - started, row["r2_score"], row["rmse"], None))
        except (ValueError, PySparkException) as error:  # an element without fit rows must not stop the others
            lines.append((element.upper(), False, time.monotonic() - started, None, None, str(error)))
    table = samples.sparkSession.createDataFrame(lines, "element string, success boolean, seconds double, r2 double, rmse double, error string")
    return done, table.withColumn("level", F.when(F.col("success"), r2_level(F.col("r2"))))


def save_model(trained: Trained, path: str, stamp: str) -> None:
    """Model, parameters and metadata document ``model_metadata_<stamp>.json``."""
    from corelode.sources.writers import save_parameters

    spark = trained.residuals.sparkSession
    model_path = f"{path}/grade_model_{stamp}"
    trained.model.write().overwrite().save(f"{model_path}/model")
    save_parameters({
        "residuals": trained.residuals, "metrics": trained.metrics, "location": trained.location, "fills": trained.fills,
        **{f"codes_{c}": df for c, df in trained.codes.items()}}, f"{model_path}/parameters")
    trained.holes.write.mode("overwrite").parquet(f"{model_path}/holes")
    by_part = {r["part"]: r.asDict() for r in trained.metrics.collect()}  # three rows
    by_cv = {r["part"]: r.asDict() for r in trained.cv.collect()} if trained.cv else {}  # two rows

    def as_map(row: dict, kind: str = "double") -> Column:
        cells = [F.lit(x) for k, v in row.items() if k != "part" and v is not None for x in (k, v if kind == "string" else float(v))]
        return (F.create_map(*cells) if cells else F.create_map()).cast(f"map<string,{kind}>")

    importance = [(r["feature"], r["importance"]) for r in feature_importance(trained.model, trained.features, spark).collect()]
    document = spark.range(1).select(
        F.lit(stamp).alias("pipeline_id"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.lit(trained.kind).alias("model_type"), F.lit(model_path).alias("model_path"), F.lit(trained.element).alias("element"),
        as_map(trained.configuration, "string").alias("configuration"),
        as_map({part: row["n"] for part, row in by_part.items()}).cast("map<string,bigint>").alias("split_sizes"),
        F.struct(*[as_map(by_part.get(part, {})).alias(f"{part}_metrics") for part in ("test", "train", "validation")],
                 as_map(by_cv.get("test", {})).alias("cv_metrics"), F.array(*[
            F.struct(F.lit(f).alias("feature"), F.lit(v).alias("importance")) for f, v in importance]).alias("feature_importance")).alias("evaluation_results"),
        F.array(*[F.lit(f) for f in trained.features]).alias("feature_names"))
    document.coalesce(1).write.mode("overwrite").json(f"{path}/model_metadata_{stamp}.json")


def load_model(spark: SparkSession, path: str, stamp: str) -> Trained:
    from corelode.sources.readers import MODEL_DOCUMENT
    from corelode.sources.writers import load_parameters

    document = spark.read.schema(MODEL_DOCUMENT).json(f"{path}/model_metadata_{stamp}.json").first()
    base = document["model_path"]
    p = load_parameters(spark, f"{base}/parameters", [
        "residuals", "metrics", "location", "fills", "codes_Element", "codes_DataSet", "codes_LabCode"])
    return Trained(
        document["element"], list(document["feature_names"]), PipelineModel.load(f"{base}/model"), p["residuals"], p["metrics"],
        p["location"], {c: p[f"codes_{c}"] for c in ("Element", "DataSet", "LabCode")}, p["fills"], spark.read.parquet(f"{base}/holes"),
        kind=document["model_type"], configuration=document["configuration"] or {})


def evaluate_saved(trained: Trained, rows: DataFrame) -> DataFrame:
    """Metrics of a model on other rows of the sample relation."""
    wide = features_training(training_rows(rows, [trained.element]), trained.location, trained.codes)
    return stats.model_metrics(as_scored(trained.score(feature_matrix(wide, trained.features, trained.fills))))


def model_info(trained: Trained) -> DataFrame:
    """One row on a model: element, features, trees, parameters, test and cross-validation metrics, best features."""
    spark = trained.residuals.sparkSession
    last = trained.model.stages[-1]
    best = [r["feature"] for r in top_features(feature_importance(trained.model, trained.features, spark), 5).collect()]
    test = trained.metrics.filter("part = 'test'").select("r2_score", "rmse", "mae")
    cells = [F.lit(x) for k, v in sorted(trained.configuration.items()) for x in (k, v)]
    cv = trained.cv.filter("part = 'test'").select("r2_mean").first() if trained.cv else None
    return test.select(
        (F.create_map(*cells) if cells else F.create_map().cast("map<string,string>")).alias("parameters"),
        F.lit(trained.kind).alias("model_type"), F.lit(cv["r2_mean"] if cv else None).cast("double").alias("cv_r2_mean"),
        F.lit(trained.element).alias("element"), F.lit("trained").alias("status"), F.lit(len(trained.features)).alias("feature_count"),
        F.lit(getattr(last, "getNumTrees", 0)).alias("trees"), "r2_score", "rmse", "mae", F.array(*[F.lit(f) for f in best]).alias("top_features"))
