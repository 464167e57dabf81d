"""Registered features and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corelode.functions import predicates as P
from corelode.functions.predicates import GRADE
from corelode.functions.probability import QUANTILE_FIT, QUANTILE_TAIL
from corelode.operators import depth as D
from corelode.operators import features as E
from corelode.operators import rows as R
from corelode.operators import stats as T
from corelode.plans.depth import AUTOCORR, ROLLING, ROLLING_DIGITS
from corelode.plans.profile import GROUP_DIGITS, GROUP_SQL
from corelode.plans.quality import _ks_sql
from corelode.plans.registry import CATALOG, register
from corelode.plans.rows import COLUMNS, G, TRAINING, VALID

_ID = ["SampleID", "Element", "Depth_From", "Depth_To", "latitude", "longitude", GRADE]
_N = ", ".join(_ID)


def _valid(t):
    return t.hole_samples.filter(P.valid_sample()).select(*_ID)


_SPATIAL = f"""SELECT {_N}, (latitude - a) / nullif(sa, 0) AS lat_norm, (longitude - b) / nullif(sb, 0) AS lon_norm,
 sqrt(pow(latitude - a, 2) + pow(longitude - b, 2)) AS distance_to_center, atan2(latitude - a, longitude - b) AS angle_from_center,
 CAST((latitude > a)::INT * 2 + (longitude > b)::INT AS BIGINT) AS quadrant FROM hole_samples,
 (SELECT avg(latitude) AS a, avg(longitude) AS b, stddev_samp(latitude) AS sa, stddev_samp(longitude) AS sb FROM hole_samples WHERE {VALID}) WHERE {VALID}"""
_SD = dict(lat_norm=6, lon_norm=6, distance_to_center=8, angle_from_center=6)
register("features_spatial", lambda t: E.features_spatial(_valid(t)), _SPATIAL, **_SD)
_ORDER = f"SampleID, Element, Depth_From NULLS FIRST, Depth_To, {G}"
NEIGHBORS = f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY latitude, longitude ORDER BY {_ORDER}) AS pos, row_number() OVER (ORDER BY {_ORDER}) AS rid
  FROM (SELECT {_N} FROM hole_samples WHERE {VALID})),
 s AS (SELECT DISTINCT latitude, longitude FROM v),
 c AS (SELECT s.latitude AS y, s.longitude AS x, sqrt((s.latitude - v.latitude) * (s.latitude - v.latitude) + (s.longitude - v.longitude) * (s.longitude - v.longitude)) AS d, v.rid, v.{G} AS g
  FROM s, v WHERE v.pos <= 6),
 n AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY d, rid) <= 6),
 k AS (SELECT v.rid AS me, n.d, n.g FROM v JOIN n ON n.y = v.latitude AND n.x = v.longitude AND n.rid <> v.rid
  QUALIFY row_number() OVER (PARTITION BY v.rid ORDER BY n.d, n.rid) <= 5),
 a AS (SELECT me, avg(d) AS avg_neighbor_distance, min(d) AS min_neighbor_distance, max(d) AS max_neighbor_distance, avg(g) AS avg_neighbor_grade FROM k GROUP BY me)
 SELECT {_N}, avg_neighbor_distance, min_neighbor_distance, max_neighbor_distance, avg_neighbor_grade, {G} - avg_neighbor_grade AS grade_vs_neighbors
 FROM v JOIN a ON a.me = v.rid"""
_ND = dict(avg_neighbor_distance=8, min_neighbor_distance=8, max_neighbor_distance=8, avg_neighbor_grade=4, grade_vs_neighbors=4)
register("features_neighbors", lambda t: E.features_neighbors(_valid(t)), NEIGHBORS, **_ND)
_ROLL_IN = ["SampleID", "Element", "Hole_ID", "latitude", "longitude", "Depth_From", "Depth_To", GRADE]
register("features_rolling", lambda t: D.rolling_grades(t.hole_samples.select(*_ROLL_IN), 10), ROLLING, **ROLLING_DIGITS)
_GRADE = f"""SELECT {_N}, ln(1 + {G}) AS grade_log, sqrt({G}) AS grade_sqrt, {G} * {G} AS grade_squared,
 CASE WHEN {G} <= q1 THEN 'low' WHEN {G} <= q2 THEN 'medium' WHEN {G} <= q3 THEN 'high' ELSE 'very_high' END AS grade_category,
 CAST(abs({G} - m) > 2 * s AS BIGINT) AS is_anomaly, abs({G} - m) / nullif(s, 0) AS anomaly_score,
 CAST(CASE WHEN {G} <= q1 THEN 1 WHEN {G} <= q2 THEN 2 WHEN {G} <= q3 THEN 0 ELSE 3 END AS BIGINT) AS grade_category_encoded
 FROM hole_samples, (SELECT quantile_cont({G}, 0.25) AS q1, quantile_cont({G}, 0.5) AS q2, quantile_cont({G}, 0.75) AS q3, avg({G}) AS m, stddev_samp({G}) AS s
  FROM hole_samples WHERE {VALID}) WHERE {VALID}"""
_GD = dict(grade_log=7, grade_sqrt=6, grade_squared=3, anomaly_score=7)
register("features_grade", lambda t: E.features_grade(_valid(t)), _GRADE, **_GD)
_FITTED = """(SELECT avg(latitude) AS la, avg(longitude) AS lo, min(md) AS d0, max(md) AS d1, max(Interval_Length) AS il, min(elevation) AS e0, max(elevation) AS e1 FROM b)"""
_LOCATION = """latitude / (longitude + 1e-8) AS lat_lon_ratio, sqrt((latitude - la) * (latitude - la) + (longitude - lo) * (longitude - lo)) AS distance_from_center,
 md / (d1 + 1e-8) AS depth_ratio, Interval_Length / (il + 1e-8) AS interval_ratio, (md - d0) / (d1 - d0 + 1e-8) AS depth_normalized,
 (elevation - e0) / (e1 - e0 + 1e-8) AS elevation_normalized, dense_rank() OVER (ORDER BY Element) - 1 AS element_encoded,
 dense_rank() OVER (ORDER BY DataSet) - 1 AS dataset_encoded, CASE WHEN LabCode IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY LabCode NULLS LAST) - 1 END AS labcode_encoded"""
_LD = dict(lat_lon_ratio=8, distance_from_center=8, depth_ratio=8, interval_ratio=8, depth_normalized=8, elevation_normalized=8)
register(
    "features_training", lambda t: E.features_training(R.training_rows(t.hole_samples)),
    f"""WITH b AS (SELECT *, (Depth_From + Depth_To) / 2 AS md FROM hole_samples WHERE {TRAINING})
    SELECT {COLUMNS}, md AS mid_depth, {G} * Interval_Length AS grade_tonnage,
    CASE WHEN {G} > 1000 THEN 'high' WHEN {G} > 500 THEN 'medium' ELSE 'low' END AS grade_category, {_LOCATION},
    ln(1 + {G}) AS log_grade, {G} / (Interval_Length + 1e-8) AS grade_per_meter, {GROUP_SQL} FROM b, {_FITTED}""",
    **_LD, log_grade=7, grade_per_meter=4, **GROUP_DIGITS,
)
_NO_GRADE = COLUMNS.replace(G + ", ", "")
register(
    "features_prediction", lambda t: E.features_prediction(R.prediction_rows(t.hole_samples)),
    f"""WITH b AS (SELECT *, (Depth_From + Depth_To) / 2 AS md FROM hole_samples
    WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND Depth_From IS NOT NULL AND Depth_To IS NOT NULL AND Interval_Length > 0)
    SELECT {_NO_GRADE}, md AS mid_depth, {_LOCATION} FROM b, {_FITTED}""",
    **_LD,
)
register(
    "features_extract", lambda t: E.features_extract(t.hole_samples.filter(P.valid_sample()).select(*_ID, "Interval_Length")),
    f"""SELECT {_N}, Interval_Length, (Depth_From + Depth_To) / 2 AS mid_depth, Depth_To - Depth_From AS depth_range, ln(1 + {G}) AS log_grade,
    {G} * Interval_Length AS grade_intensity, printf('%.3f_%.3f', latitude, longitude) AS spatial_hash,
    sqrt((latitude - a) * (latitude - a) + (longitude - b) * (longitude - b)) AS distance_from_center
    FROM hole_samples, (SELECT median(latitude) AS a, median(longitude) AS b FROM hole_samples WHERE {VALID}) WHERE {VALID}""",
    log_grade=7, distance_from_center=8,
)
register("features_all", lambda t: E.features_all(t.hole_samples.select(*_ROLL_IN)))
register("feature_matrix", lambda t: E.feature_matrix(E.features_training(R.training_rows(t.hole_samples, ["Cu"]))))
register(
    "align_features",
    lambda t: E.align_features(E.features_prediction(R.prediction_rows(t.hole_samples, ["Cu"])), E.LEAK_FREE_FEATURES + ["rock_density"], ["SampleID"]),
    f"""SELECT SampleID, latitude, longitude, elevation, mid_depth, Interval_Length, lat_lon_ratio, distance_from_center, depth_ratio, interval_ratio,
    CAST(element_encoded AS DOUBLE) AS element_encoded, CAST(dataset_encoded AS DOUBLE) AS dataset_encoded, CAST(labcode_encoded AS DOUBLE) AS labcode_encoded,
    depth_normalized, elevation_normalized, Depth_From, Depth_To, 0.0::DOUBLE AS rock_density FROM (
    SELECT *, md AS mid_depth, {_LOCATION} FROM (SELECT *, (Depth_From + Depth_To) / 2 AS md FROM hole_samples
    WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND Depth_From IS NOT NULL AND Depth_To IS NOT NULL AND Interval_Length > 0 AND Element = 'Cu') b,
    {_FITTED.replace('FROM b', "FROM (SELECT *, (Depth_From + Depth_To) / 2 AS md FROM hole_samples WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND Depth_From IS NOT NULL AND Depth_To IS NOT NULL AND Interval_Length > 0 AND Element = 'Cu')")})""",
    **_LD,
)


def _request_points(t):
    valid = t.requests.filter(F.col("latitude").between(-90, 90) & (F.col("depth_from") < F.col("depth_to")))
    return valid.select(F.col("user_id").alias("point_id"), "latitude", "longitude", "depth_from", "depth_to").distinct()




def _prediction_features(t):
    return E.point_features(_request_points(t), E.hole_table(t.hole_samples), E.fit_location(R.training_rows(t.hole_samples)))


register("prediction_features", _prediction_features)

# statistics
_E = "(y_pred - y_true)"
_METRICS = f"""SELECT Element, count(*) AS n, avg({_E} * {_E}) AS mse, sqrt(avg({_E} * {_E})) AS rmse, avg(abs{_E}) AS mae,
 1 - sum({_E} * {_E}) / nullif(var_pop(y_true) * count(*), 0) AS r2, avg(abs{_E} / nullif(abs(y_true), 0)) * 100 AS mape,
 avg(2 * abs{_E} / nullif(abs(y_true) + abs(y_pred), 0)) * 100 AS smape, avg{_E} AS mean_bias, avg{_E} AS residual_mean,
 avg{_E} / avg(y_true) * 100 AS bias_percentage, corr(y_true, y_pred) AS pearson_r, stddev_pop{_E} AS residual_std,
 (sum(pow({_E} - b, 3)) / count(*)) / pow(var_pop{_E}, 1.5) AS residual_skewness, (sum(pow({_E} - b, 4)) / count(*)) / pow(var_pop{_E}, 2) - 3 AS residual_kurtosis,
 avg(CASE WHEN abs{_E} <= 1.96 * sd THEN 1.0::DOUBLE ELSE 0 END) AS coverage_95, avg(2 * 1.96 * sd) AS mean_pi_width, avg(2 * 1.96 * sd) / stddev_pop(y_true) AS pi_width_normalized,
 {', '.join(f'quantile_cont(abs{_E}, {q}) AS abs_error_q{int(q * 100)}' for q in (0.1, 0.25, 0.5, 0.75, 0.9))}, corr(ry, rp) AS spearman_r
 FROM (SELECT *, avg(y_pred - y_true) OVER (PARTITION BY Element) AS b, y_true / 20 AS sd,
  rank() OVER (PARTITION BY Element ORDER BY y_true) + (count(*) OVER (PARTITION BY Element, y_true) - 1) / 2.0 AS ry,
  rank() OVER (PARTITION BY Element ORDER BY y_pred) + (count(*) OVER (PARTITION BY Element, y_pred) - 1) / 2.0 AS rp FROM scored) GROUP BY Element"""
register(
    "regression_metrics", lambda t: T.regression_metrics(t.scored.withColumn("sd", F.col("y_true") / 20), ["Element"], "sd"), _METRICS,
    mse=1, rmse=4, mae=4, r2=7, mape=6, smape=6, mean_bias=4, residual_mean=4, bias_percentage=6, pearson_r=7, spearman_r=7, residual_std=4,
    residual_skewness=6, residual_kurtosis=6, coverage_95=7, mean_pi_width=4, pi_width_normalized=7,
    **{f"abs_error_q{q}": 4 for q in (10, 25, 50, 75, 90)},
)
_CUTOFFS = ", ".join(f"avg(CASE WHEN (y_true >= {c}) = (y_pred >= {c}) THEN 1.0::DOUBLE ELSE 0 END) AS cutoff_{c}ppm_accuracy" for c in (100, 500, 1000, 2000, 5000))
register(
    "model_metrics", lambda t: T.model_metrics(t.scored, ["Element"]),
    f"""SELECT Element, count(*) AS n, sqrt(avg({_E} * {_E})) AS rmse, 1 - sum({_E} * {_E}) / nullif(var_pop(y_true) * count(*), 0) AS r2_score, avg(abs{_E}) AS mae,
    avg({_E} * {_E}) AS mse, 1 - var_pop{_E} / nullif(var_pop(y_true), 0) AS explained_variance, avg(abs{_E} / nullif(abs(y_true), 0)) * 100 AS mape, avg{_E} AS bias,
    avg{_E} / avg(y_true) * 100 AS relative_bias_percent, {_CUTOFFS} FROM scored GROUP BY Element""",
    rmse=4, r2_score=7, mae=4, mse=1, explained_variance=7, mape=6, bias=4, relative_bias_percent=6,
    **{f"cutoff_{c}ppm_accuracy": 7 for c in (100, 500, 1000, 2000, 5000)},
)


def _bins(c: str) -> str:
    return f"CASE WHEN {c} <= 0 THEN NULL WHEN {c} <= 0.1 THEN 1 WHEN {c} <= 0.5 THEN 2 WHEN {c} <= 1 THEN 3 WHEN {c} <= 2 THEN 4 ELSE 5 END"


# the class limits are for percentages, so the fixture's grades are scaled down
_SCALED = "(SELECT Element, y_true / 50000 AS y_true, (y_pred * y_pred / 60000) / 50000 AS y_pred FROM scored)"
register(
    "grade_class_metrics",
    lambda t: T.grade_class_metrics(t.scored.select("Element", (F.col("y_true") / 50000).alias("y_true"), (F.col("y_pred") * F.col("y_pred") / 60000 / 50000).alias("y_pred")), ["Element"]),
    f"""SELECT Element, avg(CASE WHEN {_bins('y_true')} = {_bins('y_pred')} THEN 1.0::DOUBLE ELSE 0 END) AS grade_classification_accuracy,
    coalesce(count(*) FILTER (y_true > 1 AND y_pred > 1)::DOUBLE / nullif(count(*) FILTER (y_pred > 1), 0), 0) AS high_grade_precision,
    coalesce(count(*) FILTER (y_true > 1 AND y_pred > 1)::DOUBLE / nullif(count(*) FILTER (y_true > 1), 0), 0) AS high_grade_recall,
    abs(sum(y_true) - sum(y_pred)) / sum(y_true) AS resource_estimation_error, corr(y_true, y_pred) AS grade_continuity_correlation
    FROM {_SCALED} GROUP BY Element""",
    grade_classification_accuracy=7, high_grade_precision=7, high_grade_recall=7, resource_estimation_error=7, grade_continuity_correlation=7,
)
register("bootstrap_ci", lambda t: T.bootstrap_ci(t.scored, "y_true", ["SampleID", "Element", "y_pred"], "mean"))


def _t_p_sql(t: str, v: str) -> str:
    """Two-sided p-value of Student's t by Simpson's rule over the density."""
    def density(u: str) -> str:
        return f"exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2) - 0.5 * ln({v} * pi()) - ({v} + 1) / 2 * ln(1 + pow({u}, 2) / {v}))"

    inner = density(f"(k * abs({t}) / 400)")
    return f"""greatest(0.0, 1 - 2 * abs({t}) / 1200 * list_sum([CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * {inner} FOR k IN range(0, 401)]))"""


_PAIR = ("DataSet", "Drilling_BF", "Drilling_INF", GRADE, ["Element"])
_TESTED = f"DataSet IN ('Drilling_BF', 'Drilling_INF') AND {G} > 0"


def _tested(t):
    return t.hole_samples.filter(P.positive_grade())


register(
    "ttests", lambda t: T.ttest_statistics(_tested(t), *_PAIR),
    f"""WITH m AS (SELECT Element, count({G}) FILTER (DataSet = 'Drilling_BF') AS n1, count({G}) FILTER (DataSet = 'Drilling_INF') AS n2,
    avg({G}) FILTER (DataSet = 'Drilling_BF') AS m1, avg({G}) FILTER (DataSet = 'Drilling_INF') AS m2,
    var_samp({G}) FILTER (DataSet = 'Drilling_BF') AS v1, var_samp({G}) FILTER (DataSet = 'Drilling_INF') AS v2 FROM hole_samples WHERE {_TESTED} GROUP BY Element)
    , s AS (SELECT Element, n1, n2, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) AS ttest_stat,
    CAST(n1 + n2 - 2 AS DOUBLE) AS ttest_df, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS welch_stat,
    pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS welch_df FROM m),
    p AS (SELECT *, {_t_p_sql('ttest_stat', 'ttest_df')} AS ttest_p_value, {_t_p_sql('welch_stat', 'welch_df')} AS welch_p_value FROM s)
    SELECT *, ttest_p_value < 0.05 AS means_different, welch_p_value < 0.05 AS means_different_welch FROM p""",
    ttest_stat=6, welch_stat=6, welch_df=4, ttest_p_value=6, welch_p_value=6,
)
register(
    "ks_2samp", lambda t: T.ks_statistics(_tested(t), *_PAIR),
    _ks_sql("", "hole_samples", G, "DataSet = 'Drilling_BF'", "Element", _TESTED), ks_statistic=9, p_value=7,
)
register(
    "mann_whitney", lambda t: T.mann_whitney_statistics(_tested(t), *_PAIR),
    f"""WITH r AS (SELECT Element, DataSet, rank() OVER (PARTITION BY Element ORDER BY {G}) + (count(*) OVER (PARTITION BY Element, {G}) - 1) / 2.0::DOUBLE AS rk
      FROM hole_samples WHERE {_TESTED}),
    t AS (SELECT Element, sum(k * k * k - k) AS ties FROM (SELECT Element, count(*)::DOUBLE AS k FROM hole_samples WHERE {_TESTED} GROUP BY Element, {G}) GROUP BY Element),
    u AS (SELECT Element, count(*) FILTER (DataSet = 'Drilling_BF') AS n1, count(*) FILTER (DataSet <> 'Drilling_BF') AS n2, sum(rk) FILTER (DataSet = 'Drilling_BF') AS r FROM r GROUP BY Element),
    w AS (SELECT u.Element, n1, n2, r - n1 * (n1 + 1) / 2.0::DOUBLE AS mannwhitney_stat, ties, n1::DOUBLE AS a, n2::DOUBLE AS b FROM u JOIN t ON u.Element = t.Element),
    z AS (SELECT Element, n1, n2, mannwhitney_stat, (greatest(mannwhitney_stat, a * b - mannwhitney_stat) - a * b / 2 - 0.5)
    / sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))) AS z FROM w),
    p AS (SELECT *, least(1.0, 1 - 2 * z / 1200 * list_sum([CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(k * z / 400, 2) / 2) / sqrt(2 * pi())
     FOR k IN range(0, 401)])) AS mannwhitney_p_value FROM z)
    SELECT *, mannwhitney_p_value < 0.05 AS distributions_different FROM p""",
    z=6, mannwhitney_p_value=5,
)
register("normality", lambda t: T.normality(_tested(t), GRADE, ["Element"]))
register("fit_distributions", lambda t: T.fit_distributions(_tested(t), GRADE))
# The laws whose parameters have a closed form, by value.
register(
    "fit_closed_laws",
    lambda t: T.fit_distributions(_tested(t), GRADE).filter("distribution IN ('norm', 'lognorm', 'expon')").select(
        "distribution", F.col("parameters")[0].alias("first"), F.element_at("parameters", -1).alias("last"), "log_likelihood", "aic", "bic"),
    f"""WITH s AS (SELECT count(*) AS n, avg({G}) AS m, stddev_pop({G}) AS sd, avg(ln({G})) AS lm, stddev_pop(ln({G})) AS ls FROM hole_samples WHERE {G} > 0),
    l AS (SELECT 'norm' AS distribution, m AS first, sd AS last, 2 AS k, n, n * (-0.5 * ln(2 * pi()) - ln(sd) - 0.5) AS log_likelihood FROM s
    UNION ALL SELECT 'lognorm', ls, exp(lm), 3, n, n * (-lm - ln(ls) - 0.5 * ln(2 * pi()) - 0.5) FROM s
    UNION ALL SELECT 'expon', 0, m, 2, n, n * (-ln(m) - 1) FROM s)
    SELECT distribution, first, last, log_likelihood, 2 * k - 2 * log_likelihood AS aic, k * ln(n) - 2 * log_likelihood AS bic FROM l""",
    first=3, last=3, log_likelihood=2, aic=2, bic=2,
)


def _quantile_sql(p: str) -> str:
    """``probability.normal_quantile`` in DuckDB."""
    def powers(coefficients: list[float], x: str) -> str:
        text = repr(coefficients[0])
        for c in coefficients[1:]:
            text = f"({text} * {x} + ({c!r}))"
        return text

    up, down, tail_up, tail_down = QUANTILE_FIT
    q, t = f"({p} - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    tail = f"({powers(tail_up, t)} / {powers(tail_down, t)})"
    return f"CASE WHEN {p} < {QUANTILE_TAIL} THEN {tail} WHEN {p} > 1 - {QUANTILE_TAIL} THEN -{tail} ELSE {q} * {powers(up, f'{q} * {q}')} / {powers(down, f'{q} * {q}')} END"


def _poly_sql(coefficients: list[float], x: str) -> str:
    return " + ".join(f"({c!r}) * pow({x}, {len(coefficients) - 1 - i})" for i, c in enumerate(coefficients))


register(
    "shapiro_wilk", lambda t: T.shapiro_wilk(_tested(t), GRADE, ["Hole_ID"]).select("Hole_ID", "n", "shapiro_stat"),
    f"""WITH r AS (SELECT Hole_ID, {G} AS x, count(*) OVER h AS n, row_number() OVER (h ORDER BY {G}) AS i, avg({G}) OVER h AS m
     FROM hole_samples WHERE {G} > 0 WINDOW h AS (PARTITION BY Hole_ID)),
    e AS (SELECT *, {_quantile_sql("((i - 0.375) / (n + 0.25))")} AS e FROM r WHERE n BETWEEN 6 AND {T.SHAPIRO_MOST}),
    o AS (SELECT Hole_ID, n, sum(e * e) AS p, -min(e) FILTER (i = 1) AS m1, -min(e) FILTER (i = 2) AS m2 FROM e GROUP BY Hole_ID, n),
    a AS (SELECT *, {_poly_sql(T.SHAPIRO_OUTER, "(1 / sqrt(n))")} + m1 / sqrt(p) AS a1, {_poly_sql(T.SHAPIRO_NEXT, "(1 / sqrt(n))")} + m2 / sqrt(p) AS a2 FROM o),
    f AS (SELECT *, sqrt((p - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) AS f FROM a),
    w AS (SELECT Hole_ID, n, pow(sum(sign(e) * CASE WHEN i IN (1, n) THEN a1 WHEN i IN (2, n - 1) THEN a2 ELSE abs(e) / f END * x), 2) / sum((x - m) * (x - m)) AS shapiro_stat
     FROM e JOIN f USING (Hole_ID, n) GROUP BY Hole_ID, n)
    SELECT Hole_ID, count(*) AS n, any_value(shapiro_stat) AS shapiro_stat FROM hole_samples LEFT JOIN w USING (Hole_ID) WHERE {G} > 0 GROUP BY Hole_ID""",
    shapiro_stat=6,
)
register(
    "trend", lambda t: T.trend(_tested(t), F.date_diff(F.to_date("sampled_at"), F.lit("1970-01-01").cast("date")).cast("double"), GRADE, ["Element"]),
    f"""WITH l AS (SELECT Element, count(*) AS n, regr_slope({G}, d) AS trend_slope, regr_intercept({G}, d) AS trend_intercept, regr_r2({G}, d) AS trend_r_squared
    FROM (SELECT *, date_diff('day', DATE '1970-01-01', CAST(sampled_at AS DATE))::DOUBLE AS d FROM hole_samples WHERE {G} > 0) GROUP BY Element),
    t AS (SELECT *, sqrt(trend_r_squared * (n - 2) / (1 - trend_r_squared)) AS t, CAST(n - 2 AS DOUBLE) AS v FROM l),
    p AS (SELECT *, {_t_p_sql('t', 'v')} AS trend_p_value FROM t) SELECT * EXCLUDE (t, v), trend_p_value < 0.05 AS trend_significant FROM p""",
    trend_slope=6, trend_intercept=2, trend_r_squared=9, trend_p_value=6,
)
_SPREAD = f"(SELECT Element, var_pop({G}) AS variance, stddev_pop({G}) / avg({G}) AS coefficient_of_variation FROM hole_samples WHERE {TRAINING} GROUP BY Element)"


def _series(t):
    return T.autocorrelation(
        t.hole_samples.filter(P.valid_training()), ["Element"], ["sampled_at", "SampleID", "Depth_To", GRADE], GRADE)


register(
    "autocorrelation", _series,
    f"""SELECT a.*, s.variance, s.coefficient_of_variation, max(autocorrelation) FILTER (lag = 1) OVER (PARTITION BY a.Element) AS autocorr_lag1
    FROM ({AUTOCORR}) a JOIN {_SPREAD} s ON a.Element = s.Element""",
    autocorrelation=7, autocorr_lag1=7, variance=1, coefficient_of_variation=7,
)
_PLAIN = CATALOG["model_metrics"].sql.replace("SELECT Element, ", "SELECT ").replace(" GROUP BY Element", "")
_SHRUNK = _PLAIN.replace("FROM scored", "FROM (SELECT * REPLACE (CAST(0.95 AS DOUBLE) * y_pred AS y_pred) FROM scored)")
register(
    "compare_models",
    lambda t: T.compare_models({
        "plain": T.model_metrics(t.scored), "shrunk": T.model_metrics(t.scored.withColumn("y_pred", F.col("y_pred") * 0.95))}),
    f"SELECT *, 'plain' AS model FROM ({_PLAIN}) UNION ALL SELECT *, 'shrunk' AS model FROM ({_SHRUNK})",
    **CATALOG["model_metrics"].digits,
)
