"""Registered depth series, ordered windows and resource statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corelode.functions.predicates import GRADE
from corelode.operators import depth as D
from corelode.operators import resource as Q
from corelode.operators import rows as R
from corelode.operators.ordered import row_numbers
from corelode.plans.registry import register
from corelode.plans.rows import G, TRAINING, VALID
from corelode.schema import CUTOFFS

_IDS = ["SampleID", "Hole_ID", "Element", "Depth_From", "Depth_To", "Interval_Length", GRADE]
_NAMES = ", ".join(_IDS)
_SERIES = f"PARTITION BY Hole_ID, Element ORDER BY Depth_From, Depth_To, SampleID, {G}"

register(
    "depth_series", lambda t: D.depth_series(t.hole_samples).select(*_IDS, "depth_progression"),
    f"""SELECT {_NAMES}, Depth_From / nullif(max(Depth_From) OVER (PARTITION BY Hole_ID), 0) AS depth_progression
    FROM hole_samples WHERE {VALID} AND Depth_From IS NOT NULL""",
    depth_progression=9,
)
register(
    "depth_cumulative",
    lambda t: D.depth_cumulative(t.hole_samples).select(*_IDS, "cumulative_grade", "cumulative_length"),
    f"""SELECT {_NAMES}, sum({G}) OVER w AS cumulative_grade, sum(Interval_Length) OVER w AS cumulative_length
    FROM hole_samples WHERE {TRAINING} WINDOW w AS ({_SERIES} ROWS UNBOUNDED PRECEDING)""",
    cumulative_grade=2,
)
register(
    "depth_moving3", lambda t: D.depth_moving3(t.hole_samples).select(*_IDS, "grade_ma3", "grade_std3"),
    f"""SELECT {_NAMES}, CASE WHEN count({G}) OVER w = 3 THEN avg({G}) OVER w END AS grade_ma3,
    CASE WHEN count({G}) OVER w = 3 THEN stddev_samp({G}) OVER w END AS grade_std3
    FROM hole_samples WHERE {TRAINING} WINDOW w AS ({_SERIES} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
    grade_ma3=4, grade_std3=4,
)
OVERLAPS = f"""SELECT Hole_ID, count(*) FILTER (Depth_To > nxt) AS overlaps, count(*) AS intervals FROM (
 SELECT Hole_ID, Depth_To, lead(Depth_From) OVER (PARTITION BY Hole_ID ORDER BY Depth_From, Depth_To, SampleID, Element, {G} NULLS FIRST) AS nxt
 FROM hole_samples WHERE Depth_From IS NOT NULL) GROUP BY Hole_ID"""
register("interval_overlaps", lambda t: D.interval_overlaps(t.hole_samples), OVERLAPS)
_PLACE = f"latitude, longitude, SampleID, Element, Depth_From NULLS FIRST, Depth_To, {G}"
ROLLING = f"""SELECT SampleID, Element, Hole_ID, latitude, longitude, Depth_From, Depth_To, {G}, avg({G}) OVER w AS grade_rolling_mean,
 stddev_samp({G}) OVER w AS grade_rolling_std, quantile_cont({G}, 0.5) OVER w AS grade_rolling_median,
 quantile_cont({G}, 0.25) OVER w AS grade_rolling_q25, quantile_cont({G}, 0.75) OVER w AS grade_rolling_q75
 FROM hole_samples WHERE {VALID} WINDOW w AS (ORDER BY {_PLACE} ROWS 9 PRECEDING)"""
ROLLING = f"SELECT *, grade_rolling_q75 - grade_rolling_q25 AS local_iqr, grade_rolling_std / grade_rolling_mean AS local_coefficient_variation FROM ({ROLLING})"
ROLLING_DIGITS = dict(grade_rolling_mean=4, grade_rolling_std=4, grade_rolling_median=4, grade_rolling_q25=4,
                      grade_rolling_q75=4, local_iqr=4, local_coefficient_variation=6)
_ROLLING_IN = ["SampleID", "Element", "Hole_ID", "latitude", "longitude", "Depth_From", "Depth_To", GRADE]
register("rolling10", lambda t: D.rolling_grades(t.hole_samples.select(*_ROLLING_IN)), ROLLING, **ROLLING_DIGITS)
register(
    "tonnage_curve", lambda t: D.tonnage_curve(t.hole_samples, 2.7),
    f"""SELECT * EXCLUDE (l, c), l * 2.7::DOUBLE AS cumulative_tonnage, c * 2.7::DOUBLE / 1e6 AS cumulative_metal, c / l AS cumulative_grade FROM (
    SELECT SampleID, Element, Depth_To, {G}, Interval_Length, sum(Interval_Length) OVER w AS l, sum({G} * Interval_Length) OVER w AS c
    FROM hole_samples WHERE {G} > 0 AND Interval_Length > 0
    WINDOW w AS (PARTITION BY Element ORDER BY {G} DESC, SampleID, Depth_To, Interval_Length ROWS UNBOUNDED PRECEDING))""",
    cumulative_tonnage=3, cumulative_metal=10, cumulative_grade=6,
)
_LATEST = "SELECT * FROM models QUALIFY row_number() OVER (PARTITION BY element ORDER BY trained DESC) = 1"
register("latest_model", lambda t: D.latest_model(t.models), _LATEST)
register(
    "seq_numbers",
    lambda t: row_numbers(R.training_rows(t.hole_samples).select(*_IDS), [], ["Hole_ID", "Element", "Depth_From", "SampleID", GRADE], "seq"),
    f"SELECT {_NAMES}, row_number() OVER (ORDER BY Hole_ID, Element, Depth_From, SampleID, {G}) AS seq FROM hole_samples WHERE {TRAINING}",
)
register(
    "avg_ranks", lambda t: D.average_ranks(t.scored.select("SampleID", "Element", "y_true"), ["Element"], "y_true"),
    """SELECT SampleID, Element, y_true, rank() OVER (PARTITION BY Element ORDER BY y_true)
    + (count(*) OVER (PARTITION BY Element, y_true) - 1) / 2.0::DOUBLE AS rank FROM scored""",
)
AUTOCORR = f"""WITH s AS (SELECT Element, {G} - avg({G}) OVER (PARTITION BY Element) AS d, count(*) OVER (PARTITION BY Element) AS n,
  row_number() OVER (PARTITION BY Element ORDER BY sampled_at, SampleID, Depth_To, {G}) AS i FROM hole_samples WHERE {TRAINING}),
 l AS (SELECT Element, n, i, d, CAST(unnest(range(0, least(50, n // 4))) AS BIGINT) AS lag FROM s),
 p AS (SELECT l.Element, l.lag, max(l.n) AS n, sum(l.d * s.d) AS product FROM l JOIN s ON s.Element = l.Element AND s.i = l.i - l.lag GROUP BY ALL)
 SELECT Element, lag, n, product / max(product) FILTER (lag = 0) OVER (PARTITION BY Element) AS autocorrelation FROM p"""


def _autocorrelation(t):
    rows = R.training_rows(t.hole_samples, carry=["sampled_at"])
    products = D.lag_products(rows, ["Element"], ["sampled_at", "SampleID", "Depth_To", GRADE], GRADE)
    return products.select("Element", "lag", "n", (F.col("product") / F.col("power")).alias("autocorrelation"))


register("lag_autocorr", _autocorrelation, AUTOCORR, autocorrelation=7)

register(
    "grade_tonnage", lambda t: Q.grade_tonnage(t.hole_samples),
    f"""SELECT Element, sum(Interval_Length * 2.7) AS total_tonnage, sum({G} * (Interval_Length * 2.7) / 1e6) AS total_metal_content,
    sum({G} * (Interval_Length * 2.7)) / sum(Interval_Length * 2.7) AS average_grade, var_pop({G}) AS grade_variance
    FROM hole_samples WHERE {G} > 0 AND Interval_Length > 0 GROUP BY Element""",
    total_tonnage=2, total_metal_content=5, average_grade=4, grade_variance=1,
)
_CUTS = " UNION ALL ".join(
    f"""SELECT Element, {c}.0::DOUBLE AS cutoff, count(*) FILTER ({G} >= {c}) AS samples, count(*) FILTER ({G} >= {c}) * 100.0::DOUBLE / count(*) AS percent,
    coalesce(sum(Interval_Length * 2.7) FILTER ({G} >= {c}), 0) AS tonnage, avg({G}) FILTER ({G} >= {c}) AS mean_grade
    FROM hole_samples WHERE {G} > 0 GROUP BY Element""" for c in [*CUTOFFS, 50000])
register("cutoff_curve", lambda t: Q.cutoff_curve(t.hole_samples, [*CUTOFFS, 50000]), _CUTS, percent=6, tonnage=2, mean_grade=4)
_QS = ", ".join(f"quantile_cont({G}, {p}) AS {n}" for n, p in (
    ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)))
_GEO = f"""SELECT Element, count({G}) AS count, avg({G}) AS mean, stddev_samp({G}) AS std, min({G}) AS min, max({G}) AS max,
 skewness({G}) AS skewness, kurtosis({G}) AS kurtosis, avg(ln(CASE WHEN {G} > 0 THEN {G} END)) AS lm,
 stddev_samp(ln(CASE WHEN {G} > 0 THEN {G} END)) AS ls, {_QS} FROM hole_samples WHERE {G} IS NOT NULL WHERE_MORE GROUP BY Element"""
_GEO = f"""SELECT * EXCLUDE (lm, ls), CASE WHEN mean > 0 THEN std / mean ELSE 0 END AS cv, CASE WHEN min > 0 THEN lm END AS log_mean,
 CASE WHEN min > 0 THEN ls END AS log_std, CASE WHEN min > 0 THEN exp(lm) END AS geometric_mean FROM ({_GEO})"""
_GD = dict(mean=4, std=4, skewness=7, kurtosis=7, q25=4, median=4, q75=4, p90=4, p95=4, p99=4, cv=7, log_mean=7, log_std=7, geometric_mean=4)
register("geological_statistics", lambda t: Q.geological_statistics(t.hole_samples), _GEO.replace("WHERE_MORE", ""), **_GD)
register("geological_statistics_positive", lambda t: Q.geological_statistics(t.hole_samples.filter(F.col(GRADE) > 0)),
         _GEO.replace("WHERE_MORE", f"AND {G} > 0"), **_GD)
register(
    "anomalies", lambda t: Q.anomalies(t.hole_samples, 1.5),
    f"""WITH s AS (SELECT Element, avg({G}) AS mean_grade, stddev_samp({G}) AS std_grade FROM hole_samples WHERE {VALID} GROUP BY Element)
    SELECT Hole_ID, SampleID, h.Element, {G}, latitude, longitude, DataSet, LabCode, mean_grade, std_grade,
    abs({G} - mean_grade) / nullif(std_grade, 0) AS z_score,
    CASE WHEN abs({G} - mean_grade) / nullif(std_grade, 0) > 1.5 THEN 'anomaly' ELSE 'normal' END AS anomaly_flag
    FROM hole_samples h JOIN s ON h.Element = s.Element WHERE {VALID}""",
    mean_grade=4, std_grade=4, z_score=7,
)
