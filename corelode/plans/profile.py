"""Registered summaries and pivots."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from corelode.functions.predicates import GRADE
from corelode.operators import profile as A
from corelode.operators import rows as R
from corelode.plans.registry import CATALOG, register
from corelode.plans.rows import CENTER, G, TRAINING, VALID
from corelode.schema import ELEMENTS

_STATS = f"avg({G}) AS avg_grade, min({G}) AS min_grade, max({G}) AS max_grade"
_SUMMARY = f"""SELECT Element, count(*) AS total_records, count(DISTINCT Hole_ID) AS unique_holes,
 count(DISTINCT SampleID) AS unique_samples, {_STATS}, stddev_samp({G}) AS std_grade
 FROM hole_samples WHERE {G} > 0 GROUP BY Element"""
register("elements_summary", lambda t: A.elements_summary(t.hole_samples), _SUMMARY, avg_grade=4, std_grade=4)
register(
    "element_statistics", lambda t: A.element_statistics(t.hole_samples),
    f"SELECT *, std_grade / avg_grade AS coefficient_of_variation, total_records / unique_holes AS records_per_hole FROM ({_SUMMARY})",
    avg_grade=4, std_grade=4, coefficient_of_variation=8, records_per_hole=6,
)
register(
    "data_summary", lambda t: A.data_summary(t.hole_samples),
    f"""SELECT CASE WHEN grouping(Element) = 0 THEN 'element' WHEN grouping(DataSet) = 0 THEN 'dataset'
      WHEN grouping(LabCode) = 0 THEN 'lab' ELSE 'total' END AS level, coalesce(Element, DataSet, LabCode) AS name,
    count(*) AS records, count(DISTINCT Hole_ID) AS unique_holes, count(DISTINCT SampleID) AS unique_samples,
    count(DISTINCT h.Element) AS unique_elements, {_STATS}, stddev_samp({G}) AS std_grade
    FROM hole_samples h WHERE {G} IS NOT NULL GROUP BY GROUPING SETS ((Element), (DataSet), (LabCode), ())""",
    avg_grade=4, std_grade=4,
)
_BY = f"""count(*) AS record_count, count(DISTINCT Hole_ID) AS unique_holes, {_STATS}, stddev_samp({G}) AS std_grade,
 min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon, max(longitude) AS max_lon, avg(elevation) AS avg_elevation
 FROM hole_samples WHERE {VALID}"""
_D = dict(avg_grade=4, std_grade=4, avg_elevation=6)
register("summary_by", lambda t: A.summary_by(t.hole_samples, "Elevation"), f"""SELECT CASE WHEN elevation < 1000 THEN 'Low'
 WHEN elevation < 2000 THEN 'Medium' ELSE 'High' END AS group_field, {_BY} GROUP BY 1""", **_D)
register("summary_by_lab", lambda t: A.summary_by(t.hole_samples, "LabCode", ["Cu", "Zn"]),
         f"SELECT LabCode AS group_field, {_BY} AND Element IN ('Cu', 'Zn') GROUP BY 1", **_D)
register(
    "spatial_extent", lambda t: A.spatial_extent(t.hole_samples),
    """SELECT min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon, max(longitude) AS max_lon,
    count(DISTINCT Hole_ID) AS total_holes, max(latitude) - min(latitude) AS lat_range, max(longitude) - min(longitude) AS lon_range,
    (max(latitude) - min(latitude)) * (max(longitude) - min(longitude)) AS area_degrees
    FROM hole_samples WHERE latitude IS NOT NULL AND longitude IS NOT NULL""",
    lat_range=9, lon_range=9, area_degrees=9,
)
_COORDS = "latitude IS NOT NULL AND longitude IS NOT NULL"
_DEPTHS = "Depth_From IS NOT NULL AND Depth_To IS NOT NULL"
register(
    "quality_metrics", lambda t: A.quality_metrics(t.hole_samples),
    f"""SELECT count(*) AS total_records, count(DISTINCT Hole_ID) AS unique_holes, count(DISTINCT SampleID) AS unique_samples,
    count(DISTINCT Element) AS unique_elements, count(DISTINCT DataSet) AS unique_datasets, count(DISTINCT LabCode) AS unique_labs,
    count(*) AS records_with_coords, count(*) FILTER ({_COORDS}) AS valid_coords, count(elevation) AS elevation_not_null,
    count({G}) AS non_null_grades, count(*) FILTER ({G} > 0) AS positive_grades, count(*) FILTER ({G} <= 0) AS zero_negative_grades,
    count(*) FILTER ({_DEPTHS}) AS depth_complete, count(Interval_Length) AS interval_not_null,
    CAST(count(*) FILTER ({_COORDS}) * 100.0::DOUBLE / count(*) AS DECIMAL(5,2)) AS coord_completeness_pct,
    CAST(count(*) FILTER ({G} > 0) * 100.0::DOUBLE / count(*) AS DECIMAL(5,2)) AS grade_validity_pct,
    CAST(count(*) FILTER ({_DEPTHS}) * 100.0::DOUBLE / count(*) AS DECIMAL(5,2)) AS depth_completeness_pct FROM hole_samples""",
)


def _check(name: str, where: str | None, share: bool = True) -> str:
    part = "CAST(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM hole_samples) AS DECIMAL(5,2))" if share else "CAST(NULL AS DECIMAL(5,2))"
    return f"SELECT '{name}' AS check_type, count(*) AS count_value, {part} AS percentage FROM " + (where or "hole_samples")


_CHECKS = " UNION ALL ".join([
    _check("Total Records", None, False),
    _check("Records with Coordinates", f"hole_samples WHERE {_COORDS}"),
    _check("Valid Grade Values", f"hole_samples WHERE {G} > 0"),
    _check("Complete Records", f"hole_samples WHERE {VALID}"),
    _check("Duplicate Sample_IDs", "(SELECT 1 FROM hole_samples GROUP BY SampleID, Element HAVING count(*) > 1)", False),
    _check("Records with Lab Codes", "hole_samples WHERE LabCode IS NOT NULL"),
])
register("quality_check", lambda t: A.quality_check(t.hole_samples), _CHECKS)
register("quality_union", lambda t: A.quality_union(t.hole_samples), _CHECKS)
register("duplicate_samples", lambda t: A.duplicate_samples(t.hole_samples),
         "SELECT SampleID, Element, count(*) AS duplicates FROM hole_samples GROUP BY ALL HAVING count(*) > 1")
register(
    "lab_summary", lambda t: A.lab_summary(t.hole_samples),
    f"""SELECT LabCode, count(*) AS total_records, count(DISTINCT Element) AS unique_elements, count(DISTINCT Hole_ID) AS unique_holes,
    count(DISTINCT DataSet) AS unique_datasets, {_STATS} FROM hole_samples WHERE {G} > 0 GROUP BY LabCode""",
    avg_grade=4,
)
register(
    "dataset_summary", lambda t: A.dataset_summary(t.hole_samples),
    f"""SELECT DataSet, count(*) AS total_records, count(DISTINCT Element) AS unique_elements, count(DISTINCT Hole_ID) AS unique_holes,
    count(DISTINCT LabCode) AS unique_labs, {_STATS}, avg(Interval_Length) AS avg_interval, min(Depth_From) AS min_depth,
    max(Depth_To) AS max_depth FROM hole_samples WHERE {G} > 0 GROUP BY DataSet""",
    avg_grade=4, avg_interval=6,
)
register(
    "depth_statistics", lambda t: A.depth_statistics(t.hole_samples),
    """SELECT count(*) AS total_records, avg(Depth_From) AS avg_depth_from, avg(Depth_To) AS avg_depth_to,
    avg(Interval_Length) AS avg_interval, min(Depth_From) AS min_depth, max(Depth_To) AS max_depth,
    stddev_samp(Interval_Length) AS std_interval, count(*) FILTER (Interval_Length > 5) AS long_intervals,
    count(*) FILTER (Interval_Length < 1) AS short_intervals FROM hole_samples
    WHERE Depth_From IS NOT NULL AND Depth_To IS NOT NULL AND Interval_Length IS NOT NULL""",
    avg_depth_from=6, avg_depth_to=6, avg_interval=6, std_interval=6,
)
_PCT = "* 100.0::DOUBLE / count(*)"
COORD_SQL = f"""SELECT count(*) AS total_records, count(LL_Lat) {_PCT} AS lat_completeness, count(LL_Long) {_PCT} AS long_completeness,
 count(*) FILTER (LL_Lat IS NOT NULL AND LL_Long IS NOT NULL) {_PCT} AS coord_completeness, count(Elevation) {_PCT} AS elevation_completeness FROM collars"""
GRADE_SQL = f"""SELECT count(*) AS total_records, count(weighted_grade) {_PCT} AS grade_completeness,
 count(*) FILTER (weighted_grade > 0) AS positive_grades, count(*) FILTER (weighted_grade = 0) AS zero_grades,
 count(*) FILTER (weighted_grade < 0) AS negative_grades, avg(weighted_grade) AS avg_grade, min(weighted_grade) AS min_grade,
 max(weighted_grade) AS max_grade FROM hole_grades WHERE weighted_grade IS NOT NULL"""
DEPTH_SQL = f"""SELECT count(*) AS total_records, count(*) FILTER (From_m IS NOT NULL AND To_m IS NOT NULL) {_PCT} AS depth_completeness,
 count(*) FILTER (From_m >= To_m) AS invalid_depth_order, count(*) FILTER (abs(Interval_m - (To_m - From_m)) > 0.01) AS interval_mismatch,
 avg(To_m - From_m) AS avg_interval, min(From_m) AS min_from_depth, max(To_m) AS max_to_depth
 FROM hole_grades WHERE From_m IS NOT NULL AND To_m IS NOT NULL"""
DIST_SQL = """SELECT Element, count(*) AS record_count, count(DISTINCT Hole_ID) AS unique_holes, avg(weighted_grade) AS avg_grade,
 min(weighted_grade) AS min_grade, max(weighted_grade) AS max_grade FROM hole_grades WHERE weighted_grade > 0 GROUP BY Element"""
register("coord_completeness", lambda t: A.coord_completeness(t.collars), COORD_SQL,
         lat_completeness=6, long_completeness=6, coord_completeness=6, elevation_completeness=6)
register("grade_validity", lambda t: A.grade_validity(t.hole_grades), GRADE_SQL, grade_completeness=6, avg_grade=4, min_grade=4, max_grade=4)
register("depth_consistency", lambda t: A.depth_consistency(t.hole_grades), DEPTH_SQL, depth_completeness=6, avg_interval=6)
register("element_distribution", lambda t: A.element_distribution(t.hole_grades), DIST_SQL, avg_grade=4, min_grade=4, max_grade=4)

_MAXES = ", ".join(f"max({G}) FILTER (Element = '{e}') AS {e}" for e in ELEMENTS)
_IN = "(" + ", ".join(f"'{e}'" for e in ELEMENTS) + ")"
_PIVOT = f"""SELECT b.*, m.* EXCLUDE (Hole_ID) FROM (SELECT DISTINCT Hole_ID, latitude, longitude, elevation, DataSet FROM hole_samples
 WHERE {VALID} AND Element IN {_IN}) b JOIN (SELECT Hole_ID, {_MAXES} FROM hole_samples WHERE Element IN {_IN} GROUP BY Hole_ID) m ON b.Hole_ID = m.Hole_ID"""
register("element_pivot", lambda t: A.element_pivot(t.hole_samples, ELEMENTS), _PIVOT)
register(
    "pivot_base_join",
    lambda t: t.hole_samples.select("SampleID", "Hole_ID", "Element", GRADE).join(
        t.collars.select("Hole_ID", "LL_Lat", "LL_Long").distinct(), "Hole_ID"),
    f"SELECT Hole_ID, SampleID, Element, {G}, LL_Lat, LL_Long FROM hole_samples JOIN (SELECT DISTINCT Hole_ID, LL_Lat, LL_Long FROM collars) USING (Hole_ID)",
)
_RATIOS = ", ".join(f"{a} / ({b} + 1e-8) AS {a}_{b}_ratio" for a, b in combinations(ELEMENTS, 2))
_PRESENT = " + ".join(f"CAST({e} IS NOT NULL AS BIGINT)" for e in ELEMENTS)
_TOTAL = " + ".join(f"coalesce({e}, 0)" for e in ELEMENTS)
_RD = {f"{a}_{b}_ratio": 6 for a, b in combinations(ELEMENTS, 2)}
register(
    "pivot_ratios", lambda t: A.pivot_ratios(t.hole_samples, ELEMENTS),
    f"SELECT *, {_RATIOS}, {_TOTAL} AS total_grade, {_PRESENT} AS grade_diversity FROM ({_PIVOT})",
    total_grade=4, **_RD,
)
_TWO = ELEMENTS[:3]
_MEANS = ", ".join(f"coalesce(avg({G}) FILTER (Element = '{e}'), 0) AS {e}" for e in _TWO)
register(
    "pivot_mean_features", lambda t: A.pivot_mean_features(t.hole_samples, _TWO),
    f"""SELECT *, {', '.join(f'{a} / ({b} + 1e-8) AS {a}_{b}_ratio, {a} + {b} AS {a}_{b}_sum' for a, b in combinations(_TWO, 2))},
    {' + '.join(_TWO)} AS total_concentration, {' + '.join(f'CAST({e} > 0 AS BIGINT)' for e in _TWO)} AS element_diversity
    FROM (SELECT Hole_ID, latitude, longitude, {_MEANS} FROM hole_samples WHERE {_COORDS} AND Element IN ('Cu', 'Au', 'Zn') GROUP BY ALL)""",
    **{e: 4 for e in _TWO}, **{f"{a}_{b}_ratio": 5 for a, b in combinations(_TWO, 2)},
    **{f"{a}_{b}_sum": 3 for a, b in combinations(_TWO, 2)}, total_concentration=3,
)


def _level(name: str, key: str) -> str:
    return f"""SELECT '{name}' AS level, {key} AS key, avg({G}) AS mean, stddev_samp({G}) AS std, min({G}) AS min, max({G}) AS max,
    count({G}) AS count FROM hole_samples WHERE {TRAINING} GROUP BY {key}"""


register(
    "group_stats", lambda t: A.group_stats_long(R.training_rows(t.hole_samples)),
    " UNION ALL ".join([_level("sample", "SampleID"), _level("hole", "Hole_ID"), _level("element", "Element"), _level("dataset", "DataSet")]),
    mean=4, std=4,
)


def _over(prefix: str, key: str, full: bool) -> str:
    w = f"OVER (PARTITION BY {key})"
    extra = f", min({G}) {w} AS {prefix}_min, max({G}) {w} AS {prefix}_max" if full else ""
    return f"avg({G}) {w} AS {prefix}_mean, stddev_samp({G}) {w} AS {prefix}_std{extra}, count({G}) {w} AS {prefix}_count"


GROUPS = [("sample", "SampleID", True), ("hole", "Hole_ID", True), ("element", "Element", False), ("dataset", "DataSet", False)]
GROUP_SQL = ", ".join(_over(*g) for g in GROUPS)
GROUP_DIGITS = {f"{p}_{s}": 4 for p, _, _ in GROUPS for s in ("mean", "std")}
register(
    "group_stats_join",
    lambda t: A.group_stats_join(R.training_rows(t.hole_samples).select("SampleID", "Hole_ID", "Element", "DataSet", "Depth_From", GRADE)),
    f"SELECT SampleID, Hole_ID, Element, DataSet, Depth_From, {G}, {GROUP_SQL} FROM hole_samples WHERE {TRAINING}",
    **GROUP_DIGITS,
)
register(
    "prediction_stats", lambda t: A.prediction_stats(t.scored, "y_pred", ["Element"]),
    """SELECT Element, count(y_pred) AS count, min(y_pred) AS min, max(y_pred) AS max, avg(y_pred) AS mean,
    stddev_pop(y_pred) AS std, median(y_pred) AS median FROM scored GROUP BY Element""",
    min=4, max=4, mean=4, std=4, median=4,
)
_Q = ", ".join(f"quantile_cont({G}, {p / 100}) AS p{p}" for p in (50, 75, 90, 95))
register(
    "test_distribution", lambda t: A.test_distribution(R.training_rows(t.hole_samples, ["Cu"])),
    f"""SELECT count(*) AS samples, min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon, max(longitude) AS max_lon,
    min(Depth_From) AS min_depth, max(Depth_To) AS max_depth, {_STATS}, stddev_samp({G}) AS std_grade, {_Q}
    FROM hole_samples WHERE {TRAINING} AND Element = 'Cu'""",
    avg_grade=4, std_grade=4, p50=4, p75=4, p90=4, p95=4,
)

# the other kinds of the dispatch, each like the query it leads to
for _kind, _key, _options in (
    ("summary", "summary_by", {"group_by": "Elevation"}), ("quality", "quality_check", {}), ("multi_element", "element_pivot", {}),
    ("spatial", "spatial_query_km", {"lat": CENTER[0], "lon": CENTER[1], "radius_km": 3.0, "elements": ["Cu", "Au"]}),
):
    register(
        f"query_by_type_{_kind}", lambda t, k=_kind, o=_options: R.query_by_type(t.hole_samples, k, **o), CATALOG[_key].sql, **CATALOG[_key].digits)
