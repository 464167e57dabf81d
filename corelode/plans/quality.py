"""Registered validation and preprocessing."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from corelode.functions import predicates as P
from corelode.functions.predicates import GRADE
from corelode.operators import prep as X
from corelode.operators import rows as R
from corelode.operators import stats as T
from corelode.operators import validate as V
from corelode.plans.depth import OVERLAPS
from corelode.plans.profile import COORD_SQL, DEPTH_SQL, DIST_SQL, GRADE_SQL
from corelode.plans.registry import identity_sql, register
from corelode.plans.rows import COLUMNS, G, TRAINING

NOTHING = "CAST(NULL AS BOOLEAN)"


def _tall(check: str, source: str, lines: list[tuple[str, str, str, str]], extra: str = "") -> str:
    """One SELECT per report line over a one-row source."""
    parts = [
        f"SELECT '{check}' AS \"check\", '{f}' AS field, '{m}' AS metric, CAST({v} AS DOUBLE) AS value, {p} AS passed{extra} FROM one"
        for f, m, v, p in lines]
    return f"WITH one AS ({source}) " + " UNION ALL ".join(parts)


def _stats(c: str) -> list[tuple[str, str, str, str]]:
    return [
        (c, "count", f"{c}_n", NOTHING), (c, "null_count", f"n - {c}_n", NOTHING), (c, "null_percent", f"(n - {c}_n) * 100.0::DOUBLE / n", NOTHING),
        (c, "min", f"{c}_min", NOTHING), (c, "max", f"{c}_max", NOTHING), (c, "mean", f"{c}_mean", NOTHING), (c, "std", f"{c}_std", NOTHING)]


def _source(columns: list[str], more: str = "") -> str:
    stats = ", ".join(f"count({c}) AS {c}_n, min({c}) AS {c}_min, max({c}) AS {c}_max, avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std" for c in columns)
    return f"SELECT count(*) AS n, {stats}{more} FROM hole_samples"


def _out(c: str, low: int, high: int) -> str:
    return f", count(*) FILTER ({c} < {low} OR {c} > {high}) AS {c}_out"


COORDINATES = _tall("coordinates", _source(["latitude", "longitude"], _out("latitude", -90, 90) + _out("longitude", -180, 180)), [
    line for c in ("latitude", "longitude") for line in [*_stats(c), (c, "out_of_range", f"{c}_out", f"{c}_out = 0")]])
DEPTHS = _tall("depths", _source(
    ["Depth_From", "Depth_To"], _out("Depth_From", 0, 10000) + _out("Depth_To", 0, 10000)
    + ", count(*) FILTER (Depth_From >= Depth_To) AS o, count(*) FILTER (abs(Interval_Length - (Depth_To - Depth_From)) > 0.01) AS mm"), [
    *[line for c in ("Depth_From", "Depth_To") for line in [*_stats(c), (c, "out_of_range", f"{c}_out", f"{c}_out = 0")]],
    ("interval", "from_not_before_to", "o", "o = 0"), ("interval", "length_mismatch", "mm", NOTHING)])
GRADES = _tall("grades", _source(
    [G], f", count(*) FILTER ({G} = 0) AS z, count(*) FILTER ({G} < 0) AS neg, count(*) FILTER ({G} > 1000000) AS ex,"
    f" quantile_cont({G}, 0.5) AS q50, quantile_cont({G}, 0.25) AS q25, quantile_cont({G}, 0.75) AS q75"), [
    *_stats(G), (G, "zero_count", "z", NOTHING), (G, "negative_count", "neg", NOTHING), (G, "extreme_count", "ex", NOTHING),
    (G, "median", "q50", NOTHING), (G, "q25", "q25", NOTHING), (G, "q75", "q75", NOTHING)])
_DUP = "SELECT sum(k - 1) AS d, sum(k) AS n FROM (SELECT count(*) AS k FROM hole_samples GROUP BY Hole_ID, Element, Depth_From, Depth_To)"
DUPLICATES = _tall("duplicates", _DUP, [("interval", "duplicate_count", "d", "d = 0"), ("interval", "duplicate_percent", "d * 100.0::DOUBLE / n", NOTHING)])
OVERLAP = _tall("overlaps", f'''SELECT sum("overlaps") AS n, (SELECT count(DISTINCT Hole_ID) FROM hole_samples) AS h,
 (SELECT count(*) FROM hole_samples) AS r FROM ({OVERLAPS})''', [
    ("interval", "overlap_count", "n", "n = 0"), ("Hole_ID", "unique_holes", "h", NOTHING), ("Hole_ID", "total_records", "r", NOTHING)])
_OUTLIER = f"({G} < q1 - 1.5 * (q3 - q1) OR {G} > q3 + 1.5 * (q3 - q1))"
STATISTICS = _tall("statistics", f"""SELECT count(*) FILTER {_OUTLIER} AS o, count(*) AS n, skewness({G}) AS sk, kurtosis({G}) AS ku, stddev_samp({G}) / avg({G}) AS cv
 FROM hole_samples, (SELECT quantile_cont({G}, 0.25) AS q1, quantile_cont({G}, 0.75) AS q3 FROM hole_samples) WHERE {G} IS NOT NULL""", [
    (G, "outlier_count", "o", NOTHING), (G, "outlier_percent", "o * 100.0::DOUBLE / n", "o * 100.0::DOUBLE / n <= 10"),
    (G, "skewness", "sk", "abs(sk) <= 3"), (G, "kurtosis", "ku", NOTHING), (G, "coefficient_of_variation", "cv", "cv >= 0.1")])


def _mode(c: str) -> str:
    return f"(SELECT {c} FROM (SELECT {c}, count(*) AS k FROM hole_samples WHERE {c} IS NOT NULL GROUP BY {c}) ORDER BY k DESC, {c} LIMIT 1)"


_IDS = ["Hole_ID", "Element", "DataSet"]
_ID_ONE = ", ".join(f"count({c}) AS {c}_n, count(*) FILTER ({c} IS NULL) AS {c}_0, count(*) FILTER ({c} = '') AS {c}_e, count(DISTINCT {c}) AS {c}_u" for c in _IDS)
_ID_LINES = [line for c in _IDS for line in (
    (c, "count", f"{c}_n", NOTHING), (c, "null_count", f"{c}_0", f"{c}_0 = 0"), (c, "empty_count", f"{c}_e", f"{c}_e = 0"))]
_ID_SOURCE = f"SELECT {_ID_ONE} FROM hole_samples"
IDENTIFIERS = _tall("identifiers", _ID_SOURCE, _ID_LINES, ", CAST(NULL AS VARCHAR) AS most_common") + " UNION ALL " + " UNION ALL ".join(
    f"SELECT 'identifiers', '{c}', 'unique_count', CAST({c}_u AS DOUBLE), {NOTHING}, {_mode(c)} FROM one" for c in _IDS)

register("validate_coordinates", lambda t: V.validate_coordinates(t.hole_samples), COORDINATES, value=6)
register("validate_depths", lambda t: V.validate_depths(t.hole_samples), DEPTHS, value=6)
register("validate_grades", lambda t: V.validate_grades(t.hole_samples), GRADES, value=4)
register("validate_identifiers", lambda t: V.validate_identifiers(t.hole_samples), IDENTIFIERS)
register("duplicate_intervals", lambda t: V.duplicate_intervals(t.hole_samples), DUPLICATES, value=6)
register("overlap_check", lambda t: V.overlap_check(t.hole_samples), OVERLAP)
register("statistical_properties", lambda t: V.statistical_properties(t.hole_samples), STATISTICS, value=6)

_REMARK = "metric IN ('null_count', 'zero_count', 'negative_count', 'extreme_count', 'length_mismatch') AND value > 0"
_ID_PLAIN = _tall("identifiers", _ID_SOURCE, _ID_LINES) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT 'identifiers', '{c}', 'unique_count', CAST({c}_u AS DOUBLE), {NOTHING} FROM one" for c in _IDS)
_ALL = " UNION ALL ".join(f"SELECT * FROM ({s})" for s in (COORDINATES, DEPTHS, GRADES, _ID_PLAIN, DUPLICATES, OVERLAP, STATISTICS))
register(
    "validation_report", lambda t: V.validation_report(t.hole_samples),
    f"""WITH lines AS ({_ALL}) SELECT coalesce("check", 'overall') AS "check", count(*) AS lines,
    count(*) FILTER (coalesce(NOT passed, false) OR coalesce({_REMARK}, false)) AS issues,
    CASE WHEN count(*) FILTER (NOT passed AND "check" <> 'statistics') = 0 THEN 'PASSED' ELSE 'FAILED' END AS status
    FROM lines GROUP BY ROLLUP ("check")""".replace("FILTER (NOT passed AND \"check\" <> 'statistics')", "FILTER (NOT passed AND lines.\"check\" <> 'statistics')"),
)
_PERIOD = "CAST(extract(year FROM sampled_at) * 12 + extract(month FROM sampled_at) AS BIGINT)"
HISTORY = f"""WITH k AS (SELECT {_PERIOD} AS period, count(*) AS n, count(*) FILTER (latitude IS NULL OR longitude IS NULL) AS c,
  count(*) FILTER ({G} IS NULL) AS gn, count(*) FILTER ({G} < 0) AS ng, count(*) FILTER ({G} = 0) AS z,
  count(*) FILTER (latitude NOT BETWEEN -90 AND 90 OR longitude NOT BETWEEN -180 AND 180) AS o, count(*) FILTER (Depth_From >= Depth_To) AS w
  FROM hole_samples GROUP BY period, Hole_ID, Element, Depth_From, Depth_To),
 s AS (SELECT period, sum(n) AS rows, sum(n - 1) AS d, sum(c) AS c, sum(gn) AS gn, sum(ng) AS ng, sum(z) AS z, sum(o) AS o, sum(w) AS w FROM k GROUP BY period),
 h AS (SELECT period, CASE WHEN d + o + w > 0 THEN 'FAILED' ELSE 'PASSED' END AS status,
  CAST((d > 0)::INT + (c > 0)::INT + (gn > 0)::INT + (ng > 0)::INT + (z > 0)::INT + (o > 0)::INT + (w > 0)::INT AS BIGINT) AS issues, CAST(rows AS BIGINT) AS rows FROM s)"""


def _history(t):
    month = (F.year("sampled_at") * 12 + F.month("sampled_at")).cast("long")
    return V.period_quality(t.hole_samples, month)


register("quality_history", _history, f"{HISTORY} SELECT * FROM h")
register(
    "quality_trend", lambda t: V.quality_trend(_history(t)),
    f"""{HISTORY} SELECT count(*) AS total_checks, avg(CASE WHEN status = 'PASSED' THEN 1.0::DOUBLE ELSE 0 END) AS pass_rate, avg(issues) AS avg_issues,
    arg_max(status, period) AS latest_status FROM h""",
    pass_rate=6, avg_issues=6,
)
register(
    "validate_samples", lambda t: V.validate_samples(t.hole_samples),
    f"""SELECT count(*) AS total_samples, count(*) FILTER ({G} < 0) AS negative_grades,
    count(*) FILTER (Depth_From < 0) + count(*) FILTER (Depth_To < 0) AS negative_depths,
    count(*) FILTER (latitude NOT BETWEEN -90 AND 90) + count(*) FILTER (longitude NOT BETWEEN -180 AND 180) AS invalid_coordinates,
    count(*) - count(DISTINCT SampleID) AS duplicate_samples, '' AS empty_columns, count(*) FILTER ({G} < 0) = 0 AS is_valid FROM hole_samples""",
)


def _section(name: str, sql: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS section, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM ({sql})" for c in columns)


_CONSISTENCY = """SELECT count(DISTINCT g.Hole_ID) AS total_holes_in_grades, count(DISTINCT c.Hole_ID) AS total_holes_in_coords,
 count(DISTINCT g.Hole_ID) - count(DISTINCT c.Hole_ID) AS missing_coords, count(DISTINCT c.Hole_ID) * 100.0::DOUBLE / count(DISTINCT g.Hole_ID) AS consistency_percentage
 FROM hole_grades g LEFT JOIN collars c ON g.Hole_ID = c.Hole_ID"""
register(
    "integrity_report", lambda t: V.integrity_report(t.hole_grades, t.collars),
    " UNION ALL ".join([
        _section("hole_consistency", _CONSISTENCY, ["total_holes_in_grades", "total_holes_in_coords", "missing_coords", "consistency_percentage"]),
        _section("coord_completeness", COORD_SQL, ["total_records", "lat_completeness", "long_completeness", "coord_completeness", "elevation_completeness"]),
        _section("grade_validity", GRADE_SQL, ["total_records", "grade_completeness", "positive_grades", "zero_grades", "negative_grades", "avg_grade", "min_grade", "max_grade"]),
        _section("depth_consistency", DEPTH_SQL, ["total_records", "depth_completeness", "invalid_depth_order", "interval_mismatch", "avg_interval", "min_from_depth", "max_to_depth"]),
        _section("element_distribution", f"SELECT count(*) AS element_count, sum(record_count) AS records FROM ({DIST_SQL})", ["element_count", "records"])]),
    value=4,
)


def _frame(t):
    return t.hole_samples.drop("sampled_at")


_NUM = [G, "Depth_From", "Depth_To", "Interval_Length", "latitude", "longitude", "elevation"]
_TXT = ["SampleID", "Hole_ID", "DataSet", "Element", "LabCode"]


def _profile_number(c: str) -> str:
    return f"""SELECT '{c}' AS field, 'double' AS type, count(*) - count({c}) AS missing_count, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_percent,
    avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, median({c}) AS median, skewness({c}) AS skewness, kurtosis({c}) AS kurtosis,
    CAST(NULL AS BIGINT) AS unique_count, CAST(NULL AS VARCHAR) AS most_common, CAST(NULL AS BIGINT) AS most_common_count FROM hole_samples"""


def _profile_text(c: str) -> str:
    nulls = ", ".join(["CAST(NULL AS DOUBLE)"] * 7)
    return f"""SELECT '{c}', 'string', count(*) - count({c}), round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2), {nulls},
    count(DISTINCT {c}), {_mode(c)}, (SELECT max(k) FROM (SELECT count(*) AS k FROM hole_samples WHERE {c} IS NOT NULL GROUP BY {c})) FROM hole_samples"""


register(
    "profile", lambda t: V.profile(_frame(t)),
    " UNION ALL ".join([*map(_profile_number, _NUM), *map(_profile_text, _TXT)]),
    mean=4, std=4, median=4, skewness=5, kurtosis=5,
)
register(
    "duplicate_rows", lambda t: V.duplicate_rows(_frame(t).select("Hole_ID", "Element", "Depth_From", "DataSet")),
    "SELECT CAST(sum(k - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS k FROM hole_samples GROUP BY Hole_ID, Element, Depth_From, DataSet)",
)

# preprocessing
_KEY = ["SampleID", "Element"]
_FILL = [G, "Depth_From"]


def _pick(t, *columns):
    return t.hole_samples.select(*_KEY, "Depth_To", *columns)


register(
    "impute",
    lambda t: X.impute(_pick(t, *_FILL, "LabCode"), X.fit_impute(_pick(t, *_FILL, "LabCode"), "median", _FILL, ["LabCode"])),
    f"""SELECT SampleID, Element, Depth_To, coalesce({G}, (SELECT median({G}) FROM hole_samples)) AS {G},
    coalesce(Depth_From, (SELECT median(Depth_From) FROM hole_samples)) AS Depth_From, coalesce(LabCode, {_mode('LabCode')}) AS LabCode FROM hole_samples""",
    standardized_grade_ppm=4,
)
register(
    "impute_mean",
    lambda t: X.impute(_pick(t, *_FILL), X.fit_impute(_pick(t, *_FILL), "mean", _FILL, [])),
    f"""SELECT SampleID, Element, Depth_To, coalesce({G}, (SELECT avg({G}) FROM hole_samples)) AS {G},
    coalesce(Depth_From, (SELECT avg(Depth_From) FROM hole_samples)) AS Depth_From FROM hole_samples""",
    standardized_grade_ppm=4, Depth_From=6,
)
register(
    "impute_mode",
    lambda t: X.impute(_pick(t, *_FILL), X.fit_impute(_pick(t, *_FILL), "mode", _FILL, [])),
    f"""SELECT SampleID, Element, Depth_To, coalesce({G}, {_mode(G)}) AS {G}, coalesce(Depth_From, {_mode('Depth_From')}) AS Depth_From FROM hole_samples""",
)
_OUT = [G, "Interval_Length"]
_B = {c: f"(SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM s)" for c in _OUT}
# half of the range, so that the fixture has outliers
_SRC = f"s AS (SELECT SampleID, Element, Depth_To, {G} * {G} / 1e4 AS {G}, Interval_Length FROM hole_samples)"


def _heavy(t):
    return _pick(t, "Interval_Length", GRADE).withColumn(GRADE, F.col(GRADE) * F.col(GRADE) / 1e4)


_FROM = f"FROM s, {_B[G]} a, {_B['Interval_Length']} b"
_FLAG_G, _FLAG_I = f"coalesce({G} < a.lo OR {G} > a.hi, false)", "coalesce(Interval_Length < b.lo OR Interval_Length > b.hi, false)"
register(
    "outliers_iqr", lambda t: X.flag_iqr(_heavy(t), X.fit_iqr(_heavy(t), _OUT), _OUT),
    f"WITH {_SRC} SELECT SampleID, Element, Depth_To, Interval_Length, {G}, {_FLAG_G} AS {G}_outlier, {_FLAG_I} AS Interval_Length_outlier {_FROM}",
    standardized_grade_ppm=4,
)
register(
    "cap_outliers", lambda t: X.cap_outliers(_heavy(t), X.fit_iqr(_heavy(t), _OUT), _OUT),
    f"""WITH {_SRC} SELECT SampleID, Element, Depth_To, CASE WHEN {G} IS NOT NULL THEN least(greatest({G}, a.lo), a.hi) END AS {G},
    least(greatest(Interval_Length, b.lo), b.hi) AS Interval_Length {_FROM}""",
    standardized_grade_ppm=4,
)
register(
    "remove_outliers", lambda t: X.remove_outliers(_heavy(t), X.fit_iqr(_heavy(t), _OUT), _OUT),
    f"WITH {_SRC} SELECT SampleID, Element, Depth_To, Interval_Length, {G} {_FROM} WHERE NOT {_FLAG_G} AND NOT {_FLAG_I}",
    standardized_grade_ppm=4,
)
register(
    "outliers_zscore", lambda t: X.outliers_zscore(_pick(t, GRADE), GRADE, 1.5),
    f"""WITH m AS (SELECT avg({G}) AS m, stddev_pop({G}) AS s FROM hole_samples) SELECT SampleID, Element, Depth_To, {G}, abs({G} - m) / nullif(s, 0) AS z_score,
    coalesce(abs({G} - m) / nullif(s, 0) > 1.5, false) AS is_outlier FROM hole_samples, m""",
    z_score=7,
)
register(
    "outliers_modified_z", lambda t: X.outliers_modified_z(_pick(t, GRADE), GRADE, 1.0),
    f"""WITH m AS (SELECT median({G}) AS m FROM hole_samples), d AS (SELECT median(abs({G} - m)) AS d FROM hole_samples, m)
    SELECT SampleID, Element, Depth_To, {G}, 0.6745 * ({G} - m) / nullif(d, 0) AS modified_z,
    coalesce(abs(0.6745 * ({G} - m) / nullif(d, 0)) > 1.0, false) AS is_outlier FROM hole_samples, m, d""",
    modified_z=7,
)
register(
    "transform_skew", lambda t: X.transform_skew(_pick(t, GRADE, "Interval_Length", "elevation"), [GRADE, "Interval_Length", "elevation"]),
    f"""SELECT SampleID, Element, Depth_To, {G}, Interval_Length, elevation, ln(1 + Interval_Length) AS Interval_Length_log, sqrt(Interval_Length) AS Interval_Length_sqrt,
    ln(1 + elevation) AS elevation_log, sqrt(elevation) AS elevation_sqrt FROM hole_samples""",
    Interval_Length_log=7, Interval_Length_sqrt=7, elevation_log=7, elevation_sqrt=7,
)
_SCALED = [G, "Depth_From"]


def _scaled_sql(shift: str, width: str) -> str:
    parts = ", ".join(f"({c} - (SELECT {shift.format(c=c)} FROM hole_samples)) / (SELECT {width.format(c=c)} FROM hole_samples) AS {c}" for c in _SCALED)
    return f"SELECT SampleID, Element, Depth_To, {parts} FROM hole_samples"


for _method, _shift, _width in (
    ("standard", "avg({c})", "stddev_pop({c})"), ("robust", "median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
    ("minmax", "min({c})", "max({c}) - min({c})")):
    register(
        "scale" if _method == "standard" else f"scale_{_method}",
        lambda t, m=_method: X.scale(_pick(t, *_SCALED), X.fit_scale(_pick(t, *_SCALED), _SCALED, m), _SCALED),
        _scaled_sql(_shift, _width), standardized_grade_ppm=7, Depth_From=7,
    )
_CORR = [G, "Depth_From", "Depth_To", "Interval_Length", "elevation"]
register(
    "correlation_matrix", lambda t: X.correlation_matrix(t.hole_samples, _CORR),
    " UNION ALL ".join([
        *[f"SELECT '{a}' AS a, '{a}' AS b, 1.0::DOUBLE AS r" for a in _CORR],
        *[f"SELECT '{x}', '{y}', corr({a}, {b}) FROM hole_samples" for a, b in combinations(_CORR, 2) for x, y in ((a, b), (b, a))]]),
    r=7,
)


def _matrix(t):
    rows = R.training_rows(t.hole_samples).select("SampleID", *_CORR, "mid_depth", "grade_tonnage")
    return rows.withColumn("flat", F.lit(1.0))


_MID, _TONNAGE = "(Depth_From + Depth_To) / 2 AS mid_depth", f"{G} * Interval_Length AS grade_tonnage"
# the fixture's flat column goes, and of its depths, which move together, all but Depth_To
register(
    "drop_low_variance", lambda t: X.drop_low_variance(_matrix(t)),
    f"SELECT SampleID, {', '.join(_CORR)}, {_MID}, {_TONNAGE} FROM hole_samples WHERE {TRAINING}", mid_depth=3, grade_tonnage=3)
register(
    "drop_correlated", lambda t: X.drop_correlated(_matrix(t)),
    f"SELECT SampleID, {G}, Depth_To, Interval_Length, elevation, {_TONNAGE}, 1.0::DOUBLE AS flat FROM hole_samples WHERE {TRAINING}", grade_tonnage=3)
register("preprocess_pipeline", lambda t: X.preprocess(_matrix(t), [*_CORR, "mid_depth", "grade_tonnage", "flat"]))
_SPLIT_AT = "TIMESTAMP '1999-01-01'"


def _drift(t):
    columns = [GRADE, "Depth_From", "Interval_Length"]
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns]))
    side = F.when(F.col("sampled_at") < F.lit("1999-01-01"), "old").otherwise("new")
    return T.ks_statistics(t.hole_samples.select(side.alias("side"), cells), "side", "old", "new", "value", ["field"])


def _ks_sql(field: str, source: str, value: str, first: str, keys: str = "", where: str = "TRUE") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    select = f"{keys}, " if keys else ""
    return f"""WITH v AS (SELECT {select}{value} AS v, count(*) FILTER ({first}) AS a, count(*) FILTER (NOT ({first})) AS b FROM {source} WHERE {value} IS NOT NULL AND {where} GROUP BY ALL),
    c AS (SELECT *, sum(a) OVER ({part} ORDER BY v) AS ca, sum(b) OVER ({part} ORDER BY v) AS cb, sum(a) OVER ({part}) AS n1, sum(b) OVER ({part}) AS n2 FROM v),
    k AS (SELECT {select}CAST(max(n1) AS BIGINT) AS n1, CAST(max(n2) AS BIGINT) AS n2, max(abs(ca / n1 - cb / n2)) AS ks_statistic FROM c {'GROUP BY ' + keys if keys else ''}),
    x AS (SELECT *, ks_statistic * sqrt(n1::DOUBLE * n2 / (n1 + n2)) AS x FROM k),
    p AS (SELECT * EXCLUDE x, CASE WHEN x < 0.2 THEN 1.0::DOUBLE ELSE greatest(0.0, least(1.0, list_sum([CASE j % 2 WHEN 1 THEN 2.0 ELSE -2.0 END * exp(-2.0::DOUBLE * j * j * x * x) FOR j IN range(1, 101)]))) END AS p_value FROM x)
    SELECT *, p_value < 0.05 AS distributions_different FROM p"""


register(
    "drift_ks", _drift,
    " UNION ALL ".join(f"SELECT '{c}' AS field, * FROM ({_ks_sql('', 'hole_samples', c, f'sampled_at < {_SPLIT_AT}')})" for c in (G, "Depth_From", "Interval_Length")),
    ks_statistic=9, p_value=7,
)
register(
    "label_encode", lambda t: X.label_encode(t.hole_samples.select("SampleID", *X_CODED), X_CODED),
    """SELECT SampleID, Element, DataSet, LabCode, dense_rank() OVER (ORDER BY Element) - 1 AS element_encoded,
    dense_rank() OVER (ORDER BY DataSet) - 1 AS dataset_encoded,
    CASE WHEN LabCode IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY LabCode NULLS LAST) - 1 END AS labcode_encoded FROM hole_samples""",
)
X_CODED = ["Element", "DataSet", "LabCode"]
register(
    "category_codes",
    lambda t: R.training_rows(t.hole_samples).select("SampleID", "Element", "grade_category", GRADE)
    .withColumn("grade_category_code", X.category_codes("grade_category", ["low", "medium", "high"])),
    f"""SELECT SampleID, Element, {G}, CASE WHEN {G} > 1000 THEN 'high' WHEN {G} > 500 THEN 'medium' ELSE 'low' END AS grade_category,
    CAST(CASE WHEN {G} > 1000 THEN 2 WHEN {G} > 500 THEN 1 ELSE 0 END AS BIGINT) AS grade_category_code FROM hole_samples WHERE {TRAINING}""",
)
_ROW_ID = ["SampleID", "Element", "Depth_To", GRADE]
_AT = f"{identity_sql(42, ['SampleID', 'Element'], ['Depth_To', G])} % 10000"
register(
    "split", lambda t: X.split_sizes(X.split(R.training_rows(t.hole_samples), _ROW_ID)),
    f"""WITH p AS (SELECT Element, {_AT} AS h FROM hole_samples WHERE {TRAINING}) SELECT Element, count(*) AS total, count(*) FILTER (h >= 3600) AS train,
    count(*) FILTER (h >= 2000 AND h < 3600) AS validation, count(*) FILTER (h < 2000) AS test FROM p GROUP BY Element""",
)
register(
    "split_stability", lambda t: X.split_stability(R.training_rows(t.hole_samples), _ROW_ID),
    f"""WITH p AS (SELECT * FROM hole_samples WHERE {TRAINING} AND {_AT} < 2000)
    SELECT (SELECT count(*) FROM (SELECT SampleID, Element, Depth_To, {G} FROM p EXCEPT ALL SELECT SampleID, Element, Depth_To, {G} FROM p)) AS different_rows,
    count(*) > 0 AS stable FROM p""",
)


def _isolated(t):
    from corelode.operators.isolation import isolation_forest

    rows = R.training_rows(t.hole_samples).select(*_ROW_ID, "Depth_From")
    return isolation_forest(rows, [GRADE, "Depth_From"], _ROW_ID)


register("outliers_isolation_forest", _isolated)


def _relations(t):
    return {"hole_samples": t.hole_samples, "collars": t.collars, "hole_grades": t.hole_grades}


_TYPES = {
    "hole_samples": {
        "SampleID": "string", "Hole_ID": "string", "DataSet": "string", "Element": "string", G: "double", "Depth_From": "double", "Depth_To": "double",
        "Interval_Length": "double", "latitude": "double", "longitude": "double", "elevation": "double", "LabCode": "string", "sampled_at": "timestamp_ntz"},
    "collars": {"Hole_ID": "string", "LL_Lat": "double", "LL_Long": "double", "Elevation": "double"},
    "hole_grades": {
        "Hole_ID": "string", "Element": "string", "DataSet": "string", "weighted_grade": "double", "From_m": "double", "To_m": "double", "Interval_m": "double"},
}
register(
    "schema_info", lambda t: V.schema_info(t.spark, _relations(t)).drop("nullable"),
    " UNION ALL ".join(
        f"SELECT '{r}' AS relation, CAST({i} AS INTEGER) AS position, '{c}' AS column, '{kind}' AS type, count({c}) AS values FROM {r}"
        for r, columns in _TYPES.items() for i, (c, kind) in enumerate(columns.items(), 1)),
)


def _validated(t):
    """The relations, one of them without two of its columns, against the required ones and their rows."""
    relations = _relations(t) | {"collars": t.collars.drop("Elevation", "LL_Lat")}
    rows = None
    for name, df in relations.items():
        one = df.agg(F.lit(name).alias("relation"), F.count("*").alias("rows"))
        rows = one if rows is None else rows.unionByName(one)
    return V.schema_validation(t.spark, relations).join(rows, "relation", "left")


register(
    "schema_validation", _validated,
    """SELECT 'hole_samples' AS relation, TRUE AS present, CAST(12 AS INTEGER) AS required, '' AS missing, TRUE AS valid, count(*) AS rows FROM hole_samples
    UNION ALL SELECT 'hole_grades', TRUE, 7, '', TRUE, count(*) FROM hole_grades UNION ALL SELECT 'collars', TRUE, 4, 'LL_Lat,Elevation', FALSE, count(*) FROM collars
    UNION ALL SELECT 'overall', TRUE, 23, '', FALSE, NULL""",
)
register(
    "missing_columns",
    lambda t: t.collars.agg(
        F.array_join(F.array(*[F.lit(c) for c in R.missing_columns(t.collars, ["Hole_ID", "LL_Lat", "rock_density", "Azimuth"])]), ",").alias("missing"),
        F.count("*").alias("rows")),
    "SELECT 'rock_density,Azimuth' AS missing, count(*) AS rows FROM collars",
)
