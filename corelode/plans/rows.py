"""Registered selections, predicates, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corelode.functions import predicates as P
from corelode.functions import scalars as S
from corelode.functions.predicates import GRADE, FilterSpec
from corelode.operators import profile as A
from corelode.operators import rows as R
from corelode.operators.ordered import join_on
from corelode.plans.registry import identity_sql, register
from corelode.schema import CUTOFFS, ECONOMIC_LIMITS, ELEMENTS, HEAT_DEFAULT, HEAT_MAXIMUM, QUESTION_ORDER

G = "standardized_grade_ppm"
VALID = f"latitude IS NOT NULL AND longitude IS NOT NULL AND {G} > 0"
LOCATED = "latitude IS NOT NULL AND longitude IS NOT NULL AND Depth_From IS NOT NULL AND Depth_To IS NOT NULL AND Interval_Length > 0"
TRAINING = f"{LOCATED} AND {G} > 0"
COLUMNS = f"SampleID, Hole_ID, Element, DataSet, {G}, Depth_From, Depth_To, Interval_Length, latitude, longitude, elevation, LabCode"
# area and centre used by the spatial selections
CENTER = (-15.19, -71.84)
BOUNDS = (-15.22, -15.16, -71.87, -71.83)

register("scan_samples", lambda t: R.scan_samples(t.hole_samples), f"SELECT {COLUMNS} FROM hole_samples")
register(
    "table_preview", lambda t: R.table_preview("hole_samples", t.hole_samples.drop("sampled_at")),
    f"SELECT {COLUMNS} FROM hole_samples ORDER BY SampleID, Element, {G} NULLS FIRST LIMIT 5",
)
DRILLING = f"""SELECT Hole_ID, Element, DataSet, {G}, latitude, longitude, elevation, Depth_From AS depth_from,
 Depth_To AS depth_to, Interval_Length AS interval_length, SampleID, LabCode FROM hole_samples WHERE {VALID}"""
register(
    "drilling_query", lambda t: R.drilling_query(t.hole_samples, ["CU", "Zn"]),
    f"{DRILLING} AND Element IN ('Cu', 'Zn')",
)
register(
    "filter_spec",
    lambda t: R.drilling_query(t.hole_samples, None, [
        FilterSpec(GRADE, ">=", 1000.0), FilterSpec("Element", "IN", ["Au", "Fe"]),
        FilterSpec("Depth_From", "BETWEEN", (20.0, 120.0)), FilterSpec("DataSet", "LIKE", "%_BF"),
        FilterSpec("elevation", "<", 2500.0),
    ]),
    f"""{DRILLING} AND {G} >= 1000 AND Element IN ('Au', 'Fe') AND Depth_From BETWEEN 20 AND 120
    AND DataSet LIKE '%_BF' AND elevation < 2500""",
)
register(
    "filter_helpers",
    lambda t: R.scan_samples(t.hole_samples.filter(P.all_of([
        P.grade_range(500.0, 60000.0), P.elevation_range(None, 2800.0), P.of_datasets(["Drilling_INF", "Drilling_OP"]),
        P.of_labs(["LAB1", "LAB3"]), P.depth_range(10.0, 180.0), P.grade_range(),
    ]))),
    f"""SELECT {COLUMNS} FROM hole_samples WHERE {G} BETWEEN 500 AND 60000 AND elevation <= 2800
    AND DataSet IN ('Drilling_INF', 'Drilling_OP') AND LabCode IN ('LAB1', 'LAB3') AND Depth_From >= 10 AND Depth_To <= 180""",
)
register("query_by_type", lambda t: R.query_by_type(t.hole_samples, "drilling", elements=["Cu"]), f"{DRILLING} AND Element = 'Cu'")
register(
    "drilling_by_element", lambda t: R.drilling_by_element(t.hole_samples, "cu", "Drilling_BF"),
    f"SELECT {COLUMNS} FROM hole_samples WHERE Element = 'Cu' AND DataSet = 'Drilling_BF' AND {G} > 0",
)
register(
    "multi_element_rows", lambda t: R.multi_element_rows(t.hole_samples, ["Cu", "Au"], ["Drilling_BF", "Drilling_INF"]),
    f"""SELECT {COLUMNS}, (Depth_From + Depth_To) / 2 AS mid_depth FROM hole_samples
    WHERE Element IN ('Cu', 'Au') AND DataSet IN ('Drilling_BF', 'Drilling_INF') AND {G} > 0""",
)
register(
    "by_lab_code", lambda t: R.by_lab_code(t.hole_samples, "LAB2", ["Cu", "Pb"]),
    f"SELECT {COLUMNS} FROM hole_samples WHERE LabCode = 'LAB2' AND Element IN ('Cu', 'Pb') AND {G} > 0",
)
LEVEL = f"CASE WHEN {G} > 1000 THEN 'high' WHEN {G} > 500 THEN 'medium' ELSE 'low' END"
register(
    "training_rows", lambda t: R.training_rows(t.hole_samples),
    f"""SELECT {COLUMNS}, (Depth_From + Depth_To) / 2 AS mid_depth, {G} * Interval_Length AS grade_tonnage,
    {LEVEL} AS grade_category FROM hole_samples WHERE {TRAINING}""",
    grade_tonnage=3,
)
register(
    "prediction_rows",
    lambda t: R.prediction_rows(t.hole_samples, ["Cu", "Ag", "Fe"], None, BOUNDS, (5.0, 190.0)),
    f"""SELECT {COLUMNS.replace(G + ', ', '')}, (Depth_From + Depth_To) / 2 AS mid_depth FROM hole_samples
    WHERE {LOCATED} AND Element IN ('Cu', 'Ag', 'Fe') AND latitude BETWEEN {BOUNDS[0]}::DOUBLE AND {BOUNDS[1]}::DOUBLE
    AND longitude BETWEEN {BOUNDS[2]}::DOUBLE AND {BOUNDS[3]}::DOUBLE AND Depth_From >= 5 AND Depth_To <= 190""",
)
register(
    "rows_in_bounds", lambda t: R.rows_in_bounds(t.hole_samples, *BOUNDS, ELEMENTS),
    f"""SELECT {COLUMNS.replace('Interval_Length, ', '')} FROM hole_samples
    WHERE {G} > 0 AND latitude BETWEEN {BOUNDS[0]}::DOUBLE AND {BOUNDS[1]}::DOUBLE
    AND longitude BETWEEN {BOUNDS[2]}::DOUBLE AND {BOUNDS[3]}::DOUBLE""",
)
_DLAT, _DLON = f"(latitude - ({CENTER[0]}::DOUBLE))", f"(longitude - ({CENTER[1]}::DOUBLE))"
_DEG = f"sqrt({_DLAT} * {_DLAT} + {_DLON} * {_DLON})"
register(
    "spatial_context", lambda t: R.spatial_context(t.hole_samples, *CENTER, radius_km=4.0),
    f"""SELECT {COLUMNS}, (Depth_From + Depth_To) / 2 AS mid_depth, {_DEG} AS distance_from_center
    FROM hole_samples WHERE {G} > 0 AND {_DEG} <= 4.0::DOUBLE / 111.0::DOUBLE""",
    distance_from_center=9,
)
register(
    "spatial_query_km", lambda t: R.spatial_query_km(t.hole_samples, *CENTER, radius_km=3.0, elements=["Cu", "Au"]),
    f"""SELECT Hole_ID, Element, DataSet, {G}, latitude, longitude, elevation,
    sqrt(pow({_DLAT} * 111, 2) + pow({_DLON} * 111 * cos(radians((latitude + {CENTER[0]}::DOUBLE) / 2)), 2)) AS distance_km,
    atan2({_DLAT}, {_DLON}) AS angle_radians
    FROM hole_samples WHERE {VALID} AND Element IN ('Cu', 'Au') AND {_DEG} <= 3.0::DOUBLE / 111.0::DOUBLE""",
    distance_km=7, angle_radians=7,
)
register(
    "apply_cutoff", lambda t: R.cutoff_share(t.hole_samples, "CU", 20000.0),
    f"""SELECT count(*) FILTER ({G} >= 20000) AS above, count(*) AS total,
    avg(CASE WHEN {G} >= 20000 THEN 1.0 ELSE 0.0 END) * 100 AS percent FROM hole_samples WHERE Element = 'Cu'""",
    percent=6,
)
register(
    "metal_content",
    lambda t: t.hole_samples.filter(P.positive_grade()).groupBy("Element").agg(
        F.sum(S.metal_content(F.col(GRADE), F.col("Interval_Length") * 2.7)).alias("metal_tonnes")),
    f"SELECT Element, sum({G} * (Interval_Length * 2.7) * 0.85 / 1e6) AS metal_tonnes FROM hole_samples WHERE {G} > 0 GROUP BY Element",
    metal_tonnes=5,
)


def _limit_sql(at: int) -> str:
    whens = " ".join(f"WHEN '{row[0]}' THEN {row[at]}" for row in ECONOMIC_LIMITS)
    return f"CASE upper(Element) {whens} ELSE {ECONOMIC_LIMITS[0][at]} END"


register(
    "economic_class",
    lambda t: t.hole_samples.filter(P.positive_grade()).select("SampleID", "Element", GRADE)
    .withColumn("economic_class", S.economic_class(F.col("Element"), F.col(GRADE)))
    .withColumn("label", S.economic_label(F.col("economic_class"))),
    f"""WITH c AS (SELECT SampleID, Element, {G}, CASE WHEN {G} >= {_limit_sql(1)} THEN 'high' WHEN {G} >= {_limit_sql(2)} THEN 'medium'
    WHEN {G} >= {_limit_sql(3)} THEN 'low' ELSE 'trace' END AS k FROM hole_samples WHERE {G} > 0)
    SELECT SampleID, Element, {G}, k || '-grade' AS economic_class, upper(k[1]) || k[2:] || ' Grade' AS label FROM c""",
)
_TOP = "CASE Element " + " ".join(f"WHEN '{e}' THEN {v}" for e, v in HEAT_MAXIMUM.items()) + f" ELSE {HEAT_DEFAULT} END"
_POINTS = """SELECT g.Hole_ID, g.Element, g.DataSet, c.LL_Long AS longitude, c.LL_Lat AS latitude, g.weighted_grade AS concentration
 FROM hole_grades g JOIN collars c ON g.Hole_ID = c.Hole_ID WHERE c.LL_Lat IS NOT NULL AND c.LL_Long IS NOT NULL"""
register(
    "heatmap_points", lambda t: R.heatmap_points(t.hole_grades, t.collars, "Cu"),
    f"{_POINTS} AND g.Element = 'Cu'", concentration=5,
)
register(
    "heat_weight",
    lambda t: R.heatmap_points(t.hole_grades, t.collars).withColumn("weight", S.heat_weight(F.col("Element"), F.col("concentration"))),
    f"SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, concentration / {_TOP})) AS weight FROM ({_POINTS})",
    concentration=5, weight=7,
)
_MENTION = "CASE " + " ".join(f"WHEN contains(lower(question), '{e.lower()}') THEN '{e}'" for e in QUESTION_ORDER) + " END"
register(
    "element_mention",
    lambda t: t.questions.withColumn("Element", S.element_mention(F.col("question"))).drop("question"),
    f"SELECT conv_id, turn, {_MENTION} AS Element FROM questions",
)
register("distinct_elements", lambda t: R.distinct_elements(t.hole_samples), f"SELECT DISTINCT Element FROM hole_samples WHERE {G} > 0")
_ERRORS = """[x for x in [
 CASE WHEN latitude NOT BETWEEN -90 AND 90 THEN 'latitude outside -90..90' END,
 CASE WHEN longitude NOT BETWEEN -180 AND 180 THEN 'longitude outside -180..180' END,
 CASE WHEN depth_from NOT BETWEEN 0 AND 1000 THEN 'depth_from outside 0..1000' END,
 CASE WHEN depth_to NOT BETWEEN 0 AND 1000 THEN 'depth_to outside 0..1000' END,
 CASE WHEN depth_from > depth_to THEN 'depth_from after depth_to' END] if x IS NOT NULL]"""
register(
    "validate_requests",
    lambda t: t.requests.select("event_id", F.array_join(S.request_errors(), "; ").alias("errors"),
                                (F.size(S.request_errors()) == 0).alias("valid")),
    f"SELECT event_id, array_to_string({_ERRORS}, '; ') AS errors, len({_ERRORS}) = 0 AS valid FROM requests",
)
_KEY = "md5(printf('%.6f,%.6f,%.2f,%.2f,%s', latitude, longitude, depth_from, depth_to, element))"
register(
    "request_key",
    lambda t: t.requests.select("event_id", S.request_key(*[F.col(c) for c in (
        "latitude", "longitude", "depth_from", "depth_to", "element")]).alias("request_key")),
    f"SELECT event_id, {_KEY} AS request_key FROM requests",
)


def _classes(t):
    """Scored samples by the class of an interval's width, and requests by that of their (moved) place."""
    width = S.interval_confidence(F.col("y_pred") - F.abs(F.col("y_pred") - F.col("y_true")) / 20, F.col("y_pred"))
    region = S.region_confidence(F.col("latitude") - F.col("user_id") % 4 * 5, F.col("longitude") + 25)
    intervals = t.scored.groupBy(F.lit("interval").alias("kind"), width.alias("level")).agg(F.count("*").alias("n"))
    return intervals.unionByName(t.requests.groupBy(F.lit("region").alias("kind"), region.alias("level")).agg(F.count("*").alias("n")))


register(
    "confidence_class", _classes,
    """WITH c AS (SELECT y_pred - (y_pred - abs(y_pred - y_true) / 20) AS width FROM scored),
    r AS (SELECT latitude - user_id % 4 * 5 AS a, longitude + 25 AS b FROM requests)
    SELECT 'interval' AS kind, CASE WHEN width < 100 THEN 'high' WHEN width < 300 THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM c GROUP BY ALL
    UNION ALL SELECT 'region', CASE WHEN a BETWEEN -25 AND -20 AND b BETWEEN -50 AND -45 THEN 'high'
    WHEN a BETWEEN -30 AND -15 AND b BETWEEN -55 AND -40 THEN 'medium' ELSE 'low' END, count(*) FROM r GROUP BY ALL""",
)
register(
    "model_grade",
    lambda t: t.scored.groupBy("Element", S.accuracy_level(S.sample_accuracy(F.col("y_true"), F.col("y_pred"))).alias("sample_level"))
    .agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_r2("y_true", "y_pred"), 6).alias("r2"))
    .withColumn("r2_level", S.r2_level(F.col("r2"))),
    """WITH s AS (SELECT *, greatest(0, 100 - abs(y_true - y_pred) / nullif(abs(y_true), 0) * 100) AS acc FROM scored),
    g AS (SELECT Element, CASE WHEN acc >= 90 THEN 'EXCELLENT' WHEN acc >= 80 THEN 'GOOD' WHEN acc >= 70 THEN 'FAIR' ELSE 'POOR' END AS sample_level,
      count(*) AS n, round(regr_r2(y_true, y_pred), 6) AS r2 FROM s GROUP BY ALL)
    SELECT *, CASE WHEN r2 >= 0.95 THEN 'EXCELLENT' WHEN r2 >= 0.85 THEN 'GOOD' WHEN r2 >= 0.7 THEN 'FAIR' ELSE 'POOR' END AS r2_level FROM g""",
)

# joins
register(
    "hole_consistency", lambda t: R.hole_consistency(t.hole_grades, t.collars),
    """SELECT count(DISTINCT g.Hole_ID) AS total_holes_in_grades, count(DISTINCT c.Hole_ID) AS total_holes_in_coords,
    count(DISTINCT g.Hole_ID) - count(DISTINCT c.Hole_ID) AS missing_coords,
    count(DISTINCT c.Hole_ID) * 100.0::DOUBLE / count(DISTINCT g.Hole_ID) AS consistency_percentage
    FROM hole_grades g LEFT JOIN collars c ON g.Hole_ID = c.Hole_ID""",
    consistency_percentage=6,
)
register(
    "holes_without_collar", lambda t: R.holes_without_collar(t.hole_grades, t.collars),
    "SELECT DISTINCT Hole_ID FROM hole_grades WHERE Hole_ID NOT IN (SELECT Hole_ID FROM collars)",
)
register(
    "top_location", lambda t: R.top_location(R.heatmap_points(t.hole_grades, t.collars)),
    f"""SELECT Element, Hole_ID, DataSet, latitude, longitude, concentration FROM ({_POINTS})
    QUALIFY row_number() OVER (PARTITION BY Element ORDER BY concentration DESC, Hole_ID, DataSet) = 1""",
    concentration=5,
)
register(
    "question_answer", lambda t: R.question_answer(t.questions, R.heatmap_points(t.hole_grades, t.collars)),
    f"""WITH best AS (SELECT * FROM ({_POINTS}) QUALIFY row_number() OVER (PARTITION BY Element ORDER BY concentration DESC, Hole_ID, DataSet) = 1),
    asked AS (SELECT conv_id, turn, {_MENTION} AS Element FROM questions)
    SELECT a.Element, conv_id, turn, Hole_ID, DataSet, latitude, longitude, concentration FROM asked a JOIN best b ON a.Element = b.Element""",
    concentration=5,
)

# order, limit, sets
register(
    "ordered_rows", lambda t: R.training_rows(t.hole_samples).select("Hole_ID", "Element", "Depth_From", "SampleID", GRADE)
    .orderBy("Hole_ID", "Element", "Depth_From", "SampleID"),
    f"SELECT Hole_ID, Element, Depth_From, SampleID, {G} FROM hole_samples WHERE {TRAINING}",
)
register(
    "top_samples", lambda t: R.top_samples(t.hole_samples),
    f"SELECT SampleID, Hole_ID, Element, {G} FROM hole_samples WHERE {G} > 0 ORDER BY {G} DESC, SampleID, Element LIMIT 5",
)
register(
    "offset_fetch", lambda t: R.offset_fetch(t.hole_samples.select("SampleID", "Element", GRADE), [F.desc_nulls_last(GRADE), "SampleID"], 20, 10),
    f"SELECT SampleID, Element, {G} FROM hole_samples ORDER BY {G} DESC NULLS LAST, SampleID LIMIT 20 OFFSET 10",
)
_ID = ["SampleID", "Element", "Depth_From", "Depth_To"]
register(
    "verification_sample",
    lambda t: R.verification_sample(R.training_rows(t.hole_samples, ["Cu"]).select(*_ID, "latitude", "longitude", GRADE), _ID),
    f"""WITH c AS (SELECT SampleID, Element, Depth_From, Depth_To, latitude, longitude, {G} FROM hole_samples WHERE {TRAINING} AND Element = 'Cu'),
    q AS (SELECT quantile_cont({G}, 0.5) AS q50, quantile_cont({G}, 0.75) AS q75 FROM c),
    top AS (SELECT * FROM c ORDER BY {G} DESC, SampleID, Element, Depth_From, Depth_To LIMIT 5),
    middle AS (SELECT c.* FROM c, q WHERE {G} >= q50 AND {G} < q75 ORDER BY {G} DESC, SampleID, Element, Depth_From, Depth_To LIMIT 5),
    low AS (SELECT * FROM (SELECT * FROM c ORDER BY {G}, SampleID, Element, Depth_From, Depth_To LIMIT 10) ORDER BY {G} DESC, SampleID, Element, Depth_From, Depth_To LIMIT 5),
    picked AS (SELECT * FROM c ORDER BY {identity_sql(42, ["SampleID", "Element"], ["Depth_From", "Depth_To"])}, SampleID, Element, Depth_From, Depth_To LIMIT 5)
    SELECT * FROM top UNION SELECT * FROM middle UNION SELECT * FROM low UNION SELECT * FROM picked""",
)
register(
    "grade_bands", lambda t: R.grade_bands(t.hole_samples),
    f"""WITH v AS (SELECT SampleID, Element, {G} FROM hole_samples WHERE {TRAINING}),
    q AS (SELECT quantile_cont({G}, 0.25) AS a, quantile_cont({G}, 0.75) AS b, quantile_cont({G}, 0.9) AS c FROM v)
    SELECT SampleID, Element, {G}, CASE WHEN {G} >= c THEN 'high' ELSE 'medium' END AS band
    FROM v, q WHERE {G} >= c OR ({G} >= a AND {G} < b)""",
)
register(
    "concat_distinct",
    lambda t: R.concat_distinct(*[R.scan_samples(t.hole_samples.filter(c), columns=["SampleID", "Element", GRADE]) for c in (
        F.col(GRADE) >= 50000, F.col("Depth_From") < 40)]),
    f"""SELECT SampleID, Element, {G} FROM hole_samples WHERE {G} >= 50000
    UNION SELECT SampleID, Element, {G} FROM hole_samples WHERE Depth_From < 40""",
)
register(
    "remaining_elements", lambda t: R.remaining_elements(R.element_priority(t.hole_samples), t.models),
    f"""SELECT Element, count(*) AS records FROM hole_samples WHERE {TRAINING} GROUP BY Element
    HAVING upper(Element) NOT IN (SELECT element FROM models)""",
)
