"""Registered nearness joins and spatial statistics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from corelode.functions import predicates as P
from corelode.functions import scalars as S
from corelode.functions.predicates import GRADE
from corelode.operators import neighbours as N
from corelode.operators import spatial as G_
from corelode.plans.registry import register
from corelode.plans.rows import CENTER, G, VALID

_PAIRS = f"""SELECT a.Hole_ID, a.Element AS element1, b.Element AS element2, a.Depth_From AS Depth_From1, a.Depth_To AS Depth_To1,
 b.Depth_From AS Depth_From2, b.Depth_To AS Depth_To2, a.{G} AS g1, b.{G} AS g2
 FROM hole_samples a JOIN hole_samples b ON a.Hole_ID = b.Hole_ID AND abs(a.Depth_From - b.Depth_From) < 0.1
 AND abs(a.Depth_To - b.Depth_To) < 0.1 AND a.Element < b.Element
 WHERE a.{G} > 0 AND b.{G} > 0 AND a.latitude IS NOT NULL AND a.longitude IS NOT NULL"""
register(
    "element_pairs", lambda t: N.element_pairs(t.hole_samples),
    f"""SELECT Hole_ID, element1, element2, Depth_From1, Depth_To1, Depth_From2, Depth_To2, count(*) AS pairs, sum(g1) AS sum1, sum(g2) AS sum2,
    sum(g1 * g1) AS square1, sum(g2 * g2) AS square2, sum(g1 * g2) AS product FROM ({_PAIRS}) GROUP BY ALL""",
    sum1=2, sum2=2, square1=1, square2=1, product=1,
)
register(
    "element_correlations", lambda t: N.element_correlations(t.hole_samples),
    f"""SELECT element1, element2, count(*) AS sample_count, avg(g1) AS avg_grade1, avg(g2) AS avg_grade2, corr(g1, g2) AS correlation
    FROM ({_PAIRS}) GROUP BY ALL""",
    avg_grade1=4, avg_grade2=4, correlation=7,
)


def _users(t):
    """Distinct valid request points."""
    return t.requests.filter(F.col("latitude").between(-90, 90)).select("user_id", "latitude", "longitude").distinct()


def _targets(t):
    return G_.as_targets(_users(t), "user_id")


def _references(t):
    return G_.hole_locations(t.hole_samples).select(
        F.col("Hole_ID").alias("r_id"), F.col("latitude").alias("r_lat"), F.col("longitude").alias("r_lon"), "value")


_KNN = f"""users AS (SELECT DISTINCT user_id, latitude, longitude FROM requests WHERE latitude BETWEEN -90 AND 90),
 holes AS (SELECT Hole_ID, latitude, longitude, avg({G}) AS value FROM hole_samples WHERE {VALID} GROUP BY ALL),
 near AS (SELECT user_id AS t_id, Hole_ID AS r_id, value, sqrt((u.latitude - h.latitude) * (u.latitude - h.latitude)
   + (u.longitude - h.longitude) * (u.longitude - h.longitude)) AS distance FROM users u, holes h),
 best AS (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY distance, r_id) AS position FROM near QUALIFY position <= 5)"""
register(
    "knn_join", lambda t: G_.knn_join(_targets(t), _references(t), 5, 0.02),
    f"""WITH {_KNN}, kept AS (SELECT * FROM best WHERE distance <= 0.02)
    SELECT u.user_id AS t_id, r_id, distance, position, coalesce(count(r_id) OVER (PARTITION BY u.user_id), 0) AS neighbors_found
    FROM users u LEFT JOIN kept k ON k.t_id = u.user_id""",
    distance=9,
)
register(
    "knn_all", lambda t: N.nearest(_targets(t), _references(t), 5),
    f"WITH {_KNN} SELECT t_id, r_id, distance, position FROM best", distance=9,
)
register(
    "nearest_hole", lambda t: G_.nearest_hole(_users(t), t.hole_samples, "user_id"),
    f"WITH {_KNN} SELECT user_id, latitude, longitude, distance AS distance_to_nearest_hole FROM users JOIN best ON t_id = user_id WHERE position = 1",
    distance_to_nearest_hole=9,
)
register(
    "idw", lambda t: G_.idw(_targets(t), _references(t)),
    f"""WITH {_KNN}, w AS (SELECT *, 1 / greatest(distance * distance, 1e-10) AS w FROM best),
    m AS (SELECT t_id, sum(w * value) / sum(w) AS v, sum(w) AS total, count(*) AS neighbors_used FROM w GROUP BY t_id),
    s AS (SELECT w.t_id, sqrt(sum(w.w / m.total * (w.value - m.v) * (w.value - m.v))) AS e FROM w JOIN m ON w.t_id = m.t_id GROUP BY w.t_id)
    SELECT m.t_id, v AS value, v - 1.96 * e AS lower, v + 1.96 * e AS upper, neighbors_used FROM m JOIN s ON m.t_id = s.t_id""",
    value=4, lower=4, upper=4,
)
register(
    "local_mean", lambda t: G_.local_mean(_targets(t), _references(t)),
    f"""WITH {_KNN} SELECT t_id, avg(value) AS mean, avg(value) - 1.96 * stddev_pop(value) / sqrt(count(*)) AS lower,
    avg(value) + 1.96 * stddev_pop(value) / sqrt(count(*)) AS upper, count(*) AS neighbors_used FROM best GROUP BY t_id""",
    mean=4, lower=4, upper=4,
)


def _sites(t, tag: str):
    return t.collars.filter(F.col("LL_Lat").isNotNull()).select(
        F.col("Hole_ID").alias(f"{tag}_id"), F.col("LL_Lat").alias(f"{tag}_lat"), F.col("LL_Long").alias(f"{tag}_lon"))


_TWO = "FROM collars a JOIN collars b ON a.LL_Lat IS NOT NULL AND b.LL_Lat IS NOT NULL"
_DA, _DO = "(a.LL_Lat - b.LL_Lat)", "(a.LL_Long - b.LL_Long)"
HAVERSINE = """2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin((radians({b}.{y}) - radians({a}.{y})) / 2), 2)
 + cos(radians({a}.{y})) * cos(radians({b}.{y})) * pow(sin((radians({b}.{x}) - radians({a}.{x})) / 2), 2))))"""
_KM = HAVERSINE.format(a="a", b="b", y="LL_Lat", x="LL_Long")
register(
    "distance_pairs",
    lambda t: N.distance_pairs(_sites(t, "a"), _sites(t, "b"), metric="manhattan").select(
        "a_id", "b_id", F.col("distance").alias("manhattan"),
        S.degrees_apart(*[F.col(c) for c in ("a_lat", "a_lon", "b_lat", "b_lon")]).alias("euclidean")),
    f"""SELECT a.Hole_ID AS a_id, b.Hole_ID AS b_id, abs{_DA} + abs{_DO} AS manhattan, sqrt({_DA} * {_DA} + {_DO} * {_DO}) AS euclidean
    {_TWO}""",
    manhattan=9, euclidean=9,
)
register(
    "within_distance", lambda t: N.pairs_within_km(_sites(t, "a"), _sites(t, "b"), 1.5).select("a_id", "b_id", F.col("distance").alias("km")),
    f"SELECT a.Hole_ID AS a_id, b.Hole_ID AS b_id, {_KM} AS km {_TWO} WHERE {_KM} <= 1.5", km=7,
)
register(
    "haversine",
    lambda t: t.hole_samples.filter(P.has_coordinates()).groupBy("Hole_ID", "latitude", "longitude").agg(F.count("*").alias("samples"))
    .withColumn("km", S.haversine_km(F.col("latitude"), F.col("longitude"), *CENTER)),
    f"""SELECT *, {HAVERSINE.format(a='h', b='c', y='latitude', x='longitude')} AS km FROM (SELECT Hole_ID, latitude, longitude, count(*) AS samples
    FROM hole_samples WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY ALL) h,
    (SELECT {CENTER[0]}::DOUBLE AS latitude, {CENTER[1]}::DOUBLE AS longitude) c""".replace("SELECT *,", "SELECT h.*,", 1),
    km=7,
)
_BANDS = [500, 1000, 2000, 4000]
register(
    "morans_i", lambda t: G_.morans_i(t.hole_samples.filter(P.valid_sample()), _BANDS),
    f"""WITH v AS (SELECT latitude, longitude, {G} - avg({G}) OVER () AS z FROM hole_samples WHERE {VALID}),
    s AS (SELECT latitude, longitude, count(*) AS n, sum(z) AS z, sum(z * z) AS q FROM v GROUP BY ALL),
    p AS (SELECT a.latitude, a.longitude, a.n, a.z, b.n AS bn, b.z AS bz, {HAVERSINE.format(a='a', b='b', y='latitude', x='longitude')} * 1000 AS d FROM s a, s b),
    k AS (SELECT band, latitude, longitude, max(n) AS n, max(z) AS z, sum(bn) AS k, sum(bz) AS nz
      FROM p JOIN (SELECT unnest({_BANDS})::DOUBLE AS band) ON d > 0 AND d <= band GROUP BY ALL)
    SELECT band AS band_m, CAST(sum(n) AS BIGINT) AS weights,
    (SELECT sum(n) FROM s) / sum(n) * sum(z * nz / k) / (SELECT sum(q) FROM s) AS morans_i FROM k GROUP BY band""",
    morans_i=7,
)
_METRES = 400.0
_GRID = f"""b AS (SELECT min(latitude) AS a, max(latitude) AS z, min(longitude) AS w, max(longitude) AS e FROM hole_samples WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
 s AS (SELECT *, {_METRES}::DOUBLE / 111000 AS dy, {_METRES}::DOUBLE / 111000 / cos(radians((a + z) / 2)) AS dx FROM b),
 n AS (SELECT *, CAST(ceil((z - a + dy) / dy) AS BIGINT) AS ny, CAST(ceil((e - w + dx) / dx) AS BIGINT) AS nx FROM s),
 g AS (SELECT i * nx + j AS grid_id, a + i * dy AS latitude, w + j * dx AS longitude FROM n, unnest(range(ny)) t1(i), unnest(range(nx)) t2(j))"""
register("grid", lambda t: G_.grid(t.hole_samples, _METRES), f"WITH {_GRID} SELECT * FROM g", latitude=9, longitude=9)
register("grid_cross", lambda t: G_.grid_points(t.spark, G_.extent_of(t.hole_samples), 0.004, 0.005, "half_open"),
         """WITH b AS (SELECT min(latitude) AS a, max(latitude) AS z, min(longitude) AS w, max(longitude) AS e FROM hole_samples WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
         n AS (SELECT *, CAST(ceil((z - a) / 0.004::DOUBLE) AS BIGINT) AS ny, CAST(ceil((e - w) / 0.005::DOUBLE) AS BIGINT) AS nx FROM b)
         SELECT i * nx + j AS grid_id, a + i * 0.004::DOUBLE AS latitude, w + j * 0.005::DOUBLE AS longitude FROM n, unnest(range(ny)) t1(i), unnest(range(nx)) t2(j)""",
         latitude=9, longitude=9)
register(
    "grid_nearest", lambda t: G_.nearest_hole(G_.grid(t.hole_samples, _METRES), t.hole_samples, "grid_id"),
    f"""WITH {_GRID}, h AS (SELECT DISTINCT latitude, longitude FROM hole_samples WHERE latitude IS NOT NULL AND longitude IS NOT NULL)
    SELECT grid_id, g.latitude, g.longitude, min(sqrt((g.latitude - h.latitude) * (g.latitude - h.latitude)
    + (g.longitude - h.longitude) * (g.longitude - h.longitude))) AS distance_to_nearest_hole FROM g, h GROUP BY ALL""",
    latitude=9, longitude=9, distance_to_nearest_hole=9,
)
register(
    "cluster_kmeans",
    lambda t: G_.cluster_summary(G_.cluster_kmeans(
        G_.hole_locations(t.hole_samples).withColumn("scaled", F.col("value") / 1e6), ["latitude", "longitude", "scaled"])),
)
register(
    "cluster_dbscan",
    lambda t: G_.cluster_dbscan(
        G_.hole_locations(t.hole_samples).withColumn("scaled", F.col("value") / 1e6), ["latitude", "longitude", "scaled"], 0.01)
    .groupBy("cluster").agg(F.count("*").alias("holes"), F.sum("samples").alias("samples")),
)
register(
    "grade_continuity", lambda t: G_.grade_continuity(t.hole_samples, 700.0),
    f"""WITH v AS (SELECT Element, Hole_ID, latitude, longitude, {G} AS g FROM hole_samples WHERE {VALID}),
    s AS (SELECT DISTINCT latitude, longitude FROM v),
    near AS (SELECT a.latitude AS y1, a.longitude AS x1, b.latitude AS y2, b.longitude AS x2 FROM s a, s b
      WHERE {HAVERSINE.format(a='a', b='b', y='latitude', x='longitude')} <= 0.7),
    p AS (SELECT a.Element, abs(a.g - b.g) AS d FROM near JOIN v a ON a.latitude = y1 AND a.longitude = x1
      JOIN v b ON b.latitude = y2 AND b.longitude = x2 AND b.Element = a.Element),
    m AS (SELECT Element, avg(d) AS mean_d, max(d) AS max_d, count(*) AS pairs FROM p GROUP BY Element),
    e AS (SELECT Element, stddev_pop(g) AS sd, count(*) AS n FROM v GROUP BY Element)
    SELECT e.Element, mean_d AS mean_grade_difference, max_d AS max_grade_difference, 1 - mean_d / sd AS continuity_coefficient,
    pairs AS pairs_within_threshold, n * (n - 1) // 2 AS total_possible_pairs FROM e JOIN m ON e.Element = m.Element""",
    mean_grade_difference=4, max_grade_difference=4, continuity_coefficient=7,
)
