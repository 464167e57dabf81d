"""Cell joins, nearest neighbours and spatial statistics against brute force."""

import math
import random

import numpy as np
import pytest
from support import rows
from pyspark.sql import functions as F

from corelode.functions.predicates import GRADE
from corelode.operators import continuity as C
from corelode.operators import features as E
from corelode.operators import neighbours as N
from corelode.operators import spatial as G


def points(spark, values, tag):
    return spark.createDataFrame([(f"{tag}{i}", float(y), float(x)) for i, (y, x) in enumerate(values)], f"{tag}_id string, {tag}_lat double, {tag}_lon double")


def brute(targets, references, k):
    out = []
    for i, (ty, tx) in enumerate(targets):
        near = sorted((math.sqrt((ty - ry) ** 2 + (tx - rx) ** 2), f"r{j}") for j, (ry, rx) in enumerate(references))[:k]
        out += [(f"t{i}", r, round(d, 9), n + 1) for n, (d, r) in enumerate(near)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def clouds():
    """Two dense clusters, a sparse field and targets far outside."""
    r = random.Random(7)
    references = [(r.gauss(0, 0.001), r.gauss(0, 0.001)) for _ in range(200)]
    references += [(r.gauss(5, 0.0001), r.gauss(5, 0.0001)) for _ in range(100)]
    references += [(r.uniform(-10, 10), r.uniform(-10, 10)) for _ in range(60)]
    targets = references[::17] + [(r.uniform(-12, 12), r.uniform(-12, 12)) for _ in range(30)] + [(90.0, 80.0), (-60.0, 0.0)]
    return targets, references


@pytest.mark.parametrize("k,per_cell", [(1, 64), (5, 8), (7, 1000)])
def test_nearest_equals_brute_force(spark, clouds, k, per_cell):
    targets, references = clouds
    got = N.nearest(points(spark, targets, "t"), points(spark, references, "r"), k, per_cell=per_cell)
    assert rows(got, "t_id", "r_id", "distance", "position", digits=9) == brute(targets, references, k)


def test_nearest_orders_ties_by_id(spark):
    references = [(0.0, 1.0), (1.0, 0.0), (0.0, -1.0), (-1.0, 0.0)]
    got = N.nearest(points(spark, [(0.0, 0.0)], "t"), points(spark, references, "r"), 2, per_cell=1)
    assert rows(got, "r_id", "distance") == [("r0", 1.0), ("r1", 1.0)]


def test_nearest_with_fewer_references_than_k(spark):
    got = N.nearest(points(spark, [(0.0, 0.0)], "t"), points(spark, [(0.0, 3.0), (4.0, 0.0)], "r"), 5)
    assert rows(got, "r_id", "distance") == [("r0", 3.0), ("r1", 4.0)]


def test_nearest_without_references(spark):
    empty = points(spark, [(0.0, 0.0)], "r").filter("false")
    assert N.nearest(points(spark, [(0.0, 0.0)], "t"), empty, 2).count() == 0


def test_knn_join_beyond_limit(spark):
    got = G.knn_join(points(spark, [(0.0, 0.0), (50.0, 50.0)], "t"), points(spark, [(0.0, 1.0), (0.0, 2.0), (0.0, 9.0)], "r"), 3, 2.5)
    assert rows(got, "t_id", "r_id", "neighbors_found") == [("t0", "r0", 2), ("t0", "r1", 2), ("t1", None, 0)]


@pytest.mark.parametrize("per_cell", [5, 100_000])
def test_distance_pairs_equal_brute_force(spark, clouds, per_cell):
    _, references = clouds
    a, b = points(spark, references, "a"), points(spark, references, "b")
    got = {(r["a_id"], r["b_id"]) for r in N.distance_pairs(a, b, 0.5, per_cell=per_cell).collect()}
    want = {(f"a{i}", f"b{j}") for i, p in enumerate(references) for j, q in enumerate(references) if math.dist(p, q) <= 0.5}
    assert got == want


@pytest.mark.parametrize("per_piece", [None, 40])
def test_distance_pairs_without_a_maximum_are_the_whole_matrix(spark, per_piece):
    r = random.Random(8)
    here, there = ([(r.uniform(-60, 60), r.uniform(-170, 170)) for _ in range(n)] for n in (25, 30))
    if per_piece:
        spark.conf.set("corelode.pairsPerPiece", str(per_piece))
    try:
        got = N.distance_pairs(points(spark, here, "a"), points(spark, there, "b"), metric="manhattan")
        assert not per_piece or got.rdd.getNumPartitions() > 8
        found = rows(got, "a_id", "b_id", "distance")
    finally:
        spark.conf.unset("corelode.pairsPerPiece")
    assert found == sorted(((f"a{i}", f"b{j}", round(abs(p[0] - q[0]) + abs(p[1] - q[1]), 6)) for i, p in enumerate(here) for j, q in enumerate(there)), key=str)
    assert N.distance_pairs(points(spark, [], "a"), points(spark, there, "b")).count() == 0


def test_the_query_has_every_pair_of_collars(spark, tmp_path):
    from corelode.plans import catalog

    spark.createDataFrame([(i, -1.0 if i == 4 else 1.0) for i in range(1, 13)], "s_suppkey long, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    got = rows(catalog.spark_query("distance_pairs")(spark, str(tmp_path)), "a_id", "b_id", "manhattan")
    holes = [f"H{i}" for i in range(1, 13) if i not in (4, 7)]  # one in the red, one without coordinates
    assert [g[:2] for g in got] == sorted((a, b) for a in holes for b in holes) and max(g[2] for g in got) > 0.015


def test_pairs_within_km_at_high_latitude(spark):
    r = random.Random(3)
    places = [(r.uniform(69.5, 70.0), r.uniform(10, 11)) for _ in range(80)]

    def km(p, q):
        y1, x1, y2, x2 = map(math.radians, (*p, *q))
        h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    got = {(x["a_id"], x["b_id"]) for x in N.pairs_within_km(points(spark, places, "a"), points(spark, places, "b"), 5.0).collect()}
    assert got == {(f"a{i}", f"b{j}") for i, p in enumerate(places) for j, q in enumerate(places) if km(p, q) <= 5}


def test_element_pairs_equal_theta_join(spark, samples):
    a = samples.select("Hole_ID", F.col("Element").alias("x"), F.col("Depth_From").alias("f1"), F.col("Depth_To").alias("t1"), F.col(GRADE).alias("g1"), "latitude")
    b = samples.select(F.col("Hole_ID").alias("h2"), F.col("Element").alias("y"), F.col("Depth_From").alias("f2"), F.col("Depth_To").alias("t2"), F.col(GRADE).alias("g2"))
    naive = a.join(b, (a.Hole_ID == b.h2) & (F.abs(F.col("f1") - F.col("f2")) < 0.1) & (F.abs(F.col("t1") - F.col("t2")) < 0.1) & (F.col("x") < F.col("y"))).filter(
        (F.col("g1") > 0) & (F.col("g2") > 0) & F.col("latitude").isNotNull())
    pairs = N.element_pairs(samples)
    assert pairs.agg(F.sum("pairs")).first()[0] == naive.count()


def test_neighbor_features_equal_brute_force(spark):
    r = random.Random(5)
    sites = [(round(r.uniform(0, 1), 3), round(r.uniform(0, 1), 3)) for _ in range(12)]
    data = []
    for i in range(60):
        y, x = sites[0] if i % 3 == 0 else r.choice(sites)
        data.append((f"S{i:03d}", "Cu", float(i % 5), float(i % 5 + 1), y, x, float(r.randint(1, 500))))
    data.append(data[-1])  # an exact copy
    df = spark.createDataFrame(data, "SampleID string, Element string, Depth_From double, Depth_To double, latitude double, longitude double, standardized_grade_ppm double")
    got = rows(E.features_neighbors(df, 4), "SampleID", "avg_neighbor_distance", "max_neighbor_distance", "avg_neighbor_grade")
    want = []
    for i, a in enumerate(data):
        others = sorted((math.hypot(a[4] - b[4], a[5] - b[5]), b[0], b[6]) for j, b in enumerate(data) if j != i)[:4]
        d = [o[0] for o in others]
        want.append((a[0], round(sum(d) / 4, 6), round(max(d), 6), round(sum(o[2] for o in others) / 4, 6)))
    assert got == sorted(want, key=str)


def test_idw_weights(spark):
    refs = points(spark, [(0.0, 1.0), (0.0, -2.0)], "r").withColumn("value", F.when(F.col("r_id") == "r0", 10.0).otherwise(40.0))
    row = G.idw(points(spark, [(0.0, 0.0)], "t"), refs, 2).first()
    assert row["value"] == pytest.approx((10 * 1 + 40 * 0.25) / 1.25)
    one = G.idw(points(spark, [(0.0, 0.0)], "t"), refs, 1).first()
    assert one["value"] == one["lower"] == one["upper"] == 10.0
    exact = G.idw(points(spark, [(0.0, 1.0)], "t"), refs, 2).first()
    assert exact["value"] == pytest.approx(10.0, abs=1e-6)


def test_morans_i_equals_matrix_form(spark):
    r = random.Random(1)
    places = [(-15 + r.uniform(0, 0.02), -71 + r.uniform(0, 0.02)) for _ in range(25)]
    data = [(*places[i % 25], float(r.randint(1, 100))) for i in range(60)]
    df = spark.createDataFrame(data, f"latitude double, longitude double, {GRADE} double")
    got = {x["band_m"]: x["morans_i"] for x in G.morans_i(df, [400, 900]).collect()}
    pos, v = np.radians(np.array([d[:2] for d in data])), np.array([d[2] for d in data])
    dy, dx = pos[:, None, 0] - pos[None, :, 0], pos[:, None, 1] - pos[None, :, 1]
    h = np.sin(dy / 2) ** 2 + np.cos(pos[:, None, 0]) * np.cos(pos[None, :, 0]) * np.sin(dx / 2) ** 2
    dist = 2 * 6371000 * np.arcsin(np.sqrt(h))
    for band, value in got.items():
        w = ((dist <= band) & (dist > 0)).astype(float)
        w /= np.maximum(w.sum(axis=1, keepdims=True), 1)
        z = v - v.mean()
        assert value == pytest.approx(len(v) / w.sum() * (w * np.outer(z, z)).sum() / (z * z).sum(), rel=1e-9)


def test_morans_i_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(0.0, 0.0, 5.0), (0.0, 0.001, 5.0)], f"latitude double, longitude double, {GRADE} double")
    assert G.morans_i(df, [500]).first()["morans_i"] is None


@pytest.mark.parametrize("limit", [None, 5])
def test_continuity_equals_all_pairs(spark, limit):
    r = random.Random(2)
    places = [(-15 + r.uniform(0, 0.01), -71 + r.uniform(0, 0.01)) for _ in range(8)]
    data = [(r.choice("AB"), *places[0 if i % 3 == 0 else i % 8], float(r.randint(1, 20))) for i in range(70)]
    df = spark.createDataFrame(data, f"Element string, latitude double, longitude double, {GRADE} double")
    got = {x["Element"]: x for x in G.grade_continuity(df, 400.0, limit).collect()}
    for e, row in got.items():
        mine = [d for d in data if d[0] == e]
        diffs = []
        for a in mine:
            for b in mine:
                y1, x1, y2, x2 = map(math.radians, (a[1], a[2], b[1], b[2]))
                h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
                if 2 * 6371000 * math.asin(math.sqrt(h)) <= 400:
                    diffs.append(abs(a[3] - b[3]))
        assert row["pairs_within_threshold"] == len(diffs) and row["max_grade_difference"] == max(diffs)
        assert row["mean_grade_difference"] == pytest.approx(sum(diffs) / len(diffs))


def test_grid_edges(spark):
    bounds = (0.0, 1.0, 0.0, 0.5)
    half = G.grid_points(spark, bounds, 0.25, 0.25, "half_open")
    assert half.count() == 4 * 2 and half.agg(F.max("latitude")).first()[0] == 0.75
    closed = G.grid_points(spark, bounds, 0.25, 0.25, "inclusive")
    assert closed.count() == 5 * 3 and closed.agg(F.max("latitude")).first()[0] == 1.0
    over = G.grid_points(spark, bounds, 0.3, 0.3, "overshoot")
    assert over.agg(F.max("latitude")).first()[0] == pytest.approx(1.2)


def test_dbscan_labels(spark):
    r = random.Random(4)
    blobs = [(r.gauss(0, 0.002), r.gauss(0, 0.002), 1.0) for _ in range(30)] + [(r.gauss(1, 0.002), r.gauss(1, 0.002), 1.0) for _ in range(27)]
    chain = [(3 + i * 0.008, 3.0, 1.0) for i in range(40)]
    noise = [(9.0, 9.0, 1.0), (8.0, 2.0, 1.0), (0.0, 5.0, 1.0)]
    copies = [(6.0, 6.0, 1.0)] * 5
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(blobs + chain + noise + copies)], "id int, latitude double, longitude double, value double")
    found = G.cluster_dbscan(df, ["latitude", "longitude", "value"], 0.01, 3)
    labels = {x["id"]: x["cluster"] for x in found.collect()}
    assert len(labels) == len(blobs + chain + noise + copies)
    assert len({labels[i] for i in range(57, 97)}) == 1 and labels[57] >= 0
    assert {labels[97], labels[98], labels[99]} == {-1}
    assert len({labels[i] for i in range(100, 105)}) == 1 and labels[100] >= 0
    assert G.cluster_summary(found).agg(F.sum("size")).first()[0] == sum(v >= 0 for v in labels.values())


def test_kmeans_separates_blobs(spark):
    df = spark.createDataFrame([(0.0 + i / 1000, 0.0, 1.0) for i in range(20)] + [(5.0 + i / 1000, 5.0, 9.0) for i in range(20)], "latitude double, longitude double, value double")
    summary = rows(G.cluster_summary(G.cluster_kmeans(df, ["latitude", "longitude", "value"], 2)), "size", "mean_value")
    assert summary == [(20, 1.0), (20, 9.0)]


@pytest.mark.parametrize("eps,least,levels", [(0.05, 4, 16), (0.12, 6, 16), (0.12, 6, 1)])
def test_dbscan_equals_the_definition(spark, monkeypatch, eps, least, levels):
    """Same core components, noise and admissible border labels as brute force,
    with a third of the points in one dense spot."""
    links = G._dense_links
    monkeypatch.setattr(G, "_dense_links", lambda *a: links(*a, levels=levels))
    r = random.Random(11)
    pts = [(round(r.gauss(0.5, 0.02), 4), round(r.gauss(0.5, 0.02), 4)) for _ in range(100)]
    pts += [(round(r.uniform(0, 2), 4), round(r.uniform(0, 2), 4)) for _ in range(200)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id int, x double, y double")
    got = {q["id"]: q["cluster"] for q in G.cluster_dbscan(df, ["x", "y"], eps, least).collect()}
    near = {i: [j for j, q in enumerate(pts) if math.dist(p, q) <= eps] for i, p in enumerate(pts)}
    core = {i for i in near if len(near[i]) >= least}
    seen, parts = set(), []
    for i in core:
        if i not in seen:
            part, todo = set(), [i]
            while todo:
                k = todo.pop()
                if k not in part:
                    part.add(k)
                    todo += [j for j in near[k] if j in core]
            seen |= part
            parts.append(part)
    assert len({got[min(p)] for p in parts}) == len(parts)
    for part in parts:
        assert len({got[i] for i in part}) == 1 and got[min(part)] >= 0
    for i in set(near) - core:
        allowed = {got[j] for j in near[i] if j in core} or {-1}
        assert got[i] in allowed


def test_cells_are_cut_along_both_sides_without_losing_pairs(spark, clouds):
    _, references = clouds
    a, b = points(spark, references, "a"), points(spark, references, "b")
    whole = {(r["a_id"], r["b_id"]) for r in N.distance_pairs(a, b, 0.5).collect()}
    globe = {(r["a_id"], r["b_id"]) for r in N.pairs_within_km(a, b, 40.0).collect()}
    spark.conf.set("corelode.pairsPerPiece", "25")
    try:
        cut, far = N.distance_pairs(a, b, 0.5), N.pairs_within_km(a, b, 40.0)
        assert cut.rdd.getNumPartitions() > 8  # not merged again by bytes
        got, on_globe = ([(r["a_id"], r["b_id"]) for r in df.collect()] for df in (cut, far))
    finally:
        spark.conf.unset("corelode.pairsPerPiece")
    assert sorted(got) == sorted(whole) and sorted(on_globe) == sorted(globe)


@pytest.mark.parametrize("per_block", [3, 1000])
def test_blocks_hold_each_near_pair_once(spark, per_block):
    r = random.Random(5)
    places = [(-15 + r.uniform(0, 0.02), -71 + r.uniform(0, 0.02), r.choice("AB")) for _ in range(60)] + [(89.9999, 10.0, "A"), (89.9999, -170.0, "A")]
    df = spark.createDataFrame([(*p, i) for i, p in enumerate(places)], "latitude double, longitude double, e string, i int")
    met = N.block_pairs(df, 0.5, ["i"], per_block, 2, ["e"])
    pairs = sorted((x["i"], y["i"]) for row in met.collect() for x in row["a_rows"] for y in row["b_rows"])
    assert len(pairs) == len(set(pairs))
    at = np.array([p[:2] for p in places])
    (near,) = N.within_km(at, at, [0.5])
    want = {(i, j) for i, j in zip(*map(list, np.nonzero(near))) if places[i][2] == places[j][2]}
    assert want <= set(pairs) and (60, 61) in want
    b = df.select(*[F.col(c).alias(f"{t}") for c, t in (("i", "b_id"), ("latitude", "b_lat"), ("longitude", "b_lon"))])
    a = b.withColumnsRenamed({f"b_{c}": f"a_{c}" for c in ("id", "lat", "lon")})
    assert {(x["a_id"], x["b_id"]) for x in N.pairs_within_km(a, b, 0.5).collect()} == set(zip(*map(list, np.nonzero(near))))


def test_morans_i_and_continuity_make_no_row_per_pair(spark):
    """At 36 million rows the neighbourhoods of grade_continuity filled the disk."""
    df = spark.createDataFrame([("A", 0.0, 0.001 * i, 5.0 + i) for i in range(30)], f"Element string, latitude double, longitude double, {GRADE} double")
    whole = G.morans_i(df, [500]).first()["morans_i"], G.grade_continuity(df, 400.0).first()
    spark.conf.set("corelode.sitesPerBlock", "4")
    try:
        cut = G.morans_i(df, [500])
        assert cut.first()["morans_i"] == pytest.approx(whole[0])
    finally:
        spark.conf.unset("corelode.sitesPerBlock")
    for found in (cut, G.grade_continuity(df, 400.0, 4)):
        assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    assert G.grade_continuity(df, 400.0, 4).first()["mean_grade_difference"] == pytest.approx(whole[1]["mean_grade_difference"])


def test_blocks_of_continuity_hold_sums_of_sites(spark, monkeypatch):
    """Samples copied to every block near them filled the disk."""
    seen, pairs = [], G.block_pairs
    monkeypatch.setattr(G, "block_pairs", lambda df, *a, **k: seen.append(df.count()) or pairs(df, *a, **k))
    data = [("A", 0.0, 0.001 * (i % 5), 7.0 if i < 40 else 5.0 + i) for i in range(200)]
    df = spark.createDataFrame(data + data[:30], f"Element string, latitude double, longitude double, {GRADE} double")
    got = G.grade_continuity(df, 250.0, 60).first()
    assert seen == [5]
    diffs = [abs(p[3] - q[3]) for p in data + data[:30] for q in data + data[:30] if abs(p[2] - q[2]) < 0.00225]
    assert got["pairs_within_threshold"] == len(diffs) and got["max_grade_difference"] == max(diffs)
    assert got["mean_grade_difference"] == pytest.approx(sum(diffs) / len(diffs), rel=1e-12)


@pytest.mark.parametrize("sites,extent,km", [(40, 0.02, 0.4), (700, 0.004, 0.7), (300, 2.0, 30.0), (1, 0.1, 1.0), (60, 0.03, 0.0)])
def test_differences_by_parts_equal_all_pairs(sites, extent, km):
    draw = np.random.default_rng(sites)
    places = np.c_[-15 + draw.random(sites) * extent, -71 + draw.random(sites) * extent]
    site, g, n = draw.integers(0, sites, 1500), np.sort(np.round(draw.random(1500) * 1000) / 4), draw.integers(1, 4, 1500).astype(float)
    (near,) = N.within_km(places[site], places[site], [km])
    want = (near * np.abs(g[:, None] - g) * n[:, None] * n).sum()
    for direct in (10, 200, 5000):
        assert C.differences(site, g, n, places, km, direct) == pytest.approx(want, rel=1e-11)


def test_a_sample_that_repeats_is_held_once():
    import pyarrow as pa

    many = [pa.RecordBatch.from_pydict({"Element": ["A"] * 50, "latitude": [0.0] * 50, "longitude": [0.0] * 50, "g": [3.0] * 50}) for _ in range(40)]
    other = pa.RecordBatch.from_pydict({"Element": ["B", "A"], "latitude": [0.0, 0.0], "longitude": [0.0, 0.0], "g": [1.0, 5.0]})
    found = {r["Element"]: r for batch in C.site_sums([*many, other], 2, 1.0, 30) for r in batch.to_pylist()}
    assert found["A"] == {"Element": "A", "latitude": 0.0, "longitude": 0.0, "part": 2, "n": 2001.0, "sum": 6005.0, "lo": 3.0, "hi": 5.0, "difference": 8000.0}
    assert found["B"]["n"] == 1.0 and list(C.site_sums([], 0, 1.0, 30)) == []
