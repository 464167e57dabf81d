"""Interpolation, autocorrelation, grids, clusters and continuity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corelode.functions import predicates as P
from corelode.functions.predicates import GRADE
from corelode.operators.continuity import block_differences, site_sums
from corelode.operators.neighbours import block_pairs, cell_join, locations, nearest, within_km
from corelode.operators.ordered import row_numbers
from corelode.schema import Z_95
from corelode.session import keep, limit_of

METRES_PER_DEGREE = 111_000
# locations of a block that meets others in one task, and the sums they may carry
SITES_PER_BLOCK = 4_000
VALUES_PER_BLOCK = 256_000
# samples that one task orders by grade, that are worth a task, and that are worth one more than the cores take at once
LEVELS_PER_RANGE = 2_500_000
LEAST_RANGE = 50_000
GOOD_RANGE = 1_000_000
# locations that one numpy pass holds against a block
PASS_SITES = 128


def point_id() -> Column:
    """Identity of a location: its coordinates as text."""
    return F.concat_ws(",", F.col("latitude").cast("string"), F.col("longitude").cast("string"))


def hole_locations(samples: DataFrame) -> DataFrame:
    """Distinct hole coordinates with the mean grade and number of valid samples."""
    return samples.filter(P.valid_sample()).groupBy("Hole_ID", "latitude", "longitude").agg(
        F.avg(GRADE).alias("value"), F.count("*").alias("samples"))


def as_targets(points: DataFrame, key: str) -> DataFrame:
    return points.select(F.col(key).alias("t_id"), F.col("latitude").alias("t_lat"), F.col("longitude").alias("t_lon"))


def as_references(points: DataFrame, key: str) -> DataFrame:
    return points.select(F.col(key).alias("r_id"), F.col("latitude").alias("r_lat"), F.col("longitude").alias("r_lon"))


def knn_join(targets: DataFrame, references: DataFrame, k: int = 5, max_distance: float | None = None) -> DataFrame:
    """Each target with its nearest references; ``neighbors_found`` counts those
    within ``max_distance``. A target without any keeps one row of nulls."""
    near = nearest(targets, references, k, max_distance)
    found = near.groupBy("t_id").agg(F.count("*").alias("neighbors_found"))
    return (
        targets.select("t_id").join(near, "t_id", "left").join(found, "t_id", "left")
        .withColumn("neighbors_found", F.coalesce("neighbors_found", F.lit(0).cast("long")))
    )


def _neighbour_values(targets: DataFrame, references: DataFrame, k: int, max_distance: float | None) -> DataFrame:
    values = references.select("r_id", "value")
    return nearest(targets, references, k, max_distance).join(values, "r_id")


def idw(targets: DataFrame, references: DataFrame, k: int = 5, power: float = 2.0, max_distance: float | None = None) -> DataFrame:
    """Inverse-distance interpolation with a 95 % band; references also have ``value``."""
    near = _neighbour_values(targets, references, k, max_distance)
    weighted = near.withColumn("_w", 1 / F.greatest(F.pow("distance", F.lit(power)), F.lit(1e-10)))
    sums = weighted.groupBy("t_id").agg(
        (F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("value"),
        F.collect_list(F.struct("_w", F.col("value").alias("v"))).alias("_near"),  # at most k entries
        F.sum("_w").alias("_total"), F.count("*").alias("neighbors_used"),
    )
    spread = F.sqrt(F.aggregate(
        "_near", F.lit(0.0),
        lambda acc, x: acc + x["_w"] / F.col("_total") * (x["v"] - F.col("value")) * (x["v"] - F.col("value"))))
    return sums.select(
        "t_id", "value", (F.col("value") - Z_95 * spread).alias("lower"),
        (F.col("value") + Z_95 * spread).alias("upper"), "neighbors_used")


def local_mean(targets: DataFrame, references: DataFrame, k: int = 5, max_distance: float | None = None) -> DataFrame:
    """Mean of the neighbours with ±1.96 standard errors (population deviation)."""
    near = _neighbour_values(targets, references, k, max_distance)
    error = F.stddev_pop("value") / F.sqrt(F.count("*"))
    return near.groupBy("t_id").agg(
        F.avg("value").alias("mean"), (F.avg("value") - Z_95 * error).alias("lower"),
        (F.avg("value") + Z_95 * error).alias("upper"), F.count("*").alias("neighbors_used"))


def _arrays(block: pa.StructArray) -> dict[str, np.ndarray]:
    """The columns of a block; lists, which have the same ``sizes``, one after the other."""
    found = {}
    for f, c in zip(block.type, block.flatten()):
        if pa.types.is_list(f.type):
            found["sizes"] = np.asarray(c.value_lengths()).astype(np.int64)
            c = c.flatten()
        found[f.name] = np.asarray(c)
    return found


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict[str, np.ndarray]]]:
    """The columns of both blocks of each row of :func:`block_pairs`."""
    for batch in batches:
        for row in range(len(batch)):
            blocks = [batch.column(c)[row].values for c in ("a_rows", "b_rows")]
            yield [_arrays(block) for block in blocks]


def morans_i(samples: DataFrame, bands_m: list[float], value: str = GRADE) -> DataFrame:
    """Moran's I per distance band (metres) with row-normalised weights.

    Points at the same coordinate are not neighbours of each other and share all
    their neighbours, so sums per location give the very same statistic.
    """
    valid = samples.filter(P.has_coordinates() & F.col(value).isNotNull())
    mean = valid.agg(F.avg(value).alias("m")).scalar()
    sites = keep(
        valid.select("latitude", "longitude", (F.col(value) - mean).alias("_z"))
        .groupBy("latitude", "longitude").agg(
            F.count("*").alias("n"), F.sum("_z").alias("z"), F.sum(F.col("_z") * F.col("_z")).alias("q")))

    limits = [float(m) for m in bands_m]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _block_rows(batches):
            places, other, weights = (np.stack(c, axis=1) for c in ((a["latitude"], a["longitude"]), (b["latitude"], b["longitude"]), (b["n"], b["z"])))
            for at in range(0, len(places), PASS_SITES):
                part = slice(at, at + PASS_SITES)
                same, *bands = within_km(places[part], other, [0.0, *[m / 1000 for m in limits]])
                for m, near in zip(limits, bands):
                    k, nz = ((near & ~same).astype(float) @ weights).T
                    met = np.flatnonzero(k)
                    columns = [np.full(len(met), m), *[a[c][part][met] for c in ("latitude", "longitude", "n", "z")], k[met], nz[met]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in columns], names=names)

    names = ["band_m", "latitude", "longitude", "n", "z", "k", "nz"]
    pairs = block_pairs(sites, max(limits) / 1000, ["n", "z"], limit_of(sites.sparkSession, "sitesPerBlock", SITES_PER_BLOCK), 16)
    near = pairs.select("a_rows", "b_rows").mapInArrow(run, ", ".join(f"{n} double" for n in names))
    per_site = near.groupBy("band_m", "latitude", "longitude").agg(
        F.max("n").cast("long").alias("n"), F.max("z").alias("z"), F.sum("k").alias("k"), F.sum("nz").alias("nz"))
    whole = sites.agg(F.struct(F.sum("n").alias("n"), F.sum("q").alias("q"))).scalar()
    return per_site.groupBy("band_m").agg(
        F.sum("n").alias("weights"), F.sum(F.col("z") * F.col("nz") / F.col("k")).alias("_num"),
    ).withColumn("_all", whole).select(
        "band_m", "weights",
        (F.col("_all.n") / F.col("weights") * F.try_divide("_num", F.col("_all.q"))).alias("morans_i"))


def grid_axes(bounds: tuple[float, float, float, float], lat_step: float, lon_step: float, edge: str = "inclusive") -> tuple[int, float, int, float]:
    """Points and step along latitude and longitude over (min_lat, max_lat, min_lon, max_lon).

    ``edge``: ``half_open`` leaves the upper bound out, ``inclusive`` has
    ``int(range / step) + 1`` points from bound to bound, ``overshoot`` goes up
    to one step past the upper bound.
    """
    min_lat, max_lat, min_lon, max_lon = bounds

    def axis(low: float, high: float, step: float) -> tuple[int, float]:
        span = high - low
        if edge == "half_open":
            return math.ceil(span / step), step
        if edge == "inclusive":
            n = int(span / step) + 1
            return n, (span / (n - 1) if n > 1 else step)
        if edge == "overshoot":
            return math.ceil((span + step) / step), step
        raise ValueError(f"unknown edge {edge}")

    return (*axis(min_lat, max_lat, lat_step), *axis(min_lon, max_lon, lon_step))


def grid_points(
    spark: SparkSession, bounds: tuple[float, float, float, float], lat_step: float, lon_step: float,
    edge: str = "inclusive",
) -> DataFrame:
    """Regular grid over (min_lat, max_lat, min_lon, max_lon); see :func:`grid_axes`."""
    n_lat, dlat, n_lon, dlon = grid_axes(bounds, lat_step, lon_step, edge)
    i, j = F.floor(F.col("id") / n_lon), F.col("id") % n_lon
    return spark.range(n_lat * n_lon).select(
        F.col("id").alias("grid_id"), (F.lit(bounds[0]) + i * dlat).alias("latitude"),
        (F.lit(bounds[2]) + j * dlon).alias("longitude"))


def steps_for_metres(metres: float, min_lat: float, max_lat: float) -> tuple[float, float]:
    """Grid steps in degrees for a resolution in metres."""
    lat = metres / METRES_PER_DEGREE
    return lat, lat / math.cos(math.radians((min_lat + max_lat) / 2))


def extent_of(samples: DataFrame) -> tuple[float, float, float, float]:
    row = samples.filter(P.has_coordinates()).agg(
        F.min("latitude"), F.max("latitude"), F.min("longitude"), F.max("longitude")).first()
    return tuple(row)


def grid(samples: DataFrame, metres: float, edge: str = "overshoot") -> DataFrame:
    """Grid over the extent of the samples with a resolution in metres."""
    bounds = extent_of(samples)
    return grid_points(samples.sparkSession, bounds, *steps_for_metres(metres, bounds[0], bounds[1]), edge)


def nearest_hole(points: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """Points with the distance to the nearest hole; references are distinct locations."""
    sites = locations(samples).withColumn("site", point_id())
    near = nearest(as_targets(points, key), as_references(sites, "site"), 1)
    return points.join(near.select(F.col("t_id").alias(key), F.col("distance").alias("distance_to_nearest_hole")), key, "left")


def cluster_kmeans(points: DataFrame, columns: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """k-means labels as column ``cluster``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="skip").transform(points)
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(vectors)
    return model.transform(vectors).drop("_features")


def cluster_summary(labelled: DataFrame, value: str = "value", label: str = "cluster") -> DataFrame:
    """Size, value statistics and centroid per cluster; noise (-1) is left out."""
    return labelled.filter(F.col(label) >= 0).groupBy(label).agg(
        F.count("*").alias("size"), F.avg(value).alias("mean_value"), F.stddev_pop(value).alias("std_value"),
        F.avg("latitude").alias("centroid_lat"), F.avg("longitude").alias("centroid_lon"),
        F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def cluster_dbscan(points: DataFrame, columns: list[str], eps: float, min_samples: int = 5) -> DataFrame:
    """DBSCAN labels as column ``cluster`` (noise -1); a point counts itself.

    Equal points are merged and carry their number. Space is cut into cells so
    small that any two points of a cell are neighbours. A cell with
    ``min_samples`` points is a cluster part as a whole: its points are core and
    connected, and no pairs are formed inside it or between two such cells. Only
    the points of thin cells (fewer than ``min_samples``) are compared one by one.
    """
    known = points.dropna(subset=columns)
    side = eps / math.sqrt(len(columns)) * (1 - 1e-9)
    cell = F.concat_ws(",", *[F.floor(F.col(c) / side).cast("string") for c in columns])
    sites = keep(known.groupBy(*columns).agg(F.count("*").alias("n")).withColumns({
        "id": F.concat_ws(",", *[F.col(c).cast("string") for c in columns]), "cell": cell}))
    dense = keep(sites.groupBy("cell").agg(F.sum("n").alias("_n")).filter(F.col("_n") >= min_samples).select("cell", F.lit(True).alias("dense")))
    marked = keep(sites.join(dense, "cell", "left").withColumn("dense", F.coalesce("dense", F.lit(False))))

    def tagged(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{tag}_{c}") for c in (*columns, "id", "cell", "n", "dense")])

    near = cell_join(
        tagged(marked.filter("NOT dense"), "a"), tagged(marked, "b"), {(f"a_{c}", f"b_{c}"): side for c in columns},
        reach=math.ceil(math.sqrt(len(columns))))
    gap = sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in columns), F.lit(0.0))
    # a dense cell is one node: what counts is how many of its points are near
    node = F.when(F.col("b_dense"), F.concat(F.lit("cell:"), F.col("b_cell"))).otherwise(F.col("b_id"))
    edges = keep(near.filter(F.sqrt(gap) <= eps).groupBy("a_id", node.alias("b"), F.col("b_dense").alias("whole")).agg(F.sum("b_n").alias("n")))
    thin_core = keep(edges.groupBy("a_id").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_samples).select("a_id"))
    from_core = edges.join(thin_core, "a_id", "left_semi")
    among = from_core.filter("NOT whole").join(thin_core.withColumnRenamed("a_id", "b"), "b", "left_semi").select("a_id", "b")
    to_cells = from_core.filter("whole").select("a_id", "b")
    cell_links = _dense_links(marked.filter("dense"), columns, side, eps).select(
        F.concat(F.lit("cell:"), F.col("a")).alias("a_id"), F.concat(F.lit("cell:"), F.col("b")).alias("b"))
    one_way = among.unionByName(to_cells).unionByName(cell_links)
    links = keep(one_way.unionByName(one_way.select(F.col("b").alias("a_id"), F.col("a_id").alias("b"))).distinct())
    nodes = thin_core.select(F.col("a_id").alias("id")).unionByName(dense.select(F.concat(F.lit("cell:"), F.col("cell")).alias("id")))
    labels = _components(nodes, links)

    numbers = row_numbers(labels.select("label").distinct(), [], ["label"], "_k").select("label", (F.col("_k") - 1).alias("cluster"))
    named = keep(labels.join(numbers, "label").select("id", "cluster"))
    # a border point takes the smallest label among its core neighbours
    border = edges.join(named.withColumnRenamed("id", "b"), "b").groupBy(F.col("a_id").alias("id")).agg(F.min("cluster").alias("_border"))
    own = F.when(F.col("dense"), F.concat(F.lit("cell:"), F.col("cell"))).otherwise(F.col("id"))
    placed = (
        marked.withColumn("_own", own).join(named.select(F.col("id").alias("_own"), "cluster"), "_own", "left").join(border, "id", "left")
        .select(*columns, F.coalesce("cluster", "_border", F.lit(-1).cast("long")).alias("cluster")))
    return known.join(placed, columns)


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest reachable node per node, as ``label``.

    Labels spread along links and jump to the label's own label, until none
    changes. Each round is written, which also ends its lineage.
    """
    labels = nodes.select("id", F.col("id").alias("label"))
    while True:
        lowest = links.join(labels.select(F.col("id").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a_id").alias("id")).agg(F.min("l").alias("l"))
        spread = labels.join(lowest, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("l", "label")).alias("label"))
        jump = spread.select(F.col("id").alias("label"), F.col("label").alias("next"))
        moved = keep(spread.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        labels = moved.select("id", "label")
        if moved.filter(F.col("old") != F.col("label")).isEmpty():
            return labels


def _dense_links(dense: DataFrame, columns: list[str], side: float, eps: float, levels: int = 16) -> DataFrame:
    """Pairs (a, b) of dense cells that have two points within ``eps``.

    A pair of cells is decided by the bounding boxes of its points: linked if
    even the farthest corners are within ``eps``, apart if the boxes are. Only
    undecided pairs go on to the boxes of their halves, and a pair is dropped as
    soon as one of its boxes links it. A box of one point is always decided.
    """
    finest = side / 2**levels
    at = {f"p{i}": F.floor(F.col(c) / side) for i, c in enumerate(columns)}
    deep = {f"q{i}": F.least(F.lit(2**levels - 1), F.floor((F.col(c) - F.col(f"p{i}") * side) / finest)) for i, c in enumerate(columns)}
    leaf = keep(dense.withColumns(at).withColumns(deep).select("cell", *columns, *at, *deep))

    def boxes(level: int, tag: str) -> DataFrame:
        key = F.concat_ws(",", *[F.shiftright(q, levels - level).cast("string") for q in deep])
        parent = F.concat_ws(",", *[F.shiftright(q, levels - level + 1).cast("string") for q in deep])
        grouped = leaf.groupBy(F.col("cell").alias(tag), *( [key.alias(f"{tag}_box"), parent.alias(f"{tag}_parent")] if level else [])).agg(
            *[F.min(c).alias(f"{tag}_lo{i}") for i, c in enumerate(columns)], *[F.max(c).alias(f"{tag}_hi{i}") for i, c in enumerate(columns)],
            *[F.first(p).alias(f"{tag}_{p}") for p in (at if not level else [])])
        return grouped if level else grouped.withColumn(f"{tag}_box", F.lit("0"))

    def measured(pairs: DataFrame) -> DataFrame:
        near, far = F.lit(0.0), F.lit(0.0)
        for i in range(len(columns)):
            lo1, hi1, lo2, hi2 = (F.col(f"{t}_{e}{i}") for t in ("a", "b") for e in ("lo", "hi"))
            n = F.greatest(lo1 - hi2, lo2 - hi1, F.lit(0.0))
            f = F.greatest(hi1 - lo2, hi2 - lo1)
            near, far = near + n * n, far + f * f
        return pairs.select("a", "b", "a_box", "b_box", (F.sqrt(far) <= eps).alias("linked"), (F.sqrt(near) <= eps).alias("open")).filter("open")

    a, b = boxes(0, "a"), boxes(0, "b")
    met = cell_join(a, b, {(f"a_p{i}", f"b_p{i}"): 1.0 for i in range(len(columns))}, reach=math.ceil(math.sqrt(len(columns))))
    state = keep(measured(met.filter(F.col("a") < F.col("b"))))
    linked = state.filter("linked").select("a", "b").distinct()
    for level in range(1, levels + 1):
        done = state.filter("linked").select("a", "b").distinct()
        open_pairs = keep(state.filter("NOT linked").join(done, ["a", "b"], "left_anti").select(
            "a", "b", F.col("a_box").alias("a_parent"), F.col("b_box").alias("b_parent")))
        if open_pairs.isEmpty():
            return linked
        parents = ["a", "a_parent"], ["b", "b_parent"]
        state = keep(measured(open_pairs.join(boxes(level, "a"), parents[0]).join(boxes(level, "b"), parents[1])))
        linked = linked.unionByName(state.filter("linked").select("a", "b").distinct())
    # points this close together are compared one by one
    undecided = state.filter("NOT linked").select("a", "b", "a_box", "b_box")

    def members(tag: str) -> DataFrame:
        box = F.concat_ws(",", *[F.col(q).cast("string") for q in deep])
        return leaf.select(F.col("cell").alias(tag), box.alias(f"{tag}_box"), *[F.col(c).alias(f"{tag}_x{i}") for i, c in enumerate(columns)])

    both = undecided.join(members("a"), ["a", "a_box"]).join(members("b"), ["b", "b_box"])
    gap = sum(((F.col(f"a_x{i}") - F.col(f"b_x{i}")) * (F.col(f"a_x{i}") - F.col(f"b_x{i}")) for i in range(len(columns))), F.lit(0.0))
    return linked.unionByName(both.filter(F.sqrt(gap) <= eps).select("a", "b")).distinct()


def grade_continuity(samples: DataFrame, metres: float, limit: int | None = None) -> DataFrame:
    """Grade differences between samples of an element up to a distance apart.

    Each sample counts with itself and every pair in both directions. The
    samples are cut into ranges of grade, each of which one task reads: it adds
    up the differences inside its range (:mod:`corelode.operators.continuity`)
    and sends one row of sums per site. Blocks of sites then meet for the
    differences between ranges, so a sample is shuffled once, however many are
    near it. ``limit`` is the number of samples of a range and sites of a block.
    """
    spark = samples.sparkSession
    valid = samples.filter(P.valid_sample() & F.col("Element").isNotNull())
    spread = keep(valid.groupBy("Element").agg(F.stddev_pop(GRADE).alias("std"), F.count("*").alias("samples")))
    total = spread.agg(F.sum("samples")).first()[0] or 0
    rows = limit or limit_of(spark, "levelsPerRange", LEVELS_PER_RANGE)
    cores = spark.sparkContext.defaultParallelism
    ranges = max(1, math.ceil(total / rows), min(cores, math.ceil(total / LEAST_RANGE)), min(4 * cores, math.ceil(total / GOOD_RANGE)))
    km = metres / 1000

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return site_sums(batches, TaskContext.get().partitionId(), km, rows)

    levels = valid.select("Element", "latitude", "longitude", F.col(GRADE).cast("double").alias("g"))
    sums = keep(levels.repartitionByRange(ranges, "Element", "g", "latitude", "longitude").mapInArrow(
        inside, "Element string, latitude double, longitude double, part int, n double, sum double, lo double, hi double, difference double"))
    parts = F.sort_array(F.collect_list(F.struct("part", F.col("n").alias("counts"), F.col("sum").alias("sums"))))
    sites = keep(sums.groupBy("Element", "latitude", "longitude").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), parts.alias("_parts"))
        .withColumns({c: F.col(f"_parts.{c}") for c in ("part", "counts", "sums")}).drop("_parts"))
    held = sites.agg(F.count("*"), F.sum(F.size("part"))).first()
    per_block = limit or max(1, min(SITES_PER_BLOCK, VALUES_PER_BLOCK * held[0] // max(held[1] or 0, 1)))

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [block_differences(a, b, km) for a, b in _block_rows([batch])]
            times = batch.column("directions").to_pylist()
            columns = [[f[i] * n for f, n in zip(found, times)] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("Element"), *[pa.array(c, pa.float64()) for c in (*columns, [f[2] for f in found])]], names=["Element", "difference", "pairs", "greatest"])

    pairs = block_pairs(sites, km, ["n", "lo", "hi", "part", "counts", "sums"], per_block, 8, ["Element"], once=True)
    # a pair of two blocks stands for both directions
    twice = pairs.select("Element", F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0).alias("directions"), "a_rows", "b_rows")
    totals = twice.mapInArrow(between, "Element string, difference double, pairs double, greatest double").groupBy("Element").agg(
        F.sum("difference").alias("between"), F.sum(F.col("pairs").cast("long")).alias("pairs_within_threshold"),
        F.max("greatest").alias("max_grade_difference"))
    own = sums.groupBy("Element").agg(F.sum("difference").alias("inside"))
    mean = (F.col("between") + F.col("inside")) / F.col("pairs_within_threshold")
    return totals.join(own, "Element").join(spread, "Element").filter("samples > 1").select(
        "Element", mean.alias("mean_grade_difference"), "max_grade_difference",
        (1 - F.try_divide(mean, F.col("std"))).alias("continuity_coefficient"), "pairs_within_threshold",
        (F.col("samples") * (F.col("samples") - 1) / 2).cast("long").alias("total_possible_pairs"))
