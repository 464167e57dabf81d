"""Joins on nearness: depth bands, distances and nearest neighbours.

All of them cut space (or depth) into cells and join on the cell, so that only
rows close to each other meet. Rows that share a coordinate are merged into one
location first, because samples of a hole share its collar.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelode.functions import scalars as S
from corelode.session import keep, limit_of

# locations one task may hold for one cell before the cell is split
ROWS_PER_CELL = 2_000
# pairs of a visiting row and a row that one piece of a cell may have before both sides are split
PAIRS_PER_PIECE = 20_000_000
# the same where every pair is a row of the result
MATRIX_PER_PIECE = 5_000_000
# most partitions of such a join
PIECE_PARTITIONS = 20_000
# Fixed value: the mean radius of the earth.
EARTH_KM = 6371.0
# cells that may be sent to every task (level n has at most 16 ** n)
BROADCAST_CELLS = 100_000


def locations(df: DataFrame, *aggregates: Column) -> DataFrame:
    """One row per coordinate pair with the given aggregates."""
    located = df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    if aggregates:
        return located.groupBy("latitude", "longitude").agg(*aggregates)
    return located.select("latitude", "longitude").distinct()


def _cell(c: str | Column, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size)


def cell_join(
    left: DataFrame, right: DataFrame, sizes: dict[tuple[str, str], float], equal: Sequence[str] = (),
    per_cell: int | None = None, reach: int = 1, per_piece: int | None = None,
) -> DataFrame:
    """Rows of both sides in the same or in near cells.

    ``sizes`` maps (left column, right column) to the cell size along it; the
    distance sought must not exceed ``reach`` cells. A left row visits the cells
    around its own, a right row has one cell, so each pair meets once. Right
    cells with more than ``per_cell`` rows are split by a hash, and the left rows
    that visit such a cell visit all its pieces; other cells are left alone.

    ``per_piece`` also bounds the pairs that meet in one piece, splitting both
    sides by hashes, and deals the pieces to as many tasks as there are: the
    bytes of the sides say little about the pairs.
    """
    spark = left.sparkSession
    per_cell = per_cell or limit_of(spark, "rowsPerCell", ROWS_PER_CELL)
    names = [f"_c{i}" for i in range(len(sizes))]
    around = range(-reach, reach + 1)
    one = right.withColumns({n: _cell(r, size) for n, ((_, r), size) in zip(names, sizes.items())})
    many = left
    for n, ((l, _), size) in zip(names, sizes.items()):
        many = many.withColumn(n, F.explode(F.array(*[_cell(l, size) + d for d in around])))
    on = [*equal, *names]
    if per_piece is not None:
        return _pieced(many, one, left.columns, right.columns, on, per_cell, per_piece).drop(*[c for c in on if c not in equal])
    crowded = keep(one.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > per_cell).select(
        *on, F.ceil(F.col("_n") / per_cell).alias("_pieces")))
    if not crowded.isEmpty():
        one = one.join(crowded, on, "left").withColumn(
            "_piece", F.pmod(F.xxhash64(*[F.col(c) for c in right.columns]), F.coalesce("_pieces", F.lit(1).cast("long")))).drop("_pieces")
        many = many.join(crowded, on, "left").withColumn(
            "_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_pieces", F.lit(1).cast("long")) - 1))).drop("_pieces")
        on = [*on, "_piece"]
    return many.join(one, on).drop(*[c for c in on if c not in equal])


def _pieced(many: DataFrame, one: DataFrame, of_many: Sequence[str], of_one: Sequence[str], on: Sequence[str], per_cell: int, per_piece: int) -> DataFrame:
    """Rows of both sides with the same cell, where a cell with many rows or pairs is cut along both sides.

    With rows n and visitors m, a cell needs n * m / per_piece pieces. Cutting the
    rows into about sqrt(pieces * n / m) parts copies the fewest rows; each part of
    the one side meets each part of the other once.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*on).agg(F.count("*").cast("double").alias(name))

    pieces = F.ceil(F.col("_n") * F.col("_m") / per_piece)
    cells = counted(one, "_n").join(counted(many, "_m"), on)
    work = keep(cells.withColumn("_q", F.greatest(F.ceil(F.col("_n") / per_cell), F.ceil(F.sqrt(pieces * F.col("_n") / F.col("_m")))))
                .select(*on, "_q", F.ceil(pieces / F.col("_q")).alias("_p")))
    total = work.agg(F.sum(F.col("_q") * F.col("_p"))).first()[0]
    crowded = work.filter("_q > 1 OR _p > 1")
    if crowded.isEmpty():
        return many.join(one, on).drop("_q", "_p")
    counts = [F.coalesce(c, F.lit(1).cast("long")) for c in ("_q", "_p")]
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), c - 1))
    part = lambda columns, c: F.pmod(F.xxhash64(*[F.col(x) for x in columns]), c)
    one = one.join(crowded, on, "left").withColumn("_piece", part(of_one, counts[0])).withColumn("_share", every(counts[1]))
    many = many.join(crowded, on, "left").withColumn("_share", part(of_many, counts[1])).withColumn("_piece", every(counts[0]))
    keys = [*on, "_piece", "_share"]
    partitions = min(max(int(total), one.sparkSession.sparkContext.defaultParallelism), PIECE_PARTITIONS)
    one, many = (df.drop("_q", "_p").repartition(partitions, *keys) for df in (one, many))
    return many.join(one, keys).drop("_piece", "_share")


def _every_pair(left: DataFrame, right: DataFrame, per_cell: int | None, per_piece: int) -> DataFrame:
    """Every left row with every right row, in pieces of bounded rows and pairs."""
    per_cell = per_cell or limit_of(left.sparkSession, "rowsPerCell", ROWS_PER_CELL)
    many, one = (df.withColumn("_all", F.lit(0)) for df in (left, right))
    return _pieced(many, one, left.columns, right.columns, ["_all"], per_cell, per_piece).drop("_all")


def distance_pairs(
    left: DataFrame, right: DataFrame, max_degrees: float | None = None, metric: str = "euclidean", per_cell: int | None = None,
) -> DataFrame:
    """Every pair of a left and a right point with its distance in degrees
    (euclidean, manhattan), or those up to ``max_degrees``. ``left`` has a_id,
    a_lat, a_lon and ``right`` b_id, b_lat, b_lon; further columns are carried
    along."""
    measure = {"euclidean": S.degrees_apart, "manhattan": S.manhattan_apart}
    if metric not in measure:
        raise ValueError(f"unsupported metric {metric}")
    d = measure[metric](*[F.col(c) for c in ("a_lat", "a_lon", "b_lat", "b_lon")])
    per_piece = limit_of(left.sparkSession, "pairsPerPiece", MATRIX_PER_PIECE if max_degrees is None else PAIRS_PER_PIECE)
    if max_degrees is None:
        return _every_pair(left, right, per_cell, per_piece).withColumn("distance", d)
    near = cell_join(left, right, {("a_lat", "b_lat"): max_degrees, ("a_lon", "b_lon"): max_degrees}, per_cell=per_cell, per_piece=per_piece)
    return near.withColumn("distance", d).filter(F.col("distance") <= max_degrees)


def pairs_within_km(left: DataFrame, right: DataFrame, max_km: float, per_cell: int | None = None) -> DataFrame:
    """The same for great-circle kilometres, anywhere on the globe.

    Points meet in cells of the space around the globe, whose side is the chord
    of the distance: longitudes that meet at 180 degrees and the poles need no
    case of their own.
    """
    def placed(df: DataFrame, tag: str) -> DataFrame:
        lat, lon = F.radians(f"{tag}_lat"), F.radians(f"{tag}_lon")
        return df.withColumns({f"_{tag}x": F.cos(lat) * F.cos(lon), f"_{tag}y": F.cos(lat) * F.sin(lon), f"_{tag}z": F.sin(lat)})

    side = max(2 * math.sin(min(max_km / EARTH_KM / 2, math.pi / 2)) * (1 + 1e-6), 1e-9)
    near = cell_join(placed(left, "a"), placed(right, "b"), {(f"_a{c}", f"_b{c}"): side for c in "xyz"}, per_cell=per_cell,
                     per_piece=limit_of(left.sparkSession, "pairsPerPiece", PAIRS_PER_PIECE))
    # the straight way rules most pairs out without an angle; it has the slack of the cells
    straight = sum(((F.col(f"_a{c}") - F.col(f"_b{c}")) * (F.col(f"_a{c}") - F.col(f"_b{c}")) for c in "xyz"), F.lit(0.0))
    near = near.filter(straight <= side * side * (1 + 1e-6))
    d = S.haversine_km(*[F.col(c) for c in ("a_lat", "a_lon", "b_lat", "b_lon")])
    return near.drop(*[f"_{tag}{c}" for tag in "ab" for c in "xyz"]).withColumn("distance", d).filter(F.col("distance") <= max_km)


def block_pairs(points: DataFrame, max_km: float, columns: Sequence[str], per_block: int, per_task: int, equal: Sequence[str] = (), once: bool = False) -> DataFrame:
    """Blocks of points that may hold pairs up to a distance apart: ``equal``, a, b and the arrays a_rows and b_rows.

    A block holds about ``per_block`` rows (latitude, longitude and ``columns``,
    in order) of one cell of :func:`pairs_within_km`; crowded cells have several.
    Each pair of blocks comes in both orders, or once, and a block with itself once. A
    partition has about the rows of ``per_task`` pairs of full blocks, so what a task
    holds and does is bounded, and no pair of points is a row.
    """
    side = max(2 * math.sin(min(max_km / EARTH_KM / 2, math.pi / 2)) * (1 + 1e-6), 1e-9)
    lat, lon = F.radians("latitude"), F.radians("longitude")
    cell = ["_cx", "_cy", "_cz"]
    placed = points.withColumns(dict(zip(cell, [_cell(c, side) for c in (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))])))
    on, held = [*equal, *cell], ["latitude", "longitude", *columns]
    pieces = placed.groupBy(*on).agg(F.ceil(F.count("*") / per_block).alias("_pieces"))
    blocks = keep(
        placed.join(pieces, on)
        .withColumn("_piece", F.pmod(F.xxhash64(*held), "_pieces")).groupBy(*on, "_piece")
        .agg(F.sort_array(F.collect_list(F.struct(*held))).alias("rows")).withColumn("block", F.monotonically_increasing_id()))
    named = blocks.select("block", *on, F.size("rows").alias("_b"))
    visits = named.withColumnsRenamed({"block": "a", "_b": "_a"})
    for c in cell:
        visits = visits.withColumn(c, F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])))
    met = keep(visits.join(named.withColumnRenamed("block", "b"), on).filter(F.lit(not once) | (F.col("a") <= F.col("b"))).select("a", "b", (F.col("_a") + F.col("_b")).alias("_rows")))
    pairs, rows = met.agg(F.count("*"), F.sum("_rows")).first()
    tasks = max(1, math.ceil((rows or 0) / (2 * per_block * per_task)), min(math.ceil(pairs / per_task), points.sparkSession.sparkContext.defaultParallelism))
    met = met.drop("_rows")

    def side_of(tag: str, more: Sequence[str] = ()) -> DataFrame:
        rows = blocks.select(*more, F.col("block").alias(tag), F.col("rows").alias(f"{tag}_rows"))
        return rows.join(met, tag).repartition(tasks, "a", "b")

    return side_of("a", equal).join(side_of("b"), ["a", "b"])


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def within_km(a: np.ndarray, b: np.ndarray, limits: Sequence[float], vectors: tuple[np.ndarray, np.ndarray] | None = None) -> list[np.ndarray]:
    """For every limit, whether each of ``a`` and ``b`` (rows of latitude and longitude, with their ``vectors`` if known) lie that near.

    The straight distance decides where it is clear, the great circle next to a limit. A limit of zero is the same place.
    """
    u, v = vectors or (unit_vectors(*a.T), unit_vectors(*b.T))
    cosine = u @ v.T
    found = []
    for km in limits:
        gap = 2 * math.sin(min(km / EARTH_KM / 2, math.pi / 2)) ** 2
        slack = 1e-8 * gap + 1e-14
        near = cosine >= 1 - gap + slack
        i, j = np.divmod(np.flatnonzero(near ^ (cosine >= 1 - gap - slack)), cosine.shape[1])
        y, x, v, u = (np.radians(c) for c in (a[i, 0], a[i, 1], b[j, 0], b[j, 1]))
        h = np.sin((v - y) / 2) ** 2 + np.cos(y) * np.cos(v) * np.sin((u - x) / 2) ** 2
        near[i, j] = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1.0))) <= km
        found.append(near)
    return found


def nearest(
    targets: DataFrame, references: DataFrame, k: int, max_distance: float | None = None, per_cell: int = 64,
) -> DataFrame:
    """The ``k`` nearest references (r_id, r_lat, r_lon) of each target (t_id, t_lat, t_lon).

    Returns t_id, r_id, distance (degrees), position (1..k); equal distances are
    ordered by r_id.

    References are counted in nested square cells, four to a side. Every target
    starts with the one cell around everything and moves down level by level: it
    keeps a cell only if the cell could hold one of its ``k`` nearest, that is,
    if the cell's near edge is not beyond the distance within which ``k``
    references are sure to lie. So a target meets a few cells per level and a
    few references at the end, wherever it lies and however dense they are.
    """
    box = references.agg(F.min("r_lat"), F.max("r_lat"), F.min("r_lon"), F.max("r_lon")).first()
    if box[0] is None:
        empty = targets.select(F.col("t_id"), F.lit(None).cast("string").alias("r_id"))
        return empty.filter(F.lit(False)).withColumn("distance", F.lit(0.0)).withColumn("position", F.lit(0).cast("long"))
    south, west = box[0], box[2]
    extent = max(box[1] - south, box[3] - west, 1e-9) * 1.000001
    depth = _levels(references, south, west, extent, per_cell)
    size = extent / 4**depth
    leaf = keep(references.select(
        "r_id", "r_lat", "r_lon",
        F.floor((F.col("r_lat") - south) / size).alias("x"), F.floor((F.col("r_lon") - west) / size).alias("y")))
    leaves = keep(leaf.groupBy("x", "y").agg(F.count("*").alias("n")))

    front = targets.select("t_id", "t_lat", "t_lon", F.lit(0).cast("long").alias("px"), F.lit(0).cast("long").alias("py"))
    by_far = Window.partitionBy("t_id").orderBy("_far", "x", "y").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("t_id")
    for level in range(1, depth + 1):
        shift, width = 2 * (depth - level), size * 4 ** (depth - level)
        cells = leaves.groupBy(F.shiftright("x", shift).alias("x"), F.shiftright("y", shift).alias("y")).agg(F.sum("n").alias("n"))
        cells = cells.withColumn("px", F.shiftright("x", 2)).withColumn("py", F.shiftright("y", 2))
        if 16**level <= BROADCAST_CELLS:
            # all targets share few parents here; the cells are few by construction
            cells = F.broadcast(cells)
        met = front.join(cells, ["px", "py"]).withColumns(_reach(south, west, width))
        if max_distance is not None:
            met = met.filter(F.col("_near") <= max_distance)
        sure = met.withColumn("_sum", F.sum("n").over(by_far)).withColumn(
            "_bound", F.min(F.when(F.col("_sum") >= k, F.col("_far"))).over(whole))
        front = sure.filter(F.col("_bound").isNull() | (F.col("_near") <= F.col("_bound"))).select(
            "t_id", "t_lat", "t_lon", F.col("x").alias("px"), F.col("y").alias("py"))
    met = front.join(leaf.withColumnsRenamed({"x": "px", "y": "py"}), ["px", "py"])
    met = met.withColumn("distance", S.degrees_apart(*[F.col(c) for c in ("t_lat", "t_lon", "r_lat", "r_lon")]))
    if max_distance is not None:
        met = met.filter(F.col("distance") <= max_distance)
    order = Window.partitionBy("t_id").orderBy("distance", "r_id")
    return met.withColumn("position", F.row_number().over(order).cast("long")).filter(
        F.col("position") <= k).select("t_id", "r_id", "distance", "position")


def _levels(references: DataFrame, south: float, west: float, extent: float, per_cell: int, deepest: int = 14) -> int:
    """The fewest levels after which no cell holds more than ``per_cell`` references."""
    finest = extent / 4**deepest
    x, y = F.floor((F.col("r_lat") - south) / finest), F.floor((F.col("r_lon") - west) / finest)
    crowd = (
        references.select(x.alias("x"), y.alias("y")).groupBy("x", "y").agg(F.count("*").alias("n"))
        .select("n", F.posexplode(F.array(*[
            F.struct(F.shiftright("x", 2 * (deepest - d)).alias("x"), F.shiftright("y", 2 * (deepest - d)).alias("y"))
            for d in range(deepest + 1)])).alias("d", "c"))
        .groupBy("d", "c").agg(F.sum("n").alias("n")).groupBy("d").agg(F.max("n").alias("n"))
        .filter(F.col("n") <= per_cell).agg(F.min("d")).first()[0]
    )
    return deepest if crowd is None else int(crowd)


def _reach(south: float, west: float, width: float) -> dict[str, Column]:
    """Least and greatest distance from a target to any point of a cell."""
    slack = width * 1e-9
    near, far = [], []
    for t, c, origin in (("t_lat", "x", south), ("t_lon", "y", west)):
        low = F.col(c) * width + (origin - slack)
        high = low + (width + 2 * slack)
        near.append(F.greatest(low - F.col(t), F.col(t) - high, F.lit(0.0)))
        far.append(F.greatest(F.abs(F.col(t) - low), F.abs(F.col(t) - high)))
    return {name: F.sqrt(a * a + b * b) for name, (a, b) in (("_near", near), ("_far", far))}


def element_pairs(samples: DataFrame, tolerance: float = 0.1, centres: DataFrame | None = None) -> DataFrame:
    """Pairs of elements measured over (nearly) the same interval of a hole.

    Rows of one hole, interval and element are summed before the join, so
    repeated measurements do not multiply. A row carries what the pair
    statistics need: the number of sample pairs and their sums. Grades count
    from ``centres`` (element, mean grade) where given: sums of squares of large
    numbers would lose the small differences between them.
    """
    g = F.col("standardized_grade_ppm")
    valid = samples.filter((g > 0) & F.col("Depth_From").isNotNull() & F.col("Depth_To").isNotNull())
    if centres is not None:
        as_map = centres.agg(F.map_from_entries(F.collect_list(F.struct("Element", "mean")))).scalar()  # a row per element
        valid = valid.withColumn("standardized_grade_ppm", g - F.element_at(as_map, F.col("Element")))
    sums = valid.groupBy("Hole_ID", "Depth_From", "Depth_To", "Element").agg(
        F.count("*").alias("n"), F.sum(g).alias("s"), F.sum(g * g).alias("q"),
        F.bool_or(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("located"),
    )

    def side(tag: str) -> DataFrame:
        return sums.select("Hole_ID", *[F.col(c).alias(f"{c}{tag}") for c in sums.columns if c != "Hole_ID"])

    left, right = side("1").filter("located1"), side("2")
    near = cell_join(left, right, {("Depth_From1", "Depth_From2"): tolerance}, equal=["Hole_ID"])
    return near.filter(
        (F.col("Element1") < F.col("Element2"))
        & (F.abs(F.col("Depth_From1") - F.col("Depth_From2")) < tolerance)
        & (F.abs(F.col("Depth_To1") - F.col("Depth_To2")) < tolerance)
    ).select(
        "Hole_ID", F.col("Element1").alias("element1"), F.col("Element2").alias("element2"),
        "Depth_From1", "Depth_To1", "Depth_From2", "Depth_To2",
        (F.col("n1") * F.col("n2")).alias("pairs"),
        (F.col("s1") * F.col("n2")).alias("sum1"), (F.col("s2") * F.col("n1")).alias("sum2"),
        (F.col("q1") * F.col("n2")).alias("square1"), (F.col("q2") * F.col("n1")).alias("square2"),
        (F.col("s1") * F.col("s2")).alias("product"),
    )


def element_correlations(samples: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Number of pairs, mean grades and Pearson correlation per element pair."""
    g = F.col("standardized_grade_ppm")
    centres = samples.filter((g > 0) & F.col("Element").isNotNull()).groupBy("Element").agg(F.avg(g).alias("mean"))
    pairs = element_pairs(samples, tolerance, centres)
    total = pairs.groupBy("element1", "element2").agg(*[
        F.sum(c).alias(c) for c in ("pairs", "sum1", "sum2", "square1", "square2", "product")])
    back = total.withColumns({
        f"mean{i}": F.element_at(centres.agg(F.map_from_entries(F.collect_list(F.struct("Element", "mean")))).scalar(), F.col(f"element{i}")) for i in (1, 2)})
    n, x, y = F.col("pairs"), F.col("sum1"), F.col("sum2")
    below = F.sqrt(n * F.col("square1") - x * x) * F.sqrt(n * F.col("square2") - y * y)
    return back.select(
        "element1", "element2", n.alias("sample_count"), (x / n + F.col("mean1")).alias("avg_grade1"), (y / n + F.col("mean2")).alias("avg_grade2"),
        F.try_divide(n * F.col("product") - x * y, below).alias("correlation"),
    )
