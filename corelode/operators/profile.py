"""Summaries and pivots of the sample relation. Each is one aggregation."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelode.functions import predicates as P
from corelode.functions import scalars as S
from corelode.functions.predicates import GRADE
from corelode.operators.ordered import join_on
from corelode.schema import EPSILON, INTERVAL_TOLERANCE
from corelode.session import keep

ROWS = "*"


def _grade_stats(column: str = GRADE, spread: bool = True) -> list[Column]:
    stats = [
        F.avg(column).alias("avg_grade"), F.min(column).alias("min_grade"), F.max(column).alias("max_grade"),
    ]
    return [*stats, F.stddev_samp(column).alias("std_grade")] if spread else stats


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def percent_decimal(part: Column, whole: Column) -> Column:
    return percent(part, whole).cast("decimal(5,2)")


def elements_summary(samples: DataFrame) -> DataFrame:
    return samples.filter(P.positive_grade()).groupBy("Element").agg(
        F.count(ROWS).alias("total_records"),
        F.count_distinct("Hole_ID").alias("unique_holes"),
        F.count_distinct("SampleID").alias("unique_samples"),
        *_grade_stats(),
    )


def element_statistics(samples: DataFrame) -> DataFrame:
    return elements_summary(samples).withColumns({
        "coefficient_of_variation": F.try_divide("std_grade", "avg_grade"),
        "records_per_hole": F.try_divide("total_records", "unique_holes"),
    })


# Different values of the grouping columns, together, up to which a value's groups are bits of words of 63.
BITS = 63 * 8


def _groups_met(present: DataFrame, values: str, masked: DataFrame, columns: list[str], words: list[str], bits: DataFrame) -> DataFrame:
    """(bit, different values of the column in the group of that bit); bit -1 counts all of them.

    A row enters once, whatever the number of groupings: the bits of a value's
    rows are OR-ed, values of the same bits are counted, and only these few rows
    are taken apart.
    """
    met = join_on(present.select(*columns, F.col(values).alias("_value")).filter("_value IS NOT NULL"), masked, columns)
    masks = met.groupBy("_value").agg(*[F.bit_or(w).alias(w) for w in words]).groupBy(*words).agg(F.count(ROWS).alias("n"))
    word = F.array(*words)[F.col("bit").cast("int") % len(words)]
    held = masks.join(bits, word.bitwiseAND(F.col("flag")) != 0).groupBy("bit").agg(F.sum("n").alias("n"))
    return held.unionByName(masks.agg(F.lit(-1).cast("long").alias("bit"), F.sum("n").alias("n")))


def data_summary(samples: DataFrame) -> DataFrame:
    """Totals and summaries by element, dataset and lab: grouping sets, of which the different
    holes and samples are counted apart (:func:`_groups_met`), so that no copy of a row is shuffled for them."""
    columns = ["Element", "DataSet", "LabCode"]
    present = samples.filter(F.col(GRADE).isNotNull())
    combos = keep(present.select(*columns).distinct())
    values = sum(combos.agg(*[F.count_distinct(F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit(""))) for c in columns]).first())
    if values > BITS:
        return _data_summary_expanded(present)
    return _data_summary_by_bits(present, columns, combos, max(1, -(-values // 63)))


def _level() -> Column:
    level = F.grouping_id()
    return F.when(level == 3, "element").when(level == 5, "dataset").when(level == 6, "lab").otherwise("total").alias("level")


def _data_summary_by_bits(present: DataFrame, columns: list[str], combos: DataFrame, words: int) -> DataFrame:
    sets = [*[[F.col(c)] for c in columns], []]
    names = [f"_w{i}" for i in range(words)]
    every = combos.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))).distinct()
    numbered = every.withColumn("bit", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("column", "value")).cast("long") - 1)
    bits = keep(numbered.withColumn("flag", F.expr(f"shiftleft(1L, int(bit div {words}))")))
    masked = combos
    for c in columns:
        of = bits.filter(F.col("column") == c).select(F.col("value").alias("_v"), *[
            F.when(F.col("bit") % words == i, F.col("flag")).otherwise(F.lit(0).cast("long")).alias(f"_{c}{i}") for i in range(words)])
        masked = masked.join(of, F.col(c).cast("string").eqNullSafe(F.col("_v"))).drop("_v")
    merged = [reduce(lambda a, b: a.bitwiseOR(b), [F.col(f"_{c}{i}") for c in columns]).alias(n) for i, n in enumerate(names)]
    masked = keep(masked.select(*columns, *merged))  # written, so that Spark sees how small it is
    counted = None
    for column, name in (("Hole_ID", "unique_holes"), ("SampleID", "unique_samples")):
        met = _groups_met(present, column, masked, columns, names, bits).withColumnRenamed("n", name)
        counted = met if counted is None else counted.join(met, "bit", "full")
    counted = counted.join(bits, "bit", "left").select(
        F.coalesce("column", F.lit("")).alias("_column"), F.col("value").alias("_value"), "unique_holes", "unique_samples")
    level = F.grouping_id()
    column = F.when(level == 3, "Element").when(level == 5, "DataSet").when(level == 6, "LabCode").otherwise("").alias("_column")
    value = F.coalesce(*columns).alias("name")
    stats = present.groupingSets(sets, *map(F.col, columns)).agg(_level(), column, F.count(ROWS).alias("records"), *_grade_stats())
    stats = stats.select("level", "_column", value, "records", "avg_grade", "min_grade", "max_grade", "std_grade")
    elements = combos.groupingSets(sets, *map(F.col, columns)).agg(column, F.count_distinct("Element").alias("unique_elements")).select(
        "_column", value.alias("_value"), "unique_elements")
    uniques = join_on(elements, counted, ["_column", "_value"], "left")
    found = join_on(stats.withColumn("_value", F.col("name")), uniques, ["_column", "_value"])
    whole = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("unique_holes", "unique_samples")]
    return found.select("level", "name", "records", *whole, "unique_elements", "avg_grade", "min_grade", "max_grade", "std_grade")


def _data_summary_expanded(present: DataFrame) -> DataFrame:
    """The same by copies of the rows, for groupings of more values than :data:`BITS`."""
    columns = [F.col(c) for c in ("Element", "DataSet", "LabCode")]
    return present.groupingSets([*[[c] for c in columns], []], *columns).agg(
        _level(),
        F.count(ROWS).alias("records"),
        F.count_distinct("Hole_ID").alias("unique_holes"),
        F.count_distinct("SampleID").alias("unique_samples"),
        F.count_distinct("Element").alias("unique_elements"),
        *_grade_stats(),
    ).select(
        "level", F.coalesce("Element", "DataSet", "LabCode").alias("name"),
        "records", "unique_holes", "unique_samples", "unique_elements",
        "avg_grade", "min_grade", "max_grade", "std_grade",
    )


def summary_by(samples: DataFrame, group_by: str = "Element", elements=None) -> DataFrame:
    groups = {
        "Element": F.col("Element"), "DataSet": F.col("DataSet"), "LabCode": F.col("LabCode"),
        "Elevation": S.elevation_level(F.col("elevation")),
    }
    valid = samples.filter(P.all_of([P.valid_sample(), P.of_elements(elements)]))
    return valid.groupBy(groups.get(group_by, groups["Element"]).alias("group_field")).agg(
        F.count(ROWS).alias("record_count"),
        F.count_distinct("Hole_ID").alias("unique_holes"),
        *_grade_stats(),
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"),
        F.avg("elevation").alias("avg_elevation"),
    )


def spatial_extent(samples: DataFrame) -> DataFrame:
    lat, lon = F.max("latitude") - F.min("latitude"), F.max("longitude") - F.min("longitude")
    return samples.filter(P.has_coordinates()).agg(
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"),
        F.count_distinct("Hole_ID").alias("total_holes"),
        lat.alias("lat_range"), lon.alias("lon_range"), (lat * lon).alias("area_degrees"),
    )


def quality_metrics(samples: DataFrame) -> DataFrame:
    """The fourteen counts and three percentages from one scan."""
    total = F.count(ROWS)
    coords = F.count_if(P.has_coordinates())
    positive = F.count_if(P.positive_grade())
    depth = F.count_if(F.col("Depth_From").isNotNull() & F.col("Depth_To").isNotNull())
    return samples.agg(
        total.alias("total_records"),
        F.count_distinct("Hole_ID").alias("unique_holes"),
        F.count_distinct("SampleID").alias("unique_samples"),
        F.count_distinct("Element").alias("unique_elements"),
        F.count_distinct("DataSet").alias("unique_datasets"),
        F.count_distinct("LabCode").alias("unique_labs"),
        total.alias("records_with_coords"),
        coords.alias("valid_coords"),
        F.count("elevation").alias("elevation_not_null"),
        F.count(GRADE).alias("non_null_grades"),
        positive.alias("positive_grades"),
        F.count_if(F.col(GRADE) <= 0).alias("zero_negative_grades"),
        depth.alias("depth_complete"),
        F.count("Interval_Length").alias("interval_not_null"),
        percent_decimal(coords, total).alias("coord_completeness_pct"),
        percent_decimal(positive, total).alias("grade_validity_pct"),
        percent_decimal(depth, total).alias("depth_completeness_pct"),
    )


def duplicate_samples(samples: DataFrame) -> DataFrame:
    return samples.groupBy("SampleID", "Element").agg(F.count(ROWS).alias("duplicates")).filter("duplicates > 1")


def quality_check(samples: DataFrame) -> DataFrame:
    """Six named checks from one grouping on (SampleID, Element)."""
    groups = samples.groupBy("SampleID", "Element").agg(
        F.count(ROWS).alias("n"),
        F.count_if(P.has_coordinates()).alias("coords"),
        F.count_if(P.positive_grade()).alias("grades"),
        F.count_if(P.valid_sample()).alias("complete"),
        F.count("LabCode").alias("labs"),
    )
    one = groups.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "coords", "grades", "complete", "labs")],
        F.count_if(F.col("n") > 1).alias("twice"),
    )

    def row(name: str, value: str, share: bool) -> Column:
        part = percent_decimal(F.col(value), F.col("n")) if share else F.lit(None).cast("decimal(5,2)")
        return F.struct(F.lit(name).alias("check_type"), F.col(value).alias("count_value"), part.alias("percentage"))

    return one.select(F.inline(F.array(
        row("Total Records", "n", False),
        row("Records with Coordinates", "coords", True),
        row("Valid Grade Values", "grades", True),
        row("Complete Records", "complete", True),
        row("Duplicate Sample_IDs", "twice", False),
        row("Records with Lab Codes", "labs", True),
    )))


def quality_union(samples: DataFrame) -> DataFrame:
    """The same checks as a union of one-row queries."""
    total = samples.agg(F.count(ROWS).alias("total"))

    def check(name: str, rows: DataFrame, share: bool) -> DataFrame:
        counted = rows.agg(F.count(ROWS).alias("count_value"))
        part = percent_decimal(F.col("count_value"), total.scalar()) if share else F.lit(None).cast("decimal(5,2)")
        return counted.select(F.lit(name).alias("check_type"), "count_value", part.alias("percentage"))

    checks = [
        check("Total Records", samples, False),
        check("Records with Coordinates", samples.filter(P.has_coordinates()), True),
        check("Valid Grade Values", samples.filter(P.positive_grade()), True),
        check("Complete Records", samples.filter(P.valid_sample()), True),
        check("Duplicate Sample_IDs", duplicate_samples(samples), False),
        check("Records with Lab Codes", samples.filter(F.col("LabCode").isNotNull()), True),
    ]
    union = checks[0]
    for c in checks[1:]:
        union = union.unionByName(c)
    return union


def lab_summary(samples: DataFrame) -> DataFrame:
    return samples.filter(P.positive_grade()).groupBy("LabCode").agg(
        F.count(ROWS).alias("total_records"),
        F.count_distinct("Element").alias("unique_elements"),
        F.count_distinct("Hole_ID").alias("unique_holes"),
        F.count_distinct("DataSet").alias("unique_datasets"),
        *_grade_stats(spread=False),
    )


def dataset_summary(samples: DataFrame) -> DataFrame:
    return samples.filter(P.positive_grade()).groupBy("DataSet").agg(
        F.count(ROWS).alias("total_records"),
        F.count_distinct("Element").alias("unique_elements"),
        F.count_distinct("Hole_ID").alias("unique_holes"),
        F.count_distinct("LabCode").alias("unique_labs"),
        *_grade_stats(spread=False),
        F.avg("Interval_Length").alias("avg_interval"),
        F.min("Depth_From").alias("min_depth"), F.max("Depth_To").alias("max_depth"),
    )


def depth_statistics(samples: DataFrame) -> DataFrame:
    known = samples.dropna(subset=["Depth_From", "Depth_To", "Interval_Length"])
    return known.agg(
        F.count(ROWS).alias("total_records"),
        F.avg("Depth_From").alias("avg_depth_from"), F.avg("Depth_To").alias("avg_depth_to"),
        F.avg("Interval_Length").alias("avg_interval"),
        F.min("Depth_From").alias("min_depth"), F.max("Depth_To").alias("max_depth"),
        F.stddev_samp("Interval_Length").alias("std_interval"),
        F.count_if(F.col("Interval_Length") > 5).alias("long_intervals"),
        F.count_if(F.col("Interval_Length") < 1).alias("short_intervals"),
    )


def coord_completeness(collars: DataFrame) -> DataFrame:
    total = F.count(ROWS)

    def share(part: Column) -> Column:
        return F.coalesce(percent(part, total), F.lit(0.0))

    return collars.agg(
        total.alias("total_records"),
        share(F.count("LL_Lat")).alias("lat_completeness"),
        share(F.count("LL_Long")).alias("long_completeness"),
        share(F.count_if(F.col("LL_Lat").isNotNull() & F.col("LL_Long").isNotNull())).alias("coord_completeness"),
        share(F.count("Elevation")).alias("elevation_completeness"),
    )


def grade_validity(grades: DataFrame, column: str = "weighted_grade") -> DataFrame:
    g = F.col(column)
    return grades.filter(g.isNotNull()).agg(
        F.count(ROWS).alias("total_records"),
        F.coalesce(percent(F.count(g), F.count(ROWS)), F.lit(0.0)).alias("grade_completeness"),
        F.count_if(g > 0).alias("positive_grades"), F.count_if(g == 0).alias("zero_grades"),
        F.count_if(g < 0).alias("negative_grades"),
        *[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in (
            (F.avg(g), "avg_grade"), (F.min(g), "min_grade"), (F.max(g), "max_grade"))],
    )


def depth_consistency(grades: DataFrame) -> DataFrame:
    start, end, length = F.col("From_m"), F.col("To_m"), F.col("Interval_m")
    return grades.filter(start.isNotNull() & end.isNotNull()).agg(
        F.count(ROWS).alias("total_records"),
        F.coalesce(percent(F.count_if(start.isNotNull() & end.isNotNull()), F.count(ROWS)), F.lit(0.0)).alias("depth_completeness"),
        F.count_if(start >= end).alias("invalid_depth_order"),
        F.count_if(F.abs(length - (end - start)) > INTERVAL_TOLERANCE).alias("interval_mismatch"),
        *[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in (
            (F.avg(end - start), "avg_interval"), (F.min(start), "min_from_depth"), (F.max(end), "max_to_depth"))],
    )


def element_distribution(grades: DataFrame) -> DataFrame:
    return grades.filter(F.col("weighted_grade") > 0).groupBy("Element").agg(
        F.count(ROWS).alias("record_count"), F.count_distinct("Hole_ID").alias("unique_holes"),
        *_grade_stats("weighted_grade", spread=False),
    )


def element_pivot(samples: DataFrame, elements: list[str], filters=()) -> DataFrame:
    """Highest grade per hole and element beside the hole's attributes.

    The maxima are taken over every row of the hole, whichever dataset it is in;
    both sides are aggregated to holes before they are joined.
    """
    wanted = samples.filter(P.of_elements(elements))
    base = wanted.filter(P.valid_sample()).select("Hole_ID", "latitude", "longitude", "elevation", "DataSet").distinct()
    tall = P.apply_filters(wanted, filters)
    maxima = tall.groupBy("Hole_ID").pivot("Element", elements).agg(F.max(GRADE))
    return base.join(maxima, "Hole_ID")


def pivot_ratios(samples: DataFrame, elements: list[str]) -> DataFrame:
    pivoted = element_pivot(samples, elements)
    ratios = {f"{a}_{b}_ratio": S.ratio(F.col(a), F.col(b)) for a, b in combinations(elements, 2)}
    total = sum((F.coalesce(F.col(e), F.lit(0.0)) for e in elements), F.lit(0.0))
    present = sum((F.col(e).isNotNull().cast("long") for e in elements), F.lit(0).cast("long"))
    return pivoted.withColumns({**ratios, "total_grade": total, "grade_diversity": present})


def pivot_mean_features(samples: DataFrame, elements: list[str]) -> DataFrame:
    located = samples.filter(P.has_coordinates() & P.of_elements(elements))
    wide = (
        located.groupBy("Hole_ID", "latitude", "longitude").pivot("Element", elements)
        .agg(F.avg(GRADE)).fillna(0.0, subset=elements)
    )
    pairs = {}
    for a, b in combinations(elements, 2):
        pairs[f"{a}_{b}_ratio"] = F.col(a) / (F.col(b) + EPSILON)
        pairs[f"{a}_{b}_sum"] = F.col(a) + F.col(b)
    total = sum((F.col(e) for e in elements), F.lit(0.0))
    diverse = sum(((F.col(e) > 0).cast("long") for e in elements), F.lit(0).cast("long"))
    return wide.withColumns({**pairs, "total_concentration": total, "element_diversity": diverse})


def group_stats(df: DataFrame, key: str, full: bool = True) -> DataFrame:
    """Grade statistics per ``key`` as ``<prefix>_mean`` …; five of them, or three."""
    prefix = {"SampleID": "sample", "Hole_ID": "hole", "Element": "element", "DataSet": "dataset"}[key]
    stats = [F.avg(GRADE).alias(f"{prefix}_mean"), F.stddev_samp(GRADE).alias(f"{prefix}_std")]
    if full:
        stats += [F.min(GRADE).alias(f"{prefix}_min"), F.max(GRADE).alias(f"{prefix}_max")]
    return df.groupBy(key).agg(*stats, F.count(GRADE).alias(f"{prefix}_count"))


def group_stats_long(df: DataFrame) -> DataFrame:
    """Statistics of all four groupings as one relation, from one pass."""
    level = F.grouping_id()
    keys = ["SampleID", "Hole_ID", "Element", "DataSet"]
    sets = [[F.col(k)] for k in keys]
    return df.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        F.when(level == 7, "sample").when(level == 11, "hole").when(level == 13, "element").otherwise("dataset").alias("level"),
        F.avg(GRADE).alias("mean"), F.stddev_samp(GRADE).alias("std"),
        F.min(GRADE).alias("min"), F.max(GRADE).alias("max"), F.count(GRADE).alias("count"),
    ).select("level", F.coalesce(*keys).alias("key"), "mean", "std", "min", "max", "count")


def group_stats_join(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows with the statistics of their sample, hole, element and dataset, taken
    from ``known`` rows (the rows themselves by default).

    Statistics of holes, elements and datasets are written first: where Spark sees
    that they are few, they go to the rows and the rows are not shuffled.
    """
    source = df if known is None else known
    for key, full in (("SampleID", True), ("Hole_ID", True), ("Element", False), ("DataSet", False)):
        stats = group_stats(source, key, full)
        df = join_on(df, stats if key == "SampleID" else keep(stats), [key], "left")
    return df


def prediction_stats(scored: DataFrame, column: str = "y_pred", keys=()) -> DataFrame:
    """Spread of predictions; the deviation is of the population."""
    from corelode.operators.quantiles import quantiles

    stats = scored.groupBy(*keys).agg(
        F.count(column).alias("count"), F.min(column).alias("min"), F.max(column).alias("max"),
        F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"),
    )
    middle = quantiles(scored, keys, {"median": (F.col(column), 0.5)})
    return join_on(stats, middle, list(keys)) if keys else stats.withColumn("median", middle.scalar())


def throughput(rows: int, seconds: float, spark) -> DataFrame:
    """Timing of one scoring run."""
    return spark.createDataFrame(
        [(rows, float(seconds), rows / seconds if seconds > 0 else None)],
        "total_predictions long, processing_seconds double, predictions_per_second double",
    )


def test_distribution(rows: DataFrame) -> DataFrame:
    from corelode.operators.quantiles import quantiles

    g = F.col(GRADE)
    marks = quantiles(rows, [], {"p50": (g, 0.5), "p75": (g, 0.75), "p90": (g, 0.9), "p95": (g, 0.95)})
    return rows.agg(
        F.count(ROWS).alias("samples"),
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"),
        F.min("Depth_From").alias("min_depth"), F.max("Depth_To").alias("max_depth"),
        F.min(g).alias("min_grade"), F.max(g).alias("max_grade"),
        F.avg(g).alias("avg_grade"), F.stddev_samp(g).alias("std_grade"),
    ).withColumn("_q", marks.select(F.struct("*")).scalar()).select("*", "_q.*").drop("_q")
