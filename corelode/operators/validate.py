"""Data checks. Each returns rows (check, field, metric, value, passed).

``passed`` is null for plain statistics and false on the rows that make a check
fail. Every check is one aggregation over the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corelode.functions import predicates as P
from corelode.functions.predicates import GRADE
from corelode.operators import profile as A
from corelode.operators.depth import interval_overlaps
from corelode.operators.quantiles import corrected_kurtosis, corrected_skewness, modes, quantiles
from corelode.operators.rows import hole_consistency
from corelode.schema import (
    DEPTH_RANGE, GRADE_MAXIMUM, INTERVAL_TOLERANCE, LATITUDE_RANGE, LONGITUDE_RANGE, REQUIRED,
)

IDENTIFIERS = ["Hole_ID", "Element", "DataSet"]
REPORT = "check string, field string, metric string, value double, passed boolean"

Line = tuple[str, str, Column, Column | None]  # field, metric, value, passed


def _long(one_row: DataFrame, check: str, lines: list[Line]) -> DataFrame:
    """Turn columns of a one-row frame into report rows."""
    nothing = F.lit(None).cast("boolean")
    return one_row.select(F.inline(F.array(*[
        F.struct(
            F.lit(check).alias("check"), F.lit(field).alias("field"), F.lit(metric).alias("metric"),
            value.cast("double").alias("value"), (nothing if passed is None else passed).alias("passed"))
        for field, metric, value, passed in lines])))


def _missing(df: DataFrame, check: str, fields: list[str]) -> DataFrame | None:
    absent = [f for f in fields if f not in df.columns]
    if not absent:
        return None
    rows = [(check, f, "missing_field", 1.0, False) for f in absent]
    return df.sparkSession.createDataFrame(rows, REPORT)


def _range_stats(field: str) -> list[Column]:
    c = F.col(field)
    return [
        F.count(c).alias(f"{field}_count"), F.count_if(c.isNull()).alias(f"{field}_nulls"),
        F.min(c).alias(f"{field}_min"), F.max(c).alias(f"{field}_max"), F.avg(c).alias(f"{field}_mean"),
        F.stddev_samp(c).alias(f"{field}_std"), F.count("*").alias(f"{field}_rows")]


def _range_lines(field: str, strict_nulls: bool = False) -> list[Line]:
    col = lambda m: F.col(f"{field}_{m}")
    return [
        (field, "count", col("count"), None), (field, "null_count", col("nulls"), None),
        (field, "null_percent", F.try_divide(col("nulls") * 100.0, col("rows")), None),
        (field, "min", col("min"), None), (field, "max", col("max"), None),
        (field, "mean", col("mean"), None), (field, "std", col("std"), None)]


def _outside(field: str, limits: tuple[float, float]) -> Column:
    return F.count_if((F.col(field) < limits[0]) | (F.col(field) > limits[1]))


# A check is a list of aggregates and the report lines made of them, so that
# several checks can share one pass.
Check = tuple[list[Column], list[Line]]


def _coordinate_check() -> Check:
    limits = {"latitude": LATITUDE_RANGE, "longitude": LONGITUDE_RANGE}
    aggregates = [s for f in limits for s in _range_stats(f)] + [_outside(f, r).alias(f"{f}_outside") for f, r in limits.items()]
    lines = [line for f in limits for line in [
        *_range_lines(f), (f, "out_of_range", F.col(f"{f}_outside"), F.col(f"{f}_outside") == 0)]]
    return aggregates, lines


def _depth_check() -> Check:
    fields = ["Depth_From", "Depth_To"]
    length = F.col("Depth_To") - F.col("Depth_From")
    aggregates = [
        *[s for f in fields for s in _range_stats(f)], *[_outside(f, DEPTH_RANGE).alias(f"{f}_outside") for f in fields],
        F.count_if(F.col("Depth_From") >= F.col("Depth_To")).alias("order"),
        F.count_if(F.abs(F.col("Interval_Length") - length) > INTERVAL_TOLERANCE).alias("mismatch")]
    lines = [line for f in fields for line in [
        *_range_lines(f), (f, "out_of_range", F.col(f"{f}_outside"), F.col(f"{f}_outside") == 0)]]
    lines += [("interval", "from_not_before_to", F.col("order"), F.col("order") == 0), ("interval", "length_mismatch", F.col("mismatch"), None)]
    return aggregates, lines


def _grade_check() -> Check:
    """Its lines read the quartiles from the struct ``_q``."""
    g = F.col(GRADE)
    aggregates = [
        *_range_stats(GRADE), F.count_if(g == 0).alias("zero"), F.count_if(g < 0).alias("negative"),
        F.count_if(g > GRADE_MAXIMUM).alias("extreme")]
    lines = _range_lines(GRADE) + [
        (GRADE, "zero_count", F.col("zero"), None), (GRADE, "negative_count", F.col("negative"), None),
        (GRADE, "extreme_count", F.col("extreme"), None)]
    lines += [(GRADE, m, F.col(f"_q.{m}"), None) for m in ("median", "q25", "q75")]
    return aggregates, lines


def _statistics_check() -> Check:
    """Its aggregates read the quartiles from the struct ``_q``."""
    g = F.col(GRADE)
    spread = F.col("_q.q75") - F.col("_q.q25")
    outlier = (g < F.col("_q.q25") - 1.5 * spread) | (g > F.col("_q.q75") + 1.5 * spread)
    aggregates = [
        F.count_if(outlier).alias("outliers"), F.count(g).alias("known"), corrected_skewness(g).alias("skew"),
        corrected_kurtosis(g).alias("kurt"), F.try_divide(F.stddev_samp(g), F.avg(g)).alias("cv")]
    share = F.try_divide(F.col("outliers") * 100.0, F.col("known"))
    lines = [
        (GRADE, "outlier_count", F.col("outliers"), None), (GRADE, "outlier_percent", share, share <= 10),
        (GRADE, "skewness", F.col("skew"), F.abs("skew") <= 3), (GRADE, "kurtosis", F.col("kurt"), None),
        (GRADE, "coefficient_of_variation", F.col("cv"), F.col("cv") >= 0.1)]
    return aggregates, lines


def _identifier_check() -> Check:
    aggregates = [c for f in IDENTIFIERS for c in (
        F.count(f).alias(f"{f}_count"), F.count_if(F.col(f).isNull()).alias(f"{f}_nulls"), F.count_if(F.col(f) == "").alias(f"{f}_empty"))]
    lines = [line for f in IDENTIFIERS for line in (
        (f, "count", F.col(f"{f}_count"), None), (f, "null_count", F.col(f"{f}_nulls"), F.col(f"{f}_nulls") == 0),
        (f, "empty_count", F.col(f"{f}_empty"), F.col(f"{f}_empty") == 0))]
    return aggregates, lines


def _quartiles(df: DataFrame) -> Column:
    g = F.col(GRADE)
    return quantiles(df, [], {"median": (g, 0.5), "q25": (g, 0.25), "q75": (g, 0.75)}).select(F.struct("*")).scalar()


def validate_coordinates(df: DataFrame) -> DataFrame:
    absent = _missing(df, "coordinates", ["latitude", "longitude"])
    if absent is not None:
        return absent
    aggregates, lines = _coordinate_check()
    return _long(df.agg(*aggregates), "coordinates", lines)


def validate_depths(df: DataFrame) -> DataFrame:
    absent = _missing(df, "depths", ["Depth_From", "Depth_To"])
    if absent is not None:
        return absent
    aggregates, lines = _depth_check()
    return _long(df.agg(*aggregates), "depths", lines)


def validate_grades(df: DataFrame) -> DataFrame:
    absent = _missing(df, "grades", [GRADE])
    if absent is not None:
        return absent
    aggregates, lines = _grade_check()
    return _long(df.agg(*aggregates).withColumn("_q", _quartiles(df)), "grades", lines)


def validate_identifiers(df: DataFrame) -> DataFrame:
    """Long rows plus ``most_common``, the mode of each identifier."""
    absent = _missing(df, "identifiers", IDENTIFIERS)
    if absent is not None:
        return absent.withColumn("most_common", F.lit(None).cast("string"))
    aggregates, lines = _identifier_check()
    one = df.agg(*aggregates)
    counts = _long(one, "identifiers", lines).withColumn("most_common", F.lit(None).cast("string"))
    common = modes(df, IDENTIFIERS).select(
        F.lit("identifiers").alias("check"), "field", F.lit("unique_count").alias("metric"),
        F.col("unique_count").cast("double").alias("value"), F.lit(None).cast("boolean").alias("passed"), "most_common")
    return counts.unionByName(common)


def duplicate_intervals(df: DataFrame) -> DataFrame:
    """Rows that repeat hole, element and interval of an earlier row (nulls are equal)."""
    groups = df.groupBy("Hole_ID", "Element", "Depth_From", "Depth_To").agg(F.count("*").alias("n"))
    one = groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("twice"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    return _long(one, "duplicates", [
        ("interval", "duplicate_count", F.col("twice"), F.col("twice") == 0),
        ("interval", "duplicate_percent", F.try_divide(F.col("twice") * 100.0, F.col("rows")), None)])


def overlap_check(df: DataFrame, limit: int | None = None) -> DataFrame:
    one = interval_overlaps(df, limit).agg(F.coalesce(F.sum("overlaps"), F.lit(0)).alias("n")).withColumn(
        "_s", df.agg(F.struct(F.count_distinct("Hole_ID").alias("holes"), F.count("*").alias("rows"))).scalar())
    return _long(one, "overlaps", [
        ("interval", "overlap_count", F.col("n"), F.col("n") == 0), ("Hole_ID", "unique_holes", F.col("_s.holes"), None),
        ("Hole_ID", "total_records", F.col("_s.rows"), None)])


def statistical_properties(df: DataFrame) -> DataFrame:
    """Outliers by quartiles, skewness, kurtosis and coefficient of variation of
    the grades. These rows never fail a report; ``passed`` marks the remark."""
    aggregates, lines = _statistics_check()
    return _long(df.withColumn("_q", _quartiles(df)).agg(*aggregates), "statistics", lines)


def issues(report: DataFrame) -> DataFrame:
    """The lines of a report that are worth a remark."""
    remark = F.col("passed") == F.lit(False)
    counted = (F.col("value") > 0) & F.col("metric").isin(
        "null_count", "zero_count", "negative_count", "extreme_count", "length_mismatch")
    return report.filter(F.coalesce(remark, F.lit(False)) | F.coalesce(counted, F.lit(False)))


def validation_lines(df: DataFrame) -> DataFrame:
    """All checks in one relation.

    The checks that only aggregate share one pass; duplicates, overlaps and
    distinct identifiers group the rows in their own ways.
    """
    needed = ["latitude", "longitude", "Depth_From", "Depth_To", GRADE, *IDENTIFIERS]
    absent = _missing(df, "required", needed)
    if absent is not None:
        return absent
    checks = {
        "coordinates": _coordinate_check(), "depths": _depth_check(), "grades": _grade_check(),
        "identifiers": _identifier_check(), "statistics": _statistics_check()}
    quartiles = _quartiles(df)
    one = df.withColumn("_q", quartiles).agg(*[a for aggregates, _ in checks.values() for a in aggregates]).withColumn("_q", quartiles)
    every = [(name, *line) for name, (_, lines) in checks.items() for line in lines]
    report = one.select(F.inline(F.array(*[
        F.struct(
            F.lit(check).alias("check"), F.lit(field).alias("field"), F.lit(metric).alias("metric"), value.cast("double").alias("value"),
            (F.lit(None).cast("boolean") if passed is None else passed).alias("passed"))
        for check, field, metric, value, passed in every])))
    distinct = df.agg(*[F.count_distinct(f).alias(f) for f in IDENTIFIERS])
    unique = _long(distinct, "identifiers", [(f, "unique_count", F.col(f), None) for f in IDENTIFIERS])
    for more in (unique, duplicate_intervals(df), overlap_check(df)):
        report = report.unionByName(more)
    return report


def overall(report: DataFrame) -> DataFrame:
    """Status and number of issues of a report."""
    failed = F.count_if((F.col("passed") == F.lit(False)) & (F.col("check") != "statistics"))
    return report.agg(
        F.when(failed == 0, "PASSED").otherwise("FAILED").alias("overall_status"), failed.alias("failed_lines"),
    ).withColumn("total_issues", issues(report).agg(F.count("*")).scalar())


def validation_report(df: DataFrame) -> DataFrame:
    """Every check with its number of issues and status, and the overall row."""
    lines = validation_lines(df)
    remark = F.coalesce(F.col("passed") == F.lit(False), F.lit(False))
    counted = F.coalesce((F.col("value") > 0) & F.col("metric").isin(
        "null_count", "zero_count", "negative_count", "extreme_count", "length_mismatch"), F.lit(False))
    blocking = remark & (F.col("check") != "statistics")
    label = F.coalesce(F.col("check"), F.lit("overall"))
    return lines.rollup("check").agg(
        F.count("*").alias("lines"), F.count_if(remark | counted).alias("issues"), F.count_if(blocking).alias("failed"),
    ).select(label.alias("check"), "lines", "issues", F.when(F.col("failed") == 0, "PASSED").otherwise("FAILED").alias("status"))


def period_quality(df: DataFrame, period: Column) -> DataFrame:
    """One history line per period: status, issues and rows.

    The checks that decide on a status are grouped by period, so that a whole
    history is one pass.
    """
    g = F.col(GRADE)
    twice = df.groupBy(period.alias("period"), "Hole_ID", "Element", "Depth_From", "Depth_To").agg(
        F.count("*").alias("n"),
        F.count_if((F.col("latitude").isNull()) | F.col("longitude").isNull()).alias("coords"),
        F.count_if(g.isNull()).alias("grade_nulls"), F.count_if(g < 0).alias("negative"), F.count_if(g == 0).alias("zero"),
        F.count_if(~F.col("latitude").between(*LATITUDE_RANGE) | ~F.col("longitude").between(*LONGITUDE_RANGE)).alias("outside"),
        F.count_if(F.col("Depth_From") >= F.col("Depth_To")).alias("order"))
    sums = twice.groupBy("period").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"),
        *[F.sum(c).alias(c) for c in ("coords", "grade_nulls", "negative", "zero", "outside", "order")])
    flags = sum(((F.col(c) > 0).cast("long") for c in ("duplicates", "coords", "grade_nulls", "negative", "zero", "outside", "order")), F.lit(0).cast("long"))
    bad = (F.col("duplicates") + F.col("outside") + F.col("order")) > 0
    return sums.select("period", F.when(bad, "FAILED").otherwise("PASSED").alias("status"), flags.alias("issues"), "rows")


def quality_trend(history: DataFrame) -> DataFrame:
    """Number of checks, share passed, mean issues and latest status of a history."""
    return history.agg(
        F.count("*").alias("total_checks"), F.avg((F.col("status") == "PASSED").cast("double")).alias("pass_rate"),
        F.avg("issues").alias("avg_issues"), F.max_by("status", "period").alias("latest_status"))


def validate_samples(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Counts of defects of a sample relation and whether it is valid."""
    required = required or ["latitude", "longitude", "Depth_From", "Depth_To", "Element", GRADE]
    absent = [c for c in required if c not in df.columns]
    if absent:
        one = df.agg(F.count("*").alias("total_samples"))
        return one.select(
            "total_samples", F.array(*[F.lit(c) for c in absent]).alias("missing_columns"), F.lit(False).alias("is_valid"))
    outside = lambda c, r: F.count_if(~F.col(c).between(*r))
    sums = df.groupBy("SampleID").agg(
        F.count("*").alias("n"), F.count_if(F.col(GRADE) < 0).alias("negative_grades"),
        (F.count_if(F.col("Depth_From") < 0) + F.count_if(F.col("Depth_To") < 0)).alias("negative_depths"),
        (outside("latitude", LATITUDE_RANGE) + outside("longitude", LONGITUDE_RANGE)).alias("invalid_coordinates"),
        *[F.count(c).alias(f"_{c}") for c in required])
    empty = F.array_compact(F.array(*[F.when(F.sum(f"_{c}") == 0, F.lit(c)) for c in required]))
    one = sums.agg(
        F.sum("n").alias("total_samples"), *[F.sum(c).alias(c) for c in ("negative_grades", "negative_depths", "invalid_coordinates")],
        F.sum(F.col("n") - 1).alias("duplicate_samples"), empty.alias("_empty"))
    bad = F.col("negative_grades") + F.col("negative_depths") + F.col("invalid_coordinates") + F.size("_empty")
    return one.select(
        "total_samples", "negative_grades", "negative_depths", "invalid_coordinates", "duplicate_samples",
        F.array_join("_empty", ",").alias("empty_columns"), (bad == 0).alias("is_valid"))


def schema_info(spark: SparkSession, relations: dict[str, DataFrame]) -> DataFrame:
    """Columns of relations in order, with type, nullability and number of values."""
    tables = None
    for name, df in relations.items():
        counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
        lines = counts.select(F.inline(F.array(*[
            F.struct(
                F.lit(name).alias("relation"), F.lit(i + 1).alias("position"), F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.nullable).alias("nullable"), F.col(f.name).alias("values"))
            for i, f in enumerate(df.schema.fields)])))
        tables = lines if tables is None else tables.unionByName(lines)
    return tables


def schema_validation(spark: SparkSession, relations: dict[str, DataFrame]) -> DataFrame:
    """Required against present columns per relation, with an overall row."""
    rows = []
    for name, required in REQUIRED.items():
        df = relations.get(name)
        absent = required if df is None else [c for c in required if c not in df.columns]
        rows.append((name, df is not None, len(required), ",".join(absent), not absent))
    rows.append(("overall", all(r[1] for r in rows), sum(r[2] for r in rows), "", all(r[4] for r in rows)))
    return spark.createDataFrame(rows, "relation string, present boolean, required int, missing string, valid boolean")


def integrity_report(grades: DataFrame, collars: DataFrame) -> DataFrame:
    """The relation checks as rows (section, metric, value)."""

    def long(section: str, one: DataFrame) -> DataFrame:
        return one.select(F.inline(F.array(*[
            F.struct(F.lit(section).alias("section"), F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns])))

    parts = [
        long("hole_consistency", hole_consistency(grades, collars)), long("coord_completeness", A.coord_completeness(collars)),
        long("grade_validity", A.grade_validity(grades)), long("depth_consistency", A.depth_consistency(grades)),
        long("element_distribution", A.element_distribution(grades).agg(F.count("*").alias("element_count"), F.sum("record_count").alias("records")))]
    report = parts[0]
    for p in parts[1:]:
        report = report.unionByName(p)
    return report


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def profile(df: DataFrame) -> DataFrame:
    """Per column: type, missing values, moments (numbers) or mode (texts)."""
    numbers, texts = numeric_columns(df), text_columns(df)
    one = df.agg(F.count("*").alias("_rows"), *[c for n in df.columns for c in [F.count(n).alias(f"{n}__n")]], *[c for n in numbers for c in (
        F.avg(n).alias(f"{n}__mean"), F.stddev_samp(n).alias(f"{n}__std"), F.min(n).cast("double").alias(f"{n}__min"),
        F.max(n).cast("double").alias(f"{n}__max"), corrected_skewness(F.col(n)).alias(f"{n}__skew"), corrected_kurtosis(F.col(n)).alias(f"{n}__kurt"))])
    if numbers:
        middle = quantiles(df, [], {f"{n}__median": (F.col(n), 0.5) for n in numbers})
        one = one.withColumn("_m", middle.select(F.struct("*")).scalar())
    types = dict(df.dtypes)
    null = F.lit(None).cast("double")

    def line(n: str) -> Column:
        number = n in numbers
        value = lambda m: (F.col(f"{n}__{m}") if number else null)
        absent = F.col("_rows") - F.col(f"{n}__n")
        return F.struct(
            F.lit(n).alias("field"), F.lit(types[n]).alias("type"), absent.alias("missing_count"),
            F.round(F.try_divide(absent * 100.0, F.col("_rows")), 2).alias("missing_percent"), value("mean").alias("mean"),
            value("std").alias("std"), value("min").alias("min"), value("max").alias("max"),
            (F.col(f"_m.{n}__median") if number else null).alias("median"), value("skew").alias("skewness"), value("kurt").alias("kurtosis"))

    lines = one.select(F.inline(F.array(*[line(n) for n in df.columns])))
    if not texts:
        return lines.withColumns({
            "unique_count": F.lit(None).cast("long"), "most_common": F.lit(None).cast("string"), "most_common_count": F.lit(None).cast("long")})
    return lines.join(modes(df, texts), "field", "left").select(*lines.columns, "unique_count", "most_common", "most_common_count")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in every column."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
