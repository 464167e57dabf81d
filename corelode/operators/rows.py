"""Row-level selections: filters, projections, limits and simple joins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelode.functions import predicates as P
from corelode.functions import scalars as S
from corelode.functions.predicates import GRADE, FilterSpec
from corelode.schema import ELEMENTS, KM_PER_DEGREE

SAMPLE_COLUMNS = [
    "SampleID", "Hole_ID", "Element", "DataSet", GRADE, "Depth_From", "Depth_To",
    "Interval_Length", "latitude", "longitude", "elevation", "LabCode",
]

# tables the preview serves, with the key that makes it repeatable
PREVIEW_KEYS = {
    "hole_samples": ["SampleID", "Element", GRADE],
    "collars": ["Hole_ID"],
    "hole_grades": ["Hole_ID", "Element", "DataSet"],
}


def scan_samples(samples: DataFrame, elements: Iterable[str] | None = None, columns=SAMPLE_COLUMNS) -> DataFrame:
    """Columns and elements reach the Parquet scan."""
    return samples.filter(P.all_of([P.of_elements(elements)])).select(*columns)


def table_preview(name: str, table: DataFrame, rows: int = 5) -> DataFrame:
    """First rows of an allowed table."""
    if name not in PREVIEW_KEYS:
        raise ValueError(f"table {name} is not allowed")
    return table.orderBy(*PREVIEW_KEYS[name]).limit(rows)


def drilling_query(
    samples: DataFrame, elements: Iterable[str] | None = ("Cu",),
    filters: Iterable[FilterSpec] = (), limit: int | None = None, ordered: bool = True,
) -> DataFrame:
    """Valid samples of the elements, by latitude, longitude and hole."""
    rows = P.apply_filters(samples.filter(P.valid_sample() & P.all_of([P.of_elements(elements)])), filters)
    rows = rows.select(
        "Hole_ID", "Element", "DataSet", GRADE, "latitude", "longitude", "elevation",
        F.col("Depth_From").alias("depth_from"), F.col("Depth_To").alias("depth_to"),
        F.col("Interval_Length").alias("interval_length"), "SampleID", "LabCode",
    )
    if ordered or limit:
        rows = rows.orderBy("latitude", "longitude", "Hole_ID", "SampleID", "Element", GRADE)
    return rows.limit(limit) if limit else rows


def drilling_by_element(samples: DataFrame, element: str, dataset: str | None = None) -> DataFrame:
    keep = P.all_of([P.of_elements([element]), P.positive_grade(), P.of_datasets(dataset and [dataset])])
    return samples.filter(keep).select(*SAMPLE_COLUMNS).orderBy("Hole_ID", "Depth_From", "SampleID")


def multi_element_rows(samples: DataFrame, elements=None, datasets=None) -> DataFrame:
    keep = P.all_of([P.positive_grade(), P.of_elements(elements), P.of_datasets(datasets)])
    return samples.filter(keep).select(*SAMPLE_COLUMNS).withColumn("mid_depth", S.mid_depth())


def by_lab_code(samples: DataFrame, lab: str, elements=None) -> DataFrame:
    keep = P.all_of([P.of_labs([lab]), P.positive_grade(), P.of_elements(elements)])
    return samples.filter(keep).select(*SAMPLE_COLUMNS)


def training_rows(samples: DataFrame, elements=None, datasets=None, limit: int | None = None, carry: Iterable[str] = ()) -> DataFrame:
    """Valid training rows with their derived columns, and further columns of the samples."""
    keep = P.all_of([P.valid_training(), P.of_elements(elements), P.of_datasets(datasets)])
    rows = samples.filter(keep).select(
        *SAMPLE_COLUMNS,
        S.mid_depth().alias("mid_depth"),
        (F.col(GRADE) * F.col("Interval_Length")).alias("grade_tonnage"),
        S.grade_level(F.col(GRADE)).alias("grade_category"),
        *carry,
    )
    if limit:
        rows = rows.orderBy("Hole_ID", "Element", "Depth_From", "SampleID", GRADE).limit(limit)
    return rows


def prediction_rows(samples: DataFrame, elements=None, datasets=None, bounds=None, depth=None) -> DataFrame:
    """Rows to predict: ``bounds`` = (min_lat, max_lat, min_lon, max_lon), ``depth`` = (from, to)."""
    keep = P.all_of([
        P.valid_location(), P.of_elements(elements), P.of_datasets(datasets),
        P.in_bounds(*bounds) if bounds else None,
        P.depth_range(*depth) if depth else None,
    ])
    columns = [c for c in SAMPLE_COLUMNS if c != GRADE]
    return samples.filter(keep).select(*columns, S.mid_depth().alias("mid_depth"))


def rows_in_bounds(samples: DataFrame, min_lat, max_lat, min_lon, max_lon, elements=None, datasets=None) -> DataFrame:
    keep = P.all_of([
        P.in_bounds(min_lat, max_lat, min_lon, max_lon), P.positive_grade(),
        P.of_elements(elements), P.of_datasets(datasets),
    ])
    return samples.filter(keep).select(
        "SampleID", "Hole_ID", "Element", "DataSet", GRADE, "latitude", "longitude",
        "elevation", "Depth_From", "Depth_To", "LabCode",
    )


def spatial_context(samples: DataFrame, lat: float, lon: float, radius_km: float = 10.0, elements=None, datasets=None) -> DataFrame:
    """Rows in a circle given in degrees; the bounding box comes first so that
    Parquet row groups outside it are skipped."""
    r = radius_km / KM_PER_DEGREE
    near = samples.filter(P.all_of([
        P.in_bounds(lat - r, lat + r, lon - r, lon + r), P.positive_grade(),
        P.of_elements(elements), P.of_datasets(datasets),
    ]))
    return (
        near.select(
            *SAMPLE_COLUMNS, S.mid_depth().alias("mid_depth"),
            S.degrees_apart(F.col("latitude"), F.col("longitude"), lat, lon).alias("distance_from_center"),
        ).filter(F.col("distance_from_center") <= r)
    )


def spatial_query_km(samples: DataFrame, lat: float, lon: float, radius_km: float = 10.0, elements=("Cu",)) -> DataFrame:
    r = radius_km / KM_PER_DEGREE
    here = F.col("latitude"), F.col("longitude")
    near = samples.filter(
        P.in_bounds(lat - r, lat + r, lon - r, lon + r) & P.valid_sample()
        & P.all_of([P.of_elements(elements)]) & (S.degrees_apart(*here, lat, lon) <= r)
    )
    return near.select(
        "Hole_ID", "Element", "DataSet", GRADE, "latitude", "longitude", "elevation",
        S.flat_km(*here, lat, lon).alias("distance_km"),
        F.atan2(here[0] - lat, here[1] - lon).alias("angle_radians"),
    )


def apply_cutoff(samples: DataFrame, element: str, cutoff: float, column: str = GRADE) -> DataFrame:
    if column not in samples.columns:
        raise ValueError(f"unknown column {column}")
    return samples.filter(P.of_elements([element]) & (F.col(column) >= cutoff))


def cutoff_share(samples: DataFrame, element: str, cutoff: float, column: str = GRADE) -> DataFrame:
    """Rows at or above a cutoff, all rows, and the percentage."""
    above = F.coalesce(F.col(column) >= cutoff, F.lit(False))
    return samples.filter(P.of_elements([element])).agg(
        F.count_if(above).alias("above"), F.count(F.lit(1)).alias("total"),
        (F.avg(above.cast("double")) * 100).alias("percent"),
    )


def distinct_elements(samples: DataFrame) -> DataFrame:
    return samples.filter(P.positive_grade()).select("Element").distinct().orderBy("Element")


def heatmap_points(grades: DataFrame, collars: DataFrame, element: str | None = None) -> DataFrame:
    """Composite grades placed at their collar."""
    located = collars.filter(F.col("LL_Lat").isNotNull() & F.col("LL_Long").isNotNull())
    return grades.filter(P.all_of([P.of_elements(element and [element])])).join(located, "Hole_ID").select(
        "Hole_ID", "Element", "DataSet", F.col("LL_Long").alias("longitude"),
        F.col("LL_Lat").alias("latitude"), F.col("weighted_grade").alias("concentration"),
    )


def hole_consistency(grades: DataFrame, collars: DataFrame) -> DataFrame:
    """Holes with grades, with a collar, and without one.

    Both sides are reduced to distinct holes before they meet.
    """
    graded = grades.select("Hole_ID").distinct()
    known = collars.select("Hole_ID").distinct().withColumn("found", F.lit(True))
    return graded.join(known, "Hole_ID", "left").agg(
        F.count(F.lit(1)).alias("total_holes_in_grades"),
        F.count("found").alias("total_holes_in_coords"),
        F.count_if(F.col("found").isNull()).alias("missing_coords"),
        F.coalesce(F.try_divide(F.count("found") * 100.0, F.count(F.lit(1))), F.lit(0.0)).alias("consistency_percentage"),
    )


def holes_without_collar(grades: DataFrame, collars: DataFrame) -> DataFrame:
    return grades.select("Hole_ID").distinct().join(collars, "Hole_ID", "left_anti")


def top_location(points: DataFrame) -> DataFrame:
    """Best location per element of :func:`heatmap_points`; ties go to the first hole."""
    best = points.groupBy("Element").agg(F.min_by(
        F.struct("Hole_ID", "DataSet", "latitude", "longitude", "concentration"),
        F.struct((-F.col("concentration")).alias("c"), "Hole_ID", "DataSet"),
    ).alias("b"))
    return best.select("Element", "b.*")


def question_answer(questions: DataFrame, points: DataFrame) -> DataFrame:
    """Questions that name an element with that element's best location."""
    asked = questions.select("conv_id", "turn", S.element_mention(F.col("question")).alias("Element"))
    return asked.filter(F.col("Element").isNotNull()).join(top_location(points), "Element")


def top_samples(samples: DataFrame, rows: int = 5) -> DataFrame:
    return (
        samples.filter(P.positive_grade())
        .select("SampleID", "Hole_ID", "Element", GRADE)
        .orderBy(F.desc(GRADE), "SampleID", "Element").limit(rows)
    )


def offset_fetch(df: DataFrame, order: list, rows: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(rows)


def concat_distinct(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other)
    return first.dropDuplicates()


def element_priority(samples: DataFrame) -> DataFrame:
    """Elements by number of valid rows, most first."""
    return samples.filter(P.valid_training()).groupBy("Element").agg(F.count(F.lit(1)).alias("records"))


def remaining_elements(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Wanted elements without a model yet."""
    finished = done.select(F.upper("Element").alias("_done")).distinct()
    return wanted.join(finished, F.upper("Element") == F.col("_done"), "left_anti")


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def verification_sample(df: DataFrame, id_columns: list[str], per_band: int = 5, tail: int = 10, seed: int = 42) -> DataFrame:
    """Rows for a manual check: the top grades, the 25-50 % band, the lowest
    grades and a random pick, without repeats."""
    from corelode.operators.prep import identity_hash
    from corelode.operators.quantiles import quantiles

    order = [F.desc(GRADE), *id_columns]
    bands = quantiles(df, [], {"q50": (F.col(GRADE), 0.5), "q75": (F.col(GRADE), 0.75)})
    middle = df.withColumn("_q", bands.select(F.struct("*")).scalar()).filter(
        (F.col(GRADE) >= F.col("_q.q50")) & (F.col(GRADE) < F.col("_q.q75"))
    ).drop("_q")
    chance = identity_hash(df, id_columns, seed)
    picks = [
        df.orderBy(*order).limit(per_band),
        middle.orderBy(*order).limit(per_band),
        df.orderBy(F.asc(GRADE), *id_columns).limit(tail).orderBy(*order).limit(per_band),
        df.orderBy(chance, *id_columns).limit(per_band),
    ]
    return concat_distinct(*picks)


def grade_bands(samples: DataFrame) -> DataFrame:
    """Rows from the 90th percentile up (``high``) and between the quartiles (``medium``)."""
    from corelode.operators.quantiles import quantiles

    valid = samples.filter(P.valid_training())
    g = F.col(GRADE)
    cut = quantiles(valid, [], {"p25": (g, 0.25), "p75": (g, 0.75), "p90": (g, 0.9)})
    band = F.when(g >= F.col("_q.p90"), "high").when((g >= F.col("_q.p25")) & (g < F.col("_q.p75")), "medium")
    return (
        valid.withColumn("_q", cut.select(F.struct("*")).scalar())
        .select("SampleID", "Element", GRADE, band.alias("band")).filter(F.col("band").isNotNull())
    )


def query_by_type(samples: DataFrame, kind: str, **options) -> DataFrame:
    """Dispatch to the query of a kind."""
    from corelode.operators import profile

    kinds = {
        "drilling": drilling_query,
        "multi_element": profile.element_pivot,
        "spatial": spatial_query_km,
        "summary": profile.summary_by,
        "quality": profile.quality_check,
    }
    if kind not in kinds:
        raise ValueError(f"unsupported query kind {kind}")
    if kind == "multi_element":
        options.setdefault("elements", ELEMENTS)
    return kinds[kind](samples, **options)
