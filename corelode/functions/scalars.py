"""Column functions of the assay domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corelode.schema import (
    EARTH_RADIUS_KM, ECONOMIC_LIMITS, EPSILON, HEAT_DEFAULT, HEAT_MAXIMUM, KM_PER_DEGREE,
    LATITUDE_RANGE, LONGITUDE_RANGE, QUESTION_ORDER, RECOVERY, REQUEST_DEPTH_RANGE,
)

Num = Column | float


def as_column(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def degrees_apart(lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    """Euclidean distance in degrees."""
    lat1, lon1, lat2, lon2 = map(as_column, (lat1, lon1, lat2, lon2))
    dlat, dlon = lat1 - lat2, lon1 - lon2
    return F.sqrt(dlat * dlat + dlon * dlon)


def manhattan_apart(lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    lat1, lon1, lat2, lon2 = map(as_column, (lat1, lon1, lat2, lon2))
    return F.abs(lat1 - lat2) + F.abs(lon1 - lon2)


def haversine_km(lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    """Great-circle distance in kilometres."""
    lat1, lon1, lat2, lon2 = (F.radians(as_column(x)) for x in (lat1, lon1, lat2, lon2))
    s, t = F.sin((lat2 - lat1) / 2), F.sin((lon2 - lon1) / 2)
    a = s * s + F.cos(lat1) * F.cos(lat2) * t * t
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def flat_km(lat: Num, lon: Num, center_lat: Num, center_lon: Num) -> Column:
    """Equirectangular distance in kilometres from a centre."""
    lat, lon, clat, clon = map(as_column, (lat, lon, center_lat, center_lon))
    north = (lat - clat) * KM_PER_DEGREE
    east = (lon - clon) * KM_PER_DEGREE * F.cos(F.radians((lat + clat) / 2))
    return F.sqrt(north * north + east * east)


def mid_depth() -> Column:
    return (F.col("Depth_From") + F.col("Depth_To")) / 2


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over the rows that have both values; null when one of
    them does not vary (the built-in function fails there)."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def metal_content(grade: Num, tonnage: Num, recovery: float = RECOVERY) -> Column:
    """Recoverable metal in tonnes from a grade in ppm."""
    return as_column(grade) * as_column(tonnage) * recovery / 1e6


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` with the small constant that keeps the divisor from zero."""
    return a / (b + EPSILON)


def grade_level(grade: Num) -> Column:
    g = as_column(grade)
    return F.when(g > 1000, "high").when(g > 500, "medium").otherwise("low")


def elevation_level(elevation: Column) -> Column:
    return F.when(elevation < 1000, "Low").when(elevation < 2000, "Medium").otherwise("High")


def economic_class(element: Column, grade: Column) -> Column:
    """Economic class by element; unknown elements use the copper limits."""
    symbol = F.upper(element)

    def limit(at: int) -> Column:
        values = {row[0]: row[at] for row in ECONOMIC_LIMITS}
        choice = F.lit(values["CU"])
        for name, value in values.items():
            choice = F.when(symbol == name, F.lit(value)).otherwise(choice)
        return choice

    return (
        F.when(grade >= limit(1), "high-grade")
        .when(grade >= limit(2), "medium-grade")
        .when(grade >= limit(3), "low-grade")
        .otherwise("trace-grade")
    )


def economic_label(economic: Column) -> Column:
    """``high-grade`` -> ``High Grade``."""
    return F.initcap(F.replace(economic, F.lit("-"), F.lit(" ")))


def heat_weight(element: Column, concentration: Column) -> Column:
    """Concentration scaled to 0..1 by the element's maximum."""
    top = F.lit(HEAT_DEFAULT)
    for name, value in HEAT_MAXIMUM.items():
        top = F.when(element == name, F.lit(value)).otherwise(top)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), concentration / top))


def element_mention(text: Column, whole_words: bool = False) -> Column:
    """First element symbol, in the fixed order, that occurs in a text."""
    low = F.lower(text)
    found = F.lit(None).cast("string")
    for symbol in reversed(QUESTION_ORDER):
        if whole_words:
            hit = low.rlike(rf"\b{symbol.lower()}\b")
        else:
            hit = low.contains(symbol.lower())
        found = F.when(hit, F.lit(symbol)).otherwise(found)
    return found


def request_key(lat: Column, lon: Column, depth_from: Column, depth_to: Column, element: Column) -> Column:
    return F.md5(F.format_string("%.6f,%.6f,%.2f,%.2f,%s", lat, lon, depth_from, depth_to, element))


def request_errors(
    strict_order: bool = False,
    latitude: tuple[float, float] = LATITUDE_RANGE,
    longitude: tuple[float, float] = LONGITUDE_RANGE,
    depth: tuple[float, float] = REQUEST_DEPTH_RANGE,
    check_order: bool = True,
) -> Column:
    """The violated rules of a point request (columns latitude, longitude,
    depth_from, depth_to); ``strict_order`` also rejects equal depths."""

    def outside(name: str, limits: tuple[float, float]) -> Column:
        value = F.col(name)
        bad = value.isNull() | ~value.between(*limits)
        return F.when(bad, F.lit(f"{name} outside {limits[0]:g}..{limits[1]:g}"))

    start, end = F.col("depth_from"), F.col("depth_to")
    wrong = start >= end if strict_order else start > end
    rules = [
        outside("latitude", latitude),
        outside("longitude", longitude),
        outside("depth_from", depth),
        outside("depth_to", depth),
    ]
    if check_order:
        rules.append(F.when(wrong, F.lit("depth_from after depth_to")))
    return F.array_compact(F.array(*rules))


def interval_confidence(lower: Column, upper: Column) -> Column:
    width = upper - lower
    return F.when(width < 100, "high").when(width < 300, "medium").otherwise("low")


def region_confidence(lat: Column, lon: Column) -> Column:
    return (
        F.when(lat.between(-25, -20) & lon.between(-50, -45), "high")
        .when(lat.between(-30, -15) & lon.between(-55, -40), "medium")
        .otherwise("low")
    )


def r2_level(r2: Column) -> Column:
    return (
        F.when(r2 >= 0.95, "EXCELLENT").when(r2 >= 0.85, "GOOD")
        .when(r2 >= 0.70, "FAIR").otherwise("POOR")
    )


def relative_error(actual: Column, predicted: Column) -> Column:
    """Relative error in percent; null for a zero actual value."""
    return F.try_divide(F.abs(actual - predicted), F.abs(actual)) * 100


def sample_accuracy(actual: Column, predicted: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(100.0) - relative_error(actual, predicted))


def accuracy_level(accuracy: Column) -> Column:
    return (
        F.when(accuracy >= 90, "EXCELLENT").when(accuracy >= 80, "GOOD")
        .when(accuracy >= 70, "FAIR").otherwise("POOR")
    )


def duration_text(seconds: Column) -> Column:
    """Seconds as text in s, m or h."""
    return (
        F.when(seconds < 60, F.format_string("%.1fs", seconds))
        .when(seconds < 3600, F.format_string("%.1fm", seconds / 60))
        .otherwise(F.format_string("%.1fh", seconds / 3600))
    )
