"""Row conditions shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRADE = "standardized_grade_ppm"


def all_of(conditions: Iterable[Column | None]) -> Column:
    """Conjunction of the given conditions; missing ones are skipped."""
    present = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, present) if present else F.lit(True)


def has_coordinates() -> Column:
    return F.col("latitude").isNotNull() & F.col("longitude").isNotNull()


def positive_grade(column: str = GRADE) -> Column:
    return F.col(column) > 0


def valid_sample() -> Column:
    """Coordinates present and grade present and positive."""
    return has_coordinates() & F.col(GRADE).isNotNull() & positive_grade()


def valid_location() -> Column:
    """The training conditions without the one on the grade."""
    return (
        has_coordinates() & F.col("Depth_From").isNotNull() & F.col("Depth_To").isNotNull()
        & (F.col("Interval_Length") > 0)
    )


def valid_training() -> Column:
    return valid_location() & F.col(GRADE).isNotNull() & positive_grade()


# Names of up to this many letters are filtered by all their spellings.
LONGEST_SPELLED = 3


def of_elements(elements: Iterable[str] | None) -> Column | None:
    """Element filter without regard to case. None means all elements.

    All spellings of the short names are listed, which a Parquet scan can use to
    skip row groups; ``upper(Element)`` it could not.
    """
    if elements is None:
        return None
    names = sorted({e.upper() for e in elements})
    if any(len(n) > LONGEST_SPELLED or not n.isascii() for n in names):
        return F.upper("Element").isin(names)
    return F.col("Element").isin(sorted({"".join(x) for n in names for x in product(*((c.upper(), c.lower()) for c in n))}))


def of_datasets(datasets: Iterable[str] | None) -> Column | None:
    return None if datasets is None else F.col("DataSet").isin(list(datasets))


@dataclass(frozen=True)
class FilterSpec:
    """A declared filter: ``column operator value``."""

    column: str
    operator: str
    value: Any

    def on(self, df: DataFrame) -> Column:
        if self.column not in df.columns:
            raise ValueError(f"unknown column {self.column}")
        c, v = F.col(self.column), self.value
        actions = {
            "=": lambda: c == v,
            ">": lambda: c > v,
            "<": lambda: c < v,
            ">=": lambda: c >= v,
            "<=": lambda: c <= v,
            "IN": lambda: c.isin(list(v)),
            "BETWEEN": lambda: c.between(v[0], v[1]),
            "LIKE": lambda: c.like(v),
        }
        if self.operator.upper() not in actions:
            raise ValueError(f"unknown operator {self.operator}")
        return actions[self.operator.upper()]()


def apply_filters(df: DataFrame, filters: Iterable[FilterSpec]) -> DataFrame:
    return df.filter(all_of(f.on(df) for f in filters))


def in_range(column: str, low: float | None = None, high: float | None = None) -> Column | None:
    """Closed range; a missing bound is open."""
    return _none_if_empty([
        None if low is None else F.col(column) >= low,
        None if high is None else F.col(column) <= high,
    ])


def _none_if_empty(conditions: list[Column | None]) -> Column | None:
    return all_of(conditions) if any(c is not None for c in conditions) else None


def grade_range(low: float | None = None, high: float | None = None) -> Column | None:
    return in_range(GRADE, low, high)


def elevation_range(low: float | None = None, high: float | None = None) -> Column | None:
    return in_range("elevation", low, high)


def depth_range(low: float | None = None, high: float | None = None) -> Column | None:
    """Intervals that start at or below ``low`` and end at or above ``high``."""
    return _none_if_empty([in_range("Depth_From", low), in_range("Depth_To", None, high)])


def of_labs(labs: Iterable[str] | None) -> Column | None:
    return None if labs is None else F.col("LabCode").isin(list(labs))


def in_bounds(min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> Column:
    return F.col("latitude").between(min_lat, max_lat) & F.col("longitude").between(min_lon, max_lon)
