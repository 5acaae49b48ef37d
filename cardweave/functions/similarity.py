"""Similarity of sets kept as arrays of distinct values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def set_stats(left: Column, right: Column, common: Column | None = None) -> dict[str, Column]:
    """jaccard, dice, containment and count_ratio; all 0 where there is nothing to compare."""
    common = F.size(F.array_intersect(left, right)) if common is None else common
    n, m = F.size(left), F.size(right)
    return {
        "jaccard": ratio(common, n + m - common),
        "dice": ratio(2 * common, n + m),
        "containment": ratio(common, F.least(n, m)),
        "count_ratio": ratio(F.least(n, m), F.greatest(n, m)),
    }


def disjoint(left: Column, right: Column) -> Column:
    """1 if both have values and none in common."""
    return ((F.size(left) > 0) & (F.size(right) > 0) & ~F.arrays_overlap(left, right)).cast("double")


def presence_equal(left: Column, right: Column) -> Column:
    """1 if both are empty or neither is."""
    return ((F.size(left) == 0) == (F.size(right) == 0)).cast("double")


def same_set(left: Column, right: Column) -> Column:
    return ((F.size(left) > 0) & (F.array_sort(left) == F.array_sort(right))).cast("double")


def dot(left: Column, right: Column) -> Column:
    """Dot product of two arrays of numbers, in double."""
    return F.aggregate(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
