"""Vectors in array columns, by higher-order functions in the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framestride.functions.columns import col, let, ratio


def total(x: Column | str) -> Column:
    return F.aggregate(col(x), F.lit(0.0), lambda a, v: a + v)


def dot(x: Column | str, y: Column | str) -> Column:
    return total(F.zip_with(col(x), col(y), lambda a, b: a * b))


def l1_unit(x: Column | str) -> Column:
    """Divided by its sum; NULL for an all-zero vector."""
    return let(total(x), lambda t: F.transform(col(x), lambda v: ratio(v, t)))


def scaled(x: Column | str, by: float) -> Column:
    return F.transform(col(x), lambda v: v * by)


def l2_unit(x: Column | str) -> Column:
    """Divided by its length; an all-zero vector stays."""
    return let(F.sqrt(dot(x, x)), lambda norm: F.transform(col(x), lambda v: F.when(norm > 0, v / norm).otherwise(v)))


def bhattacharyya(p: Column | str, q: Column | str) -> Column:
    """Distance of two histograms, 0 for equal and 1 for disjoint or empty ones."""
    mass = F.sqrt(total(p) * total(q))
    overlap = total(F.zip_with(col(p), col(q), lambda a, b: F.sqrt(a * b)))
    return F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce(ratio(overlap, mass), F.lit(0.0))))


def cosine_distance(x: Column | str, y: Column | str) -> Column:
    return 1 - ratio(dot(x, y), F.sqrt(dot(x, x) * dot(y, y)))


def mean_abs_difference(x: Column | str, y: Column | str) -> Column:
    return ratio(total(F.zip_with(col(x), col(y), lambda a, b: F.abs(a - b))), F.size(col(x)))
