"""Arithmetic on arrays of doubles."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance over the dimensions of ``b``; the largest double if ``b`` is null."""
    squares = F.zip_with(F.slice(a, 1, F.greatest(F.size(b), F.lit(1))), b, lambda x, y: (x - y) * (x - y))
    total = F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)
    return F.when(b.isNull(), F.lit(sys.float_info.max)).otherwise(F.sqrt(total))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def divide(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x / by)


def first_difference(a: Column, b: Column, eps: float) -> Column:
    """0 if no coordinate differs by more than ``eps``, else the first difference that does."""
    far = F.filter(F.zip_with(a, b, lambda x, y: x - y), lambda d: F.abs(d) > eps)
    return F.coalesce(F.try_element_at(far, F.lit(1)), F.lit(0.0))


def close(a: Column, b: Column, eps: float) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d <= eps)


def order(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as ``a`` comes before, with or after ``b``: by the first coordinates that differ, then the shorter first."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)
