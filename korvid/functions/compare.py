"""Typed comparison with nulls first, and the order that follows from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .convert import convert


def compare_values(a: Column, kind_a: T.DataType, b: Column, kind_b: T.DataType, target: str) -> Column:
    """-1, 0 or 1 after both sides are converted to ``target``; null is the smallest, and equals null.

    A value that can't be converted counts as null; false comes before true;
    binaries and timestamps compare by their native order.
    """
    x, y = convert(a, kind_a, target), convert(b, kind_b, target)
    return (
        F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(0)
    )


def in_order(c: Column, ascending: bool = True) -> Column:
    """A sort column that agrees with ``compare_values``."""
    return c.asc_nulls_first() if ascending else c.desc_nulls_last()
