"""Bulk comparisons: masks over columns and arrays, and positions of matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_ascii

OPERATORS = ("=", "!=", "<", "<=", ">", ">=", "CONTAINS", "BEGINSWITH", "ENDSWITH")


def compare(c: Column, op: str, target: object, case_sensitive: bool = True) -> Column:
    """One operator between a column and a scalar; null where the column is null."""
    t = F.lit(target)
    if not case_sensitive and isinstance(target, str):
        c, t = fold_ascii(c), fold_ascii(t)
    if op == "CONTAINS":
        return F.contains(c, t)
    if op == "BEGINSWITH":
        return F.startswith(c, t)
    if op == "ENDSWITH":
        return F.endswith(c, t)
    return {"=": c == t, "!=": c != t, "<": c < t, "<=": c <= t, ">": c > t, ">=": c >= t}[op]


def mask(df: DataFrame, column: str, op: str, target: object, case_sensitive: bool = True) -> DataFrame:
    """The table with a boolean ``mask``; nulls don't match."""
    return df.withColumn("mask", F.coalesce(compare(F.col(column), op, target, case_sensitive), F.lit(False)))


def match_counts(df: DataFrame, column: str, tests: list[tuple[str, object]], case_sensitive: bool = True) -> DataFrame:
    """(op, matches) of several tests of one column, in one pass."""
    counted = df.agg(*[
        F.count(F.when(compare(F.col(column), op, t, case_sensitive), True)).cast("long").alias(f"_{i}") for i, (op, t) in enumerate(tests)
    ])
    pairs = F.array(*[F.struct(F.lit(op).alias("op"), F.col(f"_{i}").alias("matches")) for i, (op, _) in enumerate(tests)])
    return counted.select(F.explode(pairs).alias("x")).select("x.op", "x.matches")


def array_mask(c: Column, op: str, target: object, case_sensitive: bool = True) -> Column:
    """The mask of an array's elements."""
    return F.transform(c, lambda x: F.coalesce(compare(x, op, target, case_sensitive), F.lit(False)))


def find_positions(
    df: DataFrame, key: str, column: str, op: str, target: object, start: int, end: int, case_sensitive: bool = True
) -> DataFrame:
    """Keys in [start, end) whose value matches; nulls are passed over."""
    inside = (F.col(key) >= start) & (F.col(key) < end)
    return df.where(inside & compare(F.col(column), op, target, case_sensitive)).select(key)
