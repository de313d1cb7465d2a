"""Changing tables: every change is a new data frame over the old one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.catalog import last_by
from ..sources.spec import ColumnSpec, SpecError, TableSpec, check_value

KEY = "_obj_key"


def insert(df: DataFrame, values: dict[str, object] | None = None, spec: TableSpec | None = None, key: str = KEY) -> DataFrame:
    """Add a row with the next key; columns that aren't named are null.  Keys start at 1."""
    values = values or {}
    unknown = values.keys() - set(df.columns)
    if unknown:
        raise SpecError(f"no columns {sorted(unknown)}")
    if spec:
        for name, v in values.items():
            check_value(spec.column(name), v)
    following = df.agg((F.coalesce(F.max(key), F.lit(0)) + 1).cast(df.schema[key].dataType).alias(key))
    row = following.select(*[
        F.col(key) if f.name == key else F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields
    ])
    return df.unionByName(row)


def matching(where: dict[str, object]) -> Column:
    """All equalities of a map hold; null equals null; an empty map matches every row."""
    return reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.lit(v)) for n, v in where.items()], F.lit(True))


def update(df: DataFrame, values: dict[str, object | Column], where: Column, spec: TableSpec | None = None) -> DataFrame:
    """Set columns of the rows that a condition is true for."""
    for name, v in values.items():
        if name not in df.columns:
            raise SpecError(f"no column {name!r}")
        if spec and not isinstance(v, Column):
            check_value(spec.column(name), v)
    hit = F.coalesce(where, F.lit(False))
    changed = {
        n: F.when(hit, (v if isinstance(v, Column) else F.lit(v)).cast(df.schema[n].dataType)).otherwise(F.col(n)) for n, v in values.items()
    }
    return df.withColumns(changed)


def set_fields(df: DataFrame, key_value: object, values: dict[str, object], spec: TableSpec | None = None, key: str = KEY) -> DataFrame:
    return update(df, values, F.col(key) == F.lit(key_value), spec)


def get_fields(df: DataFrame, key_value: object, columns: list[str], key: str = KEY) -> DataFrame:
    return df.where(F.col(key) == F.lit(key_value)).select(*columns)


def delete(df: DataFrame, where: Column) -> DataFrame:
    """Rows that a condition isn't true for."""
    return df.where(~F.coalesce(where, F.lit(False)))


def delete_keys(df: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
    """Rows whose key isn't in a table of keys."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def upsert(df: DataFrame, rows: DataFrame, key: str = KEY) -> DataFrame:
    """Rows of both; where a key is in both, the new one."""
    both = df.withColumn("_seq", F.lit(0)).unionByName(rows.withColumn("_seq", F.lit(1)))
    return last_by(both, [key], ["_seq"]).drop("_seq")


def add_column(df: DataFrame, column: ColumnSpec) -> DataFrame:
    """A new column, null in every row."""
    column.validate()
    if column.name in df.columns:
        raise SpecError(f"{column.name} exists")
    about = {"nullable": column.nullable, "attributes": sorted(column.attributes)}
    return df.withColumn(column.name, F.lit(None).cast(column.spark_type()).alias(column.name, metadata=about))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise SpecError(f"no column {name!r}")
    return df.drop(name)


def as_set(c: Column) -> Column:
    """The different elements of a list, in order."""
    return F.sort_array(F.array_distinct(c))


def rejected(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows that hold a null where the specification asks for a value, with the names of those columns."""
    bad = [F.when(F.col(c.name).isNull(), F.lit(c.name)) for c in spec.columns if not c.nullable and c.name in df.columns]
    names = F.array_compact(F.array(*bad)) if bad else F.array().cast(T.ArrayType(T.StringType()))
    return df.withColumn("_missing", names).where(F.size("_missing") > 0)
