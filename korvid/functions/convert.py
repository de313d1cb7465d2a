"""Type conversions, validity and defaults, as column expressions.

Strict ANSI casts would fail a whole job on one bad value, so conversions
give null where a value can't be converted; ``invalid`` finds those rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that are booleans.
TRUE_TEXTS = ["1", "t", "T", "TRUE", "true", "True"]
FALSE_TEXTS = ["0", "f", "F", "FALSE", "false", "False"]
# What a type holds before anything is set.
DEFAULTS = {"int": 0, "bool": False, "string": "", "float": 0.0, "double": 0.0}
SPARK_TYPES = {
    "int": T.LongType(), "bool": T.BooleanType(), "string": T.StringType(), "float": T.FloatType(), "double": T.DoubleType(),
    "binary": T.BinaryType(), "timestamp": T.TimestampNTZType(), "decimal": T.DecimalType(34, 6), "link": T.LongType(),
    "objectid": T.BinaryType(), "uuid": T.StringType(), "mixed": T.VariantType(),
    "typedlink": T.StructType([T.StructField("table_key", T.LongType()), T.StructField("obj_key", T.LongType()), T.StructField("type_info", T.IntegerType())]),
}
_INTEGER, _NUMBER = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_int(c: Column, kind: T.DataType) -> Column:
    """Integers widen, fractions are cut toward zero, booleans are 1 and 0, texts must be plain decimal integers."""
    if isinstance(kind, T.StringType):
        return F.when(c.rlike(_INTEGER), c.try_cast("bigint"))
    return c.try_cast("bigint")


def to_bool(c: Column, kind: T.DataType) -> Column:
    """Numbers are true unless zero; texts are those that spell a boolean, else numbers."""
    if isinstance(kind, T.BooleanType):
        return c
    if isinstance(kind, T.StringType):
        number = F.when(c.rlike(_NUMBER), c.try_cast("double") != 0)
        return F.when(c.isin(*TRUE_TEXTS), True).when(c.isin(*FALSE_TEXTS), False).otherwise(number)
    return c.cast("double") != 0


def to_text(c: Column) -> Column:
    return c.cast("string")


def to_double(c: Column, kind: T.DataType, single: bool = False) -> Column:
    """Double, or float if ``single``; texts must be plain decimal numbers."""
    target = "float" if single else "double"
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast(target)
    if isinstance(kind, T.StringType):
        return F.when(c.rlike(_NUMBER), c.try_cast(target))
    return c.try_cast(target)


def convert(c: Column, kind: T.DataType, target: str) -> Column:
    """Null stays null; a value that can't be converted becomes null."""
    if target == "int":
        return to_int(c, kind)
    if target == "bool":
        return to_bool(c, kind)
    if target == "string":
        return to_text(c)
    if target in ("float", "double"):
        return to_double(c, kind, target == "float")
    return c.try_cast(SPARK_TYPES[target])


def convert_column(c: Column, kind: T.DataType, target: str) -> Column:
    """The narrower rules of changing a column's type: texts never become numbers or booleans."""
    if isinstance(kind, T.StringType) and target != "string":
        return F.lit(None).cast(SPARK_TYPES[target])
    return convert(c, kind, target)


def valid(c: Column, kind: T.DataType, target: str) -> Column:
    """Whether a value is null or can be converted."""
    return c.isNull() | convert(c, kind, target).isNotNull()


def or_default(c: Column, target: str) -> Column:
    """The value, or what its type holds before anything is set."""
    return F.coalesce(c, F.lit(DEFAULTS[target]).cast(SPARK_TYPES[target]))
