"""Table specifications: columns, attributes, validation, and their form as Spark schemas."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.convert import SPARK_TYPES
from ..functions.keys import MAX_COLUMNS

# Attribute bits and limits of names.
ATTRIBUTES = {
    "indexed": 1, "unique": 2, "primary_key": 4, "nullable": 16, "auto_increment": 32, "list": 64, "set": 128, "dict": 256,
    "backlink": 512, "strong_links": 1024, "weak_links": 2048, "fulltext": 4096, "encrypted": 8192,
}
COLLECTIONS = ("list", "set", "dict")
MAX_NAME = 63
TABLE_KINDS = ("top_level", "embedded", "asymmetric")


class SpecError(ValueError):
    """A specification that contradicts itself, or a value that doesn't fit it."""


@dataclass(frozen=True)
class ColumnSpec:
    """A column; ``collection`` is list, set or dict, ``type`` then being the type of the elements."""

    name: str
    type: str
    nullable: bool = False
    collection: str | None = None
    key_type: str | None = None
    attributes: frozenset[str] = frozenset()
    link_target: str | None = None

    def spark_type(self) -> T.DataType:
        kind = SPARK_TYPES[self.type]
        if self.collection == "dict":
            return T.MapType(SPARK_TYPES[self.key_type or "string"], kind)
        return T.ArrayType(kind) if self.collection else kind

    def validate(self) -> None:
        if not 0 < len(self.name.encode()) <= MAX_NAME:
            raise SpecError(f"a column's name has 1 to {MAX_NAME} bytes: {self.name!r}")
        if self.type not in SPARK_TYPES:
            raise SpecError(f"{self.name}: no type {self.type!r}")
        if self.collection not in (None, *COLLECTIONS):
            raise SpecError(f"{self.name}: no collection {self.collection!r}")
        if (self.collection == "dict") != (self.key_type is not None):
            raise SpecError(f"{self.name}: a dictionary, and nothing else, has a key type")
        if self.key_type is not None and self.key_type not in SPARK_TYPES:
            raise SpecError(f"{self.name}: no type {self.key_type!r}")
        check_attributes(self)


def check_attributes(column: ColumnSpec) -> None:
    unknown = column.attributes - ATTRIBUTES.keys()
    if unknown:
        raise SpecError(f"{column.name}: no attributes {sorted(unknown)}")
    if len(column.attributes & set(COLLECTIONS)) + (column.collection is not None and column.collection not in column.attributes) > 1:
        raise SpecError(f"{column.name}: one kind of collection only")
    if "primary_key" in column.attributes and column.nullable:
        raise SpecError(f"{column.name}: a primary key isn't nullable")


@dataclass(frozen=True)
class TableSpec:
    """A table: top-level, embedded in a parent, or asymmetric (append only)."""

    name: str
    columns: tuple[ColumnSpec, ...] = ()
    primary_key: str | None = None
    kind: str = "top_level"
    parent: str | None = None

    def column(self, name: str) -> ColumnSpec:
        for c in self.columns:
            if c.name == name:
                return c
        raise SpecError(f"{self.name} has no column {name!r}")

    def validate(self) -> TableSpec:
        if not 0 < len(self.name.encode()) <= MAX_NAME:
            raise SpecError(f"a table's name has 1 to {MAX_NAME} bytes: {self.name!r}")
        if self.kind not in TABLE_KINDS:
            raise SpecError(f"no kind of table {self.kind!r}")
        if (self.kind == "embedded") != (self.parent is not None):
            raise SpecError("an embedded table, and no other, has a parent")
        if len(self.columns) > MAX_COLUMNS:
            raise SpecError(f"a table has {MAX_COLUMNS} columns at most")
        names = [c.name for c in self.columns]
        if len(set(names)) < len(names):
            raise SpecError(f"{self.name}: two columns have one name")
        for c in self.columns:
            c.validate()
        if self.primary_key is not None and self.column(self.primary_key).nullable:
            raise SpecError(f"{self.primary_key}: a primary key isn't nullable")
        return self

    def add(self, column: ColumnSpec) -> TableSpec:
        return replace(self, columns=(*self.columns, column)).validate()

    def remove(self, name: str) -> TableSpec:
        self.column(name)
        key = None if self.primary_key == name else self.primary_key
        return replace(self, columns=tuple(c for c in self.columns if c.name != name), primary_key=key)

    def with_attribute(self, name: str, attribute: str, on: bool = True) -> TableSpec:
        """Set or clear an attribute; a combination that isn't valid leaves the specification as it was and fails."""
        old = self.column(name)
        new = replace(old, attributes=old.attributes | {attribute} if on else old.attributes - {attribute})
        check_attributes(new)
        return replace(self, columns=tuple(new if c.name == name else c for c in self.columns))

    def with_attributes_of(self, attribute: str) -> list[str]:
        return [c.name for c in self.columns if attribute in c.attributes]

    def collections(self) -> list[str]:
        return [c.name for c in self.columns if c.collection]

    def schema(self) -> T.StructType:
        """The Spark schema; all fields may be null at rest, and ``nullable`` is kept as metadata for ``violations``."""
        fields = []
        for c in self.columns:
            about = {"nullable": c.nullable, "attributes": sorted(c.attributes)}
            if c.link_target:
                about["link_target"] = c.link_target
            fields.append(T.StructField(c.name, c.spark_type(), True, about))
        return T.StructType(fields)

    def hash(self) -> str:
        """Changes with the names, types and nullability of columns, not with their order."""
        rows = sorted((c.name, c.type, c.collection or "", c.nullable) for c in self.columns)
        return hashlib.sha256(json.dumps(rows).encode()).hexdigest()

    def to_json(self) -> str:
        body = asdict(self)
        for c in body["columns"]:
            c["attributes"] = sorted(c["attributes"])
        return json.dumps(body, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> TableSpec:
        body = json.loads(text)
        body["columns"] = tuple(ColumnSpec(**{**c, "attributes": frozenset(c["attributes"])}) for c in body["columns"])
        return cls(**body)


def attribute_bits(names: frozenset[str] | list[str]) -> int:
    return sum(ATTRIBUTES[n] for n in set(names))


def has_attribute(bits: Column, name: str) -> Column:
    return bits.bitwiseAND(ATTRIBUTES[name]) != 0


def set_attribute(bits: Column, name: str) -> Column:
    return bits.bitwiseOR(ATTRIBUTES[name])


def clear_attribute(bits: Column, name: str) -> Column:
    return bits.bitwiseAND(~ATTRIBUTES[name])


def check_value(column: ColumnSpec, value: object) -> None:
    """Fail if a value can't be set on a column."""
    if value is None:
        if not column.nullable:
            raise SpecError(f"{column.name} isn't nullable")
        return
    fits = {
        "int": lambda v: isinstance(v, int) and not isinstance(v, bool), "link": lambda v: isinstance(v, int) and not isinstance(v, bool),
        "bool": lambda v: isinstance(v, bool), "string": lambda v: isinstance(v, str), "uuid": lambda v: isinstance(v, str),
        "float": lambda v: isinstance(v, float), "double": lambda v: isinstance(v, float), "binary": lambda v: isinstance(v, bytes),
    }.get(column.type, lambda v: True)
    if column.collection:
        if not isinstance(value, dict if column.collection == "dict" else (list, tuple, set)):
            raise SpecError(f"{column.name} holds a {column.collection}")
        values = value.values() if isinstance(value, dict) else value
    else:
        values = [value]
    for v in values:
        if not fits(v):
            raise SpecError(f"{column.name} holds {column.type}, not {v!r}")


def violations(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(column, rows) of required columns that hold nulls: one pass over the table."""
    required = [c.name for c in spec.columns if not c.nullable]
    if not required:
        return df.sparkSession.createDataFrame([], "column string, rows long")
    counted = df.agg(*[F.count(F.when(F.col(n).isNull(), True)).alias(n) for n in required])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("rows")) for n in required]))
    return counted.select(pairs.alias("x")).select("x.column", "x.rows").where("rows > 0")


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")
