"""Declared schemas as tables of properties: validation, comparison and migration.

A schema is a table (object, property, public_name, type, object_type,
origin, is_primary, is_indexed, is_fulltext, is_nullable, is_computed,
table_type, ordinal), one row a property; ordinal is its place within the
object.  Comparing two schemas is a full outer join.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.convert import SPARK_TYPES, convert_column, or_default
from ..sources.catalog import current_metadata, put_metadata, remove_metadata
from ..sources.spec import TABLE_KINDS, ColumnSpec, SpecError, TableSpec

PROPERTIES = (
    "object string, property string, public_name string, type string, object_type string, origin string, is_primary boolean, "
    "is_indexed boolean, is_fulltext boolean, is_nullable boolean, is_computed boolean, table_type string, ordinal int"
)
_DEFAULTS = {
    "public_name": "", "object_type": "", "origin": "", "is_primary": False, "is_indexed": False, "is_fulltext": False,
    "is_nullable": False, "is_computed": False, "table_type": "top_level",
}
# Kinds of change.
CHANGES = (
    "AddTable", "RemoveTable", "ChangeTableType", "AddInitialProperties", "AddProperty", "RemoveProperty", "ChangePropertyType",
    "MakePropertyNullable", "MakePropertyRequired", "AddIndex", "RemoveIndex", "ChangePrimaryKey",
)


def properties(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A schema from dictionaries; whatever isn't given has its default, and properties count in the order given."""
    names = [c.split()[0] for c in PROPERTIES.split(", ")]
    seen: dict[str, int] = {}
    full = []
    for r in rows:
        seen[r["object"]] = seen.get(r["object"], -1) + 1
        full.append({**_DEFAULTS, "ordinal": seen[r["object"]], **r})
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], PROPERTIES)


def of_tables(spark: SparkSession, tables: dict[str, DataFrame], primary: dict[str, str] | None = None) -> DataFrame:
    """The schema that tables have: a property for each column, all nullable but the primary key."""
    rows = []
    for name, df in tables.items():
        for f in df.schema.fields:
            kind = next((k for k, t in SPARK_TYPES.items() if t == f.dataType), f.dataType.simpleString())
            key = (primary or {}).get(name) == f.name
            rows.append({"object": name, "property": f.name, "type": kind, "is_primary": key, "is_nullable": not key})
    return properties(spark, rows)


def validate(schema: DataFrame) -> DataFrame:
    """(object, property, problem) of everything that is wrong, in one pass and two small joins."""
    objects = schema.select(F.col("object").alias("_known")).distinct()
    is_link = F.col("type").isin("link", "typedlink")

    def problem(where: Column, text: str) -> DataFrame:
        return schema.where(where).select("object", "property", F.lit(text).alias("problem"))

    linked = schema.where(is_link & (F.col("object_type") != ""))
    lost = linked.join(objects, F.col("object_type") == F.col("_known"), "left_anti")
    primary = schema.where("is_primary").groupBy("object").agg(F.count("*").alias("n"), F.min("property").alias("property")).where("n > 1")
    twice = schema.groupBy("object", "property").agg(F.count("*").alias("n")).where("n > 1")
    return reduce(DataFrame.unionByName, [
        problem(F.coalesce(F.col("object"), F.lit("")) == "", "object has no name"),
        problem(F.coalesce(F.col("property"), F.lit("")) == "", "property has no name"),
        problem(F.col("is_primary") & F.col("is_nullable"), "primary key is nullable"),
        problem(is_link & (F.col("object_type") == ""), "link has no object type"),
        problem((F.col("origin") != "") & (F.col("object_type") == ""), "backlink has no object type"),
        lost.select("object", "property", F.lit("link target is missing").alias("problem")),
        primary.select("object", "property", F.lit("more than one primary key").alias("problem")),
        twice.select("object", "property", F.lit("property is declared twice").alias("problem")),
    ])


def find_property(schema: DataFrame, name: str) -> DataFrame:
    """Properties of a name or, failing that for an object, of a public name."""
    public = F.coalesce(F.nullif("public_name", F.lit("")), "property")
    return schema.where((F.col("property") == name) | (public == name))


def find(schema: DataFrame, name: str) -> DataFrame:
    """The properties of an object."""
    return schema.where(F.col("object") == name)


def find_by_table_key(schema: DataFrame, tables: DataFrame, key: int) -> DataFrame:
    """The properties of the object whose table has a key; ``tables`` is (object, table_key)."""
    return schema.join(tables.where(F.col("table_key") == key).select("object"), "object", "left_semi")


def equal(a: DataFrame, b: DataFrame, ordered: bool = True) -> bool:
    """Whether two schemas hold the same rows; ``ordered`` asks for the same order of properties too."""
    columns = [c for c in a.columns if ordered or c != "ordinal"]
    a, b = a.select(columns), b.select(columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(object, property, change): what leads from one schema to the other; property is empty for changes of a table.

    A new table is both AddTable and AddInitialProperties.  Removing a primary
    key is no change, and computed properties are no part of it.
    """
    old, new = (s.where(~F.col("is_computed")) for s in (old, new))

    def tables(s: DataFrame, side: str) -> DataFrame:
        primary = F.max(F.when(F.col("is_primary"), F.col("property")))
        return s.groupBy("object").agg(F.first("table_type").alias(f"{side}_type"), F.coalesce(primary, F.lit("")).alias(f"{side}_pk"))

    both = tables(old, "old").join(tables(new, "new"), "object", "full_outer")
    gone, fresh = F.col("new_type").isNull(), F.col("old_type").isNull()
    changes = F.array_compact(F.array(
        F.when(fresh, F.struct(F.lit("").alias("property"), F.lit("AddTable").alias("change"))),
        F.when(fresh, F.struct(F.lit("").alias("property"), F.lit("AddInitialProperties").alias("change"))),
        F.when(gone, F.struct(F.lit("").alias("property"), F.lit("RemoveTable").alias("change"))),
        F.when(F.col("old_type") != F.col("new_type"), F.struct(F.lit("").alias("property"), F.lit("ChangeTableType").alias("change"))),
        F.when(
            (F.col("old_pk") != F.col("new_pk")) & (F.col("new_pk") != ""),
            F.struct(F.col("new_pk").alias("property"), F.lit("ChangePrimaryKey").alias("change")),
        ),
    ))
    of_tables = both.select("object", F.explode(changes).alias("x")).select("object", "x.property", "x.change")

    kept = both.where(~gone & ~fresh).select("object")
    cols = ["type", "object_type", "is_nullable", "is_indexed"]

    def side(s: DataFrame, name: str) -> DataFrame:
        return s.join(kept, "object", "left_semi").select("object", "property", *[F.col(c).alias(f"{name}_{c}") for c in cols])

    pairs = side(old, "old").join(side(new, "new"), ["object", "property"], "full_outer")
    here = F.col("old_type").isNotNull() & F.col("new_type").isNotNull()
    kinds = F.array_compact(F.array(
        F.when(F.col("old_type").isNull(), "AddProperty"),
        F.when(F.col("new_type").isNull(), "RemoveProperty"),
        F.when(here & ((F.col("old_type") != F.col("new_type")) | (F.col("old_object_type") != F.col("new_object_type"))), "ChangePropertyType"),
        F.when(here & ~F.col("old_is_nullable") & F.col("new_is_nullable"), "MakePropertyNullable"),
        F.when(here & F.col("old_is_nullable") & ~F.col("new_is_nullable"), "MakePropertyRequired"),
        F.when(here & ~F.col("old_is_indexed") & F.col("new_is_indexed"), "AddIndex"),
        F.when(here & F.col("old_is_indexed") & ~F.col("new_is_indexed"), "RemoveIndex"),
    ))
    of_properties = pairs.select("object", "property", F.explode(kinds).alias("change"))
    return of_tables.unionByName(of_properties)


def describe(change: dict) -> str:
    """A change in words."""
    target = f"{change['object']}.{change['property']}" if change["property"] else change["object"]
    return f"{change['change']}({target})"


def same_changes(a: list[dict], b: list[dict]) -> bool:
    """Whether two lists hold the same changes in the same order."""
    key = lambda c: (c["object"], c["property"], c["change"])
    return list(map(key, a)) == list(map(key, b))


def visit(changes: list[dict], handlers: dict[str, Callable[[dict], None]], other: Callable[[dict], None] | None = None) -> int:
    """Hand each change to the handler of its kind; without one, to ``other`` or, if there is none, fail.  How many there were."""
    for c in changes:
        handler = handlers.get(c["change"], other)
        if handler is None:
            raise ValueError(f"nothing handles {describe(c)}")
        handler(c)
    return len(changes)


def _noted(df: DataFrame, name: str, **about) -> DataFrame:
    """A column whose metadata says more."""
    return df.withMetadata(name, {**df.schema[name].metadata, **about})


def _unique(df: DataFrame, name: str) -> DataFrame:
    """Fail if a column can't be a primary key."""
    if not df.where(F.col(name).isNull()).isEmpty() or not df.groupBy(name).count().where("count > 1").isEmpty():
        raise ValueError(f"{name} can't be a primary key: it holds nulls or repeated values")
    return df


def apply(df: DataFrame, name: str, changes: list[dict], new: dict[str, str]) -> DataFrame:
    """Carry the changes of one table's properties out on its data; ``new`` maps properties to their new types.

    A required property's nulls become its type's default; a text whose type
    changes to a number becomes null.  Indexes, nullability and the primary
    key are noted in the columns' metadata, the key after it has been checked.
    Changes of whole tables belong to ``apply_to`` and are an error here.
    """
    for c in changes:
        p, change = c["property"], c["change"]
        if c["object"] != name:
            continue
        if change == "AddProperty":
            df = df.withColumn(p, F.lit(None).cast(SPARK_TYPES[new[p]]))
        elif change == "RemoveProperty":
            df = df.drop(p)
        elif change == "ChangePropertyType":
            df = df.withColumn(p, convert_column(F.col(p), df.schema[p].dataType, new[p]))
        elif change == "MakePropertyRequired":
            df = _noted(df.withColumn(p, or_default(F.col(p), new[p])), p, nullable=False)
        elif change == "MakePropertyNullable":
            df = _noted(df, p, nullable=True)
        elif change in ("AddIndex", "RemoveIndex"):
            df = _noted(df, p, indexed=change == "AddIndex")
        elif change == "ChangePrimaryKey":
            df = _noted(_unique(df, p), p, primary_key=True)
        else:
            raise ValueError(f"{describe(c)} isn't a change of a property")
    return df


def apply_to(catalog, changes: list[dict], new: DataFrame) -> None:
    """Carry all changes out on a catalog: new tables, removed ones, kinds of tables, and those of properties; ``new`` is the new schema.

    Nothing is registered before every change has been planned.
    """
    by: dict[str, list[dict]] = {}
    for r in new.collect():  # one row a property
        by.setdefault(r["object"], []).append(r.asDict())

    def spec_of(name: str) -> TableSpec:
        own = sorted(by[name], key=lambda p: p["ordinal"])
        columns = tuple(
            ColumnSpec(p["property"], p["type"], p["is_nullable"], attributes=frozenset(["indexed"] if p["is_indexed"] else [])) for p in own if not p["is_computed"]
        )
        primary = next((p["property"] for p in own if p["is_primary"]), None)
        return TableSpec(name, columns, primary, own[0]["table_type"] if own[0]["table_type"] in TABLE_KINDS else "top_level")

    done: dict[str, tuple] = {}
    gone = []
    for name in dict.fromkeys(c["object"] for c in changes):
        own = [c for c in changes if c["object"] == name]
        kinds = {c["change"] for c in own}
        if "RemoveTable" in kinds:
            gone.append(name)
        elif "AddTable" in kinds:
            spec = spec_of(name)
            done[name] = (catalog.spark.createDataFrame([], spec.schema()), spec)
        else:
            of_table = {"ChangeTableType"}
            types = {p["property"]: p["type"] for p in by[name]}
            done[name] = (apply(catalog.table(name), name, [c for c in own if c["change"] not in of_table], types), spec_of(name))
    for name, (df, spec) in done.items():
        catalog.register(name, df, spec)
    for name in gone:
        catalog.drop(name)


class SchemaStore:
    """Schemas by name, as JSON in a table of metadata (key, seq, value): whoever has the table has the schemas."""

    PREFIX = "schema:"

    def __init__(self, metadata: DataFrame):
        self.metadata = metadata

    def store(self, name: str, schema: DataFrame, version: int = 1) -> None:
        rows = [r.asDict() for r in schema.orderBy("object", "ordinal", "property").collect()]  # one row a property
        self.metadata = put_metadata(self.metadata, self.PREFIX + name, json.dumps({"version": version, "properties": rows}).encode())

    def _entry(self, name: str) -> dict | None:
        row = current_metadata(self.metadata).where(F.col("key") == self.PREFIX + name).first()
        return json.loads(bytes(row["value"])) if row is not None else None

    def load(self, name: str) -> DataFrame:
        found = self._entry(name)
        if found is None:
            raise KeyError(f"no schema {name!r}")
        return properties(self.metadata.sparkSession, found["properties"])

    def version(self, name: str) -> int | None:
        found = self._entry(name)
        return found["version"] if found else None

    def frame(self) -> DataFrame:
        """(name, version, properties) of every stored schema."""
        kept = current_metadata(self.metadata).where(F.startswith("key", F.lit(self.PREFIX)))
        text = F.col("value").cast("string")
        return kept.select(
            F.substr("key", F.lit(len(self.PREFIX) + 1)).alias("name"), F.get_json_object(text, "$.version").cast("int").alias("version"),
            F.json_array_length(F.get_json_object(text, "$.properties")).alias("properties"),
        )

    def names(self) -> list[str]:
        return sorted(r["name"] for r in self.frame().collect())

    def has(self, name: str) -> bool:
        return self._entry(name) is not None

    def remove(self, name: str) -> None:
        self.metadata = remove_metadata(self.metadata, self.PREFIX + name)

    def validate(self, name: str, schema: DataFrame, version: int = 1) -> None:
        """Fail if the stored schema is another one, or of another version."""
        if self.version(name) != version or not equal(self.load(name), schema):
            raise SpecError(f"schema {name!r} differs from the stored one")


def migrate(df: DataFrame, stored: int, target: int, steps: dict[int, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Run the migrations of versions ``stored + 1`` to ``target``; one that is missing fails before any runs."""
    versions = range(stored + 1, target + 1)
    missing = [v for v in versions if v not in steps]
    if missing:
        raise KeyError(f"no migrations to versions {missing}")
    return reduce(lambda d, v: d.transform(steps[v]), versions, df)
