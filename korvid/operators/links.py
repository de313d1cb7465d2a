"""Links between tables: following them, backlinks, link sets, embedded objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialise

#: Elements of a list that is made of rows; rows of a target that has more stay rows.
MOST_IN_LIST = 100_000


def unresolved(link: Column, zero_is_null: bool = False) -> Column:
    """A link that leads nowhere; in tables whose keys start at 1, key 0 does too."""
    return link.isNull() | (link == 0) if zero_is_null else link.isNull()


def follow(df: DataFrame, link: str, target: DataFrame, target_key: str, columns: list[str]) -> DataFrame:
    """Add columns of the object that a link leads to; null where it leads nowhere."""
    clash = set(columns) & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in both tables: rename them first")
    right = target.select(F.col(target_key).alias("_target"), *columns)
    return df.join(right, F.col(link) == F.col("_target"), "left").drop("_target")


def dangling(df: DataFrame, link: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose link is set and leads to no object."""
    keys = target.select(F.col(target_key).alias("_target"))
    return df.where(F.col(link).isNotNull()).join(keys, F.col(link) == F.col("_target"), "left_anti")


def existing(df: DataFrame, link: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose link leads to an object."""
    keys = target.select(F.col(target_key).alias("_target"))
    return df.join(keys, F.col(link) == F.col("_target"), "left_semi")


def follow_typed(df: DataFrame, table: str, link: str, targets: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Follow links whose target table stands in a column: one join a table, each over its own links only.

    ``targets`` maps a table's name to (table, key, column to fetch); the
    fetched value is ``target_value``, as text.
    """
    parts = []
    for name, (target, key, column) in targets.items():
        own = df.where(F.col(table) == name)
        right = target.select(F.col(key).alias("_target"), F.col(column).cast("string").alias("target_value"))
        parts.append(own.join(right, F.col(link) == F.col("_target"), "left").drop("_target"))
    rest = df.where(F.col(table).isNull() | ~F.col(table).isin(*targets)).withColumn("target_value", F.lit(None).cast("string"))
    return reduce(DataFrame.unionByName, [*parts, rest])


def backlinks(df: DataFrame, link: str, key: str) -> DataFrame:
    """(target, origin): a row for each object that points at another; never stored, always computed."""
    return df.where(F.col(link).isNotNull()).select(F.col(link).alias("target"), F.col(key).alias("origin"))


def backlink_counts(target: DataFrame, target_key: str, df: DataFrame, link: str) -> DataFrame:
    """Each target's key and how many objects point at it, 0 included; counted before the join."""
    counted = df.where(F.col(link).isNotNull()).groupBy(F.col(link).alias("_link")).agg(F.count("*").alias("_n"))
    joined = target.select(target_key).join(counted, F.col(target_key) == F.col("_link"), "left")
    return joined.select(target_key, F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"))


def _bounded(df: DataFrame, by: str, most: int) -> None:
    """Fail, before any list is made, if a group has more rows than a list may hold."""
    worst = df.groupBy(by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if worst > most:
        raise ValueError(f"{worst} rows of one {by} are too many for a list of at most {most}: use the rows themselves")


def backlink_lists(df: DataFrame, link: str, key: str, most: int = MOST_IN_LIST) -> DataFrame:
    """(target, origins, n): the sorted keys that point at each target; a target that more than ``most`` point at is an error."""
    found = backlinks(df, link, key)
    _bounded(found, "target", most)
    return found.groupBy("target").agg(F.sort_array(F.collect_list("origin")).alias("origins"), F.count("*").cast("long").alias("n"))


def invalid_backlinks(found: DataFrame, df: DataFrame, link: str, key: str) -> DataFrame:
    """Backlinks (target, origin) that no link backs."""
    return found.join(backlinks(df, link, key), ["target", "origin"], "left_anti")


def set_add(links: Column, key: Column) -> Column:
    """Link sets are lists: adding what is there already makes it stand twice."""
    return F.array_append(links, key)


def set_remove(links: Column, key: Column) -> Column:
    """Without the first occurrence of a link."""
    at = F.array_position(links, key).cast("int")
    return F.when(at > 0, F.concat(F.slice(links, 1, at - 1), F.slice(links, at + 1, F.size(links)))).otherwise(links)


def set_contains(links: Column, key: Column) -> Column:
    return F.array_contains(links, key)


def set_size(links: Column) -> Column:
    return F.size(links)


def typed_contains_target(links: Column, table: Column, key: Column) -> Column:
    """Whether a set of typed links holds one to an object, whatever its type."""
    return F.exists(links, lambda x: (x["table_key"] == table) & (x["obj_key"] == key))


def typed_of_type(links: Column, type_info: int) -> Column:
    return F.filter(links, lambda x: x["type_info"] == type_info)


def embed(parent: DataFrame, parent_key: str, child: DataFrame, link: str, columns: list[str], name: str, most: int = MOST_IN_LIST) -> DataFrame:
    """Parents with their children as an array of structs, sorted; a parent of more than ``most`` is an error."""
    _bounded(child.where(F.col(link).isNotNull()), link, most)
    nested = child.groupBy(F.col(link).alias("_parent")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    joined = parent.join(nested, F.col(parent_key) == F.col("_parent"), "left").drop("_parent")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))


def unnest(df: DataFrame, name: str) -> DataFrame:
    """A row for each embedded object, its fields beside the parent's columns."""
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode(name).alias("_x")).select(*rest, "_x.*")


def cascade_delete(df: DataFrame, link: str, deleted: DataFrame, deleted_key: str) -> DataFrame:
    """What is left of a table when the objects that its rows belong to are deleted."""
    keys = deleted.select(F.col(deleted_key).alias("_gone"))
    return df.join(keys, F.col(link) == F.col("_gone"), "left_anti")


def cascade(gone: DataFrame, gone_key: str, levels: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """What is left of each of several tables, each (table, key, link) linking to the one before it, when objects are deleted.

    What a level loses is what the next one's links are checked against.
    """
    left = []
    for df, key, link in levels:
        keys = materialise(gone.select(F.col(gone_key).alias("_gone")).where("_gone IS NOT NULL").distinct())
        lost = F.col(link) == F.col("_gone")
        left.append(df.join(keys, lost, "left_anti"))
        gone, gone_key = df.join(keys, lost, "left_semi"), key
    return left


def cascade_tree(df: DataFrame, key: str, parent: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """What is left of a table whose rows link to parents in the same table when some are deleted with all below them.

    A round for each level; the keys found so far are written, so rounds don't
    pile up, and a circle of links ends it as well.
    """
    found = new = materialise(gone.select(F.col(gone_key).alias("_gone")).where("_gone IS NOT NULL").distinct())
    while not new.isEmpty():
        below = df.join(new, F.col(parent) == F.col("_gone"), "left_semi").select(F.col(key).alias("_gone")).distinct()
        new = materialise(below.join(found, "_gone", "left_anti"))
        found = materialise(found.unionAll(new))
    return df.join(found, F.col(key) == F.col("_gone"), "left_anti")
