"""Index look-ups as derived tables: values to keys, words to keys, and ordered key ranges.

An index isn't kept: a posting table is a projection of its table, and a
look-up is a filter that reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokenise
from ..sources.storage import materialise, save_bucketed, with_row_index

#: Types that a string index takes; other values are indexed by their text.
INDEXED_TYPES = (T.StringType, T.LongType, T.IntegerType, T.BooleanType, T.TimestampType, T.TimestampNTZType)
#: Range joins, as powers of two: the longest range that is found by cells of keys; rows of a cell, and rows and ranges of a tile at most.
NARROW, CELL_ROWS, TILE_ROWS, TILE_RANGES = 12, 8, 14, 14
#: So many tiles at least, where cells allow it; and partitions up to which each tile gets its own.
LEAST_TILES, TILE_PARTS = 64, 2000


def supports(kind: T.DataType) -> bool:
    return isinstance(kind, INDEXED_TYPES)


def postings(df: DataFrame, key: str, column: str) -> DataFrame:
    """(value, key): what a string index holds; null values aren't indexed."""
    return df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value"), F.col(key).alias("key"))


def put(index: DataFrame, value: str, key: int) -> DataFrame:
    """An entry more; one that is there already isn't doubled."""
    kind = index.schema["key"].dataType
    row = index.sparkSession.range(1).select(F.lit(value).alias("value"), F.lit(key).cast(kind).alias("key"))
    return index.unionByName(row).distinct()


def replace(index: DataFrame, key: int, value: str) -> DataFrame:
    """The key's only value is now ``value``."""
    return put(erase(index, key), value, key)


def erase(index: DataFrame, key: int, value: str | None = None) -> DataFrame:
    """Without the key, or without the key at one value."""
    hit = F.col("key") == key
    return index.where(~(hit if value is None else hit & (F.col("value") == value)))


def find_all(index: DataFrame, value: str) -> DataFrame:
    return index.where(F.col("value") == value).select("key")


def find_first(index: DataFrame, value: str) -> DataFrame:
    return find_all(index, value).orderBy("key").limit(1)


def count(index: DataFrame, value: str) -> DataFrame:
    return find_all(index, value).agg(F.count("*").cast("long").alias("n"))


def find_prefix(index: DataFrame, prefix: str) -> DataFrame:
    """Keys whose value begins with a prefix, in order."""
    return index.where(F.startswith("value", F.lit(prefix))).select("key").distinct().orderBy("key")


def duplicates(index: DataFrame) -> DataFrame:
    """Entries that stand more than once: none in a sound index."""
    return index.groupBy("value", "key").agg(F.count("*").cast("long").alias("n")).where("n > 1")


def fulltext(df: DataFrame, key: str, column: str) -> DataFrame:
    """(token, key): each different word of each text."""
    return df.select(F.explode(tokenise(F.col(column))).alias("token"), F.col(key).alias("key"))


def search(df: DataFrame, key: str, column: str, words: list[str]) -> DataFrame:
    """Keys of texts that have all words."""
    tokens = tokenise(F.col(column))
    wanted = [w.lower() for w in words]
    return df.where(F.size(F.array_intersect(tokens, F.lit(wanted))) == len(set(wanted))).select(key)


def document_frequencies(df: DataFrame, key: str, column: str) -> DataFrame:
    """(token, n, first_key, last_key): how many texts have each word.  Posting lists stay rows: a common word's would be unbounded."""
    found = fulltext(df, key, column)
    return found.groupBy("token").agg(F.count("*").cast("long").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def key_range(df: DataFrame, key: str, start: object, end: object) -> DataFrame:
    """Rows with keys from ``start`` to ``end``, both included, in order."""
    return df.where(F.col(key).between(start, end)).orderBy(key)


def seek(df: DataFrame, key: str, target: object) -> DataFrame:
    """The row of the least key that isn't below ``target``."""
    return df.where(F.col(key) >= F.lit(target)).orderBy(key).limit(1)


def step(df: DataFrame, key: str, target: object, forward: bool = True) -> DataFrame:
    """The row after, or before, a key."""
    if forward:
        return df.where(F.col(key) > F.lit(target)).orderBy(F.col(key).asc()).limit(1)
    return df.where(F.col(key) < F.lit(target)).orderBy(F.col(key).desc()).limit(1)


def neighbours(df: DataFrame, key: str, group: str) -> DataFrame:
    """Each row's key with the ones before and after it within its group."""
    w = Window.partitionBy(group).orderBy(key)
    return df.select(group, key, F.lag(key).over(w).alias("prev_key"), F.lead(key).over(w).alias("next_key"))


def where_ordered(df: DataFrame, key: str, condition) -> DataFrame:
    """Rows that fulfil a condition, in order of the key."""
    return df.where(condition).orderBy(key)


def multi_range(df: DataFrame, key: str, ranges: list[tuple[object, object]]) -> DataFrame:
    """(range_id, row) for each of several inclusive ranges that a row's key lies in; overlapping ranges give a row each.

    The ranges are few and given by the caller, so each row meets them in an
    array of literals: no join and no shuffle.
    """
    hits = F.array_compact(F.array(*[F.when(F.col(key).between(a, b), F.lit(i)) for i, (a, b) in enumerate(ranges)]))
    return df.withColumn("range_id", F.explode(hits))


def range_join(df: DataFrame, key: str, ranges: DataFrame, width: int = 1) -> DataFrame:
    """Rows joined with a table of inclusive ranges (range_id, start, end) of integer keys, of any length.

    A range lies in one or two cells of a size that is a power of two, at
    least ``width`` and longer than the range; a key stands in one cell of
    each size that occurs.  So neither a range nor a key makes many rows, and
    it is an equi join.  Where a range is longer than 2^NARROW keys, a cell
    would hold too many of both: rows and ranges then meet in tiles.

    Spark takes the keys for as few as before they stand in cells, hence the
    hint: they must not be broadcast.
    """
    least = max(int(width) - 1, 0).bit_length()
    length = F.length(F.bin(F.try_subtract(F.col("end").cast("long"), F.col("start").cast("long"))))
    level = F.greatest(F.lit(least), F.coalesce(length, F.lit(63))).cast("int")
    sized = ranges.where("start <= `end`").withColumn("_level", level)
    levels = [r["_level"] for r in sized.select("_level").distinct().collect()]  # 64 at most
    if not levels:
        levels = [least]
    if max(levels) > max(NARROW, least):
        return _tiled_range_join(df, key, sized.drop("_level"))
    cell = F.array_distinct(F.array(F.expr("shiftright(CAST(start AS BIGINT), _level)"), F.expr("shiftright(CAST(`end` AS BIGINT), _level)")))
    cells = sized.withColumn("_cell", F.explode(cell))
    own = df.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in sorted(levels)])))
    own = own.withColumn("_cell", F.expr(f"shiftright(CAST(`{key}` AS BIGINT), _level)"))
    return own.hint("merge").join(cells, ["_level", "_cell"]).where(F.col(key).between(F.col("start"), F.col("end"))).drop("_level", "_cell")


def _tiled_range_join(df: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    """The same for ranges of which some hold very many rows.

    Rows are numbered by key, and 2^CELL_ROWS of them are a cell, one array.
    A range covers the cells from the one that may hold its start to the one
    that may hold its end.  Up to 2^TILE_ROWS rows in cells that follow each
    other and 2^TILE_RANGES ranges, by start, are a tile, which bounds what one
    value of the join's keys makes; cells and ranges are copied to their tiles.

    In a tile a cell gives its rows for one range after the other.  So the same
    few rows come again soon and a range's number stands in runs, which files
    of the result compress well; it is by far the largest thing here.
    """
    cell_rows = min(CELL_ROWS, TILE_ROWS)
    at, start, end = F.col(key).cast("long"), F.col("start").cast("long"), F.col("end").cast("long")
    rows = with_row_index(df.where(at.isNotNull()).withColumn("_r", F.monotonically_increasing_id()), at, "_r", name="_n")
    rows = rows.withColumn("_cell", F.shiftright("_n", cell_rows))
    held = with_row_index(ranges, start, end, name="_s")
    # How many cells begin before a start or not after an end: its number among ends and cells, less that among ends.
    ends = F.array(F.struct(start.alias("_v"), F.lit(0).alias("_o")), F.struct(end.alias("_v"), F.lit(2).alias("_o")))
    points = with_row_index(held.select("_s", F.inline(ends)), "_v", "_o", "_s", name="_p")
    begins = rows.groupBy("_cell").agg(F.min(at).alias("_v")).select(F.lit(-1).cast("long").alias("_s"), "_v", F.lit(1).alias("_o"), F.lit(0).cast("long").alias("_p"))
    placed = with_row_index(points.unionByName(begins), "_v", "_o", "_s", name="_u").where("_o <> 1")
    begun = F.col("_u") - F.col("_p")
    covered = placed.groupBy("_s").agg(F.greatest(F.min(begun) - 1, F.lit(0)).alias("_first"), (F.max(begun) - 1).alias("_last")).where("_first <= _last")
    spans = materialise(held.join(covered.hint("merge"), "_s").withColumn("_group", F.shiftright("_s", TILE_RANGES)).drop("_s"))
    n, last, group = (x or 0 for x in spans.agg(F.sum(F.col("_last") - F.col("_first") + 1), F.max("_last"), F.max("_group")).first())
    side = min(TILE_ROWS - cell_rows, max(((last + 1) * (group + 1) // LEAST_TILES).bit_length() - 1, 0))
    spans = spans.withColumn("_first", F.shiftright("_first", side)).withColumn("_last", F.shiftright("_last", side))
    block = F.explode(F.sequence("_first", "_last")).alias("_block")
    tiles = materialise(spans.select("_group", "_first", "_last").distinct().select("_group", block).distinct())
    parts = max(1, min(2 * tiles.count(), max(TILE_PARTS, n >> 17)))
    cells = rows.groupBy("_cell").agg(F.min(at).alias("_low"), F.max(at).alias("_high"), F.collect_list(F.struct(*df.columns)).alias("_rows"))
    cells = cells.withColumn("_block", F.shiftright("_cell", side)).drop("_cell").join(tiles.hint("merge"), "_block")
    # The right side's rows of a tile are held: the ranges.
    left, right = (x.repartition(parts, "_block", "_group") for x in (cells, spans.select(*ranges.columns, "_group", block)))
    found = left.hint("merge").join(right, ["_block", "_group"]).where((F.col("_low") <= end) & (F.col("_high") >= start))
    inside = F.filter("_rows", lambda r: r[key].cast("long").between(start, end))
    # A column first, as Spark generates no code for a filter and what is in one step with it.
    found = found.withColumn("_rows", F.when((F.col("_low") >= start) & (F.col("_high") <= end), F.col("_rows")).otherwise(inside))
    found = found.select(*ranges.columns, F.explode("_rows").alias("_row"))
    return found.select(*[F.col("_row")[c].alias(c) for c in df.columns], *ranges.columns)


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key."""
    return df.where(F.col(key) == F.lit(value))


def clear(index: DataFrame) -> DataFrame:
    """An index without entries."""
    return index.limit(0)


def save(index: DataFrame, table: str, buckets: int = 64) -> DataFrame:
    """Save the postings in buckets of their values, sorted: a look-up then reads one bucket."""
    return save_bucketed(index, table, index.columns[0], buckets)


def load(spark: SparkSession, table: str) -> DataFrame:
    """The postings that were saved."""
    return spark.table(table)


def disorder(df: DataFrame, key: str, position: str, group: str | None = None) -> DataFrame:
    """Rows (position, key, previous) whose key isn't above that of the row before them: none where a table is in order.

    ``position`` says in which order the rows stand, within each ``group`` or,
    without one, in the whole table; there every row is numbered and meets the
    one before by number, in no single task.
    """
    if group is not None:
        w = Window.partitionBy(group).orderBy(position)
        rows = df.select(group, position, key, F.lag(key).over(w).alias("previous"))
        return rows.where(F.col("previous") >= F.col(key))
    own = with_row_index(df.select(position, key), position, name="_n")
    before = own.select((F.col("_n") + 1).alias("_n"), F.col(key).alias("previous"))
    return own.join(before, "_n").where(F.col("previous") >= F.col(key)).select(position, key, "previous")
