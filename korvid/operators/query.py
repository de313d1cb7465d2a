"""Queries over one table: predicate, order, limit, views and slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..plans.cache import PlanCache
from ..plans.predicate import Node
from ..sources.storage import SMALL_OFFSET, rows_between, with_row_index

_PLANS = PlanCache()


def ordering(columns: list[tuple[str, bool]], key: str) -> list[Column]:
    """Sort columns (name, ascending): nulls are the smallest values, and the key breaks ties."""
    out = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in columns]
    return out + ([] if any(c == key for c, _ in columns) else [F.col(key).asc_nulls_first()])


class Query:
    """A query being built; every method returns a new one.

    ``key`` is the unique column whose order is the order of insertion.  The
    source is a function, so that a view can be evaluated again on what the
    table holds then.
    """

    def __init__(self, source: DataFrame | Callable[[], DataFrame], key: str, nulls: str = "sql"):
        self._source: Callable[[], DataFrame] = source if callable(source) else lambda: source
        self.key, self.nulls = key, nulls
        self._where: list[str | Node | Column] = []
        self._sort: list[tuple[str, bool]] = []
        self._limit: int | None = None

    def _with(self, **changes) -> Query:
        new = Query(self._source, self.key, self.nulls)
        new._where, new._sort, new._limit = list(self._where), list(self._sort), self._limit
        for name, value in changes.items():
            setattr(new, name, value)
        return new

    def where(self, predicate: str | Node | Column) -> Query:
        """Predicates add up: a row must fulfil all of them."""
        return self._with(_where=[*self._where, predicate])

    def sort(self, *columns: tuple[str, bool] | str) -> Query:
        return self._with(_sort=[(c, True) if isinstance(c, str) else c for c in columns])

    def limit(self, n: int) -> Query:
        return self._with(_limit=n)

    def matches(self) -> DataFrame:
        """The rows that fulfil the predicate, in no order."""
        df = self._source()
        for p in self._where:
            df = df.where(p if isinstance(p, Column) else _PLANS.get(p, df.schema, self.nulls))
        return df

    def frame(self) -> DataFrame:
        """The first rows by key up to the limit, then sorted: a limit isn't a top-k here."""
        df = self.matches()
        if self._limit is not None:
            df = df.orderBy(F.col(self.key).asc_nulls_first()).limit(self._limit)
        return df.orderBy(*ordering(self._sort, self.key))

    def find_all(self) -> View:
        return View(self)

    def find_first(self) -> DataFrame:
        """The matching row of the smallest key; no row if none matches.  Sorting has no effect on it."""
        return self.matches().orderBy(F.col(self.key).asc_nulls_first()).limit(1)

    def top_k(self, n: int) -> DataFrame:
        """The first ``n`` rows in the order of the sort columns."""
        return self.matches().orderBy(*ordering(self._sort, self.key)).limit(n)

    def count(self) -> DataFrame:
        """One row, n: how many rows match."""
        return self.matches().agg(F.count("*").cast("long").alias("n"))

    def evaluate(self, key: object) -> bool:
        """Whether the row of a key matches."""
        return not self.matches().where(F.col(self.key) == F.lit(key)).isEmpty()

    def page(self, offset: int, n: int) -> DataFrame:
        """Rows ``offset`` to ``offset + n`` in sort order."""
        return rows_between(self.matches(), ordering(self._sort, self.key), offset, n)

    def keys(self) -> DataFrame:
        """The keys of the matching rows, in order."""
        return self.matches().select(self.key).orderBy(F.col(self.key).asc_nulls_first())


class View:
    """A query's result; it follows the table when asked to."""

    def __init__(self, query: Query):
        self._query, self.in_sync = query, True
        self.df = query.frame()
        self._numbered: DataFrame | None = None

    @property
    def key(self) -> str:
        return self._query.key

    def size(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def objects_at(self, i: int) -> DataFrame:
        """The row at a place, as a table of one row or none; far places are found by row numbers, which are made once."""
        if i < 0:
            return self.df.limit(0)
        if i < SMALL_OFFSET:
            return self.df.offset(i).limit(1)
        if self._numbered is None:
            self._numbered = with_row_index(self.df, *ordering(self._query._sort, self.key), name="_korvid_row")
        return self._numbered.where(F.col("_korvid_row") == i).drop("_korvid_row")

    def object_at(self, i: int) -> Row | None:
        rows = self.objects_at(i).collect()
        return rows[0] if rows else None

    def key_at(self, i: int) -> object:
        row = self.object_at(i)
        return row[self.key] if row is not None else None

    def clear(self) -> View:
        self.df, self.in_sync, self._numbered = self.df.limit(0), False, None
        return self

    def do_sync(self) -> View:
        """Evaluate the query again on the table as it is now."""
        self.df, self.in_sync, self._numbered = self._query.frame(), True, None
        return self

    def query(self) -> Query:
        """A query over the rows of this view."""
        return Query(lambda: self.df, self.key, self._query.nulls)

    def __iter__(self) -> Iterator[Row]:
        return self.df.toLocalIterator(prefetchPartitions=True)

    def for_each(self, visit: Callable[[Row], None]) -> int:
        """Hand every row to a visitor, in order; how many there were.  An error in the visitor ends it."""
        n = 0
        for row in self:
            visit(row)
            n += 1
        return n

    def for_each_partition(self, visit: Callable[[Iterator[Row]], None]) -> None:
        """Hand the rows to a visitor on the executors, a partition at a time."""
        self.df.foreachPartition(visit)

    def collect(self) -> list[Row]:
        """All rows; for views that fit on the driver."""
        return self.df.collect()


def select(
    df: DataFrame, columns: list[str] | None = None, where: dict[str, object] | None = None, key: str | None = None,
    limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """Projection, a map of equalities (null equals null), then a slice in the order of the key."""
    for name, value in (where or {}).items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    if key is not None and offset:
        df = rows_between(df, [F.col(key).asc_nulls_first()], offset, limit)
    else:
        df = df if key is None else df.orderBy(F.col(key).asc_nulls_first())
        df = df.offset(offset) if offset else df
        df = df if limit is None else df.limit(limit)
    return df.select(*columns) if columns else df


def members_of(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose value is among those of a table of one column, however long it is; Spark broadcasts it if it is small."""
    name = values.columns[0]
    return df.join(values.select(F.col(name).alias("_needle")).distinct(), F.col(column) == F.col("_needle"), "left_semi")


def where_key(df: DataFrame, key: str, test: Callable[[object], bool]) -> DataFrame:
    """Rows whose key passes a Python test: for callbacks that no column expression can stand for, a batch of keys at a time."""

    @F.pandas_udf("boolean")
    def passes(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bool(test(k))).astype(bool)

    return df.where(passes(F.col(key)))


def chunk_rows(rows: int, workers: int, most: int = 1024) -> int:
    """Rows of a chunk, so that each worker gets about two: at least one, at most ``most``."""
    return max(1, min(most, -(-rows // (2 * max(1, workers)))))


def first(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.col(key).asc_nulls_first()).limit(1)


def last(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.col(key).desc_nulls_last()).limit(1)


def ends(df: DataFrame, key: str) -> DataFrame:
    """One row: the first and the last key, in one pass without a sort."""
    return df.agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def slice_rows(df: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """Rows ``start`` to ``end`` (exclusive) in the order of a unique key."""
    return rows_between(df, [F.col(key).asc_nulls_first()], start, end - start)


def chunks(df: DataFrame, key: str, size: int) -> DataFrame:
    """Every row with the number of its chunk of ``size`` rows in the order of a unique key."""
    return with_row_index(df, key).withColumn("chunk_id", F.expr(f"row_index div {int(size)}"))


def chunk_stats(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows, least and greatest key of each chunk."""
    numbered = chunks(df.select(key), key, size)
    return numbered.groupBy("chunk_id").agg(F.count("*").cast("long").alias("n"), F.min(key).alias("min_key"), F.max(key).alias("max_key"))


class RowIterator:
    """Rows in the order of a key, one partition fetched at a time; ``where`` passes over rows it isn't true for."""

    def __init__(self, df: DataFrame, key: str, where: Callable[[Row], bool] | None = None):
        self._df, self._test = df.orderBy(F.col(key).asc_nulls_first()), where
        self.reset()

    def reset(self) -> None:
        rows = self._df.toLocalIterator(prefetchPartitions=True)
        self._rows = rows if self._test is None else filter(self._test, rows)
        self._ahead: Row | None = None
        self.position = 0

    def has_next(self) -> bool:
        if self._ahead is None:
            self._ahead = next(self._rows, None)
        return self._ahead is not None

    def next(self) -> Row:
        if not self.has_next():
            raise StopIteration
        row, self._ahead = self._ahead, None
        self.position += 1
        return row

    def skip(self, n: int) -> int:
        """Pass over up to ``n`` rows; how many there were."""
        done = 0
        while done < n and self.has_next():
            self.next()
            done += 1
        return done

    def __iter__(self) -> Iterator[Row]:
        while self.has_next():
            yield self.next()
