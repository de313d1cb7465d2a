"""A directory of tables: names to data frames, with specifications and key/value metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .spec import SpecError, TableSpec

#: Keys of the tables of the test data; their keys start at 0 and are unique except for lineitem's.
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
    "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id",
    "benchmark": "item_id", "labels": "doc_id",
}


#: Folders of a catalog's generations, and the file that says that one is whole.
GENERATION, MARK = "generation-", "_WHOLE"


class Catalog:
    """Tables by name.  A Parquet directory's tables are read when first asked for, with only the columns a query needs."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path.rstrip("/") if path else None
        self._tables: dict[str, DataFrame] = {}
        self._specs: dict[str, TableSpec] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            if self.path is None:
                raise KeyError(f"no table {name!r}")
            self._tables[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self._tables[name]

    def key(self, name: str) -> str:
        spec = self._specs.get(name)
        return spec.primary_key if spec and spec.primary_key else KEYS[name]

    def register(self, name: str, df: DataFrame, spec: TableSpec | None = None) -> DataFrame:
        if spec is not None:
            spec.validate()
            self._specs[name] = spec
        self._tables[name] = df
        return df

    def create(self, spec: TableSpec) -> DataFrame:
        """An empty table; a name that is taken fails."""
        if spec.name in self._tables:
            raise SpecError(f"{spec.name} exists")
        return self.register(spec.name, self.spark.createDataFrame([], spec.schema()), spec)

    def spec(self, name: str) -> TableSpec:
        return self._specs[name]

    def names(self) -> list[str]:
        return sorted(self._tables)

    def drop(self, name: str) -> None:
        self._tables.pop(name)
        self._specs.pop(name, None)

    def refresh(self, name: str) -> DataFrame:
        """Read a table's files again."""
        self._tables.pop(name, None)
        if self.path is not None:
            self.spark.catalog.refreshByPath(f"{self.path}/{name}.parquet")
        return self.table(name)

    def flush(self, path: str) -> int:
        """Write all registered tables and their specifications below ``path`` as a new generation; its number.

        The generation counts from the moment its mark is set, after all
        tables are written: until then, and if anything fails, the one before
        stands.  So a catalog may be flushed to where it was opened.  Of older
        generations the last is kept, for whoever still reads it.
        """
        path = path.rstrip("/")
        done = generations(self.spark, path)
        number = max(done, default=0) + 1
        base = f"{path}/{GENERATION}{number:06d}"
        fs, place = storage.files(self.spark, base)
        fs.delete(place, True)  # what a flush left that failed
        for name, df in self._tables.items():
            df.write.parquet(f"{base}/{name}.parquet")
        specs = [(name, self._specs[name].to_json() if name in self._specs else None) for name in self._tables]
        self.spark.createDataFrame(specs, "name string, spec string").write.parquet(f"{base}/_specs")
        fs.create(storage.files(self.spark, f"{base}/{MARK}")[1], False).close()
        self.path = base
        for name, df in list(self._tables.items()):
            self._tables[name] = self.spark.read.schema(df.schema).parquet(f"{base}/{name}.parquet")
        for old in done[:-1]:
            fs.delete(storage.files(self.spark, f"{path}/{GENERATION}{old:06d}")[1], True)
        return number

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Catalog:
        """The last whole generation that ``flush`` wrote; files that can't be read fail and are never replaced."""
        done = generations(spark, path.rstrip("/"))
        if not done:
            raise FileNotFoundError(f"no catalog at {path}")
        catalog = cls(spark, f"{path.rstrip('/')}/{GENERATION}{done[-1]:06d}")
        for r in spark.read.parquet(f"{catalog.path}/_specs").collect():  # one row a table
            if r["spec"] is not None:
                catalog._specs[r["name"]] = TableSpec.from_json(r["spec"])
            catalog.table(r["name"])
        return catalog


def generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole generations of a catalog's folder, in order."""
    fs, place = storage.files(spark, path)
    if not fs.exists(place):
        return []
    found = []
    for entry in fs.listStatus(place):
        name = entry.getPath().getName()
        if name.startswith(GENERATION) and fs.exists(storage.files(spark, f"{path}/{name}/{MARK}")[1]):
            found.append(int(name.removeprefix(GENERATION)))
    return sorted(found)


def put_metadata(metadata: DataFrame, key: str, value: bytes) -> DataFrame:
    """Add a version of a key to (key, seq, value)."""
    seq = metadata.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("seq"))
    return metadata.unionByName(seq.select(F.lit(key).alias("key"), F.col("seq").cast("long"), F.lit(value).alias("value")))


def current_metadata(metadata: DataFrame) -> DataFrame:
    """(key, value): the last version of each key; a null value is a removal."""
    last = metadata.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    return last.where(F.col("value").isNotNull())


def remove_metadata(metadata: DataFrame, key: str) -> DataFrame:
    return put_metadata(metadata, key, None)


def last_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last in an order, nulls being the smallest: the state that a sequence of writes leaves.

    An aggregation: each task sends one row a key, and a hot key needs no sort.
    """
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x"))
    return last.select(*[F.col(c) if c in key else F.col("_x")[c].alias(c) for c in df.columns])
