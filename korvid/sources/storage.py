"""Writing tables: sinks, compaction, and cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of this process: where no shared one is set, by application; and tables that were materialised.
_LOCAL: dict[str, str] = {}
_MADE: list[tuple[str, str]] = []
#: Rows up to which a slice is taken from a top-k.
SMALL_OFFSET = 10_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as in tests, a local folder that goes when the process ends."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    own = spark.sparkContext.applicationId
    if own not in _LOCAL:
        _LOCAL[own] = tempfile.mkdtemp(prefix="korvid-")
        atexit.register(shutil.rmtree, _LOCAL[own], ignore_errors=True)
    return f"file://{_LOCAL[own]}"


def files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as its object."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def new_folder(spark: SparkSession, prefix: str = "table") -> str:
    """A name below the shared folder that nothing has; ``clean`` removes what is written there."""
    path = f"{shared_folder(spark)}/korvid-{prefix}-{uuid.uuid4().hex}"
    _MADE.append((spark.sparkContext.applicationId, path))
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: it is computed once, and lost executors lose nothing."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Remove the intermediate tables of this session; results that read them must have been used by then."""
    own = spark.sparkContext.applicationId
    mine = [path for app, path in _MADE if app == own]
    _MADE[:] = [x for x in _MADE if x[0] != own]
    for path in mine:
        fs, place = files(spark, path)
        fs.delete(place, True)
    return len(mine)


def flush(df: DataFrame, path: str) -> DataFrame:
    """Replace what is stored at ``path`` by the table, which may read from there; the table as stored.

    The rows are written beside the old ones and take their place when all
    are there: a flush that fails leaves the old table.
    """
    spark = df.sparkSession
    fresh = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    fs, new = files(spark, fresh)
    try:
        df.write.parquet(fresh)
    except BaseException:
        fs.delete(new, True)
        raise
    _, place = files(spark, path)
    fs.delete(place, True)
    if not fs.rename(new, place):
        raise OSError(f"{fresh} can't be renamed to {path}")
    spark.catalog.refreshByPath(path)
    return spark.read.schema(df.schema).parquet(path)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """Save a table in buckets of a key, sorted within them: joins and aggregations on the key then need no shuffle."""
    df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def compact(spark: SparkSession, path: str, target: str, file_bytes: int = 256 << 20) -> int:
    """Rewrite the table at ``path`` to ``target``, which may be the same, in files of about ``file_bytes``; how many that makes."""
    fs, place = files(spark, path)
    count = max(1, -(-fs.getContentSummary(place).getLength() // file_bytes))
    flush(spark.read.parquet(path).repartition(int(count)), target)
    return int(count)


def with_row_index(df: DataFrame, *order: str | Column, name: str = "row_index") -> DataFrame:
    """Number the rows from 0 in the order of columns, nulls first, without bringing them into one task.

    Rows are range partitioned and sorted, written once, counted by partition,
    and each partition's offset (one number a partition) added.  ``order``
    should be unique: ties are numbered in no certain order.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed)
    part = F.shiftright("_at", 33)
    total, offsets = 0, []
    for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        offsets += [F.lit(r["p"]), F.lit(total).cast("long")]
        total += r["n"]
    if not offsets:
        return placed.withColumn(name, F.lit(None).cast("long")).drop("_at")
    base = F.element_at(F.create_map(*offsets), part)
    return placed.withColumn(name, base + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")


def rows_between(df: DataFrame, order: list[Column], start: int, n: int | None = None) -> DataFrame:
    """Rows ``start`` to ``start + n`` in an order; to the end without ``n``.

    Few rows from near the beginning are a top-k, of which each task sends as
    many; a slice farther on, or to the end, is found by row number.
    """
    if n is not None and n <= 0:
        return df.limit(0)
    if n is not None and start + n <= SMALL_OFFSET:
        ordered = df.orderBy(*order)
        return (ordered.offset(start) if start else ordered).limit(n)
    numbered = with_row_index(df, *order, name="_korvid_row")
    at = F.col("_korvid_row")
    inside = at >= start if n is None else (at >= start) & (at < start + n)
    return numbered.where(inside).orderBy("_korvid_row").drop("_korvid_row")
