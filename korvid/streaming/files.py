"""Structured streams over directories of Parquet files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import new_folder


def read(spark: SparkSession, directory: str, like: DataFrame, files: str = "*.parquet") -> DataFrame:
    """A stream of the rows of files that are or come into a directory, with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", files).parquet(directory)


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over all files that are there now and return what it wrote; checkpoint and output are in the shared folder."""
    spark = stream.sparkSession
    base = new_folder(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def filtered(stream: DataFrame, where: Column) -> DataFrame:
    return stream.where(where)


def windowed_counts(stream: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """Rows of each tumbling window and group; rows later than ``late`` behind the newest are left out when the window has closed."""
    marked = stream.withWatermark(time, late)
    counted = marked.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").cast("long").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), by, "n")


def distinct_keys(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key's first row; state of keys older than ``late`` is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
