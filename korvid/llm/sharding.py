"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised, each document gets its index on
the Hilbert curve through them, and the documents, sorted by that index, are
cut into runs of equal row counts.  Documents near on the curve are near in
all dimensions, so a reader that filters on any of them prunes most files.

The global rank needs no single task: the narrow sort rows are range
partitioned (ties of the index are broken by other columns, so a hot index
spreads over partitions), counted by partition, and the partitions' offsets
added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import with_row_index
from . import blocks as B

SHARDS = 40
#: Bits of each dimension: 2**BITS levels.
BITS = 7


def hilbert_index(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points with coordinates 0 .. 2**bits - 1.

    The coordinates' bit planes are walked from the highest: in each cell the
    remaining space is reflected and its axes exchanged, and at the end the
    planes are interleaved and Gray-decoded.
    """
    x = [c.astype(np.int64).copy() for c in columns]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        mask = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & mask)
            x[0] = np.where(high, x[0] ^ mask, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ turn) >> b) & 1)
    return out


def _levels(docs: DataFrame, name: str) -> Column:
    """A level for each value of a string dimension, in the order of the values; null is level 0.

    However many values there are, Spark ranks them, and as many levels as
    there are at most begin at certain values: only those reach the driver.
    """
    top = (1 << BITS) - 1
    values = docs.select(F.col(name).cast("string").alias("v")).where("v IS NOT NULL").distinct()
    ranked = with_row_index(values, "v", name="rank")
    n = ranked.count()
    if not n:
        return F.lit(0)
    level = lambda r: F.expr(f"1 + (({r}) * {top}) div {n}")
    first = ranked.where((F.col("rank") == 0) | (level("rank") != level("rank - 1"))).select("v", level("rank").cast("int").alias("l")).collect()
    begins = F.array(*[F.struct(F.lit(r["v"]).alias("v"), F.lit(r["l"]).alias("l")) for r in sorted(first, key=lambda r: r["l"])])
    own = F.col(name).cast("string")
    return F.coalesce(F.array_max(F.transform(F.filter(begins, lambda x: x["v"] <= own), lambda x: x["l"])), F.lit(0))


def shard(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = ("lang", "source"), keep_rows: bool = False) -> DataFrame:
    """Put documents (doc_id, text and the string dimensions) into ``shards`` runs of the curve; counts differ by one at most.

    The dimensions are those given and the size of the text (levels of its
    logarithm).  A null dimension is a level of its own; a null text has no
    bytes; ties of the index are broken by checksum, id and size, and rows
    equal in all of these change places without a difference.  An empty table
    gives an empty table.  Other columns are neither read nor returned, but
    with ``keep_rows`` the whole input row comes along as the struct ``row``.
    """
    top = (1 << BITS) - 1
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 16
    names = [f"_d{i}" for i in range(len(dimensions))]
    level = F.least(F.floor(F.log2(size.cast("double")) * 5), F.lit(top)).cast("int")

    @F.pandas_udf("long")
    def index(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            yield pd.Series(hilbert_index([c.to_numpy() for c in columns], BITS))

    carried = [F.struct(*docs.columns).alias("row")] if keep_rows else []
    rows = docs.select(
        "doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), level.alias("_size"),
        *[_levels(docs, d).alias(n) for d, n in zip(dimensions, names)], *carried,
    )
    carried = ["row"] if keep_rows else []
    rows = B.cut(rows.select("doc_id", "size", "text_crc32", index(*names, "_size").alias("curve"), *carried))
    order = ["curve", "text_crc32", "doc_id", "size"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = B.cut(placed.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    total, base = 0, {}
    for k, n in counts:  # one number for each partition
        base[k] = total
        total += n
    if not total:
        base = {0: 0}
    offsets = F.create_map(*[F.lit(x) for pair in base.items() for x in pair])
    rank = F.element_at(offsets, part.cast("int")).cast("long") + place
    least, more = divmod(total, shards)  # the first ``more`` shards hold one row more
    edge = more * (least + 1)
    number = F.when(F.col("_rank") < edge, F.expr(f"_rank div {least + 1}")).otherwise(F.expr(f"{more} + (_rank - {edge}) div {max(least, 1)}"))
    first = F.when(F.col("_rank") < edge, number * (least + 1)).otherwise(edge + (number - more) * least)
    out = placed.withColumn("_rank", rank)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), number.cast("int").alias("shard"),
        (F.col("_rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", *carried,
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, dimensions: tuple[str, ...] = ("lang", "source")) -> None:
    """Write the rows of ``docs`` as Parquet below ``path``, a folder ``_shard=N`` for each shard, in the order of the curve.

    The rows already stand in that order, so writing needs no further shuffle.
    """
    placed = shard(docs, shards, dimensions, keep_rows=True)
    rows = placed.sortWithinPartitions("shard", "slot").select("row.*", F.col("shard").alias("_shard"))
    rows.write.partitionBy("_shard").parquet(path)
