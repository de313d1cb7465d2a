"""Bounded blocks of text as numpy byte arrays, and shared storage.

Arrow batches are cut into blocks of about ``BLOCK_BYTES`` of UTF-8, so that
the temporary arrays of every kernel stay small however many rows Spark puts
in a batch.  Only one document longer than that makes a larger block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import materialise as cut  # noqa: F401 - the operators' name for it

BLOCK_BYTES = 1 << 18
#: Rows of an Arrow batch.
BATCH_ROWS = 1000

# The ASCII white space that separates words in every contract.
SEPARATORS = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]

IS_SEP = np.zeros(256, dtype=bool)
IS_SEP[SEPARATORS] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_CODE_LOWER = BYTE_CODE[LOWER]
#: One odd factor for each place of a window of words or bytes.
PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, grown when a longer block comes."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, BLOCK_BYTES)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                a = np.full(size, base, dtype=np.uint64)
                a[0] = 1
                setattr(cls, name, np.cumprod(a))
        return cls.up, cls.down


class Block:
    """Some documents: ``data`` holds their bytes, ``offs`` len+1 byte offsets."""

    def __init__(self, batch: pa.RecordBatch, data: np.ndarray, offs: np.ndarray):
        self.batch, self.data, self.offs = batch, data, offs

    def __len__(self) -> int:
        return len(self.offs) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut batches into blocks; a null text counts as empty."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if col.null_count:
            col = col.fill_null("")
        col = col.cast(pa.large_string())
        bufs = col.buffers()
        offs = np.frombuffer(bufs[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
        i, n = 0, len(col)
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
            j = min(j, n)
            yield Block(batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            i = j


class Words:
    """Words of a block: byte ranges ``start``/``end`` and, for document i, words ``at[i]:at[i+1]``."""

    def __init__(self, block: Block, separators: np.ndarray = IS_SEP):
        data, offs = block.data, block.offs
        self.block = block
        word = ~separators[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        inner = offs[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, offs)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word, A-Z folded if ``lower``."""
        data = self.block.data
        up, down = _Powers.of(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((BYTE_CODE_LOWER if lower else BYTE_CODE)[data] * up[: len(data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def windows(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all ``n``-word windows within documents, and the first word of each."""
        if len(hashes) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
        for k in range(n):
            out += hashes[k : len(hashes) - n + 1 + k] * PLACE[k]
        whole = np.ones(len(out), dtype=bool)
        for k in range(1, n):  # windows that would reach into the next document
            cut = self.at[1:-1] - k
            whole[cut[(cut >= 0) & (cut < len(out))]] = False
        at = np.flatnonzero(whole)
        return mix(out[at]), at


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with batches of few rows: texts are long, and both sides hold a batch at once.

    The session's bound is lowered if it is above ``BATCH_ROWS``; results don't depend on it.
    """
    spark = df.sparkSession
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    return df.mapInArrow(run, schema)


def pack(a: np.ndarray) -> bytes:
    """An array, compressed by byte planes."""
    return zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)


def unpack(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def dealt(df: DataFrame, key: str, groups: int) -> DataFrame:
    """Rows dealt by a key over enough partitions for so many groups of bounded size: a partition gets a few groups, however much data there is."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, 2 * groups), key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of an id as text, modulo ``parts``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, parts: int, held: int, share: float = 0.5) -> list[tuple[str, int]]:
    """At most ``limit`` labelled texts outside the held-out fold, at most ``share`` of the bound of class 1 and the rest of class 0.

    Rows are taken in the order of a hash of the id, so the sample does not
    depend on partitioning.  This bound is the only one the classifiers have:
    it limits what they learn from, never what they score.
    """
    if labels.schema["doc_id"].dataType != docs.schema["doc_id"].dataType:  # ids are compared as text then
        labels, docs = (t.withColumn("doc_id", F.col("doc_id").cast("string")) for t in (labels, docs))
    known = (
        labels.where(F.col(label).isin(0, 1) & (fold("doc_id", parts) != held))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("_y"))
    )
    picked = None
    for y, most in ((0, limit - int(limit * share)), (1, int(limit * share))):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "_y").agg(F.min("text").alias("text"))
    got = sorted((r["doc_id"], r["text"], int(r["_y"])) for r in rows.collect())
    return [(t, y) for _, t, y in got]


def padded(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with one blank before each document and after the last, white space made blanks."""
    n, docs = len(block.data), len(block)
    out = np.full(n + docs + 1, 0x20, dtype=np.uint8)
    out[np.arange(n) + 1 + np.repeat(np.arange(docs), np.diff(block.offs))] = np.where(IS_SEP[block.data], 0x20, LOWER[block.data])
    return out, block.offs + np.arange(docs + 1)


def subwords(data: np.ndarray, orders: tuple[int, ...], bits: int):
    """For each order: the buckets of all byte n-grams that lie in a word with its two bounding blanks, and their places."""
    blank = np.concatenate([[0], np.cumsum(data == 0x20)])
    h = np.zeros(len(data), dtype=np.uint64)
    done = 0
    for n in orders:
        if len(data) < n:
            return
        for k in range(done, n):
            h[: len(data) - k] += BYTE_CODE[data[k:]] * PLACE[k]
        done = n
        m = len(data) - n + 1
        inside = blank[n - 1 : n - 1 + m] - blank[1 : 1 + m] == 0
        if n == 2:  # two blanks bound no word
            inside &= (data[:-1] != 0x20) | (data[1:] != 0x20)
        at = np.flatnonzero(inside)
        yield (mix(h[at] + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int32), at


def sums_by_document(values: np.ndarray, at: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of ``values``, standing at sorted places ``at``, over the ranges between ``offs``."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    edge = np.searchsorted(at, offs)
    return total[edge[1:]] - total[edge[:-1]]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(bend, x.T @ (p - y) + ridge * w)
    return w
