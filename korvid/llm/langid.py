"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams (within runs of letters, with the
blanks that bound them), weighted by TF-IDF with the root of the frequency and scaled to length one.  Each language has
several centroids, found by spherical k-means over its sample rows, because
one language may hold several kinds of text.  The nearest centroid by cosine
names the language; a text farther from it than its sample rows ever were is
marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B

#: Bounds on what is learned from: rows a language, and rows in all (at least ten a language).
SAMPLE_ROWS, MAX_ROWS = 250, 4000
HELD_PARTS, HELD = 3, 1
CENTROIDS = 4
ORDERS, BITS = (2, 3, 4), 13
#: Rows of a dense vector block.
ROWS = 128
UNKNOWN = "und"

_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def has_letter(block: B.Block) -> np.ndarray:
    """Whether each text has a letter of any script."""
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[block.data])])
    out = seen[block.offs[1:]] > seen[block.offs[:-1]]
    for i in np.flatnonzero(~out & (np.diff(block.offs) > 0)):
        out[i] = any(c.isalpha() for c in block.text(i).decode("utf-8", "replace"))
    return out


def counts(block: B.Block) -> Iterator[np.ndarray]:
    """Dense n-gram counts of the documents, ``ROWS`` at a time."""
    data, offs = B.padded(block)
    data[(data < 0x80) & ~_ASCII_LETTER[data]] = 0x20  # digits, punctuation and symbols say nothing of a language
    grams = list(B.subwords(data, ORDERS, BITS))
    for i in range(0, len(block), ROWS):
        j = min(i + ROWS, len(block))
        table = np.zeros((j - i) << BITS)
        for ids, at in grams:
            edge = np.searchsorted(at, offs[i : j + 1])
            doc = np.repeat(np.arange(j - i), np.diff(edge))
            table += np.bincount((doc << BITS) + ids[edge[0] : edge[-1]], minlength=len(table))
        yield table.reshape(j - i, 1 << BITS)


@dataclass
class CentroidModel:
    """Unit centroids (rows), the language and the farthest accepted distance of each, and the idf of each bucket."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    reach: np.ndarray

    def vectors(self, table: np.ndarray) -> np.ndarray:
        v = np.sqrt(table).astype(np.float32) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def predict(self, block: B.Block) -> tuple[list[str], np.ndarray, np.ndarray]:
        letter = has_letter(block)
        if not self.langs:
            return [UNKNOWN] * len(block), np.zeros(len(block)), ~letter
        near = np.concatenate([self.vectors(t) @ self.centroids.T for t in counts(block)])
        best = near.argmax(1)
        score = np.where(letter, np.clip(near[np.arange(len(best)), best], 0, 1), 0.0)
        names = [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, letter)]
        return names, score, ~letter | (1 - score > self.reach[best])


def _cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; seeds are spread by taking the row farthest from those before."""
    seeds = [v.mean(0)]
    while len(seeds) < min(k, len(v)):
        near = np.max(v @ np.array(seeds).T, axis=1)
        seeds.append(v[near.argmin()])
    c = np.array(seeds)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        own = (v @ c.T).argmax(1)
        c = np.array([v[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def _tables(texts: list[str]) -> np.ndarray:
    batch = pa.record_batch({"text": pa.array(texts, pa.large_string())})
    return np.concatenate([t.astype(np.float32) for b in B.blocks(iter([batch])) for t in counts(b)])


def train(sample: list[tuple[str, str]]) -> CentroidModel:
    """Fit on (text, language) pairs, language by language; without any, nothing is ever recognised."""
    if not sample:
        return CentroidModel(np.zeros(1 << BITS, np.float32), np.zeros((0, 1 << BITS), np.float32), [], np.zeros(0))
    texts: dict[str, list[str]] = {}
    for t, name in sample:
        texts.setdefault(name, []).append(t)
    df = sum((_tables(own) > 0).sum(0) for own in texts.values())
    model = CentroidModel(np.log((1 + len(sample)) / (1 + df)).astype(np.float32) + 1, np.zeros(0), [], np.zeros(0))
    parts, reach = [], []
    for name in sorted(texts):
        rows = model.vectors(_tables(texts[name]))
        c = _cluster(rows, CENTROIDS)
        far = 1 - (rows @ c.T).max(1)
        parts.append(c)
        model.langs += [name] * len(c)
        reach += [1.25 * float(far.max())] * len(c)
    model.centroids, model.reach = np.concatenate(parts).astype(np.float32), np.array(reach)
    return model


def fit(docs: DataFrame, limit: int = SAMPLE_ROWS) -> CentroidModel:
    """Learn from at most ``limit`` documents of each language outside the held-out fold, in the order of a hash of the id.

    Only text and lang are learned from; the id decides the fold and the order.
    The unsigned hash below a share that the language's size sets comes first,
    the hash's own order second: both depend on the id alone.
    """
    spark = docs.sparkSession
    known = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & (B.fold("doc_id", HELD_PARTS) != HELD))
    sizes = known.groupBy("lang").agg(F.count("*").alias("_rows")).collect()
    limit = max(min(limit, MAX_ROWS // max(len(sizes), 1)), 10)
    # of a language with many rows, those of the lowest hashes: about four times as many as are wanted, whatever its size
    shares = spark.createDataFrame([(r["lang"], min(1.0, 4 * limit / r["_rows"])) for r in sizes], "lang string, _share double")
    low = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = known.join(F.broadcast(shares), "lang").where((low < F.col("_share")) | (F.col("_share") >= 1))
    ids = few.select("doc_id", "lang").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n").collect()
    picked = spark.createDataFrame(ids, few.select("doc_id", "lang").schema).dropDuplicates()
    rows = docs.select("doc_id", "lang", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), ["doc_id", "lang"])
    rows = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    got = sorted((str(r["doc_id"]), r["lang"], r["text"]) for r in rows)
    return train([(t, name) for _, name, t in got])


def predict(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with held_out, lang_pred, score and rejected.

    Null texts and texts without a letter are ``und`` with score 0; repeated
    rows are predicted alike; an empty table gives an empty table.  Other
    columns of ``docs`` are neither read nor returned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for block in B.blocks(batches):
            names, score, far = own.predict(block)
            b = block.batch
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(far)],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    rows = docs.select("doc_id", (B.fold("doc_id", HELD_PARTS) == HELD).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.transform(B.arrow, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def language(docs: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    return predict(docs, fit(docs, limit))
