"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is the bag of its byte n-grams within words (with the blanks that
bound them).  Every n-gram has a vector; the text is the weighted average of
the vectors, the weight being the n-gram's inverse document frequency in the
training sample, and a linear softmax over two classes reads that average.
Some empty mass (``prior``) joins each average, so that a few n-grams of a
very short text can't decide alone.  Vectors and softmax are trained jointly with Adagrad in numpy.  An unseen
misspelling shares most of its n-grams, and so their vectors, with the word.

At scoring time a vector matters only through its product with the softmax,
so each bucket keeps one number and a document costs one table look-up for
each n-gram: no vocabulary is broadcast and memory doesn't depend on texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

#: Bound on the labelled rows that are learned from.
SAMPLE_ROWS = 3200
#: Share of toxic rows in it; the rest are clean, as most documents are.
SAMPLE_SHARE = 0.25
#: Least number of steps, so that a small sample is learned as thoroughly.
UPDATES = 600
HELD_PARTS, HELD = 3, 1
THRESHOLD = 0.7


@dataclass
class SubwordModel:
    """Tables of 2**bits buckets: ``logit`` (weight x vector . softmax difference) and ``weight``."""

    orders: tuple[int, ...]
    bits: int
    logit: np.ndarray
    weight: np.ndarray
    scale: float
    bias: float
    prior: float = 0.0

    def scores(self, block: B.Block) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(block), -40, 40)))

    def evidence(self, block: B.Block) -> np.ndarray:
        """Log odds of class 1."""
        data, offs = B.padded(block)
        top, low = np.zeros(len(block)), np.zeros(len(block))
        for ids, at in B.subwords(data, self.orders, self.bits):
            top += B.sums_by_document(self.logit[ids], at, offs)
            low += B.sums_by_document(self.weight[ids], at, offs)
        return self.bias + self.scale * top / (low + self.prior)


def _bags(texts: list[str], orders: tuple[int, ...], bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    ids, counts = [], []
    batch = pa.record_batch({"text": pa.array(texts, pa.large_string())})
    for block in B.blocks(iter([batch])):
        data, offs = B.padded(block)
        parts = list(B.subwords(data, orders, bits))
        edges = [np.searchsorted(at, offs) for _, at in parts]
        for i in range(len(block)):
            all_ids = [p[e[i] : e[i + 1]] for (p, _), e in zip(parts, edges)]
            u, c = np.unique(np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32), return_counts=True)
            ids.append(u.astype(np.int32))
            counts.append(c.astype(np.float32))
    return ids, counts


def train(
    sample: list[tuple[str, int]], orders: tuple[int, ...] = (3, 4), bits: int = 17, dim: int = 8,
    epochs: int = 8, rate: float = 0.5, scale: float = 60.0, batch: int = 32, prior: float = 200.0, seed: int = 7,
) -> SubwordModel:
    """Fit vectors and softmax on (text, 0/1) pairs; without two classes the score is the constant share of ones."""
    n = 1 << bits
    y = np.array([label for _, label in sample], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return SubwordModel(orders, bits, np.zeros(n, np.float32), np.zeros(n, np.float32), scale, float(np.log(share / (1 - share))), prior)
    ids, counts = _bags([t for t, _ in sample], orders, bits)
    df = np.bincount(np.concatenate(ids), minlength=n)
    weight = np.where(df >= 3, np.log(len(y) / np.maximum(df, 1)), 0).astype(np.float32)
    bags = []
    for u, c in zip(ids, counts):
        w = c * weight[u]
        keep = w > 0
        u, w = u[keep], w[keep]
        bags.append((u, w / (float(w.sum()) + prior)))
    del ids, counts
    rng = np.random.default_rng(seed)
    vec = rng.uniform(-1 / dim, 1 / dim, (n, dim)).astype(np.float32)
    out = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    sq_vec, sq_out, sq_bias = np.full(n, 1e-6, np.float32), np.full((dim, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    target = np.stack([1 - y, y], 1).astype(np.float32)
    epochs = max(epochs, -(-UPDATES * batch // len(y)))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(order), batch):
            some = order[s : s + batch]
            sizes = np.array([len(bags[i][0]) for i in some])
            u = np.concatenate([bags[i][0] for i in some])
            w = np.concatenate([bags[i][1] for i in some]) * np.float32(scale)
            doc = np.repeat(np.arange(len(some)), sizes)
            rows = vec[u]
            edges = np.concatenate([[0], np.cumsum(sizes)])
            run = np.concatenate([np.zeros((1, dim), np.float64), np.cumsum(rows * w[:, None], axis=0, dtype=np.float64)])
            mean = (run[edges[1:]] - run[edges[:-1]]).astype(np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - target[some]) / len(some)
            back = g @ out.T
            uniq, place = np.unique(u, return_inverse=True)
            grad = np.stack([np.bincount(place, w * back[doc, d], len(uniq)) for d in range(dim)], 1).astype(np.float32)
            g_out, g_bias = mean.T @ g, g.sum(0)
            sq_vec[uniq] += (grad**2).mean(1)
            vec[uniq] -= rate * grad / np.sqrt(sq_vec[uniq])[:, None] * 0.1
            sq_out += g_out**2
            out -= rate * g_out / np.sqrt(sq_out) * 0.1
            sq_bias += g_bias**2
            bias -= rate * g_bias / np.sqrt(sq_bias) * 0.1
    logit = (vec @ (out[:, 1] - out[:, 0])) * weight
    return SubwordModel(orders, bits, logit.astype(np.float32), weight, scale, float(bias[1] - bias[0]), prior)


def fit(sample: list[tuple[str, int]]) -> SubwordModel:
    """Train on four fifths of the sample and calibrate on the rest, by a logistic curve over the log odds.

    A model is surer of the texts it has learned than of others; the curve
    takes that back, so that scores mean the same on texts not seen before.
    """
    learn = [x for i, x in enumerate(sample) if i % 5]
    rest = [x for i, x in enumerate(sample) if i % 5 == 0]
    model = train(learn)
    y = np.array([label for _, label in rest], dtype=float)
    if len(y) < 2 or y.min() == y.max() or not model.weight.any():
        return model
    batch = pa.record_batch({"text": pa.array([t for t, _ in rest], pa.large_string())})
    z = np.concatenate([model.evidence(b) for b in B.blocks(iter([batch]))])
    offset, slope = B.logistic(np.stack([np.ones(len(z)), z], 1), y, ridge=0.01)
    if slope > 0:
        model.bias, model.scale = float(offset + slope * model.bias), float(slope * model.scale)
    return model


def score(docs: DataFrame, model: SubwordModel, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with held_out, score and predicted.

    Null and empty texts get the score of an empty bag; repeated rows are
    scored alike; an empty table gives an empty table.  Other columns of
    ``docs`` are neither read nor returned, so their names can't clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for block in B.blocks(batches):
            b = block.batch
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.scores(block))], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", (B.fold("doc_id", HELD_PARTS) == HELD).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.transform(B.arrow, run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """Learn from labels.toxic outside the held-out fold, then score every document."""
    sample = B.labelled_sample(docs, labels, "toxic", limit, HELD_PARTS, HELD, SAMPLE_SHARE)
    return score(docs, fit(sample))
