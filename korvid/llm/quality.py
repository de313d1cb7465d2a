"""Quality classifier by compression.

Two zstandard dictionaries are built, one from text labelled good and one
from text labelled bad.  A text is compressed with each, piece by piece; a
text that resembles the good sample grows shorter with the good dictionary.
The difference of the compressed sizes, over the text's own size, is the only
evidence, and a logistic curve fitted to labelled rows makes it a calibrated
score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

#: Bound on the labelled rows that are learned from; half of it builds the dictionaries, half calibrates.
SAMPLE_ROWS = 3000
#: Share of good rows in it.
SAMPLE_SHARE = 0.6
HELD_PARTS, HELD = 4, 2
THRESHOLD = 0.7
#: Bytes of a dictionary, and of the pieces that whole texts are cut into: each piece meets a fresh dictionary.
DICT_BYTES = 110 << 10
PIECE = 256
#: Bytes of no evidence that join every text, so that a few words can't decide.
PRIOR_BYTES = 64
#: Bytes of the segments that a dictionary is made of.
SEGMENT = 128
LEVEL = 3


@dataclass
class CompressionModel:
    """Dictionaries (trained ones, with their entropy tables, or plain content) and the logistic curve over the difference."""

    good: bytes
    bad: bytes
    curve: np.ndarray
    neutral: float = 0.0
    _made: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self):
        return vars(self) | {"_made": []}

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        if not self._made:
            for content in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO)
                d.precompute_compress(level=LEVEL)
                self._made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return self._made

    def difference(self, text: bytes) -> float:
        """Bytes that the good dictionary saves more than the bad one, for each byte of the text; ``neutral`` of nothing."""
        good, bad = self.compressors()
        saved = PRIOR_BYTES * self.neutral
        for i in range(0, len(text), PIECE):
            piece = text[i : i + PIECE]
            saved += len(bad.compress(piece)) - len(good.compress(piece))
        return saved / (len(text) + PRIOR_BYTES)

    def score(self, text: bytes) -> float:
        z = float(np.dot(self.curve, _terms(self.difference(text))))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _terms(difference: float) -> np.ndarray:
    return np.array([1.0, 50 * difference])


def _dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary of ``size`` bytes trained on all texts, whole; the texts themselves if they are too few to train on."""
    whole = b"\n".join(texts)
    if len(whole) <= size:
        return whole
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    return zstandard.train_dictionary(size, pieces, k=SEGMENT, d=8).as_bytes()


def train(sample: list[tuple[str, int]]) -> CompressionModel:
    """Build both dictionaries from every other row and calibrate on the rest; one class only gives a constant score."""
    rows = [(t.encode(), y) for t, y in sample if t]
    build, rest = rows[::2], rows[1::2]
    model = CompressionModel(
        _dictionary([t for t, y in build if y == 1]), _dictionary([t for t, y in build if y == 0]), np.zeros(2)
    )
    y = np.array([y for _, y in rest], dtype=float)
    if len(y) < 2 or y.min() == y.max():
        share = (sum(y for _, y in sample) + 1) / (len(sample) + 2)
        model.curve = np.array([np.log(share / (1 - share)), 0.0])
        return model
    own = np.array([model.difference(t) * (len(t) + PRIOR_BYTES) / len(t) for t, _ in rest])
    model.neutral = float(own.mean())
    model.curve = B.logistic(np.array([_terms(model.difference(t)) for t, _ in rest]), y)
    return model


def score(self, text: bytes) -> float:
        z = float(np.dot(self.curve, _terms(self.difference(text))))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _terms(difference: float) -> np.ndarray:
    return np.array([1.0, 50 * difference])


def _dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary of ``size`` bytes trained on all texts, whole; the texts themselves if they are too few to train on."""
    whole = b"\n".join(texts)
    if len(whole) <= size:
        return whole
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    return zstandard.train_dictionary(size, pieces, k=SEGMENT, d=8).as_bytes()


def train(sample: list[tuple[str, int]]) -> CompressionModel:
    """Build both dictionaries from every other row and calibrate on the rest; one class only gives a constant score."""
    rows = [(t.encode(), y) for t, y in sample if t]
    build, rest = rows[::2], rows[1::2]
    model = CompressionModel(
        _dictionary([t for t, y in build if y == 1]), _dictionary([t for t, y in build if y == 0]), np.zeros(2)
    )
    y = np.array([y for _, y in rest], dtype=float)
    if len(y) < 2 or y.min() == y.max():
        share = (sum(y for _, y in sample) + 1) / (len(sample) + 2)
        model.curve = np.array([np.log(share / (1 - share)), 0.0])
        return model
    x = np.array([_terms(model.difference(t)) for t, _ in rest])
    model.curve = B.logistic(x, y)
    return model


def score(docs: DataFrame, model: CompressionModel, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with held_out, score and predicted.

    Null and empty texts have no evidence and get the curve's neutral value;
    repeated rows are scored alike; an empty table gives an empty table.
    Other columns of ``docs`` are neither read nor returned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for block in B.blocks(batches):
            b = block.batch
            scores = [own.score(block.text(i)) for i in range(len(block))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", (B.fold("doc_id", HELD_PARTS) == HELD).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.transform(B.arrow, run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: CompressionModel, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.blocks(batches):
            keep = [shared.value.score(block.text(i)) >= least for i in range(len(block))]
            yield block.batch.filter(pa.array(keep, pa.bool_()))

    return docs.transform(B.arrow, run, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> CompressionModel:
    return train(B.labelled_sample(docs, labels, "quality", limit, HELD_PARTS, HELD, SAMPLE_SHARE))


def quality(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """Learn from labels.quality outside the held-out fold, then score every document."""
    return score(docs, fit(docs, labels, limit))
