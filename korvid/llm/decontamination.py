"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

All word n-grams of the test items are counted over the whole corpus, and
every one that occurs there is a seed: whatever an edited copy has left of an
item's n-grams leads to it.  Documents and items meet where they share a seed;
around the places where they do, the words are aligned, and the alignment's
score, relative to the item's own or to that of a passage too long for chance,
tells copies, edited copies and copied parts from chance.

The test items are collected and broadcast in blocks of a fixed byte bound;
however many items there are, each block meets all documents, which are never
shuffled: one pass for each block, and one to count for every few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B

#: Words of a seed; an item of fewer words is one seed and must be found whole.
SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of an item's own score.
THRESHOLD = 0.5
#: Words whose score is enough whatever the item's length: a long item of which a passage was copied.
PASSAGE_WORDS = 30
#: Bytes of test items that are broadcast at once.
ITEM_BYTES = 8 << 20
#: Blocks of items whose n-grams are counted in one pass over the documents.
COUNTED = 4

# Words here are runs of ASCII letters and digits and of all other bytes from 0x80: punctuation is no difference.
_GAPS = np.ones(256, dtype=bool)
_GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two hash sequences, and its end in ``b`` (exclusive)."""
    j = np.arange(len(b) + 1) * -GAP
    row = np.zeros(len(b) + 1, dtype=np.int64)
    best, end = 0, 0
    for x in a:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(b == x, MATCH, MISMATCH))
        row = np.maximum.accumulate(new + j) - j  # gaps in a
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


@dataclass
class Seeds:
    """A block of items: words of each, and the seeds as sorted hashes with the (item, place) pairs of each."""

    ids: list
    words: list[np.ndarray]
    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    lengths: list[int]
    filter: np.ndarray

    def hits(self, words: B.Words, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the seeds that stand in a block, and the first word of each."""
        found, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in self.lengths:
            k, place = _known(words, own, n, self.hashes, self.filter)
            found.append(k)
            at.append(place)
        return np.concatenate(found), np.concatenate(at)

    def find(self, block: B.Block, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
        """(document, item, score, first word, end word) of each pair that aligns well enough, by its best alignment."""
        words = B.Words(block, _GAPS)
        own = words.hashes()
        k, place = self.hits(words, own)
        if not len(k):
            return
        n = self.first[k + 1] - self.first[k]
        entry = np.repeat(self.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(place, n)
        doc = np.searchsorted(words.at, place, side="right") - 1
        item, shift = self.item[entry], place - self.place[entry]
        order = np.lexsort((shift, item, doc))
        doc, item, shift = doc[order], item[order], shift[order]
        size = np.array([len(w) for w in self.words])
        apart = np.diff(shift) > np.maximum(size[item[1:]] // 4, 4)
        edge = np.concatenate([[0], np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0) | apart) + 1, [len(doc)]])
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
            d, it = int(doc[s]), int(item[s])
            mine, reach = self.words[it], 4 + int(size[it]) // 4
            low = max(int(shift[s]) - reach, int(words.at[d]))
            high = min(int(shift[e - 1]) + int(size[it]) + reach, int(words.at[d + 1]))
            part = own[low:high]
            least_share = min(threshold, PASSAGE_WORDS / len(mine)) if len(mine) >= SEED_WORDS else 1.0
            if np.isin(mine, part).mean() < least_share:  # no alignment matches more words than both have
                continue
            score, end = align(mine, part)
            share = score / (MATCH * len(mine))
            if share >= least_share and share > best.get((d, it), (0.0, 0, 0))[0]:
                back = align(mine[::-1], part[:end][::-1])[1]
                begin = low - int(words.at[d])
                best[d, it] = (share, begin + end - back, begin + end)
        for (d, it), found in best.items():
            yield d, it, *found


def _known(words: B.Words, own: np.ndarray, n: int, hashes: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sorted ``hashes`` a block's ``n``-word windows are, and the first word of each such window."""
    window, at = words.windows(own, n)
    some = np.flatnonzero(maybe[(window & np.uint64(0xFFFF)).astype(np.int64)])
    if not len(hashes):
        return some[:0], at[:0]
    k = np.searchsorted(hashes, window[some])
    k[k == len(hashes)] = 0
    hit = hashes[k] == window[some]
    return k[hit], at[some[hit]]


def _windows(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text its word hashes and its n-gram hashes; a text of fewer words has one, of all of them."""
    words, grams = [], []
    for block in B.blocks(iter([pa.record_batch({"text": pa.array(texts, pa.large_string())})])):
        w = B.Words(block, _GAPS)
        own = w.hashes()
        by = {n: w.windows(own, n) for n in range(1, SEED_WORDS + 1)}
        for i in range(len(block)):
            a, b = int(w.at[i]), int(w.at[i + 1])
            window, at = by[max(1, min(SEED_WORDS, b - a))]
            words.append(own[a:b])
            grams.append(window[(at >= a) & (at < b)])
    return words, grams


def _filter(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 16, dtype=bool)
    out[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
    return out


def frequencies(docs: DataFrame, hashes: np.ndarray, lengths: list[int]) -> np.ndarray:
    """In how many documents each of the sorted n-gram ``hashes`` stands; one count for each hash reaches the driver."""
    shared = docs.sparkSession.sparkContext.broadcast((hashes, _filter(hashes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, maybe = shared.value
        total = np.zeros(len(known), dtype=np.int64)
        for block in B.blocks(batches):
            words = B.Words(block, _GAPS)
            own = words.hashes()
            for n in lengths:
                k, at = _known(words, own, n, known, maybe)
                doc = np.searchsorted(words.at, at, side="right") - 1
                total += np.bincount(np.unique(doc * len(known) + k) % len(known), minlength=len(known))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k])], names=["k", "n"])

    out = np.zeros(len(hashes), dtype=np.int64)
    if len(hashes):
        for r in docs.select("text").transform(B.arrow, run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
            out[r["k"]] = r["n"]
    return out


def seed_blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator[Seeds]:
    """The seeds of each block of items: those of their n-grams that occur in ``docs``, counted for COUNTED blocks in one pass."""
    blocks = item_blocks(benchmark)
    while group := list(islice(blocks, COUNTED)):
        made = [(items, *_windows([t for _, t in items])) for items in group]
        known = np.unique(np.concatenate([g for _, _, grams in made for g in grams] or [np.zeros(0, np.uint64)]))
        lengths = sorted({min(SEED_WORDS, len(w)) for _, words, _ in made for w in words if len(w)})
        df = frequencies(docs, known, lengths)
        for items, words, grams in made:
            entries = []
            for i, g in enumerate(grams):
                entries += [(int(g[k]), i, k) for k in np.flatnonzero(df[np.searchsorted(known, g)]).tolist()]
            h = np.array([e[0] for e in entries], dtype=np.uint64)
            item = np.array([e[1] for e in entries], dtype=np.int64)
            place = np.array([e[2] for e in entries], dtype=np.int64)
            order = np.argsort(h, kind="stable")
            hashes, first = np.unique(h[order], return_index=True)
            own = sorted({min(SEED_WORDS, len(w)) for w in words if len(w)})
            yield Seeds([i for i, _ in items], words, hashes, np.append(first, len(h)), item[order], place[order], own, _filter(hashes))


def item_blocks(benchmark: DataFrame, limit: int = ITEM_BYTES) -> Iterator[list[tuple[object, str]]]:
    """Different test items with a text, in blocks of about ``limit`` bytes at most."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-2 * total // limit)) if total > limit else 1
    for k in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield sorted(((r[0], r[1]) for r in own.collect()), key=lambda x: (str(x[0]), x[1]))


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, item_id, score, first_word, end_word) of documents and test items that align.

    ``score`` is the best local alignment's share of the item's own score (0
    to 1); below ``threshold`` it is that of a passage that scores as
    ``PASSAGE_WORDS`` words or more.  The words count from 0 and the end is
    exclusive.  An item of fewer words than a seed must be there whole.  Null
    and empty texts, and texts without a word, match nothing on either side;
    repeated documents match alike, equal items once for each id.
    An empty table gives an empty table; other columns are not read.
    """
    kinds = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", kinds[0]), T.StructField("item_id", kinds[1]), T.StructField("score", T.DoubleType()),
        T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()),
    ])
    context = docs.sparkSession.sparkContext

    def scan(seeds: Seeds) -> DataFrame:
        shared = context.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for block in B.blocks(batches):
                found = list(own.find(block, threshold))
                if found:
                    d, i, score, first, end = zip(*found)
                    ids = block.batch.column(0).take(pa.array(d))
                    types = pa.schema([("s", pa.float64()), ("a", pa.int64()), ("b", pa.int64())]).types
                    item = pa.array([own.ids[k] for k in i])
                    yield pa.RecordBatch.from_arrays(
                        [ids, item, *(pa.array(x, t) for x, t in zip((score, first, end), types))],
                        names=["doc_id", "item_id", "score", "first_word", "end_word"],
                    )

        return docs.select("doc_id", "text").transform(B.arrow, run, schema)

    parts = [scan(seeds) for seeds in seed_blocks(docs, benchmark)]
    return reduce(DataFrame.unionAll, parts)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text matches no test item; texts aren't shuffled."""
    context, corpus = docs.sparkSession.sparkContext, docs
    for seeds in seed_blocks(corpus, benchmark):
        shared = context.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for block in B.blocks(batches):
                keep = np.ones(len(block), dtype=bool)
                for d, *_ in shared.value.find(block, threshold):
                    keep[d] = False
                yield block.batch.filter(pa.array(keep))

        docs = docs.transform(B.arrow, run, docs.schema)
    return docs
