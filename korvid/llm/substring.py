"""Substring deduplication by content-defined chunks.

A gear rolling hash over the bytes cuts every text into chunks of variable
length.  A cut depends only on the bytes just before it, so an insertion
shifts the chunks around it and no others, and a passage that stands in two
documents falls, but for its ends, into the same chunks in both.  Chunks are
compared by digest: the document with the smallest id keeps a chunk, and runs
of chunks that others kept before are taken out.

Only digests travel.  Each document sends each of its digests once; counts
and smallest ids are aggregated before the shuffle, so a chunk that a third
of all documents share is one row a task; the join that brings them back to
the documents is one that Spark splits where it is skewed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B

#: Chunk sizes in bytes; the hash has 16 bits and so reads 16 bytes, which the least size keeps within the chunk.
MIN_CHUNK, CUT_BITS, MAX_CHUNK = 16, 5, 256
#: Shorter runs of repeated chunks are left alone: a few common words are no repeated passage.
MIN_RUN = 96

_GEAR = (B.BYTE_CODE >> np.uint64(48)).astype(np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[b[i-k]] << k over the last 16 bytes: the rolling hash h = (h << 1) + gear[b], at all places at once."""
    h = _GEAR[data]
    step = 1
    while step < 16:  # h over 2 * step bytes is h over step bytes here, plus h over step bytes before, shifted
        out = h.copy()
        out[step:] += h[:-step] << np.uint16(step)
        h = out
        step *= 2
    return h


def chunk_ends(block: B.Block) -> list[list[int]]:
    """For each document the ends of its chunks, as offsets in the block; a text of no bytes has none."""
    data, offs = block.data, block.offs
    if not len(data):
        return [[] for _ in range(len(block))]
    cut = gear(data) >> np.uint16(16 - CUT_BITS) == 0
    cut[:-1] &= (data[1:] & 0xC0) != 0x80  # never within a character
    at = np.flatnonzero(cut) + 1
    edge = np.searchsorted(at, offs, side="right")
    ends = []
    for i in range(len(block)):
        start, stop = int(offs[i]), int(offs[i + 1])
        own: list[int] = []
        for c in at[edge[i] : edge[i + 1]].tolist():
            while c - start > MAX_CHUNK:
                start += MAX_CHUNK
                own.append(start)
            if c - start >= MIN_CHUNK:
                own.append(c)
                start = c
        while stop - start > MAX_CHUNK:
            start += MAX_CHUNK
            own.append(start)
        if stop > start:
            own.append(stop)
        ends.append(own)
    return ends


def digests(block: B.Block) -> Iterator[tuple[list[int], list[bytes]]]:
    """For each document the ends of its chunks and their digests."""
    raw = block.data.tobytes()
    for i, ends in enumerate(chunk_ends(block)):
        start, found = int(block.offs[i]), []
        for e in ends:
            found.append(hashlib.blake2b(raw[start:e], digest_size=16).digest())
            start = e
        yield ends, found


def chunk_table(docs: DataFrame) -> DataFrame:
    """Rows (hi, lo, doc_id): each different chunk digest of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.blocks(batches):
            flat: list[bytes] = []
            sizes = []
            for _, found in digests(block):
                own = dict.fromkeys(found)
                flat += own
                sizes.append(len(own))
            pair = np.frombuffer(b"".join(flat), dtype=np.int64).reshape(-1, 2)
            ids = block.batch.column(0).take(pa.array(np.repeat(np.arange(len(block)), sizes)))
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), ids], names=["hi", "lo", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    return rows.transform(B.arrow, run, f"hi long, lo long, doc_id {kind}")


def _runs(remove: list[bool], ends: list[int], begin: int, least: int) -> list[tuple[int, int, int, int]]:
    """Runs of removable chunks that have ``least`` bytes: first byte and end, first chunk and end."""
    out: list[tuple[int, int, int, int]] = []
    start, k = begin, 0
    while k < len(remove):
        j = k
        while j < len(remove) and remove[j] == remove[k]:
            j += 1
        end = ends[j - 1]
        if remove[k] and end - start >= least:
            out.append((start, end, k, j))
        start, k = end, j
    return out


def dedup(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` (doc_id, text and any others) with repeated passages taken out of text.

    Adds n_chunks, n_dup_chunks (those that were taken out: another document
    keeps them, or they stand earlier in the same text), removed_bytes and
    kept_by (ids of the documents that keep what was taken out); input columns
    of these names are replaced.  Rows with the same id never lose anything to
    each other, whether their texts agree or not: each is compared with the
    documents of other ids by its own chunks.  A row without an id neither
    keeps nor loses anything to others.  A null text stays null, an empty one
    has no chunks; an empty table gives an empty table.
    """
    chunks = chunk_table(docs)
    first = chunks.groupBy("hi", "lo").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n"))
    first = first.where(F.col("_n") > 1).select("hi", "lo", "_first")
    hits = chunks.join(first, ["hi", "lo"]).where(F.col("doc_id") != F.col("_first"))
    hits = hits.groupBy("doc_id").agg(F.collect_set(F.struct("hi", F.col("_first").alias("first"))).alias("_korvid_hits"))

    added = ["n_chunks", "n_dup_chunks", "removed_bytes"]
    base = docs.drop(*added, "kept_by")
    kind = docs.schema["doc_id"].dataType
    out_schema = T.StructType(
        base.schema.fields + [T.StructField(n, T.LongType()) for n in added] + [T.StructField("kept_by", T.ArrayType(kind))]
    )
    names = [f.name for f in out_schema.fields]
    text_at, id_at, width = base.columns.index("text"), base.columns.index("doc_id"), len(base.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.blocks(batches):
            b = block.batch
            known = [{h["hi"]: h["first"] for h in own or ()} for own in b.column(width).to_pylist()]
            null = b.column(text_at).is_null().to_pylist()
            texts, n, dup, gone, kept_by = [], [], [], [], []
            for i, (ends, found) in enumerate(digests(block)):
                begin, stop = int(block.offs[i]), int(block.offs[i + 1])
                hi = np.frombuffer(b"".join(found), dtype=np.int64)[::2].tolist()
                seen: set[bytes] = set()
                remove = []
                for d, h in zip(found, hi):
                    remove.append(d in seen or h in known[i])
                    seen.add(d)
                left, removed, count = [], 0, 0
                keepers = set()
                for a, e, k, j in _runs(remove, ends, begin, min_run):
                    left.append(block.data[begin:a].tobytes())
                    begin, removed, count = e, removed + e - a, count + j - k
                    keepers.update(known[i][h] for h in hi[k:j] if h in known[i])
                left.append(block.data[begin:stop].tobytes())
                texts.append(None if null[i] else b"".join(left).decode("utf-8", "replace"))
                n.append(len(found))
                dup.append(count)
                gone.append(removed)
                kept_by.append(sorted(keepers) if keepers else None)
            columns = [b.column(k) for k in range(width)]
            columns[text_at] = pa.array(texts, b.schema.field(text_at).type)
            columns += [pa.array(x, pa.int64()) for x in (n, dup, gone)] + [pa.array(kept_by, pa.list_(b.schema.field(id_at).type))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return base.join(hits, "doc_id", "left").select(*base.columns, "_korvid_hits").transform(B.arrow, run, out_schema)
