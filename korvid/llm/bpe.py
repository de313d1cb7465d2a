"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Tasks split texts into words and cut them into chunks; of a chunk, its words
travel once each, dealt by their hash into parts, and its documents as
sequences of word numbers.  Each part is a pool of all words of the corpus
that fall into it: every distinct word is laid out once, as a chain of byte
tokens, and an inverted index leads from the rank of a token pair to all
places in all words where that pair stands.  Ranks are taken in order, all
places of one rank at once; a merge touches only its two neighbours, whose
new pairs enter the index.  The words' ids go back to the chunks that asked
for them, and documents are put together there.

A document crosses the network twice, as packed word numbers; a word's merges
are replayed once, however many documents have it.  Rows that are lost with an
executor are made again from the input, which must give its rows in the same
order then, as files do: a chunk's number holds a digest of its content, and
answers that don't belong to it are an error, never a wrong result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B

#: Bytes of text of a chunk (a quarter where all columns come along), of the texts that a part has the words of, and of the words that are laid out at once.
CHUNK_BYTES, PART_BYTES, POOL_BYTES = 16 << 20, 4 << 20, 4 << 20
#: Parts up to which they may be that small, so that a chunk's words stay packed; and what a part has the words of beyond.
FINE_PARTS, FULL_BYTES = 4096, 256 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Read a rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder for one rank table and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.token = {str(i): t for t, i in ranks.items()}
        self.shift = max(ranks.values()).bit_length()
        self.pair: dict[int, int] = {}
        for t, i in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    self.pair[a << self.shift | b] = i
        self.byte_ids = np.array(self.byte, dtype=np.int32)
        self.keys = np.array(sorted(self.pair), dtype=np.int64)
        self.ranks = np.array([self.pair[k] for k in self.keys.tolist()], dtype=np.int32)
        self.text_of = {i: str(i) for i in ranks.values()}

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, -1 where they don't merge."""
        key = left.astype(np.int64) << self.shift | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.ranks[at], -1)

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word: all merges of the pool in the order of rank.

        All places of a rank are merged at once; in a chain of overlapping
        places every other one is, from the left.  A word in which a merge
        brings up a pair of lower rank than itself is done again alone, by
        ``replay_word``, since there the places of one rank aren't neighbours
        in time.
        """
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        heads = np.concatenate([[0], np.cumsum(lengths + 1)])
        size = int(heads[-1])
        sym = np.full(size + 1, -1, dtype=np.int32)  # -1 ends each word: no pair reaches over it
        inner = np.ones(size, dtype=bool)
        inner[heads[1:] - 1] = False
        sym[:-1][inner] = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        after = np.arange(1, size + 2, dtype=np.int32)
        before = np.arange(-1, size, dtype=np.int32)
        rank_at = np.full(size + 1, -1, dtype=np.int32)
        rank_at[: size - 1] = self._ranks_of(sym[: size - 1], sym[1:size]) if size > 1 else -1
        places: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def enter(ranks: np.ndarray, at: np.ndarray) -> None:
            some = np.flatnonzero(ranks >= 0)
            if not len(some):
                return
            ranks, at = ranks[some], at[some]
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            edge = np.flatnonzero(np.diff(ranks)) + 1
            for r, part in zip(ranks[np.concatenate([[0], edge])].tolist(), np.split(at, edge)):
                if r in places:
                    places[r].append(part)
                else:
                    places[r] = [part]
                    heapq.heappush(waiting, r)

        enter(rank_at, np.arange(size + 1))
        again: list[np.ndarray] = []
        while waiting:
            r = heapq.heappop(waiting)
            parts = places.pop(r)
            p = parts[0] if len(parts) == 1 else np.concatenate(parts)
            p = p[rank_at[p] == r]
            if len(parts) > 1:
                p = np.unique(p)
            if not len(p):
                continue
            chained = rank_at[before[p]] == r
            if chained.any():
                index = np.arange(len(p))
                start = np.maximum.accumulate(np.where(chained, 0, index))
                p = p[(index - start) % 2 == 0]
            q = after[p]
            s = after[q]
            after[p] = s
            before[s] = p
            sym[p] = r
            sym[q] = -2
            rank_at[q] = -1
            right = self._ranks_of(sym[p], sym[s])
            rank_at[p] = right
            o = before[p]
            o = o[(o >= 0) & (sym[o] >= 0)]
            left = self._ranks_of(sym[o], sym[after[o]])
            rank_at[o] = left
            both, at = np.concatenate([right, left]), np.concatenate([p, o])
            low = (both >= 0) & (both < r)
            if low.any():
                again.append(at[low])
            enter(both, at)
        flat = sym[:-1][sym[:-1] != -2]
        ends = np.flatnonzero(flat == -1).tolist()
        ids = flat.tolist()
        out, i = [], 0
        for e in ends:
            out.append(ids[i:e])
            i = e + 1
        if again:
            for w in np.unique(np.searchsorted(heads, np.concatenate(again), side="right") - 1).tolist():
                out[w] = self.replay_word(words[w])
        return out

    def replay_word(self, word: bytes) -> list[int]:
        """The ids of one word, one merge at a time: the lowest rank first, the leftmost of equal ranks."""
        ids = [self.byte[b] for b in word]
        while len(ids) > 1:
            found = [self.pair.get(a << self.shift | b, -1) for a, b in zip(ids, ids[1:])]
            r = min((x for x in found if x >= 0), default=-1)
            if r < 0:
                break
            k = found.index(r)
            ids[k : k + 2] = [r]
        return ids

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each word as 32-bit numbers; a pool is laid out for every few MB of words."""
        out: dict[bytes, bytes] = {}
        i = 0
        while i < len(words):
            j, size = i, 0
            while j < len(words) and (j == i or size + len(words[j]) <= POOL_BYTES):
                size += len(words[j])
                j += 1
            for w, ids in zip(words[i:j], self.replay(words[i:j])):
                out[w] = np.array(ids, dtype=np.uint32).tobytes()
            i = j
        return out

    def join(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Decimal ids, joined by blanks, of words that have ``counts`` of them."""
        texts = list(map(self.text_of.__getitem__, ids.tolist()))
        ends = np.cumsum(counts).tolist()
        return [" ".join(texts[a:b]) for a, b in zip([0, *ends], ends)]

    def encode(self, texts: list[str]) -> list[str]:
        """Decimal ids of each text, joined by blanks."""
        split = [self.pattern.findall(t) for t in texts]
        words = list({w for ws in split for w in ws})
        known = self.learn([w.encode() for w in words])
        found = {w: " ".join(map(self.text_of.__getitem__, np.frombuffer(known[w.encode()], np.uint32).tolist())) for w in words}
        return [" ".join(map(found.__getitem__, ws)) for ws in split]

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.split(" "))) if ids else b""


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str, ranks: dict[bytes, int] | None = None) -> Codec:
    """One codec for each Python worker and vocabulary."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(ranks if ranks is not None else load_ranks(path), pattern)
    return _CODECS[path, pattern]


class Chunk:
    """Documents as numbers of words, and those words dealt into parts.

    Texts are added one by one; of their words only the different ones are
    held.  ``close`` numbers the words anew, the commonest first.
    """

    def __init__(self) -> None:
        self.first: dict[str, int] = {}
        self.flat: list[np.ndarray] = []

    def add(self, words: list[str]) -> None:
        number = self.first
        self.flat.append(np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.uint32, count=len(words)))

    def close(self, parts: int) -> None:
        first = self.first
        self.lengths = np.array([len(x) for x in self.flat], dtype=np.uint32)
        flat = np.concatenate(self.flat) if self.flat else np.zeros(0, np.uint32)
        self.flat = []
        words = sorted(first)
        old = np.fromiter(map(first.__getitem__, words), dtype=np.int64, count=len(words))
        order = np.argsort(-np.bincount(flat, minlength=len(words))[old], kind="stable")
        number = np.empty(len(words), dtype=np.uint32)
        number[old[order]] = np.arange(len(words), dtype=np.uint32)
        self.numbers = number[flat]
        self.words = [words[i].encode() for i in order.tolist()]
        self.part = np.fromiter((zlib.crc32(w) % parts for w in self.words), dtype=np.uint32, count=len(words))

    def requests(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(part, words, their lengths) of each part that has any."""
        order = np.argsort(self.part, kind="stable")
        edge = np.flatnonzero(np.diff(self.part[order])) + 1
        for own in np.split(order, edge) if len(order) else ():
            words = [self.words[i] for i in own.tolist()]
            yield int(self.part[own[0]]), B.pack(np.frombuffer(b"".join(words), np.uint8)), B.pack(np.array([len(w) for w in words], dtype=np.uint32))


def _unjoined(words: bytes, lengths: bytes) -> list[bytes]:
    data, ends = B.unpack(words, np.uint8).tobytes(), np.cumsum(B.unpack(lengths, np.uint32)).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def encode(docs: DataFrame, path: str, pattern: str, ids: bool = True, keep: bool = False) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    ``ids`` holds the decimal ids joined by blanks.  A null or empty text has
    no tokens; repeated rows are encoded alike; an empty table gives an empty
    table.  ``path`` names a rank file that the driver reads (about 50,000
    entries; at most a few MB); its ranks are broadcast.  Other columns are
    neither read nor returned, but with ``keep`` all come along, except those
    named like the added ones, which are replaced; the text then is the one
    that the tokens decode to, which is the same.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids
    kept = docs.drop(*added).columns if keep else ["doc_id"]
    others = [c for c in kept if c != "text"]
    carried = docs.select(*others, F.col("text").isNull().alias("_korvid_null"), F.col("text").alias("_korvid_text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(1, min(-(-total // PART_BYTES), FINE_PARTS), -(-total // FULL_BYTES)))
    row = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(carried.schema.fields[:-1])])
    binary = [T.StructField(n, T.BinaryType()) for n in ("a", "b", "c")]
    schema = T.StructType(
        [T.StructField("key", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("rows", T.ArrayType(row)), *binary]
    )
    names, out_names = schema.names, kept + added
    width, chunk_bytes = len(row), CHUNK_BYTES // 4 if keep else CHUNK_BYTES

    def codec() -> Codec:
        return _CODECS.get((path, pattern)) or _codec(path, pattern, ranks.value)

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks: a row of documents with key below 0, and a row of words for each part."""
        chunk, rows = Chunk(), []
        held = done = 0

        def out() -> pa.RecordBatch:
            chunk.close(parts)
            body = [B.pack(x) for x in (chunk.numbers, chunk.lengths, chunk.part)]
            number = hashlib.blake2b(b"".join(body), digest_size=8, key=f"{TaskContext.get().partitionId()}/{done}".encode()).digest()
            own = int.from_bytes(number, "little") >> 1
            asked = list(chunk.requests())
            struct = pa.concat_arrays(rows)
            lists = pa.ListArray.from_arrays(pa.array([0] + [len(struct)] * (1 + len(asked)), pa.int32()), struct)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([-1 - own, *(p for p, _, _ in asked)], pa.int64()), pa.array([own] * (1 + len(asked)), pa.int64()),
                    pa.array([-1, *(p for p, _, _ in asked)], pa.int32()), lists, pa.array([body[0], *(w for _, w, _ in asked)], pa.binary()),
                    pa.array([body[1], *(n for _, _, n in asked)], pa.binary()), pa.array([body[2]] + [None] * len(asked), pa.binary()),
                ],
                names=names,
            )

        split = codec().pattern.findall
        for block in B.blocks(batches, "_korvid_text"):
            for i in range(len(block)):
                chunk.add(split(block.text(i).decode("utf-8", "replace")))
            rows.append(pa.StructArray.from_arrays(block.batch.columns[:width], names=row.names))
            held += len(block.data)
            if held >= chunk_bytes:
                yield out()
                chunk, rows, held, done = Chunk(), [], 0, done + 1
        if rows:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of a part become their ids; documents pass."""
        known: dict[bytes, bytes] = {}
        for batch in batches:
            part = batch.column(2)
            if not batch.num_rows or part[0].as_py() < 0:
                yield batch
                continue
            asked = [_unjoined(w, n) for w, n in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            known |= codec().learn(list({w for words in asked for w in words} - known.keys()))
            answers = [[known[w] for w in words] for words in asked]
            found = [B.pack(np.frombuffer(b"".join(x), np.uint32)) for x in answers]
            counts = [B.pack(np.array([len(x) // 4 for x in own], dtype=np.uint32)) for own in answers]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.binary()), pa.array(counts, pa.binary()), batch.column(6)], names=names)

    def together(table: pa.Table) -> pa.Table:
        """The documents of a chunk from the ids of its words."""
        own, part = codec(), table.column("part").to_pylist()
        a, b = (table.column(c).to_pylist() for c in ("a", "b"))
        if part.count(-1) != 1:
            raise RuntimeError("a chunk's documents and words don't belong together: its input isn't the same when read again")
        d = part.index(-1)
        numbers, lengths, of = B.unpack(a[d], np.uint32), B.unpack(b[d], np.uint32), B.unpack(table.column("c")[d].as_py(), np.uint32)
        word, count = np.full(len(of), None, dtype=object), np.zeros(len(of), dtype=np.int64)
        for k, p in enumerate(part):
            if p >= 0:
                at, n = np.flatnonzero(of == p), B.unpack(b[k], np.uint32)
                word[at] = np.array(own.join(B.unpack(a[k], np.uint32), n), dtype=object)
                count[at] = n
        if len(of) and not count.all():
            raise RuntimeError("a chunk's documents and words don't belong together: its input isn't the same when read again")
        ends = np.cumsum(lengths, dtype=np.int64)
        run = np.concatenate([[0], np.cumsum(count[numbers])])
        tokens = run[ends] - run[ends - lengths]
        get = word.tolist().__getitem__
        own_rows = pa.concat_arrays(table.column("rows").chunks).slice(d, 1).flatten().flatten()
        null = own_rows[-1].to_pylist()
        joined, digest, back, texts = [], [], [], []
        for k, (e, n) in enumerate(zip(ends.tolist(), lengths.tolist())):
            ids_of = " ".join(map(get, numbers[e - n : e].tolist()))
            text = own.decode(ids_of)
            digest.append(hashlib.sha256(ids_of.encode()).hexdigest())
            back.append(hashlib.sha256(text).hexdigest())
            if ids:
                joined.append(ids_of)
            if keep:
                texts.append(None if null[k] else text.decode("utf-8", "replace"))
        by = dict(zip(others, own_rows))
        columns = [pa.array(texts, pa.string()) if keep and c == "text" else by[c] for c in kept]
        columns += [pa.array(tokens, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
        return pa.Table.from_arrays(columns + [pa.array(joined, pa.string())] * ids, names=out_names)

    out = T.StructType([*(docs.schema[c] for c in kept), T.StructField("n_tokens", T.LongType()), *(T.StructField(n, T.StringType()) for n in added[1:])])
    chunks = -(-total // chunk_bytes)
    few = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spread(df: DataFrame, key: str, groups: int) -> DataFrame:
        """More partitions than the session's where one of those would get more than eight groups, or groups that carry all columns."""
        return B.dealt(df, key, groups) if keep or groups > few else df

    merged = spread(carried.transform(B.arrow, shred, schema), "key", chunks + parts).groupBy("key").applyInArrow(merge, schema)
    return spread(merged, "chunk", chunks).groupBy("chunk").applyInArrow(together, out)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The texts (doc_id, text) of a table (doc_id, ids); null ids give an empty text."""
    ranks = encoded.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _CODECS.get((path, pattern)) or _codec(path, pattern, ranks.value)
        for batch in batches:
            texts = [codec.decode(x or "").decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").transform(B.arrow, run, f"doc_id {kind}, text string")
