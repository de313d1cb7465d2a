"""N-gram Jaccard join by PartEnum signatures, and the groups its links form.

A document is the set of its word shingles.  Sizes are cut into bands; within
a band two sets that are similar enough differ in a bounded number ``k`` of
shingles.  The shingle domain is split, by hash, into first-level groups of
``PARTS`` partitions each; for every group the subsets of ``PARTS - 1`` of its
partitions are enumerated, and a signature is the content of such a subset.
A difference spoils one partition, so a group goes on yielding a common
signature until two of its partitions differ: about half as many groups as
differences are enough.

Exactness
    A group is strong in a set if at least two of its partitions aren't
    empty; then one difference leaves a subset that is whole and not empty,
    and a common signature.  A set takes part in the band of its size and in
    every larger band that a similar set may be in.  It sends all its groups
    up to its ``need``-th strong one, ``need`` being half of ``k + spare +
    1``.  Of two similar sets, take the one that stops first: all its strong
    groups are sent by the other too, and ``k`` differences leave at least
    ``2 * need - k``, that is ``spare + 1``, common signatures.  A set with
    too few strong groups sends all groups and the signatures of a prefix
    filter, so two sets of that kind meet there.  Every candidate is verified
    on the sets.
Common signatures
    A signature shared by few sets makes all its pairs candidates; since
    similar sets agree on ``spare + 1`` signatures, pairs that share fewer
    (common ones allowed for) need no verification.  A set with at most
    ``spare`` signatures that many sets share meets all its partners under
    other ones.  Only sets with more are compared under common signatures,
    all but the commonest ones, and only with sets they aren't connected with
    yet: first each with one centre (the set with the most common signatures,
    as the origin of a family of copies has).  Those still apart then meet
    the others of that kind where they share one of their rarest shingles.
Size
    Signatures travel packed, about six bytes each, in as many buckets as the
    corpus needs; exact copies within a task are sent once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import with_row_index
from . import blocks as B

SHINGLE = 5
#: Similarity as a fraction: NUM / DEN.
NUM, DEN = 80, 100
BAND_RATIO = 1.5
#: Partitions of a first-level group.
PARTS = 3
#: Sets that share a signature up to this number are all compared with each other.
SMALL_GROUP = 12
#: Signatures of a bucket, of which a task holds one at a time.
BUCKET_ROWS = 500_000
#: Ids that are broadcast to find their documents; more are joined instead.
MAX_IDS = 2_000_000
STAR_ROUNDS = 1
#: A set shares one signature more than one for each SPARE shingles with every similar one; it may do without one for each DROP.
SPARE, DROP = 20, 25
#: Tasks over which the members of one signature are dealt.
SALTS = 16
#: Ratio of the sizes that meet in one cell under a rare shingle.
CELL_RATIO = 1.02
_FLUSH = 300_000
#: Links that a task contracts at once.
_LINKS = 1_000_000
_AT, _LEFT_OUT, _STEP = B.PLACE[:PARTS], B.PLACE[PARTS : 2 * PARTS], np.uint64(0xD6E8FEB86659FD93)
_GROUP = np.arange(4096, dtype=np.uint64) * _STEP
_FALLBACK = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(block: B.Block, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each document its different shingle hashes, sorted; the whole sequence is one shingle if it has fewer words."""
    words = B.Words(block)
    own = words.hashes()
    window, at = words.windows(own, n)
    edge = np.searchsorted(at, words.at)
    for i in range(len(block)):
        a, b = int(words.at[i]), int(words.at[i + 1])
        if b - a >= n:
            yield np.unique(window[edge[i] : edge[i + 1]])
        elif b > a:
            short = (own[a:b] * B.PLACE[32 : 32 + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield B.mix(np.array([short], dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)


class Bands:
    """Size bands, and what a set of a given size sends in each."""

    def __init__(self, ratio: float = BAND_RATIO, num: int = NUM, den: int = DEN):
        self.num, self.den, self.ratio = num, den, ratio
        self.low = [1]
        self.groups: list[int] = []
        self._plans: dict[int, list[tuple[int, int, int]]] = {}

    def most(self, size: int) -> int:
        """Size of the largest set that can be similar."""
        return size * self.den // self.num

    def differ(self, size: int, other: int) -> int:
        """Most shingles in which similar sets of these sizes differ."""
        return (size + other) * (self.den - self.num) // (self.den + self.num)

    @staticmethod
    def spare(size: int) -> int:
        return -(-size // SPARE)

    @staticmethod
    def may_drop(size: int) -> int:
        """Common signatures that a set may do without: no more than any similar set has to spare."""
        return size // DROP

    def need(self, size: int, high: int) -> int:
        """Strong groups that a set must send in a band that ends at ``high``."""
        return -(-(self.differ(size, min(high, self.most(size))) + self.spare(size) + 1) // 2)

    def _grow(self, size: int) -> None:
        while self.low[-1] <= size:
            a = self.low[-1]
            b = max(a + 1, int(a * self.ratio))
            self.low.append(b)
            self.groups.append(self._groups(a, b - 1))

    def _groups(self, low: int, high: int) -> int:
        """Least number of groups of which sets of these sizes, and smaller similar ones, have as many strong ones as they need, nearly always."""
        sizes = {low, high, max(1, -(-low * self.num // self.den))}
        n = 1
        while True:
            for m in sizes:
                full = 1 - np.exp(-m / (PARTS * n))
                strong = 1 - (1 - full) ** PARTS - PARTS * full * (1 - full) ** (PARTS - 1)
                if n * strong - 2.5 * np.sqrt(n * strong * (1 - strong)) < self.need(m, high) and PARTS * n < 2 * m:
                    break
            else:
                return n
            n = max(n + 1, int(n * 1.02))

    def plan(self, size: int) -> list[tuple[int, int, int]]:
        """(band, groups, strong groups to send) of each band in which a set of this size takes part."""
        if size not in self._plans:
            self._grow(self.most(size))
            out = []
            for k in range(len(self.groups)):
                low, high = self.low[k], self.low[k + 1] - 1
                if high >= size and low <= self.most(size):
                    out.append((k, self.groups[k], self.need(size, high)))
            self._plans[size] = out
        return self._plans[size]


def signatures(shingles: np.ndarray, bands: Bands) -> tuple[list[np.ndarray], bool]:
    """The signatures of a set, and whether it had to fall back on prefixes in some band."""
    out, fallback = [], False
    scrambled = B.mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    for band, groups, need in bands.plan(len(shingles)):
        seed = np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        part = (B.mix(shingles + seed) % np.uint64(PARTS * groups)).astype(np.uint16 if PARTS * groups < 1 << 16 else np.int64)  # short numbers sort fast
        order = np.argsort(part, kind="stable")
        ordered = part[order]
        start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        content = np.zeros(PARTS * groups, dtype=np.uint64)  # of each partition; 0 is empty
        content[ordered[start]] = B.mix(np.add.reduceat(scrambled[order], start) + seed) | np.uint64(1)
        content = content.reshape(groups, PARTS)
        filled = content != 0
        some = filled.sum(1)
        strong = np.cumsum(some >= 2)
        if strong[-1] < need:
            fallback, sent = True, groups
        else:
            sent = int(np.searchsorted(strong, need)) + 1
        own = content[:sent] * _AT
        group = _GROUP[:sent] if sent <= len(_GROUP) else np.arange(sent, dtype=np.uint64) * _STEP
        whole = own.sum(1, dtype=np.uint64) + group + seed
        subsets = B.mix(whole[:, None] - own + _LEFT_OUT)  # all partitions but one, for each one
        out.append(subsets[some[:sent, None] > filled[:sent]])
    if fallback:
        m = len(shingles)
        out.append(B.mix(shingles[: m - -(-m * bands.num // bands.den) + 1] + _FALLBACK))
    return out, fallback


def sizes(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, hi, lo) of each row: the size of its set and a 128-bit digest of it (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.blocks(batches):
            size, hi, lo = [], [], []
            for s in shingle_sets(block, n):
                size.append(len(s))
                hi.append(B.mix(s).sum(dtype=np.uint64) if len(s) else 0)
                lo.append(B.mix(s ^ _FALLBACK).sum(dtype=np.uint64) if len(s) else 0)
            empty = np.array(size, dtype=np.int64) == 0
            digest = [pa.array(np.array(x, dtype=np.uint64).view(np.int64), mask=empty) for x in (hi, lo)]
            yield pa.RecordBatch.from_arrays([block.batch.column(0), pa.array(size, pa.int64()), *digest], names=["doc_id", "n_shingles", "hi", "lo"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(B.arrow, run, "doc_id long, n_shingles long, hi long, lo long")


def _pack(sig: np.ndarray, doc: np.ndarray, flag: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Five bytes of each signature; ids as differences, byte planes apart, which compress to little; flags as bits."""
    planes = sig.view(np.uint8).reshape(-1, 8)[:, :5]
    step = np.diff(doc, prepend=0).view(np.uint8).reshape(-1, 8)
    return planes.tobytes(), step.T.tobytes(), np.packbits(flag).tobytes()


def _unpack(sig: bytes, doc: bytes, flag: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(sig, np.uint8).reshape(-1, 5)
    wide = np.zeros((len(planes), 8), np.uint8)
    wide[:, :5] = planes
    step = np.ascontiguousarray(np.frombuffer(doc, np.uint8).reshape(8, -1).T)
    return wide.view(np.uint64).ravel(), np.cumsum(step.view(np.int64).ravel()), np.unpackbits(np.frombuffer(flag, np.uint8), count=len(planes)).astype(bool)


def signature_table(docs: DataFrame, buckets: int, n: int = SHINGLE) -> DataFrame:
    """Packed signatures (bucket, sig, doc, flag) of all sets that aren't empty; a set that a task has seen isn't sent again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(), set()
        sigs: list[np.ndarray] = []
        ids: list[int] = []
        counts: list[int] = []
        flags: list[bool] = []
        held = 0

        def flush() -> pa.RecordBatch:
            sig = np.concatenate(sigs)
            doc, flag = np.repeat(np.array(ids, np.int64), counts), np.repeat(np.array(flags, bool), counts)
            bucket = ((sig >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(edge)):
                o = order[edge[b] : edge[b + 1]]
                rows.append((int(b), *_pack(sig[o], doc[o], flag[o])))
            for x in (sigs, ids, counts, flags):
                x.clear()
            b, s, d, f = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(b, pa.int32()), *(pa.array(x, pa.binary()) for x in (s, d, f))], names=["bucket", "sig", "doc", "flag"]
            )

        for block in B.blocks(batches):
            own = block.batch.column(0).to_pylist()
            for i, s in enumerate(shingle_sets(block, n)):
                if not len(s) or own[i] is None:
                    continue
                digest = s.sum(dtype=np.uint64).tobytes() + B.mix(s).sum(dtype=np.uint64).tobytes()
                if digest in seen:
                    continue
                seen.add(digest)
                found, flag = signatures(s, bands)
                sigs += found
                ids.append(own[i])
                counts.append(sum(map(len, found)))
                flags.append(flag)
                held += counts[-1]
                if held >= _FLUSH:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.transform(B.arrow, run, "bucket int, sig binary, doc binary, flag binary")


def candidates(table: DataFrame, small: int = SMALL_GROUP) -> DataFrame:
    """Rows of each bucket: pairs (a < b) with the number ``n`` of uncommon signatures they share, ``sig`` being null;
    and for each common signature its members (sig, b).  ``flag`` says that all sets of the row fell back on prefixes."""

    def run(group: pa.Table) -> pa.Table:
        parts = [_unpack(s, d, f) for s, d, f in zip(*(group.column(c).to_pylist() for c in ("sig", "doc", "flag")))]
        sig, doc, flag = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((doc, sig))
        sig, doc, flag = sig[order], doc[order], flag[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])])
        sig, doc, flag = sig[new], doc[new], flag[new]
        size = np.diff(np.append(np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])), len(sig)))
        few = np.repeat(size, size) <= small
        one, two = [], []
        for step in range(1, small):
            same = np.flatnonzero(few[:-step] & (sig[:-step] == sig[step:])) if step < len(sig) else np.zeros(0, np.int64)
            one.append(same)
            two.append(same + step)
        i, j = np.concatenate(one), np.concatenate(two)
        order = np.lexsort((doc[j], doc[i]))
        i, j = i[order], j[order]
        a, b, free = doc[i], doc[j], flag[i] & flag[j]
        start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        n = np.diff(np.append(start, len(a)))
        a, b, free = a[start], b[start], free[start]
        many = np.flatnonzero(~few)
        bucket = np.uint64(group.column("bucket")[0].as_py()) << np.uint64(40)
        pair = np.arange(len(a) + len(many)) < len(a)
        return pa.table({
            "sig": pa.array(np.concatenate([np.zeros(len(a), np.int64), (sig[many] | bucket).view(np.int64)]), mask=pair),
            "a": pa.array(np.concatenate([a, np.zeros(len(many), np.int64)]), mask=~pair), "b": np.concatenate([b, doc[many]]),
            "n": np.concatenate([n, np.ones(len(many), np.int64)]), "flag": np.concatenate([free, flag[many]]),
        })

    return table.groupBy("bucket").applyInArrow(run, "sig long, a long, b long, n long, flag boolean")


def sets_of(docs: DataFrame, ids: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, shingles) of the documents named in ``ids`` (doc_id): six bytes of each shingle hash, sorted; a row for each different set.

    Up to MAX_IDS ids are broadcast and texts stay where they are; more are
    joined.  That changes the plan only, never the rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    count = ids.count()
    known = None
    if count <= MAX_IDS:
        known = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toPandas()["doc_id"].to_numpy(dtype=np.int64)))
    else:
        rows = rows.join(ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if known is not None:
                own = np.nan_to_num(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.int64) if batch.column(0).null_count else batch.column(0).to_numpy()
                at = np.minimum(np.searchsorted(known.value, own), max(len(known.value) - 1, 0))
                keep = known.value[at] == own if len(known.value) else np.zeros(len(own), bool)
                batch = batch.filter(pa.array(keep & ~np.array(batch.column(0).is_null())))
            for block in B.blocks(iter([batch])):
                out = [np.unique(s & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in shingle_sets(block, n)]
                yield pa.RecordBatch.from_arrays([block.batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "shingles"])

    return rows.transform(B.arrow, run, "doc_id long, shingles binary").distinct()


def _set(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(planes), 8), np.uint8)
    wide[:, :6] = planes
    return wide.view(np.uint64).ravel()


def verified(docs: DataFrame, pairs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """Those of the pairs (a, b), each given once, whose sets are similar enough."""
    pairs = B.cut(pairs.select("a", "b"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = B.cut(sets_of(docs, ids, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if a != last:
                    last, one = a, _set(x)
                p, q = len(x) // 6, len(y) // 6
                if DEN * min(p, q) < NUM * max(p, q):
                    keep.append(False)
                    continue
                both = np.concatenate([one, _set(y)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(DEN * common >= NUM * (p + q - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("_x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("_y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "_x", "_y").transform(B.arrow, run, "a long, b long").distinct()


def _contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node of the links but the smallest of its component: the node, and that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for x in (u, v):
            np.minimum.at(new, label[x], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def forest(links: DataFrame) -> DataFrame:
    """Links (u, v), u > v, that connect what ``links`` (a, b) connect: those of a task are contracted there, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            u, v = _contracted(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            if sum(len(x) for x, _ in held) >= _LINKS:
                yield out()
        if held:
            yield out()

    return links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").transform(B.arrow, run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of ``links`` (a, b) the smallest node it is connected with.

    Each task contracts its own links first; then large-star and small-star
    steps alternate until nothing changes.  Every step is cut off in the
    shared folder.  The smallest neighbours are written before they are joined
    with the links, so the two sides of that join are plain exchanges, and
    Spark splits the key of a node that very many are linked with.
    """
    edges = B.cut(forest(links).distinct())
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == mark or not now[0]:
            break
        mark = tuple(now)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = B.cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = B.cut(both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = B.cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = B.cut(small.where("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) when more links (a, b) come to those that ``groups`` (node, component) was made of.

    Only the components that the new links join are looked at again.
    """
    own = {side: groups.select(F.col("node").alias(side), F.col("component").alias(f"_{side}")) for side in ("a", "b")}
    named = links.join(own["a"], "a", "left").join(own["b"], "b", "left")
    above = components(named.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b"))
    top = above.select(F.col("node").alias("component"), F.col("component").alias("_top"))
    moved = groups.join(top, "component", "left").select("node", F.coalesce("_top", "component").alias("component"))
    return B.cut(moved.unionByName(above))


def sized(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) whose sets' sizes allow them to be similar, with the sizes and counts of ``info`` for both."""
    for side in ("a", "b"):
        own = info.select(F.col("doc_id").alias(side), F.col("_m").alias(f"_m{side}"), F.col("_x").alias(f"_x{side}"), F.col("_h").alias(f"_h{side}"))
        pairs = pairs.join(own, side)
    return pairs.where((DEN * F.col("_xa") >= NUM * F.col("_mb")) & (DEN * F.col("_xb") >= NUM * F.col("_ma")))


def salted(rows: DataFrame, few: DataFrame, key: list[str], by: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with a table of one row a key; rows of a key are dealt over SALTS tasks by another column."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return dealt.join(few.withColumn("_salt", salt), [*key, "_salt"], how).drop("_salt")


def prefix_pairs(docs: DataFrame, labels: DataFrame, n: int = SHINGLE) -> DataFrame:
    """Pairs (a < b) of the sets named in ``labels`` (b, _c), of different ``_c``, that share one of their rarest shingles.

    Rarest first, similar sets share one of the first ``size - NUM / DEN *
    size + 1`` shingles of either, and at the first that they share enough of
    both must be left; so no link is lost.  A passage that many of these sets
    hold is not among the rarest of any that has enough else.  What is left at
    a shingle also bounds the sizes of the partners that can matter there: a
    set meets only the cells of such sizes, so sets whose common passage comes
    too late in either never make a pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                sets = [_set(x) for x in batch.column(1)[k : k + 500].to_pylist()]
                sizes = [len(x) for x in sets]
                at = pa.array(np.repeat(np.arange(len(sets)), sizes))
                own = [batch.column(c)[k : k + 500].take(at) for c in (0, 2)]
                columns = [*own, pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(sizes, sizes).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["b", "_k", "shingle", "_size"])

    packed = sets_of(docs, labels.select(F.col("b").alias("doc_id")), n)
    rows = B.cut(packed.select("doc_id", "shingles", F.xxhash64("shingles")).transform(B.arrow, run, "b long, _k long, shingle long, _size long"))
    often = rows.groupBy("shingle").agg(F.count("*").alias("_often")).where("_often > 1")
    rank = F.row_number().over(Window.partitionBy("b", "_k").orderBy("_often", "shingle"))
    ranked = salted(rows, often, ["shingle"], "b", "left").withColumn("_rank", rank)  # null: in one set only, the rarest
    send = F.expr(f"_size - (_size * {NUM} + {DEN - 1}) div {DEN} + 1")
    sent = ranked.where((F.col("_rank") <= send) & F.col("_often").isNotNull()).join(labels, "b")
    sent = B.cut(sent.select("shingle", "b", "_c", "_size", (F.col("_size") - F.col("_rank") + 1).alias("_left")))
    apart = sent.groupBy("shingle").agg(F.min("_c").alias("_low"), F.max("_c").alias("_high")).where("_low <> _high").select("shingle")
    sent = B.cut(salted(sent, apart, ["shingle"], "b"))

    def cell(size: str) -> Column:
        return F.floor(F.log(F.expr(size).cast("double")) / float(np.log(CELL_RATIO))).cast("int")

    # the larger set of a pair goes to the cells of the partners that what it has left allows; the smaller one has a cell
    lowest, highest = f"(_size * {NUM} + {DEN - 1}) div {DEN}", f"least(_size, (_left * {NUM + DEN}) div {NUM} - _size)"
    larger = sent.where(F.expr(f"{highest} >= {lowest}")).withColumn("_cell", F.explode(F.sequence(cell(lowest), cell(highest))))
    larger = larger.select("shingle", "_cell", F.col("b").alias("a"), F.col("_c").alias("_d"), F.col("_size").alias("_other"), F.col("_left").alias("_rest"))
    smaller = sent.where(f"_left * {NUM + DEN} >= {2 * NUM} * _size").withColumn("_cell", cell("_size"))
    enough = (NUM + DEN) * F.least("_left", "_rest") >= NUM * (F.col("_size") + F.col("_other"))
    near = (F.col("_c") != F.col("_d")) & (F.col("_size") <= F.col("_other")) & enough
    return larger.join(smaller, ["shingle", "_cell"]).where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def undroppable(members: DataFrame, info: DataFrame) -> DataFrame:
    """Members (sig, b, _h) of common signatures, without as many of the commonest of each set as it may drop.

    Similar sets that share nothing but common signatures share more than
    that; in the order of frequency, the same for all sets, one of those that
    are kept is among them.  Sets that fell back keep all.
    """
    often = members.groupBy("sig").agg(F.count("*").alias("_often"))
    own = info.select(F.col("doc_id").alias("b"), "_m", "_h", "_flag")
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("_often"), "sig"))
    ranked = salted(members, often, ["sig"], "b").join(own, "b").withColumn("_rank", rank)
    return ranked.where(F.col("_flag") | (F.col("_rank") > F.expr(f"_m div {DROP}"))).select("sig", "b", "_h")


def likely(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Pairs that can be similar, by their sizes and by how many signatures they share.

    Similar sets share ``spare + 1`` signatures of the smaller one, unless
    both fell back; those they share and that aren't counted here are common
    ones, of which they share no more than either has.
    """
    counted = sized(pairs.groupBy("a", "b").agg(F.sum("n").alias("_n"), F.max("flag").alias("_free")), info)
    least = F.least("_ma", "_mb")
    spare = F.ceil(least / SPARE)
    return counted.where(F.col("_free") | (F.col("_n") + F.least("_ha", "_hb") >= spare + 1)).select("a", "b")


def join(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text).

    Documents link when their shingle sets' Jaccard similarity is at least
    NUM / DEN; component_id is the smallest id that links lead to, the
    document's own included.  Null, empty and blank texts have no shingles and
    link with nothing.  Rows with the same id are one document: if their texts
    differ, it links with whatever any of them links with, and each row has
    its own size.  Ids may be of any type that has an order; those that aren't
    integers are numbered in that order first.  A row without an id gets no
    component.  An empty table gives an empty table; other columns are neither
    read nor returned.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        ids = docs.select(F.col("doc_id").alias("_id")).where("_id IS NOT NULL").distinct()
        ids = B.cut(with_row_index(ids, "_id", name="_n"))
        rows = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id"), "left").select(F.col("_n").alias("doc_id"), "text")
        own, group = (ids.select(F.col("_n").alias(n), F.col("_id").alias(i)) for n, i in (("doc_id", "_own"), ("component_id", "_group")))
        return join(rows, n).join(own, "doc_id", "left").join(group, "component_id", "left").select(
            F.col("_own").alias("doc_id"), "n_shingles", F.col("_group").alias("component_id")
        )
    known = B.cut(sizes(docs, n))
    classes = known.where(F.col("hi").isNotNull() & F.col("doc_id").isNotNull()).groupBy("hi", "lo")
    classes = classes.agg(F.min("doc_id").alias("rep"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    of = salted(known, classes, ["hi", "lo"], "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    of = B.cut(of)
    total = of.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_ROWS)))
    found = B.cut(candidates(B.dealt(signature_table(docs, buckets, n), "bucket", buckets)))

    same = of.where(F.col("rep") != F.col("doc_id")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()

    common = found.where(F.col("sig").isNotNull())
    counts = common.groupBy("b").agg(F.count("*").alias("_h"), F.max("flag").alias("_flag"))
    info = of.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("n_shingles").alias("_m"), F.max("n_shingles").alias("_x"))
    info = B.cut(info.join(counts, info["doc_id"] == counts["b"], "left").select("doc_id", "_m", "_x", F.coalesce("_h", F.lit(0)).alias("_h"), F.coalesce("_flag", F.lit(False)).alias("_flag")))

    groups = components(verified(docs, likely(found.where(F.col("sig").isNull()), info), n).unionByName(same))
    stuck = info.where(F.col("_flag") | (F.col("_h") > F.expr(f"_m div {DROP}"))).select(F.col("doc_id").alias("b"))
    members = B.cut(undroppable(common.select("sig", "b").join(stuck, "b", "left_semi"), info))
    for turn in range(STAR_ROUNDS + 1):
        label = groups.select(F.col("node").alias("b"), F.col("component").alias("_c"))
        at = members.join(label, "b", "left").withColumn("_c", F.coalesce("_c", "b"))
        split = at.groupBy("sig").agg(F.min("_c").alias("_low"), F.max("_c").alias("_high")).where(F.col("_low") != F.col("_high"))
        at = B.cut(salted(at, split.select("sig", "_low"), ["sig"], "b"))
        if at.isEmpty():
            break
        if turn < STAR_ROUNDS:
            centre = at.groupBy("sig").agg(F.min(F.struct(-F.col("_h"), "b", "_c")).alias("_x")).select("sig", F.col("_x.b").alias("a"), F.col("_x._c").alias("_d"))
            again = salted(at, centre, ["sig"], "b").where(F.col("_c") != F.col("_d")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        else:
            again = prefix_pairs(docs, at.select("b", "_c").distinct(), n)
        groups = merged(groups, verified(docs, sized(again, info), n))
        members = at.select("sig", "b", "_h")
    label = groups.select(F.col("node").alias("doc_id"), F.col("component").alias("_c"))
    return of.join(label, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("_c", "doc_id").alias("component_id"))
