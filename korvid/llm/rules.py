"""Quality rules: base counts, and perplexity bands from an n-gram model of characters.

Spark counts all n-grams of ``LONG`` characters of the corpus; a modified
Kneser-Ney model is made of the counts, as sorted arrays of n-gram keys that
are looked up by search; every text gets its perplexity; and for each language
a text outside the band between a lower and an upper perplexity is rejected.

The model grows with the corpus, so no machine holds it.  Texts are dealt into
chunks; each chunk asks for its different n-grams, and the requests, dealt by
a hash of the characters before the last, are the counts and carry the answers
back.  N-grams that end alike but for the last character are together, so a
part of the model can be made without the others.  A text would find all its
own n-grams in a model that learned from it, noise or not: so there are two,
each of one half of the texts, and each answers the other half.  Below
``SHORT`` characters the model rests on n-grams of folded characters, of which
there are ``ALPHABET ** ORDER`` at most: only these reach the driver and are
broadcast.  A larger model also learns the junk of the corpus better, so what
the folded n-grams alone find far off is rejected too.

One model serves all languages: given the characters before, it knows which
language it reads, and texts without a language need no model of their own.
The bands are those of each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

#: Characters of the longest folded n-grams.
ORDER = 4
#: Characters of the longest n-grams, and of the shortest that are unfolded.
LONG, SHORT = 5, 4
#: Bits of a character in a key: code points up to ``PLAIN`` have a number of their own, others share what is left by hash.
BITS, PLAIN = 12, 1280
#: Characters of text of a chunk, and of the texts that a part of the model is made of.
CHUNK_CHARS, PART_CHARS = 8 << 20, 32 << 20
#: Bits of a log probability that travels are counted in steps.
STEP = 1 / 1024
#: Interquartile ranges by which a band reaches beyond the quartiles of its language.
LOWER_REACH, UPPER_REACH = 3.0, 3.5
#: Documents of fewer words don't shape a band (they fail the base rules anyway).
MIN_WORDS = 50
#: Bands that are broadcast; more are joined by shuffling, which changes the plan and no row.
MAX_LANGUAGES = 10_000
#: Words of a text from which on a band isn't widened.
USUAL_WORDS = 250

# The symbols of the base rule.
SYMBOLS = "[#*$%&|<>]".strip("[]")

#: The class of each character number; 0 stands before a document.
_CLASS = np.zeros(1 << BITS, dtype=np.int64)


def _alphabet() -> int:
    """Fill the class of each number; ASCII letters are 26 lower-case classes and one for capitals, all beyond ASCII falls into eight."""
    _CLASS[1:] = 1
    n = 2
    for group in [b" \t\r\x0b\x0c", b"\n", b"0123456789", bytes(range(65, 91)), b".", b",", b"!?", b";:", b"'\"`", SYMBOLS.encode(), b"()[]{}", b"-_/\\"]:
        _CLASS[np.array(list(group)) + 1] = n
        n += 1
    for b in range(97, 123):
        _CLASS[b + 1] = n
        n += 1
    _CLASS[0x81:] = n + np.arange(0x80, (1 << BITS) - 1) % 8
    return n + 8


ALPHABET = _alphabet()
_LINE = np.zeros(256, dtype=bool)
_LINE[0x0A] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def numbers(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """The number of each character of a block, and the offsets of the documents among them."""
    data = block.data
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    more = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32) & 0x3F
    point = lead.copy()
    for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        some = np.flatnonzero(lead >= low)
        value = lead[some] & mask
        for k in range(1, size):
            value = value << 6 | more[at[some] + k]
        point[some] = value
    rest = np.uint64((1 << BITS) - PLAIN - 1)
    out = np.where(point < PLAIN, point + 1, (B.mix(point.astype(np.uint64)) % rest).astype(np.uint32) + PLAIN + 1)
    return out.astype(np.int64), np.searchsorted(at, block.offs)


def keys(number: np.ndarray, offs: np.ndarray, order: int = LONG) -> np.ndarray:
    """The key of the n-gram that ends at each character: ``BITS`` bits of each, the last one lowest; 0 stands before a document."""
    n = len(number)
    size = np.diff(offs)
    place = np.arange(n) - np.repeat(offs[:-1], size)
    key = number.astype(np.uint64)
    for k in range(1, order):
        back = number[: max(n - k, 0)].astype(np.uint64) << np.uint64(BITS * k)
        key[k:] += np.where(place[k:] < k, np.uint64(0), back)
    return key


def _last(key: np.ndarray, order: int) -> np.ndarray:
    return key & np.uint64((1 << BITS * order) - 1)


def folded(key: np.ndarray) -> np.ndarray:
    """The folded n-gram at the end of each key."""
    out = np.zeros(len(key), dtype=np.int64)
    for k in range(ORDER):
        out += _CLASS[_last(key >> np.uint64(BITS * k), 1).astype(np.int64)] * ALPHABET**k
    return out


@dataclass
class KneserNey:
    """Log2 probabilities of the seen folded n-grams and of all shorter back-offs, as sorted key arrays; and of each character in its class."""

    within: np.ndarray  # probability of each character number in its class
    keys: list[np.ndarray]  # for each order 1..ORDER: sorted keys
    logp: list[np.ndarray]
    context: list[np.ndarray]  # for each order 2..ORDER: sorted keys of contexts
    backoff: list[np.ndarray]

    def lookup(self, key: np.ndarray) -> np.ndarray:
        """Log2 probability of the last character of each n-gram, given those before."""
        out = np.zeros(len(key))
        left = np.arange(len(key))
        for order in range(ORDER, 0, -1):
            k = key[left] % ALPHABET**order
            at = np.minimum(np.searchsorted(self.keys[order - 1], k), len(self.keys[order - 1]) - 1)
            hit = self.keys[order - 1][at] == k
            out[left[hit]] += self.logp[order - 1][at[hit]]
            left, k = left[~hit], k[~hit]
            if order == 1 or not len(left):
                break
            c = k // ALPHABET
            at = np.minimum(np.searchsorted(self.context[order - 2], c), len(self.context[order - 2]) - 1)
            known = self.context[order - 2][at] == c
            out[left[known]] += self.backoff[order - 2][at[known]]
        return out


def _discounts(c: np.ndarray) -> np.ndarray:
    """The modified Kneser-Ney discounts of counts 0, 1, 2, and 3 or more."""
    n1, n2, n3, n4 = (max(float((c == i).sum()), 1.0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return np.clip(np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]), [0, 0.05, 0.1, 0.2], [0, 0.95, 1.9, 2.9])


def kneser_ney(key: np.ndarray, count: np.ndarray, of_number: np.ndarray) -> KneserNey:
    """Modified Kneser-Ney (three discounts an order) from sorted distinct folded n-grams, their counts, and how often each character number stands."""
    of_class = np.bincount(_CLASS, of_number, minlength=ALPHABET)[_CLASS]
    within = np.where(of_class > 0, of_number / np.maximum(of_class, 1), 1.0)
    levels = {ORDER: (key, count.astype(np.float64))}
    for order in range(ORDER - 1, 0, -1):  # how many different characters stand before each shorter n-gram
        k, c = np.unique(levels[order + 1][0] % ALPHABET**order, return_counts=True)
        levels[order] = (k, c.astype(np.float64))
    model = KneserNey(within, [], [], [], [])
    lower_p: np.ndarray | None = None
    for order in range(1, ORDER + 1):
        k, c = levels[order]
        take = _discounts(c)[np.minimum(c, 3).astype(int)]
        context, start = np.unique(k // ALPHABET, return_index=True)
        total = np.add.reduceat(c, start)
        gamma = np.add.reduceat(take, start) / total
        of = np.repeat(np.arange(len(context)), np.diff(np.append(start, len(k))))
        if order == 1:
            p = (c - take) / total[of] + gamma[of] / ALPHABET
            k = np.append(k, ALPHABET) if len(k) < ALPHABET else k
            rest = np.setdiff1d(np.arange(ALPHABET), k)
            k, p = np.concatenate([levels[1][0], rest]), np.concatenate([p, np.full(len(rest), gamma[0] / ALPHABET)])
            by = np.argsort(k)
            k, p = k[by], p[by]
        else:
            at = np.searchsorted(model.keys[-1], k % ALPHABET ** (order - 1))
            p = (c - take) / total[of] + gamma[of] * lower_p[at]
            model.context.append(context)
            model.backoff.append(np.log2(gamma))
        model.keys.append(k)
        model.logp.append(np.log2(p))
        lower_p = p
    return model


def unfolded(key: np.ndarray, count: np.ndarray, ask: np.ndarray, model: KneserNey) -> np.ndarray:
    """Log2 probabilities of the last characters of the n-grams ``ask``, from the sorted distinct n-grams of one part.

    ``model`` has the folded n-grams.  All n-grams of a context are in the
    part, so its probabilities add up to one; discounts are those of the part.
    """

    def base(k: np.ndarray) -> np.ndarray:
        return np.exp2(model.lookup(folded(k))) * model.within[_last(k, 1).astype(np.int64)]

    out = base(ask)
    if not len(key):
        return np.log2(out)
    levels = {LONG: (key, count.astype(np.float64))}
    for order in range(LONG - 1, SHORT - 1, -1):  # how many different characters stand before each shorter n-gram
        k, c = np.unique(_last(levels[order + 1][0], order), return_counts=True)
        levels[order] = (k, c.astype(np.float64))
    p = base(levels[SHORT][0])
    for order in range(SHORT, LONG + 1):
        k, c = levels[order]
        take = _discounts(c)[np.minimum(c, 3).astype(int)]
        context, start = np.unique(k >> np.uint64(BITS), return_index=True)
        total = np.add.reduceat(c, start)
        gamma = np.add.reduceat(take, start) / total
        of = np.repeat(np.arange(len(context)), np.diff(np.append(start, len(k))))
        lower = p if order == SHORT else p[np.searchsorted(levels[order - 1][0], _last(k, order - 1))]
        p = (c - take) / total[of] + gamma[of] * lower
        wanted = _last(ask, order)
        at = np.minimum(np.searchsorted(context, wanted >> np.uint64(BITS)), len(context) - 1)
        out = np.where(context[at] == wanted >> np.uint64(BITS), gamma[at] * out, out)
        at = np.minimum(np.searchsorted(k, wanted), len(k) - 1)
        out = np.where(k[at] == wanted, p[at], out)
    return np.log2(out)


def fit(docs: DataFrame) -> tuple[KneserNey | None, int]:
    """The folded model of all texts (None if they have no character), and how many characters they have.

    One pass; at most ``ALPHABET ** ORDER`` counts of n-grams and ``2 ** BITS``
    of characters are added up in each task and reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET**ORDER, dtype=np.int64)
        own = np.zeros(1 << BITS, dtype=np.int64)
        for block in B.blocks(batches):
            number, offs = numbers(block)
            own += np.bincount(number, minlength=len(own))
            k, c = np.unique(folded(keys(number, offs, ORDER)), return_counts=True)
            total[k] += c
        k, number = np.flatnonzero(total), np.flatnonzero(own)
        found, counts = np.concatenate([k, -1 - number]), np.concatenate([total[k], own[number]])
        for i in range(0, len(found), 100_000):
            part = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(found[part], pa.int64()), pa.array(counts[part], pa.int64())], names=["key", "n"])

    rows = docs.select("text").transform(B.arrow, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    key, count = rows["key"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.int64)
    of_number = np.zeros(1 << BITS, dtype=np.int64)
    of_number[-1 - key[key < 0]] = count[key < 0]
    key, count = key[key >= 0], count[key >= 0]
    if not len(key):
        return None, 0
    by = np.argsort(key)
    return kneser_ney(key[by], count[by], of_number), int(of_number.sum())


def _parts(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings sorted keys by the part of the ``SHORT - 1`` characters before the last, and where each part starts."""
    part = (B.mix(_last(key >> np.uint64(BITS), SHORT - 1)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _chunk_keys(table: pa.Table) -> np.ndarray:
    found = [keys(*numbers(block)) for block in B.blocks(iter(table.to_batches()))]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _repeated(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs (document, hash): the number of equal ones of each, and whether an equal one came before."""
    own = B.mix(key + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, inverse, n = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
    return n[inverse], first[inverse] != np.arange(len(own)), own


def base_counts(block: B.Block) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    docs, offs = len(block), block.offs
    words = B.Words(block)
    n_words = np.diff(words.at)

    def per_doc(flag: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flag)])
        return run[offs[1:]] - run[offs[:-1]]

    chars = per_doc(~B.IS_SEP[block.data] & ((block.data & 0xC0) != 0x80))
    symbols = per_doc(_SYMBOL[block.data])

    lines = B.Words(block, _LINE)
    some = np.concatenate([[0], np.cumsum(~B.IS_SEP[block.data])])
    full = some[lines.end] > some[lines.start]
    line_doc = np.repeat(np.arange(docs), np.diff(lines.at))
    hashes = lines.hashes(lower=False)[full]
    dup_lines = np.bincount(line_doc[full][_repeated(hashes, line_doc[full])[1]], minlength=docs) if len(hashes) else np.zeros(docs, np.int64)

    word_doc = np.repeat(np.arange(docs), n_words)
    window, at = words.windows(words.hashes(lower=False), 3)
    mark = np.zeros(len(word_doc), dtype=bool)
    if len(window):
        again = at[_repeated(window, word_doc[at])[0] > 1]
        for k in range(3):
            mark[again + k] = True
    repeat = np.bincount(word_doc[mark], minlength=docs)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat}


def places(known: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where each key stands in the sorted array ``known``, which has them all: by a table of hashes, and by search where two share a place."""
    if not len(known):
        return np.zeros(0, np.int64)
    shift = np.uint64(64 - (len(known).bit_length() + 3))
    odd = B.PLACE[0]
    table = np.zeros(1 << int(64 - shift), dtype=np.int32)
    table[(known * odd) >> shift] = np.arange(len(known), dtype=np.int32)
    at = table[(key * odd) >> shift]
    wrong = np.flatnonzero(known[at] != key)
    at[wrong] = np.searchsorted(known, key[wrong])
    return at


def _short(logp: np.ndarray) -> np.ndarray:
    """Log2 probabilities as two bytes, in steps of STEP: what a perplexity is off by is a few parts in ten thousand."""
    return np.clip(np.rint(-logp / STEP), 0, (1 << 16) - 1).astype(np.uint16)


def requests(chunks: DataFrame, parts: int) -> DataFrame:
    """Rows (part, chunk, keys, counts): the different n-grams of each chunk, by the part of the model they belong to."""

    def ask(table: pa.Table) -> pa.Table:
        key, count = np.unique(_chunk_keys(table), return_counts=True)
        order, edge = _parts(key, parts)
        key, count = key[order], count[order].astype(np.uint32)
        some = np.flatnonzero(np.diff(edge))
        keys = [B.pack(np.diff(key[edge[i] : edge[i + 1]], prepend=np.uint64(0))) for i in some]
        counts = [B.pack(count[edge[i] : edge[i + 1]]) for i in some]
        chunk = pa.array([table.column("chunk")[0].as_py()] * len(some), pa.int64())
        return pa.table([pa.array(some, pa.int64()), chunk, pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["part", "chunk", "keys", "counts"])

    return chunks.groupBy("chunk").applyInArrow(ask, "part long, chunk long, keys binary, counts binary")


def measure(docs: DataFrame, model: KneserNey | None, size: int) -> DataFrame:
    """Base counts and both perplexities (null without a character) of each document (doc_id, lang, text) of ``size`` characters in all."""
    parts = max(1, -(-size // PART_CHARS))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def answer(table: pa.Table) -> pa.Table:
        asked = [np.cumsum(B.unpack(k, np.uint64), dtype=np.uint64) for k in table.column("keys").to_pylist()]
        counts = [B.unpack(c, np.uint32) for c in table.column("counts").to_pylist()]
        half = np.array(table.column("chunk").to_pylist()) % 2
        found = []
        for h in (0, 1):
            mine = np.flatnonzero(half == h)
            own = np.concatenate([np.zeros(0, np.uint64), *(asked[i] for i in mine)])
            key = np.unique(own)
            found.append((key, np.bincount(places(key, own), np.concatenate([np.zeros(0, np.uint32), *(counts[i] for i in mine)]))))
        packed = [b""] * len(asked)
        for h in (0, 1):  # the model of one half of the texts answers the other
            mine = np.flatnonzero(half != h)
            if len(mine):
                own = np.concatenate([asked[i] for i in mine])
                ask = np.unique(own)
                logp = _short(unfolded(*found[h], ask, shared.value))[places(ask, own)]
                edge = np.cumsum([0, *(len(asked[i]) for i in mine)])
                for k, i in enumerate(mine):
                    packed[i] = B.pack(logp[edge[k] : edge[k + 1]])
        return pa.table([table.column("part"), table.column("chunk"), pa.array(packed, pa.binary())], ["part", "chunk", "logp"])

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        own = _chunk_keys(texts)
        key = np.unique(own)
        at = places(key, own)
        del own
        logp = np.zeros(len(key))
        order, edge = _parts(key, parts)
        for part, packed in zip(answers.column("part").to_pylist(), answers.column("logp").to_pylist()):
            logp[order[edge[part] : edge[part + 1]]] = B.unpack(packed, np.uint16) * -STEP
        short = shared.value.lookup(folded(key)) if len(key) else logp
        done, out = 0, []
        for block in B.blocks(iter(texts.to_batches())):
            counts = base_counts(block)
            lead = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
            offs = lead[block.offs]
            length, n = np.diff(offs), int(offs[-1])
            ways = []
            for bits in (logp, short):
                run_sum = np.concatenate([[0.0], np.cumsum(bits[at[done : done + n]], dtype=np.float64)])
                mean = -(run_sum[offs[1:]] - run_sum[offs[:-1]]) / np.maximum(length, 1)
                ways.append(pa.array(np.exp2(mean), mask=length == 0))
            done += n
            out.append(pa.RecordBatch.from_arrays(
                [block.batch.column("doc_id"), block.batch.column("lang"), *(pa.array(counts[c].astype(np.int64)) for c in names), *ways],
                names=["doc_id", "lang", *names, "perplexity", "folded_perplexity"],
            ))
        return pa.Table.from_batches(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, " + ", ".join(f"{n} long" for n in names) + ", perplexity double, folded_perplexity double"
    many = max(1, -(-size // (2 * CHUNK_CHARS)))  # in each half; equal texts are in the same one
    chunk = (2 * F.pmod(F.xxhash64("doc_id", "text"), F.lit(many)) + F.pmod(F.xxhash64("text"), F.lit(2))).alias("chunk")
    chunks = B.dealt(docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text", chunk), "chunk", 2 * many)
    answers = B.dealt(requests(chunks, parts), "part", parts).groupBy("part").applyInArrow(answer, "part long, chunk long, logp binary")
    answers = B.dealt(answers, "chunk", 2 * many)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, schema)


def bands(measured: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """For each language (null counts as one) the quartiles of the log2 of both perplexities over all documents with enough words."""
    q = [F.percentile_approx(F.log2(c), [0.25, 0.75], 10000).alias(c) for c in ("perplexity", "folded_perplexity")]
    of = measured.where((F.col("n_words") >= min_words) & F.col("perplexity").isNotNull())
    found = of.groupBy(F.coalesce("lang", F.lit("")).alias("_lang")).agg(*q)
    return found.select("_lang", *(F.col(c)[k].alias(f"_{c}_{k}") for c in ("perplexity", "folded_perplexity") for k in (0, 1)))


def rules(docs: DataFrame, lower: float = LOWER_REACH, upper: float = UPPER_REACH) -> DataFrame:
    """Base counts, both perplexities, their bands, base_failed and kept (within both bands) of every document.

    A band is the interquartile range of the document's language, widened by
    multiples of that range; for texts shorter than USUAL_WORDS by more, since
    the mean over fewer characters varies more, with the root of their number.

    A null or empty text has no words and fails the base rules.  A document
    whose language has no band (no document with enough words) is kept or
    not by the base rules alone.  Repeated rows are judged alike; an empty
    table gives an empty table; other columns are neither read nor returned.
    """
    measured = B.cut(measure(docs, *fit(docs)))
    found = B.cut(bands(measured))
    if found.count() <= MAX_LANGUAGES:  # documents stay where they are
        found = F.broadcast(found)
    joined = measured.withColumn("_lang", F.coalesce("lang", F.lit(""))).join(found, "_lang", "left")
    wider = F.greatest(F.lit(1.0), F.sqrt(F.lit(USUAL_WORDS) / F.greatest("n_words", F.lit(1))))
    inside = F.lit(True)
    for c, band in (("perplexity", "band"), ("folded_perplexity", "folded_band")):
        low, high = F.col(f"_{c}_0"), F.col(f"_{c}_1")
        span = F.greatest(high - low, F.lit(0.02)) * wider
        joined = joined.withColumns({f"{band}_low": F.pow(F.lit(2.0), low - lower * span), f"{band}_high": F.pow(F.lit(2.0), high + upper * span)}).drop(f"_{c}_0", f"_{c}_1")
        inside &= F.coalesce(F.col(c).between(F.col(f"{band}_low"), F.col(f"{band}_high")), F.lit(True))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.drop("_lang").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & inside)
