"""Base counts against plain Python; the model is a probability; bands reject what is far off."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from korvid.llm import blocks as B
from korvid.llm import rules as R

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": dup, "n_repeat_words": len(marked)}


def test_base_counts():
    rnd = random.Random(1)
    texts = ["", None, " \n\n", "a b c a b c", "x\ny\nx\n \n \nX", "a a a a", "a\r\na\r\na", "é é é é|#"]
    texts += ["".join(rnd.choice("ab é#|\n\t") for _ in range(rnd.randint(0, 120))) for _ in range(200)]
    for limit in (1, 300, 1 << 20):
        got = []
        for block in B.blocks(iter([pa.record_batch({"text": pa.array(texts)})]), limit=limit):
            counts = R.base_counts(block)
            got += [{k: int(v[i]) for k, v in counts.items()} for i in range(len(block))]
        assert got == [plain(t) for t in texts]


def block_of(*texts):
    return next(B.blocks(iter([pa.record_batch({"text": pa.array(texts, pa.large_string())})])))


def number(c):
    """The number of a character: its own below PLAIN, a hashed one above."""
    if ord(c) < R.PLAIN:
        return ord(c) + 1
    return int(B.mix(np.array([ord(c)], np.uint64))[0]) % ((1 << R.BITS) - R.PLAIN - 1) + R.PLAIN + 1


def test_characters():
    texts = ["aé中🙂", "", "\x00z߿ࠀ￿𐀀", "ωЖ"]
    got, offs = R.numbers(block_of(*texts))
    assert got.tolist() == [number(c) for t in texts for c in t] and offs.tolist() == [0, 4, 4, 10, 12]
    rnd = random.Random(7)
    text = "".join(chr(rnd.choice([rnd.randrange(1, 0xD800), rnd.randrange(0xE000, 0x110000)])) for _ in range(3000))
    got = R.numbers(block_of(text))[0]
    assert got.tolist() == [number(c) for c in text] and 0 < got.min() and got.max() < 1 << R.BITS


class Plain:
    """Modified Kneser-Ney with dictionaries; n-grams are tuples."""

    def __init__(self, counts, lowest, base):
        self.levels, self.base, self.lowest = {}, base, lowest
        top = len(next(iter(counts))) if counts else lowest
        for order in range(top, lowest - 1, -1):
            if order < top:
                counts = Counter(g[1:] for g in counts)
            n = [max(1, sum(c == i for c in counts.values())) for i in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            d = [min(max(i - (i + 1) * y * n[i] / n[i - 1], low), high) for i, low, high in ((1, 0.05, 0.95), (2, 0.1, 1.9), (3, 0.2, 2.9))]
            total, taken = Counter(), Counter()
            for g, c in counts.items():
                total[g[:-1]] += c
                taken[g[:-1]] += d[min(c, 3) - 1]
            self.levels[order] = (counts, d, total, taken)

    def p(self, gram):
        out = self.base(gram)
        for order in sorted(self.levels):
            counts, d, total, taken = self.levels[order]
            g = gram[len(gram) - order :]
            if g[:-1] in total:
                c = counts.get(g, 0)
                out = (max(c - d[min(c, 3) - 1], 0) if c else 0) / total[g[:-1]] + taken[g[:-1]] / total[g[:-1]] * out
        return out


def grams(text, n, of):
    padded = [0] * (n - 1) + [of(c) for c in text]
    return [tuple(padded[i : i + n]) for i in range(len(text))]


def test_perplexity_against_plain_kneser_ney(spark):
    """Both perplexities of every text, the model of each half being made of the texts of the other."""
    rnd = random.Random(12)
    words = ["harbour", "nördlich", "слово", "中文字", "café", "x1", "The", "42", "lamp,"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 40))), "en") for i in range(40)] + [(90, "", "en"), (91, None, None), (92, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in R.measure(docs, *R.fit(docs)).collect()}
    half = {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", "pmod(xxhash64(text), 2) AS h").collect()}
    fold = lambda c: int(R._CLASS[number(c)])
    chars = Counter(number(c) for _, t, _ in rows for c in t or "")
    classes = Counter()
    for k, n in chars.items():
        classes[int(R._CLASS[k])] += n
    short = Plain(Counter(g for _, t, _ in rows for g in grams(t or "", R.ORDER, fold)), 1, lambda g: 1 / R.ALPHABET)
    small = lambda g: short.p(tuple(int(R._CLASS[x]) for x in g[-R.ORDER :])) * chars[g[-1]] / classes[int(R._CLASS[g[-1]])]
    long = {h: Plain(Counter(g for i, t, _ in rows if half[i] == h for g in grams(t or "", R.LONG, number)), R.SHORT, small) for h in (0, 1)}
    for i, t, _ in rows:
        if not t:
            assert got[i]["perplexity"] is None and got[i]["folded_perplexity"] is None
            continue
        want = 2 ** -np.mean([np.log2(long[1 - half[i]].p(g)) for g in grams(t, R.LONG, number)])
        folded = 2 ** -np.mean([np.log2(short.p(g)) for g in grams(t, R.ORDER, fold)])
        assert abs(got[i]["perplexity"] - want) < 5e-4 * want and abs(got[i]["folded_perplexity"] - folded) < 1e-4 * folded


def model_of(*texts):
    n, offs = R.numbers(block_of(*texts))
    k, c = np.unique(R.folded(R.keys(n, offs, R.ORDER)), return_counts=True)
    return R.kneser_ney(k, c, np.bincount(n, minlength=1 << R.BITS)), R.keys(n, offs)


def test_model_is_a_probability():
    rnd = random.Random(2)
    model, _ = model_of(" ".join(rnd.choice(["the", "cat", "sat", "on", "mats", "rarely"]) for _ in range(3000)))
    a = R.ALPHABET
    for context in [int(x) // a for x in model.keys[-1][:50]] + [0, 5, a**3 - 1]:
        assert abs(np.exp2(model.lookup(context * a + np.arange(a))).sum() - 1) < 1e-6


def test_unfolded_model_is_a_probability():
    rnd = random.Random(4)
    model, key = model_of(" ".join(rnd.choice(["Der", "Hund", "bellt", "µ²", "42", "47"]) for _ in range(3000)))
    key, count = np.unique(key, return_counts=True)
    size = np.bincount(R._CLASS[1:], minlength=R.ALPHABET)
    model.within = np.append(0, 1 / size[R._CLASS[1:]])
    shift = np.uint64(R.BITS)
    for context in [*(key[:40] >> shift), *(key[-40:] >> shift), np.uint64(0x41424344)]:
        ask = (context << shift) + np.arange(1, 1 << R.BITS, dtype=np.uint64)
        assert abs(np.exp2(R.unfolded(key, count, ask, model)).sum() - 1) < 0.05  # class 0 stands before documents only
    order, edge = R._parts(key, 3)
    for i in range(3):  # all n-grams of a context are in one part
        mine = key[order[edge[i] : edge[i + 1]]]
        assert not np.isin(mine >> shift, np.setdiff1d(key, mine) >> shift).any()


def test_characters_of_a_class_are_told_apart(spark, monkeypatch):
    rnd = random.Random(5)
    usual, odd = "αβγδε", "ικλμν"  # the same classes when folded, letter by letter
    assert all(R._CLASS[number(a)] == R._CLASS[number(b)] for a, b in zip(usual, odd))
    words = ["".join(rnd.choice(usual) for _ in range(5)) for _ in range(12)]
    rows = [(i, " ".join(rnd.choices(words, k=80)), "el") for i in range(100)]
    rows.append((900, rows[0][1].translate(str.maketrans(usual, odd)), "el"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = {r["doc_id"]: r["perplexity"] for r in R.rules(docs).collect()}
    assert whole[900] > 1.5 * max(v for k, v in whole.items() if k < 900)
    monkeypatch.setattr(R, "CHUNK_CHARS", 5000)  # the counts of all chunks make the same model
    many = {r["doc_id"]: r["perplexity"] for r in R.rules(docs).collect()}
    assert all(abs(many[k] - v) < 5e-4 * v for k, v in whole.items())


def test_places():
    rng = np.random.default_rng(1)
    for n in (1, 2, 1000, 50_000):
        known = np.unique(rng.integers(0, 1 << 60, n, dtype=np.uint64))
        key = rng.choice(known, 3 * n)
        assert (known[R.places(known, key)] == key).all()
    assert len(R.places(np.zeros(0, np.uint64), np.zeros(0, np.uint64))) == 0


def test_keys_stay_within_documents():
    values = ["abcdef", "", "xy", "qé"]
    apart = [R.keys(*R.numbers(block_of(v))) for v in values]
    assert R.keys(*R.numbers(block_of(*values))).tolist() == np.concatenate(apart).tolist()


def test_counts_cover_the_corpus(spark):
    rows = spark.createDataFrame([(i, f"some words {i % 7} hére") for i in range(500)], "doc_id long, text string").repartition(5)
    model, size = R.fit(rows)
    assert size == 500 * len("some words 0 hére") and abs(model.within[number("é")] - 1) < 1e-9
    assert R.fit(rows.limit(0)) == (None, 0)


def test_bands(spark):
    rnd = random.Random(3)
    words = [a + b for a in ("har", "sto", "li", "walk", "ri", "wa", "thea", "an") for b in ("bour", "ne", "ght", "ing", "ver", "ter", "tre", "d")]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(60, 120))), "en") for i in range(200)]
    noise = "".join(rnd.choice("qzxvkj%$ ") for _ in range(900))
    rows += [(900, noise, "en"), (901, " ".join("ab" for _ in range(30)), "en"), (902, rows[0][1], None)]
    got = {r["doc_id"]: r for r in R.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["kept"] for i in range(200)) and got[902]["kept"]
    assert not got[900]["kept"] and not got[900]["base_failed"] and got[901]["base_failed"] and not got[901]["kept"]
    for i, text, _ in rows:
        assert {k: got[i][k] for k in plain(text)} == plain(text)


def test_clean_documents_are_kept(docs, labels):
    got = R.rules(docs).join(labels, "doc_id").where("quality = 1 AND NOT base_failed")
    assert got.where("kept").count() >= 0.99 * got.count()


def test_odd_rows(odd, none):
    got = R.rules(odd).collect()
    assert len(got) == odd.count() and R.rules(none).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == 0 and by[1]["perplexity"] is None and by[1]["base_failed"] and not by[1]["kept"]
    assert by[5]["n_words"] == 60_000 and by[5]["base_failed"] and by[6]["word_chars"] == 5000
