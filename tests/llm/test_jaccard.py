"""Links and components against all pairs, with families of copies larger than the small-group bound."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from korvid.llm import jaccard as J
from korvid.llm.queries import ORACLES

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            common = len(s & t)
            if s and 100 * common >= 80 * (len(s) + len(t) - common):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def check(spark, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    return got


def edited(rnd, words, n, vocabulary):
    w = list(words)
    for _ in range(n):
        k = rnd.randrange(len(w))
        w[k : k + 1] = rnd.choice([[], [rnd.choice(vocabulary)], [w[k], rnd.choice(vocabulary)]])
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_families(spark, seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    texts = []
    passage = rnd.choices(vocabulary, k=60)
    for size, copies, most in ((150, 60, 7), (400, 25, 16), (40, 30, 2), (9, 12, 1), (6, 8, 1)):
        base = rnd.choices(vocabulary, k=size)
        texts += [edited(rnd, base, rnd.randint(0, most), vocabulary) for _ in range(copies)]
    texts += [" ".join(rnd.choices(vocabulary, k=rnd.randint(20, 60)) + passage + rnd.choices(vocabulary, k=rnd.randint(5, 40))) for _ in range(60)]
    texts += [" ".join(passage + rnd.choices(vocabulary, k=rnd.randint(0, 20))) for _ in range(30)]
    texts += [" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 8))) for _ in range(30)] + ["a b c d e", "A B c d e", "a b c d e f", "x", "X", "", " \n"]
    texts += texts[:20]
    ids = rnd.sample(range(10_000), len(texts))
    got = check(spark, list(zip(ids, texts)))
    assert len({c for _, c in got.values()}) < len(got) - 100


def test_exact_threshold(spark):
    base = [f"w{i}" for i in range(22)]  # 18 shingles; with two words more 16 of 20 are shared, which is the threshold
    same = base[:20]
    check(spark, [(5, " ".join(base)), (3, " ".join(same)), (9, " ".join([*same, "x", "y", "z"]))])


def test_common_signatures_are_never_lost(spark, monkeypatch):
    """Even if almost every signature counts as common."""
    monkeypatch.setattr(J, "candidates", lambda table, small=2, f=J.candidates: f(table, small))
    rnd = random.Random(3)
    vocabulary = [f"v{i}" for i in range(300)]
    base = rnd.choices(vocabulary, k=120)
    rows = [(i, edited(rnd, base, rnd.randint(0, 9), vocabulary)) for i in range(70)]
    check(spark, rows)


def test_bound_of_broadcast_ids(spark, monkeypatch):
    monkeypatch.setattr(J, "MAX_IDS", 1)
    check(spark, [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j"), (3, "a b c d e f g h i j k"), (4, "q r s t u")])


def test_every_size_sends_what_its_partners_need():
    bands = J.Bands()
    for size in [*range(1, 400), 1000, 5000, 20_000]:
        own = {band for band, _, _ in bands.plan(size)}
        for other in {size, max(1, -(-size * 4 // 5)), bands.most(size)}:
            if 100 * min(size, other) >= 80 * max(size, other):
                low, high = sorted((size, other))
                shared = own & {band for band, _, _ in bands.plan(other)}
                assert any(bands.low[b] <= high < bands.low[b + 1] for b in shared)
                assert bands.spare(low) >= bands.may_drop(high)


def test_similar_sets_share_the_signatures_that_are_counted_on():
    """One more than the smaller set has to spare, unless both fell back; then one of the prefixes."""
    rnd = random.Random(5)
    bands = J.Bands()
    kept = 0
    for _ in range(1500):
        size = rnd.choice([1, 2, 3, 5, 8, 13, 25, 60, 150, 400])
        both = rnd.sample(range(1 << 40), rnd.randint(-(-size * 8 // 10), size))
        own = [rnd.sample(range(1 << 41, 1 << 42), rnd.randint(0, size // 4)) for _ in range(2)]
        a, b = (np.unique(np.array(both + x, dtype=np.uint64)) for x in own)
        if 100 * len(both) < 80 * (len(a) + len(b) - len(both)):
            continue
        kept += 1
        (x, free_x), (y, free_y) = (J.signatures(s, bands) for s in (a, b))
        common = len(set(np.concatenate(x).tolist()) & set(np.concatenate(y).tolist()))
        assert common >= (1 if free_x and free_y else bands.spare(min(len(a), len(b))) + 1)
    assert kept > 400


def test_repeated_ids_with_different_texts(spark):
    """Such an id links with what any of its texts links with."""
    rnd = random.Random(6)
    one, two = (" ".join(rnd.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(2))
    rows = [(7, one), (7, two), (9, one + " x"), (3, two + " y z"), (5, "nothing like it at all"), (7, two)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 58, 3), (5, 1, 5), (7, 56, 3), (7, 56, 3), (7, 56, 3), (9, 57, 3)]


def test_text_ids(spark):
    rows = [("b", "one two three four five six"), ("a", "one two three four five six"), ("c", "q r s t u"), (None, "q r s t u"), ("d", None)]
    got = sorted((r["doc_id"] or "", r["n_shingles"], r["component_id"]) for r in J.join(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == [("", 1, None), ("a", 2, "a"), ("b", 2, "a"), ("c", 1, "c"), ("d", 0, "d")]


def test_prefix_pairs_lose_no_link_and_skip_common_passages(spark):
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(10**9)}"
    passage = [word() for _ in range(104)]
    rows = [(i, " ".join(passage + [word() for _ in range(20)])) for i in range(300)]  # 100 shingles shared, about 20 of their own
    for i in range(300, 340):
        base = [word() for _ in range(rnd.randint(10, 130))]
        rows += [(i, " ".join(base)), (i + 1000, " ".join(base + [word() for _ in range(rnd.randint(0, len(base) // 6))]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select(F.col("doc_id").alias("b"), F.col("doc_id").alias("_c"))
    got = {tuple(r) for r in J.prefix_pairs(docs, labels).collect()}
    sets = {i: shingles(t) for i, t in rows}
    want = {(a, b) for a in sets for b in (a + 1000,) if b in sets and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert want <= got and len(want) > 20 and not any(b < 300 for _, b in got)


def test_odd_rows(odd, none):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.join(odd).collect()]
    by = {}
    for i, n, c in got:
        by.setdefault(i, []).append((n, c))
    assert by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[3] == [(0, 3)] and by[4] == [(1, 4)] and by[5] == [(1, 5)]
    assert by[7] == [(2, 7)] * 2 and by[8] == [(2, 7)] and by[None][0][1] is None and len(got) == odd.count()
    assert J.join(none).count() == 0


def test_against_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = sorted(con.sql(f"SELECT doc_id, n_shingles, component_id FROM ({ORACLES['op2_ngram_jaccard_join']})").fetchall())
    assert sorted(tuple(r) for r in J.join(spark.read.parquet(path)).collect()) == want


def test_more_links_join_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(110)]
    frame = lambda some: spark.createDataFrame(some, "a long, b long")
    for first in (0, 40, 80):
        want = {tuple(r) for r in J.components(frame(links)).collect()}
        assert {tuple(r) for r in J.merged(J.components(frame(links[:first])), frame(links[first:])).collect()} == want


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 50), (70, 100), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in J.components(links).collect()}
    star = spark.createDataFrame([(5000, i) for i in range(1000)] + [(i, 7000) for i in range(2000, 3000)] + [(7000, 5000), (8000, 8001)], "a long, b long").repartition(7)
    hub = {r["node"]: r["component"] for r in J.components(star).collect()}
    assert len(hub) == 2002 and all(c == (8000 if n > 7500 else 0) for n, c in hub.items())
    assert all(got[i] == 1 for i in range(2, 41)) and got[100] == got[70] == 50 and J.components(links.limit(0)).count() == 0
