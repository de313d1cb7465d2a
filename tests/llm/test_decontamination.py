"""Alignment against the plain recurrence; copies and edited copies are found, others not."""

import random

import numpy as np

from korvid.llm import decontamination as D


def plain(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = D.MATCH if a[i - 1] == b[j - 1] else D.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP)
    return int(h.max())


def test_alignment():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = (np.array([rnd.randint(0, 3) for _ in range(rnd.randint(1, 14))]) for _ in range(2))
        score, end = D.align(a, b)
        assert score == plain(a, b)
        assert plain(a, b[:end]) == score


def corpus(rnd, spark):
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=40)).capitalize() + ".") for i in range(20)]
    text = lambda n: rnd.choices(vocabulary, k=n)
    rows, want = [], {}
    for i in range(60):
        w = text(150)
        if i < 20:
            w[50:50] = items[i][1].split()
            want[i] = (i, 50)
        elif i < 40:  # edited: about a fifth of the words
            part = items[i - 20][1].lower().replace(".", ",").split()
            for k in rnd.sample(range(40), 4):
                part[k] = rnd.choice(vocabulary)
            for k in sorted(rnd.sample(range(30), 2)):
                del part[k]
            part.insert(20, "inserted")
            w[30:30] = part
            want[i] = (i - 20, 30)
        rows.append((i, " ".join(w)))
    rows.append((99, "\n".join([items[3][1].upper(), " ".join(text(20)), items[4][1]])))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), want


def test_copies(spark):
    docs, items, want = corpus(random.Random(2), spark)
    got = D.matches(docs, items).collect()
    found = {(r["doc_id"], r["item_id"]): r for r in got}
    assert len(found) == len(got) and set(found) == {(d, i) for d, (i, _) in want.items()} | {(99, 3), (99, 4)}
    for d, (i, at) in want.items():
        r = found[d, i]
        assert abs(r["first_word"] - at) <= 4 and abs(r["end_word"] - at - 40) <= 5 and (r["score"] == 1 if d < 20 else 0.5 <= r["score"] < 1)
    left = {r["doc_id"] for r in D.clean(docs, items).collect()}
    assert left == set(range(40, 60))


def test_a_passage_in_most_documents_is_still_found(spark):
    rnd = random.Random(3)
    item = " ".join("".join(rnd.choice("abcd") for _ in range(5)) for _ in range(30))
    rows = [(i, f"{item} and {i} more words {rnd.random()}") for i in range(200)] + [(900 + i, f"nothing of it {rnd.random()}") for i in range(50)]
    got = D.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(200))


def test_evenly_spaced_edits(spark):
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(15, 59)))) for i in range(40)]
    rows = []
    for step in (4, 5):
        for i, text in items:
            w = [rnd.choice(vocabulary) if k % step == step - 1 else x for k, x in enumerate(text.split())]
            rows.append((100 * step + i, " ".join([*rnd.choices(vocabulary, k=40), *w, *rnd.choices(vocabulary, k=40)])))
    rows += [(1000 + i, text) for i, text in items[:20]]  # exact copies elsewhere
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in D.matches(docs, bench).collect()}
    assert found == {(d, d % 100) for d, _ in rows if d < 1000} | {(1000 + i, i) for i in range(20)}


def test_a_long_passage_of_a_long_item(spark):
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    item = rnd.choices(vocabulary, k=300)
    around = lambda w: " ".join([*rnd.choices(vocabulary, k=50), *w, *rnd.choices(vocabulary, k=50)])
    rows = [(1, around(item[90:210])), (2, around(item[40:70])), (3, around(item[40:60])), (4, around([]))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = {r["doc_id"]: r for r in D.matches(docs, bench).collect()}
    assert set(found) == {1, 2} and 0.4 <= found[1]["score"] < 0.42
    assert abs(found[1]["first_word"] - 50) <= 3 and abs(found[1]["end_word"] - 170) <= 3
    assert {r["doc_id"] for r in D.clean(docs, bench).collect()} == {3, 4}


def test_recall_on_short_edited_items(spark):
    """All pairs of documents and items aligned, against those that seeds lead to."""
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    for words in (12, 30):
        items = [(i, " ".join(rnd.choices(vocabulary, k=words))) for i in range(150)]
        for share in (0.1, 0.2, 0.3):
            rows = []
            for i, text in items:
                w = text.split()
                for k in rnd.sample(range(words), round(share * words)):
                    w[k] = rnd.choice(vocabulary)
                rows.append((i, " ".join([*rnd.choices(vocabulary, k=20), *w, *rnd.choices(vocabulary, k=20)])))
            docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
            ids = {w: k for k, w in enumerate(vocabulary)}
            number = lambda t: np.array([ids[w] for w in t.split()])
            want = {(d, i) for (d, text) in rows for (i, item) in items if (d == i or rnd.random() < 0.02) and D.align(number(item), number(text))[0] >= D.MATCH * words * D.THRESHOLD}
            found = {(r["doc_id"], r["item_id"]) for r in D.matches(docs, bench).collect()}
            assert len(want) > 100 and len(found & want) >= 0.95 * len(want), (words, share, len(found & want), len(want))


def test_items_in_blocks(spark, monkeypatch):
    docs, items, _ = corpus(random.Random(4), spark)
    whole = sorted(map(tuple, D.matches(docs, items).select("doc_id", "item_id").collect()))
    monkeypatch.setattr(D.item_blocks, "__defaults__", (600,))
    assert len(list(D.item_blocks(items))) > 3
    assert sorted(map(tuple, D.matches(docs, items).select("doc_id", "item_id").collect())) == whole
    assert D.clean(docs, items).count() == 20


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (4, "same text here and there again"), (4, "same text here and there again"), (None, "row without an id, long enough for")], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in D.matches(odd, items).collect())
    assert got == [(0, 0), (7, 4), (7, 4), (8, 4)]
    short = spark.createDataFrame([(1, "Word!"), (2, "and again"), (3, "there again"), (4, "...")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["score"]) for r in D.matches(odd, short).collect()) == [(4, 1, 1.0), (7, 3, 1.0), (7, 3, 1.0), (8, 3, 1.0)]
    assert D.matches(none, items).count() == 0 and D.matches(odd, items.limit(0)).count() == 0
    left = D.clean(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count() - 4 and D.clean(none, items).count() == 0
