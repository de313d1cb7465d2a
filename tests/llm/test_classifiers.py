"""Toxicity, quality and language: accuracy on documents that weren't learned from, and odd rows."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard

from korvid.llm import blocks as B
from korvid.llm import langid, quality, toxicity

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def big(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")


def held_out(df, table, label, predicted):
    df.toPandas().to_parquet(table)
    q = f"SELECT avg(({predicted} = {label})::INT), count(*) FROM '{table}' JOIN '{BIG}/{'documents' if label == 'lang' else 'labels'}.parquet' USING (doc_id) WHERE held_out"
    return duckdb.sql(q).fetchall()[0]


def test_accuracy_on_held_out_rows(big, tmp_path):
    docs, labels = big
    quality_got = held_out(quality.quality(docs, labels), f"{tmp_path}/q.parquet", "quality", "predicted")
    toxic_got = held_out(toxicity.toxicity(docs, labels), f"{tmp_path}/t.parquet", "toxic", "predicted")
    # some languages have a dozen toxic rows here; where they have more, as in larger tables, it is 0.99
    lang_got = held_out(langid.language(docs), f"{tmp_path}/l.parquet", "lang", "lang_pred")
    assert quality_got[0] > 0.98 and quality_got[1] > 500
    assert toxic_got[0] > 0.93 and toxic_got[1] > 500
    assert lang_got[0] > 0.98 and lang_got[1] > 3000


def sample(rnd, n, bad):
    words = ["".join(rnd.choice("abcdeilnorst") for _ in range(rnd.randint(2, 6))) for _ in range(200)]
    out = []
    for k in range(n):
        w = rnd.choices(words, k=60)
        if k % 2:
            for _ in range(4):
                w[rnd.randrange(60)] = rnd.choice(bad)
        out.append((" ".join(w), k % 2))
    return out


def scores(model, texts):
    batch = pa.record_batch({"text": pa.array(texts)})
    return np.concatenate([model.scores(b) for b in B.blocks(iter([batch]))])


def test_unseen_misspellings_share_subwords():
    rnd = random.Random(2)
    model = toxicity.fit(sample(rnd, 300, ["wurzzelgump", "krikkelfax"]))
    clean = sample(rnd, 2, ["x"])[0][0]
    bad = clean.split()
    bad[10:14] = ["wurzelgump", "Wurzzelgumps", "krikelfax", "krikkelfaxx"]  # none of them was learned
    a, b, empty = scores(model, [clean, " ".join(bad), ""])
    assert a < 0.3 and b > 0.7 and 0 <= empty <= 1


def test_documents_dont_depend_on_their_neighbours():
    model = toxicity.fit(sample(random.Random(3), 100, ["badword"]))
    texts = [t for t, _ in sample(random.Random(4), 30, ["badword"])] + [""]
    together = scores(model, texts)
    assert np.allclose(together, [scores(model, [t])[0] for t in texts])


def test_compression_model():
    rnd = random.Random(5)
    good = [" ".join(rnd.choices(["river", "stone", "light", "harbour", "walking"], k=50)) for _ in range(40)]
    bad = [" ".join(rnd.choices(["BUY!!", "$$$", "<<click>>", "***"], k=50)) for _ in range(40)]
    model = quality.train([(t, 1) for t in good[:30]] + [(t, 0) for t in bad[:30]])
    assert min(model.score(t.encode()) for t in good[30:]) > 0.7 > 0.3 > max(model.score(t.encode()) for t in bad[30:])
    assert model.difference(b"") == model.neutral and 0 <= model.score(b"") <= 1
    assert 0 < quality.train([("x", 1)]).score(b"abc") < 1 and 0 < quality.train([]).score(b"") < 1


def test_dictionaries_learn_from_whole_texts():
    rnd = random.Random(8)
    noise = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n)).encode()
    end = b"the same last sentence closes each of these documents"
    assert end[:30] in quality._dictionary([noise(2000) + end for _ in range(300)])


def plain_difference(good, bad, neutral, text):
    """Compressed sizes by a one-shot compressor for each piece, with nothing precomputed."""
    def size(content, piece):
        d = zstandard.ZstdCompressionDict(content)
        return len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(piece))

    pieces = [text[i : i + quality.PIECE] for i in range(0, len(text), quality.PIECE)]
    return (sum(size(bad, p) - size(good, p) for p in pieces) + quality.PRIOR_BYTES * neutral) / (len(text) + quality.PRIOR_BYTES)


def test_the_difference_alone_decides(spark, big):
    """Scores come from nothing but the difference, rise with it, and tell held-out rows apart."""
    docs, labels = big
    model = quality.fit(docs, labels)
    assert len(model.curve) == 2 and model.curve[1] > 0
    known = labels.where("quality IS NOT NULL").select("doc_id", "quality")
    rows = [r for r in quality.score(docs, model).where("held_out").join(known, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect() if r["text"]]
    for r in rows[::40]:
        d = plain_difference(model.good, model.bad, model.neutral, r["text"].encode())
        assert abs(r["score"] - 1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * 50 * d)))) < 1e-9
    y, p = np.array([r["quality"] for r in rows]), np.array([r["score"] for r in rows])
    rank = p.argsort().argsort() + 1
    ones = int(y.sum())
    auc = (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))
    assert auc > 0.99 and ((p >= 0.5) == y).mean() > 0.98


MASK = (1 << 64) - 1


def plain_bucket(gram, bits):
    """The bucket of a byte n-gram, in whole numbers of Python."""
    h = (sum(int(B.BYTE_CODE[b]) * int(B.PLACE[k]) for k, b in enumerate(gram)) + len(gram)) & MASK
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & MASK
    return (h ^ (h >> 31)) >> (64 - bits)


def plain_grams(text, orders, letters_only=False):
    """Byte n-grams within words and their bounding blanks."""
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    if letters_only:
        data = bytes(b if b >= 0x80 or 97 <= b <= 122 else 32 for b in data)
    words = re.split(rb"[\x20\x09-\x0d]", data)
    for w in words:
        w = b" " + w + b" "
        for n in orders:
            yield from (w[i : i + n] for i in range(len(w) - n + 1) if len(w) > 2)


TEXTS = ["The harbour lies badword north.", "été naïve 42 x", "a", "", "  ", "Mixed CASE words\nand lines", "中文 字"]


def test_toxicity_against_a_plain_scorer():
    model = toxicity.fit(sample(random.Random(3), 100, ["badword"]))
    got = scores(model, TEXTS)
    for text, g in zip(TEXTS, got):
        buckets = [plain_bucket(x, model.bits) for x in plain_grams(text, model.orders)]
        z = model.bias + model.scale * sum(float(model.logit[b]) for b in buckets) / (sum(float(model.weight[b]) for b in buckets) + model.prior)
        assert abs(g - 1 / (1 + np.exp(-z))) < 1e-6


def test_language_against_a_plain_scorer():
    rows = [("the cat and the dog with this", "en"), ("the house of the king", "en"), ("le chat et le chien avec la", "fr"), ("la maison de la reine", "fr"), ("日本 語文", "ja")]
    model = langid.train(rows * 3)
    names, score, _ = model.predict(next(B.blocks(iter([pa.record_batch({"text": pa.array(TEXTS)})]))))
    for text, name, s in zip(TEXTS, names, score):
        if not any(c.isalpha() for c in text):
            assert name == "und" and s == 0
            continue
        v = np.zeros(1 << langid.BITS)
        for x in plain_grams(text, langid.ORDERS, letters_only=True):
            v[plain_bucket(x, langid.BITS)] += 1
        v = np.sqrt(v) * model.idf
        near = model.centroids @ (v / max(np.linalg.norm(v), 1e-9))
        assert abs(near.max() - s) < 1e-4 and near[[k for k, n in enumerate(model.langs) if n == name]].max() >= near.max() - 1e-4


def test_langid_rejects_what_is_far_from_all_centroids():
    rows = [("the cat and the dog with this", "en"), ("the house of the king and that", "en"), ("le chat et le chien avec la", "fr"), ("la maison de la reine et les", "fr")]
    model = langid.train(rows * 5)
    batch = pa.record_batch({"text": pa.array(["the dog of the house", "le chien de la maison", "zzzqqq xxyyxx", "12 34", ""])})
    names, score, far = model.predict(next(B.blocks(iter([batch]))))
    assert names[:2] == ["en", "fr"] and names[3:] == ["und", "und"] and score[3] == 0 and far[2] and names[2] in ("en", "fr")
    assert langid.train([]).predict(next(B.blocks(iter([batch]))))[0] == ["und"] * 5


def test_text_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", f"text number {i} " * 5, "en" if i % 2 else "fr") for i in range(40)], "doc_id string, text string, lang string")
    labels = spark.createDataFrame([(f"d{i}", i % 2, (i // 2) % 2) for i in range(40)], "doc_id string, quality int, toxic int")
    for got in (quality.quality(docs, labels), toxicity.toxicity(docs, labels), langid.language(docs)):
        assert got.count() == 40 and got.schema["doc_id"].dataType.simpleString() == "string"
    assert len(B.labelled_sample(docs, labels, "toxic", 100, 3, 1)) > 10
    assert B.labelled_sample(docs, labels.withColumn("doc_id", labels["doc_id"].substr(2, 9).cast("long")), "toxic", 100, 3, 1) == []


@pytest.mark.parametrize("which", ["toxicity", "quality", "langid"])
def test_odd_rows(spark, odd, none, which):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (7, None, None), (None, 1, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    run = {"toxicity": lambda d, l: toxicity.toxicity(d, l), "quality": lambda d, l: quality.quality(d, l), "langid": lambda d, l: langid.language(d)}[which]
    for known in (labels, labels.limit(0)):
        got = run(odd, known).collect()
        assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
        sevens = [tuple(r) for r in got if r["doc_id"] == 7]
        assert len(sevens) == 2 and sevens[0] == sevens[1]
    assert run(none, labels).count() == 0
    if which == "langid":
        assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 9)} == dict.fromkeys((1, 2, 3, 9), "und")
    else:
        assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert quality.accepted(odd, quality.train([]), 0.4).columns == odd.columns


def test_more_than_300_languages(spark):
    rnd = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(320):
        words = ["".join(rnd.choices(letters, k=6)) for _ in range(12)]
        rows += [(6 * k + i, " ".join(rnd.choices(words, k=30)), f"l{k}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.language(docs).collect()}
    assert len(got) == len(rows) and sum(got[d] == lang for d, _, lang in rows) >= 0.98 * len(rows)
