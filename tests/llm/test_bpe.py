"""Ids against the tiktoken library, exact round trips, odd rows."""

import hashlib
import random

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from korvid.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_ranks(PATH), P.PATTERN)


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(max_size=60), max_size=8))
def test_any_text(reference, codec, texts):
    got = codec.encode(texts)
    assert got == [" ".join(map(str, reference.encode_ordinary(t))) for t in texts]
    assert [codec.decode(g).decode() for g in got] == texts


def test_repetitive_words(reference, codec):
    rnd = random.Random(1)
    texts = ["a" * n for n in range(1, 70)] + ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 60))) for _ in range(300)] + ["é" * 50, " " * 33, "\n" * 17 + "x"]
    assert codec.encode(texts) == [" ".join(map(str, reference.encode_ordinary(t))) for t in texts]


def test_a_pair_of_lower_rank_comes_up_late():
    """Merging b and c makes a pair that should have come first had it been there: then places don't merge together."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"cb": 258, b"abcbc": 259}
    codec = bpe.Codec(ranks, r"\S+|\s+")
    other = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abc") for _ in range(n)) for n in range(1, 60)]
    assert codec.encode(texts) == [" ".join(map(str, other.encode_ordinary(t))) for t in texts]


def test_chunks_and_parts(spark, docs, reference, monkeypatch):
    """Many chunks and parts give the same ids; a word that many chunks have is replayed once a part."""
    some = docs.select("doc_id", "text").limit(300).unionAll(docs.select("doc_id", "text").limit(20))
    want = sorted((r["doc_id"], " ".join(map(str, reference.encode_ordinary(r["text"])))) for r in some.collect())
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(bpe, "PART_BYTES", 50_000)
    got = bpe.encode(some.repartition(3), PATH, P.PATTERN)
    assert sorted((r["doc_id"], r["ids"]) for r in got.collect()) == want


def test_a_pool_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "POOL_BYTES", 10)
    codec = bpe.Codec(bpe.load_ranks(PATH), P.PATTERN)
    words = [b"harbour", b"lighthouse keeper", b"a", "\u00e9t\u00e9".encode(), b"of"]
    apart = [codec.replay_word(w) for w in words]
    assert [list(map(int, x)) for x in (np.frombuffer(codec.learn(words)[w], np.uint32) for w in words)] == apart


def test_other_columns_come_along(odd, docs):
    got = bpe.encode(odd.withColumn("ids", odd["lang"]), PATH, P.PATTERN, keep=True)
    assert got.columns == [*odd.columns, "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert sorted(map(repr, got.select(odd.columns).collect())) == sorted(map(repr, odd.collect()))
    assert got.where("ids RLIKE '[a-z]'").count() == 0


def test_documents(spark, docs, reference):
    for r in bpe.encode(docs, PATH, P.PATTERN).join(docs.select("doc_id", "text"), "doc_id").limit(100).collect():
        ids = reference.encode_ordinary(r["text"])
        assert r["ids"] == " ".join(map(str, ids)) and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(r["ids"].encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_odd_rows(odd, none):
    got = bpe.encode(odd, PATH, P.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    empty = hashlib.sha256(b"").hexdigest()
    for r in got.collect():
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
        if not texts[r["doc_id"]]:
            assert (r["n_tokens"], r["ids_sha256"], r["ids"]) == (0, empty, "")
    back = {r["doc_id"]: r["text"] for r in bpe.decode(got, PATH, P.PATTERN).collect()}
    assert back == {k: v or "" for k, v in texts.items()}
    assert got.count() == odd.count() and bpe.encode(none, PATH, P.PATTERN).count() == 0
