"""The kernels of blocks against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from korvid.llm import blocks as B

WORD = re.compile("[^\x20\x09-\x0d]+")


def texts(n=60, seed=1):
    rnd = random.Random(seed)
    alphabet = "aab B\n\t \r\x0b\x0cé中🙂.,#"
    return ["", None, " ", "a"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(n)]


def cut(values, limit):
    batch = pa.record_batch({"text": pa.array(values, pa.string())})
    return list(B.blocks(iter([batch]), limit=limit))


def test_blocks_keep_all_rows():
    values = texts()
    for limit in (1, 50, 10_000):
        got = [b.text(i).decode() for b in cut(values, limit) for i in range(len(b))]
        assert got == [v or "" for v in values]
    sliced = pa.record_batch({"text": pa.array(values, pa.string())}).slice(5, 20)
    assert [b.text(i).decode() for b in B.blocks(iter([sliced])) for i in range(len(b))] == [v or "" for v in values[5:25]]


def test_words_and_windows():
    values = texts()
    seen = {}
    for limit in (1, 70, 100_000):
        k = 0
        for block in cut(values, limit):
            words = B.Words(block)
            hashes = words.hashes()
            window, at = words.windows(hashes, 3)
            for i in range(len(block)):
                want = WORD.findall(values[k] or "")
                a, b = words.at[i], words.at[i + 1]
                assert [block.data[s:e].tobytes().decode() for s, e in zip(words.start[a:b], words.end[a:b])] == want
                for w, h in zip(want, hashes[a:b].tolist()):
                    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
                    assert seen.setdefault(folded, h) == h  # the same in every block
                inside = (at >= a) & (at < b)
                assert inside.sum() == max(0, len(want) - 2)
                grams = [tuple(x.lower() for x in want[j : j + 3]) for j in range(len(want) - 2)]
                for g, h in zip(grams, window[inside].tolist()):
                    assert seen.setdefault(g, h) == h
                k += 1
    assert len(set(seen.values())) == len(seen)


def test_subwords():
    block = cut(["Ab c", "", "Ab"], 1000)[0]
    data, offs = B.padded(block)
    assert data.tobytes() == b" ab c  ab "
    found = {n: (ids, at) for n, (ids, at) in zip((2, 3), B.subwords(data, (2, 3), 16))}
    grams = sorted(data[a : a + 3].tobytes() for a in found[3][1])
    assert grams == sorted([b" ab", b"ab ", b" c ", b" ab", b"ab "])
    assert found[3][0][0] == found[3][0][list(found[3][1]).index(6)]
    assert B.sums_by_document(np.ones(len(found[3][1])), found[3][1], offs).tolist() == [3.0, 0.0, 2.0]


def test_logistic():
    x = np.stack([np.ones(200), np.linspace(-3, 3, 200)], 1)
    y = (x[:, 1] > 0.5).astype(float)
    w = B.logistic(x, y)
    assert (((x @ w) > 0) == (y == 1)).mean() > 0.97


def test_sample_is_bounded_and_leaves_the_held_out_fold_alone(docs, labels):
    import zlib

    got = B.labelled_sample(docs, labels, "toxic", 40, 3, 1, 0.25)
    assert sum(y for _, y in got) == 10 and len(got) == 40
    texts_of = {r["text"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    assert all(t in texts_of for t, _ in got)
    assert got == B.labelled_sample(docs.repartition(7), labels.repartition(3), "toxic", 40, 3, 1, 0.25)
