"""Chunks against a rolling hash byte by byte; repeated passages; odd rows."""

import random

import numpy as np
import pyarrow as pa

from korvid.llm import blocks as B
from korvid.llm import substring as S


def plain_ends(text: bytes):
    """One byte at a time, the hash rolling over the whole text."""
    ends, start, h = [], 0, 0
    for i, b in enumerate(text):
        h = ((h << 1) + int(S._GEAR[b])) & 0xFFFF
        after = text[i + 1] if i + 1 < len(text) else 0
        size = i + 1 - start
        if size >= S.MIN_CHUNK and h >> (16 - S.CUT_BITS) == 0 and after & 0xC0 != 0x80 or size == S.MAX_CHUNK:
            ends.append(i + 1)
            start = i + 1
    return ends + ([len(text)] if start < len(text) else [])


def random_text(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(1, 9))) for _ in range(n))


def test_chunks():
    rnd = random.Random(4)
    values = [random_text(rnd, n) for n in (0, 1, 7, 300, 4000)] + ["z" * 3000, "ab" * 900]
    for limit in (100, 1 << 20):
        k = 0
        for block in B.blocks(iter([pa.record_batch({"text": pa.array(values)})]), limit=limit):
            for i, ends in enumerate(S.chunk_ends(block)):
                assert [e - int(block.offs[i]) for e in ends] == plain_ends(values[k].encode())
                k += 1


def test_insertion_moves_few_chunks():
    rnd = random.Random(5)
    text = random_text(rnd, 2000)
    other = text[:3000] + "an insertion" + text[3000:]
    pieces = []
    for t in (text, other):
        data, ends = t.encode(), plain_ends(t.encode())
        pieces.append({data[a:b] for a, b in zip([0, *ends], ends)})
    assert len(pieces[0] - pieces[1]) <= 6


def test_repeated_passages(spark):
    rnd = random.Random(6)
    passage = random_text(rnd, 60)
    own = [random_text(rnd, 200) for _ in range(6)]
    rows = [(1, own[0] + " " + passage + " " + own[1]), (2, own[2] + " " + passage + " " + own[3]), (3, own[4]), (4, own[4]), (5, own[5])]
    got = {r["doc_id"]: r for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == rows[0][1] and got[3]["text"] == own[4] and got[5]["text"] == own[5] and got[5]["removed_bytes"] == 0
    assert got[2]["removed_bytes"] > len(passage.encode()) // 2 and got[2]["kept_by"] == [1]
    assert own[2][:500] in got[2]["text"] and own[3][-500:] in got[2]["text"] and passage not in got[2]["text"]
    assert got[4]["text"] == "" and got[4]["kept_by"] == [3] and got[4]["removed_bytes"] == len(own[4].encode())


def test_short_passages_are_found(spark):
    """Passages of little more than fifty words, one in each pair of documents."""
    rnd = random.Random(9)
    rows, n = [], 150
    for i in range(n):
        passage = random_text(rnd, 55)
        for k in (0, 1):
            rows.append((2 * i + k, " ".join([random_text(rnd, rnd.randint(20, 90)), passage, random_text(rnd, rnd.randint(20, 90))])))
    got = {r["doc_id"]: r for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[2 * i + 1]["removed_bytes"] > 0 and got[2 * i + 1]["kept_by"] == [2 * i] for i in range(n))
    assert found >= 0.96 * n and not any(got[2 * i]["removed_bytes"] for i in range(n))


def test_repetition_within_a_text_and_common_words(spark):
    rnd = random.Random(7)
    block, tail = random_text(rnd, 120), random_text(rnd, 50)
    rows = [(1, block + "\n" + block + "\n" + tail), (2, "of the and in on " + random_text(rnd, 80)), (3, "of the and in on " + random_text(rnd, 80))]
    got = {r["doc_id"]: r for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(block.encode()) / 2 < got[1]["removed_bytes"] <= len(block.encode()) + 1 and got[1]["text"].startswith(block)
    assert got[2]["removed_bytes"] == got[3]["removed_bytes"] == 0


def test_odd_rows(odd, none):
    got = S.dedup(odd).collect()
    assert len(got) == odd.count() and [f for f in S.dedup(odd).columns if f == "kept_by"] == ["kept_by"]
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["text"] is None and by[2][0]["n_chunks"] == 0 and by[None][0]["removed_bytes"] == 0
    assert len(by[7]) == 2 and all(r["text"] == "same text here and there again" for r in by[7]) and by[8][0]["n_dup_chunks"] == 0 < by[8][0]["n_chunks"]
    assert by[6][0]["text"].strip("é") == "" and by[5][0]["removed_bytes"] > 100_000 and by[7][0]["score"] == "s"
    assert S.dedup(none).count() == 0


def plain_dedup(rows, least=S.MIN_RUN):
    """(text, duplicate chunks, bytes, keepers) of each row, chunk by chunk."""
    cut = []
    for i, text in rows:
        raw = (text or "").encode()
        ends = plain_ends(raw)
        cut.append((i, [raw[a:b] for a, b in zip([0, *ends], ends)]))
    first = {}
    for i, chunks in cut:
        for c in chunks if i is not None else ():
            first[c] = min(first.get(c, i), i)
    out = []
    for (i, chunks), (_, text) in zip(cut, rows):
        kept, seen, run, n, gone, by = b"", set(), [], 0, 0, set()

        def close():
            nonlocal kept, n, gone
            size = sum(map(len, run))
            if size >= least:
                n, gone = n + len(run), gone + size
                by.update(first[c] for c in run if i is not None and first[c] != i)
            else:
                kept += b"".join(run)
            run.clear()

        for c in chunks:
            if c in seen or i is not None and first[c] != i:
                run.append(c)
            else:
                close()
                kept += c
            seen.add(c)
        close()
        out.append((i, None if text is None else kept.decode(), n, gone, tuple(sorted(by))))
    return out


def test_against_plain_chunks(spark):
    """Repeated ids with equal and with different texts among them."""
    rnd = random.Random(11)
    parts = [random_text(rnd, 40) for _ in range(25)]
    rows = []
    for k in range(60):
        rows.append((rnd.choice([None, *range(20)]), " ".join(rnd.choice(parts) if rnd.random() < 0.5 else random_text(rnd, 30) for _ in range(rnd.randint(0, 5)))))
    a, c = random_text(rnd, 60), random_text(rnd, 70)
    rows += [(101, a), (102, a + random_text(rnd, 50)), (102, c), (102, c), (103, None), (103, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["text"], r["n_dup_chunks"], r["removed_bytes"], tuple(r["kept_by"] or ())) for r in S.dedup(frame).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_dedup(rows)))
    assert sum(r[1] == c for r in got) == 2


def test_text_ids(spark):
    rnd = random.Random(12)
    a = random_text(rnd, 80)
    got = {r["doc_id"]: r for r in S.dedup(spark.createDataFrame([("x", a), ("y", a)], "doc_id string, text string")).collect()}
    assert got["x"]["text"] == a and got["y"]["text"] == "" and got["y"]["kept_by"] == ["x"]


def test_gear_is_a_rolling_hash():
    data = np.frombuffer(random_text(random.Random(8), 50).encode(), np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(S._GEAR[b])) & 0xFFFF
        want.append(h)
    assert S.gear(data).tolist() == want
