"""Each stage takes effect, keeps what is clean, and returns the columns of documents."""

import corpus_pipeline as P
from korvid.llm import blocks, decontamination, jaccard, quality

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    model = quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    names = []
    for k, (name, stage) in enumerate(P.STAGES):
        names.append(name)
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = blocks.cut(stage(spark, docs, SMALL))
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before)
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
        if k == 0:
            assert set(after) == {i for i in before if scores[i] >= P.KEEP_SCORE} and len(after) < len(before)
        if k == 1:
            frame = spark.createDataFrame([(i, r["text"]) for i, r in before.items()], "doc_id long, text string")
            kept = {r["doc_id"] for r in jaccard.join(frame).collect() if r["component_id"] == r["doc_id"]}
            assert set(after) == kept and len(after) < len(before)
        if k == 2:
            assert set(after) == set(before) and any(after[i]["text"] != before[i]["text"] for i in after)
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        if k == 3:
            frame = spark.createDataFrame([(i, r["text"]) for i, r in before.items()], "doc_id long, text string")
            hit = {r["doc_id"] for r in decontamination.matches(frame, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
            assert set(after) == set(before) - hit
        if k == 4:
            assert set(after) == set(before) and all(r["n_tokens"] == len(r["ids"].split()) and r["text"] == before[i]["text"] for i, r in after.items())
            assert docs.columns[: len(columns)] == columns
    assert len(names) == 5 and P.run(spark, SMALL).count() == len(after)


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0
    assert P.STAGES[-1][1](spark, docs, SMALL).count() == 0


def test_odd_rows(spark, odd):
    """Nulls, repeated rows, repeated ids with different texts, and columns named like results pass every stage whole."""
    more = spark.createDataFrame([(7, "another text under an id that is there", "en", "a", 38, "s", "p", "k", "c")], odd.schema)
    docs = odd.unionByName(more)
    for k, (_, stage) in enumerate(P.STAGES):
        before = docs.collect()
        docs = blocks.cut(stage(spark, docs, SMALL))
        after = docs.collect()
        assert docs.columns[: len(odd.columns)] == odd.columns
        assert all(r["kept_by"] == "k" and r["component_id"] == "c" and r["score"] == "s" for r in after)
        if k == 1:
            assert sum(r["doc_id"] == 7 for r in after) == len({r["text"] for r in before if r["doc_id"] == 7})
            assert all(r["doc_id"] != 8 for r in after) or all(r["doc_id"] != 7 for r in before)
        else:
            assert {r["text"] for r in before if r["text"] is None} == {r["text"] for r in after if r["text"] is None}
