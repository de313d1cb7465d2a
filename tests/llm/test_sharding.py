"""The curve visits every cell once, step by step; shards are even and gapless."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from korvid.llm import sharding as S


def test_curve():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = S.hilbert_index([grid[:, k] for k in range(dims)], bits)
        assert sorted(index.tolist()) == list(range(len(grid)))
        path = grid[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def check(rows, shards, total):
    sizes = [0] * shards
    slots = {}
    for r in rows:
        sizes[r["shard"]] += 1
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sum(sizes) == total and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards(docs):
    got = S.shard(docs)
    rows = got.collect()
    check(rows, 40, docs.count())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in ordered] == sorted(r["curve"] for r in rows)
    assert sorted(map(tuple, S.shard(docs.repartition(9)).select("doc_id", "shard", "slot").collect())) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows)


def test_files_can_be_pruned(docs):
    of = S.shard(docs).join(docs.select("doc_id", "lang"), "doc_id")
    touched = of.groupBy("lang").agg(F.countDistinct("shard").alias("n"), (F.count("*") / 25).alias("least"))
    assert all(r["n"] <= 2 * r["least"] + 6 for r in touched.collect())


def test_odd_rows(spark, odd, none):
    for n in (1, 5, 40):
        check(S.shard(odd, n).collect(), n, odd.count())
    by = {r["doc_id"]: r for r in S.shard(odd).collect()}
    assert (by[1]["size"], by[1]["text_crc32"]) == (16, 0) == (by[2]["size"], by[2]["text_crc32"])
    assert S.shard(none).count() == 0
    same = spark.range(1000).select("id", F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source")).withColumnRenamed("id", "doc_id")
    check(S.shard(same, 7).collect(), 7, 1000)


def test_files(spark, odd, docs, tmp_path):
    for name, table in (("odd", odd), ("docs", docs)):
        S.write_shards(table, f"file://{tmp_path}/{name}", 5)
        back = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert sorted(map(repr, back.select(table.columns).collect())) == sorted(map(repr, table.collect()))
        sizes = [r["count"] for r in back.groupBy("_shard").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_levels_follow_the_order_of_values(spark):
    """Few values, as many as levels, and many more: one rule."""
    top = (1 << S.BITS) - 1
    for n in (1, 3, 127, 128, 5000):
        names = sorted(f"{(k * 7919) % 100_003:06d}é" for k in range(n))
        df = spark.createDataFrame([(k, "t", v, "s") for k, v in enumerate([*names, *names[:5], None])], "doc_id long, text string, lang string, source string")
        got = df.select("lang", S._levels(df, "lang").alias("l")).collect()
        want = {v: 1 + k * top // n for k, v in enumerate(names)} | {None: 0}
        assert all(r["l"] == want[r["lang"]] for r in got)
        if n == 5000:
            check(S.shard(df).collect(), 40, df.count())


def test_files_can_be_pruned_by_each_dimension(spark):
    rnd = np.random.default_rng(3)
    rows = [(k, "x" * int(2 ** rnd.uniform(4, 15)), f"l{rnd.integers(8)}", f"s{rnd.integers(4500):05d}") for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    of = S.shard(df, 64).join(df.select("doc_id", "lang", F.substring("source", 1, 3).alias("part")), "doc_id")
    for by, groups in (("lang", 8), ("part", 5), (F.floor(F.log2("size") / 2), 6)):
        touched = [r["n"] for r in of.groupBy(by).agg(F.countDistinct("shard").alias("n")).collect()]
        assert np.mean(touched) < 0.75 * 64, (groups, touched)
