import time

import pytest
from pyspark.sql import functions as F

from korvid.streaming import files
from korvid.streaming.results import Cancel, Interrupted, QueryManager, ResultStream, run_interruptibly


def test_stream_and_batches(spark):
    df = spark.range(12)
    stream = ResultStream(df, "id", F.col("id") % 2 == 0)
    assert stream.size() == 6 and [r["id"] for r in stream] == [0, 2, 4, 6, 8, 10] and stream.done and stream.position == 6
    assert [len(b) for b in ResultStream(df, "id").batches(5)] == [5, 5, 2]


def test_stop(spark):
    stream = ResultStream(spark.range(10), "id")
    rows = iter(stream)
    assert next(rows)["id"] == 0
    stream.stop()
    with pytest.raises(Interrupted):
        next(rows)
    assert not stream.done


def test_interrupt(spark):
    def slow():
        return spark.range(1000, numPartitions=4).select(F.expr("java_method('java.lang.Thread', 'sleep', cast(50 as bigint))")).collect()

    began = time.monotonic()
    with pytest.raises(Interrupted):
        run_interruptibly(spark, slow, Cancel(0.5))
    assert time.monotonic() - began < 8
    assert run_interruptibly(spark, lambda: spark.range(5).count()) == 5
    with pytest.raises(ZeroDivisionError):
        run_interruptibly(spark, lambda: 1 // 0)


def test_manager():
    m = QueryManager()
    a, b = m.register("a"), m.register("b")
    assert m.names() == ["a", "b"] and m.cancel("a") and not m.cancel("x") and a.cancelled and not b.cancelled
    assert m.clean() == 1 and m.cancel_all() == 1 and m.clean() == 1
    with pytest.raises(KeyError):
        m.register("c"), m.register("c")


def test_windows_and_distinct(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    raw = spark.read.parquet(f"{data}/events.parquet")
    stream = files.read(spark, data, raw, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = files.drain(files.windowed_counts(stream, "ts", "event_type", "1 day", "1 hour"))
    want = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").count()
    closed = {(r["window_start"], r["event_type"]): r["n"] for r in got.collect()}
    full = {(r["w"]["start"], r["event_type"]): r["count"] for r in want.collect()}
    assert len(closed) >= len(full) * 0.8 and all(full[k] == n for k, n in closed.items())
    keys = files.drain(files.distinct_keys(stream.select("user_id", "ts"), "user_id", "ts", "60 days"))
    assert keys.count() == events.select("user_id").distinct().count()
