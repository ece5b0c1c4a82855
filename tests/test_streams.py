"""Pacing rules, and tables of changes whose batches may be seen twice."""

import random

import pandas as pd
from pyspark.sql import functions as F

from lumarium.operators import graph, maintain, scratch
from lumarium.plans import q_enrich
from lumarium.streaming import streams as T


def frame(rows):
    return pd.DataFrame(rows, columns=["id", "arrival", "gap", "throttled", "retry_after"])


def test_pacing():
    rows = frame([(1, 0.0, None, False, None), (2, 0.1, None, False, None), (3, 1.0, None, True, 4.0), (4, 1.5, None, False, None), (5, 2.0, None, False, None), (6, 9.0, None, False, None), (7, 9.1, 2.0, False, None), (8, 9.2, None, True, 1000.0), (9, 9.3, None, False, None)])
    out, last, cool = T.pace_rows(rows, None, None)
    assert out == [(1, 0.0, 0.0, False), (2, 0.1, 0.5, False), (4, 1.5, 5.0, False), (5, 2.0, 5.0, False), (6, 9.0, 9.0, False), (7, 9.1, 9.1, False), (9, 9.3, None, True)]
    assert cool == 309.2


REQUEST = "host string, id long, arrival double, gap double, throttled boolean, retry_after double"


def test_batch_and_stream_agree(spark):
    """A stream of several micro-batches, out of order within its delay, a host with most requests, ties and a null host."""
    rng = random.Random(2)
    rows = [("hot" if i % 4 else f"h{i % 3}", i, (i // 2) * 0.7 + rng.random() * 3, None if i % 5 else 2.0, i % 23 == 5, float(i % 9) if i % 2 else None) for i in range(400)]
    df = spark.createDataFrame(rows, REQUEST).withColumn("ts", F.timestamp_micros((F.col("arrival") * 1_000_000).cast("long")))
    got = q_enrich.drained(T.pace_stream(q_enrich.in_order(df.orderBy("id"), "ts", 7), "5 seconds"), conf=T.TIMED_STATE).collect()
    want = T.pace_batch(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len({r.host for r in want}) == 4
    assert any(r.refused for r in want)


def test_batch_of_a_host_in_many_parts(spark):
    """Arrow batches of a few rows, a hot host, a null host and one of a single row, against one pass over each."""
    rng = random.Random(7)
    rows = [(rng.choice(["hot"] * 8 + [None, "b"]), i, rng.random() * 90, None, i % 17 == 3, float(i % 9)) for i in range(300)] + [("one", 900, 1.0, None, False, None)]
    df = spark.createDataFrame(rows, REQUEST)
    want = []
    for host in {r[0] for r in rows}:
        out, _, _ = T.pace_rows(frame([r[1:] for r in rows if r[0] == host]), None, None)
        want += [(host, *r) for r in out]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [tuple(r) for r in T.pace_batch(df).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert T.pace_batch(df.limit(0)).count() == 0


def changes(spark, rows, batch, table):
    T.view_sink(table)(spark.createDataFrame(rows, maintain.VIEWS), batch)


def test_changes_are_idempotent(spark):
    table = graph.scratch(spark)
    for batch, rows in ((0, [("x", 2, 5, 7), ("y", 1, 0, 0)]), (0, [("x", 2, 5, 7), ("y", 1, 0, 0)]), (1, [("x", 3, 5, 9)]), (1, [("x", 3, 5, 9)])):
        changes(spark, rows, batch, table)
    assert sorted(tuple(r) for r in maintain.read_views(spark, table).collect()) == [("x", 3, 5, 9), ("y", 1, 0, 0)]
    assert maintain.read_views(spark, graph.scratch(spark)).count() == 0
    # a batch writes what it changes, however much there is
    assert spark.read.parquet(f"{table}/batch=1").count() == 1


def test_compaction_at_any_point(spark, monkeypatch):
    table = graph.scratch(spark)
    for batch in range(5):
        rows = spark.createDataFrame([(f"u{batch}", "f", batch, batch, 10), ("u", "f", batch, batch, batch)], maintain.CACHE)
        maintain.write_changes(rows.withColumn("gone", F.col("url") == "u1"), table, batch)
    want = sorted(map(tuple, maintain.read_cache(spark, table).collect()))
    assert [r[0] for r in want] == ["u", "u0", "u2", "u3", "u4"]
    # it breaks off after it deleted two of the four batches that go
    real, left = scratch.delete, [2]

    def broken(spark_, path):
        if not left[0]:
            raise RuntimeError
        left[0] -= 1
        real(spark_, path)

    monkeypatch.setattr(maintain, "delete", broken)
    try:
        maintain.compact(spark, table, maintain.CACHE, "url", 5)
    except RuntimeError:
        pass
    assert sorted(map(tuple, maintain.read_cache(spark, table).collect())) == want
    monkeypatch.setattr(maintain, "delete", real)
    for _ in range(2):
        maintain.compact(spark, table, maintain.CACHE, "url", 5)
        assert sorted(map(tuple, maintain.read_cache(spark, table).collect())) == want
    assert maintain._batches(spark, table) == [4]


def test_cache_stream_with_a_cap(spark):
    """Eviction in the sink: the least recently used urls go, come back when they are used again, and a batch may run twice."""
    table = graph.scratch(spark)
    sink = T.cache_sink(table, cap=100)
    batches = [[("a", "f", 1, 1, 60), ("b", "f", 2, 2, 30)], [("c", "f", 3, 3, 40)], [("a", "f", 4, 4, 20)]]
    for k, rows in enumerate(batches):
        for _ in range(2):
            sink(spark.createDataFrame(rows, maintain.CACHE), k)
    assert sorted((r.url, r.bytes) for r in maintain.read_cache(spark, table).collect()) == [("a", 20), ("b", 30), ("c", 40)]
    assert sorted(r.url for r in maintain.read_changes(spark, table, maintain.CACHE, "url", 2).collect()) == ["b", "c"]


def test_streams_of_changes(spark):
    accesses = [(f"u{i % 7}", "f", (i * 37) % 100, i) for i in range(100)]
    df = spark.createDataFrame(accesses, "url string, file string, ts long, bytes long").repartition(5)
    table = graph.scratch(spark)
    q_enrich.drained(T.cache_stream(q_enrich.staged(df)), T.cache_sink(table), "update")
    want = {}
    for u, _, t, b in sorted(accesses, key=lambda r: r[2]):
        want[u] = (t, b)
    assert {r.url: (r.used, r.bytes) for r in maintain.read_cache(spark, table).collect()} == want
    table = graph.scratch(spark)
    q_enrich.drained(T.view_stream(q_enrich.staged(df.select(F.col("url").alias("path"), "ts"))), T.view_sink(table), "update")
    times = {u: [r[2] for r in accesses if r[0] == u] for u in want}
    assert {r.path: (r["count"], r.first, r.last) for r in maintain.read_views(spark, table).collect()} == {u: (len(t), min(x for x in t if x), max(t)) for u, t in times.items()}
