import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lumarium.llm import common as C


def test_components_of_random_links(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5), (7, None)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    df = spark.createDataFrame(links, "a long, b long")
    assert {tuple(r) for r in C.components(df).collect()} == {(x, root(x)) for x in up}
    assert C.components(df.limit(0)).count() == 0


def test_words_and_hashes_of_slices():
    texts = ["The cat", None, "", "the  CAT sat", "é the"]
    column = pa.array(["skip", *texts])[1:]
    raw, offs = C.utf8(column)
    h, row = C.word_hashes(raw, offs, C.is_space_split())
    assert row.tolist() == [0, 0, 3, 3, 3, 4, 4]
    assert h[0] == h[2] == h[6] and h[1] == h[3] and len(set(h.tolist())) == 4
    parts = [(lo, hi) for lo, hi, _, _ in C.text_chunks(column, 8)]
    assert parts[0][0] == 0 and parts[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_neighbours_across_batches(spark):
    rng = random.Random(3)
    keys = [rng.randrange(4000) for _ in range(3000)] + [9999] * 5000
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(tuple(r) for r in C.neighbours(df, "k").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert got == sorted((k, i) for i, k in enumerate(keys) if keys.count(k) > 1)


def test_sketch_counts_everything(spark):
    df = spark.createDataFrame([(f"w{i % 97} " * (i % 5),) for i in range(500)], "text string").repartition(3)
    sketch = C.count_sketch(df, lambda b: (C.word_hashes(raw, offs, C.is_space_split())[0] for _, _, raw, offs in C.text_chunks(b.column(0))))
    assert sketch.sum() == sum(i % 5 for i in range(500)) and len(sketch) == 1 << C.SKETCH_BITS


def test_prefix_sort_depth():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 3, 500)
    keys = np.zeros(501, np.uint64)
    for j in range(4):
        keys[: 500 - j] |= symbols[j:].astype(np.uint64) << np.uint64(48 - 16 * j)
    order = C.prefix_sort(np.arange(500), keys, 4, 3)
    seen = [tuple(symbols[i : i + 12]) + (-1,) * (i + 12 - 500) for i in order if i < 480]
    assert seen == sorted(seen)


def test_sample_is_of_distinct_texts_with_a_share_for_each_label(spark):
    texts = [(f"text {i}", "en") for i in range(300)] + [(f"texte {i}", "fr") for i in range(200)] + [("ein Text", "de")]
    df = spark.createDataFrame(texts, "text string, label string")
    # the text that comes first in the order of the sample stands in 5000 rows, with two labels
    first = df.orderBy(F.pmod(F.xxhash64("text"), F.lit(1 << 30))).first().text
    df = df.union(spark.createDataFrame([(first, "en")] * 5000 + [(first, "fr")], df.schema)).repartition(5)
    for n in (90, 3000):
        got = [tuple(r) for r in C.bounded_sample(df, n, F.col("text"), F.col("label")).collect()]
        assert len(got) == len(set(got)) == min(n, df.distinct().count())
        labels = [y for _, y in got]
        assert labels.count("de") == 1 and (n > 90 or abs(labels.count("en") - labels.count("fr")) <= 1)
    assert len({r.value for r in C.bounded_sample(df, 100, F.col("text")).collect()}) == 100
    assert C.bounded_sample(df.limit(0), 5, F.col("text")).count() == 0
    assert C.shares([5, 100, 1], 30) == [5, 24, 1] and sum(C.shares([9] * 7, 10)) == 10


def test_every_label_sends_a_text(spark):
    """Two hundred labels whose texts are all longer than their share of the bytes: each has its shortest one in."""
    rows = [(f"l{i}", f"{i} {k} " + "word " * (6000 + 10 * k)) for i in range(200) for k in range(2)]
    df = spark.createDataFrame(rows, "label string, text string").repartition(4)
    got = C.bounded_sample(df, 3000, F.col("text"), F.col("label"), 2 << 20).collect()
    assert sorted(r.label for r in got) == sorted(f"l{i}" for i in range(200)) and all(r.value.split()[1] == "0" for r in got)
    few = C.bounded_sample(df, 3000, F.col("text"), F.col("label"), 400 * 40_000).collect()
    assert len(few) == 400
