import hashlib
import re

import pytest

from lumarium.llm import decontaminate as D

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").encode().lower())


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - 9, 1 if w else 0)):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = set()
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[key]
        out.add((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


COLS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_brute_force(spark, sf):
    d = f"/root/testdata/{sf}"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    got = {tuple(r) for r in D.op7_suffix_decontamination(spark, d).select(*COLS).collect()}
    assert got == brute(docs, items)
    assert 0 < sum(r[5] for r in got) < len(got)


def test_edges_blocks_and_columns(spark):
    passage = " ".join(f"q{i}" for i in range(25))
    items = [(1, passage), (2, "Two Words"), (3, None), (4, "..."), (5, passage), (None, "one two three four five six seven eight nine ten eleven")]
    docs = [(1, None), (2, ""), (3, "x " * 30_000 + passage.upper() + " y"), (4, "two words, two words"), (5, "two"), (6, passage[:20]), (7, "ONE two three four five six seven eight nine, ten"), (7, "words two")]
    df = spark.createDataFrame([(d, t, "r", "f") for d, t in docs], "doc_id long, text string, row string, found string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [("null" if i is None else i, t) for i, t in items]
    for size in (D.BLOCK_BYTES, 100):
        found = D.search_benchmark(df, bench, block_bytes=size).select("row.doc_id", "found.*").collect()
        got = {(r.doc_id, r.n_words, sum(r.ends) - sum(r.starts), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r.starts)) for r in found}
        assert got == brute(docs, named)
        assert next(r.longest for r in found if r.doc_id == 3) == (25, 30_000, "1", 0)
        assert next(r.longest for r in found if r.doc_id == 1) is None
    kept = D.decontaminated(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6, 7]
    assert D.decontaminated(df, bench.limit(0)).count() == len(docs)
    assert D.search_benchmark(df.limit(0), bench).count() == 0
