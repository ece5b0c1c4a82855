"""Cuts, forms and restoring against plain Python on code points."""

import random
import re
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from lumarium.llm import fim


def sha(x):
    return sha256(x.encode()).hexdigest()


def plain(doc_id, text, unit="word", fim_rate=90, spm_rate=20):
    """(n, form, prefix_chars, middle_chars, output)."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text) if unit == "word" else list(text)
    n, h = len(units), sha(f"1:{doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if doc_id is None or not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim_rate:
        return n, "plain", None, None, text
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if h4 % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(seed, k):
    rng = random.Random(seed)
    parts = ["word", "A", "é", "日本", "🙂", " ", "\n", "12", "<", "<P", ">", "S>", "M", "́", "zz<S>", "\x00"]
    return ["".join(rng.choices(parts, k=rng.randrange(60))) for _ in range(k)] + ["", "a", "é", "🙂🙂", "<P>x", "abc" * 30]


def test_index_both_ways():
    for text in texts(1, 60):
        raw = np.frombuffer(text.encode(), np.uint8)
        index = fim.SparseIndex(raw)
        at = np.cumsum([0, *(len(c.encode()) for c in text)])
        assert index.to_byte(np.arange(len(text) + 1)).tolist() == at.tolist()
        assert index.to_point(at).tolist() == list(range(len(text) + 1))
        assert len(index.at) == sum(len(c.encode()) > 1 for c in text)


@pytest.mark.parametrize("page", [1, 3, 64, 1 << 20])
def test_units_by_pages(monkeypatch, page):
    monkeypatch.setattr(fim, "PAGE", page)
    batch = texts(2, 25)
    raw = np.frombuffer("".join(batch).encode(), np.uint8)
    offs = np.cumsum([0, *(len(t.encode()) for t in batch)])
    units = fim.Units(raw, offs)
    found = [re.findall("[A-Za-z]+|[^A-Za-z]", t) for t in batch]
    assert units.count.tolist() == [len(u) for u in found]
    for i, u in enumerate(found):
        at = offs[i] + np.cumsum([0, *(len(x.encode()) for x in u)])
        assert [units.start(int(units.before[i]) + k) for k in range(len(u))] == at[:-1].tolist()


@pytest.mark.parametrize("unit", ["word", "char"])
def test_against_plain_python(spark, unit):
    rows = [(i, t) for i, t in enumerate(texts(3, 250))] + [(900, None), (None, "null id"), (5, "same"), (5, "same"), (901, "ab é" * 400_000), (902, "🙂" * 300_000 + "word"), (903, "x" * 1_500_000)]
    df = spark.createDataFrame([(*r, 1, "f", "o") for r in rows], "doc_id long, text string, n int, form string, output string").repartition(4)
    out = fim.fill_in_middle(df, unit=unit, keep=["doc_id", "form", "n"])
    out = out.withColumn("back", fim.restored(out.output, out.form))
    got = sorted([(r.row.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, sha(r.output), sha(r.back)) for r in out.collect()], key=str)
    assert got == sorted([(d, *plain(d, t, unit)[:4], sha(plain(d, t, unit)[4]), sha(t or "")) for d, t in rows], key=str)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_other_rates_and_sentinels(spark):
    rows = [(i, f"some words {i}\n<P> a.b") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = ("[.p]", "[.s]", "[.m]")
    out = fim.fill_in_middle(df, fim_rate=100, spm_rate=50, sentinels=marks)
    got = out.withColumn("back", fim.restored(out.output, out.form, marks)).collect()
    assert {r.form for r in got} == {"psm", "spm"} and all(r.back == r.row.text for r in got)
    assert all(r.output.startswith("[.p]" if r.form == "psm" else "[.s]") for r in got)


def test_query_against_sql_and_plain_python(spark):
    d = "/root/testdata/sf0.001"
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    got = sorted(tuple(r) for r in fim.op13_fill_in_middle(spark, d).select(*names).collect())
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert got == sorted((i, *plain(i, t)[:4], sha(plain(i, t)[4]), sha(t or "")) for i, t in rows)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    assert sorted(c.execute(fim.ORACLE).fetchall()) == got
