import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumarium.llm import common as C
from lumarium.llm import token_files as F


def want(rows):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    out, start = set(), 0
    for d, text in sorted((d, x or "") for d, x in rows):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        out.add((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=900), st.integers(1, 5))
def test_round_trip(values, docs):
    ids = np.array(values, np.uint32)
    counts = np.array([len(x) for x in np.array_split(ids, docs)])
    blob = F.pack(np.arange(docs) - 2, counts, ids)
    a, b, c = F.unpack(blob)
    assert a.tolist() == (np.arange(docs) - 2).tolist() and b.tolist() == counts.tolist() and c.tolist() == values
    assert [x for k in range(-(-len(ids) // 256)) for x in F.read_block(blob, k).tolist()] == values


def test_blocks_are_packed():
    ids = np.random.default_rng(0).integers(0, 4000, 100_000).astype(np.uint32)
    assert len(F.pack(np.array([1]), np.array([len(ids)]), ids)) < 1.7 * len(ids)


def test_against_library_on_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in F.op5_token_files(spark, d).collect()} == want(rows)


def test_small_store_and_pieces():
    rng = random.Random(5)
    parts = ["a", "B", "é", "É", "e\u0301", "×", "'s", "'", "’", "1", "²", " ", "\n", "\u3000", "\u0301", "\x1c", ".", ",", "<|endoftext|>", "<|", "|>", "don't", "日", "İ", "Σ", "ᄀ", "ᅡ", "\u0000"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(4000)]
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    enc, got = F.PieceEncoder(P.path("word_bpe_49k.json"), capacity=300), []
    for _, _, raw, offs in C.text_chunks(pa.array(texts), 3000):
        ids, counts = enc.texts(raw, offs)
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert enc.n <= 300 + len(raw)
    assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_edges(spark, monkeypatch):
    rng = random.Random(2)
    parts = ["The", " ", "\n", "É", "é", "ſ", "don't", "12", "!?", " ", "\x1c", " ", "日本", "🙂", "<|endoftext|>", "<|startoftext|> x", "İ", "ΑΣ "]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(60)))) for i in range(120)] + [(500, None), (501, ""), (-7, "word " * 70_000)]
    df = spark.createDataFrame([(t, d, 3) for d, t in rows], "text string, doc_id long, part int").repartition(3)
    path = C.scratch_dir(spark)
    F.write_token_files(df, path)
    got = {(r.id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in F.read_token_files(spark, path).collect()}
    assert got == want(rows)
    # repeated ids: the same files however rows are dealt
    twice = df.unionByName(spark.createDataFrame([(f"other {k}", 7, 3) for k in range(40)] + [("same", 7, 3)] * 3, df.schema))
    out = []
    for n in (1, 5):
        path = C.scratch_dir(spark)
        F.write_token_files(twice.repartition(n), path)
        out.append(sorted(tuple(r) for r in F.read_token_files(spark, path).collect()))
    assert out[0] == out[1] and len(out[0]) == len(rows) + 43
    path = C.scratch_dir(spark)
    F.write_token_files(df.limit(0), path)
    assert F.read_token_files(spark, path).count() == 0
