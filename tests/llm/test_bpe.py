import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lumarium.llm import bpe, common


def library():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def sha(x):
    return hashlib.sha256(x).hexdigest()


def want(rows):
    t, out = library(), set()
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.add((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode())))
    return out


def test_against_library_on_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in bpe.op4_bpe_chunks(spark, d).collect()} == want(rows)


@pytest.mark.parametrize("bits", [2, 5, 11])
def test_repair_at_any_cut(monkeypatch, bits):
    monkeypatch.setattr(bpe, "MASK_BITS", bits)
    rng = random.Random(bits)
    parts = ["the", " ", "  ", "\n", "é", "ß ", "don't", "'s", "12", "3456", "!?", "\t", "日本語", "🙂", " a b", "A", "x" * 40, "<|endoftext|>", " ", "́", "<|end", " word"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(80))) for _ in range(150)]
    texts += texts[:20] + ["", "word " * 4000, "z" * 5000, " " * 700, "\n" * 300 + "a"]
    enc = bpe.Encoder(bpe.tokenizer_path("byte_bpe_50k.tiktoken"), P.PATTERN, bpe.SPECIAL, store_bytes=5000)
    import pyarrow as pa

    raw, offs = common.utf8(pa.array(texts))
    t = library()
    for text, ids in zip(texts, enc.texts(raw, offs), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids
        assert enc.decode(ids) == t.decode(ids.tolist(), skip_special_tokens=False)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "same text of some length " * 300), (4, "same text of some length " * 300), (5, "ab" * 40_000), (6, "x <|endoftext|> y<|endoftext|>")]
    df = spark.createDataFrame([(d, t, "i", 7) for d, t in rows], "doc_id long, text string, ids string, n_tokens int")
    got = {(r.row.doc_id, r.n_tokens, sha(r.ids), sha(r.decoded.encode())) for r in bpe.bpe_encode_decode(df).collect()}
    assert got == want(rows)
    assert bpe.bpe_encode_decode(df.limit(0)).count() == 0


@pytest.mark.parametrize("run", [" ", "\n", "\t", " \n", "\u3000 ", "\xa0"])
def test_long_white_space(run):
    """Three million characters of white space, at the start, inside, before a special string and at the end of a text."""
    enc, t = bpe.Encoder(bpe.tokenizer_path("byte_bpe_50k.tiktoken"), P.PATTERN, bpe.SPECIAL), library()
    import pyarrow as pa

    long, short = run * ((3_000_000 if run.isascii() else 100_000) // len(run)), run * 5000
    texts = [short, "a word" + long + "b next", short + "x", "x 'll" + short + "'ll 5" + short + "é", "y" + short + "<|endoftext|>" + short + " z", short + "\n!" + short]
    raw, offs = common.utf8(pa.array(texts))
    for text, ids in zip(texts, enc.texts(raw, offs), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert enc.whole(text.encode()).tolist() == want


def test_long_white_space_repeated_rows_and_null_ids(spark):
    rows = [(1, "x" + " " * 1_200_000 + "y")] * 2 + [(None, "same"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.row.doc_id, r.n_tokens, sha(r.ids), sha(r.decoded.encode())) for r in bpe.bpe_encode_decode(df).collect()), key=str)
    assert len(got) == 4 and set(got) == want(rows)
