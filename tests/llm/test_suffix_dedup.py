import hashlib
import random

import numpy as np

from lumarium.llm import suffix_dedup as S


def brute(docs, w=50):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - w + 1):
            k = b[i : i + w]
            first[k] = min(first.get(k, d), d)
    out = set()
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - w + 1):
            if first[b[i : i + w]] < d:
                gone[i : i + w] = True
        gone = gone[:-1]
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.add((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_order_is_that_of_all_suffixes():
    rng = random.Random(3)
    for alphabet in (b"ab", b"abcdefgh", bytes(range(256))):
        for n in (1, 2, 7, 300):
            raw = bytes(rng.choice(alphabet) for _ in range(n)) + b"b" * rng.randrange(4)
            order = S.two_stage_order(np.frombuffer(raw, np.uint8), 400)
            assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    raw = np.frombuffer(b"banana banana", np.uint8)
    order = S.two_stage_order(raw)
    pairs = zip(order[:-1], order[1:], strict=True)
    common = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    assert S.common_prefixes(S.pack8(raw), order).tolist() == [0, *(common(bytes(raw)[i:], bytes(raw)[j:]) for i, j in pairs)]


def test_against_brute_force_on_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in S.op8_suffix_dedup(spark, d).collect()}
    assert got == brute(docs)
    assert sum(r[2] for r in got) > 0


def test_edges(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    p, q = word(120), word(49)
    docs = [(1, None), (2, ""), (3, word(30) + p + word(40)), (4, p), (5, p), (6, word(10) + p[:50] + word(3)), (7, q), (8, q), (9, p + p), (10, "z" * 3000), (11, "z" * 200), (12, word(5) + p[40:110] + q + word(20)), (13, word(40_000))]
    df = spark.createDataFrame([(t, d, 1, "o") for d, t in docs], "text string, doc_id long, doc int, owner string")
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans"]
    out = S.suffix_dedup(df)
    got = {(*[r[c] for c in cols], hashlib.sha256(r["kept"]).hexdigest()) for r in out.collect()}
    assert got == brute(docs)
    assert S.suffix_dedup(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, p), (1, p), (None, p), (2, p)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in S.suffix_dedup(twice).collect()) == [(0, 0), (1, 0), (1, 0), (2, len(p.encode()))]


def test_crowded_owners_are_split(spark):
    rng = random.Random(7)
    words = ["lorem ipsum", "dolor sit", "amet", "consectetur"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans"]
    expected = brute(docs)
    for crowd in (1, 20, S.CROWD):
        assert {(*[r[c] for c in cols], hashlib.sha256(r["kept"]).hexdigest()) for r in S.suffix_dedup(df, crowd=crowd).collect()} == expected


def test_pieces_that_repeat_in_the_smallest_document(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p, q = word(200), word(70)
    docs = [(1, word(9) + p[40:130] + word(9)), (2, p + word(60) + p + word(5) + p), (3, p), (4, "z" * 55 + "y"), (5, "x" + "z" * 400 + "y" + "z" * 300), (6, q + q), (7, q * 3 + word(30) + q)]
    words = ["lorem ipsum", "dolor sit", "amet", "consectetur"]
    for i in range(8, 60):
        line = " ".join(rng.choice(words) for _ in range(12))
        docs.append((i, " ".join(rng.choice([line, rng.choice(words)]) for _ in range(12))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans"]
    expected = brute(docs)
    for crowd in (1, 20, S.CROWD):
        assert {(*[r[c] for c in cols], hashlib.sha256(r["kept"]).hexdigest()) for r in S.suffix_dedup(df, crowd=crowd).collect()} == expected
