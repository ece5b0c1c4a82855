"""Plans, pieces and places against the rules of packing and a one-by-one best fit."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lumarium.llm import packing


def library():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def fill(plan, n):
    """{sequence: [(offset, length)]} of a plan for all pieces of a histogram."""
    out, seen = {}, {}
    for length, number, count, first, copies, base in plan.tolist():
        assert number == seen.get(length, 0)
        seen[length] = number + count
        for k in range(count):
            out.setdefault(first + k // copies, []).append((base + k % copies * length, length))
    assert seen == n
    return out


def one_by_one(lengths, capacity, weights):
    """Best fit of every piece on its own, by the smallest weighted norm of what is left."""
    cap, bins = np.array(capacity), []
    for length in sorted(lengths, reverse=True):
        need = packing.needs(length)
        fits = [(float((np.array(weights) * ((b - need) / cap) ** 2).sum()), i) for i, b in enumerate(bins) if (b >= need).all()]
        if fits:
            bins[min(fits)[1]] -= need
        else:
            bins.append(cap - need)
    return len(bins)


@pytest.mark.parametrize("capacity", [(64, 64, 64 * 64), (64, 3, 64 * 64), (64, 64, 1100), (64, 4, 1500)])
@pytest.mark.parametrize("rule", packing.RULES)
def test_plans_hold_every_capacity(capacity, rule):
    rng = random.Random(sum(capacity))
    longest = min(64, int(capacity[2] ** 0.5))
    for _ in range(10):
        histogram = {rng.randrange(1, longest + 1): rng.randrange(1, 200) for _ in range(rng.randrange(1, 30))}
        plan, n = packing.best_fit(histogram, capacity, *rule)
        got = fill(plan, histogram)
        assert sorted(got) == list(range(n))
        for parts in got.values():
            parts.sort()
            assert [o for o, _ in parts] == np.cumsum([0, *(x for _, x in parts[:-1])]).tolist()  # no gap
            assert (sum(packing.needs(x) for _, x in parts) <= np.array(capacity)).all()


def test_counted_best_fit_is_as_good_as_one_by_one():
    rng = random.Random(5)
    for _ in range(15):
        lengths = [min(64, max(1, int(rng.lognormvariate(2.5, 1)))) for _ in range(rng.randrange(1, 400))]
        histogram = {x: lengths.count(x) for x in set(lengths)}
        for capacity in ((64, 64, 4096), (64, 5, 4096)):
            _, n = packing.fewest(histogram, capacity)
            assert n <= one_by_one(lengths, capacity, (1.0, 0.0, 0.0)) + 1
            assert n >= -(-sum(lengths) // 64)


def check(rows, got, max_tokens, max_documents=None, max_cost=None):
    """Every document is there whole, in pieces of the right lengths, and every sequence keeps its capacities without gaps."""
    t = library()
    longest = min(max_tokens, int((max_cost or max_tokens**2) ** 0.5))
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 2] for d, x in rows}
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for d, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids[d]) // longest)))
        assert all(r.length == longest for r in parts[1:]) and all(r.length == len(r.ids) // 4 for r in parts)
        assert [r.start for r in parts] == np.cumsum([0, *(r.length for r in parts[:-1])]).tolist()
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in parts]).tolist() == ids[d]
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == np.cumsum([0, *(r.length for r in parts[:-1])]).tolist()
        assert sum(r.length for r in parts) <= max_tokens and len(parts) <= (max_documents or max_tokens)
        assert sum(r.length**2 for r in parts) <= (max_cost or max_tokens**2)
    return len(by_seq), sum(map(len, ids.values()))


def sample():
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["word", "é", "x1", "\n", "long-ish", "<|endoftext|>"], k=rng.randrange(120)))) for i in range(300)]
    return rows + [(1000, None), (1001, ""), (1002, "many words " * 5000), (1003, "z" * 63), (1004, " " * 20_000 + "x")]


@pytest.mark.parametrize("limits", [{}, {"max_documents": 3}, {"max_cost": 2000}, {"max_documents": 4, "max_cost": 3000}])
def test_pack(spark, limits):
    rows = sample()
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, piece int, sequence_id string").repartition(5)
    got = packing.pack(df, max_tokens=64, **limits).collect()
    n, total = check(rows, got, 64, **limits)
    if not limits:
        assert n <= -(-total // 64) * 1.02 + 1


def test_sequences_and_edges(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d"), (2, None)], "doc_id long, text string")
    packed = packing.pack(df, max_tokens=8)
    rows = packed.collect()
    assert len(rows) == 4 and sorted((r.id, r.length) for r in rows if r.id) == [(1, 4), (1, 4), (2, 1)]
    seqs = packing.sequences(packed).collect()
    assert sum(s.n_tokens for s in seqs) == sum(len(s.ids) // 4 for s in seqs) == 11 and len(seqs) == 2
    for s in seqs:
        assert len(s.ids) // 4 == s.n_tokens <= 8 and [d.offset for d in s.documents] == sorted(d.offset for d in s.documents)
    assert packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, max_documents=0)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    out = packing.op12_vector_best_fit(spark, d).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    t = library()
    got = {}
    for r in out:
        got[r.doc_id, r.piece] = r
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
            r = got.pop((i, k))
            assert (r.start, r.length, r.ids_crc32) == (a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes()))
    assert not got
    total = sum(r.length for r in out)
    assert len({r.sequence_id for r in out}) <= -(-total // 1024) * 1.02 + 1
