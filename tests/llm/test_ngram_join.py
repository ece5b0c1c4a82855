from collections import defaultdict
from itertools import combinations

from lumarium.llm.ngram_join import ngram_jaccard_join

SPACE = b" \t\n\r\x0b\x0c"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    index, up = defaultdict(set), {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        for g in s:
            index[g].add(i)
    pairs = {p for ids in index.values() if len(ids) < 400 for p in combinations(sorted(ids), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {(i, len(sets[i]), root(i)) for i in sets}


def got(df):
    return {tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()}


def test_against_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    assert len({c for _, _, c in want}) < len(want) - 50
    assert got(ngram_jaccard_join(docs)) == want


def test_edge_cases_and_chains(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(10, None), (11, ""), (12, " \t\n"), (13, "One Two"), (14, "one  two"), (15, "one two three"), (16, " ".join(base)), (17, " ".join(base).upper()), (30, "x " * 50_000), (31, "x\n" * 50_000)]
    # a chain in which only neighbours are near
    rows += [(20 + k, " ".join(base[: 60 - 4 * k] + [f"v{j}" for j in range(4 * k)])) for k in range(9)]
    df = spark.createDataFrame([(t, i, "x", i) for i, t in rows], "text string, doc_id long, id string, token long")
    assert got(ngram_jaccard_join(df)) == brute(rows)
    assert got(ngram_jaccard_join(df.limit(0))) == set()


def test_repeated_rows_shared_and_null_ids(spark):
    """Equal rows, unequal rows of one id, null ids, and a table of nothing but copies."""
    a, b, c = ("one two three four five six seven eight " + x for x in ("nine ten", "nine ten", "other words here that differ much from those"))
    rows = [(5, a), (5, a), (7, b), (7, c), (9, c), (None, a), (3, "quite another text of some words"), (2, None), (2, None)]
    out = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n, m = len(shingle_set(a)), len(shingle_set(c))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == sorted([(5, n, 5)] * 2 + [(7, n, 5), (7, m, 7), (9, m, 7), (3, 2, 3), (2, 0, 2), (2, 0, 2)])
    copies = ngram_jaccard_join(spark.createDataFrame([(i, a) for i in range(40, 0, -1)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in copies} == {(i, 1) for i in range(1, 41)}
