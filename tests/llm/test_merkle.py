"""Layout, blocks and proofs against a plain recursive tree."""

import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from lumarium.llm import merkle as M


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_way(levels, i):
    """Siblings from a leaf to the root."""
    out = []
    for level in levels[:-1]:
        first = i - i % 3
        out += [h for k, h in enumerate(level[first : first + 3]) if first + k != i]
        i //= 3
    return out


def plain_fold(levels, i, h):
    for level in levels[:-1]:
        first = i - i % 3
        h = H(*(h if first + k == i else x for k, x in enumerate(level[first : first + 3])))
        i //= 3
    return h


def want(rows):
    """{doc_id: result} of (doc_id, source, lang, n_chars, text)."""

    def leaf(r):
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    groups = {}
    for r in rows:
        groups.setdefault("" if r[1] is None else " " + r[1], []).append(r)
    trees, subs = {}, []
    for g in sorted(groups, key=lambda g: g.encode()):
        groups[g].sort(key=lambda r: r[0])
        trees[g] = plain_tree([leaf(r) for r in groups[g]])
        subs.append(trees[g][-1][0])
    top = plain_tree(subs)
    out = {}
    for k, g in enumerate(sorted(groups, key=lambda g: g.encode())):
        for i, r in enumerate(groups[g]):
            shown = r
            if zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                shown = (*r[:4], r[4].replace("\n", ""))
            folded = plain_fold(top, k, plain_fold(trees[g], i, leaf(shown)))
            out[r[0]] = (leaf(r), subs[k], top[-1][0], H(*plain_way(trees[g], i), *plain_way(top, k)), folded, folded == top[-1][0])
    return out


@pytest.mark.parametrize("levels", range(1, 8))
def test_layout_is_a_permutation_by_halves(levels):
    for m in {1, min(2, 3 ** (levels - 1)), 3 ** (levels - 1), max(1, 3 ** (levels - 1) - 1), max(1, 3 ** (levels - 1) // 2)}:
        count, places = m, []
        for level in range(levels):
            places += M.address(level, np.arange(count), m, levels).tolist()
            count = -(-count // 3)
        assert sorted(places) == list(range(M.size(m, levels)))
        assert int(M.address(levels - 1, np.arange(1), m, levels)[0]) == 0
    # the lower subtrees of a full block lie each in one stretch
    low, m = levels // 2, 3 ** (levels - 1)
    if low:
        tree = [M.address(level, np.arange(3 ** (low - 1 - level)), m, levels) for level in range(low)]
        at = np.sort(np.concatenate(tree))
        assert at.tolist() == list(range(int(at[0]), int(at[0]) + len(at)))


def test_block_against_plain_tree():
    for m in (1, 2, 3, 4, 9, 10, 26, 27, 80):
        leaves = np.frombuffer(b"".join(sha256(bytes([i])).digest() for i in range(m)), np.uint8).reshape(-1, 32)
        levels = M.levels_over(m)
        nodes = M.build(leaves, levels)
        tree = plain_tree([x.tobytes().hex() for x in leaves])
        assert nodes[0].tobytes().hex() == tree[-1][0]
        others, count, shape = M.siblings(nodes, m, levels)
        at = np.concatenate([[0], np.cumsum(count)])
        for i in range(m):
            assert [x.tobytes().hex() for x in others[at[i] : at[i + 1]]] == plain_way(tree, i)
            assert M.fold(leaves[i].tobytes(), others[at[i] : at[i + 1]].tobytes(), shape[i].tobytes()).hex() == tree[-1][0]


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, grp string, leaf int, item string, n int"


def result(spark, rows, height):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], COLUMNS).repartition(5)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    p, root = M.merkle_manifest(docs, shown={"text": tampered}, height=height)
    return [(r.id, (r.leaf.hex(), r.subroot.hex(), root.hex(), H(r.siblings.hex()), r.folded.hex(), r.verified)) for r in M.verified(p, root).collect()]


def test_rounds_of_blocks(spark):
    # one group of two thirds, groups of one, a null group, null and empty texts, a long one
    rows = [(i, "hot" if i % 3 else None if i % 6 else f"s{i}é", "l" if i % 2 else None, i if i % 5 else None, [None, "", "a\nb", "z" * 100_000 + "\n", "q"][i % 5]) for i in range(200)]
    assert dict(result(spark, rows, 2)) == want(rows)
    assert dict(result(spark, rows, 6)) == want(rows)


def test_repeated_rows_and_null_ids(spark):
    rows = [(7, "a", "x", 1, "t\n")] * 5 + [(None, "a", "x", 1, "u")] * 2
    got = result(spark, rows, 1)
    assert len(got) == 7 and len({r[1][2] for r in got}) == 1
    assert all(r[1][5] for r in got if r[0] is None)  # nothing is shown differently there
    leaves = [next(r[1][0] for r in got if r[0] is i) for i in (None,)] * 2 + [next(r[1][0] for r in got if r[0] == 7)] * 5
    tree = plain_tree(leaves)
    assert got[0][1][1] == tree[-1][0]
    assert sorted(r[1][3] for r in got) == sorted(H(*plain_way(tree, i)) for i in range(7))


def test_empty_and_single(spark):
    docs = spark.createDataFrame([], COLUMNS)
    p, root = M.merkle_manifest(docs)
    assert root is None and M.verified(p, root).count() == 0
    one = [(3, None, None, None, None)]
    assert dict(result(spark, one, 6)) == want(one)


def test_query_against_sql_and_plain_tree(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in M.op11_merkle_manifest(spark, d).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert got == want(rows)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    assert {r[0]: r[1:] for r in c.execute(M.ORACLE).fetchall()} == got
    assert 0 < sum(not r[5] for r in got.values()) < len(got)


def test_stored_manifest_and_what_differs_from_it(spark):
    from lumarium.llm import common

    rows = [(i, f"s{i % 3}" if i % 7 else None, "l", i, f"text {i}\n") for i in range(90)] + [(5, "s2", "l", 5, "text 5\n")] * 2
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], COLUMNS).repartition(4)
    path = common.scratch_dir(spark)
    p, root = M.merkle_manifest(docs, height=2, path=path)
    q, again = M.stored_proofs(spark, path, height=2)
    assert again == root and sorted(map(tuple, q.collect()), key=str) == sorted(map(tuple, p.collect()), key=str)
    assert all(r.verified for r in M.verified(q, root).collect())
    assert M.differing(docs, q).count() == 0
    now = [r for r in rows if r[0] != 8][:-1] + [(200, None, None, None, None)]
    now = [(*r[:4], "changed") if r[0] == 11 else r for r in now]
    got = M.differing(spark.createDataFrame([(*r, "x", 1, "y", 2) for r in now], COLUMNS), q).collect()
    assert sorted((r.id, r.change) for r in got) == [(5, "missing"), (8, "missing"), (11, "added"), (11, "missing"), (200, "added")]
