import hashlib
import time
from collections import defaultdict

from lumarium.llm.line_dedup import line_dedup, op9_line_dedup


def brute(rows, sites=5, chars=20):
    seen, where = defaultdict(set), defaultdict(list)
    for d, t, s in rows:
        for k, x in enumerate([] if t is None else t.split("\n")):
            x = x.strip(" \t\r")
            if len(x) >= chars:
                where[x].append((d, k))
                if s is not None:
                    seen[x].add(s)
    gone = {p for x, ps in where.items() if len(seen[x]) >= sites for p in ps if p != min(ps)}
    out = set()
    for d, t, s in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for k, x in enumerate(lines) if (d, k) not in gone]
        out.add((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_against_brute_force_on_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = {tuple(r) for r in op9_line_dedup(spark, d).collect()}
    assert got == brute(rows) and sum(r[2] for r in got) > 0


def test_edges(spark):
    a, b = "This very line stands everywhere.", "This one stands on four sites only."
    rows = [(i, f"own {i}\n  {a}\t\nshort\n{b if i < 4 else i}\n{a}", f"s{i}") for i in range(8)] + [(20, None, "s1"), (21, "", "s2"), (22, a, None), (23, "\n" * 2000 + a, "s3")]
    df = spark.createDataFrame([(d, t, s, 1, 2) for d, t, s in rows], "doc_id long, text string, source string, doc int, row int")
    out = line_dedup(df).select("row.doc_id", "n_lines", "n_removed", "kept").collect()
    assert {(r[0], r[1], r[2], hashlib.sha256((r[3] or "").encode()).hexdigest()) for r in out} == brute(rows)
    assert line_dedup(df.limit(0)).count() == 0
    # the other way, for more boilerplate lines than are sent to tasks
    assert sorted(line_dedup(df, broadcast_lines=0).collect(), key=str) == sorted(line_dedup(df).collect(), key=str)


def test_repeated_rows_null_ids_and_long_texts(spark):
    a = "This very line stands everywhere."
    rows = [(i, a, f"s{i}") for i in range(6)] + [(0, a, "s0"), (0, f"x\n{a}", "s9"), (None, a, "s7"), (3, f"{a}\n{a}", "s3"), (9, f"{a}\nown\n" * 60_000, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for bound in (0, 10):
        got = sorted((r[0] or -1, r[1] or "") for r in line_dedup(df, broadcast_lines=bound).select("row.doc_id", "kept").collect())
        assert got == sorted([(-1, a), (-1, a), (-1, a), (-1, "x"), *((i, "") for i in (1, 2, 3, 3, 4, 5)), (9, "own\n" * 60_000)])


def test_a_million_lines_take_seconds(spark):
    a = "This very line stands everywhere."
    text = f"{a}\nown line\n" * 500_000
    df = spark.createDataFrame([(i, a, f"s{i}") for i in range(6)] + [(9, text, "s1"), (9, a + "\nshort", "s1")], "doc_id long, text string, source string")
    for bound in (0, 10):
        began = time.time()
        got = sorted((r[1], r[2], len(r[3])) for r in line_dedup(df, keep=["doc_id"], broadcast_lines=bound).where("row.doc_id = 9").collect())
        assert got == [(2, 1, 5), (1_000_001, 500_000, 500_000 * 9)]
        assert time.time() - began < 60
