"""Settings with comments, the order of tasks, dither and expansion, against plain loops."""

import json
import random

import pytest

from lumarium.operators import graph, pixels
from lumarium.sources import catalogues as S

BODY = r"""{
  // a line comment
  "a": "https://example.com/x", /* block, "b": 0 */
  "b": [1, 2,],
  "c": "say \"hi\" // not a comment", "d": "\\", // gone
  "e": "é /* stays */ ,]", "f": {"x": 1 , } ,
}
/* open to the end"""


def test_comments_and_commas(spark):
    bodies = [BODY, "", '"open string // stays', "// only", "[1, /* kept */ ]", '"' + "a\\" * 100_000 + '" // x', "/*" + "*" * 200_000 + "/1"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(bodies)), "k int, body string").orderBy("k").select(S.strip_comments("body")).collect()]
    assert json.loads(got[0]) == {"a": "https://example.com/x", "b": [1, 2], "c": 'say "hi" // not a comment', "d": "\\", "e": "é /* stays */ ,]", "f": {"x": 1}}
    assert got[1:5] == ["", '"open string // stays', "", "[1,  ]"] and got[6] == "1"
    assert got[5] == bodies[5]  # the last quote is escaped: the string is open


def test_environment_and_tasks(spark):
    bodies = ['{"env": {"A": "x", "N": 5, "L": ["y"], "E": "", "Z": null}, // c\n "tasks": [{"label": "one", "dependsOn": "two"}, {"label": "two", "dependsOn": ["three", "one"],}, {"dependsOn": "x"}, {"label": "three"}, {"label": "four", "dependsOn": 7}]}', "{broken", "{}", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "path int, body string")
    assert sorted(map(tuple, S.environment(df).collect())) == [(0, "A", "x"), (0, "E", "")]
    got = {r.path: [(t.label, t.depends_on) for t in r.tasks] for r in S.tasks(df).collect()}
    assert got == {0: [("one", ["two"]), ("two", ["three", "one"]), ("three", []), ("four", [])], 1: [], 2: [], 3: []}


def plan(tasks, label, seen, out):
    if label not in seen:
        seen.add(label)
        for name, needs in tasks:
            if name == label:
                for n in needs:
                    plan(tasks, n, seen, out)
                out.append(label)
                break
    return out


def test_run_order(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [(k, [(f"t{rng.randrange(n)}", [f"t{rng.randrange(n + 1)}" for _ in range(rng.randrange(4))]) for _ in range(n)]) for k, n in enumerate([1, 2, 3, 5, 8, 13, 20, 20, 20])]
    rows += [(90, [("t0", ["t1"]), ("t1", ["t0"])]), (91, [("t0", ["t0", "t0"])]), (92, []), (93, [("t0", ["t2", "t1"]), ("t1", ["t2"]), ("t2", [])])]
    df = spark.createDataFrame(rows, "k int, tasks array<struct<label:string,depends_on:array<string>>>")
    got = {r.k: r.o for r in df.select("k", graph.run_order("tasks", F.lit("t0")).alias("o")).collect()}
    assert got == {k: plan(t, "t0", set(), []) for k, t in rows}


def test_run_order_of_a_long_chain(spark):
    import time

    from pyspark.sql import functions as F

    n = 15_000
    names = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(F.concat(F.lit("t"), k).alias("label"), F.array(F.concat(F.lit("t"), k + 1)).alias("depends_on")))
    begin = time.time()
    got = spark.range(1).select(names.alias("tasks")).select(graph.run_order("tasks", F.lit("t0")).alias("o"))
    assert got.first().o == [f"t{k}" for k in reversed(range(n))]
    assert time.time() - begin < 60  # a search of the list at each step takes minutes


def picture(spark, w, h, seed):
    rng = random.Random(seed)
    px = {(x, y): (rng.randrange(2) * 200, rng.randrange(2) * 90, 7, rng.choice([255, 255, 255, 100])) for x in range(w) for y in range(h)}
    return px, spark.createDataFrame([(1, x, y, *p) for (x, y), p in px.items()], "image_id long, x int, y int, r int, g int, b int, a int")


def test_threshold_matrix_and_dither(spark):
    assert pixels.threshold_matrix(2) == [[0, 2], [3, 1]]
    for n in (4, 8):
        m = pixels.threshold_matrix(n)
        assert sorted(v for row in m for v in row) == list(range(n * n))
    assert pixels.threshold_matrix(4)[0] == [0, 8, 2, 10] and pixels.threshold_matrix(8)[1][:4] == [48, 16, 56, 24]
    px, df = picture(spark, 9, 7, 1)
    own = [[3, 0, 1], [4, 8, 2], [7, 5, 6]]
    for matrix, amount, (sx, sy) in ((pixels.threshold_matrix(2), 1.0, (1, 1)), (own, 0.3, (2, 3))):
        got = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in pixels.ordered_dither(df, matrix, amount, (sx, sy)).collect()}
        n = len(matrix)
        for (x, y), p in px.items():
            move = int((matrix[y // sy % n][x // sx % n] / n**2 - 0.5) * amount * 64)
            assert got[x, y] == ((*(min(255, max(0, c + move)) for c in p[:3]), 255) if p[3] == 255 else p)
    assert pixels.ordered_dither(df, own, 0.0).collect() == df.collect()


@pytest.mark.parametrize("factor", [2, 3])
@pytest.mark.parametrize("size", [(1, 1), (1, 5), (6, 1), (7, 6)])
def test_expansion(spark, factor, size):
    w, h = size
    px, df = picture(spark, w, h, w * 10 + h)
    want = {}
    for x, y in px:
        A, B, C, D, E, F_, G, H, I = (px[min(max(x + dx, 0), w - 1), min(max(y + dy, 0), h - 1)] for dy in (-1, 0, 1) for dx in (-1, 0, 1))  # noqa: E741
        edge = B != H and D != F_
        nw, ne, sw, se = D == B, B == F_, D == H, H == F_
        if factor == 2:
            cell = [(nw, D), (ne, F_), (sw, D), (se, F_)]
        else:
            cell = [(nw, D), (nw and E != C or ne and E != A, B), (ne, F_), (nw and E != G or sw and E != A, D), (False, E), (ne and E != I or se and E != C, F_), (sw, D), (sw and E != I or se and E != G, H), (se, F_)]
        for k, (take, colour) in enumerate(cell):
            want[x * factor + k % factor, y * factor + k // factor] = colour if edge and take else E
    assert {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in pixels.expanded(df, factor).collect()} == want
