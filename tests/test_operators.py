"""Operators on small literal tables."""

from pyspark.sql import functions as F

from lumarium.operators import enrich as J
from lumarium.operators import graph as G
from lumarium.operators import ordered as W
from lumarium.operators import pixels as P
from lumarium.operators import predicates, scratch
from lumarium.operators import rollups as A


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_robots_verdict(spark):
    rules = spark.createDataFrame([("https://h", "disallow", "/a"), ("https://h", "allow", "/a/b"), ("https://h", "allow", "/c"), ("https://h", "disallow", "/c"), ("https://h", "disallow", "/q?x")], "origin string, kind string, prefix string")
    urls = ["https://h/a/x", "https://h/a/b/x", "https://h/c", "https://h/d", "https://o/a", "https://h/q?x=1", "bad"]
    got = dict(rows(J.robots_verdict(spark.createDataFrame([(u,) for u in urls], "url string"), rules), "url", "allowed"))
    assert got == dict(zip(urls, [False, True, True, True, True, False, True], strict=True))


def test_scope_lookup(spark):
    rules = spark.createDataFrame([("comment", "grey"), ("keyword", "red"), ("keyword.control", "blue")], "scope string, value string")
    df = spark.createDataFrame([(1, "comment.line.slash"), (2, "keyword.control.if"), (3, "keywords"), (4, "string")], "id int, scope string")
    assert rows(J.scope_join(df, rules), "id", "value") == [(1, "grey"), (2, "blue"), (3, None), (4, None)]
    many = spark.createDataFrame([(1, ["x", "keyword.x", "comment"]), (2, ["none"])], "id int, candidates array<string>")
    assert rows(J.first_match(many, rules, "id"), "id", "value") == [(1, "red"), (2, None)]


def test_status_and_rating(spark):
    files = spark.createDataFrame([("/r/a",), ("/r/b",), ("/rx/c",), ("/r",)], "path string")
    status = spark.createDataFrame([("/r/a", "new")], "path string, status string")
    assert rows(J.with_status(files, status, "/r"), "path", "status") == [("/r", "clean"), ("/r/a", "new"), ("/r/b", "clean"), ("/rx/c", None)]
    attrs, side = (spark.createDataFrame(x, "path string, stars int") for x in ([("a", 3), ("b", 0)], [("a", 1), ("b", 2), ("c", 4)]))
    assert rows(J.effective_rating(attrs, side), "path", "stars") == [("a", 3), ("b", 2), ("c", 4)]


def test_eviction_follows_the_loop(spark):
    index = [(f"u{i}", f"f{i}", 0, i // 2, 10 + i) for i in range(40)]
    df = spark.createDataFrame(index, "url string, file string, fetched long, used long, bytes long")
    for cap, batch in ((10**6, 512), (700, 512), (0, 512), (300, 5)):
        over, gone = sum(r[4] for r in index) - cap, []
        for r in sorted(index, key=lambda r: (r[3], r[0]))[:batch] if over > 0 else []:
            if over <= 0:
                break
            gone.append(r[0])
            over -= r[4]
        assert sorted(r.url for r in W.victims(df, cap, batch).collect()) == sorted(gone)


def test_schedule_follows_the_rule(spark):
    import random

    rng = random.Random(1)
    req = [(f"h{rng.randrange(3)}", i, rng.randrange(10_000)) for i in range(200)]
    last, want = {}, {}
    for h, i, t in sorted(req, key=lambda r: (r[2], r[1])):
        want[i] = last[h] = t if h not in last else max(t, last[h] + 90)
    df = spark.createDataFrame(req, "host string, id long, arrival long")
    assert dict(rows(W.schedule(df, F.lit(90)), "id", "start")) == want


def test_folds_and_dedup(spark):
    lines = F.array(*map(F.lit, ["a b", "b", "a b", "x", "y x", "x", "y"]))
    assert spark.range(1).select(W.suppress_repeats(lines)).first()[0] == ["a b", "x", "y x", "y"]
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a"), (2, 1, "a")], "g int, i int, k string")
    assert rows(W.dedup_adjacent(df, "k", ["i"], ["g"]), "g", "i") == [(1, 1), (1, 3), (1, 5), (2, 1)]
    assert rows(W.dedup_first(df, ["g", "k"], ["i"]), "g", "i") == [(1, 1), (1, 3), (2, 1)]


def test_views_fold(spark):
    ev = spark.createDataFrame([("a", 0, 1), ("a", 9, 2), ("a", 5, 3), ("b", 0, 4)], "path string, ts long, seq long")
    assert rows(A.view_counts(ev), "path", "count", "first", "last") == [("a", 3, 9, 5), ("b", 1, 0, 0)]
    v = spark.createDataFrame([("a", 2, 1, 5), ("b", 0, 0, 0)], "path string, count long, first long, last long")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "path string")
    assert rows(A.set_viewed(v, keys, True, 7), "path", "count", "first", "last") == [("a", 2, 1, 5), ("b", 1, 7, 7), ("c", 1, 7, 7)]
    assert A.set_viewed(v, keys, False, 7).count() == 0


def test_peaks(spark):
    for n, width in ((7, 3), (3, 7), (5, 5), (1, 4)):
        amp = [((i * 37) % 11) / 10 - 0.5 for i in range(2 * n)]
        env = [max(abs(a) for a in amp[2 * k : 2 * k + 2]) for k in range(n)]
        cols = [max(env[i * n // width : min(max((i + 1) * n // width, i * n // width + 1), n)]) for i in range(width)]
        df = spark.createDataFrame([(1, i, a) for i, a in enumerate(amp)], "sound_id int, frame long, amp double")
        got = dict(rows(A.peaks(df, 2, width), "col", "peak"))
        assert [round(got[i], 9) for i in range(width)] == [round(c / max(max(cols), 1e-4), 9) for c in cols]


def test_bounds_default(spark):
    m = spark.createDataFrame([(1,), (2,)], "mesh_id int")
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0)], "mesh_id int, x double, y double, z double")
    assert rows(A.bounds_or_default(m, p), "mesh_id", "cx", "cy", "cz", "radius") == [(1, 1.0, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 0.0, 1.0)]


def test_crawl(spark):
    links = spark.createDataFrame([("a", "b/", "b", True), ("b", "a/", "a", True), ("b", "c/", "c", True), ("a", "x.zip", None, False), ("b", "y.ZIP", None, False), ("c", "z.zip", None, False), ("c", "z.txt", None, False)], "dir string, name string, target string, is_dir boolean")
    seeds = spark.createDataFrame([("a",)], "dir string")
    assert rows(G.crawl(seeds, links, "*.zip"), "name", "depth") == [("x.zip", 0), ("y.ZIP", 1), ("z.zip", 2)]
    assert rows(G.crawl(seeds, links, "", 1), "name") == [("x.zip",), ("y.ZIP",)]
    assert G.crawl(seeds.limit(0), links).count() == 0


def test_crawl_leaves_only_its_result(spark, tmp_path, monkeypatch):
    places = iter(range(1000))
    for module in (scratch, G):
        monkeypatch.setattr(module, "scratch", lambda spark: f"file://{tmp_path}/{next(places)}")
    links = spark.createDataFrame([(i, f"d{i}", (i * 7 + 1) % 50, True) for i in range(50)] + [(i, f"{i}.txt", None, False) for i in range(50)], "dir int, name string, target int, is_dir boolean")
    got = G.crawl(spark.createDataFrame([(0,), (3,)], "dir int"), links).collect()
    want, depth, front = {}, 0, {0, 3}
    while front and depth <= G.MAX_DEPTH:
        want |= dict.fromkeys(front, depth)
        front, depth = {(i * 7 + 1) % 50 for i in front} - set(want), depth + 1
    assert {r.dir: r.depth for r in got} == want
    assert len([p for p in tmp_path.iterdir() if not p.name.startswith(".")]) == 1


def test_pixels(spark):
    px = [(1, x, y, 10 * (x // 3), 0, 0, 255) for x in range(60) for y in range(5)] + [(2, 0, 0, 5, 5, 5, 128), (2, 1, 0, 5, 5, 5, 255)]
    px = [(i, x, y, r * 9 % 256, g, b, a) for i, x, y, r, g, b, a in px]
    df = spark.createDataFrame(px, "image_id long, x int, y int, r int, g int, b int, a int")
    scale = {r.image_id: (r.sx, r.sy) for r in P.pixel_scale(df).collect()}
    assert scale == {1: (15, 1), 2: (1, 1)} or scale[1][0] % 3 == 0
    assert dict(rows(P.color_counts(df, cap=250), "image_id", "colors")) == {1: None, 2: 1}
    small = {(r.x, r.y): (r.r, r.a) for r in P.downscale(df.where("image_id = 2"), 1).collect()}
    assert small == {(0, 0): (45, 191)}
    assert P.downscale(df.where("image_id = 2"), 8).count() == 2
    pal = spark.createDataFrame([(0, 0, 0, 0), (1, 90, 5, 5), (2, 90, 5, 5)], "idx int, r int, g int, b int")
    near = P.nearest_color(spark.createDataFrame([(45, 2, 2), (89, 0, 0)], "r int, g int, b int"), pal)
    assert rows(near, "r", "idx") == [(45, 0), (89, 1)]


def test_find_in_text(spark):
    df = spark.createDataFrame([(1, "aaxaaaax"), (2, "none")], "id int, text string")
    assert rows(predicates.find_in_text(df, "aa"), "id", "no", "at") == [(1, 0, 1), (1, 1, 4), (1, 2, 6)]


def test_equal_indexes_come_by_key(spark, tmp_path):
    from lumarium.plans import registry

    keys = [3 + 100_003 * k for k in range(40)]  # one index but for those that are multiples of four, which have none
    spark.createDataFrame([(k,) for k in reversed(keys)], "p_partkey long").repartition(5).write.parquet(f"{tmp_path}/part.parquet")
    rows = registry.QUERIES["o05_by_index"](spark, str(tmp_path)).collect()
    assert [r.p_partkey for r in sorted(rows, key=lambda r: r.place)] == sorted(keys, key=lambda k: (k % 4 == 0, k))


def test_edges_across_tiles(spark):
    import random
    from collections import Counter

    rng = random.Random(4)
    w, h = 150, 131
    px = {(i, x, y): (*(rng.choice((0, 20, 60)) for _ in "rgb"), rng.choice((255, 255, 255, 9))) for i in (1, 2) for x in range(w) for y in range(h) if rng.random() < 0.9 or (x, y) == (w - 1, h - 1)}
    expected = Counter()
    for (i, x, y), p in px.items():
        for axis, q, pos, across, every in (("x", px.get((i, x - 1, y)), x, y, h // 64), ("y", px.get((i, x, y - 1)), y, x, w // 64)):
            if q and p[3] == q[3] == 255 and across % every == 0 and sum(abs(a - b) for a, b in zip(p[:3], q[:3])) > P.EDGE:
                expected[i, axis, pos] += 1
    listed = [(*k, *v) for k, v in px.items()]
    rng.shuffle(listed)
    df = spark.createDataFrame(listed, "image_id long, x int, y int, r int, g int, b int, a int")
    assert {(r.image_id, r.axis, r.pos): r.n for r in P.edge_counts(df).collect()} == expected
    assert P.edges(df).count() == sum(expected.values())
    assert P.edge_counts(df.limit(0)).count() == 0
