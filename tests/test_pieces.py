"""Order and carry over many partitions of one key, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lumarium.operators import enrich as J
from lumarium.operators import ordered as W
from lumarium.operators import pieces
from lumarium.sources import files

PARTS = 23


@pytest.fixture(scope="module")
def events():
    """(key, no, value): one key has nine of ten rows, one is null; repeated values, no repeated (key, no)."""
    rng = random.Random(3)
    return [("hot" if i % 10 else rng.choice(["a", "b", None]), no, rng.choice(["x", "y", None])) for i, no in enumerate(rng.sample(range(10_000), 900))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, no long, value string").repartition(7)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def test_numbers(spark, events):
    got = {(r.key, r.no): r._n for r in pieces.numbered(frame(spark, events), ["key"], ["no"], parts=PARTS).collect()}
    assert got == {(k, r[1]): i + 1 for k, rows in by_key(events).items() for i, r in enumerate(rows)}
    whole = pieces.numbered(frame(spark, events), [], [F.desc("no")], parts=PARTS).collect()
    assert [r.no for r in sorted(whole, key=lambda r: r._n)] == sorted((r[1] for r in events), reverse=True)
    assert pieces.numbered(frame(spark, events).limit(0), ["key"], ["no"]).count() == 0


def test_a_hot_key_lies_in_many_parts(spark, events):
    rows = pieces.cut(frame(spark, events), ["key"], ["no"], PARTS).where("key = 'hot'").groupBy("_part").count().collect()
    assert len(rows) > PARTS // 2 and max(r["count"] for r in rows) < 2.5 * 900 / PARTS


def test_neighbours_and_adjacent(spark, events):
    got = {(r.key, r.no): (r.previous, r.next) for r in W.neighbours(frame(spark, events), "no", ["no"], ["key"], PARTS).collect()}
    want, kept = {}, set()
    for k, rows in by_key(events).items():
        nos = [r[1] for r in rows]
        want |= {(k, n): (a, b) for n, a, b in zip(nos, [None, *nos[:-1]], [*nos[1:], None], strict=True)}
        kept |= {(k, r[1]) for i, r in enumerate(rows) if not i or rows[i - 1][2] != r[2]}
    assert got == want
    assert {(r.key, r.no) for r in W.dedup_adjacent(frame(spark, events), "value", ["no"], ["key"], PARTS).collect()} == kept


@pytest.mark.parametrize("parts", [1, PARTS, 200])
def test_schedule_of_a_hot_host(spark, parts):
    rng = random.Random(parts)
    rows = [("hot" if rng.random() < 0.9 else "cold", i, rng.randrange(60_000), 7 + i % 3 * 60) for i in range(700)]
    df = spark.createDataFrame(rows, "host string, id long, arrival long, gap long")
    last, want = {}, {}
    for h, i, t, gap in sorted(rows, key=lambda r: (r[2], r[1])):
        want[i] = last[h] = t if h not in last else max(t, last[h] + gap)
    assert {r.id: r.start for r in W.schedule(df, F.col("gap"), parts=parts).collect()} == want


def test_pages(spark, events):
    want = {(k, r[1]): i // 10 + 1 for k, rows in by_key(events).items() for i, r in enumerate(rows)}
    for bound in (None, 3, 150):
        got = {(r.key, r.no): r.page for r in W.paginate(frame(spark, events), 10, ["no"], ["key"], bound, PARTS).collect()}
        assert got == {k: v for k, v in want.items() if bound is None or v <= bound}
    plan = W.paginate(frame(spark, events), 10, ["no"], ["key"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # one of them before the shuffle


def test_list_grows_in_order(spark):
    lists = spark.createDataFrame([("l", 1, 9, "t", ""), ("m", 5, 8, "t", "")], "list string, pos int, id long, title string, thumb_url string")
    new = spark.createDataFrame([(100 - i, "t", "", i) for i in range(60)], "id long, title string, thumb_url string, ord long").repartition(5)
    got = files.list_items(files.append_item(lists, new, "l", parts=9), "l").collect()
    assert [(r.pos, r.id) for r in got] == [(1, 9), *((i + 2, 100 - i) for i in range(60))]
    assert [r.pos for r in files.append_item(lists, new, "none").where("list = 'none'").orderBy("pos").collect()] == list(range(1, 61))


def test_carried_values(spark, events):
    got = {(r.key, r.no): r.last for r in pieces.carried(frame(spark, events), ["key"], ["no"], F.when(F.col("no") % 7 == 0, F.col("no")), "last", PARTS).collect()}
    want = {}
    for k, rows in by_key(events).items():
        last = None
        for r in rows:
            last = r[1] if r[1] % 7 == 0 else last
            want[k, r[1]] = last
    assert got == want


def test_longest_rule_of_a_hot_origin(spark):
    """Nested and neighbouring rules, a path before all rules, equal rules of both kinds, most paths of one origin."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ab/") for _ in range(rng.randrange(n)))
    rules = sorted({("https://hot" if i % 5 else "https://cold", rng.choice(["allow", "disallow"]), "/" + word(5)) for i in range(60)})
    urls = sorted({("https://hot" if i % 9 else rng.choice(["https://cold", "https://none"])) + "/" + word(9) for i in range(700)}) + ["bad", "https://hot/"]
    want = {}
    for u in urls:
        met = [(len(p), k == "allow") for o, k, p in rules if u.startswith(o + "/") and u[len(o) :].startswith(p)]
        want[u] = max(met)[1] if met else True
    df, rule = spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(rules, "origin string, kind string, prefix string")
    for parts in (1, PARTS):
        assert {r.url: r.allowed for r in J.robots_verdict(df, rule, parts=parts).collect()} == want
    assert all(r.allowed for r in J.robots_verdict(df, rule.limit(0)).collect())
