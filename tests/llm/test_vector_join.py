import numpy as np

from lumarium.llm import vector_join as V


def brute(rows, t=0.98):
    fine = [(i, l, np.array(v, float)) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    links, low = {i: set() for i, _, _ in rows}, {i: i for i, _, _ in rows}
    for a, (i, l, x) in enumerate(fine):
        for j, m, y in fine[:a]:
            if l == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= t:
                links[i].add(j)
                links[j].add(i)
    changed = True
    while changed:
        changed = False
        for i in links:
            m = min([low[i], *(low[j] for j in links[i])])
            changed |= m < low[i]
            low[i] = m
    return {(i, len(links[i]), low[i], low[i] == i) for i in links}


def test_against_brute_force_on_embeddings(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {tuple(r) for r in V.op10_vector_join(spark, d).collect()}
    assert got == brute(rows)


def test_scaled_numbers_and_repeated_ids(spark):
    rows = [(1, [1e-170, 1e-170]), (1, [1e-170, 1e-170]), (2, [1e160, 1.01e160]), (3, [1e300, -1e300]), (1, [-5.0, 5.0]), (4, [1.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "a") for i, v in rows], "vec_id long, embedding array<double>, label string")
    got = sorted(((r[0] or -1, *tuple(r)[1:]) for r in V.embedding_near_dedup(df).collect()), key=str)
    assert got == sorted([(-1, 0, None, None), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (1, 0, 1, True), (4, 0, 4, True)], key=str)


def test_few_pairs_are_compared():
    x = np.random.default_rng(4).normal(size=(1500, 64))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    y, cuts = x @ V.rotation(64), V.block_cuts(64)
    radius = np.sqrt(V.budgets(64, V.COSINE, V.BLOCKS))
    seen = sum(len(i) for b in range(V.BLOCKS) for i, _ in V.near_pairs(y[:, cuts[b] : cuts[b + 1]], None, radius[b]))
    assert seen < 0.06 * len(x) * (len(x) - 1) / 2


def test_near_pairs_against_all_pairs():
    rng = np.random.default_rng(6)
    for m, r in ((1, 0.01), (2, 0.3), (8, 0.07), (5, 1e-7), (3, 1.5)):
        y = np.concatenate([z := rng.uniform(-0.6, 0.6, (70, m)), z[:30] + rng.normal(size=(30, m)) * r / 3, z[:3]])
        for left, right in ((y, None), (y[:40], y[40:])):
            got = [(a, b) for i, j in V.near_pairs(left, right, r) for a, b in zip(i.tolist(), j.tolist())]
            got = [tuple(sorted(p)) for p in got] if right is None else got
            far = np.sqrt(((left[:, None] - (left if right is None else right)[None]) ** 2).sum(-1))
            want = {(a, b) for a, b in zip(*(k.tolist() for k in np.nonzero(far <= r))) if right is not None or a < b}
            assert len(got) == len(set(got)) and want <= set(got)


def test_edges_and_crowded_cells(spark):
    rng = np.random.default_rng(1)
    c = rng.normal(size=24)
    rows = [(i, (c + rng.normal(size=24) * s).tolist(), i % 2) for i, s in enumerate(rng.uniform(0, 0.35, 150))]
    nan, inf = float("nan"), float("inf")
    rows += [(200, None, 0), (201, [], 0), (202, [0.0] * 24, 0), (203, [nan] + [1.0] * 23, 0), (204, [inf] + [1.0] * 23, 0), (205, c.tolist(), None), (206, [None] + [1.0] * 23, 1), (207, [1.0, -0.0], 0), (208, [2.0, 0.0], 0), (209, [1.0, 0.0], 0), (210, rows[3][1], 1), (211, rows[3][1], 1)]
    df = spark.createDataFrame([(v, i, l, "x") for i, v, l in rows], "embedding array<double>, vec_id long, label int, grp string")
    want = brute(rows)
    # whole labels in a task; coarse cells of one and of three coordinates; crowded cells
    for values in (V.TASK_VALUES, 24 * 40, 24 * 3):
        assert {tuple(r) for r in V.embedding_near_dedup(df, task_values=values).collect()} == want
    assert V.embedding_near_dedup(df.limit(0)).count() == 0
