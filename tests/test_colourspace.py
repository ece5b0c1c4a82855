"""Grids and rounds against plain loops over all pairs and boxes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumarium.operators import colourspace as S
from lumarium.operators import pixels as P


def plain_cut(colours, n):
    """The rule as it stands: a list of lists."""
    boxes = [sorted(set(colours))]
    while len(boxes) < n:
        widths = [max(max(c[k] for c in b) - min(c[k] for c in b) for k in range(3)) if len(b) > 1 else -1 for b in boxes]
        i = max(range(len(boxes)), key=lambda i: (widths[i], i))
        if widths[i] < 0:
            break
        box, end = boxes[i], boxes.pop()
        if i < len(boxes):
            boxes[i] = end
        spread = [max(c[k] for c in box) - min(c[k] for c in box) for k in range(3)]
        box = sorted(box, key=lambda c: c[max(range(3), key=lambda k: (spread[k], k))])
        boxes += [box[: len(box) // 2], box[len(box) // 2 :]]
    return sorted({tuple(sum(c[k] for c in b) // len(b) for k in range(3)) for b in boxes})


def images(seed):
    rng = random.Random(seed)
    return {
        1: [(1, 2, 3)],
        2: [tuple(rng.randrange(256) for _ in range(3)) for _ in range(700)],
        3: [tuple(rng.randrange(4) * 60 for _ in range(3)) for _ in range(90)],  # many equally wide boxes
        4: [(x, 0, 0) for x in range(0, 256, 3)],
        5: [(min(255, int(rng.expovariate(0.05))), rng.randrange(8), 200) for _ in range(400)],
        6: [(0, 0, 9), (9, 0, 0)],
    }


@pytest.mark.parametrize("n", [1, 2, 4, 7, 32])
def test_median_cut_in_groups_and_rounds(spark, n):
    pictures = images(n)
    df = spark.createDataFrame([(k, *c) for k, cs in pictures.items() for c in cs], "image_id long, r int, g int, b int").repartition(3)
    want = sorted((k, *c) for k, cs in pictures.items() for c in plain_cut(cs, n))
    assert sorted(map(tuple, P.median_cut(df, n).collect())) == want
    if n in (4, 7):  # every image in rounds, some of them, and boxes joined by a shuffle
        assert sorted(map(tuple, P.median_cut(df, n, 0).collect())) == want
        S_boxes, S.BROADCAST_BOXES = S.BROADCAST_BOXES, 0
        try:
            assert sorted(map(tuple, P.median_cut(df, n, 100).collect())) == want
        finally:
            S.BROADCAST_BOXES = S_boxes


def test_median_cut_without_colours(spark):
    assert P.median_cut(spark.createDataFrame([], "image_id long, r int, g int, b int"), 4).count() == 0


def test_large_image_in_rounds(spark):
    """A hundred thousand colours: above the bound of a task."""
    k = F.col("id")
    df = spark.range(120_000).select(F.lit(9).cast("long").alias("image_id"), (k % 256).cast("int").alias("r"), (k * 7 % 253).cast("int").alias("g"), (k * k % 251).cast("int").alias("b"))
    colours = np.array([tuple(r)[1:] for r in df.distinct().collect()])
    assert len(colours) > S.GROUP_COLOURS
    colours = colours[np.lexsort((colours[:, 2], colours[:, 1], colours[:, 0]))]
    cut = S.Cut(colours)
    want = sorted({tuple((cut.rows[b].sum(0) // len(cut.rows[b])).tolist()) for b in S.final_boxes(8, 1, cut.width, cut.halves)})
    assert sorted(tuple(r)[1:] for r in P.median_cut(df, 8).collect()) == want


def palettes():
    rng = random.Random(4)
    anywhere = [tuple(rng.randrange(256) for _ in range(3)) for _ in range(3000)]
    return {
        "spread": anywhere + anywhere[:50],  # the first index of equal entries counts
        "corner": [tuple(rng.randrange(12) for _ in range(3)) for _ in range(800)],
        "two": [(0, 0, 0), (255, 255, 255)],
        "grid": [(x, y, z) for x in range(0, 256, 32) for y in range(0, 256, 32) for z in range(0, 256, 64)],  # ties
    }


@pytest.mark.parametrize("name", ["spread", "corner", "two", "grid"])
def test_nearest_in_grid(spark, name):
    rng = random.Random(8)
    palette = palettes()[name]
    queries = [tuple(rng.randrange(256) for _ in range(3)) for _ in range(300)] + [(0, 0, 0), (255, 255, 255), (16, 16, 32), *palette[:20]]
    x = np.array(palette)
    at = [int((((x - np.array(q)) ** 2).sum(1)).argmin()) for q in queries]
    df = spark.createDataFrame([(i, *q) for i, q in enumerate(queries)], "q int, r int, g int, b int")
    pal = spark.createDataFrame([(i, *c) for i, c in enumerate(palette)], "idx int, r int, g int, b int")
    for bound in (0, 4096):
        got = {r.q: (r.idx, r.pr, r.pg, r.pb) for r in P.nearest_color(df, pal, bound).collect()}
        assert got == {i: (k, *palette[k]) for i, k in enumerate(at)}
    assert P.nearest_color(df, pal.limit(0)).count() == 0


def test_spacing_in_rows_and_grids(spark):
    rows = palettes() | {"one": [(5, 5, 5)], "same": [(7, 7, 7)] * 3, "pair": [(0, 0, 0), (3, 4, 0)]}
    want = {}
    for name, p in rows.items():
        x = np.array(p)
        d = sorted(int(np.delete(((x - c) ** 2).sum(1), i).min()) for i, c in enumerate(x)) if len(p) > 1 else []
        want[name] = float(d[len(d) // 2]) if d else 20_000.0
    df = spark.createDataFrame([(name, i, *c) for name, p in rows.items() for i, c in enumerate(p)], "palette_id string, idx int, r int, g int, b int").repartition(3)
    for bound in (1, 256):
        assert {r.palette_id: r.spacing for r in P.palette_spacing(df, row_colours=bound).collect()} == want
