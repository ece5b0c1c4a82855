"""Nearest colours in a grid, and median cut of images with many colours, both as DataFrame rounds."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import dropped, written

RGB = ("r", "g", "b")


def all_of(conditions) -> Column:
    return reduce(lambda a, c: a & c, conditions)


def squared(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    return sum(((a(c) - b(c)) * (a(c) - b(c)) for c in RGB), F.lit(0))


# ---------------------------------------------------------------- nearest entries

#: Rings of cells that are looked through one after the other: those up to so many cells away.
RINGS = (0, 1, 2, 4, 8, 16, 32, 64)


def cell_bits(n: Column) -> Column:
    """Bits of a cell's side for so many distinct colours: a cell has some ten to a hundred of them if they are spread."""
    return F.when(n <= 1 << 15, 5).when(n <= 1 << 18, 4).when(n <= 1 << 21, 3).otherwise(2)


def nearest_in_grid(colors: DataFrame, entries: DataFrame, keys: list[str], other: bool = False) -> DataFrame:
    """(keys, r, g, b, d, idx, pr, pg, pb) of each distinct colour of ``colors`` (keys, r, g, b): the smallest squared distance
    to an entry (keys, r, g, b, idx) of the same keys, with distinct colours, and the entry of the lowest index at that
    distance; with ``other`` the colour itself doesn't count. Keys without such an entry give nothing.

    The colour cube of each key is cut into cells. A colour looks through its own cell, then through rings of cells around it,
    of which only those that may hold something as near as the best so far are met; it is done when nothing beyond the rings
    can be. Entries are as many as there are colours at most (2**24 for each key), cells have a bounded number of them, and
    each round writes what it found."""
    size = entries.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, cell_bits(F.col("_n")).alias("_s"))
    cell = [F.expr(f"shiftright({c}, _s)").alias(f"_c{c}") for c in RGB]

    def sized(df):
        return df.join(size, keys) if keys else df.crossJoin(F.broadcast(size))  # one row

    whole = [F.col(c).cast("int").alias(c) for c in RGB]
    e = written(sized(entries.select(*keys, *whole, "idx")).select(*keys, *cell, *(F.col(c).alias(f"p{c}") for c in RGB), F.col("idx").cast("bigint").alias("idx")))
    best = "struct<d:bigint,idx:bigint,pr:int,pg:int,pb:int>"
    open_ = written(sized(colors.select(*keys, *whole).distinct()).select(*keys, *RGB, "_s", *cell, F.lit(None).cast(best).alias("_best")))
    done, seen = [], -1
    for ring in RINGS:
        cells, gap = open_, []
        for c in RGB:
            cells = cells.select("*", F.explode(F.sequence(F.lit(-ring), F.lit(ring))).alias(f"_o{c}"))
            cells = cells.where(F.expr(f"_c{c} + _o{c} BETWEEN 0 AND shiftright(255, _s)"))
            gap.append(F.expr(f"CASE WHEN _o{c} > 0 THEN shiftleft(_c{c} + _o{c}, _s) - {c} WHEN _o{c} < 0 THEN {c} - shiftleft(_c{c} + _o{c} + 1, _s) + 1 ELSE 0 END"))
        near = sum((g * g for g in gap), F.lit(0))
        cells = cells.where((F.greatest(*(F.abs(f"_o{c}") for c in RGB)) > seen) & (F.col("_best").isNull() | (near <= F.col("_best.d"))))
        cells = cells.select(*keys, *RGB, *(F.expr(f"_c{c} + _o{c}").alias(f"_c{c}") for c in RGB))
        pairs = cells.join(e, [*keys, *(f"_c{c}" for c in RGB)]).withColumn("d", squared(F.col, lambda c: F.col(f"p{c}")).cast("bigint"))
        found = (pairs.where("d > 0") if other else pairs).groupBy(*keys, *RGB).agg(F.min(F.struct("d", "idx", "pr", "pg", "pb")).alias("_new"))
        names = [*keys, *RGB]
        found = found.withColumnsRenamed({c: f"_f{c}" for c in names})
        met = open_.join(found, all_of(F.col(c).eqNullSafe(F.col(f"_f{c}")) for c in names), "left").withColumn("_best", F.least("_best", "_new")).select(*open_.columns)
        # colours beyond the rings differ by so much at least in one channel
        side = [F.expr(f"CASE WHEN {e_} THEN 256 ELSE {v} END") for c in RGB for e_, v in ((f"_c{c} - {ring} <= 0", f"{c} - shiftleft(_c{c} - {ring}, _s) + 1"), (f"_c{c} + {ring} >= shiftright(255, _s)", f"shiftleft(_c{c} + {ring} + 1, _s) - {c}"))]
        reach = F.least(*side)
        met = written(met.withColumn("_done", (reach >= 256) | F.coalesce(F.col("_best.d") < reach * reach, F.lit(False))))
        done.append(met.where("_done"))
        open_, seen = met.where("NOT _done").drop("_done"), ring
        if not open_.limit(1).count():
            break
    out = reduce(DataFrame.unionByName, done)
    return out.where("_best IS NOT NULL").select(*keys, *RGB, "_best.*")


# ---------------------------------------------------------------- median cut

#: Colours of an image up to which one task cuts it; larger ones are cut in rounds over all tasks.
GROUP_COLOURS = 1 << 16
#: Boxes up to which their rows are sent to all tasks (some 60 bytes each).
BROADCAST_BOXES = 1 << 20


def last_widest(lo: Callable[[int], int], hi: Callable[[int], int]) -> int:
    return max(range(3), key=lambda k: (hi(k) - lo(k), k))


def final_boxes(n: int, root, width: Callable, halves: Callable) -> list:
    """The boxes that are left when the widest one of several colours is halved until there are n. Of equally wide boxes the
    one in the last place counts; the box that goes leaves its place to the last one, and its halves get new last places.
    ``width`` is negative for a box of one colour."""
    places, queue = [root], [(-width(root), 0, root)]

    def put(box, place):
        heapq.heappush(queue, (-width(box), -place, box))

    while len(places) < n:
        while queue and (-queue[0][1] >= len(places) or places[-queue[0][1]] != queue[0][2]):
            heapq.heappop(queue)  # what is there has another place now
        if not queue or queue[0][0] > 0:
            break
        place, box = -queue[0][1], heapq.heappop(queue)[2]
        last = places.pop()
        if place < len(places):
            places[place] = last
            put(last, place)
        for half in halves(box):
            put(half, len(places))
            places.append(half)
    return places


class Cut:
    """Boxes of one image's distinct colours (in order), numbered as in a binary tree."""

    def __init__(self, colours: np.ndarray):
        self.rows = {1: colours}

    def width(self, box: int) -> int:
        x = self.rows[box]
        return int((x.max(0) - x.min(0)).max()) if len(x) > 1 else -1

    def halves(self, box: int) -> tuple[int, int]:
        x = self.rows[box]
        lo, hi = x.min(0), x.max(0)
        x = x[np.argsort(x[:, last_widest(lo.__getitem__, hi.__getitem__)], kind="stable")]
        self.rows[2 * box], self.rows[2 * box + 1] = x[: len(x) // 2], x[len(x) // 2 :]
        return 2 * box, 2 * box + 1


def cut_in_groups(colors: DataFrame, n: int, key: str) -> DataFrame:
    """(key, r, g, b): the means of the boxes of each image, an image in one task."""

    def reduce_(table):
        x = np.stack([table.column(c).to_numpy() for c in RGB], 1).astype(np.int64)
        cut = Cut(x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))])
        means = np.unique([cut.rows[b].sum(0) // len(cut.rows[b]) for b in final_boxes(n, 1, cut.width, cut.halves)], axis=0)
        return pa.table({key: pa.array([table.column(key)[0].as_py()] * len(means), pa.int64()), **{c: pa.array(means[:, k], pa.int32()) for k, c in enumerate(RGB)}})

    return colors.groupBy(key).applyInArrow(reduce_, f"{key} long, r int, g int, b int")


def cut_in_rounds(colors: DataFrame, n: int, key: str) -> DataFrame:
    """The same in rounds over all images and all tasks. A box halves alike whenever it is its turn, so each round halves all
    boxes that may still be asked for: those as wide as the (n - 1)th widest that is known. Halves are no wider than their
    box and have half its colours, so that there are as many rounds as colours have bits.

    Colours of a box are in the order of the channels by which it and the boxes above it were halved, the last one first,
    then of r, g, b: three bytes in some order. The middle one is found by the counts of its first byte in each box, and
    then of the two others where the first one is right; no box is sorted, and none is in one task."""
    byte = {o: "CASE ord " + " ".join(f"WHEN '{''.join(p)}' THEN {p[k]}" for p in permutations(RGB)) + " END" for k, o in enumerate(("_a", "_b", "_c"))}
    rows = written(colors.select(key, *(F.col(c).cast("int").alias(c) for c in RGB), F.lit(1).cast("long").alias("box"), F.lit("rgb").alias("ord")))
    trees: list[DataFrame] = []
    while True:
        stats = rows.groupBy(key, "box", "ord").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{c}") for c in RGB), *(f(c).alias(f"{m}{c}") for c in RGB for f, m in ((F.min, "lo"), (F.max, "hi"))))
        spread = {c: F.col(f"hi{c}") - F.col(f"lo{c}") for c in RGB}
        width = F.greatest(*spread.values())
        channel = F.when(spread["b"] == width, "b").when(spread["g"] == width, "g").otherwise("r")
        stats = stats.select(key, "box", "n", *(F.col(f"s{c}").alias(c) for c in RGB), F.when(F.col("n") > 1, width).otherwise(-1).alias("width"), F.concat(channel, F.replace("ord", channel, F.lit(""))).alias("ord"))
        trees.append(written(stats))
        known = reduce(DataFrame.unionByName, trees)
        # as wide as the (n - 1)th widest of all known boxes of the image
        place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("width"), "box"))
        bound = known.where("width > 0").withColumn("_p", place).groupBy(key).agg(F.max(F.when(F.col("_p") == n - 1, F.col("width"))).alias("_least"))
        ask = written(trees[-1].where("width > 0").join(bound, key).where(F.col("width") >= F.coalesce("_least", F.lit(1))).select(key, "box", "ord", (F.expr("n div 2")).alias("_half")))
        boxes = ask.count()
        if n < 2 or not boxes:
            break
        side = F.broadcast(ask) if boxes <= BROADCAST_BOXES else ask
        open_ = rows.drop("ord").join(side, [key, "box"]).select(key, "box", *RGB, "ord", "_half", *(F.expr(e).alias(o) for o, e in byte.items()))
        open_ = written(open_.withColumn("_bc", F.col("_b") * 256 + F.col("_c")).drop("_b", "_c"))
        before = F.sum("_m").over(Window.partitionBy(key, "box").orderBy("_a")) - F.col("_m")
        first = open_.groupBy(key, "box", "_half", "_a").agg(F.count("*").alias("_m")).withColumn("_before", before)
        first = written(first.where("_before <= _half AND _half < _before + _m").select(key, "box", F.col("_a").alias("_at"), (F.col("_half") - F.col("_before")).alias("_rest")))
        first_side = F.broadcast(first) if boxes <= BROADCAST_BOXES else first
        second = open_.join(first_side, [key, "box"]).where("_a = _at").groupBy(key, "box", "_at", "_rest").agg(F.sort_array(F.collect_list("_bc")).alias("_l"))  # 65,536 at most
        middle = written(second.select(key, "box", "_at", F.expr("_l[int(_rest)]").alias("_bc_at")))
        middle_side = F.broadcast(middle) if boxes <= BROADCAST_BOXES else middle
        upper = (F.col("_a") > F.col("_at")) | ((F.col("_a") == F.col("_at")) & (F.col("_bc") >= F.col("_bc_at")))
        nxt = written(open_.join(middle_side, [key, "box"]).select(key, *RGB, (F.col("box") * 2 + upper.cast("long")).alias("box"), "ord"))
        for t in (rows, ask, open_, first, middle):
            dropped(t)
        rows = nxt

    def chosen(table):
        at = {b: (w, c, s) for b, w, c, *s in zip(*(table.column(x).to_pylist() for x in ("box", "width", "n", *RGB)), strict=True)}
        means = sorted({tuple(v // at[b][1] for v in at[b][2]) for b in final_boxes(n, 1, lambda b: at[b][0], lambda b: (2 * b, 2 * b + 1))})
        return pa.table({key: pa.array([table.column(key)[0].as_py()] * len(means), pa.int64()), **{c: pa.array([m[k] for m in means], pa.int32()) for k, c in enumerate(RGB)}})

    tree = written(known.select(F.col(key).cast("long").alias(key), "box", "n", "width", *RGB))
    return tree.groupBy(key).applyInArrow(chosen, f"{key} long, r int, g int, b int")


def median_cut(colors: DataFrame, n: int, key: str, group_colours: int = GROUP_COLOURS) -> DataFrame:
    """(key, r, g, b): each image's distinct colours (key, r, g, b) reduced to n at most: the box with the widest channel is
    halved in the middle until there are n, and each box gives its floored mean, once. Images of few colours go to a task
    each; those of more than ``group_colours`` are cut in rounds, with the same result."""
    n = max(n, 1)
    typed = written(colors.select(F.col(key).cast("long").alias(key), *(F.col(c).cast("int").alias(c) for c in RGB)).distinct())
    large = typed.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > max(group_colours, n))
    if not large.limit(1).count():
        return cut_in_groups(typed, n, key)
    large = written(large.select(key))
    return cut_in_groups(typed.join(large, key, "left_anti"), n, key).unionByName(cut_in_rounds(typed.join(large, key, "left_semi"), n, key))
