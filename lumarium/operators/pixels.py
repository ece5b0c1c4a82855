"""Image features over a table of pixels (image_id, x, y, r, g, b, a)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import colourspace as space
from .scratch import written

KEY = "image_id"
PIXEL_CAP, SWATCH_CAP = 4_000_000, 4096
EDGE, MIN_EDGES, PHASE_SHARE, MAX_PERIOD, SAMPLED = 24, 16, 0.8, 16, 64
#: Side of the tiles in which neighbours are compared, their pixels as bytes, and bytes that a task compares at once.
TILE, HELD_BYTES = 64, 4 << 20
PIXEL = np.dtype([("x", "u1"), ("y", "u1"), ("opaque", "u1"), ("_", "u1"), ("r", "i4"), ("g", "i4"), ("b", "i4")])
COLOUR = "struct<r:int,g:int,b:int>"


def _rgb() -> Column:
    return F.struct(*(F.col(c).cast("int").alias(c) for c in "rgb"))


def distinct_opaque(pixels: DataFrame) -> DataFrame:
    """(image_id, r, g, b): distinct fully opaque colours."""
    return pixels.where("a = 255").select(KEY, "r", "g", "b").distinct()


def color_counts(pixels: DataFrame, cap: int = PIXEL_CAP) -> DataFrame:
    """(image_id, colors): distinct opaque colours; null above the pixel cap. Two plain aggregations, no wide set."""
    colours = distinct_opaque(pixels).groupBy(KEY).agg(F.count("*").alias("n"))
    size = pixels.groupBy(KEY).agg(F.count("*").alias("pixels"))
    return size.join(colours, KEY, "left").select(KEY, F.when(F.col("pixels") <= cap, F.coalesce("n", F.lit(0))).alias("colors"))


def extract_palette(pixels: DataFrame, indexed: DataFrame | None = None, cap: int = PIXEL_CAP, swatches: int = SWATCH_CAP) -> DataFrame:
    """(image_id, palette): an image's own palette, else its opaque colours in order, else null when there are too many."""
    counts = color_counts(pixels, cap)
    fits = counts.where(F.col("colors") <= swatches).select(KEY)
    found = distinct_opaque(pixels).join(fits, KEY, "left_semi").groupBy(KEY).agg(F.array_sort(F.collect_list(_rgb())).alias("palette"))
    empty = F.when(F.col("colors") == 0, F.array().cast(f"array<{COLOUR}>"))
    out = counts.join(found, KEY, "left").select(KEY, F.coalesce("palette", empty).alias("palette"))
    if indexed is None:
        return out
    own = indexed.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("idx", _rgb().alias("c")))).alias("p")).select(KEY, F.col("p.c").alias("own"))
    return out.join(own, KEY, "left").select(KEY, F.coalesce("own", "palette").alias("palette"))


# ---------------------------------------------------------------- median cut


def median_cut(colors: DataFrame, n: int, group_colours: int = space.GROUP_COLOURS) -> DataFrame:
    """(image_id, r, g, b): each image's colours reduced to n at most."""
    return space.median_cut(colors, n, KEY, group_colours)


# ---------------------------------------------------------------- geometry


def sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(KEY).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def downscale(pixels: DataFrame, max_dim: int, size: DataFrame | None = None) -> DataFrame:
    """Area averages weighted by alpha, floored; images within ``max_dim`` stay as they are. Target cells part the source, so
    each pixel names its cell and one aggregation does the rest. ``size`` (image_id, w, h) saves a pass over the pixels."""
    size = sizes(pixels) if size is None else size
    scale = F.least(F.lit(float(max_dim)) / F.col("w"), F.lit(float(max_dim)) / F.col("h"))
    dim = size.withColumn("big", (F.col("w") > max_dim) | (F.col("h") > max_dim))
    for d, s in (("dw", "w"), ("dh", "h")):
        dim = dim.withColumn(d, F.when(F.col("big"), F.greatest(F.round(F.col(s) * scale), F.lit(1.0)).cast("int")).otherwise(F.col(s)))
    cells = pixels.join(dim, KEY).withColumn("cx", F.expr("((x + 1) * dw - 1) div w")).withColumn("cy", F.expr("((y + 1) * dh - 1) div h"))
    sums = cells.groupBy(KEY, "cx", "cy").agg(F.first("big").alias("big"), *(F.sum(F.col(c) * F.col("a")).alias(f"s{c}") for c in "rgb"), F.sum("a").alias("sa"), F.count("*").alias("n"), *(F.first(c).alias(f"f{c}") for c in "rgba"))
    value = [F.expr(f"CASE WHEN NOT big THEN f{c} WHEN sa > 0 THEN s{c} div sa ELSE 0 END").cast("int").alias(c) for c in "rgb"]
    alpha = F.expr("CASE WHEN NOT big THEN fa ELSE sa div n END").cast("int").alias("a")
    return sums.select(KEY, F.col("cx").cast("int").alias("x"), F.col("cy").cast("int").alias("y"), *value, alpha)


def _packed(pixels: DataFrame) -> DataFrame:
    """(image_id, tx, ty, pixels): the pixels of tiles of TILE by TILE as bytes, any number of rows a tile. The first column and
    row of the next tile are in a tile too."""

    def run(batches):
        for b in batches:
            image = pc.dictionary_encode(b.column(0), null_encoding="encode")
            code, (x, y) = image.indices.to_numpy(), (b.column(k).to_numpy().astype(np.int64) for k in (1, 2))
            at = [np.arange(len(x)), np.flatnonzero((x % TILE == 0) & (x > 0)), np.flatnonzero((y % TILE == 0) & (y > 0))]
            step = np.repeat([0, 1, 2], [len(k) for k in at])
            at = np.concatenate(at)
            tx, ty = x[at] // TILE - (step == 1), y[at] // TILE - (step == 2)
            order = np.lexsort((tx, ty, code[at]))
            at, tx, ty = at[order], tx[order], ty[order]
            px = np.zeros(len(at), PIXEL)
            px["x"], px["y"] = x[at] - tx * TILE, y[at] - ty * TILE
            for k, c in enumerate(("r", "g", "b", "opaque")):
                px[c] = b.column(3 + k).to_numpy(zero_copy_only=False)[at]
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(code[at]) != 0) | (np.diff(tx) != 0) | (np.diff(ty) != 0)
            first = np.flatnonzero(new)
            ends = np.append(first, len(at)) * PIXEL.itemsize
            blobs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(px.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[first])), pa.array(tx[first]), pa.array(ty[first]), blobs], [KEY, "tx", "ty", "pixels"])

    opaque = F.coalesce((F.col("a") == 255) & F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull(), F.lit(False))
    rows = pixels.where("x IS NOT NULL AND y IS NOT NULL").select(KEY, F.col("x").cast("long"), F.col("y").cast("long"), *(F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in "rgb"), opaque.cast("int").alias("opaque"))
    return rows.mapInArrow(run, T.StructType([pixels.schema[KEY], *(T.StructField(c, T.LongType()) for c in ("tx", "ty")), T.StructField("pixels", T.BinaryType())]))


def edge_counts(pixels: DataFrame, size: DataFrame | None = None) -> DataFrame:
    """(image_id, axis, pos, n): the edges of each place, counted. Pixels are shuffled as packed tiles, which tasks compare in
    arrays, some megabytes at a time."""
    size = sizes(pixels) if size is None else size
    skip = (F.greatest(F.expr(f"{c} div {SAMPLED}"), F.lit(1)).cast("long").alias(f"every_{c}") for c in "wh")
    tiles = _packed(pixels).join(size.where("w >= 4 AND h >= 4").select(KEY, *skip), KEY).select(KEY, "tx", "ty", "every_w", "every_h", "pixels")

    def counted(t: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        blobs = t.column("pixels").combine_chunks()
        px = np.frombuffer(b"".join(blobs.to_pylist()), PIXEL)
        first = np.flatnonzero(new)
        tile = np.repeat(np.cumsum(new) - 1, pc.binary_length(blobs).to_numpy() // PIXEL.itemsize)
        tx, ty, every_w, every_h = (t.column(c).to_numpy()[first] for c in ("tx", "ty", "every_w", "every_h"))
        rows = []
        for along, across, origin, beside, every in (("x", "y", tx, ty, every_h), ("y", "x", ty, tx, every_w)):
            u, v = px[along].astype(np.int64), px[across].astype(np.int64)
            key = (tile * (TILE + 1) + v) * (TILE + 2) + u
            order = np.argsort(key, kind="stable")
            p, q = order[:-1], order[1:]
            near = (key[q] == key[p] + 1) & (px["opaque"][p] & px["opaque"][q] > 0) & (v[q] < TILE)
            p, q = p[near], q[near]
            delta = sum(np.abs(px[c][q].astype(np.int64) - px[c][p]) for c in "rgb")
            q = q[(delta > EDGE) & ((beside[tile[q]] * TILE + v[q]) % every[tile[q]] == 0)]
            n = np.bincount(tile[q] * (TILE + 1) + u[q], minlength=1)
            found = np.flatnonzero(n)
            of, at = np.divmod(found, TILE + 1)
            rows.append((first[of], np.full(len(of), along), origin[of] * TILE + at, n[found]))
        of, axis, pos, n = (np.concatenate(k) for k in zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([t.column(KEY).combine_chunks().take(pa.array(of)), pa.array(axis, pa.string()), pa.array(pos, pa.int64()), pa.array(n, pa.int64())], [KEY, "axis", "pos", "n"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= HELD_BYTES:
                t = pa.Table.from_batches(held)
                new = _starts(t)
                cut = int(np.flatnonzero(new)[-1])  # the last tile may go on
                if cut:
                    yield counted(t.slice(0, cut), new[:cut])
                    t = t.slice(cut)
                held, size = t.to_batches(), 0
        if held:
            t = pa.Table.from_batches(held)
            if len(t):
                yield counted(t, _starts(t))

    tile = [KEY, "tx", "ty"]
    long = T.LongType()
    schema = T.StructType([pixels.schema[KEY], T.StructField("axis", T.StringType()), T.StructField("pos", long), T.StructField("n", long)])
    found = tiles.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(run, schema)
    return found.groupBy(KEY, "axis", F.col("pos").cast("int").alias("pos")).agg(F.sum("n").alias("n"))


def _starts(t: pa.Table) -> np.ndarray:
    """Where a tile begins among rows in their order."""
    new = np.ones(len(t), bool)
    columns = [t.column(c).combine_chunks() for c in (KEY, "tx", "ty")]
    new[1:] = np.any([pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in columns], axis=0)
    return new


def edges(pixels: DataFrame, size: DataFrame | None = None) -> DataFrame:
    """(image_id, axis, pos): places where neighbours, both opaque, differ by more than EDGE in sum; rows and columns are
    sampled so that about SAMPLED of each are looked at."""
    return edge_counts(pixels, size).select(KEY, "axis", "pos", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).drop("k")


def periods(edge_rows: DataFrame, keys: list[str], pos: str = "pos", n: str | None = None) -> DataFrame:
    """(keys, period): the largest period for which one phase holds most edges; 1 when none does or edges are few. ``n`` names
    the column of how many edges a row stands for. A key's places are counted first, modulo a multiple of all periods."""
    counts = edge_rows.groupBy(*keys, (F.col(pos) % math.lcm(*range(2, MAX_PERIOD + 1))).cast("long").alias("_pos")).agg((F.sum(n) if n else F.count("*")).cast("long").alias("_n"))
    lists = counts.groupBy(*keys).agg(F.collect_list(F.struct("_pos", "_n")).alias("_at"))

    def run(batches):
        for b in batches:
            at, rows = b.column(b.num_columns - 1), len(b)
            row = np.repeat(np.arange(rows), np.diff(at.offsets.to_numpy()))
            flat = at.flatten()
            null = flat.field(0).is_null().to_numpy(zero_copy_only=False)
            place, n = flat.field(0).fill_null(0).to_numpy(), flat.field(1).to_numpy()
            total, period = np.bincount(row, n, rows), np.ones(rows, np.int32)
            for s in range(2, MAX_PERIOD + 1):
                phase = np.where(null, 0, np.fmod(place, s) + s)  # a place before zero has a phase before zero
                best = np.bincount(row * 2 * s + phase, n, rows * 2 * s).reshape(rows, 2 * s).max(1)
                period[(total >= MIN_EDGES) & (best >= PHASE_SHARE * total)] = s
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(period)], [*keys, "period"])

    return lists.mapInArrow(run, T.StructType([*(lists.schema[k] for k in keys), T.StructField("period", T.IntegerType())]))


def pixel_scale(pixels: DataFrame) -> DataFrame:
    """(image_id, sx, sy)."""
    p = periods(edge_counts(pixels), [KEY, "axis"], n="n")
    both = p.groupBy(KEY).agg(F.max(F.when(F.col("axis") == "x", F.col("period"))).alias("sx"), F.max(F.when(F.col("axis") == "y", F.col("period"))).alias("sy"))
    return pixels.select(KEY).distinct().join(both, KEY, "left").select(KEY, F.coalesce("sx", F.lit(1)).alias("sx"), F.coalesce("sy", F.lit(1)).alias("sy"))


# ---------------------------------------------------------------- palettes


def nearest_color(colors: DataFrame, palette: DataFrame, array_entries: int = SWATCH_CAP) -> DataFrame:
    """Adds (pr, pg, pb, idx): the entry of palette (idx, r, g, b) with the smallest squared distance, the lowest index of
    equally near ones; nothing for an empty palette. A palette of up to ``array_entries`` travels as one array of one row that
    distinct colours look through; a larger one is searched in a grid, so that a colour meets the entries around it."""
    if palette.limit(array_entries + 1).count() > array_entries:
        entries = palette.groupBy("r", "g", "b").agg(F.min("idx").alias("idx"))
        near = space.nearest_in_grid(colors, entries, []).withColumnsRenamed({c: f"_{c}" for c in "rgb"})
        return colors.join(near, [F.col(c) == F.col(f"_{c}") for c in "rgb"]).select(*colors.columns, "pr", "pg", "pb", "idx")
    entries = palette.agg(F.array_sort(F.collect_list(F.struct("idx", *(F.col(c).cast("int").alias(f"p{c}") for c in "rgb")))).alias("_p")).where(F.size("_p") > 0)
    ranked = F.array_min(F.transform("_p", lambda p: F.struct(space.squared(F.col, lambda c: p[f"p{c}"]).alias("d"), p["idx"].alias("idx"), p["pr"].alias("pr"), p["pg"].alias("pg"), p["pb"].alias("pb"))))
    return colors.crossJoin(F.broadcast(entries)).withColumn("_n", ranked).select(*colors.columns, "_n.pr", "_n.pg", "_n.pb", "_n.idx")


def remap(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """Every pixel that isn't wholly transparent takes its nearest palette colour. Distinct colours are solved once."""
    near = nearest_color(pixels.where("a <> 0").select("r", "g", "b").distinct(), palette)
    out = pixels.join(near, ["r", "g", "b"], "left")
    return out.select(KEY, "x", "y", *(F.when(F.col("a") != 0, F.col(f"p{c}")).otherwise(F.col(c)).cast("int").alias(c) for c in "rgb"), "a")


def reduce_to(pixels: DataFrame, n: int) -> DataFrame:
    """Each image with at most n colours: its opaque colours are cut, and its pixels take the nearest of them."""
    reduced = median_cut(distinct_opaque(pixels), n).groupBy(KEY).agg(F.array_sort(F.collect_list(_rgb())).alias("_p"))
    colours = pixels.where("a <> 0").select(KEY, "r", "g", "b").distinct().join(reduced, KEY)

    def dist(p: Column) -> Column:
        return sum(((F.col(c) - p[c]) * (F.col(c) - p[c]) for c in "rgb"), F.lit(0))

    best = F.array_min(F.transform("_p", lambda p, i: F.struct(dist(p).alias("d"), i.alias("i"), p.alias("c"))))
    near = colours.select(KEY, "r", "g", "b", best["c"].alias("_n"))
    out = pixels.join(near, [KEY, "r", "g", "b"], "left")
    return out.select(KEY, "x", "y", *(F.coalesce(F.col(f"_n.{c}"), F.col(c)).cast("int").alias(c) for c in "rgb"), "a")


#: Distinct colours of a palette up to which each is compared with all others in one row.
ROW_COLOURS = 256


def palette_spacing(palette: DataFrame, key: str = "palette_id", row_colours: int = ROW_COLOURS) -> DataFrame:
    """(key, spacing): the upper median of squared distances to the nearest other colour; 20000 for fewer than two. A colour
    that occurs twice has distance 0. Small palettes are solved in a row each, larger ones in a grid of colour cells; the
    median comes from counts of distances."""
    colours = written(palette.groupBy(key, "r", "g", "b").agg(F.count("*").alias("n")))
    sizes = colours.groupBy(key).agg(F.count("*").alias("_k"), F.sum("n").alias("_total"))
    small = colours.join(sizes.where(F.col("_k") <= row_colours).select(key), key).groupBy(key).agg(F.collect_list(F.struct("r", "g", "b", "n")).alias("p"))
    others = F.transform("p", lambda a: F.struct(a["n"].alias("n"), F.array_min(F.transform(F.filter("p", lambda b: (b["r"] != a["r"]) | (b["g"] != a["g"]) | (b["b"] != a["b"])), lambda b: space.squared(lambda c: a[c], lambda c: b[c]).cast("bigint"))).alias("d")))
    near = small.select(key, F.explode(others).alias("o")).select(key, "o.n", F.when(F.col("o.n") > 1, 0).otherwise(F.col("o.d")).alias("d"))
    large = colours.join(sizes.where(F.col("_k") > row_colours).select(key), key)
    if large.limit(1).count():
        found = space.nearest_in_grid(large.where("n = 1"), large.withColumn("idx", F.lit(0)), [key], other=True).select(key, F.lit(1).cast("bigint").alias("n"), "d")
        near = near.unionByName(found).unionByName(large.where("n > 1").select(key, "n", F.lit(0).cast("bigint").alias("d")))
    counts = near.groupBy(key, "d").agg(F.sum("n").alias("_m")).withColumn("_upto", F.sum("_m").over(Window.partitionBy(key).orderBy("d")))  # distances are below 195,076
    median = counts.join(sizes, key).where("_upto > _total div 2 AND _upto - _m <= _total div 2").select(key, F.col("d").cast("double").alias("_d"))
    return sizes.join(median, key, "left").select(key, F.when(F.col("_total") < 2, F.lit(20_000.0)).otherwise(F.col("_d")).alias("spacing"))


def image_diff(a: DataFrame, b: DataFrame, tol: int, keys: tuple = (KEY, "x", "y")) -> DataFrame:
    """(image_id, differing, pixels): places where any channel differs by more than tol, or that one image lacks."""
    left = a.select(*keys, *(F.col(c).alias(f"a_{c}") for c in "rgba"))
    right = b.select(*keys, *(F.col(c).alias(f"b_{c}") for c in "rgba"))
    delta = F.greatest(*(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in "rgba"))
    differs = F.col("a_r").isNull() | F.col("b_r").isNull() | (delta > tol)
    return left.join(right, list(keys), "full").groupBy(KEY).agg(F.sum(F.when(differs, 1).otherwise(0)).cast("bigint").alias("differing"), F.count("*").alias("pixels"))


def expand_indexed(idx: DataFrame, palette: DataFrame) -> DataFrame:
    """Pixels (image_id, x, y, idx) as colours; an index beyond the palette is opaque black."""
    out = idx.join(palette, [KEY, "idx"], "left")
    return out.select(KEY, "x", "y", *(F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in "rgb"), F.coalesce("a", F.lit(255)).cast("int").alias("a"))


def image_features(pixels: DataFrame) -> DataFrame:
    """(image_id, src_w, src_h, colors, palette)."""
    size = sizes(pixels).select(KEY, F.col("w").alias("src_w"), F.col("h").alias("src_h"))
    return size.join(color_counts(pixels), KEY).join(extract_palette(pixels), KEY)


# ---------------------------------------------------------------- dither and expansion


def threshold_matrix(n: int) -> list[list[int]]:
    """The ordered thresholds of n x n, n a power of two: four copies of the half one times four, moved by 0, 2, 3 and 1."""
    if n == 1:
        return [[0]]
    half = [[4 * v for v in row] for row in threshold_matrix(n // 2)]
    return [[v + a for v in row] + [v + b for v in row] for a, b in ((0, 2), (3, 1)) for row in half]


def ordered_dither(pixels: DataFrame, matrix: list[list[int]], amount: float, scale: tuple[int, int] = (1, 1)) -> DataFrame:
    """Every opaque pixel moved by the threshold of its place, so that a later reduction breaks into a stable pattern: an
    expression of x and y, no step between pixels. A cell of the matrix spans ``scale`` pixels; no amount, no change."""
    n = len(matrix)
    if amount <= 0:
        return pixels
    sx, sy = (max(s, 1) for s in scale)
    cell = F.expr(f"(y div {sy} % {n}) * {n} + x div {sx} % {n}").cast("int")
    bias = [int((v / (n * n) - 0.5) * amount * 64) for row in matrix for v in row]
    moved = F.get(F.array(*map(F.lit, bias)), cell)
    return pixels.select(KEY, "x", "y", *(F.when(F.col("a") == 255, F.least(F.greatest(F.col(c) + moved, F.lit(0)), F.lit(255))).otherwise(F.col(c)).cast("int").alias(c) for c in "rgb"), "a")


def expanded(pixels: DataFrame, factor: int) -> DataFrame:
    """Images at twice or three times their size by the neighbour rules: a pixel's corner takes a neighbour's colour where two
    neighbours agree and those across from them don't. Places outside an image are as the nearest place in it.

    The nine pixels around each come from two windows, one along rows and one along columns of rows of three, so that a large
    image is spread by its rows and columns."""
    if factor not in (2, 3):
        raise ValueError("factor is 2 or 3")
    e = F.struct("r", "g", "b", "a")
    along, down = Window.partitionBy(KEY, "y").orderBy("x"), Window.partitionBy(KEY, "x").orderBy("y")
    px = pixels.select(KEY, "x", "y", e.alias("e"))
    px = px.select(KEY, "x", "y", F.struct(F.coalesce(F.lag("e").over(along), "e").alias("l"), F.col("e").alias("m"), F.coalesce(F.lead("e").over(along), "e").alias("r")).alias("row"))
    px = px.select(KEY, "x", "y", F.coalesce(F.lag("row").over(down), "row").alias("up"), "row", F.coalesce(F.lead("row").over(down), "row").alias("low"))
    px = px.select(KEY, "x", "y", *(F.col(f"{row}.{side}").alias(name) for name, row, side in (("A", "up", "l"), ("B", "up", "m"), ("C", "up", "r"), ("D", "row", "l"), ("E", "row", "m"), ("F", "row", "r"), ("G", "low", "l"), ("H", "low", "m"), ("I", "low", "r"))))
    edge = "B <> H AND D <> F"
    corner = {"nw": "D = B", "ne": "B = F", "sw": "D = H", "se": "H = F"}
    rule = lambda test, colour: F.expr(f"CASE WHEN {edge} AND ({test}) THEN {colour} ELSE E END")
    nw, ne, sw, se = rule(corner["nw"], "D"), rule(corner["ne"], "F"), rule(corner["sw"], "D"), rule(corner["se"], "F")
    if factor == 2:
        cell = [nw, ne, sw, se]
    else:
        side = lambda a, far, b, near, colour: rule(f"({corner[a]} AND E <> {far}) OR ({corner[b]} AND E <> {near})", colour)
        cell = [nw, side("nw", "C", "ne", "A", "B"), ne, side("nw", "G", "sw", "A", "D"), F.col("E"), side("ne", "I", "se", "C", "F"), sw, side("sw", "I", "se", "G", "H"), se]
    out = px.select(KEY, "x", "y", F.posexplode(F.array(*cell)).alias("k", "p"))
    return out.select(KEY, F.expr(f"x * {factor} + k % {factor}").cast("int").alias("x"), F.expr(f"y * {factor} + k div {factor}").cast("int").alias("y"), "p.*")
