"""Queries of image features (A5-A9, A13, A17, W11, J15, J16, P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pixels as P
from .base import PIXELS, flat_pixels, pixels, query, spread, table

D2 = "(c.r - p.r) * (c.r - p.r) + (c.g - p.g) * (c.g - p.g) + (c.b - p.b) * (c.b - p.b)"


@query("a05_color_counts", f"WITH {PIXELS} SELECT image_id, count(DISTINCT (r, g, b)) FILTER (WHERE a = 255) AS colors FROM flat GROUP BY image_id")
def a05(spark, d):
    return P.color_counts(flat_pixels(spark, d))


@query("a06_extract_palette", f"WITH {PIXELS}, c AS (SELECT DISTINCT image_id, r, g, b FROM flat WHERE a = 255), n AS (SELECT image_id, count(*) AS n FROM c GROUP BY 1) SELECT i.image_id, CASE WHEN n.n IS NULL THEN '' ELSE (SELECT string_agg(r||'.'||g||'.'||b, ' ' ORDER BY r, g, b) FROM c WHERE c.image_id = i.image_id) END AS palette FROM (SELECT DISTINCT image_id FROM flat) i LEFT JOIN n ON n.image_id = i.image_id WHERE coalesce(n.n, 0) <= 14 UNION ALL SELECT image_id, NULL FROM n WHERE n > 14")
def a06(spark, d):
    p = P.extract_palette(flat_pixels(spark, d), swatches=14)
    return p.select("image_id", F.when(F.col("palette").isNotNull(), F.array_join(F.transform("palette", lambda c: F.concat_ws(".", c["r"], c["g"], c["b"])), " ")).alias("palette"))


@query("a07_distinct_opaque", f"WITH {PIXELS} SELECT DISTINCT image_id, r, g, b FROM px WHERE a = 255")
def a07(spark, d):
    return P.distinct_opaque(pixels(spark, d))


#: Median cut to four colours, a step of the recursion for each halving; boxes are lists of colours in their order.
CUT = f"""c AS (SELECT DISTINCT image_id, r, g, b FROM px WHERE a = 255),
cut(image_id, k, boxes) AS (SELECT image_id, 1, [list(struct_pack(r := r, g := g, b := b) ORDER BY r, g, b)] FROM c GROUP BY image_id
 UNION ALL SELECT image_id, k + 1, list_concat(rest, [sorted[1:len(sorted) // 2], sorted[len(sorted) // 2 + 1:]]) FROM (
 SELECT image_id, k, CASE WHEN idx = len(boxes) THEN boxes[1:idx - 1] ELSE list_concat(list_concat(boxes[1:idx - 1], [boxes[len(boxes)]]), boxes[idx + 1:len(boxes) - 1]) END AS rest,
  list_transform(list_sort(list_transform(range(1, len(box) + 1), lambda i: struct_pack(v := CASE WHEN sb >= greatest(sr, sg) THEN box[i].b WHEN sg >= sr THEN box[i].g ELSE box[i].r END, i := i))), lambda x: box[x.i]) AS sorted FROM (
 SELECT *, {", ".join(f"list_max(list_transform(box, lambda q: q.{x})) - list_min(list_transform(box, lambda q: q.{x})) AS s{x}" for x in "rgb")} FROM (
 SELECT *, boxes[idx] AS box FROM (
 SELECT *, len(w) + 1 - list_position(list_reverse(w), list_max(w)) AS idx FROM (
 SELECT *, list_transform(boxes, lambda x: CASE WHEN len(x) > 1 THEN greatest({", ".join(f"list_max(list_transform(x, lambda q: q.{y})) - list_min(list_transform(x, lambda q: q.{y}))" for y in "rgb")}) ELSE -1 END) AS w FROM cut WHERE k < 4) WHERE list_max(w) >= 0))))),
ends AS (SELECT image_id, unnest(arg_max(boxes, k)) AS box FROM cut GROUP BY image_id),
reduced AS (SELECT DISTINCT image_id, {", ".join(f"CAST(list_sum(list_transform(box, lambda q: q.{x})) // len(box) AS INTEGER) AS {x}" for x in "rgb")} FROM ends)"""


@query("a08_median_cut", f"WITH RECURSIVE {PIXELS}, {CUT} SELECT * FROM reduced")
def a08(spark, d):
    return P.median_cut(P.distinct_opaque(pixels(spark, d)), 4)


@query("a09_downscale", f"WITH {PIXELS} SELECT image_id, x // 2 AS x, y // 2 AS y, CASE WHEN sum(a) > 0 THEN CAST(sum(r * a) // sum(a) AS BIGINT) ELSE 0 END AS r, CASE WHEN sum(a) > 0 THEN CAST(sum(g * a) // sum(a) AS BIGINT) ELSE 0 END AS g, CASE WHEN sum(a) > 0 THEN CAST(sum(b * a) // sum(a) AS BIGINT) ELSE 0 END AS b, CAST(sum(a) // count(*) AS BIGINT) AS a FROM px GROUP BY 1, 2, 3")
def a09(spark, d):
    return P.downscale(pixels(spark, d), 2).select("image_id", *(F.col(c).cast("bigint").alias(c) for c in "xyrgba"))


@query("a13_palette_spacing", f"WITH {PIXELS}, p AS (SELECT image_id AS palette_id, y * 4 + x AS idx, r, g, b FROM px), n AS (SELECT c.palette_id, c.idx, min({D2}) AS d FROM p c JOIN p ON p.palette_id = c.palette_id AND p.idx <> c.idx GROUP BY 1, 2), o AS (SELECT palette_id, d, row_number() OVER (PARTITION BY palette_id ORDER BY d) AS k, count(*) OVER (PARTITION BY palette_id) AS n FROM n) SELECT i.palette_id, coalesce(CAST(o.d AS DOUBLE), 20000.0) AS spacing FROM (SELECT DISTINCT palette_id FROM p) i LEFT JOIN o ON o.palette_id = i.palette_id AND o.k = o.n // 2 + 1")
def a13(spark, d):
    return P.palette_spacing(pixels(spark, d).select(F.col("image_id").alias("palette_id"), (F.col("y") * 4 + F.col("x")).alias("idx"), "r", "g", "b"))


PERIOD = "WITH e AS (SELECT {0} AS id, {1} AS pos FROM {2}), s AS (SELECT unnest(range(2, 17)) AS s), b AS (SELECT id, s, pos % s AS ph, count(*) AS n FROM e, s GROUP BY 1, 2, 3), m AS (SELECT id, s, max(n) AS best, sum(n) AS total FROM b GROUP BY 1, 2) SELECT id, CAST(coalesce(max(s) FILTER (WHERE total >= 16 AND best >= 0.8 * total), 1) AS INTEGER) AS period FROM m GROUP BY id"


@query("a17_periods", PERIOD.format("l_suppkey % 40", "CASE WHEN l_orderkey % 9 = 0 THEN l_orderkey % 97 ELSE l_orderkey % 31 * (2 + l_suppkey % 40 % 9) END", "lineitem"))
def a17(spark, d):
    li = table(spark, d, "lineitem")
    k = F.col("l_suppkey") % 40
    pos = F.when(F.col("l_orderkey") % 9 == 0, F.col("l_orderkey") % 97).otherwise(F.col("l_orderkey") % 31 * (2 + k % 9))
    return P.periods(li.select(k.alias("id"), pos.alias("pos")), ["id"])


GRID = """cell AS (SELECT p_partkey AS image_id, x, y, x // (1 + p_partkey % 4) AS u, y // (1 + p_size % 3) AS v, p_partkey AS k FROM part, (SELECT unnest(range(24)) AS x), (SELECT unnest(range(24)) AS y)),
g AS (SELECT image_id, x, y, (u * 67 + v * 131 + k * 29) % 256 AS r, (u * v * 41 + k) % 256 AS g, (u * 89 + v * 17) % 256 AS b FROM cell),
edge AS (SELECT a.image_id * 2 AS id, a.x AS pos FROM g a JOIN g b ON a.image_id = b.image_id AND a.y = b.y AND a.x = b.x + 1 WHERE abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b) > 24
 UNION ALL SELECT a.image_id * 2 + 1, a.y FROM g a JOIN g b ON a.image_id = b.image_id AND a.x = b.x AND a.y = b.y + 1 WHERE abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b) > 24)"""


def blown_up(spark, d):
    """Images of 24 x 24 pixels, one for each part, drawn in larger cells of one to four by one to three pixels."""
    p = spread(table(spark, d, "part")).select(F.col("p_partkey").alias("image_id"), (F.col("p_partkey") % 4 + 1).alias("s"), (F.col("p_size") % 3 + 1).alias("t"))
    px = p.select("image_id", "s", "t", F.explode(F.sequence(F.lit(0), F.lit(575))).alias("n")).select("image_id", (F.col("n") % 24).alias("x"), F.expr("cast(n div 24 as int)").alias("y"), F.expr("(n % 24) div s").alias("u"), F.expr("(n div 24) div t").alias("v"))
    k = F.col("image_id")
    r, g, b = (F.col("u") * 67 + F.col("v") * 131 + k * 29) % 256, (F.col("u") * F.col("v") * 41 + k) % 256, (F.col("u") * 89 + F.col("v") * 17) % 256
    return px.select("image_id", "x", "y", *(c.cast("int").alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"))), F.lit(255).alias("a"))


@query("a17_pixel_scale", PERIOD.format("id", "pos", "edge").replace("WITH ", f"WITH {GRID}, ", 1).replace("SELECT id, CAST", "SELECT p_partkey AS image_id, coalesce(max(period) FILTER (WHERE id % 2 = 0), 1) AS sx, coalesce(max(period) FILTER (WHERE id % 2 = 1), 1) AS sy FROM part LEFT JOIN (SELECT id, CAST", 1) + ") ON id // 2 = p_partkey GROUP BY 1")
def a17_images(spark, d):
    return P.pixel_scale(blown_up(spark, d))


EDGE = "abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b) > 24 AND a.a = 255 AND b.a = 255"


@query("w11_edges", f"WITH {PIXELS} SELECT a.image_id, 'x' AS axis, a.x AS pos, count(*) AS n FROM px a JOIN px b ON a.image_id = b.image_id AND a.y = b.y AND a.x = b.x + 1 WHERE {EDGE} GROUP BY 1, 3 UNION ALL SELECT a.image_id, 'y', a.y, count(*) FROM px a JOIN px b ON a.image_id = b.image_id AND a.x = b.x AND a.y = b.y + 1 WHERE {EDGE} GROUP BY 1, 3")
def w11(spark, d):
    return P.edge_counts(pixels(spark, d)).select("image_id", "axis", "pos", "n")


def palette(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("idx"), *((F.col("n_nationkey") * k % 256).alias(c) for k, c in ((37, "r"), (91, "g"), (53, "b"))))


NEAR = f"pal AS (SELECT n_nationkey AS idx, n_nationkey * 37 % 256 AS r, n_nationkey * 91 % 256 AS g, n_nationkey * 53 % 256 AS b FROM nation), cols AS (SELECT DISTINCT r, g, b FROM px WHERE a <> 0), near AS (SELECT c.r, c.g, c.b, arg_min(p.idx, ({D2}) * 1000 + p.idx) AS idx FROM cols c, pal p GROUP BY 1, 2, 3)"


@query("j15_nearest_color", f"WITH {PIXELS}, {NEAR} SELECT r, g, b, idx FROM near")
def j15(spark, d):
    return P.nearest_color(pixels(spark, d).where("a <> 0").select("r", "g", "b").distinct(), palette(spark, d)).select("r", "g", "b", "idx")


@query("j16_image_diff", f"WITH {PIXELS}, b AS (SELECT image_id - 1 AS image_id, x, y, r, g, b, a FROM px WHERE (x + y + image_id) % 7 > 0) SELECT coalesce(a.image_id, b.image_id) AS image_id, CAST(count(*) FILTER (WHERE a.r IS NULL OR b.r IS NULL OR greatest(abs(a.r - b.r), abs(a.g - b.g), abs(a.b - b.b), abs(a.a - b.a)) > 40) AS BIGINT) AS differing, count(*) AS pixels FROM px a FULL JOIN b ON a.image_id = b.image_id AND a.x = b.x AND a.y = b.y GROUP BY 1")
def j16(spark, d):
    px = pixels(spark, d)
    other = px.where("(x + y + image_id) % 7 > 0").withColumn("image_id", F.col("image_id") - 1)
    return P.image_diff(px, other, 40)


@query("p01_expand_indexed", f"WITH {PIXELS}, idx AS (SELECT image_id, x, y, r % 32 AS idx FROM px) SELECT i.image_id, i.x, i.y, coalesce(p.r, 0) AS r, coalesce(p.g, 0) AS g, coalesce(p.b, 0) AS b, 255 AS a FROM idx i LEFT JOIN px p ON p.image_id = i.image_id AND p.y * 4 + p.x = i.idx")
def p01(spark, d):
    px = pixels(spark, d)
    pal = px.select("image_id", (F.col("y") * 4 + F.col("x")).alias("idx"), "r", "g", "b", F.lit(255).alias("a"))
    return P.expand_indexed(px.select("image_id", "x", "y", (F.col("r") % 32).alias("idx")), pal)


@query("p02_remap", f"WITH {PIXELS}, {NEAR} SELECT x.image_id, x.x, x.y, p.r, p.g, p.b, x.a FROM px x JOIN near n ON n.r = x.r AND n.g = x.g AND n.b = x.b JOIN pal p ON p.idx = n.idx")
def p02(spark, d):
    return P.remap(pixels(spark, d), palette(spark, d))


@query("p03_reduce_to", f"WITH RECURSIVE {PIXELS}, {CUT}, n AS (SELECT c.image_id, c.r, c.g, c.b, arg_min(struct_pack(r := p.r, g := p.g, b := p.b), struct_pack(d := {D2}, r := p.r, g := p.g, b := p.b)) AS q FROM (SELECT DISTINCT image_id, r, g, b FROM px WHERE a <> 0) c JOIN reduced p ON p.image_id = c.image_id GROUP BY 1, 2, 3, 4) SELECT x.image_id, x.x, x.y, CAST(coalesce(n.q.r, x.r) AS INTEGER) AS r, CAST(coalesce(n.q.g, x.g) AS INTEGER) AS g, CAST(coalesce(n.q.b, x.b) AS INTEGER) AS b, x.a FROM px x LEFT JOIN n ON n.image_id = x.image_id AND n.r = x.r AND n.g = x.g AND n.b = x.b")
def p03(spark, d):
    return P.reduce_to(pixels(spark, d), 4)


@query("p04_image_features", f"WITH {PIXELS} SELECT image_id, CAST(max(x) + 1 AS INTEGER) AS src_w, CAST(max(y) + 1 AS INTEGER) AS src_h, count(DISTINCT (r, g, b)) FILTER (WHERE a = 255) AS colors, count(DISTINCT (r, g, b)) FILTER (WHERE a = 255) AS swatches FROM px GROUP BY image_id")
def p04(spark, d):
    return P.image_features(pixels(spark, d)).withColumn("swatches", F.size("palette").cast("bigint")).drop("palette")


BAYER4 = "[0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5]"


@query("p05_ordered_dither", f"WITH {PIXELS}, m AS (SELECT *, CAST(trunc((({BAYER4})[1 + (y // 1) % 4 * 4 + (x // 2) % 4] / 16.0 - 0.5) * 32) AS INTEGER) AS v FROM px) SELECT image_id, x, y, {', '.join(f'CAST(CASE WHEN a = 255 THEN least(greatest({c} + v, 0), 255) ELSE {c} END AS INTEGER) AS {c}' for c in 'rgb')}, a FROM m")
def p05(spark, d):
    return P.ordered_dither(pixels(spark, d), P.threshold_matrix(4), 0.5, (2, 1))


def around(factor: int, cell: str) -> str:
    """SQL of the nine pixels around each, by joins on places kept within the image, and of the cell that they make."""
    names = {"A": (-1, -1), "B": (0, -1), "C": (1, -1), "D": (-1, 0), "E": (0, 0), "F": (1, 0), "G": (-1, 1), "H": (0, 1), "I": (1, 1)}
    joins = " ".join(f"JOIN v {n} ON {n}.image_id = p.image_id AND {n}.x = least(greatest(p.x + {dx}, 0), 3) AND {n}.y = least(greatest(p.y + {dy}, 0), 3)" for n, (dx, dy) in names.items())
    k = f"WITH {PIXELS}, coarse AS (SELECT image_id, x, y, r - r % 128 AS r, g - g % 128 AS g, 0 AS b, 255 AS a FROM px), v AS (SELECT image_id, x, y, struct_pack(r := r, g := g, b := b, a := a) AS c FROM coarse), n AS (SELECT p.image_id, p.x, p.y, {', '.join(f'{n}.c AS {n}' for n in names)} FROM v p {joins}), o AS (SELECT image_id, x, y, [{cell}] AS cell FROM n), u AS (SELECT image_id, x, y, unnest(cell) AS q, generate_subscripts(cell, 1) - 1 AS k FROM o)"
    return f"{k} SELECT image_id, CAST(x * {factor} + k % {factor} AS INTEGER) AS x, CAST(y * {factor} + k // {factor} AS INTEGER) AS y, q.r AS r, q.g AS g, q.b AS b, q.a AS a FROM u"


def _take(test: str, colour: str) -> str:
    return f"CASE WHEN B <> H AND D <> F AND ({test}) THEN {colour} ELSE E END"


TWO = ", ".join(_take(t, c) for t, c in (("D = B", "D"), ("B = F", "F"), ("D = H", "D"), ("H = F", "F")))
THREE = ", ".join([_take("D = B", "D"), _take("(D = B AND E <> C) OR (B = F AND E <> A)", "B"), _take("B = F", "F"), _take("(D = B AND E <> G) OR (D = H AND E <> A)", "D"), "E", _take("(B = F AND E <> I) OR (H = F AND E <> C)", "F"), _take("D = H", "D"), _take("(D = H AND E <> I) OR (H = F AND E <> G)", "H"), _take("H = F", "F")])


def coarse(spark, d):
    """Pixels of two levels in two channels, so that neighbours agree."""
    return pixels(spark, d).select("image_id", "x", "y", *((F.col(c) - F.col(c) % 128).alias(c) for c in "rg"), F.lit(0).alias("b"), F.lit(255).alias("a"))


@query("p06_expand_twice", around(2, TWO))
def p06(spark, d):
    return P.expanded(coarse(spark, d), 2)


@query("p07_expand_thrice", around(3, THREE))
def p07(spark, d):
    return P.expanded(coarse(spark, d), 3)
