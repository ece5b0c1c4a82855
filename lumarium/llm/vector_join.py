"""Embedding near-duplicates by a subspace pigeonhole join.

For unit vectors, cosine >= t means a squared distance of at most 2 - 2t. A fixed random rotation spreads that distance
over all dimensions; the rotated vectors are cut into low-dimensional blocks, and each block gets a share of the squared
distance in proportion to its dimensions. At least one block of any linked pair is within its share, so a range join in
each block finds every pair. The range join uses a grid over up to five coordinates of the block, with cells as wide as its
radius, and within each cell a sorted list by one more: a vector is compared only with what lies in its own or a
neighbouring cell within the radius by the sorted coordinate. Pairs within the block's share are verified, by the cosine in
double precision, only in the first block that admits them, so the union needs no distinct.

Vectors of one label meet in one task when they fit it (``task_values`` numbers). Larger labels are dealt out by coarse
cells of one to three coordinates of each block, every vector going to its own cell and to the neighbours on one side. A
cell that is still crowded, as one of very many near copies, is split by hash, part against part. Equal vectors count once
with their number; each task sends one row per vector: its links there and a link that keeps it together with its component.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

COSINE, BLOCKS, TASK_VALUES = 0.98, 8, 1 << 21
#: Coordinates of the grid within a task; most cells along one of them, and pairs that are compared at once.
GRID, MOST_CELLS, PAIRS_AT_ONCE = 5, 60, 1 << 19


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(20_011 + d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def block_cuts(d: int, blocks: int = BLOCKS) -> np.ndarray:
    return np.linspace(0, d, min(blocks, d) + 1).astype(int)


def budgets(d: int, cosine: float, blocks: int) -> np.ndarray:
    """Squared distance that each block may have, with room for rounding."""
    return max(2 - 2 * cosine, 1e-9) * np.diff(block_cuts(d, blocks)) / d * (1 + 1e-9) + 1e-12


def unit(packed: pa.Array, d: int) -> np.ndarray:
    """Unit vectors from binary ones of d numbers of 4 or 8 bytes. Dividing by the largest number first keeps squares finite."""
    packed = packed.combine_chunks() if isinstance(packed, pa.ChunkedArray) else packed
    data = b"".join(packed.to_pylist())
    raw = np.frombuffer(data, np.float32 if len(data) == 4 * d * len(packed) else np.float64).reshape(-1, d).astype(np.float64)
    raw /= np.abs(raw).max(1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


# ---------------------------------------------------------------- range join in a block


def near_pairs(left: np.ndarray, right: np.ndarray | None, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i of left, j of right) of points that may be within the radius, in portions, each pair once; without ``right``
    the pairs i < j or j < i of left itself."""
    within = right is None
    right = left if within else right
    m = left.shape[1]
    g = min(GRID, m - 1)
    width = max(radius * (1 + 1e-9), 2 / MOST_CELLS)
    shift = (np.uint64(6) * np.arange(g, dtype=np.uint64))[None, :]

    def keys(y):
        cell = np.floor((np.clip(y[:, 1 : g + 1], -1, 1) + 1) / width).astype(np.uint64) + np.uint64(1)
        return (cell << shift).sum(1, dtype=np.uint64), ((np.clip(y[:, 0], -1, 1) + 1) * 2**31).astype(np.int64)

    (cell_l, at_l), (cell_r, at_r) = keys(left), keys(right)
    full = (cell_r << np.uint64(33)) | at_r.astype(np.uint64)
    order = np.argsort(full, kind="stable")
    full = full[order]
    own = np.arange(len(left))
    if within:
        own, cell_l, at_l = order, cell_l[order], at_l[order]
    reach = int(np.ceil(radius * (1 + 1e-9) * 2**31)) + 2
    low, high = np.maximum(at_l - reach, 0).astype(np.uint64), np.minimum(at_l + reach, 2**33 - 1).astype(np.uint64)
    zero = (0,) * g
    for step in itertools.product((-1, 0, 1), repeat=g):
        if within and step < zero:
            continue
        move = sum(s << (6 * k) for k, s in enumerate(step))
        base = (cell_l + np.uint64(move % 2**64)) << np.uint64(33)
        hi = np.searchsorted(full, base | high, "right")
        # in a point's own cell only those after it, so that a pair comes once
        lo = np.arange(1, len(left) + 1) if within and step == zero else np.searchsorted(full, base | low)
        count = np.maximum(hi - lo, 0)
        some = np.flatnonzero(count)
        ends = np.cumsum(count[some])
        a = 0
        while a < len(some):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS_AT_ONCE, "right")))
            part = some[a:b]
            yield np.repeat(own[part], count[part]), order[C.ranges(lo[part], count[part])]
            a = b


def linked_pairs(x: np.ndarray, left: np.ndarray, right: np.ndarray | None, some: range, cosine: float, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of x (one of left, one of right, or both of left) whose cosine reaches the threshold and which one of
    the blocks ``some`` is the first to admit."""
    d = x.shape[1]
    y, cuts, budget = x @ rotation(d), block_cuts(d, blocks), budgets(d, cosine, blocks)
    for block in some:
        z = y[:, cuts[block] : cuts[block + 1]]
        for i, j in near_pairs(z[left], None if right is None else z[right], float(np.sqrt(budget[block]))):
            i, j = left[i], (left if right is None else right)[j]
            diff = z[i] - z[j]
            keep = (diff * diff).sum(1) <= budget[block]
            i, j = i[keep], j[keep]
            for b in range(block):  # the first block that admits a pair has it
                if len(i):
                    diff = y[i, cuts[b] : cuts[b + 1]] - y[j, cuts[b] : cuts[b + 1]]
                    keep = (diff * diff).sum(1) > budget[b]
                    i, j = i[keep], j[keep]
            keep = (x[i] * x[j]).sum(1) >= cosine
            yield i[keep], j[keep]


# ---------------------------------------------------------------- dealing out


def task_rows(d: int, task_values: int) -> int:
    return max(2, task_values // d)


def coarse_coordinates(n: int, limit: int) -> int:
    """How many coordinates of a block deal out n vectors; none when they fit one task."""
    k = 0
    while k < 3 and n > limit * 4**k:
        k += 1
    return k


def _dealt(reps: DataFrame, cosine: float, blocks: int, task_values: int) -> DataFrame:
    """One row for each coarse cell in which a vector takes part: (grp, d, block, cell, side, key, n, v), side 0 in its own
    cell and 1 in a neighbour below. Block -1 is all blocks at once, for labels that fit one task."""

    def run(batches):
        for b in batches:
            grp, d, size, key, n, v = b.columns
            dims, sizes = d.to_numpy(), size.to_numpy()
            for dim in np.unique(dims).tolist():
                of_dim = np.flatnonzero(dims == dim)
                y, cuts = unit(v.take(pa.array(of_dim)), dim) @ rotation(dim), block_cuts(dim, blocks)
                radius = np.sqrt(budgets(dim, cosine, blocks)) * (1 + 1e-9)
                coords = np.array([coarse_coordinates(s, task_rows(dim, task_values)) for s in sizes[of_dim].tolist()])
                for k in np.unique(coords).tolist():
                    some = np.flatnonzero(coords == k)
                    for block in range(len(cuts) - 1) if k else (-1,):
                        use = min(k, cuts[block + 1] - cuts[block]) if k else 0
                        cell = np.floor(y[some, cuts[block] : cuts[block] + use] / radius[block]).astype(np.int64) + (1 << 19) if k else np.zeros((len(some), 0), np.int64)
                        for step in itertools.product((-1, 0, 1), repeat=use):
                            if step > (0,) * use:
                                continue
                            at = sum(((cell[:, c] + step[c]) << (20 * c) for c in range(use)), np.zeros(len(some), np.int64))
                            take = pa.array(of_dim[some])
                            fixed = [pa.array(np.full(len(some), block), pa.int32()), pa.array(at), pa.array(np.full(len(some), int(any(step))), pa.int32())]
                            yield pa.RecordBatch.from_arrays([grp.take(take), d.take(take), *fixed, key.take(take), n.take(take), v.take(take)], ["grp", "d", "block", "cell", "side", "key", "n", "v"])

    return C.map_batches(reps.select("grp", "d", "size", "key", "n", "v"), run, "grp long, d int, block int, cell long, side int, key long, n long, v binary")


def _meetings(dealt: DataFrame, task_values: int) -> DataFrame:
    """Adds (p, q, role): the meeting of part p of a cell's own vectors (role 0) with itself and the cell's guests, or in a
    crowded cell with another part of them or of the guests (role 1)."""
    key = ["grp", "d", "block", "cell"]
    limit = F.greatest(F.lit(2), F.floor(F.lit(task_values) / F.col("d")))
    count = dealt.groupBy(*key).agg(F.count_if(F.col("side") == 0).alias("own"), F.count_if(F.col("side") == 1).alias("guests"))
    parts = [F.ceil(F.col(c) / limit).cast("int").alias(a) for c, a in (("own", "s"), ("guests", "t"))]
    crowded = C.written(count.where(F.col("own") + F.col("guests") > limit).select(*key, *parts))
    rows = dealt.join(C.small(crowded), key, "left")
    s, t = F.col("s"), F.col("t")
    part = F.pmod(F.xxhash64("key", "block"), F.greatest(F.when(F.col("side") == 0, s).otherwise(t), F.lit(1))).cast("int")
    kind = "array<struct<p:int,q:int,role:int>>"

    def meet(p, q, role):
        return F.struct(p.alias("p"), q.alias("q"), F.lit(role).alias("role"))

    def steps(a, b, f):  # sequence() runs downwards when its end is below its start
        return F.when(b > a, F.transform(F.sequence(a, b - 1), f)).otherwise(F.array().cast(kind)).cast(kind)

    alone = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q"), F.col("side").alias("role"))).cast(kind)
    own = F.concat(steps(F.col("part"), s + t, lambda q: meet(F.col("part"), q, 0)), steps(F.lit(0), F.col("part"), lambda p: meet(p, F.col("part"), 1)))
    guest = steps(F.lit(0), s, lambda p: meet(p, s + F.col("part"), 1))
    where = F.when(s.isNull(), alone).when(F.col("side") == 0, own).otherwise(guest)
    return rows.withColumn("part", part).select(*key, F.explode(where).alias("m"), "key", "n", "v").select(*key, "m.*", "key", "n", "v")


def _roots(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(m)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _linked(meetings: DataFrame, cosine: float, blocks: int) -> DataFrame:
    def solve(key, t):
        d, block, p, q = (k.as_py() for k in (key[1], key[2], key[4], key[5]))
        keys, n, role = t.column("key").to_numpy(), t.column("n").to_numpy(), t.column("role").to_numpy()
        x = unit(t.column("v"), d)
        left, right = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        some = range(len(block_cuts(d, blocks)) - 1) if block < 0 else range(block, block + 1)
        count, root = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for other in ([None] if p == q else []) + ([right] if len(right) else []):
            for i, j in linked_pairs(x, left, other, some, cosine, blocks):
                np.add.at(count, i, n[j])
                np.add.at(count, j, n[i])
                # links so far and these: a pair of roots stands for both ends
                new = _roots(len(keys), np.concatenate([np.arange(len(keys)), i]), np.concatenate([root, j]))
                root = new
        some = np.flatnonzero(count)
        return pa.table({"key": pa.array(keys[some], pa.int64()), "n": pa.array(count[some], pa.int64()), "other": pa.array(keys[root[some]], pa.int64())})

    return meetings.groupBy("grp", "d", "block", "cell", "p", "q").applyInArrow(solve, "key long, n long, other long")


def _packed(reps: DataFrame, single: bool) -> DataFrame:
    """(grp, d, key, id, n, v) with vectors as binary, of 4 bytes a number where they came so."""
    kind = np.float32 if single else np.float64

    def run(batches):
        for b in batches:
            v = b.column(4)
            flat, cuts = v.flatten().to_numpy().astype(kind), v.offsets.to_numpy() - v.offsets[0].as_py()
            data, size = flat.tobytes(), flat.itemsize
            packed = [data[size * a : size * z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(cuts), pa.int32()), *b.columns[1:4], pa.array(packed, pa.binary())], ["grp", "d", "key", "id", "n", "v"])

    return C.map_batches(reps.select("grp", "key", "id", "n", "v"), run, "grp long, d int, key long, id long, n long, v binary")


def embedding_near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, blocks: int = BLOCKS, task_values: int = TASK_VALUES) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row of vectors.

    Rows link when their labels are equal and not null and their cosine reaches the threshold. Null, empty or zero vectors,
    and those with null, NaN or infinite components, link with nothing; so do vectors of different lengths, and rows with a
    null id. Very small and very large numbers are scaled first. Equal vectors link with each other. Rows that repeat an id
    are vectors of their own: each gives one row, and links count rows. Other columns are ignored; an empty table gives an
    empty result.
    """
    single = vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector_col].dataType.containsNull)
    base = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    fine = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    fine = F.coalesce(fine & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False))
    # 0.0 and -0.0 are one number
    named = base.withColumn("fine", fine).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("key", F.when(F.col("fine"), F.xxhash64("label", "v")))
    reps = named.where("fine").groupBy("label", "v", "key").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    reps = C.written(_packed(reps.withColumn("grp", F.xxhash64("label")), single))
    size = C.written(reps.groupBy("grp", "d").agg(F.count("*").alias("size")))
    dealt = _dealt(reps.join(C.small(size), ["grp", "d"]), cosine, blocks, task_values)
    linked = C.written(_linked(_meetings(dealt, task_values), cosine, blocks))
    far = linked.groupBy("key").agg(F.sum("n").alias("far"))
    comp = C.written(C.components(linked.select(F.col("key").alias("a"), F.col("other").alias("b"))))
    placed = reps.select("key", "id", "n").join(comp, reps.key == comp.node, "left").withColumn("comp", F.coalesce("component", "key"))
    low = placed.groupBy("comp").agg(F.min("id").alias("component_id"))
    out = C.written(placed.join(low, "comp").join(far, "key", "left").select("key", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), "component_id"))
    for table in (size, linked, comp, reps):
        C.dropped(table)
    whole = named.select("id", "key").join(out, "key", "left")
    comp_id = F.coalesce("component_id", "id")
    return whole.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), (F.col("id") == comp_id).alias("kept"))


def op10_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(C.documents(spark, sf_dir, "embeddings"))


#: The same by all pairs of a label.
ORACLE = f"""
WITH RECURSIVE fine AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  AND list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= {COSINE}),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT l.a AS vec_id, coalesce(d.n, 0) AS n_links, l.component_id, l.a = l.component_id AS kept FROM low l LEFT JOIN deg d ON l.a = d.a
"""
