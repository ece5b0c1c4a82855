"""Merkle manifest of a dataset, its subtrees stored in van Emde Boas layout.

Every row is a leaf; each group of rows (a source) has a tree, and the roots of the groups, in order, have a tree of their
own. A tree is cut into aligned blocks of 3**HEIGHT leaves. A block is one row of a table: its nodes lie in one binary value,
in the layout that splits a subtree at half its height, puts the upper half first, then the lower subtrees one by one, and
lays out each of them in the same way. ``address`` gives the place of any node by arithmetic alone; blocks are built, and
siblings fetched, by it. The roots of a group's blocks are the leaves of the next round of blocks, until one block is left.

A row's place in its group comes from range partitions and the counts in each of them, so that no group, however large, is
in one task. Only ids and hashes are shuffled, never texts. A digest is 32 bytes here, and a hash covers the lowercase hex of
what it joins.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

FANOUT, HEIGHT, DIGEST = 3, 6, 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# ---------------------------------------------------------------- layout


def size(m, levels: int):
    """Nodes of a tree of so many levels over m leaves; m may be an array."""
    total = 0
    for _ in range(levels):
        total, m = total + m, -(-m // FANOUT)
    return total


def levels_over(m: int) -> int:
    """Levels of the smallest tree with one root over m leaves."""
    n = 1
    while m > 1:
        n, m = n + 1, -(-m // FANOUT)
    return n


def address(level: int, index, m, levels: int):
    """Place of the nodes ``index`` of a level (0: the leaves) in the layout of a tree of ``levels`` levels over m leaves, of
    which the last ones may be absent: lower subtrees are full but for the last, so that places have no holes."""
    if levels == 1:
        return index * 0
    low = levels // 2
    above = -(-m // FANOUT**low)
    if level >= low:
        return address(level - low, index, above, levels - low)
    width, reach = FANOUT ** (low - 1), FANOUT ** (low - 1 - level)
    tree = index // reach
    return size(above, levels - low) + tree * size(width, low) + address(level, index - tree * reach, np.minimum(width, m - tree * width), low)


def build(leaves: np.ndarray, levels: int) -> np.ndarray:
    """All nodes, in layout order, of the tree over leaves (one row of 32 bytes each)."""
    m = count = len(leaves)
    nodes = np.zeros((size(m, levels), DIGEST), np.uint8)
    nodes[address(0, np.arange(m), m, levels)] = leaves
    for level in range(1, levels):
        below = nodes[address(level - 1, np.arange(count), m, levels)].tobytes().hex()
        count = -(-count // FANOUT)
        step = 2 * DIGEST * FANOUT
        made = b"".join([sha256(below[i * step : (i + 1) * step].encode()).digest() for i in range(count)])
        nodes[address(level, np.arange(count), m, levels)] = np.frombuffer(made, np.uint8).reshape(-1, DIGEST)
    return nodes


def siblings(nodes: np.ndarray, m: int, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all leaves of a block: sibling digests of one leaf after the other, how many each has, and for each level the
    place of its node in its run times four plus the length of the run."""
    leaf, count = np.arange(m), m
    place = np.zeros((m, 2 * (levels - 1)), np.int64)
    held = np.zeros((m, 2 * (levels - 1)), bool)
    shape = np.zeros((m, levels - 1), np.uint8)
    for level in range(levels - 1):
        own = leaf // FANOUT**level
        first = own - own % FANOUT
        run = np.minimum(FANOUT, count - first)
        shape[:, level] = own % FANOUT * 4 + run
        for k in range(FANOUT - 1):
            other = first + k + (own - first <= k)
            held[:, 2 * level + k] = k < run - 1
            place[:, 2 * level + k] = address(level, np.minimum(other, count - 1), m, levels)
        count = -(-count // FANOUT)
    return nodes[place[held]], held.sum(1), shape


def fold(leaf: bytes, others: bytes, shape: bytes) -> bytes:
    """The root that follows from a leaf, its siblings and their shape."""
    h, s, at = leaf.hex(), others.hex(), 0
    for code in shape:
        before, run = code // 4 * 2 * DIGEST, (code % 4 - 1) * 2 * DIGEST
        h = sha256((s[at : at + before] + h + s[at + before : at + run]).encode()).hexdigest()
        at += run
    return bytes.fromhex(h)


# ---------------------------------------------------------------- places and blocks


def _digests(column: pa.Array) -> np.ndarray:
    return C.utf8(column)[0].reshape(-1, DIGEST)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (grp, ...) with their number within grp in the given order, and the size of their group. Range partitions are
    numbered where they are; the counts before a partition, one row for each group in it, are added."""
    spark = rows.sparkSession

    def numbered(batches):
        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            g = b.column(0)
            if not len(g):
                continue
            new = np.flatnonzero(pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)) + 1
            first = np.zeros(len(g), np.int64)
            first[new] = new
            seq = np.arange(len(g)) - np.maximum.accumulate(first)
            if g[0].as_py() == last:
                seq[: new[0] if len(new) else len(g)] += n
            last, n = g[-1].as_py(), int(seq[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(g), pa.int32()), pa.array(seq)], [*b.schema.names, "part", "seq"])

    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType())])
    dealt = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    placed = C.written(C.map_batches(dealt, numbered, schema))
    w = Window.partitionBy("grp")
    counts = placed.groupBy("part", "grp").agg(F.count("*").alias("_n"))
    counts = counts.select("part", "grp", (F.sum("_n").over(w.orderBy("part")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("n"))
    out = placed.join(C.written(counts), ["part", "grp"])
    return out.select(*rows.columns, (F.col("_before") + F.col("seq")).alias("place"), "n")


def _blocks(rows: DataFrame, height: int) -> DataFrame:
    """(grp, block, n, m, items, nodes, root) of (grp, place, n, item, leaf): one row for each aligned block."""
    width = FANOUT**height

    def run(batches):
        kept = None
        for b in batches:
            t = pa.Table.from_batches([b] if kept is None else [kept, b]).combine_chunks()
            yield from made(t, False)
            kept = tail(t)
        if kept is not None:
            yield from made(pa.Table.from_batches([kept]), True)

    def starts(t):
        g, k = t.column(0).combine_chunks(), t.column(1).to_numpy()
        return np.concatenate([[0], np.flatnonzero(pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False) | (k[1:] != k[:-1])) + 1]) if t.num_rows else np.zeros(0, np.int64)

    def tail(t):
        return t.slice(int(starts(t)[-1])).combine_chunks().to_batches()[0] if t.num_rows else None

    def made(t, all_):
        """The blocks of a run of rows; the last one waits unless all rows are there."""
        cut = starts(t)
        ends = np.append(cut[1:], t.num_rows)
        if not all_:
            cut, ends = cut[:-1], ends[:-1]
        if not len(cut):
            return
        t = t.slice(0, int(ends[-1])).combine_chunks()
        leaf, n = _digests(t.column(4).combine_chunks()), t.column(2).to_numpy()
        nodes, roots = [], []
        for a, z in zip(cut.tolist(), ends.tolist(), strict=True):
            tree = build(leaf[a:z], height + 1 if n[a] > width else levels_over(z - a))
            nodes.append(tree.tobytes())
            roots.append(nodes[-1][:DIGEST])  # the root is first in the layout
        items = pa.ListArray.from_arrays(pa.array(np.append(cut, ends[-1]), pa.int32()), t.column(3).combine_chunks())
        at = pa.array(cut)
        yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks().take(at), t.column(1).combine_chunks().take(at), pa.array(n[cut]), pa.array(ends - cut, pa.int32()), items, pa.array(nodes, pa.binary()), pa.array(roots, pa.binary())], ["grp", "block", "n", "m", "items", "nodes", "root"])

    dealt = rows.select("grp", F.expr(f"place div {width}").alias("block"), "n", "item", "leaf", "place")
    dealt = dealt.repartition("grp", "block").sortWithinPartitions("grp", "block", "place").drop("place")
    fields = [dealt.schema["grp"], dealt.schema["block"], T.StructField("n", T.LongType()), T.StructField("m", T.IntegerType()), T.StructField("items", T.ArrayType(dealt.schema["item"].dataType)), T.StructField("nodes", T.BinaryType()), T.StructField("root", T.BinaryType())]
    return C.map_batches(dealt, run, T.StructType(fields))


def forest(rows: DataFrame, height: int = HEIGHT, path: str | None = None) -> list[DataFrame]:
    """Written tables of blocks of (grp, place, n, item, leaf), bottom first: each round has the roots of the blocks below as
    its leaves, for groups of more than one block. They lie in numbered folders of ``path``, or are scratch without one."""
    width, out = FANOUT**height, []
    while True:
        blocks = _blocks(rows, height)
        if path is None:
            out.append(C.written(blocks))
        else:
            blocks.write.mode("overwrite").parquet(f"{path}/{len(out)}")
            out.append(rows.sparkSession.read.schema(blocks.schema).parquet(f"{path}/{len(out)}"))
        more = out[-1].where(F.col("n") > width)
        if not more.limit(1).count():
            return out
        rows = more.select("grp", F.col("block").alias("place"), F.expr(f"(n + {width - 1}) div {width}").alias("n"), F.lit(0).alias("item"), F.col("root").alias("leaf"))


def roots(rounds: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """(grp, root) of every group."""
    tops = [b.where(F.col("n") <= FANOUT**height).select("grp", "root") for b in rounds]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def proofs(rounds: list[DataFrame], above: DataFrame | None = None, height: int = HEIGHT) -> DataFrame:
    """(grp, item, leaf, top, siblings, shape) of every leaf: the root of its group, and what leads from the leaf to it. With
    ``above`` (grp, siblings, shape), the way goes on from the root of the group. Every block meets one row of the round
    above, by its number."""
    width = FANOUT**height

    def run(batches):
        for b in batches:
            for grp, block, m, items, nodes, over, shapes, top in zip(*b.columns, strict=True):
                m, nodes = m.as_py(), np.frombuffer(nodes.as_py(), np.uint8).reshape(-1, DIGEST)
                levels = next(k for k in range(1, 99) if size(m, k) == len(nodes))
                others, count, shape = siblings(nodes, m, levels)
                data, cut = others.tobytes(), np.concatenate([[0], np.cumsum(count)]) * DIGEST
                over, shapes = over.as_py(), shapes.as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([grp.as_py()] * m, pa.string()), pa.array(block.as_py() * width + np.arange(m)), items.values,
                        pa.array([x.tobytes() for x in nodes[address(0, np.arange(m), m, levels)]], pa.binary()), pa.array([top.as_py()] * m, pa.binary()),
                        pa.array([data[x:y] + over for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary()), pa.array([x.tobytes() + shapes for x in shape], pa.binary()),
                    ],
                    ["grp", "place", "item", "leaf", "top", "siblings", "shape"],
                )

    nothing = F.lit(b"").cast("binary")
    way = None
    for blocks in reversed(rounds):
        tops = blocks.where(F.col("n") <= width).select("grp", "block", F.col("root").alias("top"))
        tops = tops.select("*", nothing.alias("over"), nothing.alias("shapes")) if above is None else tops.join(above.select("grp", F.col("siblings").alias("over"), F.col("shape").alias("shapes")), "grp")
        way = tops if way is None else tops.unionByName(way.select("grp", F.col("place").alias("block"), "top", F.col("siblings").alias("over"), F.col("shape").alias("shapes")))
        joined = blocks.select("grp", "block", "m", "items", "nodes").join(way, ["grp", "block"]).select("grp", "block", "m", "items", "nodes", "over", "shapes", "top")
        fields = [T.StructField("grp", T.StringType()), T.StructField("place", T.LongType()), T.StructField("item", blocks.schema["items"].dataType.elementType)]
        way = C.map_batches(joined, run, T.StructType([*fields, *(T.StructField(c, T.BinaryType()) for c in ("leaf", "top", "siblings", "shape"))]))
    return way.drop("place")


# ---------------------------------------------------------------- the manifest of a table


def leaf_hash(columns: list[Column]) -> Column:
    """Hash of the fields of a row: each ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def merkle_manifest(docs: DataFrame, fields: tuple = FIELDS, id_col: str = "doc_id", group_col: str = "source", shown: dict[str, Column] | None = None, height: int = HEIGHT, path: str | None = None) -> tuple[DataFrame, bytes | None]:
    """(proofs, root): for every row (id, grp, leaf, shown, subroot, siblings, shape), and the root over all groups.

    ``shown`` replaces columns by what a holder of the data shows: column ``shown`` is the leaf of that, which ``verified``
    folds with the original siblings. Leaves of a group ascend by id (null first); rows that share an id by their leaf, so
    that equal rows are told apart by nothing. Null fields have their own mark; a null group is a group and comes first; null,
    empty and very long texts are hashed as they are, by Spark's own functions. An empty table has no proofs and no root.
    Other columns of docs, whatever their names, are ignored. The blocks are kept in the folder ``path``, if it is given, for
    ``stored_proofs``.
    """
    own = [F.col(f"`{c}`") for c in fields]
    seen = leaf_hash([(shown or {}).get(c, F.col(f"`{c}`")) for c in fields])
    source = F.col(f"`{group_col}`").cast("string")
    # null sorts before all others as the empty string
    rows = docs.select(F.coalesce(F.concat(F.lit(" "), source), F.lit("")).alias("grp"), F.col(f"`{id_col}`").cast("long").alias("id"), leaf_hash(own).alias("leaf"), seen.alias("shown"))
    rows = C.written(rows.withColumn("tie", F.monotonically_increasing_id()))
    trees = forest(ranked(rows, ["id", "leaf", "tie"]).select("grp", "place", "n", F.struct("id", "shown").alias("item"), "leaf"), height, path and f"{path}/groups")
    names = roots(trees, height).select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("leaf"))
    upper = forest(ranked(names, ["name"]).select("grp", "place", "n", F.struct("name").alias("item"), "leaf"), height, path and f"{path}/top")
    return _proofs(trees, upper, height)


def _proofs(trees: list[DataFrame], upper: list[DataFrame], height: int) -> tuple[DataFrame, bytes | None]:
    top = roots(upper, height).first()
    above = C.written(proofs(upper, height=height).select(F.col("item.name").alias("grp"), "siblings", "shape"))
    out = proofs(trees, above, height)
    return out.select("item.id", F.when(F.col("grp") != "", F.substr("grp", F.lit(2))).alias("grp"), "leaf", "item.shown", F.col("top").alias("subroot"), "siblings", "shape"), bytes(top["root"]) if top else None


def stored_proofs(spark: SparkSession, path: str, height: int = HEIGHT) -> tuple[DataFrame, bytes | None]:
    """(proofs, root) from the blocks that ``merkle_manifest`` kept in a folder; no row of the data is read."""

    def rounds(name: str) -> list[DataFrame]:
        out: list[DataFrame] = []
        while C.is_written(spark, f"{path}/{name}/{len(out)}"):
            out.append(spark.read.parquet(f"{path}/{name}/{len(out)}"))
        return out

    return _proofs(rounds("groups"), rounds("top"), height)


def differing(docs: DataFrame, proof_rows: DataFrame, fields: tuple = FIELDS, id_col: str = "doc_id", group_col: str = "source") -> DataFrame:
    """(grp, id, leaf, change) of rows that are not as a manifest has them: ``missing`` from docs, or ``added`` to them; a row
    that was changed is both. Rows are told apart by their leaves: equal rows count as often as they stand on either side."""
    source = F.col(f"`{group_col}`").cast("string")
    now = docs.select(source.alias("grp"), F.col(f"`{id_col}`").cast("long").alias("id"), leaf_hash([F.col(f"`{c}`") for c in fields]).alias("leaf"), F.lit(1).alias("_n"))
    both = now.unionByName(proof_rows.select("grp", "id", "leaf", F.lit(-1).alias("_n"))).groupBy("grp", "id", "leaf").agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return both.select("grp", "id", "leaf", F.when(F.col("_n") > 0, "added").otherwise("missing").alias("change"), F.explode(F.sequence(F.lit(1), F.abs("_n").cast("int"))).alias("_k")).drop("_k")


def verified(proof_rows: DataFrame, root: bytes | None) -> DataFrame:
    """Adds ``folded`` (the root that the shown leaf and the siblings lead to) and ``verified`` (it is the root)."""

    def folded(shown: pa.Array, others: pa.Array, shape: pa.Array) -> pa.Array:
        return pa.array([fold(*x) for x in zip(shown.to_pylist(), others.to_pylist(), shape.to_pylist(), strict=True)], pa.binary())

    out = proof_rows.withColumn("folded", F.arrow_udf(folded, "binary")("shown", "siblings", "shape"))
    return out.withColumn("verified", F.col("folded") == F.lit(root or b""))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows, root = merkle_manifest(docs, shown={"text": tampered})

    def digest(c):
        return F.lower(F.hex(c))

    out = verified(rows, root)
    return out.select(F.col("id").alias("doc_id"), digest("leaf").alias("leaf"), digest("subroot").alias("subroot"), digest(F.lit(root or b"")).alias("root"), F.sha2(digest("siblings"), 256).alias("proof_sha256"), digest("folded").alias("folded_root"), "verified")


def _sql_leaf(text: str) -> str:
    return "sha256(" + "||".join(f"coalesce(strlen(CAST({c} AS VARCHAR))||':'||CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _sql_tree(name: str, start: str) -> str:
    return f"""{name}(grp, lvl, idx, n, h) AS ({start} UNION ALL SELECT grp, lvl + 1, idx // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY grp, lvl, n, idx // {FANOUT})"""


def _sql_way(name: str, tree: str, start: str) -> str:
    return f"""{name}(doc_id, grp, lvl, idx, n, h, proof) AS ({start} UNION ALL
 SELECT f.doc_id, f.grp, f.lvl + 1, f.idx // {FANOUT}, (f.n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(CASE WHEN t.idx = f.idx THEN f.h ELSE t.h END, '' ORDER BY t.idx)), f.proof||coalesce(string_agg(CASE WHEN t.idx <> f.idx THEN t.h END, '' ORDER BY t.idx), '')
 FROM {name} f JOIN {tree} t ON t.grp = f.grp AND t.lvl = f.lvl AND t.idx // {FANOUT} = f.idx // {FANOUT} WHERE f.n > 1 GROUP BY f.doc_id, f.grp, f.lvl, f.idx, f.n, f.h, f.proof)"""


#: The CRC-32 of the decimal id, bit by bit.
_SQL_CRC = "xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"

#: The same trees and ways level by level.
ORACLE = f"""
WITH RECURSIVE leaves AS (SELECT doc_id, coalesce(' '||source, '') AS grp, {_sql_leaf("text")} AS leaf, CASE WHEN {_SQL_CRC} % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS shown FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
{_sql_tree("tree", "SELECT grp, 0, idx, n, leaf FROM placed")},
subs AS (SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
{_sql_tree("upper_tree", "SELECT '', 0, idx, n, h FROM subs")},
{_sql_way("way", "tree", "SELECT doc_id, grp, 0, idx, n, shown, '' FROM placed")},
{_sql_way("upper_way", "upper_tree", "SELECT w.doc_id, '', 0, s.idx, s.n, w.h, w.proof FROM way w JOIN subs s ON s.grp = w.grp WHERE w.n = 1")}
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(u.proof) AS proof_sha256, u.h AS folded_root, u.h = r.h AS verified
FROM placed p JOIN subs s ON s.grp = p.grp JOIN upper_way u ON u.doc_id = p.doc_id AND u.n = 1, (SELECT h FROM upper_tree WHERE n = 1) r
"""
