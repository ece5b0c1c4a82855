"""Shared helpers: byte-level text arithmetic on Arrow batches, scratch tables, a count sketch, component labelling."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that are worked on at once; the arrays of a run are some hundred times as large at most.
CHUNK_BYTES = 1 << 18
#: Bytes of a batch that Spark hands to Python.
BATCH_BYTES = 4 << 20
SKETCH_BITS = 20
SKETCH_BLOCK = 1 << 14

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tuned(spark: SparkSession) -> SparkSession:
    """Arrow batches are kept to a few thousand rows and a few megabytes, since texts may be long; shuffle files go when the
    query that made them has ended, since the steps of an operator start from written tables. The settings stay with the
    session: frames are lazy, so they must hold when the caller runs them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """Table ``name`` of the folder."""
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def row_and_text(docs: DataFrame, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """(row, text): the columns to keep (all unless named) as a struct, so that no name clashes, and the text beside it."""
    names = docs.columns if keep is None else keep
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))


def released() -> None:
    """Hands freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def roomy(size: int = 24 << 20) -> None:
    """Frees an array of this size that was never touched. The C library then keeps up to twice as much of what is freed for
    the next arrays, instead of fetching fresh pages for each of them; ``released`` hands it back."""
    np.empty(size, np.uint8)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` whose workers, which later stages use again, hand freed memory back when a task ends."""

    def run(batches):
        yield from f(batches)
        released()

    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- scratch tables


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path under ``spark.checkpoint.dir``, which all executors share. Where that is unset, a temporary folder serves
    in local mode, as in tests; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: later steps start from files that outlive any executor."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the scratch table of a frame that ``written`` made, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a whole table lies at a path: Spark marks it so when all its tasks have ended."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(mark)


#: Rows of a one-column id table up to which it is broadcast (16 MB of long ids); larger ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def small(keys: DataFrame) -> DataFrame:
    """A written table of keys as one side of a join: broadcast when its counted rows are within BROADCAST_IDS, else shuffled."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys


def with_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join with a table of distinct long ids, broadcast only when its counted rows are within BROADCAST_IDS."""
    return df.join(small(ids), key, how)


def shares(counts: list[int], n: int) -> list[int]:
    """Splits n among labels with these counts: the same for each, and what a label can't fill goes to the others. Each gets
    one at least while n lasts."""
    out, left = [0] * len(counts), n
    order = sorted(range(len(counts)), key=lambda i: (counts[i], i))
    for k, i in enumerate(order):
        out[i] = min(counts[i], -(-left // (len(order) - k)))
        left -= out[i]
    return out


def bounded_sample(df: DataFrame, n: int, value: Column, label: Column | None = None, max_bytes: int | None = None, text: str = "text") -> DataFrame:
    """(value, label) of at most n distinct (text, label): copies count once, however many there are.

    Every label has its own equal share of n (see ``shares``), of which it sends the texts with the smallest hashes; a label
    with fewer texts than that sends all. Where labels outnumber n, the n with the most texts send one each. The distinct
    hashes are counted first, so that only about 2 n of them, however many tasks there are, get as far as the final sort.
    With ``max_bytes``, every label has an equal share of so many bytes, which its shorter texts fill first; others are left
    out, but for the shortest of a label, which always comes: the bound is exceeded by one text of each label at most.
    """
    label = F.lit("") if label is None else label
    rows = df.withColumn("_h", F.xxhash64(text)).withColumn("_label", label)
    keys = written(rows.select("_h", "_label").distinct())
    counts = keys.groupBy("_label").count().orderBy(F.desc("count"), "_label").limit(n).collect()
    bounds = [(r[0], k, min(1 << 30, int(2 * k / r[1] * (1 << 30)) + 1 + (1 << 36) // r[1])) for r, k in zip(counts, shares([r[1] for r in counts], n), strict=True)]
    bound = df.sparkSession.createDataFrame(bounds, "_label string, _n int, _below long")
    place = F.pmod(F.xxhash64("_h"), F.lit(1 << 30))
    near = keys.join(F.broadcast(bound), "_label").withColumn("_place", place).where("_place < _below")
    rank = F.row_number().over(Window.partitionBy("_label").orderBy("_place", "_h"))
    chosen = written(near.withColumn("_k", rank).where("_k <= _n").select("_h", "_label", "_place"))
    dropped(keys)
    if max_bytes is not None:  # n rows at most
        size = rows.withColumn("_size", F.octet_length(text)).join(F.broadcast(chosen), ["_h", "_label"]).groupBy("_place", "_h", "_label").agg(F.min("_size").alias("_size"))
        # every label has an equal share of the bytes too, which its shorter texts fill first
        labels = F.size(F.collect_set("_label").over(Window.partitionBy()))
        used = F.sum("_size").over(Window.partitionBy("_label").orderBy("_size", "_place", "_h").rowsBetween(Window.unboundedPreceding, 0))
        chosen = written(size.withColumn("_labels", labels).withColumn("_used", used).where((F.col("_used") * F.col("_labels") <= max_bytes) | (F.col("_used") == F.col("_size"))).select("_h", "_label", "_place"))
    out = rows.join(F.broadcast(chosen), ["_h", "_label"]).groupBy("_place", "_h", "_label").agg(F.min(value).alias("value"))
    return out.orderBy("_place", "_h", "_label").select("value", F.col("_label").alias("label"))


# ---------------------------------------------------------------- bytes, words, hashes


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows (null: empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]] if len(offs) else raw[:0], offs - offs[0]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of whole texts of about ``limit`` bytes; a longer text comes alone."""
    if not len(column):
        return
    raw, offs = utf8(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + 60_000)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of 64-bit values over all bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = 0x9E3779B97F4A7C55
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, n: int) -> np.ndarray:
    """Powers of the base ("up") or of its inverse ("down"). A table for usual runs is kept, a larger one goes after its use."""
    usual = 2 * CHUNK_BYTES
    if n <= usual and name in _POWERS:
        return _POWERS[name]
    p = np.full(max(n, usual), _BASE if name == "up" else pow(_BASE, -1, 1 << 64), U64)
    p[0] = 1
    np.cumprod(p, dtype=U64, out=p)
    if n <= usual:
        _POWERS[name] = p
    return p


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes modulo 2**64; ``span_hash`` takes the value of any span from them."""
    out = np.zeros(len(raw) + 1, U64)
    x = out[1:]
    x[:] = raw
    x += U64(1)
    x *= _powers("up", len(raw) + 1)[: len(raw)]
    np.cumsum(x, out=x)
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end, the same wherever they stand."""
    return mix((sums[end] - sums[start]) * _powers("down", len(sums))[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def split_words(raw: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of word bytes; runs end with their text."""
    m = is_word[raw]
    bounds = offs[1:-1]
    bounds = bounds[bounds < len(raw)]
    before = np.empty(len(raw), bool)
    before[:1] = False
    before[1:] = m[:-1]
    before[bounds] = False
    after = np.empty(len(raw), bool)
    after[-1:] = False
    after[:-1] = m[1:]
    after[bounds[bounds > 0] - 1] = False
    start = np.flatnonzero(m & ~before)
    end = np.flatnonzero(m & ~after) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def is_space_split() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, bool)
    t[[32, *range(9, 14)]] = False
    return t


def is_alnum() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing: digits, letters and all beyond ASCII."""
    t = np.zeros(256, bool)
    t[48:58] = t[97:123] = t[128:] = True
    return t


def word_hashes(raw: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and row of every word of lower-cased (A-Z only) texts."""
    low = LOWER[raw]
    start, end, row = split_words(low, offs, is_word)
    return span_hash(prefix_hash(low), start, end), row


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from ``first`` on, ``count`` of them, for each entry, one after the other."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


def by_row(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Order of values within rows; row numbers are below 65536."""
    order = np.argsort(values)
    return order[np.argsort(row[order].astype(np.uint16), kind="stable")]


# ---------------------------------------------------------------- count sketch


def count_sketch(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """How often each of 2**SKETCH_BITS hash buckets occurs in the whole input. The sketch has a fixed size (4 MB) at any
    input size; it only orders tokens from rare to frequent, so that collisions cost time, never results."""
    size = 1 << SKETCH_BITS
    per_task = "block int, counts binary"

    def counted(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for h in hashes(b):
                total += np.bincount((h >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
        if total.any():
            parts = np.minimum(total, 2**32 - 1).astype(np.uint32).reshape(-1, SKETCH_BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "counts"])

    def summed(batches):
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                totals[k] = totals.get(k, 0) + np.frombuffer(v, np.uint32).astype(np.int64)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes() for v in totals.values()], pa.binary())], ["block", "counts"])

    rows = map_batches(map_batches(df, counted, per_task).repartition("block"), summed, per_task).collect()
    out = np.zeros((size // SKETCH_BLOCK, SKETCH_BLOCK), np.uint32)
    for r in rows:
        out[r[0]] = np.frombuffer(r[1], np.uint32)
    return out.reshape(-1)


# ---------------------------------------------------------------- keys that occur more than once


def neighbours(rows: DataFrame, key: str, spread: str | None = None) -> DataFrame:
    """Rows whose key stands in more than one row; the key comes first. Rows with a positive ``spread`` have a frequent key:
    they are dealt by it as well, and all stay. It is 0 for all rows of any other key, and comes last."""

    def run(batches):
        last, open_ = None, False  # the last row so far, and whether a row before it has its key
        for b in batches:
            t = pa.Table.from_batches([b] if last is None else [last, b])
            value = t.column(0).to_numpy()
            same = np.concatenate([[open_], value[1:] == value[:-1]])
            keep = same | np.append(same[1:], False)
            if spread:
                keep |= t.column(t.num_columns - 1).to_numpy() > 0
            # the last row waits for the next batch, where it may find its equal
            yield from t.slice(0, len(value) - 1).filter(pa.array(keep[:-1])).to_batches()
            last, open_ = t.slice(len(value) - 1).combine_chunks().to_batches()[0], bool(same[-1])
        if last is not None and (open_ or spread and last.column(last.num_columns - 1)[0].as_py() > 0):
            yield last

    by = [key, spread] if spread else [key]
    return map_batches(rows.repartition(*by).sortWithinPartitions(key), run, rows.schema)


# ---------------------------------------------------------------- components


def fingerprint(edges: DataFrame) -> tuple:
    """Count and combined 64-bit hashes of distinct rows: equal for equal tables, unequal for others but for a chance of 2**-64."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected links, component being the smallest node reachable.

    Alternates two steps until nothing changes: every node hands its smallest neighbour to its larger neighbours, then to
    its smaller ones. A hub only ever joins with one row, so its links may be split over tasks. Links without two ends are
    ignored; an empty table gives an empty result.
    """
    edges = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = fingerprint(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        nxt = written(small)
        dropped(edges)
        edges, before, mark = nxt, mark, fingerprint(nxt)
        if mark == before:
            break
    # every edge now points from a node to the smallest of its component
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


# ---------------------------------------------------------------- suffix sorting


def prefix_sort(at: np.ndarray, keys: np.ndarray, step: int, levels: int) -> np.ndarray:
    """Positions ``at`` in the order of their first ``step * levels`` symbols; ``keys[i]`` packs the ``step`` symbols from i on,
    and is zero beyond the end. Only positions that tie on one level are compared on the next."""
    if not len(at):
        return at
    order = at[np.argsort(keys[at], kind="stable")]
    k = keys[order]
    same = np.concatenate([[False], k[1:] == k[:-1], [False]])
    where, group = np.arange(len(order)), np.cumsum(~same[:-1])
    for level in range(1, levels):
        tied = same[:-1] | same[1:]
        where, group = where[tied], group[tied]
        if not len(where):
            break
        sub = order[where]
        k = keys[np.minimum(sub + level * step, len(keys) - 1)]
        o = np.lexsort((k, group))
        order[where] = sub[o]
        k, group = k[o], group[o]
        same = np.concatenate([[False], (k[1:] == k[:-1]) & (group[1:] == group[:-1]), [False]])
        group = np.cumsum(~same[:-1])
    return order
