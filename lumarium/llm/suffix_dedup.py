"""Removal of repeated passages with suffix arrays that are sorted in two stages.

A byte goes when a string of WINDOW bytes covers it that also starts in a document with a smaller id. Equal strings are
brought together by their content: each window is owned by one of the k-byte substrings inside it (the rarest by a count
sketch of the corpus, then the one with the smallest hash), so equal windows have equal owners at equal offsets. The
windows that one place owns form a piece of text. Pieces whose owner stands in one document only are dropped. Equal pieces
of one owner are pre-aggregated to the smallest document that has them, and there to their first place; what remains goes,
with its bytes, to the task of its owner, which sorts the suffixes of all its pieces (what is found at a first place holds
at the other places of that document as well):

- only suffixes smaller than their successor are sorted directly, to a depth that exceeds the window;
- all others are induced by scanning the buckets (first bytes) in order: the suffix before each one scanned is put at the
  next place of its own bucket;
- common prefixes of neighbours in that order show the runs of equal windows, and each run its smallest document.

An owner with so many different pieces that they exceed what a task holds at once is split: its pieces are cut anew by
longer owners (the substring of FINE_OWNER bytes with the smallest hash), which equal windows share as well, and take the
same steps again. Rows of owners that the sketch shows to be frequent are also dealt by their place.

Whole copies of a text are settled before by the hashes of the texts.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW, OWNER = 50, 20
TASK_BYTES = 2 << 20
#: Different pieces from which an owner is split (about TASK_BYTES of them), the length of the finer owners, and tasks for the
#: rows of a frequent owner.
CROWD, FINE_OWNER, SPREAD = TASK_BYTES // 64, 40, 64


# ---------------------------------------------------------------- two-stage sorting


def pack8(raw: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as one number; zeros beyond the end, and one entry more."""
    n = len(raw)
    k = np.zeros(n + 16, np.uint64)
    k[:n] = raw
    for size in (1, 2, 4):
        k[:-size] = (k[:-size] << np.uint64(8 * size)) | k[size:]
    return k[: n + 1]


def two_stage_order(raw: np.ndarray, depth: int = 56) -> np.ndarray:
    """All suffix starts in the order of their first ``depth`` bytes (at least)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(raw[1:].astype(np.int16) - raw[:-1].astype(np.int16))
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where bytes change
    small = step[at] > 0
    direct = C.prefix_sort(np.flatnonzero(small), pack8(raw), 8, -(-depth // 8))
    heads = np.searchsorted(raw[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[raw[-1]].append(np.array([n - 1]))
    out = []

    def induce(scanned: np.ndarray, c: int) -> np.ndarray:
        before = scanned[scanned > 0] - 1
        before = before[~small[before]]
        b = raw[before]
        o = np.argsort(b, kind="stable")
        before, b = before[o], b[o]
        values, first = np.unique(b, return_index=True)
        same = before[:0]
        for v, part in zip(values.tolist(), np.split(before, first[1:]), strict=False) if len(values) else ():
            if v == c:
                same = part
            else:
                induced[v].append(part)
        return same

    for c in range(256):
        wave = np.concatenate(induced[c]) if induced[c] else direct[:0]
        while len(wave):
            out.append(wave)
            wave = induce(wave, c)
        own = direct[heads[c] : heads[c + 1]]
        if len(own):
            out.append(own)
            induce(own, c)
    return np.concatenate(out)


def common_prefixes(keys: np.ndarray, order: np.ndarray, depth: int = 56) -> np.ndarray:
    """Bytes (at most ``depth``) that each suffix in order shares with the one before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for level in range(-(-depth // 8)):
        if not len(live):
            break
        x = keys[np.minimum(order[live] + 8 * level, len(keys) - 1)] ^ keys[np.minimum(order[live - 1] + 8 * level, len(keys) - 1)]
        bytes_ = np.zeros(len(live), np.int64)
        for j in range(8):
            bytes_ += (x >> np.uint64(56 - 8 * j)) == 0
        out[live] += bytes_
        live = live[x == 0]
    return np.minimum(out, depth)


def repeated_windows(raw: np.ndarray, offs: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Starts of windows, whole within one piece, of which another piece of a smaller document has an equal one."""
    depth = -(-(window + 1) // 8) * 8
    order, keys = two_stage_order(raw, depth), pack8(raw)
    piece = np.searchsorted(offs, order, "right") - 1
    whole = order + window <= offs[piece + 1]
    order, piece = order[whole], piece[whole]
    if not len(order):
        return order
    new = common_prefixes(keys, order, depth) < window
    new[0] = True
    least = np.minimum.reduceat(doc[piece], np.flatnonzero(new))[np.cumsum(new) - 1]
    return np.sort(order[doc[piece] > least])


# ---------------------------------------------------------------- owners and pieces


def kmer_hashes(raw: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    sums = C.prefix_hash(raw)
    at = np.arange(max(len(raw) - k + 1, 0))
    return C.span_hash(sums, at, at + k), sums


def owned_pieces(raw: np.ndarray, offs: np.ndarray, sketch: np.ndarray, window: int, k: int):
    """(row, first window, number of windows, owner hash, piece hash) of every run of windows with one owner."""
    h, sums = kmer_hashes(raw, k)
    none = np.zeros(0, np.int64)
    total = len(raw) - window + 1
    if total <= 0:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    rank = (sketch[h >> np.uint64(64 - C.SKETCH_BITS)].astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32))
    at = np.arange(len(rank), dtype=np.int32)
    width, span = window - k + 1, 1
    while span < width:
        s = min(span, width - span)
        less = rank[s:] < rank[:-s]
        rank = np.where(less, rank[s:], rank[:-s])
        at = np.where(less, at[s:], at[:-s])
        span += s
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:total]
    ok = np.arange(total) + window <= offs[1:][row]
    start, row, at = np.flatnonzero(ok), row[ok], at[ok]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    begin = start[first]
    place = (at[first] - begin).astype(np.uint64)
    return row[first], begin - offs[row[first]], count, h[at[first]], C.span_hash(sums, begin, begin + count + window - 1) + place


AGAIN = "array<struct<level:int,base:int,first:int,count:int>>"
#: ``back``: bytes back to the first equal piece of the document.
PIECES = "owner long, whole long, doc long, first int, back int, count int, spread int"


def piece_rows(doc: pa.Array, first: np.ndarray, count: np.ndarray, owner: np.ndarray, whole: np.ndarray, frequent: np.ndarray) -> pa.RecordBatch:
    spread = np.where(frequent, 1 + (doc.to_numpy() ^ first) % SPREAD, 0)
    key = whole ^ C.mix(doc.to_numpy().astype(np.uint64))
    order = np.lexsort((first, key))
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    back = np.zeros(len(order), np.int64)
    back[order] = first[order] - first[order[new]][np.cumsum(new) - 1]
    return pa.RecordBatch.from_arrays([pa.array(owner.view(np.int64)), pa.array(whole.view(np.int64)), doc, pa.array(first, pa.int32()), pa.array(back, pa.int32()), pa.array(count, pa.int32()), pa.array(spread, pa.int32())], ["owner", "whole", "doc", "first", "back", "count", "spread"])


def _pieces(docs: DataFrame, sketch, window: int, k: int, crowd: int) -> DataFrame:
    """Pieces of each text; ``spread`` is positive for owners that stand ``crowd`` times above the mean of the sketch."""

    def run(batches):
        counts = sketch.value
        often = counts.mean() + crowd
        for b in batches:
            for lo, _, raw, offs in C.text_chunks(b.column(1)):
                row, first, count, owner, whole = owned_pieces(raw, offs, counts, window, k)
                yield piece_rows(b.column(0).take(pa.array(row + lo)), first, count, owner, whole, counts[owner >> np.uint64(64 - C.SKETCH_BITS)] > often)

    return C.map_batches(docs, run, PIECES)


def _places(batches):
    """For each run of texts in (doc, text, wanted): its bytes; owner, document and first byte of each wanted piece; where the
    piece begins and ends in the run."""
    for b in batches:
        for lo, hi, raw, offs in C.text_chunks(b.column(1)):
            part = b.column(2)[lo:hi]
            at = part.flatten()
            row = np.repeat(np.arange(hi - lo), np.diff(part.offsets.to_numpy()))
            first = at.field(1).to_numpy()
            begin = offs[row] + first
            yield raw, at.field(0), b.column(0)[lo:hi].take(pa.array(row)), first, begin, begin + at.field(2).to_numpy()


def _cut(texts: DataFrame) -> DataFrame:
    """Explodes (doc, text, wanted) to (owner, doc, first, piece), the bytes of each wanted piece."""

    def run(batches):
        for raw, owner, doc, first, begin, end in _places(batches):
            data = raw.tobytes()
            yield pa.RecordBatch.from_arrays([owner, doc, pa.array(first, pa.int32()), pa.array([data[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())], ["owner", "doc", "first", "piece"])

    return C.map_batches(texts, run, "owner long, doc long, first int, piece binary")


def _finer(texts: DataFrame, window: int, k: int) -> DataFrame:
    """The wanted pieces of (doc, text, wanted), cut anew by owners of k bytes, the smallest hash first."""

    def run(batches):
        level = np.zeros(1 << C.SKETCH_BITS, np.uint8)
        for raw, _, doc, first, begin, end in _places(batches):
            offs = np.concatenate([[0], np.cumsum(end - begin)])
            row, more, count, owner, whole = owned_pieces(raw[C.ranges(begin, end - begin)], offs, level, window, k)
            yield piece_rows(doc.take(pa.array(row)), first[row] + more, count, owner, whole, np.zeros(len(row), bool))

    return C.map_batches(texts, run, PIECES)


def _sorted_suffixes(pieces: DataFrame, window: int) -> DataFrame:
    """(doc, start, end) of repeated bytes among pieces of equal owners, which come in order of owners."""

    def solve(t: pa.Table):
        raw, offs = C.utf8(t.column("piece").combine_chunks())
        doc, first = t.column("doc").to_numpy(), t.column("first").to_numpy().astype(np.int64)
        start = repeated_windows(raw, offs, doc, window)
        piece = np.searchsorted(offs, start, "right") - 1
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1] + 1) | (piece[1:] != piece[:-1])
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(start)) - 1
        base = first[piece] - offs[piece]
        return pa.RecordBatch.from_arrays([pa.array(doc[piece[a]]), pa.array((start + base)[a], pa.int64()), pa.array((start + base)[z] + window if len(a) else np.zeros(0, np.int64), pa.int64())], ["doc", "start", "end"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size < TASK_BYTES:
                continue
            t = pa.Table.from_batches(held)
            owner = t.column("owner").to_numpy()
            cut = int(np.searchsorted(owner, owner[-1]))  # the last owner may go on
            if cut:
                yield solve(t.slice(0, cut))
                t = t.slice(cut)
            held, size = t.to_batches(), t.nbytes
        if held:
            yield solve(pa.Table.from_batches(held))

    return C.map_batches(pieces.repartition("owner").sortWithinPartitions("owner"), run, "doc long, start long, end long")


def repeated_spans(docs: DataFrame, window: int = WINDOW, owner: int = OWNER, crowd: int = CROWD) -> DataFrame:
    """(doc, copy, spans, again) for documents with repeated bytes: ``copy`` when the whole text stands in a smaller document,
    else the byte spans (start, end), not merged, and the places (level, base, first, count) where the ``count`` windows from
    ``base`` on stand once more: see ``with_equal_places``. docs has (doc, text), with texts that aren't null. Owners of more
    than ``crowd`` different pieces are split."""
    spark = docs.sparkSession
    size = F.octet_length("text")
    named = docs.where(size >= window).select("doc", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text", F.lit(2)).alias("h2"))
    first = named.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = C.written(named.join(first, ["h1", "h2"]).where("doc > least").select("doc").distinct())
    single = C.with_ids(docs.where(size >= window), copies, "doc", "left_anti")
    sketch = spark.sparkContext.broadcast(C.count_sketch(single.select("text"), lambda b: (kmer_hashes(raw, owner)[0] for _, _, raw, _ in C.text_chunks(b.column(0)))))
    item = F.collect_list(F.struct("start", "end")).alias("spans")

    def settled(pieces: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        """(doc, crowded, wanted): the pieces whose owner has several. (doc, spans, again): equal pieces, all but those of the smallest document, which are repeated as a whole; and the later places of pieces in the smallest document."""
        shared = C.written(C.neighbours(pieces, "owner", "spread"))
        least = C.written(shared.groupBy("owner", "whole").agg(F.min(F.struct("doc", "first")).alias("f"), F.first("count").alias("count")).select("owner", "whole", F.col("f.doc").alias("doc"), F.col("f.first").alias("first"), "count"))
        later = shared.join(least.select("owner", "whole", F.col("doc").alias("least")), ["owner", "whole"]).where("doc > least OR back > 0")
        span = F.struct(F.col("first").cast("long").alias("start"), (F.col("first") + F.col("count") + window - 1).cast("long").alias("end"))
        place = F.struct(F.lit(level).alias("level"), (F.col("first") - F.col("back")).alias("base"), "first", "count")
        later = C.written(later.groupBy("doc").agg(F.collect_list(F.when(F.col("doc") > F.col("least"), span)).alias("spans"), F.collect_list(F.when(F.col("doc") == F.col("least"), place)).alias("again")))
        C.dropped(shared)
        several = least.groupBy("owner").agg(F.count("*").alias("n")).where("n > 1")
        wanted = C.written(least.join(several, "owner").groupBy("doc", (F.col("n") > crowd).alias("crowded")).agg(F.collect_list(F.struct("owner", "first", (F.col("count") + window - 1).alias("bytes"))).alias("wanted")))
        C.dropped(least)
        return wanted, later

    def texts(wanted: DataFrame) -> DataFrame:
        return single.join(wanted, "doc").select("doc", "text", "wanted")

    wanted, later = settled(_pieces(single, sketch, window, owner, crowd), 0)
    spans, used, crowded = [later], [wanted], wanted.where("crowded")
    cut = _cut(texts(wanted.where("NOT crowded")))
    if not crowded.isEmpty():
        wanted, later = settled(_finer(texts(crowded), window, FINE_OWNER), 1)
        spans.append(later)
        used.append(wanted)
        cut = cut.unionByName(_cut(texts(wanted)))
    spans.append(C.written(_sorted_suffixes(cut, window).groupBy("doc").agg(item)).withColumn("again", F.array().cast(AGAIN)))
    for t in used:
        C.dropped(t)
    every = reduce(DataFrame.unionByName, spans).groupBy("doc").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "again")))
    return C.written(every.select("doc", F.lit(False).alias("copy"), "spans", "again").unionByName(copies.select("doc", F.lit(True).alias("copy"), F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.lit(None).cast(AGAIN).alias("again"))))


def with_equal_places(starts: np.ndarray, ends: np.ndarray, level: np.ndarray, base: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of one document, with those that begin among the ``count`` windows from ``base`` on once more at ``first``. Finer
    pieces (the higher level) lie within coarser ones, so they come first."""
    for step in sorted(set(level.tolist()), reverse=True):
        at = np.flatnonzero(level == step)
        order = np.argsort(starts, kind="stable")
        lo, hi = np.searchsorted(starts[order], base[at]), np.searchsorted(starts[order], base[at] + count[at])
        found, moved = order[C.ranges(lo, hi - lo)], np.repeat(first[at] - base[at], hi - lo)
        starts, ends = np.concatenate([starts, starts[found] + moved]), np.concatenate([ends, ends[found] + moved])
    return starts, ends


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, owner: int = OWNER, crowd: int = CROWD) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept): what is left of each text as UTF-8 bytes (binary).

    Null and empty texts stay empty. Ids are unique longs; a row with a null id is kept whole and removes nothing from
    others. Of repeated rows (one id twice), neither removes from the other. Texts of any length are read whole, in some
    hundred bytes for each of their bytes in the task that has them. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spans = repeated_spans(base.where("doc IS NOT NULL"), window, owner, crowd)

    def run(batches):
        for b in batches:
            texts, whole, spans, again = b.column(1), b.column(2).to_pylist(), b.column(3), b.column(4)
            raw, offs = C.utf8(texts)
            data, cut = raw.tobytes(), offs.tolist()
            n, removed, count, kept = [], [], [], []
            lists = spans.offsets.to_numpy()
            starts, ends = spans.values.field(0).to_numpy(), spans.values.field(1).to_numpy()
            others, places = again.offsets.to_numpy(), [again.values.field(k).to_numpy().astype(np.int64) for k in range(4)]
            null = spans.is_null().to_pylist()
            for i in range(len(texts)):
                t = data[cut[i] : cut[i + 1]]
                n.append(len(t))
                if whole[i]:
                    removed.append(len(t)), count.append(1), kept.append(b"")
                    continue
                if null[i]:
                    removed.append(0), count.append(0), kept.append(t)
                    continue
                mark = np.zeros(len(t) + 1, np.int32)
                start, end = starts[lists[i] : lists[i + 1]], ends[lists[i] : lists[i + 1]]
                if len(start) and others[i + 1] > others[i]:
                    start, end = with_equal_places(start, end, *(p[others[i] : others[i + 1]] for p in places))
                np.add.at(mark, start, 1)
                np.add.at(mark, end, -1)
                gone = np.cumsum(mark[:-1]) > 0
                removed.append(int(gone.sum()))
                count.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                kept.append(np.frombuffer(t, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], [id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    return C.map_batches(base.join(spans, "doc", "left").select("doc", "text", "copy", "spans", "again"), run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(C.documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same by the smallest document of every window of bytes, in hexadecimal digits.
ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
part AS (SELECT doc_id, n, o, substr(x, 2 * o + 1, {2 * (500 + WINDOW)}) AS x FROM (SELECT *, unnest(generate_series(0, n - {WINDOW}, 500)) AS o FROM d WHERE n >= {WINDOW})),
w AS (SELECT doc_id, o + k AS p, substr(x, 2 * k + 1, {2 * WINDOW}) AS s FROM (SELECT *, unnest(generate_series(0, least(499, n - {WINDOW} - o))) AS k FROM part)),
least AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING count(*) > 1),
gone AS (SELECT doc_id, p FROM w JOIN least USING (s) WHERE doc_id > low),
runs AS (SELECT doc_id, p, sum(CAST(first AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS run
         FROM (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > {WINDOW}, true) AS first FROM gone)),
span AS (SELECT doc_id, run, min(p) AS a, max(p) + {WINDOW} AS z FROM runs GROUP BY doc_id, run),
gap AS (SELECT s.doc_id, s.a, substr(d.x, 2 * coalesce(lag(s.z) OVER (PARTITION BY s.doc_id ORDER BY s.a), 0) + 1, 2 * (s.a - coalesce(lag(s.z) OVER (PARTITION BY s.doc_id ORDER BY s.a), 0))) AS x
        FROM span s JOIN d ON d.doc_id = s.doc_id),
head AS (SELECT doc_id, string_agg(x, '' ORDER BY a) AS x FROM gap GROUP BY doc_id),
tot AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans, max(z) AS z FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(t.removed, 0) AS BIGINT) AS n_removed, coalesce(t.spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN t.doc_id IS NULL THEN d.x ELSE h.x || substr(d.x, 2 * t.z + 1) END)) AS kept_sha256
FROM d LEFT JOIN tot t ON d.doc_id = t.doc_id LEFT JOIN head h ON d.doc_id = h.doc_id
"""
