"""Token-id files of patched frame-of-reference blocks.

A segment holds the ids of consecutive documents in blocks of 256. A block subtracts its minimum and packs every value at
the width of its 95th percentile; values that need more bits keep their low bits in place and their high bits in an
exception list. Layout of a segment, all little-endian:

    "PFR1" | n_docs, n_values, n_blocks, data_words (u32 each) | doc ids (i64) | ids per document (u32)
    | block minimum (u32) | block starts (u32, in words of the data) | exceptions per block (u16) | block width (u8)
    | data: per block 8 * width words of packed values, then for its exceptions the places (u8, padded) and high bits (u32)

Texts are encoded where they are read, and only their ids (16 bits each where the vocabulary allows) are put in order.
Segments are written in ascending order of document ids as rows of a Parquet table in the shared folder, so that writers
and readers need nothing but Spark's file systems.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .bpe import tokenizer_path

BLOCK, PERCENTILE, END_ID = 256, 95, 1
SEGMENT_IDS = 1 << 18
#: Pieces of text whose ids a worker keeps (some 40 bytes each), and bytes of text of one part of the ordered output.
STORE_PIECES, PART_BYTES = 1 << 19, 16 << 20


# ---------------------------------------------------------------- the format


def _bits(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    v = np.zeros(blocks * BLOCK, np.uint64)
    v[:n] = ids
    if n % BLOCK:
        v[n:] = v[n - 1]
    v = v.reshape(blocks, BLOCK)
    low = v.min(1) if blocks else np.zeros(0, np.uint64)
    v = v - low[:, None]
    place = -(-BLOCK * PERCENTILE // 100) - 1
    width = _bits(np.partition(v, place, axis=1)[:, place]) if blocks else np.zeros(0, np.int64)
    high = v >> width.astype(np.uint64)[:, None]
    where, at = np.nonzero(high)
    n_exc = np.bincount(where, minlength=blocks)
    words = 8 * width + -(-n_exc // 4) + n_exc
    start = np.cumsum(words) - words
    data = np.zeros(int(words.sum()), np.uint32)
    for w in np.unique(width).tolist():
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        part = np.ascontiguousarray((v[rows] & np.uint64((1 << w) - 1)).T)  # one row for each place of a block
        out = np.zeros((8 * w + 2, len(rows)), np.uint64)
        for j in range(BLOCK):
            word, shift = divmod(j * w, 32)
            x = part[j] << np.uint64(shift)
            out[word] |= x & np.uint64(0xFFFFFFFF)
            out[word + 1] |= x >> np.uint64(32)
        data[start[rows][:, None] + np.arange(8 * w)] = out[: 8 * w].T.astype(np.uint32)
    if len(where):
        k = np.arange(len(where)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
        lists = start[where] + 8 * width[where]
        data.view(np.uint8)[4 * lists + k] = at
        data[lists + -(-n_exc[where] // 4) + k] = high[where, at]
    head = np.array([len(doc_ids), n, blocks, len(data)], "<u4")
    return b"".join([b"PFR1", head.tobytes(), doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), low.astype("<u4").tobytes(), start.astype("<u4").tobytes(), n_exc.astype("<u2").tobytes(), width.astype("u1").tobytes(), data.astype("<u4").tobytes()])


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, ids per document, and all ids of a segment."""
    if blob[:4] != b"PFR1":
        raise ValueError("not a segment of this format")
    docs, n, blocks, size = np.frombuffer(blob, "<u4", 4, 4).tolist()
    at = 20

    def take(kind: str, m: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(blob, kind, m, at)
        at += x.nbytes
        return x

    doc_ids, counts, low, start = take("<i8", docs), take("<u4", docs), take("<u4", blocks), take("<u4", blocks).astype(np.int64)
    n_exc, width, data = take("<u2", blocks).astype(np.int64), take("u1", blocks).astype(np.int64), np.append(take("<u4", size), np.zeros(2, "<u4"))
    v = np.zeros((blocks, BLOCK), np.uint64)
    for w in np.unique(width).tolist():
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        part = np.ascontiguousarray(data[start[rows][:, None] + np.arange(8 * w + 1)].T).astype(np.uint64)
        out = np.empty((BLOCK, len(rows)), np.uint64)
        for j in range(BLOCK):
            word, shift = divmod(j * w, 32)
            out[j] = ((part[word] | (part[word + 1] << np.uint64(32))) >> np.uint64(shift)) & np.uint64((1 << w) - 1)
        v[rows] = out.T
    if n_exc.any():
        where = np.repeat(np.arange(blocks), n_exc)
        k = np.arange(len(where)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
        lists = start[where] + 8 * width[where]
        place = data.view(np.uint8)[4 * lists + k]
        v[where, place] |= data[lists + -(-n_exc[where] // 4) + k].astype(np.uint64) << width[where].astype(np.uint64)
    return doc_ids, counts.astype(np.int64), (v + low[:, None].astype(np.uint64)).reshape(-1)[:n].astype(np.uint32)


def read_block(blob: bytes, k: int) -> np.ndarray:
    """The ids of block k alone, by the index of block starts."""
    docs, n, blocks, _ = np.frombuffer(blob, "<u4", 4, 4).tolist()
    at = 20 + 12 * docs
    low, start = np.frombuffer(blob, "<u4", 1, at + 4 * k)[0], int(np.frombuffer(blob, "<u4", 1, at + 4 * (blocks + k))[0])
    n_exc, width = int(np.frombuffer(blob, "<u2", 1, at + 8 * blocks + 2 * k)[0]), blob[at + 10 * blocks + k]
    body = at + 11 * blocks + 4 * start
    bits = int.from_bytes(blob[body : body + 32 * width], "little")
    v = [(bits >> (j * width)) & ((1 << width) - 1) for j in range(BLOCK)]
    lists = body + 32 * width
    for i in range(n_exc):
        high = int(np.frombuffer(blob, "<u4", 1, lists + 4 * (-(-n_exc // 4) + i))[0])
        v[blob[lists + i]] |= high << width
    return (np.array(v[: min(BLOCK, n - k * BLOCK)], np.int64) + int(low)).astype(np.uint32)


# ---------------------------------------------------------------- encoding by pieces

SPACE, LETTER, DIGIT, MARK, OTHER = range(5)


def _kinds() -> np.ndarray:
    t = np.full(256, OTHER, np.uint8)
    t[[32, *range(9, 14)]] = SPACE
    t[65:91] = t[97:123] = LETTER
    t[48:58] = DIGIT
    t[33:48] = t[58:65] = t[91:97] = t[123:127] = MARK
    t[39] = OTHER  # an apostrophe may join what stands around it
    return t


KINDS = _kinds()
RESERVED = re.compile(rb"<\|startoftext\|>|<\|endoftext\|>")


def pieces(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of stretches that the tokenizer encodes on their own: it drops white space, takes each digit alone,
    and never joins letters with digits or marks. Only ASCII and the letters of Latin-1 are cut so; whatever else stands in
    a text keeps its neighbours, up to the next white space."""
    n = len(raw)
    kind = KINDS[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]  # not the signs of multiplication and division
    kind[lead] = kind[lead + 1] = LETTER
    before = np.full(n, SPACE, np.uint8)
    before[1:] = kind[:-1]
    bounds = offs[1:-1]
    bounds = bounds[bounds < n]
    before[bounds] = SPACE
    cut = (before == SPACE) | ((kind != OTHER) & (before != OTHER) & ((kind != before) | (kind == DIGIT)))
    for m in RESERVED.finditer(raw.tobytes()):
        cut[m.start() + 1 : m.end()] = False
    if len(bounds):
        cut[bounds] = True
    held = kind != SPACE
    start = np.flatnonzero(cut & held)
    last = np.ones(n, bool)
    last[:-1] = cut[1:] | ~held[1:]
    return start, np.flatnonzero(last & held) + 1, np.searchsorted(offs, start, "right") - 1


class PieceEncoder:
    """Encodes texts piece by piece; the ids of a text are those of its pieces. Distinct pieces are encoded once and kept by
    their 64-bit hashes in an open table with one place for each hash and a sorted list for those whose place is taken. When
    the store is full, the half that was used last stays. A worker process has one encoder for all its tasks."""

    def __init__(self, path: str, capacity: int = STORE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.capacity, self.clock = capacity, 0
        self.bits = max(4, int(capacity - 1).bit_length() + 2)
        self.slots = np.empty(1 << self.bits, np.int32)
        # arrays of entries, with room for more, and of all their ids, one entry's after the other's
        self.hashes, self.used, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.counts, self.ids = np.zeros(0, np.int32), np.zeros(0, self.kind)
        self._clear()

    def _clear(self) -> None:
        self.n, self.n_ids = 0, 0
        self.slots.fill(-1)
        self.rest_hash, self.rest = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _add(self, hashes: np.ndarray, used: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        old, n, m = self.n, self.n + len(hashes), self.n_ids + len(ids)
        for name, size in (("hashes", n), ("used", n), ("first", n), ("counts", n), ("ids", m)):
            x = getattr(self, name)
            if len(x) < size:
                setattr(self, name, np.concatenate([x, np.zeros(max(size, len(x) // 2 * 3) - len(x), x.dtype)]))
        self.hashes[old:n], self.used[old:n], self.counts[old:n] = hashes, used, counts
        self.first[old:n] = self.n_ids + np.cumsum(counts) - counts
        self.ids[self.n_ids : m] = ids
        self.n, self.n_ids = n, m
        slot, own = (hashes >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(old, n, dtype=np.int32)
        free = self.slots[slot] < 0
        self.slots[slot[free]] = own[free]
        rest = np.flatnonzero(self.slots[slot] != own)
        rest = rest[np.argsort(hashes[rest])]
        at = np.searchsorted(self.rest_hash, hashes[rest])
        self.rest_hash, self.rest = np.insert(self.rest_hash, at, hashes[rest]), np.insert(self.rest, at, own[rest])

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each piece in the store, or -1."""
        at = self.slots[(h >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        if not self.n:
            return at
        miss = np.flatnonzero((at < 0) | (self.hashes[at] != h))
        at[miss] = -1
        if len(self.rest):
            k = np.minimum(np.searchsorted(self.rest_hash, h[miss]), len(self.rest) - 1)
            at[miss] = np.where(self.rest_hash[k] == h[miss], self.rest[k], -1)
        return at

    def _shrink(self) -> None:
        keep = np.sort(np.argsort(self.used[: self.n], kind="stable")[-(self.capacity // 2) :])
        held = self.hashes[keep], self.used[keep], self.counts[keep], self.ids[C.ranges(self.first[keep], self.counts[keep])]
        self._clear()
        self._add(*held)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for lo in range(0, len(texts), 1000):  # the library's own results take much memory
            out += [np.array(x.ids, self.kind) for x in self.tokenizer.encode_batch_fast(texts[lo : lo + 1000], add_special_tokens=False)]
        return out

    def texts(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        start, end, row = pieces(raw, offs)
        h = C.span_hash(C.prefix_hash(raw), start, end)
        if self.n > self.capacity:
            self._shrink()
        self.clock += 1
        at = self._find(h)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            new, first, which = np.unique(h[miss], return_index=True, return_inverse=True)
            data = raw.tobytes()
            s, e = start[miss[first]].tolist(), end[miss[first]].tolist()
            out = self._encode([data[a:b].decode() for a, b in zip(s, e, strict=True)])
            at[miss] = self.n + which
            self._add(new, np.full(len(new), self.clock, np.int32), np.array([len(x) for x in out]), np.concatenate(out))
        self.used[at] = self.clock
        counts = self.counts[at]
        return self.ids[C.ranges(self.first[at], counts)], np.bincount(row, counts, len(offs) - 1).astype(np.int64)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder_for(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------- files


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, bounds: np.ndarray) -> DataFrame:
    """(part, id, wide, ids, tie) of (id, text): the number of bounds at or below the id, and little-endian ids with the end
    id, of 16 bits or, where ``wide``, of 32."""

    def run(batches):
        enc = encoder_for(tokenizer)
        wide = enc.kind is np.uint32 or end_id >= 1 << 16
        kind = "<u4" if wide else "<u2"
        for b in batches:
            for lo, hi, raw, offs in C.text_chunks(b.column(1)):
                ids, counts = enc.texts(raw, offs)
                ends = np.cumsum(counts)
                data = np.insert(ids.astype(kind), ends, end_id)
                cuts = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * data.itemsize
                blobs = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
                own = b.column(0)[lo:hi]
                part = pa.array(np.searchsorted(bounds, own.to_numpy(), "right"), pa.int32())
                yield pa.RecordBatch.from_arrays([part, own, pa.array([wide] * (hi - lo)), blobs.cast(pa.binary())], ["part", "id", "wide", "ids"])

    return C.map_batches(docs, run, "part int, id long, wide boolean, ids binary").withColumn("tie", F.xxhash64("ids"))


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of every text, each followed by ``end_id``, as segments in ascending order of document ids.

    Null texts count as empty and have the end id alone. Rows with a null id are left out. Rows that share an id follow each
    other in the order of a hash of their token ids, then of these, so that the files don't depend on how rows are dealt.
    Texts of any length are encoded whole. Other columns are ignored.
    """
    tokenizer = tokenizer or tokenizer_path("word_bpe_49k.json")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).where("id IS NOT NULL")
    parts = (base.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES + 1
    # the parts follow each other by id; where the cuts lie, approximately, doesn't show in the result
    cuts = base.approxQuantile("id", [k / parts for k in range(1, parts)], max(0.1 / parts, 1e-5)) if parts > 1 else []
    bounds = np.array(sorted({int(x) for x in cuts}), np.int64)

    def run(batches):
        part, seq, before = None, 0, 0
        ids, data, size = [], [], 0

        def segment():
            counts = np.array([len(x) for x in data])
            blob = pack(np.array(ids, np.int64), counts, np.concatenate(data))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([blob], pa.binary())], ["part", "seq", "before", "n_values", "segment"])

        for b in batches:
            for p, i, wide, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    if ids:
                        yield segment()
                    part, seq, before, ids, data, size = p, 0, 0, [], [], 0
                ids.append(i)
                data.append(np.frombuffer(x, "<u4" if wide else "<u2"))
                size += len(data[-1])
                if size >= SEGMENT_IDS:
                    yield segment()
                    ids, data, size, seq, before = [], [], 0, seq + 1, before + size
        if ids:
            yield segment()

    encoded = _encoded(base, tokenizer, end_id, bounds)
    ordered = encoded.repartition(int(parts), "part").sortWithinPartitions("part", "id", "tie", "ids").select("part", "id", "wide", "ids")
    C.map_batches(ordered, run, SEGMENTS).write.parquet(path)


SEGMENTS = "part int, seq int, before long, n_values long, segment binary"


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids): each document of the files, with the ids of all before it counted in ``start``."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_values").alias("n"))
    # one row for each task that wrote: their running total is short work for one task
    offset = C.written(totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset")))

    def run(batches):
        for b in batches:
            for blob, offset in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                docs, counts, ids = unpack(blob.as_py())
                ends = np.cumsum(counts)
                data, cut = ids.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(offset + ends - counts), pa.array(counts), pa.array([data[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["id", "start", "n_tokens", "ids"])

    placed = files.join(C.small(offset), "part").select("segment", (F.col("offset") + F.col("before")).alias("offset"))
    return C.map_batches(placed, run, "id long, start long, n_tokens long, ids binary")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = C.scratch_dir(spark)
    write_token_files(C.documents(spark, sf_dir), path)
    return read_token_files(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
