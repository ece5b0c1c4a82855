"""Vector best-fit packing of token ids into sequences.

A document's ids and its end id are cut into pieces, and every piece takes three things of a sequence: tokens, a place among
its documents, and attention cost (the square of its length). Pieces of one length take the same, so that the corpus is
packed by its histogram, one row for each length: the largest come first, as many copies at a time as there are. Of the
open sequences that can take a piece under every capacity, the one with the smallest weighted norm of what is then left of
its capacities is filled first, or the one with the largest weighted dot product of what it has left and what the piece
takes. Sequences with equal contents stay one entry with a count. Each rule is tried on the histogram, and the plan with the
fewest sequences holds.

The plan is as large as the histogram allows, not as the corpus: it goes to all tasks, and each piece finds its sequence by
its number among the pieces of its length, which comes from the counts in each part of the table. No piece is shuffled for it
but by its part, and no sequence is left half full because a task ended.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .bpe import SPECIAL, Encoder, _pattern, tokenizer_path

MAX_TOKENS, END_ID = 1024, 2
#: Rules of choice: (norm or dot, weights of tokens, documents and attention cost).
RULES = (("norm", (1.0, 0.0, 0.0)), ("norm", (1.0, 0.05, 0.05)), ("norm", (1.0, 0.2, 0.2)), ("dot", (1.0, 0.2, 0.2)))


# ---------------------------------------------------------------- the plan


def needs(length) -> np.ndarray:
    return np.array([length, 1, length * length], np.int64)


def best_fit(histogram: dict[int, int], capacity: tuple[int, int, int], rule: str, weights: tuple) -> tuple[np.ndarray, int]:
    """(plan, sequences). A row of the plan is (length, first number, count, first sequence, copies in each, offset of the
    first): pieces of that length from that number on go to that sequence and those after it."""
    cap, w = np.array(capacity, np.int64), np.array(weights)
    left, count, first = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    plan, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        need, n, number = needs(length), histogram[length], 0
        while n:
            fits = np.flatnonzero((left >= need).all(1))
            if not len(fits):  # as many new sequences as the rest needs
                copies = int((cap // need).min())
                left = np.concatenate([left, cap[None]])
                count, first = np.append(count, -(-n // copies)), np.append(first, sequences)
                sequences += int(count[-1])
                fits = np.array([len(left) - 1])
            after = left[fits] - need
            score = (w * (after / cap) ** 2).sum(1) if rule == "norm" else -(w * (left[fits] / cap) * (need / cap)).sum(1)
            k = int(fits[np.argmin(score)])
            copies = int((left[k] // need).min())
            used = min(int(count[k]), -(-n // copies))
            take = min(n, used * copies)
            plan.append((length, number, take, first[k], copies, cap[0] - left[k, 0]))
            n, number = n - take, number + take
            # the entry falls into sequences with all the copies, one with fewer, and those that got none
            full, some = divmod(take, copies)
            parts = [(left[k] - copies * need, full, first[k]), (left[k] - some * need, 1 if some else 0, first[k] + full), (left[k], count[k] - used, first[k] + used)]
            parts = [p for p in parts if p[1] and p[0][:2].min() > 0]
            keep = np.arange(len(left)) != k
            left = np.concatenate([left[keep], *(p[0][None] for p in parts)])
            count, first = np.concatenate([count[keep], [p[1] for p in parts]]).astype(np.int64), np.concatenate([first[keep], [p[2] for p in parts]]).astype(np.int64)
    return np.array(plan, np.int64).reshape(-1, 6), sequences


def fewest(histogram: dict[int, int], capacity: tuple[int, int, int], rules: tuple = RULES) -> tuple[np.ndarray, int]:
    """The plan with the fewest sequences over the rules, the first of equal ones."""
    return min((best_fit(histogram, capacity, *r) for r in rules), key=lambda p: p[1])


# ---------------------------------------------------------------- pieces


def pieces(docs: DataFrame, longest: int, id_col: str, text_col: str, ranks: str | None, special: dict[str, int] | None, end_id: int) -> DataFrame:
    """(id, piece, start, length, ids, part, seq): seq numbers the pieces of one length in a part of the table."""
    ranks, pattern, special = ranks or tokenizer_path("byte_bpe_50k.tiktoken"), _pattern(), SPECIAL if special is None else special

    def run(batches):
        enc, part, seen = Encoder(ranks, pattern, special), TaskContext.get().partitionId(), np.zeros(longest + 1, np.int64)
        for b in batches:
            for own, text in zip(b.column(0), b.column(1), strict=True):
                ids = np.append(enc.whole((text.as_py() or "").encode()), np.uint32(end_id)).astype("<u4")
                rest = len(ids) % longest
                cut = np.concatenate([[0], np.arange(rest or longest, len(ids) + 1, longest)])
                length = np.diff(cut)
                seq = seen[length].copy()
                seq[1 if rest else 0 :] += np.arange(len(length) - (1 if rest else 0))  # pieces but for the first one have one length
                np.add.at(seen, length, 1)
                data, n = ids.tobytes(), len(length)
                blobs = [data[4 * x : 4 * y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([own.as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(cut[:-1]), pa.array(length), pa.array(blobs, pa.binary()), pa.array([part] * n, pa.int32()), pa.array(seq)], ["id", "piece", "start", "length", "ids", "part", "seq"])

    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return C.map_batches(base, _joined(run), "id long, piece int, start long, length long, ids binary, part int, seq long")


def _joined(run, rows: int = 2000):
    """Small batches of ``run`` put together."""

    def whole(batches):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return whole


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, max_documents: int | None = None, max_cost: int | None = None, end_id: int = END_ID, ranks: str | None = None, special: dict[str, int] | None = None, rules: tuple = RULES) -> DataFrame:
    """(id, piece, start, length, ids, sequence_id, offset): where each piece of each document goes, with its ids (binary,
    little-endian unsigned 32-bit).

    A sequence has at most ``max_tokens`` tokens, ``max_documents`` pieces and ``max_cost`` as the sum of squared lengths; the
    defaults of the last two are those that tokens alone allow. A document is cut only where it is longer than a sequence
    may be, by tokens or cost; all pieces but the first are of that length. Null and empty texts have the end id alone. Rows
    that repeat an id, or have none, are documents of their own. Pieces of one length are alike to the plan, so which of them
    goes where hangs on the files of the table only. Texts are encoded whole, whatever their length. Other columns are
    ignored. An empty table has no pieces.
    """
    capacity = (max_tokens, max_tokens if max_documents is None else max_documents, max_tokens**2 if max_cost is None else max_cost)
    if min(capacity) < 1:
        raise ValueError("every capacity must let a piece of one token in")
    longest = min(max_tokens, math.isqrt(capacity[2]))
    cut = C.written(pieces(docs, longest, id_col, text_col, ranks, special, end_id))
    counts = C.written(cut.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # a row for each length at most
    plan, _ = fewest(histogram, capacity, rules)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    shared = docs.sparkSession.sparkContext.broadcast(plan[order])

    def placed(length: pa.Array, number: pa.Array) -> pa.Array:
        t, length, number = shared.value, length.to_numpy(), number.to_numpy()
        # both in one sorted key: numbers are below 2**48
        row = t[np.searchsorted((t[:, 0] << 48) + t[:, 1], (length << 48) + number, "right") - 1] if len(length) else t[:0]
        q, r = np.divmod(number - row[:, 1], row[:, 4])
        return pa.StructArray.from_arrays([pa.array(row[:, 3] + q), pa.array(row[:, 5] + r * length)], ["sequence_id", "offset"])

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    number = cut.join(counts.select("part", "length", before.alias("before")), ["part", "length"]).withColumn("number", F.col("before") + F.col("seq"))
    at = F.arrow_udf(placed, "sequence_id long, offset long")("length", "number")
    return number.withColumn("at", at).select("id", "piece", "start", "length", "ids", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, documents, ids): the ids of each sequence in order, and (id, piece, offset) of what is in it."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "id", "piece", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", "n_tokens", F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["piece"].alias("piece"), x["offset"].alias("offset"))).alias("documents"), ids.alias("ids"))


def op12_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(C.documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
