"""N-gram Jaccard join by filtering under several global token orders.

A document is the set of its distinct word shingles. Under any global order of shingles, two sets whose Jaccard similarity
reaches the threshold share a shingle among the first ``n - ceil(t * n) + 1`` of each (its prefix). Three orders are used:
from rare to frequent by a count sketch of the whole corpus, by ascending hash, and by descending hash. Prefixes of the
first order are shuffled by shingle, and a pair meets there at places which leave enough shingles to share. Prefixes of the
other two orders (32 bits of each hash) travel with the sets' sizes: only pairs that share a shingle in each of the three
prefixes, and which the parity bits of the two sets don't rule out (they differ in no more places than the sets do), have
their sets fetched and verified.

Near copies are not expanded into all pairs. Equal sets count once. In each bucket (documents that share a prefix shingle)
all members are first compared with one leader, the member whose prefix is most shared; then only with members of
components they don't belong to yet. Every link between different components is found, so components are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Production parameters: five words to a shingle, similarity in percent.
WORDS, PERCENT = 5, 75
SPLIT = C.is_space_split()
LEADER_ROUNDS = 2


def shingles(column: pa.Array, words: int = WORDS):
    """(first row, last row, shingle hashes ordered by row and hash, their rows) of runs of texts; distinct within each row."""
    for lo, hi, raw, offs in C.text_chunks(column):
        h, row = C.word_hashes(raw, offs, SPLIT)
        n = np.bincount(row, minlength=hi - lo)
        first = np.concatenate([[0], np.cumsum(n)])
        keys = C.mix(np.arange(1, words + 1, dtype=np.uint64))
        h = np.concatenate([h, np.zeros(words, np.uint64)])
        total = max(len(row), 0)
        s = np.zeros(total, np.uint64)
        pos = np.arange(total) - first[row]
        left = n[row] - pos
        for j in range(words):
            s += np.where(left > j, h[j : j + total] * (keys[j] | np.uint64(1)), np.uint64(0))
        # whole windows; of a text with fewer words, the sequence from its first word
        keep = (left >= words) | ((pos == 0) & (left < words))
        s, row = C.mix(s[keep] + np.minimum(n[row[keep]], words).astype(np.uint64)), row[keep]
        o = C.by_row(s, row)
        s, row = s[o], row[o]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
        yield lo, hi, s[new], row[new]


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def prefixes(s: np.ndarray, row: np.ndarray, n: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (and rows) of each row's prefix under the first order (sketch count, then hash)."""
    rank = (sketch[s >> np.uint64(64 - C.SKETCH_BITS)].astype(np.uint64) << np.uint64(32)) | (s >> np.uint64(32))
    o = C.by_row(rank, row)
    first = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(len(s)) - first[row]  # by_row keeps rows together and in order
    keep = place < prefix_length(n, percent)[row]
    return s[o][keep], row[keep]


def hash_prefixes(s: np.ndarray, n: np.ndarray, percent: int) -> tuple[list[bytes], list[bytes]]:
    """Upper halves of the hashes in each row's prefix by ascending and by descending hash. ``s`` ascends within rows."""
    half, size = (s >> np.uint64(32)).astype(np.uint32), prefix_length(n, percent)
    end = np.cumsum(n)
    low = [half[a : a + k].tobytes() for a, k in zip((end - n).tolist(), size.tolist(), strict=True)]
    return low, [half[b - k : b].tobytes() for b, k in zip(end.tolist(), size.tolist(), strict=True)]


def parity_bits(s: np.ndarray, row: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each set of n hashes, the parity of how many fall in each of 2**k places, with 2**k >= n (64 at least)."""
    width = np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    cuts = np.concatenate([[0], np.cumsum(1 << width)])
    place = cuts[row] + (s & ((np.uint64(1) << width[row].astype(np.uint64)) - np.uint64(1))).astype(np.int64)
    bits = np.packbits((np.bincount(place, minlength=cuts[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [bits[a:b] for a, b in zip((cuts[:-1] // 8).tolist(), (cuts[1:] // 8).tolist(), strict=True)]


def _differences(a: bytes, b: bytes) -> int:
    """Places in which two parity fields differ, the longer one folded to the length of the other."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _first_of_sets(seen: set, n: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Which rows are the first of their set that a task meets; empty sets are never."""
    new = np.zeros(len(n), bool)
    for i, key in enumerate(zip(sums[0].tolist(), sums[1].tolist(), strict=True)):
        if n[i] and key not in seen:
            seen.add(key)
            new[i] = True
    return new


FILTERS = "struct<bits:binary,low:binary,high:binary>"


def set_table(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, n, hi, lo, f): set size, 128-bit value of the set, and its filters (parity bits and the prefixes of the second and
    third order), the last only with the first document of each set that a task meets."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for b in batches:
            for lo, hi, s, row in shingles(b.column(1), words):
                n = np.bincount(row, minlength=hi - lo)
                sums = _set_values(s, row, n)
                new = _first_of_sets(seen, n, sums)
                filters = zip(parity_bits(s, row, n), *hash_prefixes(s, n, percent), strict=True)
                filters = [dict(zip(("bits", "low", "high"), x, strict=True)) if k else None for x, k in zip(filters, new.tolist(), strict=True)]
                kind = pa.struct([(c, pa.binary()) for c in ("bits", "low", "high")])
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), pa.array(filters, kind)], ["id", "n", "hi", "lo", "f"])

    return C.map_batches(docs, run, f"id long, n long, hi long, lo long, f {FILTERS}")


def shared_tokens(docs: DataFrame, sketch, words: int, percent: int) -> DataFrame:
    """Distinct (token, hi, pos) of first-order prefixes whose token stands in more than one row, with its place there. A task
    sends each set once."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for b in batches:
            for lo, hi, s, row in shingles(b.column(0), words):
                n = np.bincount(row, minlength=hi - lo)
                sums = _set_values(s, row, n)
                keep = _first_of_sets(seen, n, sums)[row]
                p, prow = prefixes(s[keep], row[keep], np.bincount(row[keep], minlength=hi - lo), sketch.value, percent)
                size = np.bincount(prow, minlength=hi - lo)
                pos = np.arange(len(prow)) - (np.cumsum(size) - size)[prow]
                yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(sums[0][prow]), pa.array(pos, pa.int32())], ["token", "hi", "pos"])

    return C.neighbours(C.map_batches(docs.select("text"), run, "token long, hi long, pos int"), "token").distinct()


def _set_values(s: np.ndarray, row: np.ndarray, n: np.ndarray) -> np.ndarray:
    first = np.cumsum(n) - n
    some = n > 0
    sums = np.zeros((2, len(n)), np.uint64)
    for k, x in enumerate((C.mix(s + np.uint64(1)), C.mix(s ^ np.uint64(0x5851F42D4C957F2D)))):
        if len(s):
            sums[k, some] = np.add.reduceat(x, first[some])
    return C.mix(sums + n.astype(np.uint64)).view(np.int64)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(hi, s) of the documents: sorted shingle hashes as binary."""

    def run(batches):
        for b in batches:
            for lo, hi, s, row in shingles(b.column(1), words):
                n = np.bincount(row, minlength=hi - lo)
                cuts = np.concatenate([[0], np.cumsum(n)]).tolist()
                blobs = [s[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(_set_values(s, row, n)[0]), pa.array(blobs, pa.binary())], ["hi", "s"])

    return C.map_batches(docs, run, "hi long, s binary")


def _meet(a: bytes, b: bytes, kind: type = np.uint64) -> int:
    """How many values two ascending lists share."""
    x, y = np.frombuffer(a, kind), np.frombuffer(b, kind)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def not_ruled_out(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of hi values that meet in the second and in the third order too, and whose parity bits allow the
    similarity: sets differ in (100 - p) / (100 + p) of their joint size at most, and in no fewer places than their bits."""
    x = reps.select(F.col("hi").alias("a"), F.col("n").alias("n_a"), F.col("f").alias("f_a"))
    y = reps.select(F.col("hi").alias("b"), F.col("n").alias("n_b"), F.col("f").alias("f_b"))

    def run(batches):
        for batch in batches:
            size = (batch.column(2).to_numpy() + batch.column(3).to_numpy()).tolist()
            keep = []
            for n, x, y in zip(size, batch.column(4), batch.column(5), strict=True):
                ok = (100 + percent) * _differences(x["bits"].as_py(), y["bits"].as_py()) <= (100 - percent) * n
                keep.append(ok and all(_meet(x[c].as_py(), y[c].as_py(), np.uint32) for c in ("low", "high")))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(y, "b").join(x, "a").select("a", "b", "n_a", "n_b", "f_a", "f_b")
    return C.map_batches(joined, run, "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of hi values whose sets have the similarity."""
    his = pairs.select(F.explode(F.array("a", "b")).alias("hi")).distinct()
    ids = C.written(reps.join(his, "hi").select("id"))
    sets = C.written(full_sets(C.with_ids(docs, ids, "id"), words))
    left, right = sets.select(F.col("hi").alias("b"), F.col("s").alias("y")), sets.select(F.col("hi").alias("a"), F.col("s").alias("x"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.as_py(), y.as_py()
                both = _meet(x, y)
                keep.append(100 * both >= percent * ((len(x) + len(y)) // 8 - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    out = C.written(C.map_batches(pairs.join(left, "b").join(right, "a").select("a", "b", "x", "y"), run, "a long, b long").distinct())
    C.dropped(sets)
    C.dropped(ids)
    return out


def joined_components(comp: DataFrame | None, new: DataFrame) -> DataFrame:
    """Components (node, component) of the links so far, of which ``comp`` has the components, and of new ones (a, b)."""
    if comp is None:
        return C.written(C.components(new))
    a, b = (comp.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of")) for c in "ab")
    over = new.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b"))
    top = C.written(C.components(over))
    moved = comp.join(top.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = C.written(moved.unionByName(top.join(comp, "node", "left_anti").select("node", "component")))
    C.dropped(top)
    C.dropped(comp)
    return out


def links(members: DataFrame, verify, percent: int) -> DataFrame:
    """Components (node, component) of the hi values, as all links between sets give them."""
    # what precedes the first shared token of a pair, in the order of the prefixes, is in one set only
    near = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("pos2")) * (100 + percent) >= (F.col("n") + F.col("m")) * percent
    done = None
    comp, scratch = None, []
    for k in range(LEADER_ROUNDS + 1):
        live = members
        if comp is not None:
            labelled = members.join(comp, members.hi == comp.node, "left").select("token", "hi", "pos", "n", "score", F.coalesce("component", "hi").alias("comp"))
            mixed = labelled.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
            live = C.written(labelled.join(mixed, "token"))
        if k < LEADER_ROUNDS:
            # the first round takes the most shared member of each bucket, the next one that of the members elsewhere
            if comp is None:
                lead = live.groupBy("token").agg(F.max(F.struct("score", "hi", "n", "pos")).alias("top")).select("token", F.col("top.hi").alias("lead"), F.col("top.n").alias("m"), F.col("top.pos").alias("pos2"))
                pairs = live.join(lead, "token").where(near)
            else:
                lead = live.groupBy("token", "comp").agg(F.max(F.struct("score", "hi", "n", "pos")).alias("top"))
                lead = lead.groupBy("token").agg(F.max(F.struct("top", "comp")).alias("one")).select("token", F.col("one.top.hi").alias("lead"), F.col("one.top.n").alias("m"), F.col("one.top.pos").alias("pos2"), F.col("one.comp").alias("lead_comp"))
                pairs = live.join(lead, "token").where(near & (F.col("comp") != F.col("lead_comp")))
            pairs = pairs.select(F.col("lead").alias("a"), F.col("hi").alias("b"))
        else:
            other = live.select("token", F.col("hi").alias("hi2"), F.col("n").alias("m"), F.col("pos").alias("pos2"), F.col("comp").alias("comp2"))
            pairs = live.join(other, "token").where((F.col("comp") < F.col("comp2")) & near).select(F.col("hi").alias("a"), F.col("hi2").alias("b"))
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = C.written(pairs)
        if live is not members:
            C.dropped(live)
        new = verify(pairs)
        scratch.append(pairs)
        done = pairs if done is None else done.unionByName(pairs)
        comp = joined_components(comp, new)
        C.dropped(new)
    for table in scratch:
        C.dropped(table)
    return comp


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id_col, n_shingles, component_id) for each row of docs.

    Rows with null or wordless text have no shingles and stay alone. ``component_id`` is the smallest id that links reach.
    Rows with a null id are left out. Rows that share an id give a row each, by their own texts, and stand for that id in
    their components. Texts of any length are compared whole: one needs some hundred bytes for each of its bytes in the task
    that has it. Other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    sketch = spark.sparkContext.broadcast(C.count_sketch(docs.select("text"), lambda b: (s for _, _, s, _ in shingles(b.column(0), words))))
    table = C.written(set_table(docs, words, percent))
    ids = table.where("n > 0").groupBy("hi", "lo").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("f", ignorenulls=True).alias("f"))
    members = C.written(shared_tokens(docs, sketch, words, percent))
    held = members.groupBy("hi").agg(F.count("*").alias("shared"))
    reps = C.written(ids.join(held, "hi"))
    score = reps.groupBy("hi").agg(F.first("n").alias("n"), F.max(F.col("shared") / (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).alias("score"))
    tokens, members = members, C.written(members.join(score, "hi"))
    C.dropped(tokens)

    def verify(pairs: DataFrame) -> DataFrame:
        left = C.written(not_ruled_out(pairs, reps, percent))
        out = verified(left, docs, reps, words, percent)
        C.dropped(left)
        return out

    comp = links(members, verify, percent)
    C.dropped(members)
    C.dropped(reps)
    by_set = ids.join(comp, ids.hi == comp.node, "left").select("hi", "lo", "id", F.coalesce("component", "hi").alias("comp"), F.when(F.col("node").isNotNull(), True).alias("linked"))
    # a hi value stands for one set, or by chance for two: only linked ones share a component
    key = F.when(F.col("linked"), F.struct(F.col("comp").alias("x"), F.lit(0).cast("long").alias("y"))).otherwise(F.struct(F.col("hi").alias("x"), F.col("lo").alias("y")))
    by_set = by_set.withColumn("key", key)
    low = by_set.groupBy("key").agg(F.min("id").alias("component_id"))
    named = by_set.join(low, "key").select("hi", "lo", "component_id")
    whole = table.select("id", "n", "hi", "lo")
    return whole.where("n > 0").join(named, ["hi", "lo"]).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id").unionByName(whole.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(C.documents(spark, sf_dir))


#: The same by a join of all shingles.
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - {WORDS - 1}, 1))) AS k FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + {WORDS - 1}], ' ') AS shingle FROM placed),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= {PERCENT} * (x.n + y.n - m)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
