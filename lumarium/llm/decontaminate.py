"""Benchmark decontamination with suffix arrays of the training texts.

Each task cuts its documents into shards of whole texts and sorts the word suffixes of a shard (to a depth of 12 words,
on 16-bit word symbols, four to a key). Every suffix of every benchmark item is then binary-searched in the shard: its
first 10 words, or the whole item when that has fewer. All places found are checked on a 64-bit hash of their words, marked in the
document, and runs along one item are joined to the longest verbatim matches. Documents stay in their task: nothing is
shuffled. The benchmark goes to the tasks in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW = 10
#: Benchmark text that is broadcast at once, in bytes (its index has some 30 MB); more is searched block after block.
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 1 << 20
STEP, LEVELS = 4, 3
SPLIT = C.is_alnum()
LOW = np.uint64(0)


class Suffixes:
    """The distinct windows of a block of items, in the order of their first symbols: word symbols, lengths, hashes, and the
    (item, place) pairs where each stands. About 50 bytes for each window."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        h, row = C.word_hashes(*C.utf8(pa.array([t for _, t in items], pa.large_string())), SPLIT)
        n = np.bincount(row, minlength=len(items))
        size = np.minimum(n, window)
        places = np.maximum(n - window + 1, (n > 0).astype(n.dtype))
        item = np.repeat(np.arange(len(items), dtype=np.int32), places)
        at = C.ranges(np.cumsum(n) - n, places)
        place = (at - np.repeat(np.cumsum(n) - n, places)).astype(np.int32)
        length = size[item].astype(np.uint8)
        value = window_hashes(h, window)[length.astype(int), at] if len(at) else np.zeros(0, np.uint64)
        _, first, which = np.unique(value, return_index=True, return_inverse=True)
        symbols = np.concatenate([h >> np.uint64(48), np.zeros(STEP * LEVELS, np.uint64)])
        low = np.zeros((LEVELS, len(first)), np.uint64)
        for j in range(STEP * LEVELS):
            known = length[first] > j
            low[j // STEP] |= np.where(known, symbols[at[first] + j], LOW) << np.uint64(16 * (STEP - 1 - j % STEP))
        order = np.argsort(low[0], kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.window, self.ids = window, [i for i, _ in items]
        self.low, self.length, self.value = low[:, order], length[first][order], value[first][order]
        which = rank[which.reshape(-1)]
        by = np.argsort(which, kind="stable")
        self.item, self.place = item[by], place[by]
        self.cuts = np.searchsorted(which[by], np.arange(len(order) + 1))

    def bounds(self, level: int, some=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest key that the words of each window allow on a level."""
        low = self.low[level][some]
        known = np.clip(self.length[some].astype(int) - level * STEP, 0, STEP)
        return low, low | (np.array([2**64 - 1, 2**48 - 1, 2**32 - 1, 2**16 - 1, 0], np.uint64)[known])

    def search(self, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, word position) of every place in a shard where a window stands whole within one text."""
        n = len(hashes)
        if not n or not len(self.length):
            return np.zeros(0, int), np.zeros(0, int)
        symbols = np.concatenate([hashes >> np.uint64(48), np.zeros(STEP + 1, np.uint64)])
        keys = np.zeros(n + 1, np.uint64)
        for j in range(STEP):
            keys[:n] |= symbols[j : j + n] << np.uint64(48 - 16 * j)
        array = C.prefix_sort(np.arange(n), keys, STEP, LEVELS)
        top = keys[array]
        least, most = self.bounds(0)
        lo, hi = np.searchsorted(top, least, "left"), np.searchsorted(top, most, "right")
        live = np.flatnonzero(lo < hi)
        lo, hi = lo[live], hi[live]
        for level in range(1, LEVELS):
            deep = np.flatnonzero(self.length[live] > level * STEP)
            for side, value, ends in zip(("left", "right"), self.bounds(level, live[deep]), (lo, hi), strict=True):
                a, b = lo[deep].copy(), hi[deep].copy()
                while len(go := np.flatnonzero(a < b)):
                    mid = (a[go] + b[go]) // 2
                    k = keys[np.minimum(array[mid] + level * STEP, n)]
                    right = k < value[go] if side == "left" else k <= value[go]
                    a[go], b[go] = np.where(right, mid + 1, a[go]), np.where(right, b[go], mid)
                if side == "left":
                    start = a
                else:
                    lo[deep], hi[deep] = start, a
            some = lo < hi
            live, lo, hi = live[some], lo[some], hi[some]
        window = np.repeat(live, hi - lo)
        at = array[C.ranges(lo, hi - lo)]
        length = self.length[window].astype(int)
        last = at + length - 1
        ok = last < n
        ok[ok] = row[last[ok]] == row[at[ok]]
        window, at, length = window[ok], at[ok], length[ok]
        good = window_hashes(hashes, self.window)[length, at] == self.value[window]
        return window[good], at[good]


def window_hashes(h: np.ndarray, window: int) -> np.ndarray:
    """(length, place): hash of as many words from each place on, on the 64-bit hashes of the words."""
    keys = C.mix(np.arange(1, window + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros((window + 1, len(h)), np.uint64)
    sums = np.zeros(len(h), np.uint64)
    for j in range(window):
        sums[: max(len(h) - j, 0)] += h[j:] * keys[j]
        out[j + 1] = C.mix(sums + np.uint64(j + 1))
    return out


def _runs(covered: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of covered words that stay in one text."""
    change = np.ones(len(row) + 1, bool)
    change[1:-1] = (row[1:] != row[:-1]) | (covered[1:] != covered[:-1])
    cut = np.flatnonzero(change)
    on = covered[cut[:-1]] if len(row) else np.zeros(0, bool)
    return cut[:-1][on], cut[1:][on]


def _longest(suffixes: Suffixes, window: np.ndarray, at: np.ndarray, row: np.ndarray, m: int) -> tuple[np.ndarray, ...]:
    """For each text the longest match, the first one of several: its words (0: none), its place among the shard's words,
    the item (its number) and the place there. Places follow each other both in the text and in one item."""
    count = np.diff(suffixes.cuts)[window]
    source = C.ranges(suffixes.cuts[window], count)
    item, place, pos, size = suffixes.item[source].astype(int), suffixes.place[source].astype(int), np.repeat(at, count), suffixes.length[np.repeat(window, count)].astype(int)
    o = np.lexsort((pos, pos - place, item, row[pos])) if len(pos) else np.zeros(0, int)
    item, place, pos, size = item[o], place[o], pos[o], size[o]
    out = [np.zeros(m, np.int64) for _ in range(4)]
    if len(pos):
        new = np.ones(len(pos), bool)
        new[1:] = (item[1:] != item[:-1]) | (pos[1:] - place[1:] != pos[:-1] - place[:-1]) | (pos[1:] != pos[:-1] + 1) | (row[pos[1:]] != row[pos[:-1]])
        first = np.flatnonzero(new)
        words = np.diff(np.append(first, len(pos))) - 1 + size[first]
        text, start = row[pos[first]], pos[first]
        best = np.lexsort((place[first], item[first], start, -words, text))
        best = best[np.concatenate([[True], text[best][1:] != text[best][:-1]])]
        for x, y in zip(out, (words, start, item[first], place[first]), strict=True):
            x[text[best]] = y[best]
    return tuple(out)


MATCH = "struct<words:bigint,start:bigint,item:string,item_start:bigint>"
FOUND = f"struct<n_words:bigint,starts:array<bigint>,ends:array<bigint>,items:array<string>,longest:{MATCH}>"


def _search_block(docs: DataFrame, suffixes, old: bool) -> DataFrame:
    """Adds to each row's ``found`` what a block of items hits in ``text``; word spans are merged with those found before."""

    def run(batches):
        s = suffixes.value
        for b in batches:
            text, before = b.column("text"), b.column("found").to_pylist() if old else None
            for lo, hi, raw, offs in C.text_chunks(text, SHARD_BYTES):
                m = hi - lo
                h, row = C.word_hashes(raw, offs, SPLIT)
                n = np.bincount(row, minlength=m)
                first = np.cumsum(n) - n
                window, at = s.search(h, row)
                mark = np.zeros(len(h) + 1, np.int32)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + s.length[window], -1)
                covered = np.cumsum(mark[:-1]) > 0
                pairs = np.unique(np.repeat(row[at], np.diff(s.cuts)[window]) * len(s.ids) + _items_of(s, window))
                items: list[set] = [set() for _ in range(m)]
                for r, i in zip(*(x.tolist() for x in np.divmod(pairs, max(len(s.ids), 1))), strict=True):
                    items[r].add(s.ids[i])
                words, start, item, place = _longest(s, window, at, row, m)
                longest = [{"words": w, "start": x - f, "item": s.ids[i], "item_start": p} if w else None for w, x, f, i, p in zip(*(x.tolist() for x in (words, start, first, item, place)), strict=True)]
                if old:
                    for i, f in enumerate(before[lo:hi]):
                        items[i].update(f["items"])
                        longest[i] = min((x for x in (f["longest"], longest[i]) if x), key=lambda x: (-x["words"], x["start"], x["item"]), default=None)
                        for a, z in zip(f["starts"], f["ends"], strict=True):
                            covered[first[i] + a : first[i] + z] = True
                start, end = _runs(covered, row)
                of = row[start]
                cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=m))]), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x - first[of], pa.int64())) for x in (start, end)]
                best = pa.array(longest, pa.struct([("words", pa.int64()), ("start", pa.int64()), ("item", pa.string()), ("item_start", pa.int64())]))
                found = pa.StructArray.from_arrays([pa.array(n, pa.int64()), *lists, pa.array([sorted(x) for x in items], pa.list_(pa.string())), best], ["n_words", "starts", "ends", "items", "longest"])
                yield pa.RecordBatch.from_arrays([b.column("row")[lo:hi], text[lo:hi], found], ["row", "text", "found"])

    schema = T.StructType([docs.schema["row"], docs.schema["text"], T.StructField("found", T._parse_datatype_string(FOUND))])
    return C.map_batches(docs, run, schema)


def _items_of(s: Suffixes, window: np.ndarray) -> np.ndarray:
    return s.item[C.ranges(s.cuts[window], np.diff(s.cuts)[window])].astype(int)


def search_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """(row, text, found): each row of docs as a struct with its text and what was found in it.

    ``found`` has the number of words, the merged word spans covered by windows, the ids (as strings, in order) of items of
    which a window occurs, and the longest verbatim match (words, first word in the text, item, first word in the item; null
    without a match). Null and wordless texts and items hit nothing; repeated
    items are all named; items with a null id are named "null". Rows that repeat an id, or have none, are each searched by
    their own text. Texts of any length are searched whole, in some hundred bytes for each of their bytes in the task that
    has them. Other columns of docs (those named in
    ``keep``, or all) pass through ``row``.
    """
    spark = docs.sparkSession
    docs = C.row_and_text(docs, text_col, keep)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = total // block_bytes + 1
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else items
        suffixes = spark.sparkContext.broadcast(Suffixes(sorted(tuple(r) for r in block.collect()), window))
        before, docs = docs, _search_block(docs, suffixes, k > 0)
        if k + 1 < blocks:
            docs = C.written(docs)
            suffixes.unpersist()
            if k:
                C.dropped(before)
    return docs


def contaminated() -> Column:
    return F.size("found.starts") > 0


def decontaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of docs in which no window of a benchmark item occurs, with their own columns."""
    return search_benchmark(docs, benchmark, **kw).where(~contaminated()).select("row.*")


def op7_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    found = search_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    n_hit = F.aggregate(F.zip_with("found.starts", "found.ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select("row.doc_id", "found.n_words", n_hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"), F.coalesce("found.longest.words", F.lit(0)).alias("longest_match"), F.col("found.longest.start").alias("match_start"), F.col("found.longest.item").alias("match_item"), F.col("found.longest.item_start").alias("match_item_start"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The same by a join of all windows.
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT item, least(len(w), {WINDOW}) AS n, w, unnest(generate_series(0, greatest(len(w) - {WINDOW}, 0))) AS place FROM i WHERE len(w) > 0),
win AS (SELECT item, n, place, array_to_string(w[place + 1 : place + n], ' ') AS s FROM iw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, w, unnest(generate_series(0, len(w) - n)) AS pos FROM d JOIN sizes ON len(w) >= n),
dwin AS (SELECT doc_id, n, pos, array_to_string(w[pos + 1 : pos + n], ' ') AS s FROM dw),
hit AS (SELECT doc_id, item, n, pos, place FROM dwin JOIN win USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(pos, pos + n - 1)) AS p FROM (SELECT DISTINCT doc_id, n, pos FROM hit)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id),
island AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item, pos - place ORDER BY pos) AS run FROM hit),
match AS (SELECT doc_id, item, min(pos) AS start, min(place) AS item_start, count(*) - 1 + arg_min(n, pos) AS words FROM island GROUP BY doc_id, item, pos - place, run),
best AS (SELECT * FROM match QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, start, item, item_start) = 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated,
  coalesce(b.words, 0) AS longest_match, b.start AS match_start, b.item AS match_item, b.item_start AS match_item_start
FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN named m ON d.doc_id = m.doc_id LEFT JOIN best b ON d.doc_id = b.doc_id
"""
