"""Cross-site boilerplate lines by distinct-site spread.

Each line hash gets a HyperLogLog sketch of its sites, and the first place where it stands; Spark merges both over its map
tasks by one aggregation. Lines whose estimate is far above the threshold are boilerplate and far below are not; for lines
near it (within three standard errors and one and a half sites) the distinct sites are counted exactly. Of a boilerplate
line the first place stays (smallest document, then line) and all others are removed.

Texts stay where they are: the boilerplate lines, few beside the corpus, go to all tasks when their counted number is within
BROADCAST_LINES, and each task marks the lines of its documents by binary search. Beyond that, the numbers of the lines to
remove are joined to the documents by a shuffle, with the same result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MIN_SITES, MIN_CHARS, LOG_K = 5, 20, 10
#: Boilerplate lines up to which they are sent to all tasks (32 bytes each).
BROADCAST_LINES = 1_000_000


def _hashes(line: Column, min_chars: int) -> tuple[Column, Column]:
    """Two hashes of a line without its outer blanks, null for a short one."""
    line = F.btrim(line, F.lit(" \t\r"))
    long = F.length(line) >= min_chars
    return F.when(long, F.xxhash64(line)), F.when(long, F.xxhash64(F.lit(1), line, F.lit(2)))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, log_k: int = LOG_K) -> tuple[DataFrame, DataFrame]:
    """(lines, first), two written tables: every long line of (doc, text, site) as (doc, no, h1, h2, site), and (h1, h2, doc,
    no) of boilerplate lines with their first place."""
    lines = docs.select("doc", "site", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    h1, h2 = _hashes(F.col("line"), min_chars)
    lines = C.written(lines.select("doc", "no", h1.alias("h1"), h2.alias("h2"), "site").where("h1 IS NOT NULL"))
    slack = 1.5 + 3 * min_sites * 1.04 / math.sqrt(2**log_k)
    sites = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(log_k)))
    spread = lines.groupBy("h1", "h2").agg(sites.alias("sites"), F.min(F.struct("doc", "no")).alias("first"))
    spread = C.written(spread.where(F.col("sites") >= min_sites - slack).select("h1", "h2", "sites", "first.doc", "first.no"))
    near = spread.where(F.col("sites") < min_sites + slack).drop("sites")
    exact = lines.where("site IS NOT NULL").select("h1", "h2", "site").join(C.small(near), ["h1", "h2"]).distinct()
    exact = exact.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.first("doc").alias("doc"), F.first("no").alias("no")).where(F.col("n") >= min_sites)
    first = C.written(spread.where(F.col("sites") >= min_sites + slack).drop("sites").unionByName(exact.drop("n")))
    C.dropped(spread)
    return lines, first


def _lists(values: np.ndarray, size: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Lists of the given sizes, one after the other; null where not valid."""
    cuts = pa.array(np.append(np.cumsum(size) - size, size.sum()).astype(np.int32), pa.int32(), mask=np.append(~valid, False))
    return pa.ListArray.from_arrays(cuts, pa.array(values))


def _sizes(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The length of each list (null: 0) and whether it is there."""
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    return np.where(valid, np.diff(lists.offsets.to_numpy()), 0), valid


def _marked(docs: DataFrame, first: DataFrame, min_chars: int) -> DataFrame:
    """Adds ``stays``, one boolean for each line, by search among the boilerplate lines in each task."""
    t = first.orderBy("h1", "h2").toArrow()
    h1, h2, doc, no = (t.column(c).to_numpy() for c in ("h1", "h2", "doc", "no"))
    repeats = int(np.diff(np.flatnonzero(np.concatenate([[True], h1[1:] != h1[:-1], [True]]))).max()) if len(h1) else 0
    shared = docs.sparkSession.sparkContext.broadcast((h1, h2, doc, no))

    def stays(ids: pa.Array, first_hash: pa.Array, second_hash: pa.Array) -> pa.Array:
        h1, h2, doc, no = shared.value
        size, valid = _sizes(first_hash)
        number = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        x, y = first_hash.flatten(), second_hash.flatten()
        own = np.repeat(ids.fill_null(0).to_numpy(), size)
        x, y, known = x.fill_null(0).to_numpy(), y.fill_null(0).to_numpy(), x.is_valid().to_numpy(zero_copy_only=False)
        at = np.searchsorted(h1, x)
        gone = np.zeros(len(x), bool)
        for k in range(repeats):  # lines that share the first hash are told apart by the second
            i = np.minimum(at + k, len(h1) - 1)
            gone |= known & (h1[i] == x) & (h2[i] == y) & ((doc[i] != own) | (no[i] != number))
        return _lists(~gone, size, valid)

    lines = F.when(F.col("doc").isNotNull(), F.split("text", "\n"))
    hashes = (F.transform(lines, lambda x: _hashes(x, min_chars)[0]), F.transform(lines, lambda x: _hashes(x, min_chars)[1]))
    return docs.withColumn("stays", F.arrow_udf(stays, "array<boolean>")("doc", *hashes))


def _joined(docs: DataFrame, lines: DataFrame, first: DataFrame) -> DataFrame:
    """The same by a join of line numbers with documents."""
    places = lines.join(first.select("h1", "h2", F.struct("doc", "no").alias("first")), ["h1", "h2"])
    gone = C.written(places.where(F.struct("doc", "no") != F.col("first")).groupBy("doc").agg(F.collect_set("no").alias("gone")))

    def stays(n: pa.Array, gone: pa.Array) -> pa.Array:
        out, at = np.ones(int(n.fill_null(0).to_numpy().sum()), bool), n.fill_null(0).to_numpy()
        size, valid = _sizes(gone)
        number = gone.flatten().to_numpy()
        own = number < np.repeat(at, size)  # rows of one id may have fewer lines than others of it
        out[(np.repeat(np.cumsum(at) - at, size) + number)[own]] = False
        return _lists(out, at, valid)

    mark = F.arrow_udf(stays, "array<boolean>")
    return docs.join(gone, "doc", "left").withColumn("stays", mark(F.when(F.col("gone").isNotNull(), F.size(F.split("text", "\n"))), "gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", keep: list[str] | None = None, broadcast_lines: int = BROADCAST_LINES, **kw) -> DataFrame:
    """(row, n_lines, n_removed, kept): each row of docs with what its text keeps.

    Lines end at "\\n" and are compared without outer blanks; shorter ones than ``min_chars`` always stay. A null text has
    no line and stays null, an empty text one empty line. Null sites count for no line. Rows that repeat an id are one
    document: where the first place of a line is in it, each of them keeps that line. A null id takes part in nothing and is
    kept whole. The work on a text is in proportion to its length, however many of its lines go. Other columns (those named in ``keep``, or all)
    pass through ``row``.
    """
    names = docs.columns if keep is None else keep
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{site_col}`").cast("string").alias("site"))
    lines, first = boilerplate(base.where("doc IS NOT NULL").select("doc", "text", "site"), **kw)
    min_chars = kw.get("min_chars", MIN_CHARS)
    out = _marked(base, first, min_chars) if first.count() <= broadcast_lines else _joined(base, lines, first)
    parts = F.split("text", "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: F.get("stays", i)), "\n")
    n = F.coalesce(F.when(F.col("text").isNotNull(), F.size(parts)), F.lit(0)).cast("long")
    removed = F.coalesce(F.size(F.filter("stays", lambda x: ~x)).cast("long"), F.lit(0))
    out = out.select("row", "text", "stays", n.alias("n_lines"), F.when(F.col("stays").isNotNull(), removed).otherwise(0).alias("n_removed"))
    return out.select("row", "n_lines", "n_removed", F.when(F.col("n_removed") == 0, F.col("text")).otherwise(kept).alias("kept"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(C.documents(spark, sf_dir), keep=["doc_id"])
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


#: The same by exact distinct counts.
ORACLE = f"""
WITH cut AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents),
numbered AS (SELECT doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS no FROM cut),
lines AS (SELECT doc_id, source, no, line, trim(line, chr(32) || chr(9) || chr(13)) AS name FROM numbered),
wide AS (SELECT name FROM lines WHERE length(name) >= {MIN_CHARS} GROUP BY name HAVING count(DISTINCT source) >= {MIN_SITES}),
placed AS (SELECT l.doc_id, l.no, row_number() OVER (PARTITION BY l.name ORDER BY l.doc_id, l.no) AS place FROM lines l JOIN wide w ON l.name = w.name),
gone AS (SELECT doc_id, no FROM placed WHERE place > 1),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.no) AS n_removed, string_agg(CASE WHEN g.no IS NULL THEN l.line END, chr(10) ORDER BY l.no) AS text
         FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.no = g.no GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
