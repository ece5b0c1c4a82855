"""Filters over tables of media records, and the column predicates they use."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Col = Column | str


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def words_in(query: str, cols: list[Col]) -> Column:
    """Whether every word of the query is a part of the joined, lower-cased columns."""
    hay = F.lower(F.concat_ws(" ", *cols))
    return _all([F.contains(hay, F.lit(w)) for w in query.lower().split()])


def match_words(df: DataFrame, query: str, cols: list[Col]) -> DataFrame:
    return df.where(words_in(query, cols))


def glob(col: Col, pattern: str) -> Column:
    """Whole-string match of a mask of ``*`` and ``?``, without regard to case."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.lower())
    return F.lower(col).rlike(rf"(?s)\A{body}\z")


def glob_any(col: Col, mask: str) -> Column:
    """``a;b|c``: any of the masks before the bar (all when blank) and none of those after it."""
    include, _, exclude = mask.strip().partition("|")
    wanted, unwanted = ([p.strip() for p in s.split(";") if p.strip()] for s in (include, exclude))
    keep = _any([glob(col, p) for p in wanted]) if include.strip() else F.lit(True)
    return keep & ~_any([glob(col, p) for p in unwanted])


def facet_filter(df: DataFrame, col: str, query: str, limit: int = 100) -> DataFrame:
    """The first names that contain the query, without regard to case."""
    return df.where(F.contains(F.lower(col), F.lit(query.lower()))).select(col).distinct().orderBy(col).limit(limit)


def criteria(name: str | None = None, exts: list[str] | None = None, width: tuple | None = None, height: tuple | None = None, size: tuple | None = None, modified: tuple | None = None, min_stars: int | None = None, trailer: str | None = None) -> Column:
    """Conjunction of the criteria given; a range is (low, high), either may be None. Plain comparisons reach the scan."""
    out = [F.contains(F.lower("name"), F.lit(name.lower()))] if name else []
    if exts:
        out.append(F.col("ext").isin([e.lower() for e in exts]))
    for col, bounds in (("width", width), ("height", height), ("size", size), ("modified", modified)):
        low, high = bounds or (None, None)
        out += [F.col(col) >= F.lit(low)] if low is not None else []
        out += [F.col(col) <= F.lit(high)] if high is not None else []
    if min_stars is not None:
        out.append(F.col("stars") >= min_stars)
    if trailer:
        out.append(F.contains(F.lower(F.concat_ws(" ", "title", "artist", "grp")), F.lit(trailer.lower())))
    return _all(out)


def advanced_search(df: DataFrame, **wanted) -> DataFrame:
    return df.where(criteria(**wanted))


#: Prefixes of the names of tools and runtimes.
TOOL_PREFIXES = ("proton", "steam linux runtime", "steamworks common")
TOOL_NAMES = ("steamvr",)


def is_nongame(name: Col) -> Column:
    n = F.lower(name)
    return _any([F.startswith(n, F.lit(p)) for p in TOOL_PREFIXES]) | n.isin(*TOOL_NAMES)


def smart_filter(df: DataFrame, seed: DataFrame, attr: str) -> DataFrame:
    """Rows like a seed row in one attribute: ``ext``, ``grp``, ``artist``, ``stars`` and ``modified`` (its day) by equality,
    ``size`` within a fifth, ``word`` by the first word of its name. The seed is one row, hence broadcast."""
    one = seed.limit(1)
    if attr == "size":
        low = one.select((F.col("size") * 0.8).alias("_low"), (F.col("size") * 1.2).alias("_high"))
        on = F.col("size").between(F.col("_low"), F.col("_high"))
        extra = ["_low", "_high"]
    elif attr == "word":
        low = one.select(F.regexp_extract(F.lower("name"), "([a-z0-9]+)", 1).alias("_word"))
        on, extra = F.contains(F.lower("name"), F.col("_word")), ["_word"]
    else:
        value = F.to_date(attr) if attr == "modified" else F.col(attr)
        low = one.select(value.alias("_value"))
        on, extra = value == F.col("_value"), ["_value"]
    return df.join(F.broadcast(low), on, "inner").drop(*extra)


def run_saved(df: DataFrame, saved: dict) -> DataFrame:
    """A saved search on another scope."""
    return advanced_search(df, **saved)


def fresh(now: Col, fetched: Col = "fetched", ttl: Col = "ttl") -> Column:
    """Stale when strictly older than its time to live; without one it never is."""
    now, fetched, ttl = (F.col(x) if isinstance(x, str) else x for x in (now, fetched, ttl))
    return ttl.isNull() | (now - fetched <= ttl)


def ttl_for(url: Col) -> Column:
    """Seconds for which a kind of URL stays fresh: contents never expire, the latest feed does in an hour, lists in a day."""
    u = F.col(url) if isinstance(url, str) else url
    return F.when(F.contains(u, F.lit("/pack/")), F.lit(None).cast("bigint")).when(F.contains(u, F.lit("/latest")), F.lit(3600).cast("bigint")).otherwise(F.lit(86_400).cast("bigint"))


def within_cap(size: Col, most: int) -> Column:
    s = F.col(size) if isinstance(size, str) else size
    return s.isNull() | (s <= most)


def search_ext(df: DataFrame, query: str, n: int, ext: str, cols: list[Col], order: list) -> DataFrame:
    """The first hits of one extension."""
    return df.where((F.col("ext") == ext) & words_in(query, cols)).orderBy(*order).limit(min(max(n, 1), 240))


def source_of(path: Col, roots: dict[str, str]) -> Column:
    """Name of the source whose root a path starts with; null for other paths."""
    table = F.create_map(*(F.lit(x) for kv in roots.items() for x in kv))
    return F.try_element_at(table, F.substring_index(path, "/", 1))


def rel_parts(path: Col, roots: dict[str, str]) -> Column:
    """The parts of a path below its source's root; none for other paths."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    below = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(source_of(path, roots).isNotNull(), below).otherwise(F.array().cast("array<string>"))


def or_dash(col: Col) -> Column:
    """A list as text, or a dash when empty."""
    return F.when(F.coalesce(F.size(col), F.lit(0)) <= 0, F.lit("—")).otherwise(F.array_join(col, ", "))


def details(df: DataFrame, keep: list[str], lists: list[str]) -> DataFrame:
    return df.select(*keep, *(or_dash(c).alias(c) for c in lists))


def is_partial(name: Col, id_: Col) -> Column:
    """Leftovers of an unfinished download of ``id_``."""
    n = F.col(name) if isinstance(name, str) else name
    i = F.col(id_) if isinstance(id_, str) else id_
    ends = F.endswith(n, F.lit(".part")) | F.endswith(n, F.lit(".ytdl"))
    return F.startswith(n, F.concat(i, F.lit("."))) & (ends | F.contains(n, F.lit(".part-")) | F.contains(n, F.lit(".f")))


def find_in_text(df: DataFrame, needle: str, text: str = "text") -> DataFrame:
    """Every place (1-based) of a needle in a text, left to right, not overlapping: adds (no, at)."""
    parts = F.split(F.col(text), re.escape(needle), -1)
    start = F.array(F.lit(1).cast("bigint"))
    # each place is the one before it, plus the needle and the text between
    places = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), start, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x) + len(needle))))
    return df.where(F.contains(text, F.lit(needle))).select("*", F.posexplode(F.slice(places, 2, F.size(places) - 1)).alias("no", "at")).withColumn("at", F.col("at") - len(needle))


def name_filter(df: DataFrame, query: str, col: str = "name") -> DataFrame:
    return df.where(F.contains(F.lower(col), F.lit(query.lower())))

