"""Window functions, ordered folds, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import pieces

EVICT_BATCH = 512


def victims(index: DataFrame, cap: int, batch: int = EVICT_BATCH) -> DataFrame:
    """Rows to evict: when the total exceeds the cap, the least recently used ones (ties by url) until the excess is gone, at
    most ``batch``. The ordered window runs over that bounded batch only."""
    total = index.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("_total"))
    oldest = index.orderBy("used", "url").limit(batch)
    before = F.sum("bytes").over(Window.orderBy("used", "url").rowsBetween(Window.unboundedPreceding, -1))
    marked = oldest.withColumn("_before", F.coalesce(before, F.lit(0))).crossJoin(F.broadcast(total))
    return marked.where(F.col("_before") < F.col("_total") - cap).drop("_before", "_total")


def evict(index: DataFrame, cap: int, batch: int = EVICT_BATCH) -> DataFrame:
    return index.join(victims(index, cap, batch).select("url"), "url", "left_anti")


def dedup_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key. A row's place decides, so a partial aggregation does: no key is sorted as a whole."""
    rest = [c for c in df.columns if c not in key]
    place = F.struct(*order)
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), place).alias("_r")).select(*key, "_r.*").select(*df.columns) if rest else df.distinct()


def dedup_adjacent(df: DataFrame, key: str, order: list, within: list[str], parts: int | None = None) -> DataFrame:
    """Drops rows whose key equals that of the row just before them; equal keys apart from each other stay."""
    out = pieces.beside(df, within, order, F.col(key), "_was", parts=parts)
    return out.where(F.col("_was").isNull() | ~F.col(key).eqNullSafe(F.col("_was.v"))).drop("_was")


def schedule(requests: DataFrame, gap: Column, host: str = "host", arrival: str = "arrival", order: tuple = ("id",), parts: int | None = None) -> DataFrame:
    """Adds ``start``: no request of a host starts before its arrival, nor before the one before it plus the gap (a column of
    the request). A host's requests may lie in any number of partitions."""
    return pieces.chained(requests, [host], [arrival, *order], F.col(arrival), gap.cast("bigint"), "start", parts)


def neighbours(df: DataFrame, item: str, order: list, within: list[str], parts: int | None = None) -> DataFrame:
    """Adds ``previous`` and ``next``: the items beside each row of its group, null at the ends."""
    out = pieces.beside(df, within, order, F.col(item), "_previous", "_next", parts)
    return out.select(*df.columns, F.col("_previous.v").alias("previous"), F.col("_next.v").alias("next"))


def suppress_repeats(lines: Column) -> Column:
    """A list of lines without those that equal, or end, the last line that was kept."""

    def step(kept: Column, line: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        return F.when(F.coalesce(F.endswith(last, line), F.lit(False)), kept).otherwise(F.concat(kept, F.array(line)))

    return F.aggregate(lines, F.array().cast("array<string>"), step)


def last_wins(rules: DataFrame, key: str, value: str, pos: str = "pos") -> DataFrame:
    return rules.groupBy(key).agg(F.max_by(value, pos).alias(value))


def first_wins(rules: DataFrame, key: str, value: str, pos: str = "pos") -> DataFrame:
    return rules.groupBy(key).agg(F.min_by(value, pos).alias(value))


def resolve_samples(ops: DataFrame, base: Column, key: str = "id") -> DataFrame:
    """(key, pos, path): sample paths of an instrument in order, below the ``default_path`` given last before each; the first
    of equal paths stays."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    slash = F.replace("value", F.lit("\\"), F.lit("/"))
    folder = F.last(F.when(F.col("opcode") == "default_path", slash), ignorenulls=True).over(w)
    found = ops.withColumn("_folder", F.coalesce(folder, F.lit(""))).where(F.col("opcode") == "sample")
    rel = F.when(F.startswith(slash, F.lit("/")), slash).otherwise(F.concat_ws("/", F.when(F.startswith("_folder", F.lit("/")), F.lit(None)).otherwise(base), F.nullif("_folder", F.lit("")), slash))
    paths = found.select(key, "pos", X.normalize_path(rel).alias("path"))
    return paths.groupBy(key, "path").agg(F.min("pos").alias("pos")).select(key, "pos", "path")


def robots_groups(lines: DataFrame, key: list[str], pos: str = "no") -> DataFrame:
    """Adds ``grp``: agent lines that follow each other open one group; lines of unknown kinds are gone before."""
    w = Window.partitionBy(*key).orderBy(pos)
    header = F.col("kind") == "user-agent"
    opens = header & ~F.coalesce(F.lag(header).over(w), F.lit(False))
    return lines.withColumn("_opens", opens.cast("int")).withColumn("grp", F.sum("_opens").over(w)).drop("_opens")


def ordinal_names(df: DataFrame, stem: str, order: list, within: list[str], parts: int | None = None) -> DataFrame:
    out = pieces.numbered(df, within, order, parts=parts)
    return out.withColumn("name", F.concat(F.lpad(F.col("_n").cast("string"), 3, "0"), F.lit("_"), F.col(stem))).drop("_n")


#: Rows of a key up to which each map task keeps its own first ones, before they are shuffled.
FIRST_ROWS = 1000


def paginate(df: DataFrame, size: int, order: list, within: list[str], max_pages: int | None = None, parts: int | None = None) -> DataFrame:
    """Adds ``page``. Where few pages are wanted, map tasks sort out all rows of a key but so many, so that a key sends a
    bounded number of rows from each task; else rows are numbered over range partitions."""
    wanted = max_pages and size * max_pages
    if wanted and wanted <= FIRST_ROWS:
        # a plain bound on row_number lets Spark keep the first rows before its shuffle
        out = df.withColumn("_n", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("_n") <= wanted)
    else:
        out = pieces.numbered(df, within, order, parts=parts)
        out = out.where(F.col("_n") <= wanted) if wanted else out
    return out.withColumn("page", F.ceil(F.col("_n") / size).cast("int")).drop("_n")


def recents(events: DataFrame, n: int, key: str = "path", ts: str = "ts") -> DataFrame:
    return events.groupBy(key).agg(F.max(ts).alias("last")).orderBy(F.desc("last"), key).limit(n)


# ---------------------------------------------------------------- sorts and top-k


def sort_catalogue(df: DataFrame, by: str, desc: bool = False, dirs_first: bool = True) -> DataFrame:
    """By name, type, modified, created, size, rating or colors; equal ones by name, then path."""
    key = {"name": F.lower("name"), "type": F.lower("ext"), "rating": F.col("stars")}.get(by, F.col(by))
    first = [F.desc("is_dir")] if dirs_first else []
    return df.orderBy(*first, key.desc() if desc else key.asc(), F.lower("name"), "path")


def by_popularity(df: DataFrame) -> DataFrame:
    return df.orderBy("popularity", "family")


def by_downloads(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("downloads"), "name")


def by_name_ci(df: DataFrame, name: str = "name", tie: tuple = ()) -> DataFrame:
    return df.orderBy(F.lower(name), name, *tie)


def by_index(df: DataFrame, tie: tuple = ()) -> DataFrame:
    return df.orderBy(F.asc_nulls_last("index"), *tie)


def by_year(df: DataFrame, tie: tuple = ()) -> DataFrame:
    return df.orderBy(F.desc("year"), *tie)


def top_n(df: DataFrame, n: int, lo: int, hi: int, order: list) -> DataFrame:
    """The first rows; the number asked for is kept within what the source gives."""
    return df.orderBy(*order).limit(min(max(n, lo), hi))


def random_pick(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(F.md5(F.concat_ws(":", key, F.lit(seed))), key).limit(1)


def search_modules(keyed: DataFrame, keyless: DataFrame, n: int) -> DataFrame:
    """Modules (page, pos, id, ...) by page: the keyed source's rows where it has any for the page, else the keyless one's;
    the first of equal ids, at most n (1..400)."""
    use = keyed.unionByName(keyless.join(keyed.select("page").distinct(), "page", "left_anti"), allowMissingColumns=True)
    return dedup_first(use, ["id"], ["page", "pos"]).orderBy("page", "pos").limit(min(max(n, 1), 400))
