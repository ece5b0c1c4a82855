"""Tables kept up to date: ratings, view history, cache index. A kept table is a folder of changes, partitioned by the batch that
made them; what a batch writes grows with what it changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import delete

VIEWS = "path STRING, count BIGINT, first BIGINT, last BIGINT"
CACHE = "url STRING, file STRING, fetched BIGINT, used BIGINT, bytes BIGINT"
RATINGS = "path STRING, stars INT"


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old with other keys."""
    return old.join(new, key, "left_anti").unionByName(new.select(*old.columns))


def ratings_from_json(df: DataFrame, body: str = "body") -> DataFrame:
    """(path, stars) of sidecar documents, each one JSON object; a broken one gives nothing."""
    return df.select(F.explode(F.from_json(body, "MAP<STRING,INT>")).alias("path", "stars")).where("stars IS NOT NULL")


def ratings_to_json(ratings: DataFrame) -> DataFrame:
    """One sidecar document per folder, so that no document grows with the table."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    pairs = F.array_sort(F.collect_list(F.struct("path", "stars")))
    return ratings.where("stars > 0").groupBy(folder.alias("folder")).agg(F.to_json(F.map_from_entries(pairs)).alias("body"))


# ---------------------------------------------------------------- tables of changes

#: A compaction every so many changes.
COMPACT_EVERY = 16


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the changes below path, ascending."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n[6:]) for n in names if n.startswith("batch="))


def write_changes(rows: DataFrame, path: str, batch: int, mode: str = "overwrite") -> None:
    """Writes the rows that a batch changes, and no others; rows with a true ``gone`` remove their key. A batch that is run
    twice replaces what it wrote."""
    rows = rows if "gone" in rows.columns else rows.withColumn("gone", F.lit(False))
    rows.write.mode(mode).parquet(f"{path}/batch={batch}")


def _changes(spark: SparkSession, path: str, schema: str, before: int | None) -> DataFrame:
    found = [b for b in _batches(spark, path) if before is None or b < before]
    if not found:
        return spark.createDataFrame([], f"{schema}, gone BOOLEAN, batch BIGINT")
    return spark.read.schema(f"{schema}, gone BOOLEAN, batch BIGINT").option("basePath", path).parquet(*(f"{path}/batch={b}" for b in found))


def read_changes(spark: SparkSession, path: str, schema: str, key: str, before: int | None = None) -> DataFrame:
    """The newest row of each key over all batches (those below ``before``), without the keys that are gone; empty when there
    is none. One aggregation, which combines on the map side."""
    rows = _changes(spark, path, schema, before)
    columns = [c for c in rows.columns if c not in ("gone", "batch")]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in columns if c != key), "gone"), "batch").alias("_r"))
    return newest.where("NOT _r.gone").select(*(F.col(key) if c == key else F.col(f"_r.{c}") for c in columns))


def compact(spark: SparkSession, path: str, schema: str, key: str, before: int) -> None:
    """Puts the newest rows of all batches below ``before`` into the last of them and deletes the others. A run that breaks
    off at any point, and one that is repeated, leaves the same table: equal rows of a key say the same, and older batches go
    first. Call it while ``before`` runs: batches below are never run again."""
    old = [b for b in _batches(spark, path) if b < before]
    if len(old) > 1:
        write_changes(read_changes(spark, path, schema, key, before), path, old[-1], "append")
        for b in old[:-1]:
            delete(spark, f"{path}/batch={b}")


def read_views(spark: SparkSession, path: str) -> DataFrame:
    return read_changes(spark, path, VIEWS, "path")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return read_changes(spark, path, CACHE, "url")


def upsert_views(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, "path")


def upsert_cache(index: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored blobs (url, file, fetched, bytes) enter the index as used when fetched."""
    return upsert(index, stored.withColumn("used", F.col("fetched")), "url")


def touch_cache(index: DataFrame, accesses: DataFrame) -> DataFrame:
    """Accesses (url, ts) move the time of last use forward."""
    last = accesses.groupBy("url").agg(F.max("ts").alias("_ts"))
    return index.join(last, "url", "left").withColumn("used", F.greatest("used", "_ts")).select(*index.columns)


def clear_cache(index: DataFrame) -> DataFrame:
    return index.limit(0)
