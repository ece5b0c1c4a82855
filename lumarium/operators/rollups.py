"""Aggregations over views, caches, folders, samples, instruments and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def cache_stats(index: DataFrame) -> DataFrame:
    return index.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("entries"))


def view_counts(events: DataFrame, key: str = "path", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """(path, count, first, last) of views in the order of arrival (seq): the first time that isn't zero, and the last."""
    first = F.min_by(F.when(F.col(ts) != 0, F.col(ts)), F.when(F.col(ts) != 0, F.col(seq)))
    return events.groupBy(key).agg(F.count("*").alias("count"), F.coalesce(first, F.lit(0)).alias("first"), F.max_by(ts, seq).alias("last"))


def set_viewed(views: DataFrame, keys: DataFrame, flag: bool, now: int, key: str = "path") -> DataFrame:
    """Marks keys as seen (those already seen keep their record) or forgets them."""
    if not flag:
        return views.join(keys, key, "left_anti")
    seen = views.where("count > 0")
    new = keys.select(key).distinct().join(seen, key, "left_anti")
    # a record without views gains one; its first time stays
    old = views.join(new, key).select(key, F.lit(1).cast("bigint").alias("count"), F.when(F.col("first") == 0, F.lit(now)).otherwise(F.col("first")).cast("bigint").alias("first"), F.lit(now).cast("bigint").alias("last"))
    fresh = new.join(views, key, "left_anti").select(key, F.lit(1).cast("bigint").alias("count"), F.lit(now).cast("bigint").alias("first"), F.lit(now).cast("bigint").alias("last"))
    return views.join(new, key, "left_anti").unionByName(old).unionByName(fresh)


def folder_counts(cat: DataFrame, path: str = "path") -> DataFrame:
    """How many records lie anywhere below each folder."""
    return cat.select(F.explode(X.ancestors(path)).alias("folder")).groupBy("folder").agg(F.count("*").alias("items"))


def peaks(samples: DataFrame, window: int = 512, width: int = 900, key: str = "sound_id", cap: int = 12_000_000) -> DataFrame:
    """(key, col, peak): the envelope in ``width`` columns, as shares of the loudest.

    Frames are pooled in windows of ``window``; column i takes windows [i*n/W, (i+1)*n/W), one at least. Each window finds its
    own columns, so there is no join.
    """
    env = samples.where(F.col("frame") < cap).groupBy(key, F.expr(f"frame div {window}").alias("w")).agg(F.max(F.abs("amp")).alias("peak"))
    n = F.count("*").over(Window.partitionBy(key))
    env = env.withColumn("n", n)
    # the columns that window w belongs to
    many = F.array(F.expr(f"((w + 1) * {width} - 1) div n"))
    few = F.expr(f"sequence((w * {width} + n - 1) div n, ((w + 1) * {width} + n - 1) div n - 1)")
    cols = env.select(key, F.explode(F.when(F.col("n") >= width, many).otherwise(few)).alias("col"), "peak").groupBy(key, "col").agg(F.max("peak").alias("peak"))
    top = F.greatest(F.max("peak").over(Window.partitionBy(key)), F.lit(1e-4))
    return cols.select(key, "col", F.least(F.greatest(F.col("peak") / top, F.lit(0.0)), F.lit(1.0)).alias("peak"))


def sfz_summary(ops: DataFrame, key: str = "id") -> DataFrame:
    """(key, regions, samples, key_lo, key_hi) of instrument opcodes (key, pos, opcode, value)."""
    note = X.parse_note("value")
    low, high = F.col("opcode").isin("lokey", "key"), F.col("opcode").isin("hikey", "key")
    return ops.groupBy(key).agg(
        F.count(F.when((F.col("opcode") == "<header>") & (F.col("value") == "region"), True)).alias("regions"),
        F.countDistinct(F.when(F.col("opcode") == "sample", F.replace("value", F.lit("\\"), F.lit("/")))).alias("samples"),
        F.min(F.when(low, note)).alias("key_lo"),
        F.max(F.when(high, note)).alias("key_hi"),
    )


def bounds(points: DataFrame, key: str = "mesh_id") -> DataFrame:
    """(key, cx, cy, cz, radius): centre of the box around each group's points, and the farthest point's distance from it."""
    box = points.groupBy(key).agg(*((F.min(a) + F.max(a)).alias(f"s{a}") for a in "xyz"))
    centred = points.join(box, key)
    d2 = sum(((F.col(a) - F.col(f"s{a}") * 0.5) * (F.col(a) - F.col(f"s{a}") * 0.5) for a in "xyz"), F.lit(0.0))
    far = centred.groupBy(key).agg(F.max(d2).alias("d2"), *(F.first(f"s{a}").alias(f"s{a}") for a in "xyz"))
    return far.select(key, *((F.col(f"s{a}") * 0.5).alias(f"c{a}") for a in "xyz"), F.greatest(F.sqrt("d2"), F.lit(1e-4)).alias("radius"))


def bounds_or_default(meshes: DataFrame, points: DataFrame, key: str = "mesh_id") -> DataFrame:
    """As bounds, with centre 0 and radius 1 for meshes without points."""
    out = meshes.select(key).distinct().join(bounds(points, key), key, "left")
    return out.select(key, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("cx", "cy", "cz")), F.coalesce("radius", F.lit(1.0)).alias("radius"))


def bucket_representatives(df: DataFrame, cover: str, total: int, priority: str, keep: list[str]) -> DataFrame:
    """Of each share of cover (in ``total`` steps) the row with the smallest priority."""
    return df.groupBy(F.round(F.col(cover) * total).cast("int").alias("bucket")).agg(F.min_by(F.struct(*keep), priority).alias("r")).select("bucket", "r.*")


def anim_length(frames: DataFrame, key: str = "image_id") -> DataFrame:
    """Milliseconds of an animation: each delay (num / den) within 20..65535, 100 when undefined."""
    ms = F.least(F.greatest(F.coalesce(F.expr("CASE WHEN den <> 0 THEN num div den END"), F.lit(100)), F.lit(20)), F.lit(65_535))
    return frames.groupBy(key).agg(F.sum(ms).cast("bigint").alias("total_ms"))


def dir_stats(files: DataFrame, length: str = "length") -> DataFrame:
    return files.agg(F.coalesce(F.sum(length), F.lit(0)).alias("bytes"), F.count("*").alias("files"))
