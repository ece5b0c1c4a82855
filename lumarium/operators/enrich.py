"""Joins: lookups of ratings, views, statuses, rules and colours for tables of media records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import pieces


def with_ratings(cat: DataFrame, ratings: DataFrame, key: str = "path") -> DataFrame:
    return cat.join(ratings.select(key, "stars"), key, "left").withColumn("stars", F.coalesce("stars", F.lit(0)))


def effective_rating(attrs: DataFrame, sidecar: DataFrame, key: str = "path") -> DataFrame:
    """A rating kept with the file goes before the one in the sidecar table."""
    a, s = attrs.select(key, F.col("stars").alias("own")), sidecar.select(key, F.col("stars").alias("side"))
    return a.join(s, key, "full").select(key, F.coalesce(F.nullif("own", F.lit(0)), "side", F.lit(0)).alias("stars"))


def with_views(cat: DataFrame, views: DataFrame, key: str = "path") -> DataFrame:
    out = cat.join(views.select(key, "count", "first", "last"), key, "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return out.withColumn("visited", F.col("count") > 0)


def unseen(cat: DataFrame, views: DataFrame, key: str = "path") -> DataFrame:
    return cat.join(views.where("count > 0"), key, "left_anti")


def seen(cat: DataFrame, views: DataFrame, key: str = "path") -> DataFrame:
    return cat.join(views.where("count > 0"), key, "left_semi")


def owned_flagged(owned: DataFrame, installed: DataFrame, key: str = "appid") -> DataFrame:
    ids = installed.select(key, F.lit(True).alias("installed")).distinct()
    return owned.join(ids, key, "left").withColumn("installed", F.coalesce("installed", F.lit(False)))


def with_status(files: DataFrame, status: DataFrame, root: str) -> DataFrame:
    """Status of each file: null outside the root, clean when inside and not listed."""
    inside = (F.col("path") == root) | F.startswith("path", F.lit(root.rstrip("/") + "/"))
    out = files.join(status.select("path", "status"), "path", "left")
    return out.withColumn("status", F.when(inside, F.coalesce("status", F.lit("clean"))))


def cache_split(wanted: DataFrame, index: DataFrame, key: str = "url") -> tuple[DataFrame, DataFrame]:
    """(hits, to fetch)."""
    return wanted.join(index, key, "left_semi"), wanted.join(index, key, "left_anti")


def robots_verdict(urls: DataFrame, rules: DataFrame, url: str = "url", parts: int | None = None) -> DataFrame:
    """Adds ``allowed``: the longest rule whose prefix the path starts with decides, allowing wins ties, none allows; a URL
    without an origin meets no rule.

    Rules and paths of an origin are put in one order, in range partitions. The rules that are prefixes of a path are the last
    rule at or before it, or prefixes of that one: so each rule comes with the lengths of the rules it starts with, the last
    rule is carried forward to the paths, and a path tells by comparing with it which of the lengths hold. An origin with most
    paths lies in many partitions, and no path is expanded."""
    split = X.split_url(url)
    base = urls.select("*", split["origin"].alias("_origin"), split["path"].alias("_path"))
    kinds = rules.where(F.col("prefix").isNotNull()).groupBy(F.col("origin").alias("_origin"), F.col("prefix").alias("_prefix"))
    kinds = kinds.agg(F.max(F.col("kind") == "disallow").alias("d"), F.max(F.col("kind") == "allow").alias("a"))
    # rules of an origin are one file's: each is probed for the rules that it starts with
    lengths = kinds.groupBy("_origin").agg(F.collect_set(F.length("_prefix")).alias("_lengths"))
    probes = kinds.join(lengths, "_origin").select("_origin", "_prefix", F.explode("_lengths").alias("n")).where(F.col("n") <= F.length("_prefix"))
    probes = probes.withColumn("_start", F.expr("substring(_prefix, 1, n)"))
    above = kinds.select("_origin", F.col("_prefix").alias("_start"), "d", "a")
    chain = probes.join(above, ["_origin", "_start"]).groupBy("_origin", "_prefix").agg(F.collect_list(F.struct("n", "d", "a")).alias("chain"))
    rule = chain.select("_origin", F.col("_prefix").alias("_path"), F.lit(0).alias("_kind"), F.struct(F.col("_prefix").alias("text"), "chain").alias("_rule"))
    paths = base.select("_origin", "_path").where("_path IS NOT NULL").distinct()
    both = rule.unionByName(paths.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    met = pieces.carried(both, ["_origin"], ["_path", "_kind"], F.col("_rule"), "_last", parts).where("_kind = 1")
    held = F.filter("_last.chain", lambda x: F.substr("_path", F.lit(1), x["n"]) == F.substr("_last.text", F.lit(1), x["n"]))
    longest = lambda flag: F.array_max(F.transform(F.filter("_held", lambda x: x[flag]), lambda x: x["n"]))
    best = met.withColumn("_held", held).select("_origin", "_path", longest("d").alias("_d"), longest("a").alias("_a"))
    out = base.join(best, ["_origin", "_path"], "left")
    verdict = F.col("_d").isNull() | (F.coalesce("_a", F.lit(-1)) >= F.col("_d"))
    return out.withColumn("allowed", verdict).drop("_origin", "_path", "_d", "_a")


def artist_via_packs(artists: DataFrame, pieces: DataFrame) -> DataFrame:
    """Pieces of each (artist, packs) row, found through its packs: a piece names its artists joined by ", "."""
    wanted = artists.select("artist", F.explode("packs").alias("pack")).distinct()
    named = pieces.withColumnRenamed("artist", "credit").withColumn("_name", F.explode(F.array_distinct(F.transform(F.split("credit", ","), lambda x: F.lower(F.trim(x))))))
    return wanted.withColumn("_name", F.lower("artist")).join(named, ["pack", "_name"]).drop("_name")


def overlay(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """All rows of primary, and those of fallback with other keys."""
    return primary.unionByName(fallback.join(primary, key, "left_anti"))


def lookup_default(df: DataFrame, dim: DataFrame, key: str, value: str, default_key: str = "other") -> DataFrame:
    """Adds the dimension's value for each row, or that of its row ``default_key``."""
    default = dim.where(F.col(key) == default_key).agg(F.first(value).alias("_default"))  # one row
    return df.join(dim.select(key, value), key, "left").crossJoin(F.broadcast(default)).withColumn(value, F.coalesce(value, "_default")).drop("_default")


def _scopes(name: Column) -> Column:
    parts = F.split(name, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), ".").alias("scope"), k.alias("depth")))


def scope_join(df: DataFrame, rules: DataFrame, name: str = "scope") -> DataFrame:
    """Adds the value of the most specific rule (scope, value): trailing dotted parts are dropped until one exists."""
    names = df.select(F.col(name).alias("_name")).distinct()
    probes = names.select("_name", F.explode(_scopes(F.col("_name"))).alias("_s")).select("_name", "_s.scope", "_s.depth")
    best = probes.join(rules.select("scope", "value"), "scope").groupBy("_name").agg(F.max_by("value", "depth").alias("value"))
    return df.join(best, F.col(name) == F.col("_name"), "left").drop("_name")


def first_match(df: DataFrame, rules: DataFrame, key: str, candidates: str = "candidates") -> DataFrame:
    """Adds the value of the first of a row's candidate scopes for which a rule exists."""
    listed = df.select(key, F.posexplode(candidates).alias("_pos", "_scope"))
    found = scope_join(listed, rules, "_scope").where("value IS NOT NULL").groupBy(key).agg(F.min_by("value", "_pos").alias("value"))
    return df.join(found, key, "left")


def new_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files (path, mtime) that a snapshot gained, without hidden ones, newest first."""
    name = X.last_part("path")
    return after.join(before, "path", "left_anti").where(~F.startswith(name, F.lit("_")) & ~F.startswith(name, F.lit("."))).orderBy(F.desc("mtime"), "path")


def changed_files(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files (path, size, mtime) whose change key has no completed marker (key)."""
    return files.withColumn("key", X.change_key("path", "size", "mtime")).join(done.select("key"), "key", "left_anti")
