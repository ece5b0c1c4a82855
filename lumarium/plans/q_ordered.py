"""Queries of window functions and folds (W), sorts and top-k (O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered as W
from . import base
from .base import CAT, catalogue, query, table
from .q_enrich import opcodes

EVICT = """o AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY used, url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY used, url) AS rn, sum(bytes) OVER () AS total FROM cache)"""


@query("w01_evict", f"WITH {base.CACHE}, {EVICT} SELECT url, bytes FROM o WHERE NOT (rn <= 512 AND before < total - 5000000)")
def w01(spark, d):
    base.utc(spark)
    return W.evict(base.cache_index(spark, d), 5_000_000).select("url", "bytes")


@query("w02_dedup_first", f"WITH {base.LINKS} SELECT page_id, href, min(pos) AS pos FROM links GROUP BY page_id, href")
def w02(spark, d):
    return W.dedup_first(base.links(spark, d).select("page_id", "href", "pos"), ["page_id", "href"], ["pos"])


@query("w03_dedup_adjacent", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) WHERE was IS DISTINCT FROM event_type")
def w03(spark, d):
    return W.dedup_adjacent(table(spark, d, "events"), "event_type", ["event_id"], ["user_id"]).select("user_id", "event_id", "event_type")


@query("w04_schedule", "WITH r AS (SELECT user_id % 10 AS host, epoch_us(ts) AS arrival, event_id AS id FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY arrival, id) AS i FROM r) SELECT host, id, max(arrival - i * 1800000000) OVER (PARTITION BY host ORDER BY arrival, id ROWS UNBOUNDED PRECEDING) + i * 1800000000 AS start FROM n")
def w04(spark, d):
    base.utc(spark)
    r = table(spark, d, "events").select((F.col("user_id") % 10).alias("host"), F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival"), F.col("event_id").alias("id"))
    return W.schedule(r, F.lit(1_800_000_000)).select("host", "id", "start")


@query("w05_neighbours", "SELECT doc_id, lag(doc_id) OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) AS previous, lead(doc_id) OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) AS next FROM documents")
def w05(spark, d):
    return W.neighbours(table(spark, d, "documents"), "doc_id", ["n_chars", "doc_id"], ["source", "lang"]).select("doc_id", "previous", "next")


@query(
    "w06_suppress_repeats",
    """WITH RECURSIVE l AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f(conv_id, n, last, kept) AS (SELECT conv_id, 1::BIGINT, role, 1::BIGINT FROM l WHERE n = 1 UNION ALL SELECT l.conv_id, l.n, CASE WHEN ends_with(f.last, l.role) THEN f.last ELSE l.role END, f.kept + CASE WHEN ends_with(f.last, l.role) THEN 0 ELSE 1 END FROM f JOIN l ON l.conv_id = f.conv_id AND l.n = f.n + 1)
SELECT conv_id, CAST(max(kept) AS INTEGER) AS kept FROM f GROUP BY conv_id""",
)
def w06(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    return c.select("conv_id", F.size(W.suppress_repeats(F.col("roles"))).alias("kept"))


RULES = "SELECT p_type AS scope, arg_{0}(p_name, p_partkey) AS value FROM part GROUP BY p_type"


@query("w07_last_wins", RULES.format("max"))
def w07(spark, d):
    t = table(spark, d, "part").select(F.col("p_type").alias("scope"), F.col("p_name").alias("value"), F.col("p_partkey").alias("pos"))
    return W.last_wins(t, "scope", "value")


@query("w08_first_wins", RULES.format("min"))
def w08(spark, d):
    t = table(spark, d, "part").select(F.col("p_type").alias("scope"), F.col("p_name").alias("value"), F.col("p_partkey").alias("pos"))
    return W.first_wins(t, "scope", "value")


@query(
    "w09_resolve_samples",
    """WITH s AS (SELECT p_brand AS id, p_partkey * 10 + 4 AS pos, p_partkey % 50 AS w, last_value(CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 9 END IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS d FROM part)
SELECT id, min(pos) AS pos, '/inst/'||CASE WHEN d IS NULL THEN '' ELSE 'd'||d||'/' END||'w'||w||'.wav' AS path FROM s GROUP BY id, 3""",
)
def w09(spark, d):
    return W.resolve_samples(opcodes(spark, d), F.lit("/inst"))


def rule_lines(spark, d):
    """For each supplier a few lines of crawl rules, one kind each."""
    kinds = F.array(*(F.when(F.col("s_suppkey") % k == 0, F.lit(a)).otherwise(F.lit(b)) for k, a, b in ((1, "user-agent", ""), (2, "user-agent", "allow"), (3, "disallow", "user-agent"), (2, "user-agent", "disallow"), (5, "allow", "crawl-delay"))))
    return table(spark, d, "supplier").select("s_suppkey", F.posexplode(kinds).alias("no", "kind"))


GROUPS = """kinds AS (SELECT s_suppkey, ['user-agent', CASE WHEN s_suppkey % 2 = 0 THEN 'user-agent' ELSE 'allow' END, CASE WHEN s_suppkey % 3 = 0 THEN 'disallow' ELSE 'user-agent' END, CASE WHEN s_suppkey % 2 = 0 THEN 'user-agent' ELSE 'disallow' END, CASE WHEN s_suppkey % 5 = 0 THEN 'allow' ELSE 'crawl-delay' END] AS k FROM supplier),
l AS (SELECT s_suppkey, unnest(k) AS kind, generate_subscripts(k, 1) - 1 AS no FROM kinds), o AS (SELECT *, CASE WHEN kind = 'user-agent' AND coalesce(lag(kind) OVER (PARTITION BY s_suppkey ORDER BY no), '') <> 'user-agent' THEN 1 ELSE 0 END AS opens FROM l)"""


@query("w10_robots_groups", f"WITH {GROUPS} SELECT s_suppkey, CAST(no AS INTEGER) AS no, kind, CAST(sum(opens) OVER (PARTITION BY s_suppkey ORDER BY no) AS BIGINT) AS grp FROM o")
def w10(spark, d):
    return W.robots_groups(rule_lines(spark, d), ["s_suppkey"])


@query("w12_ordinal_names", "SELECT p_partkey, lpad(CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS VARCHAR), 3, '0')||'_'||p_name AS name FROM part")
def w12(spark, d):
    return W.ordinal_names(table(spark, d, "part"), "p_name", ["p_partkey"], ["p_brand"]).select("p_partkey", "name")


@query("w13_paginate", "SELECT o_orderkey, CAST(ceil(n / 20.0) AS INTEGER) AS page FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n <= 240")
def w13(spark, d):
    return W.paginate(table(spark, d, "orders"), 20, ["o_orderdate", "o_orderkey"], ["o_orderpriority", "o_orderstatus"], 12).select("o_orderkey", "page")


@query("w14_recents", f'WITH {base.EV} SELECT path, max(ts) AS "last" FROM ev GROUP BY path ORDER BY 2 DESC, 1 LIMIT 25')
def w14(spark, d):
    base.utc(spark)
    return W.recents(base.view_events(spark, d), 25)


# ---------------------------------------------------------------- sorts and top-k: places are part of the result


def placed(df, key, n=None):
    """The rows of a sorted frame that a limit keeps, with their place."""
    rows = df.limit(n) if n else df
    from pyspark.sql import Window

    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))).select(key, "place") if n else rows.select(key)


def top_sql(key, order, n, source):
    return f"SELECT {key}, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS place FROM {source} ORDER BY {order} LIMIT {n}"


@query("o01_sort_catalogue", f"WITH {CAT} " + top_sql("path", "size DESC, lower(name), path", 200, "cat"))
def o01(spark, d):
    return placed(W.sort_catalogue(catalogue(spark, d).withColumn("is_dir", F.lit(False)), "size", desc=True), "path", 200)


@query("o02_by_popularity", top_sql("p_partkey", "p_size, p_name||'/'||p_partkey", 100, "part"))
def o02(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("popularity"), F.concat("p_name", F.lit("/"), "p_partkey").alias("family"))
    return placed(W.by_popularity(t), "p_partkey", 100)


@query("o03_by_downloads", top_sql("s_suppkey", "s_acctbal DESC, s_name", 50, "supplier"))
def o03(spark, d):
    t = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("downloads"), F.col("s_name").alias("name"))
    return placed(W.by_downloads(t), "s_suppkey", 50)


@query("o04_by_name_ci", top_sql("p_partkey", "lower(p_name), p_name, p_partkey", 150, "part"))
def o04(spark, d):
    return placed(W.by_name_ci(table(spark, d, "part"), "p_name", ("p_partkey",)), "p_partkey", 150)


@query("o05_by_index", top_sql("p_partkey", "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey * 37 % 100003 END NULLS LAST, p_partkey", 100, "part"))
def o05(spark, d):
    t = table(spark, d, "part").withColumn("index", F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey") * 37 % 100_003))
    return placed(W.by_index(t, ("p_partkey",)), "p_partkey", 100)


@query("o06_by_year", top_sql("o_orderkey", "year(o_orderdate) DESC, o_orderkey", 100, "orders"))
def o06(spark, d):
    return placed(W.by_year(table(spark, d, "orders").withColumn("year", F.year("o_orderdate")), ("o_orderkey",)), "o_orderkey", 100)


@query("o07_top_n", top_sql("o_orderkey", "o_totalprice DESC, o_orderkey", 240, "orders"))
def o07(spark, d):
    return placed(W.top_n(table(spark, d, "orders"), 1000, 1, 240, [F.desc("o_totalprice"), "o_orderkey"]), "o_orderkey", 240)


@query("o08_random_pick", "SELECT doc_id, source FROM documents ORDER BY md5(doc_id||':7'), doc_id LIMIT 1")
def o08(spark, d):
    return W.random_pick(table(spark, d, "documents"), "doc_id", 7).select("doc_id", "source")


@query(
    "o09_search_modules",
    """WITH k AS (SELECT o_custkey AS id, o_orderkey % 50 AS page, o_orderkey AS pos, 'xml' AS via FROM orders WHERE o_orderkey % 50 % 2 = 0),
h AS (SELECT o_custkey AS id, o_orderkey % 50 AS page, o_orderkey AS pos, 'html' AS via FROM orders), u AS (SELECT * FROM k UNION ALL SELECT * FROM h WHERE page NOT IN (SELECT page FROM k)),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY page, pos) AS r FROM u)
SELECT id, page, pos, via FROM f WHERE r = 1 ORDER BY page, pos LIMIT 400""",
)
def o09(spark, d):
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 50).alias("page"), F.col("o_orderkey").alias("pos"))
    return W.search_modules(t.where("page % 2 = 0").withColumn("via", F.lit("xml")), t.withColumn("via", F.lit("html")), 999)


