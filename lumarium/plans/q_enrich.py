"""Queries of joins (J), aggregations (A), set operations (U), walks (G), maintained tables and streams (S50-S52, T)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import enrich as J
from ..operators import graph as G
from ..operators import maintain as M
from ..operators import ordered as W
from ..operators import rollups as A
from ..operators import sets as U
from ..streaming import streams as T
from . import base
from .base import CAT, EV, RATINGS, VIEWS, catalogue, query, table


def items(spark, d):
    return catalogue(spark, d).select(F.col("item").alias("path"), "size")


ITEMS = "items AS (SELECT CAST(doc_id AS VARCHAR) AS path, n_chars AS size FROM documents)"


def views(spark, d):
    base.utc(spark)
    return A.view_counts(base.view_events(spark, d))


# ---------------------------------------------------------------- joins


@query("j01_with_ratings", f"WITH {ITEMS}, {RATINGS} SELECT i.path, size, coalesce(stars, 0) AS stars FROM items i LEFT JOIN ratings r ON i.path = r.path")
def j01(spark, d):
    return J.with_ratings(items(spark, d), base.rating_rows(spark, d))


@query("j02_effective_rating", f"WITH {RATINGS}, attrs AS (SELECT CAST(doc_id AS VARCHAR) AS path, doc_id % 4 AS stars FROM documents) SELECT coalesce(a.path, r.path) AS path, CAST(coalesce(nullif(a.stars, 0), r.stars, 0) AS INTEGER) AS stars FROM attrs a FULL JOIN ratings r ON a.path = r.path")
def j02(spark, d):
    attrs = items(spark, d).select("path", (F.col("path").cast("int") % 4).alias("stars"))
    return J.effective_rating(attrs, base.rating_rows(spark, d))


@query("j03_with_views", f'WITH {ITEMS}, {EV}, {VIEWS} SELECT i.path, size, coalesce(v.count, 0) AS count, v."first", v."last", coalesce(v.count, 0) > 0 AS visited FROM items i LEFT JOIN views v ON i.path = v.path')
def j03(spark, d):
    return J.with_views(items(spark, d), views(spark, d))


@query("j04_seen_unseen", f"WITH {ITEMS}, {EV} SELECT path, path IN (SELECT path FROM ev) AS seen FROM items")
def j04(spark, d):
    i, v = items(spark, d), views(spark, d)
    return J.seen(i, v).select("path", F.lit(True).alias("seen")).unionByName(J.unseen(i, v).select("path", F.lit(False).alias("seen")))


def snapshot(spark, d, mod):
    return table(spark, d, "documents").where(F.col("doc_id") % mod != 0).select(F.col("doc_id").alias("appid"), F.concat("source", F.lit("/"), F.when(F.col("doc_id") % 7 == 0, F.lit("_")).otherwise(F.lit("")), "doc_id").alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") * 11 % 1000).alias("mtime"))


SNAP = "snap AS (SELECT doc_id, doc_id AS appid, source||'/'||CASE WHEN doc_id % 7 = 0 THEN '_' ELSE '' END||doc_id AS path, n_chars AS size, doc_id * 11 % 1000 AS mtime FROM documents)"


@query("j05_owned_flagged", "SELECT doc_id AS appid, doc_id % 5 <> 0 AS installed FROM documents WHERE doc_id % 3 <> 0")
def j05(spark, d):
    return J.owned_flagged(snapshot(spark, d, 3).select("appid"), snapshot(spark, d, 5))


@query("j06_with_status", f"WITH {SNAP} SELECT path, CASE WHEN starts_with(path, 'src1/') THEN CASE WHEN doc_id % 5 <> 0 THEN 'new' ELSE 'clean' END END AS status FROM snap WHERE doc_id % 3 <> 0")
def j06(spark, d):
    listed = snapshot(spark, d, 5).select("path", F.lit("new").alias("status"))
    return J.with_status(snapshot(spark, d, 3).select("path"), listed, "src1")


@query("j07_cache_split", f"WITH {base.CACHE}, w AS (SELECT 'https://host'||(doc_id % 7)||'/pack/'||doc_id AS url FROM documents) SELECT url, url IN (SELECT url FROM cache) AS hit FROM w")
def j07(spark, d):
    base.utc(spark)
    wanted = table(spark, d, "documents").select(F.concat(F.lit("https://host"), F.col("doc_id") % 7, F.lit("/pack/"), "doc_id").alias("url"))
    hit, miss = J.cache_split(wanted, base.cache_index(spark, d))
    return hit.withColumn("hit", F.lit(True)).unionByName(miss.withColumn("hit", F.lit(False)))


def link_urls(spark, d):
    return base.links(spark, d).select("page_id", "pos", X.join_url("url", "href").alias("url")).where("url IS NOT NULL")


def robots_rules(spark, d):
    """For each host, prefixes of a few lengths: two disallowed, one allowed again."""
    origin = X.split_url("url")["origin"]
    hosts = table(spark, d, "pages").select(origin.alias("origin")).distinct()
    rules = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(p).alias("prefix")) for k, p in (("disallow", "/T"), ("disallow", "/L"), ("allow", "/Th"), ("allow", "/L"), ("disallow", "/Thi"))))
    return hosts.select("origin", F.explode(rules).alias("r")).select("origin", "r.*")


@query(
    "j08_robots_verdict",
    f"""WITH {base.LINKS}, u AS (SELECT page_id, pos, CASE WHEN contains(href, '://') THEN href WHEN starts_with(href, '/') THEN split_part(url, '://', 1)||'://'||split_part(split_part(url, '://', 2), '/', 1)||href END AS url FROM links),
p AS (SELECT *, substr(split_part(url, '://', 2), length(split_part(split_part(url, '://', 2), '/', 1)) + 1) AS path FROM u WHERE url IS NOT NULL)
SELECT page_id, pos, url, CASE WHEN starts_with(path, '/Thi') THEN false WHEN starts_with(path, '/Th') THEN true WHEN starts_with(path, '/T') THEN false ELSE true END AS allowed FROM p""",
)
def j08(spark, d):
    return J.robots_verdict(link_urls(spark, d), robots_rules(spark, d))


@query("j09_artist_via_packs", "WITH s AS (SELECT s_suppkey, 'Artist '||s_nationkey AS artist, 'pack'||(s_suppkey % 20) AS pack FROM supplier), a AS (SELECT DISTINCT artist, pack FROM s WHERE artist < 'Artist 2'), p AS (SELECT p_partkey, 'pack'||(p_partkey % 20) AS pack, 'artist '||(p_partkey % 25)||', Artist '||(p_partkey % 7) AS credit FROM part) SELECT p.pack, a.artist, p.p_partkey, p.credit FROM p JOIN a ON p.pack = a.pack AND list_contains(string_split(lower(p.credit), ', '), lower(a.artist))")
def j09(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("Artist "), "s_nationkey").alias("artist"), F.concat(F.lit("pack"), F.col("s_suppkey") % 20).alias("pack")).where("artist < 'Artist 2'")
    artists = s.groupBy("artist").agg(F.collect_set("pack").alias("packs"))
    pieces = table(spark, d, "part").select("p_partkey", F.concat(F.lit("pack"), F.col("p_partkey") % 20).alias("pack"), F.concat(F.lit("artist "), F.col("p_partkey") % 25, F.lit(", Artist "), F.col("p_partkey") % 7).alias("artist"))
    return J.artist_via_packs(artists, pieces).select("pack", "artist", "p_partkey", "credit")


@query("j10_overlay", f"WITH {SNAP} SELECT appid, CASE WHEN doc_id % 3 <> 0 THEN 'own' ELSE 'global' END AS origin FROM snap WHERE doc_id % 3 <> 0 OR doc_id % 5 <> 0")
def j10(spark, d):
    return J.overlay(snapshot(spark, d, 3).select("appid", F.lit("own").alias("origin")), snapshot(spark, d, 5).select("appid", F.lit("global").alias("origin")), "appid")


@query("j11_lookup_default", f"WITH {CAT} SELECT path, CASE ext WHEN 'txt' THEN 'white' WHEN 'png' THEN 'green' ELSE 'grey' END AS color FROM cat")
def j11(spark, d):
    dim = table(spark, d, "nation").where("n_nationkey < 3").select(F.expr("element_at(array('txt', 'png', 'other'), n_nationkey + 1)").alias("ext"), F.expr("element_at(array('white', 'green', 'grey'), n_nationkey + 1)").alias("color"))
    return J.lookup_default(catalogue(spark, d).select("path", "ext"), dim, "ext", "color").select("path", "color")


def scope_rules(spark, d):
    return table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("k"), F.col("n_regionkey"), F.when(F.col("n_nationkey") >= 5, F.concat(F.lit(".n"), "n_nationkey")).otherwise(F.lit(""))).alias("scope"), F.col("n_name").alias("value")).distinct()


SCOPES = "rules AS (SELECT DISTINCT 'k'||n_regionkey||CASE WHEN n_nationkey >= 5 THEN '.n'||n_nationkey ELSE '' END AS scope, n_name AS value FROM nation WHERE n_nationkey % 2 = 0)"


def scoped(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return table(spark, d, "customer").join(n, "c_nationkey").select("c_custkey", F.concat(F.lit("k"), "n_regionkey", F.lit(".n"), "c_nationkey", F.lit(".c"), "c_custkey").alias("scope"))


@query("j12_scope_join", f"WITH {SCOPES}, s AS (SELECT c_custkey, 'k'||n_regionkey AS a, 'k'||n_regionkey||'.n'||c_nationkey AS b, 'k'||n_regionkey||'.n'||c_nationkey||'.c'||c_custkey AS scope FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT c_custkey, s.scope, coalesce(r2.value, r1.value) AS value FROM s LEFT JOIN rules r1 ON r1.scope = s.a LEFT JOIN rules r2 ON r2.scope = s.b")
def j12(spark, d):
    return J.scope_join(scoped(spark, d), scope_rules(spark, d))


@query("j13_first_match", f"WITH {SCOPES}, s AS (SELECT c_custkey, 'k'||n_regionkey||'.n'||c_nationkey AS b FROM customer JOIN nation ON c_nationkey = n_nationkey), f AS (SELECT max(value) AS v FROM rules WHERE scope = 'k4') SELECT c_custkey, coalesce(r.value, f.v) AS value FROM s CROSS JOIN f LEFT JOIN rules r ON r.scope = s.b")
def j13(spark, d):
    c = scoped(spark, d).select("c_custkey", F.array(F.concat(F.lit("x."), "scope"), F.regexp_replace("scope", "^k[0-9]+[.]n([0-9]+)[.].*$", "none.$1"), F.col("scope"), F.lit("k4.any")).alias("candidates"))
    exact = scope_rules(spark, d).where("scope LIKE '%.%' OR scope = 'k4'")
    return J.first_match(c, exact, "c_custkey").select("c_custkey", "value")


@query("j14_new_files", f"WITH {SNAP} SELECT path, mtime FROM snap WHERE doc_id % 5 <> 0 AND doc_id % 3 = 0 AND doc_id % 7 <> 0")
def j14(spark, d):
    return J.new_files(snapshot(spark, d, 3).select("path"), snapshot(spark, d, 5).select("path", "mtime"))


@query("j17_changed_files", f"WITH {SNAP} SELECT path FROM snap WHERE doc_id % 3 = 0 OR doc_id % 4 = 0")
def j17(spark, d):
    path = F.concat("source", F.lit("/"), F.when(F.col("doc_id") % 7 == 0, F.lit("_")).otherwise(F.lit("")), "doc_id")
    files = table(spark, d, "documents").select("doc_id", path.alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") * 11 % 1000).alias("mtime"))
    then = F.when(F.col("doc_id") % 4 == 0, F.col("mtime") - 1).otherwise(F.col("mtime"))
    done = files.where("doc_id % 3 <> 0").select(X.change_key("path", "size", then).alias("key"))
    return J.changed_files(files.select("path", "size", "mtime"), done).select("path")


# ---------------------------------------------------------------- aggregations


@query("a01_cache_stats", f"WITH {base.CACHE} SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, count(*) AS entries FROM cache")
def a01(spark, d):
    base.utc(spark)
    return A.cache_stats(base.cache_index(spark, d))


@query("a02_view_counts", f'WITH {EV}, {VIEWS} SELECT path, count, "first", "last" FROM views')
def a02(spark, d):
    return views(spark, d)


@query("a03_set_viewed", f'WITH {EV}, {VIEWS}, k AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 3 = 0), marked AS (SELECT path, count, "first", "last" FROM views UNION ALL SELECT path, 1, 99, 99 FROM k WHERE path NOT IN (SELECT path FROM views)) SELECT path, count, "first", "last" FROM marked WHERE path NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 5 = 0)')
def a03(spark, d):
    keys = lambda m: table(spark, d, "documents").where(f"doc_id % {m} = 0").select(F.col("doc_id").cast("string").alias("path"))
    return A.set_viewed(A.set_viewed(views(spark, d), keys(3), True, 99), keys(5), False, 0)


@query("a04_folder_counts", f"WITH {CAT} SELECT folder, count(*) AS items FROM (SELECT split_part(path, '/', 1) AS folder FROM cat UNION ALL SELECT split_part(path, '/', 1)||'/'||split_part(path, '/', 2) FROM cat) GROUP BY folder")
def a04(spark, d):
    return A.folder_counts(catalogue(spark, d))


PEAK_SQL = f"""WITH {base.SAMPLES}, env AS (SELECT sound_id, frame // 2 AS w, max(abs(amp)) AS peak FROM samples GROUP BY 1, 2),
n AS (SELECT sound_id, count(*) AS n FROM env GROUP BY 1), cols AS (SELECT sound_id, n, i AS col, i * n // 40 AS a, greatest((i + 1) * n // 40, i * n // 40 + 1) AS b FROM n, range(40) t(i)),
hit AS (SELECT c.sound_id, c.col, max(e.peak) AS peak FROM cols c JOIN env e ON e.sound_id = c.sound_id AND e.w >= c.a AND e.w < least(c.b, c.n) GROUP BY 1, 2)
SELECT sound_id, col, round(peak / greatest(max(peak) OVER (PARTITION BY sound_id), 0.0001), 9) AS peak FROM hit"""


@query("a10_peaks", PEAK_SQL)
def a10(spark, d):
    return A.peaks(base.samples(spark, d), 2, 40).select("sound_id", "col", F.round("peak", 9).alias("peak"))


def opcodes(spark, d):
    """A few opcodes per part: a header, a key or a range, a folder for every third, and a sample."""
    k = F.col("p_partkey")
    rows = F.array(*(F.struct(F.lit(n).alias("pos"), o.alias("opcode"), v.cast("string").alias("value")) for n, (o, v) in enumerate((
        (F.lit("<header>"), F.when(k % 4 == 0, F.lit("group")).otherwise(F.lit("region"))), (F.when(k % 2 == 0, F.lit("key")).otherwise(F.lit("lokey")), k % 90), (F.when(k % 2 == 0, F.lit("volume")).otherwise(F.lit("hikey")), k % 90 + 12),
        (F.when(k % 3 == 0, F.lit("default_path")).otherwise(F.lit("tune")), F.concat(F.lit("d"), k % 9, F.lit("\\"))), (F.lit("sample"), F.concat(F.lit("s\\.."), F.lit("\\w"), k % 50, F.lit(".wav"))),
    ))))
    t = table(spark, d, "part").select(F.col("p_brand").alias("id"), "p_partkey", F.explode(rows).alias("o"))
    return t.select("id", (F.col("p_partkey") * 10 + F.col("o.pos")).alias("pos"), "o.opcode", "o.value")


@query("a11_sfz_summary", "SELECT p_brand AS id, count(*) FILTER (WHERE p_partkey % 4 <> 0) AS regions, count(DISTINCT p_partkey % 50) AS samples, CAST(min(p_partkey % 90) AS INTEGER) AS key_lo, CAST(max(CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 90 ELSE p_partkey % 90 + 12 END) AS INTEGER) AS key_hi FROM part GROUP BY p_brand")
def a11(spark, d):
    return A.sfz_summary(opcodes(spark, d))


def points(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("mesh_id"), F.col("l_quantity").alias("x"), F.floor("l_extendedprice").cast("double").alias("y"), F.floor(F.col("l_discount") * 100).cast("double").alias("z"))


@query("a12_bounds", "WITH p AS (SELECT l_suppkey % 50 AS mesh_id, l_quantity AS x, floor(l_extendedprice) AS y, floor(l_discount * 100) AS z FROM lineitem), b AS (SELECT mesh_id, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz FROM p GROUP BY 1) SELECT b.mesh_id, cx, cy, cz, round(sqrt(max((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz))), 6) AS radius FROM p JOIN b ON p.mesh_id = b.mesh_id GROUP BY 1, 2, 3, 4")
def a12(spark, d):
    return A.bounds(points(spark, d)).withColumn("radius", F.round("radius", 6))


@query("a14_bucket_representatives", "SELECT CAST(p_size % 11 AS INTEGER) AS bucket, arg_min(p_name, p_partkey) AS p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def a14(spark, d):
    t = table(spark, d, "part").withColumn("cover", (F.col("p_size") % 11) / 10)
    return A.bucket_representatives(t, "cover", 10, "p_partkey", ["p_name", "p_partkey"])


@query("a15_anim_length", "SELECT user_id AS image_id, CAST(sum(least(greatest(CASE WHEN event_id % 4 = 0 THEN 100 ELSE (event_id * 37 % 100000) // (event_id % 4) END, 20), 65535)) AS BIGINT) AS total_ms FROM events GROUP BY user_id")
def a15(spark, d):
    return A.anim_length(table(spark, d, "events").select(F.col("user_id").alias("image_id"), (F.col("event_id") * 37 % 100_000).alias("num"), (F.col("event_id") % 4).alias("den")))


@query("a16_dir_stats", "SELECT CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) AS files FROM documents")
def a16(spark, d):
    return A.dir_stats(catalogue(spark, d), "size")


# ---------------------------------------------------------------- set operations, walks


@query("u01_media", "SELECT 'parts' AS source, p_partkey AS id, p_name AS title, p_size AS size FROM part UNION ALL SELECT 'suppliers', s_suppkey, s_name, NULL FROM supplier UNION ALL SELECT 'documents', doc_id, lang, NULL FROM documents")
def u01(spark, d):
    return U.media({
        "parts": table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("size")),
        "suppliers": table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title")),
        "documents": table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("title")),
    })


@query("u02_distinct_names", "SELECT DISTINCT p_name AS name FROM part")
def u02(spark, d):
    return U.distinct_names(table(spark, d, "part"), "p_name").withColumnRenamed("p_name", "name")


@query("u03_all_installed", "SELECT s_nationkey AS appid, arg_min(s_name, lower(s_name)) AS name FROM supplier GROUP BY s_nationkey")
def u03(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("appid"), F.col("s_name").alias("name"), "s_suppkey")
    return U.all_installed([s.where("s_suppkey % 2 = 0").drop("s_suppkey"), s.where("s_suppkey % 2 = 1").drop("s_suppkey"), s.drop("s_suppkey")])


@query("u04_missing", f"WITH {SNAP} SELECT path FROM snap WHERE doc_id % 3 <> 0 AND doc_id % 5 = 0")
def u04(spark, d):
    return U.missing(snapshot(spark, d, 3).select("path"), snapshot(spark, d, 5), "path")


def web(spark, d):
    """A link table over pages: each page is a folder that leads to three others and holds its links as files."""
    p = table(spark, d, "pages").select("page_id")
    n = p.agg(F.count("*").alias("n"))
    dirs = p.crossJoin(F.broadcast(n)).select(F.col("page_id").alias("dir"), F.explode(F.array(*(F.pmod(F.col("page_id") * k + a, "n") for k, a in ((2, 1), (3, 7), (5, 2))))).alias("target"))
    dirs = dirs.select("dir", F.concat(F.lit("d"), "target").alias("name"), "target", F.lit(True).alias("is_dir"))
    files = base.links(spark, d).select(F.col("page_id").alias("dir"), F.concat(F.substr("href", F.lit(2)), F.lit("."), F.when(F.col("pos") % 2 == 0, F.lit("zip")).otherwise(F.lit("txt"))).alias("name"), F.lit(None).cast("bigint").alias("target"), F.lit(False).alias("is_dir"))
    return dirs.unionByName(files)


@query(
    "g01_crawl",
    f"""WITH RECURSIVE {base.LINKS}, n AS (SELECT count(*) AS n FROM pages), edge AS (SELECT page_id AS dir, unnest([(page_id * 2 + 1) % n, (page_id * 3 + 7) % n, (page_id * 5 + 2) % n]) AS target FROM pages, n),
walk(dir, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.target, w.depth + 1 FROM walk w JOIN edge e ON e.dir = w.dir WHERE w.depth < 5),
seen AS (SELECT dir, min(depth) AS depth FROM walk GROUP BY dir)
SELECT s.dir, substr(href, 2)||'.zip' AS name, s.depth FROM seen s JOIN links l ON l.page_id = s.dir WHERE pos % 2 = 0""",
)
def g01(spark, d):
    seeds = table(spark, d, "pages").where("page_id = 0").select(F.col("page_id").alias("dir"))
    return G.crawl(seeds, web(spark, d), "*.zip", 5)


@query("g02_tree", f"WITH {CAT} SELECT path, CASE k WHEN 0 THEN split_part(path, '/', 1) ELSE split_part(path, '/', 1)||'/'||split_part(path, '/', 2) END AS folder, k AS depth FROM cat, (SELECT unnest([0, 1]) AS k) WHERE starts_with(path, 'src1/')")
def g02(spark, d):
    return G.ancestors(G.subtree(catalogue(spark, d), "src1"))


# ---------------------------------------------------------------- maintained tables


@query("s50_ratings_sidecar", f"WITH {RATINGS} SELECT path, stars FROM ratings WHERE stars > 0")
def s50(spark, d):
    r = base.rating_rows(spark, d)
    bodies = M.ratings_to_json(r.withColumn("path", F.concat((F.col("path").cast("int") % 10).cast("string"), F.lit("/"), "path")))
    return M.ratings_from_json(bodies).withColumn("path", X.last_part("path"))


@query("s51_upsert_views", f'WITH {EV}, {VIEWS} SELECT path, CASE WHEN CAST(path AS BIGINT) % 4 = 0 THEN count * 2 ELSE count END AS count, "first", "last" FROM views')
def s51(spark, d):
    v = views(spark, d)
    changed = v.where("cast(path as bigint) % 4 = 0").withColumn("count", F.col("count") * 2)
    path = G.scratch(spark)
    M.write_changes(v, path, 0)
    M.write_changes(changed, path, 1)
    return M.read_views(spark, path)


@query("s52_cache_upkeep", f"WITH {base.CACHE} SELECT url, CASE WHEN bytes % 3 = 0 THEN fetched + 5 ELSE fetched END AS fetched, greatest(CASE WHEN bytes % 3 = 0 THEN fetched + 5 ELSE used END, CASE WHEN length(url) % 2 = 0 THEN used + 100 ELSE 0 END) AS used, CASE WHEN bytes % 3 = 0 THEN 1 ELSE bytes END AS bytes FROM cache")
def s52(spark, d):
    base.utc(spark)
    index = base.cache_index(spark, d)
    stored = index.where("bytes % 3 = 0").select("url", "file", (F.col("fetched") + 5).alias("fetched"), F.lit(1).cast("bigint").alias("bytes"))
    accesses = index.where("length(url) % 2 = 0").select("url", (F.col("used") + 100).alias("ts"))
    return M.touch_cache(M.upsert_cache(index, stored), accesses).drop("file")


# ---------------------------------------------------------------- streams


def drained(stream: DataFrame, sink=None, mode: str = "append", conf: dict | None = None) -> DataFrame | None:
    """Runs a stream over what is there, then gives what it wrote."""
    spark: SparkSession = stream.sparkSession
    path = G.scratch(spark)
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    try:
        w = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/log").outputMode(mode)
        (w.foreachBatch(sink).start() if sink else w.format("parquet").start(f"{path}/out")).awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return None if sink else spark.read.schema(stream.schema).parquet(f"{path}/out")


def staged(df: DataFrame) -> DataFrame:
    """A stored copy of df as a stream of files."""
    path = G.scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("t01_view_stream", f'WITH {EV}, {VIEWS} SELECT path, count, "first", "last" FROM views')
def t01(spark, d):
    base.utc(spark)
    table_ = G.scratch(spark)
    events = base.view_events(spark, d).repartitionByRange(3, "seq").sortWithinPartitions("seq")
    drained(T.view_stream(staged(events)), T.view_sink(table_), "update")
    return M.read_views(spark, table_)


def paced(spark, d):
    """Requests with their time of arrival: as seconds, and as the time itself to the millisecond."""
    e = table(spark, d, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    arrival = (micros - 1_704_067_200_000_000) / 1e6 / 400
    return e.select((F.col("user_id") % 10).cast("string").alias("host"), F.col("event_id").alias("id"), arrival.alias("arrival"), F.when(F.col("user_id") % 3 == 0, F.lit(0.75)).alias("gap"), (F.col("event_type") == "error").alias("throttled"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 9).cast("double").alias("retry_after"), F.timestamp_micros(F.floor(arrival * 1_000_000).cast("bigint")).alias("ts"))


def in_order(df: DataFrame, by: str, files: int = 6) -> DataFrame:
    """df as a stream of files in the order of ``by``, one for each micro-batch, and after them a row of no host an hour
    later, as a source that goes on would send one: it lets the watermark pass all others."""
    spark, path = df.sparkSession, G.scratch(df.sparkSession)
    df.repartitionByRange(files, by).write.parquet(path)
    end = df.agg(F.max(by).alias("t")).select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name not in (by, "throttled") else (F.col("t") + F.expr("INTERVAL 1 HOUR")).alias(by) if f.name == by else F.lit(True).alias(f.name) for f in df.schema.fields))
    end.coalesce(1).write.mode("append").parquet(path)
    # a file stream takes files by their times: those of the parts, in their order, then the last one
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    listed = [s for s in fs.listStatus(root) if s.getPath().getName().startswith("part-")]
    last = max(listed, key=lambda s: s.getModificationTime()).getPath().getName()
    ordered_ = sorted((s.getPath() for s in listed), key=lambda p: (p.getName() == last, p.getName()))
    for k, p in enumerate(ordered_):
        fs.setTimes(p, 1_700_000_000_000 + 60_000 * k, -1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


PACE = """r AS (SELECT CAST(user_id % 10 AS VARCHAR) AS host, event_id AS id, (epoch_us(ts) - 1704067200000000) / 1e6 / 400 AS arrival, CASE WHEN user_id % 3 = 0 THEN 0.75 ELSE 0.5 END AS gap, event_type = 'error' AS throttled, coalesce(CASE WHEN event_id % 2 = 0 THEN event_id % 9 END, 5) AS asked FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY arrival, id) AS k FROM r),
s(host, k, id, shown, last, cool, start, refused) AS (SELECT DISTINCT host, 0::BIGINT, NULL::BIGINT, false, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, false FROM r
 UNION ALL SELECT s.host, n.k, n.id, NOT throttled,
  CASE WHEN throttled THEN last WHEN cool > arrival THEN CASE WHEN cool - arrival > 5 THEN last ELSE cool END WHEN cool IS NOT NULL THEN last ELSE greatest(arrival, coalesce(last + gap, arrival)) END,
  CASE WHEN throttled THEN arrival + least(greatest(asked, 1), 300) WHEN cool > arrival THEN cool END,
  CASE WHEN throttled THEN NULL WHEN cool > arrival THEN CASE WHEN cool - arrival > 5 THEN NULL ELSE cool END WHEN cool IS NOT NULL THEN arrival ELSE greatest(arrival, coalesce(last + gap, arrival)) END,
  coalesce(cool - arrival > 5, false)
 FROM s JOIN n ON n.host = s.host AND n.k = s.k + 1)"""


@query("t02_pace_requests", f"WITH RECURSIVE {PACE} SELECT host, id, round(start, 6) AS start, refused FROM s WHERE shown")
def t02(spark, d):
    """One scan of the requests and one stream over them; each host's state is carried from one micro-batch to the next."""
    base.utc(spark)
    out = drained(T.pace_stream(in_order(paced(spark, d), "ts")), conf=T.TIMED_STATE)
    return out.select("host", "id", F.round("start", 6).alias("start"), "refused")


@query("t03_follow", "SELECT source, count(*) AS lines FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY source")
def t03(spark, d):
    folder = G.scratch(spark)
    lines = table(spark, d, "documents").select(F.explode(F.transform(F.split("text", "\n"), lambda x: F.struct("source", x.alias("line")))).alias("l")).where("l.line <> ''")
    lines.select(F.concat("l.source", F.lit("\t"), F.regexp_replace("l.line", "\r", "")).alias("value")).write.text(folder)
    got = drained(T.follow(spark, folder))
    return got.select(X.before("value", "\t").alias("source")).groupBy("source").agg(F.count("*").alias("lines"))


@query("t04_search_stream", f"WITH {CAT} SELECT path FROM cat WHERE ext IN ('txt') AND size >= 3000")
def t04(spark, d):
    return drained(T.search_stream(staged(catalogue(spark, d)), exts=["txt"], size=(3000, None))).select("path")


@query("t05_cache_stream", f"WITH {base.CACHE}, last AS (SELECT 'https://host'||(user_id % 7)||'/pack/'||user_id AS url, max(epoch_us(ts) // 1000000) AS used, arg_max(CAST(floor(value * 100) AS BIGINT), epoch_us(ts)) AS bytes FROM events GROUP BY user_id), t AS (SELECT sum(bytes) AS total FROM last), o AS (SELECT url, bytes, used, coalesce(sum(bytes) OVER (ORDER BY used, url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY used, url) AS rn FROM last) SELECT url, bytes, used FROM o, t WHERE NOT (rn <= 512 AND before < total - 1000000)")
def t05(spark, d):
    base.utc(spark)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events")
    url = F.concat(F.lit("https://host"), F.col("user_id") % 7, F.lit("/pack/"), "user_id")
    # one access per url and second: the last one
    acc = e.groupBy(url.alias("url"), F.floor(micros / 1_000_000).cast("bigint").alias("ts")).agg(F.max_by(F.floor(F.col("value") * 100).cast("bigint"), micros).alias("bytes")).withColumn("file", F.md5("url"))
    table_ = G.scratch(spark)
    # eviction comes once, when all accesses are in, so that the result doesn't hang on how they are dealt to batches
    drained(T.cache_stream(staged(acc.repartitionByRange(3, "ts"))), T.cache_sink(table_), "update")
    return W.evict(M.read_cache(spark, table_), 1_000_000).select("url", "bytes", "used")


@query("t06_once_per_key", "SELECT DISTINCT user_id FROM events")
def t06(spark, d):
    base.utc(spark)
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return drained(T.once_per_key(staged(e), "user_id", "ts", "400 days")).select("user_id")
