"""Registry of the catalogue queries, and the tables that they derive from the given ones.

Every derivation exists twice, as a DataFrame and as SQL; both read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query of (spark, sf_dir) and the SQL that gives the same rows."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores: for tables that are read in few tasks, since their files are small or in large groups of
    rows, before steps that do much for each row."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


def pick(key, *values):
    """The value at key modulo their number."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(key, F.lit(len(values))).cast("int"))


def sql_pick(key: str, *values) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"([{listed}])[1 + ({key}) % {len(values)}]"


# ---------------------------------------------------------------- catalogue of media records

EXTS = ("txt", "ANS", "png", "zip", "md")


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    ext = pick(F.col("doc_id"), *EXTS)
    c = table(spark, d, "documents").withColumn("e", ext)
    return c.select(
        "doc_id", F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit("."), "e")).alias("path"), F.concat("doc_id", F.lit("."), "e").alias("name"), F.lower("e").alias("ext"),
        F.col("n_chars").alias("size"), F.concat(F.lit("Artist "), F.col("doc_id") % 50).alias("artist"), F.concat(F.lit("group"), F.col("doc_id") % 12).alias("grp"), F.col("text").alias("title"),
        (F.col("doc_id") % 640).alias("width"), (F.col("doc_id") * 7 % 480).alias("height"), (F.col("doc_id") * 3600).alias("modified"), F.col("doc_id").cast("string").alias("item"),
    )


CAT = f"""cat AS (SELECT doc_id, source||'/'||lang||'/'||doc_id||'.'||e AS path, doc_id||'.'||e AS name, lower(e) AS ext, n_chars AS size, 'Artist '||(doc_id % 50) AS artist,
 'group'||(doc_id % 12) AS grp, text AS title, doc_id % 640 AS width, doc_id * 7 % 480 AS height, doc_id * 3600 AS modified, CAST(doc_id AS VARCHAR) AS item
 FROM (SELECT *, {sql_pick("doc_id", *EXTS)} AS e FROM documents))"""


def view_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'view'")
    return e.select(F.col("user_id").cast("string").alias("path"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint").alias("ts"), F.col("event_id").alias("seq"))


def utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


EV = "ev AS (SELECT CAST(user_id AS VARCHAR) AS path, epoch_us(ts) // 1000000 AS ts, event_id AS seq FROM events WHERE event_type = 'view')"
VIEWS = "views AS (SELECT path, count(*) AS count, coalesce(arg_min(ts, seq) FILTER (WHERE ts <> 0), 0) AS first, arg_max(ts, seq) AS last FROM ev GROUP BY path)"


def rating_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'purchase'")
    value = F.expr("least(cast(floor(max_by(value, event_id)) as bigint) % 11 div 2, 5)")
    return e.groupBy(F.col("user_id").cast("string").alias("path")).agg(value.cast("int").alias("stars"))


RATINGS = "ratings AS (SELECT CAST(user_id AS VARCHAR) AS path, CAST(least(CAST(floor(arg_max(value, event_id)) AS BIGINT) % 11 // 2, 5) AS INTEGER) AS stars FROM events WHERE event_type = 'purchase' GROUP BY user_id)"


def cache_index(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("s", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint"))
    url = F.concat(F.lit("https://host"), F.col("user_id") % 7, F.lit("/pack/"), "user_id")
    return e.groupBy(url.alias("url")).agg(F.min("s").alias("fetched"), F.max("s").alias("used"), F.sum(F.floor(F.col("value") * 100).cast("bigint")).alias("bytes")).withColumn("file", F.concat(F.md5("url"), F.lit(".bin"))).select("url", "file", "fetched", "used", "bytes")


CACHE = "cache AS (SELECT 'https://host'||(user_id % 7)||'/pack/'||user_id AS url, min(epoch_us(ts) // 1000000) AS fetched, max(epoch_us(ts) // 1000000) AS used, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY user_id)"


def links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("pos", "href"))


LINKS = """raw AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages),
links AS (SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos FROM raw)"""


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as images of 4 x 4 pixels; alpha is full where the channel is below 200."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("k", "v"))
    v = v.select("image_id", F.expr("k div 4").alias("p"), (F.col("k") % 4).alias("c"), F.expr("cast(cast(floor(abs(cast(v as double)) * 400) as bigint) % 256 as int)").alias("b"))
    px = v.groupBy("image_id", "p").agg(*(F.max(F.when(F.col("c") == k, F.col("b"))).alias(n) for k, n in enumerate("rgba")))
    return px.select("image_id", (F.col("p") % 4).cast("int").alias("x"), F.expr("p div 4").cast("int").alias("y"), "r", "g", "b", F.when(F.col("a") < 200, 255).otherwise(F.col("a")).alias("a"))


def flat_pixels(spark: SparkSession, d: str) -> DataFrame:
    """The same with channels rounded down to multiples of 64, so that colours repeat."""
    return pixels(spark, d).select("image_id", "x", "y", *((F.col(c) - F.col(c) % 64).alias(c) for c in "rgb"), "a")


PIXELS = """vals AS (SELECT vec_id AS image_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
chan AS (SELECT image_id, k // 4 AS p, k % 4 AS c, CAST(floor(abs(CAST(v AS DOUBLE)) * 400) AS BIGINT) % 256 AS b FROM vals),
px0 AS (SELECT image_id, p, max(b) FILTER (WHERE c = 0) AS r, max(b) FILTER (WHERE c = 1) AS g, max(b) FILTER (WHERE c = 2) AS b, max(b) FILTER (WHERE c = 3) AS a FROM chan GROUP BY image_id, p),
px AS (SELECT image_id, p % 4 AS x, p // 4 AS y, r, g, b, CASE WHEN a < 200 THEN 255 ELSE a END AS a FROM px0),
flat AS (SELECT image_id, x, y, r - r % 64 AS r, g - g % 64 AS g, b - b % 64 AS b, a FROM px)"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, d, "events").select(F.col("user_id").alias("sound_id"), n.cast("bigint").alias("frame"), F.col("value").alias("amp"))


SAMPLES = "samples AS (SELECT user_id AS sound_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS amp FROM events)"
