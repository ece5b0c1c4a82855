"""Queries of the scalar functions (X) and of the filters (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import predicates as P
from . import base
from .base import CAT, catalogue, pick, query, sql_pick, table

PART = "FROM part"
LICENSES = ("", "by", "cc0", "PDM", "by-nc-sa")


def part(spark, d):
    return table(spark, d, "part")


def half_up(x: str, digits: int) -> str:
    scale = 10**digits
    return f"printf('%.{digits}f', floor({x} * {scale} + 0.5) / {scale})" if digits else f"printf('%.0f', floor({x} + 0.5))"


@query("x01_license_label", f"SELECT p_partkey, CASE WHEN l = '' THEN '—' WHEN upper(l) IN ('PDM', 'CC0') THEN upper(l) ELSE 'CC '||upper(l) END AS label FROM (SELECT p_partkey, {sql_pick('p_partkey', *LICENSES)} AS l FROM part)")
def x01(spark, d):
    return part(spark, d).select("p_partkey", X.license_label(pick(F.col("p_partkey"), *LICENSES)).alias("label"))


@query("x02_dims", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 OR p_size = 0 THEN '' ELSE (p_partkey % 7)||'×'||p_size END AS dims FROM part")
def x02(spark, d):
    return part(spark, d).select("p_partkey", X.dims(F.col("p_partkey") % 7, "p_size").alias("dims"))


SLUG48 = "substr(trim(regexp_replace(coalesce({0}, ''), '[^A-Za-z0-9]', '_', 'g'), '_'), 1, 48)"


@query("x03_safe_filename", f"SELECT doc_id, CASE WHEN s = '' THEN 'image' ELSE s END||' ['||substr(CAST(doc_id * 1000003 AS VARCHAR), 1, 8)||'].jpg' AS name, trim(regexp_replace(text, '[/\\\\\\[\\]]', '_', 'g'), ' ')||' ['||doc_id||'].gltf' AS readable FROM (SELECT doc_id, text, {SLUG48.format('text')} AS s FROM documents)")
def x03(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", X.safe_filename("text", (F.col("doc_id") * 1000003).cast("string"), F.lit("jpg"), "image").alias("name"), X.catalogue_filename("text", "doc_id", F.lit("gltf")).alias("readable"))


TYPES, TAILS = ("", "JPEG", "png", None), ("a.JPG", "b.webp", "c", "d.exe", "e.jpeg")


@query(
    "x04_infer_ext",
    f"""SELECT p_partkey, CASE WHEN ft = 'jpeg' THEN 'jpg' WHEN ft <> '' THEN ft WHEN t IN ('jpg', 'jpeg') THEN 'jpg' WHEN t IN ('png', 'gif', 'webp', 'bmp', 'tiff', 'svg') THEN t ELSE 'jpg' END AS ext,
 CASE WHEN ft <> '' THEN ft WHEN t IN ('mp3', 'wav', 'ogg', 'flac', 'oga', 'm4a', 'aiff', 'aif') THEN t ELSE 'mp3' END AS sound_ext
 FROM (SELECT p_partkey, lower(trim(coalesce({sql_pick('p_partkey', *TYPES)}, ''))) AS ft, lower(list_last(string_split(list_last(string_split('https://h/x/'||{sql_pick('p_partkey', *TAILS)}, '/')), '.'))) AS t FROM part)""",
)
def x04(spark, d):
    ft, url = pick(F.col("p_partkey"), *TYPES), F.concat(F.lit("https://h/x/"), pick(F.col("p_partkey"), *TAILS))
    return part(spark, d).select("p_partkey", X.infer_ext(ft, url).alias("ext"), X.infer_sound_ext(ft, url).alias("sound_ext"))


@query("x05_human_count", f"SELECT o_orderkey, CASE WHEN n >= 1000000000 THEN {half_up('n / 1e9', 1)}||'B' WHEN n >= 1000000 THEN {half_up('n / 1e6', 1)}||'M' WHEN n >= 1000 THEN {half_up('n / 1e3', 1)}||'K' ELSE CAST(n AS VARCHAR) END AS views FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 3) * (o_orderkey % 2000) AS n FROM orders)")
def x05(spark, d):
    n = F.floor("o_totalprice").cast("bigint") * (F.col("o_orderkey") % 3) * (F.col("o_orderkey") % 2000)
    return table(spark, d, "orders").select("o_orderkey", X.human_count(n).alias("views"))


@query("x06_duration_str", "SELECT event_id, CASE WHEN t <= 0 THEN 'LIVE' WHEN CAST(floor(t) AS BIGINT) >= 3600 THEN (CAST(floor(t) AS BIGINT) // 3600)||':'||lpad(CAST(CAST(floor(t) AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0')||':'||lpad(CAST(CAST(floor(t) AS BIGINT) % 60 AS VARCHAR), 2, '0') ELSE (CAST(floor(t) AS BIGINT) // 60)||':'||lpad(CAST(CAST(floor(t) AS BIGINT) % 60 AS VARCHAR), 2, '0') END AS duration FROM (SELECT event_id, value * (event_id % 40) AS t FROM events)")
def x06(spark, d):
    return table(spark, d, "events").select("event_id", X.duration_str(F.col("value") * (F.col("event_id") % 40)).alias("duration"))


@query("x07_sound_labels", f"SELECT o_orderkey, CASE WHEN ms = 0 THEN '' ELSE (ms // 60000)||':'||lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') END AS duration, CASE WHEN hz = 0 THEN '' ELSE {half_up('hz / 1000.0', 1)}||' kHz' END AS rate FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 5) AS ms, o_orderkey % 9 * 11025 AS hz FROM orders)")
def x07(spark, d):
    ms, hz = F.floor("o_totalprice").cast("bigint") * (F.col("o_orderkey") % 5), F.col("o_orderkey") % 9 * 11025
    return table(spark, d, "orders").select("o_orderkey", X.duration_label(ms).alias("duration"), X.rate_label(hz).alias("rate"))


@query("x08_size_label", f"SELECT doc_id, CASE WHEN n = 0 THEN '' WHEN n >= 1048576 THEN {half_up('n / 1048576.0', 1)}||' MB' ELSE {half_up('n / 1024.0', 0)}||' KB' END AS size FROM (SELECT doc_id, n_chars * (doc_id % 900) AS n FROM documents)")
def x08(spark, d):
    return table(spark, d, "documents").select("doc_id", X.size_label(F.col("n_chars") * (F.col("doc_id") % 900)).alias("size"))


@query("x09_date_pretty", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'c. 1994' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def x09(spark, d):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.lit("c. 1994")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return table(spark, d, "orders").select("o_orderkey", X.date_pretty(raw).alias("day"))


@query("x10_percent", "SELECT doc_id, url_encode(text) AS encoded, replace(url_encode(text), '%2F', '/') AS path, text AS decoded FROM documents")
def x10(spark, d):
    return table(spark, d, "documents").select("doc_id", X.pct_encode("text").alias("encoded"), X.enc_path("text").alias("path"), X.pct_decode(X.pct_encode("text")).alias("decoded"))


HOST = "split_part(split_part(url, '://', 2), '/', 1)"


@query("x11_join_url", f"WITH {base.LINKS} SELECT page_id, pos, CASE WHEN trim(href) = '' OR href[1] = '#' OR starts_with(href, 'mailto:') OR starts_with(href, 'javascript:') THEN NULL WHEN contains(href, '://') THEN href WHEN starts_with(href, '//') THEN split_part(url, '://', 1)||':'||href WHEN href[1] = '/' THEN split_part(url, '://', 1)||'://'||{HOST}||href END AS target FROM links")
def x11(spark, d):
    return base.links(spark, d).select("page_id", "pos", X.join_url("url", "href").alias("target"))


@query("x12_split_url", "SELECT page_id, split_part(url, '://', 1)||'://'||h AS origin, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id, url, split_part(split_part(url, '://', 2), '/', 1) AS h, substr(split_part(url, '://', 2), length(split_part(split_part(url, '://', 2), '/', 1)) + 1) AS p FROM pages)")
def x12(spark, d):
    return table(spark, d, "pages").select("page_id", X.split_url("url").alias("s")).select("page_id", "s.origin", "s.path")


@query("x13_parts_for_url", "SELECT page_id, array_to_string([url_decode(p) FOR p IN string_split(split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1), '/') IF p <> ''], '|') AS parts, starts_with(url, 'http://') AS is_http FROM pages")
def x13(spark, d):
    return table(spark, d, "pages").select("page_id", X.parts_for_url("url").alias("s")).select("page_id", F.array_join("s.parts", "|").alias("parts"), "s.is_http")


@query("x14_abs_url", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'https://x/tn/y' WHEN doc_id % 4 = 1 THEN '' ELSE 'https://art.example'||replace(url_encode('/pack/x1/'||source||'#'||doc_id||'/tn/a b.png'), '%2F', '/') END AS url FROM documents")
def x14(spark, d):
    p = F.when(F.col("doc_id") % 4 == 0, F.lit("https://x/tn/y")).when(F.col("doc_id") % 4 == 1, F.lit("")).otherwise(F.concat(F.lit("/pack/tn/"), "source", F.lit("#"), "doc_id", F.lit("/tn/a b.png")))
    moved = F.when(F.startswith(p, F.lit("/")), X.x1_url(p)).otherwise(p)
    return table(spark, d, "documents").select("doc_id", X.abs_url(moved, "https://art.example").alias("url"))


@query("x15_strip_markup", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*(>|$)|>', '', 'g'), '\\s+', ' ', 'g')) AS bare, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<[^>]*(>|$)', ' ', 'g'), '>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' ') AS spaced FROM pages")
def x15(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_html("html").alias("bare"), X.strip_tags("html").alias("spaced"))


UNITS = ("", "K", "m", "G", "B", "x")


@query("x16_parse_size", f"SELECT o_orderkey, CASE u WHEN 'x' THEN NULL WHEN 'K' THEN CAST(floor(v * 1024) AS BIGINT) WHEN 'm' THEN CAST(floor(v * 1048576) AS BIGINT) WHEN 'G' THEN CAST(floor(v * 1073741824) AS BIGINT) ELSE CAST(floor(v) AS BIGINT) END AS bytes FROM (SELECT o_orderkey, (o_orderkey % 5000) / 4.0 AS v, {sql_pick('o_orderkey', *UNITS)} AS u FROM orders)")
def x16(spark, d):
    token = F.concat(((F.col("o_orderkey") % 5000) / 4).cast("string"), pick(F.col("o_orderkey"), *UNITS))
    return table(spark, d, "orders").select("o_orderkey", X.parse_size(token).alias("bytes"))


@query("x17_parse_hex", "SELECT p_partkey, CAST(p_partkey * 7919 % 16777216 // 65536 AS INTEGER) AS r, CAST(p_partkey * 7919 % 65536 // 256 AS INTEGER) AS g, CAST(p_partkey * 7919 % 256 AS INTEGER) AS b, CAST(p_partkey % 16 * 17 AS INTEGER) AS short_r FROM part")
def x17(spark, d):
    n = F.col("p_partkey") * 7919 % 16777216
    full, short = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(n)), 6, "0")), F.concat(F.lit("#"), F.hex(F.col("p_partkey") % 16), F.lit("0F"))
    return part(spark, d).select("p_partkey", X.parse_hex(full).alias("c"), X.parse_hex_any(short).alias("s")).select("p_partkey", "c.*", F.col("s.r").alias("short_r"))


@query("x18_slug", "SELECT doc_id, s AS slug, CASE WHEN rtrim(substr(s, 1, 24), '-') = '' THEN 'ai' ELSE rtrim(substr(s, 1, 24), '-') END||'_'||doc_id AS base FROM (SELECT doc_id, trim(lower(regexp_replace(text, '[^A-Za-z0-9]+', '-', 'g')), '-') AS s FROM documents)")
def x18(spark, d):
    return table(spark, d, "documents").select("doc_id", X.slug("text").alias("slug"), X.filename_base("text", "doc_id", 24).alias("base"))


@query("x19_expand", "SELECT p_partkey, p_name||' by '||upper(p_brand)||', '||trim(lower(regexp_replace(p_type, '[^A-Za-z0-9]+', '-', 'g')), '-')||' / '||lower(p_brand)||' {open' AS text FROM part")
def x19(spark, d):
    values = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"), F.lit("kind"), F.col("p_type"))
    return part(spark, d).select("p_partkey", X.expand(F.lit("{name} by {BRAND}, {kind:slug} / {brand:lower}{none} {open"), values).alias("text"))


@query("x20_stars", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(least(event_id % 14 // 2, 5) AS INTEGER) END AS stars, CAST(least(event_id % 8, 5) * 2 AS VARCHAR) AS value FROM events")
def x20(spark, d):
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("none")).otherwise(F.concat(F.lit(" "), (F.col("event_id") % 14).cast("string")))
    return table(spark, d, "events").select("event_id", X.stars_from_value(raw).alias("stars"), X.value_from_stars(F.col("event_id") % 8).alias("value"))


KINDS = "CASE d WHEN 0 THEN 'None' WHEN 1 THEN coalesce((['ASCII', 'ANSi', 'ANSiMation', 'RIPScript', 'PCBoard', 'Avatar', 'HTML', 'Source', 'TundraDraw'])[1 + f], 'Character') ELSE coalesce((['Bitmap', 'Vector', 'Audio', 'BinaryText', 'XBin', 'Archive', 'Executable'])[d - 1], 'Unknown') END"


@query("x21_kind_label", f"SELECT p_partkey, {KINDS} AS kind, CASE WHEN d = 1 AND t > 0 THEN CAST(t AS INTEGER) WHEN d = 5 AND f > 0 THEN CAST(f * 2 AS INTEGER) END AS width FROM (SELECT p_partkey, p_partkey % 10 AS d, p_partkey % 11 AS f, p_size % 4 AS t FROM part)")
def x21(spark, d):
    dt, ft, t = F.col("p_partkey") % 10, F.col("p_partkey") % 11, F.col("p_size") % 4
    return part(spark, d).select("p_partkey", X.kind_label(dt, ft).alias("kind"), X.char_width(dt, ft, t).alias("width"))


@query("x22_embedded_ids", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey END AS id, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS slug, CASE p_partkey % 3 WHEN 0 THEN 'c'||p_partkey WHEN 1 THEN 'UC'||p_partkey ELSE '' END AS channel, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS appid FROM part")
def x22(spark, d):
    k = F.col("p_partkey")
    leaf = F.when(k % 3 == 0, F.col("p_name")).otherwise(F.concat(F.col("p_name"), F.lit(" [x] ["), k.cast("string"), F.lit("].xm")))
    url = F.when(k % 3 == 0, F.concat(F.lit("https://v/channel/c"), k, F.lit("/videos?a=b"))).when(k % 3 == 1, F.concat(F.lit("UC"), k)).otherwise(F.lit("https://v/@me"))
    path = F.when(k % 2 == 0, F.concat(F.lit("game/"), k)).otherwise(F.concat(F.lit("shelf/"), k))
    return part(spark, d).select("p_partkey", X.parse_id(leaf).alias("id"), X.bracketed(leaf).alias("slug"), X.channel_id(url).alias("channel"), X.detail_appid(path).alias("appid"))


@query("x23_parse_note", "SELECT p_partkey, CAST(least(greatest((p_partkey % 12 - 1) * 12 + 12 + ([0, 2, 4, 5, 7, 9, 11])[1 + p_partkey % 7] + ([0, 1, -1])[1 + p_partkey % 3], 0), 127) AS INTEGER) AS note, CAST(least(p_partkey, 127) AS INTEGER) AS number FROM part")
def x23(spark, d):
    k = F.col("p_partkey")
    name = F.concat(pick(k, *"CdEfGaB"), pick(k, "", "#", "b"), (k % 12 - 1).cast("string"))
    return part(spark, d).select("p_partkey", X.parse_note(name).alias("note"), X.parse_note(k.cast("string")).alias("number"))


@query("x24_fraction", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0.0 ELSE CAST(p_partkey AS DOUBLE) / (p_size % 4) END AS rate, CASE WHEN p_size % 9 = 0 THEN 1.0 ELSE least((p_size % 9) * 0.1, greatest(CAST(p_size % 9 AS DOUBLE) - 1, 0.0)) END AS seek FROM part")
def x24(spark, d):
    return part(spark, d).select("p_partkey", X.parse_fraction(F.concat_ws("/", "p_partkey", F.col("p_size") % 4)).alias("rate"), X.thumb_seek(F.col("p_size") % 9).alias("seek"))


@query("x25_best_weight", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '400' WHEN 1 THEN '100' ELSE '400' END AS weight FROM part")
def x25(spark, d):
    w = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("300"), F.lit("400"))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("100"), F.lit("700"))).otherwise(F.array().cast("array<string>"))
    return part(spark, d).select("p_partkey", X.best_weight(w).alias("weight"))


@query("x26_names", "SELECT p_partkey, p_name AS family, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name||'.v2' END AS display, p_name||'.v2 ['||p_partkey||'].xm' AS leaf FROM part")
def x26(spark, d):
    title = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_brand")).otherwise(F.lit("  "))
    file_ = F.concat("p_name", F.lit(".v2.XM"))
    return part(spark, d).select("p_partkey", X.parse_family(F.concat("p_name", F.lit(".ttf"))).alias("family"), X.display_name(title, file_).alias("display"), X.leaf(file_, "p_partkey").alias("leaf"))


@query("x27_url_key", "SELECT count(*) AS urls, count(DISTINCT url) AS keys, 16 AS shortest, 16 AS longest FROM pages")
def x27(spark, d):
    k = table(spark, d, "pages").select(X.url_key("url").alias("k"))
    return k.agg(F.count("*").alias("urls"), F.countDistinct("k").alias("keys"), F.min(F.length("k")).alias("shortest"), F.max(F.length("k")).alias("longest"))


MEMBERS = ("a/b.txt", "..\\x", "/abs/c", "a/../../d", "./e", "a/../f", "")


@query("x28_safe_member", f"SELECT doc_id, {sql_pick('doc_id', 'a/b.txt', None, 'abs/c', None, 'e', 'f', None)} AS member FROM documents")
def x28(spark, d):
    return table(spark, d, "documents").select("doc_id", X.safe_member(pick(F.col("doc_id"), *MEMBERS)).alias("member"))


@query("x29_normalize_path", f"SELECT doc_id, {sql_pick('doc_id', '/s/b', 's/a/c', 'd', '/e/f')} AS path FROM documents")
def x29(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_path(pick(F.col("doc_id"), "/s/a/../b", "s/./a//c", "a/../../d", "/e/f/")).alias("path"))


@query("x30_url_from", "SELECT p_partkey, 'https://games.example/app/'||p_partkey||'/' AS page, 'https://fonts.example/specimen/'||replace(p_name, ' ', '+') AS specimen, 'https://img.example/?q='||url_encode(p_name)||'&page=1' AS search FROM part")
def x30(spark, d):
    return part(spark, d).select("p_partkey", X.url_from("https://games.example/app/{id}/", id="p_partkey").alias("page"), X.url_from("https://fonts.example/specimen/{name:plus}", name="p_name").alias("specimen"), X.url_from("https://img.example/?q={name}&page=1", name="p_name").alias("search"))


@query("x31_kind_info", f"SELECT p_partkey, {sql_pick('p_partkey', '3D Models', 'Textures', 'HDRIs', None)} AS label, {sql_pick('p_partkey', 'gltf', 'jpg', 'jpg', None)} AS ext, {sql_pick('p_partkey', 'modified', 'new', 'ignored', 'conflict', 'conflict', 'modified')} AS status FROM part")
def x31(spark, d):
    k = F.col("p_partkey")
    return part(spark, d).select("p_partkey", X.kind_info(pick(k, "models", "textures", "hdris", "rocks")).alias("i"), X.status_label(pick(k, " M", "??", "!!", "UU", "AA", "R ")).alias("status")).select("p_partkey", "i.label", "i.ext", "status")


@query("x32_first_nonempty", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN p_brand WHEN p_partkey % 3 > 0 THEN p_type ELSE '(none)' END AS name FROM part")
def x32(spark, d):
    a, b = F.when(F.col("p_partkey") % 2 == 1, F.col("p_brand")).otherwise(F.lit("")), F.when(F.col("p_partkey") % 3 > 0, F.col("p_type"))
    return part(spark, d).select("p_partkey", X.first_nonempty([a, b], "(none)").alias("name"))


# ---------------------------------------------------------------- filters


@query("f01_match_words", "SELECT p_partkey FROM part WHERE contains(lower(p_name||' '||p_brand||' '||p_type), 'ring') AND contains(lower(p_name||' '||p_brand||' '||p_type), 'brand#1')")
def f01(spark, d):
    return P.match_words(part(spark, d), " RING  brand#1", ["p_name", "p_brand", "p_type"]).select("p_partkey")


@query("f02_glob", "SELECT doc_id FROM documents WHERE regexp_full_match(lower(source||'/'||doc_id), 's.c1.*/.*7.', 's')")
def f02(spark, d):
    return table(spark, d, "documents").where(P.glob(F.concat_ws("/", "source", "doc_id"), "S?c1*/*7?")).select("doc_id")


@query("f03_glob_any", f"WITH {CAT} SELECT path FROM cat WHERE (ends_with(lower(name), '.ans') OR starts_with(name, '1')) AND NOT (contains(name, '9') OR ends_with(name, '5.txt'))")
def f03(spark, d):
    return catalogue(spark, d).where(P.glob_any("name", "*.ans; 1* | *9* ;*5.TXT")).select("path")


@query("f04_facet_filter", f"WITH {CAT} SELECT DISTINCT artist FROM cat WHERE contains(lower(artist), 'ist 1') ORDER BY artist LIMIT 100")
def f04(spark, d):
    return P.facet_filter(catalogue(spark, d), "artist", "IST 1")


ADV = "contains(lower(name), '2') AND ext IN ('txt', 'png') AND width BETWEEN 10 AND 500 AND height >= 40 AND size <= 5000 AND modified >= 36000 AND stars >= 0 AND contains(lower(title||' '||artist||' '||grp), 'group1')"
WANTED = {"name": "2", "exts": ["TXT", "png"], "width": (10, 500), "height": (40, None), "size": (None, 5000), "modified": (36000, None), "min_stars": 0, "trailer": "GROUP1"}


def starred(spark, d):
    return catalogue(spark, d).withColumn("stars", (F.col("doc_id") % 6).cast("int"))


@query("f05_advanced_search", f"WITH {CAT}, s AS (SELECT *, doc_id % 6 AS stars FROM cat) SELECT path FROM s WHERE {ADV}")
def f05(spark, d):
    return P.advanced_search(starred(spark, d), **WANTED).select("path")


NAMES = ("Proton 8.0", "SteamVR", "steamvr 2", "Steam Linux Runtime 3", "Widget")


@query("f06_is_nongame", f"SELECT p_partkey, {sql_pick('p_partkey', 1, 1, 0, 1, 0)} = 1 AS tool FROM part")
def f06(spark, d):
    return part(spark, d).select("p_partkey", P.is_nongame(pick(F.col("p_partkey"), *NAMES)).alias("tool"))


@query("f07_smart_filter", f"WITH {CAT}, seed AS (SELECT * FROM cat WHERE doc_id = 7) SELECT 'size' AS attr, c.path FROM cat c, seed s WHERE c.size BETWEEN s.size * 0.8 AND s.size * 1.2 UNION ALL SELECT 'ext', c.path FROM cat c, seed s WHERE c.ext = s.ext UNION ALL SELECT 'word', c.path FROM cat c, seed s WHERE contains(lower(c.name), '7')")
def f07(spark, d):
    c = catalogue(spark, d)
    seed = c.where("doc_id = 7")
    out = [P.smart_filter(c, seed, a).select(F.lit(a).alias("attr"), "path") for a in ("size", "ext", "word")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("f08_run_saved", f"WITH {CAT} SELECT path FROM cat WHERE starts_with(path, 'src1/') AND ext = 'ans' AND size >= 1000")
def f08(spark, d):
    return P.run_saved(catalogue(spark, d).where(F.startswith("path", F.lit("src1/"))), {"exts": ["ANS"], "size": (1000, None)}).select("path")


@query("f09_fresh", f"WITH {base.CACHE} SELECT url, length(url) % 3 = 0 OR 1704153600 - fetched <= 86000 AS fresh FROM cache")
def f09(spark, d):
    base.utc(spark)
    ttl = F.when(F.length("url") % 3 == 0, F.lit(None)).otherwise(F.lit(86_000))
    return base.cache_index(spark, d).select("url", P.fresh(F.lit(1_704_153_600), "fetched", ttl).alias("fresh"))


@query("f10_ttl_for", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 3600 ELSE 86400 END AS ttl FROM pages")
def f10(spark, d):
    url = F.concat("url", pick(F.col("page_id"), "/pack/latest", "/latest/x", "/group"))
    return table(spark, d, "pages").select("page_id", P.ttl_for(url).alias("ttl"))


@query("f11_within_cap", "SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR n_chars <= 2000")
def f11(spark, d):
    return table(spark, d, "documents").where(P.within_cap(F.when(F.col("doc_id") % 5 != 0, F.col("n_chars")), 2000)).select("doc_id")


@query("f12_search_ext", f"WITH {CAT} SELECT path FROM cat WHERE ext = 'png' AND contains(lower(title), 'the') ORDER BY doc_id LIMIT 20")
def f12(spark, d):
    return P.search_ext(catalogue(spark, d), "the", 20, "png", ["title"], ["doc_id"]).select("path")


ROOTS = {"src0": "icons", "src1": "vectors"}


@query("f13_source_of", f"WITH {CAT} SELECT path, CASE split_part(path, '/', 1) WHEN 'src0' THEN 'icons' WHEN 'src1' THEN 'vectors' END AS source, CASE WHEN split_part(path, '/', 1) IN ('src0', 'src1') THEN split_part(path, '/', 2)||'|'||split_part(path, '/', 3) ELSE '' END AS parts FROM cat")
def f13(spark, d):
    return catalogue(spark, d).select("path", P.source_of("path", ROOTS).alias("source"), F.array_join(P.rel_parts("path", ROOTS), "|").alias("parts"))


URLS = ("a/b.zip", "a.html?x=y.zip", "pkg.tar.gz#f", "x/noext", "v1.longext", "p.PHP", "i.Png?w=1", "dot.")


@query("f14_looks_like_file", f"SELECT page_id, {sql_pick('page_id', 1, 0, 1, 0, 0, 0, 1, 1)} = 1 AS file FROM pages")
def f14(spark, d):
    return table(spark, d, "pages").select("page_id", X.looks_like_file(F.concat(F.lit("https://host/"), pick(F.col("page_id"), *URLS))).alias("file"))


@query("f15_details", "SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN '—' ELSE p_brand||', '||p_type END AS designers FROM part")
def f15(spark, d):
    t = part(spark, d).withColumn("designers", F.when(F.col("p_partkey") % 3 != 0, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>")))
    return P.details(t, ["p_partkey", "p_name"], ["designers"])


PARTIALS = (".mp4", ".mp4.part", ".f137.mp4", ".ytdl", ".part-Frag3")


@query("f16_is_partial", f"SELECT p_partkey, {sql_pick('p_partkey', 0, 1, 1, 1, 1)} = 1 AS partial FROM part")
def f16(spark, d):
    id_ = F.concat(F.lit("v"), "p_partkey")
    return part(spark, d).select("p_partkey", P.is_partial(F.concat(id_, pick(F.col("p_partkey"), *PARTIALS)), id_).alias("partial"))


@query("f17_find_in_text", "WITH s AS (SELECT doc_id, string_split(text, 'the') AS parts FROM documents WHERE contains(text, 'the')), n AS (SELECT doc_id, parts, unnest(range(1, len(parts))) AS k FROM s) SELECT doc_id, CAST(k - 1 AS INTEGER) AS no, CAST(length(array_to_string(parts[1:k], 'the')) + 1 AS BIGINT) AS at FROM n")
def f17(spark, d):
    return P.find_in_text(table(spark, d, "documents"), "the").select("doc_id", "no", "at")


@query("f18_name_filter", f"WITH {CAT} SELECT path FROM cat WHERE starts_with(path, 'src3/en/') AND contains(lower(name), '3.z')")
def f18(spark, d):
    return P.name_filter(catalogue(spark, d).where(F.startswith("path", F.lit("src3/en/"))), "3.Z").select("path")
