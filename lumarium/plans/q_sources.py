"""Queries of the sources (S): bodies are built from the given tables and read back; SQL reads the tables themselves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.pieces import numbered
from ..sources import catalogues as S
from ..sources import files as Fi
from ..sources import web
from . import base
from .base import CAT, catalogue, pick, query, spread, sql_pick, table

SITE = "https://art.example"


def obj(**fields):
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def body(*args, **fields):
    return F.to_json(obj(**fields), {"ignoreNullFields": "false"})


def parts(spark, d):
    return table(spark, d, "part")


def text(x):
    return F.col(x).cast("string") if isinstance(x, str) else x.cast("string")


# ---------------------------------------------------------------- files


@query("s01_catalogue", f"WITH {CAT} SELECT path, size FROM cat WHERE ext IN ('txt', 'ans', 'png')")
def s01(spark, d):
    return Fi.known_extensions(catalogue(spark, d), ["TXT", "ans", "png", "zip"], ["zip"]).select("path", "size")


#: First bytes of files and the kind that they have; None where only the name tells.
HEADS = (
    ("0A05010800", "pcx"), ("464F524D0000001C494C424D424D4844", "iff"), ("464F524D0000001C41494646434F4D4D", None), ("00010203E0A5", "ase"), ("00010000E0A50001", "ase"), ("00010000000C0080", "ttf"),
    ("38425053000100", "psd"), ("67696D70207863662076303131", "xcf"), ("67696D702078636676", None), ("3C737667206964", "svg"), ("20200A3C3F786D6C20", "svg"), ("3C212D2D2D2D3E3C7376673E", "svg"), ("68656C6C6F", None),
    ("4F54544F00", "otf"), ("74727565", "ttf"), ("74797031", "ttf"), ("74746366", "ttc"), ("1354686544726177" + "20464F4E54532066696C651A", "tdf"), ("1354686544726177" + "20464F4E54532066696C65", None),
    ("36040000", "psf"), ("72B54A86", "psf"), ("000003F300", "amigafont"), ("5842494E1A50", "xbin"), ("5842494E1B", None), ("1854554E4452413234", "tnd"), ("1854554E44524132", None), ("1F8B08", "xp"),
    ("04312E34", "idf"), ("04312E35", "idf"), ("04312E36", None), ("7B2276657273696F6E223A32", "petmate"), ("7B226E616D65223A32", None), ("217C2A", "rip"), ("255044462D312E37", "pdf"), ("25504446", None),
    ("252150532D41646F6265", "eps"), ("C5D0D3C620", "eps"), ("89504E470D0A1A0A00", "png"), ("89504E470D0A1A", None), ("FFD8FFE0", "jpg"), ("474946383961FF", "gif"), ("474946383761FF", "gif"), ("474946383861FF", None),
    ("524946460000000057454250", "webp"), ("524946460000000057415645", None), ("4D4D002A", "tif"), ("49492A00", "tif"), ("44445320", "dds"), ("424D3A", "bmp"), ("00000100", "ico"), ("233F52414449414E4345", "hdr"),
    ("50310A", "pnm"), ("50360A", "pnm"), ("50380A", None), ("6661726266656C64", "ff"), ("0000001C6674797061766966", "avif"), ("0000001C667479706D703432", None), ("762F3101", "exr"), ("716F6966", "qoi"), ("", None),
)


@query("s02_classify_files", f"WITH k AS (SELECT doc_id, {sql_pick('doc_id', *(k for _, k in HEADS))} AS kind FROM documents) SELECT doc_id, coalesce(kind, CASE doc_id % 7 WHEN 0 THEN 'ans' WHEN 1 THEN 'ans' ELSE 'md' END) AS kind FROM k")
def s02(spark, d):
    name = F.when(F.col("doc_id") % 7 == 0, F.lit("")).when(F.col("doc_id") % 7 == 1, F.lit("/.MD")).otherwise(F.lit(".MD"))
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit("a.b/"), "doc_id", name).alias("path"), F.unhex(pick(F.col("doc_id"), *(h for h, _ in HEADS))).alias("content"))
    return Fi.classify_files(t).select("doc_id", "kind")


NAMES = ("zip", "7Z", "rar", "lha", "LZH", "tar", "ace", "arj", "arc", "zoo", "ha", "uc2", "sqz", "hyp", "tgz", "tbz", "xrns", "XRNI", "gz", "bz2", "xz", "Z", "sf2", "sfz", "dls", "xi", "txt", "zip2", "")


@query("s03_is_archive", f"WITH n AS (SELECT doc_id, {sql_pick('doc_id', *NAMES)} AS e FROM documents) SELECT doc_id, lower(e) IN ('7z', 'ace', 'arc', 'arj', 'ha', 'hyp', 'lha', 'lzh', 'rar', 'sqz', 'tar', 'tbz', 'tgz', 'uc2', 'xrni', 'xrns', 'zip', 'zoo') AS archive FROM n")
def s03(spark, d):
    return table(spark, d, "documents").select("doc_id", Fi.is_archive(F.concat(F.lit("x.zip/a.tar."), pick(F.col("doc_id"), *NAMES))).alias("archive"))


def sauce_of(k):
    """A trailer object: blank for every fourth row; the date a number or a text."""
    blank = k % 4 == 0
    t = lambda v: F.when(blank, F.lit("  ")).otherwise(v)
    return obj(Title=t(F.concat(F.lit(" T"), k)), Author=t(F.lit("me")), Group=F.lit(""), Date=F.when(blank, F.lit("")).otherwise((19900000 + k).cast("string")), Datatype=F.lit(1), Filetype=k % 9, Tinfo1=F.lit(80), Tinfo2=k % 50, Tflags=k % 3, Tinfos=F.lit("IBM VGA "), Comments=F.lit(""), Filesize=k * 10, f=obj(ice=F.when(k % 5 == 0, 1).otherwise(0)))


SAUCE_COLS = "CASE WHEN k % 4 = 0 THEN NULL ELSE 'T'||k END AS title, CASE WHEN k % 4 <> 0 THEN CAST(19900000 + k AS VARCHAR) END AS date, CASE WHEN k % 4 <> 0 THEN k % 5 = 0 OR (k % 3) & 1 <> 0 END AS ice"


def piece_cols(df, key):
    return df.select(*key, "filename", "artist", "grp", "year", "pack", "raw_url", "thumb_url", "filesize", F.col("sauce.title").alias("title"), F.col("sauce.date").alias("date"), F.col("sauce.ice").alias("ice"))


@query("s04_pieces_from_artist", f"SELECT p_name||'.ANS' AS filename, p_brand AS artist, p_type AS grp, CAST(1990 + p_size AS INTEGER) AS year, 'pk'||(k % 9) AS pack, '{SITE}/pack/'||url_encode('#'||k)||'/raw' AS raw_url, '{SITE}/pack/'||k||'/x1/a.png' AS thumb_url, k * 10 AS filesize, {SAUCE_COLS} FROM (SELECT *, p_partkey AS k FROM part) WHERE k % 6 > 0")
def s04(spark, d):
    k = F.col("p_partkey")
    file_ = obj(file=F.when(k % 6 > 0, F.concat("p_name", F.lit(".ANS"))), raw=F.concat(F.lit("/pack/#"), k, F.lit("/raw")), tn=F.concat(F.lit("/pack/"), k, F.lit("/tn/a.png")), sauce=sauce_of(k))
    packs = F.create_map(F.concat(F.lit("pk"), k % 9), obj(group=F.col("p_type"), files=F.array(file_)))
    t = parts(spark, d).select(F.col("p_brand").alias("artist"), body(results=F.create_map((1990 + F.col("p_size")).cast("string"), packs)).alias("body"))
    return piece_cols(S.pieces_from_artist(t, SITE), [])


@query("s05_pieces_from_pack", f"SELECT p_name AS filename, p_brand||', '||p_type AS artist, 'acid' AS grp, CAST(CASE WHEN k % 2 = 0 THEN 1990 + p_size ELSE 1999 END AS INTEGER) AS year, 'pk '||k AS pack, '{SITE}/pack/'||url_encode('pk '||k)||'/raw/'||url_encode(p_name) AS raw_url, '' AS thumb_url, k * 10 AS filesize, {SAUCE_COLS} FROM (SELECT *, p_partkey AS k FROM part)")
def s05(spark, d):
    k = F.col("p_partkey")
    f = F.create_map(F.col("p_name"), obj(file=obj(raw=F.lit("r"), tn=obj(uri=F.lit(None).cast("string"))), artists=F.array("p_brand", F.lit(None).cast("string"), "p_type"), sauce=sauce_of(k)))
    result = obj(year=F.when(k % 2 == 0, 1990 + F.col("p_size")), files=f)
    t = parts(spark, d).select(F.lit("acid").alias("grp"), F.lit(1999).alias("year_hint"), F.concat(F.lit("pk "), k).alias("pack"), body(results=F.array(result)).alias("body"))
    return piece_cols(S.pieces_from_pack(t, SITE), [])


@query("s06_sauce_struct", f"SELECT p_partkey, {SAUCE_COLS}, CASE WHEN k % 4 <> 0 THEN CAST(k % 9 AS INTEGER) END AS file_type, CASE WHEN k % 4 <> 0 THEN 'IBM VGA' END AS font FROM (SELECT *, p_partkey AS k FROM part)")
def s06(spark, d):
    t = parts(spark, d).select("p_partkey", F.from_json(F.to_json(sauce_of(F.col("p_partkey"))), S.SAUCE).alias("s"))
    return t.select("p_partkey", S.sauce_struct(F.col("s")).alias("s")).select("p_partkey", "s.title", "s.date", "s.ice", "s.file_type", "s.font")


def pack_bodies(spark, d):
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, F.get_json_object(F.to_json(obj(n=k)), "$.n")).otherwise(F.concat(F.lit("Pack"), k))
    url = F.when(k % 2 == 0, F.concat(F.lit("/archive/"), k)).otherwise(F.concat(F.lit("https://cdn/"), k))
    return table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.concat(F.lit('{"results":[{"name":'), F.when(k % 3 == 0, name).otherwise(F.concat(F.lit('"'), name, F.lit('"'))), F.lit(',"archive":"'), url, F.lit('"}]}')).alias("body"))


PACKS = f"packs AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'Pack'||o_orderkey END AS name, CASE WHEN o_orderkey % 2 = 0 THEN '{SITE}/archive/'||o_orderkey ELSE 'https://cdn/'||o_orderkey END AS url FROM orders)"


@query("s07_packs", f"WITH {PACKS} SELECT year, name, url FROM packs")
def s07(spark, d):
    return S.packs(pack_bodies(spark, d), SITE)


@query("s08_pack_store", f"WITH {PACKS} SELECT year, CASE WHEN year = (SELECT max(year) FROM packs) THEN name||'!' ELSE name END AS name, url FROM packs WHERE year >= (SELECT max(year) - 1 FROM packs)")
def s08(spark, d):
    """The newest year is refreshed in place; a read prunes to the years asked for."""
    path, packs = G.scratch(spark), S.packs(pack_bodies(spark, d), SITE)
    S.write_packs(packs, path)
    newest = packs.agg(F.max("year")).first()[0]
    S.write_packs(packs.where(F.col("year") == newest).withColumn("name", F.concat("name", F.lit("!"))), path)
    return S.read_packs(spark, path).where(F.col("year") >= newest - 1).select("year", "name", "url")


@query("s09_group_names", "SELECT DISTINCT p_name AS name FROM part")
def s09(spark, d):
    return S.group_names(parts(spark, d).select(body(results=F.array(F.create_map("p_name", obj(releases=F.col("p_size"))))).alias("body")))


@query("s10_artist_names", "SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 4 > 0")
def s10(spark, d):
    return S.artist_names(parts(spark, d).select(body(results=F.array(obj(artist=obj(name=F.when(F.col("p_partkey") % 4 > 0, F.col("p_name")))))).alias("body")))


@query("s11_group_pack_refs", "SELECT p_partkey AS grp, CAST(1990 + p_size AS INTEGER) AS year, unnest([p_name, p_brand]) AS pack, unnest([0, 2]) AS pos FROM part")
def s11(spark, d):
    packs = F.create_map((1990 + F.col("p_size")).cast("string"), F.array("p_name", F.lit(None).cast("string"), "p_brand"))
    return S.group_pack_refs(parts(spark, d).select(F.col("p_partkey").alias("grp"), body(results=obj(packs=packs)).alias("body")))


@query("s12_latest_releases", f"SELECT 0 AS pos, p_name AS name, '{SITE}/dl/'||p_partkey AS url FROM part WHERE p_partkey % 5 > 0")
def s12(spark, d):
    k = F.col("p_partkey")
    return S.latest_releases(parts(spark, d).select(body(results=F.array(obj(pack=F.col("p_name"), download=F.when(k % 5 > 0, F.concat(F.lit("/dl/"), k))))).alias("body")), SITE)


# ---------------------------------------------------------------- searches


def hit(k, **more):
    return obj(id=F.when(k % 7 > 0, k.cast("string")), title=F.when(k % 3 > 0, F.col("p_name")), creator=F.col("p_brand"), license=F.lit("by"), provider=F.lit(None).cast("string"), url=F.when(k % 5 > 0, F.concat(F.lit("https://h/"), k, F.lit(".PNG"))).otherwise(F.lit("")), foreign_landing_url=F.lit("p"), filetype=F.when(k % 2 == 0, F.lit("JPEG")), **more)


HITS = "FROM (SELECT *, p_partkey AS k FROM part) WHERE k % 7 > 0 AND k % 5 > 0"


@query("s13_images", f"SELECT CAST(k AS VARCHAR) AS id, CASE WHEN k % 3 > 0 THEN p_name ELSE 'Untitled' END AS title, p_brand AS creator, 'by' AS license, '' AS provider, 'https://h/'||k||'.PNG' AS img_url, 'https://h/'||k||'.PNG' AS thumb_url, 'p' AS page_url, CAST(p_size AS BIGINT) AS width, 0 AS height, CASE WHEN k % 2 = 0 THEN 'jpg' ELSE 'png' END AS ext {HITS}")
def s13(spark, d):
    t = parts(spark, d).select(body(results=F.array(hit(F.col("p_partkey"), thumbnail=F.lit(None).cast("string"), width=F.col("p_size"), height=F.lit(None).cast("int")))).alias("body"))
    return S.images(t)


@query("s14_sounds", f"SELECT CAST(k AS VARCHAR) AS id, CASE WHEN k % 3 > 0 THEN p_name ELSE 'Untitled' END AS title, p_type AS genres, k * 100 AS duration_ms, 44100 AS sample_rate, 0 AS bit_rate, CASE WHEN k % 2 = 0 THEN 'jpeg' ELSE 'mp3' END AS ext {HITS}")
def s14(spark, d):
    k = F.col("p_partkey")
    t = parts(spark, d).select(body(results=F.array(hit(k, genres=F.array("p_type", F.lit(None).cast("string")), duration=k * 100, sample_rate=F.lit(44_100), bit_rate=F.lit(None).cast("int")))).alias("body"))
    return S.sounds(t).select("id", "title", F.array_join("genres", "|").alias("genres"), "duration_ms", "sample_rate", "bit_rate", "ext")


@query("s15_icons", "SELECT 'set:'||replace(p_name, ' ', '-') AS id, p_name AS title, 'https://api/set/'||replace(p_name, ' ', '-')||'.svg?height=240&color=%23dcdcdc' AS download_url, 'https://icons/set/'||replace(p_name, ' ', '-')||'/' AS page_url, 'set' AS attribution FROM part")
def s15(spark, d):
    t = parts(spark, d).select(body(icons=F.array(F.concat(F.lit("set:"), F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit("noprefix"))).alias("body"))
    return S.icons(t, "https://api", "https://icons").select("id", "title", "download_url", "page_url", "attribution")


@query("s16_vectors", "SELECT p_partkey AS index, 'File:'||p_name||'.svg' AS id, p_name AS title, 'https://w/'||p_partkey AS download_url, 'CC0' AS license, 'A & '||p_brand AS attribution FROM part WHERE p_partkey % 3 > 0")
def s16(spark, d):
    k = F.col("p_partkey")
    info = obj(mime=F.when(k % 3 > 0, F.lit("image/svg+xml")).otherwise(F.lit("image/png")), url=F.concat(F.lit("https://w/"), k), descriptionurl=F.lit("d"), extmetadata=obj(LicenseShortName=obj(value=F.lit("CC0")), Artist=obj(value=F.concat(F.lit("<a href='x'>A  &</a> <b>"), "p_brand", F.lit("</b>")))))
    page = obj(index=k, title=F.concat(F.lit("File:"), "p_name", F.lit(".svg")), imageinfo=F.array(info))
    return S.vectors(parts(spark, d).select(body(query=obj(pages=F.create_map(k.cast("string"), page))).alias("body"))).select("index", "id", "title", "download_url", "license", "attribution")


@query("s17_assets3d", "SELECT 's'||p_partkey AS slug, CASE WHEN p_partkey % 4 > 0 THEN p_name ELSE 's'||p_partkey END AS name, p_type AS categories, 'amy|'||p_brand AS authors, CAST(p_size AS BIGINT) AS polycount, p_partkey AS downloads FROM part")
def s17(spark, d):
    k = F.col("p_partkey")
    a = obj(name=F.when(k % 4 > 0, F.col("p_name")), categories=F.array("p_type"), tags=F.lit(None).cast("array<string>"), authors=F.create_map("p_brand", F.lit("All"), F.lit("amy"), F.lit("Model")), polycount=F.col("p_size"), download_count=k, thumbnail_url=F.lit("t"))
    out = S.assets3d(parts(spark, d).select(F.to_json(F.create_map(F.concat(F.lit("s"), k), a)).alias("body")))
    listed = F.array_join(F.transform(F.array_sort(F.transform("authors", lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))), lambda x: x["v"]), "|")
    return out.select("slug", "name", F.array_join("categories", "|").alias("categories"), listed.alias("authors"), "polycount", "downloads")


def manifests(spark, d):
    k = F.col("p_partkey")
    leaf = lambda e: obj(url=F.concat(F.lit(f"u{e}/"), k), include=F.create_map(F.concat(F.lit("t/"), k, F.lit(".jpg")), obj(url=F.concat(F.lit("i/"), k))))
    return parts(spark, d).select(F.concat(F.lit("s"), k).alias("slug"), F.to_json(F.create_map(F.lit("gltf"), F.create_map(F.when(k % 2 == 0, F.lit("1k")).otherwise(F.lit("2k")), F.create_map(F.lit("gltf"), leaf(""))))).alias("body"))


@query("s18_bundle_files", "SELECT 's'||p_partkey AS slug, unnest(['s'||p_partkey||'.gltf', 't/'||p_partkey||'.jpg']) AS rel, unnest(['u/'||p_partkey, 'i/'||p_partkey]) AS url, unnest([true, false]) AS is_main FROM part WHERE p_partkey % 2 = 0")
def s18(spark, d):
    return S.bundle_files(manifests(spark, d), "gltf", "1k", "gltf")


@query("s19_texture_url", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a'||p_partkey WHEN 1 THEN 'b'||p_partkey END AS texture, 'tm' AS preview, 'h'||p_partkey AS hdr FROM part")
def s19(spark, d):
    k = F.col("p_partkey")
    leaf = lambda p: F.create_map(F.lit("1k"), obj(jpg=obj(url=F.concat(F.lit(p), k)), hdr=obj(url=F.concat(F.lit("h"), k))))
    ao = F.when(k % 3 == 2, F.create_map(F.lit("2k"), obj(jpg=obj(url=F.lit("z")), hdr=obj(url=F.lit("z"))))).otherwise(leaf("b"))
    b = F.when(k % 3 == 0, F.to_json(obj(Diffuse=leaf("a"), AO=ao, hdri=leaf("h"), tonemapped=obj(url=F.lit("tm"))))).otherwise(F.to_json(obj(AO=ao, hdri=leaf("h"), tonemapped=obj(url=F.lit("tm")))))
    t = parts(spark, d).select("p_partkey", b.alias("body"))
    return t.select("p_partkey", S.texture_url("1k").alias("texture"), S.hdri_preview_url().alias("preview"), S.hdri_hdr_url("1k").alias("hdr"))


@query("s20_fonts", "SELECT p_name AS family, p_type AS category, p_brand AS designers, CASE WHEN p_partkey % 2 = 0 THEN '400|700i' ELSE '' END AS weights, CASE WHEN p_partkey % 3 = 0 THEN 9223372036854775807 ELSE p_partkey END AS popularity, p_partkey % 4 = 0 AS is_variable FROM part")
def s20(spark, d):
    k = F.col("p_partkey")
    f = obj(family=F.col("p_name"), category=F.col("p_type"), designers=F.array("p_brand"), fonts=F.when(k % 2 == 0, F.create_map(F.lit("700i"), obj(w=F.lit(1)), F.lit("400"), obj(w=F.lit(2)))), subsets=F.array(F.lit("latin")), popularity=F.when(k % 3 > 0, k), axes=F.when(k % 4 == 0, F.array(obj(tag=F.lit("wght")))).otherwise(F.array().cast("array<struct<tag:string>>")))
    out = S.fonts(parts(spark, d).select(body(familyMetadataList=F.array(f)).alias("body")))
    return out.select("family", "category", F.array_join("designers", "|").alias("designers"), F.array_join("weights", "|").alias("weights"), "popularity", "is_variable")


@query("s21_font_url", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'https://f/'||p_partkey||'.ttf' END AS url FROM part")
def s21(spark, d):
    k = F.col("p_partkey")
    css = F.concat(F.lit("@font-face { src: url( '"), F.when(k % 3 == 0, F.lit("/rel/")).otherwise(F.lit("https://f/")), k, F.lit(".ttf' ) format('x') url(b)}"))
    return parts(spark, d).select("p_partkey", S.font_url(css).alias("url"))


@query("s22_palettes", "SELECT 'sl'||p_partkey AS slug, p_name AS title, CAST(p_partkey * 7919 % 16777216 // 65536 AS INTEGER) AS r, CASE WHEN p_partkey % 2 = 0 THEN '1,234' ELSE CAST(p_partkey AS VARCHAR) END AS downloads, CAST(p_size AS BIGINT) AS likes, 'https://pal/x.png' AS example FROM part WHERE p_partkey % 5 > 0")
def s22(spark, d):
    k = F.col("p_partkey")
    color = F.when(k % 5 > 0, F.lpad(F.hex(k * 7919 % 16777216), 6, "0")).otherwise(F.lit("zz"))
    head = F.concat(F.lit('{"palettes":[{"title":"'), "p_name", F.lit('","slug":"sl'), k, F.lit('","colors":["'), color, F.lit('","bad"],"downloads":'), F.when(k % 2 == 0, F.lit('"1,234"')).otherwise(k.cast("string")), F.lit(',"likes":'), "p_size", F.lit(',"examples":[{"image":"/x.png"}]}]}'))
    out = S.palettes(parts(spark, d).select(head.alias("body")), "https://pal")
    return out.select("slug", "title", F.col("colors")[0]["r"].alias("r"), "downloads", "likes", F.col("examples")[0].alias("example"))


# ---------------------------------------------------------------- palette files


def gpl_lines(spark, d):
    k = F.col("p_partkey")
    line = F.when(k % 9 == 0, F.lit("GIMP Palette")).when(k % 9 == 1, F.lit("# c")).when(k % 9 == 2, F.lit("  ")).when(k % 9 == 3, F.concat(k % 300, F.lit(" 1 x"))).otherwise(F.concat(F.lit(" "), k % 300, F.lit("\t"), k % 7, F.lit("  "), k % 256, F.lit(" name 5")))
    return parts(spark, d).select(F.col("p_brand").alias("file"), k.alias("no"), line.alias("line"))


GPL = "gpl AS (SELECT p_brand AS file, p_partkey AS no, p_partkey % 300 AS r, p_partkey % 7 AS g, p_partkey % 256 AS b FROM part WHERE p_partkey % 9 > 3 AND p_partkey % 300 < 256)"


@query("s23_gpl_rows", f"WITH {GPL} SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY no) - 1 AS INTEGER) AS idx, r, g, b FROM gpl")
def s23(spark, d):
    return Fi.gpl_rows(gpl_lines(spark, d))


@query("s24_palette_library", f"WITH {GPL}, n AS (SELECT file AS palette_id, row_number() OVER (PARTITION BY file ORDER BY no) - 1 AS idx, r, g, b FROM gpl) SELECT palette_id, CAST(idx AS INTEGER) AS idx, r, g, b, true AS builtin FROM n UNION ALL SELECT 'my '||palette_id, CAST(idx AS INTEGER), b, g, r, false FROM n WHERE idx < 5")
def s24(spark, d):
    p = Fi.gpl_rows(gpl_lines(spark, d)).withColumnRenamed("file", "palette_id")
    mine = p.where("idx < 5").select(F.concat(F.lit("my "), "palette_id").alias("palette_id"), "idx", F.col("b").alias("r"), "g", F.col("r").alias("b"))
    return Fi.palette_library(p, mine)


@query("s25_xterm256_use", "SELECT p_partkey, CAST((([0, 95, 135, 175, 215, 255])[1 + (p_partkey % 216) // 36]) AS INTEGER) AS r, CAST((([0, 95, 135, 175, 215, 255])[1 + (p_partkey % 216) // 6 % 6]) AS INTEGER) AS g, CAST((([0, 95, 135, 175, 215, 255])[1 + p_partkey % 6]) AS INTEGER) AS b FROM part")
def s25(spark, d):
    """Colours of the cube for the parts' numbers."""
    t = parts(spark, d).select("p_partkey", (16 + F.col("p_partkey") % 216).cast("int").alias("idx"))
    return t.join(Fi.xterm256(spark), "idx").select("p_partkey", "r", "g", "b")


# ---------------------------------------------------------------- web


def module_pages(spark, d):
    """Pages of five anchors each: names with entities, one without a name, one id twice."""
    k = F.col("p_partkey")
    a = lambda id_, name: F.concat(F.lit("<a href='dl.php?moduleid="), id_, F.lit(name), F.lit("'>x</a> "))
    html = F.concat(a(k * 10, "#a&amp;b.xm"), a(k * 10 + 1, ""), a(k * 10, "#again.mod"), a(k * 10 + 2, "#c.it"), a(k * 10 + 3, "#noext"))
    xml = F.concat(F.lit("<modarchive><module><id> "), k, F.lit("</id><filename>f&amp;"), k, F.lit(".xm</filename><songtitle>"), "p_name", F.lit("</songtitle><bytes>"), "p_size", F.lit("</bytes><genretext>"), "p_type", F.lit("</genretext></module><module><id>x</id></module></modarchive>"))
    return parts(spark, d).select(k.alias("page_id"), html.alias("html"), xml.alias("xml"))


@query("s26_modules_from_html", "SELECT p_partkey AS page_id, unnest([p_partkey * 10, p_partkey * 10 + 2]) AS id, unnest(['a', 'c.it']) AS filename FROM part WHERE false UNION ALL SELECT p_partkey, p_partkey * 10 + 2, 'c.it' FROM part UNION ALL SELECT p_partkey, p_partkey * 10, 'again.mod' FROM part")
def s26(spark, d):
    """A name ends at the first ampersand, so the first anchor has none with a dot."""
    return web.modules_from_html(module_pages(spark, d)).select("page_id", "id", "filename")


@query("s27_modules_from_xml", "SELECT p_partkey AS id, 'f&'||p_partkey||'.xm' AS filename, p_name AS title, '' AS artist, p_type AS genre, CAST(p_size AS BIGINT) AS bytes FROM part")
def s27(spark, d):
    return web.modules_from_xml(module_pages(spark, d)).select("id", "filename", "title", "artist", "genre", "bytes")


def index_pages(spark, d):
    """Directory indexes made of the parts of each size: one page per part with its file, a folder, and junk links."""
    k = F.col("p_partkey")
    html = F.concat(F.lit('<title>Index of /x</title><a href="?C=N">N</a> <a href="../">Parent</a> <a href="f'), k, F.lit('%20a.zip">f..&gt;</a> 2004-Sep-13 '), F.col("p_size"), F.lit('K <a href="d'), k, F.lit('/">d</a> - <a href="f'), k, F.lit(' a.zip">again</a> 9M <a href="https://off/x">o</a>'))
    return parts(spark, d).select(k.alias("page_id"), F.concat(F.lit("https://host/p"), k, F.lit("/")).alias("url"), html.alias("html"))


@query("s28_parse_listing", "SELECT p_partkey AS page_id, unnest(['f'||p_partkey||' a.zip', 'd'||p_partkey]) AS name, unnest([false, true]) AS is_dir, CAST(unnest([p_size * 1024, 0]) AS BIGINT) AS size FROM part")
def s28(spark, d):
    return web.parse_listing(index_pages(spark, d)).select("page_id", "name", "is_dir", "size")


PAGE = f"""u AS (SELECT page_id, pos, split_part(url, '://', 1) AS sch, {"split_part(split_part(url, '://', 2), '/', 1)"} AS host, url AS base, href FROM links),
t AS (SELECT page_id, pos, base, sch||'://'||host||split_part(href, '#', 1) AS target FROM u WHERE starts_with(href, '/') AND NOT starts_with(href, '//'))"""


@query("s29_page_links", f"WITH {base.LINKS}, {PAGE} SELECT page_id, target AS url, NOT (regexp_matches(lower(list_last(string_split(split_part(target, '?', 1), '/'))), '[.][a-z0-9]{{0,5}}$') AND NOT regexp_matches(lower(target), '[.](html|htm|php|asp|aspx|jsp|cgi|shtml)$')) AS is_dir FROM t WHERE rtrim(target, '/') <> rtrim(base, '/') GROUP BY 1, 2")
def s29(spark, d):
    return web.page_links(table(spark, d, "pages")).select("page_id", "url", "is_dir")


@query("s30_is_listing", "SELECT page_id, contains(lower(html), 'index of ') OR contains(lower(html), 'parent directory') OR contains(lower(html), '<title>directory listing') AS listing FROM pages UNION ALL SELECT -1 - p_partkey, true FROM part")
def s30(spark, d):
    own = index_pages(spark, d).select((-1 - F.col("page_id")).alias("page_id"), "html")
    return web.is_listing(table(spark, d, "pages").select("page_id", "html").unionByName(own))


@query("s31_page_entries", f"WITH {base.LINKS}, {PAGE} SELECT page_id, count(DISTINCT target) AS entries FROM t WHERE rtrim(target, '/') <> rtrim(base, '/') GROUP BY 1 UNION ALL SELECT -1 - p_partkey, 2 FROM part")
def s31(spark, d):
    own = index_pages(spark, d).withColumn("page_id", -1 - F.col("page_id"))
    return web.page_entries(table(spark, d, "pages").unionByName(own)).groupBy("page_id").agg(F.count("*").alias("entries"))


def robots_bodies(spark, d):
    k = F.col("s_suppkey")
    b = F.concat(F.lit("# hi\nUser-agent: other\nUser-Agent: "), F.when(k % 2 == 0, F.lit("*")).otherwise(F.lit("MyBot/2.0")), F.lit("\nDisallow: /a"), k, F.lit(" # x\nSitemap: s\nAllow: /b\nDisallow:\nCrawl-delay: "), k, F.lit("\nUser-agent: someone\nDisallow: /\nCrawl-delay: 3\n"))
    return table(spark, d, "supplier").select(F.concat(F.lit("https://h"), k).alias("origin"), b.alias("body"))


@query("s32_parse_robots", "SELECT 'https://h'||s_suppkey AS origin, unnest(['disallow', 'allow']) AS kind, unnest(['/a'||s_suppkey, '/b']) AS prefix, CAST(least(s_suppkey, 60) AS DOUBLE) AS seconds FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT 'https://h0', unnest(['disallow', 'allow']), unnest(['/a0', '/b']), NULL")
def s32(spark, d):
    rules, delays = web.parse_robots(robots_bodies(spark, d), "mybot")
    return rules.join(delays, "origin", "left")


# ---------------------------------------------------------------- manifests, games, videos


def manifests_vdf(spark, d):
    k = F.col("p_partkey")
    t = F.concat(F.lit('"AppState"\n{\n\t"appid"\t\t"'), F.when(k % 8 > 0, k.cast("string")).otherwise(F.lit("x")), F.lit('"\n  "name" "'), "p_name", F.lit('"\n"LastPlayed" "5"\n"SizeOnDisk" "'), "p_size", F.lit('"\n"path" "/l'), k, F.lit('"\n"path"\t"/m"\n}'))
    return parts(spark, d).select("p_partkey", t.alias("text"))


@query("s33_installed", "SELECT p_partkey AS appid, p_name AS name, 5 AS last_played, CAST(p_size AS BIGINT) AS size FROM part WHERE p_partkey % 8 > 0")
def s33(spark, d):
    return Fi.installed(manifests_vdf(spark, d))


@query("s34_library_paths", "SELECT unnest(['/l'||p_partkey, '/m']) AS path FROM part")
def s34(spark, d):
    return Fi.library_paths(manifests_vdf(spark, d))


@query("s35_owned", "SELECT p_partkey AS appid, p_name AS name, p_partkey * 2 AS playtime_min, 0 AS last_played FROM part WHERE p_partkey % 6 > 1")
def s35(spark, d):
    k = F.col("p_partkey")
    g = obj(appid=k, name=F.when(k % 6 == 0, F.lit("Proton 9")).when(k % 6 > 1, F.col("p_name")), playtime_forever=k * 2)
    return S.owned(parts(spark, d).select(body(response=obj(games=F.array(g))).alias("body")))


@query("s36_game_media", "SELECT p_partkey AS appid, unnest([0, 1]) AS section, unnest([CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Trailer' END, '']) AS name, unnest(['th', 'full']) AS thumb_url, unnest([CASE WHEN p_partkey % 3 = 0 THEN 'dash' ELSE 'hls' END, 'full']) AS open_url, unnest([true, false]) AS is_video FROM part")
def s36(spark, d):
    k = F.col("p_partkey")
    m = obj(name=F.when(k % 2 == 0, F.col("p_name")), thumbnail=F.lit("th"), hls_h264=F.when(k % 3 > 0, F.lit("hls")), dash_h264=F.lit("dash"))
    none = obj(name=F.lit("n"), thumbnail=F.lit("x"), hls_h264=F.lit(None).cast("string"), dash_h264=F.lit(None).cast("string"))
    data = obj(data=obj(name=F.col("p_name"), movies=F.array(none, m), screenshots=F.array(obj(path_full=F.lit("full")))))
    return S.game_media(parts(spark, d).select(k.alias("appid"), F.to_json(F.create_map(k.cast("string"), data)).alias("body"))).drop("k")


@query("s37_videos", "SELECT 'v'||p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'up' END AS channel, p_size * 1.5 AS duration, p_partkey AS views, CASE p_partkey % 3 WHEN 0 THEN 't2' WHEN 1 THEN 'one' ELSE 'https://i.ytimg.com/vi/v'||p_partkey||'/hqdefault.jpg' END AS thumb_url FROM part WHERE p_partkey % 9 > 0")
def s37(spark, d):
    k = F.col("p_partkey")
    thumbs = F.when(k % 3 == 0, F.array(obj(url=F.lit("t1")), obj(url=F.lit("t2")), obj(url=F.lit(None).cast("string"))))
    b = body(id=F.when(k % 9 > 0, F.concat(F.lit("v"), k)).otherwise(F.lit("")), title=F.col("p_name"), channel=F.when(k % 2 == 0, F.col("p_brand")).otherwise(F.lit("")), uploader=F.lit("up"), duration=F.col("p_size") * 1.5, view_count=k, thumbnail=F.when(k % 3 == 1, F.lit("one")), thumbnails=thumbs)
    return S.videos(parts(spark, d).select(b.alias("body"))).drop("channel_id")


@query("s38_playlists", "SELECT 'p'||p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '(playlist)' END AS title, CAST(p_size AS BIGINT) AS count, '' AS thumb_url FROM part")
def s38(spark, d):
    k = F.col("p_partkey")
    return S.playlists(parts(spark, d).select(body(id=F.concat(F.lit("p"), k), title=F.when(k % 2 == 0, F.col("p_name")), playlist_count=F.col("p_size")).alias("body")))


@query("s39_video_meta", "SELECT 'v'||p_partkey AS id, p_brand AS channel, p_partkey AS views, 0 AS likes, CAST(29.97 AS DOUBLE) AS fps, CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 5 ELSE p_partkey * 7 END AS filesize FROM part")
def s39(spark, d):
    k = F.col("p_partkey")
    b = body(id=F.concat(F.lit("v"), k), channel=F.lit(""), uploader=F.col("p_brand"), view_count=k, like_count=F.lit(None).cast("int"), fps=F.lit(29.97), filesize=F.when(k % 2 == 0, k * 5), filesize_approx=k * 7)
    return S.video_meta(parts(spark, d).select(b.alias("body"))).select("id", "channel", "views", "likes", "fps", "filesize")


@query("s40_comments", "SELECT p_partkey AS video_id, CAST(unnest([0, 1]) AS INTEGER) AS pos, unnest([p_name, p_brand]) AS text, unnest([3, 0]) AS likes FROM part")
def s40(spark, d):
    c = lambda t, parent, likes: obj(parent=F.lit(parent).cast("string"), author=F.lit("a"), text=t, like_count=F.lit(likes).cast("int"))
    listed = F.array(c(F.col("p_name"), "root", 3), c(F.lit("reply"), "c1", 1), c(F.col("p_brand"), None, None), c(F.lit("late"), "root", 2))
    return S.comments(parts(spark, d).select(F.col("p_partkey").alias("video_id"), body(comments=listed).alias("body")), 2).select("video_id", "pos", "text", "likes")


@query("s41_transcripts", "SELECT p_partkey, p_name||chr(10)||p_name||' '||p_brand||chr(10)||p_type AS transcript FROM part")
def s41(spark, d):
    vtt = F.concat_ws("\n", F.lit("WEBVTT"), F.lit("Kind: captions"), F.lit(""), F.lit("00:00.000 --> 00:01.000 align:start"), F.concat(F.lit("<c>"), "p_name", F.lit("</c> ")), F.col("p_name"), F.concat_ws(" ", "p_name", "p_brand"), F.col("p_brand"), F.lit("NOTE x"), F.concat(F.col("p_type"), F.lit("<b>")))
    return Fi.transcripts(parts(spark, d).select("p_partkey", vtt.alias("text"))).select("p_partkey", "transcript")


@query("s42_best_caption", "SELECT p_brand AS video_id, arg_min(n, r * 1000000 + p_partkey) AS name FROM (SELECT *, p_partkey||(['.de.vtt', '.en-orig.vtt', '.en-GB.vtt', '.en.srt'])[1 + p_partkey % 4] AS n, ([3, 1, 2, 9])[1 + p_partkey % 4] AS r FROM part) WHERE r < 9 GROUP BY p_brand")
def s42(spark, d):
    k = F.col("p_partkey")
    return Fi.best_caption(parts(spark, d).select(F.col("p_brand").alias("video_id"), F.concat(k, pick(k, ".de.vtt", ".en-orig.vtt", ".en-GB.vtt", ".en.srt")).alias("name"), k.alias("pos")))


@query("s43_file_status", "SELECT unnest(['/r/'||p_partkey||'/new', '/r/'||p_partkey||'/b c', '/r/'||p_partkey||'/u']) AS path, unnest(['modified', 'new', 'conflict']) AS status FROM part")
def s43(spark, d):
    b = F.concat_ws("\x00", F.lit("R  new"), F.lit("old name"), F.lit("?? b c"), F.lit("UU u"), F.lit(""))
    return Fi.file_status(parts(spark, d).select(F.concat(F.lit("/r/"), "p_partkey").alias("root"), b.alias("body"))).select("path", "status")


def trailers(spark, d):
    """Character art with a trailer: for some files a comment block, for some trailing blanks, for some no trailer."""
    k = F.col("p_partkey")
    pad = lambda x, n: F.rpad(x, n, " ")
    byte = lambda x: F.unhex(F.lpad(F.hex(x.cast("bigint")), 2, "0"))
    raw = lambda x: F.to_binary(x, F.lit("utf-8"))
    notes = F.when(k % 3 == 0, F.lit(2)).otherwise(F.lit(0))
    record = F.concat(raw(F.lit("SAUCE00")), raw(pad(F.col("p_name"), 35)), raw(pad(F.col("p_brand"), 20)), raw(pad(F.lit("grp"), 20)), raw(F.lit("19960504")), F.unhex(F.lit("00000000")), byte(F.lit(1)), byte(k % 9), byte(k % 200), byte(F.lit(1)), byte(F.lit(25)), byte(F.lit(0)), F.unhex(F.lit("00000000")), byte(notes), byte(k % 2), raw(pad(F.lit("VGA"), 22)))
    block = F.when(k % 3 == 0, F.concat(raw(F.lit("COMNT")), raw(pad(F.lit("line one"), 64)), raw(pad(F.col("p_type"), 64)))).otherwise(F.unhex(F.lit("")))
    content = F.concat(raw(F.concat(F.lit("art"), k)), F.unhex(F.lit("1A1A")), block, record, F.when(k % 2 == 0, F.unhex(F.lit("0D0A"))).otherwise(F.unhex(F.lit(""))))
    return spread(parts(spark, d)).select(k.alias("path"), F.when(k % 10 == 0, raw(F.lit("no trailer"))).otherwise(content).alias("content"))


@query("s44_sauce_scan", "SELECT p_partkey AS path, p_name AS title, p_brand AS author, '19960504' AS date, CAST(p_partkey % 9 AS INTEGER) AS file_type, CAST(p_partkey % 200 + 256 AS INTEGER) AS tinfo1, p_partkey % 2 = 1 AS ice, 'VGA' AS font, CASE WHEN p_partkey % 3 = 0 THEN 'line one '||p_type ELSE '' END AS comment FROM part WHERE p_partkey % 10 > 0")
def s44(spark, d):
    return Fi.sauce_scan(trailers(spark, d)).select("path", "title", "author", "date", "file_type", "tinfo1", "ice", "font", "comment")


@query("s45_sauce_strip", "SELECT p_partkey AS path, CASE WHEN p_partkey % 10 = 0 THEN 'no trailer' ELSE 'art'||p_partkey END AS content FROM part")
def s45(spark, d):
    return Fi.sauce_strip(trailers(spark, d)).withColumn("content", F.col("content").cast("string"))


@query("s46_sfz_opcodes", "SELECT p_partkey AS id, CAST(unnest(range(5)) AS INTEGER) AS pos, unnest(['<header>', 'key', '<header>', 'sample', 'volume']) AS opcode, unnest(['global', CAST(p_size AS VARCHAR), 'region', p_name||' '||p_brand||'.wav', '-3']) AS value FROM part")
def s46(spark, d):
    t = F.concat(F.lit("// c key=9\n<global> KEY="), "p_size", F.lit(" /* x=1\n y */\n<region>\n sample="), "p_name", F.lit("   "), "p_brand", F.lit(".wav volume=-3 // end"))
    return Fi.sfz_opcodes(parts(spark, d).select(F.col("p_partkey").alias("id"), t.alias("text")))


@query("s47_notebook_text", "SELECT p_partkey AS path, '# --- markdown ---'||chr(10)||'# '||p_name||chr(10)||'# two'||chr(10)||chr(10)||'# --- code ---'||chr(10)||p_brand||chr(10)||chr(10) AS text FROM part")
def s47(spark, d):
    cells = F.array(F.to_json(obj(cell_type=F.lit("markdown"), source=F.array(F.concat("p_name", F.lit("\n")), F.lit("two")))), F.to_json(obj(cell_type=F.lit("code"), source=F.col("p_brand"))))
    b = F.concat(F.lit('{"cells":['), F.array_join(cells, ","), F.lit("]}"))
    return S.notebook_text(parts(spark, d).select(F.col("p_partkey").alias("path"), b.alias("body")))


@query("s48_video_probe", "SELECT p_partkey AS path, CAST(p_size AS BIGINT) AS width, 'h264' AS vcodec, CASE WHEN p_partkey % 2 = 0 THEN 25.0 ELSE p_size / 2.0 END AS fps, CASE WHEN p_partkey % 3 = 0 THEN 9.5 ELSE p_size * 1.0 END AS duration, p_partkey % 4 = 0 AS has_audio FROM part")
def s48(spark, d):
    k = F.col("p_partkey")
    v = obj(codec_type=F.lit("video"), codec_name=F.lit("h264"), width=F.col("p_size"), avg_frame_rate=F.when(k % 2 == 0, F.lit("50/2")).otherwise(F.lit("0/0")), r_frame_rate=F.concat("p_size", F.lit("/2")), duration=F.when(k % 3 == 0, F.lit("9.5")))
    a = obj(codec_type=F.when(k % 4 == 0, F.lit("audio")).otherwise(F.lit("data")), codec_name=F.lit("aac"), width=F.lit(None).cast("int"), avg_frame_rate=F.lit("0/0"), r_frame_rate=F.lit("0/0"), duration=F.lit("1"))
    return S.video_probe(parts(spark, d).select(k.alias("path"), body(streams=F.array(a, v, v), format=obj(duration=F.col("p_size").cast("string"))).alias("body"))).select("path", "width", "vcodec", "fps", "duration", "has_audio")


@query("s49_decode_text", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'é'||doc_id END AS text, CASE WHEN doc_id % 2 = 0 THEN 'utf8' ELSE 'cp437' END AS encoding FROM documents")
def s49(spark, d):
    raw = F.when(F.col("doc_id") % 2 == 0, F.to_binary("text", F.lit("utf-8"))).otherwise(F.concat(F.unhex(F.lit("82")), F.to_binary(text("doc_id"), F.lit("utf-8"))))
    return Fi.decode_text(table(spark, d, "documents").select("doc_id", raw.alias("content"))).select("doc_id", "text", "encoding")


@query("s53_progress_log", "SELECT event_id, CAST(event_id % 1000 / 10.0 AS DOUBLE) AS pct, CASE WHEN event_id % 3 = 0 THEN '' ELSE '00:'||event_id END AS eta, '1MiB/s' AS speed FROM events WHERE event_id % 4 > 0")
def s53(spark, d):
    k = F.col("event_id")
    line = F.when(k % 4 == 0, F.lit("[info] PV|1|2|3")).otherwise(F.concat(F.lit("PV| "), (k % 1000 / 10).cast("string"), F.lit("%|"), F.when(k % 3 == 0, F.lit("Unknown ETA")).otherwise(F.concat(F.lit("00:"), k)), F.lit("| 1MiB/s ")))
    return Fi.progress_log(table(spark, d, "events").select("event_id", line.alias("line"))).drop("line")


@query("s54_list_items", "WITH l AS (SELECT p_brand AS list, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos, p_partkey AS id FROM part), m AS (SELECT coalesce(max(pos), 0) AS n FROM l WHERE list = 'Brand#2') SELECT id, CAST(pos AS INTEGER) AS pos FROM l WHERE list = 'Brand#2' UNION ALL SELECT s_suppkey, CAST(n + row_number() OVER (ORDER BY s_suppkey) AS INTEGER) FROM supplier, m")
def s54(spark, d):
    brands = numbered(parts(spark, d).select("p_brand", "p_partkey", "p_name"), ["p_brand"], ["p_partkey"])
    lists = brands.select(F.col("p_brand").alias("list"), F.col("_n").cast("int").alias("pos"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit("").alias("thumb_url"))
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.lit("").alias("thumb_url"), F.col("s_suppkey").alias("ord"))
    return Fi.list_items(Fi.append_item(lists, new, "Brand#2"), "Brand#2").select("id", "pos")


@query("s55_chapters", "SELECT p_partkey AS path, CAST(unnest([0, 1]) AS INTEGER) AS no, CAST(unnest([0, 3600 + p_size * 60 + 5]) AS INTEGER) AS seconds, unnest(['Intro', p_name]) AS title, unnest([p_brand||chr(10)||'more', '']) AS notes FROM part")
def s55(spark, d):
    t = F.concat_ws("\n", F.lit("Title line"), F.lit("0:00 Intro"), F.col("p_brand"), F.lit(""), F.lit("  more "), F.concat(F.lit("1:"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(":05 "), "p_name"))
    return Fi.chapters(parts(spark, d).select(F.col("p_partkey").alias("path"), t.alias("text")))


# ---------------------------------------------------------------- settings with comments


def settings(spark, d):
    """Settings of each size: tasks are its parts, in order; a part depends on two others of its size, by number, which makes
    cycles, on nothing, or on one by name; comments, links in texts, escapes and trailing commas are all over them."""
    p = numbered(parts(spark, d).select("p_partkey", "p_size", "p_name"), ["p_size"], ["p_partkey"])
    n = p.withColumn("k", F.col("_n") - 1).withColumn("n", F.count("*").over(Window.partitionBy("p_size")))  # a few dozen parts of a size
    t = lambda x: F.concat(F.lit('"t'), x, F.lit('"'))
    some = F.when(F.col("k") % 3 == 0, F.concat(F.lit("["), t((F.col("k") * 2 + 1) % F.col("n")), F.lit(", /* ,] */ "), t((F.col("k") * 5 + 3) % F.col("n")), F.lit(",]"))).when(F.col("k") % 3 == 1, t((F.col("k") + 1) % F.col("n"))).otherwise(F.lit("null"))
    task = F.concat(F.lit('{ "label": "t'), "k", F.lit('", // "label": "no"\n "detail": "https://x/y // \\"z\\" /* */", "dependsOn": '), some, F.lit(", }"))
    grouped = n.groupBy("p_size").agg(F.array_sort(F.collect_list(F.struct("k", task.alias("t")))).alias("l"), F.max_by("p_name", "k").alias("name"))
    body = F.concat(F.lit('/* settings */ { "env": { "TOOL": "/bin/'), "name", F.lit('", "N": 5, "URL": "http://h/a,}" , }, "tasks": [\n'), F.array_join(F.transform("l", lambda x: x["t"]), ",\n"), F.lit(",\n] } // end"))
    return grouped.select(F.col("p_size").alias("path"), body.alias("body"))


@query("s56_strip_comments", "SELECT p_size AS path, count(*) AS tasks, true AS valid FROM part GROUP BY p_size")
def s56(spark, d):
    """Without its comments a body is JSON."""
    clean = settings(spark, d).select("path", S.strip_comments("body").alias("body"))
    return clean.select("path", F.json_array_length(F.get_json_object("body", "$.tasks")).cast("bigint").alias("tasks"), F.try_parse_json("body").isNotNull().alias("valid"))


@query("s57_environment", "WITH l AS (SELECT p_size, arg_max(p_name, p_partkey) AS name FROM part GROUP BY p_size) SELECT p_size AS path, unnest(['TOOL', 'URL']) AS name, unnest(['/bin/'||name, 'http://h/a,}']) AS value FROM l")
def s57(spark, d):
    return S.environment(settings(spark, d))


@query(
    "g03_run_order",
    """WITH RECURSIVE p AS (SELECT p_size, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS k, count(*) OVER (PARTITION BY p_size) AS n FROM part),
dep AS (SELECT p_size, list(CASE k % 3 WHEN 0 THEN [(k * 2 + 1) % n, (k * 5 + 3) % n] WHEN 1 THEN [(k + 1) % n] ELSE CAST([] AS BIGINT[]) END ORDER BY k) AS d FROM p GROUP BY p_size),
w(p_size, i, stack, seen, done) AS (SELECT p_size, 0, [0::BIGINT], CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM dep
 UNION ALL SELECT p_size, i + 1,
  CASE WHEN top < 0 OR list_contains(seen, top) THEN rest ELSE list_concat(list_concat(rest, [-1 - top]), list_reverse(d[top + 1])) END,
  CASE WHEN top < 0 OR list_contains(seen, top) THEN seen ELSE list_append(seen, top) END, CASE WHEN top < 0 THEN list_append(done, -1 - top) ELSE done END
 FROM (SELECT w.*, dep.d, w.stack[len(w.stack)] AS top, w.stack[1:len(w.stack) - 1] AS rest FROM w JOIN dep ON dep.p_size = w.p_size WHERE len(w.stack) > 0))
SELECT p_size AS path, array_to_string(list_transform(arg_max(done, i), lambda x: 't'||x), ' ') AS labels FROM w GROUP BY p_size""",
)
def g03(spark, d):
    found = S.tasks(settings(spark, d))
    return found.select("path", F.array_join(G.run_order("tasks", F.lit("t0")), " ").alias("labels"))
