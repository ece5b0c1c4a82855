"""Stored response bodies of catalogue services as typed tables.

Every function takes a table with a ``body`` column of JSON text (and what identifies it). Schemas are explicit; a field that
is missing or of another type takes its default, and only a row without its identity is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.ordered import by_index
from ..operators.predicates import is_nongame


def _s(x: str | Column, default: str = "") -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(default))


def _n(x: str | Column, default: int = 0) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(default)).cast("bigint")


def _strings(x: str) -> Column:
    return F.coalesce(F.filter(x, lambda v: v.isNotNull()), F.array().cast("array<string>"))


def _json(df: DataFrame, schema: str, body: str = "body") -> DataFrame:
    return df.withColumn("_j", F.from_json(body, schema, {"mode": "PERMISSIVE"}))


# ---------------------------------------------------------------- art packs

SAUCE = "STRUCT<Title:STRING,Author:STRING,Group:STRING,Date:STRING,Datatype:BIGINT,Filetype:BIGINT,Tinfo1:BIGINT,Tinfo2:BIGINT,Tflags:BIGINT,Tinfos:STRING,Comments:STRING,Filesize:BIGINT,f:STRUCT<ice:BIGINT>>"


def sauce_struct(s: Column) -> Column:
    """Trailer record of a parsed JSON object; null when title, author, group and date are all blank."""

    def txt(name: str) -> Column:
        return F.btrim(F.coalesce(s[name], F.lit("")))

    names = ("title", "Title"), ("author", "Author"), ("group", "Group"), ("date", "Date")
    blank = F.concat(*(txt(j) for _, j in names)) == ""
    ice = (F.coalesce(s["f"]["ice"], F.lit(0)) != 0) | (F.coalesce(s["Tflags"], F.lit(0)).bitwiseAND(F.lit(1)) != 0)
    numbers = (("data_type", "Datatype"), ("file_type", "Filetype"), ("tinfo1", "Tinfo1"), ("tinfo2", "Tinfo2"))
    out = F.struct(*(txt(j).alias(n) for n, j in names), *(F.coalesce(s[j], F.lit(0)).cast("int").alias(n) for n, j in numbers), ice.alias("ice"), txt("Tinfos").alias("font"), txt("Comments").alias("comment"))
    return F.when(s.isNull() | blank, F.lit(None)).otherwise(out)


def pieces_from_artist(df: DataFrame, site: str, artist: str = "artist") -> DataFrame:
    file_ = f"STRUCT<file:STRING,raw:STRING,tn:STRING,sauce:{SAUCE}>"
    rows = _json(df, f"STRUCT<results:MAP<STRING,MAP<STRING,STRUCT<`group`:STRING,files:ARRAY<{file_}>>>>>")
    rows = rows.select(artist, F.explode("_j.results").alias("year", "packs")).select(artist, "year", F.explode("packs").alias("pack", "info"))
    rows = rows.select(artist, "year", "pack", _s("info.group").alias("grp"), F.explode("info.files").alias("f")).where("f.file IS NOT NULL")
    return rows.select(
        F.col("f.file").alias("filename"), F.col(artist).alias("artist"), "grp", F.coalesce(F.col("year").try_cast("int"), F.lit(0)).alias("year"), "pack",
        X.abs_url("f.raw", site).alias("raw_url"), X.abs_url(X.x1_url("f.tn"), site).alias("thumb_url"), _n("f.sauce.Filesize").alias("filesize"), sauce_struct(F.col("f.sauce")).alias("sauce"),
    )


def pieces_from_pack(df: DataFrame, site: str, group: str = "grp", year_hint: str = "year_hint", pack: str = "pack") -> DataFrame:
    file_ = f"STRUCT<file:STRUCT<raw:STRING,tn:STRUCT<uri:STRING>>,artists:ARRAY<STRING>,sauce:{SAUCE}>"
    rows = _json(df, f"STRUCT<results:ARRAY<STRUCT<year:INT,files:MAP<STRING,{file_}>>>>")
    rows = rows.select(group, year_hint, pack, F.explode("_j.results").alias("r")).select(group, pack, F.coalesce("r.year", year_hint).alias("year"), F.explode("r.files").alias("filename", "f"))
    return rows.select(
        "filename", F.array_join(_strings("f.artists"), ", ").alias("artist"), F.col(group).alias("grp"), "year", F.col(pack).alias("pack"),
        F.concat(F.lit(f"{site}/pack/"), X.pct_encode(pack), F.lit("/raw/"), X.pct_encode("filename")).alias("raw_url"),
        X.abs_url(X.x1_url("f.file.tn.uri"), site).alias("thumb_url"), _n("f.sauce.Filesize").alias("filesize"), sauce_struct(F.col("f.sauce")).alias("sauce"),
    )


def packs(df: DataFrame, site: str, year: str = "year") -> DataFrame:
    """Packs of all pages of a year; a name may be a number in the body, links may be relative."""
    rows = _json(df, "STRUCT<results:ARRAY<STRUCT<name:STRING,archive:STRING>>>").select(year, F.explode("_j.results").alias("p")).where("p.name IS NOT NULL AND p.archive IS NOT NULL")
    url = F.when(F.startswith("p.archive", F.lit("http")), F.col("p.archive")).otherwise(F.concat(F.lit(site), "p.archive"))
    return rows.select(year, F.col("p.name").alias("name"), url.alias("url")).orderBy(year, F.lower("name"), "name")


def write_packs(df: DataFrame, path: str) -> None:
    """Replaces the years that df holds and leaves the others as they are."""
    df.repartition("year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def read_packs(spark, path: str, year: int | None = None) -> DataFrame:
    df = spark.read.schema("name STRING, url STRING, year INT").parquet(path)
    return df if year is None else df.where(F.col("year") == year)


def group_names(df: DataFrame) -> DataFrame:
    rows = _json(df, "STRUCT<results:ARRAY<MAP<STRING,STRING>>>").select(F.explode("_j.results").alias("o"))
    return rows.select(F.explode(F.map_keys("o")).alias("name")).distinct()


def artist_names(df: DataFrame) -> DataFrame:
    rows = _json(df, "STRUCT<results:ARRAY<STRUCT<artist:STRUCT<name:STRING>>>>").select(F.explode("_j.results.artist.name").alias("name"))
    return rows.where("name IS NOT NULL").distinct()


def group_pack_refs(df: DataFrame, group: str = "grp") -> DataFrame:
    """(group, year, pack, pos) of a group's packs, newest year first by its text."""
    rows = _json(df, "STRUCT<results:STRUCT<packs:MAP<STRING,ARRAY<STRING>>>>").select(group, F.explode("_j.results.packs").alias("y", "list"))
    rows = rows.select(group, "y", F.posexplode("list").alias("pos", "pack")).where("pack IS NOT NULL").orderBy(group, F.desc("y"), "pos")
    return rows.select(group, F.coalesce(F.col("y").try_cast("int"), F.lit(0)).alias("year"), "pack", "pos")


def latest_releases(df: DataFrame, site: str) -> DataFrame:
    rows = _json(df, "STRUCT<results:ARRAY<STRUCT<pack:STRING,download:STRING>>>").select(F.posexplode("_j.results").alias("pos", "p")).where("p.pack IS NOT NULL AND p.download IS NOT NULL")
    url = F.when(F.startswith("p.download", F.lit("http")), F.col("p.download")).otherwise(F.concat(F.lit(site), "p.download"))
    return rows.select("pos", F.col("p.pack").alias("name"), url.alias("url"))


# ---------------------------------------------------------------- searches

_HIT = "id:STRING,title:STRING,creator:STRING,license:STRING,provider:STRING,url:STRING,foreign_landing_url:STRING,filetype:STRING"


def _hits(df: DataFrame, more: str) -> DataFrame:
    rows = _json(df, f"STRUCT<results:ARRAY<STRUCT<{_HIT},{more}>>>").select(F.explode("_j.results").alias("r")).select("r.*")
    return rows.where("id IS NOT NULL AND url IS NOT NULL AND url <> ''")


_COMMON = ("creator", "license", "provider")


def images(df: DataFrame) -> DataFrame:
    rows = _hits(df, "thumbnail:STRING,width:BIGINT,height:BIGINT")
    return rows.select("id", _s("title", "Untitled").alias("title"), *(_s(c).alias(c) for c in _COMMON), F.col("url").alias("img_url"), F.coalesce("thumbnail", "url").alias("thumb_url"), _s("foreign_landing_url").alias("page_url"), _n("width").alias("width"), _n("height").alias("height"), X.infer_ext("filetype", "url").alias("ext"))


def sounds(df: DataFrame) -> DataFrame:
    rows = _hits(df, "genres:ARRAY<STRING>,duration:BIGINT,sample_rate:BIGINT,bit_rate:BIGINT")
    return rows.select("id", _s("title", "Untitled").alias("title"), *(_s(c).alias(c) for c in _COMMON), "url", _s("foreign_landing_url").alias("page_url"), _strings("genres").alias("genres"), _n("duration").alias("duration_ms"), _n("sample_rate").alias("sample_rate"), _n("bit_rate").alias("bit_rate"), X.infer_sound_ext("filetype", "url").alias("ext"))


def icons(df: DataFrame, api: str, site: str) -> DataFrame:
    rows = _json(df, "STRUCT<icons:ARRAY<STRING>>").select(F.posexplode("_j.icons").alias("pos", "id")).where(F.contains("id", F.lit(":")))
    prefix, name = X.before("id", ":"), X.after("id", ":")
    url = F.concat(F.lit(f"{api}/"), prefix, F.lit("/"), name, F.lit(".svg?height=240&color=%23dcdcdc"))
    return rows.select("pos", "id", F.replace(name, F.lit("-"), F.lit(" ")).alias("title"), url.alias("thumb_url"), url.alias("download_url"), F.concat(F.lit(f"{site}/"), prefix, F.lit("/"), name, F.lit("/")).alias("page_url"), F.lit("").alias("license"), prefix.alias("attribution"))


def vectors(df: DataFrame) -> DataFrame:
    info = "STRUCT<mime:STRING,url:STRING,descriptionurl:STRING,extmetadata:STRUCT<LicenseShortName:STRUCT<value:STRING>,Artist:STRUCT<value:STRING>>>"
    rows = _json(df, f"STRUCT<query:STRUCT<pages:MAP<STRING,STRUCT<`index`:BIGINT,title:STRING,imageinfo:ARRAY<{info}>>>>>").select(F.explode("_j.query.pages").alias("k", "p"))
    rows = rows.select("p.index", _s("p.title", "Untitled").alias("id"), F.try_element_at("p.imageinfo", F.lit(1)).alias("i")).where("i.mime = 'image/svg+xml' AND i.url IS NOT NULL")
    title = F.regexp_replace(F.regexp_replace("id", "^File:", ""), r"\.svg$", "")
    return by_index(rows.select("index", "id", title.alias("title"), F.col("i.url").alias("thumb_url"), F.col("i.url").alias("download_url"), _s("i.descriptionurl").alias("page_url"), _s("i.extmetadata.LicenseShortName.value").alias("license"), X.strip_html("i.extmetadata.Artist.value").alias("attribution")))


# ---------------------------------------------------------------- 3D assets, fonts, palettes


def assets3d(df: DataFrame) -> DataFrame:
    """Assets keyed by slug; authors are the keys of an object. Most downloaded first."""
    asset = "STRUCT<name:STRING,categories:ARRAY<STRING>,tags:ARRAY<STRING>,authors:MAP<STRING,STRING>,polycount:BIGINT,download_count:BIGINT,thumbnail_url:STRING>"
    rows = _json(df, f"MAP<STRING,{asset}>").select(F.explode("_j").alias("slug", "a"))
    authors = F.coalesce(F.array_sort(F.map_keys("a.authors")), F.array().cast("array<string>"))
    out = rows.select("slug", F.coalesce("a.name", "slug").alias("name"), _strings("a.categories").alias("categories"), _strings("a.tags").alias("tags"), authors.alias("authors"), _n("a.polycount").alias("polycount"), _n("a.download_count").alias("downloads"), _s("a.thumbnail_url").alias("thumb_url"))
    return out.orderBy(F.desc("downloads"), "name")


def bundle_files(df: DataFrame, section: str, res: str, fmt: str, slug: str = "slug") -> DataFrame:
    """(slug, rel, url, is_main): the main file of a manifest's leaf and the files it includes."""
    leaf = "STRUCT<url:STRING,include:MAP<STRING,STRUCT<url:STRING>>>"
    node = F.try_element_at(F.try_element_at(F.try_element_at(F.col("_j"), F.lit(section)), F.lit(res)), F.lit(fmt))
    rows = _json(df, f"MAP<STRING,MAP<STRING,MAP<STRING,{leaf}>>>").select(slug, node.alias("n")).where("n.url IS NOT NULL")
    main = rows.select(slug, F.concat(slug, F.lit(f".{fmt}")).alias("rel"), F.col("n.url").alias("url"), F.lit(True).alias("is_main"))
    others = rows.select(slug, F.explode("n.include").alias("rel", "f")).select(slug, "rel", F.col("f.url").alias("url"), F.lit(False).alias("is_main")).where("url IS NOT NULL")
    return main.unionByName(others)


#: Keys of a texture's main map, in order of preference.
TEXTURE_KEYS = ("Diffuse", "diffuse", "AO", "arm")


def texture_url(res: str, body: str = "body") -> Column:
    return F.coalesce(*(F.get_json_object(body, f"$.{k}.{res}.jpg.url") for k in TEXTURE_KEYS))


def hdri_preview_url(body: str = "body") -> Column:
    return F.get_json_object(body, "$.tonemapped.url")


def hdri_hdr_url(res: str, body: str = "body") -> Column:
    return F.get_json_object(body, f"$.hdri.{res}.hdr.url")


def fonts(df: DataFrame) -> DataFrame:
    family = "STRUCT<family:STRING,category:STRING,designers:ARRAY<STRING>,fonts:MAP<STRING,STRING>,subsets:ARRAY<STRING>,popularity:BIGINT,axes:ARRAY<STRING>>"
    rows = _json(df, f"STRUCT<familyMetadataList:ARRAY<{family}>>").select(F.explode("_j.familyMetadataList").alias("f")).select("f.*").where("family IS NOT NULL")
    weights = F.coalesce(F.array_sort(F.map_keys("fonts")), F.array().cast("array<string>"))
    return rows.select("family", _s("category").alias("category"), _strings("designers").alias("designers"), weights.alias("weights"), _strings("subsets").alias("subsets"), _n("popularity", 2**63 - 1).alias("popularity"), F.coalesce(F.size("axes") > 0, F.lit(False)).alias("is_variable"))


def font_url(css: str | Column) -> Column:
    """The first URL in CSS text; null when it isn't absolute."""
    url = F.regexp_replace(F.btrim(F.regexp_extract(css, r"url\(([^)]*)\)", 1)), "^[\"']+|[\"']+$", "")
    return F.when(F.startswith(url, F.lit("http")), url)


def palettes(df: DataFrame, site: str) -> DataFrame:
    palette = "STRUCT<title:STRING,slug:STRING,colors:ARRAY<STRING>,description:STRING,downloads:STRING,likes:BIGINT,tags:ARRAY<STRING>,examples:ARRAY<STRUCT<image:STRING>>>"
    rows = _json(df, f"STRUCT<palettes:ARRAY<{palette}>>").select(F.explode("_j.palettes").alias("p")).select("p.*").where("slug IS NOT NULL")
    rows = rows.withColumn("colors", F.filter(F.transform("colors", X.parse_hex), lambda c: c.isNotNull())).where(F.size("colors") > 0)
    examples = F.transform(F.filter("examples.image", lambda x: x.isNotNull()), lambda x: F.concat(F.lit(f"{site}/"), F.regexp_replace(x, "^/+", "")))
    return rows.select(_s("title", "Untitled").alias("title"), "slug", "colors", _s("description").alias("description"), _s("downloads").alias("downloads"), _n("likes").alias("likes"), _strings("tags").alias("tags"), F.coalesce(examples, F.array().cast("array<string>")).alias("examples"))


# ---------------------------------------------------------------- games and videos


def owned(df: DataFrame) -> DataFrame:
    game = "STRUCT<appid:BIGINT,name:STRING,playtime_forever:BIGINT,rtime_last_played:BIGINT>"
    rows = _json(df, f"STRUCT<response:STRUCT<games:ARRAY<{game}>>>").select(F.explode("_j.response.games").alias("g")).select("g.*")
    rows = rows.where(F.col("appid").isNotNull() & (_s("name") != "") & ~is_nongame("name"))
    return rows.select("appid", "name", _n("playtime_forever").alias("playtime_min"), _n("rtime_last_played").alias("last_played")).orderBy(F.lower("name"), "name", "appid")


def game_media(df: DataFrame, appid: str = "appid") -> DataFrame:
    """(appid, pos, is_video, name, thumb_url, open_url): trailers in order, then screenshots."""
    movie = "STRUCT<name:STRING,thumbnail:STRING,hls_h264:STRING,dash_h264:STRING>"
    data = f"STRUCT<data:STRUCT<name:STRING,short_description:STRING,genres:ARRAY<STRUCT<description:STRING>>,movies:ARRAY<{movie}>,screenshots:ARRAY<STRUCT<path_full:STRING,path_thumbnail:STRING>>>>"
    rows = _json(df, f"MAP<STRING,{data}>").select(appid, F.try_element_at("_j", F.col(appid).cast("string")).alias("d"))
    films = rows.select(appid, F.posexplode("d.data.movies").alias("k", "m")).withColumn("open_url", F.coalesce("m.hls_h264", "m.dash_h264")).where("open_url IS NOT NULL")
    films = films.select(appid, F.lit(0).alias("section"), "k", F.lit(True).alias("is_video"), _s("m.name", "Trailer").alias("name"), _s("m.thumbnail").alias("thumb_url"), "open_url")
    shots = rows.select(appid, F.posexplode("d.data.screenshots").alias("k", "s")).where("s.path_full IS NOT NULL")
    shots = shots.select(appid, F.lit(1).alias("section"), "k", F.lit(False).alias("is_video"), F.lit("").alias("name"), F.coalesce("s.path_thumbnail", "s.path_full").alias("thumb_url"), F.col("s.path_full").alias("open_url"))
    return films.unionByName(shots)


_THUMBS = "thumbnails:ARRAY<STRUCT<url:STRING>>"


def _last_thumb() -> Column:
    return F.try_element_at(F.filter("_j.thumbnails.url", lambda x: x.isNotNull()), F.lit(-1))


def videos(lines: DataFrame, thumb: str = "https://i.ytimg.com/vi/{id}/hqdefault.jpg") -> DataFrame:
    """One video per line of JSON."""
    rows = _json(lines, f"STRUCT<id:STRING,title:STRING,channel:STRING,uploader:STRING,channel_id:STRING,uploader_id:STRING,duration:DOUBLE,view_count:BIGINT,thumbnail:STRING,{_THUMBS}>").where("_j.id <> ''")
    return rows.select(F.col("_j.id").alias("id"), _s("_j.title").alias("title"), X.first_nonempty(["_j.channel", "_j.uploader"]).alias("channel"), X.first_nonempty(["_j.channel_id", "_j.uploader_id"]).alias("channel_id"), F.coalesce("_j.duration", F.lit(0.0)).alias("duration"), _n("_j.view_count").alias("views"), F.coalesce(_last_thumb(), F.col("_j.thumbnail"), X.url_from(thumb.replace("{id}", "{id:raw}"), id="_j.id")).alias("thumb_url"))


def playlists(lines: DataFrame) -> DataFrame:
    rows = _json(lines, f"STRUCT<id:STRING,title:STRING,playlist_count:BIGINT,{_THUMBS}>").where("_j.id <> ''")
    return rows.select(F.col("_j.id").alias("id"), _s("_j.title", "(playlist)").alias("title"), _n("_j.playlist_count").alias("count"), F.coalesce(_last_thumb(), F.lit("")).alias("thumb_url"))


def video_meta(df: DataFrame) -> DataFrame:
    texts = ("id", "title", "channel", "uploader", "channel_url", "uploader_url", "upload_date", "ext", "description")
    numbers = ("view_count", "like_count", "comment_count", "width", "height", "filesize", "filesize_approx")
    rows = _json(df, "STRUCT<" + ",".join([f"{c}:STRING" for c in texts] + [f"{c}:BIGINT" for c in numbers] + ["fps:DOUBLE"]) + ">").where("_j IS NOT NULL").select("_j.*")
    return rows.select(
        _s("id").alias("id"), _s("title").alias("title"), X.first_nonempty(["channel", "uploader"]).alias("channel"), X.first_nonempty(["channel_url", "uploader_url"]).alias("channel_url"), _s("upload_date").alias("upload_date"),
        _n("view_count").alias("views"), _n("like_count").alias("likes"), _n("comment_count").alias("comments"), _n("width").alias("width"), _n("height").alias("height"), F.coalesce("fps", F.lit(0.0)).alias("fps"), _s("ext").alias("ext"), _n(F.coalesce("filesize", "filesize_approx")).alias("filesize"), _s("description").alias("description"),
    )


def comments(df: DataFrame, n: int, video: str = "video_id") -> DataFrame:
    """The first n top-level comments of each body. The list is cut inside its row, so nothing is shuffled."""
    rows = _json(df, "STRUCT<comments:ARRAY<STRUCT<parent:STRING,author:STRING,text:STRING,like_count:BIGINT>>>")
    top = F.filter("_j.comments", lambda c: F.coalesce(c["parent"], F.lit("root")) == "root")
    rows = rows.select(video, F.posexplode(F.slice(top, 1, n)).alias("pos", "c"))
    return rows.select(video, "pos", _s("c.author").alias("author"), _s("c.text").alias("text"), _n("c.like_count").alias("likes"))


def video_probe(df: DataFrame, path: str = "path") -> DataFrame:
    """First video stream, whether there is sound, rate, and the duration of the stream or else of the container."""
    stream = "STRUCT<codec_type:STRING,codec_name:STRING,width:BIGINT,height:BIGINT,avg_frame_rate:STRING,r_frame_rate:STRING,duration:STRING>"
    rows = _json(df, f"STRUCT<streams:ARRAY<{stream}>,format:STRUCT<duration:STRING>>")
    rows = rows.select(path, "_j", F.try_element_at(F.filter("_j.streams", lambda s: s["codec_type"] == "video"), F.lit(1)).alias("v")).where("v IS NOT NULL")
    fps = X.parse_fraction("v.avg_frame_rate")
    own = F.coalesce(F.col("v.duration").try_cast("double"), F.lit(0.0))
    whole = F.coalesce(F.col("_j.format.duration").try_cast("double"), own)
    return rows.select(path, _n("v.width").alias("width"), _n("v.height").alias("height"), _s("v.codec_name").alias("vcodec"), F.when(fps > 0, fps).otherwise(F.when(F.col("v.r_frame_rate").isNotNull(), X.parse_fraction("v.r_frame_rate")).otherwise(fps)).alias("fps"), F.when(own > 0, own).otherwise(whole).alias("duration"), F.exists("_j.streams", lambda s: s["codec_type"] == "audio").alias("has_audio"))


def notebook_text(df: DataFrame, path: str = "path") -> DataFrame:
    """Cells of a notebook as readable text; a cell's source is a text or a list of texts."""
    rows = _json(df, "STRUCT<cells:ARRAY<STRUCT<cell_type:STRING,source:STRING>>>").where("_j.cells IS NOT NULL")
    listed = lambda c: F.from_json(c["source"], "ARRAY<STRING>")
    source = lambda c: F.coalesce(F.when(F.startswith(c["source"], F.lit("[")), F.array_join(listed(c), "")), c["source"], F.lit(""))

    def text(c: Column) -> Column:
        src = source(c)
        body = F.regexp_replace(src, r"\n\z", "")
        noted = F.when(src == "", F.lit("")).otherwise(F.concat(F.array_join(F.transform(F.split(body, "\n"), lambda x: F.concat(F.lit("# "), x)), "\n"), F.lit("\n")))
        code = F.concat(src, F.when(F.endswith(src, F.lit("\n")), F.lit("")).otherwise(F.lit("\n")))
        return F.concat(F.when(c["cell_type"] == "markdown", F.concat(F.lit("# --- markdown ---\n"), noted)).otherwise(F.concat(F.lit("# --- code ---\n"), code)), F.lit("\n"))

    return rows.select(path, F.array_join(F.transform("_j.cells", text), "").alias("text"))


# ---------------------------------------------------------------- settings with comments

#: Strings, which stay; comments of a line and of a block, which may be open to the end; commas before a closer.
_JSONC = r'("[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"?+)|//[^\n]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/)?|,(?=\s*[}\]])'


def strip_comments(body: str | Column) -> Column:
    """JSON text without its comments and trailing commas; what looks like one inside a string stays. One pass of one pattern,
    whose parts never step back, so that a long text takes time in proportion."""
    return F.regexp_replace(body, F.lit(_JSONC), F.lit("$1"))


def environment(df: DataFrame, key: str = "path", body: str = "body") -> DataFrame:
    """(key, name, value) of the ``env`` object of settings bodies; values that aren't texts are left out, and a broken body
    gives nothing."""
    env = F.from_json(strip_comments(body), "STRUCT<env:MAP<STRING,VARIANT>>")["env"]
    rows = df.select(key, F.explode(env).alias("name", "v"))
    return rows.where(F.schema_of_variant("v") == "STRING").select(key, "name", F.variant_get("v", "$", "string").alias("value"))


def tasks(df: DataFrame, key: str = "path", body: str = "body") -> DataFrame:
    """(key, tasks): the tasks of settings bodies in order, as (label, depends_on); what a task depends on is one text or a
    list of them, and a task without a label is left out."""
    found = F.from_json(strip_comments(body), "STRUCT<tasks:ARRAY<STRUCT<label:STRING,dependsOn:VARIANT>>>")["tasks"]

    def labels(v: Column) -> Column:
        one = F.try_variant_get(v, "$", "array<string>")
        return F.when(v.isNull(), F.array().cast("array<string>")).when(F.schema_of_variant(v) == "STRING", F.array(F.try_variant_get(v, "$", "string"))).otherwise(F.coalesce(one, F.array().cast("array<string>")))

    rows = F.transform(F.filter(found, lambda t: t["label"].isNotNull()), lambda t: F.struct(t["label"].alias("label"), labels(t["dependsOn"]).alias("depends_on")))
    return df.select(key, F.coalesce(rows, F.array().cast("array<struct<label:string,depends_on:array<string>>>")).alias("tasks"))
