"""Stored web pages and crawl rules as typed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.ordered import dedup_first, robots_groups

# ---------------------------------------------------------------- module searches


def modules_from_html(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, pos, id, filename): anchors ``moduleid=<id>#<file name>`` in order; the first of equal ids of a page stays."""
    pattern = r"moduleid=([0-9]+)(?:#([^\"'&<\x20]*))?"
    ids, names = (F.regexp_extract_all(html, F.lit(pattern), k) for k in (1, 2))
    rows = pages.select(key, F.posexplode(F.arrays_zip(ids.alias("id"), names.alias("f"))).alias("pos", "m"))
    rows = rows.select(key, "pos", F.col("m.id").try_cast("bigint").alias("id"), X.unescape("m.f", X.MODULE_ENTITIES).alias("filename"))
    return dedup_first(rows.where(F.col("id").isNotNull() & F.contains("filename", F.lit("."))), [key, "id"], ["pos"])


def _tag(block: str | Column, name: str) -> Column:
    return F.regexp_extract(block, f"(?s)<{name}>(.*?)</{name}>", 1)


def modules_from_xml(df: DataFrame, key: str = "page_id", xml: str = "xml") -> DataFrame:
    """(page_id, pos, id, filename, title, artist, genre, bytes); a module without a number is dropped."""
    blocks = F.regexp_extract_all(xml, F.lit("(?s)<module>(.*?)(?:</module>|$)"), 1)
    rows = df.select(key, F.posexplode(blocks).alias("pos", "b"))
    text = lambda n: X.unescape(_tag("b", n), X.MODULE_ENTITIES)
    number = lambda n: F.btrim(_tag("b", n), F.lit(" \t\r\n")).try_cast("bigint")
    return rows.select(key, "pos", number("id").alias("id"), text("filename").alias("filename"), text("songtitle").alias("title"), text("alias").alias("artist"), text("genretext").alias("genre"), F.coalesce(number("bytes"), F.lit(0)).alias("bytes")).where("id IS NOT NULL")


def xml_error(xml: str | Column) -> Column:
    """The message of an error document; null for others."""
    x = F.col(xml) if isinstance(xml, str) else xml
    return F.when(x.rlike("(?s)<error>.*</error>"), X.unescape(F.btrim(_tag(x, "error")), X.MODULE_ENTITIES))


# ---------------------------------------------------------------- listings and links


def _chunked(pages: DataFrame, html: str) -> DataFrame:
    """pages with ``_chunks``: the text cut at its anchors, once; the first one comes before them."""
    return pages.withColumn("_chunks", F.split(html, "<a "))


def _href(chunk: Column) -> Column:
    return F.regexp_extract(chunk, '(?s)^.*?href="([^"]*)"', 1)


def _elsewhere(href: Column) -> Column:
    """Whether a target is no entry of the directory."""
    return href.isin("", "/", "../", "..", "./", ".") | href.rlike(r"^[?#/]|://|^mailto:")


def _entry_name(href: Column) -> Column:
    return X.pct_decode(F.regexp_replace(X.unescape(href), "/+$", ""))


def _is_entry(name: Column) -> Column:
    return (name != "") & ~F.contains(name, F.lit("/")) & (F.lower(name) != "parent directory")


def _entry_size(chunk: Column, is_dir: Column) -> Column:
    tail = F.coalesce(X.after(chunk, "</a>"), F.regexp_extract(chunk, '(?s)href="[^"]*(".*)$', 1))
    sizes = F.filter(F.transform(F.split(F.btrim(X.strip_tags(tail), F.lit(" \t\r\n")), r"\s+"), X.parse_size), lambda s: s.isNotNull())
    return F.when(is_dir, F.lit(0)).otherwise(F.coalesce(F.try_element_at(sizes, F.lit(-1)), F.lit(0))).cast("bigint")


def _entries(chunks: Column) -> Column:
    """The index entries of anchors' chunks as (name, pos, is_dir, size), in steps, each over what the one before it left."""
    found = F.filter(F.transform(chunks, lambda c, i: F.struct(_href(c).alias("h"), i.alias("pos"), c.alias("c"))), lambda x: ~_elsewhere(x["h"]))
    found = F.transform(found, lambda x: F.struct(_entry_name(x["h"]).alias("name"), x["pos"].alias("pos"), F.endswith(x["h"], F.lit("/")).alias("is_dir"), x["c"].alias("c")))
    return F.transform(F.filter(found, lambda x: _is_entry(x["name"])), lambda x: F.struct(x["name"].alias("name"), x["pos"].alias("pos"), x["is_dir"].alias("is_dir"), _entry_size(x["c"], x["is_dir"]).alias("size")))


def _listed(pages: DataFrame, html: str) -> DataFrame:
    """Chunked pages with ``_entries``, the index entries of a page of which the first of each name stays, and ``_index``,
    whether it is a directory index. A page is one row throughout: entries are sorted by name in it, and nothing is shuffled."""
    after = F.slice("_chunks", 2, F.greatest(F.size("_chunks") - 1, F.lit(0)))
    found = pages.withColumn("_entries", F.array_sort(_entries(after)))
    first = F.filter("_entries", lambda e, i: (i == 0) | (F.get("_entries", i - 1)["name"] != e["name"]))
    found = found.withColumn("_first", first)
    low = F.lower(html)
    words = F.contains(low, F.lit("index of ")) | F.contains(low, F.lit("parent directory")) | F.contains(low, F.lit("<title>directory listing"))
    folders = F.size(F.filter("_first", lambda e: e["is_dir"])) >= 2
    return found.withColumn("_entries", F.col("_first")).withColumn("_index", F.coalesce(words | folders, F.lit(False))).drop("_first")


def parse_listing(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, pos, name, is_dir, size): entries of a directory index, in order, named by their href.

    The size is the last token after an anchor, up to the next one, that reads as a size. Of entries with one name the first
    stays.
    """
    chunks = _chunked(pages, html)
    rows = chunks.select(key, F.posexplode(F.slice("_chunks", 2, F.greatest(F.size("_chunks") - 1, F.lit(0)))).alias("pos", "chunk"))
    rows = rows.withColumn("href", _href(F.col("chunk"))).where(~_elsewhere(F.col("href"))).withColumn("is_dir", F.endswith("href", F.lit("/")))
    rows = rows.select(key, "pos", _entry_name(F.col("href")).alias("name"), "is_dir", _entry_size(F.col("chunk"), F.col("is_dir")).alias("size"))
    return dedup_first(rows.where(_is_entry(F.col("name"))), [key, "name"], ["pos"])


def is_listing(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, listing): whether a page is a directory index, by its words or by two folder entries."""
    return _listed(_chunked(pages, html), html).select(key, F.col("_index").alias("listing"))


def _attr(tag: Column, name: str) -> Column:
    """An attribute's value, quoted either way or bare; empty without one."""
    value = F.regexp_extract(tag, rf"""(?s){name}=(?:"([^"]*)"|'([^']*)'|([^\s"'][^\s]*))""", 0)
    return F.regexp_replace(F.regexp_replace(value, f"^{name}=", ""), r"^[\"']|[\"']$|>+$", "")


#: The tags whose targets are assets, with the attribute that names them, in the order of extraction.
ASSET_TAGS = (("img", "src"), ("script", "src"), ("link", "href"), ("source", "src"))
ENTRY = "struct<name:string,pos:int,is_dir:boolean,size:bigint>"
_ASSET = f"(?s)<(?:{'|'.join(t for t, _ in ASSET_TAGS)}) [^>]*>"


def _tags(chunk: str, pos: str) -> Column:
    """The links of a chunk (of a page ``base``): its anchor, if it is one's, and the assets in it, as (kind, sub, text, target).
    Targets are resolved here, once for each tag."""
    c = F.col(chunk)
    target = lambda tag, name: X.join_url("base", X.unescape(_attr(tag, name)))
    kind = "array<struct<kind:int,sub:int,text:string,target:string>>"
    text = F.when(F.contains(c, F.lit("</a>")), X.before(X.after(c, ">"), "</a>")).otherwise(F.lit(""))
    anchor = F.array(F.struct(F.lit(0).alias("kind"), F.lit(0).alias("sub"), text.alias("text"), target(X.before(c, ">"), "href").alias("target")))
    anchor = F.when((F.col(pos) > 0) & F.contains(c, F.lit(">")), anchor).otherwise(F.array().cast(kind))
    found = F.regexp_extract_all(c, F.lit(_ASSET), F.lit(0))
    of = lambda t, value: reduce(lambda w, k: w.when(F.startswith(t, F.lit(f"<{k[1][0]} ")), value(k)), enumerate(ASSET_TAGS), F.when(F.lit(False), F.lit(None)))
    assets = F.transform(found, lambda t, i: F.struct(of(t, lambda k: F.lit(k[0] + 1)).cast("int").alias("kind"), i.alias("sub"), F.lit("").alias("text"), of(t, lambda k: target(X.before(t, ">"), k[1][1])).cast("string").alias("target")))
    return F.when(F.contains(c, F.lit("<")), F.concat(anchor, assets)).otherwise(anchor)


def _named(rows: DataFrame, key: str) -> DataFrame:
    """(key, ord, name, url, is_dir, size) of tags (key, base, e, pos, t): the links that stay, the first of each target. A
    tag of kind -1 stands for the index entry ``e``, which stays as it is."""
    entry = F.col("t.kind") == -1
    own = (X.host_of("t.target") == X.host_of("base")) & (F.regexp_replace(X.before("t.target", "#"), "/+$", "") != F.regexp_replace("base", "/+$", ""))
    links = rows.where(entry | own).select(key, F.struct("t.kind", "pos", "t.sub").alias("ord"), "t.text", "e", F.when(entry, F.col("t.target")).otherwise(X.before("t.target", "#")).alias("target"))
    first = dedup_first(links.select(key, "ord", "text", "e", "target"), [key, "target"], ["ord"])
    anchored, text = F.col("ord.kind") == 0, F.btrim(X.strip_tags("text"), F.lit(" \t\r\n"))
    text = F.when(anchored, text).otherwise(X.last_part(F.element_at(F.split("target", "[?#]"), 1)))
    name = X.pct_decode(F.when(text != "", F.substring(text, 1, 80)).otherwise(X.last_part(F.regexp_replace("target", "/+$", ""))))
    entry = F.col("ord.kind") == -1
    return first.select(key, "ord", F.when(entry, F.col("e.name")).otherwise(name).alias("name"), F.col("target").alias("url"), F.when(entry, F.col("e.is_dir")).otherwise(~X.looks_like_file("target")).alias("is_dir"), F.coalesce("e.size", F.lit(0)).cast("bigint").alias("size"))


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, ord, name, url, is_dir): links of a page to its own host, anchors first, then assets by tag.

    Anchors are named by their text, up to the next anchor, assets by their file; fragments are cut, links to the page itself
    and repeated ones dropped. The text is cut at its anchors once, and the assets are found in the cuts.
    """
    chunks = _chunked(pages, html).select(key, F.col(url).alias("base"), F.posexplode("_chunks").alias("pos", "chunk"))
    rows = chunks.select(key, "base", "pos", F.lit(None).cast(ENTRY).alias("e"), F.explode(_tags("chunk", "pos")).alias("t"))
    return _named(rows, key).drop("size")


def page_entries(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, ord, name, is_dir, size): index entries of pages that are an index with entries, else their links. Pages are
    read and cut once: each goes on as the rows of its entries or of its chunks."""
    listed = F.col("_index") & (F.size("_entries") > 0)
    entries = F.transform("_entries", lambda e: F.struct(e.alias("e"), e["pos"].alias("pos"), F.lit(None).cast("string").alias("chunk")))
    chunks = F.transform("_chunks", lambda c, i: F.struct(F.lit(None).cast(ENTRY).alias("e"), i.alias("pos"), c.alias("chunk")))
    rows = _listed(_chunked(pages, html), html).select(key, F.col(url).alias("base"), F.explode(F.when(listed, entries).otherwise(chunks)).alias("x"))
    rows = rows.select(key, "base", "x.e", "x.pos", "x.chunk")
    # entries are done; they go through the aggregation of the links as rows of their own
    done = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("sub"), F.lit("").alias("text"), F.col("e.name").alias("target")))
    tags = F.when(F.col("chunk").isNull(), done).otherwise(_tags("chunk", "pos"))
    return _named(rows.select(key, "base", "pos", "e", F.explode(tags).alias("t")), key).drop("url")


# ---------------------------------------------------------------- crawl rules


def parse_robots(df: DataFrame, token: str, origin: str = "origin", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(rules, delays): (origin, kind, prefix) of allow and disallow lines, and (origin, seconds), of the groups that are for
    everyone or name our token. The last delay counts, at most a minute."""
    raw = df.select(origin, F.posexplode(F.split(body, "\r?\n")).alias("no", "raw"))
    line = F.btrim(X.before("raw", "#"), F.lit(" \t\r\n"))
    lines = raw.withColumn("line", line).where(F.contains("line", F.lit(":")))
    lines = lines.select(origin, "no", F.lower(F.btrim(X.before("line", ":"))).alias("kind"), F.btrim(X.after("line", ":")).alias("value")).where(F.col("kind").isin("user-agent", "allow", "disallow", "crawl-delay"))
    grouped = robots_groups(lines, [origin])
    agent = (F.col("kind") == "user-agent") & ((F.col("value") == "*") | F.contains(F.lower("value"), F.lit(token.lower())))
    applies = grouped.groupBy(origin, "grp").agg(F.max(agent).alias("applies")).where("applies").select(origin, "grp")
    ours = grouped.join(applies, [origin, "grp"], "left_semi")
    rules = ours.where(F.col("kind").isin("allow", "disallow") & (F.col("value") != "")).select(origin, "kind", F.col("value").alias("prefix")).distinct()
    seconds = F.when(F.col("value").rlike(r"^[+]?[0-9]*\.?[0-9]+([eE][+-]?[0-9]+)?$"), F.col("value").try_cast("double"))
    delays = ours.where(F.col("kind") == "crawl-delay").withColumn("s", seconds).where("s > 0").groupBy(origin).agg(F.max_by("s", "no").alias("s"))
    return rules, delays.select(origin, F.least("s", F.lit(60.0)).alias("seconds"))
