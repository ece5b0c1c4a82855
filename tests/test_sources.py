"""Sources on small literal inputs."""

from lumarium.sources import catalogues as S
from lumarium.sources import files as Fi
from lumarium.sources import web


def df1(spark, text, name="body"):
    return spark.createDataFrame([(1, text)], f"page_id int, {name} string")


def test_broken_bodies_give_nothing(spark):
    for body in ("", "{", "[]", '{"results": 5}', "null", '{"results":[{"id":null}]}'):
        df = df1(spark, body).selectExpr("body", "'a' AS artist", "'g' AS grp", "2000 AS year", "1999 AS year_hint", "'p' AS pack", "7 AS appid", "'v' AS video_id", "'x' AS path", "'s' AS slug")
        for out in (S.images(df), S.sounds(df), S.pieces_from_artist(df, "s"), S.pieces_from_pack(df, "s"), S.packs(df, "s"), S.icons(df, "a", "b"), S.vectors(df), S.palettes(df, "s"), S.owned(df), S.game_media(df), S.videos(df), S.comments(df, 3), S.video_probe(df), S.fonts(df), S.bundle_files(df, "a", "b", "c"), S.group_names(df) if body != '{"results":[{"id":null}]}' else S.images(df)):
            assert out.count() == 0


def test_listing_of_a_server(spark):
    html = """<html><h1>Index of /pub</h1><pre><a href="?C=N;O=D">Name</a> <a href="/">Up</a>
<a href="../">Parent Directory</a>  -
<a href="sub%20dir/">sub dir/</a> 2004-Sep-13 -
<a href="song%5B1%5D.xm">song[1].xm</a> 2004-Sep-13 10:11 220038
<a href="long.zip">lon..&gt;</a></td><td>1.5K</td><td>&nbsp;</td>
<a href="long.zip">again</a> 9M <a href="https://o/x.zip">off</a> <a href="a/b">deep</a></pre>"""
    got = [(r.name, r.is_dir, r.size) for r in web.parse_listing(df1(spark, html, "html")).orderBy("pos").collect()]
    assert got == [("sub dir", True, 0), ("song[1].xm", False, 220038), ("long.zip", False, 1536)]
    assert web.is_listing(df1(spark, html, "html")).first().listing


def test_links_of_a_page(spark):
    html = """<a class=x href='/docs/'>The <b>docs</b></a> <a href="a.zip#f"></a><a href="https://other/x">o</a><a href="#top">t</a><a href="/">home</a>
<a href="a.zip">again</a><img alt=1 src=pic.png><script src="/s.js"></script><link rel=x href="st.css"><a href="mailto:x">m</a><source src="../v.mp4">"""
    df = spark.createDataFrame([(1, "https://h.org/dir/page", html)], "page_id int, url string, html string")
    got = [(r.name, r.url, r.is_dir) for r in web.page_links(df).orderBy("ord").collect()]
    assert got == [
        ("The  docs", "https://h.org/docs/", True), ("a.zip", "https://h.org/dir/a.zip", False), ("home", "https://h.org/", True), ("pic.png", "https://h.org/dir/pic.png", False),
        ("s.js", "https://h.org/s.js", False), ("st.css", "https://h.org/dir/st.css", False), ("v.mp4", "https://h.org/v.mp4", False),
    ]
    assert not web.is_listing(df).first().listing and web.page_entries(df).count() == 7


def test_robots_body(spark):
    body = "User-agent: a\nUser-agent: *\nDisallow: /x # no\nDisallow:\nSitemap: s\nUser-agent: b\nAllow: /y\nCrawl-delay: 9\nUser-agent: MyBot\nCrawl-delay: 100\nAllow: /z"
    df = spark.createDataFrame([("o", body)], "origin string, body string")
    rules, delays = web.parse_robots(df, "mybot")
    assert sorted((r.kind, r.prefix) for r in rules.collect()) == [("allow", "/z"), ("disallow", "/x")]
    assert [r.seconds for r in delays.collect()] == [60.0]


def test_status_records(spark):
    df = spark.createDataFrame([("/r", "R  new\0old\0?? a b\0UU c\0!! d\0 M e\0")], "root string, body string")
    got = {r.path: r.status for r in Fi.file_status(df).collect()}
    assert got == {"/r/new": "modified", "/r/a b": "new", "/r/c": "conflict", "/r/d": "ignored", "/r/e": "modified"}


def test_trailers(spark):
    def record(comments=0, flags=1):
        return b"SAUCE00" + b"Title".ljust(35) + b"Me\0".ljust(20, b"\0") + b"G".ljust(20) + b"19960504" + b"\0" * 4 + bytes([1, 1, 80, 0, 25, 0, 0, 0, 0, 0, comments, flags]) + b"VGA".ljust(22, b"\0")

    assert len(record()) == 128
    note = b"COMNT" + b"one".ljust(64) + b"two".ljust(64)
    files = [("a", b"art\x1a" + record()), ("b", b"art\x1a\x1a" + note + record(2, 0) + b"\r\n\x1a"), ("c", b"SAUCE00 in text" * 20), ("d", b"x"), ("e", record() + b"tail"), ("f", b"art" + record(2))]
    df = spark.createDataFrame(files, "path string, content binary")
    got = {r.path: (r.title, r.author, r.tinfo1, r.ice, r.comment) for r in Fi.sauce_scan(df).collect()}
    assert got == {"a": ("Title", "Me", 80, True, ""), "b": ("Title", "Me", 80, False, "one two"), "f": ("Title", "Me", 80, True, "")}
    cut = {r.path: bytes(r.content) for r in Fi.sauce_strip(df).collect()}
    assert cut == dict(files) | {"a": b"art", "b": b"art", "f": b"art"}


def test_content_of_trailers_is_made_once(spark):
    from pyspark.sql import functions as F

    files = spark.range(3).select(F.col("id").alias("path"), F.to_binary(F.rpad(F.col("id").cast("string"), 200, " "), F.lit("utf-8")).alias("content"))
    for out in (Fi.sauce_scan(files), Fi.sauce_strip(files)):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("rpad(") == 1


def test_text_encodings(spark):
    df = spark.createDataFrame([(1, "né".encode()), (2, b"\x82\xdb"), (3, b"")], "id int, content binary")
    assert {r.id: (r.text, r.encoding) for r in Fi.decode_text(df).collect()} == {1: ("né", "utf8"), 2: ("é█", "cp437"), 3: ("", "utf8")}
    assert {r.id: r.text for r in Fi.decode_text(df, encoding="latin1").collect()}[2] == "\x82Û"


def test_catalogue_and_palettes_from_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.TXT", "sub/b.png", "c.zip", "noext"):
        (tmp_path / name).write_bytes(b"x" * 5)
    got = Fi.catalogue(spark, str(tmp_path), ["txt", "png", "zip"], ["zip"])
    assert sorted(r.path.rsplit("/", 1)[1] for r in got.collect()) == ["a.TXT", "b.png"]
    (tmp_path / "p.gpl").write_text("GIMP Palette\nName: x\n#\n 1 2 3 red\n256 0 0\n4 5\n7\t8\t9\n")
    assert [(r.idx, r.r, r.g, r.b) for r in Fi.read_gpl(spark, str(tmp_path / "p.gpl")).orderBy("idx").collect()] == [(0, 1, 2, 3), (1, 7, 8, 9)]
    pal = [tuple(r) for r in Fi.xterm256(spark).orderBy("idx").collect()]
    assert len(pal) == 256 and pal[196] == (196, 255, 0, 0) and pal[255] == (255, 238, 238, 238) and pal[9] == (9, 255, 85, 85)


def test_modules(spark):
    html = "moduleid=5#a.xm' moduleid=x moduleid=6 moduleid=5#b.xm moduleid=7#noext moduleid=8#c&#039;.it"
    assert [(r.id, r.filename) for r in web.modules_from_html(df1(spark, html, "html")).orderBy("pos").collect()] == [(5, "a.xm")]
    xml = df1(spark, "<r><error> bad &amp; key </error></r>", "xml")
    assert xml.select(web.xml_error("xml")).first()[0] == "bad & key" and web.modules_from_xml(xml).count() == 0
