"""Scalar functions on single values."""

import pytest
from pyspark.sql import functions as F

from lumarium.functions import exprs as X
from lumarium.operators import predicates as P

L = F.lit


def values(spark, *cols):
    return list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first())


def check(spark, cases):
    """One job for all cases: (column, expected)."""
    got = values(spark, *(c for c, _ in cases))
    for k, ((_, want), g) in enumerate(zip(cases, got, strict=True)):
        g = tuple(g) if hasattr(g, "asDict") else g
        assert g == want, f"case {k}: {g!r} is not {want!r}"


def test_labels(spark):
    check(spark, [
        (X.license_label(L("")), "—"), (X.license_label(L(None)), "—"), (X.license_label(L("cc0")), "CC0"), (X.license_label(L("pdm")), "PDM"), (X.license_label(L("by-nc")), "CC BY-NC"),
        (X.dims(L(0), L(5)), ""), (X.dims(L(640), L(480)), "640×480"), (X.dims(L(None).cast("int"), L(4)), ""),
        (X.human_count(L(999)), "999"), (X.human_count(L(1234)), "1.2K"), (X.human_count(L(5_600_000)), "5.6M"), (X.human_count(L(7_800_000_000)), "7.8B"),
        (X.duration_str(L(0.0)), "LIVE"), (X.duration_str(L(65.9)), "1:05"), (X.duration_str(L(3725.0)), "1:02:05"), (X.duration_str(L(None).cast("double")), "LIVE"),
        (X.duration_label(L(61_500)), "1:01"), (X.duration_label(L(0)), ""), (X.rate_label(L(44_100)), "44.1 kHz"), (X.rate_label(L(0)), ""),
        (X.size_label(L(0)), ""), (X.size_label(L(2048)), "2 KB"), (X.size_label(L(3 << 20)), "3.0 MB"),
        (X.date_pretty(L("19960504")), "1996-05-04"), (X.date_pretty(L("1996")), "1996"), (X.kind_label(L(1), L(1)), "ANSi"), (X.kind_label(L(1), L(99)), "Character"), (X.kind_label(L(6), L(0)), "XBin"), (X.kind_label(L(42), L(0)), "Unknown"),
        (X.char_width(L(1), L(0), L(80)), 80), (X.char_width(L(5), L(250), L(0)), 500), (X.char_width(L(2), L(1), L(80)), None),
    ])


def test_names(spark):
    check(spark, [
        (X.safe_filename(L("A cat: on/mat!"), L("abcdefghij"), L("jpg")), "A_cat__on_mat [abcdefgh].jpg"), (X.safe_filename(L("???"), L("x"), L("png"), "image"), "image [x].png"), (X.safe_filename(L(None), L("a:b-c"), L("svg"), "asset", True), "asset [abc].svg"),
        (X.catalogue_filename(L(" Old [oak]/tree "), L("oak_1"), L("gltf")), "Old _oak__tree [oak_1].gltf"), (X.infer_ext(L("jpeg"), L("")), "jpg"), (X.infer_ext(L(" PNG"), L("")), "png"), (X.infer_ext(L(None), L("https://h/a.WEBP")), "webp"), (X.infer_ext(L(""), L("https://h/a")), "jpg"),
        (X.infer_sound_ext(L(None), L("https://h/a.flac?x=1.mp4#z")), "flac"), (X.infer_sound_ext(L(""), L("x.txt")), "mp3"), (X.slug(L("  Hello, World -- 2 ")), "hello-world-2"), (X.filename_base(L("a b c"), L(7), 3), "a-b_7"), (X.filename_base(L("!!"), L(7), 9), "ai_7"),
        (X.parse_id(L("song [x] [123].xm")), 123), (X.parse_id(L("song")), None), (X.bracketed(L("tree [oak_1].gltf")), "oak_1"), (X.bracketed(L("tree [].gltf")), None), (X.channel_id(L("https://v/channel/UCa/videos")), "UCa"), (X.channel_id(L("UCb")), "UCb"), (X.channel_id(L("https://v/@me")), ""),
        (X.detail_appid(L("game/440")), 440), (X.detail_appid(L("game/440/x")), None), (X.leaf(L("a.b/c.XM"), L(5)), "a.b_c [5].xm"), (X.parse_family(L("Open Sans.ttf")), "Open Sans"), (X.parse_family(L(".ttf")), None), (X.display_name(L("  "), L("song.it")), "song"),
        (X.first_nonempty([L(""), L(None).cast("string"), L("x")]), "x"), (X.first_nonempty([L("")], "none"), "none"), (X.best_weight(F.array(L("300"), L("700"))), "300"),
    ])


@pytest.mark.parametrize("base,href,want", [
    ("https://h.org/a/b/page.html", "../c/d.zip", "https://h.org/a/c/d.zip"), ("https://h.org/a/b/", "c", "https://h.org/a/b/c"), ("https://h.org", "x/", "https://h.org/x/"), ("https://h.org/a?q=/z", "/r", "https://h.org/r"),
    ("http://h.org/a", "//cdn/x", "http://cdn/x"), ("https://h.org/a", "ftp://o/x", "ftp://o/x"), ("https://h.org/a", "#top", None), ("https://h.org/a", "mailto:x", None), ("https://h.org/a", " ", None), ("nohost", "x", None), ("https://h.org/a/b", "../../../x/./y", "https://h.org/x/y"),
])
def test_join_url(spark, base, href, want):
    check(spark, [(X.join_url(L(base), L(href)), want)])


def test_urls_and_markup(spark):
    check(spark, [
        (X.pct_encode(L("a b/é~*+")), "a%20b%2F%C3%A9~%2A%2B"), (X.enc_path(L("/p/#4 x")), "/p/%234%20x"), (X.pct_decode(L("a%20b+c%zz%4")), "a b+c%zz%4"), (X.split_url(L("https://h/a?b#c")), ("https://h", "/a?b#c")), (X.split_url(L("https://h")), ("https://h", "/")), (X.split_url(L("h/a")), None),
        (X.parts_for_url(L("modland.org/pub/a%20b/?x")), (["modland.org", "pub", "a b"], False)), (X.parts_for_url(L("http://localhost:80/x")), (["localhost:80", "x"], True)), (X.parts_for_url(L("ftp://h.org/")), None), (X.parts_for_url(L("word")), None), (X.parts_for_url(L(" ")), None),
        (X.abs_url(L(""), "https://s"), ""), (X.abs_url(L("http://x"), "https://s"), "http://x"), (X.abs_url(L("/pack/#4"), "https://s"), "https://s/pack/%234"), (X.x1_url(L("/p/tn/a/tn/b")), "/p/x1/a/tn/b"), (X.x1_url(L("/p")), "/p"),
        (X.strip_html(L("<b>a</b>  <i>b")), "a b"), (X.strip_tags(L("<td>1</td><td>2&amp;&nbsp;3</td>")), " 1  2& 3 "), (X.parse_size(L("1.5K")), 1536), (X.parse_size(L("220038")), 220038), (X.parse_size(L("-")), None), (X.parse_size(L("2M")), 2 << 20), (X.parse_size(L("9B")), 9), (X.parse_size(L("x")), None),
        (X.looks_like_file(L("https://h/a.tar.gz?x")), True), (X.looks_like_file(L("https://h/a.html")), False), (X.looks_like_file(L("https://h/a/")), False), (X.looks_like_file(L("https://h/a.longext")), False), (X.url_from("https://s/{a}?q={b:plus}", a=L("x y"), b=L("p q")), "https://s/x%20y?q=p+q"),
    ])


def test_paths_numbers_templates(spark):
    m = F.create_map(L("prompt"), L(" Red Fox "), L("seed"), L("7"))
    check(spark, [
        (X.normalize_path(L("/a/./b/../c")), "/a/c"), (X.normalize_path(L("a/../../b")), "b"), (X.safe_member(L("..\\x")), None), (X.safe_member(L("/a/b")), "a/b"), (X.safe_member(L("a/../b")), "b"), (X.safe_member(L("a/..")), None), (X.safe_member(L("a/../../b/c")), None), (X.ancestors(L("a/b/c")), ["a", "a/b"]), (X.ancestors(L("a")), []),
        (X.parse_hex(L("#ff8000")), (255, 128, 0)), (X.parse_hex(L("fff")), None), (X.parse_hex_any(L("#f80")), (255, 136, 0, 255)), (X.parse_hex_any(L("11223344")), (17, 34, 51, 68)), (X.parse_hex_any(L("12345")), None),
        (X.stars_from_value(L(" 7 ")), 3), (X.stars_from_value(L("99")), 5), (X.stars_from_value(L("x")), 0), (X.value_from_stars(L(9)), "10"),
        (X.parse_note(L("c4")), 60), (X.parse_note(L("C#-1")), 1), (X.parse_note(L("db4")), 61), (X.parse_note(L("200")), 127), (X.parse_note(L("h2")), None), (X.parse_note(L("c-5")), 0), (X.parse_fraction(L("30000/1000")), 30.0), (X.parse_fraction(L("1/0")), 0.0), (X.parse_fraction(L("25")), 25.0), (X.thumb_seek(L(0)), 1.0), (X.thumb_seek(L(60)), 6.0), (X.thumb_seek(L(1)), 0.0),
        (X.status_label(L("UD")), "conflict"), (X.status_label(L("DD")), "conflict"), (X.status_label(L("!!")), "ignored"), (X.status_label(L(" M")), "modified"),
        (X.expand(L("{prompt:slug}/{PROMPT}-{seed}{no}{x"), m), "red-fox/RED FOX-7{x"), (X.expand(L("plain"), m), "plain"), (X.kind_info(L("hdris")), ("HDRIs", "jpg")), (X.kind_info(L("x")), None),
    ])


def test_predicates(spark):
    check(spark, [
        (P.glob(L("Song.XM"), "*.xm"), True), (P.glob(L("a.b"), "a?b"), True), (P.glob(L("a+b"), "a+b"), True), (P.glob(L("ab"), "a"), False), (P.glob(L("x\ny"), "x*y"), True), (P.glob(L(""), "*"), True),
        (P.glob_any(L("a.zip"), ""), True), (P.glob_any(L("a.zip"), "*.txt;*.zip"), True), (P.glob_any(L("a.zip"), "*|a*"), False), (P.glob_any(L("b.zip"), "|a*"), True), (P.glob_any(L("b.zip"), "*.x | "), False),
        (P.words_in("Red  fox", [L("a FOX"), L("redder")]), True), (P.words_in("red cat", [L("red")]), False), (P.words_in("  ", [L("x")]), True), (P.is_nongame(L("PROTON 9")), True), (P.is_nongame(L("SteamVR home")), False),
        (P.fresh(L(100), L(90), L(10)), True), (P.fresh(L(101), L(90), L(10)), False), (P.fresh(L(10**9), L(0), L(None).cast("int")), True), (P.is_partial(L("v1.mp4.part"), L("v1")), True), (P.is_partial(L("v1.mp4"), L("v1")), False), (P.is_partial(L("v12.f1.mp4"), L("v1")), False),
        (P.ttl_for(L("https://x/pack/latest")), None), (P.ttl_for(L("https://x/latest")), 3600), (P.within_cap(L(None).cast("int"), 5), True), (P.within_cap(L(6), 5), False),
    ])


def test_safe_filename_of_long_and_odd_titles(spark):
    import random
    import re

    rng = random.Random(9)
    titles = ["", "\n!\n", "_a_", "a" * 48 + "_", "a" * 47 + "__b", "a" * 47 + "_" * 5000, "a" * 48 + "!" * 5000 + "b", "-" * 300 + "x\ny😀z" + "😀" * 60 + "é1"]
    titles += ["".join(rng.choice("ab0é_ \n😀") for _ in range(rng.choice((3, 40, 49, 50, 51, 120)))) for _ in range(200)]
    titles += [x + rng.choice("!_\n😀") * rng.randrange(60) for x in titles]
    df = spark.createDataFrame(list(enumerate(titles)), "k int, title string").select("k", X.safe_filename("title", F.lit("i"), F.lit("e")).alias("name"), X.catalogue_filename("title", F.lit("i"), F.lit("e")).alias("readable"))
    slug = [re.sub("[^A-Za-z0-9]", "_", t).strip("_")[:48] for t in titles]
    assert {r.k: (r.name, r.readable) for r in df.collect()} == {k: (f"{slug[k] or 'file'} [i].e", f"{re.sub(r'[/\\\[\]]', '_', t).strip(' ')} [i].e") for k, t in enumerate(titles)}
    assert "regexp_replace(regexp_extract(" in df._jdf.queryExecution().optimizedPlan().toString()  # not the whole title
