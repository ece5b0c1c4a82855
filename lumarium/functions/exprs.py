"""Scalar functions of the catalogue as column expressions: every function takes and returns columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _text(x: Col) -> Column:
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def after(x: Col, sep: str) -> Column:
    """What follows the first ``sep``; null without one."""
    x = _c(x)
    at = F.instr(x, F.lit(sep))
    return F.when(at > 0, F.substr(x, at + len(sep)))


def before(x: Col, sep: str) -> Column:
    """What precedes the first ``sep``; all without one."""
    return F.substring_index(_c(x), sep, 1)


def last_part(x: Col, sep: str = "/") -> Column:
    return F.substring_index(_c(x), sep, -1)


# ---------------------------------------------------------------- labels


def license_label(code: Col) -> Column:
    """A dash when blank, public-domain marks bare, others after "CC"."""
    up = F.upper(_text(code))
    return F.when(up == "", F.lit("—")).when(up.isin("PDM", "CC0"), up).otherwise(F.concat(F.lit("CC "), up))


def dims(w: Col, h: Col) -> Column:
    w, h = F.coalesce(_c(w), F.lit(0)), F.coalesce(_c(h), F.lit(0))
    return F.when((w == 0) | (h == 0), F.lit("")).otherwise(F.concat_ws("×", w, h))


def human_count(n: Col) -> Column:
    n = _c(n)

    def scaled(unit: float, mark: str) -> Column:
        return F.format_string(f"%.1f{mark}", n.cast("double") / unit)

    return F.when(n >= 1_000_000_000, scaled(1e9, "B")).when(n >= 1_000_000, scaled(1e6, "M")).when(n >= 1000, scaled(1e3, "K")).otherwise(n.cast("string"))


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def duration_str(seconds: Col) -> Column:
    """h:mm:ss or m:ss, fractions cut; LIVE when unknown."""
    t = F.floor(_c(seconds)).cast("long")
    h, m, s = F.floor(t / 3600).cast("long"), F.floor((t % 3600) / 60).cast("long"), t % 60
    long_form = F.concat(h.cast("string"), F.lit(":"), _two(m), F.lit(":"), _two(s))
    return F.when(F.coalesce(_c(seconds), F.lit(0)) <= 0, F.lit("LIVE")).when(h > 0, long_form).otherwise(F.concat(m.cast("string"), F.lit(":"), _two(s)))


def duration_label(ms: Col) -> Column:
    s = F.floor(_c(ms) / 1000).cast("long")
    return F.when(F.coalesce(_c(ms), F.lit(0)) == 0, F.lit("")).otherwise(F.concat(F.floor(s / 60).cast("long").cast("string"), F.lit(":"), _two(s % 60)))


def rate_label(hz: Col) -> Column:
    return F.when(F.coalesce(_c(hz), F.lit(0)) == 0, F.lit("")).otherwise(F.format_string("%.1f kHz", _c(hz).cast("double") / 1000))


def size_label(n: Col) -> Column:
    n = _c(n)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit("")).when(n >= 1 << 20, F.format_string("%.1f MB", n.cast("double") / (1 << 20))).otherwise(F.format_string("%.0f KB", n.cast("double") / 1024))


def date_pretty(d: Col) -> Column:
    """CCYYMMDD as CCYY-MM-DD, anything else as it is."""
    d = _c(d)
    return F.when(d.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))).otherwise(d)


# ---------------------------------------------------------------- names and extensions


def _id8(x: Col) -> Column:
    return F.substring(_c(x), 1, 8)


def safe_filename(title: Col, id_: Col, ext: Col, default: str = "file", alnum_id: bool = False) -> Column:
    """``slug [id].ext``: ASCII letters and digits kept, all else an underscore, outer underscores cut, 48 characters."""
    # at most 48 characters from the first letter or digit on, which end in one unless another follows: no more is replaced
    head = F.regexp_extract(_text(title), r"(?s)[A-Za-z0-9](?:.{47}(?=[^A-Za-z0-9]*+[A-Za-z0-9])|.{0,46}[A-Za-z0-9])?", 0)
    slug = F.regexp_replace(head, "[^A-Za-z0-9]", "_")
    ident = F.regexp_replace(_c(id_), "[^A-Za-z0-9]", "") if alnum_id else _c(id_)
    return F.concat(F.when(slug == "", F.lit(default)).otherwise(slug), F.lit(" ["), _id8(ident), F.lit("]."), _c(ext))


def catalogue_filename(name: Col, slug: Col, ext: Col) -> Column:
    """The readable variant: spaces stay, separators and brackets become underscores, the whole slug is embedded."""
    return F.concat(F.btrim(reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("_")), "/\\[]", _text(name))), F.lit(" ["), _c(slug).cast("string"), F.lit("]."), _c(ext))


#: Extensions that count as images and as sounds in a URL.
IMAGE_EXTS = ("png", "gif", "webp", "bmp", "tiff", "svg")
SOUND_EXTS = ("mp3", "wav", "ogg", "flac", "oga", "m4a", "aiff", "aif")


def infer_ext(filetype: Col, url: Col) -> Column:
    """Declared type, else the ending of the URL if it is an image's, else jpg."""
    ft, tail = F.lower(F.btrim(_text(filetype))), F.lower(last_part(last_part(_text(url)), "."))
    known = F.when(tail.isin("jpg", "jpeg"), F.lit("jpg")).when(tail.isin(*IMAGE_EXTS), tail).otherwise(F.lit("jpg"))
    return F.when(ft == "jpeg", F.lit("jpg")).when(ft != "", ft).otherwise(known)


def infer_sound_ext(filetype: Col, url: Col) -> Column:
    ft, tail = F.lower(F.btrim(_text(filetype))), F.lower(last_part(before(before(_text(url), "?"), "#"), "."))
    return F.when(ft != "", ft).when(tail.isin(*SOUND_EXTS), tail).otherwise(F.lit("mp3"))


def slug(x: Col) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.regexp_replace(_text(x), "[^A-Za-z0-9]+", "-")), "-+", "-"), F.lit("-"))


def filename_base(prompt: Col, seed: Col, longest: int) -> Column:
    s = F.regexp_replace(F.substring(slug(prompt), 1, longest), "-+$", "")
    return F.concat_ws("_", F.when(s == "", F.lit("ai")).otherwise(s), _c(seed).cast("string"))


def parse_id(leaf: Col) -> Column:
    """Text in the last brackets of a leaf name, as a number; null without one."""
    return bracketed(leaf).try_cast("bigint")


def bracketed(leaf: Col) -> Column:
    """Text in the last brackets of a leaf name; null without brackets or with nothing in them."""
    got = F.regexp_extract(_text(leaf), r"(?s)^.*\[([^\]]*)\]", 1)
    return F.nullif(got, F.lit(""))


def channel_id(url: Col) -> Column:
    u = _text(url)
    return F.when(F.contains(u, F.lit("/channel/")), F.regexp_extract(u, "/channel/([^/?]*)", 1)).when(F.startswith(u, F.lit("UC")), u).otherwise(F.lit(""))


def detail_appid(path: Col) -> Column:
    """The number of a path ``game/<number>`` below the root; null for others."""
    return F.nullif(F.regexp_extract(_text(path), "^game/([0-9]+)$", 1), F.lit("")).cast("bigint")


def stem(name: Col) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(_text(name), r"(?s)\.[^.]*$", "")


def ext_of(name: Col) -> Column:
    return F.lower(last_part(_text(name), "."))


def leaf(filename: Col, id_: Col) -> Column:
    return catalogue_filename(stem(filename), id_, ext_of(filename))


def parse_family(filename: Col) -> Column:
    return F.nullif(F.btrim(F.regexp_replace(_text(filename), r"\.ttf$", "")), F.lit(""))


def display_name(title: Col, filename: Col) -> Column:
    t = F.btrim(_text(title))
    return F.when(t != "", t).otherwise(stem(filename))


def first_nonempty(cols: list[Col], default: str = "") -> Column:
    return F.coalesce(*(F.nullif(_c(c), F.lit("")) for c in cols), F.lit(default))


def best_weight(weights: Col) -> Column:
    w = _c(weights)
    return F.when(F.array_contains(w, "400"), F.lit("400")).otherwise(F.coalesce(F.try_element_at(w, F.lit(1)), F.lit("400")))


# ---------------------------------------------------------------- urls and markup


def pct_encode(x: Col) -> Column:
    """One path segment: all but letters, digits and ``-_.~`` as %XX of their UTF-8 bytes."""
    u = F.url_encode(_text(x))
    return F.replace(F.replace(F.replace(u, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def enc_path(x: Col) -> Column:
    """As pct_encode, with slashes kept."""
    return F.replace(pct_encode(x), F.lit("%2F"), F.lit("/"))


def pct_decode(x: Col) -> Column:
    """%XX decoded; malformed escapes stay as they are, and so does a plus sign."""
    x = _text(x)
    guarded = F.regexp_replace(F.replace(x, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(guarded), x)


def split_url(url: Col) -> Column:
    """Struct (origin, path); the path keeps its query. Null without a scheme."""
    u = _c(url)
    rest = after(u, "://")
    host = before(rest, "/")
    path = F.substr(rest, F.length(host) + 1)
    return F.when(rest.isNotNull(), F.struct(F.concat(before(u, "://"), F.lit("://"), host).alias("origin"), F.when(path == "", F.lit("/")).otherwise(path).alias("path")))


def host_of(url: Col) -> Column:
    return before(after(url, "://"), "/")


def _fold_segments(start: Column, parts: Column) -> Column:
    """Appends the parts to the segments: empty ones and dots are skipped, two dots drop the last one."""

    def step(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    return F.aggregate(parts, start, step)


def join_url(base: Col, href: Col) -> Column:
    """href resolved against the page's URL; null for fragments, mail and script links, and for a base without a scheme."""
    b, h = _c(base), F.btrim(_c(href), F.lit(" \t\r\n"))
    scheme, rest = before(b, "://"), after(b, "://")
    host, path = before(rest, "/"), F.coalesce(after(rest, "/"), F.lit(""))
    p = F.element_at(F.split(path, "[?#]"), 1)
    segments = F.split(p, "/")
    folder = F.filter(F.when(F.endswith(p, F.lit("/")), segments).otherwise(F.slice(segments, 1, F.size(segments) - 1)), lambda x: x != "")
    trail = F.when(F.endswith(h, F.lit("/")), F.lit("/")).otherwise(F.lit(""))
    relative = F.concat(scheme, F.lit("://"), host, F.lit("/"), F.array_join(_fold_segments(folder, F.split(h, "/")), "/"), trail)
    skip = (h == "") | F.startswith(h, F.lit("#")) | F.startswith(h, F.lit("mailto:")) | F.startswith(h, F.lit("javascript:"))
    return (
        F.when(skip, F.lit(None))
        .when(F.contains(h, F.lit("://")), h)
        .when(rest.isNull(), F.lit(None))
        .when(F.startswith(h, F.lit("//")), F.concat(scheme, F.lit(":"), h))
        .when(F.startswith(h, F.lit("/")), F.concat(scheme, F.lit("://"), host, h))
        .otherwise(relative)
    )


def parts_for_url(typed: Col) -> Column:
    """Struct (parts, is_http) of a typed URL: host and decoded segments; null for other schemes and bare words."""
    s = F.btrim(_text(typed), F.lit(" \t\r\n"))
    http, https = F.startswith(s, F.lit("http://")), F.startswith(s, F.lit("https://"))
    rest = F.when(https, F.substr(s, F.lit(9))).when(http, F.substr(s, F.lit(8))).otherwise(s)
    known = https | http | ~F.contains(s, F.lit("://"))
    clean = F.element_at(F.split(rest, "[?#]"), 1)
    parts = F.transform(F.filter(F.split(clean, "/"), lambda x: x != ""), pct_decode)
    host = F.try_element_at(parts, F.lit(1))
    ok = (s != "") & known & F.coalesce(F.contains(host, F.lit(".")) | F.startswith(host, F.lit("localhost")), F.lit(False))
    return F.when(ok, F.struct(parts.alias("parts"), http.alias("is_http")))


def abs_url(path: Col, site: str) -> Column:
    """A site path made absolute and encoded; absolute and empty ones pass."""
    p = _text(path)
    return F.when((p == "") | F.startswith(p, F.lit("http")), p).otherwise(F.concat(F.lit(site), enc_path(p)))


def x1_url(thumb: Col) -> Column:
    """The larger rendering that lies parallel to a thumbnail: the first ``/tn/`` becomes ``/x1/``."""
    t = _text(thumb)
    rest = after(t, "/tn/")
    return F.when(rest.isNull(), t).otherwise(F.concat(before(t, "/tn/"), F.lit("/x1/"), rest))


def strip_html(x: Col) -> Column:
    """Tags dropped, white space collapsed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(_text(x), "<[^>]*(>|$)|>", ""), r"\s+", " "))


#: The entities that listings use, in the order in which they are replaced.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))
MODULE_ENTITIES = (*ENTITIES[:4], ("&#039;", "'"), ("&apos;", "'"))


def unescape(x: Col, entities=ENTITIES) -> Column:
    x = _text(x)
    for name, char in entities:
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def strip_tags(x: Col) -> Column:
    """Tags become one space each, then entities are decoded."""
    return unescape(F.regexp_replace(F.regexp_replace(_text(x), "<[^>]*(>|$)", " "), ">", ""))


def parse_size(token: Col) -> Column:
    """Bytes of a size token such as ``1.5K`` or ``220038``; null for anything else."""
    t = F.btrim(_text(token))
    unit = F.upper(F.right(t, F.lit(1)))
    power = F.when(unit == "K", 1.0 * 2**10).when(unit == "M", 1.0 * 2**20).when(unit == "G", 1.0 * 2**30).when(unit == "T", 1.0 * 2**40).otherwise(1.0)
    number = F.btrim(F.when(unit.isin("K", "M", "G", "T", "B"), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t))
    value = F.when(number.rlike(r"^[+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), number.try_cast("double"))
    return F.floor(value * power).cast("bigint")


def looks_like_file(url: Col) -> Column:
    """Whether a URL ends like a file to fetch, not like a page to open."""
    last = F.lower(last_part(F.element_at(F.split(_text(url), "[?#]"), 1)))
    ext = F.regexp_extract(last, r"\.([a-z0-9]{0,5})$", 1)
    dotted = last.rlike(r"\.[a-z0-9]{0,5}$")
    return last.rlike(r"\.tar\.(gz|bz2|xz)$") | (dotted & ~ext.isin(*PAGE_EXTS))


#: Extensions of pages.
PAGE_EXTS = ("html", "htm", "php", "asp", "aspx", "jsp", "cgi", "shtml")


def url_from(template: str, **cols: Col) -> Column:
    """A URL template whose ``{name}`` places are filled with encoded columns; ``{name:plus}`` writes spaces as plus signs and
    ``{name:raw}`` leaves the value as it is."""
    out, rest = [], template
    while "{" in rest:
        text, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        key, _, how = name.partition(":")
        value = _c(cols[key]).cast("string")
        out += [F.lit(text), F.replace(value, F.lit(" "), F.lit("+")) if how == "plus" else value if how == "raw" else pct_encode(value)]
    return F.concat(*out, F.lit(rest))


def url_key(url: Col) -> Column:
    return F.lpad(F.lower(F.hex(F.xxhash64(_c(url)))), 16, "0")


def change_key(path: Col, size: Col, mtime: Col) -> Column:
    """Changes whenever path, size or modification time (seconds) does."""
    return url_key(F.concat_ws("|", _c(path), _c(size).cast("string"), _c(mtime).cast("string")))


# ---------------------------------------------------------------- paths


def normalize_path(path: Col) -> Column:
    """``.`` and ``..`` resolved within the path."""
    p = _text(path)
    return F.concat(F.when(F.startswith(p, F.lit("/")), F.lit("/")).otherwise(F.lit("")), F.array_join(_fold_segments(F.array().cast("array<string>"), F.split(p, "/")), "/"))


def safe_member(name: Col) -> Column:
    """An archive member's path made relative and safe; null when it is empty or leaves its folder at any point."""
    parts = F.split(F.regexp_replace(F.replace(_text(name), F.lit("\\"), F.lit("/")), "^/+", ""), "/")

    def step(acc: Column, part: Column) -> Column:
        path, ok = acc["path"], acc["ok"]
        up = part == ".."
        kept = F.when(part.isin("", "."), path).when(up, F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(F.concat(path, F.array(part)))
        return F.struct(kept.alias("path"), (ok & ~(up & (F.size(path) == 0))).alias("ok"))

    start = F.struct(F.array().cast("array<string>").alias("path"), F.lit(True).alias("ok"))
    return F.aggregate(parts, start, step, lambda acc: F.when(acc["ok"] & (F.size(acc["path"]) > 0), F.array_join(acc["path"], "/")))


def ancestors(path: Col) -> Column:
    """All folders above a path, the topmost first."""
    parts = F.split(_text(path), "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


# ---------------------------------------------------------------- numbers, colours, notes


def _hex(x: Column) -> Column:
    return F.conv(x, 16, 10).cast("int")


def parse_hex(x: Col) -> Column:
    """Six hex digits, with or without #, as a struct (r, g, b); null for anything else."""
    h = F.regexp_replace(F.btrim(_text(x)), "^#+", "")
    return F.when(h.rlike("^[0-9A-Fa-f]{6}$"), F.struct(*(_hex(F.substring(h, k, 2)).alias(n) for k, n in ((1, "r"), (3, "g"), (5, "b")))))


def parse_hex_any(x: Col) -> Column:
    """Three, six or eight hex digits as a struct (r, g, b, a)."""
    h = F.regexp_replace(F.btrim(_text(x)), "^#+", "")
    wide = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    full = F.when(F.length(wide) == 6, F.concat(wide, F.lit("ff"))).otherwise(wide)
    return F.when(h.rlike("^([0-9A-Fa-f]{3}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$"), F.struct(*(_hex(F.substring(full, k, 2)).alias(n) for k, n in ((1, "r"), (3, "g"), (5, "b"), (7, "a")))))


def stars_from_value(value: Col) -> Column:
    """0..10 as 0..5 stars; unreadable text is 0."""
    v = F.btrim(_c(value).cast("string"))
    return F.coalesce(F.when(v.rlike("^[+]?[0-9]+$"), F.least(F.floor(v.try_cast("bigint") / 2), F.lit(5))), F.lit(0)).cast("int")


def value_from_stars(stars: Col) -> Column:
    return (F.least(_c(stars), F.lit(5)) * 2).cast("string")


#: Labels of data types, and of the file types of character art.
DATA_TYPES = {0: "None", 2: "Bitmap", 3: "Vector", 4: "Audio", 5: "BinaryText", 6: "XBin", 7: "Archive", 8: "Executable"}
CHARACTER_TYPES = {0: "ASCII", 1: "ANSi", 2: "ANSiMation", 3: "RIPScript", 4: "PCBoard", 5: "Avatar", 6: "HTML", 7: "Source", 8: "TundraDraw"}


def _lookup(key: Column, table: dict, default: Column) -> Column:
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(m, key), default)


def kind_label(data_type: Col, file_type: Col) -> Column:
    d = _c(data_type).cast("int")
    return F.when(d == 1, _lookup(_c(file_type).cast("int"), CHARACTER_TYPES, F.lit("Character"))).otherwise(_lookup(d, DATA_TYPES, F.lit("Unknown")))


def char_width(data_type: Col, file_type: Col, tinfo1: Col) -> Column:
    d, f, t = _c(data_type), _c(file_type), _c(tinfo1)
    return F.when((d == 1) & (t > 0), t.cast("int")).when((d == 5) & (f > 0), (f * 2).cast("int"))


#: Half tones of the note letters.
NOTES = {"c": 0, "d": 2, "e": 4, "f": 5, "g": 7, "a": 9, "b": 11}


def parse_note(value: Col) -> Column:
    """MIDI number 0..127 of a number or a note name such as ``c#4`` or ``db-1``; null for anything else."""
    s = F.lower(F.btrim(_text(value)))
    pattern = "^([a-g])([#s]|b)?([+-]?[0-9]+)$"
    sharp = F.regexp_extract(s, pattern, 2)
    shift = F.when(sharp.isin("#", "s"), 1).when(sharp == "b", -1).otherwise(0)
    tone = _lookup(F.regexp_extract(s, pattern, 1), NOTES, F.lit(None).cast("int"))
    midi = (F.regexp_extract(s, pattern, 3).try_cast("int") + 1) * 12 + tone + shift
    number = F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("int"))
    note = F.coalesce(number, F.when(s.rlike(pattern), midi))
    return F.when(note.isNotNull(), F.greatest(F.least(note, F.lit(127)), F.lit(0)))


def parse_fraction(x: Col) -> Column:
    """``num/den`` as a rate; 0 for a zero denominator or an unreadable numerator."""
    parts = F.split(_text(x), "/")
    num = F.coalesce(F.try_element_at(parts, F.lit(1)).try_cast("double"), F.lit(0.0))
    den = F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("double"), F.lit(1.0))
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def thumb_seek(duration: Col) -> Column:
    d = _c(duration).cast("double")
    return F.when(F.coalesce(d, F.lit(0.0)) <= 0, F.lit(1.0)).otherwise(F.least(d * 0.1, F.greatest(d - 1, F.lit(0.0))))


#: Kinds of 3D assets.
KINDS = {"models": ("3D Models", "gltf"), "textures": ("Textures", "jpg"), "hdris": ("HDRIs", "jpg")}


def kind_info(slug_: Col) -> Column:
    """Struct (label, ext) of a kind; null for unknown ones."""
    s = _c(slug_)
    table = F.create_map(*(x for k, (label, ext) in KINDS.items() for x in (F.lit(k), F.struct(F.lit(label).alias("label"), F.lit(ext).alias("ext")))))
    return F.try_element_at(table, s)


def status_label(code: Col) -> Column:
    """Label of a two-letter status code of a working copy."""
    c = _c(code)
    x, y = F.substring(c, 1, 1), F.substring(c, 2, 1)
    conflict = (x == "U") | (y == "U") | c.isin("AA", "DD")
    return F.when(conflict, F.lit("conflict")).when(c == "!!", F.lit("ignored")).when(c == "??", F.lit("new")).otherwise(F.lit("modified"))


# ---------------------------------------------------------------- templates


def expand(template: Col, values: Col) -> Column:
    """Fills ``{name}`` from a map column with lower-case keys: ``{NAME}`` in capitals, ``{name:slug}`` and ``{name:lower}``
    as said, unknown names as nothing; an open brace without its end stays."""
    t, m = _text(template), _c(values)
    names = F.regexp_extract_all(t, F.lit(r"\{([^}]*)\}"), 1)
    texts = F.split(t, r"\{[^}]*\}")

    def value(raw: Column) -> Column:
        base, how = before(raw, ":"), after(raw, ":")
        v = F.btrim(F.coalesce(F.try_element_at(m, F.lower(base)), F.lit("")))
        upper = (base == F.upper(base)) & base.rlike("[A-Z]")
        return F.when(how == "slug", slug(v)).when(how == "lower", F.lower(v)).when(upper, F.upper(v)).otherwise(v)

    filled = F.transform(names, value)
    return F.array_join(F.zip_with(texts, filled, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
