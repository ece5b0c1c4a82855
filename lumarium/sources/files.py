"""Files and text dumps as typed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.ordered import suppress_repeats
from ..operators.pieces import numbered

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- catalogues of files


def catalogue(spark: SparkSession, root: str, exts: list[str], disabled: list[str] = ()) -> DataFrame:
    """(path, length, modified, ext) of all files below root whose extension is known and switched on. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    return known_extensions(files.withColumn("ext", extension("path")), exts, disabled)


def extension(path: Col) -> Column:
    """Lower-case extension of a path's last part; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def known_extensions(files: DataFrame, exts: list[str], disabled: list[str] = (), ext: str = "ext") -> DataFrame:
    off = {d.lower() for d in disabled}
    return files.where(F.lower(ext).isin(*[e.lower() for e in exts if e.lower() not in off]))


#: Fixed values, in the order in which they count: what files of each kind begin with, as (offset in bytes, hex) fields that
#: must all hold, and the least length of a head that is looked at.
SIGNATURES = (
    ("pcx", ((0, "0A"),), 1),
    ("iff", ((0, "464F524D"), (8, "494C424D")), 12),
    ("ase", ((4, "E0A5"),), 6),
    ("psd", ((0, "38425053"),), 4),
    ("xcf", ((0, "67696D702078636620"),), 9),
    ("svg", ("<svg", "<?xml"), 4),
    ("ttf", ((0, "00010000"),), 4),
    ("otf", ((0, "4F54544F"),), 4),
    ("ttf", ((0, "74727565"),), 4),
    ("ttf", ((0, "74797031"),), 4),
    ("ttc", ((0, "74746366"),), 4),
    ("tdf", ((0, "13"), (1, "5468654472617720464F4E54532066696C65")), 20),
    ("psf", ((0, "3604"),), 4),
    ("psf", ((0, "72B54A86"),), 4),
    ("amigafont", ((0, "000003F3"),), 4),
    ("xbin", ((0, "5842494E1A"),), 5),
    ("tnd", ((0, "18"), (1, "54554E4452413234")), 9),
    ("xp", ((0, "1F8B"),), 2),
    ("idf", ((0, "04312E34"),), 4),
    ("idf", ((0, "04312E35"),), 4),
    ("petmate", ("{", "version"), 1),
    ("rip", ((0, "217C"),), 2),
    ("pdf", ((0, "255044462D"),), 5),
    ("eps", ((0, "25215053"),), 4),
    ("eps", ((0, "C5D0D3C6"),), 4),
    ("png", ((0, "89504E470D0A1A0A"),), 8),
    ("jpg", ((0, "FFD8FF"),), 3),
    ("gif", ((0, "474946383961"),), 6),
    ("gif", ((0, "474946383761"),), 6),
    ("webp", ((0, "52494646"), (8, "57454250")), 12),
    ("tif", ((0, "4D4D002A"),), 4),
    ("tif", ((0, "49492A00"),), 4),
    ("dds", ((0, "44445320"),), 4),
    ("bmp", ((0, "424D"),), 2),
    ("ico", ((0, "00000100"),), 4),
    ("hdr", ((0, "233F52414449414E4345"),), 10),
    ("pnm", ((0, "5031"),), 2),
    ("pnm", ((0, "5032"),), 2),
    ("pnm", ((0, "5033"),), 2),
    ("pnm", ((0, "5034"),), 2),
    ("pnm", ((0, "5035"),), 2),
    ("pnm", ((0, "5036"),), 2),
    ("pnm", ((0, "5037"),), 2),
    ("ff", ((0, "6661726266656C64"),), 8),
    ("avif", ((4, "6674797061766966"),), 12),
    ("exr", ((0, "762F3101"),), 4),
    ("qoi", ((0, "716F6966"),), 4),
)
#: Bytes of a file that signatures look at.
HEAD = 32


def sniffed(head: Column, text: Column, signatures=SIGNATURES) -> Column:
    """The kind of a file by its first bytes, as hex and as Latin-1 text; null when no signature holds. Of several that hold
    the first counts.

    Signatures that fix the first byte are looked through only where a file has it, so that a file meets the few of its own
    byte and those that fix none (text heads and fields farther on), in their order. Text heads: ``svg`` opens with one of
    its marks after white space, or has the first anywhere; ``petmate`` is an object whose head names a version.
    """
    size = F.coalesce(F.length(text), F.lit(0))

    def first_byte(fields):
        return next((f[1][:2] for f in fields if not isinstance(f, str) and f[0] == 0), None)

    def holds(kind, fields, least):
        if kind == "svg":
            open_ = F.ltrim(text, F.lit(" \t\n\x0b\x0c\r"))
            return F.contains(text, F.lit(fields[0])) | F.startswith(open_, F.lit(fields[1]))
        if kind == "petmate":
            return F.startswith(text, F.lit(fields[0])) & F.contains(text, F.lit(fields[1]))
        return reduce(lambda a, f: a & (F.substring(head, 2 * f[0] + 1, len(f[1])) == f[1]), fields, size >= least)

    def chain(rules):
        return reduce(lambda acc, s: acc.when(holds(*s), F.lit(s[0])), rules, F.when(F.lit(False), F.lit("")))

    bytes_ = sorted({b for s in signatures if (b := first_byte(s[1]))})
    own = {b: [s for s in signatures if first_byte(s[1]) in (b, None)] for b in bytes_}
    start = F.substring(head, 1, 2)
    out = reduce(lambda acc, b: acc.when(start == b, chain(own[b])), bytes_, F.when(size == 0, F.lit(None).cast("string")))
    return out.otherwise(chain([s for s in signatures if first_byte(s[1]) is None]))


def classify_files(files: DataFrame, signatures=SIGNATURES, path: str = "path", content: str = "content") -> DataFrame:
    """Adds ``kind``: by the first bytes, else by extension, else character art for names without one."""
    raw, kind = F.substring(content, 1, HEAD), F.coalesce(sniffed(F.col("_head"), F.col("_text"), signatures), F.nullif(extension(path), F.lit("")), F.lit("ans"))
    return files.withColumn("_head", F.hex(raw)).withColumn("_text", F.decode(raw, "ISO-8859-1")).withColumn("kind", kind).drop("_head", "_text")


#: Extensions of archives that hold several files, the containers of songs and instruments among them.
ARCHIVE_EXTS = ("zip", "7z", "rar", "lha", "lzh", "tar", "ace", "arj", "arc", "zoo", "ha", "uc2", "sqz", "hyp", "tgz", "tbz", "xrns", "xrni")


def is_archive(path: Col, exts=ARCHIVE_EXTS) -> Column:
    return extension(path).isin(*exts)


# ---------------------------------------------------------------- palettes


def gpl_rows(lines: DataFrame, key: str = "file", no: str = "no", line: str = "line") -> DataFrame:
    """(key, idx, r, g, b) of palette lines (key, no, line); headers, comments and bad lines are dropped."""
    t = F.btrim(line, F.lit(" \t\r"))
    low = F.lower(t)
    header = F.startswith(low, F.lit("gimp palette")) | F.startswith(low, F.lit("name:")) | F.startswith(low, F.lit("columns:")) | F.startswith(t, F.lit("#")) | (t == "")
    parts = F.split(t, r"\s+")
    channel = lambda k: F.when(F.try_element_at(parts, F.lit(k)).rlike("^[+]?[0-9]+$"), F.try_element_at(parts, F.lit(k)).try_cast("int"))
    rows = lines.where(~header).select(key, no, *(channel(k + 1).alias(c) for k, c in enumerate("rgb")))
    good = reduce(lambda a, b: a & b, (F.col(c).between(0, 255) for c in "rgb"))
    from pyspark.sql import Window

    idx = F.row_number().over(Window.partitionBy(key).orderBy(no)) - 1
    return rows.where(good).select(key, idx.alias("idx"), *"rgb")


def read_gpl(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return gpl_rows(files.select("file", F.posexplode(F.split("value", "\n")).alias("no", "line")))


def palette_library(builtin: DataFrame, user: DataFrame) -> DataFrame:
    """(palette_id, idx, r, g, b, builtin) of bundled and own palettes."""
    cols = ["palette_id", "idx", "r", "g", "b"]
    return builtin.select(*cols, F.lit(True).alias("builtin")).unionByName(user.select(*cols, F.lit(False).alias("builtin")))


#: The sixteen basic colours of a terminal, and the steps of its colour cube.
ANSI16 = ((0, 0, 0), (170, 0, 0), (0, 170, 0), (170, 85, 0), (0, 0, 170), (170, 0, 170), (0, 170, 170), (170, 170, 170), (85, 85, 85), (255, 85, 85), (85, 255, 85), (255, 255, 85), (85, 85, 255), (255, 85, 255), (85, 255, 255), (255, 255, 255))
CUBE = (0, 95, 135, 175, 215, 255)


def xterm256(spark: SparkSession) -> DataFrame:
    """(idx, r, g, b): basic colours, a 6 x 6 x 6 cube, and 24 greys."""
    i = F.col("idx")
    cube, basic = F.array(*map(F.lit, CUBE)), F.array(*(F.array(*map(F.lit, c)) for c in ANSI16))
    at = i - 16

    def channel(k: int, step: int) -> Column:
        in_cube = F.get(cube, (F.floor(at / step) % 6).cast("int"))
        return F.when(i < 16, F.get(F.get(basic, i), F.lit(k))).when(i < 232, in_cube).otherwise(8 + 10 * (i - 232)).cast("int")

    return spark.range(256).select(F.col("id").cast("int").alias("idx")).select("idx", channel(0, 36).alias("r"), channel(1, 6).alias("g"), channel(2, 1).alias("b"))


# ---------------------------------------------------------------- key/value manifests


def vdf_value(text: Col, key: str) -> Column:
    """The first quoted value of a quoted key at the start of a line; null without one."""
    return F.try_element_at(vdf_values(text, key), F.lit(1))


def vdf_values(text: Col, key: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf'(?m)^\s*"{key}"\s*"([^"]*)"'), 1)


def installed(df: DataFrame, text: str = "text") -> DataFrame:
    """(appid, name, last_played, size) of manifests that have a number and a name."""
    number = lambda k: F.coalesce(vdf_value(text, k).try_cast("bigint"), F.lit(0))
    return df.select(vdf_value(text, "appid").try_cast("bigint").alias("appid"), vdf_value(text, "name").alias("name"), number("LastPlayed").alias("last_played"), number("SizeOnDisk").alias("size")).where("appid IS NOT NULL AND name <> ''")


def library_paths(df: DataFrame, text: str = "text", key: str = "path") -> DataFrame:
    return df.select(F.explode(vdf_values(text, key)).alias("path"))


# ---------------------------------------------------------------- transcripts, status, logs, notes


def transcript(vtt: Col) -> Column:
    """Caption text without headers, cues, tags and rolling repeats."""
    lines = F.transform(F.split(vtt, "\r?\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    head = lambda x: (x == "") | (x == "WEBVTT") | x.rlike("^(Kind:|Language:|NOTE)") | F.contains(x, F.lit("-->"))
    clean = F.transform(F.filter(lines, lambda x: ~head(x)), lambda x: F.btrim(F.regexp_replace(x, "<[^>]*(>|$)|>", ""), F.lit(" \t\r")))
    return F.array_join(suppress_repeats(F.filter(clean, lambda x: x != "")), "\n")


def transcripts(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("transcript", transcript(text))


def best_caption(df: DataFrame, video: str = "video_id", name: str = "name", pos: str = "pos") -> DataFrame:
    """(video, name): each video's best caption file by its name; of equally good ones the first listed."""
    n = F.col(name)
    rank = F.when(F.endswith(n, F.lit(".en.vtt")), 0).when(F.contains(n, F.lit(".en-orig")), 1).when(F.contains(n, F.lit(".en")), 2).otherwise(3)
    return df.where(F.endswith(n, F.lit(".vtt"))).groupBy(video).agg(F.min_by(name, F.struct(rank, pos)).alias(name))


def file_status(df: DataFrame, body: str = "body", root: str = "root") -> DataFrame:
    """(root, path, status) of NUL-separated status records; a rename or copy takes up the field after it."""
    fields = F.split(body, "\\u0000")

    def step(acc: Column, f: Column) -> Column:
        skip = acc["skip"]
        short = F.length(f) < 3
        record = F.array(F.struct(F.substring(f, 1, 2).alias("code"), F.substr(f, F.lit(4)).alias("path")))
        takes = ~skip & ~short & F.substring(f, 1, 1).isin("R", "C")
        return F.struct(takes.alias("skip"), F.when(skip | short, acc["out"]).otherwise(F.concat(acc["out"], record)).alias("out"))

    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<struct<code:string,path:string>>").alias("out"))
    rows = df.select(root, F.explode(F.aggregate(fields, start, step, lambda acc: acc["out"])).alias("r"))
    return rows.select(root, F.concat_ws("/", F.regexp_replace(root, "/+$", ""), "r.path").alias("path"), X.status_label("r.code").alias("status"))


def progress_log(df: DataFrame, line: str = "line") -> DataFrame:
    """(…, pct, eta, speed) of progress lines; other lines are dropped, unknown values blank."""
    parts = F.split(line, r"\|")
    field = lambda k: F.btrim(F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit("")))
    clean = lambda x: F.when(F.contains(x, F.lit("Unknown")) | (x == "N/A"), F.lit("")).otherwise(x)
    out = df.where(F.startswith(line, F.lit("PV|"))).withColumn("pct", F.btrim(F.regexp_replace(field(2), "%+$", "")).try_cast("double"))
    return out.where("pct IS NOT NULL").withColumn("eta", clean(field(3))).withColumn("speed", clean(field(4)))


def list_items(lists: DataFrame, name: str) -> DataFrame:
    return lists.where(F.col("list") == name).orderBy("pos")


def append_item(lists: DataFrame, items: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """lists with the items (id, title, thumb_url, ord) added at the end of one list, in the order of ``ord``; they are
    numbered over range partitions."""
    end = lists.where(F.col("list") == name).agg(F.coalesce(F.max("pos"), F.lit(0)).alias("_end"))  # one row
    new = numbered(items, [], ["ord", "id"], parts=parts).crossJoin(F.broadcast(end)).withColumn("pos", (F.col("_end") + F.col("_n")).cast("int"))
    return lists.unionByName(new.select(F.lit(name).alias("list"), "pos", "id", "title", "thumb_url"))


def chapters(df: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, no, seconds, title, notes): timecode lines are markers, lines below each are its notes.

    A fold over the lines of each text keeps the work in its row."""
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    mark = r"^(?:([0-9]+):)?([0-9]{1,2}):([0-9]{2})(?:\s+(.*))?$"

    def step(acc: Column, x: Column) -> Column:
        hour = F.coalesce(F.regexp_extract(x, mark, 1).try_cast("int"), F.lit(0))
        seconds = hour * 3600 + F.regexp_extract(x, mark, 2).try_cast("int") * 60 + F.regexp_extract(x, mark, 3).try_cast("int")
        new = F.array(F.struct(seconds.alias("seconds"), F.regexp_extract(x, mark, 4).alias("title"), F.array().cast("array<string>").alias("notes")))
        last = F.try_element_at(acc, F.lit(-1))
        noted = F.array(F.struct(last["seconds"].alias("seconds"), last["title"].alias("title"), F.concat(last["notes"], F.array(x)).alias("notes")))
        return F.when(x.rlike(mark), F.concat(acc, new)).when((x == "") | (F.size(acc) == 0), acc).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), noted))

    start = F.array().cast("array<struct<seconds:int,title:string,notes:array<string>>>")
    rows = df.select(key, F.posexplode(F.aggregate(lines, start, step)).alias("no", "m"))
    return rows.select(key, "no", "m.seconds", "m.title", F.array_join("m.notes", "\n").alias("notes"))


# ---------------------------------------------------------------- binary trailers and text encodings


def _byte(content: Column, at: Column) -> Column:
    """Byte at a 0-based place as a number."""
    return F.conv(F.hex(F.substr(content, at + 1, F.lit(1))), 16, 10).cast("int")


#: Fixed sizes: a record, what may follow it, a line of a comment and the mark before the lines.
RECORD, SLACK, COMMENT_LINE, COMMENT_MARK = 128, 8, 64, 5


def sauce_start(content: Col = "content") -> Column:
    """0-based start of the trailer record: 128 bytes from the end, or up to eight more where only blanks and control bytes
    follow; null without one."""
    c = _c(content)
    n = F.octet_length(c)
    tries = F.sequence(F.lit(0), F.least(F.lit(SLACK), n - RECORD))
    magic = lambda k: F.hex(F.substr(c, n - RECORD - k + 1, F.lit(7))) == "53415543453030"
    blank = lambda k: F.hex(F.substr(c, n - k + 1, k)).rlike("^((0|1)[0-9A-F]|20)*$")
    return F.when(n >= RECORD, n - RECORD - F.try_element_at(F.filter(tries, lambda k: magic(k) & blank(k)), F.lit(1)))


def _field(record: Column, off: int, length: int) -> Column:
    """Text of a padded field."""
    text = F.decode(F.substring(record, 1 + off, length), "UTF-8")
    return F.btrim(F.regexp_replace(text, r"[\x00\x20]+$", ""))


def _trailers(files: DataFrame, content: str) -> DataFrame:
    """files with the start of the record, the record itself, and the comment block before it (empty without one): each is cut
    out of the file once, and what is read from it meets no more of the file."""
    c, s = F.col(content), F.col("_start")
    # a generator, through which no filter goes: whatever made the content runs once for a file, not for each use of it
    once = F.inline(F.transform(F.array(c), lambda x: F.struct(x.alias(content), sauce_start(x).alias("_start"))))
    found = files.select(*(k for k in files.columns if k != content), once).select(*files.columns, "_start").withColumn("_record", F.substr(c, s + 1, F.lit(RECORD)))
    n = COMMENT_MARK + COMMENT_LINE * _byte(F.col("_record"), F.lit(104))
    there = (n > COMMENT_MARK) & (s >= n)
    found = found.withColumn("_block", F.when(there, F.substr(c, s - n + 1, n)))
    marked = F.hex(F.substring("_block", 1, COMMENT_MARK)) == "434F4D4E54"
    return found.withColumn("_block", F.when(marked, F.col("_block")).otherwise(F.lit(b"").cast("binary")))


def sauce_scan(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, title, author, group, date, data_type, file_type, tinfo1, tinfo2, comments, ice, font, comment) of files that
    end in a trailer record."""
    r, block = F.col("_record"), F.col("_block")
    byte = lambda off: _byte(r, F.lit(off))
    word = lambda off: byte(off) + 256 * byte(off + 1)
    n = F.expr(f"(octet_length(_block) - {COMMENT_MARK}) div {COMMENT_LINE}").cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    lines = F.transform(places, lambda k: F.btrim(F.decode(F.substr(block, COMMENT_MARK + 1 + COMMENT_LINE * k, F.lit(COMMENT_LINE)), "UTF-8"), F.lit(" \t\r\n")))
    comment = F.array_join(F.filter(lines, lambda x: x != ""), " ")
    return _trailers(files, content).where("_start IS NOT NULL").select(
        path, *(_field(r, off, size).alias(name) for name, off, size in (("title", 7, 35), ("author", 42, 20), ("group", 62, 20), ("date", 82, 8))),
        byte(94).alias("data_type"), byte(95).alias("file_type"), word(96).alias("tinfo1"), word(98).alias("tinfo2"), byte(104).alias("comments"),
        (byte(105) % 2 == 1).alias("ice"), _field(r, 106, 22).alias("font"), comment.alias("comment"),
    )


def sauce_strip(files: DataFrame, content: str = "content") -> DataFrame:
    """Files whose content ends before the trailer, its comment block and the end-of-file marks before them."""
    c, s = F.col(content), F.col("_start")
    cut = s - F.octet_length("_block")
    marks = F.length(F.regexp_extract(F.hex(F.substr(c, F.lit(1), cut)), "(1A)*$", 0)) / 2
    # only whole bytes count: pairs of hex digits from an even place, which a match at the end of an even text has
    kept = F.when(s.isNull(), c).otherwise(F.substr(c, F.lit(1), (cut - marks).cast("int")))
    return _trailers(files, content).withColumn(content, kept).drop("_start", "_record", "_block")


#: The characters of bytes 128 to 255 in code page 437.
CP437_HIGH = "ÇüéâäàåçêëèïîìÄÅÉæÆôöòûùÿÖÜ¢£¥₧ƒáíóúñÑªº¿⌐¬½¼¡«»░▒▓│┤╡╢╖╕╣║╗╝╜╛┐└┴┬├─┼╞╟╚╔╩╦╠═╬╧╨╤╥╙╘╒╓╫╪┘┌█▄▌▐▀αßΓπΣσµτΦΘΩδ∞φε∩≡±≥≤⌠⌡÷≈°∙·√ⁿ²■ "


def latin1(content: Col) -> Column:
    return F.decode(_c(content), "ISO-8859-1")


def cp437(content: Col) -> Column:
    """Text of code page 437; bytes below 128 as in ASCII."""
    return F.translate(latin1(content), "".join(map(chr, range(128, 256))), CP437_HIGH)


def decode_text(files: DataFrame, content: str = "content", encoding: str | None = None) -> DataFrame:
    """Adds (text, encoding): UTF-8 where the bytes are valid, else code page 437; ``encoding`` (utf8, cp437 or latin1) says
    otherwise, with Latin-1 in place of UTF-8 that isn't valid."""
    valid = F.is_valid_utf8(F.col(content).cast("string"))
    utf8 = F.decode(content, "UTF-8")
    if encoding is None:
        return files.withColumn("text", F.when(valid, utf8).otherwise(cp437(content))).withColumn("encoding", F.when(valid, F.lit("utf8")).otherwise(F.lit("cp437")))
    text = {"utf8": F.when(valid, utf8).otherwise(latin1(content)), "cp437": cp437(content), "latin1": latin1(content)}[encoding]
    return files.withColumn("text", text).withColumn("encoding", F.lit(encoding))


# ---------------------------------------------------------------- instruments


def sfz_opcodes(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, pos, opcode, value) in order: headers, and keys whose values go on to the next key."""
    clean = F.regexp_replace(text, r"(?s)//[^\n]*|/\*.*?(\*/|$)", "")
    item = r"(?s)(?:^|(?<=\s))(<\S*>)(?=\s|$)|(?:^|(?<=\s))([A-Za-z0-9_]+)=(.*?)(?=\s+(?:[A-Za-z0-9_]+=|<\S*>(?:\s|$))|\s*$)"
    parts = F.arrays_zip(*(F.regexp_extract_all(clean, F.lit(item), k).alias(n) for k, n in ((1, "h"), (2, "k"), (3, "v"))))
    rows = df.select(key, F.posexplode(parts).alias("pos", "m"))
    header = F.col("m.h") != ""
    value = F.regexp_replace(F.btrim("m.v", F.lit(" \t\r\n")), r"\s+", " ")
    return rows.select(key, "pos", F.when(header, F.lit("<header>")).otherwise(F.lower("m.k")).alias("opcode"), F.when(header, F.btrim("m.h", F.lit("<>"))).otherwise(value).alias("value"))
