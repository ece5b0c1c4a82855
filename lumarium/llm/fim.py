"""Fill-in-middle transformation with a sparse index of multibyte characters.

Texts are worked on as UTF-8 bytes. The index records only the characters of several bytes: where each stands, and how many
bytes beyond one it and those before it have. A cut in code points becomes one in bytes, and back, by a binary search in the
index; where there are only ASCII characters the two differ by a constant. Units of a cut are runs of ASCII letters and
single other characters; they are counted page by page, so that a long text needs no table of its units.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SENTINELS = ("<P>", "<S>", "<M>")
#: Of a hundred documents so many are transformed, and of a hundred of these so many have the suffix first.
FIM_RATE, SPM_RATE = 90, 20
PAGE = 1 << 20

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


class SparseIndex:
    """Where the multibyte characters of a run of bytes are: ``at`` their first bytes, ``excess`` the bytes beyond one of each
    and all before it, ``point`` their numbers as code points."""

    def __init__(self, raw: np.ndarray):
        found = [lo + np.flatnonzero(raw[lo : lo + PAGE] >= 0xC0) for lo in range(0, len(raw), PAGE)]
        self.at = np.concatenate(found) if found else np.zeros(0, np.int64)
        lead = raw[self.at]
        self.excess = np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))
        self.point = self.at - np.concatenate([[0], self.excess[:-1]]) if len(self.at) else self.at

    def to_point(self, byte):
        """The number of characters before a byte where a character starts."""
        k = np.searchsorted(self.at, byte, "left")
        return byte - np.where(k > 0, self.excess[k - 1], 0) if len(self.at) else byte

    def to_byte(self, point):
        """The first byte of a character, by its number."""
        k = np.searchsorted(self.point, point, "left")
        return point + np.where(k > 0, self.excess[k - 1], 0) if len(self.at) else point


def unit_starts(raw: np.ndarray, lo: int, hi: int, bounds: np.ndarray) -> np.ndarray:
    """Bytes from lo to hi at which a unit starts; a run of letters ends where a text of ``bounds`` does."""
    part = raw[lo:hi]
    letter = LETTER[part]
    before = np.empty(len(part), bool)
    before[1:] = letter[:-1]
    before[:1] = lo > 0 and LETTER[raw[lo - 1]]
    inner = bounds[np.searchsorted(bounds, lo) : np.searchsorted(bounds, hi)]
    before[inner - lo] = False
    return lo + np.flatnonzero(((part & 0xC0) != 0x80) & ~(letter & before))


class Units:
    """Units of a run of texts: how many each text has, and at which byte any of them starts. Only the counts of pages are
    kept."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        self.raw, self.bounds = raw, offs[:-1]
        self.total, self.page = 0, [0]
        self.before = np.zeros(len(offs), np.int64)  # units before each text
        self.kept: tuple[int, np.ndarray] | None = None
        for lo in range(0, len(raw), PAGE):
            starts = unit_starts(raw, lo, min(len(raw), lo + PAGE), self.bounds)
            own = slice(np.searchsorted(offs, lo, "left"), np.searchsorted(offs, lo + PAGE, "left"))
            self.before[own] = self.total + np.searchsorted(starts, offs[own])
            self.total += len(starts)
            self.page.append(self.total)
            self.kept = (lo // PAGE, starts)
        self.before[offs >= len(raw)] = self.total
        self.count = np.diff(self.before)

    def start(self, unit: int) -> int:
        """The byte at which a unit, counted over all texts, starts; the end for the one past the last."""
        if unit >= self.total:
            return len(self.raw)
        k = int(np.searchsorted(self.page, unit, "right")) - 1
        if self.kept[0] != k:
            self.kept = (k, unit_starts(self.raw, k * PAGE, min(len(self.raw), (k + 1) * PAGE), self.bounds))
        return int(self.kept[1][unit - self.page[k]])


def draws(id_column: Column) -> list[Column]:
    """Four numbers below 2**32 by hash of an id; null for a null id."""
    h = F.sha2(F.concat(F.lit("1:"), id_column.cast("string")), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "word", fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, str, str] = SENTINELS, keep: list[str] | None = None) -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, output): each row of docs with its transformed text.

    ``n`` counts units: with "word" runs of ASCII letters and single other characters, with "char" characters. Two cuts
    between units are drawn by hash of the id, so that repeated rows give repeated results. The form is "psm" (prefix, suffix,
    middle), "spm" (suffix, prefix, middle) or "plain"; plain are texts that the rate leaves out, null and empty ones, those
    that contain a sentinel, and rows with a null id. Their output is the text (null: empty) and their lengths are null.
    Lengths are in code points. Texts of any length are transformed whole, in some ten bytes for each of theirs. Other
    columns (those named in ``keep``, or all) pass through ``row``.
    """
    marks = [s.encode() for s in sentinels]
    pre, suf, mid = marks
    if unit not in ("word", "char"):
        raise ValueError("unit is word or char")

    def run(batches):
        for b in batches:
            draw = [b.column(k).to_pylist() for k in range(2, 6)]
            for lo, hi, raw, offs in C.text_chunks(b.column(1)):
                index, data = SparseIndex(raw), raw.tobytes()
                units = Units(raw, offs) if unit == "word" else None
                first = index.to_point(offs)  # characters before each text
                count = units.count if units else np.diff(first)
                forms, prefix, middle, out = [], [], [], []
                for i, (a, z) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                    h, n = [x[lo + i] for x in draw], int(count[i])
                    text = data[a:z]
                    if a == z or h[0] is None or h[2] % 100 >= fim_rate or any(s in text for s in marks):
                        forms.append("plain")
                        prefix.append(None)
                        middle.append(None)
                        out.append(text)
                        continue
                    cuts = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                    if units:
                        x, y = (units.start(int(units.before[i]) + c) if c < n else z for c in cuts)
                    else:
                        x, y = index.to_byte(first[i] + np.array(cuts)).tolist()
                    p, q = index.to_point(np.array([x, y])).tolist()
                    x, y = x - a, y - a
                    spm = h[3] % 100 < spm_rate
                    forms.append("spm" if spm else "psm")
                    prefix.append(p - int(first[i]))
                    middle.append(q - p)
                    out.append(b"".join([suf, text[y:], pre, text[:x], mid, text[x:y]] if spm else [pre, text[:x], suf, text[y:], mid, text[x:y]]))
                texts = pa.array(out, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(count, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), texts], ["row", "n", "form", "prefix_chars", "middle_chars", "output"])

    names = docs.columns if keep is None else keep
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"), *(d.alias(f"h{k}") for k, d in enumerate(draws(F.col(f"`{id_col}`")))))
    fields = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    return C.map_batches(base, run, T.StructType([base.schema["row"], *fields]))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of a form came from: no text that was transformed contains a sentinel, so they tell its parts."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    psm, spm = (F.concat(*(F.get(parts, F.lit(k)) for k in order)) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(C.documents(spark, sf_dir), keep=["doc_id"])
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def _hex(k: int) -> str:
    return f"CAST('0x'||substr(sha256('1:'||doc_id), {8 * k + 1}, 8) AS BIGINT)"


#: The same by lists of units.
ORACLE = f"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, {", ".join(f"{_hex(k)} AS h{k + 1}" for k in range(4))} FROM documents),
drawn AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS x, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS y FROM cut),
parts AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {FIM_RATE} THEN 'plain' WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form,
 array_to_string(u[1:x], '') AS p, array_to_string(u[x + 1:y], '') AS m, array_to_string(u[y + 1:], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>'||p||'<S>'||s||'<M>'||m ELSE '<S>'||s||'<P>'||p||'<M>'||m END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts
"""
