"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last bytes has its low bits clear, so equal passages of different documents give
equal chunks. A worker encodes each distinct chunk once and keeps its ids (of a store of fixed size, the chunks that were
not used for longest go first). At a join of two chunks the ids may differ from those of the whole text. The join is repaired by re-encoding from
the last sure token boundary of the left chunk to the first one of the right chunk; a chunk without one becomes part of
the re-encoded text, which grows until both ends agree. A sure boundary is a space between two ASCII letters: the
tokenizer's word pattern starts a new word there whatever surrounds it. Hence ids are exactly those of the whole text.

Chunks are shared within tasks and not across them: moving all text through a shuffle costs more than encoding it.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

ROLL, MASK_BITS, MIN_STORE = 16, 11, 24 << 20
SPECIAL = {"<|endoftext|>": 50256}
#: Runs of white space of so many characters are encoded without the word pattern, whose search for them goes as deep as they
#: are long.
RUN = 4096
#: White space of the word pattern (fixed values of Unicode).
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = re.compile(f"[{WHITE}]{{{RUN},}}")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Encoder:
    """Encodes whole texts chunk by chunk; ``ranks`` is the path of a rank file, ``special`` maps strings to ids."""

    def __init__(self, ranks: str, pattern: str, special: dict[str, int], store_bytes: int = MIN_STORE):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.special = {k.encode(): v for k, v in special.items()}
        self.token = [b""] * (max([*table.values(), *special.values()]) + 1)
        for k, v in [*table.items(), *((k, v) for k, v in self.special.items())]:
            self.token[v] = k
        self.size = np.array([len(x) for x in self.token])
        self.store_bytes, self.store, self.older, self.used = store_bytes, {}, {}, 0
        self.letter = np.zeros(256, bool)
        self.letter[65:91] = self.letter[97:123] = True

    def ids(self, data: bytes) -> np.ndarray:
        """Ids of a text without special strings. A long run of white space is cut out: the word pattern makes one piece of
        it, but for a last character that something follows, with which what follows begins."""
        text = data.decode()
        if len(data) < RUN or not (runs := list(LONG_RUN.finditer(text))):
            return self.bpe.encode_to_numpy(text, disallowed_special=())
        out, at = [], 0
        for m in runs:
            end = m.end() - (m.end() < len(text))
            out.append(self.bpe.encode_to_numpy(text[at : m.start()], disallowed_special=()))
            out.append(np.array(self.bpe._encode_single_piece(text[m.start() : end]), np.uint32))
            at = end
        out.append(self.bpe.encode_to_numpy(text[at:], disallowed_special=()))
        return np.concatenate(out)

    def whole(self, data: bytes) -> np.ndarray:
        """Ids of a whole text, its special strings among them, without chunks."""
        out = []
        for a, b, special in self.segments(data, 0, len(data)):
            out.append(self.ids(data[a:b]).astype(np.uint32))
            if special is not None:
                out.append(np.array([special], np.uint32))
        return np.concatenate(out)

    def chunk(self, data: bytes, head: int, tail: int) -> tuple[np.ndarray, int, int]:
        """Ids of a chunk, and how many of them stand before its first and its last sure boundary."""
        if (known := self.store.get(data)) is None:
            if (known := self.older.pop(data, None)) is None:
                ids = self.ids(data)
                ends = np.cumsum(self.size[ids])
                known = (ids.astype(np.uint32), int(np.searchsorted(ends, head)) + 1, int(np.searchsorted(ends, tail)) + 1)
            self.used += len(data) + known[0].nbytes + 300
            if self.used > self.store_bytes // 2:  # what isn't used until the new half is full is gone
                self.older, self.store, self.used = self.store, {}, len(data)
            self.store[data] = known
        return known

    def texts(self, raw: np.ndarray, offs: np.ndarray):
        """Ids of each text of a run of texts."""
        data = raw.tobytes()
        sums = C.prefix_hash(raw)
        at = np.arange(ROLL, len(raw))
        cut = at[(C.span_hash(sums, at - ROLL, at) >> np.uint64(64 - MASK_BITS)) == 0] if len(at) else at
        cut = cut[(raw[cut] & 0xC0) != 0x80]  # between characters
        cut = cut[cut - ROLL >= offs[np.searchsorted(offs, cut, "right") - 1]]  # the hashed bytes are the text's own
        sure = np.flatnonzero((raw[1:-1] == 32) & self.letter[raw[:-2]] & self.letter[raw[2:]]) + 1
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            out: list[np.ndarray] = []
            for s, e, special in self.segments(data, a, b):
                self.segment(data, s, e, cut, sure, out)
                if special is not None:
                    out.append(np.array([special], np.uint32))
            yield np.concatenate(out) if out else np.zeros(0, np.uint32)

    def segments(self, data: bytes, a: int, b: int):
        """The stretches between special strings, each with the id of the one that follows it."""
        while True:
            found = [(p, -len(k), k) for k in self.special if (p := data.find(k, a, b)) >= 0]
            if not found:
                yield a, b, None
                return
            p, _, k = min(found)
            yield a, p, self.special[k]
            a = p + len(k)

    def segment(self, data: bytes, s: int, e: int, cut: np.ndarray, sure: np.ndarray, out: list) -> None:
        inner = cut[np.searchsorted(cut, s, "right") : np.searchsorted(cut, e)]
        edges = [s, *inner.tolist(), e]
        low, high = np.searchsorted(sure, np.array(edges[:-1]) + 1), np.searchsorted(sure, np.array(edges[1:]) - 1)
        open_from = s  # start of the text that awaits re-encoding
        for k, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if x == y:
                continue
            first, last = k == 0, k == len(edges) - 2
            if low[k] >= high[k]:
                continue  # no sure boundary: all of it is encoded with its neighbours, if it has any
            head, tail = int(sure[low[k]]), int(sure[high[k] - 1])
            ids, n_head, n_tail = self.chunk(data[x:y], head - x, tail - x)
            if not first or open_from < x:
                out.append(self.ids(data[open_from:head]))
                start = n_head
            else:
                start = 0
            if last:
                out.append(ids[start:])
                return
            out.append(ids[start:n_tail])
            open_from = tail
        if open_from < e:
            out.append(self.ids(data[open_from:e]))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.token[i] for i in ids.tolist()]).decode("utf-8", "replace")


def bpe_encode_decode(docs: DataFrame, text_col: str = "text", ranks: str | None = None, pattern: str | None = None, special: dict[str, int] | None = None, keep: list[str] | None = None) -> DataFrame:
    """(row, ids, n_tokens, decoded): each row of docs with its ids (binary, little-endian unsigned 32-bit) and their decoding.

    Null and empty texts have no ids. A text of any length and with runs of white space of any length is encoded whole, in the
    memory of its task, which needs some hundred bytes for each of its bytes. Null ids pass through. Special strings inside a text become their ids. Repeated rows give repeated results;
    other columns (those named in ``keep``, or all) pass through ``row``. ``ranks`` is a rank file's path that all executors have.
    """
    ranks, pattern, special = ranks or tokenizer_path("byte_bpe_50k.tiktoken"), pattern or _pattern(), SPECIAL if special is None else special

    def run(batches):
        enc = Encoder(ranks, pattern, special)
        for b in batches:
            for lo, hi, raw, offs in C.text_chunks(b.column(1)):
                ids = list(enc.texts(raw, offs))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64()), pa.array([enc.decode(x) for x in ids], pa.string())], ["row", "ids", "n_tokens", "decoded"])

    base = C.row_and_text(docs, text_col, keep)
    schema = T.StructType([base.schema["row"], T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])
    return C.map_batches(base, run, schema)


def op4_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_encode_decode(C.documents(spark, sf_dir), keep=["doc_id"])
    return out.select("row.doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
