"""Personal data by fixed patterns and a skip-chain conditional random field.

Base spans come from four patterns. The field then labels every candidate of a document (runs of digits with separators,
address-like strings) as email, ip, card, phone or none. Candidates of a base span keep its label. Neighbours in the text
share chain potentials; candidates that repeat each other (equal digits, equal last digits, equal address names) share
skip potentials, however far apart. Loopy belief propagation runs until messages settle, and a free candidate whose belief
reaches MIN_BELIEF becomes an added span, linked or not. A candidate is linked to the one before it with the same key only,
so a document has as many links as candidates.

All weights are trained here together, by gradients of the conditional likelihood in which loopy beliefs stand for the
expectations. The training graphs are those of at most TRAIN_DOCS distinct texts of TRAIN_BYTES together: half of the base
spans have their label hidden, worn copies of base spans (country code lost, brackets lost, "@" spelled out, groups joined)
are added with a hidden label, one beside the base span or two in place of it, and free candidates that repeat no base span count as none.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS, TRAIN_BYTES, TRAIN_STEPS = 2000, 8 << 20, 120
#: Messages have settled when none changes by more than this; damped rounds beyond the last one change nothing in practice.
MIN_BELIEF, SETTLED, ROUNDS, TRAIN_ROUNDS = 0.9, 1e-4, 200, 15

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # as from any start: a run of digits is taken whole or not at all
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, in order."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---------------------------------------------------------------- candidates and their features

AT = r"(?:@|\s?[\[(]\s?at\s?[\])]\s?)"
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{AT}[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++|[+(]{{0,2}}[0-9](?:[\x20().-]{{0,2}}[0-9]){{3,}}+")
SIZES = (4, 7, 9, 10, 12, 13, 16, 17, 20)
N_FEATURES = 14 + len(SIZES)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label) of base spans and of candidates that overlap none; label 0 is free, 1 to 4 the kinds."""
    out = [(s, e, k + 1) for s, k, e in base]
    ends = sorted((s, e) for s, _, e in base)
    i, reach = 0, 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while i < len(ends) and ends[i][0] < e:
            reach = max(reach, ends[i][1])
            i += 1
        if s >= reach:
            out.append((s, e, 0))
    return sorted(out)


def features(s: str, before: str, after: str) -> np.ndarray:
    x = np.zeros(N_FEATURES)
    d = _digits(s)
    x[0] = 1
    x[1], x[2] = "@" in s, " at" in s or "(at" in s or "[at" in s
    x[3], x[4] = s.count(".") == 3, s.count(".") == 3 and all(p.isdigit() and len(p) <= 3 for p in s.split("."))
    x[5], x[6], x[7], x[8] = s.startswith("+"), "(" in s, "-" in s, " " in s
    x[9] = len(d) == len(s)
    x[10] = 12 <= len(d) <= 19 and luhn(d)
    x[11] = any(c.isalpha() for c in s)
    x[12], x[13] = bool(before) and before[-1] in "\"'=#/:_", bool(after) and after[0].isalnum()
    for k, n in enumerate(SIZES):
        x[14 + k] = len(d) >= n
    return x


def keys(s: str) -> list[tuple]:
    """Candidates with one of these in common share a skip link."""
    d = _digits(s)
    name = re.split(AT, s.lower(), maxsplit=1)
    out: list[tuple] = [("n", name[0], name[1])] if len(name) == 2 else []
    if len(name) == 1 and len(d) >= 5:
        out += [("d", d), ("t", d[-7:])] if len(d) > 7 else [("d", d)] if len(d) < 7 else [("d", d), ("t", d)]
    return out


def spelled_at(raw: np.ndarray) -> np.ndarray:
    """Whether a bracket that may open an "@" spelled out stands at each byte: "at" follows it, after one space at most."""
    out = np.zeros(len(raw), bool)
    open_ = np.flatnonzero((raw == 40) | (raw == 91))
    wide = np.concatenate([raw, np.zeros(5, np.uint8)])
    for k in range(1, 5):  # a space has at most three bytes
        out[open_[(wide[open_ + k] == 97) & (wide[open_ + k + 1] == 116)]] = True
    return out


class Graph:
    """Candidates of many documents as one field: no link leaves its document."""

    def __init__(self, texts: list[str], spans: list[list[tuple[int, int, int]]]):
        x, self.label, self.where, chain, skip = [], [], [], [], []
        for t, (text, own) in enumerate(zip(texts, spans, strict=True)):
            last, seen = None, {}
            for s, e, label in own:
                i = len(x)
                x.append(features(text[s:e], text[max(0, s - 1) : s], text[e : e + 1]))
                self.label.append(label)
                self.where.append((t, s, e))
                if last is not None and s - self.where[last][2] <= 40:
                    chain.append((last, i))
                last = i
                for k in keys(text[s:e]):
                    if k in seen:
                        skip.append((seen[k], i, k[0] == "t"))
                    seen[k] = i
        self.x = np.array(x).reshape(-1, N_FEATURES)
        self.label = np.array(self.label, int)
        self.chain, self.skip = np.array(chain, int).reshape(-1, 2), np.array(skip, int).reshape(-1, 3)


def softmax(z: np.ndarray, dims: int = 1) -> np.ndarray:
    """Over the last one or two dimensions."""
    over = tuple(range(-dims, 0))
    z = np.exp(z - z.max(over, keepdims=True))
    return z / z.sum(over, keepdims=True)


class Field:
    """Weights: nodes (features x labels), chain and two kinds of skip links (labels x labels)."""

    def __init__(self):
        n = len(KINDS) + 1
        self.node, self.chain, self.skip = np.zeros((N_FEATURES, n)), np.zeros((n, n)), np.zeros((2, n, n))

    def infer(self, g: Graph, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """Beliefs of candidates, and of the ends of all links (chain links, then skip links), by loopy sum-product in
        parallel damped rounds; labels other than 0 are observed."""
        n = len(KINDS) + 1
        phi = g.x @ self.node
        phi -= phi.max(1, keepdims=True)
        seen = np.flatnonzero(g.label > 0)
        phi[seen] = np.where(np.eye(n)[g.label[seen]] > 0, 0, -50.0)
        a, b = np.concatenate([g.chain, g.skip[:, :2]]).T
        pair = np.concatenate([np.broadcast_to(self.chain, (len(g.chain), n, n)), self.skip[g.skip[:, 2]]])
        psi = np.exp(np.concatenate([pair, pair.transpose(0, 2, 1)]))
        src, dst, m = np.concatenate([a, b]), np.concatenate([b, a]), len(a)
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        log = np.zeros((2 * m, n))
        for _ in range(rounds if m else 0):
            total = phi.copy()
            np.add.at(total, dst, log)
            new = np.log(np.einsum("ei,eij->ej", softmax(total[src] - log[back]), psi))
            new = 0.5 * log + 0.5 * (new - new.max(1, keepdims=True))
            change = np.abs(new - log).max()
            log = new
            if change < SETTLED:
                break
        total = phi.copy()
        np.add.at(total, dst, log)
        # the pair of ends of a link: what each would be without the link, and the link
        ends = softmax((total[a] - log[m:])[:, :, None] + (total[b] - log[:m])[:, None, :] + pair, 2)
        return softmax(total), ends

    def beliefs(self, g: Graph) -> np.ndarray:
        return self.infer(g)[0]


def worn(s: str, kind: int, rng: random.Random) -> str:
    """A base span as careless writers repeat it."""
    if kind == 0:
        return s.replace("@", rng.choice([" (at) ", "[at]", " [at] ", "(at)"]))
    if kind == 3:
        s = re.sub(r"^\+[0-9]{1,3}[ .-]?", "", s) if rng.random() < 0.6 else s[1:]
        return re.sub(r"[ ().-]+", rng.choice(["", "-", "."]), s).strip("-.") if rng.random() < 0.5 else s
    if kind == 1:
        return s.replace(".", rng.choice(["-", " ", ""]))
    return rng.choice(["-", " "]).join(re.findall(r".{1,4}", _digits(s)))


FILLER = " which was written down by another hand further below "


def training_graph(texts: list[str], rng: random.Random) -> tuple[Graph, np.ndarray]:
    """Candidates of the texts and of worn copies of their base spans, some labels hidden, and the true labels."""
    new_texts, spans, gold = [], [], []
    for text in texts:
        own, known = candidates(text, base_spans(text)), set()
        for s, e, label in own:
            known |= set(keys(text[s:e])) if label else set()
        out, true = [], []
        for s, e, label in own:
            # some mentions are worn wherever they stand: two worn copies take the place of the base span
            alone = bool(label) and rng.random() < 0.25
            if not alone and (label or not known & set(keys(text[s:e]))):
                out.append((s, e, label if rng.random() < 0.5 else 0))
                true.append(label)
            w = worn(text[s:e], label - 1, rng) if label and (alone or rng.random() < 0.6) else ""
            for _ in range(2 if alone else bool(w)):
                text += FILLER if rng.random() < 0.7 else " and "
                out.append((len(text), len(text) + len(w), 0))
                true.append(label)
                text += w
        new_texts.append(text)
        order = sorted(range(len(out)), key=out.__getitem__)
        spans.append([out[i] for i in order])
        gold += [true[i] for i in order]
    return Graph(new_texts, spans), np.array(gold, int)


def train(texts: list[str], seed: int = 7, steps: int = TRAIN_STEPS) -> Field:
    """Gradient ascent on the likelihood of the hidden labels given the others."""
    field, n = Field(), len(KINDS) + 1
    g, gold = training_graph(texts, random.Random(seed))
    if not len(g.x):
        return field
    truth, hidden = np.eye(n)[gold], g.label == 0
    a, b = np.concatenate([g.chain, g.skip[:, :2]]).T
    kind = np.concatenate([np.full(len(g.chain), 2), g.skip[:, 2]])
    seen = truth[a][:, :, None] * truth[b][:, None, :]
    weights = [field.node, field.skip[0], field.skip[1], field.chain]
    square = [np.full(w.shape, 1e-6) for w in weights]
    for _ in range(steps):
        belief, ends = field.infer(g, TRAIN_ROUNDS)
        miss = seen - ends
        grads = [g.x[hidden].T @ (truth - belief)[hidden], *(miss[kind == k].sum(0) for k in range(3))]
        for k, (w, q, grad) in enumerate(zip(weights, square, grads, strict=True)):
            if k in (1, 2):  # repeats have no order
                grad = (grad + grad.T) / 2
            grad = grad / len(g.x) - 1e-4 * w
            q += grad * grad
            w += 0.5 * grad / np.sqrt(q)
    return field


def add_spans(texts: list[str], field: Field, min_belief: float = MIN_BELIEF):
    """For each text its base spans, and all spans with those that the field adds."""
    base = [base_spans(t) for t in texts]
    out = [list(b) for b in base]
    g = Graph(texts, [candidates(t, b) for t, b in zip(texts, base, strict=True)])
    if len(g.x):
        belief = field.beliefs(g)
        label = belief.argmax(1)
        for i in np.flatnonzero((g.label == 0) & (label > 0) & (belief.max(1) >= min_belief)).tolist():
            t, s, e = g.where[i]
            out[t].append((s, int(label[i]) - 1, e))
    return base, [sorted(x) for x in out]


def find_pii(docs: DataFrame, text_col: str = "text", train_docs: int = TRAIN_DOCS, min_belief: float = MIN_BELIEF, keep: list[str] | None = None) -> DataFrame:
    """(row, base, spans): each row of docs with its base spans and all spans, as arrays of (start, kind, end) structs in
    code points, by start, then kind (0 email, 1 ip, 2 card, 3 phone).

    Null and empty texts have none. Repeated rows give repeated results; other columns (those named in ``keep``, or all)
    pass through ``row``. Texts of any length are one document. The field is trained on at most ``train_docs`` distinct texts
    with a digit or "@" of ``TRAIN_BYTES`` together, those with the smallest hashes that fit.
    """
    spark = docs.sparkSession
    some = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike("@|[0-9]{4}|[0-9][.][0-9]"))
    sample = C.bounded_sample(some, train_docs, F.col("text"), max_bytes=TRAIN_BYTES).collect()
    field = spark.sparkContext.broadcast(train([r[0] for r in sample]))
    C.released()
    base = C.row_and_text(docs, text_col, keep)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def spans(x):
        return pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in y] for y in x], kind)

    def run(batches):
        for b in batches:
            for lo, hi, raw, offs in C.text_chunks(b.column(1)):
                # nearly all texts have neither "@", spelled out or not, nor a digit: they aren't decoded
                hit = np.concatenate([[0], np.cumsum((raw == 64) | ((raw >= 48) & (raw <= 57)) | spelled_at(raw))])
                some = np.flatnonzero(hit[offs[1:]] > hit[offs[:-1]]).tolist()
                data = raw.tobytes()
                first, all_ = [[] for _ in range(hi - lo)], [[] for _ in range(hi - lo)]
                for i, x, y in zip(some, *add_spans([data[offs[i] : offs[i + 1]].decode() for i in some], field.value, min_belief), strict=True):
                    first[i], all_[i] = x, y
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], spans(first), spans(all_)], ["row", "base", "spans"])

    item = "array<struct<start:int,kind:int,end:int>>"
    schema = T.StructType([base.schema["row"], T.StructField("base", T._parse_datatype_string(item)), T.StructField("spans", T._parse_datatype_string(item))])
    return C.map_batches(base, run, schema)


def op3_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are those of the base spans; ``spans`` has what the field adds too."""
    out = find_pii(C.documents(spark, sf_dir), keep=["doc_id"])
    names = F.array(*map(F.lit, KINDS))

    def joined(col):
        return F.array_join(F.transform(col, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("row.doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
