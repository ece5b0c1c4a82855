"""Language of words in code-switched text by a linear-chain conditional random field.

Every word gets scores per language from its affixes, its byte n-grams and a lexicon entry (all hashed into one weight
table); learned transitions tie neighbouring words. Forward-backward gives each word's posterior; a text's language is the
one with the largest mean posterior over its words, and that mean is its score. A chain runs through a whole text. It is
worked on in stretches of CHAIN words, so that one pass goes through many stretches in lockstep; what passes from stretch to
stretch is carried over exactly.

Training maximises the likelihood of label sequences by AdaGrad in numpy. It takes all words of at most TRAIN_DOCS distinct
labelled texts of at most TRAIN_BYTES together (of each label those with the smallest hashes, up to its equal share), in
sequences of CHAIN words, half of them joined from pieces of several documents, so that switches are seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

TABLE_BITS, CHAIN = 17, 64
TRAIN_DOCS, TRAIN_BYTES, EPOCHS, BATCH = 3000, 2 << 20, 4, 400
UNDETERMINED = "und"

LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


class Words:
    """The distinct words of a run of lower-cased texts with their features, and the sequence of words."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        start, end, self.row = C.split_words(raw, offs, LETTER)
        sums = C.prefix_hash(raw)
        self.start, self.end = start, end
        _, first, self.word = np.unique(C.span_hash(sums, start, end), return_index=True, return_inverse=True)
        s, e = start[first], end[first]
        self.n = len(first)
        size = e - s
        number = np.arange(self.n, dtype=np.int32)
        of = [number]
        value = [C.span_hash(sums, s, e) ^ np.uint64(1)]  # lexicon
        for k in (1, 2, 3):
            fits = np.flatnonzero(size >= k)
            of += [number[fits], number[fits]]  # affixes
            value += [C.span_hash(sums, s[fits], s[fits] + k) ^ np.uint64(2), C.span_hash(sums, e[fits] - k, e[fits]) ^ np.uint64(3)]
            count = np.maximum(size - k + 1, 0)
            at = np.repeat(s, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            of.append(np.repeat(number, count))
            value.append(C.span_hash(sums, at, at + k) ^ np.uint64(4))
        of = np.concatenate(of)
        index = (C.mix(np.concatenate(value)) >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
        order = np.argsort(of, kind="stable")
        self.index, self.cuts = index[order], np.searchsorted(of[order], number)

    def scores(self, table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[self.index], self.cuts, axis=0) if self.n else np.zeros((0, table.shape[1]))


def padded(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of sequences of n words: (number of the stretch of each word, place of the word in it)."""
    first = np.cumsum(n) - n
    pos = np.arange(n.sum()) - np.repeat(first, n)
    stretches = -(-n // CHAIN)
    return np.repeat(np.cumsum(stretches) - stretches, n) + pos // CHAIN, pos % CHAIN


def forward_backward(score: np.ndarray, length: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (stretch, place, label) and the expected transitions, summed. ``score`` is (stretch, place, label)."""
    m, t, n = score.shape
    phi = np.exp(score - score.max(-1, keepdims=True)) if m else score
    a = np.exp(trans - trans.max())
    on = np.arange(t)[None, :] < length[:, None]
    phi[~on] = 1
    alpha, beta = np.empty_like(phi), np.ones_like(phi)
    alpha[:, 0] = phi[:, 0] / phi[:, 0].sum(-1, keepdims=True)
    for k in range(1, t):
        x = (alpha[:, k - 1] @ a) * phi[:, k]
        alpha[:, k] = np.where(on[:, k, None], x / x.sum(-1, keepdims=True), alpha[:, k - 1])
    for k in range(t - 2, -1, -1):
        x = (phi[:, k + 1] * beta[:, k + 1]) @ a.T
        beta[:, k] = np.where(on[:, k + 1, None], x / x.sum(-1, keepdims=True), 1)
    gamma = alpha * beta
    gamma /= gamma.sum(-1, keepdims=True)
    pair = np.zeros((n, n))
    for k in range(t - 1):
        live = on[:, k + 1]
        xi = alpha[live, k][:, :, None] * a * (phi[live, k + 1] * beta[live, k + 1])[:, None, :]
        pair += (xi / xi.sum((1, 2), keepdims=True)).sum(0)
    return gamma, pair


def carried(phi: np.ndarray, on: np.ndarray, a: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What enters each stretch from the left (before the transition to its first word), and from the right (at its last
    word). ``phi`` is (place, stretch, label); a stretch that ``follows`` continues the one before it.

    The words of a stretch act on what enters it as one matrix; the matrices of all stretches are multiplied in lockstep,
    then texts are walked stretch by stretch, the first stretches of all texts together, then the second ones."""
    t, m, n = phi.shape
    left, right = np.ones((m, n), phi.dtype), np.ones((m, n), phi.dtype)
    more = follows.copy()
    more[:-1] |= follows[1:]  # stretches of texts that have several
    if not follows.any():
        return left, right
    some = np.flatnonzero(more)
    step = np.broadcast_to(np.eye(n, dtype=phi.dtype), (len(some), n, n)).copy()
    for k in range(t):
        x = step @ a if k else np.where(follows[some][:, None, None], step @ a, step)
        x = x * phi[k, some][:, None, :]
        step = np.where(on[k, some][:, :, None], x / x.sum((1, 2), keepdims=True), step)
    where = np.full(m, -1)
    where[some] = np.arange(len(some))
    begin = np.maximum.accumulate(np.where(follows, 0, np.arange(m)))
    depth = np.arange(m) - begin
    by = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[by], np.arange(depth.max() + 2))
    for k in range(1, depth.max() + 1):
        own = by[cuts[k] : cuts[k + 1]]
        x = np.einsum("sn,snm->sm", left[own - 1], step[where[own - 1]])
        left[own] = x / x.sum(1, keepdims=True)
    for k in range(depth.max(), 0, -1):
        own = by[cuts[k] : cuts[k + 1]]
        x = np.einsum("snm,sm->sn", step[where[own]], right[own])
        right[own - 1] = x / x.sum(1, keepdims=True)
    return left, right


def posteriors(score: np.ndarray, length: np.ndarray, trans: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Posteriors (stretch, place, label) of whole texts, whose stretches follow each other: those of one unbroken chain."""
    m, t, n = score.shape
    phi = np.exp(score - score.max(-1, keepdims=True)) if m else score
    a = np.exp(trans - trans.max())
    phi = np.ascontiguousarray(phi.transpose(1, 0, 2))
    on = (np.arange(t)[:, None] < length[None, :])[:, :, None]
    left, beta = carried(phi, on, a, follows)
    alpha = np.empty_like(phi)
    for k in range(t):
        if k == 0:
            x = np.where(follows[:, None], left @ a, 1) * phi[0]
        else:
            x = (alpha[k - 1] @ a) * phi[k]
        alpha[k] = x / x.sum(-1, keepdims=True)
    out = alpha
    for k in range(t - 1, -1, -1):
        if k < t - 1:
            x = (phi[k + 1] * beta) @ a.T
            beta = np.where(on[k + 1], x / x.sum(-1, keepdims=True), beta)
        g = alpha[k] * beta
        out[k] = g / g.sum(-1, keepdims=True)
    return out.transpose(1, 0, 2)


class Model:
    def __init__(self, labels: list[str]):
        self.labels = labels
        self.table = np.zeros((1 << TABLE_BITS, len(labels)), np.float32)
        self.trans = np.zeros((len(labels), len(labels)), np.float32)

    def word_posteriors(self, words: Words, rows: int) -> np.ndarray:
        """(word, label) posteriors in the order of the words of ``rows`` texts."""
        n = np.bincount(words.row, minlength=rows)
        stretch, place = padded(n)
        m = int(stretch[-1]) + 1 if len(stretch) else 0
        score = np.zeros((m, CHAIN, len(self.labels)), np.float32)
        score[stretch, place] = words.scores(self.table)[words.word]
        first = np.zeros(m, bool)
        first[stretch[np.flatnonzero(np.diff(words.row, prepend=-1))]] = True
        return posteriors(score, np.bincount(stretch, minlength=m), self.trans, ~first)[stretch, place]


def train(rows: list[tuple[str, str]], seed: int = 11) -> Model:
    """Fits a model to (text, label) rows."""
    model = Model(sorted({y for _, y in rows}))
    n_labels = len(model.labels)
    if not n_labels:
        return model
    rng = np.random.default_rng(seed)
    w = Words(*C.utf8(pc.utf8_lower(pa.array([t for t, _ in rows], pa.large_string()))))
    y_of = np.array([model.labels.index(y) for _, y in rows])
    cuts = np.searchsorted(w.row, np.arange(len(rows) + 1))
    docs = np.flatnonzero(np.diff(cuts))
    if not len(docs):
        return model
    # half of the stretches are whole pieces of one document, half are joined from two or three
    ids, labels = [], []
    for d in docs.tolist():
        for s in range(cuts[d], cuts[d + 1], CHAIN):
            word, label = w.word[s : min(s + CHAIN, cuts[d + 1])], y_of[d]
            if rng.random() < 0.5 and len(word) > 8:
                parts, kinds, at = [], [], 0
                for size in np.diff(np.sort(np.concatenate([[0, len(word)], rng.integers(1, len(word), rng.integers(1, 3))]))).tolist():
                    e = d if rng.random() < 0.4 else docs[rng.integers(len(docs))]
                    k = rng.integers(cuts[e], cuts[e + 1])
                    part = w.word[k : min(k + size, cuts[e + 1])]
                    parts.append(part)
                    kinds.append(np.full(len(part), y_of[e]))
                    at += len(part)
                word, label = np.concatenate(parts), np.concatenate(kinds)
            ids.append(word)
            labels.append(np.broadcast_to(label, len(word)))
    length = np.array([len(x) for x in ids])
    square_t, square_w = np.full_like(model.trans, 1e-2), np.full((1 << TABLE_BITS, n_labels), 1e-2, np.float32)
    # a stretch has few of all words: the features of its own words are gathered by place
    ends = np.append(w.cuts[1:], len(w.index))
    for epoch in range(EPOCHS):
        order = rng.permutation(len(ids))
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            n = length[part]
            word, y = np.concatenate([ids[i] for i in part]), np.concatenate([labels[i] for i in part])
            own, inverse = np.unique(word, return_inverse=True)
            count = ends[own] - w.cuts[own]
            feat = w.index[np.repeat(w.cuts[own], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            first = np.cumsum(count) - count
            score = np.zeros((len(part), CHAIN, n_labels), np.float32)
            stretch, place = np.repeat(np.arange(len(part)), n), np.concatenate([np.arange(k) for k in n])
            score[stretch, place] = np.add.reduceat(model.table[feat], first, axis=0)[inverse]
            gamma, pair = forward_backward(score, n, model.trans)
            res = np.eye(n_labels)[y] - gamma[stretch, place]
            by_word = np.stack([np.bincount(inverse, res[:, k], len(own)) for k in range(n_labels)], 1)
            grad = np.stack([np.bincount(feat, np.repeat(by_word[:, k], count), 1 << TABLE_BITS) for k in range(n_labels)], 1) / len(part)
            hit = np.flatnonzero(np.abs(grad).sum(1))
            g = grad[hit].astype(np.float32)
            square_w[hit] += g * g
            model.table[hit] += 0.15 * g / np.sqrt(square_w[hit])
            seen = np.zeros((n_labels, n_labels))
            inner = place[1:] > 0
            np.add.at(seen, (y[:-1][inner], y[1:][inner]), 1)
            g = ((seen - pair) / len(part) - 1e-3 * model.trans).astype(np.float32)
            square_t += g * g
            model.trans += 0.15 * g / np.sqrt(square_t)
    return model


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Model:
    """Trains on at most ``train_docs`` distinct whole texts, with an equal share for each label, of ``train_bytes`` at most in
    all: texts that don't fit are left out, none is cut. Rows without text or label aren't used; repeated texts count once."""
    some = labelled.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{label_col}`").cast("string").alias("label")).where("text IS NOT NULL AND label IS NOT NULL")
    model = train([tuple(r) for r in C.bounded_sample(some, train_docs, F.col("text"), F.col("label"), train_bytes).collect()])
    C.released()
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", with_words: bool = False, keep: list[str] | None = None) -> DataFrame:
    """(row, lang_pred, score, certainty[, words]): each row of docs with its language and score, and on request all words with
    theirs. The score is the share of the language in the text; the certainty is the mean, over words, of the posterior of each
    word's own best label, so that text in several languages may be as certain as text in one.

    Null texts and those without a letter are ``und`` with score and certainty 0; so are all where nothing was learned. Texts
    of any length are one chain; repeated rows give repeated results. Other columns pass through ``row`` (those named in
    ``keep``, or all), and take no part.
    """
    base = C.row_and_text(docs, text_col, keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            for lo, hi, raw, offs in C.text_chunks(pc.utf8_lower(b.column(1))):
                rows = hi - lo
                words = Words(raw, offs)
                pred, score, certainty = [UNDETERMINED] * rows, np.zeros(rows), np.zeros(rows)
                post = np.zeros((len(words.row), 1))
                if m.labels and len(words.row):
                    post = m.word_posteriors(words, rows)
                    n = np.bincount(words.row, minlength=rows)
                    mean = np.stack([np.bincount(words.row, post[:, k], rows) for k in range(len(m.labels))], 1) / np.maximum(n, 1)[:, None]
                    best = np.bincount(words.row, post.max(1), rows) / np.maximum(n, 1)
                    ascii_ = np.concatenate([[0], np.cumsum((raw >= 97) & (raw <= 122))])
                    sure = ascii_[offs[1:]] > ascii_[offs[:-1]]
                    for i in np.flatnonzero(n).tolist():
                        if sure[i] or any(c.isalpha() for c in raw[offs[i] : offs[i + 1]].tobytes().decode()):
                            k = int(mean[i].argmax())
                            pred[i], score[i], certainty[i] = m.labels[k], min(float(mean[i, k]), 1.0), min(float(best[i]), 1.0)
                out = [b.column(0)[lo:hi], pa.array(pred), pa.array(score), pa.array(certainty)]
                if with_words:
                    data = raw.tobytes()
                    lists: list[list] = [[] for _ in range(rows)]
                    for s, e, r, p in zip(words.start.tolist(), words.end.tolist(), words.row.tolist(), post.argmax(1).tolist(), strict=True):
                        if m.labels:
                            lists[r].append({"word": data[s:e].decode(), "lang": m.labels[p]})
                    out.append(pa.array(lists, pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(out, ["row", "lang_pred", "score", "certainty", "words"][: len(out)])

    fields = [base.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("certainty", T.DoubleType())]
    if with_words:
        fields.append(T.StructField("words", T._parse_datatype_string("array<struct<word:string,lang:string>>")))
    return C.map_batches(base, run, T.StructType(fields))


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1


def op2_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    out = predict(docs, model, keep=["doc_id"])
    return out.select("row.doc_id", F.coalesce(held_out("row.doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")
