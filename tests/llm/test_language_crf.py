import itertools

import numpy as np
from pyspark.sql import functions as F

from lumarium.llm import language_crf as L


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    score, trans = rng.normal(size=(3, 5, 3)), rng.normal(size=(3, 3))
    length = np.array([5, 1, 3])
    gamma, pair = L.forward_backward(score.copy(), length, trans)
    also = L.posteriors(score.copy(), length, trans, np.zeros(3, bool))
    want_pair = np.zeros((3, 3))
    for s in range(3):
        n = length[s]
        mass, total = np.zeros((n, 3)), 0
        for path in itertools.product(range(3), repeat=n):
            w = np.exp(sum(score[s, k, y] for k, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            total += w
            for k, y in enumerate(path):
                mass[k, y] += w
        assert np.allclose(gamma[s, :n], mass / total) and np.allclose(also[s, :n], mass / total)
        for path in itertools.product(range(3), repeat=n):
            w = np.exp(sum(score[s, k, y] for k, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            for a, b in zip(path, path[1:]):
                want_pair[a, b] += w / total
    assert np.allclose(pair, want_pair)


def test_stretches_are_one_chain():
    rng = np.random.default_rng(3)
    n_words, trans = np.array([1, L.CHAIN, L.CHAIN + 1, 0, 5 * L.CHAIN + 7, 30]), rng.normal(size=(4, 4)) * 2
    model = L.Model(list("abcd"))
    model.trans, model.table = trans, None
    scores = [rng.normal(size=(n, 4)) for n in n_words]

    class Words:
        row, word = np.repeat(np.arange(len(n_words)), n_words), np.arange(n_words.sum())

        def scores(self, table):
            return np.concatenate(scores)

    got = model.word_posteriors(Words(), len(n_words))
    whole = [L.forward_backward(s[None], np.array([len(s)]), trans)[0][0] for s in scores if len(s)]
    assert np.allclose(got, np.concatenate(whole), atol=1e-5)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    rows = L.op2_language_crf(spark, d).collect()
    assert len(rows) == len(truth)
    test = [r for r in rows if r.held_out]
    right = [r.lang_pred == truth[r.doc_id] for r in test]
    assert 0.25 < len(test) / len(rows) < 0.4 and np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_switching_and_edges(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = L.fit(docs)
    pick = {r.lang: r.text.split() for r in docs.where("length(text) > 2000 AND doc_id % 3 = 0").collect()}
    text = " ".join(pick["en"][:30] + pick["de"][:30] + pick["en"][30:50])
    rows = [(1, text), (2, None), (3, ""), (4, "123 456 !?"), (5, "– …"), (6, "é"), (7, " ".join(pick["fr"] * 40)), (8, "IN THE OF AND TO " * 9)]
    df = spark.createDataFrame([(i, t, "xx", 0.5) for i, t in rows], "doc_id long, text string, lang_pred string, score double")
    got = {r.row.doc_id: r for r in L.predict(df, model, with_words=True).collect()}
    labels = [w.lang for w in got[1].words]
    n = len(labels)
    assert labels[: n // 4].count("en") > 0.9 * (n // 4) and labels[int(n * 0.45) : int(n * 0.7)].count("de") > 0.8 * (n * 0.25)
    assert [got[i].lang_pred for i in (2, 3, 4, 5)] == ["und"] * 4 and [got[i].score for i in (2, 3, 4, 5)] == [0.0] * 4
    assert got[6].lang_pred in model.labels and got[7].lang_pred == "fr" and got[8].lang_pred == "en"
    assert L.predict(df.limit(0), model).count() == 0
    none = L.fit(docs.limit(0))
    assert {r.lang_pred for r in L.predict(df, none, with_words=True).collect()} == {"und"}


def test_copies_leave_room_for_all_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars < 4000").select("text", "lang")
    first = docs.orderBy(F.xxhash64("text").asc()).first()
    rare = spark.createDataFrame([("zhuq woqx qaxu vezq " * 5, "rare")], docs.schema)
    rows = docs.union(spark.createDataFrame([tuple(first)] * 5000, docs.schema)).union(rare)
    model = L.fit(rows)
    assert model.labels == sorted({r.lang for r in docs.collect()} | {"rare"})
    got = L.predict(docs, model).select("row.lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
