import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa

from lumarium.llm import common as C
from lumarium.llm import masked_lm as M


def test_probabilities_sum_to_one_and_gradient_helps():
    rng = np.random.default_rng(0)
    net = M.Network()
    context = rng.integers(0, M.VOCAB + 1, (1, 2 * M.WINDOW))
    total = np.exp(net.log_probabilities(np.arange(M.VOCAB), np.repeat(context, M.VOCAB, 0))).sum()
    assert abs(total - 1) < 1e-4
    ids = rng.integers(0, 50, 4000)
    around = M.contexts(ids, np.zeros(len(ids), int))
    before = net.log_probabilities(ids, around).mean()
    for _ in range(60):
        net.step(ids, around, M.RATE)
    assert net.log_probabilities(ids, around).mean() > before + 1


def test_contexts_stay_in_their_text():
    c = M.contexts(np.array([5, 6, 7, 8]), np.array([0, 0, 0, 1]))
    e = M.EDGE
    assert c.tolist() == [[e, e, 6, 7], [5, e, 7, e], [6, 5, e, e], [e, e, e, e]]


def test_shuffled_texts_score_lower(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rng = random.Random(0)
    rows = [(r.doc_id, r.text) for r in docs.where("length(text) BETWEEN 500 AND 4000").collect()][:200]
    model = M.train(docs)
    odd = [(-1 - i, "".join(rng.sample(t, len(t)))) for i, t in rows] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "?!"), (10**6 + 3, "the " * 60_000)]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows + odd], "doc_id long, text string, n_tokens string")
    got = {r.row.doc_id: r for r in M.score(df, model).collect()}
    mean = {i: r.log_likelihood / r.n_tokens for i, r in got.items() if r.n_tokens}
    assert np.mean([mean[i] > mean[-1 - i] for i, _ in rows]) > 0.95
    assert all(got[10**6 + k].n_tokens == 0 and got[10**6 + k].log_likelihood == 0 for k in range(3)) and got[10**6 + 3].n_tokens == 60_000
    # of the sum, the brute force over one text
    v, net = model
    text = rows[0][1]
    ids, row, spelled = v.ids(*C.utf8(pa.array([text])))
    logs = [net.log_probabilities(ids[k : k + 1], M.contexts(ids, row)[k : k + 1])[0] for k in range(len(ids))]
    assert abs(sum(logs) + sum(spelled) - got[rows[0][0]].log_likelihood) < 1e-2
    assert M.score(df.limit(0), model).count() == 0
    M.train(docs.limit(0))


def test_vocabulary_is_the_most_frequent(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("text")
    import re
    from collections import Counter

    count = Counter(w for r in docs.collect() for w in re.findall(rb"[0-9a-z\x80-\xff]+", r.text.encode().lower()))
    v = M.count_words(docs, 50)
    floor = sorted(count.values(), reverse=True)[49]
    raw, offs = C.utf8(pa.array([w.decode() for w, n in count.items() if n > floor]))
    ids, _, _ = v.ids(raw, offs)
    assert (ids < 50).all()


def test_every_token_is_a_target_once(monkeypatch):
    row = np.array([0, 0, 0, 2, 3, 3, 3, 3])
    assert sorted(np.concatenate([M.targets(row, k, 3) for k in range(3)]).tolist()) == list(range(8))
    assert not len(M.targets(row[:0], 0, 2))
    # over some texts, whatever the rounds, the steps see each token once
    texts, seen = [np.arange(501, dtype=np.uint16), np.array([600], np.uint16), np.arange(700, 900, dtype=np.uint16)], []
    monkeypatch.setattr(M.Network, "step", lambda self, ids, context, rate: seen.extend(ids.tolist()))
    for rounds in (1, 2, 4):
        seen.clear()
        for k in range(rounds):
            M.train_shard(M.Network(), texts, 0.1, k, rounds, 5)
        assert sorted(seen) == sorted(np.concatenate(texts).tolist())


def test_scores_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(M, "FAN_IN", 3)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    out = []
    for n in (1, 4, 211):
        dealt = docs.repartition(n)
        model = M.train(dealt, shard_bytes=40_000)
        out.append({r[0]: (r[1], r[2]) for r in M.score(dealt, model).select("row.doc_id", "n_tokens", "log_likelihood").collect()})
    assert len(out[0]) == docs.count()
    for other in out[1:]:
        assert all(other[i][0] == x and abs(other[i][1] - y) <= 1e-9 * abs(y) for i, (x, y) in out[0].items())


def brute_hidden(net, context):
    return np.append(np.tanh(sum(net.inner[k][c].astype(float) for k, c in enumerate(context))), 1.0)


def brute_log(net, token, context):
    h = brute_hidden(net, context)
    p = [np.exp(h @ net.group[:, g]) for g in range(M.GROUPS)]
    q = [np.exp(h @ net.member[token % M.GROUPS][:, m]) for m in range(M.GROUP_SIZE)]
    return np.log(p[token % M.GROUPS] / sum(p)) + np.log(q[token // M.GROUPS] / sum(q))


def test_one_step_and_one_text_by_brute_force():
    rng = np.random.default_rng(8)
    ids = np.array([3, 700, 3, 51, 3 + M.GROUPS, 9, 3])
    around = M.contexts(ids, np.zeros(len(ids), int))
    net, n = M.Network(1), len(ids)
    for part in net.parts():
        part += rng.normal(size=part.shape).astype(np.float32) * 0.3
    net = M.Network().set_parts(net.parts())
    assert np.allclose(net.log_probabilities(ids, around), [brute_log(net, i, c) for i, c in zip(ids.tolist(), around.tolist())], atol=1e-4)
    new = M.Network().set_parts([p.copy() for p in net.parts()])
    new.step(ids, around, 0.2)
    # each weight moves by the slope of the sum of log probabilities, which a small change of it shows, times its rate
    for part, at, scale in ((0, (3, 5), None), (1, (700, 2), None), (2, (9, 30), None), (3, (M.EDGE, 4), None), (4, (7, 3), 1), (4, (M.HIDDEN, 3), 1), (5 + 3, (2, 0), 4), (5 + 9, (6, 0), 4), (5 + 3, (M.HIDDEN, 1), 4)):
        slope = []
        for e in (1e-2, -1e-2):
            moved = M.Network().set_parts([p.copy() for p in net.parts()])
            moved.parts()[part][at] += e
            slope.append(sum(brute_log(moved, i, c) for i, c in zip(ids.tolist(), around.tolist())))
        want = (slope[0] - slope[1]) / 2e-2
        rate = 0.2 / n * scale if scale else 0.2 * 4 / np.sqrt(n) / np.sqrt(max((around[:, part] == at[0]).sum(), 1))
        assert abs((new.parts()[part][at] - net.parts()[part][at]) - rate * want) < 1e-3 + 0.01 * abs(rate * want)


def test_invented_words_score_lower_than_rare_ones(spark):
    docs = spark.createDataFrame([(f"the banner of the cabin stands near {w}ing harbour {w}er",) for w in ("sail", "float", "wander", "linger", "rest", "paint", "bring")] * 30, "text string")
    v = M.count_words(docs, 6)
    ids, _, spelled = v.ids(*C.utf8(pa.array(["the lingering qzxjkqvwx"])))
    assert spelled[0] == 0 or ids[0] >= M.VOCAB - M.OTHER
    assert spelled[2] < spelled[1] - 10 < 0


def plain_step(net, ids, context, rate):
    """The step by one operation after the other, for each group and place of its own."""

    def softmax(z):
        z = np.exp(z - z.max(-1, keepdims=True))
        return z / z.sum(-1, keepdims=True)

    n, k = len(ids), 2 * M.WINDOW
    order = np.argsort(ids % M.GROUPS, kind="stable")
    group, member, context = ids[order] % M.GROUPS, ids[order] // M.GROUPS, context[order]
    h = np.ones((n, M.HIDDEN + 1), np.float32)
    h[:, : M.HIDDEN] = np.tanh(sum(net.inner[j][context[:, j]] for j in range(k)))
    err = -softmax(h @ net.group)
    err[np.arange(n), group] += 1
    back = err @ net.group.T
    cuts = np.searchsorted(group, np.arange(M.GROUPS + 1))
    for g in range(M.GROUPS):
        a, b = cuts[g], cuts[g + 1]
        e = -softmax(h[a:b] @ net.member[g]) if a < b else np.zeros((0, M.GROUP_SIZE), np.float32)
        e[np.arange(b - a), member[a:b]] += 1
        back[a:b] += e @ net.member[g].T
        net.member[g] += rate * 4 / n * (h[a:b].T @ e)
    net.group += rate / n * (h.T @ err)
    d = back[:, : M.HIDDEN] * (1 - h[:, : M.HIDDEN] ** 2)
    for j in range(k):
        o = np.argsort(context[:, j].astype(np.uint16), kind="stable")
        c = context[o, j]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        net.inner[j][c[first]] += rate * np.add.reduceat(d[o], first, axis=0) / np.sqrt(np.diff(np.append(first, n)))[:, None] / np.sqrt(n) * 4


def test_a_step_is_the_plain_one_in_less_time(spark):
    often = 1 / np.arange(1, M.VOCAB + 2)

    def run(batches):
        # in a worker, where products take one thread
        list(batches)
        C.roomy()
        rng = np.random.default_rng(4)
        nets, took = (M.Network(), M.Network()), ([], [])
        for n in (*[M.BATCH] * 12, 37, 2, 1):
            ids = rng.choice(M.VOCAB, n, p=often[:-1] / often[:-1].sum())
            around = rng.choice(M.VOCAB + 1, (n, 2 * M.WINDOW), p=often / often.sum())
            for net, step, t in zip(nets, (M.Network.step, plain_step), took, strict=True):
                began = time.process_time()
                step(net, ids, around, M.RATE)
                t.append(time.process_time() - began)
        off = max(float(abs(x - y).max()) for x, y in zip(*(net.parts() for net in nets), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([off]), *(pa.array([min(t[:12])]) for t in took)], ["off", "fast", "plain"])

    r = spark.range(1).repartition(1).mapInArrow(run, "off double, fast double, plain double").first()
    assert r.off < 1e-4
    assert r.fast < 0.85 * r.plain, r


def test_sums_of_runs():
    rng = np.random.default_rng(6)
    for lengths in ([1], [2], [5], [1, 1, 1], [1, 4096, 3, 900, 1], rng.integers(1, 9, 500), rng.zipf(1.5, 300).clip(1, 2000)):
        count = np.array(lengths)
        x = rng.normal(size=(count.sum(), 3))
        at = rng.permutation(len(x))
        order, got = M.run_sums(x, at, count)
        assert sorted(order) == list(range(len(count)))
        assert np.allclose(got, np.add.reduceat(x[at], np.cumsum(count) - count, axis=0)[order])


def test_a_task_sends_a_word_once(monkeypatch):
    # texts of more than 4 MB together, in two batches
    texts = ["Some words, some more. " * 100_000, "more of it " * 300_000, None, "", "it"]
    batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.string())], ["text"]) for t in (texts[:2], texts[2:])]
    count = Counter(w for t in texts if t for w in t.lower().replace(",", "").replace(".", "").split())
    hashes = {int(h): w for w in count for h in C.word_hashes(*C.utf8(pa.array([w])), M.WORD)[0].view(np.int64)}
    for held in (1 << 30, 1000):
        monkeypatch.setattr(M, "COUNTED", held)
        rows = [r for b in M.counted(iter(batches)) for r in b.to_pylist()]
        words = Counter()
        for r in rows:
            if r["kind"] == 0:
                words[hashes[r["word"]]] += r["n"]
        assert words == count
        assert held == 1000 or sum(r["kind"] == 0 for r in rows) == len(count)
        # each letter once as the second of its pair, and each border after a word
        assert sum(r["n"] for r in rows if r["kind"] == 1) == sum((len(w) + 1) * n for w, n in count.items())
