"""Masked pseudo-likelihood scores from a bidirectional window network.

Every token of a text is predicted from the WINDOW tokens on either side of it; the sum of the conditional log
probabilities is the text's pseudo-log-likelihood. Tokens are words: the most frequent ones of the whole corpus, and hash
classes by word ending for the others. The network adds one vector per neighbour and place, applies tanh, and predicts a
group of tokens, then the token within it (two small softmaxes instead of a large one). A word without an id of its own is
also spelled out, by the corpus counts of pairs of letters, so that an invented word scores lower than a rare one.

Training is by parameter averaging. Texts are encoded once and dealt to virtual shards by their hash, copies of one text in
parts that go to different shards; the number of shards follows from the bytes of the corpus. In each round stochastic
gradient descent in numpy runs over each shard, in the order of hashes, from the common weights of the round before, and the
weights of all shards are averaged by their tokens, some shards at a time. So the model depends on the texts alone and not on how rows are dealt to tasks. Rounds share the tokens
of every text by their place in it, so each token is a target once, with its whole context. What is gathered (word counts of
each task, then weights of each shard) grows with the corpus; the model has a fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

GROUPS, GROUP_SIZE, OTHER = 40, 40, 96
VOCAB = GROUPS * GROUP_SIZE
HIDDEN, WINDOW = 32, 2
ROUNDS, BATCH, RATE = 2, 4096, 0.2
#: Bytes of text of a shard, tokens that are shuffled together in training, and shards whose weights meet in one task.
SHARD_BYTES, BLOCK_TOKENS, FAN_IN = 16 << 20, 1 << 16, 64
#: Copies of one text that go to one shard together, and tasks of a round at most (a task takes one shard after the other).
COPIES, TASKS = 16, 1 << 14
#: Rows of a run that are added to those of other runs at once.
LEVELS = 16
#: Words that a task holds before it sends their counts.
COUNTED = 1 << 20
#: Upper bits of a hash by which words are looked up.
UPPER = 16
#: Letters: the bytes, and the border of a word.
LETTERS = 257
#: The token beyond either end of a text.
EDGE = VOCAB
WORD = C.is_alnum()


class Vocabulary:
    """Ids of words by hash: the most frequent ones have their own, others one of OTHER classes by their last two bytes.
    ``letters`` counts pairs of letters, by the first one."""

    def __init__(self, hashes: list[int], letters: np.ndarray):
        h = np.array(hashes, np.int64).view(np.uint64)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        # where the hashes with some upper bits start, and how many share them at most
        self.first = np.searchsorted(self.hashes, np.arange(1 << UPPER, dtype=np.uint64) << np.uint64(64 - UPPER))
        self.shared = int(np.diff(np.append(self.first, len(h))).max())
        self.spelling = np.log((letters + 0.1) / (letters + 0.1).sum(1, keepdims=True)).reshape(-1)

    def ids(self, raw: np.ndarray, offs: np.ndarray, spell: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Id, row and spelling of each word: the log probability of its letters, 0 for words with an id of their own. Training
        needs no spelling."""
        low = C.LOWER[raw]
        start, end, row = C.split_words(low, offs, WORD)
        h = C.span_hash(C.prefix_hash(low), start, end)
        other = low[end - 1].astype(np.int64) * 7 + low[np.maximum(end - 2, start)].astype(np.int64) * 31
        out = VOCAB - OTHER + other % OTHER
        first = self.first.take((h >> np.uint64(64 - UPPER)).astype(np.int64))
        for k in range(self.shared):
            at = np.minimum(first + k, len(self.hashes) - 1)
            found = np.flatnonzero(self.hashes.take(at) == h)
            out[found] = self.order[at[found]]
        if not spell:
            return out, row, None
        steps = np.zeros(len(low) + 1)
        np.cumsum(self.spelling[letter_pairs(low, start)], out=steps[1:])
        # up to each letter from the one before it, and from the last one to the border
        spelled = steps[end] - steps[start] + self.spelling[low[end - 1].astype(np.int64) * LETTERS + 256]
        return out, row, np.where(out < VOCAB - OTHER, 0, spelled)


def letter_pairs(low: np.ndarray, start: np.ndarray) -> np.ndarray:
    """At each byte, the pair of it and the byte before, which is the border where a word starts."""
    before = np.zeros(len(low), np.int64)
    before[1:] = low[:-1]
    before[start] = 256
    return before * LETTERS + low


def counted(batches):
    """(kind, word, n) of a task: its counts of distinct words (kind 0), once for each COUNTED of them, and of pairs of letters
    (kind 1). Texts are cut into words in short runs, whose arrays are cheap to make."""
    pairs, held, size = np.zeros(LETTERS * LETTERS, np.int64), [], 0

    def rows(kind, key, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n.astype(np.int64))], ["kind", "word", "n"])

    def words():
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return rows(0, h.view(np.int64), n)

    for b in batches:
        for _, _, raw, offs in C.text_chunks(b.column(0)):
            low = C.LOWER[raw]
            start, end, _ = C.split_words(low, offs, WORD)
            pairs += np.bincount(letter_pairs(low, start)[WORD[low]], minlength=len(pairs))
            pairs += np.bincount(low[end - 1].astype(np.int64) * LETTERS + 256, minlength=len(pairs))
            held.append(C.span_hash(C.prefix_hash(low), start, end))
            size += len(start)
            if size >= COUNTED:
                yield words()
                held, size = [], 0
    if held:
        yield words()
    some = np.flatnonzero(pairs)
    yield rows(1, some, pairs[some])


def count_words(docs: DataFrame, top: int) -> Vocabulary:
    """The ``top`` words of the whole corpus by count, then hash, and its pairs of letters."""
    counts = C.written(C.map_batches(docs, counted, "kind int, word long, n long").groupBy("kind", "word").agg(F.sum("n").alias("n")))
    letters = np.zeros(LETTERS * LETTERS)
    for r in counts.where("kind = 1").collect():
        letters[r.word] = r.n
    words = [r[0] for r in counts.where("kind = 0").orderBy(F.desc("n"), "word").limit(top).select("word").collect()]
    C.dropped(counts)
    return Vocabulary(words, letters.reshape(LETTERS, LETTERS))


def contexts(ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(token, place): neighbours to the left, nearest first, then to the right; EDGE where the text ends."""
    n = len(ids)
    out = np.full((n, 2 * WINDOW), EDGE)
    for k in range(1, WINDOW + 1):
        same = row[k:] == row[:-k]
        out[k:, k - 1] = np.where(same, ids[:-k], EDGE)
        out[: n - k, WINDOW + k - 1] = np.where(same, ids[k:], EDGE)
    return out


def targets(row: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Tokens that round k trains on: those whose place in their text is k modulo the rounds. How the texts are dealt and
    ordered plays no part, so over all rounds each token comes once."""
    at = np.arange(len(row))
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else at
    place = at - np.repeat(first, np.diff(np.append(first, len(row))))
    return np.flatnonzero(place % rounds == k)


def softmax(z: np.ndarray) -> np.ndarray:
    """Probabilities of the columns of z, in its place. A row of z is one choice for all tokens, so that each step here is one
    pass over whole rows."""
    z -= z.max(0)
    np.exp(z, out=z)
    z /= z.sum(0)
    return z


def log_chosen(z: np.ndarray, row) -> np.ndarray:
    """The log probability of one row of z in each column, in double precision; z is used up."""
    z -= z.max(0)
    own = z[row, np.arange(z.shape[1])].astype(float)
    return own - np.log(np.exp(z, out=z).sum(0, dtype=float))


def sorted_by(small: np.ndarray) -> np.ndarray:
    """Stable order of numbers below 65,536, which are sorted by their bytes."""
    return np.argsort(small.astype(np.uint16), kind="stable")


def run_sums(x: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of runs, from long to short, and their sums in it. ``at`` names the rows of x run after run, ``count`` of them for
    each, at least one. The first rows of all runs are added at once, then the second ones and so on; only what is left of long
    runs is summed run by run."""
    order = np.argsort(-count, kind="stable")
    first, count = (np.cumsum(count) - count)[order], count[order]
    out = x.take(at[first], 0)
    for k in range(1, LEVELS + 1):
        n = int(np.searchsorted(-count, -k))
        if not n:
            break
        if k < LEVELS:
            out[:n] += x.take(at[first[:n] + k], 0)
        else:
            left = count[:n] - k
            out[:n] += np.add.reduceat(x.take(at[C.ranges(first[:n] + k, left)], 0), np.cumsum(left) - left, axis=0)
    return order, out


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.inner = (rng.normal(size=(2 * WINDOW, VOCAB + 1, HIDDEN)) * 0.1).astype(np.float32)
        self.group = (rng.normal(size=(HIDDEN + 1, GROUPS)) * 0.1).astype(np.float32)
        self.member = (rng.normal(size=(GROUPS, HIDDEN + 1, GROUP_SIZE)) * 0.1).astype(np.float32)

    def parts(self) -> list[np.ndarray]:
        return [*self.inner, self.group, *self.member]

    def set_parts(self, parts: list[np.ndarray]) -> Network:
        k = 2 * WINDOW
        self.inner, self.group, self.member = np.stack(parts[:k]), parts[k], np.stack(parts[k + 1 :])
        return self

    def heads(self) -> np.ndarray:
        """Weights of each group for both choices, that of a group and that of its members, side by side."""
        return np.concatenate([np.broadcast_to(self.group, (GROUPS, *self.group.shape)), self.member], 2)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        x = self.inner[0].take(context[:, 0], 0)
        for k in range(1, 2 * WINDOW):
            x += self.inner[k].take(context[:, k], 0)
        h = np.ones((len(context), HIDDEN + 1), np.float32)
        h[:, :HIDDEN] = np.tanh(x, out=x)
        return h

    def log_probabilities(self, ids: np.ndarray, context: np.ndarray) -> np.ndarray:
        """log p(token | both sides) for each token. Products are summed in double precision, since a float sum depends on how
        many tokens are multiplied at once, and that on how rows are dealt."""
        out = np.empty(len(ids))
        heads = self.heads().astype(float)
        # tokens of one group together, so that each group is one matrix product
        group, member = ids % GROUPS, ids // GROUPS
        order = sorted_by(group)
        cuts = np.searchsorted(group[order], np.arange(GROUPS + 1))
        for g in range(GROUPS):
            at = order[cuts[g] : cuts[g + 1]]
            for lo in range(0, len(at), 2048):
                part = at[lo : lo + 2048]
                z = (heads[g].T @ self.hidden(context.take(part, 0)).astype(float).T).astype(np.float32)
                out[part] = log_chosen(z[:GROUPS], g) + log_chosen(z[GROUPS:], member[part])
        return out

    def step(self, ids: np.ndarray, context: np.ndarray, rate: float) -> None:
        """One step of gradient ascent on the mean log probability."""
        n, group, member = len(ids), ids % GROUPS, ids // GROUPS
        order = sorted_by(group)
        group, member, context = group[order], member[order], context.take(order, 0)
        h, heads = self.hidden(context), self.heads()
        cuts = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        # the choices of all tokens, a column each: first scores, then probabilities less what was chosen
        z = np.empty((GROUPS + GROUP_SIZE, n), np.float32)
        for g, (a, b) in enumerate(zip(cuts, cuts[1:])):
            np.matmul(heads[g].T, h[a:b].T, out=z[:, a:b])
        for part, chosen in ((z[:GROUPS], group), (z[GROUPS:], member)):
            softmax(part)[chosen, np.arange(n)] -= 1
        back, slope = np.empty((n, HIDDEN), np.float32), np.empty_like(heads)
        for g, (a, b) in enumerate(zip(cuts, cuts[1:])):
            np.matmul(z[:, a:b].T, heads[g, :HIDDEN].T, out=back[a:b])
            np.matmul(h[a:b].T, z[:, a:b].T, out=slope[g])
        self.member -= rate * 4 / n * slope[:, :, GROUPS:]
        self.group -= rate / n * slope[:, :, :GROUPS].sum(0)
        back *= 1 - h[:, :HIDDEN] ** 2
        # the neighbours of all places at once
        key = (context + np.arange(2 * WINDOW) * (VOCAB + 1)).reshape(-1)
        order = sorted_by(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(first, len(key)))
        # two columns are summed as one complex number, in half the loops
        run, total = run_sums(back.view(np.complex64), order // (2 * WINDOW), count)
        # frequent neighbours move by their mean, rare ones less
        move = (rate * 4 / np.sqrt(n * count[run])).astype(np.float32)[:, None]
        at, inner = key[first[run]], self.inner.reshape(-1, HIDDEN)
        inner[at] = inner.take(at, 0) - move * total.view(np.float32)


def train_shard(network: Network, texts: list[np.ndarray], rate: float, k: int, rounds: int, seed: int) -> None:
    """Gradient steps of round k on the token ids of some texts, in a fixed random order."""
    size = [len(x) for x in texts]
    ids, row = np.concatenate(texts).astype(np.int64), np.repeat(np.arange(len(texts)), size)
    pick = targets(row, k, rounds)
    pick = pick[np.random.default_rng(seed).permutation(len(pick))]
    around = contexts(ids, row)
    for lo in range(0, len(pick), BATCH):
        part = pick[lo : lo + BATCH]
        network.step(ids[part], around.take(part, 0), rate)


WEIGHTS = "shard long, part int, tokens double, weights binary"


def _train_round(encoded: DataFrame, shards: int, network, rate: float, k: int, rounds: int) -> Network:
    fan_in = FAN_IN

    def weights(shard: int, tokens: int, net: Network):
        parts = net.parts()
        return pa.RecordBatch.from_arrays([pa.array([shard] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array([float(tokens)] * len(parts)), pa.array([p.astype(np.float64).tobytes() for p in parts], pa.binary())], ["shard", "part", "tokens", "weights"])

    def run(batches):
        C.roomy()
        shard, net, seen, held, size = None, None, 0, [], 0
        for b in batches:
            rows = ((s, x) for s, x, n in zip(*(c.to_pylist() for c in b.columns), strict=True) for _ in range(n))
            for s, x in rows:
                if s != shard:
                    if held:
                        train_shard(net, held, rate, k, rounds, seen)
                    if seen:
                        yield weights(shard, seen, net)
                    shard, seen, held, size = s, 0, [], 0
                    net = Network().set_parts([p.copy() for p in network.value.parts()])
                held.append(np.frombuffer(x, np.uint16))
                size += len(held[-1])
                seen += len(held[-1])
                if size >= BLOCK_TOKENS:
                    train_shard(net, held, rate, k, rounds, seen)
                    held, size = [], 0
        if held:
            train_shard(net, held, rate, k, rounds, seen)
        if seen:
            yield weights(shard, seen, net)

    def mean(batches):
        """Sums the rows of one shard group and part, which follow each other in the order of their shards."""
        key, n, total = None, 0.0, 0.0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([n]), pa.array([(total / n).tobytes()], pa.binary())], ["shard", "part", "tokens", "weights"])

        for b in batches:
            for i in range(b.num_rows):
                shard, part, tokens, w = (c[i].as_py() for c in b.columns)
                if (shard // fan_in, part) != key:
                    if key:
                        yield row()
                    key, n, total = (shard // fan_in, part), 0.0, 0.0
                n, total = n + tokens, total + tokens * np.frombuffer(w)
        if key:
            yield row()

    dealt = encoded.repartitionById(min(shards, TASKS), F.col("shard").cast("int")).sortWithinPartitions("shard", "h", "ids").select("shard", "ids", "copies")
    rows, left = C.map_batches(dealt, run, WEIGHTS), shards
    while True:
        by = rows.withColumn("_group", F.floor(F.col("shard") / fan_in)).repartition("_group", "part").sortWithinPartitions("_group", "part", "shard")
        rows, left = C.map_batches(by.drop("_group"), mean, WEIGHTS), -(-left // fan_in)
        if left == 1:
            break
    parts = network.value.parts()
    for r in rows.collect():
        parts[r.part] = np.frombuffer(r.weights).reshape(parts[r.part].shape).astype(np.float32)
    return Network().set_parts(parts)


def _encoded(docs: DataFrame, vocabulary, shards: int) -> DataFrame:
    """(shard, h, ids, copies): the token ids of each text that has any, in 16 bits, with the hash by which it is dealt and how
    often the shard has it. Copies are counted where they are read, before the shuffle."""

    def run(batches):
        for b in batches:
            for lo, hi, raw, offs in C.text_chunks(b.column(1)):
                ids, row, _ = vocabulary.value.ids(raw, offs, spell=False)
                data = ids.astype("<u2").tobytes()
                cuts = (2 * np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))])).tolist()
                some = [i for i in range(hi - lo) if cuts[i] < cuts[i + 1]]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi].take(pa.array(some, pa.int64())), pa.array([data[cuts[i] : cuts[i + 1]] for i in some], pa.binary())], ["h", "ids"])

    out = C.map_batches(docs.select(F.xxhash64("text").alias("h"), "text"), run, "h long, ids binary")
    out = out.groupBy("h", "ids").agg(F.count("*").alias("n"))
    part = F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {COPIES} AS int)"))).alias("part")
    out = out.select("h", "ids", "n", part).withColumn("copies", F.least(F.lit(COPIES), F.expr(f"n - {COPIES} * part")))
    return out.select(F.pmod(F.xxhash64("h", "part"), F.lit(shards)).alias("shard"), "h", "ids", "copies")


def train(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, shard_bytes: int = SHARD_BYTES) -> tuple[Vocabulary, Network]:
    """Vocabulary and network of all texts of docs. Null texts count for nothing, repeated ones as often as they stand there;
    texts of any length are used whole. An empty table leaves the first weights."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    shards = int((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes + 1)
    vocabulary, network = count_words(docs, VOCAB - OTHER), Network()
    encoded = C.written(_encoded(docs, sc.broadcast(vocabulary), shards))
    for k in range(rounds):
        network = _train_round(encoded, shards, sc.broadcast(network), RATE / (k + 1), k, rounds)
    C.dropped(encoded)
    return vocabulary, network


def score(docs: DataFrame, model: tuple[Vocabulary, Network], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, n_tokens, log_likelihood): each row of docs with the summed conditional log probabilities of its tokens.

    Texts that are null or have no word have no tokens and sum 0. Repeated rows give repeated results; ids, null ones too, play
    no part. Texts of any length are scored whole. Other columns (those named in ``keep``, or all) pass through ``row``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = C.row_and_text(docs, text_col, keep)

    def run(batches):
        vocabulary, network = shared.value
        for b in batches:
            for lo, hi, raw, offs in C.text_chunks(b.column(1)):
                ids, row, spelled = vocabulary.ids(raw, offs)
                logs = network.log_probabilities(ids, contexts(ids, row)) + spelled
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(np.bincount(row, minlength=hi - lo), pa.int64()), pa.array(np.bincount(row, logs, hi - lo).astype(np.float64))], ["row", "n_tokens", "log_likelihood"])

    return C.map_batches(base, run, T.StructType([base.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("log_likelihood", T.DoubleType())]))


def op6_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    out = score(docs, train(docs), keep=["doc_id"])
    return out.select("row.doc_id", "n_tokens", F.round("log_likelihood", 4).alias("log_likelihood"), F.round(F.try_divide("log_likelihood", F.col("n_tokens")), 4).alias("mean_log_likelihood"))
