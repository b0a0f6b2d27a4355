"""Log-bilinear language model trained by noise-contrastive estimation (operator 7).

A token's class is the word itself for the ``FREQUENT`` most counted words and
otherwise one of ``TAILS`` classes by the word's last two bytes.  The model
gives P(class | classes of the two tokens before) as a softmax of
(q1[c1] + q2[c2]) . r[class] + b[class]; within a tail class a word has
(c + 1) / (N_class + V_class + 1), where one share stands for all unseen words.
So every text has a proper log-probability.

Training.  Counts cover all training documents (one shuffle of word hashes).
The model starts from the unigram distribution; then every task runs NCE steps
over its own training documents and the tasks' parameters are averaged by
tokens, first over an eighth of the documents, then over all of them.  The sums
are taken on integers, so reruns on the same splits agree.

Scoring.  In a task the contexts not seen before are normalised together, by
one matrix product over all classes; the words outside the ``LOCAL`` most
counted ones meet their counts in one shuffle of (document, hash, times).  What
is broadcast has a fixed size; nothing else reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haggle.llm.spark import checkpoint
from haggle.llm.words import as_bytes, hash_words, slices

FREQUENT = 448          # words with a class of their own, the end of a text among them
TAILS = 64
CLASSES = FREQUENT + TAILS
COMMON = 200_000        # words with at least this share's inverse of all tokens may be held by tasks
LOCAL = 20_000          # of them the most counted, whose counts every task holds
DIMENSIONS = 24
NOISE = 32              # noise classes a step
STEP_TOKENS = 4096
RATE = 0.08
FIXED = 1 << 24         # parameters are summed as integers of this scale
END = np.uint64(0x5BD1E995A5A5A5A5)
FLUSH = 1 << 20
CHUNKS = 16             # rows a task's parameters are cut into


def tail_class(tails: np.ndarray) -> np.ndarray:
    return (tails * 40503 >> 4) % TAILS


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, tail classes, offsets) of each text's words and its end token."""
    words, offsets, tails = hash_words(texts, keep_tail=True)
    ends = offsets[1:]
    hashes = np.insert(words, ends, END)
    kinds = np.insert(tail_class(tails), ends, 0)
    return hashes, kinds, offsets + np.arange(len(offsets))


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return (keys[first], order[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values))


def word_counts(docs: DataFrame) -> DataFrame:
    """(hash, tail, n) over all texts of docs (column text), the end token included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, kinds, _ = tokens(as_bytes(part.column("text")))
                keys, at, n = _sum_by(hashes, np.ones(len(hashes), np.int64))
                new = keys, kinds[at], n
                if have is not None:
                    both = [np.concatenate(x) for x in zip(have, new)]
                    keys, at, n = _sum_by(both[0], both[2])
                    new = keys, both[1][at], n
                have = new
                if len(have[0]) > FLUSH:
                    yield _rows(have)
                    have = None
        if have is not None:
            yield _rows(have)

    def _rows(have):
        return pa.RecordBatch.from_arrays([pa.array(have[0].view(np.int64)), pa.array(have[1].astype(np.int64)),
                                           pa.array(have[2])], ["hash", "tail", "n"])

    return docs.select("text").mapInArrow(run, "hash long, tail long, n long").groupBy("hash").agg(
        F.first("tail").alias("tail"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Corpus totals and the tables that every task holds (at most LOCAL words)."""
    total: int           # N
    distinct: int        # V
    hashes: np.ndarray   # of the LOCAL most counted words, sorted
    counts: np.ndarray
    classes: np.ndarray  # class of a frequent word, -1 for the others
    tail_total: np.ndarray  # N_class, V_class of the tail classes
    tail_distinct: np.ndarray
    noise: np.ndarray    # unigram probability of each class

    def look_up(self, hashes: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, count) of each token; count -1 where it is not held here."""
        if not len(self.hashes):
            return FREQUENT + tails, np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        count = np.where(known, self.counts[at], -1)
        own = np.where(known, self.classes[at], -1)
        return np.where(own >= 0, own, FREQUENT + tails), count


def vocabulary(counts: DataFrame) -> Vocabulary:
    """counts: (hash, tail, n), checkpointed."""
    sums = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    tail_n, tail_v = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for r in sums:
        tail_n[r.tail], tail_v[r.tail] = r.n, r.v
    total, distinct = int(tail_n.sum()), int(tail_v.sum())
    # at most COMMON words can have a share of 1 / COMMON or more; the end token is one of them whatever its rank
    end = F.col("hash") == int(END.view(np.int64))
    common = counts.where((F.col("n") * COMMON >= total) | end)
    top = common.orderBy(~end, F.desc("n"), F.col("hash")).limit(LOCAL).collect()
    hashes = np.array([r.hash for r in top], np.int64).view(np.uint64)
    n = np.array([r.n for r in top], np.int64)
    classes = np.where(np.arange(len(top)) < FREQUENT, np.arange(len(top)), -1)
    for r in top[:FREQUENT]:
        tail_n[r.tail] -= r.n
        tail_v[r.tail] -= 1
    mass = np.zeros(CLASSES)
    mass[: len(top[:FREQUENT])] = n[:FREQUENT]
    mass[FREQUENT:] = tail_n
    mass = (mass + 1) / (mass.sum() + CLASSES)
    order = np.argsort(hashes)
    return Vocabulary(total, distinct, hashes[order], n[order], classes[order], tail_n, tail_v, mass)


# -- the model

Parameters = dict[str, np.ndarray]


def start(vocabulary: Vocabulary, seed: int = 5) -> Parameters:
    rng = np.random.default_rng(seed)
    new = {k: (rng.standard_normal((CLASSES, DIMENSIONS)) * 0.1).astype(np.float32) for k in ("q1", "q2", "r")}
    return new | {"b": np.log(vocabulary.noise).astype(np.float32)}


def contexts(classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two tokens before each token; before a text stands its end's class, 0."""
    one, two = np.zeros_like(classes), np.zeros_like(classes)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    begins = offsets[:-1]
    one[begins] = 0
    two[begins] = 0
    two[(begins + 1)[begins + 1 < offsets[1:]]] = 0
    return one, two


def _scatter(rows: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """Sum of gradient rows by class."""
    order = np.argsort(rows, kind="stable")
    own = rows[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    out = np.zeros((CLASSES, gradient.shape[1]), np.float32)
    out[own[first]] = np.add.reduceat(gradient[order], first, axis=0)
    return out


def nce_step(p: Parameters, memory: Parameters, noise_log: np.ndarray, one: np.ndarray, two: np.ndarray,
             target: np.ndarray, drawn: np.ndarray) -> None:
    """One Adagrad step: tell the tokens from the drawn noise classes, whose
    share of the mixture is len(drawn) to 1."""
    k = np.float32(np.log(len(drawn)))
    context = p["q1"][one] + p["q2"][two]
    own = p["r"][target]
    push = (context * own).sum(axis=1) + p["b"][target] - noise_log[target] - k
    push = 1 / (1 + np.exp(np.clip(push, -30, 30)))              # 1 - P(token is data)
    noise = p["r"][drawn]
    pull = context @ noise.T + (p["b"][drawn] - noise_log[drawn] - k)
    pull = -1 / (1 + np.exp(np.clip(-pull, -30, 30)))            # -P(noise is data)
    to_context = push[:, None] * own + pull @ noise
    gradient = {"q1": _scatter(one, to_context), "q2": _scatter(two, to_context),
                "r": _scatter(target, push[:, None] * context),
                "b": np.bincount(target, push, CLASSES).astype(np.float32)}
    np.add.at(gradient["r"], drawn, pull.T @ context)
    np.add.at(gradient["b"], drawn, pull.sum(axis=0))
    for name, g in gradient.items():
        g /= np.float32(len(target)) ** np.float32(0.5)
        memory[name] += g * g
        p[name] += np.float32(RATE) * g / np.sqrt(memory[name] + np.float32(1e-2))


def _train_pass(docs: DataFrame, vocabulary: Vocabulary, parameters: Parameters, seed: int) -> Parameters:
    """NCE over all texts of docs in parallel; the tasks' parameters averaged by tokens."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, parameters))
    sizes = [parameters[k].size for k in sorted(parameters)]
    cut = -(-sum(sizes) // CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        voc, first = shared.value
        p = {k: v.copy() for k, v in first.items()}
        memory = {k: np.zeros_like(v) for k, v in p.items()}
        task = TaskContext.get().partitionId()
        rng, noise_log, seen = np.random.default_rng((seed, task)), np.log(voc.noise).astype(np.float32), 0
        border = np.cumsum(voc.noise)
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, tails, offsets = tokens(as_bytes(part.column("text")))
                classes, _ = voc.look_up(hashes, tails)
                one, two = contexts(classes, offsets)
                mixed = rng.permutation(len(classes))
                for at in range(0, len(mixed), STEP_TOKENS):
                    here = mixed[at: at + STEP_TOKENS]
                    drawn = np.minimum(np.searchsorted(border, rng.random(NOISE)), CLASSES - 1)
                    nce_step(p, memory, noise_log, one[here], two[here], classes[here], drawn)
                seen += len(classes)
        if seen:
            flat = np.concatenate([p[k].ravel() for k in sorted(p)]).astype(np.float64)
            weight = 1 + (seen >> 16)  # so that the integer sums hold at any size
            flat = np.round(flat * FIXED).astype(np.int64) * weight
            flat = np.concatenate((flat, np.zeros(cut * CHUNKS - len(flat), np.int64))).reshape(CHUNKS, cut)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(CHUNKS)), pa.array(np.full(CHUNKS, task % 64)), pa.array(np.full(CHUNKS, weight)),
                 pa.array([x.tobytes() for x in flat], pa.binary())], ["chunk", "part", "weight", "sums"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, sums = 0, 0
        for batch in batches:
            weight += sum(batch.column("weight").to_pylist())
            for x in batch.column("sums"):
                sums = sums + np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([0]), pa.array([weight]),
                                          pa.array([sums.tobytes()], pa.binary())], ["chunk", "part", "weight", "sums"])

    shape = "chunk long, part long, weight long, sums binary"
    summed = docs.select("text").mapInArrow(run, shape).groupBy("chunk", "part").applyInArrow(add, shape).groupBy(
        "chunk").applyInArrow(add, shape).orderBy("chunk").collect()  # CHUNKS rows
    if not summed:
        return parameters
    flat = np.concatenate([np.frombuffer(r.sums, np.int64) for r in summed]) / (FIXED * float(summed[0].weight))
    out, at = {}, 0
    for name in sorted(parameters):
        size = parameters[name].size
        out[name] = flat[at: at + size].astype(np.float32).reshape(parameters[name].shape)
        at += size
    return out


class Scorer:
    """Normalised class log-probabilities (natural logarithm); normalisers are kept by context."""

    def __init__(self, parameters: Parameters):
        self.p = parameters
        self.log_z = np.full(CLASSES * CLASSES, np.nan, np.float32)

    def log_probability(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        p, code = self.p, one * CLASSES + two
        new = np.flatnonzero(np.bincount(code[np.isnan(self.log_z[code])], minlength=1))
        for at in range(0, len(new), 2048):
            a, b = np.divmod(new[at: at + 2048], CLASSES)
            scores = (p["q1"][a] + p["q2"][b]) @ p["r"].T + p["b"]
            top = scores.max(axis=1)
            self.log_z[new[at: at + 2048]] = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
        out = np.empty(len(target))
        for at in range(0, len(target), 1 << 16):
            s = slice(at, at + (1 << 16))
            own = ((p["q1"][one[s]] + p["q2"][two[s]]) * p["r"][target[s]]).sum(axis=1) + p["b"][target[s]]
            out[s] = own - self.log_z[code[s]]
        return out


def train(docs: DataFrame, counts: DataFrame | None = None, seed: int = 5) -> tuple[Vocabulary, Parameters, DataFrame]:
    """(vocabulary, parameters, counts) learnt from the column text of docs."""
    counts = checkpoint(word_counts(docs)) if counts is None else counts
    voc = vocabulary(counts)
    parameters = start(voc, seed)
    eighth = docs.where(F.pmod(F.xxhash64("text"), F.lit(8)) == 0)
    parameters = _train_pass(eighth, voc, parameters, seed)
    return voc, _train_pass(docs, voc, parameters, seed + 1), counts


def _local_scores(docs: DataFrame, voc: Vocabulary, parameters: Parameters) -> DataFrame:
    """What a task can tell alone, a row per row of docs (doc_id, d, t, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((voc, parameters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, p = shared.value
        scorer = Scorer(p)
        rest = np.log10(voc.tail_total + voc.tail_distinct + 1.0)
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, tails, offsets = tokens(as_bytes(part.column("text")))
                classes, count = voc.look_up(hashes, tails)
                one, two = contexts(classes, offsets)
                held = count >= 0
                logs = np.log10(np.maximum(count, 0) + 1.0)
                model = scorer.log_probability(one, two, classes) / np.log(10.0)
                rare = classes >= FREQUENT
                # a rare word's count comes here where it is held, else from the join
                model = model + np.where(rare, np.where(held, logs, 0.0) - rest[np.maximum(classes - FREQUENT, 0)], 0.0)
                begins = offsets[:-1]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("d"), part.column("t"), part.column("held_out"),
                     pa.array(np.diff(offsets), pa.int64()), pa.array(np.add.reduceat(held.astype(np.int64), begins)),
                     pa.array(np.add.reduceat(np.where(held, logs, 0.0), begins)),
                     pa.array(np.add.reduceat(model, begins))],
                    ["doc_id", "d", "t", "held_out", "n_tokens", "known", "logs", "model"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, d long, t long, held_out boolean, n_tokens long, "
                                "known long, logs double, model double")


def _rare_words(docs: DataFrame, voc: Vocabulary) -> DataFrame:
    """(d, t, hash, times) of the words whose counts tasks don't hold; and a row
    with times 0 for each row of docs, which counts repeated rows."""
    shared = docs.sparkSession.sparkContext.broadcast(voc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, tails, offsets = tokens(as_bytes(part.column("text")))
                _, count = voc.look_up(hashes, tails)
                doc = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                far = count < 0
                order = np.lexsort((hashes[far], doc[far]))
                h, o = hashes[far][order], doc[far][order]
                first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])))) if len(h) \
                    else np.zeros(0, np.int64)
                times = np.diff(np.concatenate((first, [len(h)])))
                d, t = (part.column(c).to_numpy() for c in ("d", "t"))
                who = np.concatenate((o[first], np.arange(part.num_rows)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d[who]), pa.array(t[who]), pa.array(np.concatenate((h[first].view(np.int64), t ^ d))),
                     pa.array(np.concatenate((times, np.zeros(part.num_rows, np.int64))))], ["d", "t", "hash", "times"])

    return docs.mapInArrow(run, "d long, t long, hash long, times long")


def score_documents(docs: DataFrame, train_on: DataFrame, held_out: str, text: str = "text",
                    doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    train_on: rows of docs to learn from; held_out: a boolean column of docs.
    Scores are log10 of the whole text's probability, the end token included;
    base_score is that of add-one unigrams.  A null or wordless text is its end
    token alone; null held_out counts as false.  Rows that repeat doc_id and
    text get equal scores.  With nothing to learn from all words are unseen.
    Other columns are ignored."""
    voc, parameters, counts = train(train_on.select(F.col(text).alias("text")))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("d"),
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("t"), F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"),
        F.col(text).alias("text"))
    local = _local_scores(rows, voc, parameters)
    found = _rare_words(rows.select("d", "t", "text"), voc).join(counts.select("hash", "n"), "hash", "left")
    known = F.when(F.col("n").isNotNull(), F.col("times"))
    far = found.groupBy("d", "t").agg(
        F.sum(F.coalesce(known, F.lit(0))).alias("far_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("far_logs"),
        F.sum(F.when(F.col("times") == 0, 1).otherwise(0)).alias("copies"))
    everything = float(voc.total + voc.distinct + 1)
    more = F.col("far_logs") / F.col("copies")
    return local.join(far, ["d", "t"]).select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("far_known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(voc.total).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.log10(F.lit(everything))).alias("base_score"),
        (F.col("model") + more).alias("score"))
