"""Linear classifiers on word buckets: against plain loops, and that they learn."""
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from haggle.operators import evaluate as V
from haggle.operators import linear as L

CLASSES = {0: 4, 1: 3}


def examples(n=600, noise=0.1, seed=2):
    """The label follows from a cue word, save for some noise."""
    rng = random.Random(seed)
    cues = {0: ["offer", "price", "hello", "leave"], 1: ["sure", "cannot", "deal"]}
    rows = []
    for i in range(n):
        role = rng.randrange(2)
        label = rng.randrange(CLASSES[role])
        words = [rng.choice(["the", "a", "we", "it", "so", "bundle"]) for _ in range(rng.randint(1, 9))]
        words.insert(rng.randint(0, len(words)), cues[role][label].upper() if i % 2 else cues[role][label])
        if rng.random() < noise:
            label = rng.randrange(CLASSES[role])
        rows.append((i, role, " ".join(words), label, rng.choice(["train"] * 7 + ["validation"] * 2 + ["test"])))
    rows += [(n, 0, None, 1, "train"), (n + 1, 1, "", 2, "validation"), (n + 2, None, "offer", 1, "train"), (n + 3, 0, "offer", None, "train"),
             (n + 4, 0, "offer", 9, "train"), (n + 5, 7, "offer", 0, "train"), (n + 6, 1, "?! --", 0, "test")]
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "id int, role int, text string, label_id int, split string")
    return df.withColumn("features", L.word_buckets("text"))


def test_word_buckets(spark):
    import hashlib
    df = spark.createDataFrame([("One one, TWO!",), (None,), ("",), ("--",)], "t string")
    got = [r[0] for r in df.select(L.word_buckets("t")).collect()]
    want = sorted({int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % L.BUCKETS for w in ("one", "two")})
    assert got == [want, [], [], []]


def test_counted_model_against_loops(spark):
    rows = examples()
    df = frame(spark, rows)
    feats = {r.id: r.features for r in df.select("id", "features").collect()}
    model = L.counted_model(L.count_table(df.where("split = 'train'")), CLASSES)
    for role, k in CLASSES.items():
        own = [r for r in rows if r[1] == role and r[3] is not None and r[3] < k and r[4] == "train"]
        n = Counter(r[3] for r in own)
        words = Counter((b, r[3]) for r in own for b in feats[r[0]])
        seen = {b for b, _ in words}
        for r in rows[:80]:
            if r[1] != role:
                continue
            z = [math.log((n[c] + 1) / (len(own) + k)) + sum(
                math.log(words[b, c] + 1) - math.log(n[c] + 2) for b in feats[r[0]] if b in seen) for c in range(k)]
            e = [math.exp(x - max(z)) for x in z]
            got = df.where(F.col("id") == r[0]).select(
                L.label_proba(model, F.col("role"), F.col("features"), F.col("label_id"), spark)).first()[0] if r[0] < 6 else None
            p = model.proba(role, __import__("pyarrow").array([feats[r[0]]], __import__("pyarrow").list_(__import__("pyarrow").int32())))[0]
            assert np.allclose(p, [x / sum(e) for x in e])
            assert got is None or abs(got - e[r[3]] / sum(e)) < 1e-8


def test_odd_rows_score_null(spark):
    df = frame(spark, examples(50))
    model = L.counted_model(L.count_table(df), CLASSES)
    got = {r.id: (r.p, r.best) for r in df.select("id", L.label_proba(model, F.col("role"), F.col("features"), F.col("label_id"), spark).alias("p"),
                                                  L.best_label(model, F.col("role"), F.col("features"), spark).alias("best")).collect()}
    assert got[52] == (None, None) and got[55] == (None, None)  # no role, unknown role
    assert got[53][0] is None and got[54][0] is None and got[53][1] is not None  # no label, no class of the role
    assert 0 < got[50][0] < 1 and 0 < got[56][0] < 1  # without words the class shares decide


def loop_train(rows, feats, epochs, patience, rate=L.RATE):
    """The training rule, written out with dictionaries."""
    out = {}
    for role, k in CLASSES.items():
        own = {s: [r for r in rows if r[1] == role and r[3] is not None and r[3] < k and r[4] == s] for s in ("train", "validation")}
        w, sq = defaultdict(float), defaultdict(float)
        log, best, least, left, stop = [], None, 9999.0, patience, None

        def proba(r):
            z = [w[-1, c] + sum(w[b, c] for b in feats[r[0]]) for c in range(k)]
            e = [math.exp(x - max(z)) for x in z]
            return [x / sum(e) for x in e]

        for epoch in range(epochs + 1):
            for split in ("train", "validation"):
                loss = sum(round(-math.log(proba(r)[r[3]]) * 1e6) for r in own[split])
                hits = sum(max(range(k), key=lambda c: (round(proba(r)[c], 9), -c)) == r[3] for r in own[split])
                if epoch:
                    log.append((role, epoch, split, loss / 1e6, hits, len(own[split])))
            value = log[-1][3] / log[-1][5] if epoch else None
            if epoch:
                if value < least:
                    least, best, left = value, epoch, patience
                else:
                    left -= 1
                    if left < 0:
                        stop = epoch
                        break
            g = defaultdict(int)
            for r in own["train"]:
                p = proba(r)
                for c in range(k):
                    e = round((p[c] - (c == r[3])) * 1e6)
                    for b in [-1, *feats[r[0]]]:
                        g[b, c] += e
            for key, x in g.items():
                x = x / 1e6 / len(own["train"])
                sq[key] += x * x
                w[key] -= rate * x / (math.sqrt(sq[key]) + 1e-8)
        out[role] = (log, best, stop)
    return out


def near(a, b):
    return len(a) == len(b) and all(x[:3] == y[:3] and abs(x[3] - y[3]) < 1e-2 and x[4:] == y[4:] for x, y in zip(sorted(a), sorted(b)))


@pytest.mark.parametrize("noise,epochs,patience", [(0.1, 5, 5), (0.9, 30, 1)])
def test_training_against_loops(spark, noise, epochs, patience):
    rows = examples(250, noise)
    df = frame(spark, rows).repartition(3)
    feats = {r.id: r.features for r in df.select("id", "features").collect()}
    fit = L.softmax_train(df, CLASSES, epochs=epochs, patience=patience)
    want = loop_train(rows, feats, epochs, patience)
    log = [tuple(r) for r in fit.log.select("role", "epoch", "split", "loss", "correct", "n").collect()]
    assert near(log, [x for w in want.values() for x in w[0]])
    assert fit.best == {r: w[1] for r, w in want.items()}
    assert fit.stopped == {r: w[2] for r, w in want.items() if w[2] is not None}
    if noise > 0.5:
        assert fit.stopped and all(s < epochs for s in fit.stopped.values())  # labels that follow from nothing end early
    losses = fit.log.where("split = 'validation'").select(F.col("role").alias("run"), "epoch", (F.col("loss") / F.col("n")).alias("loss"))
    assert {r.run: r.stop_epoch for r in V.early_stop(losses, patience=patience, dense=True).collect()} == {
        r: w[2] for r, w in want.items()}
    assert {r.run: r.best_step for r in V.best_checkpoint(losses, step="epoch", value="loss").collect()} == fit.best
    for r, e in fit.best.items():  # what the shared folder holds is what is used
        assert np.array_equal(L.read_parameters(spark, fit.path, e, CLASSES).weights[r], fit.model.weights[r])


def test_it_learns(spark):
    df = frame(spark, examples(1500))
    fit = L.softmax_train(df, CLASSES, epochs=8)
    held = df.where("split = 'test' and label_id is not null and role in (0, 1)").select(
        "role", "label_id", L.best_label(fit.model, F.col("role"), F.col("features"), spark).alias("p")).toPandas()
    for role, own in held.groupby("role"):
        majority = own.label_id.value_counts(normalize=True).max()
        assert (own.p == own.label_id).mean() > max(0.8, majority + 0.3)
    first, last = (fit.log.where(F.col("epoch") == e).where("split = 'train'").agg(F.sum("loss")).first()[0] for e in (1, 8))
    assert last < first


def test_without_validation_or_rows(spark):
    rows = [r for r in examples(60) if r[4] == "train"]
    fit = L.softmax_train(frame(spark, rows), CLASSES, epochs=2)
    assert fit.best == {0: 2, 1: 2} and not fit.stopped
    fit = L.softmax_train(frame(spark, []), CLASSES, epochs=2)
    assert fit.log.count() == 0 and not fit.stopped
    assert np.allclose(fit.model.proba(0, __import__("pyarrow").array([[1, 2]], __import__("pyarrow").list_(__import__("pyarrow").int32()))), 0.25)


def test_sums_do_not_depend_on_partitions(spark):
    df = frame(spark, examples(200))
    a = L.softmax_train(df.coalesce(1), CLASSES, epochs=3)
    b = L.softmax_train(df.repartition(7), CLASSES, epochs=3)
    assert all(np.array_equal(a.model.weights[r], b.model.weights[r]) for r in CLASSES)
