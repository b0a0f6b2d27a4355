"""Classifiers against plain-Python loops."""
import math
import random
import re
from collections import Counter

from haggle.operators import classify as C


def test_bayes_against_loops(spark):
    rnd = random.Random(4)
    vocab = ["price", "deal", "case", "offer", "hello", "Bye", "x1"]
    rows = [(i, i % 2, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 6))), rnd.choice([0, 1, 2, None])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, role_id int, utterance string, label_id int")
    classes = spark.createDataFrame([(r, c) for r in (0, 1) for c in range(4)], "role int, label_id int")
    train = [r for r in rows if r[0] < 80]
    model = C.bayes_train(df.filter("id < 80"), classes)
    scores = C.bayes_scores(model, df, keys="id")
    got = {(r.id, r.label_id): r.score for r in scores.collect()}
    cut = lambda t: set(re.findall("[a-z0-9]+", t.lower()))
    for i, role, text, _ in rows:
        own = [r for r in train if r[1] == role and r[3] is not None]
        known = {w for r in own for w in cut(r[2])}
        for c in range(4):
            mine = [r for r in own if r[3] == c]
            counts = Counter(w for r in mine for w in cut(r[2]))
            s = math.log((len(mine) + 1) / (len(own) + 4)) + sum(
                math.log(counts[w] + 1) - math.log(len(mine) + 2) for w in cut(text) if w in known)
            assert abs(got[(i, c)] - s) < 1e-8
    best = {r.id: r.predicted for r in C.bayes_predict(scores, keys="id").collect()}
    assert all(best[i] == max(range(4), key=lambda c: (got[(i, c)], -c)) for i in best) and len(best) == 120
    p = {}
    for r in C.bayes_proba(scores, keys="id").collect():
        p[r.id] = p.get(r.id, 0) + r.p
    assert all(abs(x - 1) < 1e-9 for x in p.values())


def test_queries_score_every_row(spark):
    from tests.tables import SF_SMALL
    import __spark_entry__ as E
    q = E.queries()
    n = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert q["batch_score"](spark, SF_SMALL).count() == n
    assert q["document_quality"](spark, SF_SMALL).count() == n
