"""Registered queries for classification at scale: fitted on
labelled rows, applied to every row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.hashing import sql_md5_int
from ..labels import BUYER_INTENTS, SELLER_INTENTS, canonical_labels, sql_values
from ..operators import classify as C
from ..operators import dialogue as D
from ..operators import evaluate as V
from ..operators import extract as E
from ..operators import linear as L
from ..sources import fixtures as X
from .q_extract import LABELS_ALIAS_SQL
from .registry import register

W = X.with_views
CLASSES = [(r, i) for r, labels in ((0, BUYER_INTENTS), (1, SELLER_INTENTS)) for i in range(len(labels))]
KEYS = ("conv_id", "turn_no")


def labelled_turns(spark, sf_dir):
    """Turns with their role, intent id and 80/10/10 split."""
    t = E.label_encode(X.turns(spark, sf_dir), role="speaker", label="intent")
    return D.split_rows(t, seed=42).select("conv_id", "turn_no", F.col("speaker").alias("role_id"), "utterance",
                                           "label_id", "split")


def turn_scores(spark, sf_dir):
    t = labelled_turns(spark, sf_dir)
    model = C.bayes_train(t.filter("split = 'train'"), canonical_labels(spark))
    return t, C.bayes_scores(model, t, keys=KEYS)


X.EXTRA_VIEWS["lturns"] = f"""
SELECT t.conv_id, t.turn_no, t.speaker AS role, t.utterance, la.label_id,
       CASE WHEN {sql_md5_int(42, 't.conv_id', 't.turn_no')} % 1000 < 800 THEN 'train'
            WHEN {sql_md5_int(42, 't.conv_id', 't.turn_no')} % 1000 < 900 THEN 'validation' ELSE 'test' END AS split,
       list_distinct(list_filter(regexp_split_to_array(lower(t.utterance), '[^a-z0-9]+'), lambda w: w <> '')) AS words
FROM turns t LEFT JOIN {LABELS_ALIAS_SQL} ON la.lrole = t.speaker AND la.alias_lower = lower(t.intent)"""
X.EXTRA_VIEWS["nb"] = f"""
SELECT t.conv_id, t.turn_no, t.role, c.label_id,
       round(ln((coalesce(l.n, 0) + 1) / (a.n + a.k)) + coalesce(s.s, 0) - coalesce(m.m, 0) * ln(coalesce(l.n, 0) + 2.0), 9) AS score
FROM lturns t
JOIN {sql_values(CLASSES, ['role', 'label_id'], 'c')} ON c.role = t.role
LEFT JOIN (SELECT role, label_id, count(*) AS n FROM lturns WHERE split = 'train' AND label_id IS NOT NULL GROUP BY ALL) l
  ON l.role = t.role AND l.label_id = c.label_id
JOIN (SELECT r.role, r.k, (SELECT count(*) FROM lturns x WHERE x.split = 'train' AND x.label_id IS NOT NULL AND x.role = r.role) AS n
      FROM (VALUES (0, {len(BUYER_INTENTS)}), (1, {len(SELLER_INTENTS)})) AS r(role, k)) a ON a.role = t.role
LEFT JOIN (SELECT conv_id, turn_no, count(*) AS m FROM (SELECT conv_id, turn_no, role, unnest(words) AS w FROM lturns) q
           WHERE (role, w) IN (SELECT role, unnest(words) FROM lturns WHERE split = 'train' AND label_id IS NOT NULL)
           GROUP BY ALL) m ON m.conv_id = t.conv_id AND m.turn_no = t.turn_no
LEFT JOIN (SELECT q.conv_id, q.turn_no, k.label_id, sum(ln(k.n + 1.0)) AS s
           FROM (SELECT conv_id, turn_no, role, unnest(words) AS w FROM lturns) q
           JOIN (SELECT role, label_id, w, count(*) AS n FROM (
                   SELECT role, label_id, unnest(words) AS w FROM lturns WHERE split = 'train' AND label_id IS NOT NULL)
                 GROUP BY ALL) k ON k.role = q.role AND k.w = q.w GROUP BY ALL) s
  ON s.conv_id = t.conv_id AND s.turn_no = t.turn_no AND s.label_id = c.label_id"""


@register("intent_train", W("turns", "lturns", "nb") + """
SELECT t.conv_id, t.turn_no, t.split, t.label_id AS actual, p.predicted
FROM lturns t JOIN (SELECT conv_id, turn_no, arg_max(label_id, (score, -label_id)) AS predicted FROM nb GROUP BY ALL) p
USING (conv_id, turn_no)""")
def q_intent_train(spark, sf_dir):
    """Per-role intent classifier over turns: fit on the train split, predict on every turn."""
    t, scores = turn_scores(spark, sf_dir)
    p = C.bayes_predict(scores, keys=KEYS)
    return t.join(p, list(KEYS)).select("conv_id", "turn_no", "split", F.col("label_id").alias("actual"), "predicted")


@register("intent_proba", W("turns", "lturns", "nb") + """
SELECT conv_id, turn_no, label_id, exp(score - top) / sum(exp(score - top)) OVER (PARTITION BY conv_id, turn_no) AS p
FROM (SELECT *, max(score) OVER (PARTITION BY conv_id, turn_no) AS top FROM nb)""")
def q_intent_proba(spark, sf_dir):
    """Probability of each of the role's 12 or 13 classes for every turn."""
    _, scores = turn_scores(spark, sf_dir)
    return C.bayes_proba(scores, keys=KEYS).select("conv_id", "turn_no", "label_id", "p")


# ---------------------------------------------------------------- epochs
# Softmax regression per role over events as utterances; the twin repeats every
# epoch as a CTE (whole-number sums, so both engines follow the same path).

def sql_buckets(words: str) -> str:
    return (f"list_sort(list_distinct(list_transform({words}, "
            f"lambda w: CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % {L.BUCKETS} AS INTEGER))))")


def sql_words(text: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda w: w <> ''))"


def training(spark, sf_dir):
    """(all examples with features and split, the finished training)."""
    ex = D.split_rows(X.intent_examples(spark, sf_dir), seed=42, key_cols=("event_id",)).select(
        "event_id", "role", L.word_buckets("text").alias("features"), "label_id", "split")
    return ex, L.softmax_train(ex, X.CLASS_COUNTS)


def predicted_examples(spark, sf_dir):
    ex, fit = training(spark, sf_dir)
    return ex.select("event_id", "role", "split", F.col("label_id").alias("actual"),
                     L.best_label(fit.model, F.col("role"), F.col("features"), spark).alias("predicted"),
                     L.label_proba(fit.model, F.col("role"), F.col("features"), F.col("label_id"), spark).alias("p_actual"))


def validation_losses(log):
    return log.where("split = 'validation'").select(F.col("role").alias("run"), "epoch", (F.col("loss") / F.col("n")).alias("loss"))


def sql_training(epochs: int = L.EPOCHS, patience: int = V.PATIENCE) -> str:
    classes = sql_values(CLASSES, ["role", "c"], "k")
    out = W("intent_ex") + f"""
, sx AS MATERIALIZED (SELECT *, CASE WHEN {sql_md5_int(42, 'event_id')} % 1000 < 800 THEN 'train'
       WHEN {sql_md5_int(42, 'event_id')} % 1000 < 900 THEN 'validation' ELSE 'test' END AS split,
       {sql_buckets(sql_words('text'))} AS feats FROM intent_ex)
, sk AS (SELECT * FROM {classes})
, sf AS MATERIALIZED (SELECT event_id, role, label_id, split, unnest(list_append(feats, -1)) AS b FROM sx)
, w0 AS (SELECT 0 AS role, -1 AS b, 0 AS c, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS s WHERE false)"""
    z = """SELECT f.event_id, f.role, f.label_id, f.split, k.c, sum(coalesce(w.w, 0.0)) AS z
       FROM sf f JOIN sk k ON k.role = f.role LEFT JOIN {w} w ON w.role = f.role AND w.b = f.b AND w.c = k.c
       WHERE {where} GROUP BY ALL"""
    for e in range(epochs + 1):
        out += f"""
, z{e} AS MATERIALIZED ({z.format(w=f'w{e}', where="f.split <> 'test'")})
, p{e} AS MATERIALIZED (SELECT *, exp(z - max(z) OVER o) / sum(exp(z - top)) OVER o AS p
       FROM (SELECT *, max(z) OVER (PARTITION BY event_id) AS top FROM z{e}) WINDOW o AS (PARTITION BY event_id))
, t{e} AS MATERIALIZED (SELECT role, split, sum(loss) / {float(L.UNIT)} AS loss, sum(CAST(best = label_id AS BIGINT)) AS correct, count(*) AS n
       FROM (SELECT event_id, role, split, label_id, max(CASE WHEN c = label_id THEN CAST(round(-ln(p) * {L.UNIT}) AS BIGINT) END) AS loss,
                    arg_max(c, (round(p, {L.PLACES}), -c)) AS best FROM p{e} GROUP BY ALL) GROUP BY ALL)"""
        if e < epochs:
            out += f"""
, g{e} AS (SELECT f.role, f.b, p.c, CAST(sum(CAST(round((p.p - CASE WHEN p.c = p.label_id THEN 1 ELSE 0 END) * {L.UNIT}) AS BIGINT)) AS DOUBLE)
              / {float(L.UNIT)} / max(t.n) AS g
       FROM sf f JOIN p{e} p ON p.event_id = f.event_id JOIN t{e} t ON t.role = f.role AND t.split = 'train'
       WHERE f.split = 'train' GROUP BY ALL)
, w{e + 1} AS MATERIALIZED (SELECT g.role, g.b, g.c,
       coalesce(w.w, 0.0) - {L.RATE} * g.g / (sqrt(coalesce(w.s, 0.0) + g.g * g.g) + {L.EPSILON}) AS w, coalesce(w.s, 0.0) + g.g * g.g AS s
       FROM g{e} g LEFT JOIN w{e} w ON w.role = g.role AND w.b = g.b AND w.c = g.c)"""
    log = " UNION ALL ".join(f"SELECT role, {e} AS epoch, split, loss, correct, n FROM t{e}" for e in range(1, epochs + 1))
    weights = " UNION ALL ".join(f"SELECT {e} AS epoch, role, b, c, w FROM w{e}" for e in range(1, epochs + 1))
    return out + f"""
, whole AS ({log})
, val AS (SELECT role, epoch, loss / n AS loss, min(loss / n) OVER (PARTITION BY role ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING
          AND 1 PRECEDING) AS before FROM whole WHERE split = 'validation')
, runs AS (SELECT role, epoch, loss, max(CASE WHEN loss < least(before, 9999.0) THEN epoch END) OVER (PARTITION BY role ORDER BY epoch) AS last
           FROM val)
, ends AS (SELECT role, min(CASE WHEN epoch - coalesce(last, 0) >= {patience + 1} THEN epoch END) AS stop_epoch FROM runs GROUP BY role)
, log AS (SELECT w.* FROM whole w JOIN ends USING (role) WHERE w.epoch <= coalesce(stop_epoch, {epochs}))
, best AS (SELECT role, arg_min(epoch, (loss / n, epoch)) AS best_epoch, min(loss / n) AS best_loss, count(*) AS n_epochs
           FROM log WHERE split = 'validation' GROUP BY role)
, model AS MATERIALIZED (SELECT w.role, w.b, w.c, w.w FROM ({weights}) w JOIN best ON best.role = w.role AND best.best_epoch = w.epoch)
, guess AS MATERIALIZED ({z.format(w='model', where='true')})
, found AS (SELECT event_id, role, split, label_id AS actual, arg_max(c, (round(z, {L.PLACES}), -c)) AS predicted,
              round(max(CASE WHEN c = label_id THEN exp(z - top) END) / sum(exp(z - top)), {L.PLACES}) AS p_actual
       FROM (SELECT *, max(z) OVER (PARTITION BY event_id) AS top FROM guess) GROUP BY ALL)
"""


SQL_TRAINING = sql_training()


@register("intent_softmax", SQL_TRAINING + "SELECT event_id, role, split, actual, predicted, p_actual FROM found")
def q_intent_softmax(spark, sf_dir):
    """Per-role softmax classifier trained in epochs with patience; the best epoch's model over every example."""
    return predicted_examples(spark, sf_dir)


@register("epoch_metrics", SQL_TRAINING + """
SELECT role, epoch, split, loss / n AS mean_loss, correct / n AS accuracy, CAST(n AS BIGINT) AS n FROM log""")
def q_epoch_metrics(spark, sf_dir):
    """Loss and accuracy of the training's epochs, from its own log."""
    return V.epoch_metrics(training(spark, sf_dir)[1].log, n="n", by=("role",))


@register("intent_training", SQL_TRAINING + """
SELECT role, best_epoch, best_loss, stop_epoch, n_epochs FROM best JOIN ends USING (role)""")
def q_intent_training(spark, sf_dir):
    """Per role the epoch that is kept and the one at which patience ran out, from the training's log."""
    losses = validation_losses(training(spark, sf_dir)[1].log)
    best = V.best_checkpoint(losses, step="epoch", value="loss").select(
        "run", F.col("best_step").alias("best_epoch"), F.col("best_value").alias("best_loss"))
    return best.join(V.early_stop(losses, dense=True), "run").select(
        F.col("run").alias("role"), "best_epoch", "best_loss", "stop_epoch", "n_epochs")


@register("intent_class_report", SQL_TRAINING + """
, cm AS (SELECT role, actual, predicted, count(*) AS n FROM found WHERE split = 'test' GROUP BY ALL)
, u AS (SELECT role, actual AS label, n, 'a' AS k, actual = predicted AS hit FROM cm
        UNION ALL SELECT role, predicted AS label, n, 'p' AS k, actual = predicted AS hit FROM cm)
, g AS (SELECT role, label, sum(CASE WHEN k = 'a' THEN n ELSE 0 END) AS support, sum(CASE WHEN k = 'p' THEN n ELSE 0 END) AS n_pred,
               sum(CASE WHEN k = 'a' AND hit THEN n ELSE 0 END) AS tp FROM u GROUP BY role, label)
, h AS (SELECT role, label, support, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM g)
SELECT role, label, precision, recall,
       CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
       CAST(support AS BIGINT) AS support FROM h""")
def q_intent_class_report(spark, sf_dir):
    """Precision, recall and F1 per class on the test split, which the fit never saw."""
    return V.class_report(predicted_examples(spark, sf_dir).where("split = 'test'"), by=("role",))


@register("document_quality")
def q_document_quality(spark, sf_dir):
    """Spark ML classifier of document quality: fitted on the labelled
    documents' train split, applied to all documents."""
    docs = X.table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = X.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label_id"))
    train = D.split_rows(docs.join(lab, "doc_id"), seed=42, key_cols=("doc_id",)).filter("split = 'train'")
    model = C.intent_train(train, text="text", label="label_id", num_features=1 << 14, max_iter=20)
    return C.intent_proba(model, docs, 1, out="p_quality").select("doc_id", "predicted", "p_quality")


# ---- FIXED VALUES (own choice): the caller's two-feature model -------------
SCORER_WEIGHTS, SCORER_BIAS = (0.75, -2.5), -3.0


@register("batch_score", f"""
SELECT doc_id, 1.0 / (1.0 + exp(-({SCORER_WEIGHTS[0]} * ln(1 + len(string_split(text, ' ')))
       + {SCORER_WEIGHTS[1]} * (length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(length(text), 1)) + {SCORER_BIAS}))) AS p
FROM documents""")
def q_batch_score(spark, sf_dir):
    """The caller's own model on every document: the scorer is built once per
    partition (here two fixed weights) and fed Arrow batches."""
    docs = X.table(spark, sf_dir, "documents").select(
        "doc_id", F.log1p(F.size(F.split("text", " ")).cast("double")).alias("f_words"),
        (F.length(F.regexp_replace("text", "[^A-Z]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("f_upper"))

    def make_scorer():
        weights = np.array(SCORER_WEIGHTS)          # "load" the model once per partition

        def score(pdf: pd.DataFrame) -> pd.DataFrame:
            z = pdf[["f_words", "f_upper"]].to_numpy(dtype="float64") @ weights + SCORER_BIAS
            return pd.DataFrame({"doc_id": pdf["doc_id"], "p": 1.0 / (1.0 + np.exp(-z))})
        return score

    return C.batch_score(docs, make_scorer, "doc_id long, p double")
