"""Classification at scale.

The original fine-tunes a transformer per role; here the per-role intent
classifier is either a Spark ML pipeline (tokenise, hashed term frequencies,
IDF, multinomial logistic regression) or a count-based naive Bayes model whose
training and scoring are plain aggregates and joins.
``batch_score`` is the one Python-side hook: a caller's own model, loaded
once per partition and fed Arrow batches through ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intent_train(df: DataFrame, *, text: str = "utterance", label: str = "label_id",
                 num_features: int = 1 << 18, max_iter: int = 50, reg: float = 0.0) -> PipelineModel:
    """Fit tokeniser -> hashing TF -> IDF -> logistic regression on
    ``(text, label)``.  Train one model per role by filtering first
    (:func:`haggle.operators.dialogue.role_filter`)."""
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"\W+", minTokenLength=1),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=label, maxIter=max_iter, regParam=reg,
                           family="multinomial"),
    ])
    return pipe.fit(df.withColumn(label, F.col(label).cast("double")))


def intent_predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predicted class and the probability vector as an array."""
    out = model.transform(df)
    return (out.withColumn("proba", vector_to_array("probability"))
            .withColumn("predicted", F.col("prediction").cast("int"))
            .drop("_tok", "_tf", "_features", "rawPrediction", "probability", "prediction"))


def intent_proba(model: PipelineModel, df: DataFrame, idx, *, out: str = "p") -> DataFrame:
    """Softmax probability of class ``idx`` (an int or a column name)."""
    pred = intent_predict(model, df)
    i = F.lit(idx) if isinstance(idx, int) else F.col(idx)
    return pred.withColumn(out, F.get(F.col("proba"), i))


def words_of(text) -> Column:
    """Distinct lower-case words of a text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != ""))


@dataclass
class BayesModel:
    """Counts of a naive Bayes model per role: turns per label, and turns of a
    label that hold a word.  Tables, not collected."""
    labels: DataFrame   # role, label_id, n
    words: DataFrame    # role, word, label_id, n
    classes: DataFrame  # role, label_id: every class, seen or not


def bayes_train(df: DataFrame, classes: DataFrame, *, role: str = "role_id", text: str = "utterance",
                label: str = "label_id") -> BayesModel:
    """Count words per (role, label) over the labelled turns (NULL labels are
    left out).  Both counts are partial aggregates over one read each."""
    d = df.filter(F.col(label).isNotNull()).select(F.col(role).alias("role"), F.col(label).alias("label_id"),
                                                   words_of(text).alias("_w"))
    labels = d.groupBy("role", "label_id").agg(F.count(F.lit(1)).alias("n"))
    words = d.select("role", "label_id", F.explode("_w").alias("word")).groupBy("role", "word", "label_id").agg(
        F.count(F.lit(1)).alias("n"))
    return BayesModel(labels, words, classes.select("role", "label_id"))


def bayes_scores(model: BayesModel, df: DataFrame, *, keys, role: str = "role_id", text: str = "utterance") -> DataFrame:
    """(keys, label_id, score): add-one log-probability of every class of the
    turn's role, rounded to 9 places.  ``keys`` identify a turn; words that
    training never saw are left out.

    Only (word, label) pairs that were counted are joined: an uncounted one
    contributes log 1, and the denominators follow from the number of known
    words.  The priors have a row per class of the fixed class table and are broadcast."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    known = model.words.groupBy("role", "word").agg(F.collect_list(F.struct("label_id", "n")).alias("_by"))
    total = model.labels.groupBy("role").agg(F.sum("n").alias("_all"))
    k = model.classes.groupBy("role").agg(F.count(F.lit(1)).alias("_k"))
    priors = (model.classes.join(model.labels, ["role", "label_id"], "left").join(total, "role", "left").join(k, "role")
              .select("role", "label_id", F.coalesce("n", F.lit(0)).alias("_n"), F.coalesce("_all", F.lit(0)).alias("_all"), "_k"))
    turns = df.select(*keys, F.col(role).alias("role"), words_of(text).alias("_w"))
    hits = turns.select(*keys, "role", F.explode("_w").alias("word")).join(known, ["role", "word"])
    n_known = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    logs = hits.select(*keys, F.explode("_by").alias("_b")).groupBy(*keys, F.col("_b.label_id").alias("label_id")).agg(
        F.sum(F.log(F.col("_b.n") + F.lit(1.0))).alias("_s"))
    out = turns.select(*keys, "role").join(F.broadcast(priors), "role").join(n_known, keys, "left").join(logs, [*keys, "label_id"], "left")
    score = (F.log((F.col("_n") + 1) / (F.col("_all") + F.col("_k"))) + F.coalesce("_s", F.lit(0.0))
             - F.coalesce("_m", F.lit(0)) * F.log(F.col("_n") + F.lit(2.0)))
    return out.select(*keys, "role", "label_id", F.round(score, 9).alias("score"))


def bayes_predict(scores: DataFrame, *, keys) -> DataFrame:
    """(keys, predicted): the class of the best score, the smallest id at a tie."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return scores.groupBy(*keys).agg(F.max_by("label_id", F.struct("score", -F.col("label_id"))).alias("predicted"))


def bayes_proba(scores: DataFrame, *, keys) -> DataFrame:
    """(keys, label_id, p): softmax of the scores over the role's classes."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    z = F.exp(F.col("score") - F.max("score").over(Window.partitionBy(*keys)))
    d = scores.withColumn("_e", z)
    return d.select(*keys, "label_id", (F.col("_e") / F.sum("_e").over(Window.partitionBy(*keys))).alias("p"))


def batch_score(df: DataFrame, make_scorer: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
                schema: str) -> DataFrame:
    """Score with the caller's own model.

    ``make_scorer()`` runs once per partition on the executor (load weights,
    open a session, ...) and returns ``f(pandas batch) -> pandas batch``;
    batches arrive through Arrow, so the model is never rebuilt per row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for pdf in batches:
            yield scorer(pdf)
    return df.mapInPandas(run, schema)
