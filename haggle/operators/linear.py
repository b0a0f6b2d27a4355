"""Per-role text classifiers with one weight per (word bucket, class).

Words are hashed into a fixed number of buckets, so a model has a size bound
that doesn't grow with the data: ``buckets`` x 25 numbers for the 12 buyer and
13 seller classes.  That makes it safe to broadcast, and scoring is a look-up
inside the row: no word is ever exploded or shuffled, so very common words
can't skew it.  Only the bucket lists (whole numbers) reach Python, in Arrow batches.

Two ways to fit:

* :func:`counted_model`: naive Bayes from one partially aggregated count;
* :func:`softmax_train`: multinomial logistic regression in epochs.  Each epoch
  is one pass over the examples; tasks emit sums, which Spark adds up.  Sums are
  whole numbers (fixed-point), so the fit doesn't depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..sources.io import scratch_path
from .classify import words_of
from .evaluate import PATIENCE, START_MIN

BUCKETS = 1 << 12
BIAS = -1               # bucket of the bias row
UNIT = 1_000_000        # fixed-point units of gradients and losses
EPOCHS = 10             # FIXED VALUE: epochs of the original training
RATE = 1.0
EPSILON = 1e-8
PLACES = 9              # scores are rounded, so that summing orders don't show


def word_buckets(text, buckets: int = BUCKETS) -> Column:
    """Sorted distinct buckets of a text's distinct lower-case words; an empty
    list for a NULL text."""
    one = lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    return F.coalesce(F.sort_array(F.array_distinct(F.transform(words_of(text), one))), F.array().cast("array<int>"))


# -- models

@dataclass
class LinearModel:
    """Weights per role: (buckets + 1) x classes, the bias in the last row."""
    weights: dict[int, np.ndarray]
    buckets: int = BUCKETS

    def scores(self, role: int, features: pa.ListArray) -> np.ndarray:
        """Rows x classes: bias plus the weights of the row's buckets."""
        w = self.weights[role]
        offsets = features.offsets.to_numpy().astype(np.int64)
        flat = features.values.to_numpy(zero_copy_only=False)[offsets[0]: offsets[-1]]
        offsets = offsets - offsets[0]
        out = np.zeros((len(offsets) - 1, w.shape[1]))
        filled = np.flatnonzero(np.diff(offsets))
        if len(filled):
            out[filled] = np.add.reduceat(w[flat], offsets[filled], axis=0)
        return out + w[self.buckets]

    def proba(self, role: int, features: pa.ListArray) -> np.ndarray:
        z = self.scores(role, features)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _by_role(model: LinearModel, role: pa.Array):
    """(role, rows) of the model's roles; rows of other roles have no class."""
    known = role.fill_null(-1).to_numpy(zero_copy_only=False)
    for r in model.weights:
        rows = np.flatnonzero(known == r)
        if len(rows):
            yield r, rows


def label_proba(model: LinearModel, role, features, label, spark: SparkSession) -> Column:
    """Probability of the row's ``label`` alone, under the classifier of the row's role.
    NULL where the role has no model or the label is NULL or no class of it."""
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(role: pa.Array, features: pa.Array, label: pa.Array) -> pa.Array:
        out, model = np.full(len(role), np.nan), shared.value
        wanted = label.fill_null(-1).to_numpy(zero_copy_only=False)
        for r, rows in _by_role(model, role):
            p = model.proba(r, features.take(pa.array(rows)))
            own = np.flatnonzero((wanted[rows] >= 0) & (wanted[rows] < p.shape[1]))
            out[rows[own]] = p[own, wanted[rows[own]]]
        return pa.array(np.round(out, PLACES), mask=np.isnan(out))

    return score(role, features, label)


def best_label(model: LinearModel, role, features, spark: SparkSession) -> Column:
    """The class of the highest (rounded) score, the smallest id at a tie; NULL for roles without a model."""
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf("int")
    def best(role: pa.Array, features: pa.Array) -> pa.Array:
        out, model = np.full(len(role), -1, np.int32), shared.value
        for r, rows in _by_role(model, role):
            out[rows] = np.argmax(np.round(model.scores(r, features.take(pa.array(rows))), PLACES), axis=1)
        return pa.array(out, mask=out < 0)

    return best(role, features)


# -- naive Bayes from counts

def count_table(df: DataFrame, *, role: str = "role", features: str = "features", label: str = "label_id") -> DataFrame:
    """(role, bucket, label_id, n): labelled rows with a word of the bucket, and in
    bucket BIAS all labelled rows.  One read, one partial aggregate; at most
    buckets + 1 rows per class."""
    d = df.where(F.col(label).isNotNull() & F.col(role).isNotNull())
    return d.select(F.col(role).alias("role"), F.col(label).cast("int").alias("label_id"), F.explode(
        F.concat(F.array(F.lit(BIAS)), F.col(features))).alias("bucket")).groupBy("role", "bucket", "label_id").agg(
        F.count(F.lit(1)).alias("n"))


def counted_model(counts: DataFrame, classes: dict[int, int], buckets: int = BUCKETS) -> LinearModel:
    """Naive Bayes weights from :func:`count_table`: add-one log ratios of
    words within a class, add-one log shares of classes.  Buckets that training
    never saw weigh nothing.  ``classes``: number of classes per role."""
    n = {r: np.zeros((buckets + 1, k)) for r, k in classes.items()}
    for row in counts.where(F.col("role").isin(list(classes))).collect():  # bounded: (buckets + 1) x classes
        if row.label_id < classes[row.role]:
            n[row.role][row.bucket if row.bucket != BIAS else buckets, row.label_id] = row.n
    weights = {}
    for r, k in classes.items():
        rows = n[r][buckets]
        w = np.log(n[r] + 1.0) - np.log(rows + 2.0)
        w[n[r].sum(axis=1) == 0] = 0.0
        w[buckets] = np.log((rows + 1) / (rows.sum() + k))
        weights[r] = w
    return LinearModel(weights, buckets)


# -- softmax regression in epochs

@dataclass
class SoftmaxFit:
    """A finished training.  ``log`` has a row per (role, epoch, split): loss (summed),
    correct and n; ``best`` the epoch kept per role, ``stopped`` the epoch at which
    patience ran out (missing: never)."""
    model: LinearModel
    log: DataFrame
    best: dict[int, int]
    stopped: dict[int, int]
    path: str


def _pass(model: LinearModel, roles: list[int]):
    """One epoch's pass over a task's examples: sums of gradients by (role, bucket)
    and of losses by (role, split), as rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grads = {r: np.zeros(model.weights[r].shape, np.int64) for r in roles}
        touched = {r: np.zeros(model.buckets + 1, bool) for r in roles}
        logs: dict[tuple[int, str], np.ndarray] = {}
        for batch in batches:
            label = batch.column("label_id").to_numpy(zero_copy_only=False)
            train = np.asarray(batch.column("split").to_pylist(), object) == "train"
            for r, rows in _by_role(model, batch.column("role")):
                if r not in grads:
                    continue
                features = batch.column("features").take(pa.array(rows))
                p, y = model.proba(r, features), label[rows]
                at = np.arange(len(rows))
                loss = np.rint(-np.log(np.maximum(p[at, y], 1e-300)) * UNIT).astype(np.int64)
                hit = np.argmax(np.round(p, PLACES), axis=1) == y
                for split in ("train", "validation"):
                    own = train[rows] == (split == "train")
                    sums = np.array([loss[own].sum(), hit[own].sum(), own.sum()], np.int64)
                    logs[r, split] = logs.get((r, split), 0) + sums
                p[at, y] -= 1.0
                error = np.rint(p * UNIT).astype(np.int64)
                error[~train[rows]] = 0
                sizes = np.diff(features.offsets.to_numpy())
                flat = features.flatten().to_numpy(zero_copy_only=False)
                learnt = train[rows]
                spread = np.repeat(error, sizes, axis=0)  # sums stay whole numbers that doubles hold exactly
                for c in range(p.shape[1]):
                    grads[r][:, c] += np.bincount(flat, spread[:, c], model.buckets + 1).astype(np.int64)
                touched[r][flat[np.repeat(learnt, sizes)]] = True
                grads[r][model.buckets] += error.sum(axis=0)
                touched[r][model.buckets] |= bool(learnt.any())
        out: list[tuple] = [(r, None, None, split, *map(int, s)) for (r, split), s in logs.items()]
        for r in roles:
            out += [(r, int(b) if b < model.buckets else BIAS, grads[r][b].tolist(), None, 0, 0, 0) for b in np.flatnonzero(touched[r])]
        if out:
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)],
                                             ["role", "bucket", "g", "split", "loss", "correct", "n"])
    return run


def softmax_train(examples: DataFrame, classes: dict[int, int], *, buckets: int = BUCKETS, epochs: int = EPOCHS,
                  patience: int = PATIENCE, rate: float = RATE) -> SoftmaxFit:
    """Fit a softmax regression per role, with validation after every epoch and patience.

    ``examples``: role, features (:func:`word_buckets`), label_id and split; rows of the
    splits ``train`` and ``validation`` are used, those with a NULL role or label, or a
    label that is no class of the role, are left out.  ``classes``: number of
    classes per role.

    Epoch e is described by the parameters after e updates; each update takes the
    mean gradient over the role's training rows with per-weight step sizes
    (rate / root of the summed squares so far).  A role's training ends when its
    validation loss hasn't fallen below the best so far for ``patience`` + 1
    epochs in a row, or after ``epochs``; the epoch of the lowest validation
    loss is kept (the first at a tie; the last epoch where there are no validation rows).

    The examples are written once, as bucket lists; an epoch reads them once
    and shuffles one row per task and touched bucket.  Sums and parameters of
    every epoch lie in the shared folder; the driver holds one model."""
    spark = examples.sparkSession
    path = scratch_path(spark, "softmax")
    size = F.create_map(*[F.lit(x) for r, k in classes.items() for x in (r, k)])
    (examples.select(F.col("role").cast("int").alias("role"), "features", F.col("label_id").cast("int").alias("label_id"), "split")
     .where(F.col("split").isin("train", "validation") & F.col("label_id").between(0, F.element_at(size, F.col("role")) - 1))
     .write.parquet(f"{path}/examples"))
    data = spark.read.parquet(f"{path}/examples")

    weights = {r: np.zeros((buckets + 1, k)) for r, k in classes.items()}
    squares = {r: np.zeros((buckets + 1, k)) for r, k in classes.items()}
    least = {r: START_MIN for r in classes}
    left = {r: patience for r in classes}
    kept = {r: (0, weights[r]) for r in classes}
    stopped: dict[int, int] = {}
    for epoch in range(epochs + 1):
        roles = [r for r in classes if r not in stopped]
        if not roles:
            break
        table = _epoch_sums(data.where(F.col("role").isin(roles)), LinearModel(weights, buckets), roles,
                            f"{path}/sums/epoch={epoch}")
        rows = table.collect()  # bounded: (buckets + 1) x roles, and two rows a role
        totals = {(x.role, x.split): x for x in rows if x.split is not None}
        for r in roles if epoch else ():
            held = totals.get((r, "validation"))
            if held is None or not held.n or held.loss / UNIT / held.n < least[r]:
                kept[r], left[r] = (epoch, weights[r]), patience
                least[r] = held.loss / UNIT / held.n if held is not None and held.n else least[r]
            else:
                left[r] -= 1
                if left[r] < 0:
                    stopped[r] = epoch
        if epoch == epochs:
            break
        weights = dict(weights)
        for r in roles:
            if r not in stopped and (r, "train") in totals and totals[r, "train"].n:
                weights[r], squares[r] = _updated(weights[r], squares[r], [x for x in rows if x.role == r and x.split is None],
                                                  totals[r, "train"].n, rate, buckets)
        _write_parameters(spark, weights, f"{path}/parameters/epoch={epoch + 1}")
    return SoftmaxFit(LinearModel({r: w for r, (_, w) in kept.items()}, buckets), training_log(spark, path),
                      {r: e for r, (e, _) in kept.items()}, stopped, path)


def _epoch_sums(data: DataFrame, model: LinearModel, roles: list[int], out: str) -> DataFrame:
    """Write one epoch's sums: per (role, bucket) the gradient, per (role, split) loss, correct and n."""
    most = max(w.shape[1] for w in model.weights.values())
    parts = data.mapInArrow(_pass(model, roles), "role int, bucket int, g array<long>, split string, loss long, correct long, n long")
    added = parts.groupBy("role", "bucket", "split").agg(
        *[F.sum(F.get("g", F.lit(i))).alias(f"g{i}") for i in range(most)],
        *[F.sum(c).alias(c) for c in ("loss", "correct", "n")])
    (added.select("role", "bucket", "split", F.array(*[f"g{i}" for i in range(most)]).alias("g"), "loss", "correct", "n")
     .write.mode("overwrite").parquet(out))
    return data.sparkSession.read.parquet(out)


def _updated(w: np.ndarray, squares: np.ndarray, rows: list, n: int, rate: float, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.zeros(w.shape)
    for x in rows:
        g[x.bucket if x.bucket != BIAS else buckets] = x.g[: w.shape[1]]
    g = g / UNIT / n
    squares = squares + g * g
    return w - rate * g / (np.sqrt(squares) + EPSILON), squares


def _write_parameters(spark: SparkSession, weights: dict[int, np.ndarray], out: str) -> None:
    rows = [(r, b if b < len(w) - 1 else BIAS, w[b].tolist()) for r, w in weights.items() for b in np.flatnonzero(w.any(axis=1)).tolist()]
    spark.createDataFrame(rows, "role int, bucket int, w array<double>").write.mode("overwrite").parquet(out)


def read_parameters(spark: SparkSession, path: str, epoch: int, classes: dict[int, int], buckets: int = BUCKETS) -> LinearModel:
    """The model after ``epoch`` updates, from the shared folder of a training."""
    weights = {r: np.zeros((buckets + 1, k)) for r, k in classes.items()}
    for x in spark.read.parquet(f"{path}/parameters/epoch={epoch}").collect():  # bounded by the model's size
        weights[x.role][x.bucket if x.bucket != BIAS else buckets] = x.w
    return LinearModel(weights, buckets)


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """(role, epoch, split, loss, correct, n) of every finished epoch from 1 on, loss summed over the rows."""
    sums = spark.read.parquet(f"{path}/sums")
    return sums.where("split is not null and epoch > 0 and n > 0").select(
        "role", F.col("epoch").cast("int").alias("epoch"), "split", (F.col("loss") / F.lit(float(UNIT))).alias("loss"), "correct", "n")
