"""Policy and evaluation aggregates: group aggregates with
partial (map-side) combination; running values through the skew-safe scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.hashing import md5_int

HUMAN_REWARD = 10.0   # FIXED VALUE: reward logged for the turn's own reply
PPO_EPSILON = 0.2     # FIXED VALUE: clip range
PATIENCE = 5          # FIXED VALUE: early-stop patience
START_MIN = 9999.0    # FIXED VALUE: initial best loss


def sample_log(df: DataFrame, *, human: str = "human", reward: str = "reward", payload=("state", "context", "action"),
               key_cols=("conv_id", "turn_no"), seed: int = 42, human_reward: float = HUMAN_REWARD) -> DataFrame:
    """Append-only sample buffer of replies: the turn's own reply (``human``)
    gets the fixed reward, candidates keep theirs; the ``payload`` columns
    (state, context, action, agent, ...) travel along.  ``shuffle_key`` is a
    seeded md5 of the key: reading the buffer in its order is the seeded
    shuffle, without a global sort here.  One projection, no second read."""
    return df.select(*key_cols, *payload,
                     F.when(F.col(human), F.lit(float(human_reward))).otherwise(F.col(reward).cast("double")).alias("reward"),
                     F.col(human).alias("human_response"), md5_int(seed, *key_cols).alias("shuffle_key"))


def policy_ratio(df: DataFrame, *, new: str = "new_logp", old: str = "old_logp",
                 out: str = "ratio") -> DataFrame:
    return df.withColumn(out, F.exp(F.col(new) - F.col(old)))


def _ratio(df, new, old):
    return F.exp(F.col(new) - F.col(old))


def ppo_metrics(df: DataFrame, *, by, new: str = "new_logp", old: str = "old_logp",
                reward: str = "reward", eps: float = PPO_EPSILON, mode: str = "reference") -> DataFrame:
    """Per buffer (``by``): clipped objective, approximate KL, clip fraction
    and mean reward, all in one aggregate.

    ``mode='reference'`` takes the mean of min(-A r, -A clip(r)) as the
    original does; ``'standard'`` takes the max (the usual PPO loss)."""
    r = _ratio(df, new, old)
    a = F.col(reward)
    t1, t2 = -a * r, -a * F.least(F.greatest(r, F.lit(1 - eps)), F.lit(1 + eps))
    obj = F.least(t1, t2) if mode == "reference" else F.greatest(t1, t2)
    return df.groupBy(by).agg(
        F.avg(obj).alias("policy_loss"),
        F.avg((r - 1) - (F.col(new) - F.col(old))).alias("approx_kl"),
        F.avg(F.when(F.abs(r - 1) > eps, 1.0).otherwise(0.0)).alias("clip_frac"),
        F.avg(a.cast("double")).alias("mean_reward"),
        F.count(F.lit(1)).alias("n_samples"))


def empty_safe(metrics: DataFrame, buffers: DataFrame, by) -> DataFrame:
    """Buffers without samples report 0 for every metric."""
    cols = [c for c in metrics.columns if c not in ([by] if isinstance(by, str) else by)]
    out = buffers.join(metrics, by, "left")
    return out.select(*out.columns[:len(buffers.columns)],
                      *[F.coalesce(F.col(c), F.lit(0).cast(metrics.schema[c].dataType)).alias(c) for c in cols])


def best_checkpoint(df: DataFrame, *, run: str = "run", step: str = "step", value: str = "value") -> DataFrame:
    """Lowest validation value per run and its step; first step wins ties."""
    best = F.min_by(F.struct(F.col(step).alias("s"), F.col(value).alias("v")),
                    F.struct(F.col(value), F.col(step)))
    return df.groupBy(run).agg(best.alias("_b")).select(
        run, F.col("_b.s").alias("best_step"), F.col("_b.v").alias("best_value"))


def early_stop(df: DataFrame, *, run: str = "run", epoch: str = "epoch", loss: str = "loss",
               patience: int = PATIENCE, start: float = START_MIN, dense: bool = False) -> DataFrame:
    """Epoch at which patience runs out, per run (NULL if never).

    An epoch improves when its loss is strictly below every earlier loss
    (and below ``start``); each miss costs one unit of patience, an
    improvement restores it; training stops when patience drops below 0,
    i.e. at the (patience+1)-th straight miss.  Closed form in one scan: the
    last improving epoch up to e is the first epoch reaching the running
    minimum (strict improvements only), provided that minimum is below
    ``start``.  Misses are counted in rows, so epochs may have gaps; pass
    ``dense=True`` where epochs are numbered 1, 2, ... per run (the rows then
    need no numbering pass)."""
    if dense:
        d = df.withColumn("_n", F.col(epoch))
    else:
        d = scan.row_number(df, run, [epoch], F.floor(F.col(epoch) / F.lit(scan.CHUNK_ROWS)), "_n")
    d = d.withColumn("_le", F.struct(F.col(loss).alias("l"), F.col("_n").alias("n")))
    d = scan.running_agg(d, run, "_n", "_le", "_best", how="min")
    last_imp = F.when(F.col("_best.l") < F.lit(start), F.col("_best.n"))
    misses = F.col("_n") - F.coalesce(last_imp, F.lit(0))
    return d.groupBy(run).agg(F.min(F.when(misses >= patience + 1, F.col(epoch))).alias("stop_epoch"),
                              F.count(F.lit(1)).alias("n_epochs"))


def eval_cadence(df: DataFrame, k: int, *, step: str = "step") -> DataFrame:
    """Keep every k-th step."""
    return df.filter(F.col(step) % F.lit(k) == 0)


def epoch_metrics(df: DataFrame, *, epoch: str = "epoch", split: str = "split", loss: str = "loss",
                  correct: str = "correct", n: str | None = None, by=()) -> DataFrame:
    """Mean loss and accuracy per (``by``, epoch, split).  Rows are examples, or with
    ``n`` sums over n examples each (a training's log)."""
    total = F.sum(n) if n else F.count(F.lit(1))
    return df.groupBy(*by, epoch, split).agg(
        (F.sum(loss) / total).alias("mean_loss"),
        (F.sum(F.col(correct).cast("long")) / total).alias("accuracy"),
        total.cast("long").alias("n"))


def confusion_matrix(df: DataFrame, *, actual: str = "actual", predicted: str = "predicted",
                     pivot: bool = False, by=()) -> DataFrame:
    cm = df.groupBy(*by, actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    if pivot:
        return cm.groupBy(*by, actual).pivot(predicted).agg(F.first("n")).na.fill(0)
    return cm


def class_report(df: DataFrame, *, actual: str = "actual", predicted: str = "predicted", by=()) -> DataFrame:
    """Per class (of each ``by``) over the union of actual and predicted labels: precision,
    recall, F1 and support; 0 where a denominator is empty.  Built from the
    confusion counts (one pass), never from collected labels."""
    cm = confusion_matrix(df, actual=actual, predicted=predicted, by=by)
    per_label = cm.select(*by, F.explode(F.array(
        F.struct(F.col(actual).alias("label"), F.col("n").alias("n"), F.lit("a").alias("k"),
                 (F.col(actual) == F.col(predicted)).alias("hit")),
        F.struct(F.col(predicted).alias("label"), F.col("n").alias("n"), F.lit("p").alias("k"),
                 (F.col(actual) == F.col(predicted)).alias("hit")))).alias("x")).select(*by, "x.*")
    agg = per_label.groupBy(*by, "label").agg(
        F.sum(F.when(F.col("k") == "a", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("k") == "p", F.col("n")).otherwise(0)).alias("n_pred"),
        F.sum(F.when((F.col("k") == "a") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"))
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return (agg.withColumn("precision", p).withColumn("recall", r)
            .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall") /
                                     (F.col("precision") + F.col("recall"))).otherwise(0.0))
            .select(*by, "label", "precision", "recall", "f1", F.col("support").cast("long").alias("support")))


def accuracy(df: DataFrame, *, actual: str = "actual", predicted: str = "predicted",
             scored: str = "scored") -> DataFrame:
    """``acc_scored`` = correct / scored rows; ``acc_reference`` = correct /
    all rows (the original divides by every test row, other speaker's
    included)."""
    hit = (F.col(scored) & (F.col(actual) == F.col(predicted))).cast("int")
    return df.agg(F.try_divide(F.sum(hit), F.sum(F.col(scored).cast("int")).cast("double")).alias("acc_scored"),
                  F.try_divide(F.sum(hit), F.count(F.lit(1)).cast("double")).alias("acc_reference"))


def validation_report(parts: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Report of means in long form ``(metric, value, n)``.  ``parts`` lists
    (frame, {metric: column}); a frame's metrics come from one aggregate over
    all its rows (the overall mean, not the last batch's), then unpivoted."""
    out = None
    for df, metrics in parts:
        one = df.agg(*[F.struct(F.lit(m).alias("metric"), F.avg(F.col(c).cast("double")).alias("value"),
                                F.count(c).alias("n")).alias(f"_m{i}") for i, (m, c) in enumerate(metrics.items())])
        rows = one.select(F.inline(F.array(*[F.col(f"_m{i}") for i in range(len(metrics))])))
        out = rows if out is None else out.unionByName(rows)
    return out
