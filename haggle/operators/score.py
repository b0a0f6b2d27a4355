"""Scoring and rewards as column arithmetic, bounded windows,
pre-aggregated joins and group aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import TWO32, md5_int
from ..labels import DEFAULT_WEIGHTS, INTENT_DEFAULT_SCORE

UNB = Window.unboundedPreceding


def prize_gap_expr(final_price, opening) -> Column:
    """Buyer's final price over the seller's opening price."""
    return F.try_divide(F.col(final_price).cast("double"), F.col(opening).cast("double"))


def prize_gap(df: DataFrame, *, final_price: str = "final_price", opening: str = "opening_price",
              out: str = "prize_gap") -> DataFrame:
    return df.withColumn(out, prize_gap_expr(final_price, opening))


def negotiation_strategy_expr(buyer_price, minimum, outcome) -> Column:
    """x = (buyer - minimum) / (buyer + 1), negated unless the deal was
    accepted; e^x when x >= 0, else 0."""
    b = F.col(buyer_price).cast("double")
    x = F.try_divide(b - F.col(minimum), b + 1.0) * F.when(F.col(outcome) == "Accept", 1.0).otherwise(-1.0)
    return F.when(x >= 0, F.exp(x)).when(x.isNotNull(), F.lit(0.0))


def negotiation_strategy(df: DataFrame, *, buyer_price: str = "final_price",
                         minimum: str = "reservation_price", outcome: str = "outcome",
                         out: str = "strategy") -> DataFrame:
    return df.withColumn(out, negotiation_strategy_expr(buyer_price, minimum, outcome))


@F.arrow_udf(T.DoubleType())  # a type object: workers import this module without a session
def _word_cosines(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cosine of the word counts of each row's two word lists; null when either is null."""
    words = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode()
    codes, kinds, at, counted = words.indices.to_numpy(), max(len(words.dictionary), 1), 0, []
    for x in (a, b):
        rows = np.repeat(np.arange(len(x)), pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False))
        counted.append(np.unique(rows * kinds + codes[at: at + len(rows)], return_counts=True))
        at += len(rows)
    (key_a, n_a), (key_b, n_b) = counted
    both, i, j = np.intersect1d(key_a, key_b, assume_unique=True, return_indices=True)
    dot, norm_a, norm_b = (np.bincount(key // kinds, value, len(a)) for key, value in (
        (both, n_a[i] * n_b[j]), (key_a, n_a * n_a), (key_b, n_b * n_b)))
    with np.errstate(invalid="ignore"):
        cosines = dot / (np.sqrt(norm_a) * np.sqrt(norm_b))
    return pa.array(cosines, mask=pc.or_(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False))


def word_cosine_expr(a, b) -> Column:
    """Word-count cosine of two texts of one row (lower case, split on single
    spaces, empty words kept); NULL when either is NULL.  The words of many rows
    are counted at once in an Arrow task, without a shuffle."""
    return _word_cosines(*(F.split(F.lower(F.col(c) if isinstance(c, str) else c), " ", -1) for c in (a, b)))


def surface_similarity(df: DataFrame, contexts, *, keys=("conv_id", "turn_no"), cand: str = "cand",
                       text: str = "cand_text", accumulate: bool = True, keep=()) -> DataFrame:
    """Word-count cosine of each candidate against its context sentences.

    ``contexts`` names the columns that hold the turn's past sentences,
    oldest first (NULL where there is none), on the candidate's own row, so
    no text is shuffled.  Walking the context in order, the candidate is cut
    to the shortest context sentence seen so far (characters).  With
    ``accumulate`` the score of candidate j is the mean over all (candidate
    <= j, context) pairs of the turn, as the original never resets its list;
    otherwise the plain mean per candidate.  Candidates of a turn with no
    context score 0.  ``keep`` names columns carried through to the result.
    The window is per turn (a handful of candidates) over two numbers.
    """
    keys, keep = list(keys), list(keep)
    cosines, shortest = [], []
    for c in contexts:
        shortest.append(F.length(c))
        least = F.least(*shortest) if len(shortest) > 1 else shortest[0]   # NULLs are skipped
        cosines.append(word_cosine_expr(F.substring(F.col(text), F.lit(1), least), c))
    per = df.select(*keys, cand, *keep, F.array(*cosines).alias("_c"))
    per = per.select(*keys, cand, *keep,
                     F.aggregate("_c", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))).alias("_s"),
                     F.size(F.filter("_c", lambda x: x.isNotNull())).alias("_n"))
    if accumulate:
        w = Window.partitionBy(*keys).orderBy(cand).rowsBetween(UNB, 0)
        sim = F.try_divide(F.sum("_s").over(w), F.sum("_n").over(w).cast("double"))
    else:
        sim = F.try_divide(F.col("_s"), F.col("_n").cast("double"))
    return per.select(*keys, cand, *keep, F.coalesce(sim, F.lit(0.0)).alias("similarity"))


def intent_reward(df: DataFrame, prob, *, keys=("conv_id", "turn_no"), cand: str = "cand",
                  label_id: str = "label_id", strict: bool = False,
                  default: float = INTENT_DEFAULT_SCORE) -> DataFrame:
    """Probability of the tagged intent.

    ``prob`` is either a scores DataFrame ``(keys, cand, label_id, prob)``
    (e.g. from :func:`haggle.operators.classify.batch_score`) or a function
    ``f(effective_label_id_column) -> Column``.  An untagged candidate
    reuses the previous candidate's label id within the turn (``strict``
    turns that off); with no id yet the score is ``default``.  The window is
    per turn (a handful of candidates), never per conversation.
    """
    keys = list(keys)
    if not strict:
        w = Window.partitionBy(*keys).orderBy(cand).rowsBetween(UNB, 0)
        d = df.withColumn("_eff", F.last(label_id, ignorenulls=True).over(w))
    else:
        d = df.withColumn("_eff", F.col(label_id))
    if isinstance(prob, DataFrame):
        s = prob.select(*keys, cand, F.col(label_id).alias("_eff"), F.col("prob").alias("_prob"))
        d = d.join(s, [*keys, cand, "_eff"], "left")
    else:
        d = d.withColumn("_prob", prob(F.col("_eff")))
    return (d.withColumn("intent_score", F.when(F.col("_eff").isNull(), F.lit(default))
                         .otherwise(F.col("_prob")))
            .drop("_prob"))


def composite_reward(df: DataFrame, *, weights=DEFAULT_WEIGHTS, intent: str = "intent_score",
                     gap: str = "prize_gap", strategy: str = "strategy", similarity: str = "similarity",
                     is_final: str = "is_final", flags: dict | None = None, out: str = "reward") -> DataFrame:
    """g1*intent + g2*gap + g3*strategy - g4*similarity; gap and strategy
    count only on the final turn; ``flags`` (column names or 0/1 literals
    for use_intent/use_gap/use_strategy/use_similarity) switch terms off."""
    g1, g2, g3, g4 = weights
    fl = {k: F.lit(1) for k in ("use_intent", "use_gap", "use_strategy", "use_similarity")}
    for k, v in (flags or {}).items():
        fl[k] = F.col(v) if isinstance(v, str) else F.lit(v)
    fin = F.when(F.col(is_final), F.lit(1.0)).otherwise(F.lit(0.0))
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    r = (F.lit(g1) * fl["use_intent"] * z(intent)
         + F.lit(g2) * fl["use_gap"] * fin * z(gap)
         + F.lit(g3) * fl["use_strategy"] * fin * z(strategy)
         - F.lit(g4) * fl["use_similarity"] * z(similarity))
    return df.withColumn(out, r)


def reward_ablation(df: DataFrame, *, group_by=(), weights=DEFAULT_WEIGHTS, **cols) -> DataFrame:
    """The composite reward under each variant's flags, averaged per variant
    (and ``group_by``).  The reward is linear in the flags, so the four terms
    are averaged once, in one partial aggregate over the scored rows, and
    each variant's mean is put together from the few resulting rows."""
    from ..labels import VARIANTS
    on = ("use_intent", "use_gap", "use_strategy", "use_similarity")
    d = df
    for f in on:   # one term at a time: the others switched off
        d = composite_reward(d, weights=weights, flags={o: int(o == f) for o in on}, out=f"_{f}", **cols)
    means = d.groupBy(*group_by).agg(*[F.avg(f"_{f}").alias(f"_{f}") for f in on], F.count(F.lit(1)).alias("n"))
    variants = F.array(*[F.struct(F.lit(v[0]).alias("variant"), *[F.lit(x).alias(f) for x, f in zip(v[1:], on)])
                         for v in VARIANTS])
    x = means.withColumn("_v", F.explode(variants))
    total = sum((F.col(f"_v.{f}") * F.coalesce(F.col(f"_{f}"), F.lit(0.0)) for f in on), F.lit(0.0))
    return x.filter("n > 0").select(F.col("_v.variant").alias("variant"), *group_by, total.alias("mean_reward"), "n")


def _vec_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def embedding_cosine_expr(a, b) -> Column:
    a = F.transform(F.col(a), lambda x: x.cast("double")) if isinstance(a, str) else a
    b = F.transform(F.col(b), lambda x: x.cast("double")) if isinstance(b, str) else b
    return F.try_divide(_vec_dot(a, b), F.sqrt(_vec_dot(a, a)) * F.sqrt(_vec_dot(b, b)))


def embedding_cosine(df: DataFrame, topics: DataFrame, *, on: str = "label", vec: str = "embedding",
                     topic_vec: str = "topic", out: str = "cosine") -> DataFrame:
    """Cosine of each reply vector with its topic vector (joined on ``on``;
    Spark picks a broadcast at runtime when the topic table is small)."""
    return df.join(topics, on, "inner").withColumn(out, embedding_cosine_expr(vec, topic_vec))


def centroids(df: DataFrame, *, by: str = "label", vec: str = "embedding", out: str = "topic") -> DataFrame:
    """Element-wise mean vector per group (explode, partial-aggregated mean,
    re-assembled in position order: bounded by the vector length)."""
    ex = df.select(by, F.posexplode(vec).alias("_i", "_x"))
    m = ex.groupBy(by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return m.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))),
                                         lambda s: s["_m"]).alias(out))


def group_softmax(df: DataFrame, *, group: str = "grp", item: str = "item", logit: str = "logit",
                  temperature: float = 0.8) -> DataFrame:
    """Softmax and log-softmax of ``logit / temperature`` within each group
    (groups are one distribution, bounded by the vocabulary)."""
    w = Window.partitionBy(group)
    z = F.col(logit).cast("double") / F.lit(temperature)
    d = df.withColumn("_z", z).withColumn("_zm", F.col("_z") - F.max("_z").over(w))
    d = d.withColumn("_lse", F.log(F.sum(F.exp("_zm")).over(w)))
    return (d.withColumn("logp", F.col("_zm") - F.col("_lse")).withColumn("prob", F.exp("logp"))
            .drop("_z", "_zm", "_lse"))


def nucleus_filter(df: DataFrame, *, group: str = "grp", item: str = "item", logit: str = "logit",
                   p: float = 0.92, temperature: float = 1.0) -> DataFrame:
    """Top-p: in descending logit order (ties by item), keep an item iff the
    probability mass before it is <= p; the best item is always kept."""
    d = group_softmax(df, group=group, item=item, logit=logit, temperature=temperature)
    w = Window.partitionBy(group).orderBy(F.desc(logit), item).rowsBetween(UNB, -1)
    return d.withColumn("mass_before", F.coalesce(F.sum("prob").over(w), F.lit(0.0))) \
            .filter(F.col("mass_before") <= F.lit(p))


def categorical_draw(df: DataFrame, *, group: str = "grp", item: str = "item", prob: str = "prob",
                     seed: int = 42) -> DataFrame:
    """One weighted draw per group by an exponential race: the item with
    the least -ln(u)/p wins, u a repeatable md5 uniform of (seed, group,
    item).  A plain partial aggregate: no sort, no collect."""
    u = (md5_int(seed, group, item) + F.lit(0.5)) / F.lit(TWO32)
    key = -F.log(u) / F.col(prob)
    return (df.filter(F.col(prob) > 0).groupBy(group)
            .agg(F.min_by(F.col(item), key).alias("drawn")))


def masked_logprob(df: DataFrame, *, seq: str = "seq", logp: str = "logp", mask: str = "mask",
                   average: bool = False, both: bool = False) -> DataFrame:
    """Per-sequence sum (or mask-weighted mean) of masked log-probs; ``both``
    gives the two columns ``seq_logprob`` and ``seq_logprob_mean`` at once."""
    s = F.sum(F.col(logp) * F.col(mask))
    mean = F.try_divide(s, F.sum(F.col(mask)).cast("double"))
    if both:
        return df.groupBy(seq).agg(s.alias("seq_logprob"), mean.alias("seq_logprob_mean"))
    v = mean if average else s
    return df.groupBy(seq).agg(v.alias("seq_logprob"))


def sequence_ce(df: DataFrame, *, seq: str = "seq", nll: str = "nll", mask: str = "mask",
                smooth: str | None = None, epsilon: float = 0.0, reduce: str = "sentence") -> DataFrame:
    """Masked negative log-likelihood.  ``smooth`` is the per-token sum of
    -log p over all K classes divided by K (label smoothing term), mixed as
    (1-eps)*nll + eps*smooth.  ``reduce``: ``none`` (per token),
    ``sentence`` (per sequence mean over the mask), ``batch`` (mean of the
    sequence means, each sequence counting once)."""
    loss = F.col(nll)
    if smooth is not None and epsilon:
        loss = (1 - epsilon) * loss + epsilon * F.col(smooth)
    d = df.withColumn("loss", loss * F.col(mask))
    if reduce == "none":
        return d
    if reduce == "sentence":
        return d.groupBy(seq).agg(F.try_divide(F.sum("loss"), F.sum(mask).cast("double")).alias("loss"))
    if reduce == "batch":
        per = d.groupBy(seq).agg(F.try_divide(F.sum("loss"), F.sum(mask).cast("double")).alias("loss"))
        return per.agg(F.avg("loss").alias("loss"))
    raise ValueError(f"unknown reduce {reduce!r}")


def perplexity(df: DataFrame, *, seq: str = "seq", nll: str = "nll", mask: str = "mask") -> DataFrame:
    """exp of the per-sequence mean masked NLL."""
    return (df.groupBy(seq).agg(F.try_divide(F.sum(F.col(nll) * F.col(mask)), F.sum(mask).cast("double")).alias("_l"))
            .select(seq, F.exp("_l").alias("perplexity")))


def _aligned(hyp: pa.ListArray, ref: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(matches, chunks) per row of two word lists: occurrences of a word are paired
    from the end of both lists; a chunk is a run of pairs that follow each other on
    both sides.  Two sorts of the batch's words, the rest is linear."""
    n = len(hyp)
    sizes = [np.diff(x.offsets.to_numpy()) for x in (hyp, ref)]
    word = pa.concat_arrays([hyp.flatten(), ref.flatten()]).dictionary_encode().indices.to_numpy()
    row = np.concatenate([np.repeat(np.arange(n), s) for s in sizes])
    pos = np.concatenate([np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) for s in sizes])
    side = np.repeat([0, 1], [s.sum() for s in sizes])
    order = np.lexsort((-pos, word, row, side))
    fresh = np.ones(len(order), bool)  # first of its word on its side
    fresh[1:] = np.any([x[order][1:] != x[order][:-1] for x in (word, row, side)], axis=0)
    at = np.arange(len(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    order = np.lexsort((side, rank, word, row))
    a, b = order[:-1], order[1:]
    pair = (row[a] == row[b]) & (word[a] == word[b]) & (rank[a] == rank[b])  # its hyp and its ref occurrence
    h, r, of = pos[a][pair], pos[b][pair], row[a][pair]
    order = np.lexsort((h, of))
    h, r, of = h[order], r[order], of[order]
    begins = np.ones(len(h), bool)
    begins[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1] + 1) | (r[1:] != r[:-1] + 1)
    return np.bincount(of, minlength=n), np.bincount(of[begins], minlength=n)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _matches(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    """[matches, chunks] of two word lists."""
    return pa.array(np.stack(_aligned(hyp, ref), axis=1).astype(np.int32).tolist(), pa.list_(pa.int32()))


def meteor_pair(pairs: DataFrame, *, keys=("pair_id",), hyp: str = "hyp", ref: str = "ref",
                alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> DataFrame:
    """METEOR, exact-match stage: occurrences of a lower-case word are paired from the
    end of both texts (the last with the last, and so on), as the usual
    implementation does; chunks are islands of consecutive positions on both
    sides; score = Fmean * (1 - gamma*(chunks/m)^beta), rounded to 2 places; 0
    without matches.

    Both texts sit in one row, so nothing is shuffled: their word lists go through
    one Arrow batch function that sorts a batch's words.  One row per row of
    ``pairs``, which ``keys`` name; a NULL text has no words."""
    def words(c):
        return F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+"), lambda w: w != "")

    d = pairs.select(*keys, words(hyp).alias("_h"), words(ref).alias("_r"))
    d = d.select(*keys, F.size("_h").alias("nh"), F.size("_r").alias("nr"), _matches("_h", "_r").alias("_m"))
    mm, chunks = F.get("_m", F.lit(0)).cast("double"), F.get("_m", F.lit(1))
    P, R = mm / F.col("nh"), mm / F.col("nr")
    fmean = P * R / (F.lit(alpha) * P + F.lit(round(1 - alpha, 12)) * R)
    frag = chunks / mm
    pen = F.lit(gamma) * (frag * frag * frag if beta == 3.0 else F.pow(frag, F.lit(beta)))
    # round half up to 2 places with plain IEEE arithmetic (engine-independent)
    score = F.when(mm > 0, F.floor(fmean * (1 - pen) * 100 + 0.5) / 100).otherwise(F.lit(0.0))
    return d.select(*keys, score.alias("meteor"))
