"""Registered queries for policy and evaluation aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import sql_md5_int
from ..operators import dialogue as D
from ..operators import evaluate as V
from ..operators import extract as E
from ..operators import score as S
from ..sources import fixtures as X
from ..sources import io
from ..sources.buffer import SampleBuffer
from .q_extract import nego_outcome
from .q_score import CONTEXTS, sql_similarity, token_nll, turn_candidates
from .registry import register

W = X.with_views


BATCH = 32


@register("sample_log", W("turns", "turn_cands", "turn_ctx") + sql_similarity("turn_cands", "turn_ctx", True)
          .lstrip().lstrip(",").join([", ", ""]) + f"""
, texts AS (SELECT conv_id, turn_no, concat_ws(chr(10), lag(utterance, 2) OVER w, lag(utterance) OVER w) AS state,
                   coalesce(lag(utterance) OVER w, '') AS context
            FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn_no))
, keyed AS (SELECT c.conv_id, c.turn_no, c.cand, t.state, t.context, c.cand_text AS action,
                   CASE WHEN c.cand = 0 THEN 10.0 ELSE 1 - s.similarity END AS reward, c.cand = 0 AS human_response,
                   {sql_md5_int(42, 'c.conv_id', 'c.turn_no', 'c.cand')} AS shuffle_key
            FROM turn_cands c JOIN texts t USING (conv_id, turn_no) JOIN sim s USING (conv_id, turn_no, cand))
SELECT *, CAST(floor((row_number() OVER o - 1) / {BATCH}) AS BIGINT) AS batch_no, CAST((row_number() OVER o - 1) % {BATCH} AS INTEGER) AS batch_pos
FROM keyed WINDOW o AS (ORDER BY shuffle_key, conv_id, turn_no, cand)""")
def q_sample_log(spark, sf_dir):
    """The policy's samples (state, context, action, reward) appended to a buffer, the turns' own
    replies and the other candidates as two appends, and read back in seeded batches."""
    texts = turn_candidates(spark, sf_dir).withColumns({
        "state": F.concat_ws("\n", "prev_2_utterance", "prev_utterance"), "context": F.coalesce("prev_utterance", F.lit("")),
        "action": F.col("cand_text")})
    scored = S.surface_similarity(texts, CONTEXTS, accumulate=True, keep=["state", "context", "action"])
    log = V.sample_log(scored.withColumns({"human": F.col("cand") == 0, "reward": 1 - F.col("similarity")}),
                       key_cols=("conv_id", "turn_no", "cand")).drop("shuffle_key")
    buffer = SampleBuffer(spark, io.scratch_path(spark, "samples"), ("conv_id", "turn_no", "cand"), seed=42)
    buffer.append(log.where("human_response"), "replies")
    buffer.append(log.where("not human_response"), "candidates")
    return buffer.batches(BATCH, log.schema.simpleString()[7:-1]).drop("append")


@register("policy_ratio", W("samples") + """
SELECT buffer, idx, exp(new_logp - old_logp) AS ratio FROM samples""")
def q_policy_ratio(spark, sf_dir):
    return V.policy_ratio(X.samples(spark, sf_dir)).select("buffer", "idx", "ratio")


def _ppo(spark, sf_dir, metric):
    buffers = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("buffer"))
    m = V.ppo_metrics(X.samples(spark, sf_dir), by="buffer")
    return V.empty_safe(m, buffers, "buffer").select("buffer", metric)


PPO_SQL = W("samples") + """
, m AS (SELECT buffer,
           avg(least(-reward * exp(new_logp - old_logp),
                     -reward * least(greatest(exp(new_logp - old_logp), 0.8), 1.2))) AS policy_loss,
           avg((exp(new_logp - old_logp) - 1) - (new_logp - old_logp)) AS approx_kl,
           avg(CASE WHEN abs(exp(new_logp - old_logp) - 1) > 0.2 THEN 1.0 ELSE 0.0 END) AS clip_frac,
           avg(reward) AS mean_reward
        FROM samples GROUP BY buffer)
SELECT o.o_orderkey AS buffer, coalesce(m.{col}, 0.0) AS {col}
FROM orders o LEFT JOIN m ON m.buffer = o.o_orderkey"""


@register("clipped_objective", PPO_SQL.format(col="policy_loss"))
def q_clipped_objective(spark, sf_dir):
    return _ppo(spark, sf_dir, "policy_loss")


@register("standard_objective", W("samples") + """
SELECT buffer, avg(greatest(-reward * exp(new_logp - old_logp),
                            -reward * least(greatest(exp(new_logp - old_logp), 0.8), 1.2))) AS policy_loss
FROM samples GROUP BY buffer""")
def q_standard_objective(spark, sf_dir):
    return V.ppo_metrics(X.samples(spark, sf_dir), by="buffer", mode="standard").select("buffer", "policy_loss")


@register("approx_kl", PPO_SQL.format(col="approx_kl"))
def q_approx_kl(spark, sf_dir):
    return _ppo(spark, sf_dir, "approx_kl")


@register("clip_fraction", PPO_SQL.format(col="clip_frac"))
def q_clip_fraction(spark, sf_dir):
    return _ppo(spark, sf_dir, "clip_frac")


@register("mean_reward", PPO_SQL.format(col="mean_reward"))
def q_mean_reward(spark, sf_dir):
    return _ppo(spark, sf_dir, "mean_reward")


@register("validation_report", W("logits", "sm1", "tok_nll", "turns", "turns_f", "turns_r", "turns_x", "turns_e",
                                   "mt_pairs", "mt_h", "mt_r", "mt", "nego", "nego_f", "nego_r", "nego_o", "nego_m",
                                   "outcome") + """
, o AS (SELECT CAST(final_price AS DOUBLE) / NULLIF(CAST(opening_price AS DOUBLE), 0) AS prize_gap,
               CASE WHEN (final_price - reservation_price) / (final_price + 1.0)
                         * CASE WHEN outcome = 'Accept' THEN 1.0 ELSE -1.0 END >= 0
                    THEN exp((final_price - reservation_price) / (final_price + 1.0)
                             * CASE WHEN outcome = 'Accept' THEN 1.0 ELSE -1.0 END)
                    WHEN final_price IS NOT NULL THEN 0.0 END AS strategy FROM outcome)
SELECT 'perplexity' AS metric, avg(v) AS value, count(v) AS n FROM (
  SELECT exp(sum(nll * mask) / sum(mask)) AS v FROM tok_nll GROUP BY seq)
UNION ALL SELECT 'loss', avg(v), count(v) FROM (SELECT sum(nll * mask) / sum(mask) AS v FROM tok_nll GROUP BY seq)
UNION ALL SELECT 'length', avg(v), count(v) FROM (
  SELECT CAST(len(list_filter(regexp_split_to_array(split_part(split_part(example, chr(10), 1), chr(9), 1), '\\s+'),
                              lambda w: w <> '')) AS DOUBLE) AS v FROM turns_e)
UNION ALL SELECT 'meteor', avg(meteor), count(meteor) FROM mt
UNION ALL SELECT 'strategy', avg(strategy), count(strategy) FROM o
UNION ALL SELECT 'prize_gap', avg(prize_gap), count(prize_gap) FROM o""")
def q_validation_report(spark, sf_dir):
    """Means of perplexity, loss, reply length, METEOR, strategy and price
    gap, each over its own whole input: one aggregate per source (vectors, turns, events)."""
    nll = S.sequence_ce(token_nll(spark, sf_dir), reduce="sentence").withColumn("ppl", F.exp("loss"))
    turns = D.turn_render(D.locf_and_lead(X.turns(spark, sf_dir), previous=("utterance",)))
    turns = E.candidate_length(D.example_build(turns, ablation=True), text="example")
    turns = S.meteor_pair(turns.withColumn("answers", F.col("prev_utterance").isNotNull()), hyp="utterance", ref="prev_utterance",
                          keys=("conv_id", "turn_no", "cand_len", "answers"))
    turns = turns.withColumn("meteor", F.when(F.col("answers"), F.col("meteor")))
    out = S.negotiation_strategy(S.prize_gap(nego_outcome(spark, sf_dir)))
    return V.validation_report([(nll, {"perplexity": "ppl", "loss": "loss"}), (turns, {"length": "cand_len", "meteor": "meteor"}),
                                (out, {"strategy": "strategy", "prize_gap": "prize_gap"})])


@register("best_checkpoint", W("metric_log") + """
SELECT run, arg_min(step, (value, step)) AS best_step, min(value) AS best_value FROM metric_log GROUP BY run""")
def q_best_checkpoint(spark, sf_dir):
    return V.best_checkpoint(X.metric_log(spark, sf_dir))


@register("early_stop", W("metric_log") + """
, a AS (SELECT *, min(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_min
        FROM metric_log)
, b AS (SELECT *, value < least(prev_min, 9999.0) AS imp FROM a)
, c AS (SELECT *, max(CASE WHEN imp THEN step END) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS last_imp,
               min(step) OVER (PARTITION BY run) AS e0 FROM b)
SELECT run, min(CASE WHEN step - coalesce(last_imp, e0 - 1) >= 6 THEN step END) AS stop_epoch, count(*) AS n_epochs
FROM c GROUP BY run""")
def q_early_stop(spark, sf_dir):
    m = X.metric_log(spark, sf_dir).select("run", F.col("step").alias("epoch"), F.col("value").alias("loss"))
    return V.early_stop(m, dense=True)   # steps are row numbers


@register("eval_cadence", W("metric_log") + """
SELECT run, step, value FROM metric_log WHERE step % 50 = 0""")
def q_eval_cadence(spark, sf_dir):
    return V.eval_cadence(X.metric_log(spark, sf_dir), 50)


@register("confusion_matrix", W("labelled") + """
SELECT actual, predicted, count(*) AS n FROM labelled GROUP BY actual, predicted""")
def q_confusion_matrix(spark, sf_dir):
    return V.confusion_matrix(X.labelled(spark, sf_dir))


@register("class_report", W("labelled") + """
, cm AS (SELECT actual, predicted, count(*) AS n FROM labelled GROUP BY ALL)
, u AS (SELECT actual AS label, n, 'a' AS k, actual = predicted AS hit FROM cm
        UNION ALL SELECT predicted AS label, n, 'p' AS k, actual = predicted AS hit FROM cm)
, g AS (SELECT label, sum(CASE WHEN k = 'a' THEN n ELSE 0 END) AS support,
               sum(CASE WHEN k = 'p' THEN n ELSE 0 END) AS n_pred,
               sum(CASE WHEN k = 'a' AND hit THEN n ELSE 0 END) AS tp FROM u GROUP BY label)
, h AS (SELECT label, support, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM g)
SELECT label, precision, recall,
       CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
       CAST(support AS BIGINT) AS support
FROM h""")
def q_class_report(spark, sf_dir):
    return V.class_report(X.labelled(spark, sf_dir))


@register("accuracy", """
WITH l AS (SELECT d.doc_id, l.quality AS actual, l.toxic AS predicted, l.doc_id IS NOT NULL AS scored
           FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT sum(CAST(scored AND actual = predicted AS INTEGER)) / sum(CAST(scored AS INTEGER)) AS acc_scored,
       sum(CAST(coalesce(scored AND actual = predicted, false) AS INTEGER)) / count(*) AS acc_reference
FROM l""")
def q_accuracy(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("doc_id")
    lab = X.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("actual"),
                                                  F.col("toxic").alias("predicted"), F.lit(True).alias("scored"))
    j = d.join(lab, "doc_id", "left").withColumn("scored", F.coalesce("scored", F.lit(False)))
    return V.accuracy(j)
