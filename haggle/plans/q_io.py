"""Registered queries for the sinks: write to the shared
scratch folder, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..labels import DEFAULT_WEIGHTS
from ..operators import evaluate as V
from ..operators import score as S
from ..sources import fixtures as X
from ..sources import io
from .q_dialogue import rendered_turns
from .q_extract import OUTCOME, nego_outcome
from .q_score import SQL_STRATEGY, token_nll
from .registry import register

W = X.with_views


@register("write_transcript", W("turns", "turns_f", "turns_r") + """
SELECT conv_id, CAST(turn_no AS BIGINT) AS line_no, text FROM turns_r
UNION ALL SELECT DISTINCT conv_id, 0, '######conversation ' || CAST(conv_id AS VARCHAR) || '###############' FROM turns_r""")
def q_write_transcript(spark, sf_dir):
    path = io.scratch_path(spark, "transcript")
    io.write_transcript(rendered_turns(spark, sf_dir), path)
    return io.read_transcript(spark, path)


METRICS = ("policy_loss", "approx_kl", "clip_frac", "mean_reward")


def metric_series(spark, sf_dir, run):
    """Every series of a run in long form: the policy metrics per buffer,
    strategy and price gap per conversation, perplexity per sequence; and
    the best step (value = its loss) of each logged run, as that run's."""
    def long(df, step, names, of=F.lit(run)):
        one = [F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for n, c in names.items()]
        return df.select(of.cast("string").alias("run"), F.col(step).cast("long").alias("step"), F.inline(F.array(*one)))
    ppo = V.ppo_metrics(X.samples(spark, sf_dir), by="buffer")
    out = S.negotiation_strategy(S.prize_gap(nego_outcome(spark, sf_dir)))
    ppl = S.perplexity(token_nll(spark, sf_dir))
    best = V.best_checkpoint(X.metric_log(spark, sf_dir))
    return (long(ppo, "buffer", {m: m for m in METRICS})
            .unionByName(long(out, "conv_id", {"strategy_score": "strategy", "prize_gap_score": "prize_gap"}))
            .unionByName(long(ppl, "seq", {"validation_perplexity": "perplexity"}))
            .unionByName(long(best, "best_step", {"best_step": "best_value"}, of=F.col("run"))))


@register("write_metrics", W("samples", *OUTCOME, "logits", "sm1", "tok_nll", "metric_log") + f"""
, m AS (SELECT buffer, avg(least(-reward * exp(new_logp - old_logp),
                                 -reward * least(greatest(exp(new_logp - old_logp), 0.8), 1.2))) AS policy_loss,
               avg((exp(new_logp - old_logp) - 1) - (new_logp - old_logp)) AS approx_kl,
               avg(CASE WHEN abs(exp(new_logp - old_logp) - 1) > 0.2 THEN 1.0 ELSE 0.0 END) AS clip_frac,
               avg(reward) AS mean_reward FROM samples GROUP BY buffer)
, o AS (SELECT conv_id, CAST(final_price AS DOUBLE) / NULLIF(CAST(opening_price AS DOUBLE), 0) AS prize_gap,
               {SQL_STRATEGY} AS strategy FROM outcome)
SELECT 'run-1' AS run, buffer AS step, name, CAST(value AS DOUBLE) AS value FROM m UNPIVOT INCLUDE NULLS (
  value FOR name IN (policy_loss, approx_kl, clip_frac, mean_reward))
UNION ALL SELECT 'run-1', conv_id, 'strategy_score', strategy FROM o
UNION ALL SELECT 'run-1', conv_id, 'prize_gap_score', prize_gap FROM o
UNION ALL SELECT 'run-1', seq, 'validation_perplexity', exp(sum(nll * mask) / sum(mask)) FROM tok_nll GROUP BY seq
UNION ALL SELECT CAST(run AS VARCHAR), arg_min(step, (value, step)), 'best_step', min(value) FROM metric_log GROUP BY run""")
def q_write_metrics(spark, sf_dir):
    path = io.scratch_path(spark, "metrics")
    io.write_metrics(metric_series(spark, sf_dir, "run-1"), path)
    return io.read_metrics(spark, path)


def run_config(**own):
    """A run's configuration: the defaults of the operators, then the caller's fields."""
    g1, g2, g3, g4 = DEFAULT_WEIGHTS
    return {"model_name": "full", "use_intent": True, "use_gap": True, "use_strategy": True, "use_similarity": True,
            "gamma1": g1, "gamma2": g2, "gamma3": g3, "gamma4": g4, "human_reward": V.HUMAN_REWARD,
            "ppo_epsilon": V.PPO_EPSILON, "num_candidates": 3, "context_budget": 1024, "max_candidate_length": 50,
            "top_p": 0.92, "temperature": 0.8, "n_epochs": 5, "batch_size": 1, "evaluate_every": 50, "warmup_steps": 10,
            "learning_rate": 2e-05, "use_recent_past": True, "average_sent_loss": True, "recompute_log_prob": True,
            "seed": 42, **own}


def _sql_literal(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return f"'{v}'"
    return f"CAST({v!r} AS {'DOUBLE' if isinstance(v, float) else 'BIGINT'})"


@register("write_run_config", W("nego") + "SELECT " + ", ".join(f"{_sql_literal(v)} AS {k}" for k, v in run_config().items())
          + ", count(DISTINCT conv_id) AS n_conversations, count(*) AS n_turns FROM nego")
def q_write_run_config(spark, sf_dir):
    n = X._nego_rows(spark, sf_dir).agg(F.countDistinct("conv_id").alias("c"), F.count(F.lit(1)).alias("t")).first()
    path = io.scratch_path(spark, "run_config")
    io.write_run_config(spark, run_config(n_conversations=n.c, n_turns=n.t), path)
    return spark.read.json(path)

