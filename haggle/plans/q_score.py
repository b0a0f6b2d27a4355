"""Registered queries for scoring and rewards and the flagship
negotiation summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scan
from ..functions.hashing import sql_md5_int
from ..labels import VARIANTS, sql_values
from ..operators import dialogue as D
from ..operators import extract as E
from ..operators import linear as L
from ..operators import score as S
from ..sources import fixtures as X
from .q_classify import sql_buckets, sql_words
from .q_extract import LABELS_ALIAS_SQL, OUTCOME, TAGGED, nego_outcome, sql_tag_last, tagged_with_tags
from .registry import register

W = X.with_views


def intent_model(spark, sf_dir):
    """The per-role intent classifier of the rewards: naive Bayes on word buckets, counted
    over the train split of the negotiation's labelled utterances."""
    rows = X._nego_rows(spark, sf_dir).select("event_id", F.col("speaker").alias("role"), "utterance", "intent")
    rows = D.split_rows(E.label_encode(rows, role="role", label="intent"), seed=42, key_cols=("event_id",)).where("split = 'train'")
    return L.counted_model(L.count_table(rows.withColumn("features", L.word_buckets("utterance"))), X.CLASS_COUNTS)


def intent_prob(spark, sf_dir, *, text: str, role: str):
    """f(label id) -> probability that the classifier gives the text from its marker on."""
    model = intent_model(spark, sf_dir)
    return lambda eff: L.label_proba(model, F.col(role), L.word_buckets(E.after_marker_expr(text)), eff, spark)


SQL_AFTER = "CASE WHEN instr({t}, 'next') > 0 THEN substr({t}, instr({t}, 'next')) ELSE {t} END"
SQL_CLASSES = sql_values([(r, c) for r, k in X.CLASS_COUNTS.items() for c in range(k)], ["role", "c"], "k")
X.EXTRA_VIEWS["ib_f"] = f"""
SELECT role, label_id, unnest(list_append({sql_buckets(sql_words('utterance'))}, -1)) AS b
FROM (SELECT n.utterance, n.speaker AS role, la.label_id FROM nego n
      JOIN {LABELS_ALIAS_SQL} ON la.lrole = n.speaker AND la.alias_lower = lower(n.intent)
      WHERE {sql_md5_int(42, 'n.event_id')} % 1000 < 800)"""
X.EXTRA_VIEWS["ib_w"] = f"""
SELECT k.role, f.b, k.c, CASE WHEN f.b = -1 THEN ln((coalesce(n.n, 0) + 1.0) / (f.n + f.k)) ELSE ln(coalesce(n.n, 0) + 1.0) - ln(coalesce(t.n, 0) + 2.0) END AS w
FROM {SQL_CLASSES}
JOIN (SELECT role, b, count(*) AS n, CASE WHEN role = 0 THEN {X.CLASS_COUNTS[0]} ELSE {X.CLASS_COUNTS[1]} END AS k FROM ib_f GROUP BY ALL) f ON f.role = k.role
LEFT JOIN (SELECT role, b, label_id, count(*) AS n FROM ib_f GROUP BY ALL) n ON n.role = k.role AND n.b = f.b AND n.label_id = k.c
LEFT JOIN (SELECT role, label_id, count(*) AS n FROM ib_f WHERE b = -1 GROUP BY ALL) t ON t.role = k.role AND t.label_id = k.c"""
INTENT_BAYES = ("ib_f", "ib_w")


def sql_intent_prob(rows: str, keys: str, text: str, role: str, label: str) -> str:
    """Subquery (keys, p): probability of ``label`` for each row of ``rows``."""
    return f"""(SELECT {keys}, round(max(CASE WHEN c = lab THEN exp(z - top) END) / sum(exp(z - top)), {L.PLACES}) AS p FROM (
  SELECT *, max(z) OVER (PARTITION BY {keys}) AS top FROM (
    SELECT {keys}, r.lab, w.c, sum(w.w) AS z
    FROM (SELECT {keys}, {role} AS role, {label} AS lab, unnest(list_append({sql_buckets(sql_words(SQL_AFTER.format(t=text)))}, -1)) AS b
          FROM {rows} WHERE {label} IS NOT NULL) r
    JOIN ib_w w ON w.role = r.role AND w.b = r.b GROUP BY ALL)) GROUP BY {keys})"""


# ---------------------------------------------------------------- summary

def negotiation_summary(spark, sf_dir):
    """Per conversation: opening price, final price, outcome, price gap,
    strategy score and composite reward of the final turn (intent score of
    the final turn's own text, similarity off)."""
    out = nego_outcome(spark, sf_dir, keep_text=True)
    out = S.negotiation_strategy(S.prize_gap(out))
    out = E.label_encode(E.intent_tag_last(out, text="last_text", role="last_role", out="tag"),
                         role="last_role", label="tag")
    out = (out.withColumnRenamed("last_turn", "turn_no").withColumn("cand", F.lit(0))
           .withColumn("is_final", F.lit(True)).withColumn("similarity", F.lit(0.0)))
    out = S.composite_reward(S.intent_reward(out, intent_prob(spark, sf_dir, text="last_text", role="last_role"), strict=True))
    return out.select("conv_id", "opening_price", "final_price", "outcome", "prize_gap", "strategy",
                      "intent_score", "reward")


X.EXTRA_VIEWS["nego_l"] = f"""
SELECT t.*, la.label_id FROM (SELECT *, {sql_tag_last('text', 'role_id')} AS tag
  FROM (SELECT *, CAST(CASE WHEN substr(text, 1, 1) = 'A' THEN 0 ELSE 1 END AS INTEGER) AS role_id FROM nego_m)) t
LEFT JOIN {LABELS_ALIAS_SQL} ON la.lrole = t.role_id AND la.alias_lower = lower(t.tag)"""

SQL_STRATEGY = """CASE WHEN (final_price - reservation_price) / (final_price + 1.0)
                         * CASE WHEN outcome = 'Accept' THEN 1.0 ELSE -1.0 END >= 0
     THEN exp((final_price - reservation_price) / (final_price + 1.0) * CASE WHEN outcome = 'Accept' THEN 1.0 ELSE -1.0 END)
     WHEN final_price IS NOT NULL THEN 0.0 END"""


@register("negotiation_summary", W(*OUTCOME, "nego_l", *INTENT_BAYES) + f"""
, o AS (SELECT *, CAST(final_price AS DOUBLE) / NULLIF(CAST(opening_price AS DOUBLE), 0) AS prize_gap,
               {SQL_STRATEGY} AS strategy FROM outcome)
, l AS (SELECT n.conv_id, n.turn_no AS last_turn, n.turn_no, n.role_id, n.text, n.label_id
        FROM nego_l n JOIN outcome x ON x.conv_id = n.conv_id AND x.last_turn = n.turn_no)
, li AS (SELECT l.conv_id, l.last_turn, CASE WHEN l.label_id IS NULL THEN 0.54 ELSE s.p END AS intent_score
         FROM l LEFT JOIN {sql_intent_prob('l', 'conv_id, turn_no', 'text', 'role_id', 'label_id')} s ON s.conv_id = l.conv_id AND s.turn_no = l.turn_no)
SELECT o.conv_id, opening_price, final_price, outcome, prize_gap, strategy, intent_score,
       0.2 * coalesce(intent_score, 0.0) + 0.3 * coalesce(prize_gap, 0.0) + 0.3 * coalesce(strategy, 0.0) - 0.2 * 0.0 AS reward
FROM o LEFT JOIN li ON li.conv_id = o.conv_id AND li.last_turn = o.last_turn""")
def q_negotiation_summary(spark, sf_dir):
    return negotiation_summary(spark, sf_dir)


@register("prize_gap", W(*OUTCOME) + """
SELECT conv_id, CAST(final_price AS DOUBLE) / NULLIF(CAST(opening_price AS DOUBLE), 0) AS prize_gap FROM outcome""")
def q_prize_gap(spark, sf_dir):
    return S.prize_gap(nego_outcome(spark, sf_dir)).select("conv_id", "prize_gap")


@register("negotiation_strategy", W(*OUTCOME) + f"""
SELECT conv_id, outcome, {SQL_STRATEGY} AS strategy FROM outcome""")
def q_negotiation_strategy(spark, sf_dir):
    return S.negotiation_strategy(nego_outcome(spark, sf_dir)).select(
        "conv_id", "outcome", "strategy")


# ---------------------------------------------------------------- similarity

def turn_candidates(spark, sf_dir):
    """Three whole texts per turn: its reply, the next reply and the same
    speaker's previous one (empty text where there is none); the two previous
    replies are the context."""
    t = X.turns(spark, sf_dir).select("conv_id", "turn_no", "utterance",
                                      F.when(F.col("speaker") == 0, F.col("utterance")).alias("_b"),
                                      F.when(F.col("speaker") == 1, F.col("utterance")).alias("_s"), "speaker")
    t = scan.multi_scan(t, "conv_id", "turn_no", fill={"_b": "_pb", "_s": "_ps"}, fill_exclusive=True, nxt=["utterance"],
                        prv=["utterance"], prv_two=True)
    own = F.when(F.col("speaker") == 0, F.col("_pb")).otherwise(F.col("_ps"))
    texts = F.array("utterance", F.coalesce("next_utterance", F.lit("")), F.coalesce(own, F.lit("")))
    return t.select("conv_id", "turn_no", "prev_2_utterance", "prev_utterance",
                    F.posexplode(texts).alias("cand", "cand_text"))


CONTEXTS = ("prev_2_utterance", "prev_utterance")   # oldest first


X.EXTRA_VIEWS["turn_cands"] = """
SELECT conv_id, turn_no, cand,
       CASE cand WHEN 0 THEN utterance WHEN 1 THEN coalesce(next_utterance, '') ELSE coalesce(own_previous, '') END AS cand_text
FROM (SELECT *, CAST(unnest(range(0, 3)) AS INTEGER) AS cand FROM (
  SELECT *, lead(utterance) OVER (PARTITION BY conv_id ORDER BY turn_no) AS next_utterance,
         lag(utterance) OVER (PARTITION BY conv_id, speaker ORDER BY turn_no) AS own_previous FROM turns))"""


def sql_context(view: str) -> str:
    return f"""
SELECT conv_id, turn_no, ctx_pos, ctx_text FROM (
  SELECT conv_id, turn_no, 0 AS ctx_pos, lag(utterance, 2) OVER w AS ctx_text FROM {view}
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn_no)
  UNION ALL
  SELECT conv_id, turn_no, 1 AS ctx_pos, lag(utterance, 1) OVER w AS ctx_text FROM {view}
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn_no)) WHERE ctx_text IS NOT NULL"""


def sql_similarity(cands: str, ctx: str, accumulate: bool, p: str = "sim") -> str:
    """CTE chain ending in view ``{p}`` (conv_id, turn_no, cand, similarity)."""
    final = ("sum(s) OVER (PARTITION BY conv_id, turn_no ORDER BY cand ROWS UNBOUNDED PRECEDING) / "
             "sum(n) OVER (PARTITION BY conv_id, turn_no ORDER BY cand ROWS UNBOUNDED PRECEDING)"
             if accumulate else "s / n")
    return f"""
, {p}_ctx AS (SELECT *, min(length(ctx_text)) OVER (PARTITION BY conv_id, turn_no ORDER BY ctx_pos
                                                    ROWS UNBOUNDED PRECEDING) AS minlen FROM {ctx})
, {p}_pairs AS (SELECT c.conv_id, c.turn_no, c.cand, x.ctx_pos,
                   substr(c.cand_text, 1, least(length(c.cand_text), x.minlen)) AS a, x.ctx_text AS b
                FROM {cands} c JOIN {p}_ctx x ON x.conv_id = c.conv_id AND x.turn_no = c.turn_no)
, {p}_wa AS (SELECT conv_id, turn_no, cand, ctx_pos, w, count(*) AS na
             FROM (SELECT conv_id, turn_no, cand, ctx_pos, unnest(string_split(lower(a), ' ')) AS w FROM {p}_pairs)
             GROUP BY ALL)
, {p}_wb AS (SELECT conv_id, turn_no, cand, ctx_pos, w, count(*) AS nb
             FROM (SELECT conv_id, turn_no, cand, ctx_pos, unnest(string_split(lower(b), ' ')) AS w FROM {p}_pairs)
             GROUP BY ALL)
, {p}_sa AS (SELECT conv_id, turn_no, cand, ctx_pos, sum(na * na) AS sa FROM {p}_wa GROUP BY ALL)
, {p}_sb AS (SELECT conv_id, turn_no, cand, ctx_pos, sum(nb * nb) AS sb FROM {p}_wb GROUP BY ALL)
, {p}_dot AS (SELECT a.conv_id, a.turn_no, a.cand, a.ctx_pos, sum(na * nb) AS dot FROM {p}_wa a JOIN {p}_wb b
              USING (conv_id, turn_no, cand, ctx_pos, w) GROUP BY ALL)
, {p}_cos AS (SELECT a.conv_id, a.turn_no, a.cand, a.ctx_pos, coalesce(d.dot, 0) / (sqrt(sa) * sqrt(sb)) AS cos
              FROM {p}_sa a JOIN {p}_sb b USING (conv_id, turn_no, cand, ctx_pos)
              LEFT JOIN {p}_dot d USING (conv_id, turn_no, cand, ctx_pos))
, {p}_per AS (SELECT conv_id, turn_no, cand, sum(cos) AS s, count(*) AS n FROM {p}_cos GROUP BY ALL)
, {p}_acc AS (SELECT conv_id, turn_no, cand, {final} AS similarity FROM {p}_per)
, {p} AS (SELECT c.conv_id, c.turn_no, c.cand, coalesce(a.similarity, 0.0) AS similarity
          FROM {cands} c LEFT JOIN {p}_acc a USING (conv_id, turn_no, cand))"""


X.EXTRA_VIEWS["turn_ctx"] = sql_context("turns")


@register("surface_similarity", W("turns", "turn_cands", "turn_ctx") + sql_similarity("turn_cands", "turn_ctx", True)
          .lstrip().lstrip(",").join([", ", ""]) + """
SELECT conv_id, turn_no, cand, similarity FROM sim""")
def q_surface_similarity(spark, sf_dir):
    return S.surface_similarity(turn_candidates(spark, sf_dir), CONTEXTS, accumulate=True)


@register("surface_similarity_each", W("turns", "turn_cands", "turn_ctx") + sql_similarity("turn_cands", "turn_ctx", False)
          .lstrip().lstrip(",").join([", ", ""]) + """
SELECT conv_id, turn_no, cand, similarity FROM sim""")
def q_surface_similarity_each(spark, sf_dir):
    return S.surface_similarity(turn_candidates(spark, sf_dir), CONTEXTS, accumulate=False)


# ---------------------------------------------------------------- rewards

X.EXTRA_VIEWS["tagged_e"] = """
SELECT *, last_value(label_id IGNORE NULLS) OVER (PARTITION BY conv_id, turn_no ORDER BY cand
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eff FROM tagged_l"""
X.EXTRA_VIEWS["tagged_i"] = f"""
SELECT t.*, CASE WHEN t.eff IS NULL THEN 0.54 ELSE s.p END AS intent_score
FROM tagged_e t LEFT JOIN {sql_intent_prob('tagged_e', 'conv_id, turn_no, cand', 'cand_text', 'role_id', 'eff')} s USING (conv_id, turn_no, cand)"""
X.EXTRA_VIEWS["nego_ctx"] = sql_context("nego")
TAGGED_I = (*TAGGED, "tagged_l", *INTENT_BAYES, "tagged_e", "tagged_i")


@register("intent_reward", W(*TAGGED_I) + """
SELECT conv_id, turn_no, cand, label_id, intent_score FROM tagged_i""")
def q_intent_reward(spark, sf_dir):
    r = S.intent_reward(tagged_with_tags(spark, sf_dir), intent_prob(spark, sf_dir, text="cand_text", role="role_id"))
    return r.select("conv_id", "turn_no", "cand", "label_id", "intent_score")


def scored_candidates(spark, sf_dir):
    """Every tagged candidate with intent score, similarity to the two
    previous utterances, and (on the final turn) gap and strategy."""
    ti = S.intent_reward(tagged_with_tags(spark, sf_dir), intent_prob(spark, sf_dir, text="cand_text", role="role_id"))
    sim = S.surface_similarity(ti, CONTEXTS, accumulate=True, keep=["intent_score"])
    out = S.negotiation_strategy(S.prize_gap(nego_outcome(spark, sf_dir)))
    fin = out.select("conv_id", F.col("last_turn").alias("turn_no"), "prize_gap", "strategy",
                     F.lit(True).alias("is_final"))
    return (sim.join(fin, ["conv_id", "turn_no"], "left")
            .withColumn("is_final", F.coalesce("is_final", F.lit(False))))


SCORED_SQL = (W(*TAGGED_I, *OUTCOME[3:], "nego_ctx")
              + sql_similarity("tagged_i", "nego_ctx", True)
              + f"""
, o AS (SELECT conv_id, last_turn AS turn_no, CAST(final_price AS DOUBLE) / NULLIF(CAST(opening_price AS DOUBLE), 0) AS prize_gap,
               {SQL_STRATEGY} AS strategy, true AS is_final FROM outcome)
, scored AS (SELECT t.conv_id, t.turn_no, t.cand, t.intent_score, s.similarity, o.prize_gap, o.strategy,
                    coalesce(o.is_final, false) AS is_final
             FROM tagged_i t LEFT JOIN sim s USING (conv_id, turn_no, cand)
             LEFT JOIN o USING (conv_id, turn_no))
""")
SQL_REWARD = ("{ui} * 0.2 * coalesce(intent_score, 0.0)"
              " + {ug} * 0.3 * CASE WHEN is_final THEN 1.0 ELSE 0.0 END * coalesce(prize_gap, 0.0)"
              " + {us} * 0.3 * CASE WHEN is_final THEN 1.0 ELSE 0.0 END * coalesce(strategy, 0.0)"
              " - {um} * 0.2 * coalesce(similarity, 0.0)")


@register("composite_reward", SCORED_SQL + f"""
SELECT conv_id, turn_no, cand, {SQL_REWARD.format(ui=1, ug=1, us=1, um=1)} AS reward FROM scored""")
def q_composite_reward(spark, sf_dir):
    return S.composite_reward(scored_candidates(spark, sf_dir)).select("conv_id", "turn_no", "cand", "reward")


@register("reward_ablation", SCORED_SQL + f"""
SELECT variant, avg({SQL_REWARD.format(ui='use_intent', ug='use_gap', us='use_strategy', um='use_similarity')}) AS mean_reward,
       count(*) AS n
FROM scored CROSS JOIN {sql_values(VARIANTS, ['variant', 'use_intent', 'use_gap', 'use_strategy', 'use_similarity'], 'v')}
GROUP BY variant""")
def q_reward_ablation(spark, sf_dir):
    return S.reward_ablation(scored_candidates(spark, sf_dir))


# ---------------------------------------------------------------- vectors

@register("embedding_cosine", """
WITH ex AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x
            FROM embeddings)
, topic AS (SELECT label, list(m ORDER BY i) AS topic FROM (SELECT label, i, avg(x) AS m FROM ex GROUP BY ALL) GROUP BY label)
, e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT vec_id, label, list_dot_product(v, topic) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(topic, topic))) AS cosine
FROM e JOIN topic USING (label)""")
def q_embedding_cosine(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings")
    return S.embedding_cosine(e, S.centroids(e)).select("vec_id", "label", "cosine")


def _turn_pairs(spark, sf_dir):
    """Each reply with the previous reply of its conversation (turns without
    one are left out)."""
    t = X.turns(spark, sf_dir).select("conv_id", "turn_no", F.col("utterance").alias("hyp"))
    t = scan.shift(t, "conv_id", "turn_no", ["hyp"], direction=-1, prefix="prev_")
    return t.where("prev_hyp IS NOT NULL").withColumnRenamed("prev_hyp", "ref")


def sql_meteor_views() -> None:
    words = "list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda x: x <> '')"
    X.EXTRA_VIEWS["mt_pairs"] = """
SELECT conv_id, turn_no, utterance AS hyp, lag(utterance) OVER (PARTITION BY conv_id ORDER BY turn_no) AS ref
FROM turns QUALIFY ref IS NOT NULL"""
    for side, col in (("mt_h", "hyp"), ("mt_r", "ref")):
        X.EXTRA_VIEWS[side] = f"""
SELECT conv_id, turn_no, w, pos, row_number() OVER (PARTITION BY conv_id, turn_no, w ORDER BY pos DESC) AS k FROM (
  SELECT conv_id, turn_no, unnest(ws) AS w, unnest(range(0, len(ws))) AS pos
  FROM (SELECT conv_id, turn_no, {words.format(c=col)} AS ws FROM mt_pairs))"""
    X.EXTRA_VIEWS["mt"] = """
SELECT p.conv_id, p.turn_no,
       CASE WHEN coalesce(a.m, 0) > 0 THEN floor(
         (CAST(a.m AS DOUBLE) / nh.n) * (CAST(a.m AS DOUBLE) / nr.n)
           / (CAST(0.9 AS DOUBLE) * (CAST(a.m AS DOUBLE) / nh.n) + CAST(0.1 AS DOUBLE) * (CAST(a.m AS DOUBLE) / nr.n))
         * (1 - CAST(0.5 AS DOUBLE) * ((a.chunks / a.m) * (a.chunks / a.m) * (a.chunks / a.m))) * 100 + 0.5) / 100
       ELSE 0.0 END AS meteor
FROM mt_pairs p
LEFT JOIN (SELECT conv_id, turn_no, count(*) AS n FROM mt_h GROUP BY ALL) nh USING (conv_id, turn_no)
LEFT JOIN (SELECT conv_id, turn_no, count(*) AS n FROM mt_r GROUP BY ALL) nr USING (conv_id, turn_no)
LEFT JOIN (SELECT conv_id, turn_no, count(*) AS m, sum(brk) AS chunks FROM (
             SELECT *, CASE WHEN lag(hpos) OVER o = hpos - 1 AND lag(rpos) OVER o = rpos - 1 THEN 0 ELSE 1 END AS brk
             FROM (SELECT h.conv_id, h.turn_no, h.pos AS hpos, r.pos AS rpos FROM mt_h h JOIN mt_r r
                   ON h.conv_id = r.conv_id AND h.turn_no = r.turn_no AND h.w = r.w AND h.k = r.k)
             WINDOW o AS (PARTITION BY conv_id, turn_no ORDER BY hpos)) GROUP BY ALL) a USING (conv_id, turn_no)"""


sql_meteor_views()
METEOR_VIEWS = ("turns", "mt_pairs", "mt_h", "mt_r", "mt")


@register("meteor_pair", W(*METEOR_VIEWS) + "SELECT conv_id, turn_no, meteor FROM mt")
def q_meteor_pair(spark, sf_dir):
    """Each reply scored against the previous reply; mean per conversation
    is ``validation_report``'s METEOR input."""
    return S.meteor_pair(_turn_pairs(spark, sf_dir), keys=("conv_id", "turn_no"))


X.EXTRA_VIEWS["sm"] = """
SELECT grp, label, item, logit, logp, exp(logp) AS prob FROM (
  SELECT *, (logit / 0.8 - max(logit / 0.8) OVER (PARTITION BY grp))
            - ln(sum(exp(logit / 0.8 - max(logit / 0.8) OVER (PARTITION BY grp))) OVER (PARTITION BY grp)) AS logp
  FROM logits)"""
X.EXTRA_VIEWS["sm1"] = """
SELECT grp, label, item, logit, logp, exp(logp) AS prob FROM (
  SELECT grp, label, item, logit, z - ln(sum(exp(z)) OVER (PARTITION BY grp)) AS logp
  FROM (SELECT *, logit - max(logit) OVER (PARTITION BY grp) AS z FROM logits))"""


@register("group_softmax", W("logits") + """
, z AS (SELECT *, logit / 0.8 - max(logit / 0.8) OVER (PARTITION BY grp) AS zm FROM logits)
SELECT grp, item, zm - ln(sum(exp(zm)) OVER (PARTITION BY grp)) AS logp,
       exp(zm - ln(sum(exp(zm)) OVER (PARTITION BY grp))) AS prob FROM z""")
def q_group_softmax(spark, sf_dir):
    return S.group_softmax(X.logits(spark, sf_dir)).select("grp", "item", "logp", "prob")


@register("nucleus_filter", W("logits", "sm1") + """
SELECT grp, item, mass_before FROM (
  SELECT grp, item, coalesce(sum(prob) OVER (PARTITION BY grp ORDER BY logit DESC, item
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS mass_before
  FROM sm1) WHERE mass_before <= 0.92""")
def q_nucleus_filter(spark, sf_dir):
    return S.nucleus_filter(X.logits(spark, sf_dir), p=0.92).select("grp", "item", "mass_before")


@register("categorical_draw", W("logits") + f"""
, z AS (SELECT *, logit / 0.8 - max(logit / 0.8) OVER (PARTITION BY grp) AS zm FROM logits)
, p AS (SELECT grp, item, exp(zm - ln(sum(exp(zm)) OVER (PARTITION BY grp))) AS prob FROM z)
SELECT grp, arg_min(item, -ln(({sql_md5_int(42, 'grp', 'item')} + 0.5) / 4294967296.0) / prob) AS drawn
FROM p WHERE prob > 0 GROUP BY grp""")
def q_categorical_draw(spark, sf_dir):
    return S.categorical_draw(S.group_softmax(X.logits(spark, sf_dir)), seed=42)


@register("masked_logprob", W("logits", "sm1") + """
SELECT grp AS seq, sum(logp * CASE WHEN item >= 1 THEN 1 ELSE 0 END) AS seq_logprob,
       sum(logp * CASE WHEN item >= 1 THEN 1 ELSE 0 END) / sum(CASE WHEN item >= 1 THEN 1 ELSE 0 END) AS seq_logprob_mean
FROM sm1 GROUP BY grp""")
def q_masked_logprob(spark, sf_dir):
    d = S.group_softmax(X.logits(spark, sf_dir), temperature=1.0) \
         .select(F.col("grp").alias("seq"), "logp", F.when(F.col("item") >= 1, 1).otherwise(0).alias("mask"))
    return S.masked_logprob(d, both=True)


def token_nll(spark, sf_dir):
    """One token per vector: target class = its label; nll = -log p(label);
    smooth = mean of -log p over all classes; sequences of 8 tokens."""
    sm = S.group_softmax(X.logits(spark, sf_dir), temperature=1.0)
    per = sm.groupBy("grp").agg(
        F.max(F.when(F.col("item") == F.col("label"), -F.col("logp"))).alias("nll"),
        (-F.avg("logp")).alias("smooth"))
    return per.select(F.floor(F.col("grp") / 8).cast("long").alias("seq"), "grp", "nll", "smooth",
                      F.lit(1).alias("mask"))


X.EXTRA_VIEWS["tok_nll"] = """
SELECT CAST(floor(grp / 8) AS BIGINT) AS seq, grp, max(CASE WHEN item = label THEN -logp END) AS nll,
       -avg(logp) AS smooth, 1 AS mask
FROM sm1 GROUP BY grp"""


@register("sequence_ce", W("logits", "sm1", "tok_nll") + """
SELECT seq, sum(((1 - 0.1) * nll + 0.1 * smooth) * mask) / sum(mask) AS loss FROM tok_nll GROUP BY seq""")
def q_sequence_ce(spark, sf_dir):
    return S.sequence_ce(token_nll(spark, sf_dir), smooth="smooth", epsilon=0.1, reduce="sentence")


@register("sequence_ce_batch", W("logits", "sm1", "tok_nll") + """
SELECT avg(loss) AS loss FROM (
  SELECT seq, sum(((1 - 0.1) * nll + 0.1 * smooth) * mask) / sum(mask) AS loss FROM tok_nll GROUP BY seq)""")
def q_sequence_ce_batch(spark, sf_dir):
    return S.sequence_ce(token_nll(spark, sf_dir), smooth="smooth", epsilon=0.1, reduce="batch")


@register("sequence_ce_none", W("logits", "sm1", "tok_nll") + """
SELECT seq, grp, ((1 - 0.1) * nll + 0.1 * smooth) * mask AS loss FROM tok_nll""")
def q_sequence_ce_none(spark, sf_dir):
    return S.sequence_ce(token_nll(spark, sf_dir), smooth="smooth", epsilon=0.1, reduce="none").select("seq", "grp", "loss")


@register("perplexity", W("logits", "sm1", "tok_nll") + """
SELECT seq, exp(sum(nll * mask) / sum(mask)) AS perplexity FROM tok_nll GROUP BY seq""")
def q_perplexity(spark, sf_dir):
    return S.perplexity(token_nll(spark, sf_dir))
