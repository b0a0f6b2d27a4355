"""Registered queries for text and array extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import sql_strip_ws
from ..labels import BUYER_INTENTS, SELLER_INTENTS, label_rows, sql_values
from ..operators import dialogue as D
from ..operators import dictionary as DI
from ..operators import extract as E
from ..sources import fixtures as X
from .q_dialogue import rendered_turns, rendered_with_lead
from .registry import register

W = X.with_views

X.EXTRA_VIEWS["nego_x"] = """
SELECT *, CASE WHEN lead(turn_no) OVER w IS NULL THEN '<|end|>' ELSE lead(utterance) OVER w END AS next_utterance,
          CASE WHEN lead(turn_no) OVER w IS NULL THEN '<|end|>' ELSE lead(intent) OVER w END AS next_intent
FROM nego_r WINDOW w AS (PARTITION BY conv_id ORDER BY turn_no)"""
X.EXTRA_VIEWS["tagged"] = X._tagged_sql()
X.EXTRA_VIEWS["logits"] = X.LOGITS_SQL
X.EXTRA_VIEWS["tokens"] = X.TOKENS_SQL
X.EXTRA_VIEWS["turns_e"] = f"SELECT *, {X.sql_example(True)} AS example FROM turns_x"
TAGGED = ("nego", "nego_f", "nego_r", "nego_x", "tagged")


def _sql_list(xs) -> str:
    return "[" + ", ".join("'" + x.lower() + "'" for x in xs) + "]"


def sql_tag_last(text: str = "cand_text", role: str = "role_id") -> str:
    labs = f"(CASE WHEN {role} = 0 THEN {_sql_list(BUYER_INTENTS)} ELSE {_sql_list(SELLER_INTENTS)} END)"
    after = f"(CASE WHEN instr({text}, 'next') > 0 THEN substr({text}, instr({text}, 'next')) ELSE {text} END)"
    words = f"list_transform(string_split(lower({after}), ' '), lambda w: {sql_strip_ws('w')})"
    hits = f"list_filter({words}, lambda w: len(list_filter({labs}, lambda k: instr(w, k) > 0)) > 0)"
    last = f"({hits})[-1]"
    pick = (f"(list_filter({labs}, lambda k: instr({last}, k) > 0 AND "
            f"len(string_split(k, '_')) = len(string_split({last}, '_'))))[1]")
    return f"coalesce({pick}, 'NA')"


def sql_tag_marked(text: str = "cand_text", role: str = "role_id") -> str:
    found = f"regexp_extract_all({text}, '(?:intent:|intent of)\\s+(\\S+)', 1)"
    word = f"lower(({found})[-1])"
    b = {x.lower(): x for x in BUYER_INTENTS}
    s = {x.lower(): x for x in SELLER_INTENTS}
    cb = "CASE " + " ".join(f"WHEN {word} = '{k}' THEN '{v}'" for k, v in b.items()) + " END"
    cs = "CASE " + " ".join(f"WHEN {word} = '{k}' THEN '{v}'" for k, v in s.items()) + " END"
    return f"coalesce(CASE WHEN {role} = 0 THEN {cs} ELSE {cb} END, 'NA')"


LABELS_ALIAS_SQL = sql_values([(r, i, a) for (r, i, _, _, a) in label_rows()],
                              ["lrole", "label_id", "alias_lower"], "la")


def tagged_with_tags(spark, sf_dir):
    t = X.tagged(spark, sf_dir)
    t = E.intent_tag_last(t, text="cand_text", role="role_id", out="tag")
    return E.label_encode(t, role="role_id", label="tag", out="label_id")


X.EXTRA_VIEWS["tagged_l"] = f"""
SELECT t.*, la.label_id FROM (SELECT *, {sql_tag_last()} AS tag FROM tagged) t
LEFT JOIN {LABELS_ALIAS_SQL} ON la.lrole = t.role_id AND la.alias_lower = lower(t.tag)"""


@register("after_marker", W("turns", "turns_f", "turns_r", "turns_x", "turns_e") + """
SELECT conv_id, turn_no,
       CASE WHEN instr(example, 'next') > 0 THEN substr(example, instr(example, 'next')) ELSE example END AS after
FROM turns_e""")
def q_after_marker(spark, sf_dir):
    df = D.example_build(rendered_with_lead(spark, sf_dir), ablation=True)
    return E.after_marker(df, text="example").select("conv_id", "turn_no", "after")


@register("intent_tag_last", W(*TAGGED) + f"""
SELECT conv_id, turn_no, cand, role_id, {sql_tag_last()} AS tag FROM tagged""")
def q_intent_tag_last(spark, sf_dir):
    t = E.intent_tag_last(X.tagged(spark, sf_dir), text="cand_text", role="role_id", out="tag")
    return t.select("conv_id", "turn_no", "cand", "role_id", "tag")


@register("intent_tag_marked", W(*TAGGED) + f"""
SELECT conv_id, turn_no, cand, role_id, {sql_tag_marked()} AS tag FROM tagged""")
def q_intent_tag_marked(spark, sf_dir):
    t = E.intent_tag_marked(X.tagged(spark, sf_dir), text="cand_text", role="role_id", out="tag")
    return t.select("conv_id", "turn_no", "cand", "role_id", "tag")


@register("label_encode", W(*TAGGED, "tagged_l") + """
SELECT conv_id, turn_no, cand, role_id, tag, label_id FROM tagged_l""")
def q_label_encode(spark, sf_dir):
    return tagged_with_tags(spark, sf_dir).select("conv_id", "turn_no", "cand", "role_id", "tag", "label_id")


@register("unknown_labels", W(*TAGGED, "tagged_l") + """
SELECT role_id, tag, count(*) AS n FROM tagged_l WHERE label_id IS NULL GROUP BY role_id, tag""")
def q_unknown_labels(spark, sf_dir):
    t = E.intent_tag_last(X.tagged(spark, sf_dir), text="cand_text", role="role_id", out="tag")
    return E.unknown_labels(t)


def sql_price(e: str) -> str:
    from ..functions.text import sql_price_after_marker
    return sql_price_after_marker(e)


X.EXTRA_VIEWS["nego_o"] = f"""
SELECT n.*, coalesce(CASE WHEN a.ft IS NOT NULL AND n.turn_no >= a.ft THEN a.fp ELSE a.p0 END, 10000) AS opening_price,
       (CASE WHEN a.ft IS NOT NULL AND n.turn_no >= a.ft THEN a.fp ELSE a.p0 END) IS NOT NULL AS price_found
FROM nego_r n JOIN (
  SELECT conv_id,
         min(CASE WHEN p IS NOT NULL AND turn_no >= 2 THEN turn_no END) AS ft,
         arg_min(p, CASE WHEN p IS NOT NULL AND turn_no >= 2 THEN turn_no END) AS fp,
         max(CASE WHEN turn_no = 1 THEN p END) AS p0
  FROM (SELECT conv_id, turn_no, {sql_price('text')} AS p FROM nego_r) GROUP BY conv_id) a USING (conv_id)"""
X.EXTRA_VIEWS["nego_m"] = """
SELECT *, CASE WHEN price_found THEN CAST(0.7 AS DOUBLE) * opening_price ELSE CAST(10000 AS DOUBLE) END AS reservation_price FROM nego_o"""


def nego_priced(spark, sf_dir):
    r = D.role_id(rendered_turns(spark, sf_dir, source="nego"))
    return E.reservation_price(E.opening_price(r))


@register("opening_price", W("nego", "nego_f", "nego_r", "nego_o") + """
SELECT conv_id, turn_no, CAST(opening_price AS BIGINT) AS opening_price, price_found FROM nego_o""")
def q_opening_price(spark, sf_dir):
    r = D.role_id(rendered_turns(spark, sf_dir, source="nego"))
    return E.opening_price(r).select("conv_id", "turn_no", "opening_price", "price_found")


@register("reservation_price", W("nego", "nego_f", "nego_r", "nego_o", "nego_m") + """
SELECT conv_id, turn_no, CAST(reservation_price AS DOUBLE) AS reservation_price FROM nego_m""")
def q_reservation_price(spark, sf_dir):
    return nego_priced(spark, sf_dir).select("conv_id", "turn_no", "reservation_price")


X.EXTRA_VIEWS["outcome"] = f"""
SELECT conv_id, max(turn_no) AS last_turn,
       CASE WHEN arg_max(speaker, turn_no) = 0 THEN 'Reject' ELSE 'Accept' END AS outcome,
       arg_max_null({sql_price('text')}, turn_no) AS final_price,
       CAST(arg_max(opening_price, turn_no) AS BIGINT) AS opening_price,
       CAST(arg_max(reservation_price, turn_no) AS DOUBLE) AS reservation_price,
       arg_max_null({sql_price('text')}, turn_no) - CAST(arg_max(reservation_price, turn_no) AS DOUBLE) AS prize_diff
FROM nego_m GROUP BY conv_id"""
OUTCOME = ("nego", "nego_f", "nego_r", "nego_o", "nego_m", "outcome")


@register("final_outcome", W(*OUTCOME) + """
SELECT conv_id, last_turn, outcome, final_price, opening_price, reservation_price, prize_diff FROM outcome""")
def q_final_outcome(spark, sf_dir):
    return nego_outcome(spark, sf_dir)


def nego_outcome(spark, sf_dir, keep_text=False):
    """Per-conversation outcome of the nego dialogues in one aggregate."""
    r = D.role_id(rendered_turns(spark, sf_dir, source="nego"))
    return E.conversation_outcome(r, keep_text=keep_text)


def _arr_str(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


@register("truncate_at_eos", W("tokens") + """
, t AS (SELECT vec_id, tokens, logp, coalesce(list_position(tokens, 628), 0) AS pe,
               coalesce(list_position(tokens, -1), 0) AS pp FROM tokens)
, u AS (SELECT *, pe > 0 AND (pp = 0 OR pe < pp) AS eos_first FROM t)
, v AS (SELECT *, CASE WHEN eos_first THEN pe WHEN pp > 0 THEN pp - 1 ELSE len(tokens) END AS n FROM u)
SELECT vec_id,
       array_to_string(CASE WHEN eos_first THEN list_concat(list_slice(tokens, 1, n), [198])
                            ELSE list_slice(tokens, 1, n) END, ' ') AS kept_tokens,
       coalesce(list_sum(list_slice(logp, 1, n)), 0.0) AS logp_sum
FROM v""")
def q_truncate_at_eos(spark, sf_dir):
    t = E.truncate_at_eos(X.tokens(spark, sf_dir))
    return t.select("vec_id", _arr_str(F.col("kept_tokens")).alias("kept_tokens"), "logp_sum")


@register("prompt_slice", W("tokens") + """
SELECT vec_id, CAST(len(p) AS INTEGER) AS prompt_len, array_to_string(p, ' ') AS prompt
FROM (SELECT vec_id, list_slice(tokens, 1, CASE WHEN coalesce(list_position(tokens, 197), 0) > 0
                                           THEN list_position(tokens, 197) - 1 ELSE len(tokens) END) AS p
      FROM tokens)""")
def q_prompt_slice(spark, sf_dir):
    t = E.prompt_slice(X.tokens(spark, sf_dir))
    return t.select("vec_id", F.size("prompt").alias("prompt_len"), _arr_str(F.col("prompt")).alias("prompt"))


@register("strip_markers", W("tokens") + """
SELECT vec_id, array_to_string(list_slice(tokens, 3, len(tokens) - 2), ' ') AS stripped FROM tokens""")
def q_strip_markers(spark, sf_dir):
    t = E.strip_markers(X.tokens(spark, sf_dir))
    return t.select("vec_id", _arr_str(F.col("stripped")).alias("stripped"))


# A vocabulary for the token arrays: the words of the part names, numbered from 290 on.
FIRST_TOKEN = 290
X.EXTRA_VIEWS["vocab"] = f"""
SELECT CAST(row_number() OVER (ORDER BY word) - 1 + {FIRST_TOKEN} AS INTEGER) AS token, word AS piece
FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)"""


def vocabulary(spark, sf_dir):
    words = DI.build_dictionary(X.table(spark, sf_dir, "part"), F.split("p_name", " "))
    return words.select((F.col("id") + FIRST_TOKEN).cast("int").alias("token"), F.col("word").alias("piece"))


@register("strip_markers_text", W("tokens", "vocab") + """
, kept AS (SELECT vec_id, list_slice(tokens, 3, len(tokens) - 2) AS kept FROM tokens)
, ex AS (SELECT vec_id, unnest(kept) AS token, unnest(range(0, len(kept))) AS pos FROM kept)
SELECT k.vec_id, coalesce(t.text, '') AS stripped_text FROM kept k
LEFT JOIN (SELECT vec_id, string_agg(piece, '' ORDER BY pos) AS text FROM ex JOIN vocab USING (token) GROUP BY vec_id) t USING (vec_id)""")
def q_strip_markers_text(spark, sf_dir):
    """Stripped token arrays decoded by a vocabulary, which has no piece for some of the tokens."""
    t = E.strip_markers(X.tokens(spark, sf_dir), vocab=vocabulary(spark, sf_dir))
    return t.select("vec_id", "stripped_text")


X.EXTRA_VIEWS["norm_words"] = """
SELECT conv_id, turn_no, list_filter(regexp_split_to_array(
       regexp_replace(lower(utterance), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'), lambda w: w <> '') AS ws FROM turns"""
X.EXTRA_VIEWS["lemmas"] = """
SELECT word, min(lemma) AS lemma FROM (
  SELECT word, regexp_replace(word, '(ing|ed|s)$', '') AS lemma FROM (SELECT DISTINCT unnest(ws) AS word FROM norm_words))
WHERE length(lemma) >= 3 AND lemma <> word GROUP BY word"""


def turn_words(spark, sf_dir):
    return X.turns(spark, sf_dir).select("conv_id", "turn_no", E.normal_words("utterance").alias("words"))


def lemma_table(spark, sf_dir):
    """Lemmas for the words of the turns that end in s, ed or ing."""
    words = DI.word_counts(turn_words(spark, sf_dir), F.col("words")).select(
        "word", F.regexp_replace("word", "(ing|ed|s)$", "").alias("lemma"))
    return words.where((F.length("lemma") >= 3) & (F.col("lemma") != F.col("word")))


@register("normalize_text_lemmas", W("turns", "norm_words", "lemmas") + """
, ex AS (SELECT conv_id, turn_no, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM norm_words)
SELECT n.conv_id, n.turn_no, coalesce(t.norm, '') AS norm FROM norm_words n
LEFT JOIN (SELECT conv_id, turn_no, string_agg(coalesce(lemma, word), ' ' ORDER BY pos) AS norm
           FROM ex LEFT JOIN lemmas USING (word) GROUP BY ALL) t USING (conv_id, turn_no)""")
def q_normalize_text_lemmas(spark, sf_dir):
    """Normalised utterances with every word that has a lemma replaced by it."""
    t = E.normalize_text(X.turns(spark, sf_dir), text="utterance", lemmas=lemma_table(spark, sf_dir))
    return t.select("conv_id", "turn_no", "norm")


@register("dictionary_encode", W("turns", "norm_words") + """
, ex AS (SELECT conv_id, turn_no, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM norm_words)
, dict AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS id FROM (SELECT DISTINCT word FROM ex))
SELECT n.conv_id, n.turn_no, coalesce(t.ids, '') AS ids FROM norm_words n
LEFT JOIN (SELECT conv_id, turn_no, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids
           FROM ex JOIN dict USING (word) GROUP BY ALL) t USING (conv_id, turn_no)""")
def q_dictionary_encode(spark, sf_dir):
    """Utterances as ids of the corpus's dictionary (dense, in the order of the words)."""
    t = turn_words(spark, sf_dir)
    t = DI.encode(t, "words", DI.build_dictionary(t, F.col("words")))
    return t.select("conv_id", "turn_no", _arr_str(F.col("ids")).alias("ids"))


@register("candidate_length", W("turns", "turns_f", "turns_r", "turns_x", "turns_e") + """
SELECT conv_id, turn_no,
       CAST(len(list_filter(regexp_split_to_array(split_part(split_part(example, chr(10), 1), chr(9), 1), '\\s+'),
                            lambda w: w <> '')) AS INTEGER) AS cand_len
FROM turns_e""")
def q_candidate_length(spark, sf_dir):
    df = D.example_build(rendered_with_lead(spark, sf_dir), ablation=True)
    return E.candidate_length(df, text="example").select("conv_id", "turn_no", "cand_len")


@register("normalize_text", W("turns") + """
SELECT conv_id, turn_no,
       array_to_string(list_filter(regexp_split_to_array(
           regexp_replace(lower(utterance), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'), lambda w: w <> ''), ' ') AS norm
FROM turns""")
def q_normalize_text(spark, sf_dir):
    return E.normalize_text(X.turns(spark, sf_dir), text="utterance").select("conv_id", "turn_no", "norm")
