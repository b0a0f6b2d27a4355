"""Registered queries for dialogue assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import sql_md5_int
from ..functions.text import sql_strip_ws
from ..operators import dialogue as D
from ..sources import fixtures as X
from ..sources import io
from .registry import register

W = X.with_views


def rendered_turns(spark, sf_dir, source="turns", variant="full"):
    df = D.price_locf(X.turns(spark, sf_dir)) if source == "turns" else X.nego_scanned(spark, sf_dir)
    return D.turn_render(df, variant)


def rendered_with_lead(spark, sf_dir, source="turns"):
    """Rendered turns with the next turn's utterance and intent, the fill and
    the look-ahead done in one scan pass."""
    df = D.locf_and_lead(X.turns(spark, sf_dir)) if source == "turns" else X.nego_scanned(spark, sf_dir, lead=True)
    return D.turn_render(df)


# DuckDB twins of price_locf / turn_render over a named view ----------------

def sql_locf(view: str) -> str:
    return (f"SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY conv_id, speaker ORDER BY turn_no "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price_filled FROM {view}")


def sql_render(variant: str = "full") -> str:
    utt, intent = sql_strip_ws("utterance"), sql_strip_ws("intent")
    items, bg = sql_strip_ws("items"), sql_strip_ws("background_data")
    ptxt = "coalesce(CAST(price_filled AS VARCHAR), 'NA')"
    b = f"'A:buyer to seller: ''' || {utt}"
    s = f"'B:Seller to buyer: ''' || {utt}"
    if variant in ("full", "intent"):
        b += f" || ''' with intent of ' || {intent}"
        s += f" || ''' with intent of ' || {intent}"
    if variant in ("full", "items_price"):
        b += (f" || CASE WHEN turn_no = 1 THEN ', product description is ' || {bg} ELSE '' END"
              f" || ', buyer asking for: ' || {items}"
              f" || CASE WHEN price IS NOT NULL THEN ',will offer #price $' ELSE ' ,will offer #price $' END"
              f" || {ptxt} || ' , '")
        s += f" || ', seller telling about ' || {items} || ' ,will offer #price $' || {ptxt} || ' , '"
    return f"CASE WHEN speaker = 0 THEN {b} ELSE {s} END"


X.EXTRA_VIEWS["turns_f"] = sql_locf("turns")
X.EXTRA_VIEWS["nego_f"] = sql_locf("nego")
X.EXTRA_VIEWS["turns_r"] = f"SELECT *, {sql_render('full')} AS text FROM turns_f"
X.EXTRA_VIEWS["nego_r"] = f"SELECT *, {sql_render('full')} AS text FROM nego_f"
X.EXTRA_VIEWS["turns_x"] = """
SELECT *, CASE WHEN lead(turn_no) OVER w IS NULL THEN '<|end|>' ELSE lead(utterance) OVER w END AS next_utterance,
          CASE WHEN lead(turn_no) OVER w IS NULL THEN '<|end|>' ELSE lead(intent) OVER w END AS next_intent
FROM turns_r WINDOW w AS (PARTITION BY conv_id ORDER BY turn_no)"""


@register("read_dialogues", W("turns") + """
SELECT conv_id, turn_no, speaker, utterance, intent, price, items, background_data FROM turns""")
def q_read_dialogues(spark, sf_dir):
    # the turn table is written as a CSV in the reference layout ('NA' for a
    # missing price) to the shared scratch folder and read back with the
    # declared schema
    path = io.scratch_path(spark, "dialogues_csv")
    io.write_dialogues_csv(X.turns(spark, sf_dir), path)
    return io.read_dialogues(spark, path).select(
        "conv_id", "turn_no", "speaker", "utterance", "intent", "price", "items", "background_data")


@register("read_dialogues_escaped", W("turns") + """
SELECT conv_id, turn_no, speaker, utterance, intent, price, items, background_data FROM turns""")
def q_read_dialogues_escaped(spark, sf_dir):
    """The same table as CSV with a record per line, which any number of tasks can split."""
    path = io.scratch_path(spark, "dialogues_escaped")
    io.write_dialogues_csv(X.turns(spark, sf_dir), path, escaped=True)
    return io.read_dialogues(spark, path, "csv_escaped").select(
        "conv_id", "turn_no", "speaker", "utterance", "intent", "price", "items", "background_data")


@register("conversation_assemble", W("turns") + """
SELECT conv_id, CAST(floor(turn_no / 256) AS BIGINT) AS part, min(turn_no) AS first_turn,
       count(*) AS n_turns, string_agg(utterance, chr(10) ORDER BY turn_no) AS transcript
FROM turns GROUP BY conv_id, CAST(floor(turn_no / 256) AS BIGINT)""")
def q_conversation_assemble(spark, sf_dir):
    a = D.conversation_assemble(X.turns(spark, sf_dir), part_turns=256)
    return a.select("conv_id", "part", "first_turn", "n_turns",
                    F.array_join(F.transform("turns", lambda t: t["text"]), "\n").alias("transcript"))


@register("next_turn_lead", W("nego") + """
SELECT conv_id, turn_no, speaker,
       CASE WHEN lead(turn_no) OVER w IS NULL THEN '<|end|>' ELSE lead(utterance) OVER w END AS next_utterance,
       CASE WHEN lead(turn_no) OVER w IS NULL THEN '<|end|>' ELSE lead(intent) OVER w END AS next_intent
FROM nego WINDOW w AS (PARTITION BY conv_id ORDER BY turn_no)""")
def q_next_turn_lead(spark, sf_dir):
    # numbering, fill and look-ahead in one pass; next_turn_lead alone is held against it in the tests
    return X.nego_scanned(spark, sf_dir, lead=True).select(
        "conv_id", "turn_no", "speaker", "next_utterance", "next_intent")


@register("price_locf", W("nego", "nego_f") + """
SELECT conv_id, turn_no, speaker, price, price_filled FROM nego_f""")
def q_price_locf(spark, sf_dir):
    return X.nego_scanned(spark, sf_dir).select("conv_id", "turn_no", "speaker", "price", "price_filled")


@register("turn_render", W("turns", "turns_f") + f"""
SELECT conv_id, turn_no, {sql_render('full')} AS text_full, {sql_render('utterance')} AS text_utterance,
       {sql_render('intent')} AS text_intent, {sql_render('items_price')} AS text_items_price
FROM turns_f""")
def q_turn_render(spark, sf_dir):
    df = D.price_locf(X.turns(spark, sf_dir))
    for v in ("full", "utterance", "intent", "items_price"):
        df = D.turn_render(df, v, out=f"text_{v}")
    return df.select("conv_id", "turn_no", "text_full", "text_utterance", "text_intent", "text_items_price")


@register("example_build", W("turns", "turns_f", "turns_r", "turns_x") + """
SELECT conv_id, turn_no,
       text || CASE WHEN substr(text, 1, 1) = 'A' THEN 'next seller response ' || chr(9)
                    WHEN substr(text, 1, 1) = 'B' THEN 'next buyer response ' || chr(9) ELSE chr(9) END
            || next_utterance || 'with intent: ' || chr(9) || next_intent || ' <|end|>' || chr(10) || chr(10) || chr(10)
         AS example
FROM turns_x""")
def q_example_build(spark, sf_dir):
    return D.example_build(rendered_with_lead(spark, sf_dir), ablation=True).select("conv_id", "turn_no", "example")


@register("role_id", W("turns", "turns_f", "turns_r") + """
SELECT conv_id, turn_no, CAST(CASE WHEN substr(text, 1, 1) = 'A' THEN 0 ELSE 1 END AS INTEGER) AS role_id
FROM turns_r""")
def q_role_id(spark, sf_dir):
    return D.role_id(rendered_turns(spark, sf_dir)).select("conv_id", "turn_no", "role_id")


@register("split_conversations", W("nego") + """
, ids AS (SELECT DISTINCT conv_id FROM nego)
, tr AS (SELECT conv_id FROM ids ORDER BY md5(concat_ws(':', '42', CAST(conv_id AS VARCHAR))), conv_id LIMIT 120)
SELECT conv_id, turn_no, CASE WHEN conv_id IN (SELECT conv_id FROM tr) THEN 'train' ELSE 'validation' END AS split
FROM nego""")
def q_split_conversations(spark, sf_dir):
    """A flag per turn: ids from the events as they are, one join."""
    return D.mark_conversations(X.nego(spark, sf_dir).select("conv_id", "turn_no"), 120, seed=42,
                                ids=X._nego_rows(spark, sf_dir))


@register("split_rows", W("turns") + f"""
SELECT conv_id, turn_no,
       CASE WHEN {sql_md5_int(42, 'conv_id', 'turn_no')} % 1000 < 800 THEN 'train'
            WHEN {sql_md5_int(42, 'conv_id', 'turn_no')} % 1000 < 900 THEN 'validation' ELSE 'test' END AS split
FROM turns""")
def q_split_rows(spark, sf_dir):
    return D.split_rows(X.turns(spark, sf_dir)).select("conv_id", "turn_no", "split")


@register("batch_assign", W("turns") + f"""
SELECT conv_id, turn_no, CAST({sql_md5_int(42, 'conv_id', 'turn_no')} % 16 AS INTEGER) AS bucket,
       CAST(floor((row_number() OVER (PARTITION BY {sql_md5_int(42, 'conv_id', 'turn_no')} % 16
            ORDER BY {sql_md5_int('42:order', 'conv_id', 'turn_no')}, conv_id, turn_no) - 1) / 4) AS INTEGER) AS batch_no
FROM turns""")
def q_batch_assign(spark, sf_dir):
    return D.batch_assign(X.turns(spark, sf_dir), 4, seed=42, n_buckets=16).select(
        "conv_id", "turn_no", "bucket", "batch_no")


@register("role_filter", W("turns") + """
SELECT conv_id, turn_no, speaker, intent FROM turns WHERE speaker = 0""")
def q_role_filter(spark, sf_dir):
    return D.role_filter(X.turns(spark, sf_dir), 0).select("conv_id", "turn_no", "speaker", "intent")


@register("context_budget_trim", W("turns") + """
, t AS (SELECT conv_id, turn_no, CAST(len(string_split(utterance, ' ')) AS INTEGER) AS n FROM turns)
, s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
               sum(n) OVER (PARTITION BY conv_id) AS tot,
               max(turn_no) OVER (PARTITION BY conv_id) AS last_pos,
               arg_max(n, turn_no) OVER (PARTITION BY conv_id) AS last_n FROM t)
SELECT conv_id, turn_no, n FROM s WHERE tot <= 300 OR cum < 300 - last_n OR turn_no = last_pos""")
def q_context_budget_trim(spark, sf_dir):
    t = X.turns(spark, sf_dir).select("conv_id", "turn_no", F.size(F.split("utterance", " ")).alias("n"))
    # a budget that the longer conversations of this table exceed
    return D.context_budget_trim(t, 300).select("conv_id", "turn_no", "n")


@register("sliding_context", W("turns") + """
SELECT conv_id, turn_no,
       concat_ws(' || ', lag(utterance, 2) OVER w, lag(utterance) OVER w, utterance) AS context
FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn_no)""")
def q_sliding_context(spark, sf_dir):
    d = D.sliding_context(X.turns(spark, sf_dir), k_prev=2)
    return d.select("conv_id", "turn_no", F.array_join("context", " || ").alias("context"))


@register("expand_candidates", W("turns") + """
SELECT conv_id, turn_no, CAST(unnest(range(0, 3)) AS INTEGER) AS cand FROM turns""")
def q_expand_candidates(spark, sf_dir):
    return D.expand_candidates(X.turns(spark, sf_dir).select("conv_id", "turn_no"), 3)


@register("candidate_group", """
SELECT l_orderkey, l_linenumber, CAST(floor((l_linenumber - 1) / 4) AS BIGINT) AS turn_group,
       (l_linenumber - 1) % 4 = 0 AS is_human
FROM lineitem""")
def q_candidate_group(spark, sf_dir):
    li = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber",
                                                   (F.col("l_linenumber") - 1).alias("idx"))
    return D.candidate_group(li, 3).select("l_orderkey", "l_linenumber", "turn_group", "is_human")
