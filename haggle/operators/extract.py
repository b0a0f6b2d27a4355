"""Text and array extraction: per-row native expressions,
higher-order array functions instead of explode + shuffle wherever the work
is bounded by the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.text import price_after_marker, strip_ws
from .dictionary import replace_words
from ..labels import (BUYER_INTENTS, DEFAULT_OPENING_PRICE, RESERVATION_FACTOR, SELLER_INTENTS,
                      label_table)

CONV, POS = "conv_id", "turn_no"

# ---- FIXED VALUES: token ids of the byte-pair vocabulary -----------------
EOS_TOKEN = 628        # blank line, ends a generated reply
NEWLINE_TOKEN = 198    # appended after the end token
TAB_TOKEN = 197        # separates prompt from continuation
PAD_TOKEN = -1


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _role_labels(role: Column, lower: bool = True) -> Column:
    f = (lambda s: s.lower()) if lower else (lambda s: s)
    buyer = F.array(*[F.lit(f(x)) for x in BUYER_INTENTS])
    seller = F.array(*[F.lit(f(x)) for x in SELLER_INTENTS])
    return F.when(role == 0, buyer).otherwise(seller)


def after_marker_expr(text) -> Column:
    t = _c(text)
    i = F.instr(t, "next")
    return F.when(i > 0, t.substr(i, F.length(t))).otherwise(t)


def after_marker(df: DataFrame, *, text: str = "text", out: str = "after") -> DataFrame:
    """Text from the first ``next``; the whole text when there is none."""
    return df.withColumn(out, after_marker_expr(text))


def _any_label_word(labels: list[str]) -> str:
    """Regex for one space-delimited word containing any of ``labels``; the
    look-behind pins each attempt to a word start, so a failed word costs one
    pass instead of one per character."""
    import re
    return "(?<![^ ])[^ ]*?(?:" + "|".join(re.escape(x.lower()) for x in labels) + ")[^ ]*"


def intent_tag_last(df: DataFrame, *, text: str = "text", role: str = "role_id",
                    out: str = "tag") -> DataFrame:
    """Tag from the end: the last word (after the ``next`` marker, lower
    case, split on single spaces, stripped) that contains any label of the
    role; among the labels it contains (label-id order) the first with the
    same number of ``_`` parts, else ``NA``.

    The words holding a label are found by one regex pass per row
    (``regexp_extract_all``); only that last word is then tested against the
    fixed label list, so the per-row cost is linear in the text length.
    """
    low = F.lower(after_marker_expr(text))
    hits = F.when(F.col(role) == 0, F.regexp_extract_all(low, F.lit(_any_label_word(BUYER_INTENTS)), 0)) \
            .otherwise(F.regexp_extract_all(low, F.lit(_any_label_word(SELLER_INTENTS)), 0))
    d = df.withColumn("_last", strip_ws(F.try_element_at(hits, F.lit(-1))))
    labs = _role_labels(F.col(role))
    pick = F.get(F.filter(labs, lambda k: (F.instr(F.col("_last"), k) > 0)
                          & (F.size(F.split(k, "_")) == F.size(F.split(F.col("_last"), "_")))), 0)
    return d.withColumn(out, F.coalesce(pick, F.lit("NA"))).drop("_last")


def intent_tag_marked_expr(text, role) -> Column:
    """Label after the last ``intent:`` / ``intent of`` marker, kept only when
    it is a label of the *other* role (canonical spelling), else ``NA``."""
    found = F.regexp_extract_all(_c(text), F.lit(r"(?:intent:|intent of)\s+(\S+)"), 1)
    word = F.lower(F.try_element_at(found, F.lit(-1)))
    other = F.when(_c(role) == 0, F.lit(1)).otherwise(F.lit(0))
    canon_b = F.map_from_arrays(_role_labels(F.lit(0)), _role_labels(F.lit(0), lower=False))
    canon_s = F.map_from_arrays(_role_labels(F.lit(1)), _role_labels(F.lit(1), lower=False))
    hit = F.when(other == 0, F.try_element_at(canon_b, word)).otherwise(F.try_element_at(canon_s, word))
    return F.coalesce(hit, F.lit("NA"))


def intent_tag_marked(df: DataFrame, *, text: str = "text", role: str = "role_id",
                      out: str = "tag") -> DataFrame:
    return df.withColumn(out, intent_tag_marked_expr(text, role))


def label_encode(df: DataFrame, *, role: str = "role_id", label: str = "tag",
                 out: str = "label_id") -> DataFrame:
    """(role, label) -> label id, case-insensitive and alias-aware; unknown
    labels (``NA`` included) give NULL.  The label table is a fixed 27-row
    table, so the broadcast is bounded."""
    labs = label_table(df.sparkSession).select(
        F.col("role").alias("_lr"), F.col("alias_lower").alias("_ll"), F.col("label_id").alias(out))
    return (df.join(F.broadcast(labs), (F.col(role) == F.col("_lr")) & (F.lower(F.col(label)) == F.col("_ll")),
                    "left").drop("_lr", "_ll"))


def unknown_labels(df: DataFrame, *, role: str = "role_id", label: str = "tag") -> DataFrame:
    """(role, label, n) of the labels that :func:`label_encode` gives no id."""
    enc = label_encode(df, role=role, label=label, out="_id")
    return enc.filter(F.col("_id").isNull()).groupBy(role, label).agg(F.count(F.lit(1)).alias("n"))


def opening_price(df: DataFrame, *, text: str = "text", keys=CONV, pos=POS, exact: bool = False,
                  default: float = DEFAULT_OPENING_PRICE) -> DataFrame:
    """Seller's opening price as known at each turn (``pos`` is the 1-based
    turn number, 1 on the opening turn).

    ``p`` = integer after the first ``#price $`` of the turn text.  Turn 1
    gives a provisional value, turn 2 overrides it, later turns are read only
    while no price was found: opening(t) = first non-null p over turns 2..t,
    else p at turn 1, else ``default``.  ``exact`` reproduces the freeze: a
    price at turn 1 and no marker at all at turn 2 keeps the turn-1 price for
    good.  Adds ``opening_price`` and ``price_found``.  All of it is running
    aggregates of one skew-safe scan pass: the running minimum of
    (turn, price) over parsed turns >= 2 is the first price found so far.
    """
    d = df.withColumn("_p", price_after_marker(text))
    pc, p = F.col(pos), F.col("_p")
    cols = {"_fpv": F.when(p.isNotNull() & (pc >= 2), F.struct(pc.alias("t"), p.alias("p"))),
            "_p0v": F.when(pc == 1, p)}
    running = [("_fpv", "min", "_firstp", False), ("_p0v", "max", "_p0", False)]
    if exact:
        cols["_m1v"] = F.when(pc == 2, F.instr(F.col(text), "#price") > 0)
        running.append(("_m1v", "max", "_m1", False))
    d = scan.multi_scan(d.withColumns(cols), keys, pos, running=running)
    val = F.coalesce(F.col("_firstp.p"), F.col("_p0"))
    if exact:
        frozen = F.col("_p0").isNotNull() & (F.col("_m1") == F.lit(False))
        val = F.when(frozen, F.col("_p0")).otherwise(val)
    d = d.withColumns({"price_found": val.isNotNull(),
                       "opening_price": F.coalesce(val, F.lit(default)).cast("long")})
    return d.drop("_p", "_fpv", "_p0v", "_firstp", "_p0", *(["_m1v", "_m1"] if exact else []))


def reservation_price(df: DataFrame, *, out: str = "reservation_price",
                      default: float = DEFAULT_OPENING_PRICE) -> DataFrame:
    """Seller minimum: 0.7 x opening price; ``default`` (not 0.7 x default)
    when no price was ever found."""
    return df.withColumn(out, F.when(F.col("price_found"),
                                     F.lit(RESERVATION_FACTOR) * F.col("opening_price"))
                         .otherwise(F.lit(float(default))))


def final_outcome(df: DataFrame, *, text: str = "text", role: str = "role_id", keys=CONV,
                  pos=POS, keep_text: bool = False) -> DataFrame:
    """Per conversation, from its last turn: buyer last -> ``Reject``, seller
    last -> ``Accept``; the price stated there is the final price; with
    opening/reservation price at that turn and ``prize_diff``.  Expects the
    columns of :func:`opening_price` and :func:`reservation_price`."""
    last = F.max_by(F.struct(F.col(role).alias("role"), price_after_marker(text).alias("price"),
                             F.col("opening_price").alias("opening"),
                             F.col("reservation_price").alias("minimum"),
                             F.col(pos).alias("last_turn"), F.col(text).alias("text")), F.col(pos))
    r = df.groupBy(keys).agg(last.alias("_l"))
    return r.select(*([keys] if isinstance(keys, str) else keys),
                    F.col("_l.last_turn").alias("last_turn"),
                    F.when(F.col("_l.role") == 0, "Reject").otherwise("Accept").alias("outcome"),
                    F.col("_l.price").alias("final_price"),
                    F.col("_l.opening").alias("opening_price"),
                    F.col("_l.minimum").alias("reservation_price"),
                    (F.col("_l.price") - F.col("_l.minimum")).alias("prize_diff"),
                    *([F.col("_l.text").alias("last_text"), F.col("_l.role").alias("last_role")]
                      if keep_text else []))


def conversation_outcome(df: DataFrame, *, text: str = "text", role: str = "role_id", keys=CONV, pos=POS,
                         keep_text: bool = False, default: float = DEFAULT_OPENING_PRICE) -> DataFrame:
    """:func:`opening_price` -> :func:`reservation_price` ->
    :func:`final_outcome` evaluated at the last turn only, in ONE partial
    aggregate per conversation (no join back to the turns).

    At the last turn the lenient opening price is simply the first price
    stated from turn 2 on, else the turn-1 price, else ``default``; the same
    columns as :func:`final_outcome` come out."""
    d = df.withColumn("_p", price_after_marker(text))
    pc, p = F.col(pos), F.col("_p")
    last = F.max_by(F.struct(F.col(role).alias("role"), p.alias("price"), pc.alias("last_turn"),
                             *([F.col(text).alias("text")] if keep_text else [])), pc)
    g = d.groupBy(keys).agg(last.alias("_l"),
                            F.min_by(p, F.when(p.isNotNull() & (pc >= 2), pc)).alias("_fp"),
                            F.max(F.when(pc == 1, p)).alias("_p0"))
    val = F.coalesce(F.col("_fp"), F.col("_p0"))
    opening = F.coalesce(val, F.lit(default)).cast("long")
    minimum = F.when(val.isNotNull(), F.lit(RESERVATION_FACTOR) * opening).otherwise(F.lit(float(default)))
    return g.select(*([keys] if isinstance(keys, str) else keys),
                    F.col("_l.last_turn").alias("last_turn"),
                    F.when(F.col("_l.role") == 0, "Reject").otherwise("Accept").alias("outcome"),
                    F.col("_l.price").alias("final_price"),
                    opening.alias("opening_price"),
                    minimum.alias("reservation_price"),
                    (F.col("_l.price") - minimum).alias("prize_diff"),
                    *([F.col("_l.text").alias("last_text"), F.col("_l.role").alias("last_role")]
                      if keep_text else []))


def truncate_at_eos(df: DataFrame, *, tokens: str = "tokens", logp: str = "logp") -> DataFrame:
    """Cut a generated token array after the first end token (and append a
    newline token) or before the first pad; ``logp_sum`` is the **sum** of
    the kept log-probs (the appended token has none)."""
    t = F.col(tokens)
    pe, pp = F.array_position(t, EOS_TOKEN), F.array_position(t, PAD_TOKEN)
    eos_first = (pe > 0) & ((pp == 0) | (pe < pp))
    n = F.when(eos_first, pe).when(pp > 0, pp - 1).otherwise(F.size(t)).cast("int")
    kept = F.slice(t, 1, n)
    kept = F.when(eos_first, F.concat(kept, F.array(F.lit(NEWLINE_TOKEN)))).otherwise(kept)
    lp = F.slice(F.col(logp), 1, n)
    return (df.withColumn("kept_tokens", kept)
            .withColumn("logp_sum", F.aggregate(lp, F.lit(0.0), lambda a, x: a + x)))


def prompt_slice(df: DataFrame, *, tokens: str = "tokens", out: str = "prompt") -> DataFrame:
    """Prefix before the first tab token; the whole array when none."""
    t = F.col(tokens)
    p = F.array_position(t, TAB_TOKEN)
    return df.withColumn(out, F.slice(t, 1, F.when(p > 0, p - 1).otherwise(F.size(t)).cast("int")))


def strip_markers(df: DataFrame, *, tokens: str = "tokens", out: str = "stripped",
                  vocab: DataFrame | None = None, text_out: str = "stripped_text") -> DataFrame:
    """Drop the first two and last two tokens.  With a ``vocab`` table
    ``(token, piece)`` the kept ids are also decoded to a text: each distinct
    token of a row is looked up once (:func:`.dictionary.replace_words`), tokens
    that the vocabulary doesn't have give nothing."""
    t = F.col(tokens)
    d = df.withColumn(out, F.slice(t, 3, F.greatest(F.size(t) - 4, F.lit(0)).cast("int")))
    if vocab is None:
        return d
    d = replace_words(d, out, vocab, "_pieces", word="token", value="piece", keep=False)
    return d.withColumn(text_out, F.array_join("_pieces", "")).drop("_pieces")


def candidate_length(df: DataFrame, *, text: str = "text", out: str = "cand_len") -> DataFrame:
    """Words (whitespace-separated) in the first tab field of the first line."""
    first = F.substring_index(F.substring_index(F.col(text), "\n", 1), "\t", 1)
    return df.withColumn(out, F.size(F.filter(F.split(first, r"\s+"), lambda w: w != "")).cast("int"))


PUNCT = r"[!-/:-@\[-`{-~]"


def normal_words(text) -> Column:
    """Lower-case words of a text without ASCII punctuation."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.regexp_replace(F.lower(c), PUNCT, ""), r"\s+"), lambda w: w != "")


def normalize_text(df: DataFrame, *, text: str = "text", out: str = "norm",
                   lemmas: DataFrame | None = None) -> DataFrame:
    """Lower case, ASCII punctuation removed, whitespace-separated words
    joined by one space.  An optional ``lemmas`` table ``(word, lemma)``
    replaces words by their lemma: each distinct word of a text is looked up
    once (:func:`.dictionary.replace_words`)."""
    if lemmas is None:
        return df.withColumn(out, F.array_join(normal_words(text), " "))
    d = replace_words(df.withColumn("_words", normal_words(text)), "_words", lemmas, "_lemmas", value="lemma")
    return d.withColumn(out, F.array_join("_lemmas", " ")).drop("_words", "_lemmas")
