"""Dialogue assembly: projection, ordered scans, grouping and splits.

Ordered per-conversation scans go through :mod:`haggle.functions.scan` so that
one very long conversation is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.hashing import md5_bucket, md5_int
from ..functions.text import strip_ws
from ..labels import END_MARKER

CONV, POS = "conv_id", "turn_no"

# ---- FIXED VALUES: rendered-turn wording ---------------------------------
BUYER_PREFIX = "A:buyer to seller: '"
SELLER_PREFIX = "B:Seller to buyer: '"
INTENT_OF = "' with intent of "
DESCRIPTION = ", product description is "
BUYER_ITEMS = ", buyer asking for: "
SELLER_ITEMS = ", seller telling about "
OFFER_STATED = ",will offer #price $"
OFFER_CARRIED = " ,will offer #price $"
OFFER_END = " , "
NEXT_FOR_BUYER_TURN = "next seller response \t"
NEXT_FOR_SELLER_TURN = "next buyer response \t"
WITH_INTENT = "with intent: \t"
TURN_ENDING = "\n\n\n"            # the two end-of-turn tokens, as text
ABLATION_END = " <|end|>"


def role_filter(df: DataFrame, role: int, col: str = "speaker") -> DataFrame:
    """Keep one speaker's rows (0 buyer, 1 seller)."""
    return df.filter(F.col(col) == F.lit(role))


def next_turn_lead(df: DataFrame, cols=("utterance", "intent"), *, keys=CONV, pos=POS,
                   chunk_rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """Attach the next turn's ``cols`` as ``next_<col>``; the last turn of
    each conversation gets the end marker (bounded form: never crosses a
    conversation)."""
    out = scan.shift(df, keys, pos, [pos, *cols], direction=1, prefix="_lead_", chunk_rows=chunk_rows)
    has_next = F.col(f"_lead_{pos}").isNotNull()
    for c in cols:
        out = out.withColumn(f"next_{c}", F.when(has_next, F.col(f"_lead_{c}")).otherwise(F.lit(END_MARKER)))
    return out.drop(*[f"_lead_{c}" for c in (pos, *cols)])


def price_locf(df: DataFrame, *, price: str = "price", out: str = "price_filled",
               keys=(CONV, "speaker"), pos=POS, chunk_rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """Missing price -> same speaker's last stated price in the conversation;
    a leading missing price stays NULL."""
    return scan.ffill(df, list(keys), pos, price, out, chunk_rows=chunk_rows)


def locf_and_lead(df: DataFrame, cols=("utterance", "intent"), *, price: str = "price", previous=(),
                  out: str = "price_filled", keys=CONV, pos=POS, chunk_rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """:func:`price_locf` and :func:`next_turn_lead` in one scan pass, with the
    previous turn's columns ``previous`` as ``prev_<col>`` (NULL on the first turn).

    Both scans run per conversation in turn order; each speaker's last price
    is kept as its own fill column and the row's speaker picks one, which is
    the same as filling per (conversation, speaker)."""
    d = df.withColumns({"_lf_b": F.when(F.col("speaker") == 0, F.col(price)),
                        "_lf_s": F.when(F.col("speaker") == 1, F.col(price))})
    d = scan.multi_scan(d, keys, pos, fill={"_lf_b": "_lf_fb", "_lf_s": "_lf_fs"}, nxt=[pos, *cols],
                        next_prefix="_lead_", prv=list(previous), prev_prefix="prev_", chunk_rows=chunk_rows)
    has_next = F.col(f"_lead_{pos}").isNotNull()
    new = {out: F.when(F.col("speaker") == 0, F.col("_lf_fb")).otherwise(F.col("_lf_fs"))}
    new.update({f"next_{c}": F.when(has_next, F.col(f"_lead_{c}")).otherwise(F.lit(END_MARKER)) for c in cols})
    return d.withColumns(new).drop("_lf_b", "_lf_s", "_lf_fb", "_lf_fs", *[f"_lead_{c}" for c in (pos, *cols)])


def _price_text(price: str, filled: str):
    return F.coalesce(F.col(filled).cast("string"), F.lit("NA"))


def turn_render(df: DataFrame, variant: str = "full", *, price: str = "price",
                filled: str = "price_filled", out: str = "text") -> DataFrame:
    """Role-specific turn text.

    ``variant``: ``full`` (utterance, intent, description on turn 1, items,
    price), ``utterance`` (utterance only), ``intent`` (+ intent),
    ``items_price`` (utterance, description, items, price; no intent).
    ``full`` and ``items_price`` need ``price_filled`` (see :func:`price_locf`).
    """
    utt, intent = strip_ws("utterance"), strip_ws("intent")
    buyer = [F.lit(BUYER_PREFIX), utt]
    seller = [F.lit(SELLER_PREFIX), utt]
    if variant in ("full", "intent"):
        buyer += [F.lit(INTENT_OF), intent]
        seller += [F.lit(INTENT_OF), intent]
    if variant in ("full", "items_price"):
        desc = F.when(F.col("turn_no") == 1, F.concat(F.lit(DESCRIPTION), strip_ws("background_data"))) \
                .otherwise(F.lit(""))
        stated = F.col(price).isNotNull()
        ptxt = _price_text(price, filled)
        buyer += [desc, F.lit(BUYER_ITEMS), strip_ws("items"),
                  F.when(stated, F.lit(OFFER_STATED)).otherwise(F.lit(OFFER_CARRIED)), ptxt, F.lit(OFFER_END)]
        seller += [F.lit(SELLER_ITEMS), strip_ws("items"), F.lit(OFFER_CARRIED), ptxt, F.lit(OFFER_END)]
    if variant not in ("full", "utterance", "intent", "items_price"):
        raise ValueError(f"unknown render variant {variant!r}")
    return df.withColumn(out, F.when(F.col("speaker") == 0, F.concat(*buyer)).otherwise(F.concat(*seller)))


def example_build(df: DataFrame, *, text: str = "text", ablation: bool = False,
                  out: str = "example") -> DataFrame:
    """Training example text: turn text, the next speaker's cue, the next
    utterance and intent (from :func:`next_turn_lead`), end of turn."""
    cue = F.when(F.substring(F.col(text), 1, 1) == "A", F.lit(NEXT_FOR_BUYER_TURN)) \
           .when(F.substring(F.col(text), 1, 1) == "B", F.lit(NEXT_FOR_SELLER_TURN)).otherwise(F.lit("\t"))
    parts = [F.col(text), cue, F.col("next_utterance"), F.lit(WITH_INTENT), F.col("next_intent")]
    if ablation:
        parts.append(F.lit(ABLATION_END))
    parts.append(F.lit(TURN_ENDING))
    return df.withColumn(out, F.concat(*parts))


def role_id(df: DataFrame, *, text: str = "text", out: str = "role_id") -> DataFrame:
    """0 if the rendered turn starts with ``A`` (buyer), else 1."""
    return df.withColumn(out, F.when(F.substring(F.col(text), 1, 1) == "A", 0).otherwise(1).cast("int"))


def conversation_assemble(df: DataFrame, *, text: str = "utterance", keys=CONV, pos=POS,
                          part_turns: int = 256) -> DataFrame:
    """Ordered turn list per conversation.

    A conversation is returned as consecutive parts of at most
    ``part_turns`` turns, ``(conv_id, part, first_turn, n_turns, turns)``
    with ``turns`` an ordered ``array<struct<turn_no, text>>``, so no single
    row or task has to hold an unbounded conversation.
    """
    part = F.floor(F.col(pos) / F.lit(part_turns)).cast("long")
    return (df.groupBy(keys, part.alias("part"))
            .agg(F.min(pos).alias("first_turn"), F.count(F.lit(1)).alias("n_turns"),
                 F.sort_array(F.collect_list(F.struct(F.col(pos).alias("turn_no"),
                                                      F.col(text).alias("text")))).alias("turns")))


def mark_conversations(df: DataFrame, n_train: int, *, seed: int = 42, keys: str = CONV, ids: DataFrame | None = None,
                       out: str = "split") -> DataFrame:
    """df plus ``out``: ``train`` for the first ``n_train`` conversations in md5 order,
    ``validation`` for the others.  The distinct ids are numbered in that order by
    the two-level scan (chunks of the hash's first bits), so no task holds
    all of them; turns meet them in one join, whose strategy the optimizer picks.
    ``ids``: where to take the ids from, if there is something cheaper than df."""
    ids = (df if ids is None else ids).select(keys).distinct().withColumns({
        "_all": F.lit(0), "_h": F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(keys).cast("string")))})
    ids = scan.row_number(ids, "_all", ["_h", keys], F.conv(F.substring("_h", 1, 3), 16, 10).cast("long"), "_rn")
    chosen = ids.filter(F.col("_rn") <= n_train).select(keys, F.lit("train").alias(out))
    return df.join(chosen, keys, "left").withColumn(out, F.coalesce(out, F.lit("validation")))


def split_conversations(df: DataFrame, n_train: int, *, seed: int = 42, keys: str = CONV) -> tuple[DataFrame, DataFrame]:
    """The two halves of :func:`mark_conversations`, for a caller that wants them apart."""
    marked = mark_conversations(df, n_train, seed=seed, keys=keys, out="_split")
    return tuple(marked.filter(F.col("_split") == half).drop("_split") for half in ("train", "validation"))


def split_rows(df: DataFrame, *, seed: int = 42, train: float = 0.8, valid: float = 0.1,
               key_cols=(CONV, POS), out: str = "split") -> DataFrame:
    """80/10/10-style row split from an md5 bucket in [0, 1000): no global
    sort; sizes are approximate."""
    b = md5_bucket(seed, 1000, *key_cols)
    return df.withColumn(out, F.when(b < int(round(train * 1000)), "train")
                         .when(b < int(round((train + valid) * 1000)), "validation").otherwise("test"))


def batch_assign(df: DataFrame, size: int, *, seed: int = 42, n_buckets: int = 64,
                 key_cols=(CONV, POS)) -> DataFrame:
    """Seeded shuffle into fixed-size batches: rows go to an md5 bucket and
    are numbered inside it in the order of a second md5, then cut into runs
    of ``size``.  Batch id = (bucket, batch_no).  The numbering is the
    two-level scan (chunks of the ordering hash), so a bucket never has to
    sit in one task however many rows it holds."""
    h = md5_int(f"{seed}:order", *key_cols)
    d = df.withColumn("bucket", md5_bucket(seed, n_buckets, *key_cols).cast("int")).withColumn("_h", h)
    d = scan.row_number(d, "bucket", ["_h", *key_cols], F.floor(F.col("_h") / F.lit(1 << 16)), "_rn")
    return d.withColumn("batch_no", F.floor((F.col("_rn") - 1) / F.lit(size)).cast("int")).drop("_h", "_rn")


def context_budget_trim(df: DataFrame, budget: int, *, length: str = "n", keys=CONV, pos=POS,
                        chunk_rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """Keep a conversation whole when its total length fits ``budget``;
    otherwise keep the leading turns whose running length stays below
    ``budget - len(last turn)``, then the last turn."""
    tot = df.groupBy(keys).agg(F.sum(length).alias("_tot"), F.max(pos).alias("_last_pos"),
                               F.max_by(length, pos).alias("_last_n"))
    d = scan.running_agg(df, keys, pos, length, "_cum", how="sum", chunk_rows=chunk_rows)
    d = d.join(tot, keys, "inner")
    keep = (F.col("_tot") <= budget) | (F.col("_cum") < F.lit(budget) - F.col("_last_n")) | \
           (F.col(pos) == F.col("_last_pos"))
    return d.filter(keep).drop("_tot", "_last_pos", "_last_n", "_cum")


def sliding_context(df: DataFrame, *, text: str = "utterance", k_prev: int = 1, keys=CONV, pos=POS,
                    out: str = "context", chunk_rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """The last ``k_prev`` + 1 context sentences at each turn: the previous
    turns' texts and this one (``array<string>``, oldest first; fewer at the
    start of a conversation).  One skew-safe shift per previous turn."""
    d, prev = df.withColumn("_s0", F.col(text)), ["_s0"]
    for i in range(1, k_prev + 1):
        d = scan.shift(d, keys, pos, [prev[-1]], direction=-1, prefix=f"_s{i}", chunk_rows=chunk_rows)
        prev.append(f"_s{i}{prev[-1]}")
    return d.withColumn(out, F.filter(F.array(*reversed(prev)), lambda x: x.isNotNull())).drop(*prev)


def expand_candidates(df: DataFrame, n: int = 3, *, out: str = "cand") -> DataFrame:
    """Repeat each row ``n`` times with ``cand`` = 0..n-1."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def candidate_group(df: DataFrame, n: int = 3, *, idx: str = "idx") -> DataFrame:
    """Flat buffer index -> turn group ``idx // (n+1)``; position 0 of each
    group is the human reply."""
    return (df.withColumn("turn_group", F.floor(F.col(idx) / F.lit(n + 1)).cast("long"))
            .withColumn("is_human", (F.col(idx) % F.lit(n + 1)) == 0))
