"""Fixed label, variant and transition tables.

Values in the FIXED VALUES blocks must equal the ones the original dialogue
research code uses; they are stated plainly, in their natural order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---- FIXED VALUES: buyer intent labels, id order 0..11 -------------------
BUYER_INTENTS = [
    "Greet-Ask",
    "Negotiate-Price-Decrease",
    "Negotiate-Remove-X",
    "Ask_Clarification-Y",
    "Negotiate-Price-NoChange",
    "Negotiate-Add-X",
    "Ask_Price",
    "Accept",
    "Reject",
    "Greet-Ask_Negotiate-Price-Decrease",
    "Negotiate-Remove-X_Negotiate-Price-Decrease",
    "Negotiate-Remove-delivery",
]

# ---- FIXED VALUES: seller intent labels, id order 0..12 ------------------
SELLER_INTENTS = [
    "Greet-Inform",
    "Negotiate-Price-NoChange",
    "Negotiate-Price-Increase",
    "Tell_Price",
    "Provide_Clarification-Y",
    "Negotiate-Add-X",
    "Accept",
    "Greet-Inform_Negotiate-Price-Increase",
    "Acknowledge-acceptance",
    "Greet-Inform_Negotiate-Price-NoChange",
    "Negotiate-Remove-delivery",
    "Negotiate-Price-Remove-X",
    "avoid_rejection",
]

# ---- FIXED VALUES: spelling aliases seen for the same label --------------
# (role, alias, canonical label)
LABEL_ALIASES = [
    (1, "Acknowledge acceptance", "Acknowledge-acceptance"),
    (1, "Ask_Price", "Tell_Price"),
]

# ---- FIXED VALUES: labels of dialogue flows that no classifier class has --
# (role, label id, label): the buyer's question for a price
FLOW_LABELS = [
    (0, 12, "tell_price"),
]

# ---- FIXED VALUES: reward variants (intent, gap, strategy, similarity) ---
VARIANTS = [
    ("full", 1, 1, 1, 1),
    ("no_gap", 1, 0, 1, 1),
    ("no_intent", 0, 1, 1, 1),
    ("no_intent_text", 0, 1, 1, 1),
    ("no_strategy", 1, 1, 0, 1),
    ("baseline", 0, 0, 0, 0),
    ("baseline_intent", 0, 0, 0, 0),
    ("baseline_background", 0, 0, 0, 0),
]

# ---- FIXED VALUES: reward weights gamma1..gamma4 and constants -----------
DEFAULT_WEIGHTS = (0.2, 0.3, 0.3, 0.2)
INTENT_DEFAULT_SCORE = 0.54
DEFAULT_OPENING_PRICE = 10000
RESERVATION_FACTOR = 0.7
END_MARKER = "<|end|>"

# ---- FIXED VALUES: seller reply intents allowed after a buyer intent -----
# (phase, buyer intent id, seller intent id); phase 'open' = first exchange.
# Buyer 8 (Reject) may also end the dialogue.
REPLY_INTENTS = [
    ("open", 0, 0),
    ("open", 1, 0), ("open", 1, 7), ("open", 1, 9),
    ("open", 9, 0), ("open", 9, 7), ("open", 9, 9),
    ("open", 3, 4),
    ("open", 2, 11), ("open", 10, 11),
    ("open", 6, 9),
    ("later", 1, 1), ("later", 1, 2),
    ("later", 4, 1), ("later", 4, 2),
    ("later", 12, 1), ("later", 12, 2),
    ("later", 2, 2), ("later", 2, 3),
    ("later", 10, 2), ("later", 10, 3),
    ("later", 3, 4),
    ("later", 5, 2),
    ("later", 6, 1),
    ("later", 7, 8),
    ("later", 8, 12),
    ("later", 11, 10),
]


def label_rows() -> list[tuple[int, int, str, str, str]]:
    """(role, label_id, label, alias, alias_lower) for both roles, aliases
    included, so one lower-case match resolves every spelling."""
    rows = []
    for role, labels in ((0, BUYER_INTENTS), (1, SELLER_INTENTS)):
        for i, lab in enumerate(labels):
            rows.append((role, i, lab, lab, lab.lower()))
    canon = {(r, lab): i for r, labels in ((0, BUYER_INTENTS), (1, SELLER_INTENTS))
             for i, lab in enumerate(labels)}
    for role, alias, lab in LABEL_ALIASES:
        rows.append((role, canon[(role, lab)], lab, alias, alias.lower()))
    for role, i, lab in FLOW_LABELS:
        rows.append((role, i, lab, lab, lab.lower()))
    return rows


LABEL_SCHEMA = T.StructType([
    T.StructField("role", T.IntegerType(), False),
    T.StructField("label_id", T.IntegerType(), False),
    T.StructField("label", T.StringType(), False),
    T.StructField("alias", T.StringType(), False),
    T.StructField("alias_lower", T.StringType(), False),
])


def local_table(spark: SparkSession, rows, cols: list[str], types: list[str]) -> DataFrame:
    """Small fixed table as a JVM-side local relation (an inline VALUES
    list): no Python worker, no RDD, and the optimizer knows its size."""
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in zip(cols, types))
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({', '.join(cols)})")


def label_table(spark: SparkSession) -> DataFrame:
    return local_table(spark, label_rows(), ["role", "label_id", "label", "alias", "alias_lower"],
                       ["int", "int", "string", "string", "string"])


def class_rows() -> list[tuple[int, int, str]]:
    """(role, label_id, label) of the 12 buyer and 13 seller classes."""
    return [(r, i, lab) for r, labels in ((0, BUYER_INTENTS), (1, SELLER_INTENTS)) for i, lab in enumerate(labels)]


def canonical_labels(spark: SparkSession) -> DataFrame:
    """One row per class: the canonical spelling."""
    return local_table(spark, class_rows(), ["role", "label_id", "label"], ["int", "int", "string"])


def reply_intent_table(spark: SparkSession) -> DataFrame:
    return local_table(spark, REPLY_INTENTS, ["phase", "buyer_intent", "seller_intent"],
                       ["string", "int", "int"])


def sql_values(rows, cols, alias: str = "t") -> str:
    """Render rows as a SQL VALUES table ``(VALUES ...) AS t(cols)`` for the
    DuckDB twins."""
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({', '.join(cols)})"


# ---- FIXED VALUES (own wording): prompt templates (intent, parity, shots, pattern)
# parity 'odd' = buyer turn, 'even' = seller turn, 'any' = both; shots = worked
# examples put before the line.  'NA' is the placeholder for every other intent.
TEMPLATES = [
    ("NA", "any", 0, "Nothing is said about the {product}."),
    ("Greet-Ask", "any", 2, "Buyer greets and asks about the {product}. Last seller line: {seller_text}"),
    ("Negotiate-Price-Decrease", "any", 2, "Buyer asks to lower {seller_price} for the {product}; offers {price}."),
    ("Negotiate-Remove-X", "any", 2, "Buyer drops {removal} from the {product} bundle; the seller asked {seller_price}."),
    ("Ask_Clarification-Y", "any", 2, "Buyer asks about {clarification} of the {product}."),
    ("Negotiate-Price-NoChange", "odd", 2, "Buyer repeats the offer of {buyer_price} for the {product}."),
    ("Negotiate-Price-NoChange", "even", 2, "Seller keeps {seller_price} for the {product}."),
    ("Negotiate-Add-X", "any", 2, "{addition} is added to the {product} bundle at {price}."),
    ("Ask_Price", "odd", 1, "Buyer asks the price of the {product}. Last seller line: {seller_text}"),
    ("Ask_Price", "even", 1, "Seller quotes {price} for the {product}. Last buyer line: {buyer_text}"),
    ("Accept", "odd", 2, "Buyer accepts {seller_price} for the {product}."),
    ("Accept", "even", 2, "Seller accepts {buyer_price} for the {product}."),
    ("Reject", "odd", 2, "Buyer walks away from the {product} at {seller_price}."),
    ("Reject", "even", 2, "Seller turns down {buyer_price} for the {product}; asked {price}."),
    ("Greet-Ask_Negotiate-Price-Decrease", "any", 2, "Buyer greets and bids {price} for the {product}."),
    ("Negotiate-Remove-X_Negotiate-Price-Decrease", "any", 2, "Buyer drops {removal} and bids {price}."),
    ("Negotiate-Remove-delivery", "odd", 2, "Buyer asks to skip delivery; offers {price}."),
    ("Negotiate-Remove-delivery", "even", 2, "Seller removes delivery; asks {price}."),
    ("Greet-Inform", "any", 2, "Seller greets and presents the {product} at {price}."),
    ("Negotiate-Price-Increase", "any", 2, "Seller counters {buyer_price} with {price} for the {product}."),
    ("Tell_Price", "any", 1, "Seller quotes {price} for the {product}. Last buyer line: {buyer_text}"),
    ("Provide_Clarification-Y", "any", 2, "Seller explains {clarification} of the {product}."),
    ("Greet-Inform_Negotiate-Price-Increase", "any", 2, "Seller greets and raises to {price}."),
    ("Acknowledge-acceptance", "odd", 1, "Buyer is glad of the deal. Last seller line: {seller_text}"),
    ("Acknowledge-acceptance", "even", 1, "Seller confirms the deal at {price}. Last buyer line: {buyer_text}"),
    ("Greet-Inform_Negotiate-Price-NoChange", "any", 2, "Seller greets and holds {price}."),
    ("Negotiate-Price-Remove-X", "any", 2, "Seller reprices the smaller {product} bundle at {price}."),
    ("avoid_rejection", "any", 2, "Seller tries to keep the buyer at {price} for the {product}."),
]
TEMPLATE_ALIASES = {"acknowledge acceptance": "acknowledge-acceptance"}


def template_table(spark: SparkSession) -> DataFrame:
    """Templates by lower-case intent spelling, aliases included."""
    rows = [(i.lower(), p, n, t) for i, p, n, t in TEMPLATES]
    rows += [(alias, p, n, t) for alias, lab in TEMPLATE_ALIASES.items() for i, p, n, t in rows if i == lab]
    return local_table(spark, rows, ["intent", "parity", "shots", "pattern"], ["string", "string", "int", "string"])
