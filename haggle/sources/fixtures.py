"""Adapters: views of the driver's parquet tables in the dialogue data model.

Each adapter has a Spark builder and a DuckDB twin (``*_SQL``, a CTE body over
the pre-registered raw views) so that every registered query can be checked
against an independent SQL engine.  Nothing is written back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import md5_bucket, md5_uniform, sql_md5_int, sql_md5_uniform
from ..functions import scan
from ..labels import BUYER_INTENTS, SELLER_INTENTS, canonical_labels, class_rows, local_table, sql_values

# (role, number of classes) of the intent classifiers
CLASS_COUNTS = {0: len(BUYER_INTENTS), 1: len(SELLER_INTENTS)}

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _canon_sql(alias: str = "lab") -> str:
    return sql_values(class_rows(), ["role", "label_id", "label"], alias)


# --------------------------------------------------------------------------
# turns: conversations seen as a buyer/seller dialogue
#   buyer = user, seller = assistant, the system row is the background text;
#   turn_no is 1 on the first non-system turn; intent is a repeatable draw
#   from the speaker's label set; price a repeatable draw, NULL for 30 %.
# --------------------------------------------------------------------------

def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    bg = (c.filter(F.col("role") == "system").groupBy("conv_id")
          .agg(F.max("text").alias("background_data")))
    t = (c.filter(F.col("role") != "system")
         .join(bg, "conv_id", "left")
         .withColumn("speaker", F.when(F.col("role") == "user", 0).otherwise(1).cast("int"))
         .withColumn("turn_no", (F.col("turn") + 1 - F.when(F.col("background_data").isNull(), 0)
                                 .otherwise(1)).cast("int"))
         .withColumn("label_id", md5_bucket("intent", F.when(F.col("speaker") == 0, 12).otherwise(13),
                                            "conv_id", "turn").cast("int")))
    labs = canonical_labels(spark).withColumnRenamed("role", "speaker")
    u = md5_uniform("price", "conv_id", "turn")
    return (t.join(F.broadcast(labs), ["speaker", "label_id"], "left")
            .select("conv_id", "turn", "turn_no", "speaker", F.col("text").alias("utterance"),
                    F.col("label").alias("intent"),
                    F.when(u < 0.3, F.lit(None))
                    .otherwise(F.round(F.lit(500.0) + md5_uniform("amount", "conv_id", "turn") * 1500.0, 2))
                    .cast("decimal(12,2)").alias("price"),
                    F.col("text").alias("items"),
                    F.coalesce("background_data", F.lit("")).alias("background_data")))


TURNS_SQL = f"""
SELECT c.conv_id, c.turn,
       CAST(c.turn + 1 - CASE WHEN bg.background_data IS NULL THEN 0 ELSE 1 END AS INTEGER) AS turn_no,
       CAST(CASE WHEN c.role = 'user' THEN 0 ELSE 1 END AS INTEGER) AS speaker,
       c.text AS utterance,
       lab.label AS intent,
       CAST(CASE WHEN {sql_md5_uniform('price', 'c.conv_id', 'c.turn')} < 0.3 THEN NULL
            ELSE round(500.0 + {sql_md5_uniform('amount', 'c.conv_id', 'c.turn')} * 1500.0, 2) END
            AS DECIMAL(12,2)) AS price,
       c.text AS items,
       coalesce(bg.background_data, '') AS background_data
FROM conversations c
LEFT JOIN (SELECT conv_id, max(text) AS background_data FROM conversations
           WHERE role = 'system' GROUP BY conv_id) bg ON bg.conv_id = c.conv_id
LEFT JOIN {_canon_sql('lab')}
  ON lab.role = CASE WHEN c.role = 'user' THEN 0 ELSE 1 END
 AND lab.label_id = {sql_md5_int('intent', 'c.conv_id', 'c.turn')} % CASE WHEN c.role = 'user' THEN 12 ELSE 13 END
WHERE c.role <> 'system'
"""

# --------------------------------------------------------------------------
# nego: events seen as a long negotiation per user
#   conversation = user_id, order (ts, event_id), speaker = event_id % 2,
#   intent from event_type by a small fixed table; views and clicks draw
#   (md5 of the event) from all the speaker's labels; price = the event amount
#   put on the simulator's price scale, 500 (delivery) + 10 x value, NULL on
#   error events
# --------------------------------------------------------------------------

# ---- FIXED VALUES (adapter choice): event type -> intent per role ---------
EVENT_INTENTS = [
    ("signup", "Greet-Ask", "Greet-Inform"),
    ("purchase", "Accept", "Accept"),
    ("error", "Reject", "avoid_rejection"),
]

def day_of(ts: str):
    """Days since the epoch of a (zone-less) timestamp: the chunk of the
    per-user scans, so that one hot user still spreads over many tasks."""
    return F.datediff(F.to_date(ts), F.lit("1970-01-01")).cast("long")


def _users(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The user of each event, as ``name``: users with few events need no chunks."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias(name))


NEGO_COLS = ["conv_id", "turn_no", "speaker", "event_id", "utterance", "intent", "price", "items", "background_data"]


def _nego_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as negotiation turns, not numbered yet (``ts`` kept)."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    m = local_table(spark, EVENT_INTENTS, ["event_type", "buyer", "seller"], ["string"] * 3)
    speaker = (F.col("event_id") % 2).cast("int")
    e = e.withColumns({"_sp": speaker, "_id": md5_bucket("nego", F.when(speaker == 0, 12).otherwise(13), "event_id").cast("int")})
    labs = canonical_labels(spark).select(F.col("role").alias("_sp"), F.col("label_id").alias("_id"), "label")
    return (e.join(F.broadcast(m), "event_type", "left").join(F.broadcast(labs), ["_sp", "_id"], "left")
            .select(F.col("user_id").alias("conv_id"), "ts",
                    (F.col("event_id") % 2).cast("int").alias("speaker"),
                    "event_id",
                    F.concat_ws(" ", "event_type", "props").alias("utterance"),
                    F.coalesce(F.when(F.col("event_id") % 2 == 0, F.col("buyer")).otherwise(F.col("seller")), F.col("label"))
                    .alias("intent"),
                    F.when(F.col("event_type") == "error", F.lit(None))
                    .otherwise(F.lit(500.0) + F.col("value") * 10.0).cast("decimal(12,2)").alias("price"),
                    F.col("event_type").alias("items"),
                    F.concat(F.lit("account "), F.col("user_id").cast("string")).alias("background_data")))


def nego(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.row_number(_nego_rows(spark, sf_dir), "conv_id", ["ts", "event_id"], day_of("ts"), "turn_no",
                           sizes=_users(spark, sf_dir, "conv_id"))
    return rows.select(NEGO_COLS)


def nego_scanned(spark: SparkSession, sf_dir: str, *, lead: bool = False, previous: bool = False,
                 counterpart: bool = False) -> DataFrame:
    """:func:`nego` with what the dialogue operators read from neighbouring
    turns, all in the numbering pass over (ts, event_id): ``price_filled``;
    with ``lead`` next_utterance and next_intent (end marker on the last
    turn); with ``previous`` the two previous utterances; with
    ``counterpart`` each side's last price and utterance strictly before the
    turn and its first price.  Equal to the separate operators, in one scan
    of the events and one large shuffle."""
    from ..labels import END_MARKER
    rows = _nego_rows(spark, sf_dir).withColumn("_one", F.lit(1))
    side = {"_bp": F.when(F.col("speaker") == 0, F.col("price")), "_sp": F.when(F.col("speaker") == 1, F.col("price"))}
    fill = {"_bp": "_bpf", "_sp": "_spf"}
    nxt = ["event_id", "utterance", "intent"] if lead else []
    prv = ["utterance"] if previous else []
    if counterpart:
        side.update({"_bu": F.when(F.col("speaker") == 0, F.col("utterance")),
                     "_su": F.when(F.col("speaker") == 1, F.col("utterance"))})
        fill.update({"_bu": "_buf", "_su": "_suf"})
    how = dict(fill=fill, fill_exclusive=counterpart, nxt=nxt, next_prefix="_lead_", prv=prv, prev_prefix="prev_",
               prv_two=previous, running=[("_one", "sum", "turn_no", False)], order=["ts", "event_id"], chunk=day_of("ts"))
    few, many = scan.by_size(rows.withColumns(side), "conv_id", _users(spark, sf_dir, "conv_id"))
    d = scan.multi_scan(few, "conv_id", "_one", one_chunk=True, **how)
    d = d if many is None else d.unionByName(scan.multi_scan(many, "conv_id", "_one", **how))
    own = F.when(F.col("speaker") == 0, F.col("_bpf")).otherwise(F.col("_spf"))
    new = {"turn_no": F.col("turn_no").cast("int"),
           "price_filled": F.coalesce(F.col("price"), own) if counterpart else own}
    if lead:
        for c in ("utterance", "intent"):
            new[f"next_{c}"] = F.when(F.col("_lead_event_id").isNotNull(), F.col(f"_lead_{c}")).otherwise(F.lit(END_MARKER))
    if counterpart:
        new.update({"buyer_last_price": F.col("_bpf"), "seller_last_price": F.col("_spf"),
                    "buyer_last_text": F.coalesce("_buf", F.lit("")), "seller_last_text": F.coalesce("_suf", F.lit(""))})
    keep = [*NEGO_COLS, "price_filled", *(["next_utterance", "next_intent"] if lead else []),
            *(["prev_utterance", "prev_2_utterance"] if previous else []),
            *(["buyer_last_price", "seller_last_price", "buyer_last_text", "seller_last_text"] if counterpart else [])]
    return d.withColumns(new).select(keep)


NEGO_SQL = f"""
SELECT e.user_id AS conv_id,
       CAST(row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS INTEGER) AS turn_no,
       CAST(e.event_id % 2 AS INTEGER) AS speaker,
       e.event_id,
       concat_ws(' ', e.event_type, e.props) AS utterance,
       coalesce(CASE WHEN e.event_id % 2 = 0 THEN m.buyer ELSE m.seller END, lab.label) AS intent,
       CAST(CASE WHEN e.event_type = 'error' THEN NULL ELSE 500.0 + e.value * 10.0 END AS DECIMAL(12,2)) AS price,
       e.event_type AS items,
       'account ' || CAST(e.user_id AS VARCHAR) AS background_data
FROM events e
LEFT JOIN {sql_values(EVENT_INTENTS, ['event_type', 'buyer', 'seller'], 'm')} ON m.event_type = e.event_type
LEFT JOIN {_canon_sql('lab')} ON lab.role = e.event_id % 2
 AND lab.label_id = {sql_md5_int('nego', 'e.event_id')} % CASE WHEN e.event_id % 2 = 0 THEN 12 ELSE 13 END
"""


# --------------------------------------------------------------------------
# intent_examples: events as labelled utterances for the epoch-wise classifier
#   text = event type and props, role = event_id % 2; the label is what the text
#   says: the event type's intent, for views and clicks the class that the number
#   in the props names (number modulo classes)
# --------------------------------------------------------------------------

def intent_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    role = (F.col("event_id") % 2).cast("int")
    named = F.col("event_type")
    label = F.regexp_extract("props", "([0-9]+)", 1).cast("int") % F.when(role == 0, CLASS_COUNTS[0]).otherwise(CLASS_COUNTS[1])
    for kind, buyer, seller in EVENT_INTENTS:
        own = F.when(role == 0, BUYER_INTENTS.index(buyer)).otherwise(SELLER_INTENTS.index(seller))
        label = F.when(named == kind, own).otherwise(label)
    return e.select("event_id", role.alias("role"), F.concat_ws(" ", "event_type", "props").alias("text"),
                    label.cast("int").alias("label_id"))


INTENT_EXAMPLES_SQL = f"""
SELECT event_id, CAST(event_id % 2 AS INTEGER) AS role, concat_ws(' ', event_type, props) AS text,
       CAST(CASE {" ".join(f"WHEN event_type = '{t}' THEN CASE WHEN event_id % 2 = 0 THEN {BUYER_INTENTS.index(b)} ELSE {SELLER_INTENTS.index(v)} END"
                           for t, b, v in EVENT_INTENTS)}
            ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)
                 % CASE WHEN event_id % 2 = 0 THEN {CLASS_COUNTS[0]} ELSE {CLASS_COUNTS[1]} END END AS INTEGER) AS label_id
FROM events"""


def with_views(*names: str) -> str:
    """``WITH`` prefix defining the named adapter views for a DuckDB twin."""
    defs = {"turns": TURNS_SQL, "nego": NEGO_SQL}
    defs.update(EXTRA_VIEWS)
    return "WITH " + ",\n".join(f"{n} AS ({defs[n]})" for n in names) + "\n"


EXTRA_VIEWS: dict[str, str] = {}


# --------------------------------------------------------------------------
# tagged: rendered nego turns, each expanded to 3 candidate replies
#   cand 0 = the training example, cand 1 = the example cut before its
#   'with intent:' marker, cand 2 = the example with the turn's own intent
# --------------------------------------------------------------------------

def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import dialogue as D
    r = D.role_id(D.turn_render(nego_scanned(spark, sf_dir, lead=True, previous=True)))
    r = D.example_build(r, ablation=False)
    cue = F.when(F.substring("text", 1, 1) == "A", F.lit(D.NEXT_FOR_BUYER_TURN)).otherwise(F.lit(D.NEXT_FOR_SELLER_TURN))
    own = F.concat(F.col("text"), cue, F.col("next_utterance"), F.lit(D.WITH_INTENT), F.col("intent"), F.lit(D.TURN_ENDING))
    c = D.expand_candidates(r, 3)
    return c.select("conv_id", "turn_no", "speaker", "role_id", "utterance", "text", "cand",
                    "prev_utterance", "prev_2_utterance",
                    F.when(F.col("cand") == 0, F.col("example"))
                    .when(F.col("cand") == 1, F.substring_index("example", "with intent:", 1))
                    .otherwise(own).alias("cand_text"))


def sql_example(ablation: bool = False) -> str:
    cue = ("CASE WHEN substr(text, 1, 1) = 'A' THEN 'next seller response ' || chr(9) "
           "WHEN substr(text, 1, 1) = 'B' THEN 'next buyer response ' || chr(9) ELSE chr(9) END")
    end = "' <|end|>' || " if ablation else ""
    return (f"text || {cue} || next_utterance || 'with intent: ' || chr(9) || next_intent || {end}"
            f"chr(10) || chr(10) || chr(10)")


def _tagged_sql() -> str:
    cue = ("CASE WHEN substr(text, 1, 1) = 'A' THEN 'next seller response ' || chr(9) "
           "ELSE 'next buyer response ' || chr(9) END")
    return f"""
SELECT conv_id, turn_no, speaker, role_id, utterance, text, cand,
       CASE cand WHEN 0 THEN example WHEN 1 THEN split_part(example, 'with intent:', 1)
            ELSE text || {cue} || next_utterance || 'with intent: ' || chr(9) || intent
                 || chr(10) || chr(10) || chr(10) END AS cand_text
FROM (SELECT *, CAST(unnest(range(0, 3)) AS INTEGER) AS cand FROM (
  SELECT *, CAST(CASE WHEN substr(text, 1, 1) = 'A' THEN 0 ELSE 1 END AS INTEGER) AS role_id,
         {sql_example(False)} AS example
  FROM nego_x))"""


# --------------------------------------------------------------------------
# logits / tokens: embeddings seen as score vectors and token arrays
# --------------------------------------------------------------------------

def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("grp"), "label",
                    F.posexplode("embedding").alias("item", "logit")) \
            .withColumn("logit", F.col("logit").cast("double"))


LOGITS_SQL = """
SELECT vec_id AS grp, label, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS item,
       CAST(unnest(embedding) AS DOUBLE) AS logit
FROM embeddings"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids in -1 (pad), 628 (end), 197 (tab) or 303..339 and a
    log-prob -|x| per position."""
    e = table(spark, sf_dir, "embeddings")

    def tok(x):
        v = F.pmod(F.floor(x.cast("double") * 100000.0), F.lit(40))
        return (F.when(v == 0, -1).when(v == 1, 628).when(v == 2, 197).otherwise(v + 300)).cast("int")
    return e.select("vec_id", F.transform("embedding", tok).alias("tokens"),
                    F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("logp"))


TOKENS_SQL = """
SELECT vec_id,
       list_transform(embedding, lambda x: CAST(CASE ((CAST(floor(CAST(x AS DOUBLE) * 100000.0) AS BIGINT) % 40) + 40) % 40
            WHEN 0 THEN -1 WHEN 1 THEN 628 WHEN 2 THEN 197
            ELSE ((CAST(floor(CAST(x AS DOUBLE) * 100000.0) AS BIGINT) % 40) + 40) % 40 + 300 END AS INTEGER)) AS tokens,
       list_transform(embedding, lambda x: -abs(CAST(x AS DOUBLE))) AS logp
FROM embeddings"""


# --------------------------------------------------------------------------
# samples: lineitem as a policy sample buffer (buffer = order)
# metric_log: events as validation metric series (run = user, step = order)
# labelled: documents with quality (actual) and toxic (predicted) labels
# --------------------------------------------------------------------------

def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("buffer"), (F.col("l_linenumber") - 1).alias("idx"),
                     (-F.col("l_discount")).alias("old_logp"), (-F.col("l_tax")).alias("new_logp"),
                     F.col("l_quantity").alias("reward"), (F.col("l_linenumber") == 1).alias("human"))


SAMPLES_SQL = """
SELECT l_orderkey AS buffer, l_linenumber - 1 AS idx, -l_discount AS old_logp, -l_tax AS new_logp,
       l_quantity AS reward, l_linenumber = 1 AS human FROM lineitem"""


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    e = scan.row_number(e, "user_id", ["ts", "event_id"], day_of("ts"), "step", sizes=_users(spark, sf_dir, "user_id"))
    return e.select(F.col("user_id").alias("run"), "step", "value")


METRIC_LOG_SQL = """
SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS step, value
FROM events"""


def labelled(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("actual"),
                                                F.col("toxic").alias("predicted"))
    return d.join(lab, "doc_id", how)


LABELLED_SQL = """
SELECT d.doc_id, d.n_chars, l.quality AS actual, l.toxic AS predicted
FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""

EXTRA_VIEWS.update({"intent_ex": INTENT_EXAMPLES_SQL, "samples": SAMPLES_SQL, "metric_log": METRIC_LOG_SQL, "labelled": LABELLED_SQL})


# --------------------------------------------------------------------------
# catalog: part seen as a product catalog
#   product = brand; accessory types = part types; variants of a type = the
#   brand's part names of that type; product variants = the brand's sizes.
#   Every per-product list is bounded by the name/type/size vocabularies.
# basket: orders x lineitem x part seen as bundle flows
#   flow = order, turn = line, item = the part's type, product = its brand,
#   action R -> remove, A -> add, N -> ask; opening = order total.
# --------------------------------------------------------------------------

def catalog_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per product.  Features are all the words of its part names;
    their list is bounded by the name vocabulary, not by the parts."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_retailprice", F.explode(F.split("p_name", " ")).alias("word"))
    return p.groupBy(F.col("p_brand").alias("product")).agg(
        F.concat(F.floor(F.min("p_retailprice")).cast("string"), F.lit("-"),
                 F.ceil(F.max("p_retailprice")).cast("string")).alias("price"),
        F.array_join(F.sort_array(F.collect_set("word")), ",").alias("features"))


def catalog_accessories(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("product"), F.col("p_type").alias("accessory")).distinct()


def accessory_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("product"), F.col("p_type").alias("acc_type"),
                     F.col("p_name").alias("name")).agg(
        F.concat(F.lit("size "), F.min("p_size").cast("string")).alias("text"))


def product_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("product"),
                    F.concat(F.col("p_brand"), F.lit(" series "), F.col("p_size").cast("string")).alias("name"),
                    F.concat(F.lit("Size "), F.col("p_size").cast("string"), F.lit(" edition")).alias("text")
                    ).distinct()


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                 "l_returnflag", "l_discount", "l_quantity")
    # line numbers repeat within an order: number the lines by (line, part,
    # supplier), in blocks of line numbers so a huge order still spreads out; the
    # lines then lie by order, and meet the orders before the parts
    li = scan.row_number(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"],
                         F.floor(F.col("l_linenumber") / F.lit(1024)).cast("long"), "turn", few_chunks=True)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return (li.join(o, li.l_orderkey == o.o_orderkey, "inner").join(p, li.l_partkey == p.p_partkey, "inner")
            .select(F.col("l_orderkey").alias("flow_id"), "turn",
                    F.col("p_type").alias("item"), F.col("p_brand").alias("product"),
                    F.when(F.col("l_returnflag") == "R", "remove").when(F.col("l_returnflag") == "A", "add")
                    .otherwise("ask").alias("action"),
                    F.col("o_totalprice").alias("opening"), F.col("l_discount").cast("double").alias("discount"),
                    (F.floor(F.col("l_quantity")) % 2 == 0).alias("quoted"),
                    (F.col("o_orderpriority") == "1-URGENT").alias("drop_delivery")))


CATALOG_SQL = {
    "cat_products": """
SELECT p_brand AS product, CAST(floor(min(p_retailprice)) AS BIGINT) || '-' || CAST(ceil(max(p_retailprice)) AS BIGINT) AS price,
       string_agg(DISTINCT word, ',' ORDER BY word) AS features
FROM (SELECT p_brand, p_retailprice, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY p_brand""",
    "cat_acc": "SELECT DISTINCT p_brand AS product, p_type AS accessory FROM part",
    "acc_variants": """
SELECT p_brand AS product, p_type AS acc_type, p_name AS name, 'size ' || CAST(min(p_size) AS VARCHAR) AS text
FROM part GROUP BY ALL""",
    "prod_variants": """
SELECT DISTINCT p_brand AS product, p_brand || ' series ' || CAST(p_size AS VARCHAR) AS name,
       'Size ' || CAST(p_size AS VARCHAR) || ' edition' AS text FROM part""",
    "basket": """
SELECT l.l_orderkey AS flow_id,
       CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey) AS INTEGER) AS turn,
       p.p_type AS item, p.p_brand AS product,
       CASE WHEN l.l_returnflag = 'R' THEN 'remove' WHEN l.l_returnflag = 'A' THEN 'add' ELSE 'ask' END AS action,
       o.o_totalprice AS opening, CAST(l.l_discount AS DOUBLE) AS discount, CAST(floor(l.l_quantity) AS BIGINT) % 2 = 0 AS quoted,
       o.o_orderpriority = '1-URGENT' AS drop_delivery
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey""",
}
EXTRA_VIEWS.update(CATALOG_SQL)
