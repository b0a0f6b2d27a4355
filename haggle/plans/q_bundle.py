"""Registered queries for bundle and offer analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scan
from ..functions.hashing import sql_md5_int
from ..functions.joins import small
from ..labels import REPLY_INTENTS, TEMPLATE_ALIASES, TEMPLATES, label_rows, reply_intent_table, sql_values, template_table
from ..operators import bundle as B
from ..operators import extract as E
from ..sources import fixtures as X
from ..sources import io
from .registry import register

W = X.with_views
CAT = ("cat_products", "cat_acc")


def costs(spark, sf_dir):
    """Accessory costs from the catalog: a type's least retail price."""
    p = X.table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_type").alias("accessory")).agg(F.floor(F.min("p_retailprice")).cast("long").alias("cost"))


def bundles_with_cost(spark, sf_dir):
    b = B.bundle_enumerate(X.catalog_accessories(spark, sf_dir))
    c = B.bundle_cost(b, costs(spark, sf_dir))
    return b.join(c, ["product", "bundle_id"], "left")


def scenarios(spark, sf_dir, replicas=4):
    prods = B.price_range_parse(X.catalog_products(spark, sf_dir))
    return B.opening_offers(prods, bundles_with_cost(spark, sf_dir), replicas=replicas, seed=11)


SQL_COST = f"500 + {sql_md5_int(7, 'accessory')} % 1501"
X.EXTRA_VIEWS.update({
    "acc_draw": f"SELECT accessory, {SQL_COST} AS cost FROM (SELECT DISTINCT accessory FROM cat_acc)",
    "acc_cost": "SELECT p_type AS accessory, CAST(floor(min(p_retailprice)) AS BIGINT) AS cost FROM part GROUP BY p_type",
    "bundles": """
SELECT product, items, array_to_string(items, '+') AS bundle_id, CAST(len(items) AS INTEGER) AS n_items FROM (
  SELECT product, [accessory] AS items FROM cat_acc
  UNION ALL
  SELECT x.product, [x.accessory, y.accessory] AS items FROM cat_acc x JOIN cat_acc y
    ON x.product = y.product AND x.accessory < y.accessory)""",
    "bundle_costs": """
SELECT b.product, b.bundle_id, CAST(sum(c.cost) AS BIGINT) AS bundle_cost
FROM (SELECT product, bundle_id, unnest(items) AS accessory FROM bundles) b
LEFT JOIN acc_cost c USING (accessory) GROUP BY b.product, b.bundle_id""",
    "ranges": """
SELECT product, TRY_CAST(split_part(price, '-', 1) AS BIGINT) AS low, TRY_CAST(split_part(price, '-', 2) AS BIGINT) AS high
FROM cat_products""",
})
X.EXTRA_VIEWS["sc0"] = f"""
SELECT product, replica, first_seller,
       CAST(floor(first_seller * CAST(0.6 AS DOUBLE)) AS BIGINT)
         + {sql_md5_int('11:b', 'product', 'replica')} % (CAST(floor(first_seller * CAST(0.85 AS DOUBLE)) AS BIGINT)
                                                         - CAST(floor(first_seller * CAST(0.6 AS DOUBLE)) AS BIGINT) + 1)
         + 500 AS first_buyer
FROM (SELECT product, replica, low + {sql_md5_int(11, 'product', 'replica')} % (high - low + 1) + 500 AS first_seller
      FROM (SELECT product, low, high, CAST(unnest(range(0, 4)) AS INTEGER) AS replica FROM ranges))"""
X.EXTRA_VIEWS["scen"] = f"""
SELECT s.*, p.bundle_id, p.bundle_cost, s.first_seller + p.bundle_cost AS total_seller,
       CAST(ceil(s.first_buyer + (CAST(floor(p.bundle_cost / 2) AS BIGINT)
            + {sql_md5_int('11:extra', 's.product', 's.replica')} % (p.bundle_cost - CAST(floor(p.bundle_cost / 2) AS BIGINT) + 1)))
            AS BIGINT) AS total_buyer
FROM sc0 s LEFT JOIN (
  SELECT s.product, s.replica, b.bundle_id, c.bundle_cost
  FROM sc0 s JOIN (SELECT *, row_number() OVER (PARTITION BY product ORDER BY bundle_id) AS i,
                          count(*) OVER (PARTITION BY product) AS n FROM bundles) b
    ON b.product = s.product AND b.i = {sql_md5_int('11:bundle', 's.product', 's.replica')} % b.n + 1
  JOIN bundle_costs c ON c.product = b.product AND c.bundle_id = b.bundle_id) p
  ON p.product = s.product AND p.replica = s.replica"""
X.EXTRA_VIEWS["curve"] = """
SELECT *, CAST(floor(total_buyer + (total_seller - total_buyer) * exp(-0.5 * t)) AS BIGINT) AS seller_offer,
          CAST(ceil(total_seller - (total_seller - total_buyer) * exp(-0.2 * t)) AS BIGINT) AS buyer_offer
FROM (SELECT *, CAST(unnest(range(0, 11)) AS INTEGER) AS t FROM scen)"""
SCEN = (*CAT, "acc_cost", "bundles", "bundle_costs", "ranges", "sc0", "scen")


@register("read_catalog", W("acc_variants") + "SELECT product, acc_type, name, text AS description FROM acc_variants")
def q_read_catalog(spark, sf_dir):
    """The catalog is written as nested JSON (product -> price range,
    features, description map, accessories map of maps) to the shared
    scratch folder, read back with ``read_catalog`` and flattened."""
    path = io.scratch_path(spark, "catalog_json")
    io.write_catalog_json(X.catalog_products(spark, sf_dir), X.accessory_variants(spark, sf_dir),
                          X.product_variants(spark, sf_dir), path)
    return io.read_catalog(spark, path)


@register("accessory_cost", W(*CAT, "acc_draw") + "SELECT accessory, cost FROM acc_draw")
def q_accessory_cost(spark, sf_dir):
    return B.accessory_cost(X.catalog_accessories(spark, sf_dir).select("accessory").distinct())


@register("bundle_enumerate", W(*CAT, "bundles") + "SELECT product, bundle_id, n_items FROM bundles")
def q_bundle_enumerate(spark, sf_dir):
    return B.bundle_enumerate(X.catalog_accessories(spark, sf_dir)).select("product", "bundle_id", "n_items")


@register("bundle_cost", W(*CAT, "acc_cost", "bundles", "bundle_costs") +
          "SELECT product, bundle_id, bundle_cost FROM bundle_costs")
def q_bundle_cost(spark, sf_dir):
    b = B.bundle_enumerate(X.catalog_accessories(spark, sf_dir))
    return B.bundle_cost(b, costs(spark, sf_dir))


@register("price_range_parse", W(*CAT, "ranges") + "SELECT product, low, high FROM ranges")
def q_price_range_parse(spark, sf_dir):
    return B.price_range_parse(X.catalog_products(spark, sf_dir)).select("product", "low", "high")


@register("opening_offers", W(*SCEN) + """
SELECT product, replica, first_seller, first_buyer, bundle_id, bundle_cost, total_seller, total_buyer FROM scen""")
def q_opening_offers(spark, sf_dir):
    return scenarios(spark, sf_dir).select("product", "replica", "first_seller", "first_buyer", "bundle_id",
                                           "bundle_cost", "total_seller", "total_buyer")


@register("concession_curve", W(*SCEN, "curve") + """
SELECT product, replica, t, seller_offer, buyer_offer FROM curve""")
def q_concession_curve(spark, sf_dir):
    return B.concession_curve(scenarios(spark, sf_dir), 10).select(
        "product", "replica", "t", "seller_offer", "buyer_offer")


def basket_deltas(spark, sf_dir):
    bk = X.basket(spark, sf_dir)
    d = bk.join(small(costs(spark, sf_dir).withColumnRenamed("accessory", "item")), "item", "left")
    return d.withColumn("delta", (F.when(F.col("action") == "add", F.col("cost"))
                                  .when(F.col("action") == "remove", -F.col("cost")).otherwise(F.lit(0))
                                  + F.when((F.col("turn") == 1) & F.col("drop_delivery"), F.lit(-B.DELIVERY))
                                  .otherwise(F.lit(0))).cast("long"))


X.EXTRA_VIEWS["bdelta"] = """
SELECT b.*, CAST(CASE WHEN action = 'add' THEN c.cost WHEN action = 'remove' THEN -c.cost ELSE 0 END
              + CASE WHEN turn = 1 AND drop_delivery THEN -500 ELSE 0 END AS BIGINT) AS delta
FROM basket b LEFT JOIN (SELECT accessory AS item, cost FROM acc_cost) c USING (item)"""


@register("bundle_price_adjust", W("acc_cost", "basket", "bdelta") + """
SELECT flow_id, turn, delta, opening + sum(delta) OVER (PARTITION BY flow_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS offer
FROM bdelta""")
def q_bundle_price_adjust(spark, sf_dir):
    return B.bundle_price_adjust(basket_deltas(spark, sf_dir)).select("flow_id", "turn", "delta", "offer")


X.EXTRA_VIEWS["bstate"] = """
SELECT *, coalesce(n0, 0) + sum(ds) OVER w AS n_selected, sum(dr) OVER w AS n_removed, sum(db) OVER w AS n_back,
       sum(dn) OVER w AS n_negotiable FROM (
  SELECT *, CAST(status <> 'removed' AS INTEGER) - CAST(before_status NOT IN ('removed', 'absent') AS INTEGER) AS ds,
         CAST(status = 'removed' AS INTEGER) - CAST(before_status = 'removed' AS INTEGER) AS dr,
         CAST(status = 'back' AS INTEGER) - CAST(before_status = 'back' AS INTEGER) AS db,
         coalesce(ng, neg, 0) - coalesce(neg, 0) AS dn,
         sum(CAST(turn = first_turn AND first_action <> 'add' AS INTEGER)) OVER (PARTITION BY flow_id) AS n0
  FROM (SELECT *, CASE action WHEN 'remove' THEN 'removed' WHEN 'add' THEN back ELSE before_status END AS status
        FROM (SELECT *, CASE WHEN prev = 'remove' THEN 'removed' WHEN prev = 'add' THEN back
                             WHEN first_action = 'add' THEN 'absent' ELSE 'initial' END AS before_status
              FROM (SELECT *, CASE WHEN ever THEN 'back' WHEN first_action = 'add' THEN 'new' ELSE 'initial' END AS back
                    FROM (SELECT *, last_value(CASE WHEN action <> 'ask' THEN action END IGNORE NULLS) OVER e AS prev,
                                 coalesce(bool_or(action = 'remove') OVER e, false) AS ever,
                                 last_value(ng IGNORE NULLS) OVER e AS neg,
                                 first_value(action) OVER i AS first_action, first_value(turn) OVER i AS first_turn
                          FROM (SELECT *, CASE action WHEN 'remove' THEN 1 WHEN 'ask' THEN 0 END AS ng FROM basket)
                          WINDOW i AS (PARTITION BY flow_id, item ORDER BY turn),
                                 e AS (PARTITION BY flow_id, item ORDER BY turn
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))))))
WINDOW w AS (PARTITION BY flow_id ORDER BY turn ROWS UNBOUNDED PRECEDING)"""


@register("bundle_state", W("basket", "bstate") + """
SELECT flow_id, turn, item, action, status, CAST(n_selected AS BIGINT) AS n_selected, CAST(n_removed AS BIGINT) AS n_removed,
       CAST(n_negotiable AS BIGINT) AS n_negotiable FROM bstate""")
def q_bundle_state(spark, sf_dir):
    bk = X.basket(spark, sf_dir).select("flow_id", "turn", "item", "action")
    return B.bundle_state(io.written(bk, "basket")).select(
        "flow_id", "turn", "item", "action", "status", *(F.col(c).cast("long").alias(c) for c in (
            "n_selected", "n_removed", "n_negotiable")))


@register("open_clarifications", W("cat_products", "basket") + """
, topics AS (
    SELECT flow_id, item AS topic FROM basket UNION SELECT flow_id, product FROM basket
    UNION SELECT b.flow_id, unnest(string_split(c.features, ',')) FROM basket b JOIN cat_products c ON c.product = b.product)
SELECT t.flow_id, t.topic, min(b.turn) AS asked_turn
FROM topics t LEFT JOIN basket b ON b.flow_id = t.flow_id AND b.item = t.topic AND b.action = 'ask'
GROUP BY t.flow_id, t.topic""")
def q_open_clarifications(spark, sf_dir):
    """Topics of a flow: its items, its products and their features.  A turn is
    many mentions, so flows are dealt out to as many tasks as there are
    ``TASK_TURNS`` turns: what a task holds doesn't grow with the table."""
    tasks = X.table(spark, sf_dir, "lineitem").count() // TASK_TURNS + 1
    bk = X.basket(spark, sf_dir).select("flow_id", "turn", "item", "product", "action").repartition(tasks, "flow_id")
    feats = X.catalog_products(spark, sf_dir).select("product", F.split("features", ",").alias("f"))
    no_turn = F.lit(None).cast("int")
    said = lambda topic: F.struct(topic.alias("topic"), no_turn.alias("turn"))
    item = F.struct(F.col("item").alias("topic"), F.when(F.col("action") == "ask", F.col("turn")).otherwise(no_turn).alias("turn"))
    mentions = bk.join(small(feats), "product", "left").select("flow_id", F.inline(F.concat(
        F.array(item, said(F.col("product"))), F.coalesce(F.transform("f", said), F.array().cast(
            "array<struct<topic:string,turn:int>>")))))
    return B.open_clarifications(mentions)


TASK_TURNS = 1 << 16   # turns of a task, where each becomes some dozens of rows


def _legal_case() -> str:
    """Twin of the rule table, generated from it."""
    tests = {"deal": "deal", "quote": "prev_seller = 3", "r>0": "r > 0", "r=0": "r = 0", "r<n": "r < n", "r=n": "r = n",
             "open": "NOT all_added", "added": "all_added", "can": "can_remove", "none": "neg_empty", "some": "NOT neg_empty"}
    rules = " ".join(f"WHEN {' AND '.join(tests[t] for t in when)} THEN {list(codes)}" for when, codes in B.LEGAL_RULES)
    return f"CASE {rules} ELSE []::INTEGER[] END"


@register("legal_actions", W("acc_cost", "basket", "bdelta", "bstate") + f"""
, s AS (SELECT s.flow_id, s.turn, s.action, n_removed - dr AS r, (n_selected - ds) + (n_removed - dr) AS n, n_back - db AS k,
               (n_selected - ds) - (n_back - db) AS removable, n_negotiable - dn AS g, s.opening, s.discount,
               lag(s.action) OVER f AS prev_action, lag(s.quoted) OVER f AS prev_quoted,
               coalesce(sum(d.delta) OVER (PARTITION BY s.flow_id ORDER BY s.turn
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS moved
        FROM bstate s JOIN bdelta d ON d.flow_id = s.flow_id AND d.turn = s.turn
        WINDOW f AS (PARTITION BY s.flow_id ORDER BY s.turn))
, t AS (SELECT *, n > 0 AND k >= n AS all_added, removable > 0 AS can_remove, g = 0 AS neg_empty,
               coalesce(opening + moved <= opening * (1 - discount) + CAST(0.05 AS DOUBLE) * opening, false) AS deal,
               CASE WHEN prev_action = 'ask' THEN 4 WHEN prev_action = 'remove' THEN CASE WHEN prev_quoted THEN 2 ELSE 3 END
                    ELSE 0 END AS prev_seller,
               CASE action WHEN 'remove' THEN 2 WHEN 'add' THEN 5 ELSE 3 END AS action_id FROM s)
, u AS (SELECT *, {_legal_case()} AS legal FROM t)
SELECT flow_id, turn, array_to_string(legal, ',') AS legal, list_contains(legal, action_id) AS is_legal FROM u""")
def q_legal_actions(spark, sf_dir):
    """The state comes from earlier turns only: bundle counts before the
    turn, the seller's reply to the previous turn (an answer after a
    question, a quoted or an asked price after a removal), and a deal when
    the running offer is within the tolerance of the buyer's price."""
    bk = io.written(basket_deltas(spark, sf_dir).select(
        "flow_id", "turn", "item", "action", "opening", "discount", "quoted", "delta"), "basket")
    d = B.bundle_state(bk, previous=("action", "quoted"), running=[("delta", "sum", "_moved", True)])
    n = F.col("before_n_selected") + F.col("before_n_removed")
    offer = F.col("opening") + F.coalesce("_moved", F.lit(0))
    d = d.select(
        "flow_id", "turn", F.col("before_n_removed").alias("r"), n.alias("n"),
        ((n > 0) & (F.col("before_n_back") >= n)).alias("all_added"),
        (F.col("before_n_selected") - F.col("before_n_back") > 0).alias("can_remove"),
        (F.col("before_n_negotiable") == 0).alias("neg_empty"),
        F.coalesce(offer <= F.col("opening") * (1 - F.col("discount")) + B.DEAL_TOLERANCE * F.col("opening"),
                   F.lit(False)).alias("deal"),
        F.when(F.col("prev_action") == "ask", 4).when(
            F.col("prev_action") == "remove", F.when(F.col("prev_quoted"), 2).otherwise(3)).otherwise(0).alias("prev_seller"),
        F.when(F.col("action") == "remove", 2).when(F.col("action") == "add", 5).otherwise(3).alias("action_id"))
    la = B.legal_actions(d, action="action_id", n_removed="r", n_acc="n", all_added="all_added",
                         can_remove="can_remove", negotiable_empty="neg_empty", deal="deal", prev_seller="prev_seller")
    return la.select("flow_id", "turn", F.array_join("legal", ",").alias("legal"), "is_legal")


def _labels_sql(alias="lb"):
    return sql_values([(r, i, a) for (r, i, _, _, a) in label_rows()], ["lrole", "label_id", "alias_lower"], alias)


@register("reply_intents", W("nego") + f"""
, n AS (SELECT g.conv_id, g.turn_no, g.speaker, lb.label_id FROM nego g
        LEFT JOIN {_labels_sql()} ON lb.lrole = g.speaker AND lb.alias_lower = lower(g.intent))
, p AS (SELECT *, lead(speaker) OVER w AS next_speaker, lead(label_id) OVER w AS next_label
        FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn_no))
, c AS (SELECT CASE WHEN turn_no <= 2 THEN 'open' ELSE 'later' END AS phase, label_id AS buyer_intent,
               next_label AS seller_intent, count(*) AS n
        FROM p WHERE speaker = 0 AND next_speaker = 1 GROUP BY ALL)
SELECT c.phase, c.buyer_intent, c.seller_intent, c.n, r.phase IS NOT NULL AS allowed
FROM c LEFT JOIN {sql_values(REPLY_INTENTS, ['phase', 'buyer_intent', 'seller_intent'], 'r')}
  ON r.phase = c.phase AND r.buyer_intent = c.buyer_intent AND r.seller_intent = c.seller_intent""")
def q_reply_intents(spark, sf_dir):
    n = E.label_encode(X.nego(spark, sf_dir), role="speaker", label="intent").select(
        "conv_id", "turn_no", "speaker", "label_id")
    p = scan.shift(n, "conv_id", "turn_no", ["speaker", "label_id"], direction=1, prefix="next_")
    pairs = p.filter((F.col("speaker") == 0) & (F.col("next_speaker") == 1))
    c = pairs.groupBy(F.when(F.col("turn_no") <= 2, "open").otherwise("later").alias("phase"),
                      F.col("label_id").alias("buyer_intent"), F.col("next_label_id").alias("seller_intent")
                      ).agg(F.count(F.lit(1)).alias("n"))
    t = F.broadcast(reply_intent_table(spark).withColumn("allowed", F.lit(True)))
    return (c.join(t, ["phase", "buyer_intent", "seller_intent"], "left")
            .withColumn("allowed", F.coalesce("allowed", F.lit(False))))


TRIG = "('Negotiate-Remove-X', 'Negotiate-Add-X', 'Negotiate-Remove-X_Negotiate-Price-Decrease')"


@register("intent_retag", W("turns") + f"""
, a AS (SELECT *, coalesce(intent IN {TRIG}, false) AS trig,
               max(CASE WHEN NOT coalesce(intent IN {TRIG}, false) THEN turn_no END) OVER (PARTITION BY conv_id ORDER BY turn_no
                   ROWS UNBOUNDED PRECEDING) AS last_nt,
               min(turn_no) OVER (PARTITION BY conv_id) AS p0, max(turn_no) OVER (PARTITION BY conv_id) AS p1
        FROM turns)
, b AS (SELECT *, trig AND (turn_no - coalesce(last_nt, p0 - 1)) % 2 = 1 AS live FROM a)
, c AS (SELECT *, lag(live) OVER w AS prev_live, lag(intent) OVER w AS prev_intent FROM b
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn_no))
SELECT conv_id, turn_no, intent,
       CASE WHEN coalesce(prev_live, false) AND turn_no < p1 AND prev_intent IN ('Negotiate-Remove-X', 'Negotiate-Add-X')
                 THEN 'tell_price'
            WHEN coalesce(prev_live, false) AND turn_no < p1 AND prev_intent = 'Negotiate-Remove-X_Negotiate-Price-Decrease'
                 THEN 'Negotiate-Price-Remove-X'
            ELSE intent END AS retagged
FROM c""")
def q_intent_retag(spark, sf_dir):
    t = X.turns(spark, sf_dir).select("conv_id", "turn_no", "intent")
    return B.intent_retag(t, keys=("conv_id",), pos="turn_no").select("conv_id", "turn_no", "intent", "retagged")


@register("entity_describe", W("basket", "acc_variants", "prod_variants") + f"""
, ents AS (SELECT flow_id, turn, product, item AS entity FROM basket
           UNION ALL SELECT flow_id, turn, product, 'gift ' || action AS entity FROM basket)
, av AS (SELECT *, row_number() OVER (PARTITION BY product, acc_type ORDER BY name, text) AS i,
                count(*) OVER (PARTITION BY product, acc_type) AS n FROM acc_variants)
, pv AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY name, text) AS i,
                count(*) OVER (PARTITION BY product) AS n FROM prod_variants)
, e AS (SELECT *, {sql_md5_int(5, 'flow_id', 'entity', 'product')} AS h FROM ents)
SELECT e.flow_id, e.turn, e.entity, 'A ' || CASE WHEN a.name IS NULL THEN e.product ELSE e.entity END || ' called '
       || coalesce(a.name, p.name) || '.' || coalesce(a.text, p.text) AS described
FROM e LEFT JOIN av a ON a.product = e.product AND a.acc_type = e.entity AND a.i = e.h % a.n + 1
LEFT JOIN pv p ON p.product = e.product AND p.i = e.h % p.n + 1""")
def q_entity_describe(spark, sf_dir):
    """Every item of a flow, and a gift no product has (described by the product itself)."""
    bk = X.basket(spark, sf_dir)
    ents = bk.select("flow_id", "turn", "product", F.explode(F.array(
        F.col("item"), F.concat(F.lit("gift "), F.col("action")))).alias("entity"))
    d = B.entity_describe(ents, X.accessory_variants(spark, sf_dir), X.product_variants(spark, sf_dir))
    return d.select("flow_id", "turn", "entity", "described")


@register("flatten_nested", W("acc_variants") + """
SELECT product, acc_type, name, array_to_string(flatten([string_split(name, ' '), string_split(text, ' ')]), ',') AS flat
FROM acc_variants""")
def q_flatten_nested(spark, sf_dir):
    """Each variant's nested word lists (its name's, its text's) made one; no row holds a whole product."""
    v = X.accessory_variants(spark, sf_dir).withColumn("nested", F.array(F.split("name", " "), F.split("text", " ")))
    return B.flatten_nested(v).select("product", "acc_type", "name", F.array_join("flat", ",").alias("flat"))


@register("bundle_phrase", W(*CAT, "bundles") + """
SELECT product, bundle_id,
       CASE WHEN len(items) = 1 THEN product || ' and a ' || items[1]
            ELSE product || ' along with ' || array_to_string(list_transform(items[1:len(items) - 1], lambda x: ' a ' || x || ','), '')
                 || ' and a ' || items[len(items)] END AS phrase
FROM bundles""")
def q_bundle_phrase(spark, sf_dir):
    b = B.bundle_enumerate(X.catalog_accessories(spark, sf_dir))
    return b.select("product", "bundle_id", B.bundle_phrase_expr("product", "items").alias("phrase"))


def nego_counterpart(spark, sf_dir):
    """Turns with each side's last price and text before them; a side's
    opening price stands in until it has stated one.  Numbering and fills are
    one pass; the opening prices are one row per conversation."""
    n = X.nego_scanned(spark, sf_dir, counterpart=True)
    rows = X._nego_rows(spark, sf_dir).filter(F.col("price").isNotNull())
    when = F.struct("ts", "event_id")
    first = rows.groupBy("conv_id").agg(
        F.min_by("price", F.when(F.col("speaker") == 0, when)).alias("open_buyer"),
        F.min_by("price", F.when(F.col("speaker") == 1, when)).alias("open_seller"))
    return n.join(first, "conv_id", "left").withColumns({
        "buyer_last_price": F.coalesce("buyer_last_price", "open_buyer"),
        "seller_last_price": F.coalesce("seller_last_price", "open_seller")})


X.EXTRA_VIEWS["nego_cp"] = """
SELECT n.*, o.open_seller, coalesce(last_value(CASE WHEN speaker = 0 THEN price END IGNORE NULLS) OVER w, o.open_buyer) AS buyer_last_price,
       coalesce(last_value(CASE WHEN speaker = 1 THEN price END IGNORE NULLS) OVER w, o.open_seller) AS seller_last_price,
       coalesce(last_value(CASE WHEN speaker = 0 THEN utterance END IGNORE NULLS) OVER w, '') AS buyer_last_text,
       coalesce(last_value(CASE WHEN speaker = 1 THEN utterance END IGNORE NULLS) OVER w, '') AS seller_last_text
FROM nego n LEFT JOIN (
  SELECT conv_id, arg_min(CASE WHEN speaker = 0 THEN price END, CASE WHEN speaker = 0 THEN turn_no END) AS open_buyer,
         arg_min(CASE WHEN speaker = 1 THEN price END, CASE WHEN speaker = 1 THEN turn_no END) AS open_seller
  FROM nego WHERE price IS NOT NULL GROUP BY conv_id) o USING (conv_id)
WINDOW w AS (PARTITION BY n.conv_id ORDER BY n.turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@register("counterpart_state", W("nego", "nego_cp") + """
SELECT conv_id, turn_no, buyer_last_price, seller_last_price, buyer_last_text, seller_last_text FROM nego_cp""")
def q_counterpart_state(spark, sf_dir):
    return nego_counterpart(spark, sf_dir).select("conv_id", "turn_no", "buyer_last_price", "seller_last_price",
                                                  "buyer_last_text", "seller_last_text")


def observed_offers(spark, sf_dir):
    """Both sides' last stated prices before each turn of the observed
    negotiations, as offers (the opening prices until then)."""
    n = nego_counterpart(spark, sf_dir)
    return n.select("conv_id", F.col("turn_no").alias("t"), F.col("seller_last_price").cast("double").alias("seller_offer"),
                    F.col("buyer_last_price").cast("double").alias("buyer_offer"),
                    F.col("open_seller").cast("double").alias("first_seller"), F.lit(0.0).alias("bundle_cost"))


OFFERS = ("nego", "nego_cp", "offers")
X.EXTRA_VIEWS["offers"] = """
SELECT conv_id, turn_no AS t, CAST(seller_last_price AS DOUBLE) AS seller_offer, CAST(buyer_last_price AS DOUBLE) AS buyer_offer,
       CAST(open_seller AS DOUBLE) AS first_seller FROM nego_cp"""


@register("deal_turn", W(*OFFERS) + """
SELECT conv_id, min(CASE WHEN seller_offer <= buyer_offer + CAST(0.05 AS DOUBLE) * first_seller THEN t END) AS deal_turn
FROM offers GROUP BY conv_id""")
def q_deal_turn(spark, sf_dir):
    return B.deal_turn(observed_offers(spark, sf_dir), keys=("conv_id",))


@register("near_accept", W(*OFFERS) + """
SELECT conv_id, t, buyer_offer + CAST(0.1 AS DOUBLE) * seller_offer >= seller_offer AS near_accept FROM offers""")
def q_near_accept(spark, sf_dir):
    c = observed_offers(spark, sf_dir)
    return c.select("conv_id", "t", B.near_accept_expr("buyer_offer", "seller_offer").alias("near_accept"))


def _sql_round(v: str) -> str:
    d = f"length(CAST(CAST(floor(abs({v})) AS BIGINT) AS VARCHAR))"
    m = f"(CASE WHEN {d} <= 2 THEN 5 WHEN {d} = 3 THEN 10 ELSE 100 END)"
    return f"CAST(floor({v} / {m}) * {m} AS BIGINT)"


@register("price_round", W(*OFFERS) + f"""
SELECT conv_id, t, {_sql_round('seller_offer')} AS seller_round, {_sql_round('buyer_offer')} AS buyer_round FROM offers""")
def q_price_round(spark, sf_dir):
    c = observed_offers(spark, sf_dir)
    return c.select("conv_id", "t", B.price_round_expr("seller_offer").alias("seller_round"),
                    B.price_round_expr("buyer_offer").alias("buyer_round"))


SLOTS = {"product": "items", "price": "price", "seller_price": "seller_last_price", "buyer_price": "buyer_last_price",
         "seller_text": "seller_last_text", "buyer_text": "buyer_last_text", "clarification": "clarification",
         "removal": "removal", "addition": "addition"}
_SQL_TEMPLATES = [(i.lower(), p, n, t) for i, p, n, t in TEMPLATES]
_SQL_TEMPLATES += [(a, p, n, t) for a, lab in TEMPLATE_ALIASES.items() for i, p, n, t in _SQL_TEMPLATES if i == lab]


def _sql_fill(p: str) -> str:
    cases = " ".join(f"WHEN '{{{slot}}}' THEN coalesce(CAST({col} AS VARCHAR), '')" for slot, col in SLOTS.items())
    return (f"array_to_string(list_transform(regexp_extract_all({p}, '\\{{\\w+\\}}|[^{{]+|\\{{'), "
            f"lambda x: CASE x {cases} ELSE x END), '')")


@register("prompt_build", W("nego", "nego_cp") + f"""
, tp AS (SELECT * FROM {sql_values(_SQL_TEMPLATES, ['ti', 'tpar', 'shots', 'pattern'], 'tt')})
, q AS (SELECT n.*, CASE WHEN turn_no % 2 = 1 THEN 'odd' ELSE 'even' END AS parity, 'the ' || items AS clarification,
               CASE WHEN speaker = 0 THEN 'one ' || items END AS removal, utterance AS addition,
               CASE WHEN event_id % 7 = 0 THEN 'NA' WHEN event_id % 11 = 0 THEN NULL ELSE intent END AS asked FROM nego_cp n)
, x AS (SELECT q.*, coalesce(s.pattern, a.pattern, h.pattern) AS pattern, coalesce(s.shots, a.shots, h.shots) AS shots
        FROM q LEFT JOIN tp s ON s.ti = lower(q.asked) AND s.tpar = q.parity AND s.tpar <> 'any'
        LEFT JOIN tp a ON a.ti = lower(q.asked) AND a.tpar = 'any' JOIN tp h ON h.ti = 'na')
SELECT conv_id, turn_no, shots, {_sql_fill('pattern')} AS prompt FROM x""")
def q_prompt_build(spark, sf_dir):
    """Every turn's prompt; some intents are made unknown or NULL so that the placeholder is reached."""
    cp = nego_counterpart(spark, sf_dir).withColumns({
        "parity": F.when(F.col("turn_no") % 2 == 1, "odd").otherwise("even"),
        "clarification": F.concat(F.lit("the "), F.col("items")), "addition": F.col("utterance"),
        "removal": F.when(F.col("speaker") == 0, F.concat(F.lit("one "), F.col("items"))),
        "asked": F.when(F.col("event_id") % 7 == 0, "NA").when(F.col("event_id") % 11 == 0, F.lit(None))
                  .otherwise(F.col("intent"))})
    return B.prompt_build(cp, template_table(spark), intent="asked", slots=SLOTS).select(
        "conv_id", "turn_no", "shots", "prompt")
