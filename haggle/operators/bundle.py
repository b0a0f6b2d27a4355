"""Bundle and offer analytics: the dialogue simulator's rules
re-aimed as table operators.  Randomness is md5-keyed (repeatable at any
partitioning); every per-product fan-out is bounded by the catalog (accessory
types per product, variants per type), never by the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.hashing import md5_int
from ..functions.joins import small
from ..session import checkpointed

# ---- FIXED VALUES: simulator constants -----------------------------------
DELIVERY = 500
COST_LOW, COST_HIGH = 500, 2000
BUYER_OPEN_LOW, BUYER_OPEN_HIGH = 0.60, 0.85
SELLER_DECAY, BUYER_DECAY = 0.5, 0.2
DEAL_TOLERANCE = 0.05
ACCEPT_MARGIN = 0.10
RETAG_TELL = ("Negotiate-Remove-X", "Negotiate-Add-X")
RETAG_TELL_TO = "tell_price"
RETAG_REMOVE = "Negotiate-Remove-X_Negotiate-Price-Decrease"
RETAG_REMOVE_TO = "Negotiate-Price-Remove-X"
DESCRIBE_FORMAT = ("A ", " called ", ".")


def _uniform_int(lo: Column, hi: Column, seed, *cols) -> Column:
    """Repeatable integer uniform in [lo, hi] (inclusive)."""
    return (lo + F.pmod(md5_int(seed, *cols), (hi - lo + 1).cast("long"))).cast("long")


def accessory_cost(acc: DataFrame, *, accessory: str = "accessory", seed: int = 7) -> DataFrame:
    """A repeatable integer cost in 500..2000 per accessory name."""
    return acc.withColumn("cost", _uniform_int(F.lit(COST_LOW), F.lit(COST_HIGH), seed, accessory))


def price_range_parse(df: DataFrame, *, price: str = "price") -> DataFrame:
    """``"low-high"`` -> integer ``low``, ``high`` (NULL when malformed)."""
    parts = F.split(F.col(price), "-")
    return (df.withColumn("low", F.get(parts, 0).try_cast("long"))
            .withColumn("high", F.get(parts, 1).try_cast("long")))


def bundle_enumerate(acc: DataFrame, *, product: str = "product", accessory: str = "accessory") -> DataFrame:
    """Every accessory combination of size 1 and 2 per product.  Pairs come
    from an equi-join on product with ``a < b``; the accessory set per
    product is the distinct catalog list (bounded by the catalog)."""
    a = acc.select(product, F.col(accessory).alias("a")).distinct()
    singles = a.select(product, F.array("a").alias("items"))
    b = a.select(product, F.col("a").alias("b"))
    pairs = a.join(b, product).filter(F.col("a") < F.col("b")).select(product, F.array("a", "b").alias("items"))
    return (singles.unionByName(pairs)
            .withColumn("bundle_id", F.array_join("items", "+"))
            .withColumn("n_items", F.size("items")))


def bundle_cost(bundles: DataFrame, costs: DataFrame, *, keys=("product", "bundle_id"),
                accessory: str = "accessory") -> DataFrame:
    """Sum of accessory costs per bundle (explode, join on accessory,
    aggregate)."""
    keys = list(keys)
    ex = bundles.select(*keys, F.explode("items").alias(accessory))
    return (ex.join(costs.select(accessory, "cost"), accessory, "left")
            .groupBy(*keys).agg(F.sum("cost").alias("bundle_cost")))


def opening_offers(products: DataFrame, bundles: DataFrame, *, replicas: int, seed: int = 11,
                   product: str = "product") -> DataFrame:
    """Scenario table: each product x ``replicas`` draws.  Seller opening =
    uniform in the price range + delivery; buyer opening = uniform in
    60..85 % of the seller opening + delivery; a bundle drawn from the
    product's bundles (numbered once, met by its number); totals add the
    bundle cost (seller: all of it, buyer: a uniform between half and all of
    it, rounded up)."""
    sc = products.select(product, "low", "high").withColumn(
        "replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    sc = sc.withColumn("first_seller", _uniform_int(F.col("low"), F.col("high"), seed, product, "replica")
                       + DELIVERY)
    lo = F.floor(F.col("first_seller") * BUYER_OPEN_LOW).cast("long")
    hi = F.floor(F.col("first_seller") * BUYER_OPEN_HIGH).cast("long")
    sc = sc.withColumn("first_buyer", _uniform_int(lo, hi, f"{seed}:b", product, "replica") + DELIVERY)
    b = scan.row_number(bundles.select(product, "bundle_id", "items", "bundle_cost"), product, ["bundle_id"],
                        F.ascii("bundle_id"), "_i")
    n = b.groupBy(product).agg(F.max("_i").alias("_n"))
    sc = (sc.join(n, product, "left")
          .withColumn("_i", F.pmod(md5_int(f"{seed}:bundle", product, "replica"), F.col("_n")) + 1)
          .join(b, [product, "_i"], "left").drop("_i", "_n"))
    half = F.floor(F.col("bundle_cost") / 2).cast("long")
    extra = _uniform_int(half, F.col("bundle_cost").cast("long"), f"{seed}:extra", product, "replica")
    return (sc.withColumn("total_seller", F.col("first_seller") + F.col("bundle_cost"))
            .withColumn("total_buyer", F.ceil(F.col("first_buyer") + extra).cast("long")))


def concession_curve(sc: DataFrame, turns: int, *, seller: str = "total_seller",
                     buyer: str = "total_buyer") -> DataFrame:
    """Offers per turn t = 0..turns: seller(t) = b + (s-b) e^(-0.5 t) rounded
    down, buyer(t) = s - (s-b) e^(-0.2 t) rounded up."""
    s, b = F.col(seller).cast("double"), F.col(buyer).cast("double")
    d = sc.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(turns))))
    return (d.withColumn("seller_offer", F.floor(b + (s - b) * F.exp(-SELLER_DECAY * F.col("t"))).cast("long"))
            .withColumn("buyer_offer", F.ceil(s - (s - b) * F.exp(-BUYER_DECAY * F.col("t"))).cast("long")))


def deal_turn(curve: DataFrame, *, keys=("product", "replica")) -> DataFrame:
    """First turn with seller offer <= buyer offer + 5 % of (seller opening +
    bundle cost); NULL when the curves never meet."""
    tol = DEAL_TOLERANCE * (F.col("first_seller") + F.col("bundle_cost"))
    return curve.groupBy(*keys).agg(
        F.min(F.when(F.col("seller_offer") <= F.col("buyer_offer") + tol, F.col("t"))).alias("deal_turn"))


def near_accept_expr(buyer, seller) -> Column:
    """Accept when buyer + 10 % of the seller price reaches the seller price."""
    return F.col(buyer) + ACCEPT_MARGIN * F.col(seller) >= F.col(seller)


def price_round_expr(x) -> Column:
    """Round down to 5 / 10 / 100 for prices of <=2 / 3 / >3 integer digits."""
    v = F.col(x) if isinstance(x, str) else x
    digits = F.length(F.floor(F.abs(v)).cast("string"))
    m = F.when(digits <= 2, 5).when(digits == 3, 10).otherwise(100)
    return (F.floor(v / m) * m).cast("long")


def bundle_price_adjust(events: DataFrame, *, keys=("flow_id",), pos: str = "turn", delta: str = "delta",
                        opening: str = "opening", out: str = "offer") -> DataFrame:
    """Running offer = opening + running sum of signed deltas (add item +cost,
    remove item -cost, drop delivery -500 once), a skew-safe running sum."""
    d = scan.running_agg(events, list(keys), pos, delta, "_cum", how="sum")
    return d.withColumn(out, F.col(opening) + F.coalesce(F.col("_cum"), F.lit(0))).drop("_cum")


def bundle_state(events: DataFrame, *, keys=("flow_id",), item: str = "item", pos: str = "turn",
                 action: str = "action", previous=(), running=()) -> DataFrame:
    """The bundle after every turn: ``events`` plus ``status`` of the turn's
    item (initial, removed, back = added again after a removal, new = added
    without one) and the counts ``n_selected``, ``n_removed``, ``n_back`` and
    ``n_negotiable``; ``before_<name>`` gives each of them before the turn.

    An item is in the bundle from the start unless its first action is
    ``add``.  An item is negotiable from its removal until it is asked about.
    Only earlier turns of the flow are read (and the initial bundle, which
    the flow starts with).  One scan pass per (flow, item), one per flow,
    linear in the turns: the selected set itself is the items whose latest
    status is not ``removed``.

    ``previous`` (columns of the turn before, as ``prev_<col>``) and ``running``
    ((value, how, out, exclusive), see :func:`..functions.scan.multi_scan`) ride on the pass per flow.

    Flows of one chunk of turns are dealt out by flow once, for both passes; only
    flows with more turns take the two-level scans.  ``events`` is read more than
    once: a written table is best."""
    keys = list(keys)
    one, several = scan.by_chunks(events, keys, F.floor(F.col(pos) / F.lit(scan.CHUNK_ROWS)))
    own = dict(keys=keys, item=item, pos=pos, action=action, previous=list(previous), running=list(running))
    out = _bundle_scans(one.repartition(*keys), one_chunk=True, **own)
    return out if several is None else out.unionByName(_bundle_scans(several, one_chunk=False, **own))


def _bundle_scans(events: DataFrame, *, keys, item, pos, action, previous, running, one_chunk: bool) -> DataFrame:
    act = F.col(action)
    d = events.withColumns({
        "_c": F.when(act.isin("add", "remove"), act), "_rm": F.when(act == "remove", 1).otherwise(0),
        "_ng": F.when(act == "remove", 1).when(act == "ask", 0), "_f": F.struct(F.col(pos).alias("p"), act.alias("a"))})
    d = scan.multi_scan(d, [*keys, item], pos, fill={"_c": "_prev", "_ng": "_neg"}, fill_exclusive=True,
                        one_chunk=one_chunk, running=[("_rm", "max", "_ever", True), ("_f", "min", "_first", False)])
    first_add = F.col("_first.a") == "add"
    back = F.when(F.coalesce(F.col("_ever"), F.lit(0)) == 1, "back").when(first_add, "new").otherwise("initial")
    before = (F.when(F.col("_prev") == "remove", "removed").when(F.col("_prev") == "add", back)
              .when(first_add, "absent").otherwise("initial"))
    d = d.withColumn("before_status", before)
    d = d.withColumn("status", F.when(act == "remove", "removed").when(act == "add", back).otherwise(F.col("before_status")))

    def step(test):
        return test(F.col("status")).cast("int") - test(F.col("before_status")).cast("int")

    sel, rem, bck = (lambda c: c.isin("initial", "back", "new"), lambda c: c == "removed", lambda c: c == "back")
    negotiable = F.coalesce(F.col("_ng"), F.col("_neg"), F.lit(0)) - F.coalesce(F.col("_neg"), F.lit(0))
    d = d.withColumns({"_ds": step(sel), "_dr": step(rem), "_db": step(bck), "_dn": negotiable,
                       "_i": ((F.col("_first.p") == F.col(pos)) & ~first_add).cast("int")})
    d = scan.multi_scan(d, keys, pos, one_chunk=one_chunk, prv=previous, prev_prefix="prev_", totals=[("_i", "sum", "_n0")], running=[
        ("_ds", "sum", "n_selected", False), ("_dr", "sum", "n_removed", False), ("_db", "sum", "n_back", False),
        ("_dn", "sum", "n_negotiable", False), *running])
    d = d.withColumn("n_selected", F.col("n_selected") + F.col("_n0"))
    d = d.withColumns({f"before_{n}": F.col(n) - F.col(c) for n, c in (
        ("n_selected", "_ds"), ("n_removed", "_dr"), ("n_back", "_db"), ("n_negotiable", "_dn"))})
    made = ["before_status", "status", *(f"{p}{n}" for n in ("n_selected", "n_removed", "n_back", "n_negotiable")
                                         for p in ("", "before_")), *(f"prev_{c}" for c in previous), *(r[2] for r in running)]
    return d.select(*events.columns, *made)


def open_clarifications(mentions: DataFrame, asked: DataFrame | None = None, *, keys=("flow_id", "topic"),
                        pos: str = "turn") -> DataFrame:
    """Each dialogue's topics (features, accessories, the product) with the
    turn at which they were first asked about: a topic is open at turn t iff
    ``asked_turn`` is NULL or later than t.  One row per (dialogue, topic)
    says it for all turns.

    ``mentions`` has a row or more per (dialogue, topic).  With ``asked`` the
    questions (keys and ``pos``) are a table of their own, else a mention that is
    a question has its turn as ``pos``, and the others NULL.  One grouping, no
    join: mentions that are dealt out by dialogue stay where they are."""
    keys = list(keys)
    if asked is None:
        rows = mentions.select(*keys, pos, F.lit(True).alias("_said"))
    else:
        rows = mentions.select(*keys, F.lit(None).cast(asked.schema[pos].dataType).alias(pos), F.lit(True).alias("_said")
                               ).unionByName(asked.select(*keys, pos, F.lit(False).alias("_said")))
    named = F.lit(True)
    for k in keys:   # a question without a dialogue or a topic asks about none
        named = named & F.col(k).isNotNull()
    return rows.groupBy(*keys).agg(F.min(F.when(named, F.col(pos))).alias("asked_turn"), F.max("_said").alias("_said")).where(
        "_said").drop("_said")


# ---- FIXED VALUES: buyer actions allowed in a negotiation state ----------
# (conditions, allowed action ids), first match wins.  r items are removed of
# n; open/added: not all / all items were added back; can: an item can still
# be removed; none/some: no / some item is negotiable; quote: the seller just
# asked for a price.
LEGAL_RULES = [
    (("deal",), (7,)),
    (("quote",), (12,)),
    (("r>0", "open", "can", "r<n"), (1, 2, 3, 4, 5, 10, 11)),
    (("r>0", "r<n", "open"), (1, 3, 4, 5, 11)),
    (("r>0", "r=n", "open"), (1, 3, 4, 5, 8, 11)),
    (("r>0", "none"), (3, 6, 5, 8, 11)),
    (("r=0", "added", "some"), (1, 3, 4, 8, 11)),
    (("r=0", "added", "none"), (3, 7, 8, 11)),
    (("r=0", "open", "r<n", "can"), (1, 2, 3, 4, 10, 11)),
]


def legal_actions_expr(n_removed, n_acc, all_added, can_remove, negotiable_empty, deal, prev_seller) -> Column:
    """Allowed buyer action ids for a state, following the simulator's
    rule order (first matching rule wins); none where no rule matches."""
    r, n, added = F.col(n_removed), F.col(n_acc), F.col(all_added)
    tests = {"deal": F.col(deal), "quote": F.col(prev_seller) == 3, "r>0": r > 0, "r=0": r == 0, "r<n": r < n, "r=n": r == n,
             "open": ~added, "added": added, "can": F.col(can_remove), "none": F.col(negotiable_empty),
             "some": ~F.col(negotiable_empty)}
    out = F.array().cast("array<int>")
    for when, codes in reversed(LEGAL_RULES):
        test = F.lit(True)
        for t in when:
            test = test & tests[t]
        out = F.when(test, F.array(*[F.lit(c) for c in codes])).otherwise(out)
    return out


def legal_actions(df: DataFrame, *, action: str = "action_id", **state) -> DataFrame:
    d = df.withColumn("legal", legal_actions_expr(**state))
    return d.withColumn("is_legal", F.array_contains("legal", F.col(action)))


def intent_retag(df: DataFrame, *, keys=("flow_id",), pos: str = "turn", intent: str = "intent",
                 out: str = "retagged", exclude_last: bool = True) -> DataFrame:
    """In-place retagging of the row after a trigger: after Negotiate-Remove-X
    or Negotiate-Add-X -> ``tell_price``; after the remove-and-decrease
    intent -> Negotiate-Price-Remove-X.  Because the original rewrites rows
    in place, a retagged trigger no longer fires: within a run of
    consecutive triggers only the 1st, 3rd, 5th ... are live.  Closed form:
    position in the run (gaps and islands) -> live = odd -> the next row
    is retagged.  The first row, and (``exclude_last``) the last row, are
    never retagged.  ``pos`` must be dense within the flow."""
    keys = list(keys)
    trig = F.coalesce(F.col(intent).isin(*RETAG_TELL, RETAG_REMOVE), F.lit(False))   # a NULL intent never fires
    d = df.withColumns({"_trig": trig, "_nt_pos": F.when(~trig, F.col(pos))})
    # one pass: previous row, next row, last non-trigger position before
    # this row, first position of the flow
    d = scan.multi_scan(d, keys, pos, prv=["_trig", intent, pos], nxt=[pos], prev_prefix="_prev_",
                        next_prefix="_next_", running=[("_nt_pos", "max", "_last_nt", True),
                                                       (pos, "min", "_p0", False)])
    k_prev = F.col(f"_prev_{pos}") - F.coalesce(F.col("_last_nt"), F.col("_p0") - 1)
    fire = F.coalesce(F.col("_prev__trig") & (k_prev % 2 == 1), F.lit(False))
    if exclude_last:
        fire = fire & F.col(f"_next_{pos}").isNotNull()
    prev_intent = F.col(f"_prev_{intent}")
    new = F.when(fire & prev_intent.isin(*RETAG_TELL), F.lit(RETAG_TELL_TO)) \
           .when(fire & (prev_intent == RETAG_REMOVE), F.lit(RETAG_REMOVE_TO)) \
           .otherwise(F.col(intent))
    return d.withColumn(out, new).drop("_trig", "_nt_pos", "_last_nt", "_p0", "_prev__trig",
                                       f"_prev_{intent}", f"_prev_{pos}", f"_next_{pos}")


def _numbered(variants: DataFrame, keys: list[str]) -> DataFrame:
    """variants (keys, name, text) plus their number 1..n by name within the
    keys and n, by the skew-safe scan (chunks of the name's first letter)."""
    d = scan.row_number(variants, keys, ["name", "text"], F.ascii("name"), "_i")
    return d.join(d.groupBy(*keys).agg(F.max("_i").alias("_n")), keys)


def entity_describe(entities: DataFrame, acc_variants: DataFrame, prod_variants: DataFrame, *,
                    flow: str = "flow_id", product: str = "product", entity: str = "entity",
                    seed: int = 5) -> DataFrame:
    """One description per (flow, entity): ``A <entity> called <name>.<text>``
    with a variant drawn (md5) from the product's accessories of that type,
    or, where the entity is not one of its accessory types, ``A <product>
    called ...`` from the product's own descriptions; NULL where a key is NULL.

    Variants are numbered once; a row draws a number and meets its one
    variant by an equi-join, never all of them.  The draw depends on flow, entity
    and product alone, so rows are described where they are: they are not
    shuffled unless the catalog is too large for a broadcast."""
    av = checkpointed(_numbered(acc_variants.select(product, F.col("acc_type").alias(entity), "name", "text"), [product, entity]))
    pv = checkpointed(_numbered(prod_variants.select(product, "name", "text"), [product]))
    sizes_a = small(av.select(product, entity, F.col("_n").alias("_na")).distinct())
    sizes_p = small(pv.select(product, F.col("_n").alias("_np")).distinct())
    draw = md5_int(seed, flow, entity, product)
    ent = entities.join(sizes_a, [product, entity], "left").join(sizes_p, product, "left").withColumn("_draw", draw).withColumns({
        "_ia": F.pmod("_draw", F.col("_na")) + 1, "_ip": F.when(F.col("_na").isNull(), F.pmod("_draw", F.col("_np")) + 1)})
    av = small(av.select(product, entity, F.col("_i").alias("_ia"), F.struct("name", "text").alias("_va")))
    pv = small(pv.select(product, F.col("_i").alias("_ip"), F.struct("name", "text").alias("_vp")))
    pick = ent.join(av, [product, entity, "_ia"], "left").join(pv, [product, "_ip"], "left")
    a0, a1, a2 = DESCRIBE_FORMAT
    what = F.when(F.col("_va").isNotNull(), F.col(entity)).otherwise(F.col(product))
    v = F.coalesce("_va", "_vp")
    named = F.col(flow).isNotNull() & F.col(product).isNotNull() & F.col(entity).isNotNull()
    first = [flow, product, entity]
    return pick.select(*first, *[c for c in entities.columns if c not in first], F.when(named, F.concat(
        F.lit(a0), what, F.lit(a1), v["name"], F.lit(a2), v["text"])).alias("described"))


def flatten_nested(df: DataFrame, *, col: str = "nested", out: str = "flat") -> DataFrame:
    """Depth-first flatten of an ``array<array<...>>`` (depth fixed by the
    schema)."""
    return df.withColumn(out, F.flatten(F.col(col)))


def bundle_phrase_expr(product, items) -> Column:
    """``P and a X`` for one item; ``P along with  a X, ... and a Z`` for
    more (the original's double space and commas kept)."""
    it = F.col(items)
    head = F.slice(it, 1, F.size(it) - 1)
    many = F.concat(F.col(product), F.lit(" along with "),
                    F.array_join(F.transform(head, lambda x: F.concat(F.lit(" a "), x, F.lit(","))), ""),
                    F.lit(" and a "), F.element_at(it, -1))
    return F.when(F.size(it) == 1, F.concat(F.col(product), F.lit(" and a "), F.element_at(it, 1))) \
            .otherwise(many)


def counterpart_state(df: DataFrame, *, keys=("conv_id",), pos: str = "turn_no", role: str = "speaker",
                      price: str = "price", text: str = "utterance", open_buyer: str = "open_buyer",
                      open_seller: str = "open_seller") -> DataFrame:
    """For each turn, each side's last stated price and last utterance
    strictly before it (opening prices / empty text when none), by
    exclusive skew-safe forward fills."""
    keys = list(keys)
    d = df.withColumns({
        "_buyer_p": F.when(F.col(role) == 0, F.col(price)), "_buyer_u": F.when(F.col(role) == 0, F.col(text)),
        "_seller_p": F.when(F.col(role) == 1, F.col(price)), "_seller_u": F.when(F.col(role) == 1, F.col(text))})
    d = scan.ffill(d, keys, pos, {"_buyer_p": "buyer_last_price", "_buyer_u": "buyer_last_text",
                                  "_seller_p": "seller_last_price", "_seller_u": "seller_last_text"},
                   exclusive=True)
    d = (d.withColumn("buyer_last_price", F.coalesce(F.col("buyer_last_price"), F.col(open_buyer)))
         .withColumn("seller_last_price", F.coalesce(F.col("seller_last_price"), F.col(open_seller)))
         .withColumn("buyer_last_text", F.coalesce(F.col("buyer_last_text"), F.lit("")))
         .withColumn("seller_last_text", F.coalesce(F.col("seller_last_text"), F.lit(""))))
    return d.drop("_buyer_p", "_buyer_u", "_seller_p", "_seller_u")


def prompt_build(df: DataFrame, templates: DataFrame, *, intent: str = "intent", parity: str = "parity",
                 slots: dict[str, str], placeholder: str = "na") -> DataFrame:
    """Pick a template by (lower-case intent, turn parity) - a
    parity-specific row wins over the intent's ``any`` row, the
    ``placeholder`` intent's row stands in for every other or NULL intent -
    and fill its ``{slot}`` places.  Adds ``prompt`` and ``shots``.

    The pattern is cut into literal and slot pieces once and the slots are
    filled in one pass, so braces inside an inserted text are left alone.
    ``templates`` (intent, parity, shots, pattern) is the caller's: the join
    strategy is left to the optimizer's size check.  The placeholder is one row (of
    several, the least pattern) and goes into the plan as a constant."""
    def named(rows, p):
        return rows.select(F.col("intent").alias("_ti"), F.col("parity").alias("_tp"),
                           F.struct("pattern", "shots").alias(p))
    spec = named(templates.filter(F.col("parity") != "any"), "_ps")
    anyp = named(templates.filter(F.col("parity") == "any"), "_pa").drop("_tp")
    hold = anyp.filter(F.col("_ti") == placeholder).agg(F.min("_pa").alias("_ph")).first()._ph
    d = (df.withColumn("_ti", F.lower(F.col(intent))).withColumn("_tp", F.col(parity))
         .join(spec, ["_ti", "_tp"], "left").join(anyp, "_ti", "left"))
    kind = anyp.schema["_pa"].dataType.simpleString()
    constant = F.lit(None).cast(kind) if hold is None else F.struct(
        F.lit(hold.pattern).alias("pattern"), F.lit(hold.shots).alias("shots")).cast(kind)
    t = F.coalesce("_ps", "_pa", constant)
    pieces = F.regexp_extract_all(t["pattern"], F.lit(r"(\{\w+\}|[^{]+|\{)"), 1)

    def fill(piece):
        out = piece
        for slot, col in slots.items():
            out = F.when(piece == "{" + slot + "}", F.coalesce(F.col(col).cast("string"), F.lit(""))).otherwise(out)
        return out
    return d.withColumns({"prompt": F.array_join(F.transform(pieces, fill), ""), "shots": t["shots"]}).drop(
        "_ti", "_tp", "_ps", "_pa")
