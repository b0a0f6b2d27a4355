"""Bundle and flow operators against plain-Python loops."""
import random

from haggle.operators import bundle as B

TRIG = ["Negotiate-Remove-X", "Negotiate-Add-X", "Negotiate-Remove-X_Negotiate-Price-Decrease"]


def py_retag(intents):
    f = list(intents)
    for i in range(1, len(f) - 1):
        if f[i - 1] in ("Negotiate-Remove-X", "Negotiate-Add-X"):
            f[i] = "tell_price"
        if f[i - 1] == "Negotiate-Remove-X_Negotiate-Price-Decrease":
            f[i] = "Negotiate-Price-Remove-X"
    return f


def test_intent_retag_runs(spark):
    rnd = random.Random(13)
    flows = {k: [rnd.choice(TRIG + ["Accept", "Ask_Price"]) for _ in range(rnd.randint(1, 15))] for k in range(200)}
    flows[900] = ["Accept"] + [TRIG[0]] * 2 + ["Accept"] * 2
    flows[901] = ["Accept"] + [TRIG[1]] * 3 + ["Accept"] * 2
    flows[902] = ["Accept"] + [TRIG[2], TRIG[0], TRIG[2], TRIG[1]] + ["Accept"] * 2
    rows = [(k, t + 1, x) for k, xs in flows.items() for t, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "flow_id long, turn int, intent string")
    got = {(r.flow_id, r.turn): r.retagged for r in B.intent_retag(df).collect()}
    for k, xs in flows.items():
        exp = py_retag(xs)
        assert [got[(k, t + 1)] for t in range(len(xs))] == exp, (k, xs)


def test_retag_after_a_null_intent(spark):
    xs = [TRIG[0], TRIG[0], None, TRIG[0], "Accept", "Accept"]
    df = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(xs)], "flow_id long, turn int, intent string")
    got = {r.turn: r.retagged for r in B.intent_retag(df).collect()}
    assert [got[i] for i in range(1, 7)] == py_retag(xs) and got[5] == "tell_price"


def test_enumerate_round_phrase(spark):
    acc = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c"), ("q", "z")], "product string, accessory string")
    b = B.bundle_enumerate(acc)
    counts = {r.product: r["count"] for r in b.groupBy("product").count().collect()}
    assert counts == {"p": 6, "q": 1}
    ph = {r.bundle_id: r.ph for r in b.select("bundle_id", B.bundle_phrase_expr("product", "items").alias("ph")).collect()}
    assert ph["a+b"] == "p along with  a a, and a b" and ph["z"] == "q and a z"
    df = spark.createDataFrame([(7.0,), (99.0,), (123.0,), (999.9,), (1234.0,), (56789.0,)], "x double")
    assert [r.r for r in df.select(B.price_round_expr("x").alias("r")).collect()] == [5, 95, 120, 990, 1200, 56700]


def test_curve_and_deal(spark):
    sc = spark.createDataFrame([("p", 0, 1000, 600, 0)],
                               "product string, replica int, total_seller long, total_buyer long, bundle_cost long")
    sc = sc.withColumn("first_seller", sc.total_seller)
    c = B.concession_curve(sc, 20)
    rows = {r.t: r for r in c.collect()}
    assert rows[0].seller_offer == 1000 and rows[0].buyer_offer == 600
    d = B.deal_turn(c).collect()[0].deal_turn
    import math
    exp = next(t for t in range(21) if math.floor(600 + 400 * math.exp(-0.5 * t))
               <= math.ceil(1000 - 400 * math.exp(-0.2 * t)) + 0.05 * 1000)
    assert d == exp


def test_offers_invariants(spark):
    from tests.tables import SF_SMALL
    from haggle.plans.q_bundle import bundles_with_cost, costs, scenarios
    c = costs(spark, SF_SMALL).collect()
    assert c and all(500 <= r.cost <= 2000 for r in c)
    sc = scenarios(spark, SF_SMALL, replicas=3).collect()
    for r in sc:
        assert 0 <= r.first_seller - 500 - r.low <= r.high - r.low
        fb = r.first_buyer - 500
        assert int(r.first_seller * 0.60) <= fb <= int(r.first_seller * 0.85)
        assert r.total_seller == r.first_seller + r.bundle_cost
        assert r.first_buyer + r.bundle_cost // 2 <= r.total_buyer <= r.first_buyer + r.bundle_cost
    b = bundles_with_cost(spark, SF_SMALL)
    assert b.filter("bundle_cost IS NULL").count() == 0


def py_bundle(events):
    """Loop over one flow's (item, action): state after each turn."""
    initial = []
    seen = set()
    for item, action in events:
        if item not in seen and action != "add":
            initial.append(item)
        seen.add(item)
    state = {i: "initial" for i in initial}
    ever, neg, out = set(), set(), []
    for item, action in events:
        if action == "remove":
            state[item] = "removed"
            ever.add(item)
            neg.add(item)
        elif action == "add":
            state[item] = "back" if item in ever else "initial" if item in initial else "new"
        else:
            neg.discard(item)
        vals = list(state.values())
        out.append((state.get(item, "absent"), sum(v != "removed" for v in vals), vals.count("removed"), vals.count("back"),
                    len(neg)))
    return out


def test_bundle_state_per_turn(spark):
    rnd = random.Random(21)
    flows = {f: [(rnd.choice("abc"), rnd.choice(["add", "remove", "ask"])) for _ in range(rnd.randint(1, 12))] for f in range(80)}
    rows = [(f, t + 1, i, a) for f, ev in flows.items() for t, (i, a) in enumerate(ev)]
    df = spark.createDataFrame(rows, "flow_id long, turn int, item string, action string")
    got = {(r.flow_id, r.turn): r for r in B.bundle_state(df).collect()}
    for f, ev in flows.items():
        before = None
        for t, want in enumerate(py_bundle(ev)):
            r = got[(f, t + 1)]
            assert (r.status, r.n_selected, r.n_removed, r.n_back, r.n_negotiable) == want, (f, t, ev)
            if before:
                assert (r.before_n_selected, r.before_n_removed, r.before_n_back, r.before_n_negotiable) == before
            before = want[1:]


def test_every_rule_of_legal_actions(spark):
    rows = [  # r, n, all_added, can_remove, negotiable_empty, deal, prev_seller
        (1, 2, False, True, False, True, 0, [7]), (1, 2, False, True, False, False, 3, [12]),
        (1, 2, False, True, False, False, 0, [1, 2, 3, 4, 5, 10, 11]), (1, 2, False, False, False, False, 4, [1, 3, 4, 5, 11]),
        (2, 2, False, False, False, False, 0, [1, 3, 4, 5, 8, 11]), (1, 2, True, False, True, False, 0, [3, 6, 5, 8, 11]),
        (0, 2, True, False, False, False, 0, [1, 3, 4, 8, 11]), (0, 2, True, False, True, False, 0, [3, 7, 8, 11]),
        (0, 2, False, True, True, False, 0, [1, 2, 3, 4, 10, 11]), (0, 2, False, False, True, False, 0, []),
        (1, 2, True, False, False, False, 0, [])]
    df = spark.createDataFrame([(i, *r[:7], 3) for i, r in enumerate(rows)],
                               "id int, r int, n int, aa boolean, cr boolean, ne boolean, deal boolean, ps int, action_id int")
    out = B.legal_actions(df, n_removed="r", n_acc="n", all_added="aa", can_remove="cr", negotiable_empty="ne", deal="deal",
                          prev_seller="ps").collect()
    for r in out:
        assert r.legal == rows[r.id][7] and r.is_legal == (3 in rows[r.id][7]), r


def test_legal_actions_query_reaches_many_rules(spark):
    from tests.tables import SF_SMALL
    from haggle.plans.q_bundle import q_legal_actions
    assert q_legal_actions(spark, SF_SMALL).select("legal").distinct().count() >= 5


def test_prompts(spark):
    from haggle.labels import BUYER_INTENTS, SELLER_INTENTS, TEMPLATES, template_table
    intents = [*BUYER_INTENTS, *SELLER_INTENTS, "Acknowledge acceptance", "tell_price", "NA", "no such intent", None]
    rows = [(i, x, p, "{price} {x}", "7") for i, x in enumerate(intents) for p in ("odd", "even")]
    df = spark.createDataFrame(rows, "id int, intent string, parity string, items string, price string")
    slots = dict.fromkeys(("product", "seller_text", "buyer_text", "removal", "addition", "clarification"), "items")
    slots.update(dict.fromkeys(("price", "seller_price", "buyer_price"), "price"))
    out = {(r.id, r.parity): r for r in B.prompt_build(df, template_table(spark), slots=slots).collect()}
    assert len(out) == len(rows)
    table = {(i.lower(), p): (n, t) for i, p, n, t in TEMPLATES}
    for i, x, p, items, price in rows:
        key = {"acknowledge acceptance": "acknowledge-acceptance"}.get((x or "").lower(), (x or "").lower())
        n, t = table.get((key, p)) or table.get((key, "any")) or table[("na", "any")]
        for slot, col in slots.items():
            t = t.replace("{" + slot + "}", f"<{slot}>")
        for slot, col in slots.items():
            t = t.replace(f"<{slot}>", items if col == "items" else price)
        assert out[(i, p)].prompt == t and out[(i, p)].shots == n, x


def test_describe_draws_one_variant(spark):
    ents = spark.createDataFrame([(1, "p", "case"), (1, "p", "gift"), (2, "p", "case"), (3, "q", "case"), (4, "z", "case")],
                                 "flow_id long, product string, entity string")
    acc = spark.createDataFrame([("p", "case", f"c{i}", f"t{i}") for i in range(5)],
                                "product string, acc_type string, name string, text string")
    prod = spark.createDataFrame([("p", "P1", "x"), ("q", "Q1", "y")], "product string, name string, text string")
    out = {(r.flow_id, r.entity): r.described for r in B.entity_describe(ents, acc, prod).collect()}
    assert out[(1, "case")] in {f"A case called c{i}.t{i}" for i in range(5)} and out[(2, "case")].startswith("A case called c")
    assert out[(1, "gift")] == "A p called P1.x" and out[(3, "case")] == "A q called Q1.y" and out[(4, "case")] is None


def test_clarifications_stay_open_until_asked(spark):
    topics = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "flow_id long, topic string")
    asked = spark.createDataFrame([(1, "a", 3), (1, "a", 2), (9, "b", 1)], "flow_id long, topic string, turn int")
    out = {(r.flow_id, r.topic): r.asked_turn for r in B.open_clarifications(topics, asked).collect()}
    assert out == {(1, "a"): 2, (1, "b"): None, (2, "a"): None}
