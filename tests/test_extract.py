"""Extraction operators against plain-Python readings of their specs."""
import random

from haggle.labels import BUYER_INTENTS, SELLER_INTENTS
from haggle.operators import extract as E


def py_tag_last(text, role):
    i = text.find("next")
    if i >= 0:
        text = text[i:]
    labels = [x.lower() for x in (BUYER_INTENTS if role == 0 else SELLER_INTENTS)]
    for w in reversed([w.strip() for w in text.lower().split(" ")]):
        found = [k for k in labels if k in w]
        if found:
            for k in found:
                if len(k.split("_")) == len(w.split("_")):
                    return k
            return "NA"
    return "NA"


def test_intent_tag_last(spark):
    rnd = random.Random(3)
    vocab = ["next", "buyer", "with", "intent:", "\tAccept", "accept", "Greet-Ask_Negotiate-Price-Decrease",
             "xx-negotiate-price-decrease", "tell_price,", "ask_price", "Negotiate-Remove-X_foo", "hello",
             "greet-inform_negotiate-price-nochange", "reject\n", "avoid_rejection"]
    rows = [(i, rnd.randint(0, 1), " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 9))))
            for i in range(400)]
    rows += [(900, 0, "no marker Accept"), (901, 1, ""), (902, 0, "next  accept")]
    df = spark.createDataFrame(rows, "id long, role_id int, text string")
    got = {r.id: r.tag for r in E.intent_tag_last(df).collect()}
    for i, role, t in rows:
        assert got[i] == py_tag_last(t, role), (t, role)


def py_opening(prices, markers, exact=False):
    """Loop form: read turn 1, re-read turn 2, later turns only while no
    price is held.  A marker with no number drops the held flag; a turn 2
    without any marker drops it too unless ``exact`` (then turn 1 freezes)."""
    out, init, val = [], False, None
    for i, (p, m) in enumerate(zip(prices, markers)):
        if i == 1 or not init:
            if p is not None:
                val, init = p, True
            elif m:
                init = False
            elif i == 1 and not exact:
                init = False
        out.append((val if val is not None else 10000, val is not None))
    return out


def test_opening_price_edges(spark):
    convs = {
        1: ["#price $12000 ,", "#price $900.5 ,", "#price $5 ,"],
        2: ["none", "none", "#price $700 ,", "#price $1 ,"],
        3: ["#price $300 ,", "no marker", "#price $400 ,"],
        4: ["#price $300 ,", "#price $NA ,", "#price $450 ,"],
        5: ["nothing", "still nothing"],
        6: ["#price $12000.0 , then #price $1 ,"],
        7: ["#price $NA , later #price $450 ,", "x"],
        8: ["#price 450 then #price $450 ,", "#price"],
    }
    rows = [(c, t + 1, txt) for c, ts in convs.items() for t, txt in enumerate(ts)]
    df = spark.createDataFrame(rows, "conv_id long, turn_no int, text string")
    for exact in (False, True):
        got = {(r.conv_id, r.turn_no): (r.opening_price, r.price_found)
               for r in E.opening_price(df, exact=exact).collect()}
        for c, ts in convs.items():
            import re
            ps = [int(float(m.group(1))) if (m := re.match(r"#price \$([0-9]+(\.[0-9]+)?)", x[x.find("#price"):])) else None
                  for x in ts]
            ms = ["#price" in x for x in ts]
            exp = py_opening(ps, ms, exact=exact)
            for t in range(len(ts)):
                assert got[(c, t + 1)] == exp[t], (exact, c, t + 1)
    got = {(r.conv_id, r.turn_no): r.opening_price for r in E.opening_price(df).collect()}
    assert got[(3, 2)] == 300 and got[(3, 3)] == 400        # lenient: keeps searching
    got = {(r.conv_id, r.turn_no): r.opening_price for r in E.opening_price(df, exact=True).collect()}
    assert got[(3, 3)] == 300                                # exact: frozen at turn 1


def py_truncate(toks, lps):
    kt, kl = [], []
    for t, lp in zip(toks, lps):
        if t not in (628, -1):
            kt.append(t), kl.append(lp)
        elif t == 628:
            kt += [t, 198]
            kl.append(lp)
            break
        else:
            break
    return kt, sum(kl)


def test_truncate_and_prompt_slice(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        n = rnd.randint(0, 12)
        toks = [rnd.choice([-1, 628, 197, 5, 6, 7, 8]) for _ in range(n)]
        rows.append((i, toks, [float(-rnd.random()) for _ in range(n)]))
    df = spark.createDataFrame(rows, "vec_id long, tokens array<int>, logp array<double>")
    got = {r.vec_id: r for r in E.prompt_slice(E.truncate_at_eos(df)).collect()}
    for i, toks, lps in rows:
        kt, s = py_truncate(toks, lps)
        assert got[i].kept_tokens == kt and abs(got[i].logp_sum - s) < 1e-9
        assert got[i].prompt == (toks[:toks.index(197)] if 197 in toks else toks)


def test_marked_and_label_encode(spark):
    rows = [(1, 0, "x with intent: \tTell_Price\n"), (2, 1, "intent of Accept"), (3, 0, "intent: Greet-Ask"),
            (4, 1, "nothing")]
    df = spark.createDataFrame(rows, "id long, role_id int, text string")
    got = {r.id: r.tag for r in E.intent_tag_marked(df).collect()}
    assert got == {1: "Tell_Price", 2: "Accept", 3: "NA", 4: "NA"}
    enc = E.label_encode(spark.createDataFrame([(1, "acknowledge acceptance"), (0, "ACCEPT"), (0, "NA")],
                                               "role_id int, tag string"))
    assert sorted(((r.role_id, r.label_id if r.label_id is not None else -1) for r in enc.collect())) == [(0, -1), (0, 7), (1, 8)]


def test_conversation_outcome_equals_turn_path(spark):
    from tests.tables import SF_SMALL
    from haggle.operators import dialogue as D
    from haggle.sources import fixtures as X
    r = D.role_id(D.turn_render(D.price_locf(X.nego(spark, SF_SMALL))))
    a = E.conversation_outcome(r)
    b = E.final_outcome(E.reservation_price(E.opening_price(r)))
    cols = ["conv_id", "last_turn", "outcome", "final_price", "opening_price", "reservation_price", "prize_diff"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_strip_markers_decode_and_lemmas(spark):
    df = spark.createDataFrame([(1, [1, 2, 10, 11, 12, 3, 4]), (2, [1, 2, 3])], "vec_id long, tokens array<int>")
    vocab = spark.createDataFrame([(10, "a"), (11, "b"), (12, "c")], "token int, piece string")
    out = {r.vec_id: r for r in E.strip_markers(df, vocab=vocab).collect()}
    assert out[1].stripped == [10, 11, 12] and out[1].stripped_text == "abc" and out[2].stripped == []
    t = spark.createDataFrame([(1, "The cats, ran!")], "id long, text string")
    lem = spark.createDataFrame([("cats", "cat"), ("ran", "run")], "word string, lemma string")
    assert E.normalize_text(t, lemmas=lem).collect()[0].norm == "the cat run"
    t = spark.createDataFrame([(1, "two cats", None), (2, "two cats", None), (None, "Ran", "z"), (4, None, "z"), (5, "!", "z")],
                              "id long, text string, other string")
    got = {r.id: r.norm for r in E.normalize_text(t, lemmas=lem).collect()}
    assert got == {1: "two cat", 2: "two cat", None: "run", 4: None, 5: ""}
