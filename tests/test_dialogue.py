"""Dialogue assembly: edge rows and invariants."""
from decimal import Decimal

from pyspark.sql import functions as F

from haggle.operators import dialogue as D

SCHEMA = ("conv_id long, turn_no int, speaker int, utterance string, intent string, price decimal(12,2), "
          "items string, background_data string")


def _turns(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_locf_leading_null_and_reset(spark):
    rows = [(1, 1, 0, "a", "Greet-Ask", None, "x", "bg"), (1, 2, 1, "b", "Greet-Inform", Decimal("10"), "x", "bg"),
            (1, 3, 0, "c", "Ask_Price", Decimal("5"), "x", "bg"), (1, 4, 1, "d", "Tell_Price", None, "x", "bg"),
            (1, 5, 0, "e", "Accept", None, "x", "bg"), (2, 1, 0, "f", "Greet-Ask", None, "x", "bg")]
    out = {(r.conv_id, r.turn_no): r.price_filled for r in D.price_locf(_turns(spark, rows)).collect()}
    assert out[(1, 1)] is None and out[(2, 1)] is None          # leading NULL stays NULL, no carry across convs
    assert out[(1, 4)] == Decimal("10") and out[(1, 5)] == Decimal("5")


def test_lead_bounded_and_render(spark):
    rows = [(1, 1, 0, " hi ", "Greet-Ask", Decimal("7"), "bag", "desc"), (1, 2, 1, "yo", "Greet-Inform", None, "bag", "desc"),
            (2, 1, 1, "solo", "Accept", None, "it", "")]
    df = D.role_id(D.example_build(D.next_turn_lead(D.turn_render(D.price_locf(_turns(spark, rows))))))
    r = {(x.conv_id, x.turn_no): x for x in df.collect()}
    assert r[(1, 1)].next_utterance == "yo" and r[(1, 2)].next_utterance == "<|end|>"
    assert r[(2, 1)].next_intent == "<|end|>"                  # one-turn conversation
    assert r[(1, 1)].text == ("A:buyer to seller: 'hi' with intent of Greet-Ask, product description is desc, "
                              "buyer asking for: bag,will offer #price $7.00 , ")
    assert r[(1, 2)].text.endswith(" ,will offer #price $NA , ")
    assert r[(1, 1)].example.startswith(r[(1, 1)].text + "next seller response \tyo")
    assert r[(1, 1)].role_id == 0 and r[(1, 2)].role_id == 1


def test_context_budget_trim(spark):
    # total 10 <= 10 keeps all; total 12 > 10 keeps leading turns with cum < 10 - last (=4) plus last
    rows = [(1, 1, 3), (1, 2, 3), (1, 3, 4), (2, 1, 3), (2, 2, 3), (2, 3, 6), (3, 1, 50)]
    df = spark.createDataFrame(rows, "conv_id long, turn_no int, n int")
    kept = sorted((r.conv_id, r.turn_no) for r in D.context_budget_trim(df, 10, chunk_rows=2).collect())
    assert kept == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 3), (3, 1)]


def test_split_disjoint_and_batches(spark):
    ids = spark.range(300).withColumnRenamed("id", "conv_id")
    tr, va = D.split_conversations(ids, 120, seed=42)
    t, v = {r.conv_id for r in tr.collect()}, {r.conv_id for r in va.collect()}
    assert len(t) == 120 and len(v) == 180 and not (t & v)
    b = D.batch_assign(ids.withColumn("turn_no", F.lit(1)), 4, n_buckets=8).groupBy("bucket", "batch_no").count()
    assert max(r["count"] for r in b.collect()) <= 4


def test_assemble_parts(spark):
    rows = [(1, i, i % 2, f"u{i}", "x", None, "", "") for i in range(1, 8)]
    a = D.conversation_assemble(_turns(spark, rows), part_turns=3).orderBy("part").collect()
    assert [r.n_turns for r in a] == [2, 3, 2]
    assert [t.text for t in a[1].turns] == ["u3", "u4", "u5"]


def test_locf_and_lead_fused_equals_separate(spark):
    from tests.tables import SF_SMALL
    from haggle.sources import fixtures as X
    n = X.nego(spark, SF_SMALL)
    a = D.locf_and_lead(n, chunk_rows=3).select("conv_id", "turn_no", "price_filled", "next_utterance", "next_intent")
    b = D.next_turn_lead(D.price_locf(n)).select("conv_id", "turn_no", "price_filled", "next_utterance", "next_intent")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_sliding_context_depth(spark):
    rows = [(1, t, t % 2, f"u{t}", "Accept", None, "x", "") for t in range(1, 6)]
    for k in (1, 2, 3):
        out = {r.turn_no: r.context for r in D.sliding_context(_turns(spark, rows), k_prev=k, chunk_rows=2).collect()}
        assert all(out[t] == [f"u{i}" for i in range(max(1, t - k), t + 1)] for t in range(1, 6))


def test_split_conversations_takes_the_first_in_hash_order(spark):
    import hashlib
    df = spark.createDataFrame([(i % 50, i) for i in range(300)], "conv_id long, turn_no int")
    order = sorted(range(50), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    tr, va = D.split_conversations(df, 20)
    assert {r.conv_id for r in tr.collect()} == set(order[:20]) and {r.conv_id for r in va.collect()} == set(order[20:])
    assert tr.count() + va.count() == 300
