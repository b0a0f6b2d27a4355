"""Work that follows the rows: plans without hot shuffles, stores without a folder a run."""
import math
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from haggle.functions import scan
from haggle.operators import bundle as B
from haggle.operators import score as S
from haggle.sources import io


@pytest.fixture
def no_estimates(spark):
    """As where the catalog's file is large: nothing is broadcast by its estimated size."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n in names:
        spark.conf.unset(n)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_short_series_share_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "FEW_SERIES", 5)
    monkeypatch.setattr(io, "SHORT_SERIES", 3)
    monkeypatch.setattr(io, "PACKS", 2)
    path, schema = f"{tmp_path}/metrics", "run string, step long, name string, value double"
    write = lambda rows: io.write_metrics(spark.createDataFrame(rows, schema), path)
    read = lambda: sorted(map(tuple, io.read_metrics(spark, path).collect()), key=str)
    first = [("main", i, "loss", i / 2) for i in range(9)] + [(f"u{i}", i, "best", 1.0 * i) for i in range(40)] + [(None, 1, "best", 2.0)]
    write(first)
    write(first)
    assert read() == sorted(first, key=str)
    folders = sum(len(dirs) for _, dirs, _ in os.walk(path))
    assert folders <= 8, folders   # series, main, loss, packed, two packs; not one or two for each of 42 runs
    again = [("u3", i, "best", 7.0) for i in range(8)] + [("u4", 0, "best", 8.0), ("main", 0, "loss", 0.5), (None, 5, "best", 3.0)]
    write(again)   # a series is replaced wherever it lies
    new = {(r[0], r[2]) for r in again}
    assert read() == sorted(again + [r for r in first if (r[0], r[2]) not in new], key=str)


def test_mentions_with_their_questions(spark):
    rows = [(1, "a", None), (1, "a", 3), (1, "a", 2), (1, "b", None), (2, "a", None), (1, None, 4), (1, None, None)]
    df = spark.createDataFrame(rows, "flow_id long, topic string, turn int")
    out = B.open_clarifications(df.repartition(3, "flow_id"))
    assert plan_of(out).count("Exchange hashpartitioning") == 1   # the one by dialogue
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "a", 2), (1, "b", None), (2, "a", None), (1, None, None)], key=str)


def test_rows_are_described_where_they_are(spark, no_estimates):
    ents = spark.createDataFrame([(1, "p", "case", 1), (1, "p", "case", 2), (None, "p", "case", 3), (3, "p", None, 4)],
                                 "flow_id long, product string, entity string, turn int")
    acc = spark.createDataFrame([("p", "case", f"c{i}", "t") for i in range(5)], "product string, acc_type string, name string, text string")
    prod = spark.createDataFrame([("p", "P1", "x")], "product string, name string, text string")
    out = B.entity_describe(ents, acc, prod)
    assert "SortMergeJoin" not in plan_of(out) and "ShuffledHashJoin" not in plan_of(out)
    got = {r.turn: r.described for r in out.collect()}
    assert got[1] == got[2] and got[1].startswith("A case called c") and got[3] is None and got[4] is None


def test_costs_are_met_without_a_shuffle_by_item(spark, no_estimates):
    from haggle.plans.q_bundle import basket_deltas
    from tests.tables import SF_SMALL
    assert "hashpartitioning(item" not in plan_of(basket_deltas(spark, SF_SMALL))


def test_flows_of_one_chunk_are_shuffled_once(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(f, t, rnd.choice("abc"), rnd.choice(["add", "remove", "ask"])) for f in range(30) for t in range(1, rnd.randint(2, 30))]
    df = spark.createDataFrame(rows + [(None, 1, "a", "add"), (None, 2, "a", "remove")], "flow_id long, turn int, item string, action string")
    whole = B.bundle_state(df)
    assert plan_of(whole).count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(scan, "CHUNK_ROWS", 8)   # longer flows take the other way
    one, several = scan.by_chunks(df, "flow_id", F.floor(F.col("turn") / 8))
    assert 0 < several.count() and one.count() + several.count() == df.count()
    assert sorted(map(str, B.bundle_state(df).collect())) == sorted(map(str, whole.collect()))


def test_one_window_equals_two_levels(spark):
    rnd = random.Random(6)
    rows = [(rnd.randrange(6), rnd.randrange(50), i, rnd.choice([None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, ts long, id int, v int").withColumn("one", F.lit(1))
    how = dict(fill={"v": "f"}, nxt=["id"], prv=["v"], prv_two=True, order=["ts", "id"], chunk=F.floor(F.col("ts") / 7),
               running=[("one", "sum", "n", False), ("v", "min", "low", True)], totals=[("v", "sum", "all")])
    two = scan.multi_scan(df, "k", "one", **how)
    few, many = scan.by_size(df, "k", chunk_rows=30)
    assert many.count() > 0 and few.count() + many.count() == 200
    one = scan.multi_scan(df, "k", "one", one_chunk=True, **how).select(two.columns)
    assert [f.dataType for f in one.schema] == [f.dataType for f in two.schema]
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    numbered = [sorted(map(str, scan.row_number(df, "k", ["ts", "id"], F.floor(F.col("ts") / 7), "r", **x).collect()))
                for x in ({}, {"sizes": df}, {"few_chunks": True})]
    assert numbered[0] == numbered[1] == numbered[2]


def test_cosines_of_a_batch():
    kind = pa.list_(pa.string())
    a = pa.array([["a", "b", "a"], [""], None, ["x"], ["é"], ["q"]], kind)
    b = pa.array([["a"], ["", "y"], ["a"], None, ["é"], ["r"]], kind)
    got = S._word_cosines.func(a, b).to_pylist()
    want = [2 / math.sqrt(5), 1 / math.sqrt(2), None, None, 1.0, 0.0]
    assert all(g == w or abs(g - w) < 1e-12 for g, w in zip(got, want))
    assert S._word_cosines.func(a.slice(4), b.slice(4)).to_pylist() == [1.0, 0.0]
    assert S._word_cosines.func(a.slice(0, 0), b.slice(0, 0)).to_pylist() == []
