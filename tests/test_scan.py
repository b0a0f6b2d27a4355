"""Chunked two-level scans equal the plain single-window scans."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from haggle.functions import scan


def _data(spark, seed=1):
    rnd = random.Random(seed)
    rows = []
    for k in range(5):
        n = rnd.randint(1, 40)
        pos = sorted(rnd.sample(range(200), n))
        for p in pos:
            v = None if rnd.random() < 0.4 else float(rnd.randint(-50, 50))
            rows.append((k, p, v))
    return spark.createDataFrame(rows, "k long, p long, v double")


def _cmp(a, b, cols):
    ra = sorted(tuple(r[c] for c in cols) for r in a.collect())
    rb = sorted(tuple(r[c] for c in cols) for r in b.collect())
    assert ra == rb


def test_ffill(spark):
    df = _data(spark)
    for excl in (False, True):
        got = scan.ffill(df, "k", "p", "v", "f", exclusive=excl, chunk_rows=7)
        w = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1 if excl else 0)
        exp = df.withColumn("f", F.last("v", ignorenulls=True).over(w))
        _cmp(got, exp, ["k", "p", "f"])


def test_running(spark):
    df = _data(spark)
    for how, fn in (("sum", F.sum), ("min", F.min), ("max", F.max)):
        for excl in (False, True):
            got = scan.running_agg(df, "k", "p", "v", "r", how=how, exclusive=excl, chunk_rows=5)
            w = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1 if excl else 0)
            exp = df.withColumn("r", fn("v").over(w))
            _cmp(got, exp, ["k", "p", "r"])


def test_shift(spark):
    df = _data(spark)
    w = Window.partitionBy("k").orderBy("p")
    got = scan.shift(df, "k", "p", ["v", "p"], direction=1, prefix="n_", chunk_rows=3)
    exp = df.withColumn("n_v", F.lead("v").over(w)).withColumn("n_p", F.lead("p").over(w))
    _cmp(got, exp, ["k", "p", "n_v", "n_p"])
    got = scan.shift(df, "k", "p", ["v"], direction=-1, prefix="b_", chunk_rows=3)
    exp = df.withColumn("b_v", F.lag("v").over(w))
    _cmp(got, exp, ["k", "p", "b_v"])


def test_row_number(spark):
    df = _data(spark)
    got = scan.row_number(df, "k", ["p"], F.floor(F.col("p") / 13), "rn")
    exp = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("p")))
    _cmp(got, exp, ["k", "p", "rn"])


def test_multi_scan(spark):
    df = _data(spark, seed=4)
    got = scan.multi_scan(df, "k", "p", fill={"v": "f"}, nxt=["v"], prv=["v"], next_prefix="n_", prev_prefix="b_",
                          chunk_rows=4)
    w = Window.partitionBy("k").orderBy("p")
    exp = (df.withColumn("f", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("n_v", F.lead("v").over(w)).withColumn("b_v", F.lag("v").over(w)))
    _cmp(got, exp, ["k", "p", "f", "n_v", "b_v"])


def test_multi_scan_running(spark):
    df = _data(spark, seed=8)
    got = scan.multi_scan(df, "k", "p", running=[("v", "sum", "s", True), ("v", "max", "m", False)], chunk_rows=3)
    w = Window.partitionBy("k").orderBy("p")
    exp = (df.withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)))
           .withColumn("m", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    _cmp(got, exp, ["k", "p", "s", "m"])


def test_multi_scan_order_and_two_previous(spark):
    """No integer position: order columns and a chunk; rows are numbered in the same pass."""
    df = _data(spark, seed=5).withColumn("one", F.lit(1))
    got = scan.multi_scan(df, "k", "one", fill={"v": "f"}, nxt=["p"], prv=["p"], prv_two=True, order=["p"],
                          chunk=F.floor(F.col("p") / 9), running=[("one", "sum", "n", False)])
    w = Window.partitionBy("k").orderBy("p")
    exp = (df.withColumn("f", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("next_p", F.lead("p").over(w)).withColumn("prev_p", F.lag("p").over(w))
           .withColumn("prev_2_p", F.lag("p", 2).over(w)).withColumn("n", F.row_number().over(w)))
    key = lambda r: tuple((x is None, x) for x in r)
    cols = ["k", "p", "f", "next_p", "prev_p", "prev_2_p", "n"]
    assert sorted(map(tuple, got.select(cols).collect()), key=key) == sorted(map(tuple, exp.select(cols).collect()), key=key)


def test_nego_scanned_equals_the_operators(spark):
    from tests.tables import SF_SMALL
    from haggle.operators import bundle as B
    from haggle.operators import dialogue as D
    from haggle.sources import fixtures as X
    n = X.nego(spark, SF_SMALL)
    a = D.next_turn_lead(D.price_locf(n))
    b = X.nego_scanned(spark, SF_SMALL, lead=True)
    cols = ["conv_id", "turn_no", "speaker", "utterance", "price", "price_filled", "next_utterance", "next_intent"]
    assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))
    first = n.withColumns({"open_buyer": F.lit(None).cast("decimal(12,2)"), "open_seller": F.lit(None).cast("decimal(12,2)")})
    a = B.counterpart_state(first)
    b = X.nego_scanned(spark, SF_SMALL, counterpart=True)
    cols = ["conv_id", "turn_no", "buyer_last_price", "seller_last_price", "buyer_last_text", "seller_last_text"]
    assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))
