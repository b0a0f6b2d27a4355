"""Evaluation aggregates against plain-Python loops."""
import random

from haggle.operators import evaluate as V


def py_early_stop(losses, patience=5, start=9999.0):
    best, pat = start, patience
    for e, l in enumerate(losses, start=1):
        if l < best:
            best, pat = l, patience
        else:
            pat -= 1
            if pat < 0:
                return e
    return None


def test_early_stop(spark):
    rnd = random.Random(11)
    runs = {r: [rnd.choice([rnd.random() * 10, 5.0, 9999.0, 10000.0]) for _ in range(rnd.randint(1, 30))]
            for r in range(150)}
    runs[900] = [1.0] + [2.0] * 6            # six straight misses -> stops at epoch 7
    runs[901] = [10000.0] * 6                # first loss >= 9999 is a miss
    rows = [(r, e, l) for r, ls in runs.items() for e, l in enumerate(ls, start=1)]
    df = spark.createDataFrame(rows, "run long, epoch int, loss double")
    got = {r.run: r.stop_epoch for r in V.early_stop(df).collect()}
    for r, ls in runs.items():
        assert got[r] == py_early_stop(ls), (r, ls)
    assert got[900] == 7 and got[901] == 6
    assert {r.run: r.stop_epoch for r in V.early_stop(df, dense=True).collect()} == got


def test_early_stop_counts_rows_not_epochs(spark):
    df = spark.createDataFrame([(1, 10, 1.0), (1, 20, 2.0), (1, 30, 2.0)], "run long, epoch int, loss double")
    assert V.early_stop(df).first().stop_epoch is None
    rows = [(1, 10 * e, 1.0 if e == 1 else 2.0) for e in range(1, 9)]
    assert V.early_stop(spark.createDataFrame(rows, "run long, epoch int, loss double")).first().stop_epoch == 70


def test_sample_log(spark):
    df = spark.createDataFrame([(1, 1, 0.5, True, "s"), (1, 2, 0.25, False, "t")],
                               "conv_id long, turn_no int, reward double, human boolean, state string")
    rows = {r.turn_no: r for r in V.sample_log(df, payload=("state",)).collect()}
    assert (rows[1].reward, rows[1].human_response, rows[1].state) == (10.0, True, "s")
    assert (rows[2].reward, rows[2].human_response, rows[2].state) == (0.25, False, "t")
    assert rows[1].shuffle_key != rows[2].shuffle_key


def test_class_report_and_accuracy(spark):
    rows = [(0, 0, True), (0, 1, True), (1, 1, True), (1, 1, True), (0, 2, True), (1, 0, False)]
    df = spark.createDataFrame(rows, "actual int, predicted int, scored boolean")
    rep = {r.label: r for r in V.class_report(df.filter("scored")).collect()}
    assert set(rep) == {0, 1, 2}                           # class 2 only predicted
    assert rep[2].support == 0 and rep[2].precision == 0.0 and rep[2].f1 == 0.0
    assert abs(rep[1].precision - 2 / 3) < 1e-12 and rep[1].recall == 1.0
    assert all(0.0 <= r.f1 <= 1.0 for r in rep.values())
    acc = V.accuracy(df).collect()[0]
    assert abs(acc.acc_scored - 3 / 5) < 1e-12 and abs(acc.acc_reference - 3 / 6) < 1e-12


def test_ppo_metrics_and_best(spark):
    rows = [(1, 0.0, 0.1, 2.0), (1, 0.0, -0.5, 1.0), (2, -1.0, -1.0, 3.0)]
    df = spark.createDataFrame(rows, "buffer long, old_logp double, new_logp double, reward double")
    m = {r.buffer: r for r in V.ppo_metrics(df, by="buffer").collect()}
    assert m[2].approx_kl == 0.0 and m[2].clip_frac == 0.0 and m[2].mean_reward == 3.0
    assert m[1].clip_frac == 0.5
    b = V.best_checkpoint(spark.createDataFrame([(1, 1, 3.0), (1, 2, 2.0), (1, 3, 2.0)], "run long, step int, value double"))
    assert b.collect()[0].best_step == 2
