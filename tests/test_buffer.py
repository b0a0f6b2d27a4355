"""The sample buffer and the metric store: whole appends, seeded batches, repeated writes."""
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from haggle.sources import buffer as B
from haggle.sources import io

SCHEMA = "conv long, cand int, state string, context string, action string, reward double"


def rows(first, n):
    return [(i, i % 3, f"state {i}", None if i % 5 == 0 else f"context {i}", "" if i % 7 == 0 else f"action {i}", i / 4) for i in range(first, first + n)]


def key(seed, row):
    return int(hashlib.md5(f"{seed}:{row[0]}:{row[1]}".encode()).hexdigest()[:8], 16)


def expected(data, seed, size):
    order = sorted(data, key=lambda r: (key(seed, r), r[0], r[1]))
    return {(r[0], r[1]): (i // size, i % size) for i, r in enumerate(order)}


def batches(buffer, size):
    return {(r.conv, r.cand): (r.batch_no, r.batch_pos) for r in buffer.batches(size, SCHEMA).collect()}


def test_batches_do_not_depend_on_appends_or_tasks(spark, tmp_path, monkeypatch):
    data = rows(0, 500)
    want = expected(data, 7, 32)
    monkeypatch.setattr(B, "RANGE_ROWS", 40)  # numbered over many ranges
    one = B.SampleBuffer(spark, f"{tmp_path}/one", ["conv", "cand"], seed=7)
    one.append(spark.createDataFrame(data, SCHEMA).coalesce(1), "all")
    two = B.SampleBuffer(spark, f"{tmp_path}/two", ["conv", "cand"], seed=7)
    two.append(spark.createDataFrame(data[300:], SCHEMA).repartition(5), "b")
    two.append(spark.createDataFrame(data[:300], SCHEMA).repartition(3), "a")
    assert batches(one, 32) == want and batches(two, 32) == want and batches(two, 32) == want
    assert batches(B.SampleBuffer(spark, f"{tmp_path}/two", ["conv", "cand"], seed=7), 32) == want  # another job's reader
    sizes = [r["count"] for r in two.batches(32, SCHEMA).groupBy("batch_no").count().orderBy("batch_no").collect()]
    assert sizes == [32] * 15 + [20]
    got = {tuple(r)[:6] for r in two.read().select(*spark.createDataFrame([], SCHEMA).columns).collect()}
    assert got == set(data)


def test_a_lost_append_leaves_nothing(spark, tmp_path, monkeypatch):
    buffer = B.SampleBuffer(spark, f"{tmp_path}/b", ["conv", "cand"])
    buffer.append(spark.createDataFrame(rows(0, 20), SCHEMA), "first")

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:  # rows are written, the manifest row isn't
        m.setattr(buffer, "_commit", lost)
        with pytest.raises(RuntimeError):
            buffer.append(spark.createDataFrame(rows(100, 30), SCHEMA), "second")
    assert len(batches(buffer, 8)) == 20
    assert buffer.append(spark.createDataFrame(rows(100, 30), SCHEMA), "second") == 30  # the rerun counts once
    assert buffer.append(spark.createDataFrame(rows(100, 30), SCHEMA), "second") == 30
    assert batches(buffer, 8) == expected(rows(0, 20) + rows(100, 30), 42, 8)


def test_clear_and_empty(spark, tmp_path):
    import os
    buffer = B.SampleBuffer(spark, f"{tmp_path}/b", ["conv", "cand"])
    with pytest.raises(ValueError):
        buffer.read()
    assert batches(buffer, 4) == {}
    assert buffer.append(spark.createDataFrame([], SCHEMA), "none") == 0
    buffer.append(spark.createDataFrame(rows(0, 9), SCHEMA), "a")
    buffer.clear()
    assert batches(buffer, 4) == {} and not os.path.exists(f"{tmp_path}/b/data/append=a")
    assert buffer.append(spark.createDataFrame(rows(50, 5), SCHEMA), "a") == 5  # names are free again
    assert batches(buffer, 4) == expected(rows(50, 5), 42, 4)


def test_repeated_and_null_keys(spark, tmp_path):
    buffer = B.SampleBuffer(spark, f"{tmp_path}/b", ["conv", "cand"])
    data = [(1, 0, "s", None, None, None)] * 3 + [(None, None, None, None, None, None)] * 2
    buffer.append(spark.createDataFrame(data, SCHEMA), "a")
    got = buffer.batches(2, SCHEMA).collect()
    assert sorted((r.batch_no, r.batch_pos) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]


def test_metric_store_is_idempotent(spark, tmp_path):
    path = f"{tmp_path}/metrics"
    schema = "run string, step long, name string, value double"
    first = [("r1", i, "loss", i / 2) for i in range(5)] + [("r1", 1, "kl", 0.5), ("7", 3, "loss", math.pi), (None, 1, "loss", 1.0), ("a/b=c", 2, "x y", None)]
    io.write_metrics(spark.createDataFrame(first, schema), path)
    io.write_metrics(spark.createDataFrame(first, schema), path)  # the job runs again
    read = lambda: sorted(map(tuple, io.read_metrics(spark, path).collect()), key=str)
    assert read() == sorted(first, key=str)
    again = [("r1", i, "loss", 9.0) for i in range(2)]  # a series is replaced, others stay
    io.write_metrics(spark.createDataFrame(again, schema), path)
    assert read() == sorted(again + [r for r in first if (r[0], r[2]) != ("r1", "loss")], key=str)
    only = io.read_metrics(spark, path).where("run = 'r1' and name = 'kl'")
    assert only.count() == 1 and "PartitionFilters: [isnotnull(run" in only._jdf.queryExecution().toString()
