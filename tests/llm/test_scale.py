"""Large groups and many shuffle partitions."""
import random
import time

import numpy as np
from pyspark.sql import functions as F

import haggle.llm.mixing as mixing
import haggle.llm.near_dedup as nd
from haggle.llm.spark import checkpoint, written


def test_first_each_member_meets_its_likeliest(spark):
    """Twenty members alike in one bucket: a pair a member at most, not a pair for every two of them."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, nd.SKETCH_BYTES, dtype=np.uint8)
    rows = []
    for i in range(20):
        own = base.copy()
        own[rng.integers(nd.ROWS, nd.SKETCH_BYTES, 30)] ^= 5
        rows.append((0, 20, i, i, bytearray(own.tobytes())))
    members = spark.createDataFrame(rows, "key long, size long, rep long, component long, sketch binary")
    near = nd._cross_pairs(members, nd.floor_estimate(0.75), True).count()
    assert 0 < near <= 20 < nd._cross_pairs(members, nd.floor_estimate(0.75)).count() == 190


def test_joined_pairs_are_not_tested_again(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4)], "a long, b long")
    found = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "node long, component long")
    assert sorted(map(tuple, nd._apart(pairs, found).collect())) == [(1, 3, 1, 3), (2, 3, 1, 3)]


def test_tables_of_few_patterns_take_few_tasks(spark, monkeypatch):
    sizes, kept = [], mixing.checkpoint

    def counted(df):
        out = kept(df)
        sizes.append(out.rdd.getNumPartitions())
        return out

    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "w " * rng.randrange(1, 30), rng.choice("abc")) for i in range(200)],
                                 "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "checkpoint", counted)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        taken = mixing.mix_report(docs).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert taken == 200 and sum(n > mixing.TINY_TASKS for n in sizes) <= 3, sizes  # patterns and units are dealt out


def test_steps_leave_no_shuffle_files(spark):
    """Once a step's rows are in the shared folder, its shuffle files are gone, whenever the driver collects garbage."""
    def blocks():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in found.split("\n") if "shuffle_" in f}

    for step in (checkpoint, lambda df: written(df)[0]):
        before = blocks()
        counts = spark.range(500).groupBy((F.col("id") % 50).alias("k")).count()
        out = step(counts)
        start = time.time()
        while blocks() - before and time.time() < start + 10:
            time.sleep(0.2)
        assert not blocks() - before
        assert out.count() == counts.count() == 50  # either can still be read


def test_buckets_of_one_block_are_not_joined(spark, monkeypatch):
    """Only buckets larger than a block are written and joined block by block."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, nd.SKETCH_BYTES, dtype=np.uint8).tobytes()
    members = spark.createDataFrame([(key, size, 100 * key + i, 100 * key + i, bytearray(base))
                                     for key, size in ((0, 3), (64, 9)) for i in range(size)],
                                    "key long, size long, rep long, component long, sketch binary")
    sizes, kept = [], nd.checkpoint
    monkeypatch.setattr(nd, "checkpoint", lambda df: sizes.append(df.groupBy("key").count().count()) or kept(df))
    monkeypatch.setattr(nd, "BLOCK", 4)
    assert nd._cross_pairs(members, nd.floor_estimate(0.75)).count() == 3 + 36
    assert sizes == [1]
    monkeypatch.setattr(nd, "BLOCK", 9)
    assert nd._cross_pairs(members, nd.floor_estimate(0.75)).count() == 3 + 36
    assert sizes == [1]
