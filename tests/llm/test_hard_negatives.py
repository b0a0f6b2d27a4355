import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from haggle.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=400, d=12, seed=4):
    """Clustered vectors with the awkward cases: nulls, no finite number, ties, repeats, other lengths."""
    rng = random.Random(seed)
    centre = [[rng.uniform(-1, 1) for _ in range(d)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = centre[rng.randrange(6)]
        rows.append((i, [x + rng.gauss(0, 0.2) for x in c], rng.randrange(4)))
    for i in range(n, n + 60):  # one common vector under many ids
        rows.append((i, centre[0], rng.randrange(4)))
    rows += [(1001, None, 1), (1002, centre[1], None), (1003, [None] + centre[1][1:], 2), (1004, [math.nan] + centre[1][1:], 2),
             (1005, [math.inf] + centre[1][1:], 2), (None, centre[2], 1), (None, centre[2], 1), (1006, [], 3), (1007, centre[3][:5], 0),
             (20, rows[20][1], rows[20][2]), (20, centre[4], 2), (1008, centre[3] + [3.0], 1)]
    rng.shuffle(rows)
    return rows


def brute(rows, every, positives=5, negatives=5):
    import struct
    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    have = []
    for i, v, label in rows:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        have.append((i, [math.floor(256 * single(x)) for x in v], label))
    out = []
    anchors = {(i, tuple(v), label) for i, v, label in have if i is not None and i % every == 0}
    for i, v, label in anchors:
        dot = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, k) for j, w, k in have]
        pos = sorted(x[:3] for x, (j, _, k) in zip(dot, have) if k == label and j != i)[:positives]
        for p in pos:
            fits = sorted(x[:3] for x, (_, _, k) in zip(dot, have) if k != label and 80 * -p[0] <= 100 * -x[0] <= 100 * -p[0])
            out += [(i, None if p[1] else p[2], r + 1, None if x[1] else x[2], -p[0], -x[0]) for r, x in enumerate(fits[:negatives])]
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def mined(df, every, **more):
    return sorted(map(tuple, H.hard_negatives(df, F.col("vec_id") % every == 0, **more).collect()), key=key)


@pytest.mark.parametrize("block", [1024, 7])
def test_against_brute_force(spark, block):
    df = spark.createDataFrame(vectors(), SCHEMA).withColumns({c: F.lit("x") for c in ("id", "v", "anchor", "score", "slot", "rank")})
    want = sorted(brute(vectors(), 10), key=key)
    assert len(want) > 300
    assert mined(df.repartition(5), 10, block=block) == want


def test_wide_numbers_stay_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-30000, 30000) * 40 for _ in range(4)], i % 3) for i in range(60)]
    assert mined(spark.createDataFrame(rows, SCHEMA), 5) == sorted(brute(rows, 5), key=key)
    with pytest.raises(Exception, match="64 bits"):
        mined(spark.createDataFrame([(0, [1e30], 1), (1, [1e30], 1)], SCHEMA), 5)


def test_empty_and_lonely(spark):
    assert mined(spark.createDataFrame([], SCHEMA), 5) == []
    assert mined(spark.createDataFrame([(0, [1.0], 1), (3, [1.0], 2)], SCHEMA), 5) == []  # no positive
    assert mined(spark.createDataFrame([(None, [1.0], 1)], SCHEMA), 5) == []


def test_bounds_hold_and_skip_rows():
    """Every row outside the scored ones really lies outside the window, and near anchors save work."""
    import pyarrow as pa
    rng = np.random.default_rng(2)
    centre = rng.normal(0, 100, (8, 16))
    x = np.floor(centre[rng.integers(0, 8, 600)] + rng.normal(0, 4, (600, 16))).astype(np.int64)
    block = H.make_block(list(range(40)), ["a"] * 40, x[:40].tolist())
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(600)), pa.array(["a"] * 600), pa.array(x.tolist(), pa.list_(pa.int64()))],
                                       ["id", "label", "v"])
    rows = H.Rows(batch, block, pa.array(["a"]))
    top = {a: int(np.sort(x @ block.vectors[a])[-20]) for a in range(40)}
    scored = 0
    for a, where, score in H.overlapping(rows, block, lambda a: [(top[a], np.inf)]):
        exact = x @ block.vectors[a]
        assert np.array_equal(exact[where], score)
        assert set(np.flatnonzero(exact >= top[a])) <= set(where.tolist())
        scored += len(where)
    assert scored < 0.6 * 40 * 600


def test_spanning_tree_is_minimal():
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, (30, 6))
    order, parent, edge = H.spanning_tree(x)
    assert sorted(order) == list(range(30)) and all(parent[i] < i for i in range(1, 30))
    gaps = sorted((np.linalg.norm(x[i] - x[j]), i, j) for i in range(30) for j in range(i))
    root = list(range(30))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    total = 0
    for g, i, j in gaps:
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += g
    assert abs(edge.sum() - total) < 1e-3 and (edge[1:] >= [np.linalg.norm(x[order[i]] - x[order[parent[i]]]) for i in range(1, 30)]).all()
