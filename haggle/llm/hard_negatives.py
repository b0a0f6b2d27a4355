"""Hard negatives by anchor spanning-tree bounds (operator 12).

Anchors are held against all rows in blocks.  The anchors of a block form a
minimum spanning tree by distance.  For a row c, an anchor and its parent in
the tree, |score(anchor, c) - score(parent, c)| <= |anchor - parent| * |c|: the
parent's score (or its own bounds, where it wasn't computed) plus and minus
edge times norm bounds the anchor's.  Only rows whose bounds overlap a window
that is asked for are scored, exactly, in integers.

For each block two passes read the rows: the first finds the positives (its window
is open upwards from the worst of the best so far), the second the
negatives within the window that each positive sets.

Scale.  Rows are written once as integers and never shuffled; a task keeps the
best few per anchor (or anchor and positive), and only these are merged.  A
block has at most ``block`` anchors, whatever the input, and is all that the
driver holds or broadcasts; each block's rows are written before the next one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haggle.llm.spark import shared_path

BLOCK = 1024            # anchors at once: their vectors and tree are broadcast
ROWS = 4096             # rows scored at once: a task holds two numbers per anchor and row
EXACT = 1 << 53         # integers a double holds exactly

FOUND_SCHEMA = "anchor int, slot int, score long, id long"
RESULT_SCHEMA = ("anchor_id long, positive_id long, rank int, negative_id long, "
                 "positive_score long, negative_score long")


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as whole numbers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(label: Column, vector: Column) -> Column:
    """True for rows with a label and a vector of finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                      & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(finite, F.lit(False))


# -- blocks of anchors

@dataclass
class Block:
    """Anchors in an order that has every parent before its children."""
    ids: list[int]
    labels: list[str]
    vectors: np.ndarray  # integers, anchors x dimensions
    parent: np.ndarray   # of each anchor but the first
    edge: np.ndarray     # distance to the parent, rounded up


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent by place in that order, edge) of a minimum spanning tree."""
    n, x = len(vectors), vectors.astype(np.float64)
    squares = (x * x).sum(axis=1)
    order, parent, edge = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    near, at, left = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    last = 0
    for place in range(n):
        if place:
            last = int(np.argmin(np.where(left, near, np.inf)))
            parent[place] = at[last]
            edge[place] = np.sqrt(((x[last] - x[order[at[last]]]) ** 2).sum()) * (1 + 1e-9)
        order[place], left[last] = last, False
        gap = np.maximum(squares + squares[last] - 2 * (x @ x[last]), 0)
        closer = left & (gap < near)
        near[closer], at[closer] = gap[closer], place
    return order, parent, edge


def padded(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def make_block(ids: list[int], labels: list[str], vectors: list[list[int]]) -> Block:
    x = padded(vectors, max(map(len, vectors)))
    order, parent, edge = spanning_tree(x)
    return Block([ids[i] for i in order], [labels[i] for i in order], x[order], parent, edge)


# -- scoring

def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Rows x width; components beyond width meet nothing, missing ones are 0."""
    offsets = vectors.offsets.to_numpy()
    sizes, flat = np.diff(offsets), vectors.values.to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat[offsets[0]: offsets[-1]].reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    for i, (a, n) in enumerate(zip(offsets[:-1].tolist(), np.minimum(sizes, width).tolist())):
        out[i, :n] = flat[a: a + n]
    return out


class Rows:
    """A slice of the rows, ready to be scored against a block."""

    def __init__(self, batch: pa.RecordBatch, block: Block, labels: pa.Array):
        self.x = _matrix(batch.column("v"), block.vectors.shape[1])
        self.ids = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False)
        self.nameless = batch.column("id").is_null().to_numpy(zero_copy_only=False)
        self.label = pc.fill_null(pc.index_in(batch.column("label"), labels), -1).to_numpy(zero_copy_only=False)
        high = int(np.abs(self.x).max(initial=0)) * int(np.abs(block.vectors).max(initial=0)) * block.vectors.shape[1]
        if high >= 1 << 63:
            raise OverflowError("inner products of these vectors may pass 64 bits")
        self.kind = np.float64 if high < EXACT else np.int64
        self.x = self.x.astype(self.kind)
        self.norm = np.sqrt((self.x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)

    def scores(self, anchor: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
        x = self.x if rows is None else self.x[rows]
        return (x @ anchor.astype(self.kind)).astype(np.int64)


def overlapping(rows: Rows, block: Block, windows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows, their exact scores) for each anchor: of the rows whose bounds
    overlap one of ``windows(anchor)``, pairs of a least and a highest score."""
    n = len(rows.x)
    least, most = np.empty((len(block.ids), n)), np.empty((len(block.ids), n))
    for a in range(len(block.ids)):
        if a:
            slack = block.edge[a] * rows.norm + 1.0  # scores are whole numbers
            np.subtract(least[block.parent[a]], slack, out=least[a])
            np.add(most[block.parent[a]], slack, out=most[a])
            asked = np.zeros(n, bool)
            for low, high in windows(a):
                asked |= (most[a] >= low) & (least[a] <= high)
            where = np.flatnonzero(asked)
        else:
            where = np.arange(n)
        found = rows.scores(block.vectors[a], None if len(where) == n else where)
        least[a, where] = most[a, where] = found
        yield a, where, found


class Best:
    """The first few rows by score (descending) and id (null last) of one search."""

    def __init__(self, size: int):
        self.size = size
        self.score, self.ids, self.nameless = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def floor(self) -> float:
        """Rows under this score can't get in."""
        return self.score[-1] if len(self.score) == self.size else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        score, ids, nameless = (np.concatenate(x) for x in ((self.score, score), (self.ids, ids), (self.nameless, nameless)))
        first = np.lexsort((ids, nameless, -score))[: self.size]
        self.score, self.ids, self.nameless = score[first], ids[first], nameless[first]


def _found(best: dict[tuple[int, int], Best]) -> pa.RecordBatch:
    keys = np.array([k for k, b in best.items() for _ in b.score], np.int32).reshape(-1, 2)
    join = lambda kind, parts: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
    ids, nameless = join(np.int64, [b.ids for b in best.values()]), join(bool, [b.nameless for b in best.values()])
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(join(np.int64, [b.score for b in best.values()])),
         pa.array(ids, mask=nameless)], ["anchor", "slot", "score", "id"])


def _search(table: DataFrame, block: Block, size: int, windows: dict[int, list[tuple[int, int]]] | None) -> DataFrame:
    """The first ``size`` rows per anchor and window: those of another label with
    a score in the window, or without windows those of the anchor's label."""
    labels = sorted(set(block.labels))
    shared = table.sparkSession.sparkContext.broadcast((block, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, windows = shared.value
        names, code = pa.array(labels, pa.string()), {x: i for i, x in enumerate(labels)}
        slots = {a: [(-np.inf, np.inf)] for a in range(len(block.ids))} if windows is None else windows
        best = {(a, s): Best(size) for a, some in slots.items() for s in range(len(some))}

        def open_windows(a):
            return [(max(low, best[a, s].floor), high) for s, (low, high) in enumerate(slots.get(a, ()))]

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = Rows(batch.slice(at, ROWS), block, names)
                for a, where, score in overlapping(rows, block, open_windows):
                    same = rows.label[where] == code[block.labels[a]]
                    if windows is None:
                        other = (rows.ids[where] != block.ids[a]) | rows.nameless[where]
                    for s, (low, high) in enumerate(open_windows(a)):
                        fits = (score >= low) & (score <= high) & (same & other if windows is None else ~same)
                        if fits.any():
                            best[a, s].add(score[fits], rows.ids[where][fits], rows.nameless[where][fits])
        yield _found(best)

    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return (table.mapInArrow(run, FOUND_SCHEMA)
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size))


# -- the operator

def hard_negatives(rows: DataFrame, anchor: Column, row_id: str = "vec_id", vector: str = "embedding",
                   label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   scale: int = 256, block: int = BLOCK) -> DataFrame:
    """Per anchor (rows where ``anchor`` holds) and positive (its first rows of the
    same label by integer inner product of the quantised vectors): the first
    rows of other labels whose score lies between low and high hundredths of the
    positive's.  Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    Higher scores come first, ties by smaller id, a null id after all others.
    Rows with a null label or vector, or with a null or non-finite component,
    take no part; a row with a null id is no anchor.  Of vectors of different length the
    missing components count as 0.  A row is no positive of an anchor with
    its own id; rows repeated with another id, or with a null one, are rows of
    their own; anchors repeated with id, label and vector count once.  An anchor
    without positives, or a window without rows, gives no row, and so does an empty table.
    Other columns are ignored, whatever their names.  Vectors whose products may
    pass 64 bits raise OverflowError."""
    spark = rows.sparkSession
    path = shared_path(spark, "hard-negatives")
    kept = rows.where(usable(F.col(label), F.col(vector)))
    (kept.select(F.col(row_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
                 quantised(F.col(vector), scale).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
     .write.parquet(f"{path}/rows"))
    table = spark.read.parquet(f"{path}/rows")
    anchors = table.where("anchor and id is not null").select("id", "label", "v").dropDuplicates()
    few = max(1, -(-anchors.count() // block))
    anchors.repartitionByRange(few, "label", "id").sortWithinPartitions("label", "id").write.parquet(f"{path}/anchors")
    table = table.select("id", "label", "v")
    held, done = [], 0
    for row in spark.read.parquet(f"{path}/anchors").toLocalIterator():  # a partition, about a block, at a time
        held.append(row)
        if len(held) == block:
            _mine_block(table, held, positives, negatives, low, high, f"{path}/found/block={done}")
            held, done = [], done + 1
    if held or not done:
        _mine_block(table, held, positives, negatives, low, high, f"{path}/found/block={done}")
    return spark.read.schema(RESULT_SCHEMA).parquet(f"{path}/found").select(*[c.split()[0] for c in RESULT_SCHEMA.split(", ")])


def _mine_block(table: DataFrame, anchors: list, positives: int, negatives: int, low: int, high: int, out: str) -> None:
    """Write the result of one block of anchors."""
    spark = table.sparkSession
    if not anchors:
        spark.createDataFrame([], RESULT_SCHEMA).write.parquet(out)
        return
    block = make_block([r.id for r in anchors], [r.label for r in anchors], [r.v for r in anchors])
    found = _search(table, block, positives, None).orderBy("anchor", "rank").collect()  # positives x block rows at most
    windows: dict[int, list[tuple[int, int]]] = {}
    named = []
    for r in found:
        slots = windows.setdefault(r.anchor, [])
        named.append((r.anchor, len(slots), block.ids[r.anchor], r.id, r.score))
        slots.append((-(-low * r.score // 100), high * r.score // 100))
    pairs = spark.createDataFrame(named, "anchor int, slot int, anchor_id long, positive_id long, positive_score long")
    (_search(table, block, negatives, windows).join(F.broadcast(pairs), ["anchor", "slot"])
     .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
             "positive_score", F.col("score").alias("negative_score")).write.parquet(out))
