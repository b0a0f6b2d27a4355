"""Near-duplicate documents by circulant MinHash (operator 1).

Text -> distinct five-word shingles -> circulant signature -> bands -> exact
Jaccard test -> connected components.

Scale.  Documents with equal shingle sets become one class first, so exact
copies never meet in a bucket.  One row per class and band is shuffled (a key
and an id), never text.  In a bucket every member is first paired with the
bucket's least member only; after those links are joined to components, only
buckets that still hold several components are compared further, first each
member's likeliest pair, then all pairs of what is still apart, in blocks of
bounded size, and a pair leaves its block once (in the first band it shares)
and only if its 1024 signature coordinates don't rule out the threshold.  Of the
bands' least members a class first meets the one it shares most buckets with;
of its pairs with the others, only the likeliest between two components that are
still apart are tested.  So a group of thousands of copies gives
about as many pairs as members, and no link that could join two components is
left untested.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haggle.llm.circulant import signature
from haggle.llm.components import components
from haggle.llm.spark import checkpoint, semi_join
from haggle.llm.words import as_bytes, shingle_sets, slices

ROWS = 5            # coordinates a band
BANDS = 56          # a pair at 0.75 shares no band with probability (1 - 0.75^5)^56 < 3e-7
COORDINATES = 1024  # of which the first ROWS * BANDS make the bands; all estimate similarity
WIDE = ROWS * BANDS                             # kept with eight bits, the others with four
SKETCH_BYTES = WIDE + (COORDINATES - WIDE) // 2
CHANCE = 1 / 16     # two different values agree in their low four bits
BLOCK = 512         # members of a bucket compared at once
SIGMAS = 4.5        # an estimate this many standard errors under the threshold rules a pair out


def floor_estimate(threshold: float) -> float:
    """The share of low four bits in agreement that a pair at the threshold
    reaches, but for SIGMAS standard errors."""
    agree = threshold + (1 - threshold) * CHANCE
    return agree - SIGMAS * (agree * (1 - agree) / COORDINATES) ** 0.5


def sketch(coordinates: np.ndarray) -> bytes:
    """Low bytes of the band coordinates, then the others' low four bits, two a byte."""
    rest = (coordinates[WIDE:] & 15).astype(np.uint8)
    return (coordinates[:WIDE] & 255).astype(np.uint8).tobytes() + (rest[::2] | rest[1::2] << 4).tobytes()


def agreement(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of coordinates whose low four bits agree, row by row."""
    apart = left ^ right
    low = ((apart & 15) == 0).sum(axis=-1)
    return (low + ((apart[..., WIDE:] >> 4) == 0).sum(axis=-1)) / COORDINATES


def shingle_table(docs: DataFrame, width: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, n_shingles, set_key, sketch): set_key digests the whole set,
    sketch keeps the low bits of each coordinate; both null for an empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, keys, sketches = [], [], []
                for s in shingle_sets(as_bytes(part.column("text")), width):
                    n.append(len(s))
                    keys.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sketches.append(sketch(signature(s, COORDINATES)) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                     pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "set_key", "sketch"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, set_key binary, sketch binary")


def full_sets(docs: DataFrame, ids: DataFrame, width: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, shingles): whole shingle sets, as packed 64-bit hashes, of the documents named in ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [s.tobytes() for s in shingle_sets(as_bytes(part.column("text")), width)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())],
                                                 ["doc_id", "shingles"])

    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return semi_join(named, ids, "doc_id").mapInArrow(run, "doc_id long, shingles binary")


def _likeness(pairs: DataFrame) -> DataFrame:
    """(a, b, x, y, likeness) from the two sketches of each pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH_BYTES)
                           for c in ("sketch_a", "sketch_b"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in "abxy"), pa.array(agreement(left, right), pa.float64())], [*"abxy", "likeness"])

    return pairs.select(*"abxy", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long, x long, y long, likeness double")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b, x, y): the pairs whose ends lie in different components, x < y."""
    a = found.select(F.col("node").alias("a"), F.col("component").alias("x"))
    b = found.select(F.col("node").alias("b"), F.col("component").alias("y"))
    named = pairs.join(a, "a", "left").join(b, "b", "left").select(
        "a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    return named.where("x <> y").select("a", "b", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def _likeliest(pairs: DataFrame, sketches: DataFrame, floor: float) -> DataFrame:
    """(a, b): of the pairs (a, b, x, y) of each x and y the likeliest, if its likeness reaches floor."""
    a = sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sketch_a"))
    b = sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sketch_b"))
    return _likeness(pairs.join(b, "b").join(a, "a")).where(F.col("likeness") >= floor).groupBy("x", "y").agg(
        F.max_by(F.struct("a", "b"), F.struct("likeness", "a", "b")).alias("pair")).select("pair.a", "pair.b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(
                pa.array(keep, pa.bool_()))

    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b").mapInArrow(
        run, "a long, b long")


def _cross_pairs(members: DataFrame, floor: float, nearest: bool = False) -> DataFrame:
    """Distinct pairs of different components in a bucket whose likeness
    reaches floor, or with ``nearest`` only the likeliest of each member in a
    block.  members: (key, size, rep, component, sketch)."""
    def grouped(some: DataFrame) -> DataFrame:
        return some.withColumn("block", F.expr(f"pmod(xxhash64(rep, 11), ceil(size / {BLOCK}))")).groupBy(
            "key", "block").agg(F.collect_list(F.struct("rep", "component", "sketch")).alias("rows"))

    def unpack(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sketches = np.frombuffer(b"".join(rows.field("sketch").to_pylist()), np.uint8)
        return (rows.field("rep").to_numpy(), rows.field("component").to_numpy(),
                sketches.reshape(-1, SKETCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lefts, rights, same = batch.column("rows"), batch.column("others"), batch.column("same").to_pylist()
            found_a, found_b = [], []
            for i in range(batch.num_rows):
                ids, comps, sketches = unpack(lefts[i].values)
                ids2, comps2, sketches2 = (ids, comps, sketches) if same[i] else unpack(rights[i].values)
                key_band = _shared_band(sketches, sketches2, batch.column("key")[i].as_py())
                for j in range(len(ids)):
                    begin = j + 1 if same[i] else 0
                    others = np.flatnonzero(comps2[begin:] != comps[j]) + begin
                    alike = agreement(sketches2[others], sketches[j])
                    if nearest and len(others):
                        others, alike = others[[alike.argmax()]], alike[[alike.argmax()]]
                    others = others[alike >= floor]
                    if len(others):
                        shared = (sketches2[others, :WIDE] == sketches[j, :WIDE]).reshape(-1, BANDS, ROWS).all(axis=2)
                        others = others[shared.any(axis=1) & (shared.argmax(axis=1) == key_band)]
                        found_a.append(np.minimum(ids[j], ids2[others]))
                        found_b.append(np.maximum(ids[j], ids2[others]))
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a), pa.int64()),
                                                  pa.array(np.concatenate(found_b), pa.int64())], ["a", "b"])

    # a bucket of one block, as nearly all are, is compared where it is grouped; only blocks of larger ones are joined
    columns = ["key", "rows", "others", "same"]
    pairs = grouped(members.where(f"size <= {BLOCK}")).withColumn("others", F.expr("slice(rows, 1, 0)")).withColumn(
        "same", F.lit(True)).select(*columns)
    large = members.where(f"size > {BLOCK}")
    if not large.isEmpty():
        blocks = checkpoint(grouped(large))
        pairs = pairs.unionAll(blocks.join(blocks.select("key", F.col("block").alias("other"), F.col("rows").alias(
            "others")), "key").where("block <= other").withColumn("same", F.expr("block = other")).select(*columns))
    return pairs.mapInArrow(run, "a long, b long")


def _shared_band(left: np.ndarray, right: np.ndarray, key: int) -> int:
    """The bucket's band: its number lies in the key's lowest six bits."""
    return int(key) & 63


def band_rows(classes: DataFrame) -> DataFrame:
    """(key, rep) for each band of each class; the key's lowest six bits are the band's number."""
    return classes.select("rep", F.explode(F.expr(
        f"transform(sequence(0, {BANDS - 1}), i -> "
        f"(xxhash64(i, substring(sketch, i * {ROWS} + 1, {ROWS})) & ~63L) | i)")).alias("key"))


def near_duplicates(docs: DataFrame, threshold: float = 0.75, width: int = 5,
                    text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Linked documents have a Jaccard similarity of at least ``threshold`` over
    distinct ``width``-word shingles; component_id is the least doc_id that
    links reach, kept says doc_id is that.

    * null or wordless text: n_shingles 0, linked with nothing;
    * fewer words than ``width``: the whole sequence is the one shingle;
    * null doc_id: not linked (it has no name to report), component_id null, kept;
    * rows that repeat a doc_id are one document with the links of all of them;
    * other columns, whatever their names, are neither read nor returned;
    * an empty table gives an empty result.
    """
    percent, floor = round(threshold * 100), floor_estimate(threshold)
    table = checkpoint(shingle_table(docs, width, text, doc_id))
    classes = checkpoint(table.where("doc_id is not null and n_shingles > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")))
    buckets = checkpoint(band_rows(classes).groupBy("key").agg(
        F.min("rep").alias("centre"), F.count("*").alias("size")).where("size > 1"))
    members = checkpoint(band_rows(classes).join(buckets, "key"))
    ids = checkpoint(members.select(F.col("rep").alias("doc_id")).distinct())
    sets = checkpoint(full_sets(docs, ids, width, text, doc_id).groupBy("doc_id", F.xxhash64("shingles").alias("h"))
                      .agg(F.first("shingles").alias("shingles")).select("doc_id", "shingles"))
    sketches = checkpoint(classes.select(F.col("rep").alias("doc_id"), "sketch").join(ids, "doc_id"))

    stars = checkpoint(members.where("rep <> centre").groupBy(F.col("centre").alias("a"), F.col("rep").alias("b")).agg(
        F.count("*").alias("n")))
    nearest = stars.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    links = checkpoint(verified(_likeliest(nearest.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")),
                                           sketches, floor), sets, percent))
    others = checkpoint(_apart(stars, components(links)))
    links = links.unionAll(checkpoint(verified(_likeliest(others, sketches, floor), sets, percent)))

    for nearest in (True, False):  # what the likeliest pairs join needs no further comparing
        named = checkpoint(members.join(components(links).withColumnRenamed("node", "rep"), "rep", "left").select(
            "key", "size", "rep", F.coalesce("component", "rep").alias("component")))
        open_keys = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where(
            "x <> y").select("key")
        rest = named.join(checkpoint(open_keys), "key")
        pairs = _cross_pairs(rest.join(sketches.withColumnRenamed("doc_id", "rep"), "rep"), floor, nearest)
        links = links.unionAll(checkpoint(verified(pairs, sets, percent)))
        members = rest.select("key", "size", "rep")
    # rows that repeat a doc_id with another text tie their classes together
    repeats = checkpoint(table.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(
        F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x <> y").select("doc_id"))
    if not repeats.isEmpty():
        ties = table.where("n_shingles > 0").join(repeats, "doc_id").join(
            classes.select("set_key", "rep"), "set_key").where("doc_id <> rep").distinct()
        links = links.unionAll(ties.select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b")))
    joined = components(links)

    named = checkpoint(classes.select("set_key", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
                       .select("set_key", F.coalesce("component", "rep").alias("component")))
    # each row takes its class's component; a hot class is split by the skew join
    out = table.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    return out.select(
        "doc_id", "n_shingles",
        F.expr("case when doc_id is null then null else coalesce(component, doc_id) end").alias("component_id"),
        F.expr("doc_id is null or component is null or doc_id = component").alias("kept"))
