"""Exact deduplication by two-pass Bloom filtering (operator 10).

Pass 1 builds a filter that remembers, for every bit, whether no, one or
several rows set it.  Pass 2 asks it for every row: only rows all of whose bits
were set several times can have an equal; they alone are shuffled, as (digest,
id), the rest pass straight through.  False positives only cost a shuffled row.

Scale.  A key sets its bits in one 64-bit word, so a map task sends one short
record per distinct word it touched; they are merged per segment of words, and
a hot digest is one record per task.  The finished filter has two bytes a row
and at most ``max_filter_bytes`` (a documented bound, so it may be broadcast);
past that size it only lets more unrepeated rows through to the shuffle.  The
group totals of the shuffled rows come from a partially aggregated sum, and the
few groups that hold over a thousandth of all rows are joined back by a
broadcast of at most a thousand totals, so no task receives a large group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

from haggle.llm.spark import BROADCAST_ROWS, checkpoint, packed

BITS_PER_KEY = 16
BITS_SET = 4
SEGMENT_WORDS = 1 << 14  # words merged together: 128 KiB a layer
MAX_FILTER_BYTES = 64 << 20
DIGEST_ROWS = 256
HEAVY_SHARE = 1000       # a group with over 1/1000 of the rows is heavy; there are fewer than 1000


@arrow_udf(BinaryType())  # a type object: workers import this module without a session
def text_digest(text: pa.Array) -> pa.Array:
    """SHA-256 of the text with A-Z lower-cased, in UTF-8; null counts as empty."""
    sha, out = hashlib.sha256, []
    for at in range(0, len(text), DIGEST_ROWS):  # so many texts are held as Python objects at once
        lowered = pc.ascii_lower(pc.fill_null(text.slice(at, DIGEST_ROWS), ""))
        out += [sha(v).digest() for v in lowered.cast(
            pa.large_binary() if pa.types.is_large_string(lowered.type) else pa.binary()).to_pylist()]
    return pa.array(out, pa.binary())


def _places(digests: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each digest's word and its mask of BITS_SET bits in that word."""
    raw = np.frombuffer(b"".join(digests.to_pylist()), np.uint8).reshape(-1, 32)
    numbers = raw[:, :16].copy().view(np.uint64)
    mask = np.zeros(len(raw), np.uint64)
    for i in range(BITS_SET):
        mask |= np.uint64(1) << ((numbers[:, 1] >> np.uint64(6 * i)) & np.uint64(63))
    return (numbers[:, 0] % np.uint64(words)).astype(np.int64), mask


def _merge(word: np.ndarray, once: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One record a word: bits set at least once, and bits set by more than one record or already often."""
    order = np.argsort(word, kind="stable")
    word, once, often = word[order], once[order], often[order]
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((first, [len(word)])))
    seen, twice = once[first].copy(), often[first].copy()
    for step in range(1, int(size.max()) if len(size) else 0):  # as many steps as records of the fullest word
        at = np.flatnonzero(size > step)
        more = first[at] + step
        twice[at] |= often[more] | (seen[at] & once[more])
        seen[at] |= once[more]
    return word[first], seen, twice


def repeat_filter(digests: DataFrame, rows: int, max_filter_bytes: int = MAX_FILTER_BYTES) -> np.ndarray:
    """64-bit words whose set bits were set by two rows or more.  digests: one binary column ``digest``."""
    words = max(1, min(rows * BITS_PER_KEY // 64 + 1, max_filter_bytes // 8))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None
        for batch in batches:
            if not batch.num_rows:
                continue
            word, mask = _places(batch.column("digest"), words)
            new = _merge_keys(word, mask)
            have = new if have is None else _merge(*(np.concatenate(x) for x in zip(have, new)))
            if len(have[0]) > 1 << 20:  # bounded memory: hand over and go on
                yield _records(*have)
                have = None
        if have is not None:
            yield _records(*have)

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, twice = np.zeros(SEGMENT_WORDS, np.uint64), np.zeros(SEGMENT_WORDS, np.uint64)
        for batch in batches:
            word, once, often = (batch.column(c).to_numpy() for c in ("word", "once", "often"))
            word, once, often = _merge(word % SEGMENT_WORDS, once.view(np.uint64), often.view(np.uint64))
            twice[word] |= often | (seen[word] & once)
            seen[word] |= once
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()),
                                          pa.array([twice.tobytes()], pa.binary())], ["segment", "bits"])

    records = digests.mapInArrow(partial, "segment long, word long, once long, often long")
    segments = records.groupBy("segment").applyInArrow(merged, "segment long, bits binary")
    out = np.zeros(-(-words // SEGMENT_WORDS) * SEGMENT_WORDS, np.uint64)
    for row in segments.toLocalIterator():  # the filter itself, max_filter_bytes at most
        out[row.segment * SEGMENT_WORDS:][:SEGMENT_WORDS] = np.frombuffer(row.bits, np.uint64)
    return out[:words]


def _merge_keys(word: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records of one batch's keys; equal keys become one, with its bits set often."""
    order = np.lexsort((mask, word))
    word, mask = word[order], mask[order]
    first = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (mask[1:] != mask[:-1]))))
    size = np.diff(np.concatenate((first, [len(word)])))
    return _merge(word[first], mask[first], np.where(size > 1, mask[first], np.uint64(0)))


def _records(word: np.ndarray, once: np.ndarray, often: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(word // SEGMENT_WORDS, pa.int64()), pa.array(word, pa.int64()),
         pa.array(once.view(np.int64)), pa.array(often.view(np.int64))], ["segment", "word", "once", "often"])


def maybe_repeated(digest: Column, bits: np.ndarray, spark) -> Column:
    """False for rows that certainly have no equal."""
    shared = spark.sparkContext.broadcast(bits)

    @arrow_udf("boolean")
    def test(digests: pa.Array) -> pa.Array:
        if not len(digests):
            return pa.array([], pa.bool_())
        word, mask = _places(digests, len(shared.value))
        return pa.array((shared.value[word] & mask) == mask)

    return test(digest)


def _flagged(docs: DataFrame, text: Column, *columns: Column, max_filter_bytes: int) -> tuple[DataFrame, int]:
    """columns plus digest and maybe (may have an equal), and the number of rows."""
    rows = docs.count()
    bits = repeat_filter(docs.select(text_digest(text).alias("digest")), rows, max_filter_bytes)
    digested = docs.select(*columns, text_digest(text).alias("digest"))
    return digested.withColumn("maybe", maybe_repeated(F.col("digest"), bits, docs.sparkSession)), rows


def _with_totals(rows: DataFrame, total: int) -> DataFrame:
    """rows (digest, id, ...) plus keep_id and group_size of their digest."""
    groups = checkpoint(rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")))
    heavy = F.broadcast(groups.where(F.col("group_size") * HEAVY_SHARE > total))  # under HEAVY_SHARE rows
    light = groups.where(F.col("group_size") * HEAVY_SHARE <= total)
    return rows.join(heavy, "digest").unionByName(rows.join(heavy, "digest", "left_anti").join(light, "digest"))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after A-Z are lower-cased; the row with the
    largest doc_id of each group stays.  Null text counts as empty.  A null
    doc_id is smaller than any other; a group with null ids only keeps one row
    (keep_id null).  Of rows that repeat both doc_id and text exactly one stays.
    Other columns are ignored, whatever their names; an empty table gives an
    empty result."""
    flagged, total = _flagged(docs, F.col(text), F.col(doc_id).cast("long").alias("id"), max_filter_bytes=max_filter_bytes)
    slim = checkpoint(flagged.select("id", "digest", "maybe"))
    alone = slim.where("not maybe").select(
        "id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"))
    shared = _with_totals(slim.where("maybe").select("id", "digest"), total)
    # rows with the kept id: one, save where a row is repeated with its id
    first = F.row_number().over(Window.partitionBy("digest").orderBy("digest")) == 1
    winners = shared.where("id <=> keep_id").withColumn("kept", first)
    losers = shared.where("not (id <=> keep_id)").withColumn("kept", F.lit(False))
    return alone.unionByName(winners).unionByName(losers).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                      max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """docs without the rows that an equal text with a larger doc_id (or, at a
    tie, one other row) replaces; all columns are kept as they are.

    Null text counts as empty, a null doc_id is smaller than any other; of rows that
    repeat doc_id and text one stays; an empty table gives an empty one.  Other columns may have any name.

    Ids and digests are written once; the filter, the groups and the ids that go
    come from that table.  Rows meet the ids that go in a broadcast, if these
    are at most BROADCAST_ROWS; otherwise rows that may have an equal are shuffled, and
    those without one never are."""
    spark = docs.sparkSession
    slim = checkpoint(docs.select(F.col(doc_id).alias("id"), text_digest(F.col(text)).alias("digest")))
    total = slim.count()
    bits = repeat_filter(slim.select("digest"), total, max_filter_bytes)
    some = slim.where(maybe_repeated(F.col("digest"), bits, spark))
    rows = checkpoint(some.groupBy("digest", "id").agg(F.count("*").alias("times")))
    shared = _with_totals(rows, total)
    marks = checkpoint(shared.where("not (id <=> keep_id) or times > 1").select(
        F.col("digest").alias("of"), F.col("id").alias("mark"), F.expr("id <=> keep_id").alias("again")))
    digested = docs.select(packed(docs), F.col(doc_id).alias("id"), text_digest(F.col(text)).alias("digest"))
    on = (F.col("digest") == F.col("of")) & F.col("id").eqNullSafe(F.col("mark"))
    if marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        kept = digested.join(F.broadcast(marks), on, "left_anti").select("row.*")
    else:
        flagged = digested.withColumn("maybe", maybe_repeated(F.col("digest"), bits, spark))
        kept = flagged.where("not maybe").select("row.*").unionByName(
            flagged.where("maybe").join(marks, on, "left_anti").select("row.*"))
    again = marks.where("again")
    if again.limit(1).count():  # the row that stays is repeated as a whole: the first of each
        one = digested.join(again, on).groupBy("digest", "id").agg(F.first("row").alias("row"))
        kept = kept.unionByName(one.select("row.*"))
    return kept
