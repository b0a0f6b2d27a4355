"""Document fingerprints by winnowing (operator 3).

Every run of K code points is hashed (rolling, by one prefix sum); of every W
neighbouring hashes the least is kept, the rightmost at a tie, with its
position.  So any passage of at least K + W - 1 code points that two texts
share gives them a common fingerprint.

Scale.  Texts are shuffled once, into ranges of doc_id; each range also gets the
first document of the next range, so a task streams its documents in order and
holds two at a time.  The ranges come from at most ``SAMPLE`` ids, which only
affects balance.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haggle.llm.words import distinct, mix

K = 16
W = 64
CHUNK = 1 << 18           # hashes looked at together; neighbours overlap by W - 1
SAMPLE = 200_000          # ids sampled to place range borders
ROWS_A_RANGE = 2000
MAX_RANGES = 100_000
_POSITION = np.uint64((1 << 20) - 1)
_P = np.uint64(0x9E3779B97F4A7C15)
_tables: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _tables:
        for base in (int(_P), pow(int(_P), -1, 1 << 64)):
            steps = np.full(CHUNK + K + W, np.uint64(base), np.uint64)
            steps[0] = 1
            _tables.append(np.multiply.accumulate(steps))
    return _tables


def gram_hashes(codes: np.ndarray, width: int = K) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` code points (at most CHUNK + W of them)."""
    p, ip = _powers()
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * p[: len(codes)], out=total[1:])
    n = len(codes) - width + 1
    return mix((total[width:] - total[:n]) * ip[:n])


def winnow(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the selected K-grams, by position.  A text
    shorter than K has one fingerprint, of all of it; an empty one has none; one
    with fewer than W K-grams is a single window."""
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(codes) < K:
        return gram_hashes(codes, len(codes)) >> np.uint64(20), np.zeros(1, np.int64)
    grams = len(codes) - K + 1
    found_h, found_p, last = [], [], -1
    for at in range(0, max(grams - W + 1, 1), CHUNK):
        n = min(grams - at, CHUNK + W - 1)
        h = gram_hashes(codes[at: at + n + K - 1])
        # the hash above, the position (later is less) below: a plain minimum breaks ties to the right
        low = (h & ~_POSITION) | (_POSITION - np.arange(n, dtype=np.uint64))
        if n <= W:
            low = low.min(keepdims=True)
        else:
            size = 1
            while size * 2 <= W:
                low = np.minimum(low[:-size], low[size:])
                size *= 2
            if size < W:
                low = np.minimum(low[: n - W + 1], low[W - size:])
            low = low[np.concatenate(([True], low[1:] != low[:-1]))]
        places = at + (_POSITION - (low & _POSITION)).astype(np.int64)
        fresh = places > last
        found_h.append(low[fresh] >> np.uint64(20))
        found_p.append(places[fresh])
        last = int(places[-1])
    return np.concatenate(found_h), np.concatenate(found_p)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def shown(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Sixteen hex digits a fingerprint: eight of the position, eight of the hash."""
    return ((positions.astype(np.uint64) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))).astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints' distinct (sorted) hashes; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def edited_text(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class _Document:
    def __init__(self, doc_id, text: str):
        self.doc_id, self.text = doc_id, text
        hashes, positions = winnow(code_points(text))
        self.shown, self.hashes = shown(hashes, positions), distinct(hashes)

    def row(self, following: _Document) -> tuple:
        edited = edited_text(self.text, following.text)
        hashes, positions = winnow(code_points(edited))
        return (self.doc_id, len(self.text), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), self.shown,
                shown(hashes, positions), likeness(self.hashes, distinct(hashes)),
                likeness(self.hashes, following.hashes))


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                    ("near_edited", pa.float64()), ("near_next", pa.float64())])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fingerprint of each row alone, without the comparison with neighbours."""
    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([shown(*winnow(code_points(t or ""))) for t in column.to_pylist()], pa.string())

    return docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text)).alias("fingerprint"))


def _in_ranges(rows: DataFrame) -> DataFrame:
    """rows (doc_id, h, text) plus range: a number that grows with doc_id."""
    n = rows.count()
    ids = rows.select("doc_id").where("doc_id is not null").where(
        F.pmod(F.xxhash64("doc_id"), F.lit(max(1, 2 * n // SAMPLE))) == 0).limit(SAMPLE)
    sample = np.sort(np.array([r.doc_id for r in ids.collect()], np.int64))
    ranges = min(max(1, n // ROWS_A_RANGE), MAX_RANGES)
    borders = distinct(sample[(np.arange(1, ranges) * len(sample)) // ranges]) if len(sample) else sample

    @F.arrow_udf("long")
    def place(column: pa.Array) -> pa.Array:
        known = column.fill_null(np.iinfo(np.int64).min).to_numpy()
        return pa.array(np.searchsorted(borders, known, side="right"), pa.int64())

    return rows.withColumn("range", place("doc_id"))


def compare_neighbours(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likenesses.

    The next document is the one with the next larger doc_id; the last one's is
    the first.  Null text counts as empty.  Null doc_ids come first; rows that
    repeat a doc_id follow one another in the order of a hash of their text,
    then of the text.  A table of one row is its own neighbour; an empty one
    gives no rows.  Other columns are ignored."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = _in_ranges(rows.withColumn("h", F.xxhash64("text")).select("doc_id", "h", "text"))
    first = rows.groupBy("range").agg(F.min(F.struct("doc_id", "h", "text")).alias("x"))
    full = np.array(sorted(r.range for r in rows.select("range").distinct().collect()), np.int64)  # MAX_RANGES at most

    @F.arrow_udf("long")
    def range_before(column: pa.Array) -> pa.Array:
        return pa.array(full[np.searchsorted(full, column.to_numpy()) - 1], pa.int64())  # the first wraps to the last

    last = first.select(range_before("range").alias("range"), "x.*").withColumn("borrowed", F.lit(True))
    both = rows.withColumn("borrowed", F.lit(False)).unionByName(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, out, size = None, [], 0
        for batch in batches:
            for d, t, borrowed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "borrowed"))):
                here = _Document(d, t)
                if previous is not None:
                    out.append(previous.row(here))
                    size += len(out[-1][3]) + len(out[-1][4])
                previous = None if borrowed else here  # a range ends with the borrowed row
                if size > 1 << 21:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)

    return both.repartition("range").sortWithinPartitions("range", "borrowed", "doc_id", "h", "text").select(
        "doc_id", "text", "borrowed").mapInArrow(run, SCHEMA)
