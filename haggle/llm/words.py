"""Whole-batch word hashing in numpy, used inside Arrow tasks.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, after A-Z are
lower-cased (all other bytes are kept).  Every word becomes a 64-bit hash; no
Python object is made for a word, so a task's memory follows the bytes of one
slice and not its number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19  # bytes hashed at once; a task's arrays are a few times eight times this
_SEED = 20240229
_rng = np.random.default_rng(_SEED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p^i and p^-i modulo 2^64 for i < n, kept for the worker's life up to the piece size."""
    have = _tables.get("p")
    if have is None or len(have) < n:
        size = max(n, PIECE + 4096)
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        tables = {}
        for name, base in (("p", _P), ("ip", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables[name] = np.multiply.accumulate(steps)
        if size > PIECE + 4096:  # one giant word: don't keep its tables
            return tables["p"], tables["ip"]
        _tables.update(tables)
    return _tables["p"], _tables["ip"]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of buf[start:end] for every span, by one prefix sum."""
    p, ip = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * p[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * ip[starts] + (ends - starts).astype(np.uint64))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in a byte buffer."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~_SPACE[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hash_words(texts: list[bytes], keep_tail: bool = False):
    """(hashes of all words, offsets of each text's words[, last-two-bytes code per word]).

    Texts are hashed in pieces of about PIECE bytes that never cut a word."""
    buf = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.concatenate(([0], np.cumsum(sizes)))
    hashes, tails, firsts = [], [], []
    at = 0
    while at < len(buf):
        end = min(len(buf), at + PIECE)
        while end < len(buf):
            back = np.flatnonzero(_SPACE[buf[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
                break
            end = min(len(buf), end + PIECE)
        piece = buf[at:end]
        starts, ends = word_spans(piece)
        hashes.append(span_hashes(piece, starts, ends))
        firsts.append(starts + at)
        if keep_tail:
            last = piece[ends - 1].astype(np.int64)
            before = np.where(ends - starts > 1, piece[np.maximum(ends - 2, 0)], 0).astype(np.int64)
            tails.append(last * 256 + before)
        at = end
    none = np.zeros(0, np.int64)
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    offsets = np.searchsorted(np.concatenate(firsts) if firsts else none, begins)
    if keep_tail:
        return words, offsets, np.concatenate(tails) if tails else none
    return words, offsets


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes: runs of ``width`` words; the
    whole sequence where a text has fewer; nothing where it has no word."""
    words, offsets = hash_words(texts)
    rolled = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for i in range(width):
        rolled = rolled * _Q + words[i: i + len(rolled)]
    rolled = mix(rolled)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= width:
            yield distinct(rolled[a: b - width + 1])
        elif b > a:
            whole = b - a
            for w in words[a:b].tolist():
                whole = (whole * int(_Q) + w) % (1 << 64)
            yield mix(np.array([whole], np.uint64) ^ _P)
        else:
            yield np.zeros(0, np.uint64)


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) \
        else pa.binary()
    return [v or b"" for v in column.cast(wide).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the column's bytes pass ``limit`` (a longer text stands alone)."""
    import pyarrow.compute as pc
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    yield batch.slice(begin)
