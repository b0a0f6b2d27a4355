"""Phrase collocations from sorted count streams (operator 13).

Counting.  Three passes over the texts count words, then pairs of frequent
words, then phrases of three and more words all of whose pairs are frequent: a
phrase can't be more frequent than its parts.  A pass asks a bit map of the frequent
words or pairs, which may only say "frequent" too often; counts are exact
(bytes against bytes).  Repeats are summed per slice of a task before they are
shuffled, so common words move as a few rows a task.

Streams.  The frequent phrases of all lengths are then kept in two orders: by
words (prefix order) and by words from the last one (suffix order), cut into
ranges.  One pass over the prefix order merges the streams of all lengths in
lockstep: the phrases that begin a phrase are those open on a small stack when it comes, so
their counts (left parts) and the highest count of an extension to the right are
read off without a hash table; the suffix order gives right parts and extensions
to the left the same way.  A range that starts amid its prefixes is given their
counts, so no group of phrases has to lie in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haggle.llm.spark import BROADCAST_ROWS, checkpoint, remove, written
from haggle.llm.words import as_bytes, mix, span_hashes

LONGEST = 5
SLICE_BYTES = 6 << 20          # text counted at once, in about thirty times its size; a longer text is a slice of its own
BITS_PER_KEY = 16
MAX_MAP_BYTES = 64 << 20       # bound of the broadcast map; beyond it more phrases are counted, with the same result
SEGMENT = 1 << 17              # bytes of the map merged together
RANGE_ROWS = 200_000           # phrases of a range
BUCKETS = 64                   # a language's phrases are ranked in so many parts first

# FIXED VALUES: what ends a piece (other than line ends) and what lies between words
PIECE_MARKS = ".,;:!?"
WORD, BLANK, CUT = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = BLANK
_KIND[[*PIECE_MARKS.encode(), 0x0A, 0x0B, 0x0C, 0x0D]] = CUT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

COUNT_SCHEMA = "key binary, n long"  # key: the phrase, a tab (which no word has), the language
PHRASE_SCHEMA = "lang binary, phrase binary, words array<binary>, n long"
SIDE_SCHEMA = "lang binary, words array<binary>, a long, l array<long>, r array<long>, ext long"


# -- counting in a task

class Slice:
    """Words of some texts: a code per word (equal for equal words), the number of its
    language, and whether the next word belongs to the same piece."""

    def __init__(self, texts: list[bytes], langs: np.ndarray):
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        kind = _KIND[buf]
        inside = np.zeros(len(buf) + 1, bool)
        inside[1:] = kind == WORD
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        ends = np.flatnonzero(~inside[1:] & inside[:-1])  # the last byte is a cut
        words = _binary(np.cumsum(ends - starts), _LOWER[buf[inside[1:]]]).dictionary_encode()
        self.code = words.indices.to_numpy()
        self.words = words.dictionary
        piece = np.searchsorted(np.flatnonzero(kind == CUT), starts)
        self.joined = piece[1:] == piece[:-1]  # to the next word
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.lang = langs[np.searchsorted(np.cumsum(sizes), starts, side="right")]


def _binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Slice, pa.Array]]:
    """Slices of about SLICE_BYTES with the names of their languages."""
    texts, langs, held = [], [], 0

    def made():
        number = {x: i for i, x in enumerate(dict.fromkeys(langs))}
        return Slice(texts, np.fromiter((number[x] for x in langs), np.int64, len(langs))), pa.array(list(number), pa.binary())

    for batch in batches:
        for text, lang in zip(as_bytes(batch.column("text")), as_bytes(batch.column("lang"))):
            texts.append(text)
            langs.append(lang)
            held += len(text)
            if held > SLICE_BYTES:
                yield made()
                texts, langs, held = [], [], 0
    if texts:
        yield made()


def _grouped(high: np.ndarray, low: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs of numbers, low < below: (high, low of the distinct pairs, each pair's place among them, their times)."""
    below = max(1, below)
    group, keys = pd.factorize(high * below + low)
    return keys // below, keys % below, group, np.bincount(group, minlength=len(keys))


def _counts(lang: pa.Array, phrase: pa.Array, times: np.ndarray) -> pa.RecordBatch:
    key = pc.binary_join_element_wise(phrase, lang.cast(pa.large_binary()), pa.scalar(b"\t", pa.large_binary()))
    return pa.RecordBatch.from_arrays([key.cast(pa.binary()), pa.array(times, pa.int64())], ["key", "n"])


def _followed(left: pa.Array, right: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(left, right, pa.scalar(b" ", pa.large_binary()))


def _hashes(values: pa.Array) -> np.ndarray:
    """64 bits per binary value."""
    values = values.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    if not len(values):
        return np.zeros(0, np.uint64)
    bounds = np.frombuffer(offsets, np.int64)[values.offset: values.offset + len(values) + 1]
    data = np.frombuffer(data, np.uint8)[bounds[0]: bounds[-1]] if data else np.zeros(0, np.uint8)
    return span_hashes(data, bounds[:-1] - bounds[0], bounds[1:] - bounds[0])


def _linked(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Hashes of pairs from the hashes of their parts; the order counts."""
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + then)


def _listed(hashes: np.ndarray, have: np.ndarray) -> np.ndarray:
    at = (hashes % np.uint64(len(have) * 8)).astype(np.int64)
    return (have[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class Pairs:
    """Pairs of neighbouring words that may both be frequent, as numbers."""

    def __init__(self, part: Slice, names: pa.Array, frequent: np.ndarray):
        self.lang, code, self.word, _ = _grouped(part.lang, part.code, len(part.words))
        self.words = part.words.take(pa.array(code))
        self.hashes = _linked(_hashes(names)[self.lang], _hashes(part.words)[code])
        good = _listed(self.hashes, frequent)[self.word]
        self.at = np.flatnonzero(good[:-1] & good[1:] & part.joined)
        self.first, self.second, self.group, self.times = _grouped(self.word[self.at], self.word[self.at + 1], len(code))

    def phrases(self, which: np.ndarray) -> pa.Array:
        return _followed(self.words.take(pa.array(self.first[which])), self.words.take(pa.array(self.second[which])))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, names in slices(batches):
        lang, code, _, times = _grouped(part.lang, part.code, len(part.words))
        yield _counts(names.take(pa.array(lang)), part.words.take(pa.array(code)), times)


def count_pairs(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part, names in slices(batches):
        pairs = Pairs(part, names, words)
        yield _counts(names.take(pa.array(pairs.lang[pairs.first])), pairs.phrases(np.arange(len(pairs.times))), pairs.times)


def count_longer(batches: Iterator[pa.RecordBatch], words: np.ndarray, frequent: np.ndarray,
                 longest: int) -> Iterator[pa.RecordBatch]:
    for part, names in slices(batches):
        pairs = Pairs(part, names, words)
        good = _listed(_linked(pairs.hashes[pairs.first], pairs.hashes[pairs.second]), frequent)
        kept = np.flatnonzero(good)  # pairs that may be frequent
        phrases, lang = pairs.phrases(kept), pairs.lang[pairs.first[kept]]
        number = np.cumsum(good) - 1
        group = np.full(len(part.code) + 1, -1)  # number of the phrase that starts at a word, -1 for none
        good = good[pairs.group]
        group[pairs.at[good]] = number[pairs.group[good]]
        for length in range(3, longest + 1):
            at = np.flatnonzero((group[:-1] >= 0) & (group[1:] >= 0))
            before, last, longer, times = _grouped(group[at], pairs.word[at + length - 1], len(pairs.words))
            phrases, lang = _followed(phrases.take(pa.array(before)), pairs.words.take(pa.array(last))), lang[before]
            yield _counts(names.take(pa.array(lang)), phrases, times)
            group = np.full(len(part.code) + 1, -1)
            group[at] = longer


# -- counting over all tasks

def _frequent(counts: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, n) of the phrases that are counted at least so often."""
    summed = counts.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return summed.mapInArrow(_parted, PHRASE_SCHEMA)


def bit_map(phrases: DataFrame, pairs: bool) -> np.ndarray:
    """Bytes of a map with a bit set for every (lang, word), or (lang, pair of words); at most MAX_MAP_BYTES."""
    size, bits = 1 << 10, phrases.count() * BITS_PER_KEY
    while size * 8 < bits and size < MAX_MAP_BYTES:
        size *= 2
    segment = min(size, SEGMENT)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = _hashes(batch.column("lang"))
            parts = pc.split_pattern(batch.column("phrase").cast(pa.large_binary()), b" ")  # words hold no space
            words, at = _hashes(parts.flatten()), parts.offsets.to_numpy()[:-1].astype(np.int64)
            hashes = _linked(lang, words[at])
            if pairs:
                hashes = _linked(hashes, _linked(lang, words[at + 1]))
            bit = np.unique((hashes % np.uint64(size * 8)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(bit // (8 * segment)), pa.array(bit % (8 * segment))], ["segment", "bit"])

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(8 * segment, np.uint8)
        for batch in batches:
            out[batch.column("bit").to_numpy()] = 1
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()),
                                          pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])

    out = np.zeros(size, np.uint8)
    found = phrases.select("lang", "phrase").mapInArrow(places, "segment long, bit long")
    for row in found.groupBy("segment").applyInArrow(merged, "segment long, bits binary").toLocalIterator():
        out[row.segment * segment:][:segment] = np.frombuffer(row.bits, np.uint8)
    return out


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [key.split(b"\t", 1) for key in batch.column("key").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang for _, lang in keys], pa.binary()), pa.array([p for p, _ in keys], pa.binary()),
             pa.array([p.split(b" ") for p, _ in keys], pa.list_(pa.binary())), batch.column("n")], ["lang", "phrase", "words", "n"])


def frequent_phrases(docs: DataFrame, least: int, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, list[str]]:
    """(lang, words, a of every phrase of 1 to ``longest`` words with a >= least; lang,
    n: all words of each language; paths of the tables to remove later).
    docs: lang and text, both binary and without nulls."""
    sc, paths = docs.sparkSession.sparkContext, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        table, path = written(df, name)
        paths.append(path)
        return table

    counts = kept(_frequent(docs.mapInArrow(count_words, COUNT_SCHEMA), 1), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    words = counts.where(F.col("n") >= least)
    word_map = sc.broadcast(bit_map(words, pairs=False))
    pairs = kept(_frequent(docs.mapInArrow(lambda b: count_pairs(b, word_map.value), COUNT_SCHEMA), least), "pairs")
    found = words.unionByName(pairs)
    if longest > 2:
        pair_map = sc.broadcast(bit_map(pairs, pairs=True))
        found = found.unionByName(kept(_frequent(docs.mapInArrow(
            lambda b: count_longer(b, word_map.value, pair_map.value, longest), COUNT_SCHEMA), least), "longer"))
    return found.select("lang", "words", F.col("n").alias("a")), totals, paths


# -- lockstep passes

def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[bytes], int]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "a")))


def merge_stream(rows: Iterator[tuple[bytes, list[bytes], int]],
                 opened: list[tuple[bytes, list[bytes], int]]) -> Iterator[tuple]:
    """(lang, words, a, counts of its proper beginnings from the shortest on, highest
    count of a phrase one word longer that begins with it) of each row of a sorted
    stream.  ``opened``: beginnings of the first row that came before the
    stream; they return with a null a, for the extensions found here."""
    stack = [[lang, words, None, a, 0] for lang, words, a in opened]

    def closed():
        lang, words, a, _, ext = stack.pop()
        return lang, words, a, [x[3] for x in stack], ext

    for lang, words, a in rows:
        while stack and not (stack[-1][0] == lang and len(stack[-1][1]) < len(words)
                             and words[: len(stack[-1][1])] == stack[-1][1]):
            yield closed()
        if stack and len(stack[-1][1]) == len(words) - 1:
            stack[-1][4] = max(stack[-1][4], a)
        stack.append([lang, words, a, a, 0])
    while stack:
        yield closed()


def stream_counts(phrases: DataFrame, suffix: bool) -> DataFrame:
    """SIDE_SCHEMA: per phrase its left parts (``l``, from the shortest) and highest extension to
    the right, or in suffix order its right parts (``r``) and highest extension to
    the left.  Rows with a null a only add an extension."""
    if suffix:
        phrases = phrases.withColumn("words", F.reverse("words"))
    ranges = max(1, -(-phrases.count() // RANGE_ROWS))
    ordered = checkpoint(phrases.repartitionByRange(ranges, "lang", "words").sortWithinPartitions("lang", "words")
                         .withColumn("range", F.spark_partition_id()))

    # the least row of every range, and at most LONGEST - 1 beginnings each
    starts = ordered.groupBy("range").agg(F.min(F.struct("lang", "words")).alias("first")).select("range", "first.*")
    begun = starts.select("range", "lang", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("words")), lambda k: F.slice("words", 1, k))).alias("words"), F.size("words").alias("of"))
    begun = begun.where(F.size("words") < F.col("of")).drop("of")
    opened: dict[int, list] = {}
    for r in ordered.drop("range").join(F.broadcast(begun), ["lang", "words"]).select("range", "lang", "words", "a").collect():
        opened.setdefault(r.range, []).append((bytes(r.lang), [bytes(w) for w in r.words], r.a))
    shared = phrases.sparkSession.sparkContext.broadcast({k: sorted(v, key=lambda x: len(x[1])) for k, v in opened.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        own, have = shared.value.get(first.column("range")[0].as_py(), []), []
        kinds = [pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
        names = ["lang", "words", "a", "l", "r", "ext"]

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*have), kinds)], names)

        for lang, words, a, parts, ext in merge_stream(_rows(chain([first], batches)), own):
            parts = parts if a is not None else None
            have.append((lang, words[::-1], a, None, parts, ext) if suffix else (lang, words, a, parts, None, ext))
            if len(have) == 20_000:
                yield batch()
                have.clear()
        if have:
            yield batch()

    return ordered.mapInArrow(run, SIDE_SCHEMA)


# -- the operator

def _score(a: Column, n: Column, part: Column, rest: Column) -> Column:
    """floor(1000 a n / (part rest)) in 38 digits; the quotient is at most 1000 n / a."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", (wide(a) * wide(n)).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)"), wide(part) * wide(rest))


def scored_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100,
                   longest: int = LONGEST) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase of 2 to ``longest`` words with a >= least
    that no longer such phrase replaces (see ``collocations``)."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).cast("binary").alias("lang"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    phrases, totals, paths = frequent_phrases(rows, least, longest)
    totals = checkpoint(totals)
    sides, left = written(stream_counts(phrases, suffix=False).unionByName(stream_counts(phrases, suffix=True)), "sides")
    remove(docs.sparkSession, paths)
    whole = sides.groupBy("lang", "words").agg(*[F.max(c).alias(c) for c in ("a", "l", "r", "ext")])
    whole = whole.where((F.size("words") > 1) & (F.col("ext") < F.col("a")))
    few = totals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    whole = whole.join(F.broadcast(totals) if few else totals, "lang")
    cuts = F.transform(F.sequence(F.lit(1), F.size("l")), lambda k: F.struct(
        _score(F.col("a"), F.col("n"), F.element_at("l", k), F.element_at("r", F.size("l") - k + 1)).alias("score"),
        k.alias("k"), F.element_at("l", k).alias("l"), F.element_at("r", F.size("l") - k + 1).alias("r")))
    worst = F.array_min(cuts)  # least score, then least k
    phrase = F.array_join(F.transform("words", lambda w: w.cast("string")), " ")
    return checkpoint(whole.withColumn("worst", worst).select(
        F.col("lang").cast("string").alias("lang"), phrase.alias("phrase"), "a", "worst.l", "worst.r", "n", "worst.score"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = LONGEST,
                 most: int = 2000) -> DataFrame:
    """The first ``most`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; texts are cut into pieces at ``.,;:!?`` and line ends, and
    pieces into words at spaces and tabs.  a counts a phrase within pieces,
    overlaps included; n all words of the language.  A phrase's score is the
    lowest floor(1000 a n / (l r)) of its cuts into a left part (count l) and a
    right part (count r), of equal ones the first cut.  A phrase that lies within a
    longer one just as frequent is left out: if any longer one is, one that
    is a word longer is too, as no phrase is more frequent than its parts.
    Order: score and a descending, phrase by bytes.

    Null text counts as empty, null lang as ``und`` (the same language as a lang of that name);
    repeated rows count each time; ids and other columns are ignored, whatever
    their names; an empty table gives no rows.  Counts past 17 digits fail."""
    found = scored_phrases(docs, text, lang, least, longest)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order)))
    last = first.where(F.col("rank") <= most).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return last.where(F.col("rank") <= most).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
