"""Language identification with hyperdimensional profiles (operator 2).

Every letter has a random +1/-1 vector (its signs come from a seeded hash of
the code point, so any alphabet works and no table is stored).  An n-gram's
vector binds its letters' vectors, each permuted by its place (a circular
shift), by multiplication; a text bundles (adds) the vectors of its n-grams,
with word ends as a letter of their own; a language's prototype bundles the
texts labelled with it.  A text gets the language of the prototype with the
largest cosine.

Scale.  Training is one pass: each task adds up its texts' vectors by language
and sends one row per language, and the sums are taken as integers, so the
prototypes don't depend on task order.  They are a few kilobytes a language;
``MAX_LANGUAGES`` bounds what is broadcast.  Scoring is a map without shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haggle.llm.spark import unused_name
from haggle.llm.words import as_bytes, distinct, mix, slices

DIMENSIONS = 1024
N = 3
SLICE_BYTES = 1 << 19  # a task's arrays stay at a few dozen megabytes
BLOCK_TEXTS, BLOCK_GRAMS = 512, 2048
MAX_LANGUAGES = 1000  # more distinct labels than this raise an error
SEED = 42
UNDETERMINED = "und"

_state: dict = {}


def _letter_table() -> np.ndarray:
    """Symbol of each code point after lower-casing: the code point of a letter, 0 for all else."""
    if "letters" not in _state:
        table = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            if chr(c).isalpha():
                table[c] = c
        _state["letters"] = table
    return _state["letters"]


def letter_vectors(symbols: np.ndarray) -> np.ndarray:
    """+1/-1 rows of DIMENSIONS for symbols (0 is the word end)."""
    words = np.arange(DIMENSIONS // 64, dtype=np.uint64)
    bits = mix(mix(symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED))[:, None]
               + words[None, :] * np.uint64(0xD6E8FEB86659FD93))
    flat = np.unpackbits(bits.view(np.uint8), axis=1)
    return flat.astype(np.int8) * 2 - 1


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each text: (rows of N symbols, index into them, count,
    offsets of the texts).  Letters are lower-cased; runs of anything else are one word end."""
    if not texts:
        return np.zeros((0, N), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    pieces, sizes, end = [], [], np.zeros(1, np.uint32)
    for t in texts:
        chars = np.frombuffer(t.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
        pieces += [end, chars, end]
        sizes.append(len(chars) + 2)
    symbols = _letter_table()[np.concatenate(pieces)]
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    keep = np.ones(len(symbols), bool)  # one word end at most in a row
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0) | (text[1:] != text[:-1])
    symbols, text = symbols[keep], text[keep]
    alphabet = np.flatnonzero(np.bincount(symbols))
    place = np.zeros(int(alphabet[-1]) + 1, np.int32)
    place[alphabet] = np.arange(len(alphabet))
    small, base = place[symbols], len(alphabet)
    if len(small) < N:
        return (np.zeros((0, N), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64),
                np.zeros(len(texts) + 1, np.int64))
    code = np.zeros(len(small) - N + 1, np.int64)
    for i in range(N):
        code = code * base + small[i: i + len(code)]
    whole = text[N - 1:] == text[: len(code)]
    # drop n-grams without two letters: they say little, and a text without letters has none
    letters = sum((symbols[i: i + len(code)] != 0).astype(np.int8) for i in range(N))
    whole &= letters >= 2
    pair = np.sort(text[: len(code)][whole].astype(np.int64) * base ** N + code[whole])
    first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate((first, [len(pair)])))
    text, code = np.divmod(pair[first], base ** N)
    grams = distinct(code)
    index = np.searchsorted(grams, code)
    rows = np.stack([alphabet[grams // base ** (N - 1 - i) % base] for i in range(N)], axis=1)
    return rows, index, count, np.searchsorted(text, np.arange(len(texts) + 1))


def gram_vectors(rows: np.ndarray) -> np.ndarray:
    """Bind each n-gram's letters: the i-th vector is shifted by N - 1 - i places, then all are multiplied."""
    symbols, index = np.unique(rows, return_inverse=True)
    vectors, index = letter_vectors(symbols), index.reshape(rows.shape)
    out = np.ones((len(rows), DIMENSIONS), np.int8)
    for i in range(N):
        out *= np.roll(vectors, N - 1 - i, axis=1)[index[:, i]]
    return out


def text_vectors(texts: list[bytes], groups: np.ndarray | None = None, grams: np.ndarray | None = None) -> np.ndarray:
    """Bundled vector of each text (zero where it has no n-gram), or of each
    group of texts (groups: a number from 0 for each text): counts times n-gram
    vectors, in blocks of texts and n-grams so that memory is bounded.  grams,
    if given, gets each text's effective number of n-grams: (sum of counts)^2 /
    sum of squared counts, so that repeats don't make a text longer."""
    groups = np.arange(len(texts)) if groups is None else groups
    out = np.zeros((int(groups.max()) + 1 if len(groups) else 0, DIMENSIONS), np.float32)
    for at in range(0, len(texts), BLOCK_TEXTS):
        rows, index, count, offsets = gram_counts(texts[at: at + BLOCK_TEXTS])
        if grams is not None:
            of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            total, squares = (np.bincount(of, w, len(offsets) - 1) for w in (count, count.astype(np.float64) ** 2))
            grams[at: at + BLOCK_TEXTS] = total ** 2 / np.maximum(squares, 1)
        here, own = np.unique(groups[at: at + BLOCK_TEXTS], return_inverse=True)
        target = np.repeat(own, np.diff(offsets))
        for low in range(0, len(rows), BLOCK_GRAMS):
            inside = (index >= low) & (index < low + BLOCK_GRAMS)
            block = rows[low: low + BLOCK_GRAMS]
            cells = target[inside] * len(block) + index[inside] - low
            dense = np.bincount(cells, count[inside], len(here) * len(block)).astype(np.float32)
            out[here] += dense.reshape(len(here), len(block)) @ gram_vectors(block).astype(np.float32)
    return out


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))  # stops at the first letter


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototype vector of each language, from all labelled rows given (null
    labels are left out, null texts add nothing)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                labels = part.column("lang").to_pylist()
                names = sorted(set(labels))
                groups = np.searchsorted(names, labels)
                for name, v in zip(names, text_vectors(as_bytes(part.column("text")), groups)):
                    sums[name] = sums.get(name, 0) + v.astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))],
                ["lang", "vector"])

    parts = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang")).mapInArrow(
        run, "lang string, vector array<long>")
    sums = parts.select("lang", F.posexplode("vector").alias("place", "x")).groupBy("lang", "place").agg(
        F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("v"))
    rows = sums.limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} distinct languages; clean the label column first")
    return {r.lang: np.array([x.x for x in r.v], np.float64) for r in sorted(rows, key=lambda r: r.lang)}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text",
             lang_out: str = "lang_pred", score_out: str = "score", grams_out: str | None = None) -> DataFrame:
    """docs plus the predicted language and its cosine, cut to 0..1, and as
    ``grams_out``, if named, the text's effective number of n-grams.

    ``und`` with score 0 where the text is null or has no letter, or nothing
    was learned.  A letter-bearing text too short for an n-gram of two letters,
    or at a tie, gets the first of the best languages in code-point order.
    All input columns are kept; one that has an output's name is replaced."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float32).reshape(len(names), DIMENSIONS)
    norms = np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1))
    matrix = (matrix / np.maximum(norms, 1e-12)[:, None]).astype(np.float32)

    @F.arrow_udf("struct<lang:string,score:double,grams:double>")
    def predict(column: pa.Array) -> pa.Array:
        langs, scores, sizes = [], [], []
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        for part in slices(batch, "text", SLICE_BYTES):
            texts = as_bytes(part.column("text"))
            grams = np.zeros(len(texts))
            vectors = text_vectors(texts, grams=grams)
            sizes += grams.tolist()
            length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
            cosine = vectors @ matrix.T / np.maximum(length, 1e-12)[:, None]
            for t, n, row in zip(texts, length.tolist(), cosine):
                if not names or not has_letter(t):
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                else:
                    best = int(row.argmax()) if n else 0
                    langs.append(names[best])
                    scores.append(min(max(float(row[best]), 0.0), 1.0))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                                           pa.array(sizes, pa.float64())], ["lang", "score", "grams"])

    hit = unused_name(docs, "hit")
    out = docs.withColumn(hit, predict(F.col(text)))
    named = {lang_out: F.col(f"{hit}.lang"), score_out: F.col(f"{hit}.score")}
    return out.withColumns(named | ({grams_out: F.col(f"{hit}.grams")} if grams_out else {})).drop(hit)


# -- which texts are in none of the languages

CHANCE = 1 / DIMENSIONS ** 0.5  # standard deviation of an unrelated text's cosine
LEAST = 20   # labelled texts of a length from which a floor is learnt
STEPS = 4096  # steps in which scores are counted


def size_class(grams: Column) -> Column:
    """Texts of similar length: the whole part of log2 of the n-grams."""
    return F.floor(F.log2(F.greatest(grams, F.lit(1.0)))).cast("int")


def learn_floors(judged: DataFrame, lang: str, pred: str, score: str, grams: str,
                 languages: int) -> dict[str, dict[int, float]]:
    """Per language, and "" for all together, and per size class: the least ratio
    score / sqrt(n-grams) of a text in the language.

    A text of n effective n-grams that are drawn from a language has a cosine in
    proportion to sqrt(n).  The floor is half of what 95 % of the texts labelled
    and found as the language reach.
    Where it is within reach of chance (two standard deviations, and what the
    largest of ``languages`` cosines adds), texts are too short to be judged, and
    there is no floor; nor is there where fewer than LEAST texts tell it."""
    ratio = F.col(score) / F.sqrt(F.col(grams))
    seen = judged.where((F.col(lang) == F.col(pred)) & (F.col(grams) > 0)).select(
        F.col(pred).alias("l"), size_class(F.col(grams)).alias("c"), F.floor(ratio * STEPS).cast("int").alias("x"))
    counted = seen.groupBy("l", "c", "x").agg(F.count("*").alias("n"))
    counted = counted.unionByName(counted.groupBy("c", "x").agg(F.sum("n").alias("n")).withColumn("l", F.lit("")))
    group = Window.partitionBy("l", "c")  # at most STEPS rows
    counted = counted.withColumn("upto", F.sum("n").over(group.orderBy("x"))).withColumn("all", F.sum("n").over(group))
    rows = counted.where(F.col("all") >= LEAST).groupBy("l", "c").agg(
        F.min(F.when(F.col("upto") * 20 >= F.col("all"), F.col("x"))).alias("low")).collect()
    floors: dict[str, dict[int, float]] = {}
    chance = CHANCE * (2 + (2 * np.log(max(languages, 1))) ** 0.5)
    for r in rows:
        floor = r.low / 2 / STEPS
        floors.setdefault(r.l, {})[r.c] = floor if floor * 2 ** (r.c / 2) > chance else 0.0
    return floors


def above_floor(floors: dict[str, dict[int, float]], languages: list[str], pred: str, score: str, grams: str) -> Column:
    """Whether a text's score reaches its language's floor, or that of all
    languages where its own has too few texts.  Texts longer than all that were
    seen are held to the floor of the longest."""
    pooled, table = floors.get("", {}), {}
    for name in languages:
        own = pooled | floors.get(name, {})
        if own:
            last = max(own)
            table[name] = [own.get(c, 0.0) for c in range(last + 1)]
    if not table:
        return F.lit(True)
    known = F.create_map(*[x for name, row in table.items() for x in (F.lit(name), F.array(*map(F.lit, row)))])
    row = F.element_at(known, F.col(pred))
    floor = F.coalesce(F.get(row, F.least(size_class(F.col(grams)), F.size(row) - 1)), F.lit(0.0))
    return (F.col(grams) <= 0) | (F.col(score) >= floor * F.sqrt(F.col(grams)))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))
