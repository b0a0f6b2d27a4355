"""Token ids in ORC files (operator 6).

Documents are range-partitioned and sorted by doc_id, tokenized, and written as
ORC: ids are integer columns, so ORC run-length encodes them; every file has
stripes that can be read in parallel, a row index, and Bloom filters on
doc_id, so that a lookup reads only the stripes and row groups that can hold
the id.  A row also keeps its file's number and the ids before it in that file;
the ids before a file are the running sum of one row a file.

Words repeat, so a task encodes a word (with the space before it) once and
looks it up afterwards: the byte-level pattern always starts a token at a space
that a non-space follows.  Texts where that can't be told go to the library
whole.  A new word of common characters is cut by the library's pattern over the
classes that the library itself puts these characters in, other words by the
library; the library merges every piece.  The store is bounded and only saves time.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from haggle.llm.words import slices

STORE = 600_000   # words and word parts kept by a worker, with as many from before them
LONG_WORD = 64    # longer ones are not kept
PLAIN = 0x250     # words of characters under it are cut here
ROW_INDEX = 1000  # rows of a row group
STRIPE_BYTES = 16 << 20

_tokenizers: dict[str, ByteTokenizer] = {}


class _LooseSpace(Exception):
    """A space before white space or the text's end."""


class _Store(dict):
    """make(key) for every key, remembered; long keys are made each time.  Keys
    used since the last but one ``age`` are kept, so frequent ones stay."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG_WORD:
            self[key] = value
        return value

    def age(self) -> None:
        self.old = dict(self)
        self.clear()


def _pattern(cutter) -> re.Pattern:
    """The byte-level pattern for characters under PLAIN, by the class that the
    cutter puts each in."""
    classes = {x: "" for x in ("a", "1", "!", " ")}
    for c in map(chr, range(PLAIN)):
        classes[next((x for x in "a1!" if len(cutter.pre_tokenize_str(x + c)) == 1), " ")] += re.escape(c)
    letter, number, other, space = classes.values()
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[{other}]+|[{space}]+(?![^{space}])|[{space}]+")


class ByteTokenizer:
    """A byte-level BPE file of the tokenizers library; special tokens' strings
    in a text are ordinary text.  Ids are handled as little-endian int32 bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.cutter, self.merge = self.library.pre_tokenizer, self.library.model.tokenize
        self.by_word = self.library.normalizer is None and isinstance(self.cutter, pre_tokenizers.ByteLevel) \
            and not self.cutter.add_prefix_space and self.cutter.use_regex \
            and all(t.special for t in self.library.get_added_tokens_decoder().values())
        self.first = _Store(self._at_start)
        self.rest = _Store(self._after_space)
        self.pieces = _Store(self._piece)    # as the library shows them
        self.parts = _Store(lambda x: self._piece(x.translate(self.shown)))  # of plain words
        if self.by_word:  # how the library cuts and shows common characters
            self.cut = _pattern(self.cutter).findall
            self.shown = str.maketrans({chr(c): self.cutter.pre_tokenize_str(chr(c))[0][0] for c in range(PLAIN)})
            self.space = self.shown[ord(" ")]

    def _whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}i", *ids)

    def _piece(self, piece: str) -> bytes:
        return array("i", [t.id for t in self.merge(piece)]).tobytes()

    def _after_space(self, word: str) -> bytes:
        """A word that is one piece is merged; the first piece of others is looked
        up as the word that it is alone."""
        if word.isalpha() and word.isascii():
            return self._piece(self.space + word)
        if not word or word[0].isspace():
            raise _LooseSpace
        if not word.isascii() and max(word) >= chr(PLAIN):
            return self._other(" ", word)
        head, *parts = self.cut(" " + word)
        if not parts:
            return self._piece(head.translate(self.shown))
        return self.rest[head[1:]] + b"".join([self.parts[x] for x in parts])

    def _at_start(self, word: str) -> bytes:
        if not word.isascii() and max(word) >= chr(PLAIN):
            return self._other("", word)
        return b"".join([self.parts[x] for x in self.cut(word)])

    def _other(self, lead: str, word: str) -> bytes:
        """A word with other characters; one line feed between words is a piece of its own."""
        head, *lines = word.split("\n")
        if lines and all(x and not x[0].isspace() and not x[-1].isspace() for x in (head, *lines)):
            return self.parts["\n"].join([(self.rest if lead else self.first)[head], *map(self.first.__getitem__, lines)])
        return b"".join([self.pieces[x] for x, _ in self.cutter.pre_tokenize_str(lead + word)])

    def ids(self, texts: list[str]) -> list[bytes]:
        """The library's ids of each text (add_special_tokens=False)."""
        stores = self.first, self.rest, self.pieces, self.parts
        if sum(map(len, stores)) > STORE:
            for store in stores:
                store.age()
        out, first, rest = [], self.first, self.rest.__getitem__
        for t in texts:
            if not self.by_word:
                out.append(self._whole(t))
                continue
            head, *words = t.split(" ")
            try:
                out.append(first[head] + b"".join(map(rest, words)))
            except _LooseSpace:
                out.append(self._whole(t))
        return out


def tokenizer(path: str) -> ByteTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ByteTokenizer(path)
        gc.freeze()  # else each of Python's garbage collections walks through the stores
    return _tokenizers[path]


def write_token_files(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 2,
                      text: str = "text", doc_id: str = "doc_id") -> None:
    """Write doc_id, file, before (ids before the row in its file), n_tokens and
    ids as ORC under ``out``, in ascending doc_id order over all files.

    Null text gives the end id alone.  Null doc_ids come first; rows that repeat
    a doc_id follow one another in the order of a hash of their text.  An empty
    table writes no rows.  Other columns are not written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        own, file, before = tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<i4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                ids = own.ids([t or "" for t in part.column("text").to_pylist()])
                sizes = np.array([len(x) // 4 + 1 for x in ids], np.int64)
                ends = np.cumsum(sizes)
                values = np.frombuffer(b"".join([x + end for x in ids]), "<i4")
                offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.full(len(sizes), file), pa.int64()),
                     pa.array(before + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(values))],
                    ["doc_id", "file", "before", "n_tokens", "ids"])
                before += int(ends[-1])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    (rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
     .mapInArrow(run, "doc_id long, file long, before long, n_tokens long, ids array<int>")
     .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.row.index.stride", ROW_INDEX).option("orc.stripe.size", STRIPE_BYTES)
     .option("compression", "zstd").mode("errorifexists").orc(out))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids."""
    rows = spark.read.orc(path)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # a row a file
    upto = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("file", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "file").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; stripes and row groups without them are skipped by index and Bloom filter."""
    return spark.read.orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


@F.arrow_udf(LongType())  # a type object: workers import this module without a session
def ids_crc32(ids: pa.Array) -> pa.Array:
    """Unsigned CRC-32 of each id list as little-endian unsigned 32-bit integers."""
    offsets = ids.offsets.to_numpy()
    data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
    return pa.array([zlib.crc32(data[4 * a: 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())],
                    pa.int64())
