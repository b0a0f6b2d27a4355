"""SentencePiece encoding with byte offsets, and decoding (operator 4).

A text is normalised here, by longest prefix through the model's compiled
character map (a double-array trie with its replacement strings), and every
normalised byte remembers the character of the text it came from.  The library
segments the text; the pieces tile the normalised bytes, so each piece is
projected through the alignment to a span of the original bytes.  A piece
sequence that does not tile the normalised text raises an error.

Words repeat, so where no piece of the model holds a space mark after another
character (checked when the model is loaded) a word's pieces don't depend on
its neighbours, and each task segments a word once and looks it up afterwards.
The store is bounded and only saves time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haggle.llm.spark import unused_name
from haggle.llm.words import as_bytes, slices

MARK = "▁"  # stands for a space
MARK_BYTES = MARK.encode()
STORE = 150_000  # words kept by a worker
LONG_WORD = 64   # longer ones are not kept
BYTE_PIECE, USER_PIECE = 6, 4  # piece types of the model file

_models: dict[str, PieceModel] = {}


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields."""
    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = raw[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    i = 0
    while i < len(raw):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        elif key & 7 == 2:
            size, i = varint(i)
            value, i = raw[i: i + size], i + size
        else:
            size = 8 if key & 7 == 1 else 4
            value, i = raw[i: i + size], i + size
        yield key >> 3, value


class CharacterMap:
    """The compiled map: a little-endian length, the trie's 32-bit units, then NUL-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0]
        self.units = struct.unpack(f"<{size // 4}I", blob[4: 4 + size])
        self.strings = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes read, replacement) of the longest key that is a prefix of text[at:]."""
        units = self.units
        node = self._offset(units[0])
        found = None
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units) or units[node] & 0x800000FF != text[i]:
                break
            leaf = units[node] >> 8 & 1
            node ^= self._offset(units[node])
            if leaf:
                value = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[value: self.strings.index(b"\0", value)]
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


@dataclass
class Encoding:
    ids: list[int]
    begins: np.ndarray  # byte offsets into the original text
    ends: np.ndarray


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            raw = f.read()
        normaliser, trainer = {}, {}
        pieces, kinds = [], []
        for number, value in _fields(raw):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own.get(1, b""))
                kinds.append(own.get(3, 1))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        blob = normaliser.get(2, b"")
        self.map = CharacterMap(blob) if blob else None
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.trim = bool(normaliser.get(4, 1))
        self.mark_spaces = bool(normaliser.get(5, 1))
        if trainer.get(24, 0):
            raise ValueError("models that mark spaces as suffixes are not supported")
        self.own_symbols = sorted((p for p, k in zip(pieces, kinds) if k == USER_PIECE), key=len, reverse=True)
        self.lengths = np.array([1 if k == BYTE_PIECE else len(p) for p, k in zip(pieces, kinds)], np.int64)
        self.unknown = self.library.unk_id()
        self.byte_fallback = BYTE_PIECE in kinds
        self.names = [str(i) for i in range(len(pieces))]
        ordinary = [p.decode("utf-8", "replace") for p, k in zip(pieces, kinds) if k in (1, USER_PIECE)]
        apart = all(MARK not in p.lstrip(MARK) for p in ordinary)
        self.by_word = apart and self.map is None and self.dummy_prefix and not self.trim and self.byte_fallback \
            and not self.own_symbols and self.mark_spaces
        self.store: dict[str, bytes] = {}

    # -- normalising with alignment

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and the end) the offset in
        text of the character it comes from."""
        if self.map is None and not self.trim and not self.own_symbols and self.mark_spaces:
            if not text:
                return b"", np.zeros(1, np.int64)
            raw = np.frombuffer(text, np.uint8)
            # every byte of a character comes from the character's first byte
            first = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, np.arange(len(text)), 0))
            origin = np.append(np.repeat(first, np.where(raw == 32, 3, 1)), len(text))
            out = text.replace(b" ", MARK_BYTES)
            if self.dummy_prefix:
                return MARK_BYTES + out, np.concatenate((np.zeros(3, np.int64), origin))
            return out, origin
        return self._normalise_by_prefix(text)

    def _prefix(self, text: bytes, at: int) -> tuple[int, bytes]:
        for own in self.own_symbols:
            if text.startswith(own, at):
                return len(own), own
        found = self.map.longest(text, at) if self.map else None
        if found:
            return found
        lead = text[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, text[at: at + size]

    def _normalise_by_prefix(self, text: bytes) -> tuple[bytes, np.ndarray]:
        space = MARK_BYTES if self.mark_spaces else b" "
        out, origin = bytearray(), []
        at = 0
        if self.trim:
            while at < len(text):
                size, new = self._prefix(text, at)
                if new != b" ":
                    break
                at += size
        if at == len(text):
            return b"", np.zeros(1, np.int64)
        if self.dummy_prefix:
            out += space
            origin += [at] * len(space)
        after_space = self.trim
        while at < len(text):
            size, new = self._prefix(text, at)
            if after_space:
                new = new.lstrip(b" ")
            if new:
                shown = new.replace(b" ", space)
                out += shown
                origin += [at] * len(shown)
                after_space = self.trim and new.endswith(b" ")
            at += size
        origin.append(len(text))
        if self.trim:
            while out.endswith(space):
                del out[-len(space):]
                last = origin[len(out)]
                del origin[len(out):]
                origin.append(last)
        return bytes(out), np.array(origin, np.int64)

    # -- segmenting

    def _library_ids(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(x)}i", *x) for x in self.library.encode(texts, num_threads=1)] if texts else []

    def segment(self, texts: list[str]) -> list[bytes]:
        """The library's ids of each text, without an end id, as little-endian int32 bytes."""
        if not self.by_word:
            return self._library_ids(texts)
        store = self.store
        if len(store) > STORE:
            store.clear()
        split, missing, whole = [], set(), []
        for t in texts:
            if not t or t[0] == " " or t[-1] == " " or "  " in t or MARK in t:
                whole.append(t)
                split.append(None)
                continue
            split.append(t.split(" "))
            missing.update(set(split[-1]).difference(store))
        names = list(missing)
        store.update(zip(names, self._library_ids(names)))
        rest = iter(self._library_ids(whole))
        out = [next(rest) if words is None else b"".join(map(store.__getitem__, words)) for words in split]
        for w in names:
            if len(w) > LONG_WORD:
                del store[w]
        return out

    def encode(self, texts: list[bytes], end_id: bool = True) -> list[Encoding]:
        plain = [t.decode() for t in texts]
        out = []
        for raw, text, packed in zip(texts, plain, self.segment(plain)):
            normal, origin = self.normalise(raw)
            numbers = np.frombuffer(packed, "<i4")
            ids = numbers.tolist()
            if self.byte_fallback or self.unknown not in ids:
                sizes = self.lengths[numbers]
            else:  # an unknown run's piece is its own text
                sizes = np.array([len(p.encode()) for p in self.library.encode(text, out_type=str)], np.int64)
            places = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(sizes, out=places[1:])
            if places[-1] != len(normal):
                raise ValueError("pieces do not tile the normalised text")
            begins, ends = origin[places[:-1]], origin[places[1:]]
            if end_id:
                ids = [*ids, self.library.eos_id()]
                begins, ends = np.append(begins, len(raw)), np.append(ends, len(raw))
            out.append(Encoding(ids, begins, ends))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", end_id: bool = True) -> DataFrame:
    """docs plus ids, begins, ends (arrays: every piece's byte span in the
    text's UTF-8) and decoded (the library's decoding of the ids).  Null text
    counts as empty and gives only the end id.  Columns are kept; one that has an
    output's name is replaced."""

    @F.arrow_udf("struct<ids:array<int>,begins:array<int>,ends:array<int>,decoded:string>")
    def run(column: pa.Array) -> pa.Array:
        own, found = model(model_path), []
        for part in slices(pa.RecordBatch.from_arrays([column], ["text"]), "text"):
            found += own.encode(as_bytes(part.column("text")), end_id)
        spans = pa.list_(pa.int32())
        return pa.StructArray.from_arrays(
            [pa.array([e.ids for e in found], spans), pa.array([e.begins.astype(np.int32) for e in found], spans),
             pa.array([e.ends.astype(np.int32) for e in found], spans),
             pa.array(own.decode([e.ids for e in found]), pa.string())], ["ids", "begins", "ends", "decoded"])

    hit = unused_name(docs, "hit")
    out = docs.withColumn(hit, run(F.col(text)))
    return out.withColumns({c: F.col(f"{hit}.{c}") for c in ("ids", "begins", "ends", "decoded")}).drop(hit)


def digest_documents(docs: DataFrame, model_path: str, text: str = "text", doc_id: str = "doc_id",
                     end_id: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_covered: the digests of
    what ``encode_documents`` gives, made where the ids are (only digests leave
    the task).  n_covered: bytes of the text that the pieces' spans cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(model_path)
        for batch in batches:
            for part in slices(batch, "text"):
                found = own.encode(as_bytes(part.column("text")), end_id)
                names = own.names
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(e.ids) for e in found], pa.int64()),
                    pa.array([sha256(" ".join([names[i] for i in e.ids]).encode()).hexdigest() for e in found]),
                    pa.array([sha256(t.encode()).hexdigest() for t in own.decode([e.ids for e in found])]),
                    pa.array([covered(e) for e in found], pa.int64())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_covered"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)[doc_id]}, n_tokens long, ids_sha256 string, decoded_sha256 string, "
             "n_covered long")


def covered(e: Encoding) -> int:
    """Bytes from the first span's begin to the last's end, less gaps between neighbours."""
    return int((e.ends - e.begins).sum())
