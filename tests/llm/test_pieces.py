import hashlib
import struct

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from haggle.llm.pieces import CharacterMap, PieceModel, _fields, digest_documents, encode_documents, model

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "a", "Hello world", "  two  spaces ", "tabs\tand\nlines", "naïve Ünïcode – 漢字 🙂", "▁ mark ▁▁", "x" * 500,
         "<s> </s> <unk> <0x0A>", "word word word", "a\x0bb\x0cc", "trailing ", "é", "𝒳 𝒴", "The quick brown fox. " * 40]


# -- a compiled character map, built for the tests

def compiled_map(rules):
    """Blob of a double-array trie over rules {source: replacement}."""
    strings, values = b"", {}
    for source, new in sorted(rules.items()):
        values[source.encode()] = len(strings)
        strings += new.encode() + b"\0"
    units, used = {0: 0}, {0}

    def place(prefix, pos):
        labels = sorted({k[len(prefix)] for k in values if len(k) > len(prefix) and k.startswith(prefix)})
        leaf = prefix in values
        offset = 1
        while any((pos ^ offset ^ c) in used for c in ([0] if leaf else []) + labels):
            offset += 1
        units[pos] |= (offset << 10) | (0x100 if leaf else 0)
        base = pos ^ offset
        if leaf:
            used.add(base)
            units[base] = values[prefix] | 1 << 31
        for c in labels:
            used.add(base ^ c)
            units[base ^ c] = c
        for c in labels:
            place(prefix + bytes([c]), base ^ c)

    place(b"", 0)
    size = (max(units) | 255) + 1
    flat = struct.pack(f"<{size}I", *[units.get(i, 0) for i in range(size)])
    return struct.pack("<I", len(flat)) + flat + strings


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(number, value):
    return varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) \
        else varint(number << 3) + varint(value)


def patched(tmp_path, blob, trim, dummy=1):
    """The public model with another normaliser."""
    with open(PATH, "rb") as f:
        raw = f.read()
    spec = field(1, b"own") + field(2, blob) + field(3, dummy) + field(4, trim) + field(5, 1)
    out = b"".join(field(n, spec if n == 3 else v) for n, v in _fields(raw))
    path = tmp_path / f"m{trim}{dummy}.model"
    path.write_bytes(out)
    return PieceModel(str(path))


RULES = {"ﬁ": "fi", "Ａ": "A", " ": " ", "é": "é", "…": "...", "​": "", "ab": "X", "abc": "Y", "\t": " "}


def test_longest_prefix():
    m = CharacterMap(compiled_map(RULES))
    for source, new in RULES.items():
        assert m.longest((source + "zz").encode(), 0) == (len(source.encode()), new.encode())
    assert m.longest(b"abcab", 0) == (3, b"Y") and m.longest(b"abcab", 3) == (2, b"X")
    assert m.longest(b"a", 0) is None and m.longest(b"", 0) is None and m.longest("é".encode(), 0) is None


def library_spans(own, text):
    proto = own.library.encode(text, out_type="serialized_proto")
    pieces = [dict(_fields(v)) for n, v in _fields(proto) if n == 2]
    return [(p.get(2, 0), p.get(4, 0), p.get(5, 0)) for p in pieces]


@pytest.mark.parametrize("trim,dummy", [(0, 1), (1, 1), (1, 0), (0, 0)])
def test_own_normaliser_equals_library(tmp_path, trim, dummy):
    own = patched(tmp_path, compiled_map(RULES), trim, dummy)
    texts = TEXTS + ["abcab ﬁn…", "Ａ  B", "  ​  ", "éé caf", "​", " \tx\t "]
    for t in texts:
        normal, origin = own.normalise(t.encode())
        assert normal.decode().replace("▁", " ") == own.library.normalize(t).replace("▁", " ")
        assert len(origin) == len(normal) + 1
        e, = own.encode([t.encode()], end_id=False)
        assert e.ids == own.library.encode(t)
        assert [(i, int(b), int(c)) for i, b, c in zip(e.ids, e.begins, e.ends)] == library_spans(own, t)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é\t\n▁漢🙂<s>", max_size=25), min_size=1, max_size=4))
def test_ids_spans_and_decoding(texts):
    own = model(PATH)
    plain = own.library.encode(texts, add_eos=True)
    for t, e, ids in zip(texts, own.encode([t.encode() for t in texts]), plain):
        raw = t.encode()
        assert e.ids == ids
        assert [(i, int(b), int(c)) for i, b, c in zip(e.ids[:-1], e.begins, e.ends)] == library_spans(own, t)
        assert b"".join(raw[a:b] for a, b in zip(e.begins, e.ends)) == raw
    assert own.decode(plain) == own.library.decode(plain)


def test_words_kept_or_not(monkeypatch):
    own = PieceModel(PATH)
    assert own.by_word
    monkeypatch.setattr("haggle.llm.pieces.STORE", 2)
    for _ in range(3):
        assert [np.frombuffer(x, "<i4").tolist() for x in own.segment(TEXTS)] == own.library.encode(TEXTS)
    assert all(len(w) <= 64 for w in own.store)


def test_documents(awkward, small_docs, empty):
    own = model(PATH)
    want = {}
    for i, t, *_ in small_docs:
        ids = own.library.encode(t or "", add_eos=True)
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                   hashlib.sha256(own.library.decode(ids).encode()).hexdigest(), len((t or "").encode()))
    got = digest_documents(awkward, PATH).collect()
    assert len(got) == len(small_docs)
    assert all(want[r.doc_id] == (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.n_covered) for r in got)
    full = encode_documents(awkward.withColumnRenamed("text", "ids"), PATH, text="ids")
    rows = full.collect()
    assert len(rows) == len(small_docs) and all(len(r.ids) == len(r.begins) == want[r.doc_id][0] for r in rows)
    assert digest_documents(empty, PATH).collect() == [] and encode_documents(empty, PATH).collect() == []
