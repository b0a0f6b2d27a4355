import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from haggle.llm.circulant import UNIVERSE, band_keys, signature, windows
from haggle.llm.components import components
from haggle.llm.exact_dedup import _merge, drop_exact_copies, exact_groups, repeat_filter
from haggle.llm.near_dedup import near_duplicates
from haggle.llm.words import hash_words, shingle_sets
from tests.llm.conftest import SCHEMA, lower, words


# -- brute force

def sets_of(text, width=5):
    w = words(text)
    if len(w) >= width:
        return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}
    return {tuple(w)} if w else set()


def brute_components(rows):
    """{doc_id: least reachable doc_id} over all pairs of rows."""
    named = [(i, sets_of(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in named}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(named):
        for j, y in named[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a_, b_ = sorted((find(i), find(j)))
                parent[b_] = a_
    return {i: find(i) for i in parent}


# -- hashing and signatures

@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbB é\t\n\x0b\x1c 漢", max_size=30), max_size=6))
def test_words_are_ascii_space_runs(texts):
    hashes, offsets = hash_words([t.encode() for t in texts])
    seen = {}
    for t, a, b in zip(texts, offsets[:-1], offsets[1:]):
        assert b - a == len(words(t))
        for w, h in zip(words(t), hashes[a:b].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_pieces_do_not_change_hashes(monkeypatch):
    texts = [b"alpha beta " * 50, b"x" * 700, b"", b"gamma delta"]
    whole, at = hash_words(texts)
    monkeypatch.setattr("haggle.llm.words.PIECE", 64)
    cut, at2 = hash_words(texts)
    assert np.array_equal(whole, cut) and np.array_equal(at, at2)


def test_shingles_match_sets():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (0, 1, 3, 4, 5, 6, 40, 300)]
    for t, s in zip(texts, shingle_sets([t.encode() for t in texts])):
        assert len(s) == len(sets_of(t))


def test_circulant_coordinates():
    """Coordinate k is the least of pi, shifted circularly by k, over the set's places."""
    view = windows(8)
    pi = view[:, 0]
    assert sorted(pi[:10].tolist()) != pi[:10].tolist() and len(np.unique(pi)) == UNIVERSE
    assert np.array_equal(view[UNIVERSE - 1], np.concatenate((pi[-1:], pi[:7])))
    from haggle.llm.words import mix
    s = np.arange(1000, dtype=np.uint64)
    places = (mix(s ^ np.uint64(0xA5A5A5A5DEADBEEF)) % np.uint64(UNIVERSE)).astype(np.int64)
    assert signature(s, 8).tolist() == [int(pi[(places + k) % UNIVERSE].min()) for k in range(8)]


def test_signature_estimates_jaccard():
    a, b = np.arange(0, 4000, dtype=np.uint64), np.arange(1000, 5000, dtype=np.uint64)
    same = (signature(a, 512) == signature(b, 512)).mean()
    assert abs(same - 0.6) < 0.1
    assert len(set(band_keys(signature(a, 280), 5).tolist())) == 56


# -- near duplicates

def check_near(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id], r
            assert r.kept == (r.doc_id == want[r.doc_id])
    sizes = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles) for r in got)
    assert sizes == sorted((i if i is not None else -1, len(sets_of(t))) for i, t in rows)


def test_near_duplicates_awkward(spark, awkward, small_docs):
    got = {(r.doc_id, r.n_shingles): r for r in near_duplicates(awkward).collect()}
    want = brute_components([(r[0], r[1]) for r in small_docs])
    assert {i: r.component_id for (i, _), r in got.items() if i is not None} == want


def test_near_duplicates_empty(empty):
    assert near_duplicates(empty).collect() == []


def test_near_duplicates_chain_and_group(spark):
    """A chain of edits (ends far apart), a group of edited copies, and short and equal texts."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    rows, at = [], 0
    chain = [rng.choice(vocab) for _ in range(200)]
    for _ in range(12):
        rows.append((at, " ".join(chain)))
        at += 1
        for _ in range(4):
            chain[rng.randrange(200)] = rng.choice(vocab)
    base = [rng.choice(vocab) for _ in range(150)]
    for _ in range(150):
        own = list(base)
        for _ in range(rng.randrange(0, 12)):
            own[rng.randrange(150)] = rng.choice(vocab)
        rows.append((at, " ".join(own)))
        at += 1
    for _ in range(60):
        rows.append((at, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 9)))))
        at += 1
    rows += [(at + i, "same short text") for i in range(5)]
    rng.shuffle(rows)
    check_near(spark, rows)


def test_near_duplicates_blocks(spark, monkeypatch):
    """Buckets larger than a block lose no link."""
    import haggle.llm.near_dedup as nd
    monkeypatch.setattr(nd, "BLOCK", 4)
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(100)]
    rows = []
    for i in range(80):
        own = list(base)
        for _ in range(rng.randrange(0, 8)):
            own[rng.randrange(100)] = f"w{rng.randrange(900)}"
        rows.append((i, " ".join(own)))
    check_near(spark, rows)


def test_repeated_ids_tie_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(5, a), (5, b), (3, a), (9, b), (7, "other words here")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in near_duplicates(df).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (7, 7)}


def test_components_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 70), (70, 85), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in (100, 70, 85)} == {70} and got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# -- exact duplicates

def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    return groups


def test_exact_groups_awkward(awkward, small_docs):
    rows = [(r[0], r[1]) for r in small_docs]
    groups = brute_groups(rows)
    got = exact_groups(awkward).collect()
    assert len(got) == len(rows)
    kept = defaultdict(int)
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[i].append(lower(t))
    for r in got:
        text = next(t for t in by_id[r.doc_id] if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = groups[text]
        assert r.keep_id == max((i for i in ids if i is not None), default=None) and r.group_size == len(ids)
        kept[text] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert all(kept[t] == 1 for t in groups)


def test_drop_exact_copies(awkward, small_docs):
    got = drop_exact_copies(awkward)
    assert got.columns == awkward.columns
    rows = got.collect()
    groups = brute_groups([(r[0], r[1]) for r in small_docs])
    assert sorted(lower(r.text) for r in rows) == sorted(groups)
    for r in rows:
        assert r.doc_id == max((i for i in groups[lower(r.text)] if i is not None), default=None)


def test_exact_empty(empty):
    assert exact_groups(empty).collect() == [] and drop_exact_copies(empty).collect() == []


@pytest.mark.parametrize("limit", [8, 1 << 20])
def test_exact_groups_hot_group_and_small_filter(spark, limit):
    """A third of the rows equal; a saturated filter changes nothing in the result."""
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 400}") for i in range(1500)]
    groups = brute_groups(rows)
    got = exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), max_filter_bytes=limit).collect()
    for r in got:
        ids = groups[dict(rows)[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), r.doc_id == max(ids))


def test_filter_finds_all_repeats_and_few_others(spark):
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(4000)]
    rows = digests + digests[:300]
    df = spark.createDataFrame([(d,) for d in rows], "digest binary").repartition(5)
    bits = repeat_filter(df, len(rows))
    from haggle.llm.exact_dedup import _places
    import pyarrow as pa
    word, mask = _places(pa.array(digests, pa.binary()), len(bits))
    hit = (bits[word] & mask) == mask
    assert hit[:300].all() and hit[300:].mean() < 0.05


def test_merge_is_associative():
    rng = np.random.default_rng(0)
    word = rng.integers(0, 5, 200)
    once = rng.integers(0, 2**63, 200, dtype=np.uint64)
    none = np.zeros(200, np.uint64)
    whole = _merge(word, once, none)
    halves = [_merge(word[s], once[s], none[s]) for s in (slice(0, 90), slice(90, 200))]
    both = _merge(*(np.concatenate(x) for x in zip(*halves)))
    assert all(np.array_equal(a, b) for a, b in zip(whole, both))


def test_schema_constant():
    assert SCHEMA.startswith("doc_id long")
