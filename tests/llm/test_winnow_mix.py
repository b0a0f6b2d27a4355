import hashlib
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from haggle.llm import mixing as X
from haggle.llm import winnow as W
from tests.llm.conftest import words


# -- winnowing

def brute_winnow(text):
    codes = W.code_points(text)
    if len(codes) < W.K:
        return [(int(W.gram_hashes(codes, len(codes))[0] >> np.uint64(20)), 0)] if len(codes) else []
    h = [int(W.gram_hashes(codes[i: i + W.K])[0] >> np.uint64(20)) for i in range(len(codes) - W.K + 1)]
    picked = set()
    for i in range(max(len(h) - W.W + 1, 1)):
        window = h[i: i + W.W]
        picked.add(i + max(j for j, x in enumerate(window) if x == min(window)))
    return [(h[i], i) for i in sorted(picked)]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab é🙂", max_size=300))
def test_winnow_against_loops(text):
    hashes, positions = W.winnow(W.code_points(text))
    assert list(zip(hashes.tolist(), positions.tolist())) == brute_winnow(text)


def test_chunks_do_not_matter(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcd ") for _ in range(3000)) + "a" * 400
    whole = W.winnow(W.code_points(text))
    monkeypatch.setattr(W, "CHUNK", 100)
    cut = W.winnow(W.code_points(text))
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut))


def test_match_guarantee():
    """Texts that share K + W - 1 code points share a fingerprint."""
    rng = random.Random(2)

    def noise(n):
        return "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))

    for _ in range(50):
        shared = noise(W.K + W.W - 1)
        a, b = (W.winnow(W.code_points(noise(rng.randrange(300)) + shared + noise(rng.randrange(300))))[0] for _ in range(2))
        assert set(a.tolist()) & set(b.tolist())


def check_neighbours(docs, rows):
    got = W.compare_neighbours(docs).collect()
    assert len(got) == len(rows)
    named = sorted((i, t or "") for i, t in rows if i is not None)
    if len({i for i, _ in named}) == len(rows):
        for (i, t), (_, following) in zip(named, named[1:] + named[:1]):
            r = next(r for r in got if r.doc_id == i)
            edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            own, ed, nx = (W.winnow(W.code_points(x)) for x in (t, edited, following))
            assert r.fingerprint == W.shown(*own) and r.edited_fingerprint == W.shown(*ed)
            a, b, c = (set(x[0].tolist()) for x in (own, ed, nx))
            assert r.near_edited == (len(a & b) / len(a | b) if a | b else 1.0)
            assert r.near_next == (len(a & c) / len(a | c) if a | c else 1.0)
    return got


def test_neighbours_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(W, "ROWS_A_RANGE", 7)
    rng = random.Random(6)
    rows = [(i * i - 50, " ".join(rng.choice(["aa", "bb", "cc", "é🙂"]) for _ in range(rng.randrange(80)))) for i in range(100)]
    rows[5], rows[6] = (rows[5][0], None), (rows[6][0], "")
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_neighbours(df, rows)


def test_neighbours_awkward(spark, awkward, small_docs, empty):
    got = check_neighbours(awkward, [(r[0], r[1]) for r in small_docs])
    texts = {}
    for r in got:
        texts.setdefault(r.n_chars, set()).add(r.fingerprint)
    assert W.compare_neighbours(empty).collect() == []
    one = W.compare_neighbours(spark.createDataFrame([(1, "abc" * 50)], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    by = {r.doc_id: r.fingerprint for r in W.fingerprints(awkward).collect()}
    assert by[103] == by[104] == "" and len({by[100], by[101]}) == 2


def test_equal_texts_have_equal_fingerprints():
    t = "some text that is long enough to have fingerprints, more than one window of them, surely and certainly" * 3
    assert W.shown(*W.winnow(W.code_points(t))) == W.shown(*W.winnow(W.code_points(str(t))))
    assert W.likeness(*[np.unique(W.winnow(W.code_points(t))[0])] * 2) == 1.0


# -- mixing

def brute_flow(caps, members, quotas, repeats):
    """Least cost among all maximum flows, by enumeration of the words each pattern gives."""
    best = None
    for give in itertools.product(*[range(c * repeats + 1) for c in caps]):
        if feasible(give, members, quotas):
            cost = sum(sum(max(0, g - k * c) for k in range(1, repeats)) for g, c in zip(give, caps))
            key = (-sum(give), cost)
            best = min(best, key) if best else key
    return best


def feasible(give, members, quotas):
    """Hall's condition: what patterns inside any set of sources give fits its quotas."""
    n = len(quotas)
    return all(sum(g for g, m in zip(give, members) if all(mask >> s & 1 for s in m)) <= sum(
        q for s, q in enumerate(quotas) if mask >> s & 1) for mask in range(1 << n))


@pytest.mark.parametrize("seed", range(25))
def test_route_is_cheapest_maximum_flow(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 3)
    members = [sorted(rng.sample(range(n), rng.randint(1, n))) for _ in range(rng.randint(1, 3))]
    caps = [rng.randint(0, 4) for _ in members]
    quotas = [rng.randint(0, 9) for _ in range(n)]
    taken = X.route(caps, members, quotas, 2)
    assert feasible(taken, members, quotas) and all(t <= 2 * c for t, c in zip(taken, caps))
    cost = sum(max(0, t - c) for t, c in zip(taken, caps))
    assert (-sum(taken), cost) == brute_flow(caps, members, quotas, 2)


def brute_targets(sizes, weights, share, limit):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(limit * sizes[s] for s in full)
        level = rest / sum(w[s] for s in free) if free else 0
        over = {s for s in free if w[s] * level > limit * sizes[s]}
        if not over:
            return {s: limit * sizes[s] if s in full else w[s] * level for s in names}
        full |= over


def test_report(spark):
    rng = random.Random(9)
    rows = []
    for i in range(900):
        source = rng.choice(["a", "b", "B", "é", "z9", None] + ["hot"] * 5)
        rows.append((i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 3, 8, 20, 40]))), source))
    rows += [(1000, None, "a"), (1001, "only one here", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = X.mix_report(df).collect()
    assert len(got) == len(rows)
    sizes, of = {}, {i: s for i, _, s in rows}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    target = brute_targets(sizes, (3, 1, 2), 1.5, 2)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s in sizes:  # off by less than the smallest unused document, here of at most 40 words
        unused = [r.size for r in got if of[r.doc_id] == s and 0 < r.size and r.taken < 2 * r.size]
        assert abs(taken[s] - target[s]) <= max(0.5, min(unused, default=0) / 2), (s, taken[s], target[s])
    again = {(r.doc_id, r.taken) for r in X.mix_report(df.repartition(9)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_long_text_leaves_no_gap(spark):
    """A text as large as half its source that overshoots is left aside, and the
    others fill the gap; repeated rows count with all their copies."""
    rng = random.Random(12)
    rows = []
    for s in "abcdefgh":
        sizes = [rng.randint(5, 30) for _ in range(200)]
        rows += [(len(rows) + i, "w " * n, s) for i, n in enumerate([*sizes, sum(sizes)])]
        rows += [rows[-5], rows[-9]] * 2
    got = X.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1,), share=0.3).collect()
    source, copies = {i: s for i, _, s in rows}, {}
    for i, _, _ in rows:
        copies[i] = copies.get(i, 0) + 1
    for s in "abcdefgh":
        own = [r for r in got if source[r.doc_id] == s]
        unused = [r.size * copies[r.doc_id] for r in own if r.taken < r.size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(0.5, min(unused) / 2), s


def test_overlapping_sources(spark):
    rows = [(i, "x " * 10, (["a"], ["a", "b"], ["b"], ["c"], [], None)[i % 6]) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = X.mix(df, weights=(1, 1, 1), share=0.5).collect()
    assert sum(r.taken for r in got if r.source and "c" in r.source) > 0
    assert all(r.taken == 0 for r in got if not r.source)
    total = sum(r.taken for r in got)
    assert abs(total - 0.5 * 2400 * 4 / 6) <= 2400


def test_mix_awkward(awkward, small_docs, empty):
    got = X.mix(awkward)
    assert got.columns == [c for c in awkward.columns if c not in ("size", "taken")] + ["size", "taken"]
    rows = got.collect()
    assert len(rows) == len(small_docs)
    assert all(r.size == len(words(r.text)) and r.taken in (0, r.size, 2 * r.size) for r in rows)
    mixed = X.mixed_documents(awkward)
    assert mixed.columns == awkward.columns
    assert mixed.count() == sum(r.taken // r.size for r in rows if r.size)
    assert X.mix_report(empty).collect() == [] and X.mixed_documents(empty).collect() == []


def test_ranks(spark):
    names = ["1", "0b", "0a", "0é", "0Z"]
    df = spark.createDataFrame([(x,) for x in names], "key string")
    got = {r.key: r.rank for r in X.ranked(df, "key").collect()}
    assert got == {x: i for i, x in enumerate(sorted(names, key=str.encode))}
    assert F.lit(1) is not None
