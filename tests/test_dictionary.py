"""Dictionaries and look-ups by distinct word, against plain Python."""
import random

import pytest
from pyspark.sql import functions as F

from haggle.operators import dictionary as D
from haggle.operators import extract as E

SCHEMA = "id long, words array<string>"


def texts(n=200, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "漢", "", " ", "a,b", '"q"', "Z"]
    rows = [(i if i % 4 else None, [rng.choice(vocab[: rng.randint(1, len(vocab))]) for _ in range(rng.randint(0, 20))]) for i in range(n)]
    rows += [(1, None), (None, None), (1, []), (1, ["w0"] * 500), (2, [None, "w1", None])] + [(7, ["hot", "text"])] * 90 + [(None, None)] * 50
    return rows


@pytest.fixture(params=[1000, 20])
def heavy(request, monkeypatch):
    monkeypatch.setattr(D, "HEAVY_SHARE", request.param)  # 20: many words and texts are light, some heavy


def test_dense_ids_in_word_order(spark):
    df = spark.createDataFrame(texts(), SCHEMA).repartition(6)
    got = [tuple(r) for r in D.build_dictionary(df, F.col("words")).collect()]
    flat = [w for _, ws in texts() for w in ws or [] if w is not None]
    want = [(w, i, flat.count(w)) for i, w in enumerate(sorted(set(flat), key=lambda w: w.encode()))]
    assert sorted(got, key=lambda r: r[1]) == want
    assert D.build_dictionary(spark.createDataFrame([], SCHEMA), F.col("words")).count() == 0


def test_encode_and_decode(spark, heavy):
    df = spark.createDataFrame(texts(), SCHEMA)
    d = D.build_dictionary(df, F.col("words"))
    ids = {r.word: r.id for r in d.collect()}
    enc = D.encode(df, "words", d)
    key = lambda r: str(r)
    got = sorted(((r.id, r.words, r.ids) for r in enc.collect()), key=key)
    assert got == sorted(((i, ws, ws and [ids.get(w) for w in ws] if ws is not None else None) for i, ws in texts()), key=key)
    back = D.decode(enc.drop("words"), "ids", d).collect()
    assert sorted(((r.id, r.words) for r in back), key=key) == sorted(texts(), key=key)


def test_replace_words(spark, heavy):
    table = [("w1", "one"), ("w1", "eins"), ("hot", "cold"), (None, "never"), ("unused", "x"), ("w2", None)]
    values = {"w1": "eins", "hot": "cold"}
    df = spark.createDataFrame(texts(), SCHEMA).withColumn("_value", F.lit(1))
    out = D.replace_words(df, "words", spark.createDataFrame(table, "word string, value string"), "new").collect()
    assert len(out) == len(texts())
    for r in out:
        assert r.new == (None if r.words is None else [values.get(w, w) for w in r.words])


def test_one_lookup_per_distinct_word_of_a_text(spark):
    df = spark.createDataFrame([(i, ["a"] * 1000 + ["b"]) for i in range(50)], SCHEMA)
    table = spark.createDataFrame([("a", "x")], "word string, value string")
    D.replace_words(df, "words", table, "new").collect()
    from haggle.sources import io
    written = next(p for p in reversed(io._written) if "/words-" in p)
    assert spark.read.parquet(written).count() == 2  # one text, two distinct words


def test_normalize_and_strip(spark, heavy):
    lem = spark.createDataFrame([("cats", "cat"), ("cats", "cat"), ("ran", "run"), (None, "x")], "word string, lemma string")
    t = spark.createDataFrame([(1, "The CATS, ran!"), (1, "cats cats"), (None, "Ran"), (None, None), (3, "!")], "id long, text string")
    got = sorted(((r.id, r.text, r.norm) for r in E.normalize_text(t, lemmas=lem).collect()), key=str)
    assert got == sorted([(1, "The CATS, ran!", "the cat run"), (1, "cats cats", "cat cat"), (None, "Ran", "run"), (None, None, None), (3, "!", "")], key=str)
    df = spark.createDataFrame([(1, [9, 9, 10, 77, 10, 9, 9]), (1, [9, 9, 10, 9, 9]), (None, None), (2, [1])], "id long, tokens array<int>")
    vocab = spark.createDataFrame([(10, "ab"), (10, "ab"), (9, "no")], "token int, piece string")
    got = sorted(((r.id, r.stripped, r.stripped_text) for r in E.strip_markers(df, vocab=vocab).collect()), key=str)
    assert got == sorted([(1, [10, 77, 10], "abab"), (1, [10], "ab"), (None, None, None), (2, [], "")], key=str)
