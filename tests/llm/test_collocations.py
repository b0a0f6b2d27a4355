import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from haggle.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, longest=5, most=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i: i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        cand = {g: a for g, a in counts.items() if 2 <= len(g) <= longest and a >= least}
        inside = defaultdict(int)  # the highest count of any longer candidate that holds a phrase
        for g, a in cand.items():
            for i in range(len(g)):
                for j in range(i + 2, len(g) + 1):
                    if j - i < len(g):
                        inside[g[i:j]] = max(inside[g[i:j]], a)
        rows_ = []
        for g, a in cand.items():
            if 100 * inside[g] >= 100 * a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            rows_.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (s, a, g, l, r) in enumerate(sorted(rows_)[:most], 1):
            out.append((lang, rank, g.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(25)] + ["É", "漢字", "a\x01", "a", "a\x00b", "naïve", "<s>"]
    idioms = [["once", "Upon", "a", "time", "there"], ["New", "york"], ["new", "york", "city"], ["ha"] * 9, ["a", "b"]]
    rows = []
    for i in range(160):
        words = []
        for _ in range(rng.randint(0, 60)):
            words += rng.choice(idioms) if rng.random() < 0.25 else [rng.choice(vocab[: rng.randint(2, len(vocab))])]
            words[-1:] = [words[-1] + rng.choice(["", "", "", "", ".", ",", "?!", "\n"])] if words else []
        rows.append((i, rng.choice([" ", "  ", "\t"]).join(words), rng.choice(["en", "en", "de", None, "und", "x"])))
    rows += [(200, None, "en"), (201, "", None), (202, " \t\n. ;", "de"), (203, "word " * 40_000, "long"), (None, rows[3][1], "en"),
             (3, rows[3][1], rows[3][2]), (204, "X\x0bY\x0cZ\rX Y", "en")]
    return rows


def mined(df, **more):
    return sorted(tuple(r) for r in C.collocations(df, **more).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("x") for c in ("phrase", "words", "a", "n", "l", "r", "ext", "score", "rank", "k")})


@pytest.mark.parametrize("least,ranges,slice_bytes", [(5, 200_000, 8 << 20), (5, 7, 300), (12, 40, 5000), (1, 1000, 3000)])
def test_against_brute_force(spark, monkeypatch, least, ranges, slice_bytes):
    """Also with many small ranges (so that most start amid their prefixes) and small slices."""
    rows = corpus()[: 60 if least == 1 else None]
    want = brute(rows, least)
    assert len(want) > 20
    monkeypatch.setattr(C, "RANGE_ROWS", ranges)
    monkeypatch.setattr(C, "SLICE_BYTES", slice_bytes)
    assert mined(frame(spark, rows).repartition(4), least=least) == want


def test_a_full_map_only_costs_time():
    """Counts are the same where every word and pair seems frequent."""
    rows = corpus()[:50]
    texts = [(r[1] or "").encode() for r in rows]
    import numpy as np
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([b"en"] * len(rows), pa.binary()), pa.array(texts, pa.binary())], ["lang", "text"])
    full = np.array([255], np.uint8)
    got = Counter()
    for out in (*C.count_pairs(iter([batch]), full), *C.count_longer(iter([batch]), full, full, 5)):
        for key, n in zip(out.column("key").to_pylist(), out.column("n").to_pylist()):
            got[key.removesuffix(b"\ten")] += n
    want = Counter()
    for text in texts:
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", text.lower()):
            w = re.findall(rb"[^\x20\x09]+", piece)
            want.update(b" ".join(w[i: i + m]) for m in range(2, 6) for i in range(len(w) - m + 1))
    assert got == want


def test_first_of_each_language(spark):
    rows = corpus()
    want = brute(rows, 5, most=3)
    assert mined(frame(spark, rows), least=5, most=3) == want and {r[0] for r in want} >= {"en", "de", "und"}


def test_shorter_phrases_only(spark):
    assert mined(frame(spark, corpus()), least=5, longest=2) == brute(corpus(), 5, longest=2)


def test_empty_table(spark):
    assert mined(spark.createDataFrame([], SCHEMA), least=1) == []
    assert mined(spark.createDataFrame([(1, None, None), (2, "", "en")], SCHEMA), least=1) == []


def test_products_past_64_bits(spark):
    row = spark.sql("select 90000000000000000L as a, 99999999999999999L as n, 90000000000000000L as l, 99999999999999998L as r")
    got = row.select(C._score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).first()[0]
    assert got == 1000 * 90000000000000000 * 99999999999999999 // (90000000000000000 * 99999999999999998)


def test_merge_gives_parts_and_extensions():
    counts = {(b"a",): 9, (b"a", b"b"): 7, (b"a", b"b", b"c"): 7, (b"a", b"c"): 2, (b"b",): 8}
    rows = [(b"en", list(g), n) for g, n in sorted(counts.items())]
    whole = {tuple(w): (a, parts, ext) for _, w, a, parts, ext in C.merge_stream(iter(rows), [])}
    assert whole[(b"a", b"b", b"c")] == (7, [9, 7], 0) and whole[(b"a", b"b")] == (7, [9], 7) and whole[(b"a",)] == (9, [], 7)
    late = {tuple(w): (a, parts, ext) for _, w, a, parts, ext in C.merge_stream(
        iter(rows[2:]), [(b"en", [b"a"], 9), (b"en", [b"a", b"b"], 7)])}
    assert late[(b"a", b"b", b"c")] == (7, [9, 7], 0) and late[(b"a", b"b")] == (None, [9], 7) and late[(b"a",)] == (None, [], 2)
