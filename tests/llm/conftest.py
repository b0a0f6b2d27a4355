import random

import pytest


@pytest.fixture(scope="session")
def small_docs(spark):
    """A small table with the awkward cases: nulls, empty and long texts, repeats, clashing column names."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(400)]

    def text(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    base = text(120)
    near = base.split()
    near[60] = "changed"
    rows = [(i, text(rng.randint(6, 60)), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100, base, "en", "s0"), (101, " ".join(near), "en", "s1"), (102, base.upper(), "en", None),
             (103, None, None, None), (104, "", "en", "s1"), (105, " \t\n ", "en", "s2"), (106, "one two", "de", "s2"),
             (107, "One  TWO", "de", "s0"), (108, text(30000), "en", "s0"), (109, "a\x0bb\x0cc d e f g", "en", "s1"),
             (110, "naïve Ünïcode ÀÉ – 漢字 🙂 text with marks", "fr", "s1"),
             (111, "naïve ünïcode ÀÉ – 漢字 🙂 text with marks", "fr", "s1"), (112, "12 34 !!", "en", "s2"),
             (100, base, "en", "s0"), (113, "<s> </s> <|endoftext|> ▁ x", "en", "s0"), (None, "text without an id", "en", "s1")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def awkward(spark, small_docs):
    """The table above with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(small_docs, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("row", "id", "digest", "maybe", "keep", "h", "size", "taken", "pattern",
                                                   "hit", "score", "n", "rep", "key", "component", "sketch")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    """A-Z only."""
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return lower(text).encode().split()
