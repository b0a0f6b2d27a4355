"""Dictionaries of distinct words, and look-ups once per distinct word.

A dictionary gives every distinct word of a corpus a dense id, in the order of
the words, and its number of occurrences.  Texts become arrays of ids; tables
about words (lemmas, pieces of a vocabulary) meet the distinct words of a text
instead of every occurrence.

Rows are told apart by their words alone (a digest of the word list), so callers
need no row keys: rows with NULL or repeated keys are as good as any, and equal
texts are looked up once.

Scale.  Occurrences are counted by partial aggregates.  Words (or texts) that
hold over a thousandth of all entries are fewer than a thousand and are joined by
broadcast; the rest meets in a shuffle in which no key is heavy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import written

HEAVY_SHARE = 1000  # a key with over 1/1000 of the entries is heavy; there are fewer than 1000
_ROW_BITS = 33      # row bits of monotonically_increasing_id


def word_counts(df: DataFrame, words: Column) -> DataFrame:
    """(word, n): occurrences of every distinct word of the arrays; NULL words are left out."""
    return df.select(F.explode(words).alias("word")).where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def build_dictionary(df: DataFrame, words: Column) -> DataFrame:
    """(word, id, n) with dense ids from 0 in the order of the words.

    The counted words are sorted over ranges; a row's id is its place in its
    range plus the words of the ranges before (one small row per range).  The
    result is a written table: its ids don't change when it is read again."""
    ranges = word_counts(df, words).repartitionByRange("word").sortWithinPartitions("word")
    placed = written(ranges.withColumn("_at", F.monotonically_increasing_id()), "dictionary")
    placed = placed.select("word", "n", F.shiftright("_at", _ROW_BITS).alias("_range"),
                           F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))  # a row per shuffle partition
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_range").select("word", (F.col("_before") + F.col("_row")).alias("id"), "n")


def _split_join(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame, how: str) -> DataFrame:
    """left joined with right (unique keys) on ``key``; the keys of ``heavy`` (fewer
    than HEAVY_SHARE rows) by broadcast, the others by a shuffle."""
    heavy = F.broadcast(heavy.select(key))
    some = left.join(heavy, key, "left_semi").join(F.broadcast(right.join(heavy, key, "left_semi")), key, how)
    return some.unionByName(left.join(heavy, key, "left_anti").join(right.join(heavy, key, "left_anti"), key, how))


def _over_share(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Keys with more than 1/HEAVY_SHARE of the entries that ``counts`` (key, n) counts."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) * HEAVY_SHARE > F.lit(total)).select(key)


def replace_words(df: DataFrame, words: str, table: DataFrame, out: str, *, word: str = "word", value: str = "value",
                  keep: bool = True) -> DataFrame:
    """df plus ``out``: the array ``words`` with every word's value in its place.

    Words that the table doesn't name stay (``keep``, for values of the words' own
    type) or become NULL.  A word that the table names several times takes its least
    value; NULL words of the table are ignored.  A NULL array gives NULL.

    The distinct words of each distinct array meet the table, once; arrays are
    rebuilt in the row from a map that is no larger than the array."""
    values = table.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("_word")).agg(F.min(value).alias("_value"))
    d = df.withColumn("_text", F.when(F.col(words).isNotNull(), F.md5(F.to_json(words))))
    pairs = written(d.where("_text is not null").select("_text", F.explode(F.array_distinct(words)).alias("_word"))
                     .where("_word is not null").groupBy("_text", "_word").agg(F.count(F.lit(1)).alias("_rows")), "words")
    heavy = _over_share(pairs.groupBy("_word").agg(F.count(F.lit(1)).alias("_n")), "_word", "_n")
    found = _split_join(pairs, values, "_word", heavy, "inner")
    maps = written(found.groupBy("_text").agg(
        F.map_from_entries(F.collect_list(F.struct("_word", "_value"))).alias("_map"), F.max("_rows").alias("_rows")), "maps")
    heavy = maps.where(F.col("_rows") * HEAVY_SHARE > F.lit(df.count()))
    joined = _split_join(d.where("_text is not null"), maps.select("_text", "_map"), "_text", heavy, "left")
    rest = d.where("_text is null").withColumn("_map", F.lit(None).cast(maps.schema["_map"].dataType))
    new = lambda w: F.try_element_at("_map", w)
    return joined.unionByName(rest).withColumn(
        out, F.transform(words, lambda w: F.coalesce(new(w), w) if keep else new(w))).drop("_text", "_map")


def encode(df: DataFrame, words: str, dictionary: DataFrame, out: str = "ids") -> DataFrame:
    """df plus ``out``: the array ``words`` as ids of the dictionary; NULL for words it doesn't have."""
    return replace_words(df, words, dictionary, out, value="id", keep=False)


def decode(df: DataFrame, ids: str, dictionary: DataFrame, out: str = "words") -> DataFrame:
    """The inverse of :func:`encode`; NULL for ids that the dictionary doesn't have."""
    return replace_words(df, ids, dictionary, out, word="id", value="word", keep=False)
