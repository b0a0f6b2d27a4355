"""The pipeline against a brute-force version of each stage, and the registered queries."""

import hashlib
import random

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as P
from haggle.llm.langid import identify, train
from tests.llm.conftest import SCHEMA, lower, words
from tests.llm.test_dedup import brute_components
from tests.llm.test_winnow_mix import brute_targets

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert names["pipeline"] is P.run and 4 <= len(P.STAGES) <= 5


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(3).select(F.lit(10**6) + F.col("doc_id"), F.upper("text"), "lang", "source", "n_chars")
    junk = spark.createDataFrame([(10**7, "12 345 !!", "en", "src0", 9), (10**7 + 1, None, "en", "src1", None)], docs.schema)
    current = docs.unionAll(extra.toDF(*docs.columns).withColumn("doc_id", F.col("doc_id").cast("long"))).unionAll(junk)
    current = current.cache()
    for i, (name, stage) in enumerate(P.STAGES):
        before = [tuple(r) for r in current.collect()]
        result = stage(spark, current, SF).cache()
        after = [tuple(r) for r in result.collect()]
        if i < 4:
            assert result.columns == docs.columns
        if i == 0:
            judged = identify(current, train(current)).collect()
            assert sorted(r.doc_id for r in judged if r.lang_pred != "und" and r.score >= P.MIN_COSINE) == sorted(
                r[0] for r in after)
            assert 10**7 not in {r[0] for r in after} and len(after) >= len(before) - 3
        elif i == 1:
            keep = {}
            for r in before:
                keep[lower(r[1])] = max(r, keep.get(lower(r[1]), r))
            assert sorted(after) == sorted(keep.values())
        elif i == 2:
            names = brute_components([(r[0], r[1]) for r in before])
            assert sorted(after) == sorted(r for r in before if names[r[0]] == r[0])
        elif i == 3:
            sizes = {}
            for r in before:
                sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
            target = brute_targets(sizes, (3, 1, 2), 1.5, 2)
            taken = dict.fromkeys(sizes, 0)
            for r in after:
                taken[r[3]] += len(words(r[1]))
            assert set(after) <= set(before) and all(after.count(r) <= 2 for r in set(after))
            assert abs(sum(taken.values()) - sum(target.values())) < 0.1 * sum(target.values())
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            want = []
            for r in before:
                ids = library.encode(r[1], add_eos=True)
                want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                             hashlib.sha256(library.decode(ids).encode()).hexdigest(), len(r[1].encode())))
            assert sorted(after) == sorted(want)
        current = result


def test_short_clean_texts_stay_and_unlearnt_languages_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    rng = random.Random(3)
    clean = ["Avec.", "A.", "I", "\u6f22", "a b c", "A.\nAll rights reserved.", "Von.", "oui", "The end."]
    unlike = [
        "La lingua italiana \u00e8 una lingua romanza parlata principalmente in Italia. Il presidente della repubblica ha "
        "detto che la situazione economica del paese \u00e8 migliorata negli ultimi mesi, ma che rimangono ancora molti "
        "problemi da risolvere.",
        "De Nederlandse taal wordt gesproken door ongeveer vierentwintig miljoen mensen. Het weer is vandaag erg mooi en wij "
        "gaan naar het strand om te zwemmen en te spelen met de kinderen van onze buren.",
        "Suomen kieli on uralilainen kieli, jota puhutaan p\u00e4\u00e4asiassa Suomessa. T\u00e4n\u00e4\u00e4n on kaunis p\u00e4iv\u00e4 ja me "
        "menemme rannalle uimaan yst\u00e4viemme kanssa, koska aurinko paistaa l\u00e4mpim\u00e4sti.",
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(300))]
    planted = [(10**7 + i, t, None, "src0") for i, t in enumerate(clean + unlike)]
    planted = spark.createDataFrame(planted, docs.schema)
    kept = {r.doc_id for r in P.language_identification(spark, docs.unionAll(planted), SF).select("doc_id").collect()}
    assert {i for i in kept if i >= 10**7} == {10**7 + i for i in range(len(clean))}
    lettered = {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))}
    assert len(lettered - kept) <= len(lettered) // 200


def test_run(spark):
    rows = P.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_covered"] and rows.count() > 50


def test_stages_awkward(spark, small_docs):
    docs = spark.createDataFrame(small_docs, SCHEMA)
    empty = docs.limit(0)
    for i, (_, stage) in enumerate(P.STAGES):
        assert stage(spark, empty, SF).collect() == []
        out = stage(spark, docs.withColumn("score", F.lit("x")), SF)
        if i < 4:
            assert out.columns == [*docs.columns, "score"]
        assert out.count() > 0
