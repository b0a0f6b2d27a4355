"""From raw documents to token ids: the stages of a training-corpus pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and gives the written table to the next
stage, so a lost executor never costs more than the current stage.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haggle.llm.exact_dedup import drop_exact_copies
from haggle.llm.langid import CHANCE, UNDETERMINED, above_floor, identify, learn_floors, train
from haggle.llm.mixing import mixed_documents
from haggle.llm.near_dedup import near_duplicates
from haggle.llm.pieces import digest_documents
from haggle.llm.spark import BROADCAST_ROWS, shared_path, unused_name

# What an unrelated text's cosine with one prototype stays under (two standard
# deviations).  No floor of language_identification lies below it.
MIN_COSINE = 2 * CHANCE


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled documents show.  Out
    go those without a letter, and those unlike every language: their cosine is
    under a floor that the labelled documents of their length teach
    (``learn_floors``).  Texts too short to be judged stay.  Without any label
    nothing can be told and all lettered documents go.  Every text is scored
    once: the scored documents are written, the floors are learnt from that
    table and applied to it."""
    columns = docs.columns
    pred, score, grams = (unused_name(docs, n) for n in ("pred", "score", "grams"))
    prototypes = train(docs)
    path = shared_path(spark, "scored")
    scored = identify(docs, prototypes, lang_out=pred, score_out=score, grams_out=grams)
    scored.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(scored.schema).parquet(path)
    floors = learn_floors(found, "lang", pred, score, grams, len(prototypes))
    return found.where((F.col(pred) != UNDETERMINED) & above_floor(
        floors, sorted(prototypes), pred, score, grams)).select(*columns)


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased; null counts as empty) the row with the largest doc_id."""
    return drop_exact_copies(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id, of each group of linked
    documents.  Documents without words have no link and stay."""
    gone = near_duplicates(docs, threshold=0.75, width=5).where("not kept").select("doc_id").distinct()
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of 150 % of all words by weights 3, 1, 2 over the sources: each
    document as often as it is taken (0, 1 or 2 times)."""
    return mixed_documents(docs, weights=(3, 1, 2), share=1.5, limit=2.0, repeats=2)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix: doc_id, n_tokens, ids_sha256, decoded_sha256, n_covered."""
    return digest_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_identification", language_identification),
    ("exact_deduplication", exact_deduplication),
    ("near_deduplication", near_deduplication),
    ("source_mixing", source_mixing),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

# The first stage compares texts with learnt vectors and the fourth draws by a
# hash: SQL can't express run(); tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = shared_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
