"""Registered queries of the operators: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haggle.llm.near_dedup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=0.75, width=5)


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from haggle.llm.langid import fold, identify, train
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn(
        "held_out", fold(F.col("doc_id"), 4) == 2)
    prototypes = train(docs.where("not held_out"))
    return identify(docs.select("doc_id", "text", "held_out"), prototypes).drop("text")


@query
def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haggle.llm.winnow import compare_neighbours
    return compare_neighbours(table(spark, sf_dir, "documents"))


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from haggle.llm.pieces import digest_documents
    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from haggle.llm.html_text import extract_text
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages, out="text").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from haggle.llm.spark import shared_path
    from haggle.llm.token_files import ids_crc32, read_token_files, write_token_files
    path = shared_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path, end_id=2)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", ids_crc32("ids").alias("ids_crc32"))


@query
def op7_neural_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from haggle.llm.langid import fold
    from haggle.llm.neural_lm import score_documents
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), 7) == 2)
    return score_documents(docs, docs.where("not held_out"), "held_out")


@query
def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haggle.llm.urls import ALLOW, BLOCK, judge_urls, rule_table
    rules = rule_table(spark, [(BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/")])
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haggle.llm.mixing import mix_report
    return mix_report(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, limit=2.0, repeats=2)


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haggle.llm.exact_dedup import exact_groups
    return exact_groups(table(spark, sf_dir, "documents"))


@query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haggle.llm.spark import remove, shared_path
    from haggle.llm.warc import normalise, read_records, write_archives
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), f"{path}/monolithic", least=100)
    normalise(spark, f"{path}/monolithic", path)
    remove(spark, [f"{path}/monolithic"])
    return read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from haggle.llm.hard_negatives import hard_negatives
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(
        F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, high=100, scale=256)


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haggle.llm.collocations import collocations
    return collocations(table(spark, sf_dir, "documents"), least=100, longest=5, most=2000)
