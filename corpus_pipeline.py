"""A training-data pipeline over `documents`: five stages, each written as Parquet and read by the next.

1. language: rows that language identification rejects go.
2. near_dedup: of each group of near duplicates the row with the smallest doc_id stays.
3. substring_dedup: words of windows that start earlier elsewhere are cut out.
4. decontaminate: rows with benchmark passages go.
5. tokenize: byte-level BPE ids of the remaining texts, decoded again and compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelens.llm import bpe, decontaminate, language, near_dedup, substring_dedup
from curvelens.llm.common import recorded, removed, shared_path, table

#: Tables that near_dedup has stored; when the next stage begins, its output is written and they go.
_TABLES: list[str] = []


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    removed(spark, _TABLES)
    with recorded(_TABLES):
        return near_dedup.drop_near_duplicates(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    removed(spark, _TABLES)
    return substring_dedup.remove_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with n_tokens, token_ids and round_trip: decoding gives the text back."""
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = bpe.decode(bpe.encode(docs, ranks), ranks, into="__decoded")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select(*docs.columns, F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", (F.col("__decoded") == text).alias("round_trip"))


STAGES = [
    ("language", known_language),
    ("near_dedup", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("decontaminate", without_benchmark),
    ("tokenize", tokenized),
]

#: SQL cannot express the stages; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
