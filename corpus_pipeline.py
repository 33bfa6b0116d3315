"""A training corpus from raw documents: five stages, each an operator of ``lograft.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. ``run`` writes each
stage's rows as Parquet to the shared folder and reads them again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograft import session
from lograft.llm import bpe, decontaminate, ngram_join, passages, quality
from lograft.llm.common import by_place, documents, table
from lograft.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base check or are judged bad go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets with a similarity of 0.8 or more stays."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; so do documents of which nothing is left. ``n_chars`` follows the text."""
    def cut(docs: DataFrame) -> DataFrame:
        left = passages.deduplicate(docs).where(F.col("text").isNull() | (F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
        return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))

    return by_place(docs, cut, "doc_id", "text", "n_chars")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold question and answer of a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, packed, with digests of them and of the decoded text."""
    keep = ("doc_id", "lang", "source")
    return bpe.encode(docs, tokenizer("word_bpe_49k.json"), keep=keep).select(
        *keep, "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("bpe_encoding_and_decoding", encoding),
]

#: SQL can express neither the groups of near copies nor byte-pair merges; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = f"{session.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
