"""The operators of this folder as registered queries: each over its whole table, with production parameters."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograft.llm import (
    bpe, chat, conversation_repair, conversation_trie, crf, decontaminate, fingerprints, langid, ngram_join, pages, passages, quality,
    token_counts,
)
from lograft.llm.common import crc_mod, documents, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir))


def tokenizer(name: str) -> str:
    """The content of a public vocabulary file."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op2_bpe_encoding_and_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs, crc_mod(F.col("doc_id"), 5) != 0)
    held = (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out")
    return langid.predict(docs, model).select("doc_id", held, "lang_pred", "score", F.size("spans").alias("n_spans"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text, and the places that were cut."""
    return passages.deduplicate(documents(spark, sf_dir).select("doc_id", "text"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = crc_mod(F.col("doc_id"), 4) == 2
    field = crf.train(docs, table(spark, sf_dir, "labels"), ~held)
    return crf.score(docs, field).select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(documents(spark, sf_dir), n=3, percent=90)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and number -7, whose texts are control strings."""
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(own)
    return chat.digests(chat.format_conversations(rows))


def op11_conversation_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given conversations, damaged by rule and repaired."""
    rows = table(spark, sf_dir, "conversations")
    found = conversation_repair.repair(conversation_repair.damage(rows))
    told = found.conversations().withColumnRenamed("conv_id", "_conv")
    shas = conversation_repair.digests(found.turns()).withColumnRenamed("conv_id", "_sha_of")
    ids = rows.select("conv_id").distinct()
    whole = ids.join(told, ids["conv_id"].eqNullSafe(told["_conv"]), "left").join(shas, ids["conv_id"].eqNullSafe(shas["_sha_of"]), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes over all conversations, rebuilt by rule so that they share first turns."""
    found = conversation_trie.sequences(table(spark, sf_dir, "conversations"))
    return conversation_trie.nodes(conversation_trie.rebuild(found))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document beside its edited text and the next document."""
    return fingerprints.compare(documents(spark, sf_dir))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_bpe_encoding_and_decoding": op2_bpe_encoding_and_decoding,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_language_id": op4_language_id,
    "op5_html_extraction": op5_html_extraction,
    "op6_token_counts": op6_token_counts,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_conversation_structure_repair": op11_conversation_structure_repair,
    "op12_conversation_prefix_trie": op12_conversation_prefix_trie,
    "op13_document_fingerprints": op13_document_fingerprints,
}
