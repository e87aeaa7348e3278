"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamframe.llm import bayes_jaccard, chat_format, chunked_bpe, collocations, cross_parsing, exact_dedup, merkle_manifest, multi_index_hashing, packing, tag_path_extract, token_rollup, toxicity, url_reputation
from beamframe.llm.common import scratch_path, table


def op1_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_parsing.identify_languages(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe -7, each turn told as a log of streamed, edited and regenerated
    messages that is folded again."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return chat_format.format_digests(chat_format.streamed_events(turns.unionByName(chat_format.probe_conversation(spark))))


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index_hashing.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes_jaccard.similarity_classes(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return url_reputation.judge_urls(table(spark, sf_dir, "pages"), url_reputation.outcomes_from_labels(labels))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_bpe.encode_digests(table(spark, sf_dir, "documents"))


def op2_dp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted with rough counts, revised to true ones, and what was inserted under
    another version deleted again; a batch delivered twice changes nothing."""
    store = token_rollup.TokenRollup(spark, scratch_path(spark, "token-rollup"))
    return token_rollup.maintain(store, table(spark, sf_dir, "documents"), "word_bpe_49k")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.verify_manifest(table(spark, sf_dir, "documents"))


def op12_tag_path_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_path_extract.extract_pages(table(spark, sf_dir, "pages"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_cross_parsing": op1_cross_parsing,
        "op2_dp_packing": op2_dp_packing,
        "op3_chat_format": op3_chat_format,
        "op4_multi_index_hashing": op4_multi_index_hashing,
        "op5_bayes_jaccard": op5_bayes_jaccard,
        "op6_url_reputation": op6_url_reputation,
        "op7_chunked_bpe": op7_chunked_bpe,
        "op8_toxicity": op8_toxicity,
        "op9_token_rollup": op9_token_rollup,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_tag_path_extract": op12_tag_path_extract,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_url_reputation": url_reputation.ORACLE_SQL,
        "op10_exact_dedup": exact_dedup.ORACLE_SQL,
        "op11_merkle_manifest": merkle_manifest.ORACLE_SQL,
        "op13_collocations": collocations.ORACLE_SQL,
    }
