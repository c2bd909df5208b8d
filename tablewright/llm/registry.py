"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import best_fit_packing, document_fingerprints, line_dedup, oracles, secret_scan, sharding, simhash_dedup, source_mixing, token_counts, topk_search, toxicity
from .common import table, tokenizer_path


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(oracles.TOKENS))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "row.text", "n_words", "n_removed")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_topk_search": op3_topk_search,
    "op4_token_counts": op4_token_counts,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_secret_scan": op6_secret_scan,
    "op7_sharding": op7_sharding,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_source_mixing": op10_source_mixing,
}

#: The others can't be told in SQL, and are held against brute force in the tests.
ORACLE_SQL: dict[str, str] = {
    "op3_topk_search": oracles.TOP_K,
    "op4_token_counts": oracles.COUNTS,
    "op6_secret_scan": oracles.SECRETS,
    "op9_line_dedup": oracles.LINES,
    "op10_source_mixing": oracles.MIX,
}
