"""A corpus from raw documents to training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the
last return the columns of ``documents``; the last returns pieces with their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import best_fit_packing, line_dedup, near_copies, source_mixing, toxicity
from tablewright.llm.common import removed, stored, table, tokenizer_path


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled ones finds toxic go."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more go where they occur again; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs).select("row.*")
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five-word shingles at similarity 0.8, stays."""
    return near_copies.first_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return source_mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return best_fit_packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic_documents),
    ("line_dedup", repeated_lines),
    ("simhash_dedup", near_duplicates),
    ("source_mixing", mix),
    ("best_fit_packing", sequences),
]

#: Models, hashes and packing can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two is written to the checkpoint folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir))
        if before:
            removed(spark, before)
        before = path
    out = STAGES[-1][1](spark, docs, sf_dir)
    # packing has cut its lineage: the result no longer reads the last table
    removed(spark, before)
    return out
