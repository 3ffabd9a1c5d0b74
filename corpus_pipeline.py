"""From raw documents to packed training sequences, stage by stage.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame. Its
result is written as Parquet and read again as the next stage's documents, so a
lost executor never reaches back over a stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caregap.llm import decontamination, language_id, line_dedup, near_dedup, packing
from caregap.llm.common import DOCUMENT_COLUMNS, table
from caregap.session import apply_defaults, materialize

# Texts whose shingle sets are alike to this percentage are near duplicates here; op4 has a limit of its own.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those whose language the model rejects."""
    model = language_id.train(docs.filter(~language_id.held_out()))
    return language_id.keep_accepted(docs.select(*DOCUMENT_COLUMNS), model)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated line chunks out of the texts; every document stays."""
    cleaned = line_dedup.remove_repeated_lines(docs.select(*DOCUMENT_COLUMNS))
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint")).select(*DOCUMENT_COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return near_dedup.one_of_each(docs.select(*DOCUMENT_COLUMNS), NEAR_PERCENT)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of the benchmark."""
    return decontamination.clean_documents(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_lines),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("packing", pack),
]

# Language scores, shingle links and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(apply_defaults(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
