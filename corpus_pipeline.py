"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents the one before it kept and returns documents with the same columns; the
last returns pieces of packed sequences. ``run`` writes a table between stages in the shared folder,
so a lost executor repeats tasks of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import line_templates, packing, pii, quality, simhash
from textloom.scale import settle
from textloom.session import ship

VOCABULARY = "byte_bpe_50k.json"


def _recount(docs: DataFrame) -> DataFrame:
    """``n_chars`` of texts that a stage has changed, where the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table accepts."""
    return quality.keep_good(docs, "text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later lines of templates that recur across different texts."""
    return _recount(line_templates.drop_recurring(docs, "doc_id", "text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles, four fifths of them in common."""
    ship(spark)
    return simhash.keep_similar(docs, "doc_id", "text")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    ship(spark)
    return _recount(pii.redact(docs, "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token numbers."""
    ship(spark)
    tokens = packing.load_tokens(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return packing.pack(docs, "doc_id", "text", tokens, keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("personal data", personal_data),
    ("packing", pack),
]

# Tokens, fingerprints and the fitted field cannot be said in SQL; tests/llm holds a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all packed sequences made from ``documents``."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
