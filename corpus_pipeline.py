"""From raw documents to packed training sequences, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns documents that are written and
read again as the next stage's docs; the last returns pieces in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import line_dedup, near_dedup, packing, quality_rules, secrets
from tidemark.llm.queries import tokenizer_path
from tidemark.session import materialize


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (operator 9)."""
    return quality_rules.keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines (operator 3)."""
    return line_dedup.delete_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (operator 5)."""
    return near_dedup.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked, also those under nested encodings (operator 1)."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens (operator 8)."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), 2048, 0)


STAGES = [
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]

#: Signatures, tokenisers and packing are beyond SQL; a test holds the whole run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
