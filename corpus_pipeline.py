"""The corpus pipeline: quality, exact copies, near copies, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repolens.llm import exact_dedup, mixing, near_dedup, packing, quality
from repolens.llm.common import documents, materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is likelier above the lowest than not stay."""
    return quality.filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    return near_dedup.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, evenly over domains, languages and sources as far as they reach."""
    return mixing.select_mixture(docs, 0.9)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack(materialize(packing.document_pieces(docs), "pieces"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("pack", pack),
]

#: Learned grades, similarity components and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
