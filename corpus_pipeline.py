"""From documents to packed training sequences: stages that each call one operator of ``tidewatch.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm import jaccard, mixing, packing, quality, secrets
from tidewatch.llm.common import bounded_batches, fold, table, unused
from tidewatch.session import stage

#: No SQL can train and apply the classifier; tests compare every stage with a plain version of itself.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts.  It learns from labelled documents outside fold 1 of 3."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter(fold(F.col("doc_id"), 3) != 1)
    score = unused(docs.columns, "_score")
    scored = quality.with_text_score(docs, quality.train_on_texts(docs, labels), score)
    return scored.filter(F.col(score) >= 0.5).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one that names its component.

    Near duplicates share five-word shingles with a similarity of 0.8 or more.
    """
    bounded_batches(spark)
    return jaccard.representatives(docs, k=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is replaced by a marker."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target proportions: a row per document and reading."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    import public_tokenizers

    bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("secret scans", without_secrets),
    ("mixing sources", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table that the next stage reads."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
