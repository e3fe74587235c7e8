"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

All but the last keep the columns of ``documents``; rows without a doc_id pass the stages that
decide by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import decontam, mixing, near_dup, quality, token_ids
from foliant.llm.store import Stage

#: Shares of the expected tokens of clean, low-quality and toxic text in what is written.
MIX = (0.985, 0.01, 0.005)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to the labelled ones among them, keeps."""
    return quality.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return near_dup.one_of_each(docs, near_dup.near_duplicates(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each as often as its rate says, for the token shares of ``MIX``.

    The classifier is fitted to the labelled rows of ``documents``, as few of the low-quality and toxic
    domains are left here.  The budget is what keeps the clean domain's tokens as many as they are.
    """
    labels, all_docs = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixing.resampled(docs, mixing.rates(docs, labels, target=MIX, budget=None, train_docs=all_docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in Simple-8b words."""
    return token_ids.packed(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokenize", tokenize),
]
#: SQL can't express the classifiers, the sketches or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table ``documents`` of a folder, a row per copy of a document that
    is left.  Empty tables give no rows; between the stages one table is kept."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            written = Stage(docs, name)
            if before:
                before.drop()
            docs, before = written.df, written
    return docs
