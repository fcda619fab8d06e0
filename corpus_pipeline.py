"""The training-data pipeline: stages applied to ``documents`` one after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glosswork.llm import bpe, decontaminate, exact_dedup, jaccard_join, quality
from glosswork.llm.common import table
from glosswork.session import configure, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Near copies: five-word shingles, similarity of 0.8 or more.
NEAR = jaccard_join.Threshold(words=5, num=80, den=100)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It is fitted on labels of ``documents``."""
    configure(spark)
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space."""
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return jaccard_join.drop_near_copies(docs, NEAR)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    return bpe.encode(docs, bpe.public_vocabulary()).selectExpr("doc_id", "length(ids) div 4 AS n_tokens", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_exact),
    ("jaccard_join", drop_near),
    ("decontamination", drop_leaked),
    ("bpe_encoding", tokenize),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
