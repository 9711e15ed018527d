"""The corpus pipeline: five stages from documents to a training mix, each by one operator of ``corpusloom.llm``.

Defined cases of every stage: an empty table goes through as an empty table of the same columns. Null and empty texts are documents: the classifier
judges them like any others, they link with nothing, hold no benchmark item and no secret, and have size 0. Very long texts are read whole.
Repeated rows of a doc_id are one document from the second stage on; rows with a null doc_id are kept each for itself. Of equal documents the
smallest doc_id stays. Extra columns, whatever their names, come through the first four stages unchanged; in the last, those
named like a column of the mix give way to it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontamination, jaccard, mixing, quality, secrets
from corpusloom.storage import materialize, shared_dir


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on those of them that have labels, doesn't reject."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised ones included."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind."""
    return secrets.redacted(docs, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Taken words, training positions and texts of all documents, in training order."""
    return mixing.mix(docs, carry=True)


STAGES = [
    ("quality classifier", keep_good_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs


#: Trained models and iterative classes: not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None
