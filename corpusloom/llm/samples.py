"""Labelled samples for the trained operators, bounded by a parameter, the same at every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.storage import materialize

#: A classifier is fitted on at most this many labelled rows.
FIT_ROWS = 24_000
#: The label model of weak supervision sees at most this many rows besides, without their labels.
UNLABELLED_ROWS = 8_000


def remainder(folds: int) -> Column:
    """crc32 of the document id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int = FIT_ROWS) -> DataFrame:
    """text and label of at most ``rows`` labelled documents outside the held-out fold, taken in the order of a hash.

    A document labelled more than once counts once, by its largest label. Only the chosen ids and labels
    are broadcast (``rows`` of them at most).
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(remainder(folds) != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit("fit"), "doc_id"), "doc_id").limit(rows)
    return materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label"), f"sample-{label}")


def unlabelled(docs: DataFrame, folds: int, held: int, rows: int = UNLABELLED_ROWS) -> DataFrame:
    """text of at most ``rows`` documents outside the held-out fold, whether labelled or not, taken in the order of a hash."""
    known = docs.select("doc_id").where(F.col("doc_id").isNotNull() & (remainder(folds) != held)).distinct()
    chosen = known.orderBy(F.xxhash64(F.lit("more"), "doc_id"), "doc_id").limit(rows)
    return materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text"), "sample-unlabelled")
