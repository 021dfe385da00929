"""Bounded training samples of labelled documents, shared by the two learned scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import checkpoint, text_or_empty

FOLDS = 5


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``FOLDS``: rows with 0 are held out of every fit."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS, F.lit(0))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, label): at most ``most`` labelled, not held-out documents, chosen by a hash of their id.

    Ids that carry several different labels are left out. The bound makes the id table small enough
    to broadcast, whatever the size of the corpus.
    """
    known = labels.where(F.col(label).isin(0, 1)).where(fold() != 0)
    known = known.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "label")
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    return checkpoint(rows.select("text", F.col("label").cast("int").alias("label")))
