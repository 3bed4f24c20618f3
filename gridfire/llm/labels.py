"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are in no fold."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds


def training_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``y``, ``text``) of at most ``rows`` labelled ids for which ``train`` holds, one text for each.

    The sample is those with the smallest hash of the id, so it is the same in every run. Ids and labels only are
    sorted and sent to the tasks, ``rows`` of them at most. Null labels are left out; of labels that differ the
    largest counts. Of the texts of a repeated id the smallest counts, so the sample is bounded whatever repeats.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & train).groupBy(F.col(id_col).alias("id_")).agg(F.max(label).cast("int").alias("y"))
    picked = known.orderBy(F.xxhash64("id_"), "id_").limit(rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_"), text_of(text_col).alias("text"))
    return texts.join(F.broadcast(picked), F.col("doc_") == F.col("id_")).groupBy("id_", "y").agg(F.min("text").alias("text")).select("y", "text")
