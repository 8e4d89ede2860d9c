"""Labelled rows for the classifiers: folds, bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, text, y) of the chosen labels' documents; of rows that repeat an id the one with the least text, so that the sample is the same every time."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id, as text, leaves that remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def training_labels(labels: DataFrame, column: str, folds: int, fold: int, most: int, balanced: bool = False) -> DataFrame:
    """(doc_id, y) outside the held-out fold, at most `most` rows, the first in the order of a hash of the id.

    A doc_id with several labels gets their majority, ties 1. Null ids and labels are left out. balanced: at most half of
    `most` rows of each label.
    """
    rows = labels.select("doc_id", F.col(column).cast("double").alias("y")).where("doc_id is not null and y is not null")
    rows = rows.where(~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    order = F.xxhash64(F.lit(column), "doc_id")
    if not balanced:
        return rows.orderBy(order).limit(most)
    return rows.where("y = 1").orderBy(order).limit(most // 2).unionByName(rows.where("y = 0").orderBy(order).limit(most // 2))
