"""Held-out folds and bounded samples of labelled documents.

A classifier is fitted on a sample whose bound is a parameter, so what reaches the driver does not grow with
the data: ids are ordered by a hash, and the first ones of the training fold are taken. Everything counted
over the corpus is counted over all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_labels(labels: DataFrame, column: str, folds: int, fold: int) -> DataFrame:
    """(doc_id, label) outside the held-out fold: one row per id, the larger label where rows disagree; null labels are none."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    rows = rows.where("doc_id is not null and label is not null").where(~in_fold(F.col("doc_id"), folds, fold))
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def first_by_hash(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n rows, by a hash of doc_id."""
    return rows.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)


def texts_for(ids: DataFrame, docs: DataFrame, bound: int) -> DataFrame:
    """The texts of at most ``bound`` sampled ids; the ids, being that few, are what is broadcast."""
    return docs.join(F.broadcast(ids.limit(bound)), "doc_id")
