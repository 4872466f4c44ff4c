"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

All stages but the last return the columns of ``documents``. Between stages the documents are written as
Parquet to the shared checkpoint folder and read again, so a lost executor costs one stage's work at most. A
stage's files go once the next one has been written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from voxelspark.llm.decontaminate import clean_of
from voxelspark.llm.minhash import keep_one_of_each
from voxelspark.llm.mixing import mixture
from voxelspark.llm.quality import good_documents
from voxelspark.llm.tables import table
from voxelspark.llm.toxicity import clean_documents
from voxelspark.plans.lineage import ensure_checkpoint_dir, remove


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return clean_documents(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted bad go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return clean_of(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken: doc_id, size, source_size, target, taken, copies."""
    return mixture(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]

#: The classifiers and the draws of the mix are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    place = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        if before:
            remove(spark, f"{place}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
