"""Bounds on what one Arrow batch carries to a Python worker."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..plans.shipping import ship

BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """At most ``rows`` rows and about 16 MB in a batch (a single longer row is a batch by itself)."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
