"""Cutting lineage where executors can be lost.

``cut`` writes a DataFrame to the reliable checkpoint folder. The folder is the one the cluster names in
``spark.checkpoint.dir``; only where a session names none (tests, a laptop) a folder of our own is set.
``release`` removes a cut that nothing reads any more, so that rounds do not pile up copies. ``stored`` keeps
a table of many rows in the same folder as parquet, a fraction of a cut's size, for as long as a block lasts.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; sets a temporary one only where none is configured."""
    sc = spark.sparkContext
    if (there := sc.getCheckpointDir()) is not None:
        return there
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="voxelspark-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """The same rows, read back from the reliable checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder by whatever file system its path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(*frames: DataFrame | None) -> None:
    """Removes the files of frames that :func:`cut` returned, once whatever read them has itself been cut or written."""
    for df in frames:
        if df is not None:
            file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
            if file.isDefined():
                remove(df.sparkSession, file.get())


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """The same rows, read back from parquet in the checkpoint folder until the block ends; what the block leaves behind must be cut by then."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{uuid4().hex}"
    try:
        sweep(spark)
        df.write.parquet(path)
        sweep(spark)
        yield spark.read.parquet(path)
    finally:
        remove(spark, path)


def sweep(spark: SparkSession) -> None:
    """Lets the session's cleaner see what nothing refers to any more, such as the shuffles of what has been stored."""
    spark.sparkContext._jvm.System.gc()
