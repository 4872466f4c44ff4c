"""Object statistics over blocks that arrive as files: an extension beyond batch work.

Sizes and section ranges of ids merge associatively, so each micro-batch of voxels only adds to the state of
the ids that it holds. There is no event time in a volume: late blocks are as good as early ones, and the
state is one row per id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def object_stats(voxels: DataFrame, label: str) -> DataFrame:
    """(id, size, min_z, max_z), for a batch or a streaming frame alike."""
    return voxels.where(F.col(label) != 0).groupBy(F.col(label).alias("id")).agg(F.count("*").alias("size"), F.min("z").alias("min_z"), F.max("z").alias("max_z"))


def read_blocks(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of parquet blocks as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drain(stats: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Runs the stream over what is there and returns the final statistics, written beside the checkpoint, which makes it resumable."""
    place = f"{checkpoint}-out"
    write = lambda df, _: df.write.mode("overwrite").parquet(place)
    q = stats.writeStream.outputMode("complete").foreachBatch(write).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return stats.sparkSession.read.schema(stats.schema).parquet(place)


def event_windows(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n, total) in tumbling windows with a watermark; the stream-like relative of block statistics."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )
