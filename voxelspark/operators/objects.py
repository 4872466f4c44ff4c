"""Statistics of objects and volumes, and the filters that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.roi import AXES
from .select import mask_ids


def sizes(df: DataFrame, label: str) -> DataFrame:
    """(id, size) of the foreground objects."""
    return df.where(F.col(label) != 0).groupBy(F.col(label).alias("id")).agg(F.count("*").alias("size"))


def z_extents(df: DataFrame, label: str) -> DataFrame:
    """(id, min_z, max_z, extent)."""
    out = df.where(F.col(label) != 0).groupBy(F.col(label).alias("id")).agg(F.min("z").alias("min_z"), F.max("z").alias("max_z"))
    return out.withColumn("extent", F.col("max_z") - F.col("min_z") + 1)


def centroids(df: DataFrame, label: str, offset=(0, 0, 0), voxel_size=(1, 1, 1)) -> DataFrame:
    """(id, size, z, y, x): positions in world units of the whole voxel that holds the centre of mass."""
    pos = [(F.lit(o) + F.lit(v) * F.floor(F.avg(a))).cast("long").alias(a) for a, o, v in zip(AXES, offset, voxel_size)]
    return df.where(F.col(label) != 0).groupBy(F.col(label).alias("id")).agg(F.count("*").alias("size"), *pos)


def mean_affinity(df: DataFrame, label: str, affs: list[str]) -> DataFrame:
    """(id, mean_aff): the mean over voxels of the mean over channels."""
    total = sum((F.col(a) for a in affs[1:]), F.col(affs[0]))
    return df.where(F.col(label) != 0).groupBy(F.col(label).alias("id")).agg(F.avg(total / len(affs)).alias("mean_aff"))


def size_moments(s: DataFrame, min_size: int = 0) -> DataFrame:
    """One row of count, mean, population deviation and percentiles of sizes from ``min_size`` on."""
    p = lambda q: F.percentile("size", F.lit(q))
    return s.where(F.col("size") >= min_size).agg(
        F.count("*").alias("n"), F.avg("size").alias("mean"), F.stddev_pop("size").alias("std"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), p(0.999).alias("p999")
    )


def size_report(s: DataFrame) -> DataFrame:
    """One row of count, least, whole median and greatest size."""
    return s.agg(F.count("*").alias("n"), F.min("size").alias("min_size"), F.median("size").cast("long").alias("median_size"), F.max("size").alias("max_size"))


def outlier_ids(df: DataFrame, label: str, num_std: float = 3, min_size: int = 0) -> DataFrame:
    """Ids whose size is further from the mean than so many deviations; only the moments leave small objects out."""
    s = sizes(df, label)
    m = size_moments(s, min_size).select("mean", "std")
    return s.join(F.broadcast(m)).where((F.col("size") < F.col("mean") - num_std * F.col("std")) | (F.col("size") > F.col("mean") + num_std * F.col("std"))).select("id", "size")


def size_outside(df: DataFrame, label: str, min_size: int = 0, max_size: int | None = None) -> DataFrame:
    """Ids that are smaller than the least or larger than the greatest size; no greatest or 0: no cap."""
    bad = F.col("size") < min_size
    if max_size:
        bad = bad | (F.col("size") > max_size)
    return sizes(df, label).where(bad).select("id", "size")


def flat_ids(df: DataFrame, label: str, min_z: int = 1) -> DataFrame:
    """Ids that extend over at most ``min_z`` sections."""
    return z_extents(df, label).where(F.col("extent") <= min_z).select("id", "extent")


def outlier_filter(df: DataFrame, label: str, num_std: float = 3, min_size: int = 0) -> DataFrame:
    return mask_ids(df, label, outlier_ids(df, label, num_std, min_size))


def size_filter(df: DataFrame, label: str, min_size: int = 0, max_size: int | None = None) -> DataFrame:
    return mask_ids(df, label, size_outside(df, label, min_size, max_size))


def z_filter(df: DataFrame, label: str, min_z: int = 1) -> DataFrame:
    return mask_ids(df, label, flat_ids(df, label, min_z))


def remove_debris(df: DataFrame, label: str, min_size: int = 64) -> DataFrame:
    """Objects smaller than the least size become 0."""
    return size_filter(df, label, min_size)


def affinity_filter(df: DataFrame, label: str, affs: list[str], least: float) -> DataFrame:
    """Objects whose mean affinity is below the least become 0."""
    return mask_ids(df, label, mean_affinity(df, label, affs).where(F.col("mean_aff") < least))


def array_stats(df: DataFrame, value: str, total: int | None = None) -> DataFrame:
    """One row: mean, population deviation, voxels above 0, all voxels and the ratio; absent cells count as 0 where the total is given."""
    v = F.col(value).cast("double")
    n = F.count("*") if total is None else F.lit(total)
    mean = F.sum(v) / n
    return df.agg(
        mean.alias("mean"), F.sqrt(F.greatest(F.sum(v * v) / n - mean * mean, F.lit(0.0))).alias("std"), F.count_if(v > 0).alias("nonzero"), n.cast("long").alias("total"), (F.count_if(v > 0) / n).alias("ratio")
    )


def min_max(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def balance_weights(df: DataFrame, label: str, slab: int = 0) -> DataFrame:
    """Weights that give each class of a slab of sections the same total: n / (classes * n of the class); slab 0 is the whole volume."""
    part = F.floor(F.col("z") / slab) if slab else F.lit(0).cast("long")
    keyed = df.withColumn("slab", part)
    freq = keyed.groupBy("slab", F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    of = freq.groupBy("slab").agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    weights = freq.join(of, "slab").select("slab", F.col("_l").alias(label), (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return keyed.join(weights, ["slab", label])


def masked_loss(df: DataFrame, pred: str, target: str, weight: str) -> DataFrame:
    """The mean of weight * (pred - target)^2 where the weight is above 0; the plain mean of it all where none is."""
    term = F.col(weight) * F.pow(F.col(pred) - F.col(target), 2)
    return df.agg(F.coalesce(F.avg(F.when(F.col(weight) > 0, term)), F.avg(term)).alias("loss"))


def clip(value: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(value, F.lit(hi)), F.lit(lo))
