"""Pyramid levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.roi import AXES


def downsample_labels(df: DataFrame, factor: tuple) -> DataFrame:
    """Stride sampling at the middle voxel ``k // 2`` of each cell."""
    cond = F.lit(True)
    for a, k in zip(AXES, factor):
        cond = cond & (F.pmod(F.col(a), F.lit(k)) == k // 2)
    rest = [c for c in df.columns if c not in AXES]
    return df.where(cond).select(*[F.floor(F.col(a) / k).alias(a) for a, k in zip(AXES, factor)], *rest)


def downsample_mean(df: DataFrame, value: str, factor: tuple) -> DataFrame:
    """The mean of each cell's voxels; absent ones, also beyond the edge, count as 0."""
    n = factor[0] * factor[1] * factor[2]
    return df.groupBy(*[F.floor(F.col(a) / k).alias(a) for a, k in zip(AXES, factor)]).agg((F.sum(value) / n).alias(value))


def upsample_labels(df: DataFrame, factor: tuple) -> DataFrame:
    """Each voxel repeated over its cell."""
    rest = [c for c in df.columns if c not in AXES]
    for a, k in zip(AXES, factor):
        df = df.withColumn(a, F.explode(F.sequence(F.col(a) * k, F.col(a) * k + k - 1)))
    return df.select(*AXES, *rest)


def upsample_linear(df: DataFrame, value: str, factor: tuple) -> DataFrame:
    """Linear interpolation between voxel centres, one axis after another; at the ends, and beside absent voxels, the value stays."""
    for a, k in zip(AXES, factor):
        if k == 1:
            continue
        others = [b for b in AXES if b != a]
        side = {s: df.select(*others, (F.col(a) - d).alias(a), F.col(value).alias(s)) for s, d in (("prev", -1), ("next", 1))}
        df = df.join(side["prev"], [*others, a], "left").join(side["next"], [*others, a], "left")
        sub = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        t = (F.col("i") + 0.5) / k - 0.5
        other: Column = F.coalesce(F.when(t < 0, F.col("prev")).otherwise(F.col("next")), F.col(value))
        df = sub.select(*others, (F.col(a) * k + F.col("i")).alias(a), (F.col(value) + (other - F.col(value)) * F.abs(t)).alias(value))
    return df.select(*AXES, value)


def pyramid(df: DataFrame, value: str, factors: list[tuple], labels: bool) -> DataFrame:
    """(level, z, y, x, value): the volume and each level below it, the finest is level 0."""
    out = df.select(F.lit(0).alias("level"), *AXES, value)
    for n, f in enumerate(factors, 1):
        df = downsample_labels(df.select(*AXES, value), f) if labels else downsample_mean(df, value, f)
        out = out.unionByName(df.select(F.lit(n).alias("level"), *AXES, value))
    return out
