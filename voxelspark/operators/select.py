"""Projections, filters and predicates over voxel tables (z, y, x, value columns; absent cells are 0)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.roi import AXES, Roi


def roi_scan(df: DataFrame, roi: Roi, values: list[str], fill: float = 0) -> DataFrame:
    """Every cell of a box (in voxels), with the fill value where the volume has none."""
    spark = df.sparkSession
    axis = [spark.range(lo, hi).withColumnRenamed("id", a) for a, lo, hi in zip(AXES, roi.offset, roi.end)]
    z, y, x = axis
    # the grid is exploded from its z sections, row by row, not crossed
    ys, xs = F.sequence(F.lit(roi.offset[1]), F.lit(roi.end[1] - 1)), F.sequence(F.lit(roi.offset[2]), F.lit(roi.end[2] - 1))
    grid = z.withColumn("y", F.explode(ys)).withColumn("x", F.explode(xs)).select(*[F.col(a).cast("long") for a in AXES]) if not roi.empty else df.select(*AXES).limit(0)
    return grid.join(df.where(roi.where()), list(AXES), "left").select(*AXES, *[F.coalesce(F.col(v), F.lit(fill)).alias(v) for v in values])


def channels(df: DataFrame, column: str, first: int, n: int) -> DataFrame:
    """The channels [first, first + n) of an array column, counted from 0."""
    return df.withColumn(column, F.slice(column, first + 1, n))


def normalise(value: Column, dtype: str) -> Column:
    """8-bit intensities to [0, 1]; others as doubles."""
    return value / 255.0 if dtype == "uint8" else value.cast("double")


def scale_dtype(df: DataFrame, value: str, to_max: int) -> DataFrame:
    """Values stretched so that the largest becomes ``to_max``, cut to integers; one row of the maximum is broadcast."""
    top = df.agg(F.max(value).alias("_top"))
    return df.join(F.broadcast(top)).withColumn(value, (F.col(value) / F.col("_top") * to_max).cast("long")).drop("_top")


def threshold(value: Column, t: float) -> Column:
    return value > t


def band(value: Column, floor: float, ceil: float) -> Column:
    """1 strictly between the two; a value at either is outside."""
    return ((value > floor) & (value < ceil)).cast("int")


def object_mask(df: DataFrame, value: str, name: str = "mask") -> DataFrame:
    return df.withColumn(name, (F.col(value) > 0).cast("int"))


def apply_mask(df: DataFrame, mask: DataFrame, values: list[str], name: str = "mask") -> DataFrame:
    """Values where the mask is above 0, else 0; where a mask has channels, their minimum counts."""
    kind = dict(mask.dtypes)[name]
    m = F.array_min(name) if kind.startswith("array") else F.col(name)
    got = df.join(mask.select(*AXES, m.alias("_m")), list(AXES), "left")
    return got.select(*[F.when(F.col("_m") > 0, F.col(c)).otherwise(F.lit(0).cast(t)).alias(c) if c in values else F.col(c) for c, t in df.dtypes])


def bounding_box(df: DataFrame, value: str) -> DataFrame:
    """One row: the least and greatest foreground coordinates and the foreground's size."""
    aggs = [f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))]
    return df.where(F.col(value) > 0).agg(*aggs, F.count("*").alias("n"))


def crop_to_foreground(df: DataFrame, value: str, padding: int = 0, shape: tuple | None = None) -> DataFrame:
    """The box of the foreground and its padding, clamped to the volume (from 0, to ``shape`` if given), moved to the origin.

    Keeps ``off_z, off_y, off_x``, the voxels that the origin moved by.
    """
    box = bounding_box(df, value)
    lo = [F.greatest(F.col(f"min_{a}") - padding, F.lit(0)).alias(f"off_{a}") for a in AXES]
    hi = [(F.col(f"max_{a}") + padding if shape is None else F.least(F.col(f"max_{a}") + padding, F.lit(s - 1))).alias(f"end_{a}") for a, s in zip(AXES, shape or AXES)]
    box = F.broadcast(box.where("n > 0").select(*lo, *hi))
    inside = F.lit(True)
    for a in AXES:
        inside = inside & F.col(a).between(F.col(f"off_{a}"), F.col(f"end_{a}"))
    rest = [c for c in df.columns if c not in AXES]
    return df.join(box, inside).select(*[(F.col(a) - F.col(f"off_{a}")).alias(a) for a in AXES], *rest, *[f"off_{a}" for a in AXES])


def mask_ids(df: DataFrame, value: str, ids: DataFrame, name: str = "id") -> DataFrame:
    """Listed ids become 0. The ids are joined, so their number is no limit; AQE broadcasts a short list."""
    hit = ids.select(F.col(name).alias("_id")).distinct()
    got = df.join(hit, F.col(value) == F.col("_id"), "left")
    return got.withColumn(value, F.when(F.col("_id").isNotNull(), F.lit(0).cast(dict(df.dtypes)[value])).otherwise(F.col(value))).drop("_id")


def _chosen(value: str, ids: list[int] | None, roi: Roi | None) -> Column:
    parts = []
    if ids:
        parts.append(F.col(value).isin(ids))
    if roi is not None:
        parts.append(roi.where())
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def omit(df: DataFrame, value: str, ids: list[int] | None = None, roi: Roi | None = None) -> DataFrame:
    """0 for the ids and inside the box."""
    return df.withColumn(value, F.when(_chosen(value, ids, roi), 0).otherwise(F.col(value)))


def keep(df: DataFrame, value: str, ids: list[int] | None = None, roi: Roi | None = None) -> DataFrame:
    """0 for everything else."""
    return df.withColumn(value, F.when(_chosen(value, ids, roi), F.col(value)).otherwise(0))


def boxes_to_mask(df: DataFrame, boxes: DataFrame, side: int = 64) -> DataFrame:
    """1 for voxels inside any annotated box (lo_z.., hi_z.. in voxels, floats; floor of the least, ceil of the greatest, half open).

    Boxes are dealt to the cubes of ``side`` voxels that they touch, so the join is an equi-join on cubes.
    """
    lo, hi = {a: F.floor(f"lo_{a}") for a in AXES}, {a: F.ceil(f"hi_{a}") for a in AXES}
    b = boxes.select(*[lo[a].alias(f"lo_{a}") for a in AXES], *[hi[a].alias(f"hi_{a}") for a in AXES]).where(" and ".join(f"lo_{a} < hi_{a}" for a in AXES))
    for a in AXES:
        b = b.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(f"lo_{a}") / side), F.floor((F.col(f"hi_{a}") - 1) / side))))
    cubes = [F.floor(F.col(a) / side).alias(f"c{a}") for a in AXES]
    inside = " and ".join(f"{a} >= lo_{a} and {a} < hi_{a}" for a in AXES)
    hit = df.select(*AXES, *cubes).join(b, [f"c{a}" for a in AXES]).where(inside).select(*AXES).distinct().withColumn("_hit", F.lit(1))
    return df.join(hit, list(AXES), "left").withColumn("mask", F.coalesce("_hit", F.lit(0))).drop("_hit")


def scale_shift(value: Column, scale: float, shift: float) -> Column:
    return value * scale + shift


def promote_two_channels(affs: Column) -> Column:
    """Two in-plane affinities become three with a missing first one of 0."""
    return F.when(F.size(affs) == 2, F.concat(F.array(F.lit(0.0)), affs)).otherwise(affs)


def accept_blocks(df: DataFrame, mask: str, block: list[int], least: float = 0.05) -> DataFrame:
    """Voxels of blocks in which the mask covers at least a share of the block's volume."""
    keys = [F.floor(F.col(a) / b).alias(f"b{a}") for a, b in zip(AXES, block)]
    keyed = df.select("*", *keys)
    names = [f"b{a}" for a in AXES]
    volume = float(block[0] * block[1] * block[2])
    good = keyed.groupBy(*names).agg((F.sum((F.col(mask) > 0).cast("int")) / volume).alias("share")).where(F.col("share") >= least).select(*names)
    return keyed.join(good, names, "left_semi")


def blackout(df: DataFrame, label: str, divisor: int) -> DataFrame:
    """Ids that the divisor divides become 0."""
    return df.withColumn(label, F.when(F.col(label) % divisor == 0, 0).otherwise(F.col(label)))
