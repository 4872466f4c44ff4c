"""Whole commands over volumes: ingest, masks, pyramids, refinement, evaluation. Each reads and writes by Spark's paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.roi import AXES
from ..operators import blocks, evaluate, neighbors, objects, relabel, resample, select
from ..sources import volumes


def convert(spark: SparkSession, images: str, voxel_size=(1, 1, 1), offset=(0, 0, 0), crop: bool = False, to_max: int | None = None) -> tuple[DataFrame, tuple]:
    """(voxels, offset in world units) of a folder of images, stretched and cropped to the foreground on demand. The offset counts in voxels."""
    df = volumes.image_stack(spark, images)
    if to_max:
        df = select.scale_dtype(df, "value", to_max)
    start = [0, 0, 0]
    if crop:
        df = select.crop_to_foreground(df, "value")
        if (first := df.select(*[f"off_{a}" for a in AXES]).first()) is not None:
            start = list(first)
        df = df.drop(*[f"off_{a}" for a in AXES])
    return df, tuple((o + s) * v for o, s, v in zip(offset, start, voxel_size))


def make_mask(df: DataFrame, value: str, mode: str, radius: int = 10, times: int = 2) -> DataFrame:
    """(z, y, x, mask) of labels (foreground) or of raw data (foreground closed by a disk in each section)."""
    m = select.object_mask(df, value)
    if mode == "labels":
        return m.select(*AXES, "mask")
    if mode != "raw":
        raise ValueError(f"no mask of {mode}")
    return neighbors.disk_closing(m.select(*AXES, "mask"), "mask", radius, times)


def scale_pyramid(df: DataFrame, value: str, name: str, dtype: str, factors: Sequence[tuple], up: bool = False) -> DataFrame:
    """(level, z, y, x, value) down, or of one finer level up, by the rule of labels or of images."""
    from ..functions.naming import is_label_dataset

    labels = is_label_dataset(name, dtype)
    if any(len(f) != 3 or min(f) < 1 for f in factors):
        raise ValueError("each level takes three factors of at least 1")
    if up:
        one = resample.upsample_labels(df.select(*AXES, value), factors[0]) if labels else resample.upsample_linear(df.select(*AXES, value), value, factors[0])
        return one.select(F.lit(0).alias("level"), *AXES, value).unionByName(df.select(F.lit(1).alias("level"), *AXES, value))
    return resample.pyramid(df, value, list(factors), labels)


def refine(df: DataFrame, label: str, command: str, dry_run: bool = False, **options) -> DataFrame:
    """One of size_filter, outlier_filter, z_filter, remap, morph; a dry run gives the ids that would go."""
    dry = {"size_filter": objects.size_outside, "outlier_filter": objects.outlier_ids, "z_filter": objects.flat_ids}
    if dry_run:
        return dry[command](df, label, **options)
    run = {"size_filter": objects.size_filter, "outlier_filter": objects.outlier_filter, "z_filter": objects.z_filter, "remap": relabel.manual_remap, "morph": blocks.morph}
    return run[command](df, label, **options)


def clean_error_mask(df: DataFrame, mask: str, shape, times: int = 4, block=(64, 64, 64)) -> DataFrame:
    """(z, y, x, value): a mask opened in each section to drop thin differences, then closed along z to join gaps between sections."""
    import numpy as np

    def run(a):
        m = (a[mask] > 0).astype(np.int64)

        def step(x, axes, grow):
            out = x.copy()
            for axis in axes:
                for d in (-1, 1):
                    p = np.roll(x, d, axis)
                    edge = [slice(None)] * 3
                    edge[axis] = 0 if d == 1 else -1
                    p[tuple(edge)] = 0
                    out = np.maximum(out, p) if grow else np.minimum(out, p)
            return out

        for grow in (False, True):
            for _ in range(times):
                m = step(m, (1, 2), grow)
        return step(step(m, (0,), True), (0,), False)

    reach = (2, 2 * times, 2 * times)
    return blocks.BlockOp(run, (mask,), block, reach, reach).apply(df, shape)


def pad(df: DataFrame, shape, by: tuple, mode: str = "constant") -> DataFrame:
    """A volume with margins, moved so that it starts at 0 again; margins are absent cells, or mirror images that leave out the edge ("reflect")."""
    rest = [c for c in df.columns if c not in AXES]
    out = df
    for a, n, p in zip(AXES, shape, by):
        if mode == "reflect":
            if p >= n:
                raise ValueError("a mirrored margin must be smaller than the volume")
            mirror = [F.when((F.col(a) >= 1) & (F.col(a) <= p), -F.col(a)), F.when((F.col(a) <= n - 2) & (F.col(a) >= n - 1 - p), 2 * (n - 1) - F.col(a))]
            spots = F.filter(F.array(F.col(a), *mirror), lambda v: v.isNotNull())
            out = out.withColumn(a, F.explode(spots))
        out = out.withColumn(a, F.col(a) + p)
    return out.select(*AXES, *rest)


def copy_volume(spark: SparkSession, source: str, target: str) -> None:
    """A volume with its metadata under another path."""
    volumes.write_volume(volumes.open_volume(spark, source), target, volumes.read_meta(spark, source))


def evaluate_segmentations(segs: dict[str, DataFrame], gt: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(segmentation, metrics): each volume (z, y, x, seg) against (z, y, x, gt), masked; all in one plan."""
    both = None
    for name, s in sorted(segs.items()):
        one = gt.join(s, list(AXES), "left").select(F.lit(name).alias("segmentation"), *AXES, "gt", F.coalesce("seg", F.lit(0)).alias("seg"))
        both = one if both is None else both.unionByName(one)
    if mask is not None:
        both = both.join(mask.where("mask > 0").select(*AXES), list(AXES), "left_semi")
    return evaluate.rand_voi(both, "gt", "seg", ["segmentation"])
