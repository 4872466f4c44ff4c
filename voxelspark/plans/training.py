"""Training samples of the ten model kinds as operator chains over DataFrames.

A chain's plan is data: what goes in, what comes out, and which steps lie between. Samples are voxel tables;
no network is run here.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roi import AXES
from ..operators import augment, blocks, kernels, neighbors, objects


@dataclass(frozen=True)
class Model:
    """Inputs and outputs by kind: raw, affs (channels are offsets), lsds. ``synthetic`` ones learn from made-up labels."""

    inputs: dict[str, int]
    outputs: dict[str, int]
    dims: int
    synthetic: bool = False

    def inference_scale(self) -> tuple[float, float]:
        """(scale, shift) of outputs to 8 bits; inputs are scaled to [-1, 1] before."""
        return 255.0, 0.0


# Channels in and out of each model kind.
MODELS = {
    "2d_affs": Model({"raw": 1}, {"affs": 6}, 2),
    "2d_lsd": Model({"raw": 1}, {"lsds": 6}, 2),
    "2d_mtlsd": Model({"raw": 1}, {"lsds": 6, "affs": 6}, 2),
    "3d_affs": Model({"raw": 1}, {"affs": 6}, 3),
    "3d_lsd": Model({"raw": 1}, {"lsds": 10}, 3),
    "3d_mtlsd": Model({"raw": 1}, {"lsds": 10, "affs": 6}, 3),
    "3d_affs_from_2d_affs": Model({"affs": 6}, {"affs": 9}, 3, True),
    "3d_affs_from_2d_lsd": Model({"lsds": 6}, {"affs": 9}, 3, True),
    "3d_affs_from_2d_mtlsd": Model({"lsds": 6, "affs": 6}, {"affs": 9}, 3, True),
    "3d_affs_from_3d_lsd": Model({"lsds": 10}, {"affs": 9}, 3, True),
}


def validate(model: str, neighborhood: Sequence) -> None:
    """An error where a model's affinity channels and offsets differ in number."""
    want = MODELS[model].outputs.get("affs")
    if want is not None and want != len(neighborhood):
        raise ValueError(f"{model} has {want} affinity channels, not {len(neighborhood)}")


def augmented_raw(df: DataFrame, raw: str, seed: int) -> DataFrame:
    """Intensity chain on raw in [0, 1]: noise, contrast, gamma, impulses, defects; then to [-1, 1]."""
    df = augment.gaussian_noise(df, raw, 0.1, seed)
    df = augment.intensity(df, raw, (0.9, 1.1), (-0.1, 0.1), seed + 1)
    df = augment.gamma(df, raw, (1, -1, -1), seed=seed + 3)
    df = augment.impulse_noise(df, raw, 0.05, seed + 4)
    df = augment.defects(df, raw, 0.1, 0.1, seed=seed + 6)
    return df.withColumn(raw, F.col(raw) * 2 - 1)


def affinity_targets(df: DataFrame, label: str, neighborhood: Sequence, grow: int = 1, slab: int = 0) -> DataFrame:
    """(z, y, x, o, aff, weight): affinities of grown-back labels and their class-balance weights by channel and slab."""
    grown = neighbors.grow_boundary(df, label, grow)
    affs = neighbors.affinities(grown, label, neighborhood)
    key = affs.withColumn("_z", F.col("z")).withColumn("z", F.col("o") * (1 << 20) + (F.floor(F.col("z") / slab) if slab else F.lit(0)))
    out = objects.balance_weights(key, "aff", 1)
    return out.select(F.col("_z").alias("z"), "y", "x", "o", "aff", "weight")


def descriptor_targets(df: DataFrame, label: str, shape, sigma: float, channels: int, block=(32, 64, 64)) -> DataFrame:
    """(z, y, x, lsd): descriptor arrays; six channels are those of each section by itself."""
    per_section = channels == 6
    reach = int(4 * sigma + 0.5)

    def all_channels(a):
        lab = a[label]
        got = np.stack([kernels.local_shape_descriptors(s, sigma) for s in lab], 1) if per_section else kernels.local_shape_descriptors(lab, sigma)
        return np.asarray(got)[:channels]

    halo = (0 if per_section else reach, reach, reach)
    return blocks.BlockOp(all_channels, (label,), block, halo, halo, "array<double>").apply(df, shape, "lsd")


def training_sample(model: str, df: DataFrame, shape, neighborhood: Sequence, sigma: float = 2.0, grow: int = 1, seed: int = 0, in_neighborhood: Sequence | None = None) -> dict[str, DataFrame]:
    """The inputs and targets of a model from a volume (z, y, x, raw, label), or from its labels alone for synthetic kinds."""
    m = MODELS[model]
    validate(model, neighborhood)
    out: dict[str, DataFrame] = {}
    labels = df.select(*AXES, "label")
    if not m.synthetic:
        out["raw"] = augmented_raw(df.select(*AXES, "raw"), "raw", seed)
    else:
        broken = augment.obfuscate_split(augment.obfuscate_merge(labels, "label", 0.1, seed), "label", 0.1, 1 << 40, seed + 1)
        if "affs" in m.inputs:
            inp = neighbors.affinities(broken, "label", in_neighborhood or neighborhood).withColumn("aff", F.col("aff").cast("double"))
            out["input_affs"] = augment.intensity(augment.gaussian_noise(inp, "aff", 0.1, seed + 2), "aff", (0.9, 1.1), (-0.1, 0.1), seed + 3)
        if "lsds" in m.inputs:
            out["input_lsds"] = descriptor_targets(broken, "label", shape, sigma, m.inputs["lsds"])
    if "affs" in m.outputs:
        out["affs"] = affinity_targets(labels, "label", neighborhood, grow, 3 if m.synthetic else 0)
    if "lsds" in m.outputs:
        out["lsds"] = descriptor_targets(labels, "label", shape, sigma, m.outputs["lsds"])
    return out
