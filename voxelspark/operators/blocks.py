"""Block operators: voxels are dealt to blocks with a halo, a kernel runs on each block, and its core is kept.

A block is one group of a grouped map, so its size bounds what a task holds. Ids are made unique over the
volume without coordination: the block's number times the voxels of a block is added to the kernel's ids.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roi import AXES
from .neighbors import block_halo


@dataclass(frozen=True)
class BlockOp:
    """``kernel(arrays) -> array``: arrays by value column, dense over the read box; the result over the same box.

    ``reach`` is how far the kernel's result at a voxel depends on others; the halo must cover it. With
    ``unique_ids`` the result is ids that count from 1 in each block. Blocks without a value are not run. With an
    array type the result has its channels first, and voxels without any but zeros are left out.
    """

    kernel: Callable[[dict[str, np.ndarray]], np.ndarray]
    values: tuple[str, ...]
    block: tuple[int, int, int]
    halo: tuple[int, int, int] = (0, 0, 0)
    reach: tuple[int, int, int] = (0, 0, 0)
    dtype: str = "long"
    unique_ids: bool = False
    skip_below: float | None = None

    def __post_init__(self):
        if any(h < r for h, r in zip(self.halo, self.reach)):
            raise ValueError(f"a halo of {self.halo} does not cover a reach of {self.reach}")

    def apply(self, df: DataFrame, shape: tuple[int, int, int], out: str = "value") -> DataFrame:
        """(z, y, x, out) of the cores, zeros left out. ``shape`` is the volume's, from the origin."""
        grid = tuple(-(-s // b) for s, b in zip(shape, self.block))
        voxels = int(np.prod(self.block))
        if self.unique_ids and int(np.prod(grid)) * voxels >= 2**63:
            raise ValueError("block ids do not fit 64 bits")
        op, dtype, many = self, self.dtype, self.dtype.startswith("array")

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            b = [int(pdf[f"b{a}"].iloc[0]) for a in AXES]
            lo = [max(0, k * s - h) for k, s, h in zip(b, op.block, op.halo)]
            hi = [min(n, (k + 1) * s + h) for k, s, h, n in zip(b, op.block, op.halo, shape)]
            at = tuple(pdf[a].to_numpy() - l for a, l in zip(AXES, lo))
            arrays = {}
            for v in op.values:
                col = pdf[v].to_numpy()
                arrays[v] = np.zeros([h - l for h, l in zip(hi, lo)], col.dtype if col.dtype != object else float)
                arrays[v][at] = col
            empty = pd.DataFrame({**{a: np.empty(0, np.int64) for a in AXES}, out: np.empty(0, object if many else np.int64 if dtype == "long" else float)})
            if op.skip_below is not None and max(float(a.max()) for a in arrays.values()) < op.skip_below:
                return empty
            got = op.kernel(arrays)
            if many:  # channels first
                core = tuple(slice(k * s - l, min(n, (k + 1) * s) - l) for k, s, l, n in zip(b, op.block, lo, shape))
                got = got[(slice(None), *core)]
                z, y, x = np.nonzero((got != 0).any(0))
                return pd.DataFrame({"z": z + core[0].start + lo[0], "y": y + core[1].start + lo[1], "x": x + core[2].start + lo[2], out: list(got[:, z, y, x].T)}) if len(z) else empty
            core = tuple(slice(k * s - l, min(n, (k + 1) * s) - l) for k, s, l, n in zip(b, op.block, lo, shape))
            got = got[core]
            z, y, x = np.nonzero(got)
            val = got[z, y, x]
            if op.unique_ids:
                number = (b[0] * grid[1] + b[1]) * grid[2] + b[2]
                # cut at the core, parts that only met in the halo are told apart by the callers' agglomeration
                _, val = np.unique(val, return_inverse=True)
                val = val + 1 + number * voxels
            start = [c.start + l for c, l in zip(core, lo)]
            return pd.DataFrame({"z": z + start[0], "y": y + start[1], "x": x + start[2], out: val}) if len(z) else empty

        inside = df.where(" and ".join(f"{a} >= 0 and {a} < {s}" for a, s in zip(AXES, shape)))
        dealt = block_halo(inside.select(*AXES, *self.values), self.block, self.halo, grid)
        return dealt.groupBy("bz", "by", "bx").applyInPandas(run, f"z long, y long, x long, {out} {dtype}")


def morph(df: DataFrame, label: str, shape, op: str, times: int = 1, per_section: bool = False, block=(64, 64, 64)) -> DataFrame:
    """(z, y, x, value) after a morphological operator; holes are filled where they fit in a block and its halo."""
    from . import kernels

    need = times * (2 if op in ("opening", "closing") else 1) if op != "fill_holes" else 16
    reach = (0 if per_section else need, need, need)
    return BlockOp(lambda a: kernels.morph(a[label], op, times, per_section), (label,), block, reach, reach if op != "fill_holes" else (0, 0, 0)).apply(df, shape)


def smooth(df: DataFrame, value: str, shape, sigma: tuple, block=(64, 64, 64)) -> DataFrame:
    """(z, y, x, value) after a Gaussian, exact for blocks inside: the halo holds the whole kernel."""
    from . import kernels

    reach = tuple(int(4 * s + 0.5) for s in sigma)
    return BlockOp(lambda a: kernels.gaussian(a[value], list(sigma)), (value,), block, reach, reach, "double").apply(df, shape)


def distance_transform(df: DataFrame, mask: str, shape, per_section: bool = False, block=(64, 64, 64)) -> DataFrame:
    """(z, y, x, value): distances to the background, however far; infinite where a section (or the volume) has none.

    Squared distances are lowered axis by axis, so a block holds whole lines of one axis and needs no halo.
    """
    from . import kernels

    out = df.where(F.col(mask) > 0).select(*AXES, F.lit(float("inf")).alias("value"))
    for axis in (1, 2) if per_section else (0, 1, 2):
        lines = tuple(n if k == axis else b for k, (n, b) in enumerate(zip(shape, block)))
        out = BlockOp(lambda a, axis=axis: kernels.lower_along(a["value"], axis), ("value",), lines, dtype="double").apply(out, shape)
    return out.withColumn("value", F.sqrt("value"))


def equalise(df: DataFrame, value: str, shape, tile: int = 8) -> DataFrame:
    """(z, y, x, value): each section's contrast-limited equalisation; a section is one task's work."""
    from . import kernels

    return BlockOp(lambda a: np.stack([kernels.clahe(s, tile) for s in a[value]]), (value,), (1, shape[1], shape[2]), dtype="double").apply(df, shape)


def grow_random(df: DataFrame, label: str, shape, max_steps: int, per_section: bool = True, seed: int = 0, block=(64, 64, 64)) -> DataFrame:
    """(z, y, x, value): each label eroded by a number of steps up to ``max_steps`` that its id draws."""
    import zlib

    from . import kernels

    def run(a):
        lab = a[label]
        steps = {int(i): zlib.crc32(f"{seed}:{i}".encode()) % (max_steps + 1) for i in np.unique(lab)}
        return np.stack([kernels.grow_random(s, steps) for s in lab]) if per_section else kernels.grow_random(lab, steps)

    reach = (0 if per_section else max_steps, max_steps, max_steps)
    return BlockOp(run, (label,), block, reach, reach).apply(df, shape)


def infer(df: DataFrame, values: tuple[str, ...], shape, function: Callable, block, halo) -> DataFrame:
    """(z, y, x, value): a user's function on each block, such as a network's forward pass."""
    return BlockOp(function, values, block, halo, halo, "double").apply(df, shape)


def descriptors(df: DataFrame, label: str, shape, sigma: float, channel: int, block=(32, 64, 64)) -> DataFrame:
    """(z, y, x, value): one channel of the local shape descriptors."""
    from . import kernels

    r = int(4 * sigma + 0.5)
    return BlockOp(lambda a: kernels.local_shape_descriptors(a[label], sigma)[channel], (label,), block, (r, r, r), (r, r, r), "double").apply(df, shape)


def fragments(df: DataFrame, affs: tuple[str, ...], shape, in_xy: bool = True, min_seed_distance: int = 10, block=(8, 64, 64), context: tuple | None = None, seed_eps: float | None = None) -> DataFrame:
    """(z, y, x, fragment): seeded-watershed fragments of each block, with ids that are unique over the volume."""
    from . import kernels

    context = context or tuple(max(1, s // 8) for s in block)

    def run(a):
        x = np.stack([a[c] for c in affs])
        if seed_eps is not None:
            x = kernels.seed_decay(x, seed_eps, min_seed_distance)
        return kernels.components(kernels.affinity_basins(x, in_xy, min_seed_distance))[0]

    op = BlockOp(run, affs, block, context, unique_ids=True, skip_below=1e-3)
    out = op.apply(df, shape, "fragment")
    return out.select("z", "y", "x", F.col("fragment"))
