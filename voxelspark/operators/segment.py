"""Segmentation pipelines: ``ws`` and ``mws`` (simple and block-wise) and ``cc``.

A volume is a voxel table with one column per affinity channel. Block-wise, fragments are kernels on blocks
and all that follows is relational: boundary scores are one aggregation, components coarsen from threshold to
threshold, and relabelling is a join. Nothing but thresholds passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.configs import resolve
from ..functions.roi import AXES
from ..plans.lineage import cut
from . import kernels, objects
from .blocks import BlockOp, fragments, smooth
from .graphs import affinity_components, mutex_partition, threshold_sweep
from .relabel import apply_lut
from .select import apply_mask

#: How boundaries are scored by name, before and after each merge: None is the mean, a number the quantile of affinities across them.
MERGE_FUNCTIONS: dict[str, float | None] = {"mean": None, "hist_quant_10": 0.1, "hist_quant_25": 0.25, "hist_quant_50": 0.5, "hist_quant_75": 0.75, "hist_quant_90": 0.9}


def noise(eps: float, seed: int, *columns: str) -> Column:
    """A normal deviate times eps, drawn by hash of the voxel, so that it does not depend on the plan."""
    u = lambda k: (F.pmod(F.xxhash64(*columns, F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * np.pi * u(1)) * eps


def shift_affinities(df: DataFrame, affs: Sequence[str], bias: Sequence[float] | float | None = None, noise_eps: float | None = None, smooth: Callable[[DataFrame, str], DataFrame] | None = None, seed: int = 0) -> DataFrame:
    """Affinities plus their bias, noise, and the difference that smoothing makes."""
    out = df
    for k, a in enumerate(affs):
        total = F.col(a)
        if bias is not None:
            total = total + F.lit(float(bias[k] if isinstance(bias, list | tuple) else bias))
        if noise_eps:
            total = total + noise(noise_eps, seed + k, *AXES)
        if smooth is not None:
            s = smooth(df, a).select(*AXES, F.col("value").alias("_s"))
            out = out.join(s, list(AXES), "left")
            total = total + F.coalesce("_s", F.lit(0.0)) - F.col(a)
        out = out.withColumn(a, total).drop("_s")
    return out


def _block_boundaries(frags: DataFrame, df: DataFrame, affs: Sequence[str], block, halo, quantile: float | None = None) -> DataFrame:
    """(bz, by, bx, u, v, n, total): boundaries of the fragments within each block's box, grown by the halo; total is a sum, or with a quantile the values."""
    from .neighbors import block_halo, shifted_pairs

    steps = [tuple(-1 if a == k else 0 for a in range(3)) for k in range(3)]
    pairs = shifted_pairs(df.join(frags, list(AXES)), steps, ["fragment", *affs]).where("fragment <> n_fragment")
    value = F.element_at(F.array(*affs), F.col("o") + 1)
    pairs = pairs.select("o", *AXES, F.least("fragment", "n_fragment").alias("u"), F.greatest("fragment", "n_fragment").alias("v"), value.alias("aff"))
    dealt = block_halo(pairs, block, halo)
    for k, a in enumerate(AXES):  # the neighbour one step back is in the box too
        dealt = dealt.where((F.col("o") != k) | (F.col(a) - 1 >= F.col(f"b{a}") * block[k] - halo[k]))
    total = F.sum("aff") if quantile is None else F.collect_list("aff")
    return dealt.groupBy("bz", "by", "bx", "u", "v").agg(F.count("*").alias("n"), total.alias("total"))


def scored_graph(frags: DataFrame, df: DataFrame, affs: Sequence[str], merge_function: str = "mean", block=(64, 64, 64), context=(1, 1, 1)) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a fragment volume: sizes and centres; boundary sizes, and the score at which hierarchical agglomeration first joins u and v.

    Each block is agglomerated with its context up to a score of 1. An edge takes its score from the block that
    holds the centre of u; it has none where u and v never join there.
    """
    if merge_function not in MERGE_FUNCTIONS:
        raise ValueError(f"{merge_function} is none of {sorted(MERGE_FUNCTIONS)}")
    quantile = MERGE_FUNCTIONS[merge_function]
    nodes = objects.centroids(frags, "fragment")
    home = nodes.select(F.col("id").alias("u"), *[F.floor(F.col(a) / b).alias(f"u{a}") for a, b in zip(AXES, block)])
    # one voxel of context at least, as boundaries between blocks are seen by neither otherwise
    bounds = _block_boundaries(frags, df, affs, block, tuple(max(1, c) for c in context), quantile)
    bounds = bounds.join(home, "u").withColumn("own", F.expr(" and ".join(f"b{a} = u{a}" for a in AXES)))

    def run(pdf):
        pdf = pdf.sort_values(["u", "v"])
        own = pdf[pdf["own"]]
        history = kernels.agglomerate(pdf["u"], pdf["v"], pdf["n"], pdf["total"], 1.0, quantile) if len(own) else []
        return own[["u", "v", "n"]].assign(score=kernels.joined_at(own["u"], own["v"], history))

    edges = bounds.groupBy("bz", "by", "bx").applyInPandas(run, "u long, v long, n long, score double")
    return nodes, edges.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))


def merge_within_blocks(frags: DataFrame, df: DataFrame, affs: Sequence[str], stop: float, block) -> DataFrame:
    """(fragment, segment): fragments agglomerated up to a score, each block by itself."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["u", "v"])
        up = {b: a for _, a, b, _, _ in kernels.agglomerate(pdf["u"], pdf["v"], pdf["n"], pdf["total"], stop)}
        rows = []
        for f in up:
            s = f
            while s in up:
                s = up[s]
            rows.append((f, s))
        return pd.DataFrame(rows, columns=["fragment", "segment"]).astype("int64")

    return _block_boundaries(frags, df, affs, block, (0, 0, 0)).groupBy("bz", "by", "bx").applyInPandas(run, "fragment long, segment long")


def _smoother(shape, sigma, block):
    """A Gaussian over whole volumes by blocks, or none; one number is a sigma in the plane and across."""
    if sigma is None:
        return None
    sigma = tuple(map(float, sigma)) if isinstance(sigma, list | tuple) else (float(sigma),) * 3
    return lambda df, a: smooth(df, a, shape, sigma, block)


def watershed(
    df: DataFrame, affs: Sequence[str], shape, thresholds: Sequence[float] = (0.2, 0.35, 0.5), fragments_in_xy: bool = True, min_seed_distance: int = 10, merge_function: str = "mean",
    mask: DataFrame | None = None, block=(8, 64, 64), context=None, epsilon_agglomerate: float = 0.0, filter_fragments: float = 0.1, remove_debris: int = 64, bias=None, noise_eps=None, seed_eps: float | None = None,
    sigma=None,
) -> dict[str, DataFrame]:
    """Block-wise ``ws``: fragments, nodes, edges, lut (threshold, fragment, segment) and segmentation (threshold, z, y, x, segment)."""
    if mask is not None:
        df = apply_mask(df, mask, list(affs))
    shifted = shift_affinities(df, affs, bias, noise_eps, _smoother(shape, sigma, block))
    frags = cut(fragments(shifted, tuple(affs), shape, fragments_in_xy, min_seed_distance, block, context, seed_eps))
    if filter_fragments:
        frags = objects.affinity_filter(df.join(frags, list(AXES)), "fragment", list(affs), filter_fragments).where("fragment <> 0").select(*AXES, "fragment")
    if remove_debris:
        frags = objects.remove_debris(frags, "fragment", remove_debris).where("fragment <> 0")
    context = context or tuple(max(1, s // 8) for s in block)
    if epsilon_agglomerate:
        frags = cut(apply_lut(frags, "fragment", merge_within_blocks(frags, df, affs, epsilon_agglomerate, block)))
    nodes, edges = scored_graph(frags, df, affs, merge_function, block, context)
    edges = cut(edges)
    lut = threshold_sweep(nodes, edges, list(thresholds))
    return {"fragments": frags, "nodes": nodes, "edges": edges, "lut": lut, "segmentation": frags.join(lut, "fragment").select("threshold", *AXES, "segment")}


def agglomeration_history(frags: DataFrame, df: DataFrame, affs: Sequence[str], block=(64, 64, 64), stop: float = np.inf) -> DataFrame:
    """(block, step, a, b, c, score): greedy merging of the boundaries of each block, on the graph of that block alone."""
    both = df.join(frags, list(AXES))
    steps = [tuple(-1 if a == k else 0 for a in range(3)) for k in range(3)]
    from .neighbors import shifted_pairs

    pairs = shifted_pairs(both, steps, ["fragment", *affs]).where("fragment <> n_fragment")
    cell = [F.floor(F.col(a) / b) for a, b in zip(AXES, block)]
    number = F.shiftleft(cell[0], 40) + F.shiftleft(cell[1], 20) + cell[2]
    e = pairs.groupBy(number.alias("block"), F.least("fragment", "n_fragment").alias("u"), F.greatest("fragment", "n_fragment").alias("v"))
    e = e.agg(F.count("*").alias("n"), F.sum(F.element_at(F.array(*affs), F.col("o") + 1)).alias("total"))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["u", "v"])
        rows = kernels.agglomerate(pdf["u"], pdf["v"], pdf["n"], pdf["total"], stop)
        return pd.DataFrame([(pdf["block"].iloc[0], *r) for r in rows], columns=["block", "step", "a", "b", "c", "score"]).astype({"block": "int64", "step": "int64", "a": "int64", "b": "int64", "c": "int64", "score": float})

    return e.groupBy("block").applyInPandas(run, "block long, step long, a long, b long, c long, score double")


def mutex(
    df: DataFrame, affs: Sequence[str], shape, aff_neighborhood, bias: Sequence[float], strides=None, randomized_strides: bool = False, mask: DataFrame | None = None, block=(16, 64, 64), context=None,
    filter_fragments: float | None = None, remove_debris: int = 64, noise_eps: float | None = 0.001, sigma=None, global_bias: tuple[float, float] = (1.0, -0.5), min_seed_distance: int | None = None, seed: int = 0,
) -> dict[str, DataFrame]:
    """Block-wise ``mws``: mutex-watershed fragments of blocks, their mean boundary affinities, a global mutex partition with biases for short and long offsets, and the relabelled volume.

    ``aff_neighborhood`` has an offset for each channel, ``bias`` and ``strides`` go with it. Fragments whose mean
    affinity is below ``filter_fragments`` go. ``min_seed_distance`` is held by configurations; there are no seeds here.
    """
    offsets = [tuple(o) for o in aff_neighborhood]
    if len(bias) != len(offsets) or len(affs) != len(offsets):
        raise ValueError("a channel and a bias for each offset are required")
    if mask is not None:
        df = apply_mask(df, mask, list(affs))
    shifted = shift_affinities(df, affs, None, noise_eps, _smoother(shape, sigma, block), seed)
    context = context or tuple(max(1, s // 8) for s in block)

    def run(a):
        x = np.stack([a[c] for c in affs])
        lab = kernels.affinity_mutex_watershed(x, offsets, bias, strides, mask=x.max(0) > 0, randomized=randomized_strides, seed=seed)
        return kernels.components(lab)[0]

    frags = cut(BlockOp(run, tuple(affs), block, context, unique_ids=True, skip_below=1e-3).apply(shifted, shape, "fragment"))
    if filter_fragments:
        frags = objects.affinity_filter(df.join(frags, list(AXES)), "fragment", list(affs), filter_fragments).where("fragment <> 0").select(*AXES, "fragment")
    if remove_debris:
        frags = objects.remove_debris(frags, "fragment", remove_debris).where("fragment <> 0")
    from .neighbors import shifted_pairs

    pairs = shifted_pairs(df.join(frags, list(AXES)), offsets, ["fragment", *affs]).where("fragment <> n_fragment")
    value = F.element_at(F.array(*affs), F.col("o") + 1)
    short = [k for k, o in enumerate(offsets) if sum(map(abs, o)) == 1]
    kind = F.when(F.col("o").isin(short), 0).otherwise(1)
    edges = pairs.groupBy(F.least("fragment", "n_fragment").alias("u"), F.greatest("fragment", "n_fragment").alias("v"), kind.alias("far")).agg(F.avg(value).alias("aff"))
    signed = edges.select("u", "v", F.when(F.col("far") == 0, F.col("aff") - 1 + global_bias[0]).otherwise(F.col("aff") + global_bias[1]).alias("score"))
    nodes = objects.centroids(frags, "fragment")
    lut = cut(mutex_partition(nodes, signed))
    return {"fragments": frags, "nodes": nodes, "edges": signed, "lut": lut, "segmentation": apply_lut(frags, "fragment", lut, "segment")}


def threshold_components(
    df: DataFrame, affs: Sequence[str], shape=None, threshold: float = 0.5, mask: DataFrame | None = None, noise_eps=None, remove_debris: int = 64, seed: int = 0, sign: int = 1, sigma=None, block=(64, 64, 64)
) -> DataFrame:
    """``cc``: (z, y, x, component) of the first three channels above a threshold, small parts removed; distributed over the whole volume."""
    affs = list(affs)[:3]
    if mask is not None:
        df = apply_mask(df, mask, affs)
    out = cut(affinity_components(shift_affinities(df, affs, None, noise_eps, _smoother(shape, sigma, block), seed), affs, threshold, sign))
    return objects.remove_debris(out, "component", remove_debris).where("component <> 0") if remove_debris else out


METHODS: dict[str, Callable] = {"ws": watershed, "mws": mutex, "cc": threshold_components}


def run_method(method: str, df: DataFrame, affs: Sequence[str], shape, config=None, overrides=None, **more) -> DataFrame:
    """The segmentation by a method's resolved parameters: defaults, then the configuration's, then overrides. ``more`` holds the mask, blocks and the like."""
    got = METHODS[method](df, affs, shape, **resolve(method, config, overrides), **more)
    return got["segmentation"] if isinstance(got, dict) else got.withColumnRenamed("component", "segment")
