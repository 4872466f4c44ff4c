"""Connected components of an edge list by contraction and alternating large-star and small-star steps.

Tasks that hold at most ``CONTRACT`` edges each contract them to a spanning forest of stars, which shortens
paths and drops repeated edges without a shuffle; as the edges get fewer so do the tasks, and once one task's
share holds them all its stars are the components. Until then each round takes the two star steps. A step is
a group-by on a node and never gathers a neighbourhood: the minimum is a partially aggregated ``min``, and the
neighbours are rewired by a join that deals the neighbours of hot nodes at random. The number of rounds grows
with the logarithm of the longest path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, release
from ..plans.shipping import ship
from .kernels import flat_components
from .keyjoin import join_counted

#: A task contracts about so many edges.
CONTRACT = 1 << 20


def _contract(batches):
    """(u, v): for a task's edges, every node that is not the least of its component with the least one."""

    def stars(held):
        u, v = map(np.concatenate, zip(*held))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = flat_components(len(ids), at[: len(u)], at[len(u) :])
        far = np.flatnonzero(root != np.arange(len(ids)))
        return ids[far], ids[root[far]]

    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n > 2 * CONTRACT:  # partitions are uneven; a forest takes the place of its edges, unless it is as large
            held = [stars(held)]
            if (n := len(held[0][0])) > CONTRACT:
                yield pa.record_batch(list(map(pa.array, held[0])), ["u", "v"])
                held, n = [], 0
    if n:
        yield pa.record_batch(list(map(pa.array, stars(held))), ["u", "v"])


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    return edges.select("u", "v").coalesce(tasks).mapInArrow(_contract, "u long, v long")


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """edges: (u, v), u > v. Returns (u, v), u > v, after one large-star or small-star step."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = both.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("m")).select("u", F.least("u", "least").alias("least"), "m")
    joined = join_counted(both, low, ["u"], 2 * total)
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    out = joined.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return out.unionByName(low.select("u", F.col("least").alias("v")))


def _open(edges: DataFrame) -> tuple[int, int]:
    """(nodes that keep the edges from being stars around least nodes, number of edges)."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    bad = F.sum(((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).cast("long"))
    return tuple(x or 0 for x in per.agg(bad, F.sum("up")).first())


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    Self loops, repeated edges and either direction are accepted; edges with a null end are ignored. No edge:
    an empty frame. A node without edges does not appear; callers give it its own id.
    """
    ship(edges.sparkSession)
    e = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    for _ in range(max_rounds):
        tasks = max(1, -(-e.count() // CONTRACT))
        before, e = e, cut(_contracted(e, tasks))
        release(before)
        if tasks == 1:  # at most CONTRACT edges: one task has seen them all
            break
        open_, total = _open(e)
        if not open_:
            break
        large = cut(_star(e, True, total).where("u <> v").distinct())
        before, e = e, cut(_star(large, False, total).where("u <> v").distinct())
        release(before, large)
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
