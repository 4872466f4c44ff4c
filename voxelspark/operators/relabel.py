"""Relabelling: every remap is a left equi-join with the identity as its default."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roi import AXES


def apply_lut(df: DataFrame, value: str, lut: DataFrame, out: str | None = None) -> DataFrame:
    """Values through (fragment, segment); ids that are not in it stay. Repeated fragments: the smallest segment."""
    one = lut.groupBy(F.col("fragment").alias("_f")).agg(F.min("segment").alias("_s"))
    got = df.join(one, F.col(value) == F.col("_f"), "left")
    return got.withColumn(out or value, F.coalesce("_s", value)).drop("_f", "_s")


def remap_rules(spark, remove: Iterable[int] = (), merge: Iterable[Iterable[int]] = ()) -> DataFrame:
    """(fragment, segment) of a manual edit: removed ids to 0, each group to its first id; a later group wins.

    An id both removed and merged is an error. Groups that share ids are not joined with one another.
    """
    remove, rules = set(remove), {}
    for group in merge:
        group = list(group)
        for i in group:
            if i in remove:
                raise ValueError(f"{i} is both removed and merged")
            rules[i] = group[0]
    rules |= dict.fromkeys(remove, 0)
    return spark.createDataFrame(sorted(rules.items()), "fragment long, segment long")


def manual_remap(df: DataFrame, value: str, remove: Iterable[int] = (), merge: Iterable[Iterable[int]] = ()) -> DataFrame:
    return apply_lut(df, value, remap_rules(df.sparkSession, remove, merge))


def merge_to_largest(spark, ids: list[int]) -> DataFrame:
    """The rule of the interactive merge: all ids become the largest."""
    return spark.createDataFrame([(i, max(ids)) for i in ids], "fragment long, segment long")


def compact_ids(df: DataFrame, value: str) -> DataFrame:
    """Foreground ids renumbered 1, 2, ... in order; 0 stays.

    Ranks are counted within ranges of ids and shifted by the counts before, so no task holds all ids.
    """
    ids = df.where(F.col(value) != 0).select(F.col(value).alias("id")).distinct().repartitionByRange("id").withColumn("part", F.spark_partition_id())
    from ..plans.lineage import cut

    ids = cut(ids)
    counts = sorted(map(tuple, ids.groupBy("part").count().collect()))
    base, offsets = 0, []
    for part, n in counts:
        offsets.append((part, base))
        base += n
    offs = df.sparkSession.createDataFrame(offsets, "part int, base long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    lut = ids.join(F.broadcast(offs), "part").select(F.col("id").alias("fragment"), (rank + F.col("base")).alias("segment"))
    return apply_lut(df, value, lut)


def sites_to_labels(sites: DataFrame, volume: DataFrame, value: str, offset=(0, 0, 0), voxel_size=(1, 1, 1), keep_background: bool = False) -> DataFrame:
    """The label under each point (z, y, x in world units); background sites go, or stay as 0."""
    at = [F.floor((F.col(a) - o) / v).cast("long").alias(f"_{a}") for a, o, v in zip(AXES, offset, voxel_size)]
    vox = volume.select(*[F.col(a).alias(f"_{a}") for a in AXES], F.col(value).alias("label"))
    got = sites.select("*", *at).join(vox, [f"_{a}" for a in AXES], "left").drop(*[f"_{a}" for a in AXES])
    got = got.withColumn("label", F.coalesce("label", F.lit(0)))
    return got if keep_background else got.where("label <> 0")


def sites_to_segments(sites: DataFrame, lut: DataFrame) -> DataFrame:
    """Sites with a label that the table knows, with its segment."""
    return sites.join(lut.select(F.col("fragment").alias("label"), "segment"), "label")


def segment_subgraph(edges: DataFrame, lut: DataFrame, segment: int) -> tuple[DataFrame, DataFrame]:
    """(fragments, edges among them) of one segment."""
    ids = lut.where(F.col("segment") == segment).select("fragment")
    e = edges.join(ids.withColumnRenamed("fragment", "u"), "u", "left_semi").join(ids.withColumnRenamed("fragment", "v"), "v", "left_semi")
    return ids, e
