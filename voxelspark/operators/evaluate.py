"""Segmentation metrics: contingency tables, variation of information, RAND, run lengths, error maps, edits.

Definitions (base 2, p over voxels whose ground truth is not 0): ``voi_split = H(seg | gt)``,
``voi_merge = H(gt | seg)``, ``nvi`` a term over the joint entropy, ``rand_split = sum p^2 / sum p_gt^2``,
``rand_merge = sum p^2 / sum p_seg^2``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roi import AXES
from ..plans.lineage import cut, stored, sweep
from .components import connected_components
from .neighbors import shifted_pairs


def contingency(df: DataFrame, gt: str, seg: str) -> DataFrame:
    """(gt, seg, n) of the voxels with ground truth."""
    return df.where(F.col(gt) != 0).groupBy(F.col(gt).alias("gt"), F.col(seg).alias("seg")).agg(F.count("*").alias("n"))


def _entropy(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): - sum p log2 p of the counts n out of ``all``, per key."""
    p = F.col("n") / F.col("all")
    term = F.sum(-p * F.log2(p))
    return counts.groupBy(*keys).agg(term.alias(name)) if keys else counts.agg(term.alias(name))


def rand_voi(df: DataFrame, gt: str, seg: str, keys: list[str] | None = None) -> DataFrame:
    """One row per key (one in all without keys): voi_split, voi_merge, voi_sum, nvi_split, nvi_merge, nvi_sum, rand_split, rand_merge.

    The three counts are one aggregation by grouping sets over the contingency table, which is small.
    """
    keys = keys or []
    table = df.where(F.col(gt) != 0).groupBy(*keys, F.col(gt).alias("gt"), F.col(seg).alias("seg")).agg(F.count("*").alias("n"))
    lit = F.lit(0).alias("_one")
    table = table.select(*keys, lit, "gt", "seg", "n")
    by = [*keys, "_one"]
    total = table.groupBy(*by).agg(F.sum("n").alias("all"))
    joint = table.groupBy(*by).agg(F.sum(F.col("n") * F.log2("n")).alias("jl"), F.sum(F.col("n").cast("double") * F.col("n")).alias("j2"))
    one = lambda c: table.groupBy(*by, c).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(F.col("n") * F.log2("n")).alias(f"{c}l"), F.sum(F.col("n").cast("double") * F.col("n")).alias(f"{c}2"))
    m = total.join(joint, by).join(one("gt"), by).join(one("seg"), by)
    # H = log2(all) - sum n log2 n / all
    h = lambda c: F.log2("all") - F.col(c) / F.col("all")
    m = m.withColumn("hj", h("jl")).withColumn("voi_split", F.col("hj") - h("gtl")).withColumn("voi_merge", F.col("hj") - h("segl"))
    nvi = lambda c: F.when(F.col("hj") > 1e-12, c / F.col("hj")).otherwise(0.0)
    split, merge = F.col("voi_split"), F.col("voi_merge")
    return m.select(
        *keys, "voi_split", "voi_merge", (split + merge).alias("voi_sum"), nvi(split).alias("nvi_split"), nvi(merge).alias("nvi_merge"), nvi(split + merge).alias("nvi_sum"),
        (F.col("j2") / F.col("gt2")).alias("rand_split"), (F.col("j2") / F.col("seg2")).alias("rand_merge"),
    )


def voi_per_cluster(df: DataFrame, gt: str, seg: str) -> DataFrame:
    """(side, id, n, voi): each object's share of voi_split (side gt) and of voi_merge (side seg)."""
    table = contingency(df, gt, seg)
    total = table.agg(F.sum("n").alias("all"))

    def side(c, name):
        w = Window.partitionBy(c)
        q = table.select(F.col(c).alias("id"), "n", F.sum("n").over(w).alias("m")).join(F.broadcast(total))
        return q.groupBy(F.lit(name).alias("side"), "id").agg(F.sum("n").alias("n"), F.sum(-(F.col("n") / F.col("all")) * F.log2(F.col("n") / F.col("m"))).alias("voi"))

    return side("gt", "gt").unionByName(side("seg", "seg"))


def worst(clusters: DataFrame, k: int = 10) -> DataFrame:
    """The k clusters with the largest entropy, ties by id."""
    return clusters.orderBy(F.desc("voi"), "id").limit(k)


def best_thresholds(metrics: DataFrame, *names: str) -> DataFrame:
    """(metric, threshold, value): for each metric its least value's threshold, the lower of equal ones; null where it has no value."""
    rows = metrics.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), "threshold", F.col(n).cast("double").alias("value")) for n in names])).alias("r")).select("r.*")
    best = F.min(F.when(F.col("value").isNotNull(), F.struct("value", "threshold")))
    return rows.groupBy("metric").agg(best.alias("b")).select("metric", "b.threshold", "b.value")


def affinity_error(df: DataFrame, pred: list[str], seg: str, offsets) -> DataFrame:
    """(z, y, x, diff): the sum over offsets of the squared difference of predicted and segmentation affinities, where the neighbour exists."""
    got = shifted_pairs(df, offsets, [seg, *pred])
    aff = ((F.col(seg) == F.col(f"n_{seg}")) & (F.col(seg) != 0)).cast("double")
    p = F.element_at(F.array(*pred), F.col("o") + 1)
    return got.groupBy(*AXES).agg(F.sum(F.pow(p - aff, 2)).alias("diff"))


def vector_error(a: Column, b: Column) -> Column:
    """The sum of squared differences of two descriptor arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def error_map(df: DataFrame, diff: str, block: tuple | None = None) -> DataFrame:
    """``error``: differences over their maximum, of the whole volume or of each block; 0 where that is 0."""
    if block is None:
        top = df.agg(F.max(diff).alias("_top"))
        df = df.join(F.broadcast(top))
    else:
        df = df.withColumn("_top", F.max(diff).over(Window.partitionBy(*[F.floor(F.col(a) / b) for a, b in zip(AXES, block)])))
    return df.withColumn("error", F.when(F.col("_top") > 0, F.col(diff) / F.col("_top")).otherwise(0.0)).drop("_top")


def edge_lengths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(skel, u, v, length) of skeleton edges."""
    at = lambda s: nodes.select(F.col("node").alias(s), F.col("skel").alias(f"{s}_skel"), *[F.col(a).alias(f"{s}{a}") for a in AXES])
    got = edges.join(at("u"), "u").join(at("v"), "v")
    d = sum((F.pow(F.col(f"u{a}") - F.col(f"v{a}"), 2) for a in AXES), F.lit(0.0))
    return got.select(F.col("u_skel").alias("skel"), "u", "v", F.sqrt(d).alias("length"))


def skeleton_lengths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return edge_lengths(nodes, edges).groupBy("skel").agg(F.sum("length").alias("length"))


def run_lengths(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(skel, segment, run): lengths of a skeleton within a segment, of edges with both ends in it; labels is (node, segment).

    Runs of segments that touch several skeletons are 0: a merge is right about nothing.
    """
    lab = labels.where("segment <> 0")
    on = nodes.join(lab, "node").select("skel", "segment").distinct()
    merging = on.groupBy("segment").agg(F.count("*").alias("skels")).withColumn("merging", F.col("skels") > 1).select("segment", "merging")
    e = edge_lengths(nodes, edges).join(lab.select(F.col("node").alias("u"), F.col("segment")), "u").join(lab.select(F.col("node").alias("v"), F.col("segment").alias("s2")), "v").where("segment = s2")
    runs = e.groupBy("skel", "segment").agg(F.sum("length").alias("run"))
    return runs.join(merging, "segment").select("skel", "segment", F.when(F.col("merging"), 0.0).otherwise(F.col("run")).alias("run"))


def expected_run_length(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: erl, the same for a perfect labelling (perfect_erl), nerl and total_length.

    erl is the sum over runs of run^2 over the total length: each skeleton counts by its length.
    """
    per = skeleton_lengths(nodes, edges).agg(F.sum("length").alias("total_length"), F.sum(F.pow("length", 2)).alias("best"))
    runs = run_lengths(nodes, edges, labels).agg(F.coalesce(F.sum(F.pow("run", 2)), F.lit(0.0)).alias("got"))
    m = per.join(F.broadcast(runs))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return m.select(ratio("got", "total_length").alias("erl"), ratio("best", "total_length").alias("perfect_erl"), ratio("got", "best").alias("nerl"), "total_length")


def merge_split_stats(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: merges (skeletons beyond the first in each segment), the same without segment 0, splits (segments beyond the first of each skeleton), segments, skeletons."""
    on = nodes.join(labels, "node").select("skel", "segment").distinct()
    seg = on.groupBy("segment").agg(F.count("*").alias("k"))
    skel = on.groupBy("skel").agg(F.count("*").alias("k"))
    a = seg.agg(F.sum(F.col("k") - 1).alias("merges"), F.sum(F.when(F.col("segment") != 0, F.col("k") - 1).otherwise(0)).alias("merges_non0"), F.count("*").alias("segments"))
    b = skel.agg(F.sum(F.col("k") - 1).alias("splits"), F.count("*").alias("skeletons"))
    return a.join(F.broadcast(b)).select("merges", "merges_non0", "splits", "segments", "skeletons")


def min_cut_edits(fragments: DataFrame, edges: DataFrame, sites: DataFrame) -> DataFrame:
    """(segment, splits, extra_merges) of merging segments: cuts between skeletons, and merges that the cuts then cost.

    fragments (fragment, segment), edges (u, v, score; null counts as 1), sites (skel, fragment). In a segment
    that several skeletons touch, fragments touched by more than one are unsplittable and dropped; with at
    most one skeleton left nothing is to cut. The skeletons' sets are then cut apart one after another, each by
    a minimum cut of weights 1 - score from the others; splits counts the cut edges, extra merges the pieces
    beyond one per skeleton.

    Touched fragments have their side given, so a minimum cut falls apart into one for each island: fragments that
    no skeleton touches and that hang together without those that one does. Of an island of one fragment the cut is a
    comparison of sums, in decimals of 12 places; a larger island's graph is one task's work.
    """
    touched = cut(sites.where("skel is not null").join(fragments, "fragment").select("segment", "fragment", "skel").distinct())
    merging = touched.groupBy("segment").agg(F.count_distinct("skel").alias("k")).where("k > 1").select("segment")
    owner = touched.groupBy("segment", "fragment").agg(F.min("skel").alias("skel"), (F.min("skel") != F.max("skel")).alias("shared"))
    split = owner.where("not shared").groupBy("segment").agg(F.count_distinct("skel").alias("skels")).where("skels > 1")
    nodes = fragments.join(split.select("segment"), "segment", "left_semi").join(owner, ["segment", "fragment"], "left")
    nodes = cut(nodes.where("shared is null or not shared").select("fragment", "segment", "skel"))

    weight = F.greatest(F.lit(1e-9), 1 - F.coalesce("score", F.lit(1.0))).cast("decimal(28,12)")
    at = lambda c: nodes.select(F.col("fragment").alias(c), F.col("segment").alias(f"s{c}"), F.col("skel").alias(f"k{c}"))
    pairs = edges.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), weight.alias("w")).join(at("a"), "a").join(at("b"), "b").where("sa = sb")
    # dealt by b as the join left them, so repeated edges are summed without another shuffle
    pairs = pairs.groupBy("b", "a", F.col("sa").alias("segment"), "ka", "kb").agg(F.sum("w").alias("w"))
    with stored(pairs) as pairs:
        inner = pairs.where("ka is null and kb is null")
        islands = cut(connected_components(inner, "a", "b"))
        # (segment, x, y, skel, w): free fragments and their touched neighbours
        half = lambda x, y: pairs.where(f"k{x} is null and k{y} is not null").select("segment", F.col(x).alias("x"), F.col(y).alias("y"), F.col(f"k{y}").alias("skel"), "w")
        rim = half("b", "a").unionByName(half("a", "b"))
        sums = rim.groupBy("segment", "x", "skel").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
        alone = sums.join(islands.select(F.col("node").alias("x")), "x", "left_anti")
        later = Window.partitionBy("segment", "x").orderBy(F.desc("skel")).rowsBetween(Window.unboundedPreceding, -1)
        alone = alone.withColumn("later", F.coalesce(F.sum("w").over(later), F.lit(0)))
        alone = alone.groupBy("segment", "x").agg(F.min(F.when(F.col("w") > F.col("later"), F.col("skel"))).alias("side"))
        sides = cut(alone if islands.isEmpty() else alone.unionByName(_island_sides(inner, sums, islands)))
        sweep(pairs.sparkSession)
        stay = cut(_uncut(pairs, rim, sides))
        counts = cut(pairs.groupBy("segment").agg(F.count("*").alias("all")))
    kept = stay.groupBy("segment").agg(F.count("*").alias("kept"))
    comps = connected_components(stay, "x", "y")
    ends = nodes.where("skel is not null").join(comps, F.col("fragment") == F.col("node"), "left")
    pieces = ends.groupBy("segment").agg(F.count_distinct(F.coalesce("component", "fragment")).alias("pieces"))
    got = merging.join(split, "segment", "left").join(counts, "segment", "left").join(kept, "segment", "left").join(pieces, "segment", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    return cut(got.select("segment", (none(F.col("all")) - none(F.col("kept"))).alias("splits"), F.greatest(F.lit(0), none(F.col("pieces") - F.col("skels"))).cast("long").alias("extra_merges")))


def _island_sides(inner: DataFrame, sums: DataFrame, islands: DataFrame) -> DataFrame:
    """(segment, x, side) of the fragments of islands of several: the skeleton that each stays with; null where none touches its island."""
    at = islands.select(F.col("node").alias("x"), F.col("component").alias("island"))
    none = F.lit(None).cast("long")
    rows = inner.select("segment", F.col("a").alias("x"), F.col("b").alias("y"), none.alias("skel"), "w").unionByName(sums.select("segment", "x", none.alias("y"), "skel", "w")).join(at, "x")
    rows = rows.select("segment", "island", "x", "y", F.col("skel").cast("long").alias("skel"), F.col("w").cast("double").alias("w"))

    def one(pdf):
        import pandas as pd

        from .kernels import island_sides

        got = island_sides(pdf)
        return pd.DataFrame({"segment": pdf["segment"].iloc[0], "x": list(got), "side": pd.array(list(got.values()), "Int64")})

    return rows.groupBy("island").applyInPandas(one, "segment long, x long, side long")


def _uncut(pairs: DataFrame, rim: DataFrame, sides: DataFrame) -> DataFrame:
    """(segment, x, y) of the edges with both ends on one side."""
    out = rim.select("segment", "x", "y", F.col("skel").alias("side")).join(sides, ["segment", "x", "side"], "left_semi").select("segment", "x", "y")
    touching = pairs.where("ka = kb").select("segment", F.col("a").alias("x"), F.col("b").alias("y"))
    at = lambda c: sides.select(F.col("x").alias(c), F.col("side").alias(f"{c}_side"))
    inner = pairs.where("ka is null and kb is null").select("segment", F.col("a").alias("x"), F.col("b").alias("y")).join(at("x"), "x").join(at("y"), "y")
    return out.unionByName(touching).unionByName(inner.where("x_side <=> y_side").select("segment", "x", "y"))


def edits_needed(nodes: DataFrame, labels: DataFrame, cuts: DataFrame) -> DataFrame:
    """One row: splits needed, merges needed (segments of a skeleton beyond one, and those that cuts cost), their sum, and averages by segments and skeletons."""
    s = merge_split_stats(nodes, labels.where("segment <> 0"))
    c = cuts.agg(F.coalesce(F.sum("splits"), F.lit(0)).alias("cut"), F.coalesce(F.sum("extra_merges"), F.lit(0)).alias("extra"))
    m = s.join(F.broadcast(c)).select(F.col("cut").alias("splits_needed"), (F.col("splits") + F.col("extra")).alias("merges_needed"), "segments", "skeletons")
    total = F.col("splits_needed") + F.col("merges_needed")
    return m.withColumn("total_edits", total).withColumn("edits_per_segment", total / F.col("segments")).withColumn("edits_per_skeleton", total / F.col("skeletons"))
