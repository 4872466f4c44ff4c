"""Volumes, graphs and skeletons made from the driver's tables, in the same way in Spark and in SQL.

``VOXELS`` and its companions are SQL with the same meaning in both dialects, so a query and its oracle start
from one definition. Sums of decimals and rounded averages keep doubles comparable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse volume (z, y, x, label, seg, raw): months by part by supplier; absent cells are 0."""
    li = table(spark, sf_dir, "lineitem")
    z = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    cells = li.select(
        z.cast("long").alias("z"), F.pmod("l_partkey", F.lit(SIDE)).cast("long").alias("y"), F.pmod("l_suppkey", F.lit(SIDE)).cast("long").alias("x"),
        F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"),
    )
    return cells.groupBy("z", "y", "x").agg(
        F.min(F.col("p") % 7).cast("long").alias("label"), F.max(F.col("s") % 5).cast("long").alias("seg"), F.round(F.avg("q"), 6).alias("raw")
    )


VOXELS = f"""vox AS (SELECT ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::BIGINT z, (l_partkey % {SIDE})::BIGINT y, (l_suppkey % {SIDE})::BIGINT x,
  min(l_partkey % 7)::BIGINT "label", max(l_suppkey % 5)::BIGINT seg, round(avg(l_quantity), 6) raw FROM lineitem GROUP BY 1, 2, 3)"""


def affinity_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, y, x, az, ay, ax): made-up affinities in [0, 1] of each cell, a fixed function of its values."""
    v = voxels(spark, sf_dir)
    one = lambda c, k: F.round(((F.col("raw") * k + F.col(c) * 13) % 50) / 50.0, 6)
    return v.select("z", "y", "x", one("label", 3).alias("az"), one("seg", 7).alias("ay"), one("label", 11).alias("ax"))


AFFS = VOXELS + """, affs AS (SELECT z, y, x, round(((raw * 3 + "label" * 13) % 50) / 50.0, 6) az, round(((raw * 7 + seg * 13) % 50) / 50.0, 6) ay, round(((raw * 11 + "label" * 13) % 50) / 50.0, 6) ax FROM vox)"""


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fragment, segment): the first supplier of a part."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("fragment")).agg(F.min("l_suppkey").alias("segment"))


LUT = "lut AS (SELECT l_partkey fragment, min(l_suppkey) segment FROM lineitem GROUP BY 1)"


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v, score): suppliers u and parts v + 1000000 of all orders, scored by their mean discount; unscored where the tax is high."""
    score = F.when(F.max("l_tax") < 0.08, F.round(F.avg("l_discount"), 6))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("u"), (F.col("l_partkey") + 1000000).alias("v")).agg((score + 0.0).alias("score"))


GRAPH = "edges AS (SELECT l_suppkey u, l_partkey + 1000000 v, CASE WHEN max(l_tax) < 0.08 THEN round(avg(l_discount), 6) + 0.0 END score FROM lineitem GROUP BY 1, 2)"


def skeletons(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): one path per order, its lines by line number; (node, skel, z, y, x) and (u, v)."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    nodes = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("node"), F.col("l_orderkey").alias("skel"), F.col("q").alias("z"), (F.col("p") % SIDE).cast("double").alias("y"), (F.col("s") % SIDE).cast("double").alias("x"))
    nxt = nodes.select(F.col("node").alias("v"), F.col("skel").alias("vs"), (F.col("node") - 1).alias("u"))
    edges = nodes.select(F.col("node").alias("u"), "skel").join(nxt, "u").where("skel = vs").select("u", "v")
    return nodes, edges


SKELETONS = f"""sk AS (SELECT l_orderkey * 10 + l_linenumber node, l_orderkey skel, max(l_quantity) z, (max(l_partkey) % {SIDE})::DOUBLE y, (max(l_suppkey) % {SIDE})::DOUBLE x
  FROM lineitem GROUP BY l_orderkey, l_linenumber), ske AS (SELECT a.node u, b.node v FROM sk a JOIN sk b ON b.node = a.node + 1 AND a.skel = b.skel)"""
