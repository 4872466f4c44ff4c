"""The query catalogue: each operator applied to whole tables, with a DuckDB oracle where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.roi import Roi
from ..operators import augment, blocks, evaluate, graphs, neighbors, objects, relabel, resample, segment, select
from ..sources import derive, volumes
from . import prepare, training
from ..sources.derive import AFFS, GRAPH, LUT, SKELETONS, VOXELS
from .lineage import cut, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ZYX = ["z", "y", "x"]
OFFSETS = [(-1, 0, 0), (0, -1, 0), (0, 0, -1), (0, -2, 0)]
ROI = Roi((6, 8, 8), (24, 24, 24))
_IN_ROI = "z >= 6 AND z < 30 AND y >= 8 AND y < 32 AND x >= 8 AND x < 32"
SHAPE = (84, 48, 48)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c: str, places: int = 8, name: str | None = None):
    """Rounded, without a negative zero, as doubles compare."""
    return (F.round(F.col(c), places) + 0.0).alias(name or c)


# --- volumes, selections, projections


@query(f"WITH {VOXELS} SELECT z, count(*) n, count(*) FILTER (\"label\" > 0) foreground, round(avg(raw), 6) + 0.0 mean_raw FROM vox GROUP BY 1")
def volume_slices(spark, d):
    v = derive.voxels(spark, d)
    return v.groupBy("z").agg(F.count("*").alias("n"), F.count_if(F.col("label") > 0).alias("foreground"), F.avg("raw").alias("mean_raw")).select("z", "n", "foreground", _r("mean_raw", 6))


@query(f"""WITH {VOXELS} SELECT a.range z, b.range y, c.range x, coalesce(v.raw, 0.0) raw, coalesce(v."label", 0)::BIGINT "label" FROM range(6, 30) a, range(8, 32) b, range(8, 32) c
LEFT JOIN vox v ON v.z = a.range AND v.y = b.range AND v.x = c.range""")
def roi_scan_fill(spark, d):
    return select.roi_scan(derive.voxels(spark, d), ROI, ["raw", "label"]).select(*ZYX, "raw", F.col("label").cast("long").alias("label"))


@query(f'WITH {VOXELS} SELECT min(z) min_z, max(z) max_z, min(y) min_y, max(y) max_y, min(x) min_x, max(x) max_x, count(*) n FROM vox WHERE "label" > 0')
def bbox(spark, d):
    return select.bounding_box(derive.voxels(spark, d), "label")


@query(f"""WITH {VOXELS}, b AS (SELECT greatest(min(z) - 1, 0) oz, max(z) + 1 ez, greatest(min(y) - 1, 0) oy, max(y) + 1 ey, greatest(min(x) - 1, 0) ox, max(x) + 1 ex FROM vox WHERE "label" > 5)
SELECT z - oz z, y - oy y, x - ox x, CASE WHEN "label" > 5 THEN "label" ELSE 0 END::BIGINT "label", oz off_z, oy off_y, ox off_x FROM vox, b WHERE z BETWEEN oz AND ez AND y BETWEEN oy AND ey AND x BETWEEN ox AND ex""")
def bbox_crop(spark, d):
    v = derive.voxels(spark, d).select(*ZYX, F.when(F.col("label") > 5, F.col("label")).otherwise(0).cast("long").alias("label"))
    return select.crop_to_foreground(v, "label", 1)


@query(f'WITH {VOXELS} SELECT z, y, x, ("label" > 0)::INT mask FROM vox')
def object_mask(spark, d):
    return select.object_mask(derive.voxels(spark, d), "label").select(*ZYX, "mask")


@query(f'WITH {VOXELS} SELECT z, y, x, CASE WHEN seg > 0 THEN raw ELSE 0 END raw, CASE WHEN seg > 0 THEN "label" ELSE 0 END::BIGINT "label" FROM vox')
def apply_mask(spark, d):
    v = derive.voxels(spark, d)
    return select.apply_mask(v.select(*ZYX, "raw", "label"), v.select(*ZYX, F.col("seg").alias("mask")), ["raw", "label"])


@query(f"WITH {AFFS} SELECT z, y, x, (least(az, ay, ax) > 0)::INT * 1.0 * ay aff FROM affs")
def apply_channel_mask(spark, d):
    a = derive.affinity_volume(spark, d)
    return select.apply_mask(a.select(*ZYX, F.col("ay").alias("aff")), a.select(*ZYX, F.array("az", "ay", "ax").alias("mask")), ["aff"])


@query(f"WITH {AFFS} SELECT z, y, x, (ay > 0.1 AND ay < 0.98)::INT inside, ay > 0.5 above FROM affs")
def band_threshold(spark, d):
    return derive.affinity_volume(spark, d).select(*ZYX, select.band(F.col("ay"), 0.1, 0.98).alias("inside"), select.threshold(F.col("ay"), 0.5).alias("above"))


@query(f'WITH {VOXELS} SELECT z, y, x, "label", seg FROM vox WHERE {_IN_ROI} AND z >= 10 AND "label" > 0 AND seg > 0')
def roi_intersect(spark, d):
    v = derive.voxels(spark, d)
    both = ROI.intersect(Roi((10, 0, 0), (1000, 1000, 1000)))
    return v.where(both.where()).where("label > 0 and seg > 0").select(*ZYX, "label", "seg")


@query(f"WITH {VOXELS} SELECT z, y, x, (raw / (SELECT max(raw) FROM vox) * 255 - 0.4999999999)::BIGINT scaled FROM vox WHERE raw > 0")
def dtype_scale(spark, d):
    return select.scale_dtype(derive.voxels(spark, d), "raw", 255).select(*ZYX, F.col("raw").alias("scaled"))


@query(f"WITH {VOXELS} SELECT z, y, x, round(raw / 255.0, 10) + 0.0 normal, round(raw * 2 - 1, 8) + 0.0 shifted FROM vox")
def normalise_shift(spark, d):
    return derive.voxels(spark, d).select(*ZYX, select.normalise(F.col("raw"), "uint8").alias("n"), select.scale_shift(F.col("raw"), 2, -1).alias("s")).select(*ZYX, _r("n", 10, "normal"), _r("s", 8, "shifted"))


@query(f'WITH {VOXELS} SELECT z, y, x, CASE WHEN "label" IN (2, 3) OR ({_IN_ROI}) THEN 0 ELSE "label" END::BIGINT omitted, CASE WHEN "label" IN (2, 3) OR ({_IN_ROI}) THEN "label" ELSE 0 END::BIGINT kept FROM vox')
def omit_keep(spark, d):
    v = derive.voxels(spark, d).select(*ZYX, F.col("label").alias("omitted"), F.col("label").alias("kept"))
    return v.select(*ZYX, "omitted").transform(lambda x: select.omit(x, "omitted", [2, 3], ROI)).join(select.keep(v.select(*ZYX, "kept"), "kept", [2, 3], ROI), ZYX).select(*ZYX, F.col("omitted").cast("long").alias("omitted"), F.col("kept").cast("long").alias("kept"))


@query(f"""WITH {VOXELS}, b AS (SELECT p_size lz, p_size + 2.5 hz, (p_partkey % 40) + 0.5 ly, (p_partkey % 40) + 4.2 hy, (p_partkey % 37) + 0.25 lx, (p_partkey % 37) + 3.75 hx FROM part)
SELECT z, y, x, EXISTS (SELECT 1 FROM b WHERE z >= floor(lz) AND z < ceil(hz) AND y >= floor(ly) AND y < ceil(hy) AND x >= floor(lx) AND x < ceil(hx))::INT mask FROM vox""")
def box_annotations(spark, d):
    p = derive.table(spark, d, "part")
    b = p.select(
        F.col("p_size").alias("lo_z"), (F.col("p_size") + 2.5).alias("hi_z"), (F.col("p_partkey") % 40 + 0.5).alias("lo_y"), (F.col("p_partkey") % 40 + 4.2).alias("hi_y"),
        (F.col("p_partkey") % 37 + 0.25).alias("lo_x"), (F.col("p_partkey") % 37 + 3.75).alias("hi_x"),
    )
    return select.boxes_to_mask(derive.voxels(spark, d).select(*ZYX), b, 16)


@query(f"WITH {VOXELS}, k AS (SELECT z // 8 bz, y // 16 b_y, x // 16 bx FROM vox GROUP BY 1, 2, 3 HAVING count(*) FILTER (seg > 3) / 2048.0 >= 0.05) SELECT z, y, x, seg FROM vox JOIN k ON bz = z // 8 AND b_y = y // 16 AND bx = x // 16")
def reject_blocks(spark, d):
    v = derive.voxels(spark, d).select(*ZYX, "seg", (F.col("seg") > 3).cast("int").alias("m"))
    return select.accept_blocks(v, "m", [8, 16, 16], 0.05).select(*ZYX, "seg")


@query(f'WITH {VOXELS} SELECT z, y, x, CASE WHEN "label" % 3 = 0 THEN 0 ELSE "label" END::BIGINT "label" FROM vox')
def blackout(spark, d):
    return select.blackout(derive.voxels(spark, d), "label", 3).select(*ZYX, F.col("label").cast("long").alias("label"))


@query(f"WITH {VOXELS} SELECT z, y, x, CASE WHEN z IN (14, 74) THEN 0 ELSE raw END raw FROM vox")
def zero_sections(spark, d):
    return volumes.zero_sections(derive.voxels(spark, d), [14, 74], "raw").select(*ZYX, "raw")


@query(f'WITH {VOXELS} SELECT z // 10 tz, y // 16 ty, x // 16 tx, count(*) n, count(DISTINCT "label") labels FROM vox GROUP BY 1, 2, 3')
def tile_scan(spark, d):
    return volumes.tiles(derive.voxels(spark, d), 10, 16).groupBy("tz", "ty", "tx").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"))


@query(f"WITH {AFFS} SELECT v.z, v.y, v.x, raw, \"label\", az FROM vox v JOIN affs a USING (z, y, x)")
def merge_sources(spark, d):
    return volumes.merge_sources(derive.voxels(spark, d).select(*ZYX, "raw", "label"), derive.affinity_volume(spark, d).select(*ZYX, "az"))


@query(f"WITH {AFFS} SELECT z, y, x, ay c0, ax c1 FROM affs")
def channel_slice(spark, d):
    a = derive.affinity_volume(spark, d).select(*ZYX, F.array("az", "ay", "ax").alias("ch"))
    return select.channels(a, "ch", 1, 2).select(*ZYX, F.col("ch")[0].alias("c0"), F.col("ch")[1].alias("c1"))


@query(f"WITH {VOXELS} SELECT z, y, x, raw FROM vox WHERE {_IN_ROI}")
def volume_store(spark, d):
    import uuid

    from .lineage import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark)}/volume-{uuid.uuid4().hex}"
    volumes.write_volume(derive.voxels(spark, d).select(*ZYX, "raw"), path, volumes.VolumeMeta("raw", "float64", SHAPE), 8)
    return volumes.open_volume(spark, path, ROI, 8).select(*ZYX, "raw")


@query(f"WITH {GRAPH} SELECT u, v, score FROM edges WHERE score <= 0.04")
def graph_store(spark, d):
    import uuid

    from .lineage import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark)}/graph-{uuid.uuid4().hex}"
    volumes.write_graph(None, derive.graph(spark, d), path)
    return volumes.read_graph(spark, {"kind": "parquet", "path": path}, "edges", "score <= 0.04").select("u", "v", "score")


# --- objects


@query('WITH p AS (SELECT l_partkey id, count(*) size FROM lineitem GROUP BY 1) SELECT id, size FROM p WHERE id <> 0')
def object_sizes(spark, d):
    return objects.sizes(derive.table(spark, d, "lineitem"), "l_partkey")


@query(f'WITH {VOXELS} SELECT y * 48 + x id, min(z) min_z, max(z) max_z, max(z) - min(z) + 1 extent FROM vox WHERE y * 48 + x <> 0 GROUP BY 1')
def object_extent(spark, d):
    return objects.z_extents(derive.voxels(spark, d).select("z", (F.col("y") * 48 + F.col("x")).alias("id")), "id")


@query(f'WITH {VOXELS} SELECT "label" id, count(*) size, (5 + 40 * floor(avg(z)))::BIGINT z, (4 * floor(avg(y)))::BIGINT y, (4 * floor(avg(x)))::BIGINT x FROM vox WHERE "label" <> 0 GROUP BY 1')
def object_centroid(spark, d):
    return objects.centroids(derive.voxels(spark, d), "label", (5, 0, 0), (40, 4, 4))


@query(f"WITH {AFFS}, j AS (SELECT a.*, \"label\" FROM affs a JOIN vox USING (z, y, x)) SELECT \"label\" id, round(avg((az + ay + ax) / 3), 8) + 0.0 mean_aff FROM j WHERE \"label\" <> 0 GROUP BY 1")
def fragment_affinity(spark, d):
    v = derive.voxels(spark, d).select(*ZYX, "label").join(derive.affinity_volume(spark, d), ZYX)
    return objects.mean_affinity(v, "label", ["az", "ay", "ax"]).select("id", _r("mean_aff"))


_SIZED = f"WITH {VOXELS}, o AS (SELECT z, y, x, z * 48 + y AS obj FROM vox), s AS (SELECT obj id, count(*) size FROM o WHERE obj <> 0 GROUP BY 1)"


def _objects(spark, d):
    return derive.voxels(spark, d).select(*ZYX, (F.col("z") * 48 + F.col("y")).alias("obj"))


@query(_SIZED + " SELECT z, y, x, CASE WHEN id IS NOT NULL AND (size < 8 OR size > 15) THEN 0 ELSE obj END::BIGINT obj FROM o LEFT JOIN s ON id = obj")
def size_filter(spark, d):
    return objects.size_filter(_objects(spark, d), "obj", 8, 15).select(*ZYX, "obj")


@query(_SIZED + ", m AS (SELECT avg(size) a, stddev_pop(size) b FROM s WHERE size >= 2) SELECT z, y, x, CASE WHEN id IS NOT NULL AND (size < a - b OR size > a + b) THEN 0 ELSE obj END::BIGINT obj FROM o LEFT JOIN s ON id = obj, m")
def outlier_filter(spark, d):
    return objects.outlier_filter(_objects(spark, d), "obj", 1, 2).select(*ZYX, "obj")


@query(f"WITH {VOXELS}, o AS (SELECT z, y, x, (y * 48 + x) * 10 + z // 9 obj FROM vox), e AS (SELECT obj id, max(z) - min(z) + 1 extent FROM o WHERE obj <> 0 GROUP BY 1) SELECT z, y, x, CASE WHEN extent <= 4 THEN 0 ELSE obj END::BIGINT obj FROM o LEFT JOIN e ON id = obj")
def z_filter(spark, d):
    v = derive.voxels(spark, d).select(*ZYX, ((F.col("y") * 48 + F.col("x")) * 10 + F.floor(F.col("z") / 9)).alias("obj"))
    return objects.z_filter(v, "obj", 4).select(*ZYX, "obj")


@query(_SIZED + " SELECT count(*) n, round(avg(size), 8) + 0.0 mean, round(stddev_pop(size), 8) + 0.0 std, quantile_cont(size, 0.5) p50, quantile_cont(size, 0.9) p90, round(quantile_cont(size, 0.99), 8) + 0.0 p99, round(quantile_cont(size, 0.999), 8) + 0.0 p999 FROM s WHERE size >= 2")
def size_percentiles(spark, d):
    s = objects.size_moments(objects.sizes(_objects(spark, d), "obj"), 2)
    return s.select("n", _r("mean"), _r("std"), "p50", "p90", _r("p99"), _r("p999"))


@query(_SIZED + " SELECT count(*) n, min(size) min_size, floor(median(size))::BIGINT median_size, max(size) max_size FROM s")
def size_report(spark, d):
    return objects.size_report(objects.sizes(_objects(spark, d), "obj"))


@query(f"WITH {VOXELS} SELECT round(sum(raw) / 200000, 8) + 0.0 mean, round(sqrt(sum(raw * raw) / 200000 - pow(sum(raw) / 200000, 2)), 6) + 0.0 std, count(*) FILTER (raw > 0) nonzero, 200000::BIGINT total, round(count(*) FILTER (raw > 0) / 200000, 8) + 0.0 ratio FROM vox")
def array_stats(spark, d):
    return objects.array_stats(derive.voxels(spark, d), "raw", 200000).select(_r("mean"), _r("std", 6), "nonzero", "total", _r("ratio"))


@query(f"WITH {VOXELS} SELECT min(raw) min_value, max(raw) max_value FROM vox")
def array_min_max(spark, d):
    return objects.min_max(derive.voxels(spark, d), "raw")


@query(f'WITH {VOXELS}, f AS (SELECT z // 12 slab, "label", count(*) n FROM vox GROUP BY 1, 2), g AS (SELECT *, sum(n) OVER (PARTITION BY slab) a, count(*) OVER (PARTITION BY slab) k FROM f) SELECT z, y, x, v."label", round(a / (k * n), 8) + 0.0 weight FROM vox v JOIN g ON slab = z // 12 AND g."label" = v."label"')
def balance_weights(spark, d):
    return objects.balance_weights(derive.voxels(spark, d), "label", 12).select(*ZYX, "label", _r("weight"))


@query(f"WITH {AFFS}, j AS (SELECT a.*, seg FROM affs a JOIN vox USING (z, y, x)) SELECT round(avg(seg * pow(ay - ax, 2)) FILTER (seg > 0), 8) + 0.0 loss FROM j")
def masked_loss(spark, d):
    v = derive.voxels(spark, d).select(*ZYX, "seg").join(derive.affinity_volume(spark, d), ZYX)
    return objects.masked_loss(v, "ay", "ax", "seg").select(_r("loss"))


# --- relabelling


@query(f"WITH {LUT} SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(segment, l_partkey) segment, count(*) n FROM lineitem LEFT JOIN lut ON fragment = l_partkey AND fragment % 3 <> 0 GROUP BY 1, 2, 3, 4")
def lut_relabel(spark, d):
    lut = derive.lookup(spark, d).where("fragment % 3 <> 0")
    li = derive.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return relabel.apply_lut(li, "l_partkey", lut, "segment").groupBy("l_orderkey", "l_linenumber", "l_suppkey", "segment").agg(F.count("*").alias("n"))


@query(f'WITH {VOXELS} SELECT z, y, x, CASE WHEN "label" IN (5) THEN 0 WHEN "label" IN (1, 6) THEN 6 WHEN "label" IN (2, 3) THEN 2 ELSE "label" END::BIGINT "label" FROM vox')
def remap_merge(spark, d):
    return relabel.manual_remap(derive.voxels(spark, d).select(*ZYX, "label"), "label", [5], [[1, 2], [6, 1], [2, 3]])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 20) THEN 0 ELSE l_partkey END::BIGINT l_partkey, l_quantity FROM lineitem")
def remove_ids(spark, d):
    ids = derive.table(spark, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("id"))
    li = derive.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return select.mask_ids(li, "l_partkey", ids)


@query("SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE r END::BIGINT id FROM lineitem LEFT JOIN (SELECT k, row_number() OVER (ORDER BY k) r FROM (SELECT DISTINCT l_partkey k FROM lineitem WHERE l_partkey % 3 <> 0)) ON k = l_partkey")
def compact_ids(spark, d):
    li = derive.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_partkey") % 3 == 0, 0).otherwise(F.col("l_partkey")).cast("long").alias("id"))
    return relabel.compact_ids(li, "id").select("l_orderkey", "l_linenumber", "l_quantity", F.col("id").cast("long").alias("id"))


_SITES = "sites AS (SELECT c_custkey site, c_custkey % 80 + 0.5 z, c_custkey % 47 + 0.25 y, c_nationkey + 0.75 x FROM customer)"


def _sites(spark, d):
    k = F.col("c_custkey")
    return derive.table(spark, d, "customer").select(k.alias("site"), (k % 80 + 0.5).alias("z"), (k % 47 + 0.25).alias("y"), (F.col("c_nationkey") + 0.75).alias("x"))


@query(f'WITH {VOXELS}, {_SITES}, {LUT} SELECT site, v."label", segment FROM sites s JOIN vox v ON v.z = floor(s.z) AND v.y = floor(s.y) AND v.x = floor(s.x) JOIN lut ON fragment = v."label" WHERE v."label" <> 0')
def site_to_segment(spark, d):
    got = relabel.sites_to_labels(_sites(spark, d), derive.voxels(spark, d), "label")
    return relabel.sites_to_segments(got, derive.lookup(spark, d)).select("site", "label", "segment")


@query(f'WITH {VOXELS}, {_SITES} SELECT count(*) sites, count(*) FILTER (coalesce(v."label", 0) = 0) background FROM sites s LEFT JOIN vox v ON v.z = floor(s.z) AND v.y = floor(s.y) AND v.x = floor(s.x)')
def background_sites(spark, d):
    got = relabel.sites_to_labels(_sites(spark, d), derive.voxels(spark, d), "label", keep_background=True)
    return got.agg(F.count("*").alias("sites"), F.count_if(F.col("label") == 0).alias("background"))


@query(f"WITH {GRAPH}, {LUT}, f AS (SELECT fragment + 1000000 fragment, segment FROM lut UNION SELECT segment, segment FROM lut), k AS (SELECT fragment FROM f WHERE segment = 7) SELECT u, v, score FROM edges WHERE u IN (SELECT * FROM k) AND v IN (SELECT * FROM k)")
def segment_edges(spark, d):
    lut = derive.lookup(spark, d)
    f = lut.select((F.col("fragment") + 1000000).alias("fragment"), "segment").union(lut.select(F.col("segment").alias("fragment"), "segment")).distinct()
    return relabel.segment_subgraph(derive.graph(spark, d), f, 7)[1].select("u", "v", "score")


# --- resampling


@query(f'WITH {VOXELS} SELECT z // 2 z, y // 3 y, x // 3 x, "label" FROM vox WHERE z % 2 = 1 AND y % 3 = 1 AND x % 3 = 1')
def downsample_labels(spark, d):
    return resample.downsample_labels(derive.voxels(spark, d).select(*ZYX, "label"), (2, 3, 3))


@query(f"WITH {VOXELS} SELECT z // 1 z, y // 2 y, x // 2 x, round(sum(raw) / 4, 8) + 0.0 raw FROM vox GROUP BY 1, 2, 3")
def downsample_mean(spark, d):
    return resample.downsample_mean(derive.voxels(spark, d), "raw", (1, 2, 2)).select(*ZYX, _r("raw"))


@query(f'WITH {VOXELS} SELECT z, y * 2 + a.range y, x * 2 + b.range x, "label" FROM vox, range(2) a, range(2) b')
def upsample_labels(spark, d):
    return resample.upsample_labels(derive.voxels(spark, d).select(*ZYX, "label"), (1, 2, 2))


@query(f"""WITH {VOXELS}, n AS (SELECT z, y, x, raw, lag(raw) OVER w p, lag(x) OVER w px, lead(raw) OVER w q, lead(x) OVER w qx FROM vox WINDOW w AS (PARTITION BY z, y ORDER BY x))
SELECT z, y, x * 2 + i.range x, round(raw + (CASE WHEN i.range = 0 THEN CASE WHEN px = x - 1 THEN p ELSE raw END ELSE CASE WHEN qx = x + 1 THEN q ELSE raw END END - raw) * 0.25, 8) + 0.0 raw FROM n, range(2) i""")
def upsample_linear(spark, d):
    return resample.upsample_linear(derive.voxels(spark, d).select(*ZYX, "raw"), "raw", (1, 1, 2)).select(*ZYX, _r("raw"))


@query(f"""WITH {VOXELS}, a AS (SELECT z // 1 z, y // 2 y, x // 2 x, sum(raw) / 4 raw FROM vox GROUP BY 1, 2, 3), b AS (SELECT z // 2 z, y // 2 y, x // 2 x, sum(raw) / 8 raw FROM a GROUP BY 1, 2, 3)
SELECT 0 AS level, z, y, x, round(raw, 8) + 0.0 raw FROM vox UNION ALL SELECT 1, z, y, x, round(raw, 8) + 0.0 FROM a UNION ALL SELECT 2, z, y, x, round(raw, 8) + 0.0 FROM b""")
def pyramid_levels(spark, d):
    return resample.pyramid(derive.voxels(spark, d), "raw", [(1, 2, 2), (2, 2, 2)], False).select("level", *ZYX, _r("raw"))


# --- neighbourhoods

_OFF = "off(o, dz, dy, dx) AS (VALUES (0, -1, 0, 0), (1, 0, -1, 0), (2, 0, 0, -1), (3, 0, -2, 0))"


@query(f'WITH {VOXELS}, {_OFF} SELECT a.z, a.y, a.x, o, (a."label" = b."label" AND a."label" <> 0)::INT aff FROM vox a, off JOIN vox b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx')
def affinities(spark, d):
    return neighbors.affinities(derive.voxels(spark, d).select(*ZYX, "label"), "label", OFFSETS)


@query(f'WITH {VOXELS}, {_OFF} SELECT o, count(*) n, sum((a."label" = b."label" AND a."label" <> 0)::INT)::BIGINT same FROM vox a, off JOIN vox b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1')
def affinity_offsets(spark, d):
    return neighbors.affinities(derive.voxels(spark, d).select(*ZYX, "label"), "label", OFFSETS).groupBy("o").agg(F.count("*").alias("n"), F.sum("aff").alias("same"))


_PAIRS = "f(dz, dy, dx) AS (VALUES (0, 0, 1), (0, 1, 0), (1, 0, 0)), o AS (SELECT z, y, x, (z // 8) * 1000 + (y // 8) * 30 + x // 8 + 1 obj FROM vox)"


def _cells(spark, d):
    v = derive.voxels(spark, d)
    obj = F.floor(F.col("z") / 8) * 1000 + F.floor(F.col("y") / 8) * 30 + F.floor(F.col("x") / 8) + 1
    return v.select(*ZYX, obj.alias("obj"))


@query(f"WITH {VOXELS}, {_PAIRS} SELECT DISTINCT least(a.obj, b.obj) u, greatest(a.obj, b.obj) v FROM o a, f JOIN o b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.obj <> b.obj")
def rag_edges(spark, d):
    return neighbors.adjacency(_cells(spark, d), "obj")


_BOUND = f"WITH {AFFS}, g(k, dz, dy, dx) AS (VALUES (0, -1, 0, 0), (1, 0, -1, 0), (2, 0, 0, -1)), o AS (SELECT z, y, x, (z // 8) * 1000 + (y // 8) * 30 + x // 8 + 1 obj, az, ay, ax FROM affs), e AS (SELECT least(a.obj, b.obj) u, greatest(a.obj, b.obj) v, CASE k WHEN 0 THEN a.az WHEN 1 THEN a.ay ELSE a.ax END aff FROM o a, g JOIN o b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.obj <> b.obj)"


def _cell_affs(spark, d):
    return _cells(spark, d).join(derive.affinity_volume(spark, d), ZYX)


@query(_BOUND + " SELECT u, v, count(*) n, round(1 - avg(aff), 8) + 0.0 score FROM e GROUP BY 1, 2")
def rag_mean_affinity(spark, d):
    return neighbors.boundary_affinity(_cell_affs(spark, d), "obj", ["az", "ay", "ax"]).select("u", "v", "n", _r("score"))


@query(_BOUND + " SELECT u, v, count(*) n, round(1 - quantile_cont(aff, 0.75), 8) + 0.0 score FROM e GROUP BY 1, 2")
def rag_quantile_affinity(spark, d):
    return neighbors.boundary_affinity(_cell_affs(spark, d), "obj", ["az", "ay", "ax"], 0.75).select("u", "v", "n", _r("score"))


@query(f"""WITH {VOXELS}, w AS (SELECT *, min("label") OVER a la, max("label") OVER a ha, min("label") OVER b lb, max("label") OVER b hb FROM vox WINDOW a AS (PARTITION BY z, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING), b AS (PARTITION BY z, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT z, y, x, CASE WHEN least(la, lb) = greatest(ha, hb) THEN "label" ELSE 0 END::BIGINT grown FROM w""")
def boundary_grow(spark, d):
    return neighbors.boundary_grow(derive.voxels(spark, d), "label").select(*ZYX, F.col("grown").cast("long").alias("grown"))


@query(f"""WITH {VOXELS}, a AS (SELECT *, max(raw) OVER (PARTITION BY z, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) m FROM vox) SELECT z, y, x, max(m) OVER (PARTITION BY z, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) max_value FROM a""")
def dilate_stencil(spark, d):
    return neighbors.maximum_filter(derive.voxels(spark, d), "raw", 3, ("y", "x")).select(*ZYX, "max_value")


@query(f"""WITH {VOXELS}, a AS (SELECT *, max(raw) OVER (PARTITION BY z, x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) m FROM vox), b AS (SELECT *, max(m) OVER (PARTITION BY z, y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) t FROM a) SELECT z, y, x, raw FROM b WHERE raw = t""")
def local_maxima(spark, d):
    return neighbors.local_maxima(derive.voxels(spark, d), "raw", 5, ("y", "x")).select(*ZYX, "raw")


@query(f"""WITH {VOXELS}, t AS (SELECT a.range b_z, b.range b_y, c.range b_x FROM range(6) a, range(3) b, range(3) c) SELECT b_z, b_y, b_x, count(*) n, count(*) FILTER (z // 16 = b_z AND y // 16 = b_y AND x // 16 = b_x) core FROM t JOIN vox ON z BETWEEN b_z * 16 - 1 AND (b_z + 1) * 16 AND y BETWEEN b_y * 16 - 2 AND (b_y + 1) * 16 + 1 AND x BETWEEN b_x * 16 - 2 AND (b_x + 1) * 16 + 1 GROUP BY 1, 2, 3""")
def halo_blocks(spark, d):
    h = neighbors.block_halo(derive.voxels(spark, d).select(*ZYX), (16, 16, 16), (1, 2, 2), (6, 3, 3))
    return h.groupBy(*[F.col(f"b{a}").alias(f"b_{a}") for a in ZYX]).agg(F.count("*").alias("n"), F.count_if("core").alias("core"))


@query(f"""WITH {VOXELS}, o AS (SELECT z, y, x, CASE WHEN "label" > 3 THEN "label" ELSE 0 END l FROM vox), k(dy, dx) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)), s AS (SELECT z, y + dy y, x + dx x, min(l) l FROM o, k WHERE l > 0 GROUP BY 1, 2, 3)
SELECT z, y, x, CASE WHEN o.l > 0 THEN o.l ELSE coalesce(s.l, 0) END::BIGINT expanded FROM o LEFT JOIN s USING (z, y, x)""")
def expand_labels(spark, d):
    v = derive.voxels(spark, d).select(*ZYX, F.when(F.col("label") > 3, F.col("label")).otherwise(0).cast("long").alias("l"))
    return neighbors.expand_labels(v, "l", 1).select(*ZYX, F.col("expanded").cast("long").alias("expanded"))


@query(f"""WITH {VOXELS}, o AS (SELECT z, y, x, (seg > 3)::INT m FROM vox), k(dy, dx) AS (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)),
a AS (SELECT z, y, x, CASE WHEN EXISTS (SELECT 1 FROM o b, k WHERE b.m = 1 AND b.z = o.z AND b.y = o.y + dy AND b.x = o.x + dx) THEN 1 ELSE 0 END m FROM o)
SELECT z, y, x, CASE WHEN EXISTS (SELECT 1 FROM a b, k WHERE b.m = 0 AND b.z = a.z AND b.y = a.y + dy AND b.x = a.x + dx) THEN 0 ELSE 1 END mask FROM a""")
def disk_closing(spark, d):
    v = derive.voxels(spark, d).select(*ZYX, (F.col("seg") > 3).cast("int").alias("mask"))
    return neighbors.disk_closing(v, "mask", 1)


# --- metrics


@query(f'WITH {VOXELS} SELECT "label" gt, seg, count(*) n FROM vox WHERE "label" <> 0 GROUP BY 1, 2')
def contingency(spark, d):
    return evaluate.contingency(derive.voxels(spark, d), "label", "seg")


_VOI = """c AS (SELECT k, gt, seg, count(*) n FROM src WHERE gt <> 0 GROUP BY 1, 2, 3), t AS (SELECT k, sum(n) a FROM c GROUP BY 1),
j AS (SELECT k, -sum(n / a * log2(n / a)) h, sum(pow(n / a, 2)) q FROM c JOIN t USING (k) GROUP BY 1),
g AS (SELECT k, -sum(n / a * log2(n / a)) h, sum(pow(n / a, 2)) q FROM (SELECT k, gt, sum(n) n FROM c GROUP BY 1, 2) JOIN t USING (k) GROUP BY 1),
s AS (SELECT k, -sum(n / a * log2(n / a)) h, sum(pow(n / a, 2)) q FROM (SELECT k, seg, sum(n) n FROM c GROUP BY 1, 2) JOIN t USING (k) GROUP BY 1)"""


@query(f"""WITH {VOXELS}, src AS (SELECT 0 k, "label" gt, seg FROM vox), {_VOI} SELECT round(j.h - g.h, 8) + 0.0 voi_split, round(j.h - s.h, 8) + 0.0 voi_merge, round(2 * j.h - g.h - s.h, 8) + 0.0 voi_sum, round((j.h - g.h) / j.h, 8) + 0.0 nvi_split, round((j.h - s.h) / j.h, 8) + 0.0 nvi_merge, round((2 * j.h - g.h - s.h) / j.h, 8) + 0.0 nvi_sum, round(j.q / g.q, 8) + 0.0 rand_split, round(j.q / s.q, 8) + 0.0 rand_merge
FROM j JOIN g USING (k) JOIN s USING (k)""")
def rand_voi(spark, d):
    m = evaluate.rand_voi(derive.voxels(spark, d), "label", "seg")
    return m.select(*[_r(c) for c in m.columns])


@query(f"""WITH {VOXELS}, c AS (SELECT "label" gt, seg, count(*) n FROM vox WHERE "label" <> 0 GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY gt) a, sum(n) OVER (PARTITION BY seg) b, sum(n) OVER () t FROM c)
SELECT 'gt' side, gt id, sum(n)::BIGINT n, round(sum(-(n / t) * log2(n / a)), 8) + 0.0 voi FROM w GROUP BY gt UNION ALL SELECT 'seg', seg, sum(n)::BIGINT, round(sum(-(n / t) * log2(n / b)), 8) + 0.0 FROM w GROUP BY seg""")
def voi_per_cluster(spark, d):
    return evaluate.voi_per_cluster(derive.voxels(spark, d), "label", "seg").select("side", "id", "n", _r("voi"))


@query(f"""WITH {VOXELS}, o AS (SELECT z * 48 + y + 1 gt, seg FROM vox), c AS (SELECT gt, seg, count(*) n FROM o GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY gt) a, sum(n) OVER () t FROM c)
SELECT gt id, sum(n)::BIGINT n, round(sum(-(n / t) * log2(n / a)), 10) + 0.0 voi FROM w GROUP BY gt ORDER BY voi DESC, id LIMIT 10""")
def worst_splits(spark, d):
    v = derive.voxels(spark, d).select((F.col("z") * 48 + F.col("y") + 1).alias("gt"), "seg")
    return evaluate.worst(evaluate.voi_per_cluster(v, "gt", "seg").where("side = 'gt'").select("id", "n", _r("voi", 10)), 10)


THRESHOLDS = [0.02, 0.03, 0.05]


def _sweep_sql(tail: str) -> str:
    return f"""WITH RECURSIVE {GRAPH}, th(threshold) AS (VALUES (0.02), (0.03), (0.05)), n AS (SELECT u id FROM edges UNION SELECT v FROM edges),
e AS MATERIALIZED (SELECT threshold, u, v FROM edges, th WHERE score <= threshold UNION ALL SELECT threshold, v, u FROM edges, th WHERE score <= threshold),
r(threshold, src, dst) USING KEY (threshold, src) AS (SELECT threshold, id, id FROM n, th UNION (SELECT e.threshold, e.u, min(r.dst) FROM r JOIN e ON e.threshold = r.threshold AND e.v = r.src JOIN recurring.r k ON k.threshold = e.threshold AND k.src = e.u WHERE r.dst < k.dst GROUP BY 1, 2)),
lut AS (SELECT threshold::DOUBLE threshold, src fragment, dst segment FROM r) {tail}"""


def _nodes(g):
    return g.select(F.explode(F.array("u", "v")).alias("id")).distinct()


@query(_sweep_sql("SELECT threshold, fragment, segment FROM lut"))
def threshold_sweep(spark, d):
    g = derive.graph(spark, d)
    return graphs.threshold_sweep(_nodes(g), g, THRESHOLDS)


_BEST = """, src AS (SELECT threshold k, fragment % 20 + 1 gt, segment seg FROM lut), """ + _VOI + """, m AS (SELECT k threshold, round((2 * j.h - g.h - s.h) / j.h, 8) nvi_sum, round(j.h - g.h, 8) voi_split FROM j JOIN g USING (k) JOIN s USING (k))
SELECT 'nvi_sum' metric, (SELECT threshold FROM m ORDER BY nvi_sum, threshold LIMIT 1) threshold, (SELECT min(nvi_sum) FROM m) + 0.0 "value" UNION ALL SELECT 'voi_split', (SELECT threshold FROM m ORDER BY voi_split, threshold LIMIT 1), (SELECT min(voi_split) FROM m) + 0.0"""


@query(_sweep_sql(_BEST))
def best_threshold(spark, d):
    lut = threshold_sweep(spark, d).select("threshold", (F.col("fragment") % 20 + 1).alias("gt"), "segment")
    m = evaluate.rand_voi(lut, "gt", "segment", ["threshold"]).select("threshold", _r("nvi_sum"), _r("voi_split"))
    return evaluate.best_thresholds(m, "nvi_sum", "voi_split")


_ERR = f"WITH {AFFS}, {_OFF}, j AS (SELECT a.*, seg, ay q FROM affs a JOIN vox USING (z, y, x)), e AS (SELECT a.z, a.y, a.x, round(sum(pow(CASE o WHEN 0 THEN a.az WHEN 1 THEN a.ay WHEN 2 THEN a.ax ELSE a.q END - (a.seg = b.seg AND a.seg <> 0)::INT, 2)), 8) diff FROM j a, off JOIN j b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3)"


def _errors(spark, d):
    v = derive.voxels(spark, d).select(*ZYX, "seg").join(derive.affinity_volume(spark, d), ZYX)
    return evaluate.affinity_error(v, ["az", "ay", "ax", "ay"], "seg", OFFSETS).select(*ZYX, F.round("diff", 8).alias("diff"))


@query(_ERR + " SELECT z, y, x, round(diff / (max(diff) OVER (PARTITION BY z // 16, y // 16, x // 16)), 8) + 0.0 error FROM e WHERE diff >= 0")
def error_map_affinity(spark, d):
    return evaluate.error_map(_errors(spark, d), "diff", (16, 16, 16)).select(*ZYX, F.coalesce(_r("error"), F.lit(0.0)).alias("error"))


@query(_ERR + ", m AS (SELECT diff / max(diff) OVER () error FROM e) SELECT round(avg(error), 8) + 0.0 mean, round(stddev_pop(error), 8) + 0.0 std, count(*) FILTER (error > 0) nonzero, count(*) total, round(count(*) FILTER (error > 0) / count(*), 8) + 0.0 ratio FROM m")
def error_stats(spark, d):
    return objects.array_stats(evaluate.error_map(_errors(spark, d), "diff"), "error").select(_r("mean"), _r("std"), "nonzero", "total", _r("ratio"))


@query(_ERR + ", m AS (SELECT z, y, x, diff / max(diff) OVER () error FROM e) SELECT z, y, x, (error > 0.1 AND error < 1.0)::INT mask FROM m")
def error_mask(spark, d):
    return evaluate.error_map(_errors(spark, d), "diff").select(*ZYX, select.band(F.col("error"), 0.1, 1.0).alias("mask"))


@query("SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2))), 6) + 0.0 error FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def error_map_embedding(spark, d):
    e = derive.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return e.join(b, "vec_id").select("vec_id", evaluate.vector_error(F.col("a"), F.col("b")).alias("error")).select("vec_id", _r("error", 6))


# --- components


@query(f"WITH RECURSIVE {GRAPH}, e AS MATERIALIZED (SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges), r(src, dst) USING KEY (src) AS (SELECT DISTINCT u, u FROM e UNION (SELECT e.u, min(r.dst) FROM r JOIN e ON e.v = r.src JOIN recurring.r k ON k.src = e.u WHERE r.dst < k.dst GROUP BY 1)) SELECT src node, dst component FROM r")
def connected_components(spark, d):
    from ..operators.components import connected_components as cc

    return cc(derive.graph(spark, d))


@query(_sweep_sql("SELECT fragment, segment FROM lut WHERE threshold = 0.03"))
def components_at_threshold(spark, d):
    g = derive.graph(spark, d)
    return graphs.components_at(_nodes(g), g, 0.03)


@query(f"""WITH RECURSIVE {VOXELS}, o AS MATERIALIZED (SELECT (z << 40) + (y << 20) + x + 1 AS "key", z, y, x, "label" FROM vox WHERE "label" <> 0), f(dz, dy, dx) AS (VALUES (0, 0, 1), (0, 1, 0), (1, 0, 0), (0, 0, -1), (0, -1, 0), (-1, 0, 0)),
e AS MATERIALIZED (SELECT a."key" u, b."key" v FROM o a, f JOIN o b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx AND a."label" = b."label"),
r AS (SELECT "key" src, "key" dst FROM o UNION SELECT r.src, e.v FROM r JOIN e ON e.u = r.dst), c AS (SELECT src, min(dst) component FROM r GROUP BY 1) SELECT z, y, x, "label", component FROM o JOIN c ON src = "key" """)
def voxel_components(spark, d):
    return graphs.voxel_components(derive.voxels(spark, d), "label")


_HIST = "h AS (SELECT n_nationkey::BIGINT step, n_regionkey::BIGINT * 100 a, n_nationkey::BIGINT + 1 b, n_regionkey::BIGINT * 100 c, round(0.01 * n_nationkey, 4) score FROM nation)"


@query(f"""WITH {_HIST}, p AS (SELECT x.n_nationkey::BIGINT + 1 u, y.n_nationkey::BIGINT + 1 v, x.n_regionkey rx, y.n_regionkey r_y FROM nation x JOIN nation y ON y.n_nationkey = (x.n_nationkey * 7 + 3) % 25)
SELECT u, v, CASE WHEN u = v THEN 0.0 WHEN rx = r_y THEN round(0.01 * (greatest(u, v) - 1), 4) END score FROM p""")
def merge_score(spark, d):
    n = derive.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("r"))
    hist = n.select(F.col("k").alias("step"), (F.col("r") * 100).alias("a"), (F.col("k") + 1).alias("b"), (F.col("r") * 100).alias("c"), F.round(F.col("k") * 0.01, 4).alias("score"))
    pairs = n.select((F.col("k") + 1).alias("u"), ((F.col("k") * 7 + 3) % 25 + 1).alias("v"))
    return graphs.join_scores(pairs, hist)


# --- skeletons


@query(f"WITH {SKELETONS} SELECT a.skel, round(sum(sqrt(pow(a.z - b.z, 2) + pow(a.y - b.y, 2) + pow(a.x - b.x, 2))), 6) + 0.0 AS length FROM ske JOIN sk a ON a.node = u JOIN sk b ON b.node = v GROUP BY 1")
def skeleton_lengths(spark, d):
    return evaluate.skeleton_lengths(*derive.skeletons(spark, d)).select("skel", _r("length", 6))


_LABELS = "lab AS (SELECT node, CASE WHEN skel % 5 = 0 THEN skel % 50 ELSE skel * 10 + (node % 10) // 3 END segment FROM sk)"


def _skeleton_labels(nodes):
    return nodes.select("node", F.when(F.col("skel") % 5 == 0, F.col("skel") % 50).otherwise(F.col("skel") * 10 + F.floor(F.col("node") % 10 / 3)).alias("segment"))


@query(f"""WITH {SKELETONS}, {_LABELS}, el AS (SELECT a.skel, u, v, sqrt(pow(a.z - b.z, 2) + pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) l FROM ske JOIN sk a ON a.node = u JOIN sk b ON b.node = v),
mg AS (SELECT segment, count(DISTINCT skel) > 1 merging FROM lab JOIN sk USING (node) WHERE segment <> 0 GROUP BY 1),
runs AS (SELECT el.skel, p.segment, sum(l) * (NOT any_value(merging))::INT run FROM el JOIN lab p ON p.node = u JOIN lab q ON q.node = v JOIN mg ON mg.segment = p.segment WHERE p.segment = q.segment AND p.segment <> 0 GROUP BY 1, 2),
tot AS (SELECT sum(l) t, sum(l * l) b FROM (SELECT skel, sum(l) l FROM el GROUP BY 1)), got AS (SELECT sum(run * run) g FROM runs)
SELECT round(g / t, 6) + 0.0 erl, round(b / t, 6) + 0.0 perfect_erl, round(g / b, 8) + 0.0 nerl, round(t, 4) + 0.0 total_length FROM tot, got""")
def expected_run_length(spark, d):
    nodes, edges = derive.skeletons(spark, d)
    return evaluate.expected_run_length(nodes, edges, _skeleton_labels(nodes)).select(_r("erl", 6), _r("perfect_erl", 6), _r("nerl"), _r("total_length", 4))


@query(f"""WITH {SKELETONS}, {_LABELS}, o AS (SELECT DISTINCT skel, segment FROM lab JOIN sk USING (node)), a AS (SELECT segment, count(*) k FROM o GROUP BY 1), b AS (SELECT skel, count(*) k FROM o GROUP BY 1)
SELECT (SELECT sum(k - 1)::BIGINT FROM a) merges, (SELECT sum(k - 1)::BIGINT FROM a WHERE segment <> 0) merges_non0, (SELECT sum(k - 1)::BIGINT FROM b) splits, (SELECT count(*) FROM a) segments, (SELECT count(*) FROM b) skeletons""")
def merge_split_stats(spark, d):
    nodes, _ = derive.skeletons(spark, d)
    return evaluate.merge_split_stats(nodes, _skeleton_labels(nodes))


@query()
def edits_needed(spark, d):
    # a supplier is 0, which in labels is background: ids count from 1 here
    g = derive.graph(spark, d).select((F.col("u") + 1).alias("u"), (F.col("v") + 1).alias("v"), "score")
    with stored(g) as g:
        lut = cut(graphs.components_at(_nodes(g), g, 0.03))
        sites = cut(g.select(((F.col("u") - 1) % 7).alias("skel"), F.col("u").alias("fragment")).distinct())
        cuts = evaluate.min_cut_edits(lut, g, sites)
    nodes = sites.select(F.col("fragment").alias("node"), "skel")
    return evaluate.edits_needed(nodes, lut.select(F.col("fragment").alias("node"), "segment"), cuts)


# --- augmentation


@query(f"WITH {AFFS}, w AS (SELECT *, min(ay) OVER (PARTITION BY z) lo, max(ay) OVER (PARTITION BY z) hi FROM affs) SELECT z, y, x, round(CASE WHEN hi - lo > 0.001 THEN lo + pow((ay - lo) / (hi - lo), 1.5) * (hi - lo) ELSE ay END, 8) + 0.0 ay FROM w")
def gamma(spark, d):
    return augment.gamma(derive.affinity_volume(spark, d), "ay", (1, -1, -1), 1.5).select(*ZYX, _r("ay"))


@query(f"WITH {AFFS} SELECT z, y, x, round(avg(ay) OVER (PARTITION BY z) + (ay - avg(ay) OVER (PARTITION BY z)) * 0.1 + 3e-11, 8) + 0.0 ay FROM affs")
def low_contrast(spark, d):
    # a hair off exact halves, which rounding would send either way
    low = augment.low_contrast(derive.affinity_volume(spark, d), "ay", 0.1, 1.0)
    return low.withColumn("ay", F.col("ay") + 3e-11).select(*ZYX, _r("ay"))


@query(f"WITH {VOXELS}, i AS (SELECT z, l, lead(l) OVER (PARTITION BY z ORDER BY l) n FROM (SELECT DISTINCT z, \"label\" l FROM vox WHERE \"label\" <> 0)) SELECT v.z, y, x, coalesce(n, \"label\") \"label\" FROM vox v LEFT JOIN i ON i.z = v.z AND l = \"label\"")
def obfuscate_merge(spark, d):
    return augment.obfuscate_merge(derive.voxels(spark, d).select(*ZYX, "label"), "label", 1.1).select(*ZYX, "label")


@query(f"WITH {VOXELS} SELECT z, 47 - x y, y x, raw FROM vox")
def mirror_transpose(spark, d):
    return augment.simple_transform(derive.voxels(spark, d).select(*ZYX, "raw"), SHAPE, (False, False, True), True)


@query()
def impulse_noise(spark, d):
    return augment.impulse_noise(derive.affinity_volume(spark, d), "ay", 0.1, 3).select(*ZYX, "ay")


@query()
def defects(spark, d):
    return augment.defects(derive.affinity_volume(spark, d), "ay", 0.05, 0.1, 0.1, seed=4).select(*ZYX, "ay")


@query()
def synthetic_labels(spark, d):
    return augment.synthetic_labels(spark, (12, 32, 32), 40, 7, (3, 5))


# --- kernels on blocks and pipelines


_BOX = (6, 6, 8)
_IN = f"z BETWEEN 0 AND {SHAPE[0] - 1} AND y BETWEEN 0 AND {SHAPE[1] - 1} AND x BETWEEN 0 AND {SHAPE[2] - 1}"
_STEPS = "st(dz, dy, dx) AS (VALUES (0, 0, 1), (0, 1, 0), (1, 0, 0), (0, 0, -1), (0, -1, 0), (-1, 0, 0))"
_SOLID = f"""{VOXELS}, cell AS (SELECT z // {_BOX[0]} cz, y // {_BOX[1]} cy, x // {_BOX[2]} cx, sum("label" * 3 + seg) % 3 l FROM vox GROUP BY 1, 2, 3),
v0 AS MATERIALIZED (SELECT cz * {_BOX[0]} + a z, cy * {_BOX[1]} + b y, cx * {_BOX[2]} + c x, l::BIGINT l FROM cell, range({_BOX[0]}) p(a), range({_BOX[1]}) q(b), range({_BOX[2]}) r(c) WHERE l > 0), {_STEPS}"""


def _solid(spark, d):
    """Labels that fill whole boxes of ``_BOX``, as kernels that look around need something solid."""
    v = derive.voxels(spark, d)
    cells = v.groupBy(*[F.floor(F.col(a) / n).alias("c" + a) for a, n in zip(ZYX, _BOX)]).agg((F.sum(F.col("label") * 3 + F.col("seg")) % 3).alias("label")).where("label > 0")
    for a, n in zip(ZYX, _BOX):
        cells = cells.withColumn(a, F.explode(F.sequence(F.col("c" + a) * n, F.col("c" + a) * n + n - 1)))
    return cells.select(*ZYX, "label").where(_IN)


def _dilated(a: str, b: str) -> str:
    """SQL: b is a with background beside a label taken by the smallest one."""
    return f", {b} AS MATERIALIZED (SELECT z, y, x, coalesce(max(l) FILTER (own), min(l)) l FROM (SELECT z, y, x, l, true own FROM {a} UNION ALL SELECT z + dz, y + dy, x + dx, l, false FROM {a}, st) WHERE {_IN} GROUP BY 1, 2, 3)"


def _eroded(a: str, b: str) -> str:
    """SQL: b is a without voxels beside another value; beyond the edge the value goes on."""
    out = "+".join(f"({c} = 0)::INT + ({c} = {n - 1})::INT" for c, n in zip(ZYX, SHAPE))
    return f", {b} AS MATERIALIZED (SELECT z, y, x, l FROM {a} LEFT JOIN (SELECT p.z, p.y, p.x, count(*) n FROM (SELECT *, z + dz nz, y + dy ny, x + dx nx FROM {a}, st) p JOIN {a} q ON q.z = nz AND q.y = ny AND q.x = nx AND q.l = p.l GROUP BY 1, 2, 3) USING (z, y, x) WHERE coalesce(n, 0) + {out} = 6)"


def _morph(name, op, steps=()):
    def run(spark, d):
        return blocks.morph(_solid(spark, d), "label", SHAPE, op, block=(28, 48, 48))

    run.__name__ = name
    sql = f"WITH {_SOLID}" + "".join(f(f"v{k}", f"v{k + 1}") for k, f in enumerate(steps)) + f' SELECT z, y, x, l "value" FROM v{len(steps)}'
    return query(sql if steps else None)(run)


for _n, _op, _how in (("morph_dilate", "dilate", (_dilated,)), ("morph_erode", "erode", (_eroded,)), ("morph_opening", "opening", (_eroded, _dilated)), ("morph_closing", "closing", (_dilated, _eroded)), ("fill_holes", "fill_holes", ())):
    _morph(_n, _op, _how)


@query(f"""WITH {VOXELS}, m AS (SELECT z, y, x FROM vox WHERE seg > 0), al AS (SELECT s.z, a.y, b.x FROM (SELECT DISTINCT z FROM m) s, range({SHAPE[1]}) a(y), range({SHAPE[2]}) b(x)), bg AS (SELECT * FROM al ANTI JOIN m USING (z, y, x)),
d AS (SELECT m.z, m.y, m.x, min(pow(m.y - bg.y, 2) + pow(m.x - bg.x, 2)) d FROM m LEFT JOIN bg ON bg.z = m.z GROUP BY 1, 2, 3) SELECT z, y, x, coalesce(round(sqrt(d), 8), 'inf'::DOUBLE) + 0.0 "value" FROM d""")
def edt(spark, d):
    return blocks.distance_transform(derive.voxels(spark, d).where("seg > 0").select(*ZYX, "seg"), "seg", SHAPE, True, (28, 48, 48)).select(*ZYX, F.round("value", 8).alias("value"))


def _gaussian_sql(axis: str, n: int, a: str, b: str) -> str:
    """SQL: b is a smoothed along an axis by a Gaussian of sigma 1 with mirrored edges; each voxel deals its weight out."""
    to = f"CASE WHEN {axis} + k < 0 THEN -1 - {axis} - k WHEN {axis} + k >= {n} THEN {2 * n - 1} - {axis} - k ELSE {axis} + k END"
    rest = [c for c in ZYX if c != axis]
    # what a place takes from one beyond the edge comes from the mirrored one, so weights are gathered, not dealt
    return f", {b} AS (SELECT t.{axis}, {', '.join('s.' + c for c in rest)}, sum(s.v * t.w) v FROM (SELECT {axis}, {to} f, w FROM range({n}) i({axis}), g) t JOIN {a} s ON s.{axis} = t.f GROUP BY 1, 2, 3)"


@query(
    f"WITH {VOXELS}, e AS (SELECT k, exp(-0.5 * k * k) w FROM range(-4, 5) r(k)), g AS (SELECT k, w / sum(w) OVER () w FROM e), v0 AS (SELECT z, y, x, raw v FROM vox)"
    + _gaussian_sql("y", SHAPE[1], "v0", "v1") + _gaussian_sql("x", SHAPE[2], "v1", "v2") + ' SELECT z, y, x, round(v, 8) + 0.0 "value" FROM v2 WHERE v <> 0'
)
def gaussian_smooth(spark, d):
    return blocks.smooth(derive.voxels(spark, d).select(*ZYX, "raw"), "raw", SHAPE, (0.0, 1.0, 1.0), (28, 48, 48)).select(*ZYX, F.round("value", 8).alias("value"))


@query()
def grow_random(spark, d):
    return blocks.grow_random(_solid(spark, d), "label", SHAPE, 1, block=(28, 48, 48))


@query(f'WITH {VOXELS} SELECT z, y, x, round(raw / 50.0, 8) + 0.0 "value" FROM vox WHERE raw <> 0')
def block_inference(spark, d):
    v = derive.voxels(spark, d).select(*ZYX, "raw")
    return blocks.infer(v, ("raw",), SHAPE, lambda a: a["raw"] / 50.0, (28, 48, 48), (0, 2, 2)).select(*ZYX, F.round("value", 8).alias("value"))


@query()
def clahe(spark, d):
    return blocks.equalise(derive.voxels(spark, d).select(*ZYX, "raw"), "raw", SHAPE).select(*ZYX, F.round("value", 8).alias("value"))


@query()
def local_shape_descriptor(spark, d):
    return blocks.descriptors(_solid(spark, d), "label", SHAPE, 1.0, 0, (28, 48, 48)).select(*ZYX, F.round("value", 8).alias("value"))


def _soft(spark, d):
    """Affinities that favour blobs, for pipelines."""
    return derive.affinity_volume(spark, d).select(*ZYX, *[F.round(0.4 + F.col(c) * 0.6, 6).alias(c) for c in ("az", "ay", "ax")])


@query()
def watershed_slices(spark, d):
    return blocks.fragments(_soft(spark, d), ("az", "ay", "ax"), SHAPE, True, 5, (12, 48, 48), (0, 0, 0))


@query()
def segment_ws(spark, d):
    return segment.watershed(_soft(spark, d), ["az", "ay", "ax"], SHAPE, (0.2, 0.35), min_seed_distance=5, block=(21, 48, 48), filter_fragments=0.0, remove_debris=0)["segmentation"]


@query()
def segment_mws(spark, d):
    near, far = [(-1, 0, 0), (0, -1, 0), (0, 0, -1)], [(-2, 0, 0), (0, -5, 0), (0, 0, -5)]
    v = _soft(spark, d).withColumns({f"f{c}": F.round(1 - F.col(c) * 0.9, 6) for c in ("az", "ay", "ax")})
    names, strides = ["az", "ay", "ax", "faz", "fay", "fax"], [(1, 1, 1)] * 3 + [(1, 3, 3)] * 3
    return segment.mutex(v, names, SHAPE, near + far, [-0.6] * 3 + [-0.75] * 3, strides, True, block=(12, 48, 48), filter_fragments=0.1, remove_debris=2)["segmentation"]


@query(f"""WITH RECURSIVE {AFFS}, o AS MATERIALIZED (SELECT (z << 40) + (y << 20) + x + 1 AS "key", z, y, x, az > 0.8 hz, ay > 0.8 hy, ax > 0.8 hx FROM affs WHERE az > 0.8 OR ay > 0.8 OR ax > 0.8),
h AS (SELECT a."key" u, b."key" v FROM o a JOIN o b ON a.hz AND b.z = a.z + 1 AND b.y = a.y AND b.x = a.x UNION ALL SELECT a."key", b."key" FROM o a JOIN o b ON a.hy AND b.z = a.z AND b.y = a.y + 1 AND b.x = a.x UNION ALL SELECT a."key", b."key" FROM o a JOIN o b ON a.hx AND b.z = a.z AND b.y = a.y AND b.x = a.x + 1),
e AS MATERIALIZED (SELECT u, v FROM h UNION ALL SELECT v, u FROM h), r AS (SELECT "key" src, "key" dst FROM o UNION SELECT r.src, e.v FROM r JOIN e ON e.u = r.dst), c AS (SELECT src, min(dst) component FROM r GROUP BY 1), s AS (SELECT component FROM c GROUP BY 1 HAVING count(*) >= 4)
SELECT z, y, x, component FROM o JOIN c ON src = "key" WHERE component IN (SELECT component FROM s)""")
def segment_cc(spark, d):
    return segment.threshold_components(derive.affinity_volume(spark, d), ["az", "ay", "ax"], threshold=0.8, remove_debris=4)


@query()
def agglomeration_history(spark, d):
    frags = _cells(spark, d).select(*ZYX, F.col("obj").alias("fragment"))
    h = segment.agglomeration_history(frags, derive.affinity_volume(spark, d), ["az", "ay", "ax"], (24, 48, 48))
    return h.select("block", "step", "a", "b", "c", F.round("score", 8).alias("score"))


@query()
def mutex_graph(spark, d):
    g = derive.graph(spark, d).select("u", "v", (0.05 - F.coalesce("score", F.lit(0.05))).alias("score"))
    with stored(g) as g:
        return cut(graphs.mutex_partition(_nodes(g), g))


@query()
def segment_ws_seed_decay(spark, d):
    return segment.watershed(_soft(spark, d), ["az", "ay", "ax"], SHAPE, (0.35,), min_seed_distance=5, block=(12, 48, 48), epsilon_agglomerate=0.1, filter_fragments=0.5, remove_debris=0, seed_eps=0.02)["segmentation"]


@query()
def error_mask_clean(spark, d):
    m = error_mask(spark, d).where("mask > 0")
    return prepare.clean_error_mask(m, "mask", SHAPE, 1, (28, 48, 48))


@query(f"""WITH {VOXELS}, v AS (SELECT z, y, x, raw FROM vox), a AS (SELECT z, unnest(list_filter([y, CASE WHEN y BETWEEN 1 AND 3 THEN -y END, CASE WHEN y BETWEEN 44 AND 46 THEN 94 - y END], lambda i: i IS NOT NULL)) + 3 y, x, raw FROM v)
SELECT z, y, unnest(list_filter([x, CASE WHEN x BETWEEN 1 AND 2 THEN -x END, CASE WHEN x BETWEEN 45 AND 46 THEN 94 - x END], lambda i: i IS NOT NULL)) + 2 x, raw FROM a""")
def pad_reflect(spark, d):
    return prepare.pad(derive.voxels(spark, d).select(*ZYX, "raw"), SHAPE, (0, 3, 2), "reflect")


@query(f'WITH {VOXELS}, o AS (SELECT z, y, x, (raw > 20)::INT m FROM vox) SELECT z, y, x, m mask FROM o')
def mask_from_labels(spark, d):
    v = derive.voxels(spark, d).select(*ZYX, (F.col("raw") > 20).cast("int").alias("value"))
    return prepare.make_mask(v, "value", "labels")


@query(f"""WITH {VOXELS}, src AS (SELECT 'a' k, "label" gt, seg FROM vox UNION ALL SELECT 'b', "label", "label" % 3 FROM vox), {_VOI} SELECT k segmentation, round(j.h - g.h, 8) + 0.0 voi_split, round(j.h - s.h, 8) + 0.0 voi_merge, round(j.q / g.q, 8) + 0.0 rand_split, round(j.q / s.q, 8) + 0.0 rand_merge FROM j JOIN g USING (k) JOIN s USING (k)""")
def evaluate_segmentations(spark, d):
    v = derive.voxels(spark, d)
    segs = {"a": v.select(*ZYX, "seg"), "b": v.select(*ZYX, (F.col("label") % 3).alias("seg"))}
    m = prepare.evaluate_segmentations(segs, v.select(*ZYX, F.col("label").alias("gt")))
    return m.select("segmentation", *[_r(c) for c in ("voi_split", "voi_merge", "rand_split", "rand_merge")])


def _aff_target_sql(offsets, slab: int) -> str:
    """SQL: affinities of labels shrunk by a step and their balance weights by offset and slab of sections."""
    off = "off(o, dz, dy, dx) AS (VALUES " + ", ".join(f"({k}, {z}, {y}, {x})" for k, (z, y, x) in enumerate(offsets)) + ")"
    part = f"a.z // {slab}" if slab else "0"
    return f"""WITH {VOXELS}, {off}, w AS (SELECT *, min("label") OVER a la, max("label") OVER a ha, min("label") OVER b lb, max("label") OVER b hb FROM vox WINDOW a AS (PARTITION BY z, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING), b AS (PARTITION BY z, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
g AS MATERIALIZED (SELECT z, y, x, CASE WHEN least(la, lb) = greatest(ha, hb) THEN "label" ELSE 0 END l FROM w), a AS MATERIALIZED (SELECT a.z, a.y, a.x, o, (a.l = b.l AND a.l <> 0)::INT aff FROM (SELECT g.*, o, z + dz nz, y + dy ny, x + dx nx FROM g, off) a JOIN g b ON b.z = nz AND b.y = ny AND b.x = nx),
f AS (SELECT o, {part} slab, aff, count(*) n FROM a a GROUP BY 1, 2, 3), k AS (SELECT *, sum(n) OVER (PARTITION BY o, slab) t, count(*) OVER (PARTITION BY o, slab) c FROM f)
SELECT z, y, x, a.o, a.aff, round(t / (c * n), 8) + 0.0 weight FROM a JOIN k ON k.o = a.o AND slab = {part} AND k.aff = a.aff"""


@query(_aff_target_sql(OFFSETS, 3))
def training_affinities(spark, d):
    return training.affinity_targets(derive.voxels(spark, d).select(*ZYX, "label"), "label", OFFSETS, 1, 3).select(*ZYX, "o", "aff", _r("weight"))


# Offsets of the model kinds: six in the plane or in space, nine where a third step is learnt.
_PLANE = [(0, -1, 0), (0, 0, -1), (0, -2, 0), (0, 0, -2), (0, -3, 0), (0, 0, -3)]
_SPACE = [(-1, 0, 0), (0, -1, 0), (0, 0, -1), (-2, 0, 0), (0, -3, 0), (0, 0, -3)]


def _model(name: str):
    """The targets that a model learns from: its affinities, else its descriptors."""
    m = training.MODELS[name]
    n = m.outputs.get("affs")
    offsets = _PLANE if m.dims == 2 else _SPACE + [(-3, 0, 0), (0, -9, 0), (0, 0, -9)][: (n or 6) - 6]

    def run(spark, d):
        v = derive.voxels(spark, d).select(*ZYX, (F.col("raw") / 50).alias("raw"), "label")
        s = training.training_sample(name, v, SHAPE, offsets, 1.0)
        if n:
            return s["affs"].select(*ZYX, "o", "aff", _r("weight"))
        return s["lsds"].select(*ZYX, F.size("lsd").alias("channels"), F.round(F.aggregate("lsd", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))

    run.__name__ = f"model_{name}"
    query(_aff_target_sql(offsets, 3 if m.synthetic else 0) if n else None)(run)


for _n in training.MODELS:
    _model(_n)


@query()
def training_sample_3d(spark, d):
    v = derive.voxels(spark, d).select(*ZYX, (F.col("raw") / 50).alias("raw"), "label")
    s = training.training_sample("3d_mtlsd", v, SHAPE, OFFSETS + [(0, 0, -2), (-2, 0, 0)], 1.0)
    return s["lsds"].join(s["raw"], ZYX, "left").select(*ZYX, F.size("lsd").alias("channels"), F.round("raw", 8).alias("raw"))


# --- stream (extension)


@query("SELECT l_partkey % 50 AS id, count(*) size, min(l_linenumber)::BIGINT min_z, max(l_linenumber)::BIGINT max_z FROM lineitem WHERE l_partkey % 50 <> 0 GROUP BY 1")
def stream_object_sizes(spark, d):
    import uuid

    from ..plans.lineage import ensure_checkpoint_dir
    from ..streaming import objects as stream

    name = f"stream_object_sizes_{uuid.uuid4().hex}"
    blocks_ = spark.readStream.schema(derive.table(spark, d, "lineitem").schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    vox = blocks_.select((F.col("l_partkey") % 50).alias("label"), F.col("l_linenumber").cast("long").alias("z"))
    return stream.drain(stream.object_stats(vox, "label"), name, f"{ensure_checkpoint_dir(spark)}/{name}")
