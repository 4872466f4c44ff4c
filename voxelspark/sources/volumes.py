"""Volumes as tables: a voxel table beside one row of metadata, and the other stores around them.

Every path is opened by Spark's readers and writers, so any store that Spark knows will do.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import provenance, pyramid_level
from ..functions.roi import AXES, Coordinate, Roi

_META = "name string, dtype string, shape array<long>, offset array<long>, voxel_size array<long>, axis_names array<string>, units array<string>, chunk_shape array<int>, channel_dims int, params map<string,string>"


@dataclass(frozen=True)
class VolumeMeta:
    """What is known of a volume besides its values; missing offsets are 0, missing voxel sizes 1."""

    name: str
    dtype: str
    shape: tuple
    offset: tuple | None = None
    voxel_size: tuple | None = None
    axis_names: tuple | None = None
    units: tuple | None = None
    chunk_shape: tuple | None = None
    channel_dims: int = 0
    params: Mapping = field(default_factory=dict)

    @property
    def roi(self) -> Roi:
        size = Coordinate(self.voxel_size or [1] * len(self.shape))
        return Roi(self.offset or [0] * len(self.shape), Coordinate(self.shape) * size)

    def row(self) -> dict:
        n = len(self.shape)
        d = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}
        return d | {
            "offset": d["offset"] or [0] * n, "voxel_size": d["voxel_size"] or [1] * n, "axis_names": d["axis_names"] or list(AXES[-n:]), "units": d["units"] or ["nm"] * n,
            "chunk_shape": d["chunk_shape"] or [64] * n, "params": provenance(self.params),
        }


def prepare_volume(spark: SparkSession, path: str, meta: VolumeMeta) -> None:
    """Writes the metadata row; values are written by :func:`write_volume`."""
    spark.createDataFrame([tuple(meta.row()[c.split()[0]] for c in _META.split(", "))], _META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def write_volume(df: DataFrame, path: str, meta: VolumeMeta, chunk: int = 64) -> None:
    """Voxels in folders of z-chunks, sorted by chunk within files so that row groups prune boxes."""
    prepare_volume(df.sparkSession, path, meta)
    keyed = df.withColumn("bz", F.floor(F.col("z") / chunk).cast("int"))
    order = [F.floor(F.col("y") / chunk), F.floor(F.col("x") / chunk), "z", "y", "x"]
    keyed.repartitionByRange("bz", "y").sortWithinPartitions("bz", *order).write.mode("overwrite").partitionBy("bz").parquet(f"{path}/voxels")


def read_meta(spark: SparkSession, path: str) -> VolumeMeta:
    r = spark.read.parquet(f"{path}/meta").first().asDict()
    return VolumeMeta(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items() if k != "params"}, params={k: json.loads(v) for k, v in (r["params"] or {}).items()})


def open_volume(spark: SparkSession, path: str, roi: Roi | None = None, chunk: int = 64) -> DataFrame:
    """The voxels of a volume, or of a box in voxels; folders outside the box are not listed."""
    df = spark.read.parquet(f"{path}/voxels")
    if roi is not None:
        df = df.where(roi.where()).where((F.col("bz") >= roi.offset[0] // chunk) & (F.col("bz") <= (roi.end[0] - 1) // chunk))
    return df.drop("bz")


def write_pyramid_level(df: DataFrame, path: str, level: int) -> None:
    """A level of a pyramid group; refuses to overwrite one."""
    df.write.mode("error").parquet(f"{path}/s{level}")


def read_pyramid(spark: SparkSession, path: str, levels: list[str]) -> DataFrame:
    """All levels as one table with a ``level`` column."""
    parts = [spark.read.parquet(f"{path}/{n}").withColumn("level", F.lit(pyramid_level(n))) for n in levels if pyramid_level(n) is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def image_stack(spark: SparkSession, path: str) -> DataFrame:
    """(z, y, x, value) of a folder of 2-D images, sorted by path; of colours the first channel (red). PNG, JPEG and what else Spark decodes.

    z is the place of a file among the sorted ones: a window over one row per image, without pixels.
    """
    from pyspark.sql import Window

    img = spark.read.format("image").load(path).select("image.*")
    place = img.select("origin", (F.row_number().over(Window.orderBy("origin")) - 1).alias("z"))
    rows = img.join(place, "origin").where("height > 0")

    def pixels(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for r in b.itertuples():
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                y, x = np.indices(a.shape[:2])
                yield pd.DataFrame({"z": r.z, "y": y.ravel(), "x": x.ravel(), "value": a[..., 2 if r.nChannels >= 3 else 0].ravel().astype(np.int16)})

    return rows.select("z", "height", "width", "nChannels", "data").mapInPandas(pixels, "z long, y long, x long, value short")


def zero_sections(df: DataFrame, sections: list[int], value: str = "value") -> DataFrame:
    """Sections that are known to be broken become 0."""
    return df.withColumn(value, F.when(F.col("z").isin(sections), 0).otherwise(F.col(value)))


def merge_sources(*frames: DataFrame) -> DataFrame:
    """Co-registered volumes with differently named values, where all have a voxel."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, ["z", "y", "x"])
    return out


def choose_source(frames: list[DataFrame], n: int, seed: int, weights: list[float] | None = None) -> list[int]:
    """Which of the sources each of n draws takes, by hash of (seed, draw)."""
    import zlib

    weights = weights or [1.0] * len(frames)
    out = []
    for k in range(n):
        u = zlib.crc32(f"{seed}:{k}".encode()) / 2**32 * sum(weights)
        i = 0
        while i < len(weights) - 1 and u >= weights[i]:
            u -= weights[i]
            i += 1
        out.append(i)
    return out


def tiles(df: DataFrame, z_chunk: int, tile: int = 4096) -> DataFrame:
    """Voxels with the z-chunk and xy-tile that they belong to."""
    return df.withColumn("tz", F.floor(F.col("z") / z_chunk)).withColumn("ty", F.floor(F.col("y") / tile)).withColumn("tx", F.floor(F.col("x") / tile))


def read_graphml(spark: SparkSession, path: str, roi: Roi | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GraphML files, nodes with all three positions inside a box; edges keep both ends, isolated nodes go."""

    def parse(batches):
        import pandas as pd

        for b in batches:
            out = []
            for content in b["content"]:
                root = ElementTree.fromstring(bytes(content))
                ns = root.tag.partition("}")[0] + "}" if root.tag.startswith("{") else ""
                keys = {k.get("id"): k.get("attr.name") for k in root.iter(f"{ns}key")}
                for n in root.iter(f"{ns}node"):
                    d = {keys.get(x.get("key")): x.text for x in n.iter(f"{ns}data")}
                    pos = [float(d[f"position_{a}"]) if d.get(f"position_{a}") else None for a in AXES]
                    out.append(("n", int(n.get("id")), None, int(float(d["id"])) if d.get("id") else None, *pos))
                out += [("e", int(e.get("source")), int(e.get("target")), None, None, None, None) for e in root.iter(f"{ns}edge")]
            yield pd.DataFrame(out, columns=["kind", "u", "v", "skel", "z", "y", "x"]).astype({"u": "Int64", "v": "Int64", "skel": "Int64", "z": float, "y": float, "x": float})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "kind string, u long, v long, skel long, z double, y double, x double")
    nodes = rows.where("kind = 'n' and z is not null and y is not null and x is not null and not isnan(z) and not isnan(y) and not isnan(x)")
    nodes = nodes.select(F.col("u").alias("node"), "skel", "z", "y", "x")
    if roi is not None:
        cond = F.lit(True)
        for a, lo, hi in zip(AXES, roi.offset, roi.end):
            cond = cond & ((F.col(a) > lo) if strict else (F.col(a) >= lo)) & (F.col(a) < hi)
        nodes = nodes.where(cond)
    ids = nodes.select("node")
    edges = rows.where("kind = 'e'").select("u", "v")
    edges = edges.join(ids.withColumnRenamed("node", "u"), "u", "left_semi").join(ids.withColumnRenamed("node", "v"), "v", "left_semi").select("u", "v")
    used = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(used, "node", "left_semi"), edges


def read_graph(spark: SparkSession, store: Mapping, what: str, where: str | None = None) -> DataFrame:
    """Nodes or edges of a graph store; the predicate is pushed to the source, but one that asks for a score holds for the settled one."""
    if store["kind"] == "parquet":
        df = _settled(spark.read.parquet(f"{store['path']}/{what}"))
    else:
        df = spark.read.format("jdbc").options(url=store["url"], dbtable=store[what], **{k: store[k] for k in ("user", "password") if k in store}).load()
    return df.where(where) if where else df


def write_graph(nodes: DataFrame | None, edges: DataFrame | None, path: str) -> None:
    """Appends nodes and edges of blocks, each block's once; :func:`read_graph` settles what several blocks wrote."""
    if nodes is not None:
        nodes.dropDuplicates(["id"]).write.mode("append").parquet(f"{path}/nodes")
    if edges is not None:
        e = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "score")
        e.groupBy("u", "v").agg(F.min("score").alias("score")).write.mode("append").parquet(f"{path}/edges")


def _settled(df: DataFrame) -> DataFrame:
    """One row per node, or per undirected edge with the smallest score that a block gave it."""
    return df.dropDuplicates(["id"]) if "id" in df.columns else df.groupBy("u", "v").agg(F.min("score").alias("score"))


def read_lut_json(spark: SparkSession, path: str) -> DataFrame:
    """(fragment, segment) of a JSON document ``{"merges": {"segment": [fragments]}}`` or of the inner object alone."""
    text = spark.read.text(path, wholetext=True)
    kind = "map<string,array<bigint>>"
    inner = F.coalesce(F.get_json_object("value", "$.merges"), F.col("value"))
    return text.select(F.explode(F.from_json(inner, kind)).alias("k", "ids")).select(F.explode("ids").alias("fragment"), F.col("k").cast("long").alias("segment"))


def read_lut_npz(spark: SparkSession, path: str) -> DataFrame:
    """(fragment, segment) of ``.npz`` files, each with one array of two rows: fragments and their segments."""

    def parse(frames):
        import io

        import numpy as np
        import pandas as pd

        for pdf in frames:
            for raw in pdf["content"]:
                with np.load(io.BytesIO(raw)) as f:
                    pairs = f[f.files[0]].astype(np.int64)
                yield pd.DataFrame({"fragment": pairs[0], "segment": pairs[1]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "fragment long, segment long")


def write_lut(lut: DataFrame, path: str) -> None:
    """(fragment, segment), one row a fragment, as parquet; a fragment with two segments keeps the smaller."""
    lut.groupBy("fragment").agg(F.min("segment").alias("segment")).write.mode("overwrite").parquet(path)


def read_lut(spark: SparkSession, path: str) -> DataFrame:
    """A lookup table by its ending: ``.json``, ``.npz``, or else what :func:`write_lut` wrote."""
    if path.endswith(".json"):
        return read_lut_json(spark, path)
    return read_lut_npz(spark, path) if path.endswith(".npz") else spark.read.parquet(path).select("fragment", "segment")


def write_results(df: DataFrame, path: str) -> None:
    """Metrics as JSON lines, one for each segmentation."""
    df.coalesce(1).write.mode("overwrite").json(path)


def snapshot(df: DataFrame, path: str, step: int, every: int, columns: list[str]) -> bool:
    """Every so many steps, the columns rescaled from [-1, 1] to [0, 255]; whether it was written."""
    if step % every:
        return False
    scaled = [F.round((F.col(c) + 1) * 127.5).cast("short").alias(c) if c in columns else F.col(c) for c in df.columns]
    df.select(*scaled).withColumn("step", F.lit(step)).write.mode("append").partitionBy("step").parquet(path)
    return True
