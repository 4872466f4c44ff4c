"""Training-time augmentations as projections. Every draw is a hash of (seed, what it is drawn for), so a volume's augmentation does not depend on its partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roi import AXES
from ..plans.lineage import cut


def uniform(seed: int, *keys) -> Column:
    """A number in (0, 1) for the keys."""
    return (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def slab_keys(slab: tuple[int, int, int]) -> list[Column]:
    """Numbers of the slab that a voxel is in; -1 is a whole axis."""
    return [F.floor(F.col(a) / s) if s > 0 else F.lit(0).cast("long") for a, s in zip(AXES, slab)]


def gamma(df: DataFrame, value: str, slab=(1, -1, -1), exponent: float | None = None, low: float = 0.5, high: float = 2.0, seed: int = 0) -> DataFrame:
    """Each slab normalised by its extremes, raised to a power and stretched back; flat slabs stay. Without an exponent each slab draws one, evenly in gain from ``low`` to ``high``."""
    keys = slab_keys(slab)
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    if exponent is None:
        gain = lambda g: (max(g, 1 / g) - 1) * (-1 if g < 1 else 1)
        d = F.lit(gain(low)) + uniform(seed, *keys) * (gain(high) - gain(low))
        power = F.when(d < 0, 1 / (1 - d)).otherwise(1 + d)
    else:
        power = F.lit(float(exponent))
    return df.withColumn(value, F.when(hi - lo > 1e-3, lo + F.pow((F.col(value) - lo) / (hi - lo), power) * (hi - lo)).otherwise(F.col(value)))


def impulse_noise(df: DataFrame, value: str, p: float, seed: int = 0) -> DataFrame:
    """Voxels replaced by a uniform draw with probability p."""
    return df.withColumn(value, F.when(uniform(seed, *AXES) < p, uniform(seed + 1, *AXES)).otherwise(F.col(value)))


def gaussian_noise(df: DataFrame, value: str, std: float, seed: int = 0) -> DataFrame:
    """Values plus a normal deviate for each voxel, clipped to [0, 1]."""
    u, v = uniform(seed, *AXES), uniform(seed + 101, *AXES)
    z = F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * v)
    return df.withColumn(value, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value) + z * std)))


def zero_out(df: DataFrame, value: str, p: float, seed: int = 0, sections: list[int] | None = None) -> DataFrame:
    """Whole sections become 0 or 1 at even odds, with probability p or by list."""
    hit = F.col("z").isin(sections) if sections is not None else uniform(seed, "z") < p
    fill = F.when(uniform(seed + 1, "z") < 0.5, 0.0).otherwise(1.0) if sections is None else F.lit(0.0)
    return df.withColumn(value, F.when(hit, fill).otherwise(F.col(value)))


def low_contrast(df: DataFrame, value: str, scale: float, p: float = 1.0, seed: int = 0) -> DataFrame:
    """Sections pulled to their mean: mean + (value - mean) * scale."""
    mean = F.avg(value).over(Window.partitionBy("z"))
    return df.withColumn(value, F.when(uniform(seed, "z") < p, mean + (F.col(value) - mean) * scale).otherwise(F.col(value)))


def blend_artifact(df: DataFrame, value: str, artifact: DataFrame, p: float = 1.0, seed: int = 0) -> DataFrame:
    """Sections blended with an artifact (y, x, alpha, artifact): value * (1 - alpha) + artifact * alpha."""
    got = df.join(artifact.select("y", "x", F.col("alpha").alias("_al"), F.col("artifact").alias("_ar")), ["y", "x"], "left")
    mixed = F.when((uniform(seed, "z") < p) & F.col("_al").isNotNull(), F.col(value) * (1 - F.col("_al")) + F.col("_ar") * F.col("_al")).otherwise(F.col(value))
    return got.withColumn(value, mixed).drop("_al", "_ar")


def defects(df: DataFrame, value: str, p_missing: float = 0.0, p_low_contrast: float = 0.0, scale: float = 0.1, p_artifact: float = 0.0, artifact: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Each section draws once: missing, low contrast, artifact or nothing, by cumulative probability."""
    u = uniform(seed, "z")
    kind = F.when(u < p_missing, 1).when(u < p_missing + p_low_contrast, 2).when(u < p_missing + p_low_contrast + p_artifact, 3).otherwise(0)
    mean = F.avg(value).over(Window.partitionBy("z"))
    df = df.withColumn("_k", kind).withColumn("_m", mean)
    out = F.when(F.col("_k") == 1, F.when(uniform(seed + 1, "z") < 0.5, 0.0).otherwise(1.0)).when(F.col("_k") == 2, F.col("_m") + (F.col(value) - F.col("_m")) * scale)
    if artifact is not None:
        df = df.join(artifact.select("y", "x", F.col("alpha").alias("_al"), F.col("artifact").alias("_ar")), ["y", "x"], "left")
        out = out.when((F.col("_k") == 3) & F.col("_al").isNotNull(), F.col(value) * (1 - F.col("_al")) + F.col("_ar") * F.col("_al"))
    return df.withColumn(value, out.otherwise(F.col(value))).drop("_k", "_m", "_al", "_ar")


def deform_sections(df: DataFrame, value: str, strength: float, p: float = 1.0, seed: int = 0) -> DataFrame:
    """Sections whose two sides of a drawn line move apart along it by up to ``strength`` voxels; cells that nothing moved to are absent."""
    angle = uniform(seed, "z") * 3.141592653589793
    side = F.signum(F.col("y") * F.cos(angle) + F.col("x") * F.sin(angle) - uniform(seed + 1, "z") * 64)
    hit = uniform(seed + 2, "z") < p
    moved = lambda a, f: F.when(hit, F.col(a) + F.round(side * f(angle) * strength).cast("long")).otherwise(F.col(a)).alias(a)
    out = df.select("z", moved("y", F.cos), moved("x", F.sin), value)
    return out.groupBy(*AXES).agg(F.max(value).alias(value))


def obfuscate_merge(df: DataFrame, label: str, p: float, seed: int = 0) -> DataFrame:
    """In drawn sections an id takes the next larger id of the section."""
    ids = df.where(F.col(label) != 0).select("z", F.col(label).alias("_l")).distinct()
    nxt = F.lead("_l").over(Window.partitionBy("z").orderBy("_l"))
    pairs = ids.withColumn("_n", nxt).where(F.col("_n").isNotNull() & (uniform(seed, "z", "_l") < p))
    got = df.join(pairs.withColumnRenamed("z", "_z"), (F.col("z") == F.col("_z")) & (F.col(label) == F.col("_l")), "left").drop("_z")
    return got.withColumn(label, F.coalesce("_n", label)).drop("_l", "_n")


def obfuscate_split(df: DataFrame, label: str, p: float, new_id_offset: int, seed: int = 0) -> DataFrame:
    """In drawn sections an id's voxels past the middle of its box, along a drawn axis, get an id of their own."""
    w = Window.partitionBy("z", label)
    mid = lambda a: (F.min(a).over(w) + F.max(a).over(w)) / 2
    along = F.when(uniform(seed + 1, "z", label) < 0.5, F.col("y") > mid("y")).otherwise(F.col("x") > mid("x"))
    hit = (F.col(label) != 0) & (uniform(seed, "z", label) < p) & along
    return df.withColumn(label, F.when(hit, F.col(label) + new_id_offset).otherwise(F.col(label)))


def simple_transform(df: DataFrame, shape, mirror=(False, False, False), transpose_xy: bool = False) -> DataFrame:
    """Mirrored axes and swapped plane axes of a volume of this shape."""
    axes = [(s - 1 - F.col(a)).alias(a) if m else F.col(a) for a, s, m in zip(AXES, shape, mirror)]
    out = df.select(*axes, *[c for c in df.columns if c not in AXES])
    return out.select("z", F.col("x").alias("y"), F.col("y").alias("x"), *[c for c in df.columns if c not in AXES]) if transpose_xy else out


def shift_sections(df: DataFrame, reach: int, seed: int = 0, p: float = 1.0) -> DataFrame:
    """Sections moved in the plane by drawn whole steps within ``reach``."""
    step = lambda k: F.when(uniform(seed, "z") < p, F.floor(uniform(seed + k, "z") * (2 * reach + 1)) - reach).otherwise(0)
    return df.withColumn("y", F.col("y") + step(1)).withColumn("x", F.col("x") + step(2))


def intensity(df: DataFrame, value: str, scale: tuple, shift: tuple, seed: int = 0, per_section: bool = True) -> DataFrame:
    """mean + (value - mean) * scale + shift with drawn scale and shift, by section or for the volume; clipped to [0, 1]."""
    key = ["z"] if per_section else [F.lit(0)]
    # one number of the whole volume is an aggregate, not a window that one task would hold
    mean = F.avg(value).over(Window.partitionBy(*key)) if per_section else F.lit(df.agg(F.avg(value)).first()[0])
    s, b = (F.lit(lo) + uniform(seed + k, *key) * (hi - lo) for k, (lo, hi) in enumerate((scale, shift)))
    return df.withColumn(value, F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean + (F.col(value) - mean) * s + b)))


def random_locations(total, shape, n: int, seed: int = 0) -> list:
    """Boxes of a shape inside a total, drawn by hash."""
    import zlib

    from ..functions.roi import Roi

    out = []
    for k in range(n):
        at = [o + zlib.crc32(f"{seed}:{k}:{a}".encode()) % max(1, s - d + 1) for a, (o, s, d) in enumerate(zip(total.offset, total.shape, shape))]
        out.append(Roi(at, shape))
    return out


def synthetic_labels(spark, shape, seeds: int, seed: int = 0, blackout: tuple[int, ...] = (), side: int = 16) -> DataFrame:
    """(z, y, x, label): each voxel takes the nearest of drawn seed points, the smaller label of equally near ones.

    Voxels look for seeds in rings of cubes around their own, and only in as many as can hold a nearer one, so
    no voxel meets all seeds. Ids that a divisor of ``blackout`` divides become 0.
    """
    z, y, x = shape
    pts = spark.range(1, seeds + 1).select(F.col("id").alias("label"), *[F.floor(uniform(seed + k, "id") * s).alias(f"s{a}") for k, (a, s) in enumerate(zip(AXES, shape))])
    cube = pts.select("*", *[F.floor(F.col(f"s{a}") / side).alias(f"c{a}") for a in AXES])
    vox = spark.range(z * y * x).select((F.col("id") / (y * x)).cast("long").alias("z"), F.floor(F.col("id") % (y * x) / x).alias("y"), (F.col("id") % x).alias("x"))
    rings = max(-(-s // side) for s in shape)
    open_, done, ring = vox, None, 1
    while True:
        near = open_
        for a in AXES:
            near = near.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(a) / side) - ring, F.floor(F.col(a) / side) + ring)))
        d2 = sum((F.pow(F.col(a) - F.col(f"s{a}"), 2) for a in AXES), F.lit(0.0))
        best = near.join(cube, [f"c{a}" for a in AXES]).groupBy(*AXES).agg(F.min(F.struct(d2.alias("d2"), "label")).alias("m")).select(*AXES, "m.d2", "m.label")
        got = cut(open_.join(best, list(AXES), "left"))
        # nearer than the nearest cube that was not looked into
        sure = (F.col("d2").isNotNull() & (F.col("d2") <= (ring * side) ** 2)) | F.lit(ring >= rings)
        part = got.where(sure).select(*AXES, "label")
        done = part if done is None else done.unionByName(part)
        open_ = got.where(~sure).select(*AXES)
        if ring >= rings or open_.isEmpty():
            break
        ring = min(rings, ring * 2)
    for d in blackout:
        done = done.withColumn("label", F.when(F.col("label") % d == 0, 0).otherwise(F.col("label")))
    return done
