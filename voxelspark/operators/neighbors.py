"""Neighbourhoods as equi-joins on shifted coordinates and as windows along an axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roi import AXES

FACES = ((0, 0, 1), (0, 1, 0), (1, 0, 0))


def shifted_pairs(df: DataFrame, offsets, columns: list[str]) -> DataFrame:
    """(offset number, z, y, x, columns, columns of the voxel at the offset as ``n_*``), inner.

    Each voxel is sent once for every offset to where its neighbour looks for it, so all offsets share one
    equi-join on (offset, z, y, x) and background is best filtered before.
    """
    spots = F.array(*[F.struct(F.lit(k).alias("o"), F.lit(dz).cast("long").alias("dz"), F.lit(dy).cast("long").alias("dy"), F.lit(dx).cast("long").alias("dx")) for k, (dz, dy, dx) in enumerate(offsets)])
    here = df.select(*AXES, *columns, F.explode(spots).alias("s")).select("s.o", *AXES, *columns)
    there = df.select(*AXES, *columns, F.explode(spots).alias("s"))
    there = there.select("s.o", *[(F.col(a) - F.col(f"s.d{a}")).alias(a) for a in AXES], *[F.col(c).alias(f"n_{c}") for c in columns])
    return here.join(there, ["o", *AXES])


def affinities(df: DataFrame, label: str, offsets) -> DataFrame:
    """(z, y, x, o, aff): 1 where a voxel and its neighbour at the offset hold the same foreground id, 0 where both exist and differ."""
    got = shifted_pairs(df, offsets, [label])
    same = (F.col(label) == F.col(f"n_{label}")) & (F.col(label) != 0)
    return got.select(*AXES, "o", same.cast("int").alias("aff"))


def adjacency(df: DataFrame, label: str, faces=FACES) -> DataFrame:
    """(u, v), u < v: foreground objects with voxels that share a face."""
    got = shifted_pairs(df.where(F.col(label) != 0), faces, [label]).where(F.col(label) != F.col(f"n_{label}"))
    return got.select(F.least(label, f"n_{label}").alias("u"), F.greatest(label, f"n_{label}").alias("v")).distinct()


def boundary_affinity(df: DataFrame, label: str, affs: list[str], quantile: float | None = None) -> DataFrame:
    """(u, v, n, score): one less the mean (or a quantile) of the affinities across the boundary of two objects.

    ``affs[k]`` at a voxel is the affinity to its neighbour one step back along axis k.
    """
    steps = tuple(tuple(-1 if a == k else 0 for a in range(3)) for k in range(3))
    got = shifted_pairs(df.where(F.col(label) != 0), steps, [label, *affs]).where(F.col(label) != F.col(f"n_{label}"))
    value = F.element_at(F.array(*affs), F.col("o") + 1)
    agg = F.avg(value) if quantile is None else F.percentile(value, F.lit(quantile))
    out = got.groupBy(F.least(label, f"n_{label}").alias("u"), F.greatest(label, f"n_{label}").alias("v"))
    return out.agg(F.count("*").alias("n"), (1 - agg).alias("score"))


def equal_neighbour_edges(df: DataFrame, label: str) -> DataFrame:
    """(u, v): face-neighbours with the same foreground id, voxels named by :func:`voxel_key`."""
    keyed = df.where(F.col(label) != 0).withColumn("key", voxel_key())
    got = shifted_pairs(keyed, FACES, [label, "key"]).where(F.col(label) == F.col(f"n_{label}"))
    return got.select(F.col("key").alias("u"), F.col("n_key").alias("v"))


def voxel_key(bits: int = 20) -> Column:
    """A voxel's raster order as one number from 1, for coordinates from 0 to 2^bits - 1; others are an error, 0 stays background."""
    inside = F.lit(True)
    for a in ("z", "y", "x"):
        inside = inside & F.col(a).between(0, (1 << bits) - 1)
    key = F.shiftleft(F.col("z"), 2 * bits) + F.shiftleft(F.col("y"), bits) + F.col("x") + 1
    return F.when(inside, key).otherwise(F.raise_error(F.lit(f"a coordinate does not fit {bits} bits")).cast("long"))


def block_halo(df: DataFrame, block: tuple, halo: tuple, grid: tuple | None = None) -> DataFrame:
    """Voxels dealt to every block whose box, grown by the halo, holds them; ``core`` marks the block's own.

    An explode per axis, so the range join of voxels and blocks becomes a projection. Block numbers are from 0,
    and below ``grid`` where that is given.
    """
    out = df
    for k, a in enumerate(AXES):
        lo, hi = F.floor((F.col(a) - halo[k]) / block[k]), F.floor((F.col(a) + halo[k]) / block[k])
        lo = F.greatest(lo, F.lit(0))
        hi = F.least(hi, F.lit(grid[k] - 1)) if grid else hi
        out = out.withColumn(f"b{a}", F.explode(F.sequence(lo, hi)))
    core = F.lit(True)
    for k, a in enumerate(AXES):
        core = core & (F.floor(F.col(a) / block[k]) == F.col(f"b{a}"))
    return out.withColumn("core", core)


def max_along(df: DataFrame, value: str, axis: str, reach: int, low: int | None = None) -> Column:
    """The maximum over neighbours within ``reach`` along an axis (``low``: another reach backwards); absent cells do not count."""
    others = [a for a in AXES if a != axis]
    return F.max(value).over(Window.partitionBy(*others).orderBy(axis).rangeBetween(-(reach if low is None else low), reach))


def maximum_filter(df: DataFrame, value: str, size: int, axes=AXES) -> DataFrame:
    """The maximum over a box of ``size`` voxels around each voxel, axis by axis; an even size reaches further back."""
    out = df.withColumn("max_value", F.col(value))
    for a in axes:
        out = out.withColumn("max_value", max_along(out, "max_value", a, (size - 1) // 2, size // 2))
    return out


def local_maxima(df: DataFrame, value: str, size: int, axes=AXES) -> DataFrame:
    """Voxels that hold the maximum of their box."""
    return maximum_filter(df, value, size, axes).where(F.col(value) == F.col("max_value")).drop("max_value")


def boundary_grow(df: DataFrame, label: str, only_xy: bool = True) -> DataFrame:
    """One erosion step of every object: voxels with a face-neighbour that exists and holds another value become 0."""
    axes = AXES[1:] if only_xy else AXES
    low, high = F.col(label), F.col(label)
    for a in axes:
        w = Window.partitionBy(*[b for b in AXES if b != a]).orderBy(a).rangeBetween(-1, 1)
        low, high = F.least(low, F.min(label).over(w)), F.greatest(high, F.max(label).over(w))
    return df.withColumn("grown", F.when(low == high, F.col(label)).otherwise(0))


def grow_boundary(df: DataFrame, label: str, steps: int, only_xy: bool = True) -> DataFrame:
    """So many steps of :func:`boundary_grow`."""
    for _ in range(steps):
        df = boundary_grow(df, label, only_xy).withColumn(label, F.col("grown")).drop("grown")
    return df


def expand_labels(df: DataFrame, label: str, reach: int) -> DataFrame:
    """Background voxels of a section take the nearest label within ``reach``; of equally near ones the smallest."""
    disk = [(0, dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if 0 < dy * dy + dx * dx <= reach * reach]
    spots = F.array(*[F.struct(F.lit(dy).cast("long").alias("dy"), F.lit(dx).cast("long").alias("dx"), F.lit(dy * dy + dx * dx).alias("d2")) for _, dy, dx in disk])
    sent = df.where(F.col(label) != 0).select("z", "y", "x", F.col(label).alias("l"), F.explode(spots).alias("s"))
    near = sent.groupBy("z", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).agg(F.min(F.struct(F.col("s.d2"), "l"))["l"].alias("near"))
    return df.join(near, list(AXES), "left").withColumn("expanded", F.when(F.col(label) != 0, F.col(label)).otherwise(F.coalesce("near", F.lit(0)))).drop("near")


def disk_closing(df: DataFrame, mask: str, radius: int, times: int = 1) -> DataFrame:
    """Binary closing by a disk in each section, so many dilations then erosions; cells beyond the volume do not count."""
    disk = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    spots = F.array(*[F.struct(F.lit(dy).cast("long").alias("dy"), F.lit(dx).cast("long").alias("dx")) for dy, dx in disk])

    def step(d, value):  # cells reached from a cell of the value
        sent = d.where(F.col(mask) == value).select("z", "y", "x", F.explode(spots).alias("s"))
        hit = sent.select("z", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).distinct().withColumn("_hit", F.lit(1))
        return d.join(hit, list(AXES), "left").withColumn(mask, F.when(F.col("_hit").isNotNull(), value).otherwise(F.col(mask))).drop("_hit")

    for value in (1, 0):
        for _ in range(times):
            df = step(df, value)
    return df
