"""Boxes in world units and the arithmetic of requests.

A box is half open: it holds the points p with ``offset <= p < offset + shape``. Boxes live on the driver and
become column predicates, so Catalyst pushes them to the scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


class Coordinate(tuple):
    """An integer vector; arithmetic is element-wise and a number stands for a vector of it."""

    def __new__(cls, *v):
        return super().__new__(cls, (int(x) for x in (v[0] if len(v) == 1 and isinstance(v[0], Iterable) else v)))

    def _with(self, other, f):
        other = other if isinstance(other, tuple | list) else [other] * len(self)
        if len(other) != len(self):
            raise ValueError(f"{self} and {other} differ in dimensions")
        return Coordinate(f(a, b) for a, b in zip(self, other))

    def __add__(self, o):
        return self._with(o, lambda a, b: a + b)

    def __sub__(self, o):
        return self._with(o, lambda a, b: a - b)

    def __mul__(self, o):
        return self._with(o, lambda a, b: a * b)

    def __floordiv__(self, o):
        return self._with(o, lambda a, b: a // b)

    __truediv__ = __floordiv__

    def __neg__(self):
        return Coordinate(-a for a in self)


@dataclass(frozen=True)
class Roi:
    offset: Coordinate
    shape: Coordinate

    def __post_init__(self):
        object.__setattr__(self, "offset", Coordinate(self.offset))
        object.__setattr__(self, "shape", Coordinate(self.shape))
        if len(self.offset) != len(self.shape):
            raise ValueError("offset and shape differ in dimensions")

    @property
    def end(self) -> Coordinate:
        return self.offset + self.shape

    @property
    def empty(self) -> bool:
        return any(s <= 0 for s in self.shape)

    def intersect(self, o: Roi) -> Roi:
        lo = Coordinate(max(a, b) for a, b in zip(self.offset, o.offset))
        hi = Coordinate(min(a, b) for a, b in zip(self.end, o.end))
        return Roi(lo, Coordinate(max(0, b - a) for a, b in zip(lo, hi)))

    def union(self, o: Roi) -> Roi:
        lo = Coordinate(min(a, b) for a, b in zip(self.offset, o.offset))
        return Roi(lo, Coordinate(max(a, b) for a, b in zip(self.end, o.end)) - lo)

    def grow(self, low, high) -> Roi:
        zero = self.offset * 0
        low, high = zero + low, zero + high
        return Roi(self.offset - low, self.shape + low + high)

    def shift(self, by) -> Roi:
        return Roi(self.offset + by, self.shape)

    def contains(self, o: Roi) -> bool:
        return all(a <= b for a, b in zip(self.offset, o.offset)) and all(a >= b for a, b in zip(self.end, o.end))

    def snap_to_grid(self, grid, mode: str = "grow") -> Roi:
        grid = self.offset * 0 + grid
        up, down = (lambda a, g: -(-a // g) * g), (lambda a, g: a // g * g)
        first, last = {"grow": (down, up), "shrink": (up, down)}[mode]
        lo = Coordinate(first(a, g) for a, g in zip(self.offset, grid))
        hi = Coordinate(last(a, g) for a, g in zip(self.end, grid))
        return Roi(lo, Coordinate(max(0, b - a) for a, b in zip(lo, hi)))

    def __mul__(self, k) -> Roi:
        return Roi(self.offset * k, self.shape * k)

    def __floordiv__(self, k) -> Roi:
        return Roi(self.offset // k, self.shape // k)

    def where(self, *columns: str) -> Column:
        """The predicate of being inside, over the axes' columns."""
        cond = F.lit(True)
        for c, lo, hi in zip(columns or AXES[-len(self.offset) :], self.offset, self.end):
            cond = cond & (F.col(c) >= lo) & (F.col(c) < hi)
        return cond


def sub_roi(total: Roi, voxel_size, offset=None, shape=None) -> Roi:
    """A request in voxels from the total's corner, in world units, clipped to the total; None is all that is left."""
    voxel_size = Coordinate(voxel_size)
    start = Coordinate(offset or [0] * len(voxel_size)) * voxel_size
    left = total.shape - start
    size = left if shape is None else Coordinate(min(a, b) for a, b in zip(Coordinate(shape) * voxel_size, left))
    return Roi(total.offset + start, size).intersect(total)


def center_crop(outer: Roi, shape) -> Roi:
    """The box of a shape in the middle of another, by whole halves of the difference."""
    return Roi(outer.offset + (outer.shape - Coordinate(shape)) // 2, shape)


def max_padding(output_size, voxel_size, sigma, mode: str = "shrink") -> Coordinate:
    """World units to grow a request by so that any rotation of the output in the plane, and three sigma, are covered.

    An output one voxel deep needs no context along its first axis. Begins snap up for "shrink", down for "grow".
    """
    output_size, voxel_size = Coordinate(output_size), Coordinate(voxel_size)
    sigma = [sigma] * 3 if isinstance(sigma, int | float) else list(sigma)
    deep = output_size[0] // voxel_size[0] != 1
    half = int(math.hypot(*output_size[-2:]) / 2)
    pad = [(int(output_size[0] / 2) + 3 * sigma[0]) if deep else 0, half + 3 * sigma[1], half + 3 * sigma[2]]
    snap = math.ceil if mode == "shrink" else math.floor
    return Coordinate(snap(p / v) * v for p, v in zip(pad, voxel_size))


def halo_of(voxel_size, sigma=None, neighborhood=None) -> Coordinate:
    """World units of context that descriptors of a sigma and affinities of offsets need, on each side."""
    voxel_size = Coordinate(voxel_size)
    out = [0] * len(voxel_size)
    if sigma is not None:
        sigma = sigma if isinstance(sigma, tuple | list) else [sigma] * len(voxel_size)
        out = [math.ceil(3 * s / v) * v for s, v in zip(sigma, voxel_size)]
    for o in neighborhood or ():
        out = [max(a, abs(b) * v) for a, b, v in zip(out, o, voxel_size)]
    return Coordinate(out)


def block_grid(total: Roi, block_shape) -> list[Roi]:
    """The write boxes that tile a total, ragged at the far ends."""
    out = [()]
    for lo, hi, s in zip(total.offset, total.end, Coordinate(block_shape)):
        out = [(*o, (a, min(s, hi - a))) for o in out for a in range(lo, hi, s)]
    return [Roi([a for a, _ in o], [n for _, n in o]) for o in out]
