"""NumPy kernels on one block: what is inherently sequential or needs a whole neighbourhood at once.

Arrays are (z, y, x) or (y, x); labels are integers with 0 as background; neighbours share a face.
"""

from __future__ import annotations

import heapq
from array import array

import numpy as np


def _lines(a: np.ndarray, axis: int) -> np.ndarray:
    return np.moveaxis(a, axis, -1).reshape(-1, a.shape[axis])


def edt(mask: np.ndarray, spacing=None, nearest: bool = False):
    """Euclidean distance of each True voxel to the nearest False one (infinite without one); with ``nearest`` also its flat index.

    Squared distances are lowered axis by axis: along a line, d(i) = min over j of f(j) + (i - j)^2.
    """
    spacing = spacing or [1.0] * mask.ndim
    d = np.where(mask, np.inf, 0.0)
    at = np.arange(mask.size).reshape(mask.shape)
    for axis in range(mask.ndim):
        n = mask.shape[axis]
        gap = ((np.arange(n)[:, None] - np.arange(n)[None, :]) * spacing[axis]) ** 2
        f, ids = _lines(d, axis), _lines(at, axis)
        best, who = np.empty_like(f), np.empty_like(ids)
        for k in range(0, len(f), max(1, (1 << 22) // max(1, n * n))):
            part = slice(k, k + max(1, (1 << 22) // max(1, n * n)))
            c = f[part][:, None, :] + gap[None]
            j = c.argmin(-1)
            best[part] = np.take_along_axis(c, j[..., None], -1)[..., 0]
            who[part] = np.take_along_axis(ids[part], j, -1)
        shape = [*np.moveaxis(d, axis, -1).shape]
        d, at = np.moveaxis(best.reshape(shape), -1, axis), np.moveaxis(who.reshape(shape), -1, axis)
    return (np.sqrt(d), at) if nearest else np.sqrt(d)


def lower_along(d: np.ndarray, axis: int) -> np.ndarray:
    """One axis of :func:`edt`: squared distances d(i) = min over j of d(j) + (i - j)^2 along each line."""
    out, n = np.moveaxis(d.astype(float), axis, 0), d.shape[axis]
    f = out.copy()
    for gap in range(1, n):
        if gap * gap >= out.max():
            break
        np.minimum(out[gap:], f[:-gap] + gap * gap, out=out[gap:])
        np.minimum(out[:-gap], f[gap:] + gap * gap, out=out[:-gap])
    return np.moveaxis(out, 0, axis)


def gaussian(a: np.ndarray, sigma, truncate: float = 4.0) -> np.ndarray:
    """Separable Gaussian with mirrored edges, cut at ``truncate`` sigma."""
    out = a.astype(float)
    for axis, s in enumerate(sigma if isinstance(sigma, list | tuple) else [sigma] * a.ndim):
        if not s:
            continue
        r = int(truncate * s + 0.5)
        w = np.exp(-0.5 * (np.arange(-r, r + 1) / s) ** 2)
        w /= w.sum()
        pad = [(r, r) if k == axis else (0, 0) for k in range(a.ndim)]
        p = np.pad(out, pad, mode="symmetric")
        out = sum(w[k] * np.take(p, range(k, k + a.shape[axis]), axis) for k in range(2 * r + 1))
    return out


def box_max(a: np.ndarray, size: int) -> np.ndarray:
    """The maximum over a box of ``size`` around each voxel; beyond the edge nothing counts."""
    out = a
    for axis in range(a.ndim):
        pad = [(size // 2, (size - 1) // 2) if k == axis else (0, 0) for k in range(a.ndim)]
        p = np.pad(out, pad, constant_values=-np.inf)
        out = np.lib.stride_tricks.sliding_window_view(p, size, axis).max(-1)
    return out


def flat_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component: hooking to smaller roots, then pointer jumping."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def components(labels: np.ndarray) -> tuple[np.ndarray, int]:
    """Face-connected parts of equal foreground values, numbered from 1 in raster order; and how many."""
    at = np.arange(labels.size).reshape(labels.shape)
    us, vs = [], []
    for axis in range(labels.ndim):
        a, b = np.take(labels, range(labels.shape[axis] - 1), axis), np.take(labels, range(1, labels.shape[axis]), axis)
        same = (a == b) & (a != 0)
        us.append(np.take(at, range(labels.shape[axis] - 1), axis)[same])
        vs.append(np.take(at, range(1, labels.shape[axis]), axis)[same])
    root = flat_components(labels.size, np.concatenate(us), np.concatenate(vs))
    fore = labels.ravel() != 0
    ids, inv = np.unique(root[fore], return_inverse=True)
    out = np.zeros(labels.size, np.int64)
    out[fore] = inv + 1
    return out.reshape(labels.shape), len(ids)


def affinity_flood(hard: np.ndarray) -> np.ndarray:
    """Components of (channel, z, y, x) booleans: channel k at v joins v to v + 1 along axis k; ids from 1 in raster order."""
    shape = hard.shape[1:]
    at = np.arange(int(np.prod(shape))).reshape(shape)
    fore = hard.any(0)
    us, vs = [], []
    for axis in range(3):
        n = shape[axis]
        on = np.take(hard[axis], range(n - 1), axis) & np.take(fore, range(1, n), axis)
        us.append(np.take(at, range(n - 1), axis)[on])
        vs.append(np.take(at, range(1, n), axis)[on])
    root = flat_components(at.size, np.concatenate(us), np.concatenate(vs))
    ids, inv = np.unique(root[fore.ravel()], return_inverse=True)
    out = np.zeros(at.size, np.int64)
    out[fore.ravel()] = inv + 1
    return out.reshape(shape)


def _steps(shape):
    """(flat step, axis, direction) of face neighbours."""
    stride = np.cumprod([1, *shape[::-1]])[:-1][::-1]
    return [(int(s) * d, k, d) for k, s in enumerate(stride) for d in (-1, 1)]


def watershed(height: np.ndarray, seeds: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Seeded watershed: voxels of the mask are flooded from the lowest, first come first served among equals."""
    shape, lab = height.shape, np.where(mask, seeds, 0).ravel().astype(np.int64)
    h, ok = height.ravel().tolist(), mask.ravel()
    steps = _steps(shape)
    size = [int(s) for s in shape]
    stride = [abs(st) for st, _, d in steps if d == 1]
    heap = [(h[i], k, i) for k, i in enumerate(np.flatnonzero(lab).tolist())]
    heapq.heapify(heap)
    count = len(heap)
    while heap:
        _, _, i = heapq.heappop(heap)
        for st, k, d in steps:
            c = i // stride[k] % size[k]
            if not 0 <= c + d < size[k]:
                continue
            j = i + st
            if ok[j] and not lab[j]:
                lab[j] = lab[i]
                heapq.heappush(heap, (h[j], count, j))
                count += 1
    return lab.reshape(shape)


def basins(mask: np.ndarray, reach: int) -> np.ndarray:
    """Parts of a mask of any rank, flooded from the plateaus that lie farthest from its background within a box of ``reach``; numbered from 1.

    Where there is no background, every voxel is as far as the sides are long together.
    """
    depth = np.minimum(edt(mask), float(sum(mask.shape)))
    plateaus, _ = components((depth == box_max(depth, reach)).astype(int))
    return watershed(-depth, plateaus, mask)


def affinity_basins(affs: np.ndarray, flat: bool, reach: int = 10, most: float = 1.0) -> np.ndarray:
    """Basins where (channel, z, y, x) affinities exceed half of ``most`` on average: of all channels in 3-D, or flat ones of the two in the plane, section by section.

    Numbers of a section go on from the voxels of those before it, so no count is handed on.
    """
    if not flat:
        return basins(affs.mean(0) > most / 2, reach)
    sheets = affs[-2:].mean(0) > most / 2
    return np.stack([np.where(got > 0, got + z * got.size, 0) for z, got in enumerate(basins(sheet, reach) for sheet in sheets)])


def seed_decay(affs: np.ndarray, eps: float, min_seed_distance: int = 10) -> np.ndarray:
    """Affinities less eps times the distance to the nearest seed, which makes for more fragments."""
    mask = affs.mean(0) > 0.5
    dist = edt(mask)
    seeds = (box_max(dist, min_seed_distance) == dist) & mask
    far = edt(~seeds)
    return affs - eps * np.where(np.isfinite(far), far, 0.0)


def _around(a: np.ndarray, fill):
    for axis in range(a.ndim):
        for d in (-1, 1):
            p = np.roll(a, d, axis)
            edge = [slice(None)] * a.ndim
            edge[axis] = 0 if d == 1 else -1
            p[tuple(edge)] = fill if not isinstance(fill, np.ndarray) else fill[tuple(edge)]
            yield p


def dilate(a: np.ndarray, times: int = 1) -> np.ndarray:
    """Background voxels beside a label take it, the smallest of several."""
    big = np.iinfo(np.int64).max
    for _ in range(times):
        best = np.full(a.shape, big)
        for p in _around(a, 0):
            best = np.where((p != 0) & (p < best), p, best)
        a = np.where((a == 0) & (best < big), best, a)
    return a


def erode(a: np.ndarray, times: int = 1) -> np.ndarray:
    """Voxels beside another value become background; beyond the edge the value goes on."""
    for _ in range(times):
        keep = np.ones(a.shape, bool)
        for p in _around(a, a):
            keep &= p == a
        a = np.where(keep, a, 0)
    return a


def opening(a: np.ndarray, times: int = 1) -> np.ndarray:
    return dilate(erode(a, times), times)


def closing(a: np.ndarray, times: int = 1) -> np.ndarray:
    return erode(dilate(a, times), times)


def fill_holes(a: np.ndarray, merge_threshold: float = 0.95) -> np.ndarray:
    """Parts of background that do not reach the edge take the label that makes up at least a share of the faces around them."""
    parts, n = components((a == 0).astype(int))
    if not n:
        return a
    open_ = np.zeros(n + 1, bool)
    for axis in range(a.ndim):
        for end in (0, -1):
            open_[np.unique(np.take(parts, end, axis))] = True
    pairs = []
    for p in _around(a, 0):
        hit = (parts > 0) & (p != 0)
        pairs.append(np.stack([parts[hit], p[hit]], 1))
    faces, counts = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
    total = np.bincount(faces[:, 0], counts, n + 1) if len(faces) else np.zeros(n + 1)
    fill = np.zeros(n + 1, a.dtype)
    for (part, label), c in zip(faces.tolist(), counts.tolist()):
        if not open_[part] and c >= merge_threshold * total[part]:
            fill[part] = label
    return np.where(a == 0, fill[parts], a)


def morph(a: np.ndarray, op: str, times: int = 1, per_section: bool = False) -> np.ndarray:
    """One of dilate, erode, opening, closing, fill_holes, in 3-D or section by section."""
    f = {"dilate": dilate, "erode": erode, "opening": opening, "closing": closing, "fill_holes": lambda x, _: fill_holes(x)}[op]
    return np.stack([f(s, times) for s in a]) if per_section else f(a, times)


def clahe(a: np.ndarray, tile: int = 8, clip: float = 0.01, bins: int = 256, least_range: float = 1e-3) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of a section; a flat one stays. Values keep their range."""
    lo, hi = float(a.min()), float(a.max())
    if hi - lo <= least_range:
        return a.astype(float)
    q = np.minimum(((a - lo) / (hi - lo) * bins).astype(int), bins - 1)
    ny, nx = -(-a.shape[0] // tile), -(-a.shape[1] // tile)
    maps = np.empty((ny, nx, bins))
    for i in range(ny):
        for j in range(nx):
            h = np.bincount(q[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile].ravel(), minlength=bins).astype(float)
            top = max(1.0, clip * h.sum())
            over = np.maximum(h - top, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(h, top) + over / bins) / h.sum()
    y, x = (np.arange(a.shape[0]) - (tile - 1) / 2) / tile, (np.arange(a.shape[1]) - (tile - 1) / 2) / tile
    y0, x0 = np.clip(np.floor(y).astype(int), 0, ny - 1), np.clip(np.floor(x).astype(int), 0, nx - 1)
    y1, x1 = np.minimum(y0 + 1, ny - 1), np.minimum(x0 + 1, nx - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None, :]
    g = lambda i, j: maps[i[:, None], j[None, :], q]
    out = (1 - fy) * ((1 - fx) * g(y0, x0) + fx * g(y0, x1)) + fy * ((1 - fx) * g(y1, x0) + fx * g(y1, x1))
    return lo + out * (hi - lo)


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, a: int, b: int) -> int:
        self.up[max(a, b)] = min(a, b)
        return min(a, b)


class MutexSets:
    """Clusters of n nodes under edges that come by falling |w|, some at a time: positive ones join, negative ones forbid.

    A cluster's list holds a node of each cluster that it must not join, so a forbidden pair takes four bytes at
    either end. Of two lists the shorter one answers and moves; long ones are cut to one entry a cluster as they double.
    """

    SHORT, LONG, KNOWN = 48, 1024, 1 << 20

    def __init__(self, n: int):
        self.up, self.far = array("q", range(n)), [None] * n
        self.due: dict[int, int] = {}
        self.known: set[int] = set()  # pairs of roots with long lists that were found forbidden

    def roots(self, x: np.ndarray) -> np.ndarray:
        up = np.frombuffer(self.up, np.int64) if len(self.up) else np.empty(0, np.int64)
        now = up[x]
        while ((then := up[now]) != now).any():
            now = then
        return now

    def take(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        a, b = self.roots(u), self.roots(v)
        open_ = (a != b) & (w != 0)
        up, far = self.up, self.far
        for i, j, apart in zip(a[open_].tolist(), b[open_].tolist(), (w[open_] < 0).tolist()):
            while up[i] != i:
                up[i] = i = up[up[i]]
            while up[j] != j:
                up[j] = j = up[up[j]]
            if i == j:
                continue
            if apart:
                for x, y in ((i, j), (j, i)):
                    if far[x] is None:
                        far[x] = array("i", (y,))
                    else:
                        far[x].append(y)
                        if len(far[x]) >= self.LONG:
                            self._shorten(x)
            elif not self._forbidden(i, j):
                self._join(i, j)

    def _shorten(self, i: int) -> None:
        if len(self.far[i]) >= self.due.get(i, 0):
            self.far[i] = array("i", np.unique(self.roots(np.array(self.far[i]))).astype(np.int32).tobytes())
            self.due[i] = 2 * len(self.far[i])

    def _forbidden(self, i: int, j: int) -> bool:
        up, few, other = self.up, self.far[i], j
        if few is None or self.far[j] is None:
            return False
        if len(few) > len(self.far[j]):
            few, other = self.far[j], i
        if len(few) <= self.SHORT:
            for x in few:
                while up[x] != x:
                    up[x] = x = up[up[x]]
                if x == other:
                    return True
            return False
        pair = min(i, j) * len(up) + max(i, j)
        if pair in self.known:
            return True
        if not (self.roots(np.array(few)) == other).any():
            return False
        if len(self.known) >= self.KNOWN:
            self.known.clear()
        self.known.add(pair)
        return True

    def _join(self, i: int, j: int) -> None:
        far = self.far
        if len(far[i] or ()) < len(far[j] or ()):
            i, j = j, i
        self.up[j] = i
        if far[j] is not None:
            far[i].extend(far[j])
            far[j] = None
            self.due.pop(j, None)
            if len(far[i]) >= self.LONG:
                self._shorten(i)

    def least(self) -> np.ndarray:
        """For each node its cluster's least node."""
        at = np.arange(len(self.up))
        root, out = self.roots(at), np.full(len(at), len(at))
        np.minimum.at(out, root, at)
        return out[root]


def mutex_watershed(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each of n nodes its cluster's least node: edges by falling |w|; positive ones join, negative ones forbid."""
    sets, by = MutexSets(n), np.lexsort((v, u, -np.abs(w)))
    for k in range(0, len(by), 1 << 14):
        at = by[k : k + (1 << 14)]
        sets.take(u[at], v[at], w[at])
    return sets.least()


def grid_edges(affs: np.ndarray, offsets, strides=None, mask: np.ndarray | None = None, randomized: bool = False, seed: int = 0):
    """(u, v, w) of (channel, z, y, x) signed affinities: each voxel and the one at its channel's offset, at every stride.

    Randomized strides keep as large a share of a channel's edges, drawn instead of on a grid.
    """
    shape = affs.shape[1:]
    draw = np.random.default_rng(seed)
    at = np.arange(int(np.prod(shape))).reshape(shape)
    us, vs, ws = [], [], []
    for k, o in enumerate(offsets):
        if any(abs(d) >= n for d, n in zip(o, shape)):  # longer than the volume
            continue
        here = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(o, shape))
        there = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(o, shape))
        keep = np.ones(at[here].shape, bool)
        if strides is not None and randomized:
            share = 1 / np.prod(strides[k])
            keep &= draw.random(keep.shape) < share if share < 1 else True
        elif strides is not None:
            for axis, s in enumerate(strides[k]):
                first = here[axis].start
                keep &= np.expand_dims((np.arange(first, first + keep.shape[axis]) % s) == 0, tuple(a for a in range(3) if a != axis))
        if mask is not None:
            keep &= mask[here] & mask[there]
        us.append(at[here][keep])
        vs.append(at[there][keep])
        ws.append(affs[k][here][keep])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs]), np.concatenate([np.empty(0), *ws])


def affinity_mutex_watershed(affs, offsets, bias, strides=None, sigma=None, shift=None, mask=None, randomized=False, seed=0) -> np.ndarray:
    """Labels of a volume by the mutex watershed of its biased affinities; ids from 1 in raster order."""
    w = affs.astype(float) + np.asarray(bias, float).reshape(-1, 1, 1, 1)
    if sigma is not None:
        w += gaussian(affs, (0, *sigma)) - affs
    if shift is not None:
        w += shift
    u, v, s = grid_edges(w, offsets, strides, mask, randomized, seed)
    lab = mutex_watershed(int(np.prod(affs.shape[1:])), u, v, s)
    ids, inv = np.unique(lab, return_inverse=True)
    out = (inv + 1).reshape(affs.shape[1:])
    return np.where(mask, out, 0) if mask is not None else out


def agglomerate(u, v, n, total, stop: float = np.inf, quantile: float | None = None):
    """(step, a, b, c, score): greedy merging of a graph's cheapest edge; boundaries are joined by their sizes and sums.

    Edge k has ``n[k]`` boundary voxels with affinities that sum to ``total[k]``; its score is 1 - mean. With a
    quantile ``total[k]`` holds the affinities themselves, and the score is 1 - that quantile. c = min(a, b).
    """
    near: dict[int, dict[int, list]] = {}
    plus = (lambda s, t: s + t) if quantile is None else (lambda s, t: np.concatenate([s, t]))
    score = (lambda k, t: 1 - t / k) if quantile is None else (lambda k, t: 1 - float(np.quantile(t, quantile)))
    sums = np.asarray(total).tolist() if quantile is None else [np.asarray(t, float) for t in total]
    for a, b, k, t in zip(*(np.asarray(x).tolist() for x in (u, v, n)), sums):
        e = near.setdefault(a, {}).get(b)
        near[a][b] = near.setdefault(b, {})[a] = [k, t, 0.0] if e is None else [e[0] + k, plus(e[1], t), 0.0]
    for a, m in near.items():
        for b, e in m.items():
            if a < b:
                e[2] = score(e[0], e[1])
    heap = [(e[2], a, b, e[0]) for a, m in near.items() for b, e in m.items() if a < b]
    heapq.heapify(heap)
    out = []
    while heap:
        s, a, b, k = heapq.heappop(heap)
        e = near.get(a, {}).get(b)
        if e is None or e[0] != k or e[2] != s:
            continue
        if s > stop:
            break
        out.append((len(out), a, b, a, s))
        gone = near.pop(b)
        for c, f in gone.items():
            del near[c][b]
            if c == a:
                continue
            g = near[a].get(c)
            if g is None:
                g = f
            else:
                g = [g[0] + f[0], plus(g[1], f[1]), 0.0]
                g[2] = score(g[0], g[1])
            near[a][c] = near[c][a] = g
            heapq.heappush(heap, (g[2], min(a, c), max(a, c), g[0]))
    return out


def joined_at(u, v, history) -> np.ndarray:
    """The score at which each pair of nodes first stands in one, by a merge history (step, a, b, c = a, score); nan for never."""
    up: dict[int, tuple] = {b: (step, a, score) for step, a, b, _, score in history}
    out = np.full(len(u), np.nan)
    for k, (p, q) in enumerate(zip(np.asarray(u).tolist(), np.asarray(v).tolist())):
        s = 0.0
        while p != q:
            # a node is named by its cluster's root until its step; the earlier of both steps comes first
            if p not in up and q not in up:
                s = np.nan
                break
            if q not in up or (p in up and up[p][0] < up[q][0]):
                _, p, s = up[p]
            else:
                _, q, s = up[q]
        out[k] = s
    return out


def multiway_cut(pdf) -> tuple[int, int]:
    """(cut edges, extra merges) of one segment's rows: edges (u, v, score) and sites (u, skel)."""
    sites, owner, shared = pdf[pdf["skel"].notna()], {}, set()
    for f, s in zip(sites["u"].tolist(), sites["skel"].tolist()):
        if owner.setdefault(f, s) != s:
            shared.add(f)
    groups: dict = {}
    for f, s in owner.items():
        if f not in shared:
            groups.setdefault(s, set()).add(f)
    if len(groups) <= 1:
        return 0, 0
    cap: dict = {}
    e = pdf[pdf["v"].notna()]
    for a, b, s in zip(e["u"].tolist(), e["v"].tolist(), e["score"].tolist()):
        if a in shared or b in shared:
            continue
        w = max(1e-9, 1 - s)
        cap.setdefault(a, {})[b] = cap.get(a, {}).get(b, 0) + w
        cap.setdefault(b, {})[a] = cap.get(b, {}).get(a, 0) + w
    cuts, names = 0, sorted(groups)
    for s in names[:-1]:
        others = set().union(*(groups[t] for t in names if t > s))
        side = _source_side(cap, groups[s], others)
        for a in list(cap):
            for b in list(cap[a]):
                if a in side and b not in side:
                    del cap[a][b], cap[b][a]
                    cuts += 1
    seen, parts = {}, 0
    for f in sorted(set().union(*groups.values())):
        if f in seen:
            continue
        parts += 1
        todo = [f]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = parts
                todo += [y for y in cap.get(x, {}) if y not in seen]
    return cuts, max(0, parts - len(groups))


def island_sides(pdf) -> dict:
    """For each fragment of an island the skeleton it stays with, by cuts one after another as in :func:`multiway_cut`; None for all where no skeleton touches the island.

    Rows: (x, y, w) within the island, (x, skel, w) summed over a skeleton's fragments.
    """
    cap: dict = {}
    for x, y, s, w in zip(pdf["x"].tolist(), pdf["y"].tolist(), pdf["skel"].tolist(), pdf["w"].tolist()):
        a, b = (0, int(x)), (0, int(y)) if y == y else (1, int(s))
        cap.setdefault(a, {})[b] = cap.get(a, {}).get(b, 0) + w
        cap.setdefault(b, {})[a] = cap.get(b, {}).get(a, 0) + w
    names = sorted(x for kind, x in cap if kind)
    got = {x: names[-1] if names else None for kind, x in cap if not kind}
    for k, s in enumerate(names[:-1]):
        side = _source_side(cap, {(1, s)}, {(1, t) for t in names[k + 1 :]})
        got |= {x: s for kind, x in side if not kind}
        for a in side:
            for b in cap.pop(a, {}):
                if b not in side:
                    del cap[b][a]
    return got


def _source_side(cap: dict, source: set, sink: set) -> set:
    """Nodes on the source's side of a minimum cut (the least such set), by blocking flows on shortest paths."""
    flow = {a: dict(m) for a, m in cap.items()}
    while True:
        level, todo, met = dict.fromkeys(source, 0), list(source), False
        while todo and not met:
            nxt = []
            for x in todo:
                for y, c in flow.get(x, {}).items():
                    if c > 1e-12 and y not in level:
                        level[y] = level[x] + 1
                        if y in sink:
                            met = True
                        else:
                            nxt.append(y)
            todo = nxt
        if not met:
            return set(level)
        arcs, dead = {}, set()
        for s in source:
            path = [s]
            while path:
                x = path[-1]
                if x in sink:
                    steps = list(zip(path, path[1:]))
                    m = min(flow[a][b] for a, b in steps)
                    for a, b in steps:
                        flow[a][b] -= m
                        flow[b][a] = flow[b].get(a, 0) + m
                    del path[next(k for k, (a, b) in enumerate(steps) if flow[a][b] <= 1e-12) + 1 :]
                    continue
                if x not in arcs:
                    arcs[x] = [y for y in flow.get(x, {}) if level.get(y) == level[x] + 1]
                rest = arcs[x]
                while rest and (rest[-1] in dead or flow[x][rest[-1]] <= 1e-12):
                    rest.pop()
                if rest:
                    path.append(rest[-1])
                else:
                    dead.add(x)
                    path.pop()


def local_shape_descriptors(labels: np.ndarray, sigma, voxel_size=None) -> np.ndarray:
    """(10 or 6, ...) channels in [0, 1]: Gaussian-weighted mean offset, covariance (off-diagonal, then diagonal) and size, label by label."""
    n = labels.ndim
    voxel_size = voxel_size or [1.0] * n
    sigma = sigma if isinstance(sigma, list | tuple) else [sigma] * n
    px = [s / v for s, v in zip(sigma, voxel_size)]
    coords = [c * v for c, v in zip(np.indices(labels.shape).astype(float), voxel_size)]
    cross = [(a, b) for a in range(n) for b in range(a + 1, n)]
    order = [(a, a) for a in range(n)]
    out = np.zeros((2 * n + len(cross) + 1, *labels.shape))
    for l in np.unique(labels):
        if l == 0:
            continue
        m = (labels == l).astype(float)
        count = gaussian(m, px)
        safe = np.maximum(count, 1e-12)
        mean = [gaussian(m * c, px) / safe for c in coords]
        cov = lambda a, b: gaussian(m * coords[a] * coords[b], px) / safe - mean[a] * mean[b]
        feats = [np.clip((mean[k] - coords[k]) / sigma[k] * 0.5 + 0.5, 0, 1) for k in range(n)]
        diag = {k: np.maximum(cov(k, k), 1e-3) for k in range(n)}
        pear = [np.clip(cov(a, b) / np.sqrt(diag[a] * diag[b]) * 0.5 + 0.5, 0, 1) for a, b in cross]
        var = [np.clip(diag[a] / sigma[a] ** 2, 0, 1) for a, _ in order]
        for k, f in enumerate([*feats, *pear, *var, np.clip(count, 0, 1)]):
            out[k] += f * m
    return out


def grow_random(labels: np.ndarray, steps: dict, mask: np.ndarray | None = None) -> np.ndarray:
    """Each label eroded by its own number of steps; masked-out voxels count as the label that is eroded, and beyond the edge it goes on."""
    keep = np.zeros(labels.shape, bool)
    free = np.zeros(labels.shape, bool) if mask is None else mask == 0
    for l in np.unique(labels):
        if l == 0:
            continue
        m = (labels == l) | free
        for _ in range(steps.get(int(l), 0)):
            inner = m.copy()
            for p in _around(m, True):
                inner &= p
            m = inner
        keep |= m
    return np.where(keep, labels, 0)
