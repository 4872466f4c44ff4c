import itertools

import numpy as np
import pandas as pd

from voxelspark.operators import kernels as k

rng = np.random.default_rng(1)


def test_edt():
    m = rng.random((5, 7, 6)) < 0.7
    m[0, 0, 0] = False
    off = np.argwhere(~m)
    want = np.array([np.sqrt(((off - p) ** 2).sum(1).min()) for p in np.argwhere(np.ones_like(m))]).reshape(m.shape)
    got, at = k.edt(m, nearest=True)
    assert np.allclose(got, want)
    assert np.allclose(np.linalg.norm(np.argwhere(np.ones_like(m)) - np.array(np.unravel_index(at.ravel(), m.shape)).T, axis=1), want.ravel())


def _flood(labels):
    seen, out, n = set(), np.zeros(labels.shape, int), 0
    for p in itertools.product(*map(range, labels.shape)):
        if labels[p] == 0 or p in seen:
            continue
        n += 1
        todo = [p]
        while todo:
            q = todo.pop()
            if q in seen:
                continue
            seen.add(q)
            out[q] = n
            for a in range(labels.ndim):
                for d in (-1, 1):
                    r = tuple(x + d * (i == a) for i, x in enumerate(q))
                    if all(0 <= x < s for x, s in zip(r, labels.shape)) and labels[r] == labels[p]:
                        todo.append(r)
    return out, n


def test_components():
    lab = rng.integers(0, 3, (4, 6, 6))
    got, n = k.components(lab)
    want, m = _flood(lab)
    assert n == m and (got == want).all()


def test_affinity_flood():
    hard = np.zeros((3, 1, 1, 4), bool)
    hard[2, 0, 0] = [True, False, True, True]
    assert k.affinity_flood(hard).tolist() == [[[1, 0, 2, 2]]]


def test_watershed_two_basins():
    mask = np.ones((1, 3, 9), bool)
    mask[:, :, 4] = False
    mask[0, 1, 4] = True
    lab = k.basins(mask[0], 3)
    assert lab.max() >= 2 and (lab[mask[0]] > 0).all() and lab[1, 1] != lab[1, 7]


def test_morphology():
    a = np.zeros((9, 9), int)
    a[3:6, 3:6] = 7
    assert k.erode(a).sum() == 7 and k.dilate(a).astype(bool).sum() == 21
    assert (k.opening(a) != 0).sum() == 5 and (k.closing(a) == a).all()
    b = np.array([[1, 0, 2]])
    assert k.dilate(b).tolist() == [[1, 1, 2]]
    ring = a.copy()
    ring[4, 4] = 0
    assert (k.fill_holes(ring) == a).all() and (k.fill_holes(np.zeros((3, 3), int)) == 0).all()


def test_gaussian_and_box():
    a = rng.random((6, 6))
    g = k.gaussian(a, 1.0)
    assert abs(g.mean() - a.mean()) < 0.05 and g.std() < a.std()
    assert np.allclose(k.gaussian(np.full((4, 5), 2.0), 1.5), 2)
    want = np.array([[a[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].max() for x in range(6)] for y in range(6)])
    assert np.allclose(k.box_max(a, 3), want)


def test_mutex_watershed():
    # 0-1 strong attraction, 1-2 weaker attraction, 0-2 stronger repulsion
    assert k.mutex_watershed(3, np.array([0, 1, 0]), np.array([1, 2, 2]), np.array([0.9, 0.3, -0.5])).tolist() == [0, 0, 2]
    assert k.mutex_watershed(3, np.array([0, 1, 0]), np.array([1, 2, 2]), np.array([0.9, 0.6, -0.5])).tolist() == [0, 0, 0]
    affs = np.full((3, 1, 1, 4), 0.1)
    affs[2, 0, 0] = [0.0, 0.9, 0.1, 0.9]
    lab = k.affinity_mutex_watershed(affs, [(-1, 0, 0), (0, -1, 0), (0, 0, -1)], [-0.5] * 3)
    assert lab.tolist() == [[[1, 1, 2, 2]]] or len(set(lab.ravel().tolist())) == 2


def test_agglomerate():
    rows = k.agglomerate([1, 2, 1], [2, 3, 3], [10, 10, 10], [9, 5, 1])
    assert [(a, b, c, round(s, 3)) for _, a, b, c, s in rows] == [(1, 2, 1, 0.1), (1, 3, 1, 0.7)]
    assert len(k.agglomerate([1, 2], [2, 3], [1, 1], [0.9, 0.1], stop=0.5)) == 1


def test_multiway_cut():
    e = pd.DataFrame({"u": [1, 2, 3, 1, 4], "v": [2, 3, 4, None, None], "score": [0.1, 0.8, 0.1, None, None], "skel": [None, None, None, 10, 20]})
    assert k.multiway_cut(e) == (1, 0)
    assert k.multiway_cut(e[e["skel"] != 20]) == (0, 0)


def test_clahe_changes_and_keeps_range():
    a = rng.integers(0, 256, (10, 10)).astype(float)
    b = k.clahe(a)
    assert b.shape == a.shape and not np.allclose(a, b) and b.min() >= a.min() and b.max() <= a.max() + 1e-9
    assert (k.clahe(np.full((4, 4), 3.0)) == 3).all()


def test_descriptors():
    lab = np.zeros((3, 9, 9), int)
    lab[:, 2:7, 2:7] = 4
    d = k.local_shape_descriptors(lab, 1.0)
    assert d.shape == (10, 3, 9, 9) and 0 <= d.min() and d.max() <= 1 and (d[:, lab == 0] == 0).all()
    assert abs(d[1, 1, 4, 4] - 0.5) < 1e-6
    assert k.local_shape_descriptors(lab[0], 1.0).shape == (6, 9, 9)


def test_grow_random():
    a = np.ones((1, 3), int)
    a[0, 2] = 2
    assert k.grow_random(a, {1: 1}).tolist() == [[1, 0, 2]]
    assert k.grow_random(a, {1: 1, 2: 1}, np.array([[1, 1, 0]])).tolist() == [[1, 1, 2]]
