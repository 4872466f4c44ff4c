"""Graph operators whose parts may hold the whole graph: no task gathers one, and the results are the kernels'."""

import numpy as np
import pandas as pd
import pytest

from voxelspark.operators import evaluate, graphs, kernels


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _cut_case(seed, free_links):
    """fragments, edges, sites: two segments; fragments from 100 on are touched by no skeleton."""
    rng = np.random.default_rng(seed)
    fragments = [(int(f), int(f) % 2) for f in [*range(1, 15), *range(100, 130)]]
    sites = [(int(rng.integers(0, 4)), f) for f, _ in fragments if f < 100] + [(1, 3), (2, 3)]
    names = [f for f, _ in fragments]
    edges = []
    for _ in range(150):
        u, v = (int(x) for x in rng.choice(names, 2))
        if not free_links and min(u, v) >= 100:
            continue
        edges.append((u, v, None if rng.random() < 0.1 else round(float(rng.random()), 2)))
    return fragments, edges, sites


def _by_kernel(fragments, edges, sites):
    seg, out = dict(fragments), {}
    for s in (0, 1):
        rows = [(u, v, 1.0 if w is None else w, None) for u, v, w in edges if seg[u] == seg[v] == s and u != v]
        rows += [(f, None, None, k) for k, f in sites if seg[f] == s]
        out[s] = kernels.multiway_cut(pd.DataFrame(rows, columns=["u", "v", "score", "skel"]))
    return out


@pytest.mark.parametrize("seed, free_links", [(0, False), (1, False), (2, True), (3, True)])
def test_cuts_by_islands_are_those_of_whole_segments(spark, monkeypatch, seed, free_links):
    fragments, edges, sites = _cut_case(seed, free_links)
    f, e, s = _frame(spark, fragments, "fragment long, segment long"), _frame(spark, edges, "u long, v long, score double"), _frame(spark, sites, "skel long, fragment long")
    if not free_links:  # islands of one fragment need no kernel, however many a segment has
        monkeypatch.setattr(type(f.groupBy()), "applyInPandas", lambda *_: pytest.fail("a segment is gathered in one task"))
    got = {r["segment"]: (r["splits"], r["extra_merges"]) for r in evaluate.min_cut_edits(f, e, s).collect()}
    assert got == _by_kernel(fragments, edges, sites)


def _mutex_by_hand(nodes, edges):
    cluster, apart = {x: {x} for x in nodes}, set()
    for u, v, w in sorted((e for e in edges if e[2]), key=lambda e: (-abs(e[2]), e[0], e[1])):
        a, b = cluster[u], cluster[v]
        if a is b or any((x, y) in apart for x in a for y in b):
            continue
        if w < 0:
            apart |= {(u, v), (v, u)}
            continue
        a |= b
        cluster |= dict.fromkeys(b, a)
    return {x: min(c) for x, c in cluster.items()}


def _signed(seed, n, m):
    rng = np.random.default_rng(seed)
    ends = {tuple(sorted(int(x) for x in rng.choice(n, 2, replace=False))) for _ in range(m)}
    return [(u, v, float(rng.integers(-6, 7)) / 8) for u, v in sorted(ends)]


def test_mutex_partition_reads_parts_as_streams(spark, monkeypatch):
    edges = [(u + 1000 * part, v + 1000 * part, w) for part in range(5) for u, v, w in _signed(part, 30, 120)]
    edges += [(7000, 7001, None), (7001, 7002, 0.0), (7003, 2, -0.5), (2, 1003, -0.9)]  # no score is no edge
    nodes = sorted({x for e in edges for x in e[:2]})
    e, n = _frame(spark, edges, "u long, v long, score double"), _frame(spark, [(x,) for x in nodes], "id long")
    monkeypatch.setattr(type(n.groupBy()), "applyInPandas", lambda *_: pytest.fail("a part's edges are gathered in one frame"))
    assert {r["fragment"]: r["segment"] for r in graphs.mutex_partition(n, e).collect()} == _mutex_by_hand(nodes, edges)


@pytest.mark.parametrize("short, long, known", [(48, 1024, 1 << 20), (1, 4, 3)])
def test_mutex_sets_however_long_the_lists(monkeypatch, short, long, known):
    for name, value in (("SHORT", short), ("LONG", long), ("KNOWN", known)):
        monkeypatch.setattr(kernels.MutexSets, name, value)
    for seed in range(20):
        edges = _signed(seed, 40, 300)
        u, v, w = (np.array(x) for x in zip(*edges))
        want = _mutex_by_hand(range(40), edges)
        assert kernels.mutex_watershed(40, u, v, w).tolist() == [want[x] for x in range(40)]
