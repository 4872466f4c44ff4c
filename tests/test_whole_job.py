"""Whole inputs: results by brute force on the smallest tables, with no row left out."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelspark.operators import blocks, kernels, segment
from voxelspark.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def _graph():
    """(u, v) -> score of all rows of lineitem, and all nodes."""
    li = pd.read_parquet(f"{FOLDER}/lineitem.parquet")
    li = li.astype({"l_tax": float, "l_discount": float})
    g = li.groupby(["l_suppkey", "l_partkey"]).agg(tax=("l_tax", "max"), score=("l_discount", "mean"), n=("l_tax", "size"))
    edges = {(int(s), int(p) + 1000000): round(r.score, 6) if r.tax < 0.08 - 1e-9 else None for (s, p), r in zip(g.index, g.itertuples())}
    return edges, {x for e in edges for x in e}


def _parts(nodes, links):
    at = {x: x for x in nodes}
    while True:
        low = dict(at)
        for u, v in links:
            low[u] = low[v] = min(low[u], low[v])
        if low == at:
            return at
        at = low


def _least(lut):
    """Each node's cluster named by its least node."""
    first = {}
    for f, s in lut.items():
        first[s] = min(first.get(s, f), f)
    return {f: first[s] for f, s in lut.items()}


def test_graph_queries_take_all_rows(spark):
    edges, nodes = _graph()
    run = lambda name: [tuple(r) for r in catalog.QUERIES[name](spark, FOLDER).collect()]
    upto = lambda t: [e for e, s in edges.items() if s is not None and s <= t]
    assert dict(run("connected_components")) == _parts(nodes, edges)
    assert dict(run("components_at_threshold")) == _parts(nodes, upto(0.03))
    sweep = {(t, f): s for t, f, s in run("threshold_sweep")}
    assert sweep == {(t, f): s for t in (0.02, 0.03, 0.05) for f, s in _parts(nodes, upto(t)).items()}
    assert {(u, v): s for u, v, s in run("graph_store")} == {e: edges[e] for e in upto(0.04)}
    assert len(run("best_threshold")) == 2
    li = pd.read_parquet(f"{FOLDER}/lineitem.parquet")
    first = li.groupby("l_partkey")["l_suppkey"].min()
    kept = {int(p) + 1000000 for p, s in first.items() if s == 7} | ({7} & set(first))
    assert {(u, v): s for u, v, s in run("segment_edges")} == {e: s for e, s in edges.items() if set(e) <= kept}


def test_mutex_graph_takes_all_rows(spark):
    edges, nodes = _graph()
    cluster, apart = {x: {x} for x in nodes}, set()
    signed = [(round(0.05 - (0.05 if s is None else s), 12), u, v) for (u, v), s in edges.items()]
    for w, u, v in sorted(signed, key=lambda r: (-abs(r[0]), r[1], r[2])):
        a, b = cluster[u], cluster[v]
        if a is b or w == 0 or any((x, y) in apart for x in a for y in b):
            continue
        if w < 0:
            apart |= {(x, y) for x, y in ((u, v), (v, u))}
            continue
        a |= b
        for x in b:
            cluster[x] = a
    got = dict(tuple(r) for r in catalog.QUERIES["mutex_graph"](spark, FOLDER).collect())
    assert set(got) == nodes
    # equal weights differ in their last bits, so the order of ties, and with it the clusters, is compared on exact ones
    ids = {x: k for k, x in enumerate(sorted(nodes))}
    s = np.array([[ids[u], ids[v]] for _, u, v in signed])
    lab = kernels.mutex_watershed(len(ids), s[:, 0], s[:, 1], np.array([w for w, _, _ in signed]))
    want = {x: min(c) for x, c in cluster.items()}
    assert _least({x: int(lab[k]) for x, k in ids.items()}) == want


def test_edits_needed_takes_all_rows(spark):
    edges, nodes = _graph()
    r = catalog.QUERIES["edits_needed"](spark, FOLDER).first()
    lut = _parts(nodes, [e for e, s in edges.items() if s is not None and s <= 0.03])
    suppliers = {u for u, _ in edges}
    assert r["skeletons"] == len({u % 7 for u in suppliers}) and r["segments"] == len({lut[u] for u in suppliers})


def test_minimum_cut_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = 7
        cap = {}
        for a in range(n):
            for b in range(a + 1, n):
                if rng.random() < 0.5:
                    w = float(rng.integers(1, 9))
                    cap.setdefault(a, {})[b] = w
                    cap.setdefault(b, {})[a] = w
        best = None
        for bits in range(1 << n):
            side = {k for k in range(n) if bits >> k & 1}
            if {0, 1} <= side and not side & {5, 6}:
                cost = sum(w for a in side for b, w in cap.get(a, {}).items() if b not in side)
                if best is None or (cost, len(side)) < best[:2]:
                    best = (cost, len(side), side)
        assert kernels._source_side(cap, {0, 1}, {5, 6}) == best[2]


@pytest.mark.parametrize("name", ["segment_mws", "segment_ws_seed_decay", "training_sample_3d"])
def test_block_queries_take_all_sections(spark, name):
    z = pd.to_datetime(pd.read_parquet(f"{FOLDER}/lineitem.parquet")["l_shipdate"])
    z = (z.dt.year - 1995) * 12 + z.dt.month - 1
    got = {r[0] for r in catalog.QUERIES[name](spark, FOLDER).select("z").distinct().collect()}
    # sections without a segment beyond the debris are few; none are cut off
    assert got <= set(z) and len(got) > 0.8 * z.nunique() and max(got) >= z.max() - 1


def _join_scores(edges, value):
    """Scores at which ends of edges (u, v, values) first join, by merging the cheapest pair of clusters again and again."""
    at, out = {x: x for u, v, _ in edges for x in (u, v)}, {}
    while True:
        between = {}
        for u, v, x in edges:
            a, b = sorted((at[u], at[v]))
            if a != b:
                between.setdefault((a, b), []).extend(x)
        best = min(((1 - value(x), a, b) for (a, b), x in between.items()), default=None)
        if best is None or best[0] > 1:
            return out
        s, a, b = best
        for u, v, _ in edges:
            if {at[u], at[v]} == {a, b}:
                out[u, v] = s
        at = {x: a if c == b else c for x, c in at.items()}


def _scattered(spark):
    """Scattered fragments with affinities, and their boundaries (u, v, values)."""
    rng = np.random.default_rng(8)
    frag = rng.integers(1, 9, (2, 5, 6))
    rows = [(z, y, x, int(frag[z, y, x]), *map(float, rng.integers(1, 1000, 3) / 1000)) for z, y, x in np.ndindex(*frag.shape)]
    df = spark.createDataFrame(rows, "z long, y long, x long, fragment long, az double, ay double, ax double")
    edges, aff = {}, {r[:3]: r[4:] for r in rows}
    for z, y, x in aff:
        for k in range(3):
            n = tuple(c - (k == a) for a, c in enumerate((z, y, x)))
            if n in aff and frag[n] != frag[z, y, x]:
                edges.setdefault(tuple(sorted((int(frag[n]), int(frag[z, y, x])))), []).append(aff[z, y, x][k])
    return df, [(*e, x) for e, x in edges.items()]


@pytest.mark.parametrize("name,value", [("mean", np.mean), ("hist_quant_75", lambda x: np.quantile(x, 0.75))])
def test_edges_are_scored_by_merging(spark, name, value):
    df, edges = _scattered(spark)
    want = _join_scores(edges, value)
    plain = {(u, v): 1 - value(x) for u, v, x in edges}
    affs = ["az", "ay", "ax"]
    _, got = segment.scored_graph(df.select("z", "y", "x", "fragment"), df.drop("fragment"), affs, name, (2, 5, 6), (0, 0, 0))
    got = {(r["u"], r["v"]): r["score"] for r in got.collect()}
    assert set(got) == set(plain) and all(abs(got[e] - want[e]) < 1e-9 for e in want)
    assert any(abs(got[e] - plain[e]) > 1e-6 for e in plain)


def test_blocks_score_every_edge_once(spark):
    df, edges = _scattered(spark)
    f = df.select("z", "y", "x", (F.col("fragment") + 8 * F.floor(F.col("x") / 3)).alias("fragment"))
    affs = ["az", "ay", "ax"]
    _, got = segment.scored_graph(f, df.drop("fragment"), affs, "mean", (2, 5, 3), (0, 0, 0))
    rows = [(r["u"], r["v"]) for r in got.collect()]
    seen = {}
    for r in f.collect():
        seen[r["z"], r["y"], r["x"]] = r["fragment"]
    want = {tuple(sorted((a, seen[n]))) for p, a in seen.items() for k in range(3) if (n := tuple(c - (k == i) for i, c in enumerate(p))) in seen and seen[n] != a}
    assert len(rows) == len(set(rows)) and set(rows) == want
    lut = dict(tuple(r) for r in segment.merge_within_blocks(f, df.drop("fragment"), affs, 0.4, (2, 5, 3)).collect())
    assert lut and all((a > 8) == (b > 8) for a, b in lut.items())


@pytest.mark.parametrize("per_section", [True, False])
def test_distances_have_no_cap(spark, per_section):
    mask = np.ones((3, 20, 21), bool)
    mask[0, 0, 0] = mask[1, 19, 3] = mask[1, 4, 4] = mask[2, 2, 20] = False
    off = np.argwhere(~mask)
    df = spark.createDataFrame([(*map(int, p), 1) for p in np.argwhere(mask)], "z long, y long, x long, m long")
    got = blocks.distance_transform(df, "m", mask.shape, per_section, (2, 8, 8)).collect()
    assert len(got) == mask.sum() and max(r["value"] for r in got) > 15
    for r in got:
        p = np.array([r["z"], r["y"], r["x"]])
        near = off[off[:, 0] == r["z"]] if per_section else off
        assert abs(r["value"] - np.sqrt(((near - p) ** 2).sum(1).min())) < 1e-9
