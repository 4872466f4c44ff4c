"""Near duplicates of vectors by an epsilon grid order join.

A cosine of at least ``COSINE`` between vectors is a distance of at most ``EPS = sqrt(2 - 2 COSINE)`` between
their directions. Directions are turned into the basis of their principal dimensions (found from sums over
all rows); the leading ``DIMS`` of them are cut into cells of side EPS, and vectors are sorted by cells, then
within them. The sequence is cut into intervals of at most ``PIECE`` vectors with their bounding boxes over all
dimensions. Intervals are joined recursively: a tree over the sequence is descended in pairs, and a pair whose
boxes are more than EPS apart is dropped with all below it. Intervals that are left are dealt by pairs of
blocks of ``GROUP`` neighbours, so an interval is sent once for each block with a partner in it, not once for
each partner; inside a task pairs are halved in the same way down to ``LEAF`` vectors. A turn of the basis
keeps distances and boxes only widen, so no link is lost, whatever the basis.

Equal vectors are one node with a multiplicity before the join; they are equal by value, not by hash. A task
emits a sum for each vector and a spanning forest of the links that it saw, never the links.

Vectors that are null, zero or hold null or non-finite components are linked with nothing. Vectors of fewer
components count as filled with zeros. Rows that repeat a vec_id are vectors of their own that share an id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.kernels import flat_components
from ..operators.keyjoin import join_counted
from ..plans.lineage import cut, release
from .arrowconf import bound_batches

COSINE = 0.9
EPS = float(np.sqrt(2 - 2 * COSINE)) + 1e-9
DIMS, PIECE, GROUP, LEAF, FAN = 8, 1024, 16, 512, 8
#: Pairs whose single-precision cosine is this close to the bound or above are computed in double precision.
SLACK = 1e-4


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) in double precision, filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, size = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    if (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim))
    out[np.repeat(np.arange(len(size)), size), np.concatenate([np.arange(s) for s in size]).astype(int)] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _moments(dim):
    """(i, j, v): sums of products of directions, per task."""

    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                u = _unit(_vectors(batch.column(0), dim))
                total += u.T @ u
        i, j = np.triu_indices(dim)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    return run


def _projected(dim, basis, kind):
    """(node, m, vec, y) with the coordinates along the principal dimensions."""

    def run(batches):
        for batch in batches:
            x = _vectors(batch.column(2), dim)
            y = _unit(x) @ basis if len(x) else np.empty((0, dim))
            raw = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(y.ravel()))
            yield pa.record_batch([batch.column(0), batch.column(1), raw, flat], ["node", "m", "vec", "y"])

    return run


def _pieces(size):
    """(at, nodes, ms, vecs, lo, hi): runs of at most ``size`` vectors of a sorted partition, ``at`` their place among its runs."""
    names = ["at", "nodes", "ms", "vecs", "lo", "hi"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]

    def piece(at, rows):
        t = pa.Table.from_batches(rows)
        y = t["y"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        cols = [[at], [t["node"].to_numpy().tobytes()], [t["m"].to_numpy().tobytes()], [b"".join(t["vec"].to_pylist())], [y.min(0).tolist()], [y.max(0).tolist()]]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    def run(batches):
        held, n, at = [], 0, 0
        for batch in batches:
            while batch.num_rows:
                take = min(batch.num_rows, size - n)
                held.append(batch.slice(0, take))
                batch, n = batch.slice(take), n + take
                if n == size:
                    yield piece(at, held)
                    held, n, at = [], 0, at + 1
        if held:
            yield piece(at, held)

    return run


class _Side:
    """Vectors of a block, in sequence order, with the box of any part of it."""

    def __init__(self, nodes, ms, x, basis):
        self.nodes, self.ms, self.x = nodes, ms, x
        u = _unit(x)
        self.f = u.astype(np.float32)
        self.y, self.boxes = u @ basis, {}

    def box(self, a, b):
        if (a, b) not in self.boxes:
            self.boxes[a, b] = self.y[a:b].min(0), self.y[a:b].max(0)
        return self.boxes[a, b]

    def apart(self, a, b, other, c, d) -> bool:
        (plo, phi), (qlo, qhi) = self.box(a, b), other.box(c, d)
        return float((np.maximum(0, np.maximum(plo - qhi, qlo - phi)) ** 2).sum()) > EPS * EPS


def _links(s: _Side, a: int, b: int, t: _Side, c: int, d: int):
    """(i, j) of the linked vectors of two parts."""
    near = s.f[a:b] @ t.f[c:d].T
    i, j = np.nonzero(near >= COSINE - SLACK)
    i, j = i + a, j + c
    if s is t:
        i, j = i[i < j], j[i < j]
    sure = []
    for k in range(0, len(i), 4096):
        p, q = s.x[i[k : k + 4096]], t.x[j[k : k + 4096]]
        sp, sq = np.abs(p).max(1), np.abs(q).max(1)
        p, q = p / sp[:, None], q / sq[:, None]
        sure.append(np.einsum("ij,ij->i", p, q) / np.sqrt(np.einsum("ij,ij->i", p, p) * np.einsum("ij,ij->i", q, q)) >= COSINE)
    keep = np.concatenate(sure) if sure else np.zeros(0, bool)
    return i[keep], j[keep]


def _forest(n: int, edges: list) -> list:
    """The edges (i, j) of n vectors as stars around the least vector of each part."""
    i, j = (np.concatenate(x) for x in zip(*edges))
    root = flat_components(n, i, j)
    far = np.flatnonzero(root != np.arange(n))
    return [(far, root[far])]


def _joined(dim, basis, kind):
    """(kind, a, b): kind 0 adds b links to vector a, kind 1 is an edge; of rows (p, q, block, no, nodes, ms, vecs) sorted by (p, q), the pair of blocks."""

    def pair(rows):
        t = pa.Table.from_batches(rows)
        p, q = t["p"][0].as_py(), t["q"][0].as_py()
        block, no = t["block"].to_numpy(), t["no"].to_numpy()
        sides = []
        for one in [p] if p == q else [p, q]:
            own = np.flatnonzero(block == one)
            own = own[np.argsort(no[own])]
            join = lambda c, own=own: b"".join(t[c][int(k)].as_py() for k in own)
            x = np.frombuffer(join("vecs"), kind).reshape(-1, dim).astype(np.float64)
            sides.append(_Side(np.frombuffer(join("nodes"), np.int64), np.frombuffer(join("ms"), np.int64), x, basis))
        s, o = sides[0], sides[-1]
        shift = 0 if s is o else len(s.nodes)
        n = shift + len(o.nodes)
        count, stars = np.zeros(n, np.int64), []
        todo = [(0, len(s.nodes), 0, len(o.nodes))]
        while todo:
            a, b, c, d = todo.pop()
            if s is o and (a, b) == (c, d):
                if b - a > LEAF:
                    m = (a + b) // 2
                    todo += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
                    continue
            elif s.apart(a, b, o, c, d):
                continue
            elif max(b - a, d - c) > LEAF:
                if b - a >= d - c:
                    m = (a + b) // 2
                    todo += [(a, m, c, d), (m, b, c, d)]
                else:
                    m = (c + d) // 2
                    todo += [(a, b, c, m), (a, b, m, d)]
                continue
            i, j = _links(s, a, b, o, c, d)
            if len(i):
                np.add.at(count, i, o.ms[j])
                np.add.at(count, j + shift, s.ms[i])
                stars.append((i, j + shift))
                if sum(len(x) for x, _ in stars) > 1 << 20:
                    stars = _forest(n, stars)
        nodes = s.nodes if s is o else np.concatenate([s.nodes, o.nodes])
        some = np.flatnonzero(count)
        (u, v), = _forest(n, stars) if stars else [(some[:0], some[:0])]
        what = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(u), np.int32)])
        return pa.record_batch([pa.array(what), pa.array(np.concatenate([nodes[some], nodes[u]])), pa.array(np.concatenate([count[some], nodes[v]]))], ["kind", "a", "b"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            key = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            lo = 0
            for k in range(1, len(key) + 1):
                if k == len(key) or key[k] != key[lo]:
                    if held and key[lo] != now:
                        yield pair(held)
                        held = []
                    now = key[lo]
                    held.append(batch.slice(lo, k - lo))
                    lo = k
        if held:
            yield pair(held)

    return run


def _near_pairs(meta: DataFrame, n: int, dim: int) -> DataFrame:
    """(p, q), p <= q: intervals whose boxes are within EPS, found down a tree over the sequence with ``FAN`` children a node."""
    height, top = 0, max(1, n)
    while top > 1:
        top, height = -(-top // FAN), height + 1
    gap = F.transform(F.arrays_zip("plo", "phi", "qlo", "qhi"), lambda d: F.greatest(d["plo"] - d["qhi"], d["qlo"] - d["phi"], F.lit(0.0)))
    near = F.aggregate(gap, F.lit(0.0), lambda total, g: total + g * g) <= EPS * EPS
    pairs = None
    for level in range(height, -1, -1):
        bounds = [F.array(*[f(F.col(c)[k]) for k in range(dim)]).alias(c) for c, f in (("lo", F.min), ("hi", F.max))]
        node = meta.groupBy(F.floor(F.col("no") / F.lit(FAN**level)).alias("node")).agg(*bounds) if level else meta.select(F.col("no").alias("node"), "lo", "hi")
        if pairs is None:
            pairs = cut(node.select(F.col("node").alias("p"), F.col("node").alias("q")))
            continue
        left = node.select((F.floor(F.col("node") / FAN)).alias("p"), F.col("node").alias("pn"), F.col("lo").alias("plo"), F.col("hi").alias("phi"))
        right = node.select((F.floor(F.col("node") / FAN)).alias("q"), F.col("node").alias("qn"), F.col("lo").alias("qlo"), F.col("hi").alias("qhi"))
        before, pairs = pairs, cut(pairs.join(left, "p").join(right, "q").where("pn <= qn").where(near).select(F.col("pn").alias("p"), F.col("qn").alias("q")))
        release(before)
    return pairs


def _digests(e):
    """Two hashes of a vector with seeds of their own."""
    return F.xxhash64(e).alias("h1"), F.xxhash64(F.lit(7), e).alias("h2")


def near_vectors(rows: DataFrame, piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """One row per row of ``rows`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    n_links counts the other rows with a vector that is linked directly. Other columns are not read. Rows whose
    vec_id is null are linked with nothing.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    element = rows.schema["embedding"].dataType.elementType.typeName()
    kind = np.float32 if element == "float" else np.float64
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    fine = F.col("vec_id").isNotNull() & F.coalesce(F.forall("e", finite) & F.exists("e", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("fine", fine)
    hashed = rows.where("fine").select("vec_id", *_digests(F.transform("e", lambda v: v + F.lit(0.0))), F.transform("e", lambda v: v + F.lit(0.0)).alias("e"))
    distinct = hashed.groupBy("h1", "h2", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")).withColumn("node", F.monotonically_increasing_id())
    distinct = cut(distinct)
    dim, n_nodes, n_rows = distinct.agg(F.max(F.size("e")), F.count("*"), F.sum("m")).first()
    if dim is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sums = distinct.select("e").mapInArrow(_moments(dim), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    cov = np.zeros((dim, dim))
    cov[sums["i"], sums["j"]] = cov[sums["j"], sums["i"]] = sums["v"]
    basis = np.linalg.eigh(cov)[1][:, ::-1]
    lead = range(min(DIMS, dim))
    placed = distinct.select("node", "m", "e").mapInArrow(_projected(dim, basis, kind), "node long, m long, vec binary, y array<double>")
    order = [f"c{k}" for k in lead] + ["y0", "node"]
    placed = placed.select("*", *[F.floor(F.col("y")[k] / EPS).alias(f"c{k}") for k in lead], F.col("y")[0].alias("y0"))
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("node", "m", "vec", "y")
    pieces = ordered.mapInArrow(_pieces(piece), "at long, nodes binary, ms binary, vecs binary, lo array<double>, hi array<double>")
    held = cut(pieces.withColumn("part", F.spark_partition_id()))
    # places in the whole sequence: one number for each partition
    offsets, total = [], 0
    for part, n in sorted(map(tuple, held.groupBy("part").agg(F.count("*").alias("n")).collect())):
        offsets.append((part, total))
        total += n
    pieces = held.join(F.broadcast(spark.createDataFrame(offsets, "part int, base long")), "part").withColumn("no", F.col("base") + F.col("at"))
    meta = cut(pieces.select("no", "lo", "hi"))
    pairs = _near_pairs(meta, total, dim)
    block = lambda c: F.floor(F.col(c) / F.lit(group))
    sent = pairs.select(block("p").alias("p"), block("q").alias("q"), F.explode(F.array("p", "q")).alias("no")).distinct()
    dealt = sent.join(pieces.select("no", "nodes", "ms", "vecs"), "no").select("p", "q", block("no").alias("block"), "no", "nodes", "ms", "vecs")
    dealt = dealt.repartition("p", "q").sortWithinPartitions("p", "q")
    found = cut(dealt.mapInArrow(_joined(dim, basis, kind), "kind int, a long, b long"))
    release(held, meta, pairs)
    links = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    comps = connected_components(found.where("kind = 1"), "a", "b").select("node", F.col("component").alias("comp"))
    per = distinct.select("node", "h1", "h2", "e", "rep", "m").join(links, "node", "left").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = per.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count("*").alias("size"))
    per = join_counted(per, least, ["comp"], n_nodes, "size").withColumn("n_links", F.col("m") - 1 + F.coalesce("others", F.lit(0)))
    # vectors are told apart by their digests as long as these differ, else by value
    key = ["h1", "h2"] if distinct.groupBy("h1", "h2").count().where("count > 1").isEmpty() else ["h1", "h2", "e"]
    done = join_counted(hashed.select("vec_id", *key), per.select(*key, "m", "n_links", "component_id"), key, n_rows).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
