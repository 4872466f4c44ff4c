"""Near duplicates by a multi-index Hamming join over b-bit MinHash signatures.

A document's set holds its distinct 5-word shingles (words are cut at white space, A-Z lowered; fewer words:
the whole sequence is one shingle; no words: the empty set, linked with nothing). A signature has ``SYMBOLS``
minima of ``BITS`` bits. It is split into ``SYMBOLS / WIDTH`` chunks. Two signatures that differ in at most
``MEET = chunks * (ERRORS + 1) - 1`` symbols have, by the pigeonhole principle, a chunk with at most
``ERRORS`` = 1 differing symbol; the join key of a chunk with one symbol left out enumerates these errors, so
every pair within that distance meets under some key. A pair at similarity 0.75 fails to meet with
probability 1e-7. Pairs that meet are confirmed on the full sets if they differ in at most ``MAX_DISTANCE``
symbols, which a pair at 0.75 exceeds with probability 1e-8; the full sets decide.

Documents with equal sets are one node, known by set size and 128 bits of the set. No group's pairs are
enumerated as a rule. Under a key, members are compared with the key's hub, the least of them in a fixed random
order, so the members of a group mostly agree on one hub; links are confirmed on the full sets, and what is
already connected is not compared again. Only pairs under a key that are still in different components go on,
first to another hub (the least in another order), in the end all of them, in squares of bounded size. There a
pair is looked at under its first common key only and goes on to the full sets only if an upper bound of the
intersection allows a link. So a hot key costs rows in proportion to its members, and no link between
components is lost. Rows of a hot key or a hot group of copies are dealt at random (``keyjoin``).

Rows whose doc_id is null are linked with nothing. Rows that repeat a doc_id are documents of their own that
happen to share an id: repeated rows cost no more than copies, and a component is named by its least id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.keyjoin import join_counted
from ..plans.lineage import cut, release
from . import textblocks as tb
from .arrowconf import bound_batches

SHINGLE, PERCENT = 5, 75
SYMBOLS, WIDTH, ERRORS, BITS = 48, 4, 1, 14
CHUNKS = SYMBOLS // WIDTH
MEET = CHUNKS * (ERRORS + 1) - 1
MAX_DISTANCE = 30
#: Rounds of hubs, each by another random order.
HUB_ROUNDS = 2
SQUARE = 512
#: Sets of at most so many shingles are also held as 16-bit values, which bound an intersection from above.
SMALL = 2048

_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 32, SYMBOLS, np.uint32)
_MUL = _rng.integers(0, 1 << 32, SYMBOLS, np.uint32) | np.uint32(1)
#: A chunk is a long of ``WIDTH`` lanes, one bit wider than a symbol: adding _FULL to a lane carries into that bit unless it is 0.
_LANE = BITS + 1
_FULL = sum(((1 << BITS) - 1) << (_LANE * k) for k in range(WIDTH))
_CARRY = sum(1 << (_LANE * k + BITS) for k in range(WIDTH))
_SIG = [f"c{k}" for k in range(CHUNKS)]
_GROUP = ["n_shingles", "fp1", "fp2"]


def _fingerprint(u: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes, as two signed longs."""
    both = np.array([u.sum(dtype=np.uint64), np.bitwise_xor.reduce(tb.mix(u ^ np.uint64(0x5851F42D4C957F2D)), initial=np.uint64(0))], np.uint64)
    return tuple(both.view(np.int64).tolist())


def signature_rows(batches):
    """(doc_id, h, n_shingles, fp1, fp2, chunks of the signature) per (doc_id, h, text): set size, 128 bits of the set, the signature's symbols."""
    lanes = np.uint64(_LANE) * np.arange(WIDTH, dtype=np.uint64)
    for batch in batches:
        n_out, fps, sigs = [], [], []
        for i, j, block in tb.blocks(batch.column(2), tb.SPACED):
            h, first = tb.shingles(block, SHINGLE)
            sig = np.zeros((j - i, SYMBOLS), np.uint64)
            full = np.flatnonzero(np.diff(first))
            if len(full):
                x = (h >> np.uint64(32)).astype(np.uint32)
                for s in range(SYMBOLS):
                    low = np.minimum.reduceat((x ^ _XOR[s]) * _MUL[s], first[full])
                    low = (low ^ (low >> np.uint32(16))) * np.uint32(0x85EBCA6B)
                    sig[full, s] = low >> np.uint32(32 - BITS)
            for r in range(j - i):
                u = np.unique(h[first[r] : first[r + 1]])
                n_out.append(len(u))
                fps.append(_fingerprint(u))
            sigs.append((sig.reshape(j - i, CHUNKS, WIDTH) << lanes).sum(2, dtype=np.uint64))
        sig = np.concatenate(sigs).view(np.int64) if sigs else np.empty((0, CHUNKS), np.int64)
        fp = np.array(fps, np.int64).reshape(-1, 2)
        cols = [pa.array(n_out, pa.int64()), *map(pa.array, (fp[:, 0], fp[:, 1])), *(pa.array(sig[:, k]) for k in range(CHUNKS))]
        yield pa.record_batch([batch.column(0), batch.column(1), *cols], ["doc_id", "h", *_GROUP, *_SIG])


def symbols(chunks: np.ndarray) -> np.ndarray:
    """(rows, SYMBOLS) of (rows, CHUNKS) longs."""
    out = chunks[:, :, None] >> (_LANE * np.arange(WIDTH)) & ((1 << BITS) - 1)
    return out.reshape(len(chunks), SYMBOLS).astype(np.uint16)


def _confirm(batches):
    """(u, v) of the pairs (u, v, text of u, text of v), equal v mostly in a row, whose full sets are similar enough."""
    last: tuple = (None, None)
    for batch in batches:
        u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        keep = np.zeros(len(u), bool)
        hubs = batch.column(3)
        for i, j, block in tb.blocks(batch.column(2), tb.SPACED):
            h, first = tb.shingles(block, SHINGLE)
            for r in range(i, j):
                if last[0] != v[r]:
                    _, _, one = next(tb.blocks(hubs.slice(r, 1), tb.SPACED))
                    last = (v[r], np.unique(tb.shingles(one, SHINGLE)[0]))
                a, b = last[1], np.unique(h[first[r - i] : first[r - i + 1]])
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep[r] = 100 * both >= PERCENT * (len(a) + len(b) - both) and both > 0
        yield pa.record_batch([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])


def _sets(batches):
    """(node, small, text) of the rows (node, fp1, fp2, text) whose set is the node's; small holds the low 16 bits of its shingles, null for large sets."""
    for batch in batches:
        small, mine = [], []
        fp1, fp2 = (batch.column(k).to_pylist() for k in (1, 2))
        for i, j, block in tb.blocks(batch.column(3), tb.SPACED):
            h, first = tb.shingles(block, SHINGLE)
            for r in range(i, j):
                u = np.unique(h[first[r - i] : first[r - i + 1]])
                mine.append(_fingerprint(u) == (fp1[r], fp2[r]))
                small.append(u.astype(np.uint16).tobytes() if len(u) <= SMALL else None)
        out = pa.record_batch([batch.column(0), pa.array(small, pa.binary()), batch.column(3)], ["node", "small", "text"])
        yield out.filter(pa.array(mine, pa.bool_()))


class _Square:
    """Members of two blocks under a key: which pairs may be links."""

    def __init__(self, t: pa.Table):
        self.block, self.node, self.comp, self.n = (t[c].to_numpy() for c in ("block", "node", "comp", "n_shingles"))
        self.no, self.a, self.b = t["no"][0].as_py(), t["a"][0].as_py(), t["b"][0].as_py()
        self.sig = symbols(np.column_stack([t[c].to_numpy() for c in _SIG]))
        self.small = [None if x is None else np.frombuffer(x, np.uint16) for x in t["small"].to_pylist()]
        self.inside = np.zeros(1 << 16, bool)

    def _first(self, same: np.ndarray) -> np.ndarray:
        """Whether this key is the first one that the pairs share, so that each pair is looked at once."""
        chunk, left_out = divmod(self.no, WIDTH)
        wrong = WIDTH - same.reshape(*same.shape[:-1], CHUNKS, WIDTH).sum(-1)
        earlier = (wrong[..., :chunk] <= ERRORS).any(-1)
        # within the chunk: pairs that agree wholly meet under each of its keys, others under one
        return ~earlier & ((wrong[..., chunk] > 0) | (left_out == 0))

    def pairs(self) -> list[tuple[int, int]]:
        left, right = np.flatnonzero(self.block == self.a), np.flatnonzero(self.block == self.b)
        out = []
        for at in range(0, len(left), 64):
            l = left[at : at + 64]
            same = self.sig[l][:, None, :] == self.sig[right][None, :, :]
            small, large = np.minimum(self.n[l][:, None], self.n[right][None, :]), np.maximum(self.n[l][:, None], self.n[right][None, :])
            ok = (SYMBOLS - same.sum(-1) <= MAX_DISTANCE) & (self.comp[l][:, None] != self.comp[right][None, :]) & (100 * small >= PERCENT * large) & self._first(same)
            if self.a == self.b:
                ok &= self.node[l][:, None] < self.node[right][None, :]
            for x in np.flatnonzero(ok.any(1)).tolist():
                out += [(int(self.node[l[x]]), int(self.node[y])) for y in self._possible(int(l[x]), right[ok[x]])]
        return [(min(p), max(p)) for p in out]

    def _possible(self, x: int, ys: np.ndarray):
        """Those of ys whose intersection with x, bounded from above, is large enough."""
        if self.small[x] is None:
            return ys.tolist()
        self.inside[self.small[x]] = True
        good = []
        for y in ys.tolist():
            if (s := self.small[y]) is not None:
                most = int(self.inside[s].sum())
                if 100 * most < PERCENT * (int(self.n[x]) + int(self.n[y]) - most):
                    continue
            good.append(y)
        self.inside[self.small[x]] = False
        return good


def _near_in_squares(batches):
    """(u, v) that may be links between components, of rows that come sorted by (key, no, a, b).

    Columns: key, no (the key's number), a, b (the square), block (a or b), node, comp, n_shingles, small, chunks.
    """

    def pairs(rows):
        t = pa.Table.from_batches(rows)
        got = _Square(t).pairs() if t.num_rows > 1 else []
        return pa.record_batch([pa.array([p[0] for p in got], pa.int64()), pa.array([p[1] for p in got], pa.int64())], ["u", "v"]) if got else None

    now, held = None, []
    for batch in batches:
        keys = [batch.column(k).to_numpy() for k in range(4)]
        change = np.zeros(max(0, batch.num_rows - 1), bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            this = tuple(k[lo] for k in keys)
            if this != now and held:
                if (out := pairs(held)) is not None:
                    yield out
                held = []
            now = this
            held.append(batch.slice(lo, hi - lo))
    if held and (out := pairs(held)) is not None:
        yield out


def _keys():
    """The join keys of a signature: for each chunk and each symbol left out, a hash of the others."""
    out = []
    for c, chunk in enumerate(_SIG):
        for d in range(WIDTH):
            rest = F.col(chunk).bitwiseAND(F.lit(~(((1 << _LANE) - 1) << (_LANE * d))))
            out.append(F.xxhash64(F.lit(c * WIDTH + d), rest))
    return F.array(*out)


def _distance(a: str, b: str):
    """How many symbols differ, of columns prefixed by a and b."""
    one = lambda c: F.bit_count((F.col(a + c).bitwiseXOR(F.col(b + c)) + F.lit(_FULL)).bitwiseAND(F.lit(_CARRY)))
    return sum((one(c) for c in _SIG[1:]), one(_SIG[0]))


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (u, v), distinct; many may share a v. The links among them."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias("t" + c))
    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "tu", "tv").mapInArrow(_confirm, "u long, v long")


def _near_hub(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the pairs (u, v) those whose sizes and signatures allow a link, each once."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias("n" + c), *[F.col(s).alias(c + s) for s in _SIG])
    both = pairs.distinct().join(side("u"), "u").join(side("v"), "v").where(F.lit(100) * F.least("nu", "nv") >= F.lit(PERCENT) * F.greatest("nu", "nv"))
    return both.where(_distance("u", "v") <= MAX_DISTANCE).select("u", "v")


def _square_pairs(open_: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): all members of open keys that are in different components, where sizes, signatures and a bound of the intersection allow a link."""
    rows = open_.withColumn("parts", F.ceil(F.col("m") / F.lit(SQUARE)).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.join(nodes.select("node", "n_shingles", *_SIG), "node").join(texts.select("node", "small"), "node")
    rows = rows.select("key", "no", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "node", "comp", "n_shingles", "small", *_SIG)
    return rows.repartition("key", "no", "a", "b").sortWithinPartitions("key", "no", "a", "b").mapInArrow(_near_in_squares, "u long, v long").distinct()


def _merged(links: DataFrame, comps: DataFrame | None = None) -> DataFrame:
    """(node, comp) of the nodes that have a link; components known before count as stars of links, so nothing is looked up."""
    edges = links if comps is None else links.unionByName(comps.select(F.col("node").alias("u"), F.col("comp").alias("v")))
    return connected_components(edges).select("node", F.col("component").alias("comp"))


def _components(met: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, comp) of the nodes that have a link. met: (key, no, node, m, hub), the members of keys with more than one."""
    total = met.count()
    links = cut(_confirmed(_near_hub(met.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")), nodes), texts))
    comps = _merged(links)
    release(links)
    for step in range(1, HUB_ROUNDS + 1):
        last = step == HUB_ROUNDS
        open_ = met.select("key", "no", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        order = F.xxhash64(F.lit(step), "node")
        hub = [] if last else [F.min_by("node", order).alias("hub"), F.min_by("comp", order).alias("hubc")]
        state = open_.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), *hub)
        state = cut(state.where("lo < hi").drop("lo", "hi"))
        open_ = join_counted(open_, state, ["key"], total)
        if last:
            pairs = _square_pairs(open_, nodes, texts)
        else:
            pairs = _near_hub(open_.where("comp <> hubc").select(F.col("node").alias("u"), F.col("hub").alias("v")), nodes)
        links = cut(_confirmed(pairs, texts))
        comps = _merged(links, comps)
        release(links, state)
    return comps


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_shingles, component_id) of each row of docs (doc_id, text); h is xxhash64 of the text."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    schema = f"doc_id long, h long, {', '.join(f'{c} long' for c in [*_GROUP, *_SIG])}"
    rows = cut(texts.mapInArrow(signature_rows, schema))
    some = rows.where("n_shingles > 0 and doc_id is not null")
    nodes = some.groupBy(*_GROUP).agg(F.min("doc_id").alias("rep"), F.min_by("h", "doc_id").alias("rep_h"), F.count("*").alias("m"), *[F.first(c).alias(c) for c in _SIG])
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    n_nodes, n_rows = (x or 0 for x in nodes.agg(F.count("*"), F.sum("m")).first())
    keyed = nodes.select(F.posexplode(_keys()).alias("no", "key"), "node")
    shared = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min_by("node", F.xxhash64(F.lit(0), "node")).alias("hub")).where("m > 1")
    met = cut(join_counted(keyed, shared, ["key"], SYMBOLS * n_nodes))
    # from here on only the nodes that meet another one are read
    need = nodes.join(met.select("node").distinct(), "node", "left_semi").select(F.col("rep").alias("doc_id"), F.col("rep_h").alias("h"), "node", "fp1", "fp2")
    once = texts.where("doc_id is not null").groupBy("doc_id", "h").agg(F.first("text").alias("text"))
    texts = cut(once.join(need, ["doc_id", "h"]).select("node", "fp1", "fp2", "text").mapInArrow(_sets, "node long, small binary, text string"))
    comps = _components(met, nodes, texts)
    release(met, texts)
    # the components' least ids, then every row by its set
    found = nodes.select(*_GROUP, "m", "rep", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = found.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count("*").alias("size"))
    found = cut(join_counted(found, cut(least), ["comp"], n_nodes, "size").select(*_GROUP, "m", "component_id"))
    done = join_counted(some.select("doc_id", "h", *_GROUP), found, _GROUP, n_rows).select("doc_id", "h", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "h", "n_shingles", F.col("doc_id").alias("component_id"))
    return done.unionByName(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Other columns are not read. Null or empty texts, and texts of white space alone, have n_shingles 0 and are
    their own component. No rows in, no rows out.
    """
    return classes(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the one with the least id, the least text hash among equal ids; all columns stay.

    Rows with a null doc_id or without words are in a class of their own and stay.
    """
    rows = cut(classes(docs).where("doc_id is not null and n_shingles > 0"))
    chosen = cut(rows.where("doc_id = component_id").groupBy("doc_id").agg(F.min("h").alias("best"), F.count("*").alias("m")))
    several = cut(rows.join(chosen.where("m > 1"), "doc_id", "left_semi").join(chosen, "doc_id").where("doc_id = component_id"))
    key = ["_id", "_h"]
    as_key = lambda df: df.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    gone = as_key(rows.where("doc_id <> component_id").unionByName(several.where("h <> best").select(rows.columns)))
    kept = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_h": F.xxhash64("text")}).join(gone, key, "left_anti")
    again = as_key(several.where("h = best"))
    if not several.isEmpty():  # rows that repeat both id and text
        kept = kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates(key))
    return kept.select(docs.columns)
