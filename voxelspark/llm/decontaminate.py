"""Benchmark decontamination by a prefix-filtered set join with exact containment over item-sized windows.

Words are runs of digits, a-z (A-Z lowered) and characters beyond ASCII. An item's windows are its runs of
``WINDOW`` words; an item with fewer words, but not none, is one window. A window is a sequence of shingles of
``SHINGLE`` words (a window with fewer words: one shingle of all of them). Containment of the whole window
needs all of its shingles, so its necessary prefix is a single one: the rarest in the documents, counted over
all of them, ties by hash. Documents are joined by that shingle alone. Where it stands fixes where the window
would start (positional bound) and end (length bound); what is left is verified word by word, as bytes.

The benchmark's windows and the items that hold them go to every task only while they take at most
``broadcast_bytes``, measured before anything is gathered; beyond that the same join runs as shuffled equi-joins,
in which which item holds which window stays a table. Results are equal either way. What one row needs is
gathered for that row alone: where candidates start in a document (one for each of its words and windows of a
shingle at most), and the ids of its items, as the digest is of their sorted list.

Null texts have no words. Items or documents that repeat an id count as they stand: a document row each, and
equal item ids once. Null item ids are left out; a null doc_id stays with its row.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import textblocks as tb
from .arrowconf import bound_batches

WINDOW, SHINGLE = 10, 5
#: What may be sent to every task, as measured by :func:`_bytes`; Python objects take about three times as much.
BROADCAST_BYTES = 48 << 20
OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_BITS = 20


def item_windows(batches):
    """(item_id, words, shingles, width): each window of each item, its words joined by a space, its shingles' hashes in order."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        out = []
        for i, j, block in tb.blocks(batch.column(1), tb.ALNUM):
            h = block.hashes()
            for r in range(i, j):
                lo, hi = int(block.first[r - i]), int(block.first[r - i + 1])
                size = min(WINDOW, hi - lo)
                if not size or ids[r] is None:
                    continue
                width = min(SHINGLE, size)
                run = tb.chain(h[lo:hi], width).view(np.int64).tolist()
                words = [block.word(x).decode() for x in range(lo, hi)]
                for s in range(hi - lo - size + 1):
                    out.append((ids[r], " ".join(words[s : s + size]), run[s : s + size - width + 1], width))
        cols = list(zip(*out)) if out else [[], [], [], []]
        yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.int32())], ["item_id", "words", "shingles", "width"])


class Lookup:
    """Which of many hashes are in a fixed set: a bit table first, then a sorted search."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes.astype(np.uint64))
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.sorted >> np.uint64(64 - _BITS)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Positions in h of members."""
        maybe = np.flatnonzero(self.bits[h >> np.uint64(64 - _BITS)])
        if not len(maybe) or not len(self.sorted):
            return maybe[:0]
        at = np.searchsorted(self.sorted, h[maybe])
        return maybe[self.sorted[np.minimum(at, len(self.sorted) - 1)] == h[maybe]]


def _counter(shared):
    """Counts, per task, of the benchmark's shingles in documents."""

    def run(batches):
        hashes, widths = shared.value
        find, total = Lookup(hashes), defaultdict(int)
        for batch in batches:
            for _, _, block in tb.blocks(batch.column(0), tb.ALNUM):
                h = block.hashes()
                for k in widths:
                    c = tb.chain(h, k)
                    hit = find(c)
                    for x, n in zip(*np.unique(c[hit], return_counts=True)):
                        total[int(x)] += int(n)
        yield pa.record_batch([pa.array(np.array(list(total), np.uint64).view(np.int64)), pa.array(list(total.values()), pa.int64())], ["shingle", "n"])

    return run


def _row(n_words: int, spans: list, items: set) -> tuple:
    hit, end = 0, 0
    for s, e in sorted(spans):
        hit += max(0, e - max(s, end))
        end = max(end, e)
    names = ",".join(sorted(map(str, items)))
    return n_words, hit, len(items), hashlib.sha256(names.encode()).hexdigest(), hit > 0


def _batch(ids, rows) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.record_batch([ids, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.bool_())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _scanner(shared, text_at: int | None = None):
    """By the broadcast index, prefix shingle -> (offset, words, number of the item list), and item lists: rows of OUT for (doc_id, text), or the rows whose text, column ``text_at``, is clean."""

    def run(batches):
        index, lists, widths = shared.value
        find = Lookup(np.array(list(index), np.int64).view(np.uint64))
        for batch in batches:
            rows = []
            for i, j, block in tb.blocks(batch.column(1 if text_at is None else text_at), tb.ALNUM):
                h = block.hashes()
                spans, items = defaultdict(list), defaultdict(set)
                for k in widths:
                    c = tb.chain(h, k)
                    hits = find(c)
                    of = np.searchsorted(block.first, hits, "right") - 1
                    for at, r in zip(hits.tolist(), of.tolist()):
                        lo, hi = int(block.first[r]), int(block.first[r + 1])
                        for offset, words, names in index[int(c[at].astype(np.int64))]:
                            s = at - offset
                            if s < lo or s + len(words) > hi or any(block.word(s + x) != w for x, w in enumerate(words)):
                                continue
                            spans[r].append((s, s + len(words)))
                            items[r].update(lists[names])
                n = block.counts.tolist()
                rows += [_row(n[r], spans.get(r, ()), items.get(r, ())) for r in range(j - i)]
            yield _batch(batch.column(0), rows) if text_at is None else batch.filter(pa.array([not r[4] for r in rows], pa.bool_()))

    return run


def _positions(widths):
    """(row_id, pos, n_words, shingle) of every shingle of documents, for the shuffled join."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, block in tb.blocks(batch.column(1), tb.ALNUM):
                h = block.hashes()
                for k in widths:
                    c = tb.chain(h, k)
                    of = np.searchsorted(block.first, np.arange(len(c)), "right") - 1
                    inside = np.arange(len(c)) + k <= block.first[of + 1] if len(c) else np.empty(0, bool)
                    of, at = of[inside], np.flatnonzero(inside)
                    yield pa.record_batch([pa.array(ids[i:j][of], pa.int64()), pa.array(at - block.first[of], pa.int64()), pa.array(block.counts[of], pa.int64()), pa.array(c[inside].view(np.int64))], ["row_id", "pos", "n_words", "shingle"])

    return run


def _verify(batches):
    """(row_id, n_words, n_hit, windows found) of (row_id, text, found: array of (start, words))."""
    for batch in batches:
        found = batch.column(2).to_pylist()
        rows, windows = [], []
        for i, j, block in tb.blocks(batch.column(1), tb.ALNUM):
            for r in range(i, j):
                lo = int(block.first[r - i])
                spans, names = [], set()
                for f in found[r] or ():
                    words, s = f["words"].encode().split(b" "), f["start"]
                    if all(block.word(lo + s + x) == w for x, w in enumerate(words)):
                        spans.append((s, s + len(words)))
                        names.add(f["words"])
                rows.append(_row(int(block.counts[r - i]), spans, ()))
                windows.append(sorted(names))
        yield pa.record_batch([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(windows, pa.list_(pa.string()))], ["row_id", "n_words", "n_hit", "windows"])


def _bytes(windows: DataFrame, members: DataFrame) -> int:
    """Bytes of the distinct windows with their shingles, and of the ids of the items that hold them."""
    own = windows.agg(F.sum(F.length("words") + 8 * F.size("shingles") + 200)).first()[0] or 0
    return own + 16 * members.count()


def _prepared(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int):
    """(windows, members, widths, index to send to the tasks or None where it is too large)."""
    spark = docs.sparkSession
    bound_batches(spark)
    pieces = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(item_windows, "item_id long, words string, shingles array<long>, width int")
    members = cut(pieces.distinct())
    windows = cut(members.groupBy("words").agg(F.min("shingles").alias("shingles"), F.min("width").alias("width")))
    members = members.select("words", "item_id")
    widths = sorted(r[0] for r in windows.select("width").distinct().collect())
    if _bytes(windows, members) > broadcast_bytes:
        return windows, members, widths, None
    held = windows.collect()
    items = defaultdict(list)
    for words, item in members.collect():
        items[words].append(item)
    wanted = np.unique(np.array([s for w in held for s in w["shingles"]], np.int64)).view(np.uint64)
    counts = docs.select("text").mapInArrow(_counter(spark.sparkContext.broadcast((wanted, widths))), "shingle long, n long")
    often = dict(map(tuple, counts.groupBy("shingle").agg(F.sum("n").alias("n")).collect())) if len(wanted) else {}
    index, lists = defaultdict(list), {}
    for w in held:
        s = w["shingles"]
        at = min(range(len(s)), key=lambda x: (often.get(s[x], 0), s[x]))
        if often.get(s[at], 0):  # no document has it otherwise
            index[s[at]].append((at, w["words"].encode().split(b" "), lists.setdefault(tuple(sorted(items[w["words"]])), len(lists))))
    return windows, members, widths, spark.sparkContext.broadcast((dict(index), list(lists), widths))


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): words, words hit, items with occurring windows and their digest.

    ``benchmark`` has (item_id, text). Other columns are not read. An empty benchmark hits nothing.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    windows, members, widths, index = _prepared(docs, benchmark, broadcast_bytes)
    if index is not None:
        return docs.mapInArrow(_scanner(index), OUT)
    keyed = cut(docs.withColumn("row_id", F.monotonically_increasing_id()))
    hits = cut(_shuffled(keyed, windows, widths))
    of = hits.select("row_id", F.explode("windows").alias("words")).join(members, "words").select("row_id", "item_id").distinct()
    ids = of.groupBy("row_id").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("ids"))
    out = keyed.select("row_id", "doc_id").join(hits.drop("windows"), "row_id").join(ids, "row_id", "left")
    digest = F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _shuffled(keyed: DataFrame, windows: DataFrame, widths: list[int]) -> DataFrame:
    """(row_id, n_words, n_hit, windows) of (row_id, text), by shuffled joins."""
    shingle = keyed.select("row_id", "text").mapInArrow(_positions(widths), "row_id long, pos long, n_words long, shingle long")
    parts = windows.select("words", F.size(F.split("words", " ")).alias("len"), F.posexplode("shingles").alias("offset", "shingle"))
    wanted = parts.select("shingle").distinct()
    often = shingle.join(wanted, "shingle").groupBy("shingle").agg(F.count("*").alias("n"))
    rare = F.min(F.struct("n", "shingle", "offset")).alias("rare")
    prefix = parts.join(often, "shingle").groupBy("words").agg(rare, F.first("len").alias("len"), F.count("*").alias("some"))
    whole = windows.select("words", F.size("shingles").alias("all"))
    prefix = prefix.join(whole, "words").where("some = all").select("words", "len", "rare.shingle", "rare.offset")
    found = shingle.join(prefix, "shingle").withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0 and start + len <= n_words")
    found = found.groupBy("row_id").agg(F.collect_list(F.struct("start", "words")).alias("found"))
    return keyed.join(found, "row_id", "left").select("row_id", "text", "found").mapInArrow(_verify, "row_id long, n_words long, n_hit long, windows array<string>")


def clean_of(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without contaminated documents; all columns stay."""
    windows, _, widths, index = _prepared(docs, benchmark, broadcast_bytes)
    if index is not None:
        return docs.mapInArrow(_scanner(index, docs.columns.index("text")), docs.schema)
    # a verdict is of a row: ids may be null or repeat
    keyed = cut(docs.withColumn("_row_id", F.monotonically_increasing_id()))
    hit = _shuffled(keyed.select(F.col("_row_id").alias("row_id"), "text"), windows, widths).where("n_hit > 0").select(F.col("row_id").alias("_row_id"))
    return keyed.join(hit, "_row_id", "left_anti").select(docs.columns)
