"""Token counts by byte-pair merging on a heap and a linked list.

A piece of text starts as one symbol per byte (the last one carries the vocabulary's end-of-word mark). The
adjacent pair of lowest rank is popped again and again, leftmost first among equals; a merge joins two list
nodes and offers the two new neighbours. The count is the number of initial symbols minus the merges; no
identifier is ever made. Counts of pieces are kept per task while they are at most ``MEMO``.

The vocabulary file is read once, where the job is planned, and sent to the tasks; its size is that of a
vocabulary and does not grow with the data.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .arrowconf import bound_batches

MEMO = 300_000
LIMIT = 2048


def _byte_letters() -> list[str]:
    """The letter for each byte: printable bytes stand for themselves, the others for 256, 257, ... in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _normaliser(spec: dict | None) -> list:
    """The functions that a file's normaliser names, in order; an error for one that is not known here, as counts would be off."""
    kind = (spec or {}).get("type")
    if kind is None:
        return []
    if kind == "Sequence":
        return [f for s in spec["normalizers"] for f in _normaliser(s)]
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return [lambda t: unicodedata.normalize(kind, t)]
    if kind == "Lowercase":  # letter by letter: a final sigma is not special
        return [lambda t: t.replace("Σ", "σ").lower()]
    if kind == "Replace" and "Regex" in spec["pattern"]:
        find = regex.compile(spec["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        by = spec["content"].replace("\\", "\\\\")
        return [lambda t: find.sub(by, t)]
    if kind == "Replace":
        return [lambda t: t.replace(spec["pattern"]["String"], spec["content"])]
    raise ValueError(f"no normaliser of type {kind}")


class Counter(dict):
    """Tokens of a piece (a dict that fills itself), and of a text."""

    def __init__(self, spec: str):
        super().__init__()
        model = json.loads(spec)
        bpe = model["model"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in bpe["merges"])
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.mark = bpe.get("end_of_word_suffix") or ""
        self.letters = _byte_letters()
        special = [t["content"] for t in model.get("added_tokens", ())]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.starts = {s[0] for s in special}
        self.normal = _normaliser(model.get("normalizer"))
        split = next(x for x in model["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        self.pieces = regex.compile(split.replace(r"\s", r"\p{White_Space}")).findall

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[piece] = n = self._merge(piece)
        return n

    def _merge(self, piece: str) -> int:
        sym = [self.letters[b] for b in piece.encode()]
        sym[-1] += self.mark
        n = len(sym)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        rank = self.rank
        heap = [(r, i, sym[i] + sym[i + 1]) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i] if sym[i] is not None else -1
            if j < 0 or sym[i] + sym[j] != whole or (sym[i], sym[j]) not in rank:
                continue
            sym[i], sym[j] = whole, None
            merges += 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get((whole, sym[k]))) is not None:
                    heapq.heappush(heap, (r, i, whole + sym[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((sym[h], whole))) is not None:
                heapq.heappush(heap, (r, h, sym[h] + whole))
        return n - merges

    def text(self, text: str) -> int:
        if not any(c in text for c in self.starts):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        for step in self.normal:
            text = step(text)
        return sum(map(self.__getitem__, self.pieces(text)))


def _run(spec):
    def run(batches):
        count = Counter(spec.value)
        for batch in batches:
            _, offs = tb.texts_of(batch.column(1))
            texts = batch.column(1).to_pylist()
            tokens = [count.text(t) if t else 0 for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(np.diff(offs)), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    ``vocabulary`` is the path of a word-piece BPE file with an end-of-word mark. Special strings inside a
    text count one token each. Null and empty texts have 0 bytes and 0 tokens. Other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_run(spec), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
