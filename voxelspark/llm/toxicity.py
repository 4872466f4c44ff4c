"""Toxicity as maximum-scoring segments of token log-odds, calibrated by extreme values.

Word weights are log-odds between toxic and other training documents with an informative Dirichlet prior
(the pooled word frequencies, in all as many pseudo-counts as the toxic documents have words), kept where
they stand out by ``Z`` standard deviations. A word counts once a document and a repeated text counts once,
so neither repetition nor copies pass for evidence. A word scores its clipped weight less a drift, so ordinary text scores below zero on average;
a word that repeats the one before it scores as ordinary text.
A linear scan (each word is pushed and popped once) finds all maximal-scoring segments of a whole text.

The scores of ordinary text give the decay ``lam`` of the extreme-value law as the root of
``sum p(s) exp(lam s) = 1``, and its best segments in non-toxic training documents give ``K``; a segment of
score S in n words is then expected ``E = K n exp(-lam S)`` times by chance. Segments with E below
``SIGNIFICANT`` are toxic passages. A document's evidence is the strongest segment's -log E and the sum over
its passages; a logistic curve, fitted on training rows, makes it a score between 0 and 1.

Fitted on a sample of at most ``SAMPLE`` labelled training rows by hash; the model holds at most ``VOCABULARY``
words, those that stand out most. Both bounds are parameters of :func:`train`. Labels, lang, source and doc_id are
no inputs. Texts without words have no segment and get the score of no evidence; without training rows of
both kinds all scores are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import textblocks as tb
from .arrowconf import bound_batches
from .labelled import first_by_hash, in_fold, texts_for, training_labels

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
SAMPLE, VOCABULARY = 24_000, 50_000
Z, MIN_COUNT = 2.3, 4
CLIP, DRIFT = 6.0, 1.0
SIGNIFICANT = 0.05


def maximal_segments(low: list[float], high: list[float]) -> list[tuple[int, int]]:
    """All maximal-scoring segments of a sequence, as (first, last) of its rising elements.

    Element k rises from the running total ``low[k]`` to ``high[k]``; what lies between elements falls.
    """
    seg: list[list] = []  # [total before, total after, first, last]
    for k in range(len(low)):
        cur = [low[k], high[k], k, k]
        while True:
            j = len(seg) - 1
            while j >= 0 and seg[j][0] >= cur[0]:
                j = seg[j][4]
            if j < 0 or seg[j][1] >= cur[1]:
                # the nearest earlier segment that starts lower: where later searches may go on
                seg.append([*cur, j])
                break
            cur = [seg[j][0], cur[1], seg[j][2], cur[3]]
            del seg[j:]
    return [(s[2], s[3]) for s in seg]


class Model:
    def __init__(self, hashes: np.ndarray, scores: np.ndarray, lam: float, k: float, curve: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], scores[order]
        self.lam, self.k, self.curve = lam, k, curve

    def word_scores(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -DRIFT)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            out[hit] = self.scores[at[hit]]
        return out

    def segments(self, block: tb.Block):
        """For each text, the (start word, end word, score) of its maximal segments."""
        h = block.hashes()
        s = self.word_scores(h)
        again = np.flatnonzero(h[1:] == h[:-1]) + 1
        s[again] = np.minimum(s[again], -DRIFT)
        total = np.concatenate([[0.0], np.cumsum(s)])
        up = np.flatnonzero(s > 0)
        first = np.searchsorted(up, block.first)
        for r in range(len(block.counts)):
            if (mine := up[first[r] : first[r + 1]]).size:
                lo = int(block.first[r])
                a, b = total[mine], total[mine + 1]
                yield [(int(mine[x]) - lo, int(mine[y]) + 1 - lo, float(b[y] - a[x])) for x, y in maximal_segments(a.tolist(), b.tolist())]
            else:
                yield []

    def evidence(self, n: int, segments: list) -> tuple[float, float, int]:
        """(-log E of the best, sum over passages, number of passages); 0 where there is none."""
        if not segments:
            return 0.0, 0.0, 0
        e = self.lam * np.array([s for _, _, s in segments]) - np.log(max(self.k * n, 1e-300))
        passages = e[e > -np.log(SIGNIFICANT)]
        return float(max(0.0, e.max())), float(passages.sum()), len(passages)

    def score(self, best, total):
        x = self.curve[0] + self.curve[1] * np.log1p(best) + self.curve[2] * np.log1p(total)
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _counted(batches):
    """(word, toxic, clean): documents with the word, per block."""
    for batch in batches:
        label = batch.column(1).to_numpy()
        for i, j, block in tb.blocks(batch.column(0), tb.ALNUM):
            of = np.repeat(np.arange(j - i), block.counts)
            h = block.hashes()
            _, once = np.unique(h ^ tb.mix(of.astype(np.uint64)), return_index=True)
            h, toxic = h[once], (label[i:j] == 1)[of[once]]
            u, at = np.unique(h, return_inverse=True)
            t = np.bincount(at, weights=toxic, minlength=len(u))
            c = np.bincount(at, minlength=len(u)) - t
            yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(t.astype(np.int64)), pa.array(c.astype(np.int64))], ["word", "toxic", "clean"])


def _measured(shared):
    """(label, n, score of the best segment, evidence of it and of all passages) for calibration: four numbers a text."""

    def run(batches):
        model = shared.value
        for batch in batches:
            n, best, total, top = [], [], [], []
            for _, _, block in tb.blocks(batch.column(0), tb.ALNUM):
                n += block.counts.tolist()
                for k, seg in zip(block.counts.tolist(), model.segments(block)):
                    top.append(max((s for _, _, s in seg), default=0.0))
                    b, t, _ = model.evidence(k, seg)
                    best.append(b)
                    total.append(t)
            numbers = [pa.array(x, pa.float64()) for x in (top, best, total)]
            yield pa.record_batch([batch.column(1), pa.array(n, pa.int64()), *numbers], ["label", "n", "top", "best", "total"])

    return run


def _decay(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p exp(lam s) = 1; 1 where scores never rise or do not fall on average."""
    if not (s[p > 0] > 0).any() or (p * s).sum() >= 0:
        return 1.0
    lo, hi = 0.0, 1.0
    f = lambda x: float((p * np.exp(np.clip(x * s, -700, 700))).sum()) - 1
    while f(hi) < 0:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a little ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 1e-2 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> Model | None:
    """The model of documents (doc_id, text) and labels (doc_id, toxic), from training rows alone."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = first_by_hash(training_labels(labels, "toxic", FOLDS, HELD_OUT), sample, 3)
    texts = cut(texts_for(known, docs, sample).select("text", "label", F.xxhash64("text").alias("h")).dropDuplicates(["h", "label"]).select("text", "label"))
    counts = texts.mapInArrow(_counted, "word long, toxic long, clean long")
    counts = cut(counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    nt, nc = (float(x or 0) for x in counts.agg(F.sum("toxic"), F.sum("clean")).first())
    if not nt or not nc:
        return None
    prior = F.lit(nt) * (F.col("toxic") + F.col("clean")) / F.lit(nt + nc)
    odds = lambda y, n: F.log((y + prior) / (F.lit(n + nt) - y - prior))
    delta = odds(F.col("toxic"), nt) - odds(F.col("clean"), nc)
    z = delta / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    strong = counts.where(F.col("toxic") + F.col("clean") >= MIN_COUNT).withColumn("delta", delta).withColumn("z", z).where(F.abs("z") >= Z)
    held = strong.orderBy(F.abs("z").desc(), "word").limit(vocabulary).toPandas()
    scores = np.clip(held["delta"].to_numpy(float), -CLIP, CLIP) - DRIFT
    model = Model(held["word"].to_numpy(np.int64).view(np.uint64), scores, 1.0, 1.0, np.zeros(3))
    seen = held["clean"].to_numpy(float)
    p, s = np.append(seen, max(0.0, nc - seen.sum())) / nc, np.append(scores, -DRIFT)
    model.lam = _decay(p, s)
    measure = lambda: texts.mapInArrow(_measured(spark.sparkContext.broadcast(model)), "label int, n long, top double, best double, total double").where("n > 0")
    clean = measure().where("label = 0").select(F.count("*"), F.sum(F.col("n") * F.exp(-model.lam * F.col("top")))).first()
    model.k = float(clean[0] / max(clean[1] or 0.0, 1e-12))
    got = measure().toPandas()
    y = (got["label"] == 1).to_numpy(float)
    if not y.any() or y.all():
        return None
    ev = got[["best", "total"]].to_numpy(float)
    order = np.lexsort((ev[:, 1], ev[:, 0], y))
    model.curve = _logistic(np.column_stack([np.ones(len(y)), np.log1p(ev)])[order], y[order])
    return model


def _scores(model: Model | None, column: pa.Array) -> tuple[np.ndarray, list]:
    """Scores of texts and their passages."""
    if model is None:
        return np.zeros(len(column)), [[]] * len(column)
    best, total, spans = [], [], []
    for _, _, block in tb.blocks(column, tb.ALNUM):
        for n, seg in zip(block.counts.tolist(), model.segments(block)):
            b, t, _ = model.evidence(n, seg)
            best.append(b)
            total.append(t)
            least = np.log(max(model.k * n, 1e-300)) - np.log(SIGNIFICANT)
            spans.append([s for s in seg if model.lam * s[2] > least])
    return model.score(np.array(best), np.array(total)), spans


def _scanned(shared):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            score, spans = _scores(shared.value, batch.column(1))
            spans = [[dict(zip(("start", "end", "score"), x)) for x in s] for s in spans]
            yield pa.record_batch([batch.column(0), pa.array(score, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "passages"])

    return run


def _keeper(shared, at):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared.value, batch.column(at))[0] < THRESHOLD))

    return run


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that are predicted toxic, in one pass; all columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.mapInArrow(_keeper(model, docs.columns.index("text")), docs.schema)


def toxic_passages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, passages (start word, end word, score)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_scanned(model), "doc_id long, score double, passages array<struct<start:long,end:long,score:double>>")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, n_passages."""
    out = toxic_passages(docs, labels)
    return out.select(
        "doc_id", in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages")
    )
