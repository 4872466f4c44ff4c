"""Quality by positive-unlabelled learning with the non-negative risk.

A small network over the shape of a whole text (which characters and neighbouring kinds of characters it is
made of, how its words repeat, how long they are) is fitted to trusted positives and unlabelled documents by
minimising::

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

with the logistic loss; where the second term falls below zero the step goes the other way. Labelled
negatives are never fitted nor counted.

The class prior is estimated from the same positives and unlabelled documents. A network that tells positives
from unlabelled documents is fitted on one half of them; on the other half, the share of unlabelled documents
above a score, divided by the share of positives above it, bounds the prior from above at every score, and is
the prior where no negative lies above. The score is taken where that ratio plus its error bound is least (best
bin estimation), once for each half, and two standard errors are taken off: a prior that is too high leaves the
last kinds of bad text among the good ones, one that is a little low costs nothing.

Positives and unlabelled documents are each a sample of at most ``SAMPLE`` by hash, a parameter of :func:`train`:
errors of shares from 8,000 rows are about half a per cent, and the network has some 4,000 weights.

Labels, lang, source and doc_id are no inputs. A text without words is scored by the same features, all 0.
With fewer than two positives or two documents to train on, every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .arrowconf import bound_batches
from .labelled import first_by_hash, in_fold, texts_for, training_labels

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.5
SAMPLE = 8000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 150, 4000, 2e-2, 1e-4
DOUBT, SURE = 2.0, 0.1

# kinds of bytes: lower, upper, digit, space, line feed, other control, beyond ASCII, then each punctuation mark
_KIND = np.full(256, 6, np.int64)
_KIND[:32], _KIND[127], _KIND[10], _KIND[32] = 5, 5, 4, 3
_KIND[48:58], _KIND[65:91], _KIND[97:123] = 2, 1, 0
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
for _i, _b in enumerate(_MARKS):
    _KIND[_b] = 7 + _i
_N = 7 + len(_MARKS)
_COARSE = np.array([0, 1, 2, 3, 4, 5, 6, *(7 if chr(b) in ".,;:?!'\"()-" else 8 for b in _MARKS)])
_C = 9
_BACK = 4
WIDTH = _N + _C * _C + _BACK + 6


def features(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, WIDTH) of the texts of a block."""
    n = len(offs) - 1
    size = np.maximum(np.diff(offs), 1)[:, None]
    row = np.repeat(np.arange(n), np.diff(offs))
    kind = _KIND[raw]
    one = np.bincount(row * _N + kind, minlength=n * _N).reshape(n, _N) / size
    c = _COARSE[kind]
    pair = (row[1:] * _C + c[:-1]) * _C + c[1:]
    two = np.bincount(pair[row[1:] == row[:-1]], minlength=n * _C * _C).reshape(n, _C * _C) / size
    block = tb.Block(raw, offs, tb.SPACED)
    h, words = block.hashes(), np.maximum(block.counts, 1)[:, None]
    of = np.repeat(np.arange(n), block.counts)
    back = np.zeros((n, _BACK))
    for k in range(1, _BACK + 1):
        same = (h[k:] == h[:-k]) & (of[k:] == of[:-k])
        back[:, k - 1] = np.bincount(of[k:][same], minlength=n)
    long = (block.ends - block.starts).astype(float)
    sums = lambda x: np.bincount(of, weights=x, minlength=n)[:, None] / words
    mean = sums(long)
    rest = [np.log1p(block.counts)[:, None], mean, np.sqrt(np.maximum(0, sums(long**2) - mean**2)), sums(long <= 3), sums(long >= 13), np.log1p(np.diff(offs))[:, None]]
    return np.hstack([np.sqrt(one), np.sqrt(two), np.sqrt(back / words), *rest]).astype(np.float32)


def _featured(batches):
    for batch in batches:
        parts = [features(raw, offs) for _, _, raw, offs in tb.slices(batch.column(1))]
        x = np.vstack(parts) if parts else np.empty((0, WIDTH), np.float32)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * WIDTH), pa.array(x.ravel()))
        yield pa.record_batch([batch.column(0), batch.column(2), flat], ["doc_id", "role", "x"])


_soft = lambda z: np.logaddexp(0, z)
_sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def nn_risk(ga: np.ndarray, gb: np.ndarray, prior: float):
    """(value, slopes of positives' and unlabelled outputs) of the non-negative risk; where its second term is below 0, the slopes that raise that term."""
    positive, negative = prior * _soft(-ga).mean(), _soft(gb).mean() - prior * _soft(ga).mean()
    up, minus_a, minus_b = prior * (_sigmoid(ga) - 1) / len(ga), -prior * _sigmoid(ga) / len(ga), _sigmoid(gb) / len(gb)
    if negative >= 0:
        return positive + negative, up + minus_a, minus_b
    return positive, -minus_a, -minus_b


def told_apart(ga: np.ndarray, gb: np.ndarray, _: float):
    """(value, slopes) of the logistic loss that tells positives from unlabelled."""
    return _soft(-ga).mean() + _soft(gb).mean(), (_sigmoid(ga) - 1) / len(ga), _sigmoid(gb) / len(gb)


def fit(pos: np.ndarray, unl: np.ndarray, prior: float, risk=nn_risk, epochs: int = EPOCHS, seed: int = 5) -> dict:
    """The network that minimises a risk of positives and unlabelled."""
    rng = np.random.default_rng(seed)
    both = np.vstack([pos, unl])
    mean, std = both.mean(0), both.std(0) + 1e-3
    pos, unl = np.clip((pos - mean) / std, -8, 8), np.clip((unl - mean) / std, -8, 8)
    w = [rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    steps = max(1, min(len(pos), len(unl)) // BATCH)
    for epoch in range(epochs):
        p, u = rng.permutation(len(pos)), rng.permutation(len(unl))
        for s in range(steps):
            a, b = pos[p[s::steps]], unl[u[s::steps]]
            x = np.vstack([a, b])
            h = np.tanh(x @ w[0] + w[1])
            g = h @ w[2] + w[3]
            d = np.concatenate(risk(g[: len(a)], g[len(a) :], prior)[1:])
            dh = d[:, None] * w[2] * (1 - h * h)
            grads = [x.T @ dh + DECAY * w[0], dh.sum(0), h.T @ d + DECAY * w[2], np.array([d.sum()])]
            t += 1
            rate = RATE * (0.1 if epoch > 0.75 * epochs else 1)
            for k, gr in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * gr
                v[k] = 0.999 * v[k] + 0.001 * gr * gr
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return {"w": w, "mean": mean, "std": std}


def best_bin(pos: np.ndarray, unl: np.ndarray) -> tuple[float, float]:
    """(prior, its standard error) from the scores of positives and unlabelled documents that no fit has seen."""
    cut = np.unique(pos)
    qp = 1 - np.searchsorted(np.sort(pos), cut) / len(pos)
    qu = 1 - np.searchsorted(np.sort(unl), cut) / len(unl)
    slack = np.sqrt(np.log(4 / SURE) / 2) * (1 / np.sqrt(len(unl)) + 1 / np.sqrt(len(pos)))
    k = int(np.argmin((qu + slack) / qp))
    error = np.sqrt(qu[k] * (1 - qu[k]) / len(unl) / qp[k] ** 2 + (qu[k] / qp[k]) ** 2 * (1 - qp[k]) / len(pos) / qp[k])
    return float(min(1.0, qu[k] / qp[k])), float(error)


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives among unlabelled documents, less ``DOUBT`` standard errors; each half is judged by a network of the other."""
    got = []
    for k in (0, 1):
        model = fit(pos[k::2], unl[k::2], 0.5, told_apart, EPOCHS // 4)
        got.append(best_bin(apply_model(model, pos[1 - k :: 2]), apply_model(model, unl[1 - k :: 2])))
    (a, ea), (b, eb) = got
    return float(np.clip((a + b) / 2 - DOUBT * np.hypot(ea, eb) / 2, 0.02, 0.98))


def apply_model(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    w = model["w"]
    g = np.tanh(np.clip((x - model["mean"]) / model["std"], -8, 8) @ w[0] + w[1]) @ w[2] + w[3]
    return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The model of documents (doc_id, text) and labels (doc_id, quality), from training rows alone."""
    bound_batches(docs.sparkSession)
    known = training_labels(labels, "quality", FOLDS, HELD_OUT)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pos = first_by_hash(known.where("label = 1").select("doc_id"), sample, 1).withColumn("role", F.lit(1))
    unl = docs.select("doc_id").where("doc_id is not null").where(~in_fold(F.col("doc_id"), FOLDS, HELD_OUT))
    unl = first_by_hash(unl, sample, 2).withColumn("role", F.lit(0))
    rows = texts_for(pos.unionByName(unl), docs, 2 * sample).select("doc_id", "text", "role").mapInArrow(_featured, "doc_id long, role int, x array<float>")
    got = rows.toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, WIDTH) if got.num_rows else np.empty((0, WIDTH), np.float32)
    ids, role = got["doc_id"].to_numpy(), got["role"].to_numpy()
    order = np.lexsort((ids, role))
    x, role = x[order].astype(np.float64), role[order]
    pos, unl = x[role == 1], x[role == 0]
    if min(len(pos), len(unl)) < 2:
        return None
    return fit(pos, unl, estimate_prior(pos, unl))


def _scorer(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            parts = [apply_model(model, features(raw, offs)) for _, _, raw, offs in tb.slices(batch.column(1))]
            score = np.concatenate(parts) if parts else np.empty(0)
            yield pa.record_batch([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (higher: likelier good), predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(model), "doc_id long, score double")
    return out.select("doc_id", in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _keeper(shared, at):
    def run(batches):
        model = shared.value
        for batch in batches:
            parts = [apply_model(model, features(raw, offs)) for _, _, raw, offs in tb.slices(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(parts) >= THRESHOLD)) if parts else batch

    return run


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that are predicted bad, in one pass; all columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.mapInArrow(_keeper(model, docs.columns.index("text")), docs.schema)
