"""Classifiers by held-out accuracy, vectors and the pipeline by brute force, SQL oracles."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_ops import contaminated, near_components, water
from tests.oracle import check
from voxelspark.llm import quality, toxicity, vectors
from voxelspark.llm import queries as q

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_oracle(spark, name):
    check(spark, q.QUERIES[name], q.SQL[name], SMALL)


def held_out_accuracy(spark, out, column, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = out.join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(column).alias("y")).toPandas()
    order = got["score"].rank().to_numpy()
    y = got["y"].to_numpy()
    auc = (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    return (got["predicted"] == y).mean(), auc


def test_quality_held_out(spark):
    out = q.op1_quality(spark, "/root/testdata/sf0.1")
    acc, auc = held_out_accuracy(spark, out, "quality", "/root/testdata/sf0.1")
    assert acc > 0.97 and auc > 0.98
    r = out.where("score < 0 or score > 1 or score is null or predicted <> int(score >= 0.5)").count()
    assert r == 0 and out.count() == 10000
    assert {(x[0], x[1]) for x in out.select("doc_id", "held_out").take(200)} == {(x[0], zlib.crc32(str(x[0]).encode()) % 3 == 1) for x in out.select("doc_id").take(200)}


def test_toxicity_held_out(spark):
    acc, auc = held_out_accuracy(spark, q.op9_toxicity(spark, "/root/testdata/sf0.1"), "toxic", "/root/testdata/sf0.1")
    assert acc > 0.95 and auc > 0.93


def test_scores_do_not_see_labels_of_held_out_rows(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    for f, fold, n, c in ((quality.quality_scores, 1, 3, "quality"), (toxicity.toxicity_scores, 2, 4, "toxic")):
        hidden = F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == fold
        flipped = labels.withColumn(c, F.when(hidden, 1 - F.col(c)).otherwise(F.col(c)))
        assert sorted(map(tuple, f(docs, labels).select("doc_id", "score").collect())) == sorted(map(tuple, f(docs.withColumn("lang", F.lit("?")), flipped).select("doc_id", "score").collect()))


def test_maximal_segments():
    """Against the definition: recursively, the best segment, then those left and right of it."""

    def brute(s, lo, hi):
        best = None
        for i in range(lo, hi):
            for j in range(i + 1, hi + 1):
                if (t := round(sum(s[i:j]), 9)) > 0 and (best is None or t > best[0]):
                    best = (t, i, j)
        return [] if best is None else [*brute(s, lo, best[1]), (best[1], best[2]), *brute(s, best[2], hi)]

    r = random.Random(4)
    for _ in range(300):
        s = [r.choice([-3.1, -1.7, -1.01, 0.53, 1.3, 2.9, 4.7]) + r.random() * 0.01 for _ in range(r.randint(1, 25))]
        total = np.concatenate([[0], np.cumsum(s)])
        up = [k for k, x in enumerate(s) if x > 0]
        got = [(up[a], up[b] + 1) for a, b in toxicity.maximal_segments([total[k] for k in up], [total[k + 1] for k in up])]
        assert got == brute(s, 0, len(s))


@pytest.mark.parametrize("prior", [0.3, 0.9])
def test_slopes_of_the_non_negative_risk(prior):
    """Finite differences of each side of the risk, where its second term is positive and where it is not."""
    r = np.random.default_rng(1)
    ga, gb = r.normal(size=7), r.normal(size=11)
    for shift in (3.0, -8.0):
        b = gb + shift
        soft = lambda z: np.logaddexp(0, z)
        second = lambda x, y: soft(y).mean() - prior * soft(x).mean()
        positive = second(ga, b) >= 0
        assert positive == (shift > 0)
        f = (lambda x, y: prior * soft(-x).mean() + second(x, y)) if positive else lambda x, y: -second(x, y)
        value, da, db = quality.nn_risk(ga, b, prior)
        assert abs(value - (prior * soft(-ga).mean() + max(0, second(ga, b)))) < 1e-12
        for k in range(7):
            e = np.eye(7)[k] * 1e-6
            assert abs((f(ga + e, b) - f(ga - e, b)) / 2e-6 - da[k]) < 1e-6
        for k in range(11):
            e = np.eye(11)[k] * 1e-6
            assert abs((f(ga, b + e) - f(ga, b - e)) / 2e-6 - db[k]) < 1e-6


def test_prior_is_estimated_from_positives_and_unlabelled():
    r = np.random.default_rng(2)
    for share in (0.3, 0.7, 0.9):
        pos = r.normal(2, 1, 4000)
        unl = np.where(r.random(4000) < share, r.normal(2, 1, 4000), r.normal(-2, 1, 4000))
        got, error = quality.best_bin(pos, unl)
        assert abs(got - share) < 0.05 and 0 < error < 0.05


def test_decay_solves_its_equation():
    p, s = np.array([0.02, 0.98]), np.array([3.0, -0.2])
    lam = toxicity._decay(p, s)
    assert lam > 0 and abs((p * np.exp(lam * s)).sum() - 1) < 1e-9


def test_vectors(spark, monkeypatch):
    r = np.random.default_rng(8)
    base = r.normal(size=(12, 64))
    rows = [(k, [float(x) for x in np.float32(base[k % 12] + r.normal(size=64) * (0.05 if k % 3 else 0.45))]) for k in range(300)]
    rows += [(k, rows[k % 7][1]) for k in range(300, 340)]
    rows += [(400, None), (401, [0.0] * 64), (402, [float("nan")] * 64), (403, [None] * 64), (404, [float("inf")] * 64), (405, [2 * x for x in rows[5][1]]), (406, rows[5][1][:10])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1)).withColumn("label", F.lit(None).cast("int"))
    good = {k: np.array([*v, *[0.0] * (64 - len(v))], float) for k, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    x = np.array([good[k].astype(np.float32).astype(float) for k in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    comp = {k: k for k in [k for k, _ in rows]}
    for _ in range(40):
        for i, k in enumerate(ids):
            comp[k] = min(comp[ids[j]] for j in np.flatnonzero(link[i]))
    want = sorted((k, int(link[ids.index(k)].sum()) - 1 if k in good else 0, comp[k], comp[k] == k) for k, _ in rows)
    for piece, group, leaf in ((1024, 16, 512), (16, 3, 4)):
        monkeypatch.setattr(vectors, "LEAF", leaf)
        got = vectors.near_vectors(df, piece, group)
        assert sorted(map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect())) == want


def test_vectors_are_told_apart_where_digests_collide(spark, monkeypatch):
    monkeypatch.setattr(vectors, "_digests", lambda e: (F.lit(1).cast("long").alias("h1"), F.lit(2).cast("long").alias("h2")))
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (3, [0.0, -1.0]), (9, [0.0, -2.0])]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, True), (2, 0, 2, True), (3, 1, 1, False), (3, 1, 3, True), (9, 1, 3, False)]


def test_digests_of_a_vector_are_independent(spark):
    a, b = spark.range(1).select(*vectors._digests(F.array(F.lit(1.0), F.lit(2.0)))).first()
    assert a != b and b != spark.range(1).select(F.xxhash64(F.array(F.lit(1.0), F.lit(2.0)), F.lit(7))).first()[0]


def test_pipeline(spark):
    """Each stage on its own input, against brute force; the models' decisions against their own operators."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    stages = dict(p.STAGES)
    assert [n for n, _ in p.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "mixing"]
    a = stages["toxicity"](spark, docs, MIDDLE)
    assert a.columns == docs.columns and ids(a) == ids(toxicity.toxicity_scores(docs, labels).where("predicted = 0"))
    a = spark.createDataFrame(a.collect(), docs.schema)
    b = stages["quality"](spark, a, MIDDLE)
    assert ids(b) == ids(quality.quality_scores(a, labels).where("predicted = 1"))
    b = spark.createDataFrame(b.collect(), docs.schema)
    c = stages["near_duplicates"](spark, b, MIDDLE)
    text = [(r["doc_id"], r["text"]) for r in b.collect()]
    small = text[:250]
    few = stages["near_duplicates"](spark, b.where(F.col("doc_id").isin([d for d, _ in small])), MIDDLE)
    assert ids(few) == [d for d, _, _, k in near_components(small) if k]
    c = spark.createDataFrame(c.collect(), docs.schema)
    d = stages["decontamination"](spark, c, MIDDLE)
    items = [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").collect()]
    want = [r[0] for r in contaminated([(r["doc_id"], r["text"]) for r in c.collect()], items) if not r[5]]
    assert ids(d) == sorted(want) and d.columns == docs.columns
    d = spark.createDataFrame(d.collect(), docs.schema)
    e = stages["mixing"](spark, d, MIDDLE).toPandas()
    source = {r["doc_id"]: r["source"] for r in d.collect()}
    sizes = e.groupby(e["doc_id"].map(source))["size"].sum().to_dict()
    for s, t in water(sizes).items():
        mine = e[e["doc_id"].map(source) == s]
        assert abs(mine["target"].iloc[0] - t) < 1e-6 and abs(mine["taken"].sum() - t) <= mine["size"].max() / 2 + 1e-6
    whole = p.run(spark, MIDDLE).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert whole.equals(e.sort_values("doc_id").reset_index(drop=True)[whole.columns])
