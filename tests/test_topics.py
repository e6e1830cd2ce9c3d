"""Topic models and sparse clusters against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom import scale
from textloom.operators import features, topics


def entries(spark, seed=1, docs=24, terms=15):
    draw = random.Random(seed)
    rows = {}
    for d in range(docs):
        for _ in range(draw.randrange(1, 25)):
            t = f"t{draw.randrange(terms) // (1 + d % 2)}"
            rows[d, t] = rows.get((d, t), 0) + 1
    return spark.createDataFrame([(d, t, n) for (d, t), n in rows.items()], "doc long, term string, tf long"), rows


def start(term, topic):
    return 0.5 + (F.substring(term, 2, 9).cast("int") * (topic + 2)) % 7 / F.lit(7.0)


def plain_digamma(x):
    h = 1e-4 * max(1.0, x)
    return (math.lgamma(x - 2 * h) - 8 * math.lgamma(x - h) + 8 * math.lgamma(x + h) - math.lgamma(x + 2 * h)) / (12 * h)


def plain_lda(rows, k, rounds, alpha, eta):
    docs, terms = sorted({d for d, _ in rows}), sorted({t for _, t in rows})
    n = np.array([[rows.get((d, t), 0) for t in terms] for d in docs], float)
    weight = np.array([[0.5 + (int(t[1:]) * (i + 2)) % 7 / 7.0 for i in range(k)] for t in terms])
    gamma = np.repeat(alpha + n.sum(axis=1, keepdims=True) / k, k, axis=1)
    psi = np.vectorize(plain_digamma)
    for _ in range(rounds):
        b, e = np.exp(psi(weight) - psi(weight.sum(axis=0))), np.exp(psi(gamma) - psi(gamma.sum(axis=1, keepdims=True)))
        p = e[:, None, :] * b[None, :, :]
        p = n[:, :, None] * p / p.sum(axis=2, keepdims=True)
        gamma, weight = alpha + p.sum(axis=1), eta + p.sum(axis=0)
    return docs, terms, gamma, weight


def test_digamma(spark):
    points = [1e-6, 0.01, 0.25, 1.0, 1.4616321449683623, 3.5, 40.0, 1e6]
    df = spark.createDataFrame([(x,) for x in points], "x double")
    got = [r[0] for r in df.select(topics.digamma(F.col("x"))).collect()]
    assert got[3] == pytest.approx(-0.5772156649015329, abs=1e-9) and got[4] == pytest.approx(0.0, abs=1e-9)
    assert got[0] == pytest.approx(-1e6 - 0.5772140200, rel=1e-12)
    assert got[5:] == pytest.approx([1.1031566406452432, 3.676327, math.log(1e6) - 5e-7], abs=1e-6)


@pytest.mark.parametrize("hot", [False, True], ids=["broadcast", "salted"])
def test_variational_updates(spark, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(scale, "fits", lambda *a, **k: False)
        monkeypatch.setattr(topics, "Salted", lambda big, on, **k: scale.Salted(big, on, rows_per_task=5))
    df, rows = entries(spark)
    model = topics.lda(df, topics=3, rounds=4, alpha=0.3, eta=0.2, start=start)
    docs, terms, gamma, weight = plain_lda(rows, 3, 4, 0.3, 0.2)
    shares = {r["doc"]: r["distribution"] for r in model.distributions().collect()}
    assert sorted(shares) == docs
    for d, g in zip(docs, gamma):
        assert np.allclose(shares[d], g / g.sum(), atol=1e-6) and abs(sum(shares[d]) - 1) < 1e-9
    words = {(r["term"], r["topic"]): r["weight"] for r in model.term_shares().collect()}
    for i, t in enumerate(terms):
        for k in range(3):
            assert words[t, k] == pytest.approx(weight[i, k] / weight[:, k].sum(), abs=1e-6)
    heavy = features.top_words(model.term_shares(), ["topic"], 4).collect()
    assert len(heavy) == 12 and all(0 <= r["weight"] <= 1 for r in heavy)


def test_topics_are_told_apart(spark):
    texts = ["apple pie tart", "apple tart sugar", "engine wheel car", "car wheel road"] * 6
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    model = topics.lda(features.term_counts(df, "id", "text"), topics=2, rounds=15)
    found = {r["doc"]: r["topic"] for r in features.with_topic(model.distributions(), "distribution").collect()}
    assert len({found[i] for i in range(24) if i % 4 < 2}) == 1 and len({found[i] for i in range(24) if i % 4 > 1}) == 1
    assert found[0] != found[2]
    new = spark.createDataFrame([(100, "sugar"), (101, "road engine"), (102, "unknown")], "id long, text string")
    moved = topics.transform(model, features.term_counts(new, "id", "text"), 5)
    named = {r["doc"]: r["topic"] for r in features.with_topic(moved.distributions(), "distribution").collect()}
    assert named == {100: found[0], 101: found[2]}


def test_topics_of_nothing(spark):
    none = spark.createDataFrame([], "doc long, term string, tf long")
    model = topics.lda(none, topics=2, rounds=1)
    assert model.distributions().count() == 0 and model.term_shares().count() == 0


@pytest.mark.parametrize("hot", [False, True], ids=["broadcast", "salted"])
def test_sparse_clusters_are_those_of_dense_steps(spark, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(scale, "fits", lambda *a, **k: False)
        monkeypatch.setattr(topics, "Salted", lambda big, on, **k: scale.Salted(big, on, rows_per_task=5))
    df, rows = entries(spark, seed=5, docs=40, terms=30)
    weights = df.select("doc", "term", (F.col("tf") / 3.0).alias("weight"))
    docs, terms = sorted({d for d, _ in rows}), sorted({t for _, t in rows})
    x = np.array([[rows.get((d, t), 0) / 3.0 for t in terms] for d in docs])
    centres = x[:4].copy()

    def nearest():
        return np.argmax(np.round(2 * x @ centres.T - (centres**2).sum(axis=1), 9), axis=1)

    for _ in range(3):
        own = nearest()
        centres = np.array([x[own == i].mean(axis=0) if (own == i).any() else centres[i] for i in range(4)])
    starts = spark.createDataFrame([(i, docs[i]) for i in range(4)], "cluster_id int, doc long")
    got = {r["doc"]: r["cluster_id"] for r in topics.sparse_kmeans(weights, starts, 3).collect()}
    assert got == dict(zip(docs, nearest().tolist()))
    assert topics.sparse_kmeans(weights.limit(0), starts, 1).count() == 0
