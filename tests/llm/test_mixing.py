from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing

FOLDER = "/root/testdata/sf0.01"
WEIGHTS = {"good": 0.85, "poor": 0.09, "toxic": 0.06}


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = mixing.quality_domains(spark.read.parquet(f"{FOLDER}/labels.parquet"))
    return docs, labels


def split(text):
    flat = "".join(" " if c in "\n\t\r" else c for c in (text or "").lower())
    return [w for w in flat.split(" ") if w]


def test_posteriors_equal_a_plain_bayes(corpus):
    docs, labels = corpus
    c = mixing.fit_classifier(docs, labels, features=20)
    assert c.domains == ["good", "poor", "toxic"] and len(c.weights) == 20
    bag = {r.doc_id: set(split(r.text)) for r in docs.select("doc_id", "text").collect()}
    marked = {r.doc_id: r.domain for r in labels.collect()}
    size = [sum(d == k for d in marked.values()) for k in c.domains]
    words = [sum(len(bag[i]) for i, d in marked.items() if d == k) for k in c.domains]
    for r in mixing.posteriors(docs, c).select("doc_id", "__tokens", "__p", "text").limit(60).collect():
        logit = [math.log(v / sum(size)) for v in size]
        here = set(c.weights) & bag[r.doc_id]
        for k, d in enumerate(c.domains):
            own = [not set(c.weights) & bag[i] for i, x in marked.items() if x == d]
            bare = (sum(own) + 0.5) / (len(own) + 1)
            logit[k] += math.log(1 - bare if here else bare)
        for w in here:
            n = [sum(w in bag[i] for i, x in marked.items() if x == d) for d in c.domains]
            for k in range(3):
                logit[k] += math.log((n[k] + 0.5) / (words[k] + 1) / ((sum(n) + 0.5) / (sum(words) + 1)))
        p = np.exp(np.array(logit) - max(logit))
        assert np.allclose(r["__p"], p / p.sum(), atol=1e-9)
        assert r["__tokens"] == len(split(r.text))


def test_classifier_on_unseen_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = mixing.quality_domains(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    c = mixing.fit_classifier(docs, labels.filter(~part))
    best = F.array_position("__p", F.array_max("__p")) - 1
    got = mixing.posteriors(docs, c).withColumn("guess", F.lit(c.domains)[best.cast("int")]).join(labels.filter(part), "doc_id")
    rows = got.select("guess", "domain").collect()
    assert np.mean([r.guess == r.domain for r in rows]) > 0.85


def plain_rates(p, t, targets, step_rows):
    """The same least squares by plain projected gradient in numpy."""
    r = np.ones(len(t))
    scale = (t[:, None] * p).sum(axis=0)
    m = np.einsum("i,ij,ik->jk", t, p, p) / np.sqrt(scale[:, None] * scale[None, :])
    step = 1 / m.sum(axis=1).max()
    last, pace = r, 1.0
    for _ in range(step_rows):
        new = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        y = r + (pace - 1) / new * (r - last)
        pace = new
        s = ((y * t)[:, None] * p).sum(axis=0)
        r, last = np.maximum(0, y - p @ (step * (s - targets) / scale)), r
    return r


def test_rates_equal_plain_projected_gradient(spark, corpus):
    docs, labels = corpus
    table = mixing.rates_table(docs, labels, WEIGHTS, 1.25).collect()
    p = np.array([[r.p_good, r.p_poor, r.p_toxic] for r in table])
    t = np.array([r.n_tokens for r in table], float)
    rate = np.array([r.rate for r in table])
    targets = 1.25 * t.sum() * np.array([WEIGHTS[k] for k in ("good", "poor", "toxic")])
    assert (rate >= 0).all()
    scale = (t[:, None] * p).sum(axis=0)

    def loss(r):
        return (((((r * t)[:, None] * p).sum(axis=0) - targets) ** 2) / scale).sum() / targets.sum()

    assert loss(rate) <= loss(plain_rates(p, t, targets, 2000)) + 1e-4 < loss(np.ones(len(t))) / 50
    best = min(np.abs(plain_rates(p, t, targets, n) - rate).max() for n in range(mixing.STEPS + 1))
    assert best < 1e-6
    copies = np.array([r.copies for r in table])
    assert (np.abs(copies - rate) < 1).all()
    assert abs((copies * t).sum() / (rate * t).sum() - 1) < 0.1


def test_targets_are_met(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = mixing.quality_domains(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    c = mixing.fit_classifier(docs, labels)
    p = mixing.posteriors(docs, c).select(F.col("__tokens").alias("tokens"), F.col("__p").alias("p"))
    rates = mixing.fit_rates(p, c, WEIGHTS, 1.25)
    assert np.allclose(rates.totals, rates.targets, rtol=5e-3)


def test_mix_repeats_rows(corpus):
    docs, labels = corpus
    got = mixing.mix(docs, labels, WEIGHTS, 1.25)
    assert got.columns == docs.columns
    n = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    want = {r.doc_id: r.copies for r in mixing.rates_table(docs, labels, WEIGHTS, 1.25).collect() if r.copies}
    assert n == want


def test_edges(spark, corpus):
    _, labels = corpus
    schema = "doc_id long, text string, __x int, tokens string"
    rows = [(1, None, 1, "a"), (2, "", 1, None), (None, "some words", None, "p"), (3, "w " * 30_000, 2, "n"), (3, "w " * 30_000, 2, "n")]
    df = spark.createDataFrame(rows, schema)
    own = spark.createDataFrame([(3, "good"), (2, "poor"), (None, "poor"), (1, None)], "doc_id long, domain string")
    got = mixing.rates_table(df, own, WEIGHTS).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 2, 30_000, 30_000]
    assert all(r.rate >= 0 for r in got)
    assert mixing.mix(df, own, WEIGHTS).columns == df.columns
    assert mixing.mix(df, own.limit(0), WEIGHTS).count() == 5
    assert mixing.rates_table(df.limit(0), labels, WEIGHTS).collect() == []
    assert mixing.mix(df.limit(0), own, WEIGHTS).collect() == []


def test_no_python_in_the_plan(corpus):
    docs, labels = corpus
    plan = mixing.rates_table(docs, labels, WEIGHTS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
