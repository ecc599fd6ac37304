"""Toxicity on held-out labels, and its descent against plain FTRL."""

import math
from collections import defaultdict

import numpy as np
import pytest

from partslake.llm import toxicity as X


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = X.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert out.count() == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic) > 50
    assert sum(r.predicted for r in clean) <= 0.005 * len(clean)


def test_descent_equals_plain_ftrl():
    rng = np.random.default_rng(2)
    bias = 1 << X.BITS
    rows = [(np.append(np.unique(rng.integers(0, 40, 12)) + (bias >> 1) * (k % 2), bias), int(rng.random() < 0.4)) for k in range(60)]
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == bias else X.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((X.BETA + math.sqrt(n[i])) / X.ALPHA + X.L2)

    value = lambda i: X.PAIR if bias > i >= bias >> 1 else 1.0
    for _ in range(X.EPOCHS):
        for features, label in rows:
            w = {i: weight(i) for i in features}
            p = 1 / (1 + math.exp(-sum(w[i] * value(i) for i in features)))
            for i in features:
                g = (p - label) * value(i)
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / X.ALPHA * w[i]
                n[i] += g * g
    index, weights, b = X.descend(rows)
    want = {i: weight(i) for i in z if i != bias and weight(i)}
    assert dict(zip(index.tolist(), weights.tolist())) == pytest.approx(want) and b == pytest.approx(weight(bias))


def test_edge_rows(spark, rows):
    clean, bad = "a quiet day by the river", "you foul beast of a day"
    data = [(i, bad if i % 3 == 0 else clean) for i in range(60)] + [(100, None), (101, ""), (102, " .,! "), (None, bad), (103, clean + " river" * 100_000), (0, bad)]
    labels = [(i, int(i % 3 == 0)) for i in range(60)] + [(0, 0), (1, None), (None, 1), (5, 7), (999, 1), (2, 0), (2, 0)]
    docs = rows(data, "doc_id long, text string").selectExpr("*", "1 as score", "'x' as toxic", "2 as predicted")
    out = X.toxicity(docs, rows(labels, "doc_id long, toxic int").selectExpr("*", "'y' as text"), fold=None).collect()
    assert len(out) == len(data) and not any(r.held_out for r in out)
    got = {r.doc_id: r for r in out}
    assert got[100].score == got[101].score == got[102].score < 0.7
    assert got[3].predicted == got[None].predicted == 1 and got[1].predicted == got[103].predicted == 0


def test_nothing_to_learn(spark, rows):
    none = rows([], "doc_id long, toxic int")
    assert X.toxicity(rows([], "doc_id long, text string"), none).count() == 0
    (r,) = X.toxicity(rows([(1, "abc")], "doc_id long, text string"), none).collect()
    assert (r.score, r.predicted) == (0.0, 0)
