"""Exact top-k against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from partslake.llm import topk as T


def brute(data, k):
    rows = [(i, [math.floor(float(np.float32(c)) * 256) for c in x]) for i, x in data if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    asked = {}
    for i, x in rows:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, x), x)
    out = []
    for i, x in asked.items():
        found = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in rows if j != i and len(y) == len(x))
        out += [(i, r, j, -s) for r, (s, j) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["normal", "sparse", "ties", "one"])
def test_equals_all_pairs(spark, rows, kind, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_ROWS", 64)
    monkeypatch.setattr(T, "QUERY_ROWS", 3)
    monkeypatch.setattr(T, "QUERY_BLOCKS", 2)
    rng = np.random.default_rng(5)
    n = 4 if kind == "one" else 700
    x = rng.normal(size=(n, 16)) / 4
    if kind == "sparse":
        x[rng.random(x.shape) < 0.8] = 0
    if kind == "ties":
        x = np.round(x * 2) / 8
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    data += [(10_000, None), (10_050, [1.0, None] + [0.0] * 14), (10_100, [float("nan")] * 16), (10_150, [float("inf")] * 16), (None, [1.0] * 16)]
    data += [(20_000, [0.5, 0.25]), (20_001, [0.5, -0.25]), (20_050, []), (7, x[3].tolist()), (50, x[2].tolist())]
    df = rows(data, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as x", "3 as score").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in T.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute(data, 5)


def test_search_stops_early_on_clustered_vectors():
    """The proof is reached before the last level, so only few vectors are scored exactly."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 32))
    x = np.floor((centre[rng.integers(40, size=2000)] + rng.normal(size=(2000, 32)) * 0.05) * 256).astype(np.int64)
    block = T.Block(np.arange(2000), x)
    row, col, score = block.search(np.arange(5), x[:5], 5)
    full = x[:5] @ x.T
    for q in range(5):
        want = sorted((-int(s), j) for j, s in enumerate(full[q]) if j != q)[:5]
        assert [(-int(s), int(j)) for r, j, s in zip(row, col, score) if r == q] == want


def test_empty(spark, rows):
    assert T.top_k(rows([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0
