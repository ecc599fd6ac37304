"""Mixing against a plain restatement, and its budgets."""

import math
from collections import Counter, defaultdict

import pytest

from partslake.llm import mixing as M


def docs_of(rows):
    data = [(i, "w " * (1 + i % 7), "big") for i in range(300)] + [(1000 + i, "w w w", "mid") for i in range(60)]
    data += [(2000 + i, "w " * 5, None) for i in range(20)] + [(3000, "", "none"), (3001, None, "none"), (None, "w w", "mid"), (7, "w " * 8, "big")]
    return rows(data, "doc_id long, text string, source string"), data


def shares(data):
    n = Counter()
    for _, t, s in data:
        n[s] += len((t or "").split())
    return n


def test_every_document_stays_and_repetition_is_met(spark, rows):
    docs, data = docs_of(rows)
    out = M.mixing(docs.selectExpr("*", "1 as _nothing", "2 as weight", "3 as pass")).collect()
    drawn = Counter((r.doc_id, r.source, r.n_tokens) for r in out)
    n = shares(data)
    total = sum(n.values())
    low, high = 0.0, 1.0
    for _ in range(60):
        t = (low + high) / 2
        rate = [(v / total) ** (t - 1) for v in n.values() if v]
        low, high = (low, t) if max(rate) / min(rate) <= 2.0 else (t, high)
    w = {s: (v / total) ** high for s, v in n.items() if v}
    z = sum(w.values())
    base = min(w[s] / z / (v / total) for s, v in n.items() if v)
    passes = {s: w[s] / z / (n[s] / total) / base for s in w}
    assert max(passes.values()) == pytest.approx(2.0) and min(passes.values()) == pytest.approx(1.0)
    got = defaultdict(int)
    for r in out:
        got[r.source] += r.n_tokens
        if r.source != "none":
            assert r.passes == pytest.approx(passes[r.source]) and r.weight == pytest.approx(w[r.source] / z)
    for i, t, s in data:
        assert drawn[(i, s, len((t or "").split()))] >= 1
    for s in passes:  # within the budget, and short of it by less than a document
        assert passes[s] * n[s] - 9 < got[s] <= passes[s] * n[s] + 1e-6
    assert all(v <= 3 for v in drawn.values())


def test_budget_and_entropy(spark, rows):
    docs, data = docs_of(rows)
    n = shares(data)
    full = -sum(v / sum(n.values()) * math.log(v / sum(n.values())) for v in n.values() if v)
    target = (full + math.log(3)) / 2
    out = M.mix(docs, max_passes=None, entropy=target, budget=600).select("source", "_tokens", "_plan.weight", "_pass").collect()
    weights = {r.source: r.weight for r in out if r.source != "none"}
    assert -sum(w * math.log(w) for w in weights.values()) == pytest.approx(target, abs=1e-6)
    got = Counter()
    for r in out:
        got[r.source] += r._tokens
    for s, w in weights.items():
        assert w * 600 - 9 < got[s] <= w * 600 + 1e-6


def test_same_draws_every_time_and_in_any_partitioning(spark, rows):
    docs, _ = docs_of(rows)
    a, b = (Counter(map(tuple, M.mixing(d).select("doc_id", "source", "pass", "block").collect())) for d in (docs.repartition(1), docs.repartition(7)))
    assert a == b


def test_empty_and_wrong_arguments(spark, rows):
    assert M.mixing(rows([], "doc_id long, text string, source string")).count() == 0
    with pytest.raises(ValueError):
        M.source_plan(rows([], "source string, tokens long"), max_passes=None)


def test_plan_is_native(spark, rows):
    plan = M.mixing(docs_of(rows)[0])._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow", "CartesianProduct", "NestedLoop"))
