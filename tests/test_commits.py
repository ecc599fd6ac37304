"""Keyed tables under one log of commits: whole or not at all, few files read, merged under readers."""

import random

import pytest

from partslake.sources import commits as C
from tests.conftest import tuples

SCHEMA = "bin string, part string, qty long"


@pytest.fixture
def store(spark, rows, tmp_path):
    root = str(tmp_path / "store")
    stock = rows([("b", f"P{i}", i) for i in range(200)], SCHEMA)
    log = rows([], "seq long, what string")
    C.create(spark, root, {"stock": (stock, ["bin", "part"]), "log": (log, [])}, buckets=4)
    return root


def stock_of(spark, root):
    return {(r.bin, r.part): r.qty for r in C.read(spark, root, "stock").collect()}


def test_changes_removals_and_growing_rows(spark, rows, store):
    C.commit(spark, store, {"stock": rows([("b", "P1", 100), ("c", "N", 5)], SCHEMA), "log": rows([(1, "a")], "seq long, what string")})
    C.commit(spark, store, {"log": rows([(2, "b")], "seq long, what string")}, removed={"stock": rows([("b", "P2")], "bin string, part string")})
    got = stock_of(spark, store)
    assert got[("b", "P1")] == 100 and got[("c", "N")] == 5 and ("b", "P2") not in got and len(got) == 200
    assert tuples(C.read(spark, store, "log")) == [(1, "a"), (2, "b")]
    back = rows([("b", "P2", 7)], SCHEMA)
    C.commit(spark, store, {"stock": back})
    assert stock_of(spark, store)[("b", "P2")] == 7


def test_a_batch_counts_once(spark, rows, store):
    one = {"log": rows([(1, "a")], "seq long, what string")}
    assert C.commit(spark, store, one, writer="s", batch=0) == C.commit(spark, store, one, writer="s", batch=0) == 1
    assert C.commit(spark, store, one, writer="other", batch=0) == 2
    assert C.read(spark, store, "log").count() == 2


@pytest.mark.parametrize("gap", range(3))
def test_a_failure_at_any_point_leaves_the_old_state(spark, rows, store, monkeypatch, gap):
    changes = {"stock": rows([("b", "P1", -1)], SCHEMA), "log": rows([(1, "a")], "seq long, what string")}
    steps, real_layer, real_publish = [], C._write_layer, C._publish

    def failing(real):
        def call(*args, **kwargs):
            steps.append(real)
            if len(steps) > gap:
                raise RuntimeError("lost")
            return real(*args, **kwargs)

        return call

    monkeypatch.setattr(C, "_write_layer", failing(real_layer))
    monkeypatch.setattr(C, "_publish", failing(real_publish))
    with pytest.raises(RuntimeError):
        C.commit(spark, store, changes, writer="s", batch=4)
    monkeypatch.undo()
    assert stock_of(spark, store)[("b", "P1")] == 1 and C.read(spark, store, "log").isEmpty()
    C.commit(spark, store, changes, writer="s", batch=4)
    assert stock_of(spark, store)[("b", "P1")] == -1 and tuples(C.read(spark, store, "log")) == [(1, "a")]
    if gap:
        assert C.vacuum(spark, store, keep=0) >= 1
        assert stock_of(spark, store)[("b", "P1")] == -1


def test_few_files_are_read_and_merging_spares_readers(spark, rows, store):
    rng = random.Random(2)
    want = stock_of(spark, store)
    before = C.read(spark, store, "stock")  # a reader that outlives what follows
    first = dict(want)
    for n in range(30):
        part = f"P{rng.randrange(200)}"
        want[("b", part)] = 1000 + n
        C.commit(spark, store, {"stock": rows([("b", part, 1000 + n)], SCHEMA)})
    keys = [("b", "P3"), ("b", "P77"), ("b", "nobody")]
    wanted = rows(keys, "bin string, part string")
    live = C._index(spark, store, "stock", C.newest(spark, store)["tables"]["stock"]).count()
    read = C.files_with(wanted, store, "stock")
    changed = sum(1 for k in keys if want.get(k, 0) >= 1000)
    assert live > 30 and len(read) <= 2 + changed + 3  # two base files, one file per change, and few by mistake
    assert {(r.bin, r.part): r.qty for r in C.read_keys(wanted, store, "stock").collect()} == {k: want[k] for k in keys if k in want}

    assert C.compact(spark, store, "stock", files=3) == 4
    assert C._index(spark, store, "stock", C.newest(spark, store)["tables"]["stock"]).count() == 4
    assert stock_of(spark, store) == want
    assert {(r.bin, r.part): r.qty for r in before.collect()} == first
    assert C.compact(spark, store, "stock", files=3) == 0
    assert C.vacuum(spark, store, keep=0) > 50
    assert stock_of(spark, store) == want and C.newest(spark, store)["commit"] == 31


def test_filters_have_no_false_no(rows):
    import numpy as np

    rng = np.random.default_rng(1)
    held = rng.integers(-(1 << 63), (1 << 63) - 1, 5000)
    bloom = C._filter_of(held)
    assert all(C._may_hold(bloom, held[i : i + 1]) for i in range(0, 5000, 7))
    others = rng.integers(-(1 << 63), (1 << 63) - 1, 2000)
    assert sum(C._may_hold(bloom, others[i : i + 1]) for i in range(2000)) < 100
