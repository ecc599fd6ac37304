import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from partslake.operators import metric as M

VEC = "row_id long, label string, vec array<float>"
ASKED = "id long, vec array<float>"


def clustered(rng, clusters, each, spread=0.05, size=16):
    centres = rng.normal(size=(clusters, size))
    m = np.repeat(centres, each, axis=0) + spread * rng.normal(size=(clusters * each, size))
    return m.astype(np.float32).astype(float)


def table(rows, m):
    return rows([(j, f"L{j}", v.tolist()) for j, v in enumerate(m)], VEC)


def brute(asked, cached, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    d = 1 - unit(asked) @ unit(cached).T
    return {i: [round(x, 6) for x in np.sort(row)[:k]] for i, row in enumerate(d)}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["id"], r["rank"])):
        out.setdefault(r["id"], []).append(round(r["distance"], 6))
    return out


@pytest.mark.parametrize("clusters", [4, 16])
def test_fewer_cells_are_visited_as_the_cache_grows(rows, clusters):
    """On clustered vectors the share of (query, cell) pairs that is searched falls."""
    rng = np.random.default_rng(5)
    cached = clustered(rng, clusters, 50)
    asked = cached[::25] + 0.01
    cells = M.cells_of(table(rows, cached), cell_rows=25)
    near, rest = M.visits(cells, rows([(i, v.tolist()) for i, v in enumerate(asked)], ASKED), 3)
    share = (len(asked) + rest.count()) / (len(asked) * cells.sizes.count())
    assert share < {4: 0.7, 16: 0.25}[clusters]


def test_two_levels_equal_brute_force(rows):
    rng = np.random.default_rng(6)
    cached = clustered(rng, 8, 20)
    # unlike any cluster, and a third copies of one vector
    cached = np.vstack([cached, rng.normal(size=(20, 16)), np.repeat(cached[:1], 90, axis=0)]).astype(np.float32).astype(float)
    asked = np.vstack([cached[::17], rng.normal(size=(10, 16))]).astype(np.float32).astype(float)
    cache = table(rows, cached)
    cells = M.cells_of(cache, block_rows=32, cell_rows=16, fanout=4)
    assert cells.below is not None and cells.below.count() > 4
    got = M.nearest(rows([(i, v.tolist()) for i, v in enumerate(asked)], ASKED), cache, 5, block_rows=32, cell_rows=16, fanout=4)
    assert found(got) == brute(asked, cached, 5)


def test_every_row_has_one_cell(rows):
    m = clustered(np.random.default_rng(7), 5, 30)
    cells = M.cells_of(table(rows, m), cell_rows=10, fanout=4)
    assert cells.rows.count() == cells.rows.select("row_id").distinct().count() == 150
    assert cells.sizes.agg(F.sum("n")).first()[0] == 150


def test_zero_vectors_and_fewer_rows_than_k(rows):
    """A zero vector is at distance 1 from all."""
    cache = table(rows, np.array([[0.0, 0.0], [1.0, 0.0], [-1.0, 0.0]]))
    asked = rows([(1, [2.0, 0.0]), (2, [0.0, 0.0])], ASKED)
    got = M.nearest(asked, cache, 5, cell_rows=1)
    assert found(got) == {1: [0.0, 1.0, 2.0], 2: [1.0, 1.0, 1.0]}


def test_ties_go_to_the_smaller_row_in_other_cells(rows):
    cache = table(rows, np.array([[0.0, 1.0], [0.0, -1.0], [0.0, 1.0], [0.0, -1.0]]))
    got = M.nearest(rows([(1, [1.0, 0.0])], ASKED), cache, 2, cell_rows=1).collect()
    assert sorted((r["rank"], r["row_id"]) for r in got) == [(1, 0), (2, 1)]


def test_empty_tables(rows):
    cache, asked = table(rows, np.eye(2)), rows([(1, [1.0, 0.0])], ASKED)
    assert M.nearest(asked.filter("false"), cache).count() == 0
    assert M.nearest(asked, cache.filter("false")).count() == 0


def test_memory_of_a_block_and_of_a_batch_is_bounded():
    """Copies of one vector tie with all rows, and a batch without clusters visits all cells."""
    n, size = M.BLOCK_ROWS, 8
    rng = np.random.default_rng(8)
    copies = [np.ones(size)] * n
    qs = pd.DataFrame({"id": range(n), "vec": copies, "most": np.inf})
    cs = pd.DataFrame({"row_id": range(n), "label": ["L"] * n, "vec": copies})
    batch = pd.DataFrame({"id": range(10_000), "vec": list(rng.normal(size=(10_000, size))), "bound": 2.0})
    points = M.unit(pd.Series(list(rng.normal(size=(M.FANOUT, size)))))
    tracemalloc.start()
    out = M.nearest_in_block(qs, cs, 3)
    asked = M._within_bound(batch, points, np.full(M.FANOUT, 2.0), np.arange(M.FANOUT))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["row_id"].tolist() == [0, 1, 2] * n
    # a row of the batch comes once, with its cells in a list
    assert len(asked) == len(batch) and asked["cells"].map(len).eq(M.FANOUT).all()
    assert peak < 200e6


def test_one_cell_has_no_join_without_a_key(rows):
    """A small cache is one cell; its queries and rows still fall into blocks, and the result is that of brute force."""
    rng = np.random.default_rng(11)
    cached, asked = (rng.normal(size=(n, 8)).astype(np.float32).astype(float) for n in (40, 30))
    got = M.nearest(rows([(i, v.tolist()) for i, v in enumerate(asked)], ASKED), table(rows, cached), 3, block_rows=16)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found(got) == brute(asked, cached, 3)
