"""Connected components against union-find."""

import numpy as np
import pytest

from partslake.llm.components import components


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components(spark, rows, kind):
    rng = np.random.default_rng(4)
    edges = {
        "random": [tuple(map(int, rng.integers(-60, 60, 2))) for _ in range(70)],
        "chain": [(i, i + 1) for i in rng.permutation(50).tolist()],
        "star": [(30, i) for i in range(60)] + [(5, 5)],
        "none": [(1, 1)],
    }[kind]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = [tuple(r) for r in components(rows(edges, "a long, b long")).select("node", "root").collect()]
    assert sorted(got) == sorted((x, find(x)) for x in linked)
