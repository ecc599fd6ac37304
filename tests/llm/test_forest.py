"""Near-duplicates of the LSH forest against the similarity of every pair of texts."""

import random

import numpy as np
import pytest

from partslake.llm import forest as N

PARAMETERS = [(3, (85, 100)), (5, (4, 5))]


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def plain(data, width, similar):
    """(id, size of the set, smallest id reachable) of each row of (id, text)."""
    low = {}
    for i, t in data:
        s = shingles(t, width)
        low[s] = min(low.get(s, i), i)
    root = {s: s for s in low}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    links, sets = 0, sorted(low, key=len)
    for k, x in enumerate(sets):
        for y in sets[k + 1 :]:
            if not x or similar[1] * len(x) < similar[0] * len(y):
                break
            both = len(x & y)
            if similar[1] * both >= similar[0] * (len(x) + len(y) - both):
                a, b = sorted((find(x), find(y)), key=low.get)
                root[b] = a
                links += 1
    return sorted((i, len(shingles(t, width)), low[find(shingles(t, width))] if shingles(t, width) else i) for i, t in data), links


def corpus(groups=60, spread=8):
    """Texts with copies at any number of changed words, and with passages that all share."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(3000)}"
    shared = [[word() for _ in range(60)] for _ in range(3)]
    texts = ["", " \n", None, None, "one", "One", "a b", "a b c", "a b c d", "A b c d", "a b c d e", "x" * 200_000, "x " * 5000]
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(5, 150))] + rng.choice(shared)
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randrange(0, spread)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = [word()]
            texts.append(" ".join(copy[: rng.randrange(len(copy) * 4 // 5, len(copy) + 1)]))
    base = [word() for _ in range(150)]
    for _ in range(80):  # one large group: a chain of small changes, and copies
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = word()
        texts += [" ".join(copy)] * rng.choice([1, 1, 3])
    order = list(range(len(texts)))
    rng.shuffle(order)
    return list(zip(order, texts))


def found(spark, rows, data, width, similar):
    docs = rows([(i, t, 1, 2, 3) for i, t in data], "doc_id long, text string, node int, n int, region int").repartition(5)
    out = N.near_duplicates(docs, width=width, similar=similar).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in out)


@pytest.mark.parametrize("width, similar", PARAMETERS)
def test_equals_brute_force(spark, rows, width, similar):
    data = corpus()
    want, links = plain(data, width, similar)
    assert links > 100
    assert found(spark, rows, data, width, similar) == want


@pytest.mark.parametrize("limits", [{"DENSE": 0, "BLOCK": 16}, {"SLICE": 20, "REGION": 8, "LEADERS": 4, "BLOCK": 32}])
def test_dense_and_sliced_regions(spark, rows, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(N, name, value)
    data = corpus(20)
    want, _ = plain(data, *PARAMETERS[0])
    assert found(spark, rows, data, *PARAMETERS[0]) == want


def test_a_centre_whose_copies_are_not_alike(spark, rows, monkeypatch):
    """Copies at 0.87 to 0.9 of one text, at less than 0.85 of each other, whose centre has the largest id."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(9000)}" for _ in range(300)]
    data = []
    for i in range(40):
        copy = list(base)
        for k in range(6):
            copy[7 * i + 3 + (k * 53) % 290 if 7 * i + 3 + (k * 53) % 290 < 300 else k * 53] = f"new{i}"
        data.append((i, " ".join(copy)))
    data.append((99, " ".join(base)))
    want, _ = plain(data, *PARAMETERS[0])
    assert found(spark, rows, data, *PARAMETERS[0]) == want
    monkeypatch.setattr(N, "DENSE", 0)
    assert found(spark, rows, data, *PARAMETERS[0]) == want


def test_null_ids_shared_ids_and_empty_tables(spark, rows):
    schema = "doc_id long, text string"
    assert N.near_duplicates(rows([], schema)).collect() == []
    text = " ".join(f"w{i}" for i in range(40))
    data = [(None, text), (4, text), (4, "other words here"), (9, text), (None, "alone in here"), (None, None), (2, "other words here"), (2, "other words here")]
    got = sorted(map(tuple, N.near_duplicates(rows(data, schema)).collect()), key=repr)
    assert got == sorted([(None, 38, 4, False), (4, 38, 4, True), (4, 1, 2, False), (9, 38, 4, False), (None, 1, None, True), (None, 0, None, True), (2, 1, 2, True), (2, 1, 2, True)], key=repr)
    one = lambda data: sorted(map(tuple, N.one_of_each(rows(data, schema), width=3, similar=(85, 100)).collect()), key=repr)
    assert one([]) == []
    # rows that only share an id both stay, copies with a null id are one
    assert one([(1, text), (1, "other words here"), (None, "alone in here"), (None, "alone in here"), (3, None), (5, "")]) == sorted(
        [(1, text), (1, "other words here"), (None, "alone in here"), (3, None)], key=repr
    )


def test_recall_of_the_trees_by_similarity():
    """Signatures of sets of 0.85 meet in a prefix of four minima, and their sketches differ in few bits."""
    rng = np.random.default_rng(3)
    limit = N.most_differing((85, 100))
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 340, dtype=np.uint64)
        x, y = (np.concatenate([both, rng.integers(0, 1 << 63, 30, dtype=np.uint64)]) for _ in range(2))
        sx, sy = (np.frombuffer(N.signature(np.unique(s)), np.uint64) for s in (x, y))
        assert (sx[: 2 * N.TREES : 2] == sy[: 2 * N.TREES : 2]).any()
        assert np.bitwise_count(sx[2 * N.TREES :] ^ sy[2 * N.TREES :]).sum() <= limit
