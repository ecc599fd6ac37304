"""SimHash against all pairs in plain Python."""

import numpy as np
import pytest
import xxhash

from partslake.llm import simhash as S

WORDS = [f"w{i}" for i in range(60)]


def brute_fp(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(ids, fps, bits=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    low = {}
    for i in range(len(ids)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low[find(i)] for i in range(len(ids))]


def texts(seed, n):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            words = out[rng.integers(len(out))].split()
            if words and rng.random() < 0.8:
                words[rng.integers(len(words))] = WORDS[rng.integers(60)]
            out.append(" ".join(words))
        else:
            out.append(" ".join(WORDS[k] for k in rng.integers(60, size=rng.integers(0, 120))))
    return out


@pytest.mark.parametrize("pair_rows", [1 << 18, 24])
def test_components_equal_all_pairs(spark, rows, pair_rows, monkeypatch):
    """A low bound on rows of a node pair sends hot pairs through further rounds in Spark."""
    monkeypatch.setattr(S.links, "__kwdefaults__", S.links.__kwdefaults__ | {"pair_rows": pair_rows})
    data = [(i, t) for i, t in enumerate(texts(1, 160))] + [(900, None), (901, ""), (902, " \t"), (903, "One"), (904, "one"), (904, "one"), (905, "Ä b"), (906, "ä b")]
    got = {}
    for r in S.near_duplicates(rows(data, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as root")).collect():
        got.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    fps = [brute_fp(t) for _, t in data]
    want = brute_components([i for i, _ in data], fps)
    for (i, _), fp, c in zip(data, fps, want):
        assert set(got[i]) == {(f"{fp:016x}", c)}
    assert len(got[904]) == 2 and len({c for c in want}) < len(data)


def test_walk_finds_every_close_pair_once():
    rng = np.random.default_rng(3)
    a = np.unique(np.concatenate([rng.integers(0, 1 << 62, 300, dtype=np.uint64), np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64))]))
    found = [(int(i), int(j)) for x, y in S.walk(a, a, 0, 0, 2) for i, j in zip(x, y)]
    found = [p for p in found if p[0] != p[1]]
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if bin(int(a[i] ^ a[j])).count("1") <= 2}
    assert {tuple(sorted(p)) for p in found} == want and want


def test_empty_and_one_of_each(spark, rows):
    assert S.near_duplicates(rows([], "doc_id long, text string")).count() == 0
    docs = rows([(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "other words go here"), (None, "a b c d")], "doc_id long, text string")
    kept = S.one_of_each(docs.withColumn("fp", docs.doc_id)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "None"]
