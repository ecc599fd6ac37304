"""Importance resampling against a plain restatement."""

import hashlib
import math
import random
import re
from zlib import crc32

import pytest

from partslake.llm import resample as R

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [crc32(r.encode()) % 10000 for r in runs]


def plain(docs, target, share=(5, 100), min_words=20):
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for b in features(text)[1]:
                counts[b] += 1
    total, goal = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (goal + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        n, found = features(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return rows, able[: share[0] * len(able) // share[1]]


def corpus(n=700):
    rng = random.Random(5)
    word = lambda: rng.choice(["Alpha", "beta9", "Γάμμα", "d.e", "É", "x-y", "o_o", f"w{rng.randrange(500)}"])
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " \t\n.,"), (None, "alpha " * 30), (None, None), (-5, "Z" * 50_000 + " y" * 30_000)]
    docs += [(7, docs[7][1])] * 3 + [(9, "other words " * 15)]
    return docs, ["alpha beta9 gamma " * 20, None, "", "É É É w1 w2"]


@pytest.mark.parametrize("share", [(5, 100), (1, 1), (40, 100)])
def test_equals_the_plain_form(spark, rows, share):
    docs, target = corpus()
    frame = rows([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, score int, rank int, _row int").repartition(5)
    out = R.importance_resample(frame, rows([(t, 1) for t in target], "text string, n int"), share=share).collect()
    want, drawn = plain(docs, target, share)
    none = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted((tuple(r[:5]) for r in out), key=none) == sorted(want, key=none)
    ranked = sorted((r for r in out if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.score, r.doc_id) for r in ranked] == [(r[4], r[0]) for r in drawn]


def test_select_with_few_pivots_and_many_ties(spark, rows, monkeypatch):
    monkeypatch.setattr(R, "PIVOTS", 3)
    rng = random.Random(2)
    data = [(rng.randrange(5), None if rng.random() < 0.1 else rng.randrange(9), i) for i in range(400)]
    frame = rows(data, "a int, b int, c int")
    order = sorted(data, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    for k in (1, 2, 57, 200, 399, 400):
        assert R.kth(frame, ["a", "b", "c"], k) == order[k - 1]


def test_empty_tables(spark, rows):
    docs, target = rows([], "doc_id long, text string"), rows([], "text string")
    assert R.importance_resample(docs, target).collect() == []
    few = rows([(i, "w " * 20) for i in range(19)], "doc_id long, text string")
    out = R.importance_resample(few, target).collect()
    assert len(out) == 19 and all(r.rank is None and r.n_features == 57 for r in out)
    same = R.importance_resample(rows([(4, "w " * 20)] * 60, "doc_id long, text string"), target).collect()
    assert sorted(r.rank for r in same if r.rank) == [1, 2, 3]
