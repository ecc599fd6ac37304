"""Base measures against plain Python; the ratio's verdicts."""

import re
from collections import Counter

import numpy as np
import pytest

from partslake.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


TEXTS = [
    None, "", " \n\t", "ein Wörtchen 𝒳 é", "a b c a b c a", "x\nx\n x\nx\n\n\n", "# $ %% a|b <c> *", "a\x0bb\x0cc\rd\xa0e a",
    "same line here\n" * 60, " ".join(f"w{i}" for i in range(200)), "aaa " * 70_000, "a b c\nd a b c\n" + " ".join(f"v{i}" for i in range(60)),
]


def test_measures_equal_plain_python(spark, rows):
    data = list(enumerate(TEXTS)) + [(4, TEXTS[4]), (None, TEXTS[9])]
    docs = rows(data, "doc_id long, text string").selectExpr("*", "1 as llr", "2 as n_words").repartition(2)
    out = Q.quality(docs, rows([(1, 1), (1, 1), (None, 1), (3, None)], "doc_id long, quality int")).collect()
    assert len(out) == len(data)
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
    for i, t in data:
        assert set(got[i]) == {brute(t)}, repr(t)[:80]
    assert not any(r.kept for r in out if r.base_failed)


@pytest.mark.parametrize("map_bits", [26, 6])
def test_ratio_against_counts(spark, rows, monkeypatch, map_bits):
    """Counted grams over texts of several batches, also where ids share bits of the map."""
    monkeypatch.setattr(Q, "MAP_BITS", map_bits)
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abc d"), 400)) for _ in range(30)]
    docs = rows([*enumerate(texts[:-1]), (None, texts[-1])], "doc_id long, text string")
    raw, good = Q.count_grams(docs.repartition(3), rows([(i,) for i in range(10)], "doc_id long"))

    def bucket(g):
        packed = 0
        for b in g:
            packed = (packed << 8 | b) & 0xFFFFFFFF
        return (packed * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - Q.BITS)

    want = {True: Counter(), False: Counter()}
    for i, t in enumerate(texts):
        for k, n in enumerate((3, 4)):
            for j in range(len(t) - n + 1):
                b = bucket(t.encode()[j : j + n]) + (k << Q.BITS)
                want[False][b] += 1
                want[True][b] += i < 10
    assert {b: n for b, n in enumerate(raw) if n} == want[False] and {b: n for b, n in enumerate(good) if n} == {b: n for b, n in want[True].items() if n}


def test_verdicts_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = Q.quality(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").filter("not base_failed").collect()
    assert sum(r.kept for r in out if r.quality == 1) == sum(r.quality == 1 for r in out) > 100
    assert sum(not r.kept for r in out if r.quality == 0) >= 0.95 * sum(r.quality == 0 for r in out)


def test_empty(spark, rows):
    assert Q.quality(rows([], "doc_id long, text string"), rows([], "doc_id long, quality int")).count() == 0


def test_all_trusted_rows_count(spark):
    """With every document trusted both sides are the same counts, however many there are."""
    docs = spark.range(20_500).selectExpr("id as doc_id", "md5(string(id)) as text")
    labels = docs.selectExpr("doc_id", "1 as quality")
    assert Q.quality(docs, labels).filter("llr <> 0").count() == 0
