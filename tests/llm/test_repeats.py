"""Repeated passages against every string of every text."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from partslake.llm import repeats as R


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


def texts(seed):
    rng = np.random.default_rng(seed)
    word = lambda: bytes(rng.choice(list(b"abcdefgh"), rng.integers(1, 8)).tolist())
    prose = lambda n: b" ".join(word() for _ in range(n))
    shared = [prose(n) for n in (8, 10, 14, 30)]
    out = []
    for _ in range(70):
        t = prose(rng.integers(0, 40))
        for _ in range(rng.integers(0, 4) * int(rng.random() < 0.6)):
            at = rng.integers(0, len(t) + 1)
            t = t[:at] + shared[rng.integers(4)] + t[at:]
        out.append(t)
        if rng.random() < 0.4:  # a near copy
            b = bytearray(out[rng.integers(len(out))])
            for _ in range(rng.integers(0, 4) * int(rng.random() < 0.6)):
                if b:
                    b[rng.integers(len(b))] = 120
            out.append(bytes(b))
    out += [prose(12) for _ in range(6)]
    return out + [b"a" * 150, b"ab" * 60, b"a" * 41, b"a" * 40, b"", "é".encode() * 50, b"xyz" * 30 + b"q" + b"xyz" * 30]


@pytest.mark.parametrize("seed, window, gram, run_size", [(0, 16, 8, 4), (1, 16, 8, 4), (2, 32, 6, 16), (3, 1, 4, 1)])
def test_equals_every_string(spark, rows, seed, window, gram, run_size):
    data = [(i, t.decode()) for i, t in enumerate(texts(seed))] + [(900, None), (None, "n" * 44), (5, texts(seed)[5].decode())]
    docs = rows(data, "doc_id long, text string").selectExpr("*", "1 as kept", "2 as begin").repartition(3)
    out = R.remove_repeats(docs, length=40, window=window, gram=gram, run_size=run_size).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in out)
    want = sorted((str(i), *x) for (i, _), x in zip(data, brute([(t or "").encode() for _, t in data], 40)))
    assert got == want
    assert sum(r.n_removed > 0 for r in out) > 20 and sum(r.n_removed == 0 for r in out) > 5


def test_full_length(spark, rows):
    rng = np.random.default_rng(9)
    prose = lambda n: "".join(rng.choice(list("abcdefghijk "), n))
    passages = [prose(n) for n in (399, 400, 401, 520, 900, 3_000)]
    data = [(i, prose(rng.integers(0, 900)) + passages[i % 6] + prose(rng.integers(0, 900))) for i in range(24)]
    data += [(50, "z" * 120_000), (51, data[0][1]), (52, data[0][1][:700] + "X" + data[0][1][700:])]
    out = R.remove_repeats(rows(data, "doc_id long, text string")).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in out)
    assert got == sorted((i, *x) for (i, _), x in zip(data, brute([t.encode() for _, t in data], 400)))


def test_empty(spark, rows):
    assert R.remove_repeats(rows([], "doc_id long, text string")).count() == 0


def test_rows_of_one_passage_are_dealt_over_tasks(spark, rows, monkeypatch):
    """A passage in all texts is one rank: its rows lie in many files of the tables between, and the result is the same."""
    rng = np.random.default_rng(4)
    prose = lambda n: "".join(rng.choice(list("abcdefghijk "), n))
    passage = prose(41)
    data = [(i, prose(rng.integers(0, 60)) + passage + prose(rng.integers(0, 60))) for i in range(300)]
    data += [(300 + i, prose(20) + data[i][1] + prose(20)) for i in range(6)]
    share, keep = [], R.Tables.keep

    def counted(self, df):
        out = keep(self, df)
        if "_rank" in out.columns:
            files = [r["count"] for r in out.groupBy(F.input_file_name()).count().collect()]
            share.append(max(files) / sum(files))
        return out

    monkeypatch.setattr(R.Tables, "keep", counted)
    monkeypatch.setattr(R, "KEY_ROWS", 4, raising=False)
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = R.remove_repeats(rows(data, "doc_id long, text string"), length=40, window=16, gram=8, run_size=4).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in out)
    assert got == sorted((i, *x) for (i, _), x in zip(data, brute([t.encode() for _, t in data], 40)))
    assert share and max(share) < 0.3, share
