"""PPM codes against a plain model, and the base score against plain counts."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from partslake.llm import ppm as M


def plain_model(texts, least=1):
    counts = [defaultdict(Counter) for _ in range(M.ORDER + 1)]
    for t in texts:
        b = bytes([M.END]) * M.ORDER + b" ".join(t.split()) + bytes([M.END])
        for i in range(M.ORDER, len(b)):
            for k in range(M.ORDER + 1):
                counts[k][b[i - k : i]][b[i]] += 1
    return [{c: {s: n for s, n in row.items() if n >= least} for c, row in level.items() if any(n >= least for n in row.values())} for level in counts]


def plain_code(model, context, byte):
    hidden, log = set(), 0.0
    for k in range(M.ORDER, -1, -1):
        row = model[k].get(context[len(context) - k :] if k else b"")
        if row is None:
            continue
        left = {s: n for s, n in row.items() if s not in hidden}
        n, d = sum(left.values()), len(left)
        if byte in left:
            return log + math.log10((2 * left[byte] - 1) / (2 * n))
        if d:
            log += math.log10(d / (2 * n))
        hidden |= set(row)
    return log - math.log10(max(1, 256 - len(hidden)))


TEXTS = ["the cat sat on the mat", "The dog\tate the cat!", "", None, "ünïcode the", "zzz", "the the the", "a\nb", " \t lead  and\n\ntrail \n", " "]


def rows_of(rows, texts, first=0):
    return rows([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize("max_nodes", [1 << 20, 12])
def test_scores_equal_the_plain_model(spark, rows, max_nodes):
    docs = rows_of(rows, TEXTS * 2).union(rows([(None, "quite new wörds")], "doc_id long, text string")).selectExpr("*", "1 as score", "2 as word").repartition(3)
    out = M.lm_score(docs, max_nodes=max_nodes, head_words=2).collect()
    data = [(i, t) for i, t in enumerate(TEXTS * 2)] + [(None, "quite new wörds")]
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
    low = lambda t: (t or "").encode().lower()
    learnt = [low(t) for i, t in data if not held(i)]
    whole = Counter(g for row in plain_model(learnt)[M.ORDER].values() for g in row.values())
    least = min((n for n in range(1, 1002) if sum(c for m, c in whole.items() if m >= n) <= max_nodes))
    model = plain_model(learnt, least)
    words = Counter(w for t in learnt for w in t.split())
    n, v = sum(words.values()) + len(learnt), len(words) + 1
    base = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    assert len(out) == len(data)
    got = {r.doc_id: r for r in out}
    for i, t in data:
        r, b = got[i], bytes([M.END]) * M.ORDER + b" ".join(low(t).split()) + bytes([M.END])
        tokens = low(t).split()
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(i), len(tokens) + 1, n)
        assert r.n_known == 1 + sum(words[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(sum(base(words[w]) for w in tokens) + base(len(learnt)))
        assert r.score == pytest.approx(sum(plain_code(model, b[j - M.ORDER : j], b[j]) for j in range(M.ORDER, len(b))), rel=1e-9)


def test_codes_of_a_context_add_up_to_one(spark, rows):
    nodes = M.cut_lineage(M.count_nodes(rows([(t,) for t in (b"abracadabra", b"abra kadabra", b"banana")], "text binary")))
    packed = [[int.from_bytes(context.rjust(M.ORDER, b"\xff") + bytes([s]), "big") for s in range(256)] for context in (b"abra", b"abrac", b"ana", b"zzzzz")]
    asked = rows([(g,) for grams in packed for g in grams], "gram long")
    codes = {r.gram: r.code for r in M.coded(asked, M.full_order(nodes), M.levels_of(nodes)).collect()}
    for grams in packed:
        assert sum(10 ** codes[g] for g in grams) == pytest.approx(1.0, rel=1e-12)


def test_head_finds_what_it_holds_and_nothing_else():
    grams = np.sort(np.random.default_rng(5).choice(1 << 40, 5_000, replace=False).astype(np.uint64))
    head = M.Head(grams, np.arange(5_000) + 1.0, np.arange(5_000) % 7)
    asked = np.concatenate([grams[::3], np.array([0, 0, 5], np.uint64), grams[:10] + np.uint64(1)])
    codes, rest, unique, which = head.split(asked)
    known = {int(g): i + 1.0 for i, g in enumerate(grams)}
    assert codes.tolist() == [known.get(int(g), 0.0) for g in asked]
    assert rest.tolist() == [i for i, g in enumerate(asked) if int(g) not in known]
    assert (unique[which] == asked[rest]).all()


def test_held_out_texts_take_few_bits(spark):
    """Below 2.6 bits a byte on texts not learnt from (a byte of random text takes 8)."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = M.lm_score(docs).filter("held_out").join(docs, "doc_id").collect()
    assert -sum(r.score for r in out) / math.log10(2) / sum(len(r.text.encode()) for r in out) < 2.6


def test_empty(spark, rows):
    assert M.lm_score(rows_of(rows, [])).count() == 0
    (r,) = M.lm_score(rows([(1, "abc")], "doc_id long, text string"), fold=None).collect()
    assert r.n_known == 2 and not r.held_out
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = M.lm_score(rows([(held, "abc d")], "doc_id long, text string")).collect()
    assert r.n_known == 0 and r.train_tokens == 0 and r.score == pytest.approx(-6 * math.log10(256))


@pytest.mark.parametrize("head_nodes", [0, 12])
def test_nodes_outside_the_broadcast_head_count(spark, rows, head_nodes):
    docs = rows_of(rows, TEXTS * 2).union(rows([(None, "quite new wörds")], "doc_id long, text string")).repartition(3)
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
    low = lambda t: b" ".join((t or "").encode().lower().split())
    data = [(i, low(t)) for i, t in enumerate(TEXTS * 2)] + [(None, low("quite new wörds"))]
    model = plain_model([t for i, t in data if not held(i)])
    got = {r.doc_id: r for r in M.lm_score(docs, head_nodes=head_nodes, head_words=2).collect()}
    for i, t in data:
        b = bytes([M.END]) * M.ORDER + t + bytes([M.END])
        assert got[i].score == pytest.approx(sum(plain_code(model, b[j - M.ORDER : j], b[j]) for j in range(M.ORDER, len(b))), rel=1e-9)


def test_scores_do_not_depend_on_what_is_broadcast(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole, none = ({r.doc_id: r.score for r in M.lm_score(docs, head_nodes=h, head_words=w).collect()} for h, w in ((M.HEAD_NODES, M.HEAD_WORDS), (0, 10)))
    assert whole.keys() == none.keys()
    assert all(whole[i] == pytest.approx(none[i], rel=1e-12) for i in whole)


@pytest.mark.parametrize("head_nodes", [0, M.HEAD_NODES])
def test_nul_bytes_and_very_long_words(spark, rows, head_nodes):
    learnt = ["abc abd", "the \0 cat", "x" * 3_000]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    free = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 1][: len(learnt)]
    asked = ["\0" * 9, "abc " + "x" * 3_000, "abc \0\0 " * 40_000]
    out = M.lm_score(rows([*zip(free, learnt), *zip(held, asked)], "doc_id long, text string"), head_nodes=head_nodes)
    got = {r.doc_id: r for r in out.collect()}
    model = plain_model([t.encode() for t in learnt])
    for i, t in zip(held, asked):
        b = bytes([M.END]) * M.ORDER + b" ".join(t.encode().split()) + bytes([M.END])
        own = Counter(b[j - M.ORDER : j + 1] for j in range(M.ORDER, len(b)))
        assert got[i].score == pytest.approx(sum(n * plain_code(model, g[:-1], g[-1]) for g, n in own.items()), rel=1e-9)
    assert got[held[1]].n_known == 3
