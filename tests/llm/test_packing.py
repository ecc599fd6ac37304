"""Packing: exact round trip of ids, gapless sequences, little padding."""

from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from partslake.llm import packing as K

PATH = P.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "\n\n", "x<|endoftext|>y <|endoftext|> z", "don't we'll", "tab\t\tend\t", "é ü   x",
    "word " * 5000, "\x1c a\x85 b", "ßtraße 123 4,5;;; ---  !?", " ", "\r\n \r\n x", "日本語 テキスト",
]


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def test_round_trip(spark, rows):
    data = list(enumerate(TEXTS)) + [(3, "a"), (None, "null id")]
    docs = rows(data, "doc_id long, text string").selectExpr("*", "5 as length", "'x' as offset").repartition(3)
    packed = K.pack(K.cut(docs.select("doc_id", "text"), PATH, ["doc_id"], length=64, with_ids=True), length=64)
    got, spans = defaultdict(list), defaultdict(list)
    for r in packed.collect():
        got[r.doc_id].append((r.start, list(r.ids)))
        spans[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == r.length
    for i, t in data[: len(TEXTS)]:
        pieces = sorted(got[i])
        if i == 3:
            assert [p for _, p in pieces] == [ids_of("a")] * 2
            continue
        assert [s for s, _ in pieces] == list(np.cumsum([0] + [len(p) for _, p in pieces])[:-1])
        assert [x for _, p in pieces for x in p] == ids_of(t), repr(t)
    assert sorted(spans) == list(range(len(spans)))
    for pieces in spans.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    flat = {r.sequence_id: r.ids for r in K.sequences(packed).collect()}
    assert {k: len(v) for k, v in flat.items()} == {k: sum(n for _, n in v) for k, v in spans.items()}


@pytest.mark.parametrize("seed", range(4))
def test_patterns_use_every_piece_and_little_room(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 2049, 30_000) if seed < 2 else np.minimum(2048, rng.geometric(0.004, 30_000))
    histogram = dict(zip(*np.unique(lengths, return_counts=True)))
    packs = K.patterns({int(k): int(v) for k, v in histogram.items()}, 2048)
    used = defaultdict(int)
    for count, inside in packs:
        assert sum(inside) <= 2048
        for size in inside:
            used[size] += count
    assert used == histogram
    assert lengths.sum() / (2048 * sum(c for c, _ in packs)) > 0.97


def test_empty(spark, rows):
    assert K.packing(rows([], "doc_id long, text string"), PATH).count() == 0
