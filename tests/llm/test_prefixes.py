"""The trie of conversations against one built turn by turn."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest

from partslake.llm import prefixes as P

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    made = hashlib.sha256(f"{len(role)}:{role}{len(text)}:{text}".encode()).hexdigest()
    return int(made[:15], 16), int(made[15:30], 16)


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100 if c >= 0 else c + -c % 100, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    out = []
    for v, convs in members.items():
        under = [w for w in members if w[: len(v)] == v]
        ending = sorted(c for c in convs if len(built[c]) == len(v))
        out.append((
            min(convs), len(v), min(members[v[:-1]]) if v else None, len(convs), sum(len(w) == len(v) + 1 for w in under),
            sum(not any(len(x) == len(w) + 1 and x[: len(w)] == w for x in under) for w in under),
            sum((len(members[w]) - 1) * len(w[-1][1]) for w in under if w),
            hashlib.sha256(",".join(map(str, ending)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def corpus():
    """Families with shared heads, copies, long ones, ties, nulls and missing first conversations."""
    rng = random.Random(4)
    words = ["", "a", "bb", "ccc", "É😀"]
    rows = []
    for c in [*range(0, 12), *range(100, 108), *range(205, 210), 300, 301, -7, -100, -150]:
        for t in range(rng.choice([1, 2, 5, 9, 14])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["u", "a", None]), rng.choice([*words, None])))
    for c in range(1000, 1030):  # near and exact copies of one conversation, long enough for several blocks
        rows += [(c, t, "u", f"same {t}" if t < c - 1000 or c % 3 else "other") for t in range(13)]
    rows += [(1030, 0, "u", "x" * 100_000), (1031, 0, "u", "x" * 100_000), (1032, 5, "u", "tie"), (1032, 5, "a", "tie"), (1032, 5, "a", "tie"), (None, 0, "u", "lost")]
    return rows


@pytest.mark.parametrize("block, many", [(1, 1 << 12), (3, 1 << 12), (4, 5)])
def test_equals_the_plain_form(spark, rows, monkeypatch, block, many):
    monkeypatch.setattr(P, "MANY", many)
    data = corpus()
    frame = rows([(*r, 1, 2) for r in data], SCHEMA + ", depth int, n int").repartition(3)
    out = P.prefix_trie(frame, block=block)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=repr) == plain(data)


def test_growing_copies_of_one_conversation(spark, rows):
    data = [(100 * (c + 1), t, "u", f"turn {t}") for c in range(25) for t in range(c + 1)]
    out = P.prefix_trie(rows(data, SCHEMA)).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in out), key=repr) == plain(data)


def test_empty_and_turnless(spark, rows):
    assert P.prefix_trie(rows([], SCHEMA)).collect() == []
    lost = next(c for c in range(101, 200) if crc32(str(c).encode()) % 6)  # its first turn is replaced by that of none
    out = P.prefix_trie(rows([(lost, 0, "u", "t")], SCHEMA)).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in out] == plain([(lost, 0, "u", "t")])
    assert out[0].n_leaves == 1 and out[0].depth == 0


def test_lists_of_any_length(spark, rows, monkeypatch):
    monkeypatch.setattr(P, "PIECE_IDS", 7)
    data = [(k, v) for k, n in ((1, 1), (2, 500), (-3, 20)) for v in range(n)]
    random.Random(1).shuffle(data)
    got = {r.k: r.sha256 for r in P.listed(rows(data, "k long, v long").repartition(6), ["k"], "v").collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest() for k, n in ((1, 1), (2, 500), (-3, 20))}


def test_text_of_nodes(spark, rows):
    data = corpus()
    frame = rows(data, SCHEMA)
    out = P.with_text(P.prefix_trie(frame), frame).collect()
    assert len(out) == len(plain(data))
    assert sum((r.n_convs - 1) * len(r.text or "") for r in out) == next(r.saved_tokens for r in out if r.depth == 0)
    assert all((r.text is None) == (r.depth == 0) for r in out)
