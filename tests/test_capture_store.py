"""Captures and undos move stock, cache, journal and outcomes on together."""

import pytest

from partslake.operators import recognise as G
from partslake.sources import commits as C
from partslake.streaming import capture_store as K
from tests.conftest import tuples

STOCK = "bin string, section string, part string, qty long, source string, cells map<string,string>"
CACHE = "row_id long, model_hash string, image_hash string, label string, marking_text string, vec array<float>"
SECTIONS = "bin string, section string, position int, has_table boolean, header array<string>"
CAPTURES = "capture_id long, seq long, bin string, image_hash string, vec array<float>, camera string, ts timestamp"
VERDICTS = "capture_id long, vlm_kind string, vlm_label string, vlm_hint string"
HIT, MEDIUM_HIT, MISS = [1.0, 0.0], [0.83, 0.56], [0.0, 1.0]


@pytest.fixture
def store(spark, rows, tmp_path):
    root = str(tmp_path / "store")
    stock = rows([("b", "S", "LM358N", 1, "manual", {}), ("c", "S", "NE555N", 4, "manual", {})], STOCK)
    K.create(stock, rows([(1, "m", "h0", "LM358N", None, HIT)], CACHE), root, buckets=2)
    sections = rows([(x, "S", 1, True, ["Part", "Qty", "Source"]) for x in "bc"], SECTIONS)

    def take(batch_id, *captures, verdicts=(), **kwargs):
        """``captures``: (id, bin, vector, second of the day)."""
        data = [(i, i, b, f"h{i}", v, "cam", s) for i, b, v, s in captures]
        frame = rows(data, CAPTURES.replace("ts timestamp", "s long")).selectExpr("* except (s)", "timestamp_seconds(s) as ts")
        return K.apply_captures(frame, rows(list(verdicts), VERDICTS), sections, root, "m", batch_id, **kwargs)

    take.root = root
    take.table = lambda name, *cols: tuples(C.read(spark, root, name), *cols)
    return take


def state(store):
    return tuple(store.table(t, *c) for t, c in (("stock", ("bin", "part", "qty")), ("cache", ("row_id", "label")), ("journal", ("bin", "entry_id", "qty_after", "cache_row_id"))))


def test_write_learn_and_no_idea(store):
    store(0, (10, "b", HIT, 0), (11, "b", MISS, 100), (12, "c", MISS, 200), verdicts=[(11, "hedged_id", "TL072", None), (12, "no_idea", None, None)])
    assert state(store) == (
        [("b", "LM358N", 2), ("b", "TL072", 1), ("c", "NE555N", 4)],
        [(1, "LM358N"), (2, "LM358N"), (3, "TL072")],
        [("b", 10, 2, 2), ("b", 11, 1, 3)],
    )
    before = state(store)
    store(0, (13, "b", HIT, 300))  # the same batch again
    assert state(store) == before


def test_a_write_that_fails_leaves_everything(store, monkeypatch):
    before = state(store)
    real = C._write_layer

    def failing(rows, path, *args, **kwargs):
        if path.endswith("journal"):
            raise RuntimeError("disk")
        return real(rows, path, *args, **kwargs)

    monkeypatch.setattr(C, "_write_layer", failing)
    with pytest.raises(RuntimeError):
        store(0, (10, "b", HIT, 0))
    assert state(store) == before
    monkeypatch.undo()
    store(0, (10, "b", HIT, 0))
    assert state(store)[0] == [("b", "LM358N", 2), ("c", "NE555N", 4)]


def test_enrichment_cannot_fail_the_write(store):
    def broken(parts):
        raise OSError("no network")

    store(0, (10, "b", HIT, 0), enrich=broken)
    assert state(store)[0][0] == ("b", "LM358N", 2) and store.table("enriched") == []
    store(1, (11, "b", HIT, 100), enrich=lambda parts: parts.selectExpr("part", "'enriched' as kind", "null as reason", "'cache' as origin", "'u' as datasheet"))
    assert store.table("enriched", "part", "datasheet") == [("LM358N", "u")]


def test_a_diagnostic_shuts_the_bin(store):
    """Bin b would get a part the check refuses; bin c is written."""
    check = lambda post: post.filter("part = 'bad'").selectExpr("bin", "'no' as message")
    verdicts = [(10, "hedged_id", "bad", None), (12, "hedged_id", "NE555N", None)]
    store(0, (10, "b", MISS, 0), (11, "b", HIT, 100), (12, "c", MISS, 200), verdicts=verdicts, check=check)
    assert state(store) == ([("b", "LM358N", 1), ("c", "NE555N", 5)], [(1, "LM358N"), (2, "NE555N")], [("c", 12, 5, 2)])
    assert store.table("outcomes", "seq", "disposition", "reason") == [(10, "rejected", "gate"), (11, "rejected", "gate"), (12, "bumped", None)]


def test_the_third_reframing_goes_to_the_maker(spark, rows):
    """Within one batch, over batches, and afresh for the next part."""
    times = [0, 3, 6, 100, 103]
    other = [-0.56, 0.83]
    data = [(i, "cam", t, MEDIUM_HIT if t < 50 else other, "Reframing") for i, t in enumerate(times)]
    routed = rows(data, "capture_id long, camera string, s long, vec array<float>, kind string").selectExpr(
        "capture_id", "camera", "timestamp_seconds(s) as ts", "vec",
        "named_struct('kind', kind, 'label', string(null), 'source', string(null), 'hint', 'again') as outcome",
    )
    kinds = lambda df: {r.capture_id: r.outcome.kind for r in df.collect()}
    whole, last = G.capped(routed)
    want = {0: "Reframing", 1: "Reframing", 2: "EscalatedToManual", 3: "Reframing", 4: "Reframing"}
    assert kinds(whole) == want and [r.attempts for r in last.collect()] == [2]
    got, memory = {}, None
    for i in range(5):
        part, memory = G.capped(routed.filter(f"capture_id = {i}"), memory)
        memory = rows([tuple(r) for r in memory.collect()], "camera string, ts timestamp, vec array<double>, attempts long")
        got |= kinds(part)
    assert got == want


def test_retries_are_remembered_over_batches(store):
    for n in range(3):
        store(n, (20 + n, "b", MEDIUM_HIT, 3 * n))
    assert store.table("attempts", "camera", "attempts") == [("cam", 3)]


def test_undo_is_one_commit(store, spark, monkeypatch):
    store(0, (10, "b", HIT, 0), (11, "b", HIT, 100))
    before = state(store)
    for gap in ("cache", "journal"):
        real = C._write_layer

        def failing(rows, path, *args, _gap=gap, **kwargs):
            if path.endswith(_gap):
                raise RuntimeError("disk")
            return real(rows, path, *args, **kwargs)

        monkeypatch.setattr(C, "_write_layer", failing)
        with pytest.raises(RuntimeError):
            K.undo_captures(spark, store.root)
        monkeypatch.undo()
        assert state(store) == before
    assert tuples(K.undo_captures(spark, store.root), "bin", "entry_id", "outcome") == [("b", 11, "reverted"), ("c", None, "nothing to undo")]
    assert state(store) == ([("b", "LM358N", 2), ("c", "NE555N", 4)], [(1, "LM358N"), (2, "LM358N")], [("b", 10, 2, 2)])


def test_tidying_keeps_the_state(store, monkeypatch):
    monkeypatch.setattr(K, "TIDY_EVERY", 2)
    monkeypatch.setattr(C, "MANY_FILES", 1)
    for n in range(2):
        store(n, (10 + n, "b", HIT, 100 * n))
    assert state(store)[0] == [("b", "LM358N", 3), ("c", "NE555N", 4)] and len(state(store)[1]) == 3
