import numpy as np
import pytest
from pyspark.sql import functions as F

from partslake.operators import recognise as G
from tests.conftest import tuples

VEC = "row_id long, label string, vec array<float>"


def at(distance):
    """Unit vector at a cosine distance from (1, 0)."""
    c = 1 - distance
    return [float(c), float(np.sqrt(max(0.0, 1 - c * c)))]


@pytest.fixture
def one(rows):
    return rows([(1, [1.0, 0.0])], "id long, vec array<float>")


BANDS = [(0.05, "tight"), (0.0999, "tight"), (0.1001, "medium"), (0.20, "medium"), (0.2499, "medium"), (0.2501, "miss"), (0.30, "miss")]


def test_bands(rows):
    asked = rows([(i, at(d)) for i, (d, _) in enumerate(BANDS)], "id long, vec array<float>")
    got = G.classify(asked, rows([(7, "L", [1.0, 0.0])], VEC)).orderBy("id").collect()
    assert [r["band"] for r in got] == [b for _, b in BANDS]
    assert all((r["top_row"] == 7) == (r["band"] != "miss") for r in got)


def test_bands_are_half_open(rows, one):
    """A distance that is exactly a threshold belongs to the farther band."""
    cache = rows([(7, "L", [0.0, 1.0])], VEC)
    assert G.classify(one, cache, tight=1.0, medium=2.0).first()["band"] == "medium"
    assert G.classify(one, cache, tight=0.5, medium=1.0).first()["band"] == "miss"


def test_ambiguous_and_empty(rows, one):
    cache = rows([(1, "LM358N", at(0.02)), (2, "LM358P", at(0.03)), (3, "LM358P", at(0.2))], VEC)
    got = G.classify(one, cache).first()
    assert (got["band"], got["top_label"], got["tight_labels"]) == ("tight_ambiguous", "LM358N", ["LM358N", "LM358P"])
    assert G.classify(one, cache.filter("row_id <> 2")).first()["band"] == "tight"
    assert G.classify(one, cache.filter("false")).first()["band"] == "miss"


@pytest.mark.parametrize("within", [None, 0.3, 1.2])
@pytest.mark.parametrize("block_rows, cell_rows, fanout", [(7, 24, 256), (4096, 4096, 256), (16, 4, 4)])
def test_nearest_equals_brute_force(rows, within, block_rows, cell_rows, fanout):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 8))
    cached = np.vstack([centres[i % 6] + 0.3 * rng.normal(size=8) for i in range(120)])
    # a third of the cache are copies of one vector
    cached[:40] = cached[0]
    asked = np.vstack([centres[i % 6] + 0.3 * rng.normal(size=8) for i in range(50)])
    asked[:15] = cached[0]
    f32 = lambda m: m.astype(np.float32).astype(float)
    cached, asked = f32(cached), f32(asked)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    d = 1 - unit(asked) @ unit(cached).T
    want = {}
    for i, row in enumerate(d):
        order = sorted(range(120), key=lambda j: (round(row[j], 9), j))[:3]
        want[i] = [round(row[j], 6) for j in order if within is None or row[j] < within]
    got = G.nearest(
        rows([(i, v.tolist()) for i, v in enumerate(asked)], "id long, vec array<float>"),
        rows([(j, f"L{j}", v.tolist()) for j, v in enumerate(cached)], VEC),
        k=3, within=within, block_rows=block_rows, cell_rows=cell_rows, fanout=fanout,
    ).collect()
    have = {i: [] for i in want}
    for r in sorted(got, key=lambda r: r["rank"]):
        have[r["id"]].append(round(r["distance"], 6))
    assert have == want


def test_route(rows):
    cases = [
        ("tight", "no_idea", "Wrote", "cache"), ("tight_ambiguous", "hedged_id", "Wrote", "vlm"), ("tight_ambiguous", "no_idea", "EscalatedToManual", None),
        ("medium", "hedged_id", "Reframing", None), ("miss", "hedged_id", "Wrote", "vlm"), ("miss", "needs_reframe", "Reframing", None),
        ("miss", "no_idea", "EscalatedToManual", None), ("miss", None, "EscalatedToManual", None),
    ]
    df = rows([(i, b, "C", v, "V", None) for i, (b, v, _, _) in enumerate(cases)],
              "i int, band string, top_label string, vlm_kind string, vlm_label string, vlm_hint string")
    got = [(r["outcome"]["kind"], r["outcome"]["source"]) for r in G.route(df).orderBy("i").collect()]
    assert got == [(k, s) for _, _, k, s in cases]


LEARN = "seq long, model_hash string, image_hash string, label string, marking_text string, vec array<float>"
CACHE = "row_id long, model_hash string, image_hash string, label string, marking_text string, vec array<float>"


def test_learning_is_idempotent(rows):
    cache = rows([(5, "m", "h1", "A", None, [1.0])], CACHE)
    learned = rows([(2, "m", "h2", "B", None, [1.0]), (1, "m", "h2", "C", None, [1.0]), (3, "m", "h1", "D", None, [1.0]), (4, "m", "h3", "E", None, [1.0])], LEARN)
    once = G.cache_learn(cache, learned)
    assert tuples(once, "row_id", "image_hash", "label") == [(5, "h1", "A"), (6, "h2", "C"), (7, "h3", "E")]
    assert tuples(G.cache_learn(once, learned), "row_id", "image_hash") == tuples(once, "row_id", "image_hash")
    assert G.cache_learn(cache.filter("false"), learned).agg(F.min("row_id")).first()[0] == 1


def test_model_gate(rows):
    cache = rows([(1, "m1"), (2, "m2")], "row_id long, model_hash string")
    assert tuples(G.model_gate(cache, "m1"), "row_id") == [(1,)]
    with pytest.raises(Exception, match="another model"):
        G.model_gate(cache, "m1", strict=True).collect()
    assert G.model_gate(cache.filter("row_id = 1"), "m1", strict=True).count() == 1


def test_retry_cap(rows):
    far, near = [0.0, 1.0], [1.0, 0.0]
    events = [
        (0, True, near), (1, True, near), (2, True, near),  # third attempt escalates
        (30, True, near),  # a gap alone is the same part
        (31, True, far),  # another vector alone is the same part
        (60, True, near), (61, False, near), (62, True, near),
    ]
    df = rows([("c", i, r, v, t) for i, (t, r, v) in enumerate(events)], "camera string, capture_id long, reframing boolean, vec array<double>, t long")
    df = df.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    got = G.retry_cap(df, width=3).orderBy("capture_id").collect()
    assert [(r["part_no"], r["attempts"]) for r in got] == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (2, 1), (2, 1), (2, 2)]
    assert [r["outcome"] for r in got] == ["Reframing"] * 2 + ["EscalatedToManual"] * 3 + ["Reframing", "ok", "Reframing"]


def test_failed_stock_write_stops_learning(rows):
    sections = rows([("good", "S", 1, True, ["Part", "Qty", "Source"]), ("bad", "S", 1, False, None)],
                    "bin string, section string, position int, has_table boolean, header array<string>")
    stock = rows([], "bin string, section string, part string, qty int, source string, cells map<string,string>")
    cache = rows([(1, "m", "h0", "LM358N", None, [1.0, 0.0])], CACHE)
    captures = rows([(1, 1, "good", "h1", at(0.01)), (2, 2, "bad", "h2", at(0.01)), (3, 3, "good", "h3", [0.0, 1.0]), (4, 4, "good", "h4", at(0.2))],
                    "capture_id long, seq long, bin string, image_hash string, vec array<float>")
    verdicts = rows([(3, "hedged_id", "likely NE555", None)], "capture_id long, vlm_kind string, vlm_label string, vlm_hint string")
    done = G.run_captures(captures, verdicts, stock, sections, cache, "m")
    assert tuples(done["dispositions"], "bin", "part", "disposition") == [
        ("bad", "LM358N", "rejected"), ("good", "LM358N", "inserted"), ("good", "likely NE555", "inserted"),
    ]
    assert tuples(done["stock"], "bin", "part", "qty") == [("good", "LM358N", 1), ("good", "likely NE555", 1)]
    assert tuples(done["cache"], "image_hash", "label", "marking_text") == [
        ("h0", "LM358N", None), ("h1", "LM358N", None), ("h3", "likely NE555", "likely NE555"),
    ]


def test_band_report(rows):
    seen = rows([(1, "tight", 0.05), (2, "tight", 0.05), (3, "miss", None)], "id long, band string, distance double")
    got = G.band_report(seen, rows([(2,)], "id long"))
    assert tuples(got, "band", "captures", "undos", "undo_rate") == [("miss", 1, 0, 0.0), ("tight", 2, 1, 0.5)]
