import numpy as np
import pytest
from pyspark.sql import functions as F

from partslake.operators import signals as I  # noqa: E741
from tests.conftest import tuples

PIXEL = "frame_id int, y int, x int, b int, g int, r int"


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(2)
    images = {1: np.full((20, 20, 3), 128), 2: np.full((20, 20, 3), 30), 3: np.full((20, 20, 3), 255), 4: rng.integers(0, 250, (12, 9, 3)), 5: np.full((1, 1, 3), 90)}
    data = [(f, y, x, *map(int, im[y, x])) for f, im in images.items() for y in range(im.shape[0]) for x in range(im.shape[1])]
    return images, spark.createDataFrame(data, PIXEL)


def test_lighting(frames):
    got = {r["frame_id"]: r["band"] for r in I.lighting_bands(frames[1]).collect()}
    assert (got[1], got[2], got[3]) == ("green", "red", "red")


def test_focus_against_numpy(frames):
    images, pixels = frames
    got = {r["frame_id"]: (r["variance"], r["band"]) for r in I.focus_bands(pixels).collect()}
    assert got[1] == (0.0, "red") and got[5] == (0.0, "red")
    im = images[4]
    grey = np.floor(0.299 * im[..., 2] + 0.587 * im[..., 1] + 0.114 * im[..., 0] + 0.5)
    p = np.pad(grey, 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * grey
    assert got[4][0] == pytest.approx(lap.var()) and got[4][1] == "green"


def test_focus_shuffles_once(frames):
    plan = I.focus_bands(frames[1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_camera_lost(rows):
    oks = "1000001000010000000000"  # runs of 5, 4 and 10
    reads = rows([("c", i, o == "1") for i, o in enumerate(oks)], "camera string, seq long, ok boolean")
    for width in (3, 10**6):
        got = I.camera_lost(reads, chunk=F.floor(F.col("seq") / width))
        assert set(tuples(got, "seq")) == {(5,), (16,)}


DECODED = (
    [
        (["brown", "black", "red", "gold"], "1k", 5.0, 1.0, True),
        (["yellow", "violet", "red", "gold"], "4k7", 5.0, 1.0, True),
        (["gold", "red", "violet", "yellow"], "4k7", 5.0, 1.0, True),
        (["red", "red", "black", "black", "brown"], "220R", 1.0, 0.5, False),
        (["brown", "black", "green", "gold"], "1M", 5.0, 1.0, True),
        # read backwards it is 140R, which only the finest series has
        (["brown", "black", "black", "yellow", "brown"], "140R", 1.0, 0.5, False),
        (["brown", "brown", "brown", "brown"], "110R", 1.0, 1.0, True),
        (["white", "white", "red", "gold"], None, None, 0.0, False),
        (["pink", "red", "red", "gold"], None, None, 0.0, False),
        (["red"], None, None, 0.0, False),
    ]
)


def test_decode(rows):
    got = I.decode_bands(rows([(b,) for b, *_ in DECODED], "bands array<string>")).collect()
    assert [(r["bands"], r["value"], r["tolerance"], r["confidence"], r["orientation_resolved"]) for r in got] == DECODED


OHMS = [(4700.0, "4k7"), (100.0, "100R"), (1e6, "1M"), (2.2, "2R2"), (0.47, "0R47"), (2210.0, "2k21"), (10500.0, "10k5")]


def test_format(rows):
    got = rows([(o,) for o, _ in OHMS], "o double").select(I.format_ohms(F.col("o"))).collect()
    assert [r[0] for r in got] == [t for _, t in OHMS]


def test_uniformity(rows):
    batches = {1: "1k 1k 1k", 2: "1k 1k 1k 1k 4k7", 3: "1k 1k 1k 4k7 4k7", 4: "b a"}
    df = rows([(b, i, v, 0.1) for b, vs in batches.items() for i, v in enumerate(vs.split())], "batch_id int, position int, value string, confidence double")
    assert tuples(I.uniformity(df)) == [(1, "1k", True, 3), (2, "1k", False, 5), (3, "1k", False, 5), (4, "a", False, 2)]
    assert tuples(I.deviations(df), "batch_id", "position", "confidence") == [(2, 4, 0.1), (3, 3, 0.1), (3, 4, 0.1), (4, 0, 0.1)]


@pytest.mark.parametrize("width", [5, 8, 10**6])
def test_stable_value(rows, width):
    values = "aabbbabcccccabab"
    frames = [i * 3 for i in range(len(values))]
    got = I.stable_value(rows([("t", f, v) for f, v in zip(frames, values)], "track string, frame_no long, value string"), k=5, width=width)
    want = []
    for i, f in enumerate(frames):
        last = values[max(0, i - 4): i + 1]
        top = max(last.count(v) for v in last)
        best = sorted({v for v in last if last.count(v) == top})
        want.append((f, best[0] + ("?" if len(best) > 1 else "")))
    assert tuples(got, "frame_no", "shown") == sorted(want, key=repr)


def test_undo_window(rows):
    events = [(0, "write"), (4, "undo"), (5, "undo"), (10, "write"), (16, "undo"), (20, "write"), (21, "write"), (22, "undo")]
    df = rows([("b", i, t, k) for i, (t, k) in enumerate(events)], "bin string, event_id long, t long, kind string")
    got = I.undo_window(df.withColumn("ts", F.timestamp_seconds("t")).drop("t"), width=3)
    assert tuples(got, "event_id", "legal", "write_id") == [(1, True, 0), (2, False, None), (4, False, None), (7, True, 6)]
