"""Streams over several micro-batches give the batch operator's rows."""

import random

import pytest
from pyspark.sql import functions as F

from partslake.operators import recognise as G
from partslake.operators import signals as I  # noqa: E741
from partslake.sources import commits as S
from partslake.streaming import capture_store as K
from partslake.streaming import streams as J
from tests.conftest import tuples


@pytest.fixture
def feed(spark, tmp_path):
    """Write rows as ordered files, read back one file per micro-batch, return what was written."""

    def run(df, order, op, files=4):
        path, n = str(tmp_path / "in"), df.count()
        placed = df.orderBy(order).collect()
        step = -(-n // files)
        for i in range(0, n, step):
            spark.createDataFrame(placed[i: i + step], df.schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
        out, state = str(tmp_path / "out"), str(tmp_path / "state")
        result = op(stream)
        q = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(result.schema).parquet(out)

    return run


@pytest.fixture
def arrive(spark, tmp_path):
    """Feed batches of rows one after the other, then a row far ahead in time so that all that waits comes out."""

    def run(op, batches, schema):
        src, out, late, state = (str(tmp_path / n) for n in ("src", "out", "late", "state"))
        closing = [tuple(4_000_000_000 if f.split()[0] == "t" else None for f in schema.split(", "))]
        for part in (batches, [closing]):
            for batch in part:
                df = spark.createDataFrame(batch, schema).withColumn("ts", F.timestamp_seconds("t")).drop("t")
                df.coalesce(1).write.mode("append").parquet(src)
            # a second run takes the state up from where the first left it
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
            result = op(stream)
            J.to_two(result, out, late, state).trigger(availableNow=True).start().awaitTermination()
        kind = J.on_time(result).schema
        return spark.read.schema(kind).parquet(out).drop("batch"), spark.read.schema(kind).parquet(late).drop("batch")

    return run


def shuffled(data, batches=8, seed=1):
    rng = random.Random(seed)
    data = list(data)
    rng.shuffle(data)
    return [data[i::batches] for i in range(batches)]


def table_of(rows, data, schema):
    return rows(data, schema).withColumn("ts", F.timestamp_seconds("t")).drop("t")


CAMERA = "camera string, seq long, t long, ok boolean"


def test_camera_lost(rows, arrive):
    rng = random.Random(4)
    data = [(rng.choice(["a", "b"]), i, i // 3, rng.random() < 0.3) for i in range(200)]
    got, late = arrive(lambda s: J.stream_camera_lost(s, limit=3, delay="1 hour"), shuffled(data), CAMERA)
    want = I.camera_lost(table_of(rows, data, CAMERA), limit=3).select("camera", "seq")
    assert tuples(got) == tuples(want) and want.count() > 5 and late.isEmpty()


def test_rows_within_the_delay_are_ordered_and_later_ones_marked(rows, arrive):
    """Neighbouring batches overlap by less than the delay; one row comes far too late."""
    rng = random.Random(5)
    data = [("a", i, i, rng.random() < 0.4) for i in range(120)]
    arriving = sorted(data, key=lambda r: (r[2] + rng.randrange(8), r[1]))
    batches = [arriving[i : i + 15] for i in range(0, 120, 15)]
    stray = ("a", 1000, 3, False)
    batches[6] = [*batches[6], stray]
    got, late = arrive(lambda s: J.stream_camera_lost(s, limit=3, delay="10 seconds"), batches, CAMERA)
    want = I.camera_lost(table_of(rows, data, CAMERA), limit=3).select("camera", "seq")
    assert tuples(got) == tuples(want) and want.count() > 2
    assert tuples(late) == [("a", 1000)]


def test_retry_cap(rows, arrive):
    rng = random.Random(6)
    t = 0
    data = []
    for i in range(80):
        t += rng.choice([1, 5, 30])
        data.append((rng.choice(["a", "b"]), i, t, rng.random() < 0.8, rng.choice([[1.0, 0.0], [0.0, 1.0], [0.9, 0.1]])))
    schema = "camera string, capture_id long, t long, reframing boolean, vec array<double>"
    got, late = arrive(lambda s: J.stream_retry_cap(s, delay="1 hour"), shuffled(data), schema)
    cols = ("camera", "capture_id", "part_no", "attempts", "outcome")
    want = G.retry_cap(table_of(rows, data, schema))
    assert tuples(got, *cols) == tuples(want, *cols) and want.filter("part_no > 3").count() and late.isEmpty()


def test_undo_window(rows, arrive):
    rng = random.Random(8)
    t = 0
    data = []
    for i in range(100):
        t += rng.choice([1, 4, 9])
        data.append((rng.choice(["a", "b"]), i, t, rng.choice(["write", "undo"])))
    schema = "bin string, event_id long, t long, kind string"
    got, late = arrive(J.stream_undo_window, [data[i : i + 25] for i in range(0, 100, 25)], schema)
    cols = ("bin", "event_id", "legal", "write_id")
    want = I.undo_window(table_of(rows, data, schema))
    assert tuples(got, *cols) == tuples(want, *cols) and want.filter("legal").count() and late.isEmpty()


def test_state_is_by_bucket_and_not_by_camera(spark, rows, tmp_path):
    """Thousands of cameras: calls and values of the state stay as few as the buckets; null seq keeps others whole."""
    big = 2**53 + 1
    data = [(f"c{i % 3000}", big + i, i // 3000, False) for i in range(9000)]
    src = str(tmp_path / "in")
    for part in (data[:6000], data[6000:], [("z", None, 10**6, True)]):
        table_of(rows, part, CAMERA).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("camera string, seq long, ok boolean, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    found = J.stream_camera_lost(stream, limit=3).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    run = found.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress) <= 6 * J.BUCKETS
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["seq"] for r in got.collect()) == [big + i for i in range(6000, 9000)]


def test_dedup(rows, feed):
    data = [(i, f"h{i % 7}") for i in range(40)]
    events = rows(data, "t long, image_hash string").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    assert tuples(feed(events, "ts", J.stream_dedup), "image_hash") == [(f"h{i}",) for i in range(7)]


def test_dedup_keeps_late_hashes_and_never_repeats_one(spark, rows, tmp_path):
    """Hours apart, out of order, one file a batch."""
    rng = random.Random(3)
    data = [(3600 * i, f"h{rng.randrange(60)}") for i in range(200)]
    rng.shuffle(data)
    src = str(tmp_path / "in")
    for k in range(8):
        part = rows(data[25 * k : 25 * (k + 1)], "t long, image_hash string")
        part.withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("ts timestamp, image_hash string").option("maxFilesPerTrigger", 1).parquet(src)
    run = J.stream_dedup(stream).writeStream.format("memory").queryName("late").trigger(availableNow=True).start()
    run.awaitTermination()
    assert tuples(spark.table("late"), "image_hash") == [(h,) for h in sorted({h for _, h in data}, key=lambda h: repr((h,)))]


def test_dedup_into_files(spark, rows, tmp_path):
    """Shuffled files give each hash once, in no state; a batch that is run again adds nothing."""
    rng = random.Random(3)
    data = [(i, f"h{rng.randrange(40)}" if i % 9 else None) for i in range(160)]
    rng.shuffle(data)
    src, root = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "t long, image_hash string"
    parts = [table_of(rows, data[20 * k : 20 * (k + 1)], schema) for k in range(8)]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(src)
    J.create_seen(spark, root, parts[0].schema, buckets=2)
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(src)

    def run(state):
        q = J.dedup_into(stream, root, str(tmp_path / state), tidy_every=5).trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    first = run("one")
    assert len(first.recentProgress) >= 8 and all(not p["stateOperators"] for p in first.recentProgress)
    want = sorted({(h,) for _, h in data}, key=repr)
    assert tuples(S.read(spark, root, "first"), "image_hash") == want
    assert tuples(S.read(spark, root, "seen"), "image_hash") == want
    run("two")  # as after a lost checkpoint: the same batches once more
    assert tuples(S.read(spark, root, "first"), "image_hash") == want


def test_captures_over_batches(spark, rows, tmp_path):
    """A part learnt in one batch is recognised in the next; the journal has every write."""
    root = str(tmp_path / "db")
    stock = rows([("b", "S", "LM358N", 1, "manual", {})], "bin string, section string, part string, qty long, source string, cells map<string,string>")
    cache = rows([(1, "m", "h0", "LM358N", None, [1.0, 0.0])], "row_id long, model_hash string, image_hash string, label string, marking_text string, vec array<float>")
    K.create(stock, cache, root, buckets=2)
    sections = rows([("b", "S", 1, True, ["Part", "Qty", "Source"])], "bin string, section string, position int, has_table boolean, header array<string>")
    verdicts = rows([(1, "hedged_id", "NE555N", None)], "capture_id long, vlm_kind string, vlm_label string, vlm_hint string")
    schema = "capture_id long, seq long, bin string, image_hash string, vec array<float>"
    src = str(tmp_path / "in")
    for c in [(1, 1, "b", "h1", [0.0, 1.0]), (2, 2, "b", "h2", [0.01, 1.0]), (3, 3, "b", "h3", [1.0, 0.01])]:
        rows([c], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = J.stream_captures(stream, verdicts, sections, root, "m", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert tuples(S.read(spark, root, "stock"), "part", "qty") == [("LM358N", 2), ("NE555N", 2)]
    learnt = S.read(spark, root, "cache")
    assert tuples(learnt, "row_id", "image_hash", "label") == [(1, "h0", "LM358N"), (2, "h1", "NE555N"), (3, "h2", "NE555N"), (4, "h3", "LM358N")]
    kept = tuples(S.read(spark, root, "journal"), "entry_id", "part", "qty_before", "qty_after", "cache_row_id")
    assert kept == [(1, "NE555N", 0, 1, 2), (2, "NE555N", 1, 2, 3), (3, "LM358N", 1, 2, 4)]
