"""Chunked scans equal the plain window, whatever the chunk width and however hot a key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from partslake.plans.running import int_chunk, numbered, running, top_rows
from tests.conftest import tuples


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    data = [
        # a third of all rows has key "hot"
        ("hot" if rng.random() < 0.34 else f"k{rng.randrange(20)}", i, rng.randrange(-5, 6),
         rng.choice([None, "a", "b"]), rng.random() < 0.2)
        for i in rng.sample(range(3000), 900)
    ]
    return spark.createDataFrame(data, "k string, seq long, v int, s string, r boolean").cache()


@pytest.mark.parametrize("width", [1, 7, 100, 10**6])
def test_running_equals_window(events, width):
    got = running(
        events, ["k"], ["seq"], int_chunk("seq", width),
        sums={"total": F.col("v")},
        since={"streak": (F.col("v"), F.col("r"))},
        lasts={"seen": F.col("s")},
        lags={"before": F.col("s")},
    )
    w = Window.partitionBy("k").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = (
        events.withColumn("total", F.sum("v").over(upto))
        .withColumn("seen", F.last("s", True).over(upto))
        .withColumn("before", F.lag("s").over(w))
        .withColumn("g", F.sum(F.col("r").cast("int")).over(upto))
        .withColumn("streak", F.sum("v").over(Window.partitionBy("k", "g").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    )
    cols = ("k", "seq", "total", "streak", "seen", "before")
    assert tuples(got, *cols) == tuples(want, *cols)


def test_numbered_equals_row_number(events):
    got = numbered(events, ["k"], [F.abs("v"), "seq"], "n")
    want = events.withColumn(
        "n", F.row_number().over(Window.partitionBy("k").orderBy(F.abs("v"), "seq"))
    )
    assert tuples(got, "k", "seq", "n") == tuples(want, "k", "seq", "n")


def test_numbered_without_keys(events):
    got = [r["n"] for r in numbered(events, [], ["seq"], "n").orderBy("seq").collect()]
    assert got == list(range(1, 901))


def test_hot_key_is_spread(events):
    """The rows of one key reach more than one group in the scan."""
    spread = events.filter("k = 'hot'").select(int_chunk("seq", 100).alias("c")).distinct().count()
    assert spread > 20


def test_top_rows(events):
    got = top_rows(events, ["k"], [F.col("seq").desc()], 2)
    assert max(r["count"] for r in got.groupBy("k").count().collect()) == 2
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
