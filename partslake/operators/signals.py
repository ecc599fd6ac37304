"""Capture signals (light, focus, camera loss) and resistor batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partslake.functions import rules as R
from partslake.operators.workitems import lookup
from partslake.plans.running import CHUNK_ROWS, int_chunk, numbered, running, seconds_of


def lighting_bands(pixels: DataFrame) -> DataFrame:
    """Mean luminance, clipped share and band per frame of ``(frame_id, y, x, b, g, r)``."""
    read = pixels.groupBy("frame_id").agg(
        F.avg((F.col("b") + F.col("g") + F.col("r")) / 3.0).alias("mean_luminance"),
        F.avg(
            F.when(F.greatest("b", "g", "r") >= R.CLIP_LEVEL, 1.0).otherwise(0.0)
        ).alias("clipped_fraction"),
    )
    lum, clip = F.col("mean_luminance"), F.col("clipped_fraction")
    outside = lambda band, limit: ~lum.between(*band) | (clip >= limit)
    return read.withColumn(
        "band",
        F.when(outside(R.LIGHT_AMBER, R.CLIP_RED), "red")
        .when(outside(R.LIGHT_GREEN, R.CLIP_AMBER), "amber")
        .otherwise("green"),
    )


def focus_bands(pixels: DataFrame) -> DataFrame:
    """Variance of the Laplacian of the grey image per frame, and its band.

    Beyond the border the image is mirrored without its edge. Pixels are brought together
    by frame once; both windows and the aggregate use that partitioning. A group is one
    image.
    """
    grey = F.floor(
        0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b") + 0.5
    ).cast("double")
    work = pixels.select("frame_id", "y", "x", grey.alias("v")).repartition("frame_id")
    row = Window.partitionBy("frame_id", "y").orderBy("x")
    col = Window.partitionBy("frame_id", "x").orderBy("y")

    def beside(w) -> Column:
        before, after = F.lag("v").over(w), F.lead("v").over(w)
        return F.coalesce(before, after, "v") + F.coalesce(after, before, "v")

    laplacian = work.withColumn("_h", beside(row)).withColumn("_w", beside(col))
    return (
        laplacian.groupBy("frame_id")
        .agg(F.var_pop(F.col("_h") + F.col("_w") - 4 * F.col("v")).alias("variance"))
        .withColumn(
            "band",
            F.when(F.col("variance") >= R.FOCUS_GREEN, "green")
            .when(F.col("variance") >= R.FOCUS_AMBER, "amber")
            .otherwise("red"),
        )
    )


def camera_lost(
    reads: DataFrame, limit: int = 5, chunk: Column | None = None, order: tuple[str, ...] = ("seq",)
) -> DataFrame:
    """First point of each run of ``limit`` failures of a camera; a success resets.

    ``reads`` is ``(camera, seq, ok)``.
    """
    chunk = int_chunk("seq") if chunk is None else chunk
    counted = running(
        reads,
        ["camera"],
        list(order),
        chunk,
        since={"_fails": ((~F.col("ok")).cast("int"), F.col("ok"))},
    )
    return counted.filter(~F.col("ok") & (F.col("_fails") == limit)).select(*reads.columns)


def _digit(colour: Column) -> Column:
    return lookup(R.COLOUR_DIGIT, colour)


def _reading(bands: Column) -> Column:
    """Ohms, tolerance and series of a colour list read in one direction, or null."""
    n = F.size(bands)
    at = lambda i: F.get(bands, F.lit(i))
    d0, d1, d2 = _digit(at(0)), _digit(at(1)), _digit(at(2))
    figures = F.when(n == 4, d0 * 10 + d1).when(n == 5, d0 * 100 + d1 * 10 + d2)
    power = lookup(R.COLOUR_POWER, F.get(bands, n - 2))
    tolerance = lookup(R.COLOUR_TOLERANCE, F.get(bands, n - 1))
    mantissa = F.when(n == 4, figures * 10).otherwise(figures)
    two = (mantissa / 10).cast("int")
    even = mantissa % 10 == 0
    rank = (
        F.when(even & two.isin(*R.E12), 1)
        .when(even & two.isin(*R.E24), 2)
        .when(mantissa.isin(*R.E96), 3)
    )
    ohms = F.round(figures * F.pow(F.lit(10.0), power), 3)
    return F.when(
        ohms.isNotNull() & tolerance.isNotNull() & rank.isNotNull(),
        F.struct(ohms.alias("ohms"), tolerance.alias("tolerance"), rank.alias("rank")),
    )


def format_ohms(ohms: Column) -> Column:
    """``4k7``, ``100R``, ``1M``: the unit letter stands for the decimal point."""
    unit = F.when(ohms >= 1e6, "M").when(ohms >= 1e3, "k").otherwise("R")
    scale = F.when(ohms >= 1e6, 1e6).when(ohms >= 1e3, 1e3).otherwise(1.0)
    milli = F.round(ohms / scale * 1000).cast("long")
    rest = F.rtrim(F.lpad((milli % 1000).cast("string"), 3, "0"), F.lit("0"))
    return F.concat(F.floor(milli / 1000).cast("long").cast("string"), unit, rest)


def decode_bands(resistors: DataFrame) -> DataFrame:
    """Value of a 4- or 5-band colour list, tried in both directions.

    A direction counts if it gives a value of a preferred series. If both do, the finer
    series wins (a value belongs to the coarsest series that has it; a tie is read as
    given) and the confidence is halved.
    """
    reads = resistors.withColumn("_f", _reading(F.col("bands"))).withColumn(
        "_r", _reading(F.reverse("bands"))
    )
    both = F.col("_f").isNotNull() & F.col("_r").isNotNull()
    flipped = F.col("_f").isNull() | (both & (F.col("_r.rank") > F.col("_f.rank")))
    best = F.when(flipped, F.col("_r")).otherwise(F.col("_f"))
    series = lookup({1: "E12", 2: "E24", 3: "E96"}, best["rank"])
    same = F.col("bands") == F.reverse("bands")
    return reads.select(
        *resistors.columns,
        best["ohms"].alias("ohms"),
        best["tolerance"].alias("tolerance"),
        series.alias("series"),
        format_ohms(best["ohms"]).alias("value"),
        F.when(best.isNull(), 0.0).when(both & ~same, 0.5).otherwise(1.0).alias("confidence"),
        (best.isNotNull() & (~both | same)).alias("orientation_resolved"),
    )


def uniformity(decoded: DataFrame) -> DataFrame:
    """Modal value per batch and whether all agree; the smallest value wins a tie."""
    counts = decoded.groupBy("batch_id", "value").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("batch_id").agg(
        F.max("n").alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("values")
    )
    modal = (
        counts.withColumnRenamed("n", "top")
        .join(most.select("batch_id", "top"), ["batch_id", "top"])
        .groupBy("batch_id")
        .agg(F.min("value").alias("modal_value"))
    )
    return most.join(modal, "batch_id").select(
        "batch_id", "modal_value", (F.col("values") == 1).alias("uniform"), "n"
    )


def deviations(decoded: DataFrame) -> DataFrame:
    """Every resistor unlike the mode of its batch, whatever its confidence."""
    modal = uniformity(decoded).filter(~F.col("uniform")).select("batch_id", "modal_value")
    return decoded.join(modal, "batch_id").filter(F.col("value") != F.col("modal_value"))


def stable_value(
    decoded: DataFrame, k: int = 5, width: int = CHUNK_ROWS, chunk: Column | None = None
) -> DataFrame:
    """Modal value over the last ``k`` frames per track; ``?`` marks a tied vote.

    ``decoded`` is ``(track, frame_no, value)``. Frames are numbered per track, cut into chunks, and
    the last k-1 of a chunk are shown to the next one, so a long track has no long task.
    A tie shows the smallest value.
    """
    chunk = int_chunk("frame_no", width) if chunk is None else chunk
    placed = running(decoded, ["track"], ["frame_no"], chunk, sums={"_rn": F.lit(1)})
    part = F.floor(F.col("_rn") / width).cast("long")
    spread = placed.withColumn("_home", part).withColumn(
        "_part",
        F.explode(
            F.when(
                F.floor((F.col("_rn") + (k - 1)) / width) > part, F.array(part, part + 1)
            ).otherwise(F.array(part))
        ),
    )
    w = Window.partitionBy("track", "_part").orderBy("_rn").rowsBetween(-(k - 1), 0)
    votes = spread.withColumn("_last", F.collect_list("value").over(w)).filter("_part = _home")
    tally = F.transform(
        F.array_sort(F.array_distinct("_last")),
        lambda v: F.struct(
            v.alias("v"), F.size(F.filter("_last", lambda x: x == v)).alias("n")
        ),
    )
    top = F.array_max(F.transform("_tally", lambda t: t["n"]))
    leaders = F.filter("_tally", lambda t: t["n"] == F.col("_top"))
    return (
        votes.withColumn("_tally", tally)
        .withColumn("_top", top)
        .withColumn("_leaders", leaders)
        .select(
            *decoded.columns,
            F.get("_leaders", F.lit(0))["v"].alias("stable"),
            (F.size("_leaders") > 1).alias("tied"),
        )
        .withColumn(
            "shown",
            F.concat(F.col("stable").cast("string"), F.when(F.col("tied"), "?").otherwise("")),
        )
    )


def undo_window(events: DataFrame, seconds: float = 5.0, width: int = CHUNK_ROWS) -> DataFrame:
    """Undos ``(bin, ts, event_id, kind)`` that are legal.

    An undo takes back the write just before it, within the time, and only once: after
    another undo there is nothing left to take back. A bin's rows are numbered in order
    and cut every ``width`` rows.
    """
    before = running(
        numbered(events, ["bin"], ["ts", "event_id"], "_n"),
        ["bin"],
        ["_n"],
        int_chunk("_n", width),
        lags={"_kind": F.col("kind"), "_ts": F.col("ts"), "write_id": F.col("event_id")},
    )
    age = seconds_of("ts") - seconds_of("_ts")
    legal = F.coalesce((F.col("_kind") == "write") & (age <= seconds), F.lit(False))
    return before.filter(F.col("kind") == "undo").select(
        *events.columns, legal.alias("legal"), F.when(legal, F.col("write_id")).alias("write_id")
    )
