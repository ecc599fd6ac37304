"""Banded recognition over embeddings: exact nearest neighbours, bands, routing, learning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partslake.operators.metric import nearest
from partslake.plans.running import CHUNK_ROWS, int_chunk, numbered, running, seconds_of
from partslake.session import cut_lineage

TIGHT, MEDIUM = 0.10, 0.25


def model_gate(cache: DataFrame, model_hash: str, strict: bool = False) -> DataFrame:
    """Rows of another backbone are invisible; strict mode fails on the first one."""
    same = F.col("model_hash") == model_hash
    if strict:
        return cache.filter(
            F.when(same, True).otherwise(
                F.raise_error(F.lit("cache holds vectors of another model")).cast("boolean")
            )
        )
    return cache.filter(same)


def classify(
    queries: DataFrame,
    cache: DataFrame,
    tight: float = TIGHT,
    medium: float = MEDIUM,
    k: int = 3,
    **nearest_options,
) -> DataFrame:
    """Band, nearest row and neighbour labels per query. Bands are half-open.

    Rows at ``medium`` or farther do not matter for a band, so only nearer ones are searched.
    """
    near = nearest(queries, cache, k=k, within=medium, **nearest_options)
    seen = near.groupBy("id").agg(
        F.min("distance").alias("distance"),
        F.min_by("row_id", "rank").alias("top_row"),
        F.min_by("label", "rank").alias("top_label"),
        # at most k labels
        F.array_sort(F.collect_set(F.when(F.col("distance") < tight, F.col("label")))).alias("tight_labels"),
    )
    return queries.select("id").join(seen, "id", "left").select(
        "id",
        F.when(F.col("distance").isNull(), "miss")
        .when((F.col("distance") < tight) & (F.size("tight_labels") > 1), "tight_ambiguous")
        .when(F.col("distance") < tight, "tight")
        .otherwise("medium")
        .alias("band"),
        "distance",
        "top_row",
        "top_label",
        "tight_labels",
    )


def route(verdicts: DataFrame, generic_hint: str = "recompose and retry") -> DataFrame:
    """Outcome of a band and a model's verdict.

    Reads ``band``, ``top_label``, ``vlm_kind`` (hedged_id / needs_reframe / no_idea),
    ``vlm_label``, ``vlm_hint``. A medium band never asks the model; without a model
    verdict where one is needed the maker takes over.
    """
    asks = F.col("band").isin("tight_ambiguous", "miss")
    by_model = asks & (F.col("vlm_kind") == "hedged_id")
    reframe = asks & (F.col("vlm_kind") == "needs_reframe")
    kind = (
        F.when(F.col("band") == "tight", "Wrote")
        .when(F.col("band") == "medium", "Reframing")
        .when(by_model, "Wrote")
        .when(reframe, "Reframing")
        .otherwise("EscalatedToManual")
    )
    label = F.when(F.col("band") == "tight", F.col("top_label").cast("string")).when(
        by_model, F.col("vlm_label")
    )
    source = F.when(F.col("band") == "tight", "cache").when(by_model, "vlm")
    hint = F.when(F.col("band") == "medium", generic_hint).when(
        reframe, F.coalesce("vlm_hint", F.lit(generic_hint))
    )
    return verdicts.withColumn(
        "outcome",
        F.struct(
            kind.alias("kind"), label.alias("label"), source.alias("source"), hint.alias("hint")
        ),
    )


def cache_learn(cache: DataFrame, learned: DataFrame) -> DataFrame:
    """Cache with new images added; a known image hash keeps its row and id.

    ``learned`` is ``(seq, model_hash, image_hash, label, marking_text, vec)``. New ids follow the
    largest one in order of ``seq``.
    """
    rest = ["model_hash", "label", "marking_text", "vec"]
    first = (
        learned.groupBy("image_hash")
        .agg(F.min("seq").alias("seq"), F.min_by(F.struct(*rest), "seq").alias("r"))
        .join(cache.select("image_hash"), "image_hash", "left_anti")
        .select("image_hash", "seq", "r.*")
    )
    last = cache.agg(F.coalesce(F.max("row_id"), F.lit(0))).scalar()
    new = numbered(first, [], ["seq", "image_hash"], "n").withColumn("row_id", F.col("n") + last)
    columns = ["row_id", "model_hash", "image_hash", "label", "marking_text", "vec"]
    return cache.select(*columns).unionByName(new.select(*columns))


def cosine_distance(a: Column, b: Column) -> Column:
    """Cosine distance of two arrays of one row."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
        F.lit(0.0),
        lambda s, v: s + v,
    )
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def retry_cap(
    events: DataFrame,
    cap: int = 2,
    gap_seconds: float = 10.0,
    distinct: float = MEDIUM,
    width: int = CHUNK_ROWS,
) -> DataFrame:
    """Attempts per part at a camera; after ``cap`` retries the maker takes over.

    ``events`` is ``(camera, ts, capture_id, reframing, vec)``. The next part begins after a time
    gap with a distinctly different vector; ``distinct`` is our choice of threshold. A camera's
    rows are numbered in order and cut every ``width`` rows, however dense they are in time.
    """
    order, chunk = ["_n"], int_chunk("_n", width)
    paired = running(
        numbered(events, ["camera"], ["ts", "capture_id"], "_n"), ["camera"], order, chunk, lags={"_ts": F.col("ts"), "_vec": F.col("vec")}
    )
    gap = seconds_of("ts") - seconds_of("_ts")
    starts = F.col("_ts").isNull() | (
        (gap > gap_seconds) & (cosine_distance(F.col("vec"), F.col("_vec")) >= distinct)
    )
    tried = running(
        paired.withColumn("_start", starts).drop("_ts", "_vec"),
        ["camera"],
        order,
        chunk,
        sums={"part_no": F.col("_start").cast("int")},
        since={"attempts": (F.col("reframing").cast("int"), F.col("_start"))},
    ).drop("_start", "_n")
    return tried.withColumn(
        "outcome",
        F.when(~F.col("reframing"), "ok")
        .when(F.col("attempts") > cap, "EscalatedToManual")
        .otherwise("Reframing"),
    )


def recognised(
    captures: DataFrame,
    verdicts: DataFrame,
    cache: DataFrame,
    model_hash: str,
    tight: float = TIGHT,
    medium: float = MEDIUM,
) -> DataFrame:
    """Captures with band and ``outcome``, written once as the search is costly."""
    visible = model_gate(cache, model_hash)
    bands = classify(
        captures.select(F.col("capture_id").alias("id"), "vec"), visible, tight, medium
    ).withColumnRenamed("id", "capture_id")
    return cut_lineage(
        route(captures.join(bands, "capture_id").join(verdicts, "capture_id", "left"))
    )


def capped(
    routed: DataFrame,
    earlier: DataFrame | None = None,
    cap: int = 2,
    gap_seconds: float = 10.0,
    distinct: float = MEDIUM,
) -> tuple[DataFrame, DataFrame]:
    """Reframings beyond the cap go to the maker; and what is to be remembered of each camera.

    ``routed`` also has ``camera`` and ``ts``. ``earlier`` is the second result of the batch
    before: ``(camera, ts, vec, attempts)``, the last capture of each camera and the retries of
    its part so far.
    """
    columns = ["camera", "ts", "capture_id", "reframing", "vec"]
    events = routed.withColumn("reframing", F.col("outcome.kind") == "Reframing").select(*columns)
    if earlier is not None:
        # as many retries as still matter, all at the time of the last
        many = F.greatest(F.lit(1), F.least(F.col("attempts"), F.lit(cap + 1))).cast("int")
        before = earlier.withColumn("_n", F.explode(F.sequence(F.lit(1), many)))
        before = before.withColumn("capture_id", (F.col("_n") - cap - 2).cast("long")).withColumn("reframing", F.col("attempts") > 0)
        at, vec = (routed.schema[c].dataType for c in ("ts", "vec"))
        before = before.withColumn("ts", F.col("ts").cast(at)).withColumn("vec", F.col("vec").cast(vec))
        # below all ids of this batch, should the times be equal
        low = F.least(F.lit(0).cast("long"), events.agg(F.min("capture_id")).scalar())
        events = events.unionByName(before.withColumn("capture_id", F.col("capture_id") + low).select(*columns))
    tried = cut_lineage(retry_cap(events, cap, gap_seconds, distinct))
    over = tried.filter(F.col("outcome") == "EscalatedToManual").select("capture_id", F.lit(True).alias("_over"))
    text = F.lit(None).cast("string")
    to_maker = F.struct(F.lit("EscalatedToManual").alias("kind"), text.alias("label"), text.alias("source"), text.alias("hint"))
    out = routed.join(over, "capture_id", "left").withColumn("outcome", F.when(F.col("_over"), to_maker).otherwise(F.col("outcome")))
    last = tried.groupBy("camera").agg(
        F.max_by(F.struct("ts", "vec", "attempts"), F.struct("ts", "capture_id")).alias("r")
    )
    return out.drop("_over"), last.select("camera", "r.*")


def run_captures(
    captures: DataFrame,
    verdicts: DataFrame,
    stock: DataFrame,
    sections: DataFrame,
    cache: DataFrame,
    model_hash: str,
    tight: float = TIGHT,
    medium: float = MEDIUM,
    *,
    routed: DataFrame | None = None,
    check: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """One batch of captures through recognition, stock and cache.

    ``captures`` is ``(capture_id, seq, bin, image_hash, vec)``, ``verdicts`` the model's answers per
    capture. With ``camera`` and ``ts`` retries are capped per part. ``check`` finds diagnostics
    (with ``bin``) in the stock as it would be; a bin that has one keeps its old stock, and its
    writes are rejected. A capture whose write was rejected teaches the cache nothing.
    ``routed`` is the recognition, where the caller has done it. ``journal`` has what
    :func:`~partslake.operators.ledger.undo_last` needs of each write: quantities before and
    after, and the cache row of its image.
    """
    from partslake.operators.ledger import dispositions, gate, replay, upsert_batch

    if routed is None:
        routed = recognised(captures, verdicts, cache, model_hash, tight, medium)
        if {"camera", "ts"} <= set(captures.columns):
            routed = cut_lineage(capped(routed)[0])
    deltas = deltas_of(routed)
    replayed = replay(stock, deltas, sections)
    outcomes = cut_lineage(dispositions(stock, deltas, sections, replayed=replayed))
    post = upsert_batch(stock, deltas, sections, replayed=replayed)
    if check is not None:
        post = cut_lineage(post)
        refused = cut_lineage(check(post).select("bin").distinct())
        post = gate(post, refused).unionByName(stock.join(refused, "bin", "left_semi").select(*post.columns))
        shut = outcomes.join(refused.withColumn("_shut", F.lit(True)), "bin", "left")
        open_ = F.col("_shut").isNull() | (F.col("disposition") == "rejected")
        values = {"disposition": F.lit("rejected"), "qty": F.lit(None), "section": F.lit(None), "reason": F.lit("gate")}
        outcomes = cut_lineage(
            shut.select(*[F.when(open_, F.col(c)).otherwise(values[c]).alias(c) if c in values else F.col(c) for c in outcomes.columns])
        )
    written = outcomes.filter(F.col("disposition") != "rejected").select("bin", "seq")
    learned = (
        routed.filter(F.col("outcome.kind") == "Wrote")
        .join(written, ["bin", "seq"], "left_semi")
        .select(
            "bin",
            "seq",
            F.lit(model_hash).alias("model_hash"),
            "image_hash",
            F.col("outcome.label").alias("label"),
            F.when(F.col("outcome.source") == "vlm", F.col("vlm_label")).alias("marking_text"),
            "vec",
        )
    )
    new_cache = cut_lineage(cache_learn(cache, learned))
    rows_of = new_cache.groupBy("image_hash").agg(F.min("row_id").alias("cache_row_id"))
    journal = (
        outcomes.filter(F.col("disposition") != "rejected")
        .join(learned.select("bin", "seq", "image_hash"), ["bin", "seq"])
        .join(rows_of, "image_hash", "left")
        .select(
            "bin", "part", F.col("seq").alias("entry_id"), F.col("seq").alias("ts"),
            (F.col("qty") - 1).alias("qty_before"), F.col("qty").alias("qty_after"), "cache_row_id",
        )
    )
    return {
        "routed": routed,
        "dispositions": outcomes,
        "stock": post,
        "cache": new_cache,
        "journal": journal,
    }


def deltas_of(routed: DataFrame) -> DataFrame:
    """One more of each part that was recognised."""
    return routed.filter(F.col("outcome.kind") == "Wrote").select(
        "bin",
        "seq",
        F.col("outcome.label").alias("part"),
        F.lit(1).alias("qty_delta"),
        F.lit("camera").alias("source"),
        F.lit(None).cast("string").alias("section"),
        F.create_map().cast("map<string,string>").alias("cells"),
    )


def band_report(
    classified: DataFrame, undone: DataFrame, high: float = 0.30, bins: int = 30
) -> DataFrame:
    """Captures and undos per band and distance bucket; a miss has no distance.

    ``undone`` is ``(id)`` of captures taken back.
    """
    marks = undone.select("id").distinct().withColumn("undone", F.lit(1))
    bucket = F.width_bucket("distance", F.lit(0.0), F.lit(high), F.lit(bins))
    return (
        classified.join(marks, "id", "left")
        .groupBy("band", bucket.alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("captures"),
            F.count("undone").alias("undos"),
        )
        .withColumn("undo_rate", F.col("undos") / F.col("captures"))
    )
