"""Resampling of a corpus towards a target by importance weights of hashed n-grams.

Runs of one to three words fall into buckets. A bucket's gain is the scaled logarithm of
its share in the target over its share in the corpus; a document's weight is the sum of the
gains of its runs, looked up in one array. Weight plus Gumbel noise, a function of the id
alone, is the score; the highest scores are a draw without replacement by weight.

The lowest drawn score is found by a distributed quickselect: pivots are random rows, one
pass counts exactly what lies below, at and between them, and only the rows of the interval
that holds the k-th go on. No row is sorted but the drawn ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partslake.llm.common import only, text_bytes
from partslake.plans.running import numbered
from partslake.session import cut_lineage

BUCKETS = 10_000
# Words of the longest run.
RUN = 3
# Gains and noise are multiples of one thousandth.
UNIT = 1000
# Share of the eligible documents that is drawn, as numerator and denominator, and the least
# words of an eligible one.
SHARE, MIN_WORDS = (5, 100), 20
SEED = 42
# Pivots of one round: each round leaves about a PIVOTS-th of the rows.
PIVOTS = 32

# A-Z in lower case; other ASCII than letters and digits separates words.
_LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def buckets(text: bytes) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of each run of one to ``RUN`` words."""
    found = text.translate(_LETTERS).split(b" ")
    found = [w for w in found if w]
    sums = list(map(crc32, found))
    out = [sums]
    # the sum of a longer run goes on from that of the shorter one
    spaced = [b" " + w for w in found]
    for k in range(1, RUN):
        sums = list(map(crc32, spaced[k:], sums))
        out.append(sums)
    return len(found), np.array([s for part in out for s in part], np.int64) % BUCKETS


def counted(texts: DataFrame) -> np.ndarray:
    """Runs per bucket over all of ``text``; each task sends one row per bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                counts += np.bincount(buckets(text.as_py())[1], minlength=BUCKETS)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found])], names=["bucket", "n"])

    rows = texts.select(text_bytes()).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket, both counts smoothed by one per bucket."""
    ratio = ((target + 1.0) * (raw.sum() + float(BUCKETS))) / ((raw + 1.0) * (target.sum() + float(BUCKETS)))
    return np.floor(UNIT * np.log(ratio)).astype(np.int64)


def weighed(docs: DataFrame, keep: list[str], gain: np.ndarray) -> DataFrame:
    """The columns ``keep`` with ``n_words``, ``n_features`` and ``weight`` of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    schema = docs.select(*keep).schema
    for name in ("n_words", "n_features", "weight"):
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            made = np.zeros((3, batch.num_rows), np.int64)
            for row, text in enumerate(batch.column(batch.num_columns - 1)):
                n, bucket = buckets(text.as_py())
                made[:, row] = n, len(bucket), gain[bucket].sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, made)], names=schema.names)

    return docs.select(*keep, text_bytes().alias("_text")).mapInArrow(run, schema)


def noise(doc_id: str, seed: int) -> Column:
    """Gumbel noise of an id in units; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-float(UNIT) * F.log(-F.log(share))).cast("long")


def kth(rows: DataFrame, order: list[str], k: int) -> tuple:
    """The ``order`` values of the ``k``-th row (from 1), ascending.

    The values must be distinct as a whole; a null comes before all others. Pivots are the
    rows with the smallest hash, another hash each round, so that a retried task names the
    same ones. Each round reads the rows left twice and writes those of one interval.
    """
    here, around = rows.select(F.struct(*order).alias("key")), 0
    kind = here.schema["key"].dataType
    while True:
        drawn = here.orderBy(F.xxhash64("key", F.lit(around)), "key").limit(PIVOTS)
        pivots = [r.key for r in drawn.orderBy("key").collect()]
        known = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(p, kind)]) for p in pivots])
        below = F.size(F.filter(known, lambda p: p < F.col("key")))
        at = F.exists(known, lambda p: p == F.col("key"))
        counts = {(r.below, r.at): r["count"] for r in here.groupBy(below.alias("below"), at.alias("at")).count().collect()}
        for part in sorted(counts):  # below a pivot, at it, below the next
            if k <= counts[part]:
                break
            k -= counts[part]
        if part[1]:
            return tuple(pivots[part[0]])
        # the rows before the first pivot, between two, or behind the last
        here, around = cut_lineage(here.filter((below == part[0]) & ~at)), around + 1


def importance_resample(
    docs: DataFrame, target: DataFrame, *, share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS, seed: int = SEED
) -> DataFrame:
    """Every row's ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null if not drawn).

    ``docs`` has doc_id and text, ``target`` has text. Of the N rows with ``min_words`` or
    more, floor(share * N) are drawn: highest scores first, ties to the smaller id, null ids
    last. Null and empty texts have no runs and weigh 0. Rows that share their id have the
    same noise and are drawn each on its own; rows alike in score and id are ordered at will.
    An empty table gives no row; with an empty target every bucket is smoothed to the same share.
    """
    texts = only(docs, "doc_id", "text")
    gain = gains(counted(texts), counted(only(target, "text")))
    scored = weighed(texts, ["doc_id"], gain).withColumn("score", F.col("weight") + noise("doc_id", seed))
    scored = cut_lineage(
        scored.withColumns(
            {"_down": -F.col("score"), "_none": F.col("doc_id").isNull(), "_id": F.col("doc_id"), "_row": F.monotonically_increasing_id()}
        )
    )
    order = ["_down", "_none", "_id", "_row"]
    result = ["doc_id", "n_words", "n_features", "weight", "score"]
    able = scored.filter(F.col("n_words") >= min_words)
    k = share[0] * able.count() // share[1]
    unranked = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select(*result, unranked)
    last = kth(able, order, k)
    kind = scored.select(F.struct(*order).alias("key")).schema["key"].dataType
    edge = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last, kind)])
    drawn = (F.col("n_words") >= min_words) & (F.struct(*order) <= edge)
    winners = numbered(scored.filter(drawn).withColumn("_all", F.lit(0)), ["_all"], order, "rank")
    return winners.select(*result, "rank").union(scored.filter(~drawn).select(*result, unranked))
