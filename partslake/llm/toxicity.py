"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the words, neighbouring pairs and pairs with one word between,
each hashed to one of ``2**BITS`` coordinates and counted once; the upper half belongs to
the pairs, which weigh less. Every coordinate has its own learning rate, and L1 leaves most weights at exactly zero, so a model is a short list
of (coordinate, weight) that is broadcast. Scoring reads each text once and moves nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partslake.llm.common import Hashes, lowered, mix, only, remainder, scans, smallest, table_of, text_bytes, words

BITS = 21
# Labelled rows learnt from, at most.
SAMPLE_ROWS = 12_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 4.0, 1.0, 2.0, 0.0
# Value of a pair; a word has 1.
PAIR = 0.4
THRESHOLD = 0.7

# Everything below 0x80 that is no letter or digit separates words.
_SEPARATOR = table_of(bytes(b for b in range(128) if not chr(b).isalnum()))


def features(data: np.ndarray, offsets: np.ndarray, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate and text number of each word, pair and skip-pair."""
    data = lowered(data)
    hashes.load(data)
    start, end, text = words(data, offsets, _SEPARATOR)
    h = hashes.of(start, end)
    shift, upper = np.uint64(65 - BITS), np.uint64(1 << (BITS - 1))
    found, owner = [h >> shift], [text]
    for gap, salt in ((1, 0x2545F4914F6CDD1D), (2, 0xD1342543DE82EF95)):
        same = text[:-gap] == text[gap:] if len(text) > gap else np.zeros(0, bool)
        pair = mix(h[:-gap] * np.uint64(salt) + h[gap:]) if len(text) > gap else h[:0]
        found.append((pair[same] >> shift) | upper)
        owner.append(text[gap:][same] if len(text) > gap else text[:0])
    return np.concatenate(found).astype(np.int64), np.concatenate(owner)


def values(feature: np.ndarray) -> np.ndarray:
    return np.where((feature >> (BITS - 1)) == 1, PAIR, 1.0)


def descend(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates and weights that are not zero, and the bias, after ``EPOCHS`` passes."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        l1 = np.where(i == 1 << BITS, 0.0, L1)  # the bias stays free of L1
        step = -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= l1, 0.0, step)

    for _ in range(EPOCHS):
        for i, label in rows:
            w, x = weight(i), values(i)
            g = (1.0 / (1.0 + np.exp(-np.clip((w * x).sum(), -35.0, 35.0))) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weight(np.arange((1 << BITS) + 1))
    kept = np.flatnonzero(w[:-1])
    return kept, w[kept], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, *, fold: tuple[int, int] | None = None, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Learn from ``rows`` labelled documents at most, those with the smallest hash of the id.

    ``fold`` (n, r) leaves out ids whose crc32 modulo n is r. A label that is neither 0 nor
    1 is ignored, a document with both labels is toxic. The sample has a fixed bound and is
    learnt in one task; only weights that are not zero reach the driver.
    """
    known = only(labels, "doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if fold:
        known = known.filter(remainder("doc_id", fold[0]) != fold[1])
    known = smallest(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", rows)
    sample = (
        docs.select("doc_id", text_bytes())
        .join(F.broadcast(known), "doc_id")
        .select("text", "toxic", F.xxhash64("doc_id").alias("at"))
        .repartition(1)
    )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = Hashes(), []
        for batch in batches:
            label, at = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for first, end, data, offsets in scans(batch):
                found, owner = features(data, offsets, hashes)
                pairs = np.unique((owner << BITS) + found)
                cut = np.searchsorted(pairs, np.arange(end - first + 1) << BITS)
                for k in range(end - first):
                    own = (pairs[cut[k] : cut[k + 1]] & ((1 << BITS) - 1)).astype(np.int32)
                    seen.append((at[first + k], np.append(own, np.int32(1 << BITS)), label[first + k]))
        seen.sort(key=lambda row: (row[0], len(row[1]), row[2]))
        index, weights, bias = descend([row[1:] for row in seen])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(index, -1), pa.int64()), pa.array(np.append(weights, bias), pa.float64())],
            names=["feature", "weight"],
        )

    model = sample.mapInArrow(fit, "feature long, weight double").toArrow()
    index, weights = model["feature"].to_numpy(), model["weight"].to_numpy()
    bias = float(weights[index < 0][0]) if (index < 0).any() else -np.inf
    return index[index >= 0], weights[index >= 0], bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``score``, the probability that a text is toxic.

    Null and empty texts get the score of the bias alone; without any labelled row it is 0
    for all. Very long texts are read whole. Repeated rows are scored each on their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(*keep, text_bytes().alias("_text"))
    kept = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weights, bias = shared.value
        dense, hashes = np.zeros(1 << BITS), Hashes()
        dense[index] = weights * values(index)
        for batch in batches:
            sums = np.full(batch.num_rows, bias)
            for first, end, data, offsets in scans(batch, "_text"):
                found, owner = features(data, offsets, hashes)
                hit = dense[found] != 0
                pairs = np.unique((owner[hit] << BITS) + found[hit])
                sums[first:end] += np.bincount(pairs >> BITS, dense[pairs & ((1 << BITS) - 1)], minlength=end - first)
            with np.errstate(over="ignore"):
                scores = pa.array(1.0 / (1.0 + np.exp(-sums)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*batch.schema.names[:-1], "score"])

    return out.mapInArrow(run, kept.add("score", "double"))


def toxicity(docs: DataFrame, labels: DataFrame, *, fold: tuple[int, int] | None = (3, 1), threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``.

    Rows with the remainder ``fold[1]`` are not learnt from and are marked ``held_out``.
    Repeated rows each give a row; an empty table gives no row.
    """
    out = score(docs, train(docs, labels, fold=fold), ["doc_id"])
    held = remainder("doc_id", fold[0]) == fold[1] if fold else F.lit(False)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
