"""Quality rules: log-likelihood ratio of hashed n-grams, trusted texts against the raw corpus.

Byte 3- and 4-grams are hashed to buckets and counted over all documents and over trusted
ones. A text's ratio is the mean over its n-grams of log(p_trusted / p_raw); below a fixed
threshold it is not kept. Plain measures of each text give the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partslake.llm.common import SPACES, Hashes, mix, only, scans, table_of, text_bytes, words
from partslake.session import cut_lineage

# Buckets of one n-gram length.
BITS = 16
# Bits of the map of trusted ids.
MAP_BITS = 26
THRESHOLD = -0.3
MIN_WORDS, MAX_REPEAT = 50, 50

_SEPARATOR = table_of(SPACES)
_SYMBOLS = table_of(b"#*$%&|<>")
_GRAMS = (3, 4)


def grams(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: bucket at every position, and first and end position in each text."""
    out = []
    for k, n in enumerate(_GRAMS):
        count = max(0, len(data) - n + 1)
        packed = np.zeros(count, np.uint32)
        for j in range(n):
            packed = (packed << np.uint32(8)) | data[j : j + count]
        bucket = ((packed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64) + (k << BITS)
        out.append((bucket, np.minimum(offsets[:-1], count), np.clip(offsets[1:] - n + 1, np.minimum(offsets[:-1], count), count)))
    return out


def _sums(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.append(values.dtype.type(0), np.cumsum(values))
    return total[end] - total[first]


def _slot(doc_id: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("string")).bitwiseAND(F.lit((1 << MAP_BITS) - 1))


def _map_of(ids: DataFrame) -> np.ndarray:
    """A bit for each id; its size does not depend on how many there are."""
    slot = ids.select(_slot("doc_id").alias("s")).groupBy(F.shiftright("s", 6).alias("word"))
    marked = slot.agg(F.expr("bit_or(shiftleft(1L, int(s & 63)))").alias("bits")).toArrow()
    bits = np.zeros(1 << MAP_BITS - 6, np.uint64)
    bits[marked["word"].to_numpy()] = marked["bits"].to_numpy().view(np.uint64)
    return bits


def _counts(docs: DataFrame, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts per bucket over all of ``docs`` and over those whose id has its bit set."""
    size, shared = len(_GRAMS) << BITS, docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good, known = np.zeros(size, np.int64), np.zeros(size, np.int64), shared.value
        for batch in batches:
            slot = batch.column(0).to_numpy()
            mark = (slot >= 0) & (known[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            for first, end, data, offsets in scans(batch):
                for bucket, start, stop in grams(data, offsets):
                    # +1 where a text's n-grams begin, -1 behind them: 1 within, 0 across texts
                    step = np.zeros(len(bucket) + 1, np.int8)
                    np.add.at(step, start, 1)
                    np.add.at(step, stop, -1)
                    inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
                    raw += np.bincount(bucket[inside], minlength=size)
                    marked = [bucket[a:b] for a, b, m in zip(start, stop, mark[first:end]) if m]
                    if marked:
                        good += np.bincount(np.concatenate(marked), minlength=size)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])

    slotted = docs.select(F.when(F.col("doc_id").isNull(), -1).otherwise(_slot("doc_id")).cast("long").alias("slot"), text_bytes())
    total = (
        slotted.mapInArrow(run, "bucket int, raw long, good long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    )
    raw, good = np.zeros(size), np.zeros(size)
    raw[total["bucket"].to_numpy()], good[total["bucket"].to_numpy()] = total["raw"].to_numpy(), total["good"].to_numpy()
    return raw, good


def count_grams(docs: DataFrame, trusted: DataFrame | None) -> tuple[np.ndarray, np.ndarray]:
    """Counts per bucket over all of ``docs`` and over those with an id in ``trusted``, which has each once.

    Texts do not move to meet the ids: a map of the trusted ids is sent to them. Ids that
    only share a bit with a trusted one are found by a join of ids, and what their texts
    counted is taken off again, so the counts are exact.
    """
    if trusted is None:
        return _counts(docs, np.zeros(1 << MAP_BITS - 6, np.uint64))
    bits = _map_of(trusted)
    raw, good = _counts(docs, bits)
    shared = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct().join(trusted.select("doc_id"), "doc_id", "left_anti")
    known = trusted.select(_slot("doc_id").alias("_s")).distinct()
    wrong = shared.withColumn("_s", _slot("doc_id")).join(known, "_s", "left_semi").select("doc_id")
    wrong = cut_lineage(wrong)
    if not wrong.isEmpty():
        good = good - _counts(docs.join(wrong, "doc_id", "left_semi"), bits)[0]
    return raw, good


def ratios(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """log(p_trusted / p_raw) per bucket, one count added to each; 0 without trusted texts."""
    if not good.any():
        return np.zeros(len(raw))
    out = []
    for k in range(len(_GRAMS)):
        r, g = raw[k << BITS : (k + 1) << BITS], good[k << BITS : (k + 1) << BITS]
        out.append(np.log((g + 1) / (g.sum() + len(g))) - np.log((r + 1) / (r.sum() + len(r))))
    return np.concatenate(out)


def measures(data: np.ndarray, offsets: np.ndarray, hashes: Hashes) -> dict[str, np.ndarray]:
    """The base measures of each text."""
    rows = len(offsets) - 1
    start, end, text = words(data, offsets, _SEPARATOR)
    hashes.load(data)
    h = hashes.of(start, end)
    per_text = lambda flags: _sums(flags.astype(np.int64), offsets[:-1], offsets[1:])
    inside = ~_SEPARATOR[data]
    n_words = np.bincount(text, minlength=rows)
    covered = np.zeros(len(h), bool)
    if len(h) > 2:
        same = np.flatnonzero(text[:-2] == text[2:])
        window = mix(mix(h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:])[same]
        order = np.lexsort((window, text[same]))
        w, t = window[order], text[same][order]
        equal = (w[1:] == w[:-1]) & (t[1:] == t[:-1])
        twice = np.zeros(len(w), bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        at = same[order[twice]]
        for k in range(3):
            covered[at + k] = True
    lines = np.zeros(rows, np.int64)
    whole = data.tobytes()
    for k in range(rows):
        found = [x for x in whole[offsets[k] : offsets[k + 1]].split(b"\n") if x.strip(SPACES)]
        lines[k] = len(found) - len(set(found))
    return {
        "n_words": n_words,
        "word_chars": per_text(inside & ((data & 0xC0) != 0x80)),
        "n_symbols": per_text(_SYMBOLS[data]),
        "n_dup_lines": lines,
        "n_repeat_words": np.bincount(text[covered], minlength=rows),
    }


def quality(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """Base measures, ``base_failed``, ``kept`` and ``llr`` of every row of ``docs``.

    Trusted are all documents labelled with quality 1. A null text is empty; a text without n-grams, or a corpus
    without trusted texts, has the ratio 0. Repeated rows each give a row and count each.
    """
    docs = only(docs, "doc_id", "text")
    good = only(labels, "doc_id", "quality").filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    weights = docs.sparkSession.sparkContext.broadcast(ratios(*count_grams(docs, good)))
    schema = docs.select("doc_id").schema
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for name in names:
        schema = schema.add(name, "long")
    schema = schema.add("llr", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, hashes = weights.value, Hashes()
        for batch in batches:
            for first, end, data, offsets in scans(batch):
                m = measures(data, offsets, hashes)
                total, n = np.zeros(end - first), np.zeros(end - first, np.int64)
                for bucket, start, stop in grams(data, offsets):
                    total += [w[bucket[a:b]].sum() for a, b in zip(start, stop)]
                    n += stop - start
                columns = [pa.array(m[c].astype(np.int64)) for c in names]
                ids = batch.column(0).slice(first, end - first)
                yield pa.RecordBatch.from_arrays([ids, *columns, pa.array(total / np.maximum(n, 1))], names=schema.names)

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    out = docs.select("doc_id", text_bytes()).mapInArrow(run, schema).withColumn("base_failed", failed)
    return out.select("doc_id", *names, "base_failed", (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"), "llr")
