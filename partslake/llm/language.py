"""Language identification: nearest of several clustered centroids per language.

A text becomes a TF-IDF vector of hashed byte 1- to 3-grams, scaled to length 1. Each
language has up to ``CLUSTERS`` centroids from spherical k-means, and a text gets the
language of the centroid with the highest cosine. A text farther from its centroid than
nearly all texts the centroid was made of is marked ``rejected``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partslake.llm.common import only, remainder, scans, table_of, text_bytes

DIM = 4096
# Texts learnt from: per language, and in all.
PER_LANGUAGE, SAMPLE_ROWS = 1_500, 12_000
CLUSTERS, STEPS = 3, 8
# Share of a centroid's own texts that lie below its lowest accepted cosine.
REJECTED_SHARE = 0.005

# ASCII letters in lower case and bytes of other alphabets stay, the rest becomes a space.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_SPACE = table_of(b" ")


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``DIM`` counts for each text."""
    rows = len(offsets) - 1
    # a space on both sides of each text; runs of spaces are cut to one
    spread = np.full(len(data) + 2 * rows, 32, np.uint8)
    text = np.repeat(np.arange(rows), np.diff(offsets))
    spread[np.arange(len(data)) + 2 * text + 1] = _LETTERS[data]
    owner = np.repeat(np.arange(rows), np.diff(offsets) + 2)
    space = _SPACE[spread]
    kept = np.ones(len(spread), bool)
    kept[1:] = ~(space[1:] & space[:-1] & (owner[1:] == owner[:-1]))
    b, owner = spread[kept].astype(np.uint32), owner[kept]
    out = np.zeros(rows * DIM)
    for n in (1, 2, 3):
        count = len(b) - n + 1
        if count <= 0:
            continue
        h = np.full(count, n, np.uint32)
        for j in range(n):
            h = (h ^ b[j : j + count]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        own = owner[:count]
        same = own == owner[n - 1 :]
        out += np.bincount(own[same] * DIM + (h[same] & np.uint32(DIM - 1)), minlength=rows * DIM)
    return out.reshape(rows, DIM)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(length == 0, 1.0, length)


def clustered(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of spherical k-means, and the lowest accepted cosine of each.

    Starts from the text nearest to the mean, then from the text farthest from the
    centroids so far, so the result depends on the rows alone.
    """
    start = [v[(v @ v.mean(axis=0)).argmax()]]
    while len(start) < min(CLUSTERS, len(v)):
        start.append(v[(v @ np.array(start).T).max(axis=1).argmin()])
    centroids = np.array(start)
    for _ in range(STEPS):
        nearest = (v @ centroids.T).argmax(axis=1)
        for k in range(len(centroids)):
            if (nearest == k).any():
                mean = v[nearest == k].mean(axis=0)
                centroids[k] = mean / max(np.linalg.norm(mean), 1e-12)
    cosine = v @ centroids.T
    nearest, best = cosine.argmax(axis=1), cosine.max(axis=1)
    lowest = [np.quantile(best[nearest == k], REJECTED_SHARE) if (nearest == k).any() else 1.0 for k in range(len(centroids))]
    return centroids, np.array(lowest)


def train(docs: DataFrame, *, fold: tuple[int, int] | None = None, per_language: int = PER_LANGUAGE, rows: int = SAMPLE_ROWS) -> dict:
    """Learn from documents with a language, text and id, by smallest hash of the id.

    At most ``per_language`` of a language and ``rows`` in all, taking turns over the
    languages. ``fold`` (n, r) leaves out ids whose crc32 modulo n is r. Only the
    document frequencies (``DIM`` numbers) and centroids reach the driver.
    """
    has_letter = F.col("text").rlike(r"\p{L}")
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & has_letter)
    if fold:
        usable = usable.filter(remainder("doc_id", fold[0]) != fold[1])
    at = F.xxhash64(F.col("doc_id").cast("string"))
    turn = Window.partitionBy("lang").orderBy("_at", "doc_id")
    chosen = (
        usable.select("doc_id", "lang", at.alias("_at"))
        .withColumn("_turn", F.row_number().over(turn))
        .filter(F.col("_turn") <= per_language)
        .orderBy("_turn", "_at", "doc_id")
        .limit(rows)
        .select("doc_id", "lang")
        .distinct()
    )
    sample = usable.select("doc_id", "lang", text_bytes()).join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM + 1, np.int64), 0
        for batch in batches:
            for first, end, data, offsets in scans(batch):
                df[:DIM] += (gram_counts(data, offsets) > 0).sum(axis=0)
                n += end - first
        df[DIM] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1), pa.int32()), pa.array(df)], names=["gram", "n"])

    total = sample.mapInArrow(frequency, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(DIM + 1)
    df[total["gram"].to_numpy()] = total["n"].to_numpy()
    idf = np.log((1.0 + df[DIM]) / (1.0 + df[:DIM])) + 1.0

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        batch = pa.RecordBatch.from_pydict({"text": pa.array(sorted(frame["text"]), pa.binary())})
        v = np.concatenate([vectors(gram_counts(data, offsets), idf).astype(np.float32) for _, _, data, offsets in scans(batch)])
        centroids, lowest = clustered(v)
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "centroid": list(centroids.astype(float)), "lowest": lowest})

    fitted = sample.groupBy("lang").applyInPandas(fit, "lang string, centroid array<double>, lowest double").toPandas()
    fitted = fitted.sort_values("lang", kind="stable")
    return {
        "idf": idf,
        "lang": fitted["lang"].tolist(),
        "centroid": np.array(fitted["centroid"].tolist()).reshape(len(fitted), DIM),
        "lowest": fitted["lowest"].to_numpy(),
    }


def predict(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``lang_pred``, ``score`` (cosine) and ``rejected``.

    ``und`` with score 0 for a null text, one without a letter, or a model without any
    language. Of equal cosines the first language by name wins. Very long texts are read
    whole; repeated rows each give a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ready = docs.select(*keep, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter"), text_bytes().alias("_text"))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        centroids, names = m["centroid"].astype(np.float32).T, np.array([*m["lang"], "und"], object)
        for batch in batches:
            letter = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False).astype(bool)
            best, cosine = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
            if len(names) > 1:
                for first, end, data, offsets in scans(batch, "_text"):
                    c = vectors(gram_counts(data, offsets), m["idf"]).astype(np.float32) @ centroids
                    best[first:end], cosine[first:end] = c.argmax(axis=1), c.max(axis=1)
            best[~letter], cosine[~letter] = len(names) - 1, 0.0
            rejected = cosine < np.append(m["lowest"], np.inf)[best]
            columns = [pa.array(names[best], pa.string()), pa.array(np.clip(cosine, 0.0, 1.0)), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], names=schema.names)

    return ready.mapInArrow(run, schema)


def language(docs: DataFrame, *, fold: tuple[int, int] | None = (4, 2)) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` and ``rejected`` of every row.

    Rows with the remainder ``fold[1]`` are not learnt from and are marked ``held_out``.
    """
    docs = only(docs, "doc_id", "text", "lang")
    out = predict(docs, train(docs, fold=fold), ["doc_id"])
    held = remainder("doc_id", fold[0]) == fold[1] if fold else F.lit(False)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
