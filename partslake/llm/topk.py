"""Exact top-k by inner product over an impact-ordered, score-at-a-time index.

Vectors lie in blocks, and a block's components are postings (dimension, vector, value) in
segments by quantised impact: level 0 holds the largest absolute values, each further level
those up to half as large. A search takes the segments in that order and adds each to the
scores. What is left of a vector cannot add more than the product of its remaining length
and the query's, so each score has proven bounds. Once few vectors can still be among the
best k, the search stops and scores those exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partslake.session import cut_lineage, scratch

SCALE, K = 256, 5
BLOCK_ROWS = 4096
LEVELS = 6
# Queries of one block, and query blocks that are broadcast at once.
QUERY_ROWS, QUERY_BLOCKS = 256, 256


def scaled(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``id`` and ``x``, the floors of ``SCALE`` times each component, of whole and finite vectors."""
    v = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{column}`").cast("array<double>").alias("v")).filter("id is not null and v is not null")
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(F.coalesce(usable, F.lit(False))).select("id", F.transform("v", lambda x: F.floor(x * SCALE).cast("long")).alias("x"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (block, dim, ids, values): up to ``size`` vectors of one dimension, as 64-bit bytes.

    Each task cuts what it reads into blocks, so no row moves and no block depends on a key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        nth, part = 0, TaskContext.get().partitionId()

        def full(dim: int) -> pa.RecordBatch:
            nonlocal nth
            ids, x = zip(*waiting.pop(dim))
            nth += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | nth], pa.int64()), pa.array([dim], pa.int32()),
                    pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.array(x, np.int64).tobytes()], pa.binary()),
                ],
                names=["block", "dim", "ids", "values"],
            )

        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(1)
            starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for k, i in enumerate(ids):
                x = flat[starts[k] : starts[k + 1]]
                own = waiting.setdefault(len(x), [])
                own.append((i, x))
                if len(own) == size:
                    yield full(len(x))
        for dim in list(waiting):
            yield full(dim)

    return rows.mapInArrow(run, "block long, dim int, ids binary, values binary")


class Block:
    """Index of one block: its postings by level, and how much of each vector each level leaves."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        size = np.abs(x)
        top = max(1, int(size.max(initial=0)))
        # level of a posting: how often the largest value halves before the value is reached
        level = np.minimum(np.floor(np.log2(top / np.maximum(size, 1))).astype(int), LEVELS - 1)
        self.segments, self.left = [], []
        rest = x.astype(np.float64)
        for k in range(LEVELS):
            self.segments.append(np.where(level == k, x, 0).astype(np.float64).T)
            rest = np.where(level == k, 0.0, rest)
            self.left.append(np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-9))

    def search(self, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position of query and vector and their score: the best ``k`` of this block for each query."""
        real = q.astype(np.float64)
        length = np.sqrt((real * real).sum(axis=1)) * (1 + 1e-9)
        own = ids[:, None] == self.ids[None, :]
        score = np.zeros((len(ids), len(self.ids)))
        n = min(k, len(self.ids))
        for segment, left in zip(self.segments, self.left):
            score += real @ segment
            slack = np.outer(length, left) + 1e-9 * np.abs(score)
            low = np.where(own, -np.inf, score - slack)
            least = np.partition(low, len(self.ids) - n, axis=1)[:, len(self.ids) - n]
            possible = (score + slack >= least[:, None]) & ~own
            if possible.sum() <= 4 * k * len(ids):
                break
        row, col = np.nonzero(possible)
        exact = (q[row] * self.x[col]).sum(axis=1)
        order = np.lexsort((self.ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        return row[rank < k], col[rank < k], exact[rank < k]


def top_k(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", column: str = "embedding", k: int = K) -> DataFrame:
    """The ``k`` highest scores of each query: query_id, rank (from 1), vec_id, score.

    The score is the integer inner product of scaled vectors; ties go to the smaller id, and
    rows with the query's own id are no candidates. Vectors that are null or hold a null or a
    number that is not finite take no part; vectors of other length are not compared. Rows
    that repeat an id are candidates each on its own and one query, the first by values.
    """
    rows = cut_lineage(scaled(vectors, id_col, column))
    index = cut_lineage(blocks(rows, BLOCK_ROWS))
    asked = rows.withColumnRenamed("id", id_col).filter(is_query).withColumnRenamed(id_col, "id").groupBy("id").agg(F.min("x").alias("x"))
    queries = cut_lineage(blocks(asked, QUERY_ROWS))
    numbers = sorted(r["block"] for r in queries.select("block").collect())
    spark, folder = vectors.sparkSession, scratch(vectors.sparkSession, "topk")
    schema = "query_id long, vec_id long, score long"
    for first in range(0, max(1, len(numbers)), QUERY_BLOCKS):
        some = queries.filter(F.col("block").isin(numbers[first : first + QUERY_BLOCKS])).collect()
        shared = spark.sparkContext.broadcast([(r["dim"], bytes(r["ids"]), bytes(r["values"])) for r in some])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = [(d, np.frombuffer(i, np.int64), np.frombuffer(v, np.int64)) for d, i, v in shared.value]
            for batch in batches:
                for dim, ids, values in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                    ids = np.frombuffer(ids, np.int64)
                    block = Block(ids, np.frombuffer(values, np.int64).reshape(len(ids), dim))
                    for d, qid, q in whole:
                        if d == dim:
                            row, col, score = block.search(qid, q.reshape(len(qid), dim), k)
                            yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(ids[col]), pa.array(score)], names=["query_id", "vec_id", "score"])

        index.mapInArrow(run, schema).write.mode("append").parquet(folder)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema(schema).parquet(folder).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
