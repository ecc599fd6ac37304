"""SimHash near-duplicates by a self-join of a binary trie.

Distinct fingerprints form a binary trie. Pairs of its nodes are walked down together
from (root, root): a pair's children are paired, differing bits add up, and a pair whose
differing bits exceed the budget is dropped with all below it. Spark walks the top: every
fingerprint is a row of each surviving pair its prefix belongs to, and pairs with too many
rows for one task take more bits, so a hot prefix is split like any other. The rest of a
pair is walked inside one task, in numpy, depth first and in chunks of bounded size.

A task reports a spanning forest of its links, not all links, which leaves the components
as they are. Copies of one fingerprint are a single trie leaf and are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partslake.llm.common import only, text_bytes
from partslake.llm.components import components
from partslake.session import cut_lineage

SHINGLE_WORDS = 3
MAX_BITS = 2
# Rows of a node pair that one task takes; larger pairs are walked further by Spark.
PAIR_ROWS = 1 << 18
# Bits walked in one round by Spark.
STEP_BITS = 4
# Node pairs held at once inside a task, the size below which two nodes are compared one by
# one, and the pairs of such nodes compared at once.
CHUNK, LEAF, LEAVES = 1 << 18, 32, 1 << 6
# Shingles whose bits are counted at once.
_SLICE = 1 << 14


def fingerprint(text: bytes, shingle: int) -> int:
    """A bit is set if it is set in over half the XXH64 (seed 42) of the shingles."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the six separators
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), 42)
    columns = [words[k : len(words) - shingle + 1 + k] for k in range(shingle)]
    counts, n = np.zeros(64, np.int64), len(columns[0])
    hashes = np.fromiter((digest(s, 42) for s in map(b" ".join, zip(*columns))), np.uint64, n)
    for first in range(0, n, _SLICE):
        bits = np.unpackbits(hashes[first : first + _SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int((2 * counts > n).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprints(docs: DataFrame, keep: list[str], *, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """The columns ``keep`` with ``fp``, the 64 bits as a signed long. Texts are read whole.

    A text of fewer words than a shingle has its word sequence as its only shingle; one
    without words, or null, has 0.
    """
    schema = docs.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(batch.num_columns - 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp.view(np.int64))], names=schema.names)

    return docs.select(*keep, text_bytes().alias("_text")).mapInArrow(run, schema)


class Trie:
    """Nodes of a binary trie over sorted fingerprints, level by level as they are asked for."""

    def __init__(self, values: np.ndarray, depth: int):
        """All of ``values`` share their first ``depth`` bits."""
        self.values, self.depth = values, depth
        self.levels = [(np.zeros(1, np.int32), np.array([len(values)], np.int32))]
        self.below: list[tuple[np.ndarray, np.ndarray]] = []

    def ranges(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First and end position of each node of a level."""
        return self.levels[depth - self.depth]

    def children(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Child under bit 0 and under bit 1 of each node of a level, -1 for none."""
        while len(self.below) <= depth - self.depth:
            lo, hi = self.levels[-1]
            bit = np.uint64(1) << np.uint64(63 - self.depth - len(self.below))
            head = ~(bit | (bit - np.uint64(1)))
            mid = np.searchsorted(self.values, (self.values[lo] & head) | bit).astype(np.int32)
            there = np.stack([mid > lo, hi > mid], axis=1)
            number = np.where(there, np.cumsum(there).reshape(there.shape) - 1, -1).astype(np.int32)
            self.levels.append((np.stack([lo, mid], axis=1)[there], np.stack([mid, hi], axis=1)[there]))
            self.below.append((number[:, 0].copy(), number[:, 1].copy()))
        return self.below[depth - self.depth]


def walk(a: np.ndarray, b: np.ndarray, depth: int, err: int, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in sorted ``a`` and ``b`` of fingerprints at ``max_bits`` bits or fewer.

    All of ``a`` share their first ``depth`` bits, all of ``b`` too; these differ in ``err``.
    With ``a`` itself as ``b``, each unordered pair comes once.
    """
    left = Trie(a, depth)
    right = left if a is b else Trie(b, depth)
    span = np.arange(LEAF, dtype=np.int32)
    stack = [(depth, np.zeros(1, np.int32), np.zeros(1, np.int32), np.array([err], np.int8))]
    while stack:
        depth, x, y, err = stack.pop()
        if len(x) > CHUNK:
            half = len(x) // 2
            stack += [(depth, x[:half], y[:half], err[:half]), (depth, x[half:], y[half:], err[half:])]
            continue
        (alo, ahi), (blo, bhi) = left.ranges(depth), right.ranges(depth)
        leaf = (np.maximum((ahi - alo)[x], (bhi - blo)[y]) <= LEAF) | (depth == 64)
        p, q = x[leaf], y[leaf]
        for first in range(0, len(p), LEAVES):
            some = slice(first, first + LEAVES)
            i, j = alo[p[some], None] + span, blo[q[some], None] + span
            near = np.bitwise_count(a[np.minimum(i, len(a) - 1)][:, :, None] ^ b[np.minimum(j, len(b) - 1)][:, None, :]) <= max_bits
            pair, m, n = np.nonzero(near)
            i, j = i[pair, m], j[pair, n]
            real = (i < ahi[p[some]][pair]) & (j < bhi[q[some]][pair])
            yield i[real], j[real]
        x, y, err = x[~leaf], y[~leaf], err[~leaf]
        if not len(x):
            continue
        (a0, a1), (b0, b1) = left.children(depth), right.children(depth)
        a0, a1, b0, b1 = a0[x], a1[x], b0[y], b1[y]
        spare = err < max_bits
        # a node paired with itself has its mixed pair of children only once
        for p, q, may, bits in ((a0, b0, True, 0), (a1, b1, True, 0), (a0, b1, spare, 1), (a1, b0, spare & (x != y) if left is right else spare, 1)):
            alive = np.flatnonzero((p >= 0) & (q >= 0) & may)
            if len(alive):
                stack.append((depth + 1, p[alive], q[alive], err[alive] + np.int8(bits)))


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` positions the smallest one it is linked to, over any number of links."""
    root = np.arange(n)
    for i, j in links:
        while True:
            ri, rj = root[i], root[j]
            open_ = ri != rj
            if not open_.any():
                break
            i, j, ri, rj = i[open_], j[open_], ri[open_], rj[open_]
            np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
            while (root[root] != root).any():
                root = root[root]
    while (root[root] != root).any():
        root = root[root]
    return root


def _prefix(bits: Column, n: int) -> Column:
    """The first ``n`` bits."""
    return F.shiftrightunsigned(bits, 64 - n) if n else F.lit(0).cast("long")


def _expand(rows: DataFrame, depth: int, step: int, max_bits: int) -> DataFrame:
    """Rows of the node pairs one step further down.

    ``rows``: fp, p, q (prefixes of the pair's nodes, p <= q), err. A fingerprint of node p
    goes to each pair of its next prefix with one below q that keeps to the budget, and one
    of node q likewise; in a pair (p, p) each unordered pair of children is one pair.
    """
    if depth + step > 64:
        step = 64 - depth
    own = _prefix(F.col("fp"), depth + step)
    masks = [m for m in range(1 << step) if bin(m).count("1") <= max_bits]
    other_root = F.when(F.col("side") == 0, F.col("q")).otherwise(F.col("p"))
    low = F.col("own").bitwiseAND(F.lit((1 << step) - 1))
    out = (
        rows.withColumn("own", own)
        .withColumn("m", F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("x"), F.lit(bin(m).count("1")).alias("e")) for m in masks])))
        .withColumn("err", F.col("err") + F.col("m.e"))
        .filter(F.col("err") <= max_bits)
        .withColumn("other", F.shiftleft(other_root, step).bitwiseOR(low.bitwiseXOR(F.col("m.x"))))
    )
    # within (p, p) both ends come from the same rows: the side is given by the order
    same = F.col("p") == F.col("q")
    side = F.when(same, F.when(F.col("own") <= F.col("other"), 0).otherwise(1)).otherwise(F.col("side"))
    return out.withColumn("side", side).select(
        "fp",
        F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("p"),
        F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("q"),
        "side",
        "err",
    )


def links(distinct: DataFrame, *, max_bits: int = MAX_BITS, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """Edges (a, b) of a spanning forest of the links between the values of ``fp``."""
    rows = distinct.select("fp", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(0).alias("side"), F.lit(0).alias("err"))
    n, depth, found = distinct.count(), 0, []
    # one step at least, so that there are pairs for many tasks; then as even prefixes would
    # need, while uneven ones are found by counting
    while depth < STEP_BITS or n >> depth > pair_rows // 2 and depth < 64 - STEP_BITS:
        rows, depth = _expand(rows, depth, STEP_BITS, max_bits), depth + STEP_BITS

    def finish(done: DataFrame, depth: int) -> DataFrame:
        def pair(frame: pd.DataFrame) -> pd.DataFrame:
            fp = frame["fp"].to_numpy().view(np.uint64)
            side, err = frame["side"].to_numpy(), int(frame["err"].iloc[0])
            if frame["p"].iloc[0] == frame["q"].iloc[0]:
                a = b = np.unique(fp)
                ends = a
                root = forest(len(a), walk(a, a, depth, err, max_bits))
            else:
                a, b = np.sort(fp[side == 0]), np.sort(fp[side == 1])
                ends = np.concatenate([a, b])
                root = forest(len(ends), ((i, j + len(a)) for i, j in walk(a, b, depth, err, max_bits)) if len(a) and len(b) else iter(()))
            linked = root != np.arange(len(root))
            return pd.DataFrame({"a": ends[root[linked]].view(np.int64), "b": ends[linked].view(np.int64)})

        return done.groupBy("p", "q").applyInPandas(pair, "a long, b long")

    while True:
        large = rows.groupBy("p", "q").count().filter((F.col("count") > pair_rows) & F.lit(depth < 64))
        large = cut_lineage(large.select("p", "q"))
        if large.isEmpty():
            found.append(finish(rows, depth))
            break
        found.append(finish(rows.join(large, ["p", "q"], "left_anti"), depth))
        rows = cut_lineage(_expand(rows.join(large, ["p", "q"], "left_semi"), depth, STEP_BITS, max_bits))
        depth = min(64, depth + STEP_BITS)
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    return edges


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Fingerprints at ``max_bits`` differing bits or fewer are linked; ``component_id`` is the
    smallest id reachable over links. Texts without words share the fingerprint 0 and are
    linked like others. Repeated rows each give a row. A null id is ignored as a component
    id unless all ids of the component are null.
    """
    fps = cut_lineage(fingerprints(only(docs, "doc_id", "text"), ["doc_id"], shingle=shingle))
    nodes = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(nodes.select("fp"), max_bits=max_bits)).withColumnRenamed("node", "fp")
    joined = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = joined.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest id.

    Rows with a null id all stay; of rows that share their id one stays.
    """
    groups = near_duplicates(docs, shingle=shingle, max_bits=max_bits)
    keep = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept")).distinct()
    with_id = docs.join(keep, F.col("doc_id") == F.col("_kept"), "left_semi").dropDuplicates(["doc_id"])
    return with_id.union(docs.filter(F.col("doc_id").isNull()))
