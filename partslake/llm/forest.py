"""Near-duplicates by an LSH forest of MinHash signatures.

A text is the set of its word shingles, as 64-bit hashes; texts of one set are one node.
Each of ``TREES`` trees orders the nodes by a signature of ``DEPTH`` minima. A region is a
run of nodes with a common prefix: ``LEAST`` minima where few nodes share them, more where
many do. Nodes of a region are compared by a sketch of 128 bits, which keeps all but a
millionth of the similar pairs, and what passes is settled on the whole sets.

No region emits its pairs. First each node names one partner, so a group of copies gives as
many pairs as nodes; the settled ones make components. Then only nodes of different
components are paired. Regions that still hold many such pairs, or are too large for a task,
are joined into groups whose nodes are all compared on whole sets, block against block
inside tasks that return a spanning forest.

Links may first be sought by SimHash (``trie_joined``): the trie self-join names the candidates,
whole sets settle them, and the forest is left with what lies across the components made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partslake.llm.common import SPACES, Hashes, lowered, mix, only, scans, table_of, text_bytes, words
from partslake.llm.components import components
from partslake.llm.simhash import SHINGLE_WORDS as PRINT_WORDS
from partslake.llm.simhash import fingerprint, links
from partslake.plans.running import numbered, top_rows
from partslake.session import cut_lineage

SHINGLE_WORDS = 3
# Least similarity, as numerator and denominator.
SIMILAR = (85, 100)
# Trees, minima of a tree's signature, and the least prefix: of pairs of 0.85, one in 10**8
# shares no prefix of 4 in any tree, and 5 in 10**4 none of 8.
TREES, DEPTH, LEAST = 24, 8, 4
# Bits of the sketch, and standard deviations by which it may miss a similar pair.
BITS, SIGMAS = 128, 5
# Nodes of a region above which a longer prefix is taken, and those one task takes at once.
REGION, SLICE = 128, 4096
# First nodes of a larger region that all its slices see.
LEADERS = 64
# Pairs per node of a region above which it goes to the blocks, and nodes of a block.
DENSE, BLOCK = 16, 1024
# Shingles whose minima are taken at once, and nodes a task remembers to have met.
_SLICE, _HELD = 1 << 12, 1 << 20
# Bits of the map of wanted nodes that is broadcast; a full map only lets more sets pass.
MAP_BITS = 26

_SEPARATOR = table_of(SPACES)
_RANDOM = np.random.default_rng(20_240_613)
_TIMES = _RANDOM.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RANDOM.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_SALT = _RANDOM.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_NODE = "node long, n long, low long, s0 long, s1 long, comp long"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, hashes: Hashes, width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, ascending.

    A text of fewer words than a shingle has its word sequence as its only shingle; one
    without words has none.
    """
    data, rows = lowered(data), len(offsets) - 1
    start, end, text = words(data, offsets, _SEPARATOR)
    hashes.load(data)
    h = np.append(hashes.of(start, end), np.zeros(width, np.uint64))
    n = np.bincount(text, minlength=rows)
    first = np.cumsum(n) - n
    left = first[text] + n[text] - np.arange(len(text))  # words from here to the end of the text
    out = np.zeros(len(text), np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(3) + np.where(left > k, h[k : k + len(text)], 0))
    for a, size in zip(first.tolist(), n.tolist()):
        yield np.unique(out[a : a + max(size - width + 1, min(size, 1))])


def _sets(batch: pa.RecordBatch, hashes: Hashes, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Name and shingles of each text of a batch."""
    for _, _, data, offsets in scans(batch, "_text"):
        for s in shingle_sets(data, offsets, hashes, width):
            yield xxhash.xxh64_intdigest(s.tobytes(), 42), s


def signature(shingles: np.ndarray) -> bytes:
    """The minima of all trees, 16 bits of each, and the sketch: one further bit of the first ``BITS``."""
    low = np.full(len(_TIMES), 0xFFFFFFFF, np.uint32)
    x = shingles.astype(np.uint32)
    for first in range(0, len(x), _SLICE):
        low = np.minimum(low, (x[first : first + _SLICE, None] * _TIMES + _PLUS).min(axis=0))
    mixed = mix(low.astype(np.uint64) ^ _SALT)
    return mixed.astype(np.uint16).tobytes() + np.packbits((mixed[:BITS] >> np.uint64(40)).astype(np.uint8) & 1).tobytes()


def least_size(similar: tuple[int, int]) -> int:
    """Shingles that a set needs to have a similar one that is not the same."""
    up, down = similar
    return -(-up // (down - up)) if down > up else 1 << 62


def signed(docs: DataFrame, keep: list[str], width: int, least: int, shingle: int | None = None) -> DataFrame:
    """The columns ``keep`` with ``node``, ``n`` (size of the set) and ``sig``; with ``shingle`` also ``fp``, the SimHash of such shingles.

    ``sig`` and ``fp`` are null where a set is too small to have a similar one, and for a node that
    the task has met before.
    """
    schema = docs.select(*keep).schema.add("node", "long").add("n", "long").add("sig", "binary")
    if shingle:
        schema = schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, met = Hashes(), set()
        for batch in batches:
            node, n, sig, fp = [], [], [], []
            for (name, s), text in zip(_sets(batch, hashes, width), batch.column("_text")):
                new = len(s) >= least and name not in met
                node.append(name)
                n.append(len(s))
                sig.append(signature(s) if new else None)
                if shingle:
                    fp.append(np.uint64(fingerprint(text.as_py(), shingle)).view(np.int64) if new else None)
                met.add(name)
            if len(met) > _HELD:
                met.clear()
            made = [pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(sig, pa.binary())]
            made += [pa.array(fp, pa.int64())] if shingle else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=schema.names)

    return docs.select(*keep, text_bytes().alias("_text")).mapInArrow(run, schema)


def postings(nodes: DataFrame) -> DataFrame:
    """A row per node and tree: ``hi`` and ``lo`` (the signature, ``hi`` of ``LEAST`` minima), sketch and labels.

    ``nodes``: node, n, low, comp, sig.
    """
    names = ["hi", "lo", "node", "n", "low", "s0", "s1", "comp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(TREES, dtype=np.uint64) + np.uint64(77))
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            hi, lo = sig[:, : 2 * TREES : 2] ^ salt, sig[:, 1 : 2 * TREES : 2]
            node, n, low, comp = (np.repeat(batch.column(c).to_numpy(), TREES) for c in ("node", "n", "low", "comp"))
            s0, s1 = (np.repeat(sig[:, 2 * TREES + k].view(np.int64), TREES) for k in range(2))
            columns = [hi.ravel().view(np.int64), np.ascontiguousarray(lo).ravel().view(np.int64), node, n, low, s0, s1, comp]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return nodes.select("node", "n", "low", "comp", "sig").mapInArrow(run, "hi long, lo long, " + _NODE)


def regions(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``posts`` with ``region``, at most about ``SLICE`` rows each, and those prefixes that had to be sliced.

    Prefixes of ``LEAST`` minima are regions unless shared by too many nodes; these go by
    whole signatures, and a signature shared by too many is cut into slices that all hold
    its first nodes (``lead``). Such prefixes are few: their counts are a small table.
    """
    deep = cut_lineage(posts.groupBy("hi").agg(F.count(F.lit(1)).alias("_deep")).filter(F.col("_deep") > SLICE))
    counts = posts.join(deep, "hi", "left_semi").groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("_count"))
    sliced = cut_lineage(counts.filter(F.col("_count") > SLICE).select("hi", "lo", F.ceil(F.col("_count") / SLICE).alias("_slices")))
    out = posts.withColumn("lead", F.lit(False))
    if deep.isEmpty():
        return out.withColumn("region", F.col("hi")), sliced
    out = out.join(deep, "hi", "left").join(sliced, ["hi", "lo"], "left")
    slice_of = F.pmod(F.col("node"), F.coalesce("_slices", F.lit(1)))
    region = F.when(F.col("_deep").isNull(), F.col("hi")).otherwise(F.xxhash64("hi", "lo", slice_of))
    out = out.withColumn("region", region).drop("_deep", "_slices")
    lead = top_rows(posts.join(sliced, ["hi", "lo"]), ["hi", "lo"], [F.col("low"), F.col("node")], LEADERS)
    lead = lead.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1)))
    lead = lead.withColumn("lead", F.lit(True)).withColumn("region", F.xxhash64("hi", "lo", "_slice"))
    return out.unionByName(lead.select(*out.columns)), sliced


def most_differing(similar: tuple[int, int]) -> int:
    """Bits of a sketch in which a similar pair may differ."""
    half = (1 - similar[0] / similar[1]) / 2
    return math.ceil(BITS * half + SIGMAS * math.sqrt(BITS * half * (1 - half)))


class Region:
    """Nodes of one region by arrays, sorted by prefix."""

    def __init__(self, columns: dict[str, np.ndarray], similar: tuple[int, int]):
        self.up, self.down = similar
        self.differ = most_differing(similar)
        self.__dict__.update(columns)

    def runs(self, first: int, end: int, depth: int) -> Iterator[tuple[int, int]]:
        """Stretches that share a prefix as long as their size asks for."""
        if end - first < 2:
            return
        if end - first <= REGION or depth == DEPTH:
            yield first, end
            return
        key = self.lo[first:end].view(np.uint64) >> np.uint64(16 * (DEPTH - depth - 1))
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1 + first
        for a, b in zip([first, *cut.tolist()], [*cut.tolist(), end]):
            yield from self.runs(a, b, depth + 1)

    def near(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Which of ``rows`` and ``others`` may be similar, by sketch and size."""
        apart = np.bitwise_count(self.s0[rows, None] ^ self.s0[others]).astype(np.int16) + np.bitwise_count(self.s1[rows, None] ^ self.s1[others])
        x, y = self.n[rows, None], self.n[others]
        fits = self.down * np.minimum(x, y) >= self.up * np.maximum(x, y)
        return (apart <= self.differ) & fits & (self.node[rows, None] != self.node[others])


def _scan(batches: Iterator[pa.RecordBatch], similar: tuple[int, int]) -> Iterator[tuple[Region, list[tuple[int, int]]]]:
    """Regions with their runs, of batches sorted by region and signature. A region's end may lie in the next batch."""
    rest: list[pa.RecordBatch] = []

    def take(table: pa.Table) -> Iterator[tuple[Region, list[tuple[int, int]]]]:
        columns = {c: table[c].to_numpy() for c in table.column_names}
        for c in ("s0", "s1"):
            columns[c] = columns[c].view(np.uint64)
        all_rows = Region(columns, similar)
        key = columns["region"]
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        first, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        found = []
        for a, b in zip(*(x[end - first > 1].tolist() for x in (first, end))):
            found += all_rows.runs(a, b, LEAST)
        yield all_rows, found

    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        key = batch.column("region").to_numpy()
        if rest[0].column("region")[0].as_py() == key[-1]:
            continue  # one region so far
        end = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        yield from take(pa.Table.from_batches([*rest[:-1], batch.slice(0, end)]))
        rest = [batch.slice(end)]
    if rest:
        yield from take(pa.Table.from_batches(rest))


def _sorted(posts: DataFrame) -> DataFrame:
    return posts.repartition("region").sortWithinPartitions("region", "lo", "low", "node")


def partners(posts: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """``node`` and ``other``: for each node with any candidate of another component, that of the smallest id over all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, found in _scan(batches, similar):
            made = [[], []]
            for a, b in found:
                inside = np.arange(a, b)
                inside = inside[np.argsort(r.low[a:b], kind="stable")]
                for part in range(0, len(inside), 512):
                    rows = inside[part : part + 512]
                    near = r.near(rows, inside) & (r.comp[rows, None] != r.comp[inside])
                    some = near.any(axis=1)
                    made[0].append(rows[some])
                    made[1].append(inside[near.argmax(axis=1)[some]])
            if made[0]:
                i, j = map(np.concatenate, made)
                yield pa.RecordBatch.from_arrays([pa.array(r.node[i]), pa.array(r.node[j]), pa.array(r.low[j])], names=["node", "other", "low"])

    out = _sorted(posts).mapInArrow(run, "node long, other long, low long")
    return out.groupBy("node").agg(F.min_by("other", "low").alias("other"))


def crossing(posts: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Candidates ``a`` < ``b`` of different components; of runs with very many, all rows with ``run``, the name of the run.

    Pairs have a null ``run``; rows of a dense run have a null ``b``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, found in _scan(batches, similar):
            made = [np.zeros((0, 2), np.int64)]
            dense, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in found:
                inside = np.arange(a, b)
                if (r.comp[a:b] == r.comp[a]).all():
                    continue
                pairs, held = [], 0
                for part in range(0, len(inside), 512):
                    rows = inside[part : part + 512]
                    near = r.near(rows, inside) & (r.comp[rows, None] != r.comp[inside]) & (r.node[rows, None] < r.node[inside])
                    i, j = np.nonzero(near)
                    held += len(i)
                    if held > DENSE * len(inside):
                        break
                    pairs.append(np.stack([r.node[rows[i]], r.node[inside[j]]], axis=1))
                if held > DENSE * len(inside):
                    dense.append(r.node[a:b])
                    names.append(np.full(b - a, r.node[a:b].min()))
                else:
                    made += pairs
            two, one = np.concatenate(made), np.concatenate(dense)
            left = pa.concat_arrays([pa.array(two[:, 0]), pa.array(one)])
            right = pa.concat_arrays([pa.array(two[:, 1]), pa.nulls(len(one), pa.int64())])
            label = pa.concat_arrays([pa.nulls(len(two), pa.int64()), pa.array(np.concatenate(names))])
            yield pa.RecordBatch.from_arrays([left, right, label], names=["a", "b", "run"])

    return _sorted(posts).mapInArrow(run, "a long, b long, run long").distinct()


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``node`` and ``shingles`` of the nodes of ``wanted``."""
    key = F.col("node").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    marked = wanted.groupBy(F.shiftright(key, 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(node & 63)))").alias("bits")).toArrow()
    bits = np.zeros(1 << MAP_BITS - 6, np.uint64)
    bits[marked["word"].to_numpy()] = marked["bits"].to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, want, met = Hashes(), shared.value, set()
        for batch in batches:
            node, found = [], []
            for name, s in _sets(batch, hashes, width):
                slot = name & ((1 << MAP_BITS) - 1)
                if int(want[slot >> 6]) >> (slot & 63) & 1 and name not in met:
                    met.add(name)
                    node.append(name)
                    found.append(s.tobytes())
            if len(met) > _HELD:
                met.clear()
            yield pa.RecordBatch.from_arrays([pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(found, pa.binary())], names=["node", "shingles"])

    whole = docs.select(text_bytes().alias("_text")).mapInArrow(run, "node long, shingles binary")
    return whole.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def alike(x: np.ndarray, y: np.ndarray, similar: tuple[int, int]) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return similar[1] * both >= similar[0] * (len(x) + len(y) - both)


def settled(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similar) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def block_links(rows: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Links (a, b) that join all nodes of each ``run`` that any chain of similar sets joins.

    Runs that share a node are one group. A group's nodes are numbered by size and cut into
    blocks; each pair of blocks whose sizes allow it is one task, which compares whole sets
    of nodes not joined yet and returns a spanning forest of what it found.
    """
    group = components(rows.select("a", F.col("run").alias("b"))).withColumnRenamed("root", "g")
    own = rows.select(F.col("a").alias("node"), "n", "comp", "s0", "s1").dropDuplicates(["node"]).join(group, "node", "left")
    own = numbered(own.withColumn("g", F.coalesce("g", "node")), ["g"], ["n", "node"], "_place")
    own = cut_lineage(own.withColumn("block", F.floor((F.col("_place") - 1) / BLOCK)).drop("_place"))
    up, down = similar
    spans = cut_lineage(own.groupBy("g", "block").agg(F.min("n").alias("least"), F.max("n").alias("most")))
    later = spans.select("g", F.col("block").alias("j"), F.col("least").alias("least_j"))
    meet = spans.join(later, "g").filter((F.col("block") <= F.col("j")) & (down * F.col("most") >= up * F.col("least_j"))).select("g", F.col("block").alias("i"), "j")
    meet = cut_lineage(meet)
    own = cut_lineage(own.join(sets, "node"))
    sides = [own.join(meet.select("g", "i", "j", F.col(s).alias("block")), ["g", "block"]).withColumn("side", F.lit(s)) for s in "ij"]

    def pair(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("node").reset_index(drop=True)
        columns = {c: frame[c].to_numpy() for c in ("node", "n", "comp", "s0", "s1")}
        columns["s0"], columns["s1"] = columns["s0"].view(np.uint64), columns["s1"].view(np.uint64)
        r = Region(columns, similar)
        sets = [np.frombuffer(s, np.uint64) for s in frame["shingles"]]
        _, root = np.unique(r.comp, return_inverse=True)
        found, everything = [], np.arange(len(frame))
        for part in range(0, len(frame), 256):
            rows = everything[part : part + 256]
            for i, j in zip(*(x.tolist() for x in np.nonzero(r.near(rows, everything)))):
                i += part
                if i < j and root[i] != root[j] and alike(sets[i], sets[j], similar):
                    found.append((r.node[i], r.node[j]))
                    root[root == root[j]] = root[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return sides[0].unionByName(sides[1]).groupBy("g", "i", "j").applyInPandas(pair, "a long, b long")


def trie_joined(texts: DataFrame, nodes: DataFrame, *, width: int, similar: tuple[int, int], max_bits: int) -> tuple[DataFrame, DataFrame]:
    """``node`` and ``root`` of nodes that the SimHash trie links and whole sets confirm; and ``node`` and ``shingles`` of those tried.

    ``nodes``: node, fp, sig. Nodes of one fingerprint are tried against the first of them, and first
    ones as the trie's self-join links their fingerprints, at ``max_bits`` bits or fewer.
    """
    large = nodes.filter(F.col("sig").isNotNull()).select("node", "fp")
    first = cut_lineage(large.groupBy("fp").agg(F.min("node").alias("first")))
    same = large.join(first, "fp").filter(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b"))
    ends = [first.select(F.col("fp").alias(c), F.col("first").alias(f"node_{c}")) for c in "ab"]
    across = links(first.select("fp"), max_bits=max_bits).join(ends[0], "a").join(ends[1], "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    pairs = cut_lineage(same.union(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    tried = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = cut_lineage(sets_of(texts, tried, width))
    return cut_lineage(components(settled(pairs, sets, similar))), sets


def linked(texts: DataFrame, nodes: DataFrame, *, width: int, similar: tuple[int, int], max_bits: int | None = None) -> DataFrame:
    """``node`` and ``root`` of every node that has a similar one. ``nodes``: node, n, low, sig, with ``max_bits`` also fp."""
    large = nodes.filter(F.col("sig").isNotNull()).withColumn("low", F.coalesce("low", F.lit((1 << 63) - 1)))
    start, joined = large.withColumn("comp", F.col("node")), None
    if max_bits is not None:
        joined, held = trie_joined(texts, nodes, width=width, similar=similar, max_bits=max_bits)
        start = large.join(joined, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    posts, _ = regions(postings(start))
    first = cut_lineage(partners(posts, similar))
    asked = first.select("node")
    if joined is None:
        sets = cut_lineage(sets_of(texts, asked, width))
    else:
        asked = cut_lineage(asked.union(joined.select("node")).distinct())
        sets = held.union(cut_lineage(sets_of(texts, asked.join(held, "node", "left_anti"), width)))
    tried = first.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    tried = cut_lineage(tried)
    edges = settled(tried, sets, similar)
    if joined is not None:
        edges = edges.union(joined.select(F.col("node").alias("a"), F.col("root").alias("b")))
    edges = cut_lineage(edges)
    roots = cut_lineage(components(edges))

    # what is similar and not joined yet lies across components
    labelled = large.join(asked, "node", "left_semi").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    labelled = cut_lineage(labelled)
    posts, sliced = regions(postings(labelled))
    across = cut_lineage(crossing(posts, similar))
    pairs = across.filter(F.col("run").isNull()).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    more = settled(pairs, sets, similar)
    # a sliced prefix of several components is compared as a whole
    wide = postings(labelled).join(sliced, ["hi", "lo"]).select("hi", "lo", "node", "comp")
    split = wide.groupBy("hi", "lo").agg(F.min("node").alias("run"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y")
    dense = across.filter(F.col("run").isNotNull()).select("a", "run")
    if not sliced.isEmpty():
        dense = dense.union(wide.join(split, ["hi", "lo"]).select(F.col("node").alias("a"), "run"))
    dense = cut_lineage(dense.distinct())
    if not dense.isEmpty():
        asked = labelled.join(dense.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
        sketched = postings(asked).select(F.col("node").alias("a"), "n", "comp", "s0", "s1").dropDuplicates(["a"])
        more = more.union(block_links(dense.join(sketched, "a"), sets, similar))
    more = cut_lineage(more)
    if more.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))


def classes(
    docs: DataFrame, keep: list[str], *, width: int = SHINGLE_WORDS, similar: tuple[int, int] = SIMILAR, max_bits: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Two tables: the columns ``keep`` with ``node`` and ``n`` of each row, and ``node`` with ``root`` of each node.

    With ``max_bits``, SimHash fingerprints at so many bits or fewer are linked first (``trie_joined``).
    """
    named = cut_lineage(signed(docs, keep, width, least_size(similar), None if max_bits is None else PRINT_WORDS))
    found = [F.first(c, ignorenulls=True).alias(c) for c in named.columns if c in ("sig", "fp")]
    nodes = cut_lineage(named.groupBy("node").agg(F.max("n").alias("n"), F.min("doc_id").try_cast("long").alias("low"), *found))
    roots = linked(docs, nodes, width=width, similar=similar, max_bits=max_bits)
    every = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return named.select(*keep, "node", "n"), every


def near_duplicates(docs: DataFrame, *, width: int = SHINGLE_WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Rows are linked if the sets of their shingles have a similarity of ``similar`` or more.
    ``component_id`` is the smallest id reachable over links; a null id counts only where all
    ids of the component are null, and ``kept`` compares null with null as equal. Null and
    empty texts, and those without words, are linked with nothing. Rows that share id and
    text each give a row; rows that share their id only are linked by their texts. An empty
    table gives no row, and further columns are not looked at.
    """
    texts = only(docs, "doc_id", "text")
    named, every = classes(texts, ["doc_id"], width=width, similar=similar)
    low = named.groupBy("node").agg(F.min("doc_id").alias("low")).join(every, "node")
    lowest = low.groupBy("root").agg(F.min("low").alias("component_id"))
    by_node = low.select("node", "root").join(lowest, "root").select("node", "component_id")
    out = named.join(by_node, "node")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _row_key(columns: list[str]) -> list[Column]:
    """Two longs that name a row by id and text."""
    id_, text = (F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns)
    digest = F.sha2(F.concat(F.length(id_).cast("string"), F.lit(":"), id_, text), 256)
    return [F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("long").alias(f"_k{k}") for k in range(2)]


def one_of_each(docs: DataFrame, *, width: int, similar: tuple[int, int], max_bits: int | None = None) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest id.

    ``max_bits`` is that of ``classes``: a way to find links, which does not change what is linked.
    Null ids come last; of rows with one id that with the smaller digest of the text stays,
    and of rows that share id and text any one. Texts without words are all alike.
    """
    keys = ["_k0", "_k1"]
    texts = only(docs, "doc_id", "text").select("doc_id", "text", *_row_key(["doc_id", "text"]))
    named, every = classes(texts, ["doc_id", *keys], width=width, similar=similar, max_bits=max_bits)
    rows = named.groupBy("node", "doc_id", *keys).agg(F.count(F.lit(1)).alias("copies")).join(every, "node")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *keys, "copies")
    kept = cut_lineage(rows.groupBy("root").agg(F.min(order).alias("r")).select("r.*").select(*keys, "copies").distinct())
    marked = docs.select("*", *_row_key(["doc_id", "text"]))
    single = marked.join(kept.filter("copies = 1"), keys, "left_semi")
    several = marked.join(kept.filter("copies > 1"), keys, "left_semi").dropDuplicates(keys)
    return single.union(several).select(*docs.columns)
