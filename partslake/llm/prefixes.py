"""Prefix trie of conversations by hashing of fixed-length blocks of turns.

A node is a distinct sequence of first turns. A turn's digest depends on the turn and its
place, so the digest of a sequence is a sum, and the digest before a block is a running sum
over the blocks of a conversation, cut into chunks where one is very long.

Conversations that are alike before a block are siblings. They are first grouped by the
digest of the whole block: where all siblings have the same one, its nodes have the same
members, and one conversation stands for them all. Only in blocks where siblings diverge are
the turns of every sibling looked at.

Values over subtrees are sums over members, so no level of the trie waits for another. A
conversation owns the nodes whose smallest member it is: one run of depths down to its end.
Let its lead be the characters before that run. Within the subtree of a node, the characters
that were not stored again are, for each member but the owner, its lead beyond the node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partslake.llm.common import only
from partslake.plans.running import int_chunk, numbered, running
from partslake.session import cut_lineage

# Turns of a block.
BLOCK = 4
# Conversations whose id shares all but the last two digits share a head of less than six turns.
FAMILY, HEADS = 100, 6
# Conversations of a group of siblings above which it is joined apart from the others.
MANY = 1 << 12
# Ids written into one piece of a list of ids.
PIECE_IDS = 1 << 14

# A digest: four sums of 32-bit numbers, each below 2**63 for 2**31 turns.
_AT = ["l0", "l1", "l2", "l3"]
_BEFORE = ["b0", "b1", "b2", "b3"]


def _digest(*columns: Column) -> list[Column]:
    """Two longs of 60 bits of the SHA-256 of the columns' texts."""
    parts = [p for c in columns for p in (F.length(c).cast("string"), F.lit(":"), c)]
    digest = F.sha2(F.concat(*parts), 256)
    return [F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("long") for k in range(2)]


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (from 0), the digest ``d0``, ``d1`` of role and text, and ``chars`` of the text.

    Turns are ordered by ``turn``, null first, then by digest. A null role or text is the
    empty one. Repeated rows are turns of their own. Rows without a conv_id are left out.
    """
    turns = only(conversations, "conv_id", "turn", "role", "text").filter(F.col("conv_id").isNotNull())
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    first, second = _digest(role, text)
    turns = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", first.alias("d0"), second.alias("d1"), F.length(text).cast("long").alias("chars")
    )
    placed = numbered(turns, ["conv_id"], ["turn", "d0", "d1"], "_place")
    return placed.select("conv_id", (F.col("_place") - 1).alias("pos"), "d0", "d1", "chars")


def with_heads(turns: DataFrame, *, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns and all ``conv_id``: the first h turns are those of the family's first conversation.

    That is the one whose id is the id less its remainder by ``family``; h is the crc32 of
    the id as text modulo ``heads``. Its first h turns (all if fewer, none if there is no such
    conversation) are followed by the own turns after the first h, if any.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    first = F.col("conv_id") - F.col("conv_id") % family
    lead = turns.filter((F.col("conv_id") % family == 0) & (F.col("pos") < heads - 1)).withColumnRenamed("conv_id", "_first")
    held = lead.groupBy("_first").agg(F.count(F.lit(1)).alias("_held"))
    ids = cut_lineage(turns.select("conv_id").distinct())
    shared = ids.withColumn("_first", first).join(lead, "_first").filter(F.col("pos") < h).select(*turns.columns)
    own = turns.filter(F.col("pos") >= h).withColumn("_first", first).join(held, "_first", "left")
    moved = F.col("pos") - h + F.least(h, F.coalesce("_held", F.lit(0)))
    return shared.union(own.withColumn("pos", moved).select(*turns.columns)), ids


def _uniform(columns: list[str]) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & (F.min(c) == F.max(c))
    return same


def trie(turns: DataFrame, ids: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, pos, d0, d1, chars).

    ``ids`` has every conv_id once, also of conversations without turns, which are members
    of the root alone. Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``
    (null at the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and the
    digest ``l0`` to ``l3`` of the node's turns. Without a conversation there is no node.
    """
    seeds = [F.xxhash64("pos", "d0", "d1"), F.xxhash64("d1", F.lit(1), "d0", "pos")]
    lanes = [x for s in seeds for x in (s.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(s, 32))]
    placed = turns.select("conv_id", "pos", "chars", F.floor(F.col("pos") / block).cast("long").alias("block"), *[x.alias(c) for x, c in zip(lanes, _AT)])
    placed = cut_lineage(placed)

    sums = {"chars": "c", **dict(zip(_AT, _AT))}
    blocks = cut_lineage(placed.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums]))
    upto = running(blocks, ["conv_id"], ["block"], int_chunk("block"), sums={f"up_{c}": F.col(c) for c in sums})
    upto = upto.select(
        "conv_id", "block", "n", *_AT, (F.col("up_chars") - F.col("chars")).alias("c"), *[(F.col(f"up_{a}") - F.col(a)).alias(b) for a, b in zip(_AT, _BEFORE)]
    )
    upto = cut_lineage(upto)

    # siblings by the digest before the block; the block's own digest tells whether they diverge
    key = ["block", *_BEFORE]
    siblings = upto.groupBy(*key).agg(F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("low"), _uniform(["n", *_AT]).alias("alike"))
    siblings = cut_lineage(siblings)
    rows = upto.drop("n", *_AT)
    # groups with many members are few: a small table, which Spark sends to the rows
    many = cut_lineage(siblings.filter(F.col("members") > MANY))
    rest = rows.join(many.select(*key), key, "left_anti").join(siblings.filter(F.col("members") <= MANY), key)
    members = cut_lineage(rest.unionByName(rows.join(many, key)))
    shown = members.filter(~F.col("alike") | (F.col("conv_id") == F.col("low")))
    inside = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        shown.withColumn("n", F.when(F.col("alike"), F.col("members")).otherwise(1))
        .join(placed, ["conv_id", "block"])
        .select(
            "conv_id", "block", "n", "alike", (F.col("pos") + 1).alias("depth"),
            (F.col("c") + F.sum("chars").over(inside) - F.col("chars")).alias("c"),
            *[(F.col(b) + F.sum(a).over(inside)).alias(a) for a, b in zip(_AT, _BEFORE)],
            *[(F.col(b) + F.sum(a).over(inside) - F.col(a)).alias(b) for a, b in zip(_AT, _BEFORE)],
        )
    )
    rows = cut_lineage(rows)

    node = ["depth", *_AT]
    root = ids.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    zero = [F.lit(0).cast("long").alias(x) for x in ("depth", *_AT)]
    none = [F.lit(None).cast("long").alias(x) for x in _BEFORE]
    found = rows.groupBy(*node).agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("c").alias("c"), *[F.min(b).alias(b) for b in _BEFORE])
    found = found.unionByName(root.select(*zero, "n_convs", "conv_id", F.lit(0).cast("long").alias("c"), *none))
    found = cut_lineage(found)
    above = [(F.col("depth") - 1).alias("depth"), *[F.col(b).alias(a) for a, b in zip(_AT, _BEFORE)]]
    children = found.filter("depth > 0").groupBy(*above).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(found.join(children, node, "left").fillna(0, ["n_children"]))

    # of each conversation: its lead, and whether the last node it owns is a leaf
    owned = nodes.groupBy("conv_id").agg(F.min("c").alias("lead"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    total = blocks.groupBy("conv_id").agg(F.sum("chars").alias("total"))
    leads = ids.join(total, "conv_id", "left").join(owned, "conv_id", "left")
    leads = cut_lineage(leads.select("conv_id", F.coalesce("lead", "total", F.lit(0)).alias("lead"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf")))

    parts = [F.sum("lead").alias("leads"), F.min("lead").alias("least"), F.sum("leaf").alias("leaves")]
    apart = rows.filter(~F.col("alike")).select("conv_id", *node).join(leads, "conv_id").groupBy(*node).agg(*parts)
    together = members.filter(F.col("alike") & (F.col("members") > 1)).select("conv_id", "low", "block").join(leads, "conv_id")
    together = together.groupBy(F.col("low").alias("conv_id"), "block").agg(*parts)
    chains = rows.filter(F.col("alike") & (F.col("n") > 1)).select("conv_id", "block", *node).join(together, ["conv_id", "block"]).drop("conv_id", "block")
    top = leads.agg(*parts).filter(F.col("leaves").isNotNull()).select(*zero, "leads", "least", "leaves")
    values = apart.union(chains.select(*apart.columns)).union(top.select(*apart.columns))

    parents = nodes.select(F.col("conv_id").alias("parent_conv_id"), *[F.col(c).alias(f"_{c}") for c in node])
    up = (F.col("depth") - 1 == F.col("_depth")) & (F.col("depth") > 0)
    for a, b in zip(_AT, _BEFORE):
        up = up & (F.col(b) == F.col(f"_{a}"))
    # a node that only its owner passes has no row of values: it leads to one leaf and saves nothing
    saved = F.col("leads") - F.col("least") - (F.col("n_convs") - 1) * F.col("c")
    return (
        nodes.join(values, node, "left").join(parents, up, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
            F.coalesce(saved, F.lit(0)).alias("saved_tokens"), *_AT,
        )
    )


def ends(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """``depth``, the digest ``l0`` to ``l3`` and ``conv_id`` of each conversation's whole sequence."""
    seeds = [F.xxhash64("pos", "d0", "d1"), F.xxhash64("d1", F.lit(1), "d0", "pos")]
    lanes = [x for s in seeds for x in (s.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(s, 32))]
    whole = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), *[F.sum(x).alias(c) for x, c in zip(lanes, _AT)])
    return ids.join(whole, "conv_id", "left").fillna(0, ["depth", *_AT]).select("depth", *_AT, "conv_id")


def listed(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys`` with ``sha256`` (hex) of the comma-joined ascending ``value`` of each group.

    Groups may be of any size: ranges of (keys, value) are joined into pieces over all
    tasks, and a group's pieces are hashed one after the other as they stream past.
    ``keys`` and ``value`` are longs without null.
    """
    sort = [*keys, value]
    kinds = ", ".join(f"{k} long" for k in keys)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:-1]])
            place = np.arange(batch.num_rows)
            start = np.maximum.accumulate(np.where(new, place, 0))
            first = np.flatnonzero((place - start) % PIECE_IDS == 0)
            end = np.append(first[1:], batch.num_rows)
            values = columns[-1].astype(str)
            text = [",".join(values[a:b]) for a, b in zip(first.tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays([*[pa.array(c[first]) for c in columns], pa.array(text)], names=[*sort, "_text"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def out() -> pa.RecordBatch:
            made = [pa.array([k[i] for k, _ in done], pa.int64()) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays([*made, pa.array([h for _, h in done], pa.string())], names=[*keys, "sha256"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *here, _, text in zip(*columns):
                if here != key:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = here, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield out()
            done = []
        if state:
            done.append((key, state.hexdigest()))
            yield out()

    ranged = rows.select(*sort).repartitionByRange(*sort).sortWithinPartitions(*sort)
    joined = ranged.mapInArrow(pieces, f"{kinds}, {value} long, _text string")
    return joined.repartition(*keys).sortWithinPartitions(*sort).mapInArrow(hashed, f"{kinds}, sha256 string")


def prefix_trie(conversations: DataFrame, *, block: int = BLOCK, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Nodes of the rebuilt ``conversations`` (conv_id, turn, role, text) with ``ends_sha256``.

    See ``with_heads`` for the rebuilding and ``trie`` for the columns; ``ends_sha256`` is
    the SHA-256 of the ascending comma-joined ids of the conversations that end at the node.
    An empty table gives no row. Further columns are not looked at.
    """
    rebuilt, ids = with_heads(cut_lineage(turns_of(conversations)), family=family, heads=heads)
    rebuilt = cut_lineage(rebuilt)
    at = ["depth", *_AT]
    nodes = trie(rebuilt, ids, block=block)
    finished = listed(ends(rebuilt, ids), at, "conv_id")
    return nodes.join(finished, at, "left").withColumn("ends_sha256", F.coalesce("sha256", F.sha2(F.lit(""), 256))).drop("sha256", *_AT)


def with_text(nodes: DataFrame, conversations: DataFrame, *, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """``nodes`` with ``role`` and ``text`` of the last turn of each, null at the root."""
    turns = turns_of(conversations)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    first, second = _digest(role, text)
    texts = only(conversations, "role", "text").select(first.alias("d0"), second.alias("d1"), role.alias("role"), text.alias("text"))
    rebuilt, _ = with_heads(cut_lineage(turns), family=family, heads=heads)
    last = rebuilt.select("conv_id", (F.col("pos") + 1).alias("depth"), "d0", "d1")
    return nodes.join(last, ["conv_id", "depth"], "left").join(texts.dropDuplicates(["d0", "d1"]), ["d0", "d1"], "left").drop("d0", "d1")
