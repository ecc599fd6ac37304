"""Packing: token pieces into sequences of fixed length, shortest pack first over the histogram.

Texts are tokenised and cut into pieces of at most ``LENGTH`` tokens. Only the histogram of
piece lengths, at most ``LENGTH`` numbers, reaches the driver. Lengths are placed longest
first; each goes to the pattern with the most room, else to a new one. Patterns with their
counts then give every piece its sequence by the rank of the piece among those of its length.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from tokenizers import Tokenizer

from partslake.llm.common import only, scans, text_bytes
from partslake.session import cut_lineage

LENGTH, END_ID = 2048, 1
# Words whose ids a Python worker remembers, bits to tell words met before from new ones,
# and unknown words encoded as one text.
REMEMBERED, MET, JOINED = 400_000, 1 << 22, 256


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, remembering the ids of frequent words.

    A byte-level tokeniser without normaliser never merges across the border between a
    character that is no space and a space after it. So a text is cut there, each part has
    the ids it has within the text, and parts not yet known are encoded together. Any other
    tokeniser encodes whole texts.
    """

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_str(definition)
        # kinds of the parts that this cut is exact for
        parts = json.loads(definition)
        pre = parts.get("pre_tokenizer") or {}
        self.cuts = (
            (pre.get("type"), pre.get("use_regex", True), pre.get("add_prefix_space")) == ("ByteLevel", True, False)
            and not parts.get("normalizer")
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or " " in t["content"] for t in parts.get("added_tokens", []))
        )
        size = self.tokenizer.get_vocab_size()
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.known: dict[str, bytes] = {"": b""}
        self.met = bytearray(MET)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of each part with a space before it; empty for a part that ends in white space."""
        out = {p: b"" for p in parts if p[-1].isspace()}
        parts = [p for p in parts if not p[-1].isspace()]
        groups = [parts[first : first + JOINED] for first in range(0, len(parts), JOINED)]
        encoded = self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)
        for some, found in zip(groups, encoded):
            ids = np.array(found.ids, "<u4")
            cut = np.append(np.flatnonzero(self.opens[ids]), len(ids)) * 4
            data, cut = ids.tobytes(), cut.tolist()
            out.update((p, data[a:b]) for p, a, b in zip(some, cut, cut[1:]))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self.whole(texts)
        split = [t.split(" ") for t in texts]
        known = self.known
        new = self.learn(list({p for parts in split for p in parts[1:] if p not in known}))
        if len(known) < REMEMBERED:
            # most words are met once only; the second time one is remembered
            met, places = self.met, {p: hash(p) % MET for p in new}
            known.update((p, new[p]) for p, at in places.items() if met[at])
            for at in places.values():
                met[at] = 1
        heads = self.whole([parts[0] for parts in split])
        out = []
        for parts, head in zip(split, heads):
            rest = [ids if (ids := known.get(p)) is not None else new[p] for p in parts[1:]]
            if b"" in rest or not parts[0] or parts[0][-1].isspace():
                out.append(self.glued(parts))
            else:
                out.append(head + b"".join(rest))
        return out

    def glued(self, parts: list[str]) -> bytes:
        """As ``encode`` where spaces follow other white space: such parts stay together."""
        units, open_ = [], None
        for p in parts:
            open_ = p if open_ is None else f"{open_} {p}"
            if open_ and not open_[-1].isspace():
                units.append(open_)
                open_ = None
        if open_ is not None:
            units.append(open_)
        return b"".join(self.whole([units[0], *[" " + u for u in units[1:]]]))


def encoder_of(definition: str) -> Encoder:
    """The encoder of this Python worker, which keeps its words from task to task."""
    kept = sys.__dict__.setdefault("_partslake_encoders", {})
    if definition not in kept:
        kept.clear()
        kept[definition] = Encoder(definition)
    return kept[definition]


def cut(docs: DataFrame, tokenizer: str, keep: list[str], *, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``length`` ids of each text followed by ``end_id``.

    Columns: ``keep``, start, length, ids_crc32, doc_tokens, and with ``with_ids`` the ids.
    ``_part`` and ``_nth`` number the pieces of a length within the task that made them. A
    null text is empty and has one piece of one id. Repeated rows are separate texts.
    """
    with open(tokenizer, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = docs.select(*keep).schema
    for name, kind in (("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("_part", "integer"), ("_nth", "long")):
        schema = schema.add(name, kind)
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))
    last = np.array([end_id], "<u4").tobytes()
    names, width = schema.names, length * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(definition.value), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for first, end, _, _ in scans(batch, "_text"):
                row, start, size, crc, total, nth, ids = [], [], [], [], [], [], []
                encoded = encoder.encode([str(t, "utf-8", "replace") for t in texts.slice(first, end - first).to_pylist()])
                for k, data in enumerate(encoded, first):
                    data += last
                    for at in range(0, len(data), width):
                        piece = data[at : at + width]
                        n = len(piece) // 4
                        row.append(k)
                        start.append(at // 4)
                        size.append(n)
                        crc.append(crc32(piece))
                        total.append(len(data) // 4)
                        nth.append(seen[n])
                        seen[n] += 1
                        if with_ids:
                            ids.append(np.frombuffer(piece, "<i4"))
                made = [pa.array(x, pa.int64()) for x in (start, size, crc, total)]
                made += [pa.array(np.full(len(row), part, np.int32)), pa.array(nth, pa.int64())]
                if with_ids:
                    made.append(pa.array(ids, pa.list_(pa.int32())))
                kept = batch.take(pa.array(row, pa.int64())).columns[:-1]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=names)

    return docs.select(*keep, text_bytes().alias("_text")).mapInArrow(run, schema)


def patterns(histogram: dict[int, int], length: int) -> list[tuple[int, list[int]]]:
    """(count, lengths) of each packing pattern for ``histogram`` (length: count)."""
    room: dict[int, list[tuple[int, list[int]]]] = {}
    most = -1
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            while most >= 0 and not room.get(most):
                most -= 1
            if most >= size:  # the shortest pack takes one more
                count, inside = room[most].pop()
                taken = min(left, count)
                if taken < count:
                    room[most].append((count - taken, inside))
                room.setdefault(most - size, []).append((taken, [*inside, size]))
                left -= taken
            else:  # new packs, each with as many as fit
                fits = length // size
                for count, inside in ((left // fits, fits), (1, left % fits)):
                    if count and inside:
                        rest = length - size * inside
                        room.setdefault(rest, []).append((count, [size] * inside))
                        most = max(most, rest)
                left = 0
    return [p for rest in sorted(room) for p in room[rest]]


def slots(packs: list[tuple[int, list[int]]], length: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, copies in a pack, first sequence and first offset of its stretches of ranks."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for count, inside in packs:
        offset = 0
        for size in sorted(set(inside), reverse=True):
            copies = inside.count(size)
            start = taken.get(size, 0)
            table.setdefault(size, []).append((start, copies, first, offset))
            taken[size] = start + count * copies
            offset += copies * size
        first += count
    return {size: tuple(np.array(x, np.int64) for x in zip(*rows)) for size, rows in table.items()}


def pack(pieces: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """``pieces`` (from ``cut``) with ``sequence_id`` and ``offset``, without ``_part`` and ``_nth``.

    Sequence ids run from 0 without gaps, and offsets in a sequence from 0 without gaps.
    An empty table gives no row.
    """
    pieces = cut_lineage(pieces)  # a task's numbering must stay as it is
    counts = pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = pieces.sparkSession.sparkContext.broadcast(slots(patterns(histogram, length), length))
    ranked = pieces.join(starts, ["_part", "length"]).withColumn("_rank", F.col("_nth") + F.col("_before"))
    ranked = ranked.select(*[c for c in pieces.columns if c not in ("_part", "_nth")], "_rank")
    schema = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")
    at = ranked.columns.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            size, rank = batch.column(at).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            edges = np.append(np.flatnonzero(np.diff(size[order], prepend=-1)), len(order))
            for a, b in zip(edges, edges[1:]):
                rows = order[a:b]
                n = int(size[rows[0]])
                start, copies, first, base = table[n]
                k = np.searchsorted(start, rank[rows], side="right") - 1
                into = rank[rows] - start[k]
                sequence[rows] = first[k] + into // copies[k]
                offset[rows] = base[k] + into % copies[k] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and its ``ids``, from packed pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def packing(docs: DataFrame, tokenizer: str, *, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(cut(only(docs, "doc_id", "text"), tokenizer, ["doc_id"], length=length), length=length)
