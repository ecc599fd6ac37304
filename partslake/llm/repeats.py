"""Repeated passages by distributed prefix doubling.

Every byte position is a suffix; ranking all of them would move the corpus many times over,
so suffixes are ranked at anchors only. The anchor of a position is the smallest of the
hashed ``GRAM``-byte strings starting at it or at the next ``window - 1`` bytes, the first of
equal ones. It depends on bytes of the position's ``length``-byte string alone, so equal
strings have their anchors at the same place, and an anchor stands for all positions that
chose it. Nothing is lost, and about one position in ``window / 2`` is ranked.

Spark sorts (rank, name of the bytes that follow) pairs of the anchors at growing offsets and
ranks them anew; an anchor whose pair is unique drops out. The last offset is the prefix
that all strings of an anchor share. The survivors' positions are then settled with the
bytes on both sides: together where the whole stretch is repeated; else in runs of ``RUN``
positions; else one by one. Of equal stretches one goes on, so copies do not add up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partslake.llm.common import Hashes, Tables, mix, only, scans, text_bytes

LENGTH = 400
WINDOW, GRAM, RUN = 256, 24, 16
# Keys of texts, 16 bytes each, that are broadcast at most; as many keys with very many rows.
BROADCAST_KEYS = 1 << 20
# Rows of one key that are sent to one task, unless that makes too many keys to broadcast.
KEY_ROWS = 2048
_KEY = ["_id", "_hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Id and text, with a key of both; rows equal in both share it and are told apart by count."""
    docs = only(docs, "doc_id", "text")
    return docs.select("doc_id", text_bytes(), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), F.xxhash64("text").alias("_hash"))


def anchors(data: np.ndarray, offsets: np.ndarray, hashes: Hashes, length: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each anchor with the first and last position that chose it. ``window`` is a power of two."""
    room = np.diff(offsets) - length + 1
    texts = np.flatnonzero(room > 0)
    none = np.zeros(0, np.int64)
    if not len(texts):
        return none, none, none
    at = np.arange(len(data) - gram + 1)
    bits = np.uint64(int(len(data)).bit_length())
    least = (hashes.of(at, at + gram) >> bits << bits) | at.astype(np.uint64)
    span = 1
    while span < window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    n = room[texts]
    starts = np.repeat(offsets[texts] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    chosen = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    return chosen[first], starts[first], starts[np.append(first[1:], len(starts)) - 1]


def _positions(docs: DataFrame, length: int, window: int, gram: int, cuts: list[int]) -> DataFrame:
    """A row per anchor: key, place, names of its prefix piece by piece, and of the whole stretch.

    ``place`` has the anchor's offset and, in its low bytes, how far before it the first and
    the last position lie that chose it.
    """
    names = [f"_n{k}" for k in range(len(cuts))]
    schema = "_id long, _hash long, place long, whole long, " + ", ".join(f"{n} long" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, other = Hashes(), Hashes(1)
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for top, _, data, offsets in scans(batch):
                if len(data) < length:
                    continue
                hashes.load(data)
                other.load(data)
                a, i, j = anchors(data, offsets, hashes, length, window, gram)
                text = np.searchsorted(offsets, a, side="right") - 1
                place = (a - offsets[text]) << 16 | (a - i) << 8 | (a - j)
                # where in the stretch the anchor lies is part of what must be equal
                whole = other.of(i, j + length) ^ mix((place & 0xFFFF).astype(np.uint64))
                pieces = [hashes.of(a + p, a + q).view(np.int64) for p, q in zip([0, *cuts], cuts)]
                columns = [ids[top + text], keys[top + text], place, whole.view(np.int64), *pieces]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[*_KEY, "place", "whole", *names])

    return docs.select(*_KEY, "text").mapInArrow(run, schema)


def _among(tables: Tables, rows: DataFrame, counted: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of the rows whose keys are in ``counted``, which has the number ``_n`` of rows of each.

    Rows of a key are dealt over parts of bounded size, so a passage that very many texts
    share is no single task. Keys of more than one part are few: all rows over the part's size.
    """
    size = max(KEY_ROWS, rows.count() // BROADCAST_KEYS)
    parts = tables.keep(counted.select(*keys, F.ceil(F.col("_n") / size).alias("_parts")))
    many = F.broadcast(parts.filter(F.col("_parts") > 1))
    part = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_parts")), F.lit(0))
    dealt = rows.join(many, keys, "left").withColumn("_part", part)
    wanted = parts.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))
    out = tables.keep(dealt.join(wanted, [*keys, "_part"], "left_semi").select(*columns))
    tables.drop(parts)
    return out


def _several(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys of more than one row, with their number ``_n``."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)


def _settle(tables: Tables, rows: DataFrame, group: str, content: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose content is repeated within their group; and for each group with several contents one row of each."""
    kinds = tables.keep(rows.groupBy(group, content).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*keep)).alias("_one")))
    settled = _among(tables, rows.select(*keep, group, content), kinds.filter(F.col("_n") > 1), [group, content], keep)
    open_ = _among(tables, kinds.select(group, "_one.*"), _several(kinds, group), [group], [group, *keep])
    tables.drop(kinds)
    return settled, open_


def _with_texts(keyed: DataFrame, rows: DataFrame, what: list[str]) -> DataFrame:
    """Key, text and ``at``, the rows of each text that has any. A text comes once, however often it is repeated."""
    at = rows.groupBy(*_KEY).agg(F.collect_list(F.struct(*what)).alias("at"))
    return _asked(keyed, rows).select(*_KEY, "text").dropDuplicates(_KEY).join(at, _KEY)


def _asked(keyed: DataFrame, rows: DataFrame, how: str = "left_semi") -> DataFrame:
    """Texts that have rows (or have none, for ``left_anti``), before any text moves.

    The keys are broadcast up to ``BROADCAST_KEYS``, counted first; more are joined by a shuffle.
    """
    keys = rows.select(*_KEY).distinct()
    return keyed.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, _KEY, how)


def _runs(texts: DataFrame, length: int, size: int) -> DataFrame:
    """Runs of positions of each anchor: ``group`` (rank, run and what the run's strings share), ``span`` (all its bytes), ``low`` (first position and number behind it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, other = Hashes(2), Hashes(3)
        for batch in batches:
            for i, h, text, at in zip(*(batch.column(c) for c in range(4))):
                data = np.frombuffer(text.as_py(), np.uint8)
                hashes.load(data)
                other.load(data)
                packed, rank = (at.values.field(n).to_numpy() for n in range(2))
                place = packed >> 16
                first, last = place - ((packed >> 8) & 0xFF), place - (packed & 0xFF)
                # run t holds the positions place - t*size down to place - t*size - size + 1
                low_run, high_run = (place - last) // size, (place - first) // size
                n = high_run - low_run + 1
                of = np.repeat(np.arange(len(n)), n)
                t = np.repeat(low_run - (np.cumsum(n) - n), n) + np.arange(n.sum())
                top = place[of] - t * size
                low, high = np.maximum(top - size + 1, first[of]), np.minimum(top, last[of])
                group = mix(hashes.of(top, top - size + 1 + length) ^ mix(rank[of].view(np.uint64) + t.astype(np.uint64)))
                span = other.of(low, high + length) ^ mix(((top - low) << 8 | (top - high)).astype(np.uint64))
                columns = [np.full(len(of), i.as_py()), np.full(len(of), h.as_py()), group.view(np.int64), span.view(np.int64), low << 8 | (high - low)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*_KEY, "group", "span", "low"])

    return texts.mapInArrow(run, "_id long, _hash long, group long, span long, low long")


def _singles(texts: DataFrame, length: int) -> DataFrame:
    """Each position of the runs in ``at`` (low, group) with the name of its string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(3)
        for batch in batches:
            for i, h, text, at in zip(*(batch.column(c) for c in range(4))):
                hashes.load(np.frombuffer(text.as_py(), np.uint8))
                packed, group = (at.values.field(n).to_numpy() for n in range(2))
                n = (packed & 0xFF) + 1
                start = np.repeat((packed >> 8) - (np.cumsum(n) - n), n) + np.arange(n.sum())
                columns = [np.full(len(start), i.as_py()), np.full(len(start), h.as_py()), start, np.repeat(group, n), hashes.of(start, start + length).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*_KEY, "start", "group", "single"])

    return texts.mapInArrow(run, "_id long, _hash long, start long, group long, single long")


def repeated_stretches(tables: Tables, keyed: DataFrame, *, length: int = LENGTH, window: int = WINDOW, gram: int = GRAM, run_size: int = RUN) -> list[DataFrame]:
    """Tables of (key, begin, end): stretches of bytes covered by repeated strings of ``length`` bytes."""
    if window & (window - 1) or window > 256 or run_size > window or window + gram - 1 > length:
        raise ValueError("window must be a power of two up to 256 and fit into length with gram")
    prefix = length + 1 - window  # what every string of an anchor holds
    cuts = sorted({max(1, prefix // 2), prefix})
    alive = tables.keep(_positions(keyed, length, window, gram, cuts))
    for k in range(len(cuts)):
        # rank of the doubled prefix: the rank so far and the name of the bytes behind it
        ranked = alive.withColumn("_rank", F.xxhash64("_rank", f"_n{k}") if k else F.col("_n0"))
        names = [f"_n{j}" for j in range(k + 1, len(cuts))]
        left = _among(tables, ranked, _several(ranked, "_rank"), ["_rank"], [*_KEY, "place", "whole", "_rank", *names])
        tables.drop(alive)
        alive = left
    whole, open_ = _settle(tables, alive, "_rank", "whole", [*_KEY, "place"])
    tables.drop(alive)
    runs = tables.keep(_runs(_with_texts(keyed, open_, ["place", "_rank"]), length, run_size))
    tables.drop(open_)
    parts, open_ = _settle(tables, runs, "group", "span", [*_KEY, "low"])
    tables.drop(runs)
    one = tables.keep(_singles(_with_texts(keyed, open_, ["low", "group"]), length))
    tables.drop(open_)
    single = _among(tables, one, _several(one, "group", "single"), ["group", "single"], [*_KEY, "start"])
    tables.drop(one)
    at = F.shiftright("place", 16)
    return [
        whole.select(*_KEY, (at - F.shiftright("place", 8).bitwiseAND(255)).alias("begin"), (at - F.col("place").bitwiseAND(F.lit(255)) + length).alias("end")),
        parts.select(*_KEY, F.shiftright("low", 8).alias("begin"), (F.shiftright("low", 8) + F.col("low").bitwiseAND(F.lit(255)) + length).alias("end")),
        single.select(*_KEY, F.col("start").alias("begin"), (F.col("start") + length).alias("end")),
    ]


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, window: int = WINDOW, gram: int = GRAM, run_size: int = RUN) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept``, the bytes left.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in the
    same text or another. A null text is empty. Rows equal in id and text are texts of their
    own, so each is a copy of the other. Texts are read whole, however long.
    """
    keyed, tables = _keyed(docs), Tables(docs.sparkSession)
    found = repeated_stretches(tables, keyed, length=length, window=window, gram=gram, run_size=run_size)
    # a set, as rows that share their key have each stretch several times
    spans = tables.keep(found[0].union(found[1]).union(found[2]).groupBy(*_KEY).agg(F.collect_set(F.struct("begin", "end")).alias("spans")))
    touched = _asked(keyed, spans).join(spans, _KEY).select("doc_id", "spans", "text")
    intact = _asked(keyed, spans, "left_anti").select("doc_id", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), "text")
    joined = touched.union(intact)
    schema = keyed.select("doc_id").schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("kept", "binary")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py()
                removed, n, at, kept = 0, 0, 0, []
                for begin, end in sorted((s["begin"], s["end"]) for s in spans or ()):
                    if begin > at or not n:
                        kept.append(text[at:begin])
                        n += 1
                        at = begin
                    removed += max(0, end - at)
                    at = max(at, end)
                rest = b"".join([*kept, text[at:]])
                out.append((len(text), removed, n, hashlib.sha256(rest).hexdigest(), rest))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return joined.mapInArrow(run, schema)
