"""LM scoring: prediction by partial matching over a byte-context trie.

Training texts, as their lower-cased (A-Z) words with one space between and an end byte, give counts of each byte after
each context of up to ``ORDER`` bytes; these are the nodes of the trie, counted over the
whole corpus by Spark. A byte is coded in the longest context seen: with counts c, n in all
and d different bytes, it costs (2c - 1) / 2n, or the escape d / 2n and the next shorter
context, from which all bytes of the longer one are excluded. What no context knows is
uniform over the bytes left.

No count is left out, and there is one way at every size. The codes of the most frequent nodes of
full order are broadcast. The other grams of the texts meet the nodes in a join; those that
are no node, and only those, go down the orders, each a join with the counts of their contexts.
Words, for the base score, likewise: frequent ones are looked up in the task, all others by a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partslake.llm.common import SPACES, lowered, only, remainder, scans, table_of, text_bytes
from partslake.session import cut_lineage

ORDER = 5
# Nodes of full order whose codes are broadcast: 16 bytes each.
HEAD_NODES = 1 << 20
# Closes a text and fills the contexts before it; no UTF-8 text holds this byte.
END = 0xFF
# Words looked up within the task, and entries of a count table held before it is emitted.
HEAD_WORDS, HELD = 1 << 18, 1 << 19
# Longer words are never among those, so that these take 16 MB at most.
HEAD_WORD_BYTES = 64

_SEPARATOR = table_of(SPACES)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and end byte: it and the ``ORDER`` bytes before it, packed; and its text.

    The bytes are those of the words with one space between.
    """
    rows = len(offsets) - 1
    text = np.repeat(np.arange(rows), np.diff(offsets))
    apart = _SEPARATOR[data]
    first = np.ones(len(data), bool)  # after a separator, or the first of a text
    first[1:] = apart[:-1] | (text[1:] != text[:-1])
    kept = np.flatnonzero(~(apart & first))
    data, text = np.where(apart, 32, lowered(data))[kept], text[kept]
    last = np.ones(len(data), bool)
    last[:-1] = text[1:] != text[:-1]
    kept = np.flatnonzero((data != 32) | ~last)
    data, text = data[kept], text[kept]
    sizes = np.bincount(text, minlength=rows)
    spread = np.full(len(data) + rows * (ORDER + 1), END, np.uint64)
    spread[np.arange(len(data)) + text * (ORDER + 1) + ORDER] = data
    at = np.repeat(np.arange(rows), sizes + 1)
    first = np.arange(len(at)) + at * ORDER
    out = np.zeros(len(at), np.uint64)
    for k in range(ORDER + 1):
        out = (out << np.uint64(8)) | spread[first + k]
    return out, at


def count_nodes(docs: DataFrame) -> DataFrame:
    """``gram`` and ``n``: how often each byte follows each full context in ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, waiting = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            g, c = np.concatenate(held), np.concatenate(counts)
            unique, where = np.unique(g, return_inverse=True)
            return unique, np.bincount(where, c).astype(np.int64)

        def out(g: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c)], names=["gram", "n"])

        for batch in batches:
            for _, _, data, offsets in scans(batch):
                g, c = np.unique(grams(data, offsets)[0], return_counts=True)
                held.append(g)
                counts.append(c.astype(np.float64))
                waiting += len(g)
                if waiting > 4 * HELD:
                    g, c = merged()
                    if len(g) > 2 * HELD:
                        yield out(g, c)
                        held, counts, waiting = [], [], 0
                    else:
                        held, counts, waiting = [g], [c.astype(np.float64)], len(g)
        if held:
            yield out(*merged())

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def least_count(nodes: DataFrame, max_nodes: int) -> int:
    """The least count of a node if no more than ``max_nodes`` of full order are wanted."""
    spread = nodes.groupBy(F.least("n", F.lit(1_000)).alias("n")).agg(F.count(F.lit(1)).alias("nodes")).collect()
    least, kept = 1_001, 0
    for n, count in sorted(((r["n"], r["nodes"]) for r in spread), reverse=True):
        if kept + count > max_nodes:
            break
        least, kept = n, kept + count
    return least


def _last(gram: Column, order: int) -> Column:
    """The last byte of a gram and the ``order`` bytes before it."""
    return gram.bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))


def levels_of(nodes: DataFrame, least: int = 1) -> list[DataFrame]:
    """``gram`` and ``n`` of the nodes of each order from 0 to ``ORDER``, each counted from the longer ones."""
    counted = [nodes]
    for order in range(ORDER - 1, -1, -1):
        counted.insert(0, cut_lineage(counted[0].groupBy(_last(F.col("gram"), order).alias("gram")).agg(F.sum("n").alias("n"))))
    return [level.filter(F.col("n") >= least) for level in counted]


def full_order(nodes: DataFrame) -> DataFrame:
    """``gram``, ``n`` and ``code`` of the nodes of full order: nothing is excluded there, and a context has 256 at most."""
    total = F.sum("n").over(Window.partitionBy(F.shiftright("gram", 8)))
    written = cut_lineage(nodes.select("gram", "n", total.alias("total")))
    return written.select("gram", "n", F.log10((2 * F.col("n") - 1) / (2 * F.col("total"))).alias("code"))


def head_of(full: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams (ascending), codes and counts of the most frequent nodes, ``most`` or fewer.

    The least count is one step of a logarithmic scale, so nothing is sorted for it.
    """
    step = F.floor(F.log2("n") * 16)
    sizes = {r["step"]: r["nodes"] for r in full.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("nodes")).collect()}
    least, kept = max(sizes, default=0) + 1, 0
    for at in sorted(sizes, reverse=True):
        if kept + sizes[at] > most:
            break
        least, kept = at, kept + sizes[at]
    table = full.filter(step >= least).toArrow()
    g = table["gram"].to_numpy().view(np.uint64)
    rank = np.argsort(g)
    return g[rank], table["code"].to_numpy()[rank], table["n"].to_numpy()[rank]


def contexts_of(level: DataFrame, shorter: DataFrame | None, order: int, asked: DataFrame) -> DataFrame:
    """``context``, ``total``, ``kinds`` and ``hidden`` of the contexts among ``asked``.

    ``hidden`` is how often the bytes known here follow the next shorter context.
    """
    level = level.withColumn("context", F.shiftright("gram", 8)).join(asked, "context", "left_semi")
    hidden = F.lit(0).cast("long")
    if shorter is not None:
        shorter = shorter.select(F.col("gram").alias("_short"), F.col("n").alias("_n"))
        level = level.join(shorter, _last(F.col("gram"), order - 1) == F.col("_short"), "left")
        hidden = F.coalesce("_n", F.lit(0))
    return level.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum(hidden).alias("hidden"))


def coded(asked: DataFrame, full: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``gram`` and ``code`` (log10) of the distinct grams ``asked``.

    Nodes of full order have theirs in ``full``. Of the others each order closes those it knows,
    and only what is still open is joined with the next. ``hn`` and ``hd`` are what the longer
    context takes from the counts and the kinds of the shorter.
    """
    met = cut_lineage(asked.select("gram").join(full.select("gram", "code"), "gram", "left"))
    closed = met.filter("code is not null")
    zero = F.lit(0).cast("long")
    rows = met.filter("code is null").select("gram", F.lit(0.0).alias("code"), zero.alias("hn"), zero.alias("hd"))
    for order in range(ORDER, -1, -1):
        own = _last(F.col("gram"), order)
        rows = rows.withColumn("context", F.shiftright(own, 8))
        contexts = contexts_of(levels[order], levels[order - 1] if order else None, order, rows.select("context").distinct())
        rows = rows.join(contexts, "context", "left")
        node = levels[order].select(F.col("gram").alias("_g"), F.col("n").alias("_c"))
        rows = rows.join(node, own == F.col("_g"), "left") if order < ORDER else rows.withColumn("_c", F.lit(None).cast("long"))
        d = F.col("kinds") - F.col("hd")
        top = F.coalesce(2 * F.col("_c") - 1, d)
        cost = F.when(d > 0, F.log10(top / (2 * (F.col("total") - F.col("hn"))))).otherwise(0.0)
        rows = cut_lineage(
            rows.select(
                "gram",
                (F.col("code") + cost).alias("code"),
                F.coalesce("hidden", "hn").alias("hn"),
                F.coalesce("kinds", "hd").alias("hd"),
                F.col("_c").isNotNull().alias("seen"),
            )
        )
        closed = closed.unionByName(rows.filter("seen").select("gram", "code"))
        rows = rows.filter("not seen").drop("seen")
    left = F.log10(F.greatest(256 - F.col("hd"), F.lit(1)).cast("double"))
    return closed.unionByName(rows.select("gram", (F.col("code") - left).alias("code")))


class Head:
    """Looks codes of frequent grams up: a slot names a place in the sorted grams, and the gram there decides."""

    def __init__(self, grams: np.ndarray, codes: np.ndarray, counts: np.ndarray):
        self.grams, self.codes = grams, codes
        self.bits = max(8, len(grams).bit_length() + 1)
        self.place = np.zeros(1 << self.bits, np.int32)
        rank = np.argsort(counts, kind="stable")  # of two grams in a slot the more frequent stays
        self.place[self._slot(grams[rank])] = rank

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def split(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes, 0 where there is none; the positions without, the distinct grams there, and which of these."""
        if not len(self.grams):
            unique, where = np.unique(grams, return_inverse=True)
            return np.zeros(len(grams)), np.arange(len(grams)), unique, where
        place = self.place[self._slot(grams)]
        codes = np.where(self.grams[place] == grams, self.codes[place], 0.0)
        rest = np.flatnonzero(self.grams[place] != grams)
        unique, where = np.unique(grams[rest], return_inverse=True)
        at = np.minimum(np.searchsorted(self.grams, unique), len(self.grams) - 1)
        hit = self.grams[at] == unique
        codes[rest] = np.where(hit, self.codes[at], 0.0)[where]
        number = np.cumsum(~hit) - 1
        open_ = ~hit[where]
        return codes, rest[open_], unique[~hit], number[where[open_]]


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` (bytes, lower-cased A-Z) and ``n`` over all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for value in batch.column(0):
                counts.update(value.as_py().lower().split())
                if len(counts) > HELD:
                    yield out()
        if counts:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def scored(docs: DataFrame, keep: list[str], model: tuple[np.ndarray, np.ndarray, np.ndarray], head: dict[bytes, int]) -> DataFrame:
    """The columns ``keep`` with n_tokens, score, the counts of head words and the other words.

    ``_head`` has (count in training, how often in the text); ``_tail`` (word, how often).
    ``model`` is what ``head_of`` gives; ``_grams`` has (gram, how often) of those whose codes
    are still to be added to the score. ``_row`` numbers the rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model, head))
    schema = spark.createDataFrame([], "n_tokens long, score double, _row long, _head array<struct<c:long,times:long>>, _tail array<struct<word:binary,times:long>>, _grams array<struct<gram:long,times:long>>").schema
    schema = type(schema)([*docs.select(*keep).schema.fields, *schema.fields])
    kinds = [pa.list_(pa.struct([("c", pa.int64()), ("times", pa.int64())])), pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (model, known) = shared.value
        codes_of = Head(*model)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for first, end, data, offsets in scans(batch, "_text"):
                packed, at = grams(data, offsets)
                codes, rest, unique, which = codes_of.split(packed)
                score = np.bincount(at, codes, minlength=end - first)
                kinds_ = max(1, len(unique))
                open_, times = np.unique(at[rest] * kinds_ + which, return_counts=True)
                size = np.append(0, np.cumsum(np.bincount(open_ // kinds_, minlength=end - first)))
                grams_ = pa.StructArray.from_arrays([pa.array(unique.view(np.int64)[open_ % kinds_]), pa.array(times.astype(np.int64))], names=["gram", "times"])
                grams_ = pa.ListArray.from_arrays(pa.array(size, pa.int32()), grams_)
                tokens, sizes = [], ([0], [0])
                heads, tails = ([], []), ([], [])
                for value in texts.slice(first, end - first):
                    words = value.as_py().lower().split()
                    tokens.append(len(words) + 1)
                    for word, times in Counter(words).items():
                        c = known.get(word)
                        own = tails if c is None else heads
                        own[0].append(word if c is None else c)
                        own[1].append(times)
                    sizes[0].append(len(heads[0]))
                    sizes[1].append(len(tails[0]))
                lists = [
                    pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.StructArray.from_arrays([pa.array(own[0], kind.value_type[0].type), pa.array(own[1], pa.int64())], fields=list(kind.value_type)))
                    for size, own, kind in zip(sizes, (heads, tails), kinds)
                ]
                n = end - first
                kept = [c.slice(first, n) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(tokens, pa.int64()), pa.array(score), pa.array(np.arange(row, row + n)), *lists, grams_], names=schema.names)
                row += n

    return docs.select(*keep, text_bytes().alias("_text")).mapInArrow(run, schema)


def lm_score(docs: DataFrame, *, fold: tuple[int, int] | None = (5, 1), max_nodes: int | None = None, head_nodes: int = HEAD_NODES, head_words: int = HEAD_WORDS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Rows with the remainder ``fold[1]`` are held out: scored but not learnt from. A null text
    is empty and has its end token alone. Without any training text every token is unknown
    and every byte uniform. Repeated rows count and are scored each on its own. All nodes
    count, unless ``max_nodes`` asks for a smaller model: the most frequent nodes of full order,
    and those of lower order that are as frequent. ``head_nodes`` is only what is broadcast.
    """
    docs = only(docs, "doc_id", "text")
    held = remainder("doc_id", fold[0]) == fold[1] if fold else F.lit(False)
    learnt = docs.filter(~held).select(text_bytes())
    words = cut_lineage(count_words(learnt))
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = learnt.count()
    n, v = totals["n"] + ends, totals["v"] + (ends > 0)
    short = words.filter(F.length("word") <= HEAD_WORD_BYTES)
    head = {bytes(r["word"]): r["n"] for r in short.orderBy(F.desc("n"), "word").limit(head_words).toArrow().to_pylist()}
    nodes = cut_lineage(count_nodes(learnt))
    levels = levels_of(nodes, 1 if max_nodes is None else least_count(nodes, max_nodes))
    full = full_order(levels[ORDER])
    out = cut_lineage(scored(docs, ["doc_id"], head_of(full, head_nodes), head))
    rest = out.select("_row", F.explode("_grams").alias("g")).select("_row", "g.gram", "g.times")
    codes = coded(rest.select("gram").distinct(), full, levels)
    rest = rest.join(codes, "gram").groupBy("_row").agg(F.sum(F.col("times") * F.col("code")).alias("_more"))

    log = lambda c: F.log10((c + 0.5) / (F.lit(float(n)) + 0.5 * (F.lit(float(v)) + 1)))
    tail = out.select("_row", F.explode("_tail").alias("t")).select("_row", "t.word", "t.times")
    tail = tail.join(words, "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    tail = tail.groupBy("_row").agg(F.sum(F.col("times") * log(F.col("c"))).alias("_sum"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("_known"))
    head_sum = F.aggregate("_head", F.lit(0.0), lambda a, x: a + x["times"] * log(x["c"]))
    head_known = F.aggregate("_head", F.lit(0).cast("long"), lambda a, x: a + x["times"])
    joined = out.drop("_tail", "_grams").join(tail, "_row", "left").join(rest, "_row", "left")
    return joined.select(
        "doc_id",
        (remainder("doc_id", fold[0]) == fold[1] if fold else F.lit(False)).alias("held_out"),
        "n_tokens",
        (head_known + F.coalesce("_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (head_sum + F.coalesce("_sum", F.lit(0.0)) + log(F.lit(float(ends)))).alias("base_score"),
        (F.col("score") + F.coalesce("_more", F.lit(0.0))).alias("score"),
    )
