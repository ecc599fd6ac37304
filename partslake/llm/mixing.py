"""Mixing sources by temperature, realised as budgeted permutations of blocks.

A source's weight is its share of tokens to the power t, over the sum of all. Bisection
finds the t that meets a limit on repetition or a target entropy. With weights and a token
budget each source is passed over so and so often: whole passes take every document, and
the last one takes blocks of documents in a permuted order until its budget is used, cutting
inside one block at most. Everything here is DataFrame functions; the only rows that meet
in one task are one per source, and the documents of one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partslake.session import cut_lineage

WORDS = r"[^\x20\x09-\x0D]+"
# Hex digits of the id's digest that name its block: 4096 blocks in a source.
BLOCK_DIGITS = 3
STEPS = 60
MAX_PASSES = 2.0
# Sources up to which the plan, one row each, is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 2_000


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _weights(t: Column, shares: Column) -> Column:
    powers = F.transform(shares, lambda p: F.pow(p, t))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def _entropy(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda a, w: a - F.when(w > 0, w * F.log(w)).otherwise(0.0))


def _most_passes(weights: Column, shares: Column) -> Column:
    """Passes over the source repeated most if every source is passed over at least once."""
    rates = F.zip_with(weights, shares, lambda w, p: w / p)
    return F.array_max(rates) / F.array_min(rates)


def source_plan(totals: DataFrame, *, max_passes: float | None = MAX_PASSES, entropy: float | None = None, budget: int | None = None, steps: int = STEPS) -> DataFrame:
    """``source``, ``weight``, ``passes`` and ``exponent`` for ``totals`` (source, tokens).

    The exponent lies in [0, 1]: 1 keeps the shares, 0 makes sources equal. It is the
    smallest at which no source is passed over more than ``max_passes`` times as often as
    another, or the largest that reaches ``entropy`` (in nats; 0 if none does). ``budget``
    is the number of tokens to draw; without one every source is passed over once at least,
    so no document is lost. A source without tokens has weight 0 and one pass.
    """
    if (max_passes is None) == (entropy is None):
        raise ValueError("give a limit on passes or an entropy")
    live = F.filter("all", lambda s: s["tokens"] > 0)
    one = totals.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "tokens"))).alias("all"))
    one = one.withColumn("sum", F.aggregate("all", F.lit(0).cast("long"), lambda a, s: a + s["tokens"]))
    one = one.withColumn("shares", F.transform(live, lambda s: s["tokens"] / F.col("sum")))
    bounds = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

    def halve(b: Column, _: Column) -> Column:
        t = (b["low"] + b["high"]) / 2
        w = _weights(t, F.col("shares"))
        if max_passes is not None:  # less repetition the higher t
            to_low = _most_passes(w, F.col("shares")) <= max_passes
        else:  # less entropy the higher t
            to_low = _entropy(w) < entropy
        return F.struct(F.when(to_low, b["low"]).otherwise(t).alias("low"), F.when(to_low, t).otherwise(b["high"]).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), bounds, halve)
    one = one.withColumn("exponent", found["high"] if max_passes is not None else found["low"])
    one = one.withColumn("weights", _weights(F.col("exponent"), F.col("shares")))
    rates = F.zip_with("weights", "shares", lambda w, p: w / p)
    # tokens drawn over tokens there are: given, or so that the least repeated source has one pass
    drawn = F.lit(float(budget)) / F.col("sum") if budget is not None else F.lit(1.0) / F.array_min("rates")
    one = one.withColumn("rates", rates).withColumn("drawn", drawn)
    rows = F.concat(
        F.zip_with(live, F.arrays_zip(F.col("weights").alias("w"), F.col("rates").alias("r")), lambda s, x: F.struct(s["source"].alias("source"), x["w"].alias("weight"), (x["r"] * F.col("drawn")).alias("passes"), s["tokens"].alias("tokens"))),
        F.transform(F.filter("all", lambda s: s["tokens"] <= 0), lambda s: F.struct(s["source"].alias("source"), F.lit(0.0).alias("weight"), F.lit(1.0).alias("passes"), s["tokens"].alias("tokens"))),
    )
    return one.select(F.explode(rows).alias("r"), "exponent").select("r.*", "exponent")


def mix(docs: DataFrame, *, max_passes: float | None = MAX_PASSES, entropy: float | None = None, budget: int | None = None, seed: int = 0) -> DataFrame:
    """``docs`` once per draw, with ``_tokens``, ``_pass`` (from 0), ``_block`` and ``_plan``.

    Tokens are words. A null source is a source of its own, a null text has no token. Rows
    that share their id are drawn each on its own; copies lie in the same block. A document
    is drawn in each whole pass; in the last, part pass if its block lies within the budget,
    and in the block where the budget ends if the documents up to it still fit.
    """
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    block = F.conv(F.substring(_digest(F.col("doc_id")), 1, BLOCK_DIGITS), 16, 10).cast("int")
    work = docs.withColumn("_tokens", tokens).withColumn("_block", block)
    blocks = cut_lineage(work.groupBy("source", "_block").agg(F.sum("_tokens").alias("tokens")))
    plan = source_plan(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")), max_passes=max_passes, entropy=entropy, budget=budget)
    whole = F.floor(F.col("passes") + 1e-9).cast("int")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0.0), F.col("passes") - whole) * F.col("tokens"))
    plan = cut_lineage(plan.drop("tokens"))

    # the permutation of a source's blocks in its part pass
    order = _digest(F.lit(seed), F.col("whole"), F.col("source"), F.col("_block"))
    permuted = blocks.join(plan.select(F.col("source").alias("_s"), "whole", "rest"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    upto = Window.partitionBy("source").orderBy("_order", "_block")
    permuted = permuted.withColumn("_order", order).withColumn("_upto", F.sum("tokens").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.col("_upto") <= F.col("rest") + 1e-6
    cut_here = ~inside & (F.col("_upto") - F.col("tokens") < F.col("rest") + 1e-6)
    by_source = permuted.groupBy("source").agg(
        F.collect_list(F.when(inside & (F.col("rest") > 0), F.col("_block"))).alias("taken"),
        F.max(F.when(cut_here, F.col("_block"))).alias("cut"),
        F.max(F.when(cut_here, F.col("rest") - (F.col("_upto") - F.col("tokens")))).alias("left"),
    )
    by_source = by_source.select(F.col("source").alias("_s"), "taken", "cut", "left")
    full = cut_lineage(plan.join(by_source, F.col("source").eqNullSafe(F.col("_s"))).select(F.struct("weight", "passes", "whole", "taken", "cut", "left", "exponent").alias("_plan"), "_s"))
    side = F.broadcast(full) if full.count() <= BROADCAST_SOURCES else full
    work = work.join(side, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    times = F.col("_plan.whole") + F.array_contains("_plan.taken", F.col("_block")).cast("int")
    drawn = work.filter(times > 0).withColumn("_pass", F.explode(F.sequence(F.lit(0), times - 1)))
    # documents of the block where the budget ends, in their permuted order
    last = work.filter(F.col("_block") == F.col("_plan.cut")).withColumn("_at", _digest(F.lit(seed), F.col("_plan.whole"), F.col("doc_id")))
    fits = Window.partitionBy("source").orderBy("_at", "_tokens").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("_sum", F.sum("_tokens").over(fits)).filter(F.col("_sum") <= F.col("_plan.left") + 1e-6)
    return drawn.unionByName(last.drop("_at", "_sum").withColumn("_pass", F.col("_plan.whole")))


def mixing(docs: DataFrame, *, max_passes: float = MAX_PASSES) -> DataFrame:
    """One row per draw: doc_id, source, n_tokens, pass, block, weight, passes."""
    out = mix(docs.select("doc_id", "source", "text"), max_passes=max_passes)
    return out.select(
        "doc_id", "source", F.col("_tokens").alias("n_tokens"), F.col("_pass").alias("pass"), F.col("_block").alias("block"),
        F.col("_plan.weight").alias("weight"), F.col("_plan.passes").alias("passes"),
    )
