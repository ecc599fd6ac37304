"""Stock, cache, journal and outcomes of captures under one log of commits.

A batch of captures, or an undo, moves all tables on in one commit: stock and cache never
differ, and a batch that is run again after a failure counts once.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partslake.operators.ledger import undo_last
from partslake.operators.recognise import MEDIUM, TIGHT, capped, deltas_of, recognised, run_captures
from partslake.session import cut_lineage
from partslake.sources import commits

JOURNAL = "bin string, part string, entry_id long, ts long, qty_before long, qty_after long, cache_row_id long"
OUTCOMES = "bin string, part string, seq long, disposition string, qty long, section string, reason string"
ATTEMPTS = "camera string, ts timestamp, vec array<double>, attempts long"
ENRICHED = "part string, kind string, reason string, origin string, datasheet string"

# A table's buckets are merged, and what no reader needs is removed, every so many commits.
TIDY_EVERY = 16


def create(stock: DataFrame, cache: DataFrame, root: str, buckets: int = commits.BUCKETS) -> None:
    """A store with ``stock`` (bin, section, part, qty, source, cells) and ``cache``."""
    spark = stock.sparkSession
    empty = lambda schema: spark.createDataFrame([], schema)
    commits.create(
        spark,
        root,
        {
            "stock": (stock, ["bin", "part"]),
            "cache": (cache, ["row_id"]),
            "journal": (empty(JOURNAL), ["bin", "entry_id"]),
            "outcomes": (empty(OUTCOMES), []),
            "attempts": (empty(ATTEMPTS), ["camera"]),
            "enriched": (empty(ENRICHED), ["part"]),
        },
        buckets,
    )


def apply_captures(
    batch: DataFrame,
    verdicts: DataFrame,
    sections: DataFrame,
    root: str,
    model_hash: str,
    batch_id: int,
    tight: float = TIGHT,
    medium: float = MEDIUM,
    *,
    check: Callable[[DataFrame], DataFrame] | None = None,
    enrich: Callable[[DataFrame], DataFrame] | None = None,
) -> int:
    """Captures into the store, in one commit. Returns its number.

    Of the stock only the parts that were recognised are read, or with a ``check`` (see
    :func:`run_captures`) their bins. The search reads the cache whole. ``enrich`` turns the
    written parts into ``(part, kind, reason, origin, datasheet)`` afterwards, in a commit of
    its own; its failure is logged and takes nothing back.
    """
    spark = batch.sparkSession
    record = commits.newest(spark, root)
    if batch_id <= record["batches"].get("captures", -1):
        return record["commit"]
    cache = commits.read(spark, root, "cache", record)
    routed = recognised(batch, verdicts, cache, model_hash, tight, medium)
    changes = {}
    if {"camera", "ts"} <= set(batch.columns):
        earlier = commits.read_keys(batch.select("camera").distinct(), root, "attempts", record)
        routed, changes["attempts"] = capped(routed, earlier)
        routed = cut_lineage(routed)
    parts = cut_lineage(deltas_of(routed).select("bin", "part").distinct())
    if check is None:
        stock = commits.read_keys(parts, root, "stock", record)
    else:
        stock = commits.read(spark, root, "stock", record).join(parts.select("bin").distinct(), "bin", "left_semi")
    done = run_captures(batch, verdicts, cut_lineage(stock), sections, cache, model_hash, tight, medium, routed=routed, check=check)
    touched = done["dispositions"].filter(~F.col("disposition").isin("rejected", "no_op")).select("bin", "part").distinct()
    changes |= {
        "stock": done["stock"].join(touched, ["bin", "part"], "left_semi"),
        "cache": done["cache"].join(cache.select("row_id"), "row_id", "left_anti"),
        "journal": done["journal"],
        "outcomes": done["dispositions"],
    }
    number = commits.commit(spark, root, changes, writer="captures", batch=batch_id)
    if enrich is not None:
        try:
            found = enrich(touched.select("part").distinct())
            commits.commit(spark, root, {"enriched": found}, writer="enrichment", batch=batch_id)
        except Exception:  # noqa: BLE001  whatever went wrong there, the write stands
            logging.getLogger(__name__).exception("enrichment of batch %s failed", batch_id)
    if number % TIDY_EVERY == 0:
        for name in ("stock", "cache", "journal", "attempts", "enriched"):
            commits.compact(spark, root, name)
        commits.vacuum(spark, root)
    return number


def undo_captures(spark: SparkSession, root: str, depth: int = 1, writer: str = "undo", batch: int | None = None) -> DataFrame:
    """Reverse the newest ``depth`` writes of each bin in one commit; the outcomes.

    Stock, cache rows and journal entries change together: after a failure none of them has.
    """
    record = commits.newest(spark, root)
    stock, cache, journal = (commits.read(spark, root, t, record) for t in ("stock", "cache", "journal"))
    new_stock, _, _, outcomes = undo_last(stock, cache, journal, depth)
    outcomes = cut_lineage(outcomes)
    done = outcomes.filter(F.col("outcome") == "reverted")
    entries = cut_lineage(journal.join(done.select("bin", "entry_id"), ["bin", "entry_id"], "left_semi"))
    commits.commit(
        spark,
        root,
        {"stock": new_stock.join(done.select("bin", "part").distinct(), ["bin", "part"], "left_semi")},
        removed={"cache": entries.select(F.col("cache_row_id").alias("row_id")).distinct(), "journal": entries.select("bin", "entry_id")},
        writer=writer,
        batch=batch,
    )
    return outcomes
