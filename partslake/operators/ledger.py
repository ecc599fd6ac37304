"""Keyed stock ledger: ordered upserts as set operations.

Stock is ``(bin, section, part, qty, source, cells)``, unique by (bin, part). Deltas are
``(bin, seq, part, qty_delta, source, section, cells)``, ``seq`` unique per bin. Rows of one
part are processed in ``seq`` order: those of most parts in one task, moved once; a part
with very many deltas is cut into chunks of bounded size, which spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partslake.functions import text as T
from partslake.plans.running import CHUNK_ROWS, int_chunk, numbered, running, top_rows
from partslake.session import cut_lineage

KEY = ["bin", "part"]
# Parts fall into buckets by hash. Those of a bucket with more rows than a chunk are cut into chunks.
BUCKETS = 1 << 16
# Many deltas are moved between tasks a part of them at a time, in so many passes at most: by then
# the disk this takes is no more than what the deltas and their replay take in any case.
PASS_ROWS, PASSES = 1 << 24, 4
# Cell columns whose last values are held side by side; with more, a row is made of each cell.
CELL_COLUMNS = 16
COMPUTED = ("Qty", "Source", "Part")


def resolve_first(rows: DataFrame) -> DataFrame:
    """One row per part: the first in document order. Partial aggregation, no window."""
    rest = [c for c in rows.columns if c not in KEY]
    first = F.min_by(F.struct(*rest), F.struct("path", "line_no"))
    return rows.groupBy(*KEY).agg(first.alias("r")).select(*KEY, "r.*")


def stock_of(rows: DataFrame) -> DataFrame:
    """Stock from inventory rows: the tables a write may touch, first row per part."""
    usable = rows.filter(F.col("first_table") & (F.col("part") != ""))
    return resolve_first(usable).select(
        "bin", "section", "part", "qty", "source", "cells", "path", "line_no", "page"
    )


def sections_of(sectioned: DataFrame, rows: DataFrame) -> DataFrame:
    """``(bin, section, position, has_table, header)`` for the ledger.

    ``sectioned`` are lines with sections; the first section of a name counts.
    """
    names = (
        sectioned.filter(F.col("section").isNotNull())
        .groupBy("bin", "section")
        .agg(F.min(F.struct("path", "line_no")).alias("position"))
    )
    tables = (
        rows.filter("first_table")
        .groupBy("bin", "section")
        .agg(F.min_by("header", F.struct("path", "line_no")).alias("header"))
    )
    return names.join(tables, ["bin", "section"], "left").withColumn(
        "has_table", F.col("header").isNotNull()
    )


def check_source(deltas: DataFrame) -> DataFrame:
    """Mark deltas whose source is no lowercase token: ``reject_reason`` or null."""
    src = F.coalesce(F.col("source"), F.lit(""))
    return deltas.withColumn(
        "reject_reason",
        F.when(src == "", "source is empty")
        .when(T.has_outer_blanks(src), "source has outer blanks")
        .when(~src.rlike(T.SOURCE_TOKEN), "source is not a lowercase token"),
    )


def resolve_section(deltas: DataFrame, sections: DataFrame) -> DataFrame:
    """Add the section a delta would insert into, or why it cannot insert.

    No section means the bin's first one. Adds ``target`` and ``insert_error``; an
    existing part ignores both.
    """
    first = sections.groupBy("bin").agg(F.min_by("section", "position").alias("first_section"))
    named = sections.select(
        "bin", F.col("section").alias("target"), F.col("has_table").alias("_has_table")
    )
    return (
        deltas.join(first, "bin", "left")
        .withColumn("target", F.coalesce("section", "first_section"))
        .join(named, ["bin", "target"], "left")
        .withColumn(
            "insert_error",
            F.when(F.col("first_section").isNull(), "bin has no sections")
            .when(F.col("_has_table").isNull(), "unknown section")
            .when(~F.col("_has_table"), "section has no parts table"),
        )
        .drop("first_section", "_has_table")
    )


def _replay_chunks(stock: DataFrame, deltas: DataFrame, width: int) -> DataFrame:
    """Stock rows and deltas as one ordered stream per part with its running state.

    A stock row is the event before all others. A delta is accepted if its part exists:
    in stock, or by an earlier or the same delta that can insert. Existence and the
    quantity from there on are summed per chunk first and carried over chunks.
    """
    empty = F.create_map().cast("map<string,string>")
    events = stock.select(
        *KEY,
        F.lit(None).cast("long").alias("seq"),
        F.col("qty").cast("long").alias("qty_delta"),
        "source",
        F.lit(None).cast("string").alias("asked"),
        F.col("section").alias("target"),
        F.coalesce("cells", empty).alias("cells"),
        F.lit(None).cast("string").alias("insert_error"),
        F.lit(-1).cast("long").alias("_chunk"),
    ).unionByName(
        deltas.select(
            *KEY,
            "seq",
            F.col("qty_delta").cast("long").alias("qty_delta"),
            "source",
            F.col("section").alias("asked"),
            "target",
            F.coalesce("cells", empty).alias("cells"),
            "insert_error",
            int_chunk("seq", width).alias("_chunk"),
        )
    )
    group = [*KEY, "_chunk"]
    local = Window.partitionBy(*group).orderBy(F.col("seq").asc_nulls_first())
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = (
        events.withColumn("_able", F.col("insert_error").isNull())
        .withColumn("_alive", F.max("_able").over(upto))
        .withColumn("_all", F.sum("qty_delta").over(upto))
        .withColumn(
            "_from", F.sum(F.when(F.col("_alive"), F.col("qty_delta")).otherwise(0)).over(upto)
        )
        .withColumn("_prev_source", F.lag("source").over(local))
        .withColumn(
            "_born", F.first(F.when(F.col("_able"), F.struct("seq", "target")), True).over(upto)
        )
    )
    # one row per part and chunk, then in chunk order per part
    order = Window.partitionBy(*KEY).orderBy("_chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        events.groupBy(*group)
        .agg(
            F.max("_able").alias("_able"),
            F.sum("qty_delta").alias("_all"),
            F.sum(F.when(F.col("_alive"), F.col("qty_delta")).otherwise(0)).alias("_from"),
            F.max_by("source", F.coalesce("seq", F.lit(-1))).alias("_source"),
            F.min_by(
                F.struct("seq", "target"), F.when(F.col("_able"), F.coalesce("seq", F.lit(-1)))
            ).alias("_born"),
        )
        .withColumn("_c_alive", F.coalesce(F.max("_able").over(before), F.lit(False)))
        .withColumn(
            "_c_qty",
            F.coalesce(
                F.sum(F.when(F.col("_c_alive"), F.col("_all")).otherwise(F.col("_from"))).over(
                    before
                ),
                F.lit(0),
            ),
        )
        .withColumn("_c_source", F.last("_source").over(before))
        .withColumn("_c_born", F.first("_born", ignorenulls=True).over(before))
        .select(*group, "_c_alive", "_c_qty", "_c_source", "_c_born")
    )
    joined = events.join(carry, group)
    born = F.coalesce("_c_born", "_born")
    return joined.select(
        *KEY,
        "seq",
        "qty_delta",
        "source",
        "cells",
        "asked",
        (F.col("_c_alive") | F.col("_alive")).alias("accepted"),
        (
            F.col("_c_qty") + F.when(F.col("_c_alive"), F.col("_all")).otherwise(F.col("_from"))
        ).alias("qty_after"),
        F.coalesce("_prev_source", "_c_source").alias("prev_source"),
        born["target"].alias("section"),
        F.coalesce(born["seq"] == F.col("seq"), F.lit(False)).alias("inserts"),
    )


def _headers(rows: DataFrame, sections: DataFrame) -> DataFrame:
    return rows.join(sections.select("bin", "section", "header"), ["bin", "section"], "left")


def _in_header(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """Rows whose ``col`` the header of their ``section`` has, or that have no header.

    All accepted rows of a part have one section, so this may wait until few rows are left.
    """
    known = F.col("header").isNull() | F.array_contains("header", F.col("col"))
    return _headers(rows, sections).filter(known).drop("header")


def replay(
    stock: DataFrame, deltas: DataFrame, sections: DataFrame, width: int = CHUNK_ROWS
) -> DataFrame:
    """Deltas and the stock rows they touch (``seq`` null) in order, with state and outcome inputs.

    The common part of :func:`dispositions` and :func:`upsert_batch`, written once because
    both read it more than once; pass it to them to get both from one run. The deltas are read
    several times, so they are written first.
    """
    return _replay_written(stock, cut_lineage(deltas, release=True), sections, width)


def _replay_written(
    stock: DataFrame, deltas: DataFrame, sections: DataFrame, width: int, changes: bool = True
) -> DataFrame:
    """:func:`replay` of written deltas. ``changes`` asks for ``cell_changed``, which an upsert has no use for."""
    bucket = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in KEY]), F.lit(BUCKETS))
    found = (
        _sound(deltas)
        .groupBy(bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.sum(F.when(F.col("n") <= width, F.col("n"))).alias("rows"),
            F.collect_list(F.when(F.col("n") > width, F.col("bucket"))).alias("hot"),
        )
        .first()
    )
    passes, names = min(-(-(found["rows"] or 0) // PASS_ROWS), PASSES), []
    if changes and passes:
        given = _sound(deltas).select(F.explode(F.map_keys("cells")).alias("col"))
        named = given.filter(~F.col("col").isin(*COMPUTED)).distinct().limit(CELL_COLUMNS + 1)
        names = sorted(r["col"] for r in named.collect())
    done = []
    # nothing at all still has columns
    for i in range(passes if passes or found["hot"] else 1):
        mine = ~bucket.isin(found["hot"]) & (F.pmod(bucket, F.lit(passes or 1)) == i)
        done.append(_replay_parts(stock.filter(mine), _sound(deltas.filter(mine)), sections, names, changes))
    if found["hot"]:
        mine = bucket.isin(found["hot"])
        many = _sound(deltas.filter(mine))
        touched = stock.filter(mine).join(many.select(*KEY).distinct(), KEY, "left_semi")
        hot = cut_lineage(_replay_chunks(touched, resolve_section(many, sections), width), release=True)
        if changes:
            changed = _changed_events(hot, sections, width)
            hot = cut_lineage(
                hot.join(changed, [*KEY, "seq"], "left").withColumn(
                    "cell_changed", F.coalesce("cell_changed", F.lit(False))
                ),
                release=True,
            )
        done.append(hot)
    return reduce(DataFrame.unionByName, done)


def _sound(deltas: DataFrame) -> DataFrame:
    """Deltas of a valid source and a part in a bin."""
    keyed = F.col("bin").isNotNull() & F.col("part").isNotNull()
    return check_source(deltas.filter(keyed)).filter(F.col("reject_reason").isNull()).drop("reject_reason")


def _replay_parts(
    stock: DataFrame, deltas: DataFrame, sections: DataFrame, names: Sequence[str], changes: bool
) -> DataFrame:
    """As :func:`_replay_chunks`, for parts whose deltas fit into a task: each delta moves once.

    What a section says of an insert is asked once per part and section, not per delta. Where
    a part is or comes to be is one more row of it, before all its deltas. ``names`` are the
    columns that the cells of deltas have, one more than ``CELL_COLUMNS`` at most.
    """
    asked = cut_lineage(deltas.groupBy(*KEY, "section").agg(F.min("seq").alias("seq")), release=True)
    touched = cut_lineage(stock.join(asked.select(*KEY).distinct(), KEY, "left_semi"), release=True)
    births = (
        resolve_section(asked.join(touched.select(*KEY), KEY, "left_anti"), sections)
        .filter(F.col("insert_error").isNull())
        .groupBy(*KEY)
        .agg(F.min(F.struct("seq", "target")).alias("b"))
    )
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("qty", "long"), ("source", "string"), ("cells", "map<string,string>"))}
    homes = touched.select(
        *KEY, "section", F.lit(None).cast("long").alias("born"), F.col("qty").cast("long").alias("qty"), "source", "cells"
    ).unionByName(births.select(*KEY, F.col("b.target").alias("section"), F.col("b.seq").cast("long").alias("born"), *none.values()))
    place = ["section", "born"]
    if changes:
        homes, place = _headers(homes, sections), [*place, "header"]
    homes = homes.withColumn("_home", F.struct(*place))
    empty = F.create_map().cast("map<string,string>")
    events = homes.select(
        *KEY,
        F.lit(None).cast("long").alias("seq"),
        F.col("qty").alias("qty_delta"),
        "source",
        F.lit(None).cast("string").alias("asked"),
        F.coalesce("cells", empty).alias("cells"),
        "_home",
    ).unionByName(
        deltas.select(
            *KEY,
            F.col("seq").cast("long").alias("seq"),
            F.col("qty_delta").cast("long").alias("qty_delta"),
            "source",
            F.col("section").alias("asked"),
            F.coalesce("cells", empty).alias("cells"),
            F.lit(None).cast(homes.schema["_home"].dataType).alias("_home"),
        )
    )
    order = Window.partitionBy(*KEY).orderBy(F.col("seq").asc_nulls_first())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    born = F.col("_home.born")
    events = (
        events.withColumn("_home", F.first("_home").over(upto))
        .withColumn("prev_source", F.lag("source").over(order))
        .withColumn(
            "accepted",
            F.coalesce(F.col("_home").isNotNull() & (born.isNull() | (F.col("seq") >= born)), F.lit(False)),
        )
        .withColumn("qty_after", F.sum(F.when(F.col("accepted"), F.col("qty_delta"))).over(upto))
        .filter(F.col("seq").isNotNull() | born.isNull())
        .withColumn("section", F.col("_home.section"))
        .withColumn("inserts", F.coalesce(F.col("seq") == born, F.lit(False)))
    )
    state = ["qty_delta", "source", "cells", "asked", "accepted", "qty_after", "prev_source", "section", "inserts"]
    if not changes:
        return cut_lineage(events.select(*KEY, "seq", *state), release=True)
    header = F.col("_home.header")
    known = lambda c: header.isNull() | F.array_contains(header, c)
    if len(names) <= CELL_COLUMNS:
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        changed = F.lit(False)
        for c in map(F.lit, names):
            given = F.when(F.col("accepted") & F.map_contains_key("cells", c), F.struct(F.try_element_at("cells", c).alias("v")))
            last = F.last(given, ignorenulls=True).over(before)["v"]
            changed = changed | F.coalesce(known(c) & (given["v"] != F.coalesce(last, F.lit(""))), F.lit(False))
        marked = events.withColumn("cell_changed", F.col("seq").isNotNull() & changed)
        return cut_lineage(marked.select(*KEY, "seq", *state, "cell_changed"), release=True)
    cell = "struct<col:string,value:string>"
    entries = F.filter(F.map_entries("cells"), lambda e: ~e["key"].isin(*COMPUTED) & known(e["key"]))
    # a row for the delta itself and one for each cell it sets; the state goes with the former
    own = F.array(F.lit(None).cast(cell))
    cells = events.select(
        *KEY,
        "seq",
        F.struct(*state).alias("state"),
        F.explode_outer(F.when(F.col("accepted"), F.concat(own, entries.cast(f"array<{cell}>"))).otherwise(own)).alias("cell"),
    ).select(*KEY, "seq", F.when(F.col("cell").isNull(), F.col("state")).alias("state"), "cell.*")
    per_cell = Window.partitionBy(*KEY, "col").orderBy(F.col("seq").asc_nulls_first())
    changed = F.col("col").isNotNull() & F.col("seq").isNotNull() & (F.col("value") != F.coalesce("_before", F.lit("")))
    folded = (
        cells.withColumn("_before", F.lag("value").over(per_cell))
        .groupBy(*KEY, "seq")
        .agg(
            F.first("state", ignorenulls=True).alias("state"),
            F.coalesce(F.max(changed), F.lit(False)).alias("cell_changed"),
        )
    )
    return cut_lineage(folded.select(*KEY, "seq", "state.*", "cell_changed"), release=True)


def _cell_events(replayed: DataFrame) -> DataFrame:
    """Accepted cell values one per row: ``(bin, part, section, seq, col, value)``.

    Qty and Source are computed. The Part cell stays as the row was born. Columns that the
    section's header lacks are left to :func:`_in_header`.
    """
    birth = F.col("inserts") | F.col("seq").isNull()
    return (
        replayed.filter("accepted")
        .select(*KEY, "section", "seq", "inserts", F.explode("cells").alias("col", "value"))
        .filter(~F.col("col").isin("Qty", "Source"))
        .filter((F.col("col") != "Part") | birth)
        .drop("inserts")
    )


def _changed_events(replayed: DataFrame, sections: DataFrame, width: int) -> DataFrame:
    """``(bin, part, seq)`` of deltas that set a cell to another value."""
    cells = (
        _cell_events(replayed)
        .filter(F.col("col") != "Part")
        .withColumn("_at", F.coalesce("seq", F.lit(-1)))
    )
    before = running(
        cells, [*KEY, "col"], ["_at"], int_chunk("_at", width), lags={"before": F.col("value")}
    )
    changed = before.filter(F.col("seq").isNotNull()).filter(F.col("value") != F.coalesce("before", F.lit("")))
    return (
        _in_header(changed.select(*KEY, "section", "seq", "col"), sections)
        .select(*KEY, "seq")
        .distinct()
        .withColumn("cell_changed", F.lit(True))
    )


def dispositions(
    stock: DataFrame,
    deltas: DataFrame,
    sections: DataFrame,
    width: int = CHUNK_ROWS,
    replayed: DataFrame | None = None,
) -> DataFrame:
    """Outcome per delta: inserted / bumped / metadata_updated / no_op / rejected.

    ``reason`` says why a delta was rejected. A supplied Qty or Source cell counts as a
    metadata change where it differs, although the computed value then replaces it.
    """
    if replayed is None:
        deltas = cut_lineage(deltas, release=True)
        replayed = _replay_written(stock, deltas, sections, width)
    bad = check_source(deltas).filter(F.col("reject_reason").isNotNull())
    own = replayed.filter(F.col("seq").isNotNull())
    given_source = F.try_element_at("cells", F.lit("Source"))
    given_qty = F.try_element_at("cells", F.lit("Qty"))
    source_changed = F.coalesce(
        given_source != F.col("prev_source"), F.lit(False)
    ) | ~F.coalesce(given_source, F.col("prev_source")).eqNullSafe(F.col("source"))
    qty_changed = F.coalesce(
        given_qty != (F.col("qty_after") - F.col("qty_delta")).cast("string"), F.lit(False)
    )
    judged = own.filter("accepted").select(
        *KEY,
        "seq",
        F.when(F.col("inserts"), "inserted")
        .when(F.col("qty_delta") != 0, "bumped")
        .when(F.col("cell_changed") | source_changed | qty_changed, "metadata_updated")
        .otherwise("no_op")
        .alias("disposition"),
        F.col("qty_after").alias("qty"),
        "section",
        F.lit(None).cast("string").alias("reason"),
    )
    early = own.filter(~F.col("accepted")).select(*KEY, "seq", F.col("asked").alias("section"))
    refused = bad.select(*KEY, "seq", F.col("reject_reason").alias("reason")).unionByName(
        resolve_section(early, sections).select(*KEY, "seq", F.col("insert_error").alias("reason"))
    )
    return judged.unionByName(
        refused.select(
            *KEY,
            "seq",
            F.lit("rejected").alias("disposition"),
            F.lit(None).cast("long").alias("qty"),
            F.lit(None).cast("string").alias("section"),
            "reason",
        )
    )


def upsert_batch(
    stock: DataFrame,
    deltas: DataFrame,
    sections: DataFrame,
    width: int = CHUNK_ROWS,
    replayed: DataFrame | None = None,
) -> DataFrame:
    """Stock after the batch: ``(bin, section, part, qty, source, cells)``.

    The last state per part and the last value per cell, both combined before the
    shuffle, so a hot part costs one small row per task. Stock without a delta passes by.
    """
    if replayed is None:
        replayed = _replay_written(stock, cut_lineage(deltas, release=True), sections, width, changes=False)
    at = F.coalesce("seq", F.lit(-1))
    state = F.struct("section", F.col("qty_after").alias("qty"), "source")
    last = (
        replayed.filter("accepted")
        .groupBy(*KEY)
        .agg(F.max_by(state, at).alias("s"))
        .select(*KEY, "s.*")
    )
    latest = _cell_events(replayed).groupBy(*KEY, "section", "col").agg(F.max_by("value", at).alias("value"))
    cells = (
        _in_header(latest, sections)
        .groupBy(*KEY)
        # one entry per header column, so the list is as short as a header
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "value")))).alias("cells"))
    )
    cell_map = F.coalesce("cells", F.create_map().cast("map<string,string>"))
    known = lambda e: (F.col("header").isNull() | F.array_contains("header", e["key"])) & ~e["key"].isin("Qty", "Source")
    touched = replayed.filter(F.col("seq").isNotNull()).select(*KEY).distinct()
    untouched = _headers(stock.join(touched, KEY, "left_anti"), sections).select(
        *KEY,
        "section",
        F.col("qty").cast("long").alias("qty"),
        "source",
        F.map_from_entries(F.array_sort(F.filter(F.map_entries("cells"), known))).alias("cells"),
    )
    return last.join(cells, KEY, "left").unionByName(untouched).select(
        "bin",
        "section",
        "part",
        "qty",
        "source",
        F.when(F.map_contains_key(cell_map, "Part"), cell_map)
        .otherwise(F.map_concat(F.create_map(F.lit("Part"), F.col("part")), cell_map))
        .alias("cells"),
    )


def gate(post: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Rows of bins without a diagnostic: one violation rejects the bin's whole batch."""
    return post.join(diagnostics.select("bin").distinct(), "bin", "left_anti")


def render_order(rows: DataFrame) -> DataFrame:
    """Place of every row in its section, by case-folded visible text."""
    return numbered(rows, ["bin", "section"], [T.fold(F.col("part")), "part"], "position")


def undo_last(
    stock: DataFrame, cache: DataFrame, journal: DataFrame, depth: int = 1
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Reverse the newest ``depth`` writes of each bin.

    Returns stock, cache, journal and outcomes. A write whose part is not in stock with
    the quantity the journal left behind, or whose cache row is gone, cannot be reversed:
    stock, cache row and entry stay.
    """
    cached = cache.select(F.col("row_id").alias("cache_row_id")).distinct().withColumn("_cached", F.lit(True))
    newest = top_rows(
        journal, ["bin"], [F.col("ts").desc(), F.col("entry_id").desc()], depth
    ).join(cached, "cache_row_id", "left")
    planned = newest.groupBy("bin", "part").agg(
        F.sum(F.col("qty_after") - F.col("qty_before")).alias("step"),
        F.max_by("qty_after", F.struct("ts", "entry_id")).alias("qty_now"),
        F.bool_and(F.coalesce("_cached", F.lit(False))).alias("_cached"),
    )
    able = planned.join(
        stock.select("bin", "part", "qty"), KEY, "left"
    ).withColumn("reverted", F.coalesce((F.col("qty") == F.col("qty_now")) & F.col("_cached"), F.lit(False)))
    done = newest.join(able.select(*KEY, "reverted"), KEY)
    new_stock = (
        stock.join(able.filter("reverted").select(*KEY, "step"), KEY, "left")
        .withColumn("qty", F.col("qty") - F.coalesce("step", F.lit(0)))
        .drop("step")
        .select(*stock.columns)
    )
    gone = done.filter("reverted")
    new_cache = cache.join(
        gone.select(F.col("cache_row_id").alias("row_id")), "row_id", "left_anti"
    ).select(*cache.columns)
    new_journal = journal.join(gone.select("entry_id"), "entry_id", "left_anti").select(
        *journal.columns
    )
    bins = stock.select("bin").union(journal.select("bin")).distinct()
    outcomes = bins.join(
        done.select(
            "bin",
            "part",
            "entry_id",
            F.when(F.col("reverted"), "reverted").otherwise("undo failed").alias("outcome"),
        ),
        "bin",
        "left",
    ).withColumn("outcome", F.coalesce("outcome", F.lit("nothing to undo")))
    return new_stock, new_cache, new_journal, outcomes


def family_stock(rows: DataFrame) -> DataFrame:
    """Each row with the stock of all rows on its page; a row without a page is its own family."""
    family = F.coalesce("page", F.concat(F.lit("\0"), F.col("part")))
    rows = rows.withColumn("_family", family)
    sums = rows.groupBy("bin", "_family").agg(
        F.sum("qty").alias("family_qty"), F.count(F.lit(1)).alias("family_rows")
    )
    return (
        rows.join(sums, ["bin", "_family"])
        .withColumn("canonical", F.when(F.col("page").isNull(), F.col("part")).otherwise(T.stem(F.col("page"))))
        .drop("_family")
    )


def bom_plan(bom: DataFrame, stock: DataFrame) -> DataFrame:
    """Needed, in stock and to order per BOM line; bulk rows need no order.

    Needs of equal (bin, part) lines are not netted: each line is planned against the
    stock, as on paper. ``feasible`` looks at the family's stock. Stock has ``bulk``.
    """
    known = family_stock(stock).select("bin", "part", "qty", "family_qty", "bulk")
    joined = bom.join(known, KEY, "left")
    bulk = F.coalesce("bulk", F.lit(False))
    qty = F.coalesce("qty", F.lit(0))
    return joined.select(
        *bom.columns,
        F.when(bulk, "(bulk)").otherwise(qty.cast("string")).alias("in_stock"),
        F.when(bulk, 0).otherwise(F.greatest(F.col("needed") - qty, F.lit(0))).cast("long").alias("to_order"),
        (bulk | (F.coalesce("family_qty", F.lit(0)) >= F.col("needed"))).alias("feasible"),
    )


FILLABLE = ("description", "datasheet", "notes")


def fill_empty(rows: DataFrame, enriched: DataFrame) -> DataFrame:
    """Fill empty Description / Datasheet / Notes; a filled cell is never touched."""
    new = enriched.select("part", *[F.col(c).alias(f"_new_{c}") for c in FILLABLE])
    kept = [c for c in rows.columns if c not in FILLABLE]
    filled = [
        F.coalesce(F.when(T.strip(F.col(c)) != "", F.col(c)), F.col(f"_new_{c}"), F.lit("")).alias(c)
        for c in FILLABLE
    ]
    changed = [
        (F.coalesce(T.strip(F.col(c)), F.lit("")) == "") & (F.coalesce(f"_new_{c}", F.lit("")) != "")
        for c in FILLABLE
    ]
    return rows.join(new, "part", "left").select(
        *kept, *filled, (changed[0] | changed[1] | changed[2]).alias("filled")
    )


def merge_owned(
    ours: DataFrame, theirs: DataFrame, keys: list[str], owner: Mapping[str, str]
) -> DataFrame:
    """Merge two record sets; each field comes from its owner, ``ours`` or ``theirs``.

    A record only one side has is taken whole. Conflicts are flagged per record.
    """
    fields = list(owner)
    a = ours.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in fields], F.lit(True).alias("_in_a"))
    b = theirs.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in fields], F.lit(True).alias("_in_b"))
    both = a.join(b, keys, "full_outer")
    out, conflict = [], F.lit(False)
    for c in fields:
        own, other = ("_a_", "_b_") if owner[c] == "ours" else ("_b_", "_a_")
        has = "_in_a" if owner[c] == "ours" else "_in_b"
        out.append(F.when(F.col(has), F.col(own + c)).otherwise(F.col(other + c)).alias(c))
        conflict = conflict | ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    paired = F.coalesce(F.col("_in_a") & F.col("_in_b"), F.lit(False))
    return both.select(*keys, *out, (paired & conflict).alias("conflict"))


def stock_stats(rows: DataFrame) -> DataFrame:
    """Parts and pieces per section and source, per section, and in total."""
    return rows.rollup("section", "source").agg(
        F.count(F.lit(1)).alias("parts"),
        F.sum("qty").alias("pieces"),
        F.grouping_id().cast("int").alias("level"),
    )


def out_of_stock(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("qty") == 0)


def first_sightings(stock: DataFrame, deltas: DataFrame) -> DataFrame:
    """New parts and the delta that brings each in; a restock is none."""
    rest = [c for c in deltas.columns if c not in (*KEY, "seq")]
    first = deltas.groupBy(*KEY).agg(
        F.min("seq").alias("seq"), F.min_by(F.struct(*rest), "seq").alias("r")
    )
    return first.join(stock.select(*KEY), KEY, "left_anti").select(*KEY, "seq", "r.*")
