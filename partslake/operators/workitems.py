"""Work items: status, counts, order checks, dependency graph, burn-up."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partslake.functions import rules as R
from partslake.functions import text as T
from partslake.plans.running import numbered
from partslake.session import cut_lineage, scratch


def lookup(table: dict, key: Column) -> Column:
    """Value of a small fixed table, null for other keys."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def _tasks(items: DataFrame) -> DataFrame:
    return items.filter(F.col("id").startswith("TASK-"))


def _epic(items: DataFrame) -> Column:
    return F.nullif(T.strip(F.col("epic")), F.lit(""))


def epic_status(items: DataFrame) -> DataFrame:
    """All closed gives closed, all open gives open, anything else active, none null."""
    n = F.count("status")
    return (
        _tasks(items)
        .withColumn("epic", _epic(items))
        .filter(F.col("epic").isNotNull())
        .groupBy("epic")
        .agg(
            F.when(n == 0, None)
            .when(F.count_if(F.col("status") == "closed") == n, "closed")
            .when(F.count_if(F.col("status") == "open") == n, "open")
            .otherwise("active")
            .alias("derived")
        )
    )


def _moved(path: Column, status: Column) -> Column:
    return F.regexp_replace(path, F.lit(r"[^/]*/([^/]*)$"), F.concat(status, F.lit("/$1")))


def misplaced(items: DataFrame) -> DataFrame:
    """Items outside the folder of their status, and epics outside that of their tasks."""
    tasks = (
        _tasks(items)
        .filter(F.col("status").isin(*R.STATUSES) & (F.col("status") != F.col("folder")))
        .select(
            "path",
            _moved(F.col("path"), F.col("status")).alias("target"),
            F.concat(F.col("id"), F.lit(" status="), F.col("status")).alias("reason"),
        )
    )
    epics = (
        items.filter(F.col("id").startswith("EPIC-"))
        .withColumn("epic", F.coalesce(_epic(items), F.col("id")))
        .join(epic_status(items), "epic")
        .filter(F.col("derived") != F.col("folder"))
        .select(
            "path",
            _moved(F.col("path"), F.col("derived")).alias("target"),
            F.concat(F.lit("epic "), F.col("id"), F.lit(" derived="), F.col("derived")).alias("reason"),
        )
    )
    return tasks.unionByName(epics)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves to even."""
    return F.when(whole > 0, F.bround(100 * part / whole, 0)).otherwise(0).cast("int")


def progress_tenths(pct: Column) -> Column:
    """Filled tenths of a bar, halves to even."""
    return F.bround(10 * pct / 100, 0).cast("int")


def epic_counts(items: DataFrame) -> DataFrame:
    """Counts per epic, of items without one (epic null), and in total (``is_total``)."""
    counts = (
        _tasks(items)
        .withColumn("epic", _epic(items))
        .filter(F.col("status").isin(*R.STATUSES))
        .rollup("epic")
        .agg(
            F.grouping("epic").cast("int").alias("is_total"),
            *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in R.STATUSES],
            F.count(F.lit(1)).alias("total"),
        )
    )
    pct = percent(F.col("n_closed"), F.col("total"))
    return counts.withColumn("pct", pct).withColumn("tenths", progress_tenths(F.col("pct")))


def _with_order(items: DataFrame) -> DataFrame:
    raw = T.strip(F.col("ord_raw"))
    return (
        _tasks(items)
        .withColumn("epic", _epic(items))
        .filter(F.col("epic").isNotNull())
        .withColumn("raw", F.when(~raw.isin("", "?"), raw))
        .withColumn("ord", T.try_int(F.col("raw")))
    )


def order_violations(items: DataFrame) -> DataFrame:
    """Missing, non-integer and duplicate order per epic, one row per item concerned."""
    work = _with_order(items).select("epic", "id", "raw", "ord")
    shared = (
        work.filter(F.col("ord").isNotNull())
        .groupBy("epic", "ord")
        .agg(F.count(F.lit(1)).alias("owners"))
        .filter("owners > 1")
    )
    single = work.filter(F.col("ord").isNull()).select(
        "epic",
        "id",
        F.when(F.col("raw").isNull(), "missing").otherwise("non-integer").alias("violation"),
        "raw",
        F.lit(None).cast("long").alias("owners"),
    )
    return single.unionByName(
        work.join(shared, ["epic", "ord"]).select(
            "epic", "id", F.lit("duplicate").alias("violation"), "raw", "owners"
        )
    )


def renumber(items: DataFrame) -> DataFrame:
    """Contiguous order from 1 per epic; only the rows that change."""
    placed = numbered(
        _with_order(items).select("epic", "id", "path", "ord"),
        ["epic"],
        [F.coalesce("ord", F.lit(10**9)), "path"],
        "new_ord",
    )
    return placed.filter(~F.col("ord").eqNullSafe(F.col("new_ord")))


def ranked_items(items: DataFrame) -> DataFrame:
    """Tasks with their list keys: status rank, order (999 without), path."""
    rank = F.coalesce(
        lookup(R.STATUS_RANK, F.coalesce("status", F.lit("open"))), F.lit(99)
    )
    return (
        _tasks(items)
        .withColumn("rank", rank)
        .withColumn("ord", F.coalesce(T.try_int(F.col("ord_raw")), F.lit(999)))
        .orderBy("rank", "ord", "path")
    )


def prerequisite_edges(items: DataFrame) -> DataFrame:
    """``(epic, src, dst, src_status, in_epic)``; an unknown prerequisite counts as open."""
    tasks = _tasks(items).withColumn("epic", _epic(items))
    edges = tasks.select("epic", F.col("id").alias("dst"), F.explode("prerequisites").alias("src"))
    known = tasks.select(
        F.col("id").alias("src"), F.col("epic").alias("_src_epic"), F.col("status").alias("_status")
    )
    return edges.join(known, "src", "left").select(
        "epic",
        "src",
        "dst",
        F.coalesce("_status", F.lit("open")).alias("src_status"),
        F.coalesce(F.col("_src_epic") == F.col("epic"), F.lit(False)).alias("in_epic"),
    )


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (epic, src, dst, w) between nodes that are not inside a stretch, and epics with a bare ring.

    A stretch is a run of nodes with one way in and one way out. Each of its nodes points to
    the next; in every round it points on to where that one points, so the distance doubles
    and all know the end of their stretch after a logarithm of its length. In a round
    without any progress only rings are left, which have no end.
    """
    out = edges.groupBy("epic", F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("outs"), F.min("dst").alias("next"))
    into = edges.groupBy("epic", F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("ins"))
    inner = cut_lineage(out.join(into, ["epic", "v"]).filter("outs = 1 and ins = 1").select("epic", "v", "next"))
    within = inner.select("epic", F.col("v").alias("next"), F.lit(True).alias("open"))
    at = cut_lineage(
        inner.join(within, ["epic", "next"], "left").select("epic", "v", "next", F.lit(1).cast("long").alias("w"), F.coalesce("open", F.lit(False)).alias("open"))
    )
    open_, before = at.filter("open").count(), -1
    while open_ and open_ != before:
        ahead = at.select("epic", F.col("v").alias("next"), F.col("next").alias("_next"), F.col("w").alias("_w"), F.col("open").alias("_open"))
        moved = at.filter("open").join(ahead, ["epic", "next"]).select("epic", "v", F.col("_next").alias("next"), F.col("w") + F.col("_w"), F.col("_open"))
        at = cut_lineage(at.filter(~F.col("open")).union(moved))
        open_, before = at.filter("open").count(), open_
    rings = at.filter("open").select("epic").distinct()
    ends = at.filter(~F.col("open")).select("epic", F.col("v").alias("dst"), "next", "w")
    outer = edges.join(inner.select("epic", F.col("v").alias("src")), ["epic", "src"], "left_anti")
    # an edge into a stretch goes on to its end
    long = outer.join(ends, ["epic", "dst"], "left").select(
        "epic", "src", F.coalesce("next", "dst").alias("dst"), (1 + F.coalesce("w", F.lit(0))).alias("w")
    )
    return long, rings


def _depths(edges: DataFrame) -> DataFrame:
    """``(epic, depth, cyclic)`` of each epic with edges (epic, src, dst).

    Stretches are contracted, and the rest is peeled: an edge goes when no edge leads into
    its source any more, and hands on the distance of its source. An epic in which none
    goes is stuck in a cycle and out of the next round; what its cycle was handed counts.
    """
    spark = edges.sparkSession
    root = scratch(spark, "rounds")
    long, rings = _contracted(cut_lineage(edges.distinct()))
    here = long.withColumn("d", F.lit(0).cast("long"))
    for k in count():
        entered = here.select("epic", F.col("dst").alias("src"), F.lit(False).alias("goes")).distinct()
        here = cut_lineage(here.join(entered, ["epic", "src"], "left").withColumn("goes", F.coalesce("goes", F.lit(True))))
        handed = F.max(F.when(F.col("goes"), F.col("d") + F.col("w")))
        rounds = here.groupBy("epic").agg(handed.alias("far"), F.bool_or("goes").alias("moved"))
        rounds.write.mode("overwrite").parquet(f"{root}/round={k}")
        if here.isEmpty():
            break
        moved = spark.read.schema("epic string, far long, moved boolean").parquet(f"{root}/round={k}").filter("moved").select("epic")
        reached = here.filter("goes").groupBy("epic", F.col("dst").alias("src")).agg(F.max(F.col("d") + F.col("w")).alias("_d"))
        here = (
            here.filter(~F.col("goes")).join(moved, "epic", "left_semi").join(reached, ["epic", "src"], "left")
            .select("epic", "src", "dst", "w", F.greatest("d", F.coalesce("_d", F.lit(0))).alias("d"))
        )
    peeled = spark.read.schema("epic string, far long, moved boolean, round int").parquet(root)
    found = peeled.select("epic", "far", (~F.col("moved")).alias("cyclic"))
    found = found.union(rings.select("epic", F.lit(0).cast("long"), F.lit(True)))
    return found.groupBy("epic").agg((F.coalesce(F.max("far"), F.lit(0)) + 1).alias("depth"), F.bool_or("cyclic").alias("cyclic"))


def dag_shape(items: DataFrame) -> DataFrame:
    """Roots, depth, direction per epic; ``cyclic`` where prerequisites run in a circle.

    Rounds grow with the logarithm of the longest stretch without branches, and with the
    number of branching nodes on the longest way.
    """
    tasks = _tasks(items).withColumn("epic", _epic(items)).filter(F.col("epic").isNotNull())
    all_edges = prerequisite_edges(items).filter(F.col("epic").isNotNull())
    shapes = _depths(all_edges.filter("in_epic").select("epic", "src", "dst"))
    entered = all_edges.filter("in_epic").select("epic", F.col("dst").alias("id")).distinct()
    roots = (
        tasks.join(entered, ["epic", "id"], "left_anti")
        .groupBy("epic")
        .agg(F.count_distinct("id").alias("roots"))
    )
    nodes = tasks.groupBy("epic").agg(F.count_distinct("id").alias("nodes"))
    n_edges = all_edges.groupBy("epic").agg(F.count(F.lit(1)).alias("edges"))
    shaped = (
        nodes.join(roots, "epic", "left")
        .join(n_edges, "epic", "left")
        .join(shapes, "epic", "left")
        .select(
            "epic",
            "nodes",
            F.coalesce("edges", F.lit(0)).alias("edges"),
            F.coalesce("roots", F.lit(0)).alias("roots"),
            F.coalesce("depth", F.lit(1)).cast("long").alias("depth"),
            F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        )
    )
    return shaped.withColumn(
        "direction",
        F.when(F.col("edges") == 0, "LR")
        .when(F.col("roots") > 4, "LR")
        .when(F.col("depth") > F.col("roots"), "LR")
        .otherwise("TD"),
    )


def eligible(items: DataFrame) -> DataFrame:
    """Open items as eligible or blocked, paused items as may_resume or waiting."""
    ready = (
        prerequisite_edges(items)
        .groupBy(F.col("dst").alias("id"))
        .agg(
            F.bool_and(F.col("src_status") == "closed").alias("ready"),
            F.count_if(F.col("src_status") != "closed").alias("blockers"),
        )
    )
    is_ready = F.coalesce("ready", F.lit(True))
    return (
        _tasks(items)
        .filter(F.col("status").isin("open", "paused"))
        .join(ready, "id", "left")
        .select(
            "id",
            "status",
            F.coalesce("blockers", F.lit(0)).alias("blockers"),
            F.when((F.col("status") == "open") & is_ready, "eligible")
            .when(F.col("status") == "open", "blocked")
            .when(is_ready, "may_resume")
            .otherwise("waiting")
            .alias("state"),
        )
    )


def effort_hours(label: Column) -> Column:
    """Hours of an effort label, null if unknown."""
    return lookup(R.EFFORT_HOURS, T.strip(label))


def effort_days(label: Column) -> Column:
    """Days of an effort label: the lower-cased text before a bracket."""
    word = T.strip(F.lower(F.split(label, r"\(", 2)[0]))
    return F.coalesce(lookup(R.EFFORT_DAYS, word), F.lit(R.EFFORT_DAYS_DEFAULT))


def latest_closures(closures: DataFrame) -> DataFrame:
    """One closure per basename: latest date, then latest position."""
    rest = [c for c in closures.columns if c != "basename"]
    return (
        closures.groupBy("basename")
        .agg(F.max_by(F.struct(*rest), F.struct("closed_on", "pos")).alias("r"))
        .select("basename", "r.*")
    )


def burn_up(closures: DataFrame) -> DataFrame:
    """Per day tasks, epics, hours, and their running totals. Unknown hours add nothing."""
    is_epic = F.col("kind") == "epic"
    daily = closures.groupBy(F.col("closed_on").alias("day")).agg(
        F.count_if(~is_epic).alias("tasks"),
        F.count_if(is_epic).alias("epics"),
        F.coalesce(F.sum("effort_h"), F.lit(0.0)).alias("est_h"),
        F.coalesce(F.sum("effort_actual_h"), F.lit(0.0)).alias("actual_h"),
    )
    # One row per calendar day by now, so a single ordered window is small at any scale.
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.select(
        "*",
        *[
            F.sum(c).over(upto).alias(f"cum_{c}")
            for c in ("tasks", "epics", "est_h", "actual_h")
        ],
    )


def board(items: DataFrame) -> DataFrame:
    """Cards of epics with unfinished work: ``(epic, status, position, id)``.

    Items without an epic are under ``Other``; unknown statuses are dropped.
    """
    cards = (
        _tasks(items)
        .withColumn("status", F.coalesce("status", F.lit("open")))
        .filter(F.col("status").isin(*R.STATUSES))
        .select(F.coalesce(_epic(items), F.lit("Other")).alias("epic"), "status", "id")
    )
    live = (
        cards.groupBy("epic")
        .agg(F.bool_or(F.col("status") != "closed").alias("unfinished"))
        .filter("unfinished")
        .select("epic")
    )
    return numbered(
        cards.join(live, "epic", "left_semi"), ["epic", "status"], ["id"], "position"
    ).withColumn("epic_key", T.fold(F.col("epic")))


def idea_index(fronts: DataFrame) -> DataFrame:
    """Idea rows by folder; sub-notes ``idea-N.x.md`` are left out."""
    name = T.basename(F.col("path"))
    field = lambda n: F.try_element_at("fields", F.lit(n))
    category = T.strip(F.coalesce(field("category"), F.lit("")))
    icon = lookup(R.CATEGORY_ICONS, category)
    return (
        fronts.filter(F.col("folder").isin("open", "archived"))
        .filter(~name.rlike(r"(?i)^idea-\d+\..+\.md\z"))
        .select(
            "folder",
            F.coalesce(field("id"), F.lit("?")).alias("id"),
            F.when(category == "", "—")
            .when(icon.isNotNull(), F.concat(icon, F.lit(chr(0xA0)), category))
            .otherwise(category)
            .alias("category"),
            F.coalesce(field("title"), name).alias("title"),
            F.coalesce(field("description"), F.lit("")).alias("description"),
            name.alias("file"),
        )
    )


def idea_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("folder").agg(F.count(F.lit(1)).alias("ideas"))


RELEASE = r"/archive/(v\d+\.\d+\.\d+)/[^/]+\.md\z"


def release_index(archived: DataFrame) -> DataFrame:
    """Tasks per release, from ``(path, fields)`` of archived files; epics are left out."""
    field = lambda n: F.try_element_at("fields", F.lit(n))
    return (
        archived.withColumn("version", F.regexp_extract("path", RELEASE, 1))
        .filter((F.col("version") != "") & ~F.coalesce(field("id"), F.lit("")).startswith("EPIC-"))
        .select(
            "version",
            F.coalesce(field("id"), F.lit("?")).alias("id"),
            F.coalesce(field("title"), T.basename(F.col("path"))).alias("title"),
            F.coalesce(field("effort"), F.lit("?")).alias("effort"),
            F.coalesce(field("complexity"), F.lit("?")).alias("complexity"),
        )
    )


def strip_generated(text: Column) -> Column:
    """Text without generator notices and markers; runs of blank lines collapse."""
    for pattern in R.GENERATED_LINES:
        text = F.regexp_replace(text, pattern, "")
    return F.ltrim(F.regexp_replace(text, r"\n{3,}", "\n\n"), F.lit("\n"))
