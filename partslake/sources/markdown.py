"""Markdown and log text to rows.

A document is one row ``(bin, path, text)``. Lines, sections and tables are found with
array functions inside that row and exploded at the end, so reading a corpus of any
size needs no shuffle, and no group is larger than one document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partslake.functions import text as T
from partslake.functions.arrays import exploded, posexploded


def scan_docs(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.md") -> DataFrame:
    """Files to ``(bin, path, text)``; the bin is the folder a file lies in."""
    return (
        spark.read.text(paths, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
        .select(
            T.folder(F.col("_metadata.file_path")).alias("bin"),
            F.col("_metadata.file_path").alias("path"),
            F.col("value").alias("text"),
        )
    )


def read_split_bin(
    spark: SparkSession, paths: str | Sequence[str], master: str = "INVENTORY.md"
) -> DataFrame:
    """Section files of split bins; the master index is left out."""
    return section_files(scan_docs(spark, paths), master)


def section_files(docs: DataFrame, master: str = "INVENTORY.md") -> DataFrame:
    return docs.filter(T.basename(F.col("path")) != master)


def scan_lines(docs: DataFrame) -> DataFrame:
    """``(bin, path, line_no, text)``, lines counted from 1."""
    return posexploded(
        docs, ["bin", "path"], T.split_lines(F.col("text")), "pos", "line"
    ).select("bin", "path", (F.col("pos") + 1).alias("line_no"), F.col("line").alias("text"))


def _marks(lines: Column, is_mark, value) -> Column:
    """Array of (line_no, value) for the lines that satisfy ``is_mark``."""
    return F.filter(
        F.transform(
            lines,
            lambda line, i: F.when(
                is_mark(line), F.struct((i + 1).alias("no"), value(line).alias("value"))
            ),
        ),
        lambda m: m.isNotNull(),
    )


def _stretches(df: DataFrame, marks: Column) -> DataFrame:
    """Cut ``lines`` at marks into ``(nth, value, start, stretch)``.

    The nth stretch starts at the nth mark; stretch 0 lies before the first, without value.
    """
    none = F.struct(F.lit(0).alias("no"), F.lit(None).cast("string").alias("value"))
    keep = [c for c in df.columns if c != "lines"]
    cut = df.withColumn("bounds", F.concat(F.array(none), marks))
    cut = cut.withColumn(
        "cuts",
        F.transform(
            "bounds",
            lambda b, i: F.struct(
                i.alias("nth"),
                b["value"].alias("value"),
                F.greatest(b["no"], F.lit(1)).alias("start"),
                F.slice(
                    F.col("lines"),
                    F.greatest(b["no"], F.lit(1)),
                    F.coalesce(F.get("bounds", i + 1)["no"], F.size("lines") + 1)
                    - F.greatest(b["no"], F.lit(1)),
                ).alias("stretch"),
            ),
        ),
    )
    return exploded(cut, keep, "cuts", "c").select(*keep, "c.*")


def with_sections(docs: DataFrame) -> DataFrame:
    """Lines tagged with their ``## `` section; null before the first heading."""
    lines = docs.select("bin", "path", T.split_lines(F.col("text")).alias("lines"))
    cut = _stretches(
        lines,
        _marks(
            F.col("lines"),
            lambda s: s.startswith("## "),
            lambda s: T.strip(F.substring(s, 4, 1 << 30)),
        ),
    )
    return posexploded(
        cut, ["bin", "path", F.col("value").alias("section"), "start"], "stretch", "pos", "text"
    ).select("bin", "path", (F.col("start") + F.col("pos")).alias("line_no"), "section", "text")


def _tables_in_row(docs: DataFrame) -> DataFrame:
    """Documents with their pipe tables as an array, in line order.

    A table is an unbroken run of table lines; its header is the first line followed by
    a separator, its rows are all lines after that separator.
    """
    df = docs.select("bin", "path", T.split_lines(F.col("text")).alias("lines"))
    df = df.withColumn(
        "kind",
        F.transform(
            "lines",
            lambda s: F.when(
                T.is_table_line(s), F.when(T.is_separator_line(s), 2).otherwise(1)
            ).otherwise(0),
        ),
    ).withColumn(
        "heads",
        _marks(
            F.col("lines"),
            lambda s: s.startswith("## "),
            lambda s: T.strip(F.substring(s, 4, 1 << 30)),
        ),
    )

    def edges(step: int) -> Column:
        return F.filter(
            F.transform(
                "kind",
                lambda k, i: F.when(
                    (k > 0) & (F.coalesce(F.get("kind", i + step), F.lit(0)) == 0), i + 1
                ),
            ),
            lambda i: i.isNotNull(),
        )

    df = df.withColumn("starts", edges(-1)).withColumn("ends", edges(+1))
    df = df.withColumn(
        "runs",
        F.transform(
            "starts",
            lambda s, i: F.struct(
                s.alias("start"),
                F.get("ends", i).alias("end"),
                # offset of the first separator after the run's first line, 0 if none
                F.array_position(
                    F.slice(F.col("kind"), s + 1, F.get("ends", i) - s), F.lit(2)
                ).cast("int").alias("sep"),
            ),
        ),
    )
    df = df.withColumn("runs", F.filter("runs", lambda r: r["sep"] > 0))
    table = F.transform(
        "runs",
        lambda r: F.struct(
            (r["start"] + r["sep"] - 1).alias("header_line"),
            F.get(
                F.slice(
                    F.filter("heads", lambda h: h["no"] < r["start"]), -1, 1
                ),
                F.lit(0),
            ).alias("head"),
            T.split_cells(F.get("lines", r["start"] + r["sep"] - 2)).alias("header"),
            F.transform(
                F.slice(
                    F.col("lines"), r["start"] + r["sep"] + 1, r["end"] - r["start"] - r["sep"]
                ),
                lambda line, j: F.struct(
                    (r["start"] + r["sep"] + 1 + j).alias("line_no"),
                    T.split_cells(line).alias("cells"),
                ),
            ).alias("rows"),
        ),
    )
    return df.select("bin", "path", "lines", "heads", "runs").select(
        "bin", "path", table.alias("tables")
    )


def table_blocks(docs: DataFrame) -> DataFrame:
    """One row per pipe table: section, header line, header, rows with their lines."""
    return (
        posexploded(_tables_in_row(docs), ["bin", "path"], "tables", "table_id", "t")
        .select(
            "bin",
            "path",
            F.col("t.head.value").alias("section"),
            "table_id",
            "t.header_line",
            "t.header",
            "t.rows",
        )
    )


def inventory_rows(docs: DataFrame) -> DataFrame:
    """Rows of parts tables, cells keyed by header.

    ``first_table`` marks the tables a write may touch: the first parts table of each
    section. ``prev_line`` / ``prev_key`` are the row above that counts for sort order.
    """
    parts = _tables_in_row(docs).withColumn(
        "tables",
        F.filter(
            F.transform("tables", lambda t, i: F.struct(i.alias("table_id"), t.alias("t"))),
            lambda x: F.array_contains(x["t"]["header"], "Part")
            & F.array_contains(x["t"]["header"], "Source"),
        ),
    )
    head_no = lambda x: F.coalesce(x["t"]["head"]["no"], F.lit(0))
    parts = parts.withColumn(
        "tables",
        F.transform(
            "tables",
            lambda x, i: F.struct(
                x["table_id"].alias("table_id"),
                x["t"].alias("t"),
                (
                    (head_no(x) > 0)
                    & ((i == 0) | (head_no(F.get("tables", i - 1)) != head_no(x)))
                ).alias("first_table"),
            ),
        ),
    )
    tables = exploded(parts, ["bin", "path"], "tables", "x").select(
        "bin",
        "path",
        F.col("x.t.head.value").alias("section"),
        "x.table_id",
        "x.first_table",
        F.col("x.t.header").alias("header"),
        F.col("x.t.rows").alias("rows"),
    )
    part_at = F.array_position("header", F.lit("Part")).cast("int") - 1

    def has_part(r: Column) -> Column:
        return F.coalesce(F.get(r["cells"], part_at), F.lit("")) != ""

    tables = tables.withColumn("sorted", F.filter("rows", has_part)).withColumn(
        "rest", F.filter("rows", lambda r: ~has_part(r))
    )
    previous = lambda r, i: F.struct(
        r["line_no"].alias("line_no"),
        r["cells"].alias("cells"),
        F.get("sorted", i - 1)["line_no"].alias("prev_line"),
        F.get(F.get("sorted", i - 1)["cells"], part_at).alias("prev_cell"),
    )
    alone = lambda r: F.struct(
        r["line_no"].alias("line_no"),
        r["cells"].alias("cells"),
        F.lit(None).cast("int").alias("prev_line"),
        F.lit(None).cast("string").alias("prev_cell"),
    )
    rows = exploded(
        tables,
        ["bin", "path", "section", "table_id", "first_table", "header"],
        F.concat(F.transform("sorted", previous), F.transform("rest", alone)),
        "r",
    ).select(
        "bin", "path", "section", "table_id", "first_table", "header",
        "r.line_no", F.col("r.cells").alias("raw"), "r.prev_line", "r.prev_cell",
    )
    rows = rows.withColumn("names", F.array_distinct("header")).withColumn(
        "cells",
        F.map_from_arrays(
            "names",
            F.transform(
                "names",
                lambda h: F.coalesce(
                    F.get("raw", F.array_position("header", h).cast("int") - 1), F.lit("")
                ),
            ),
        ),
    )
    return rows.select(
        "bin",
        "path",
        "section",
        "table_id",
        "first_table",
        "line_no",
        "header",
        "cells",
        F.size("raw").alias("n_cells"),
        F.col("cells")["Part"].alias("part_cell"),
        T.part_link(F.col("cells")["Part"]).alias("link"),
        F.coalesce(T.try_int(F.try_element_at("cells", F.lit("Qty"))), F.lit(0)).alias("qty"),
        F.col("cells")["Source"].alias("source"),
        F.try_element_at("cells", F.lit("Notes")).alias("notes"),
        (~F.exists("raw", lambda c: c != "")).alias("is_empty"),
        "prev_line",
        T.fold(T.part_link(F.col("prev_cell"))["part"]).alias("prev_key"),
    ).select(
        "*", F.col("link.part").alias("part"), F.col("link.page").alias("page"),
        F.col("link.target").alias("target"),
    ).drop("link")


def pin_tables(docs: DataFrame) -> DataFrame:
    """Pin, name and use from the DIP pinout tables of pages; other shapes are skipped."""
    at = lambda name: F.get(
        "cells", F.array_position("header", F.lit(name)).cast("int") - 1
    )
    rows = (
        table_blocks(docs)
        .filter(
            F.col("section").startswith("Pinout (DIP-")
            & F.array_contains("header", "Pin")
            & F.array_contains("header", "Name")
        )
    )
    rows = exploded(rows, ["path", "header"], "rows", "r").select(
        "path", "header", "r.line_no", "r.cells"
    )
    used = F.when(F.size("header") > 2, F.get("cells", F.lit(2)))
    return rows.select(
        "path", "line_no", at("Pin").alias("pin"), at("Name").alias("name"), used.alias("use")
    )


FRONTMATTER = r"(?s)\A---\n(.*?)\n---"
# A blank after the colon stays on the line, so an empty value is null.
FIELD = r"(?mdU)^(\w[\w-]*):[ \t]*(.*)$"


def with_fields(docs: DataFrame) -> DataFrame:
    """Add ``fields``, the frontmatter map; documents without frontmatter are dropped.

    The last of equal keys wins, an empty value is null.
    """
    block = F.regexp_extract("text", FRONTMATTER, 1)
    found = docs.filter(F.col("text").rlike(FRONTMATTER)).withColumn("_block", block)
    found = found.withColumn(
        "_keys", F.reverse(F.regexp_extract_all("_block", F.lit(FIELD), F.lit(1)))
    ).withColumn("_values", F.reverse(F.regexp_extract_all("_block", F.lit(FIELD), F.lit(2))))
    found = found.withColumn("_names", F.array_distinct("_keys"))
    value = lambda k: F.nullif(
        T.strip(F.get("_values", F.array_position("_keys", k).cast("int") - 1)), F.lit("")
    )
    return found.withColumn(
        "fields", F.map_from_arrays("_names", F.transform("_names", value))
    ).drop("_block", "_keys", "_values", "_names")


def scan_frontmatter(docs: DataFrame) -> DataFrame:
    """``(path, folder, fields)`` of documents with frontmatter; archived files are left out."""
    live = docs.filter(~F.col("path").contains("/archive/"))
    return with_fields(live).select("path", T.folder(F.col("path")).alias("folder"), "fields")


def work_items(fronts: DataFrame) -> DataFrame:
    """Typed work items from scanned frontmatter."""
    field = lambda name: F.try_element_at("fields", F.lit(name))
    return fronts.select(
        field("id").alias("id"),
        F.lower(F.regexp_extract(field("id"), r"^([A-Z]+)-", 1)).alias("kind"),
        field("title").alias("title"),
        field("status").alias("status"),
        "folder",
        "path",
        field("epic").alias("epic"),
        field("order").alias("ord_raw"),
        field("effort").alias("effort"),
        field("effort_actual").alias("effort_actual"),
        field("complexity").alias("complexity"),
        field("assigned").alias("assigned"),
        field("human-in-loop").alias("human_in_loop"),
        F.coalesce(
            F.regexp_extract_all(field("prerequisites"), F.lit(r"TASK-\d+"), F.lit(0)),
            F.array().cast("array<string>"),
        ).alias("prerequisites"),
    )


def scan_closure_log(docs: DataFrame) -> DataFrame:
    """``COMMIT <date>`` dates the paths after it; paths before the first are dropped."""
    lines = docs.select(
        F.col("path").alias("log"),
        F.transform(
            T.split_lines(F.col("text")), lambda s: F.rtrim(s, F.lit(T.BLANKS))
        ).alias("lines"),
    )
    cut = _stretches(
        lines,
        _marks(
            F.col("lines"),
            lambda s: s.startswith("COMMIT "),
            lambda s: T.strip(F.substring(s, 8, 1 << 30)),
        ),
    ).filter(F.col("value").isNotNull())
    return (
        posexploded(cut, ["log", "value", "start"], "stretch", "i", "path")
        .filter((F.col("i") > 0) & (F.col("path") != ""))
        .select(
            "log",
            "path",
            T.basename(F.col("path")).alias("basename"),
            F.when(T.basename(F.col("path")).startswith("epic-"), "epic").otherwise("task").alias("kind"),
            F.col("value").try_cast("date").alias("closed_on"),
            (F.col("start") + F.col("i")).cast("long").alias("pos"),
        )
    )


def _signed(lines: Column, sign: str) -> Column:
    return F.transform(
        F.filter(lines, lambda s: s.startswith(sign) & ~s.startswith(sign * 3)),
        lambda s: F.substring(s, 2, 1 << 30),
    )


def changed_lines(diff: Column, sign: str) -> Column:
    """Array of the added (``+``) or removed (``-``) lines of a unified diff.

    File headers go by their three signs, so content that starts like one goes too.
    """
    return _signed(T.split_lines(diff), sign)


def diff_lines(diffs: DataFrame) -> DataFrame:
    """``(change_id, file, sign, pos, text)`` of unified diffs."""
    split = diffs.select("change_id", "file", T.split_lines(F.col("diff")).alias("all"))
    signs = F.array(
        *[
            F.struct(F.lit(s).alias("sign"), _signed(F.col("all"), s).alias("lines"))
            for s in "+-"
        ]
    )
    sides = exploded(split, ["change_id", "file"], signs, "s")
    return posexploded(sides, ["change_id", "file", "s.sign"], "s.lines", "pos", "text")
