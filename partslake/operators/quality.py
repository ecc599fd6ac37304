"""Data-quality rules: rows and pages in, diagnostics ``(bin, path, line, rule, message)`` out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partslake.functions import rules as R
from partslake.functions import text as T
from partslake.functions.arrays import exploded, posexploded
from partslake.plans.running import CHUNK_ROWS, int_chunk, running
from partslake.sources.markdown import _marks, _stretches, _tables_in_row, inventory_rows


def can_match(text: Column, rule: R.Rule) -> Column:
    """Whether a text contains what every match of the rule needs.

    A pattern without case is checked on folded text: upper, then lower case brings
    together all characters such a pattern takes as equal.
    """
    if not rule.needs:
        return F.lit(True)
    seen = F.lower(F.upper(text)) if rule.pattern.startswith("(?i") else text
    return reduce(lambda a, b: a | b, [F.contains(seen, F.lit(n)) for n in rule.needs])


def any_of(text: Column, rules: Sequence[R.Rule]) -> Column:
    """Whether a whole text can match one of the rules; most documents stop here."""
    return reduce(lambda a, b: a | b, [can_match(text, r) for r in rules])


def matching(line: Column, rules: Sequence[R.Rule], extra=None) -> Column:
    """Array of the rules a line matches, as structs; patterns are literals."""
    hits = [
        F.when(
            can_match(line, r) & line.rlike(r.pattern) & (F.lit(True) if extra is None else extra(r)),
            F.struct(
                F.lit(r.name).alias("rule"),
                F.lit(r.message).alias("message"),
                F.lit(r.severity).alias("severity"),
            ),
        )
        for r in rules
    ]
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


def _diagnostics(rows: DataFrame, rule: str, message: Column) -> DataFrame:
    return rows.select(
        "bin",
        "path",
        F.col("line_no").alias("line"),
        F.lit(rule).alias("rule"),
        message.alias("message"),
    )


def _quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), value, F.lit("'"))


def _source_message() -> Column:
    src = F.coalesce(F.col("source"), F.lit(""))
    message = (
        F.when(
            F.array_position("header", F.lit("Source")) > F.col("n_cells"),
            F.lit("row is missing the Source cell"),
        )
        .when(src == "", "Source cell is empty")
        .when(
            T.has_outer_blanks(src),
            F.concat(F.lit("Source cell has leading or trailing whitespace: "), _quoted(src)),
        )
        .when(
            ~src.rlike(T.SOURCE_TOKEN),
            F.concat(F.lit("Source must be a lowercase token (got "), _quoted(src), F.lit(")")),
        )
    )
    return F.when(~F.col("is_empty"), message)


def lint_source_shape(rows: DataFrame) -> DataFrame:
    """Source missing from a short row, empty, or no lowercase token."""
    found = rows.withColumn("_m", _source_message()).filter("_m is not null")
    return _diagnostics(found, "source-shape", F.col("_m"))


def with_previous(rows: DataFrame, width: int = CHUNK_ROWS) -> DataFrame:
    """Add the key and line of the row above that counts, for rows without them.

    Rows read from Markdown carry both already; this is for row tables.
    """
    counted = rows.filter(~F.col("is_empty") & (F.coalesce("part_cell", F.lit("")) != ""))
    return running(
        counted,
        ["path", "table_id"],
        ["line_no"],
        int_chunk("line_no", width),
        lags={"prev_key": T.fold(F.col("part")), "prev_line": F.col("line_no")},
    )


def _order_message() -> Column:
    wrong = (
        ~F.col("is_empty")
        & (F.coalesce("part_cell", F.lit("")) != "")
        & (T.fold(F.col("part")) < F.col("prev_key"))
    )
    return F.when(
        wrong,
        F.concat(
            F.lit("Part "),
            _quoted(F.col("part_cell")),
            F.lit(" should sort before the previous row at line "),
            F.col("prev_line").cast("string"),
        ),
    )


def lint_alphabetical(rows: DataFrame) -> DataFrame:
    """Row whose key sorts below the row above; the message names that row's line."""
    if "prev_key" not in rows.columns:
        rows = with_previous(rows)
    found = rows.withColumn("_m", _order_message()).filter("_m is not null")
    return _diagnostics(found, "alphabetical-order", F.col("_m"))


def is_hedged(text: Column, phrases: Sequence[str] = R.HEDGE_PHRASES) -> Column:
    return T.bound(T.fold(text), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in phrases]))


def _hedge_message(phrases: Sequence[str]) -> Column:
    notes = T.strip(F.coalesce("notes", F.lit("")))
    bare = (
        ~F.col("is_empty")
        & (F.col("source") == "camera")
        & (notes != "")
        & ~is_hedged(notes, phrases)
    )
    return F.when(bare, "camera-sourced row has a Notes cell with no hedge phrase")


def lint_row_hedge(rows: DataFrame, phrases: Sequence[str] = R.HEDGE_PHRASES) -> DataFrame:
    """Camera row whose Notes say something without a hedge phrase."""
    found = rows.withColumn("_m", _hedge_message(phrases)).filter("_m is not null")
    return _diagnostics(found, "hedge-language", F.col("_m"))


def lint_parts_link(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Link target that is no page of the bin. ``pages`` is ``(bin, page)``."""
    linked = rows.filter(~F.col("is_empty") & F.col("target").isNotNull())
    known = pages.select("bin", F.col("page").alias("target")).distinct()
    return _diagnostics(
        linked.join(known, ["bin", "target"], "left_anti"),
        "parts-link",
        F.concat(F.lit("link target does not exist: parts/"), F.col("target")),
    )


def lint_rows(
    rows: DataFrame, pages: DataFrame | None = None, phrases: Sequence[str] = R.HEDGE_PHRASES
) -> DataFrame:
    """All row rules; the link rule needs the page listing. Reads the rows once.

    A row's findings are an array; a link to a page is one of them, and stays if the
    listing lacks the page.
    """
    if "prev_key" not in rows.columns:
        found = lint_source_shape(rows).unionByName(lint_alphabetical(rows)).unionByName(lint_row_hedge(rows, phrases))
        return found if pages is None else found.unionByName(lint_parts_link(rows, pages))
    link = F.when(~F.col("is_empty"), F.col("target"))
    messages = {
        "source-shape": _source_message(),
        "alphabetical-order": _order_message(),
        "hedge-language": _hedge_message(phrases),
        "parts-link": F.concat(F.lit("link target does not exist: parts/"), link),
    }
    if pages is None:
        del messages["parts-link"]
    all_found = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), m.alias("message"), (link if rule == "parts-link" else F.lit(None)).alias("target"))
            for rule, m in messages.items()
        ]
    )
    found = rows.select(
        "bin", "path", F.col("line_no").alias("line"),
        F.explode(F.filter(all_found, lambda d: d["message"].isNotNull())).alias("d"),
    ).select("bin", "path", "line", "d.*")
    if pages is None:
        return found.drop("target")
    known = pages.select("bin", F.col("page").alias("_key"), F.lit(True).alias("_known")).distinct()
    # findings without a target spread over the join by their place
    key = F.coalesce("target", F.concat_ws("\0", F.lit(""), "path", F.col("line").cast("string")))
    return (
        found.withColumn("_key", key)
        .join(known, ["bin", "_key"], "left")
        .filter(F.col("target").isNull() | F.col("_known").isNull())
        .select("bin", "path", "line", "rule", "message")
    )


def lint_inventory(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """All row rules over every parts table of every bin."""
    return lint_rows(inventory_rows(docs), pages)


def lint_page_hedge(
    docs: DataFrame, rules: Sequence[R.Rule] = R.PAGE_CLAIMS, marker: str = R.SUPPRESS_MARKER
) -> DataFrame:
    """Absolute claims outside fences, quotes, comments and suppressed lines.

    A fence line toggles and is skipped; an open fence exempts the rest. One diagnostic
    per rule and line.
    """
    lines = (
        docs.filter(any_of(F.col("text"), rules))
        .select("bin", "path", T.split_lines(F.col("text")).alias("lines"))
    )
    cut = _stretches(
        lines, _marks(F.col("lines"), lambda s: s.rlike(r"(?U)^\s*```"), lambda s: s)
    ).filter(F.col("nth") % 2 == 0)
    texts = (
        posexploded(cut, ["bin", "path", "nth", "start"], "stretch", "i", "text")
        # an even stretch after the first begins with the fence line that closes
        .filter((F.col("nth") == 0) | (F.col("i") > 0))
        .filter(~F.col("text").rlike(r"(?U)^\s*>") & ~F.contains("text", F.lit(marker)))
    )
    scan = F.regexp_replace("text", "(?d)<!--.*?-->", "")
    return exploded(
        texts,
        ["bin", "path", (F.col("start") + F.col("i")).alias("line")],
        matching(scan, rules),
        "h",
    ).select(
        "bin",
        "path",
        "line",
        "h.rule",
        F.concat(F.lit("absolute-claim phrasing "), _quoted(F.col("h.rule"))).alias("message"),
    )


def scan_forbidden(
    files: DataFrame,
    rules: Sequence[R.Rule] = R.FORBIDDEN,
    extensions: Sequence[str] = R.TEXT_EXTENSIONS,
) -> DataFrame:
    """Forbidden text per line of ``(path, text)`` files: path, line, rule, finding."""
    name = T.basename(F.col("path"))
    suffix = F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1))
    opened = files.filter(~name.startswith(".") & suffix.isin(*extensions)).filter(
        any_of(F.col("text"), rules)
    )
    lines = posexploded(opened, ["path"], T.split_lines(F.col("text")), "i", "line")
    in_docs = F.col("path").startswith("docs/")
    hits = matching(
        F.col("line"), rules, lambda r: ~in_docs if r.skip_docs else F.lit(True)
    )
    return exploded(lines, ["path", (F.col("i") + 1).alias("line")], hits, "h").select(
        "path",
        "line",
        "h.rule",
        F.concat_ws(":", "path", "line", F.concat(F.lit(" "), F.col("h.message"))).alias("finding"),
    )


def parse_allowlist(lines: DataFrame) -> DataFrame:
    """``path:fragment`` lines to ``(path, fragment)``; comments and malformed lines go."""
    line = T.strip(F.col("text"))
    parts = F.split(line, ":", 3)
    return (
        lines.filter((line != "") & ~line.startswith("#"))
        .select(
            T.strip(F.get(parts, F.lit(0))).alias("path"),
            T.strip(F.get(parts, F.lit(1))).alias("fragment"),
        )
        .filter((F.col("path") != "") & (F.coalesce("fragment", F.lit("")) != ""))
    )


def apply_allowlist(findings: DataFrame, allow: DataFrame) -> DataFrame:
    """Findings not named by an entry of the same path whose fragment they contain."""
    entries = allow.select(F.col("path").alias("_path"), F.col("fragment").alias("_fragment"))
    return findings.join(
        entries,
        (F.col("path") == F.col("_path")) & F.contains("finding", F.col("_fragment")),
        "left_anti",
    )


def lint_split(section_docs: DataFrame, masters: DataFrame) -> DataFrame:
    """Split bins: one row shape, every file in the master, no part in two files."""
    rows = inventory_rows(section_docs)
    twice = (
        rows.filter(~F.col("is_empty") & (F.col("part") != ""))
        .groupBy("bin", "part")
        .agg(F.count_distinct("path").alias("files"), F.min("path").alias("path"), F.min("line_no").alias("line"))
        .filter("files > 1")
        .select(
            "bin",
            "path",
            "line",
            F.lit("split-duplicate").alias("rule"),
            F.concat(F.lit("part in several files: "), F.col("part")).alias("message"),
        )
    )
    headers = rows.groupBy("bin", "path").agg(
        F.min("line_no").alias("line"), F.min("header").alias("low"), F.max("header").alias("high")
    )
    shape = headers.groupBy("bin").agg(F.min_by("low", "path").alias("first"))
    mixed = (
        headers.join(shape, "bin")
        .filter((F.col("low") != F.col("first")) | (F.col("high") != F.col("first")))
        .select(
            "bin",
            "path",
            "line",
            F.lit("split-shape").alias("rule"),
            F.lit("row shape differs from the bin's first file").alias("message"),
        )
    )
    listed = masters.select(
        "bin",
        F.explode(
            F.regexp_extract_all("text", F.lit(r"\]\((?:\./)?([^)/]+\.md)\)"), F.lit(1))
        ).alias("name"),
    ).distinct()
    missing = (
        section_docs.select("bin", "path", T.basename(F.col("path")).alias("name"))
        .join(listed, ["bin", "name"], "left_anti")
        .select(
            "bin",
            "path",
            F.lit(0).alias("line"),
            F.lit("split-unlisted").alias("rule"),
            F.lit("file is not in the master index").alias("message"),
        )
    )
    return twice.unionByName(mixed).unionByName(missing)


def suggest_split(
    docs: DataFrame, max_rows: int = 200, max_bytes: int = 30 * 1024, marker: str = R.SPLIT_DECLINED
) -> DataFrame:
    """Bins that reached the row or byte bound and have not declined."""
    is_parts = lambda t: F.array_contains(t["header"], "Part") & F.array_contains(t["header"], "Source")
    counted = _tables_in_row(docs).select(
        "bin",
        F.aggregate(
            F.filter("tables", is_parts), F.lit(0), lambda n, t: n + F.size(t["rows"])
        ).alias("rows"),
    )
    sizes = docs.groupBy("bin").agg(
        F.sum(F.octet_length("text")).alias("bytes"),
        F.max(F.contains("text", F.lit(marker))).alias("declined"),
    )
    totals = counted.groupBy("bin").agg(F.sum("rows").alias("rows"))
    return (
        totals.join(sizes, "bin")
        .filter(~F.col("declined"))
        .filter((F.col("rows") >= max_rows) | (F.col("bytes") >= max_bytes))
        .select("bin", "rows", "bytes")
    )


def verdict_ok(
    text: Column,
    openings: Sequence[str] = R.HEDGE_OPENINGS,
    modals: Sequence[str] = R.FORBIDDEN_MODALS,
) -> Column:
    """Identification that opens with a hedge and holds no absolute word."""
    return text.rlike(rf"(?iU)^\s*(?:{'|'.join(openings)})\b") & ~text.rlike(
        rf"(?iU)\b(?:{'|'.join(modals)})\b"
    )


def check_verdicts(verdicts: DataFrame, cap: int = 2, width: int = CHUNK_ROWS) -> DataFrame:
    """Outcome per answer ``(capture_id, seq, text)``: accepted, retry, or no_idea.

    The failure after ``cap`` retries ends the capture.
    """
    ok = F.coalesce(verdict_ok(F.col("text")), F.lit(False))
    counted = running(
        verdicts,
        ["capture_id"],
        ["seq"],
        int_chunk("seq", width),
        sums={"failures": F.when(ok, 0).otherwise(1)},
    )
    return counted.withColumn(
        "outcome",
        F.when(ok, "accepted").when(F.col("failures") > cap, "no_idea").otherwise("retry"),
    )


def hint_family(
    verdicts: DataFrame,
    families: Sequence[R.Rule] = R.HINT_FAMILIES,
    generic: str = R.GENERIC_HINT,
) -> DataFrame:
    """Family of a re-frame hint, first match wins; else the generic text is shown."""
    family = F.coalesce(*[F.when(F.col("hint").rlike(r.pattern), r.name) for r in families])
    return verdicts.withColumn("family", family).withColumn(
        "shown", F.when(F.col("family").isNotNull(), F.col("hint")).otherwise(generic)
    )
