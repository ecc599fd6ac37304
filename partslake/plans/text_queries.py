"""Queries of the scans (A) and the data-quality rules (C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partslake.functions import rules as R
from partslake.functions import text as T
from partslake.operators import quality as Q
from partslake.plans.registry import query, spread_table, table
from partslake.session import scratch
from partslake.sources import markdown as M
from partslake.sources import stock_store as S

# ---------------------------------------------------------------- derived documents

HEADER = "| Part | Qty | Description | Source | Notes |"
RULE = "| --- | --- | --- | --- | --- |"

PART_CELL = (
    "case when p_partkey % 4 = 0 then concat('[P', p_partkey, '](parts/', replace(p_name, ' ', '-'), '.md)')"
    " when p_partkey % 4 = 1 then concat('see [P', p_partkey, '](parts/p', p_partkey % 30, '.md)')"
    " else concat('P', p_partkey) end"
)
SOURCE_CELL = (
    "case when p_partkey % 11 = 0 then 'Manual' when p_partkey % 13 = 0 then ''"
    " when p_partkey % 2 = 0 then 'camera' else 'manual' end"
)
NOTES_CELL = (
    "case when p_partkey % 3 = 0 then '' when p_partkey % 5 = 0 then concat('Likely ', p_name)"
    " else p_brand end"
)


def docs(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a page of the bin its source names."""
    return spread_table(spark, d, "documents", "doc_id").select(
        F.col("source").alias("bin"),
        F.concat_ws("/", "source", F.concat("doc_id", F.lit(".md"))).alias("path"),
        "text",
        "doc_id",
    )


DOCS = (
    "docs as (select source as bin, concat(source, '/', doc_id, '.md') as path, text, doc_id from documents)"
)


def index_docs(spark: SparkSession, d: str) -> DataFrame:
    """Index files built from the part table: 50 part numbers per bin, a section per type."""
    parts = table(spark, d, "part").selectExpr(
        "cast(floor(p_partkey / 50) as long) as bin_no",
        "p_type",
        "p_partkey",
        f"concat('| ', {PART_CELL}, ' | ', p_size, ' | ', p_name, ' | ', {SOURCE_CELL}, ' | ', {NOTES_CELL}, ' |') as line",
    )
    # at most 50 rows per bin, by the key
    sections = parts.groupBy("bin_no", "p_type").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]
            ),
            "\n",
        ).alias("rows")
    )
    body = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("p_type", "rows"))),
            lambda s: F.concat(
                F.lit("## "), s["p_type"], F.lit(f"\n\n{HEADER}\n{RULE}\n"), s["rows"], F.lit("\n")
            ),
        ),
        "\n",
    )
    return sections.groupBy("bin_no").agg(body.alias("body")).select(
        F.concat(F.lit("bin"), "bin_no").alias("bin"),
        F.concat(F.lit("bin"), "bin_no", F.lit("/INVENTORY.md")).alias("path"),
        F.concat(
            F.lit("# Index\n\n| Key | Value |\n| --- | --- |\n| bin | "),
            "bin_no",
            F.lit(" |\n\n"),
            "body",
        ).alias("text"),
    )


# The same files in SQL, their lines, and the table lines with their section.
INDEX = rf"""
cells as (select p_partkey // 50 as bin_no, p_type, p_partkey, p_size, p_name, {PART_CELL} as part_cell,
    {SOURCE_CELL} as source, {NOTES_CELL} as notes from part),
secs as (select bin_no, p_type, string_agg(concat('| ', part_cell, ' | ', p_size, ' | ', p_name, ' | ', source,
    ' | ', notes, ' |'), chr(10) order by p_partkey) as rows from cells group by all),
idx as (select concat('bin', bin_no) as bin, concat('bin', bin_no, '/INVENTORY.md') as path,
    concat('# Index', chr(10), chr(10), '| Key | Value |', chr(10), '| --- | --- |', chr(10), '| bin | ', bin_no,
    ' |', chr(10), chr(10),
    string_agg(concat('## ', p_type, chr(10), chr(10), '{HEADER}', chr(10), '{RULE}', chr(10), rows, chr(10)),
    chr(10) order by p_type)) as text from secs group by bin_no),
split as (select bin, path, string_split(regexp_replace(text, '\n$', ''), chr(10)) as ls from idx),
lines as (select bin, path, unnest(range(1, len(ls) + 1)) as line_no, unnest(ls) as text from split),
tagged as (select *, last_value(case when starts_with(text, '## ') then trim(text[4:]) end ignore nulls)
    over (partition by path order by line_no) as section from lines),
tab as (select *, sum(case when text like '|%' then 0 else 1 end) over (partition by path order by line_no) as run
    from tagged),
blk as (select *, min(line_no) over (partition by path, run) as head_line from tab where text like '|%'),
rows_ as (select bin, path, section, head_line, line_no, string_split(text[3:-3], ' | ') as c from blk
    where line_no > head_line + 1 and section is not null),
inv as (select bin, path, section, line_no, trim(c[1]) as part_cell, trim(c[2])::bigint as qty,
    trim(c[4]) as source, trim(c[5]) as notes,
    case when regexp_matches(c[1], '^\[([^\]]+)\]\(parts/[^)]+\.md\)') then
      regexp_extract(c[1], '^\[([^\]]+)\]', 1) else trim(c[1]) end as part,
    nullif(regexp_extract(c[1], '^\[[^\]]+\]\(parts/([^)]+\.md)\)', 1), '') as page,
    nullif(regexp_extract(c[1], '\[[^\]]+\]\(parts/([^)]+\.md)\)', 1), '') as target from rows_)
"""


@query(
    "a1_scan_lines",
    f"""with {DOCS}, s as (select bin, path, string_split(regexp_replace(text, '\\n$', ''), chr(10)) as ls from docs)
    select bin, path, unnest(range(1, len(ls) + 1))::int as line_no, unnest(ls) as text from s""",
)
def a1(spark, d):
    return M.scan_lines(docs(spark, d))


@query("a2_with_sections", f"with {INDEX} select bin, path, line_no::int as line_no, section, text from tagged")
def a2(spark, d):
    return M.with_sections(index_docs(spark, d))


@query(
    "a3_table_blocks",
    f"""with {INDEX} select path, section, min(line_no)::int as header_line,
    (count(*) - 2)::int as n_rows, min_by(text, line_no) as header from blk group by path, section, run""",
)
def a3(spark, d):
    return M.table_blocks(index_docs(spark, d)).select(
        "path",
        "section",
        "header_line",
        F.size("rows").alias("n_rows"),
        F.concat(F.lit("| "), F.array_join("header", " | "), F.lit(" |")).alias("header"),
    )


@query(
    "a4_inventory_rows",
    f"with {INDEX} select bin, path, section, line_no::int as line_no, part_cell, part, page, target, qty, source, notes from inv",
)
def a4(spark, d):
    return M.inventory_rows(index_docs(spark, d)).select(
        "bin", "path", "section", "line_no", "part_cell", "part", "page", "target", "qty", "source", "notes"
    )


@query(
    "a5_part_link",
    rf"""with c as (select p_partkey, {PART_CELL} as c from part) select p_partkey,
    case when c like '[%' then regexp_extract(c, '^\[([^\]]+)\]', 1) else c end as part,
    nullif(regexp_extract(c, '^\[[^\]]+\]\(parts/([^)]+\.md)\)', 1), '') as page,
    nullif(regexp_extract(c, '\[[^\]]+\]\(parts/([^)]+\.md)\)', 1), '') as target from c""",
)
def a5(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", T.part_link(F.expr(PART_CELL)).alias("link")
    ).select("p_partkey", "link.*")


FRONT = (
    "concat('---\n', 'id: TASK-', o_orderkey, '\n', 'title: Order of ', o_custkey, '\n', 'status: draft\n',"
    " 'status: ', lower(o_orderstatus), '\n', 'epic:\n', 'effort: ', o_orderpriority, '\n',"
    " 'prerequisites: [TASK-', o_orderkey + 1, ', TASK-', o_orderkey + 2, ']\n---\nbody: none\n')"
)


@query(
    "a6_scan_frontmatter",
    """select concat('tasks/open/task-', o_orderkey, '.md') as path, 'open' as folder,
    concat('TASK-', o_orderkey) as id, 'task' as kind, concat('Order of ', o_custkey) as title,
    lower(o_orderstatus) as status, cast(null as varchar) as epic, o_orderpriority as effort,
    concat('TASK-', o_orderkey + 1, ' TASK-', o_orderkey + 2) as prerequisites
    from orders where o_orderkey % 10 <> 0""",
)
def a6(spark, d):
    files = table(spark, d, "orders").selectExpr(
        "case when o_orderkey % 20 = 0 then concat('tasks/archive/v1.0.0/task-', o_orderkey, '.md')"
        " else concat('tasks/open/task-', o_orderkey, '.md') end as path",
        f"case when o_orderkey % 20 = 10 then 'no frontmatter' else {FRONT!r} end as text".replace(
            repr(FRONT), FRONT
        ),
    )
    return M.work_items(M.scan_frontmatter(files)).select(
        "path", "folder", "id", "kind", "title", "status", "epic", "effort",
        F.array_join("prerequisites", " ").alias("prerequisites"),
    )


@query(
    "a7_scan_closure_log",
    """select concat('log-', o_orderkey // 100) as log, concat('tasks/closed/',
    case when o_orderkey % 20 = 0 then 'epic-' else 'task-' end, o_orderkey, '.md') as path,
    concat(case when o_orderkey % 20 = 0 then 'epic-' else 'task-' end, o_orderkey, '.md') as basename,
    case when o_orderkey % 20 = 0 then 'epic' else 'task' end as kind,
    o_orderdate::date as closed_on from orders""",
)
def a7(spark, d):
    logs = (
        table(spark, d, "orders")
        .selectExpr(
            "cast(floor(o_orderkey / 100) as long) as no",
            "o_orderkey",
            "concat('COMMIT ', date_format(o_orderdate, 'yyyy-MM-dd'), '\n', 'tasks/closed/',"
            " if(o_orderkey % 20 = 0, 'epic-', 'task-'), o_orderkey, '.md\n') as entry",
        )
        # at most 100 orders per log, by the key
        .groupBy("no")
        .agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "entry"))).alias("entries"))
        .select(
            F.concat(F.lit("log-"), "no").alias("path"),
            F.concat(
                F.lit("stray/task-1.md\n"),
                F.array_join(F.transform("entries", lambda e: e["entry"]), "\n"),
            ).alias("text"),
        )
    )
    return M.scan_closure_log(logs).drop("pos")


DIFF = "concat('--- a/x\n+++ b/x\n@@\n+', replace(text, '\n', '\n+'), '\n-', replace(text, '\n', '\n-'))"


@query(
    "a8_diff_lines",
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as text,
      unnest(range(0, len(string_split(text, chr(10))))) as i from documents),
    s as (select doc_id, i, text, unnest(['+', '-']) as sign from l),
    k as (select * from s where not starts_with(sign || text, sign || sign || sign))
    select doc_id as change_id, concat('f', doc_id) as file, sign,
      (row_number() over (partition by doc_id, sign order by i) - 1)::int as pos, text from k""",
)
def a8(spark, d):
    diffs = spread_table(spark, d, "documents", "doc_id").selectExpr(
        "doc_id as change_id", "concat('f', doc_id) as file", f"{DIFF} as diff"
    )
    return M.diff_lines(diffs)


@query(
    "a9_read_split_bin",
    """select concat('src', p_partkey // 40) as bin, concat('part-', p_partkey % 40, '.md') as file, p_name as text
    from part where p_partkey % 40 <> 0""",
)
def a9(spark, d):
    files = table(spark, d, "part").selectExpr(
        "concat('src', cast(floor(p_partkey / 40) as long)) as bin",
        "concat('bins/', if(p_partkey % 40 = 0, 'INVENTORY', concat('part-', p_partkey % 40)), '.md') as path",
        "p_name as text",
    )
    return M.section_files(files).select("bin", T.basename(F.col("path")).alias("file"), "text")


@query(
    "a10_pin_tables",
    """select concat('parts/p', p_partkey // 8, '.md') as path, (6 + p_partkey % 8)::int as line_no,
    (p_partkey % 8 + 1)::varchar as pin, p_name as name, p_type as use from part""",
)
def a10(spark, d):
    pages = (
        table(spark, d, "part")
        .selectExpr(
            "cast(floor(p_partkey / 8) as long) as no",
            "p_partkey",
            "concat('| ', p_partkey % 8 + 1, ' | ', p_name, ' | ', p_type, ' |') as line",
        )
        # eight pins per page, by the key
        .groupBy("no")
        .agg(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))).alias("ls"))
        .select(
            F.lit("parts").alias("bin"),
            F.concat(F.lit("parts/p"), "no", F.lit(".md")).alias("path"),
            F.concat(
                F.lit("# Page\n## Pinout (DIP-8)\n\n| Pin | Name | Use |\n| --- | --- | --- |\n"),
                F.array_join(F.transform("ls", lambda x: x["line"]), "\n"),
                F.lit("\n\n## Pinout (TO-92)\n\n| Pin | Name | Use |\n| --- | --- | --- |\n| 1 | E | emitter |\n"),
            ).alias("text"),
        )
    )
    return M.pin_tables(pages)


@query(
    "a11_write_stock",
    "select 'main' as bin, concat('P', p_partkey) as part, p_size + 1 as qty from part",
)
def a11(spark, d):
    root = scratch(spark, "stock")
    stock = table(spark, d, "part").selectExpr(
        "'main' as bin", "concat('P', p_partkey) as part", "p_size as qty"
    )
    S.write_stock(stock, root, 1)
    S.write_stock(S.read_stock(spark, root).withColumn("qty", F.col("qty") + 1), root, 2)
    return S.read_stock(spark, root)


@query(
    "a12_append_log",
    "select ts::date as day, event_type as kind, count(*) as n from events group by all",
)
def a12(spark, d):
    path = scratch(spark, "log")
    events = table(spark, d, "events")
    for half in (0, 1):
        S.append_log(
            events.filter(F.col("event_id") % 2 == half).select(
                F.to_date("ts").alias("day"), "ts", F.col("event_type").alias("kind")
            ),
            path,
        )
    return spark.read.parquet(path).groupBy("day", "kind").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- rules over rows

SHAPE_SQL = r"""select bin, path, line_no::int as line, 'source-shape' as rule,
    case when source = '' then 'Source cell is empty'
    else concat('Source must be a lowercase token (got ''', source, ''')') end as message
    from inv where not regexp_matches(source, '^[a-z][a-z0-9_-]*$')"""
ALPHA_SQL = """select bin, path, line_no::int as line, 'alphabetical-order' as rule,
    concat('Part ''', part_cell, ''' should sort before the previous row at line ', prev_line) as message
    from (select *, lag(lower(part)) over w as prev_key, lag(line_no) over w as prev_line from inv
      window w as (partition by path, section order by line_no)) where lower(part) < prev_key"""
HEDGES = " or ".join(f"contains(lower(notes), '{p}')" for p in R.HEDGE_PHRASES)
HEDGE_SQL = f"""select bin, path, line_no::int as line, 'hedge-language' as rule,
    'camera-sourced row has a Notes cell with no hedge phrase' as message
    from inv where source = 'camera' and notes <> '' and not ({HEDGES})"""
PAGES_SQL = "pg as (select distinct concat('bin', p_partkey // 50) as bin, concat(replace(p_name, ' ', '-'), '.md') as page from part where p_partkey % 8 = 0)"
LINK_SQL = """select bin, path, line_no::int as line, 'parts-link' as rule,
    concat('link target does not exist: parts/', target) as message from inv
    where target is not null and not exists (select 1 from pg where pg.bin = inv.bin and pg.page = inv.target)"""


def page_list(spark, d):
    return (
        table(spark, d, "part")
        .filter(F.col("p_partkey") % 8 == 0)
        .selectExpr(
            "concat('bin', cast(floor(p_partkey / 50) as long)) as bin",
            "concat(replace(p_name, ' ', '-'), '.md') as page",
        )
    )


@query("c1_lint_source_shape", f"with {INDEX} {SHAPE_SQL}")
def c1(spark, d):
    return Q.lint_source_shape(M.inventory_rows(index_docs(spark, d)))


@query("c2_lint_alphabetical", f"with {INDEX} {ALPHA_SQL}")
def c2(spark, d):
    return Q.lint_alphabetical(M.inventory_rows(index_docs(spark, d)))


@query(
    "c2_lint_alphabetical_rows",
    """select bin, path, line::int as line, 'alphabetical-order' as rule,
    concat('Part ''', p_name, ''' should sort before the previous row at line ', prev_line) as message from
    (select p_brand as bin, p_brand as path, p_partkey as line, p_name, lag(p_partkey) over w as prev_line,
      lag(lower(p_name)) over w as prev_key from part window w as (partition by p_brand, p_type order by p_partkey))
    where lower(p_name) < prev_key""",
)
def c2_rows(spark, d):
    rows = table(spark, d, "part").select(
        F.col("p_brand").alias("bin"),
        F.col("p_brand").alias("path"),
        F.col("p_type").alias("table_id"),
        F.col("p_partkey").cast("int").alias("line_no"),
        F.col("p_name").alias("part_cell"),
        F.col("p_name").alias("part"),
        F.lit(False).alias("is_empty"),
    )
    return Q.lint_alphabetical(rows)


@query("c3_lint_row_hedge", f"with {INDEX} {HEDGE_SQL}")
def c3(spark, d):
    return Q.lint_row_hedge(M.inventory_rows(index_docs(spark, d)))


@query("c4_lint_parts_link", f"with {INDEX}, {PAGES_SQL} {LINK_SQL}")
def c4(spark, d):
    return Q.lint_parts_link(M.inventory_rows(index_docs(spark, d)), page_list(spark, d))


@query(
    "c5_lint_inventory",
    f"with {INDEX}, {PAGES_SQL} {SHAPE_SQL} union all {ALPHA_SQL} union all {HEDGE_SQL} union all {LINK_SQL}",
)
def c5(spark, d):
    return Q.lint_inventory(index_docs(spark, d), page_list(spark, d))


CLAIMS = (
    "concat(text, '\n```\nit must never\n```\n  > always so\nthis IS  the end <!-- must -->\n"
    "always <!-- lint: ok -->\nNever mind the mustard <!-- always --> must\n```\nis the open fence\n')"
)
CLAIM_SQL = CLAIMS.replace("\n", "' || chr(10) || '")


@query(
    "c6_lint_page_hedge",
    rf"""with {DOCS}, t as (select bin, path, {CLAIM_SQL} as text from docs),
    s as (select bin, path, string_split(regexp_replace(text, '\n$', ''), chr(10)) as ls from t),
    l as (select bin, path, unnest(range(1, len(ls) + 1))::int as line, unnest(ls) as text from s),
    f as (select *, regexp_matches(text, '^\s*```') as fence, sum(case when regexp_matches(text, '^\s*```') then 1 else 0 end)
      over (partition by path order by line) as n from l),
    o as (select bin, path, line, regexp_replace(text, '<!--.*?-->', '', 'g') as text from f where not fence and n % 2 = 0
      and not regexp_matches(text, '^\s*>') and not contains(text, '{R.SUPPRESS_MARKER}')),
    h as (select *, unnest([case when regexp_matches(text, '(?i)\bis\s+the\b') then 'is-the' end,
      case when regexp_matches(text, '(?i)\bmust\b') then 'must' end,
      case when regexp_matches(text, '(?i)\balways\b') then 'always' end,
      case when regexp_matches(text, '(?i)\bnever\b') then 'never' end]) as rule from o)
    select bin, path, line, rule, concat('absolute-claim phrasing ''', rule, '''') as message from h where rule is not null""",
)
def c6(spark, d):
    pages = docs(spark, d).select("bin", "path", F.expr(CLAIMS).alias("text"))
    return Q.lint_page_hedge(pages)


FILE_PATH = (
    "concat(case when doc_id % 3 = 0 then 'docs/' else 'src/' end, source, '/', case when doc_id % 7 = 0 then '.' else '' end,"
    " 'f', doc_id, case when doc_id % 5 = 0 then '.bin' when doc_id % 5 = 1 then '.PY' else '.md' end)"
)
FILE_TEXT = (
    "concat(text, case when doc_id % 2 = 0 then '\n  from scripts.x import y\nsee /home/user or (inventory/INVENTORY)'"
    " else '\nxdocs/guide and docs/guide\nCircuitSmith .parent.parent.parent' end)"
)
FILE_SQL = FILE_TEXT.replace("\n", "' || chr(10) || '")


def _re2(pattern: str) -> str:
    """The pattern for RE2: no class flag, and no look-behind."""
    return (
        pattern.replace("(?iU)", "(?i)")
        .replace("(?U)", "")
        .replace("(?<![a-zA-Z0-9_/-])", "(?:^|[^a-zA-Z0-9_/-])")
        .replace("'", "''")
    )


FORBIDDEN_SQL = f"""
files as (select {FILE_PATH} as path, {FILE_SQL} as text from documents),
opened as (select * from files where not regexp_matches(path, '/\\.[^/]*$')
  and lower(regexp_extract(path, '(\\.[^./]+)$', 1)) in ({', '.join(repr(e) for e in R.TEXT_EXTENSIONS)})),
ls as (select path, unnest(range(1, len(string_split(text, chr(10))) + 1))::int as line,
  unnest(string_split(text, chr(10))) as text from opened),
found as ({' union all '.join(
    f"select path, line, '{r.name}' as rule, concat(path, ':', line, ': ', '{r.message}') as finding from ls"
    f" where regexp_matches(text, '{_re2(r.pattern)}')"
    + (" and not starts_with(path, 'docs/')" if r.skip_docs else "") for r in R.FORBIDDEN)})
"""


def forbidden(spark, d):
    files = spread_table(spark, d, "documents", "doc_id").select(
        F.expr(FILE_PATH).alias("path"), F.expr(FILE_TEXT).alias("text")
    )
    return Q.scan_forbidden(files)


@query("c7_scan_forbidden", f"with {FORBIDDEN_SQL} select * from found")
def c7(spark, d):
    return forbidden(spark, d)


@query(
    "c8_apply_allowlist",
    f"""with {FORBIDDEN_SQL} select * from found where not exists (select 1 from documents
    where doc_id % 4 < 2 and {FILE_PATH} = path and contains(finding, case when doc_id % 4 = 0 then 'home' else 'repo path' end))""",
)
def c8(spark, d):
    lines = spread_table(spark, d, "documents", "doc_id").selectExpr(
        f"case doc_id % 4 when 0 then concat({FILE_PATH}, ' : home') when 1 then concat({FILE_PATH}, ':repo path: why')"
        f" when 2 then concat('# ', {FILE_PATH}, ':home') else {FILE_PATH} end as text"
    )
    return Q.apply_allowlist(forbidden(spark, d), Q.parse_allowlist(lines))


@query(
    "c9_lint_split",
    """with f as (select p_partkey // 60 as b, p_partkey % 3 as f, p_partkey, concat('P', p_partkey // 2) as part from part),
    n as (select *, row_number() over (partition by b, f order by p_partkey) as rn from f),
    g as (select b, part, count(distinct f) as files, min(f) as f0, min(rn) as rn from n group by b, part)
    select concat('bin', b) as bin, concat('bins/bin', b, '/s', f0, '.md') as path, 'split-duplicate' as rule,
      concat('part in several files: ', part) as message from g where files > 1
    union all select distinct concat('bin', b), concat('bins/bin', b, '/s', f, '.md'), 'split-unlisted',
      'file is not in the master index' from f where f = 2
    union all select distinct concat('bin', b), concat('bins/bin', b, '/s', f, '.md'), 'split-shape',
      'row shape differs from the bin''s first file' from f where f = 1 and b % 2 = 0
      and exists (select 1 from f g where g.b = f.b and g.f = 0)""",
)
def c9(spark, d):
    parts = table(spark, d, "part").selectExpr(
        "cast(floor(p_partkey / 60) as long) as b", "p_partkey % 3 as f", "p_partkey"
    )
    files = (
        # twenty rows per file, by the key
        parts.groupBy("b", "f")
        .agg(F.array_sort(F.collect_list("p_partkey")).alias("ks"))
        .select(
            F.concat(F.lit("bin"), "b").alias("bin"),
            F.expr("concat('bins/bin', b, '/s', f, '.md')").alias("path"),
            F.concat(
                F.expr(
                    "if(f = 1 and b % 2 = 0, '## S\n| Part | Source | Qty |\n| --- | --- | --- |\n',"
                    " '## S\n| Part | Qty | Source |\n| --- | --- | --- |\n')"
                ),
                F.array_join(
                    F.transform(
                        "ks",
                        lambda k: F.concat(
                            F.lit("| P"), F.floor(k / 2).cast("string"), F.lit(" | 1 | manual |")
                        ),
                    ),
                    "\n",
                ),
            ).alias("text"),
        )
    )
    masters = parts.select("b").distinct().select(
        F.concat(F.lit("bin"), "b").alias("bin"),
        F.lit("# Master\n- [one](s0.md)\n- [two](s1.md)\n").alias("text"),
    )
    return Q.lint_split(files, masters).drop("line")


@query(
    "c10_suggest_split",
    f"""with {INDEX}, n as (select bin, count(*) as rows from inv group by bin),
    z as (select bin, sum(strlen(text))::bigint as bytes from idx group by bin)
    select bin, rows, bytes from n join z using (bin) where rows >= 50 or bytes >= 2900""",
)
def c10(spark, d):
    return Q.suggest_split(index_docs(spark, d), max_rows=50, max_bytes=2900)


ANSWER = (
    "case when turn % 3 = 0 then concat('Likely ', text) when turn % 3 = 1 then text"
    " else concat('appears to be a must: ', text) end"
)


@query(
    "c11_check_verdicts",
    rf"""with v as (select conv_id as capture_id, turn as seq, {ANSWER} as text from conversations),
    k as (select *, regexp_matches(text, '(?i)^\s*(?:likely|probably|appears to be)\b')
      and not regexp_matches(text, '(?i)\b(?:must|always|never)\b') as ok from v),
    n as (select *, sum(case when ok then 0 else 1 end) over (partition by capture_id order by seq)::bigint as failures from k)
    select capture_id, seq, failures, case when ok then 'accepted' when failures > 2 then 'no_idea' else 'retry' end as outcome from n""",
)
def c11(spark, d):
    verdicts = table(spark, d, "conversations").selectExpr(
        "conv_id as capture_id", "turn as seq", f"{ANSWER} as text"
    )
    return Q.check_verdicts(verdicts).select("capture_id", "seq", "failures", "outcome")


HINT = (
    "concat(case doc_id % 9 when 0 then 'rotate 90 ' when 1 then 'too dark ' when 2 then 'image too blurry '"
    " when 3 then 'part is cut off ' when 4 then 'reflective surface ' when 5 then 'too far away '"
    " when 6 then 'marking worn, too dark ' when 7 then 'Out of focus ' else '' end, text)"
)


@query(
    "c12_hint_family",
    f"""with v as (select doc_id, {HINT} as hint from documents),
    f as (select *, case {' '.join(f"when regexp_matches(hint, '{_re2(r.pattern)}') then '{r.name}'" for r in R.HINT_FAMILIES)} end as family from v)
    select doc_id, family, case when family is null then '{R.GENERIC_HINT}' else hint end as shown from f""",
)
def c12(spark, d):
    verdicts = spread_table(spark, d, "documents", "doc_id").selectExpr("doc_id", f"{HINT} as hint")
    return Q.hint_family(verdicts).select("doc_id", "family", "shown")
