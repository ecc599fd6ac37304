import pytest
from pyspark.sql import functions as F

from partslake.functions import text as T
from partslake.operators import workitems as W
from partslake.sources import markdown as M
from partslake.sources import stock_store as S
from tests.conftest import tuples

INDEX = """# Inventory

intro | not a table

## ICs

| stray |
| Part | Qty | Source | Notes |
| ---- | :---: | ------ | ----- |
| [7660S](parts/7660s.md) | 2 | manual |  |
| LM358N | x | manual | a \\| b |
| --- | --- | --- | --- |
| short |
|  |  |  |  |

| Key | Value |
| --- | --- |
| a | b |

| Part | Source |
| --- | --- |
| second | manual |

## Sensors

| Part | Qty | Source | Notes |
| --- | --- | --- | --- |
"""


@pytest.fixture
def docs(rows):
    return rows([("b1", "b1/INVENTORY.md", INDEX)], "bin string, path string, text string")


TEXTS = ["", "\n", "a", "a\n", "a\n\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x85e\u2028f\u2029"]
CELLS = [("| a | b |", ["a", "b"]), ("| a ||", ["a"]), ("||x|", ["x"]), ("|a\\|b|", ["a\\", "b"])]
SEPARATORS = [
    ("| --- | :-: |", False), ("| --- | :---: |", True), ("| --- |  |", True), ("|  |  |", False), ("| -- |", False), ("---", False),
]


def test_split_lines_is_splitlines(rows):
    got = rows([(t,) for t in TEXTS], "t string").select(T.split_lines(F.col("t")).alias("l")).collect()
    assert [r["l"] for r in got] == [t.splitlines() for t in TEXTS]


def test_cells_and_separators(rows):
    got = rows([(t,) for t, _ in CELLS], "t string").select(T.split_cells(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in got] == [c for _, c in CELLS]
    got = rows([(t,) for t, _ in SEPARATORS], "t string").select(T.is_separator_line(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in got] == [s for _, s in SEPARATORS]


def test_sections(docs):
    got = {r["line_no"]: r["section"] for r in M.with_sections(docs).collect()}
    assert got[1] is None and got[5] == "ICs" and got[22] == "ICs" and got[24] == "Sensors"
    assert len(got) == len(INDEX.splitlines())


def test_tables_one_per_run(docs):
    got = [
        (r["section"], r["header_line"], r["header"], len(r["rows"]))
        for r in M.table_blocks(docs).orderBy("header_line").collect()
    ]
    assert got == [
        ("ICs", 8, ["Part", "Qty", "Source", "Notes"], 5),
        ("ICs", 16, ["Key", "Value"], 1),
        ("ICs", 20, ["Part", "Source"], 1),
        ("Sensors", 26, ["Part", "Qty", "Source", "Notes"], 0),
    ]


def test_inventory_rows(docs):
    got = M.inventory_rows(docs).orderBy("line_no").collect()
    assert [(r["part"], r["page"], r["qty"], r["n_cells"], r["is_empty"], r["first_table"]) for r in got] == [
        ("7660S", "7660s.md", 2, 4, False, True),
        ("LM358N", None, 0, 5, False, True),
        ("---", None, 0, 4, False, True),
        ("short", None, 0, 1, False, True),
        ("", None, 0, 4, True, True),
        ("second", None, 0, 2, False, False),
    ]
    assert got[0]["cells"]["Notes"] == "" and got[1]["prev_key"] == "7660s" and got[1]["prev_line"] == 10


def test_reading_needs_no_shuffle(docs):
    for df in (M.inventory_rows(docs), M.with_sections(docs), M.table_blocks(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


def test_part_link_anchored_and_anywhere(rows):
    df = rows([("see [X](parts/x.md)",), (" [Y](parts/y.md) note",)], "c string")
    got = [tuple(r[0]) for r in df.select(T.part_link(F.col("c"))).collect()]
    assert got == [("see [X](parts/x.md)", None, "x.md"), ("Y", "y.md", "y.md")]


FRONT = """---
id: TASK-016
title: Writer: module
status: open
epic:
order: 4
status: closed
prerequisites: [TASK-001, TASK-002]
human-in-loop: No
---
body: no
"""


def test_frontmatter(rows):
    files = rows(
        [
            ("t/closed/task-016.md", FRONT),
            ("t/archive/v1.0.0/task-1.md", FRONT),
            ("t/open/none.md", "# no frontmatter"),
        ],
        "path string, text string",
    )
    fronts = M.scan_frontmatter(files)
    row = fronts.collect()
    assert len(row) == 1 and row[0]["folder"] == "closed"
    item = M.work_items(fronts).first()
    # an empty value is null and does not swallow the next line; the last key wins
    assert (item["epic"], item["ord_raw"], item["status"], item["title"]) == (None, "4", "closed", "Writer: module")
    assert item["prerequisites"] == ["TASK-001", "TASK-002"] and item["kind"] == "task"


def test_closure_log(rows):
    text = "stray/task-9.md\nCOMMIT 2026-04-26\n\nclosed/task-001.md  \nclosed/epic-002.md\nCOMMIT 2026-04-25\nclosed/task-003.md\n"
    got = M.scan_closure_log(rows([("log", text)], "path string, text string")).orderBy("pos").collect()
    assert [(r["path"], str(r["closed_on"]), r["kind"]) for r in got] == [
        ("closed/task-001.md", "2026-04-26", "task"),
        ("closed/epic-002.md", "2026-04-26", "epic"),
        ("closed/task-003.md", "2026-04-25", "task"),
    ]


def test_diff_lines(rows):
    diff = "--- a\n+++ b\n@@\n+new\n++ plus\n+++ lost\n-old\n context\n--- lost too"
    got = M.diff_lines(rows([(1, "f", diff)], "change_id int, file string, diff string"))
    assert tuples(got, "sign", "pos", "text") == [("+", 0, "new"), ("+", 1, "+ plus"), ("-", 0, "old")]


def test_pin_tables_skip_other_shapes(rows):
    page = "## Pinout (DIP-8)\n| Pin | Name | Use |\n| --- | --- | --- |\n| 1 | OUT | out |\n## Pinout (TO-92)\n| Pin | Name |\n| --- | --- |\n| 1 | E |\n"
    got = M.pin_tables(rows([("b", "p", page)], "bin string, path string, text string"))
    assert tuples(got, "pin", "name", "use") == [("1", "OUT", "out")]


def test_read_files(spark, tmp_path):
    bin_dir = tmp_path / "bench"
    bin_dir.mkdir()
    (bin_dir / "INVENTORY.md").write_text("# Master\n")
    (bin_dir / "ics.md").write_text(INDEX)
    (bin_dir / "notes.txt").write_text("no")
    assert M.scan_docs(spark, str(tmp_path)).count() == 2
    section = M.read_split_bin(spark, str(tmp_path)).collect()
    assert [(r["bin"], r["text"]) for r in section] == [("bench", INDEX)]
    assert M.scan_lines(M.read_split_bin(spark, str(tmp_path))).count() == len(INDEX.splitlines())


def test_write_stock_switches_versions(spark, rows, tmp_path):
    root = str(tmp_path / "stock")
    S.write_stock(rows([("a", 1)], "part string, qty int"), root, 1)
    S.write_stock(S.read_stock(spark, root).withColumn("qty", F.col("qty") + 1), root, 2)
    assert tuples(S.read_stock(spark, root)) == [("a", 2)]
    # data without a pointer is not seen
    rows([("a", 9)], "part string, qty int").write.parquet(f"{root}/data/v3")
    assert tuples(S.read_stock(spark, root)) == [("a", 2)]


def test_write_stock_after_a_failed_attempt(spark, rows, tmp_path):
    root = str(tmp_path / "stock")
    S.write_stock(rows([("a", 1)], "part string, qty int"), root, 1)
    broken = rows([("a", 2)], "part string, qty int").withColumn("qty", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        S.write_stock(broken, root, 2)
    assert tuples(S.read_stock(spark, root)) == [("a", 1)]
    S.write_stock(rows([("a", 2)], "part string, qty int"), root, 2)
    assert tuples(S.read_stock(spark, root)) == [("a", 2)]


def test_changes_read_latest(spark, rows, tmp_path):
    root = str(tmp_path / "c")
    S.put_changes(rows([("a", 1), ("b", 1)], "part string, qty int"), root, 0)
    S.put_changes(rows([("a", 2)], "part string, qty int"), root, 1)
    S.put_changes(rows([("a", 3)], "part string, qty int"), root, 1)
    assert tuples(S.latest(spark, root, ["part"])) == [("a", 3), ("b", 1)]
    assert tuples(S.latest(spark, root, ["part"], below=1)) == [("a", 1), ("b", 1)]


def test_append_log(spark, rows, tmp_path):
    path = str(tmp_path / "log")
    log = rows([("2026-01-01", "ok")], "day string, kind string")
    S.append_log(log, path)
    S.append_log(log, path)
    assert spark.read.parquet(path).count() == 2


def test_append_log_bounds_files_per_day(spark, rows, tmp_path):
    path = tmp_path / "log"
    log = rows([(f"2026-01-0{1 + i % 2}", str(i)) for i in range(400)], "day string, kind string").repartition(16)
    S.append_log(log, str(path), files_per_day=3)
    assert all(len(list(day.glob("*.parquet"))) <= 3 for day in path.glob("day=*"))
    assert spark.read.parquet(str(path)).count() == 400


def test_release_and_ideas(rows):
    front = "---\nid: {}\ncategory: {}\ntitle: T\n---\n"
    files = rows(
        [
            ("x/archive/v0.1.0/task-2.md", front.format("TASK-2", "")),
            ("x/archive/v0.1.0/epic-1.md", front.format("EPIC-1", "")),
            ("x/archive/v0.1/task-3.md", front.format("TASK-3", "")),
            ("i/open/idea-001-a.md", front.format("IDEA-1", "docs")),
            ("i/open/idea-001.note.md", front.format("IDEA-1", "docs")),
            ("i/archived/idea-002-b.md", front.format("IDEA-2", "new")),
        ],
        "path string, text string",
    )
    assert tuples(W.release_index(M.with_fields(files)), "version", "id") == [("v0.1.0", "TASK-2")]
    ideas = W.idea_index(M.scan_frontmatter(files))
    assert tuples(ideas, "folder", "id", "category") == [
        ("archived", "IDEA-2", "new"), ("open", "IDEA-1", "\U0001f4d6 docs"),
    ]
    assert tuples(W.idea_counts(ideas)) == [("archived", 1), ("open", 1)]


def test_fold_is_case_folding_of_every_letter(spark, rows):
    letters = [(chr(c),) for c in (*range(0xD800), *range(0xE000, 0x110000)) if chr(c).isalpha() or chr(c).casefold() != chr(c)]
    words = [("ΑΣ ΣΑΣ",), ("Straße",), ("ﬁn İı",), ("plain ABC",), ("",), (None,)]
    df = rows(letters + words, "c string").repartition(8)
    wrong = [(r.c, r.f) for r in df.select("c", T.fold(F.col("c")).alias("f")).collect() if r.f != (r.c and r.c.casefold())]
    assert not wrong


def test_strip_is_that_of_plain_text_also_on_long_runs(rows):
    texts = ["", " ", " a ", " a b ", "a\n", "\x1c\x1d x \x1f", "a" + " " * 200_000 + "b", " " * 100_000, "x　 \t", None]
    got = [r[0] for r in rows([(t,) for t in texts], "t string").select(T.strip(F.col("t"))).collect()]
    assert got == [t and t.strip() for t in texts]
