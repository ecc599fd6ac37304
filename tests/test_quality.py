from pyspark.sql import functions as F

from partslake.functions import rules as R
from partslake.operators import quality as Q
from tests.conftest import tuples

HEAD = "## S\n| Part | Qty | Source | Notes |\n| --- | --- | --- | --- |\n"


def lint(rows, *lines, pages=None):
    docs = rows([("b", "p", HEAD + "\n".join(lines))], "bin string, path string, text string")
    listing = None if pages is None else rows([("b", p) for p in pages], "bin string, page string")
    return tuples(Q.lint_inventory(docs, listing), "line", "rule")


ROW_CASES = (
    [
        (["| LM358N | 1 | manual | |"], []),
        (["| LM358N | 1 |  | x |"], [(4, "source-shape")]),
        (["| LM358N | 1 | Manual | |"], [(4, "source-shape")]),
        (["| LM358N | 1 | imported | |"], []),
        (["| LM358N | 1 |"], [(4, "source-shape")]),
        (["| NE555N | 1 | manual | |", "| LM358N | 1 | manual | |"], [(5, "alphabetical-order")]),
        (["| lm358n | 1 | manual | |", "| KT 209 | 1 | manual | |", "| LM1 | 1 | manual | |"], [(5, "alphabetical-order")]),
        (["| B | 1 | manual | |", "| | | | |", "|  | 1 | manual | |", "| A | 1 | manual | |"], [(7, "alphabetical-order")]),
        (["| A | 1 | camera | likely LM358 family |"], []),
        (["| A | 1 | camera | LM358 family |"], [(4, "hedge-language")]),
        (["| A | 1 | camera | about ~5 |"], []),
        (["| A | 1 | manual | LM358 family |"], []),
        (["| A | 1 | camera |  |"], []),
        (["| | | | |"], []),
    ]
)


def test_row_rules(rows):
    """One document per case, all in one job."""
    docs = rows(
        [(f"b{i}", "p", HEAD + "\n".join(lines)) for i, (lines, _) in enumerate(ROW_CASES)],
        "bin string, path string, text string",
    )
    got = tuples(Q.lint_inventory(docs), "bin", "line", "rule")
    assert got == sorted(((f"b{i}", *f) for i, (_, fs) in enumerate(ROW_CASES) for f in fs), key=repr)


def test_link_rule_needs_the_page_list(rows):
    line = "| [A](parts/a.md) | 1 | manual | |", "| see [B](parts/b.md) | 1 | manual | |"
    assert lint(rows, *line) == []
    assert lint(rows, *line, pages=["a.md"]) == [(5, "parts-link")]


CLAIM_CASES = (
    [
        ("this is the LM358 family chip", [(1, "is-the")]),
        ("All resistors must be 1%-tolerance", [(1, "must")]),
        ("Always. NEVER.", [(1, "always"), (1, "never")]),
        ("mustard isthe alwaysx", []),
        ("is\u00a0the", [(1, "is-the")]),
        ("```\nmust\n```\nmust", [(4, "must")]),
        ("a\n  ```py\nmust\n", []),
        ("```\nx\n```\nok\n```\nmust", []),
        ("> must\n  > never", []),
        ("must <!-- lint: ok -->", []),
        ("a <!-- must --> b", []),
        ("a <!-- x --> must", [(1, "must")]),
        ("", []),
    ]
)


def test_page_claims(rows):
    docs = rows([("b", f"p{i}", t) for i, (t, _) in enumerate(CLAIM_CASES)], "bin string, path string, text string")
    got = tuples(Q.lint_page_hedge(docs), "path", "line", "rule")
    assert got == sorted(((f"p{i}", *f) for i, (_, fs) in enumerate(CLAIM_CASES) for f in fs), key=repr)


def test_forbidden_text(rows):
    files = rows(
        [
            ("src/a.py", "x = '/home/me'\n  from scripts.x import y\nfrom scriptsx import z"),
            ("docs/a.md", "CircuitSmith\nsee docs/guide and adocs/guide"),
            ("src/b.bin", "/home/me"),
            ("src/.hidden.py", "/home/me"),
            ("src/c.PY", "C:\\\\Users a.parent.parent.parent CircuitSmith"),
            ("src/d.md", "line\x0b  from scripts.y"),
        ],
        "path string, text string",
    )
    found = Q.scan_forbidden(files)
    assert tuples(found, "path", "line", "rule") == [
        ("docs/a.md", 2, "docs-path"),
        ("src/a.py", 1, "linux-home"),
        ("src/a.py", 2, "from-scripts"),
        ("src/c.PY", 1, "parent-escape"),
        ("src/c.PY", 1, "sibling-circuitsmith"),
        ("src/c.PY", 1, "windows-path"),
        ("src/d.md", 2, "from-scripts"),
    ]
    allow = Q.parse_allowlist(
        rows([("src/a.py:home: old",), ("# src/a.py:import",), ("src/c.PY",), ("src/b.py:home",)], "text string")
    )
    assert tuples(allow) == [("src/a.py", "home"), ("src/b.py", "home")]
    assert ("src/a.py", 1) not in tuples(Q.apply_allowlist(found, allow), "path", "line")
    assert Q.apply_allowlist(found, allow).count() == found.count() - 1


def test_every_rule_pattern_compiles(rows):
    text = rows([("x",)], "t string")
    every = R.PAGE_CLAIMS + R.FORBIDDEN + R.CHANGE_RULES + R.SECRET_RULES + R.HINT_FAMILIES
    assert text.select(*[F.col("t").rlike(r.pattern) for r in every]).first()


def test_split_bins(rows):
    head = "## S\n| Part | Qty | Source |\n| --- | --- | --- |\n"
    files = rows(
        [
            ("b", "b/ics.md", head + "| A | 1 | manual |"),
            ("b", "b/misc.md", head + "| A | 1 | manual |\n| B | 1 | manual |"),
            ("b", "b/odd.md", head.replace("Qty", "Count") + "| C | 1 | manual |"),
        ],
        "bin string, path string, text string",
    )
    masters = rows([("b", "- [ics](ics.md)\n- [odd](./odd.md)")], "bin string, text string")
    assert tuples(Q.lint_split(files, masters), "path", "rule") == [
        ("b/ics.md", "split-duplicate"), ("b/misc.md", "split-unlisted"), ("b/odd.md", "split-shape"),
    ]


def test_suggest_split(rows):
    head = "## S\n| Part | Qty | Source |\n| --- | --- | --- |\n"
    line = "| A | 1 | manual |\n"
    docs = rows(
        [
            ("rows", "r", head + line * 200), ("few", "f", head + line * 199), ("bytes", "b", "x" * 30 * 1024),
            ("declined", "d", R.SPLIT_DECLINED + "\n" + head + line * 300),
        ],
        "bin string, path string, text string",
    )
    assert tuples(Q.suggest_split(docs), "bin") == [("bytes",), ("rows",)]


def test_verdicts(rows):
    answers = [
        (1, 1, "LM358"), (1, 2, "must be"), (1, 3, "It is"), (2, 1, "Likely LM358"), (2, 2, "probably, but must"),
        (3, 1, "appears to be an LM358"), (3, 2, "likelyish"),
    ]
    got = Q.check_verdicts(rows(answers, "capture_id int, seq long, text string"), width=2)
    assert tuples(got, "capture_id", "seq", "outcome") == [
        (1, 1, "retry"), (1, 2, "retry"), (1, 3, "no_idea"), (2, 1, "accepted"), (2, 2, "retry"),
        (3, 1, "accepted"), (3, 2, "retry"),
    ]


HINTS = (
    [
        ("rotate 90°", "angle"), ("show more from the left", "angle"), ("tilt up so the marking is visible", "angle"),
        ("too dark", "lighting"), ("too bright", "lighting"), ("glare on the marking", "lighting"), ("shadow on the body", "lighting"),
        ("image too blurry", "sharpness"), ("out of focus", "sharpness"), ("part is off-centre", "framing"),
        ("part is cut off", "framing"), ("two parts in shot — show one", "framing"),
        ("reflective surface — try a matte mat", "surface"), ("too close", "distance"), ("too far away", "distance"),
        ("marking worn — try a different side", "marking"), ("marking unreadable from this angle", "marking"), ("hm", None),
    ]
)


def test_hints(rows):
    got = Q.hint_family(rows([(h,) for h, _ in HINTS], "hint string")).collect()
    assert [(r["hint"], r["family"]) for r in got] == HINTS
    assert {r["shown"] for r in got if not r["family"]} == {R.GENERIC_HINT}
