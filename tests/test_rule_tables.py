"""Rules as tables give what rules as literals give."""

import pytest
from pyspark.sql import functions as F

from partslake.functions import rules as R
from partslake.operators import changes as C
from partslake.operators import enrich as H
from partslake.operators import family as D
from partslake.operators import rule_tables as P
from tests.conftest import tuples

PATHS = ["src/a/b.py", "src/a.py", "a.md", "ab.md", "a/.md", "aXmd", "p/x+(1)", "docs/[x].md", "", None, "src/a.py", "x\\y", "é/ü.py", "a\nb", "a/b/c/d.md"]
GLOBS = ["src/**", "src/*.py", "a?.md", "a.md", "**/x+(1)", "*", "**", "docs/[x].md", "*.md", "**/*.py", "*/b/*", "???", "", "x\\y", "é/*", "**d.md", "*a*", "src/*.py"]


def test_owners(rows):
    paths = rows([(p, 1) for p in PATHS], "path string, owner int")
    entries = [(g, f"o{i}") for i, g in enumerate(GLOBS)]
    table = rows([*entries, (None, "x")], "pattern string, owner string")
    got = tuples(P.owners_of(paths, table), "path", "pattern", "owner")
    assert got == tuples(D.owners(paths.filter("path is not null"), entries), "path", "pattern", "owner")
    assert len(got) > 25


def test_owners_with_single_wildcards(rows):
    words = ["a", "b/c", "é", "\U0001f600", "?", "/", "", "long-name", "x"]
    globs = [f"{h}{x}?{y}" for h in ("", "*", "**/") for x in words for y in words] + [f"{x}?{y}*" for x in words for y in words] + ["??", "?a?", "*?a?b", "a??*", "a*a?", "a?*?a"]
    names = [f"{x}{m}{y}" for x in words for m in ("?", "m", "/", "é", "\U0001f600", "") for y in words] + ["d/a?x", "d/d/b/c?é", "a\nb", None]
    paths, entries = rows([(p,) for p in names], "path string"), [(g, f"o{i}") for i, g in enumerate(globs)]
    got = tuples(P.owners_of(paths, rows(entries, "pattern string, owner string")), "path", "pattern", "owner")
    assert got == tuples(D.owners(paths.filter("path is not null"), entries), "path", "pattern", "owner")
    assert len(got) > 1000


@pytest.mark.parametrize("glob, path", [("'**/', id, '?page=2&ref=x'", "'host/en/', id, '?page=2&ref=x'"), ("'page', '?', id, '?/*'", "'page-', id, '-/x'")])
def test_rules_that_share_a_literal_meet_few_paths(spark, glob, path):
    n = 3_000
    entries, paths = spark.range(n).selectExpr(f"concat({glob}) as pattern", "'o' as owner"), spark.range(n).selectExpr(f"concat({path}) as path")
    assert P.owners_of(paths, entries).count() == n
    assert P.candidates_of(paths, entries).count() <= 3 * n


def test_datasheets(rows):
    names = ["LM358N", "lm358", "TL082CP", "TL08xx", "tl08", "NE555P", "İLM358", "L7805", None, "", "PIC16F84", "xLM358"]
    parts = rows([(i, p) for i, p in enumerate(names * 2)], "id int, part string")
    prefixes = rows(list(R.DATASHEET_PREFIXES), "prefix string, url string")
    assert tuples(P.datasheets_of(parts, prefixes)) == tuples(parts.select("id", "part", H.family_datasheet(F.col("part")).alias("url")))
    ties = rows([("A.x", "u3"), ("a.x", "u1"), ("a.", "u0"), ("A.x", "u2"), (None, "u"), ("", "all")], "prefix string, url string")
    assert tuples(P.datasheets_of(rows([("a.7",), ("a.z",), ("ab7",), ("q",), (None,)], "part string"), ties)) == [
        ("a.7", "u2"), ("a.z", "u0"), ("ab7", "all"), ("q", "all"), (None, None)]


def test_interest(rows):
    names = [".envrc", "Makefile", "a/Makefile", "a.py", ".py", "x/y.sh", ".claude/hooks/x", "scripts/git-hooks/pre", "scripts/x", "", None, "a.tar.js"]
    files = rows([(i, f) for i, f in enumerate(names * 2)], "change_id int, file string")
    rules = [("path", v) for v in R.INTERESTING_PATHS] + [("suffix", v) for v in R.INTERESTING_SUFFIXES] + [("prefix", v) for v in R.INTERESTING_PREFIXES]
    table = rows([*rules, *rules, ("prefix", None), ("other", "scripts/x")], "kind string, value string")
    assert tuples(P.interest_of(files, table)) == tuples(files.filter(C.is_interesting(F.col("file"))))


def test_empty_tables(rows):
    paths, none = rows([("a",)], "path string"), rows([], "path string")
    entries, no_entries = rows([("*", "o")], "pattern string, owner string"), rows([], "pattern string, owner string")
    assert P.owners_of(none, entries).count() == P.owners_of(paths, no_entries).count() == 0
    assert tuples(P.datasheets_of(rows([("a",)], "part string"), rows([], "prefix string, url string"))) == [("a", None)]
    assert P.interest_of(rows([("a",)], "file string"), rows([], "kind string, value string")).count() == 0


@pytest.mark.parametrize("n", [50, 50_000])
def test_plan_does_not_grow_and_nothing_is_looped(spark, n):
    ids = spark.range(n)
    entries = ids.selectExpr("concat('team', id % 997, '/dir', id, '/**/*.c') as pattern", "concat('o', id) as owner")
    paths = ids.selectExpr("concat('team', id % 997, '/dir', id, '/x/y', id % 3, if(id % 2 = 0, '.c', '.h')) as path")
    df = P.owners_of(paths, entries)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 8_000
    hit = df.groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum((F.expr("split(path, '/')[1]") == F.expr("split(pattern, '/')[1]")).cast("int")).alias("own")).first()
    assert (hit["n"], hit["own"]) == (n // 2, n // 2)
