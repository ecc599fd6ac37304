import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from partslake.operators import changes as C
from partslake.operators import family as D
from tests.conftest import tuples

PAIRS = [
    ("LM358P", "LM358N", True), ("LM358", "LM358N", True), ("lm358n", "LM358P", True),
    ("PIC16F628AP", "PIC16F628AT", True), ("LM358N", "LM386N", False), ("LM358", "LM2904", False),
    ("LM358", "LM3580", False), ("LM358N", "LM358N", False), ("PIC16F628", "PIC16F876A", False),
    ("", "LM358N", False), ("PIC16F628-20I/P", "PIC16F628A", False), ("LM358A2B", "LM358N", True),
    ("lm358n", "LM358N", False),
]


def sibling(a, b):
    """The definition, for brute force."""
    a, b = a.upper(), b.upper()
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n] and a[n].isalnum():
        n += 1
    fits = lambda s: not s or re.fullmatch(r"[A-Z]\d?[A-Z]?", s)
    return bool(a and b and a != b and n >= 4 and fits(a[n:]) and fits(b[n:]))


@pytest.mark.parametrize("a, b, yes", PAIRS)
def test_definition(a, b, yes):
    assert sibling(a, b) is yes and sibling(b, a) is yes


def test_worked_pairs(rows):
    ids = rows([(i, x) for i, (x, _, _) in enumerate(PAIRS)], "probe_id int, part string")
    parts = rows([(i, x) for i, (_, x, _) in enumerate(PAIRS)], "pos int, part string")
    got = set(tuples(D.find_siblings(ids, parts), "probe_id", "pos"))
    want = {(i, j) for (i, (a, _, _)), (j, (_, b, _)) in itertools.product(enumerate(PAIRS), repeat=2) if sibling(a, b)}
    assert got == want


def test_pairs_against_brute_force(rows):
    rng = random.Random(3)
    ids = {rng.choice(["LM35", "lm35", "L-M3", "PIC1"]) + "".join(rng.choice("8NnP2-A") for _ in range(rng.randrange(5))) for _ in range(250)}
    # one part number makes up half of all rows
    data = [(x,) for x in ids] + [("LM358N",)] * len(ids)
    got = set(tuples(D.family_pairs(rows(data, "part string"))))
    upper = {x.upper() for x in ids} | {"LM358N"}
    assert got == {(a, b) for a in upper for b in upper if a < b and sibling(a, b)}


def test_pages_and_batch(rows):
    probes = rows([(1, "LM358P")], "probe_id int, part string")
    pages = rows([("parts/lm358n.md",), ("parts/lm386.md",)], "path string")
    assert tuples(D.sibling_pages(probes, pages), "path") == [("parts/lm358n.md",)]
    stock = rows([("b", "LM358N")], "bin string, part string")
    deltas = rows([("b", "LM358P", 1), ("b", "TL082CP", 2), ("b", "TL082CN", 3), ("c", "LM358A", 1)], "bin string, part string, seq long")
    assert tuples(D.batch_siblings(stock, deltas)) == [("b", "LM358P", 1, "LM358N", True), ("b", "TL082CN", 3, "TL082CP", False)]


@pytest.mark.parametrize(
    "glob, path, yes",
    [
        ("src/**", "src/a/b.py", True), ("src/*.py", "src/a.py", True), ("src/*.py", "src/a/b.py", False),
        ("a?.md", "ab.md", True), ("a?.md", "a/.md", False), ("a.md", "aXmd", False), ("**/x+(1)", "p/x+(1)", True), ("*", "a/b", False),
    ],
)
def test_globs(rows, glob, path, yes):
    got = D.owners(rows([(path,)], "path string"), [(glob, "o"), ("never", "n")])
    assert tuples(got) == ([(path, glob, "o")] if yes else [])


def test_joins_are_equi_joins(spark, rows):
    ids = spark.range(100).select(F.col("id").alias("probe_id"), F.concat(F.lit("LM"), "id").alias("part"), F.col("id").alias("pos"))
    for df in (D.family_pairs(ids), D.find_siblings(ids, ids.select("pos", "part"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_trusted(rows):
    files = rows([(1, "scripts/run.sh"), (1, "src/a.py")], "change_id int, file string")
    allow = rows([("Bash(scripts/run.sh:*)",), ("Bash(git:*)",)], "entry string")
    assert tuples(C.trusted_changed(files, allow), "file") == [("scripts/run.sh",)]
