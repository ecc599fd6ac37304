import random
import threading

import pytest
from pyspark.sql import functions as F

from partslake.operators import ledger as L
from partslake.operators import quality as Q
from partslake.sources import markdown as M
from tests.conftest import tuples

HEADER = ["Part", "Qty", "Description", "Source", "Notes"]
STOCK = "bin string, section string, part string, qty int, source string, cells map<string,string>"
DELTA = "bin string, seq long, part string, qty_delta int, source string, section string, cells map<string,string>"
SECTION = "bin string, section string, position int, has_table boolean, header array<string>"


def cells(part, **kw):
    return {"Part": part, "Description": "", "Notes": "", **kw}


@pytest.fixture
def base(rows):
    stock = rows([("b", "ICs", "LM358N", 1, "manual", cells("LM358N", Description="Op-amp"))], STOCK)
    sections = rows(
        [("b", "ICs", 1, True, HEADER), ("b", "Sensors", 2, True, HEADER), ("b", "Text", 3, False, None)], SECTION
    )
    return stock, sections


CASES = [
    # delta, disposition, qty, section, reason
    (("NE555N", 3, "manual", "ICs", None), ("inserted", 3, "ICs", None)),
    (("NE555N", 3, "manual", None, None), ("inserted", 3, "ICs", None)),
    (("lm358n", 1, "manual", None, None), ("inserted", 1, "ICs", None)),
    (("LM358N", 2, "manual", None, None), ("bumped", 3, "ICs", None)),
    (("LM358N", -5, "manual", None, None), ("bumped", -4, "ICs", None)),
    (("LM358N", 2, "manual", "Nowhere", None), ("bumped", 3, "ICs", None)),
    (("LM358N", 0, "manual", None, {"Notes": "new"}), ("metadata_updated", 1, "ICs", None)),
    (("LM358N", 0, "camera", None, None), ("metadata_updated", 1, "ICs", None)),
    (("LM358N", 0, "manual", None, {"Description": "Op-amp", "Bogus": "x"}), ("no_op", 1, "ICs", None)),
    (("LM358N", 0, "manual", None, {"Part": "[LM358N](parts/a.md)"}), ("no_op", 1, "ICs", None)),
    (("LM358N", 0, "manual", None, {"Qty": "1"}), ("no_op", 1, "ICs", None)),
    (("LM358N", 0, "manual", None, {"Qty": "7"}), ("metadata_updated", 1, "ICs", None)),
    (("LM358N", 0, "manual", None, {"Source": "camera"}), ("metadata_updated", 1, "ICs", None)),
    (("X", 1, "manual", "Nowhere", None), ("rejected", None, None, "unknown section")),
    (("X", 1, "manual", "Text", None), ("rejected", None, None, "section has no parts table")),
    (("X", 1, "Manual", None, None), ("rejected", None, None, "source is not a lowercase token")),
    (("X", 1, "", None, None), ("rejected", None, None, "source is empty")),
    (("X", 1, " manual", None, None), ("rejected", None, None, "source has outer blanks")),
]


def test_single_deltas(rows, base):
    """Each case in a bin of its own, so one job checks all."""
    stock, sections = base
    bins = rows([(f"b{i}",) for i in range(len(CASES))], "bin string")
    spread = lambda df: bins.join(df.drop("bin"), F.lit(True))
    deltas = rows(
        [(f"b{i}", 1, p, q, src, sec, c) for i, ((p, q, src, sec, c), _) in enumerate(CASES)], DELTA
    )
    got = L.dispositions(spread(stock), deltas, spread(sections)).collect()
    by_bin = {r["bin"]: (r["disposition"], r["qty"], r["section"], r["reason"]) for r in got}
    assert [by_bin[f"b{i}"] for i in range(len(CASES))] == [want for _, want in CASES]


def test_upsert_keeps_part_cell_and_overlays(rows, base):
    stock, sections = base
    deltas = rows(
        [
            ("b", 1, "LM358N", 0, "camera", None, {"Part": "[LM358N](parts/x.md)", "Notes": "a", "Bogus": "z"}),
            ("b", 2, "LM358N", 2, "manual", None, {"Notes": "b", "Qty": "99"}),
            ("b", 3, "NEW", 1, "manual", "Sensors", {"Part": "[NEW](parts/new.md)", "Description": "d"}),
            ("b", 4, "NEW", 1, "camera", "ICs", {"Part": "other"}),
        ],
        DELTA,
    )
    got = {r["part"]: r for r in L.upsert_batch(stock, deltas, sections).collect()}
    assert (got["LM358N"]["qty"], got["LM358N"]["source"]) == (3, "manual")
    assert got["LM358N"]["cells"] == cells("LM358N", Description="Op-amp", Notes="b")
    assert (got["NEW"]["section"], got["NEW"]["qty"], got["NEW"]["source"]) == ("Sensors", 2, "camera")
    assert got["NEW"]["cells"]["Part"] == "[NEW](parts/new.md)"


def replay(stock, sections, deltas):
    """The batch one delta after the other, in plain Python."""
    import re

    state = {(b, p): dict(section=s, qty=q, source=src, cells=dict(c)) for b, s, p, q, src, c in stock}
    out = {}
    for b, seq, part, delta, source, section, given in sorted(deltas, key=lambda d: (d[0], d[1])):
        if not re.fullmatch(r"[a-z][a-z0-9_-]*", source):
            out[(b, seq)] = ("rejected", None)
            continue
        row = state.get((b, part))
        given = dict(given or {})
        if row is None:
            mine = [s for s in sections if s[0] == b]
            target = section or (min(mine, key=lambda s: s[2])[1] if mine else None)
            found = [s for s in mine if s[1] == target]
            if not found or not found[0][3]:
                out[(b, seq)] = ("rejected", None)
                continue
            kept = {c: v for c, v in given.items() if c in HEADER and c not in ("Qty", "Source")}
            state[(b, part)] = dict(section=target, qty=delta, source=source, cells={"Part": part, **kept})
            out[(b, seq)] = ("inserted", delta)
            continue
        changed = False
        for c, v in given.items():
            if c not in HEADER or c == "Part":
                continue
            current = {"Qty": str(row["qty"]), "Source": row["source"]}.get(c, row["cells"].get(c, ""))
            changed |= v != current
            if c == "Source":
                row["source"] = v
            elif c != "Qty":
                row["cells"][c] = v
        changed |= row["source"] != source
        row["source"] = source
        row["qty"] += delta
        out[(b, seq)] = ("bumped" if delta else "metadata_updated" if changed else "no_op", row["qty"])
    return state, out


@pytest.mark.parametrize("seed, width", [(1, 3), (2, 11), (3, 1 << 20)])
def test_batch_equals_sequential_replay(rows, seed, width):
    rng = random.Random(seed)
    sections = [
        (b, s, i, s != "Text", HEADER if s != "Text" else None)
        for b in ("x", "y") for i, s in enumerate(("Text", "ICs", "Sensors") if b == "x" else ("ICs", "Text"))
    ]
    stock = [(b, "ICs", f"P{i}", rng.randrange(5), "manual", {"Part": f"P{i}", "Notes": "n"}) for b in ("x", "y") for i in range(2)]
    deltas = []
    for b in ("x", "y"):
        for seq in range(150):
            given = rng.choice([None, {"Notes": rng.choice("ab")}, {"Notes": "n", "Description": rng.choice("de")},
                                {"Qty": str(rng.randrange(4))}, {"Source": rng.choice(["manual", "camera"])}, {"Bogus": "q"}])
            # half of all deltas are for one part
            part = "P3" if rng.random() < 0.5 else f"P{rng.randrange(6)}"
            deltas.append((b, seq, part, rng.choice([0, 0, 1, -2]), rng.choice(["manual", "manual", "camera", "Bad"]),
                           rng.choice([None, "ICs", "Text", "Nowhere"]), given))
    state, outcome = replay(stock, sections, deltas)
    args = rows(stock, STOCK), rows(deltas, DELTA), rows(sections, SECTION)
    got = {(r["bin"], r["seq"]): (r["disposition"], r["qty"]) for r in L.dispositions(*args, width=width).collect()}
    assert got == outcome
    post = {(r["bin"], r["part"]): dict(section=r["section"], qty=r["qty"], source=r["source"], cells=r["cells"])
            for r in L.upsert_batch(*args, width=width).collect()}
    assert post == state


DOC = """# Inv

## ICs

| Part | Qty | Source | Notes |
| --- | --- | --- | --- |
| [A1](parts/a.md) | 2 | manual | |
| B1 | 1 | camera | likely b |
| A1 | 9 | manual | later row |

## Empty

| Part | Qty | Source | Notes |
| --- | --- | --- | --- |
|  |  |  |  |
"""


def test_from_markdown_to_gate(rows):
    docs = rows([("b", "b/I.md", DOC), ("c", "c/I.md", DOC.replace("camera", "manual"))], "bin string, path string, text string")
    lines = M.inventory_rows(docs)
    stock = L.stock_of(lines)
    assert tuples(stock.filter("bin = 'b'"), "part", "qty", "section") == [("A1", 2, "ICs"), ("B1", 1, "ICs")]
    sections = L.sections_of(M.with_sections(docs), lines)
    assert tuples(sections, "bin", "section", "has_table") == [
        ("b", "Empty", True), ("b", "ICs", True), ("c", "Empty", True), ("c", "ICs", True),
    ]
    deltas = rows([("b", 1, "C1", 4, "manual", "Empty", None), ("c", 1, "C1", 4, "manual", None, None)], DELTA)
    post = L.upsert_batch(stock.select(*[c.split()[0] for c in STOCK.split(", ")]), deltas, sections)
    assert {(r["bin"], r["part"]): (r["section"], r["qty"]) for r in post.collect()}[("b", "C1")] == ("Empty", 4)
    # an old violation blocks the whole bin
    bad = Q.lint_inventory(docs)
    assert tuples(bad, "bin", "line", "rule") == [("b", 9, "alphabetical-order"), ("c", 9, "alphabetical-order")]
    assert L.gate(post, bad.filter("bin = 'b'")).select("bin").distinct().collect()[0]["bin"] == "c"


def test_undo(rows):
    stock = rows([("b", "p", 4), ("c", "p", 4), ("d", "p", 1)], "bin string, part string, qty int")
    cache = rows([(1, "x"), (2, "y"), (3, "z")], "row_id long, label string")
    journal = rows(
        [("b", "p", 10, 1, 2, 3, 1), ("b", "p", 11, 2, 3, 4, 2), ("c", "p", 12, 1, 7, 8, 3)],
        "bin string, part string, entry_id long, ts int, qty_before int, qty_after int, cache_row_id long",
    )
    new_stock, new_cache, new_journal, outcomes = L.undo_last(stock, cache, journal)
    assert tuples(new_stock) == [("b", "p", 3), ("c", "p", 4), ("d", "p", 1)]
    assert tuples(new_cache, "row_id") == [(1,), (3,)]
    assert tuples(new_journal, "entry_id") == [(10,), (12,)]
    assert tuples(outcomes, "bin", "outcome") == [("b", "reverted"), ("c", "undo failed"), ("d", "nothing to undo")]


def test_undo_needs_the_cache_row(rows):
    stock = rows([("b", "p", 4), ("c", "q", 3)], "bin string, part string, qty int")
    cache = rows([(2, "y")], "row_id long, label string")
    journal = rows(
        [("b", "p", 10, 1, 3, 4, 1), ("c", "q", 11, 1, 2, 3, 2)],
        "bin string, part string, entry_id long, ts int, qty_before int, qty_after int, cache_row_id long",
    )
    new_stock, new_cache, new_journal, outcomes = L.undo_last(stock, cache, journal)
    assert tuples(new_stock) == [("b", "p", 4), ("c", "q", 2)] and tuples(new_journal, "entry_id") == [(10,)]
    assert not new_cache.count() and tuples(outcomes, "bin", "outcome") == [("b", "undo failed"), ("c", "reverted")]


def test_family_and_bom(rows):
    stock = rows(
        [("b", "PIC16F628", 2, "pic.md", False), ("b", "PIC16F628A", 2, "pic.md", False), ("b", "LM358N", 1, None, False), ("b", "kit", 0, None, True)],
        "bin string, part string, qty int, page string, bulk boolean",
    )
    fam = {r["part"]: (r["family_qty"], r["canonical"]) for r in L.family_stock(stock).collect()}
    assert fam["PIC16F628"] == (4, "pic") and fam["LM358N"] == (1, "LM358N")
    bom = rows([("b", "U1", "LM358N", 1), ("b", "U2", "PIC16F628", 3), ("b", "R1", "kit", 8), ("b", "U3", "none", 2)],
               "bin string, designator string, part string, needed int")
    got = {r["designator"]: (r["in_stock"], r["to_order"], r["feasible"]) for r in L.bom_plan(bom, stock).collect()}
    assert got == {"U1": ("1", 0, True), "U2": ("2", 1, True), "R1": ("(bulk)", 0, True), "U3": ("0", 2, False)}


def test_fill_empty_is_idempotent(rows):
    have = rows([("a", "mine", "", None), ("b", " ", "url", "n")], "part string, description string, datasheet string, notes string")
    new = rows([("a", "theirs", "ds", "DIP"), ("b", "d", None, None)], "part string, description string, datasheet string, notes string")
    once = L.fill_empty(have, new)
    assert tuples(once) == [("a", "mine", "ds", "DIP", True), ("b", "d", "url", "n", True)]
    twice = L.fill_empty(once.drop("filled"), new)
    assert tuples(twice.drop("filled")) == tuples(once.drop("filled")) and not twice.filter("filled").count()


def test_merge_and_first_sightings(rows):
    a = rows([(1, "x", 5), (2, "y", 5)], "k int, name string, qty int")
    b = rows([(1, "z", 7), (3, "w", 1)], "k int, name string, qty int")
    got = L.merge_owned(a, b, ["k"], {"name": "ours", "qty": "theirs"})
    assert tuples(got) == [(1, "x", 7, True), (2, "y", 5, False), (3, "w", 1, False)]
    stock = rows([("b", "p")], "bin string, part string")
    deltas = rows([("b", "p", 1, 1), ("b", "q", 3, 1), ("b", "q", 2, 5)], "bin string, part string, seq long, qty_delta int")
    assert tuples(L.first_sightings(stock, deltas)) == [("b", "q", 2, 5)]


@pytest.mark.parametrize("op", [L.upsert_batch, L.dispositions])
def test_costly_deltas_are_worked_out_once(spark, rows, op):
    cells = "source string, {}section string, cells map<string,string>"
    stock = rows([("b", "P1", 2, "manual", "S", {"Part": "P1"})], "bin string, part string, qty long, " + cells.format(""))
    sections = rows([("b", "S", 1, True, ["Part", "Notes"])], "bin string, section string, position int, has_table boolean, header array<string>")
    data = [("b", i, f"P{i % 3}", 1, "manual" if i else "", None, {"Notes": "n", "Extra": "x"}) for i in range(9)]
    deltas = rows(data, "bin string, seq long, part string, qty_delta long, " + cells.format(""))
    met = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    out = op(stock, deltas.mapInArrow(count, deltas.schema), sections)
    got = out.collect()
    assert met.value == len(data)
    if op is L.upsert_batch:
        assert sorted((r["part"], r["qty"], tuple(sorted(r["cells"].items()))) for r in got) == [
            (f"P{i}", n, (("Notes", "n"), ("Part", f"P{i}"))) for i, n in ((0, 2), (1, 5), (2, 3))
        ]


@pytest.mark.parametrize("width, passes, columns", [(1 << 20, 3, 16), (1 << 20, 1, 0), (40, 2, 16)])
def test_passes_hot_parts_and_cell_columns_equal_sequential_replay(rows, monkeypatch, width, passes, columns):
    """Parts replayed whole, parts cut into chunks and several passes give what one delta after the other gives."""
    monkeypatch.setattr(L, "PASS_ROWS", 1)
    monkeypatch.setattr(L, "PASSES", passes)
    monkeypatch.setattr(L, "CELL_COLUMNS", columns)
    rng = random.Random(width + passes)
    sections = [(b, s, i, s != "Text", HEADER if s != "Text" else None) for b in "xyz" for i, s in enumerate(("Text", "ICs", "Sensors"))]
    stock = [(b, rng.choice(["ICs", "Sensors"]), f"P{i}", rng.randrange(5), "manual", {"Part": f"P{i}", "Notes": "n"}) for b in "xy" for i in range(3)]
    deltas = []
    for b in "xyzw":
        # far apart: the span of the numbers must not matter
        for seq in sorted(rng.sample(range(1 << 40), 90)):
            given = rng.choice([None, {}, {"Notes": rng.choice("ab")}, {"Notes": "n", "Description": rng.choice("de")}, {"Description": ""},
                                {"Qty": str(rng.randrange(4)), "Bogus": "q"}, {"Source": rng.choice(["manual", "camera"])}])
            part = "P5" if rng.random() < 0.5 else f"P{rng.randrange(9)}"
            deltas.append((b, seq, part, rng.choice([0, 0, 0, 1, -2]), rng.choice(["manual", "manual", "manual", "camera", "Bad"]),
                           rng.choice([None, "ICs", "Sensors", "Nowhere"]), given))
    state, outcome = replay(stock, sections, deltas)
    args = rows(stock, STOCK), rows(deltas, DELTA), rows(sections, SECTION)
    got = L.dispositions(*args, width=width).collect()
    assert len(got) == len(deltas)
    assert {(r["bin"], r["seq"]): (r["disposition"], r["qty"]) for r in got} == outcome
    assert all((r["reason"] is not None) == (r["disposition"] == "rejected") for r in got)
    post = {(r["bin"], r["part"]): dict(section=r["section"], qty=r["qty"], source=r["source"], cells=r["cells"])
            for r in L.upsert_batch(*args, width=width).collect()}
    assert post == state


@pytest.mark.parametrize("op", [L.upsert_batch, L.dispositions])
def test_a_delta_moves_between_tasks_once(spark, rows, op):
    """Bytes of all shuffle files there are while an operator runs, however far apart the sequence numbers are."""
    n = 20_000
    deltas = spark.range(n).selectExpr(
        "concat('bin', id % 100) as bin", "id * 5000000 as seq", "concat('P', id % 1000) as part", "cast(id % 3 as int) as qty_delta",
        "'manual' as source", "cast(null as string) as section", "map('Notes', md5(string(id))) as cells",
    )
    stock = spark.range(500).selectExpr(
        "concat('bin', id % 100) as bin", "'S' as section", "concat('P', id) as part", "1 as qty", "'manual' as source", "map('Part', concat('P', id)) as cells"
    )
    sections = spark.range(100).selectExpr(
        "concat('bin', id) as bin", "'S' as section", "1 as position", "true as has_table", "array('Part', 'Qty', 'Source', 'Notes') as header"
    )
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = blocks.getAllFiles().iterator()
        sizes = {}
        while files.hasNext():
            f = files.next()
            if f.getName().endswith(".data"):
                sizes[f.getName()] = f.length()
        return sizes

    # the shuffle files of a step may go at once, so the peak is watched
    before, peak, stop = shuffled(), [0], threading.Event()

    def watch():
        while not stop.wait(0.02):
            peak[0] = max(peak[0], sum(v for k, v in shuffled().items() if k not in before))

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        op(stock, deltas, sections).write.format("noop").mode("overwrite").save()
    finally:
        stop.set()
        watcher.join()
    # a cell of a delta is 32 random digits; twice these would be moved by a second shuffle of the cells
    assert 0 < peak[0] < n * 100


def test_an_upsert_does_not_look_for_changed_cells(rows, base, monkeypatch):
    stock, sections = base
    deltas = rows([("b", i, "LM358N", 1, "manual", None, {"Notes": str(i)}) for i in range(4)], DELTA)
    monkeypatch.setattr(L, "_changed_events", None)
    for width in (1, 1 << 20):
        (row,) = L.upsert_batch(stock, deltas, sections, width=width).collect()
        assert (row["qty"], row["cells"]["Notes"]) == (5, "3")
