import random

from pyspark.sql import functions as F

from partslake.operators import workitems as W
from tests.conftest import tuples

ITEM = "id string, status string, folder string, path string, epic string, ord_raw string, prerequisites array<string>"


def item(n, status="open", epic="E", order="1", folder=None, pre=()):
    folder = folder or status
    return (f"TASK-{n}", status, folder, f"t/{folder}/task-{n}.md", epic, order, [f"TASK-{p}" for p in pre])


STATUS_CASES = (
    [
        (["closed", "closed"], "closed"), (["open"], "open"), (["open", "closed"], "active"), (["paused"], "active"),
        (["open", "paused"], "active"), ([None], None), ([None, "closed"], "closed"),
    ]
)


def test_epic_status(rows):
    items = rows(
        [item(f"{e}{i}", s, folder="open", epic=f"E{e}") for e, (ss, _) in enumerate(STATUS_CASES) for i, s in enumerate(ss)], ITEM
    )
    assert tuples(W.epic_status(items)) == [(f"E{e}", want) for e, (_, want) in enumerate(STATUS_CASES)]


def test_misplaced(rows):
    items = rows(
        [
            item(1, "closed", folder="open"), item(2, "closed"), item(3, "odd", folder="open", epic=None),
            ("EPIC-1", "open", "open", "t/open/epic-1.md", "E", None, []),
            ("EPIC-2", "open", "open", "t/open/epic-2.md", None, None, []),
        ],
        ITEM,
    )
    assert tuples(W.misplaced(items), "path", "target") == [
        ("t/open/epic-1.md", "t/closed/epic-1.md"), ("t/open/task-1.md", "t/closed/task-1.md"),
    ]


def test_counts_round_half_even(rows):
    items = rows([item(i, "closed" if i == 0 else "open") for i in range(8)] + [item(9, "open", epic=" ")], ITEM)
    got = {(r["epic"], r["is_total"]): (r["n_closed"], r["total"], r["pct"], r["tenths"]) for r in W.epic_counts(items).collect()}
    assert got == {("E", 0): (1, 8, 12, 1), (None, 0): (0, 1, 0, 0), (None, 1): (1, 9, 11, 1)}
    bars = rows([(5,), (15,), (25,), (100,)], "p int").select(W.progress_tenths(F.col("p")).alias("t"))
    assert [r["t"] for r in bars.collect()] == [0, 2, 2, 10]


def test_order_and_renumber(rows):
    items = rows(
        [item(1, order="1"), item(2, order="?"), item(3, order=" "), item(4, order="x"), item(5, order="1"), item(6, order="3"), item(7, order=None, epic=None)],
        ITEM,
    )
    assert tuples(W.order_violations(items), "id", "violation", "owners") == [
        ("TASK-1", "duplicate", 2), ("TASK-2", "missing", None), ("TASK-3", "missing", None),
        ("TASK-4", "non-integer", None), ("TASK-5", "duplicate", 2),
    ]
    assert tuples(W.renumber(items), "id", "new_ord") == [("TASK-2", 4), ("TASK-3", 5), ("TASK-4", 6), ("TASK-5", 2)]


def test_ranked(rows):
    items = rows([item(1, "closed"), item(2, "active"), item(3, "paused"), item(4, "open", order="9"), item(5, "open", order="x"), item(6, "odd")], ITEM)
    assert [r["id"] for r in W.ranked_items(items).collect()] == ["TASK-4", "TASK-5", "TASK-3", "TASK-2", "TASK-1", "TASK-6"]


def test_edges_and_eligible(rows):
    items = rows(
        [item(1, "closed"), item(2, "open", pre=[1]), item(3, "open", pre=[1, 2]), item(4, "paused", pre=[1]), item(5, "open", pre=[99]), item(6, "open", epic="F", pre=[1])],
        ITEM,
    )
    assert tuples(W.prerequisite_edges(items), "src", "dst", "src_status", "in_epic") == [
        ("TASK-1", "TASK-2", "closed", True), ("TASK-1", "TASK-3", "closed", True), ("TASK-1", "TASK-4", "closed", True),
        ("TASK-1", "TASK-6", "closed", False), ("TASK-2", "TASK-3", "open", True), ("TASK-99", "TASK-5", "open", False),
    ]
    assert tuples(W.eligible(items), "id", "state", "blockers") == [
        ("TASK-2", "eligible", 0), ("TASK-3", "blocked", 1), ("TASK-4", "may_resume", 0), ("TASK-5", "blocked", 1), ("TASK-6", "eligible", 0),
    ]


def test_dag_shape(rows):
    items = rows(
        [item(1, epic="none")]
        + [item(10, epic="chain"), item(11, epic="chain", pre=[10]), item(12, epic="chain", pre=[11, 10])]
        + [item(20 + i, epic="fan") for i in range(5)] + [item(29, epic="fan", pre=[20])]
        + [item(30, epic="wide"), item(31, epic="wide"), item(32, epic="wide", pre=[30, 31])]
        + [item(40, epic="ring", pre=[41]), item(41, epic="ring", pre=[40]), item(42, epic="ring")]
        + [item(50, epic="outside", pre=[1])],
        ITEM,
    )
    got = {r["epic"]: (r["roots"], r["depth"], r["cyclic"], r["direction"]) for r in W.dag_shape(items).collect()}
    assert got == {
        "none": (1, 1, False, "LR"), "chain": (1, 3, False, "LR"), "fan": (5, 2, False, "LR"), "wide": (2, 2, False, "TD"),
        "ring": (1, 1, True, "TD"), "outside": (1, 1, False, "TD"),
    }


def test_dag_shape_equals_the_queue(rows):
    """Random graphs with branches, rings, self-loops and repeated prerequisites, node by node."""
    rng = random.Random(9)
    items, want = [], {}
    for e in range(12):
        n = rng.randrange(2, 14)
        base = 1000 * (e + 1)
        pre = {base + i: [base + rng.randrange(n) for _ in range(rng.choice([0, 1, 1, 1, 2]))] for i in range(n)}
        if e % 3:  # no cycles
            pre = {v: [u for u in us if u < v] for v, us in pre.items()}
        items += [item(v, epic=f"e{e:02d}", pre=us) for v, us in pre.items()]
        left, dist = {v: len(us) for v, us in pre.items()}, dict.fromkeys(pre, 0)
        queue = [v for v in pre if not left[v]]
        done = 0
        while queue:
            u, done = queue.pop(0), done + 1
            for v in pre:
                for x in pre[v]:
                    if x == u:
                        dist[v] = max(dist[v], dist[u] + 1)
                        left[v] -= 1
                        if not left[v]:
                            queue.append(v)
        want[f"e{e:02d}"] = (max(dist.values()) + 1, done < n)
    assert {r["epic"]: (r["depth"], r["cyclic"]) for r in W.dag_shape(rows(items, ITEM)).collect()} == want
    assert any(c for _, c in want.values()) and any(d > 3 for d, _ in want.values())


def test_a_long_chain_takes_few_rounds(rows, monkeypatch):
    calls, real = [], W.cut_lineage
    monkeypatch.setattr(W, "cut_lineage", lambda df: calls.append(1) or real(df))
    chain = [item(10_000 + i, epic="long", pre=[9_999 + i] if i else []) for i in range(10_000)]
    assert [(r["depth"], r["cyclic"]) for r in W.dag_shape(rows(chain, ITEM)).collect()] == [(10_000, False)]
    assert len(calls) <= 20


def test_dag_shape_of_deep_chains_and_cycles_behind_them(rows):
    chain = [item(100 + i, epic="deep", pre=[99 + i] if i else []) for i in range(40)]
    behind = [item(200, epic="behind")] + [item(201 + i, epic="behind", pre=[200 + i]) for i in range(5)]
    behind += [item(210, epic="behind", pre=[205, 211]), item(211, epic="behind", pre=[210])]
    shaped = W.dag_shape(rows(chain + behind, ITEM))
    got = {r["epic"]: (r["depth"], r["cyclic"]) for r in shaped.collect()}
    assert got == {"deep": (40, False), "behind": (7, True)}  # a node counts from any of its prerequisites that is done
    shallow = W.dag_shape(rows(chain[:3], ITEM))
    size = lambda df: len(df._jdf.queryExecution().analyzed().toString().splitlines())
    assert size(shaped) == size(shallow)


def test_effort(rows):
    df = rows([("Small (2-4h)",), ("XXL (>40h)",), ("Extra-Large (x)",), ("weird",), (None,)], "e string")
    got = [tuple(r) for r in df.select(W.effort_hours(F.col("e")), W.effort_days(F.col("e"))).collect()]
    assert got == [(1.0, 2), (56.0, 3), (None, 20), (None, 3), (None, 3)]


def test_closures(rows):
    data = [
        ("task-001.md", "task", "2026-04-25", 1.0, 5.0, 1), ("task-002.md", "task", "2026-04-25", 5.0, None, 2),
        ("epic-001.md", "epic", "2026-04-26", None, None, 3), ("task-003.md", "task", "2026-04-20", 9.0, 9.0, 4),
        ("task-003.md", "task", "2026-04-26", 9.0, 9.0, 5), ("task-003.md", "task", "2026-04-26", 16.0, 32.0, 6),
    ]
    closures = rows(data, "basename string, kind string, closed_on string, effort_h double, effort_actual_h double, pos long")
    latest = W.latest_closures(closures)
    assert tuples(latest, "basename", "pos") == [("epic-001.md", 3), ("task-001.md", 1), ("task-002.md", 2), ("task-003.md", 6)]
    assert tuples(W.burn_up(latest)) == [
        ("2026-04-25", 2, 0, 6.0, 5.0, 2, 0, 6.0, 5.0), ("2026-04-26", 1, 1, 16.0, 32.0, 3, 1, 22.0, 37.0),
    ]


def test_board(rows):
    items = rows([item(2), item(1), item(3, "closed"), item(4, "closed", epic="Done"), item(5, "odd"), item(6, "active", epic=None)], ITEM)
    assert tuples(W.board(items), "epic", "status", "position", "id") == [
        ("E", "closed", 1, "TASK-3"), ("E", "open", 1, "TASK-1"), ("E", "open", 2, "TASK-2"), ("Other", "active", 1, "TASK-6"),
    ]


def test_strip_generated(rows):
    text = "\n_Auto-generated by `housekeep.py`. Do not edit manually._\n\n# T\n<!-- GENERATED -->\n\n\n<!-- BURNUP:START -->\nx <!-- END GENERATED -->\n<!-- END GENERATED -->"
    assert rows([(text,)], "t string").select(W.strip_generated(F.col("t")).alias("t")).first()["t"] == "# T\n\nx <!-- END GENERATED -->\n"
