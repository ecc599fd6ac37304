"""Run registered queries next to their SQL and compare rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v)


def compare(spark_df, con, sql: str) -> str | None:
    """None if the rows agree, else what differs."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(_norm(r[names.index(c)]) for c in order) for r in cur.fetchall())
    got = Counter(tuple(_norm(r[c]) for c in order) for r in spark_df.collect())
    if want == got:
        return None if want else "no rows"
    return (
        f"rows {sum(got.values())} != {sum(want.values())}; {order}"
        f" spark-only {list((got - want).items())[:3]} sql-only {list((want - got).items())[:3]}"
    )


if __name__ == "__main__":
    import __spark_entry__ as entry
    from partslake.session import local_session

    sf = sys.argv[1]
    spark, con = local_session(8), duck(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    wanted = [n for n in queries if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]
    bad = 0
    for n in wanted:
        t = time.time()
        try:
            df = queries[n](spark, sf)
            out = compare(df, con, sql[n]) if n in sql else f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            out = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        bad += bool(out) and not str(out).startswith("rows only")
        print(f"{n:32s} {time.time() - t:6.2f}s {out or 'ok'}", flush=True)
    print("failed", bad, "of", len(wanted))
