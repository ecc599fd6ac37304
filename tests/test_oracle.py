"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


# Rules that may find nothing in the smallest tables.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # no pair-by-pair join, no Python per row
    assert not [x for x in ("NestedLoop", "CartesianProduct", "BatchEvalPython") if x in plan]
    if name in entry.oracle_sql():
        found = compare(df, con, entry.oracle_sql()[name])
        assert found is None or found == "no rows" and name in MAY_BE_EMPTY, found
    else:
        assert df.count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["bin", "part", "seq", "disposition", "qty", "section", "reason"] and df.count()
