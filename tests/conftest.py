import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from partslake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "partslake-tests")
    # tiny inputs; the code does not depend on the number
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture
def rows(spark):
    """Build a DataFrame from tuples and a schema string."""
    return lambda data, schema: spark.createDataFrame(data, schema)


def tuples(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)
