import os
from urllib.parse import urlparse

import pytest

from partslake import session as S


def folders(spark):
    """Local name of the checkpoint folder, and what it holds."""
    root = urlparse(S.checkpoint_dir(spark)).path
    return root, set(os.listdir(root))


def test_leased_tables_are_removed(spark):
    before = folders(spark)[1]
    with S.leased(spark):
        assert S.cut_lineage(spark.range(5)).count() == 5
        with S.leased(spark):
            inner = S.scratch(spark, "inner")
            spark.range(3).write.parquet(inner)
        assert not os.path.exists(urlparse(inner).path)
        assert len(folders(spark)[1] - before) == 1
    assert folders(spark)[1] == before


def test_a_failure_leaves_no_table_and_what_is_not_leased_stays(spark):
    kept = S.cut_lineage(spark.range(4))
    before = folders(spark)[1]
    with pytest.raises(ValueError), S.leased(spark):
        S.cut_lineage(spark.range(5))
        raise ValueError
    assert folders(spark)[1] == before
    assert kept.count() == 4


def test_sweep_takes_old_folders_of_other_applications_only(spark):
    # the folder of another application beside ours
    root = os.path.join(os.path.dirname(folders(spark)[0]), "another")
    kept = S.cut_lineage(spark.range(4))
    old, young, other = (os.path.join(root, n) for n in (S.PREFIX + "gone-cut-1", S.PREFIX + "live-cut-2", "other"))
    for path in (old, young, other):
        os.makedirs(path, exist_ok=True)
        with open(os.path.join(path, "part"), "w") as f:
            f.write("x")
    for path in (old, young, other):
        os.utime(path, (1, 1))
    for path in (old, other):
        os.utime(os.path.join(path, "part"), (1, 1))
    assert S.sweep(spark, idle_hours=1) == [S.PREFIX + "gone-cut-1"]
    assert not os.path.exists(old) and os.path.exists(young) and os.path.exists(other)
    assert kept.count() == 4
