"""Plans keep what makes the operators scale."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


# Work inside one document, image list or record: nothing moves between tasks.
@pytest.mark.parametrize("name", ["a5_part_link", "e11_effort_hours", "h3_family_datasheet", "i4_decode_bands", "d5_owners", "e4_progress_tenths"])
def test_row_work_does_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


# One shuffle, after partial aggregation.
@pytest.mark.parametrize("name", ["b3_resolve_first", "b13_stock_stats", "e3_epic_counts", "i1_lighting_bands", "h6_enrichment_outcomes"])
def test_aggregates_shuffle_once(spark, name):
    assert plan(spark, name).count("Exchange") == 1


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "b12_merge_owned")
    assert "ReadSchema: struct<o_custkey:bigint>" in text
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,3)]" in plan(spark, "b10_bom_plan")


def test_no_window_holds_a_whole_key(spark):
    """The windows of a chunked scan partition by the chunk, or run over chunk totals."""
    text = plan(spark, "i3_camera_lost")
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert any("_chunk" in line for line in exchanges)
    whole = [line for line in text.splitlines() if "Window " in line and "_chunk" not in line]
    assert not whole


def test_gated_stock_is_worked_out_once(spark):
    """Its rows and their diagnostics are read from one table."""
    text = plan(spark, "b6_gate")
    assert "max_by" not in text and "Window" not in text
