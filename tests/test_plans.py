from __future__ import annotations

import pytest

from tessera.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "scans"), [("q_gate_summary", 1), ("q_coupling", 3), ("q_package_rollup", 3), ("q_violation_diff", 2), ("q_clone_groups", 2), ("q_marker_density", 1)])
def test_tables_are_read_few_times(spark, name, scans):
    assert plan(QUERIES[name](spark, FOLDER)).count("FileScan") <= scans


def test_a_pattern_is_counted_once(spark):
    assert plan(QUERIES["q_marker_density"](spark, FOLDER)).count("regexp_count") <= 1 or plan(QUERIES["q_marker_density"](spark, FOLDER)).count("(the|der") <= 1


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(QUERIES["q_churn"](spark, FOLDER))
    assert "l_extendedprice" not in text and "l_comment" not in text
    assert "PushedFilters: [IsNotNull(p_size)" in plan(QUERIES["q_located"](spark, FOLDER)) or "PushedFilters" in text
