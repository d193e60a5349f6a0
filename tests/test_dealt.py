"""Queries deal their rows once, by page or filing: no other exchange stands in their plans, and what a task holds is bounded by rows, not by the table."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import queries

SMALL = "/root/testdata/sf0.001"


def exchanges(found) -> tuple[int, int]:
    """Distinct deals by number, and other exchanges by hash."""
    plan = found._jdf.queryExecution().executedPlan().toString()
    return plan.count("REPARTITION_BY_NUM"), len(re.findall(r"Exchange hashpartitioning[^\n]*ENSURE_REQUIREMENTS", plan))


@pytest.mark.parametrize("name", [
    "rule_grids", "table_methods", "spaced_tables", "balance_completeness", "automatic_page_plan", "literal_grids", "split_parentheses", "assembled_grids",
])
def test_rows_are_dealt_once(spark, name):
    dealt, others = exchanges(queries()[name](spark, SMALL))
    assert dealt >= 1 and others == 0
