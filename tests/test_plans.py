"""Shapes of plans: no pairs by nested loops, no window over a whole document, filters and columns reach the scan."""

import re

import pytest

from sizelake.plans import catalog

FOLDER = "/root/testdata/sf0.001"
#: A grid of a few thresholds against a few counts.
NESTED = {"sweep_grid"}


def plan(spark, name):
    return catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - NESTED))
def test_no_nested_loops(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert not re.search(r"Window \[[^\]]*\], \[doc_id#\d+\]", p)


def formatted(spark, name):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().explainString(mode)


def test_pushdown(spark):
    p = formatted(spark, "audit_filter")
    assert "EqualTo(event_type,click)" in p and "GreaterThanOrEqual(ts" in p
    assert re.search(r"ReadSchema: struct<c_nationkey:int>", formatted(spark, "top_segments"))
