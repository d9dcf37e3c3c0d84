"""Physical-plan checks over every query of this folder (sf0.001): the shapes that do not scale are absent."""

import pytest

from scanledger.llm import queries

SF = "/root/testdata/sf0.001"
# collect_list over the spans, and over the items, of one document
BOUNDED_COLLECT = {"op4_secret_ownership", "op11_prefix_decontamination"}


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_unscalable_operators(spark, name):
    p = plan_text(queries.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
    if name not in BOUNDED_COLLECT:
        assert "collect_list" not in p and "collect_set" not in p, name
    assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_secret_scan_needs_no_python(spark):
    p = plan_text(queries.QUERIES["op4_secret_ownership"](spark, SF))
    assert "InArrow" not in p and "InPandas" not in p
