"""Physical-plan checks over every registered query (sf0.001): the shapes that do not scale are absent."""

import pytest

from scanledger.plans import catalog
from tests.conftest import built

SF = "/root/testdata/sf0.001"
# collect_list over <= 500 rows per repo (the tool's own cap); over one payload, whose bound the query checks; over one
# part of a document
BOUNDED_COLLECT = {"triage_payload", "triage_batches", "pr_comment_bodies", "json_export_documents", "sarif_upload_bodies"}


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(q for q in catalog.QUERIES if not q.endswith("_varied")))  # second forms share the plan
def test_no_unscalable_operators(spark, name):
    p = plan_text(built(spark, name))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
    if name not in BOUNDED_COLLECT:
        assert "collect_list" not in p and "collect_set" not in p, name
    assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_cap_is_a_partial_window_group_limit(spark):
    p = plan_text(built(spark, "triage_cap"))
    assert p.count("WindowGroupLimit") >= 2  # partial before the shuffle + final


def test_text_scans_do_not_shuffle(spark):
    for q in ("secret_scan_documents", "secret_scan_pages", "license_scan_documents"):
        p = plan_text(built(spark, q))
        assert "Exchange" not in p, q


def test_hot_repo_is_split_across_tasks_by_ordered_writers(spark):
    from pyspark.sql import functions as F

    from scanledger.plans import reports
    from tests.conftest import make_findings

    rows = [dict(repo="hot" if i % 10 else f"cold-{i}", run_date="2024-01-01", ingest_seq=i, scanner="semgrep",
                 severity="HIGH", title=f"t{i % 50}", file_path=f"f{i}.py", line=1, rule_id=f"r{i % 50}")
            for i in range(4000)]
    f = make_findings(spark, rows)
    parts = reports.sarif_document_parts(f)
    keys = ["repo", "k1", "k2", "k3", "k4"]
    spread = parts.repartitionByRange(8, *keys).withColumn("pid", F.spark_partition_id())
    tasks = spread.filter(F.col("repo") == "hot").select("pid").distinct().count()
    assert tasks >= 4  # the hot repo's document is produced by several tasks, not one
    # and the fragments of the hot repo are still globally ordered across those tasks
    key = F.struct("k1", "k2", "k3", "k4")
    bounds = spread.filter(F.col("repo") == "hot").groupBy("pid").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    b = sorted((r["pid"], tuple(r["lo"]), tuple(r["hi"])) for r in bounds.collect())
    assert all(b[i][2] <= b[i + 1][1] for i in range(len(b) - 1))
