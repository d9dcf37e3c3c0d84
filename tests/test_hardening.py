"""Faults that only show off the main path: clean runs, restarted streams, odd payloads, CSV quoting."""

import csv
import glob
import json
import os

import pytest

from scanledger.operators import triage
from scanledger.operators.store import BucketedStore
from scanledger.plans import reports
from scanledger.streaming.ingest import ingest_stream
from tests.conftest import CANONICAL, make_findings
from tests.test_normalizers import run
from tests.test_streaming import report, write_lines


def ingest(spark, src, root, checkpoint):
    ingest_stream(spark, src, root, checkpoint_location=checkpoint, n_buckets=4).awaitTermination(120)


def test_clean_first_run_and_restarted_checkpoint(spark, tmpdir_path):
    src, root = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "store")
    os.makedirs(src)
    write_lines(src, "b0.json", [report("r1", "2024-01-01", 1, [])])
    ingest(spark, src, root, os.path.join(tmpdir_path, "c1"))
    assert BucketedStore(spark, root, 4).read() is None  # committed, without a row
    write_lines(src, "b1.json", [report("r1", "2024-01-08", 2, ["a"])])
    ingest(spark, src, root, os.path.join(tmpdir_path, "c1"))
    assert [r["status"] for r in BucketedStore(spark, root, 4).read().collect()] == ["open"]
    src2 = os.path.join(tmpdir_path, "in2")
    os.makedirs(src2)
    write_lines(src2, "b2.json", [report("r2", "2024-01-08", 3, ["b"])])
    ingest(spark, src2, root, os.path.join(tmpdir_path, "c2"))  # epochs count from 0 again
    assert sorted(r["repo"] for r in BucketedStore(spark, root, 4).read().collect()) == ["r1", "r2"]


def test_full_commit_of_few_buckets_reads_back(spark, tmpdir_path):
    store = BucketedStore(spark, os.path.join(tmpdir_path, "s"), 8)
    assert store.read() is None
    state = spark.createDataFrame([("r1", "f1", "open")], "repo string, fingerprint string, status string")
    store.commit(state)
    assert store.read().count() == 1
    store.commit(state.limit(0))
    assert store.read() is None


def test_unreadable_commits_are_not_taken_for_none(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "s")
    os.makedirs(os.path.join(root, "_commits"))
    with open(os.path.join(root, "_commits", "part-0.parquet"), "w") as fh:
        fh.write("no parquet")
    with pytest.raises(Exception):  # noqa: B017
        BucketedStore(spark, root, 4).latest_version()


@pytest.mark.parametrize("tool", ["gitleaks", "hadolint"])
def test_lone_object_is_a_failed_report(spark, tool):
    findings, status = run(spark, (tool, "x", {"error": "boom"}))
    assert findings == [] and [s["ok"] for s in status] == [False]


def test_repos_without_a_good_response_fall_back_once(spark):
    rows = [dict(repo=r, scanner="gitleaks", severity="HIGH", title=f"t-{r}", description="d", file_path="a.py", line=1, recommendation="x", rule_id="q") for r in "abc"]
    good = json.dumps({"summary": "s", "high": [{"title": "T", "detail": "d", "scanner": "gitleaks"}]})
    responses = spark.createDataFrame([("a", good), ("a", "not json"), ("b", "not json")], "repo string, response string")
    out = sorted((r["repo"], r["title"], r["triaged"]) for r in triage.parse_triage(responses, make_findings(spark, rows)).collect())
    assert out == [("a", "T", True), ("b", "t-b", False), ("c", "t-c", False)]


def test_csv_round_trips_through_another_reader(spark, tmpdir_path):
    titles = ['say "hi", x', "  blanks  ", "two\nlines", "back\\slash"]
    rows = [dict(repo="r", scanner="semgrep", severity="HIGH", title=t, description=t, file_path="a.py", line=1, recommendation=t, rule_id="q") for t in titles]
    out = os.path.join(tmpdir_path, "csv")
    reports.export_csv(make_findings(spark, rows), out)
    got = []
    for path in glob.glob(f"{out}/**/*.csv", recursive=True):
        with open(path, newline="") as fh:
            got += [r["title"] for r in csv.DictReader(fh)]
    assert sorted(got) == sorted(titles)


def test_fingerprints_sharing_a_tag_and_titles_sharing_a_prefix_stay_apart(spark):
    from pyspark.sql import functions as F

    f = make_findings(spark, [dict(CANONICAL[0], ingest_seq=i, title="x" * 40 + str(i)) for i in range(2)])
    tagged = f.withColumn("fingerprint", F.concat(F.lit("01234567"), F.col("ingest_seq").cast("string")))
    todo = reports.issue_work_list(tagged, spark.createDataFrame([], "repo string, issue_title string"))
    assert sorted(r["fingerprint"] for r in todo.collect()) == ["012345670", "012345671"]
    assert reports.sarif_rules(f.withColumn("fingerprint", F.lit(""))).count() == 2
