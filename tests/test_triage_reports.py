import csv
import glob
import json
import os

from pyspark.sql import functions as F

from scanledger.operators import aggregates as agg
from scanledger.operators import triage
from scanledger.plans import reports
from tests.conftest import CANONICAL, make_findings


def canon(spark):
    return make_findings(spark, CANONICAL)


def test_passthrough_grouping(spark):
    rows = {(r["severity"], r["n"]) for r in agg.passthrough_triage(canon(spark)).collect()}
    assert rows == {("CRITICAL", 1), ("HIGH", 2), ("MEDIUM", 1)}
    assert {r["summary"] for r in agg.passthrough_triage(canon(spark)).collect()} == {"4 raw findings (triage skipped)"}


def test_parse_triage_valid_fenced_and_invalid(spark):
    body = {"summary": "2 issues", "critical": [{"title": "Leaked key", "detail": "d", "recommendation": "rotate",
                                                 "scanner": "gitleaks"}],
            "high": [{"title": "SQLi"}], "medium": [], "low": []}
    responses = spark.createDataFrame(
        [("a", json.dumps(body)), ("b", "```json\n" + json.dumps(body) + "\n```"), ("c", "not json at all")],
        "repo string, response string",
    )
    fb = make_findings(spark, [dict(r, repo="c") for r in CANONICAL])
    out = {(r["repo"], r["severity"], r["title"], r["scanner"], r["triaged"]) for r in triage.parse_triage(responses, fb).collect()}
    for repo in ("a", "b"):
        assert (repo, "CRITICAL", "Leaked key", "gitleaks", True) in out
        assert (repo, "HIGH", "SQLi", "unknown", True) in out
    assert len([x for x in out if x[0] == "c"]) == 4 and all(not x[4] for x in out if x[0] == "c")


def test_strip_fences(spark):
    df = spark.createDataFrame([("```json\n{}\n```",), ("```{}```",), ("  {} \n",)], "t string")
    assert [r[0] for r in df.select(triage.strip_fences(F.col("t"))).collect()] == ["{}", "{}", "{}"]


def test_triage_cap_and_payload_truncation(spark):
    rows = [dict(repo="r", run_date="2024-01-01", ingest_seq=i, scanner="s", severity="LOW", title=f"t{i}",
                 description="x" * 200) for i in range(100)]
    f = make_findings(spark, rows)
    assert triage.triage_cap(f, 10).count() == 10
    p = triage.triage_payload(f, 500, 12000).collect()[0]
    marker = "\n... (truncated)"
    assert p["payload"].endswith(marker) and 11000 < len(p["payload"]) <= 12000 + len(marker)
    sent = json.loads(p["payload"].removesuffix(marker))  # ends on a whole finding
    assert [x["title"] for x in sent] == [f"t{i}" for i in range(p["n_sent"])] and p["n_sent"] + p["n_left"] == 100
    (whole,) = triage.triage_payload(f.where("ingest_seq < 9"), 500, 12000).collect()
    assert len(json.loads(whole["payload"])) == whole["n_sent"] == 9 and whole["n_left"] == 0
    (long,) = triage.triage_payload(f.where("ingest_seq < 2"), 500, 100).collect()
    assert len(json.loads(long["payload"].removesuffix(marker))) == long["n_sent"] == long["n_left"] == 1


def test_rule_triage_merges_and_drops_tests(spark):
    rows = [dict(repo="r", run_date="2024-01-01", ingest_seq=i, scanner="semgrep", severity=s, title="sqli",
                 file_path=p, rule_id="sqli") for i, (s, p) in enumerate(
                     [("LOW", "a.py"), ("HIGH", "b.py"), ("CRITICAL", "tests/test_a.py")])]
    rows.append(dict(repo="r", run_date="2024-01-01", ingest_seq=9, scanner="gitleaks", severity="LOW", title="k",
                     file_path="c.py", rule_id="k"))
    out = {r["rule"]: r for r in triage.rule_triage(make_findings(spark, rows)).collect()}
    assert out["sqli"]["severity"] == "HIGH" and out["sqli"]["occurrences"] == 2 and out["sqli"]["files"] == 2
    assert out["k"]["severity"] == "CRITICAL"


def test_csv_rows_and_written_file(spark, tmpdir_path):
    f = canon(spark)
    rows = reports.csv_rows(f).collect()
    assert len(rows) == 4
    assert [r["file_path"] for r in rows if r["scanner"] == "npm-audit"] == [""]
    out = os.path.join(tmpdir_path, "csv")
    reports.export_csv(f, out)
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 4 and "fingerprint" in back.columns


def test_sarif_results_and_rules(spark):
    f = canon(spark)
    res = reports.sarif_results(f).collect()
    assert len(res) == 4
    by = {r["scanner"]: r for r in res}
    assert by["gitleaks"]["level"] == "error" and by["gitleaks"]["uri"] == "config.py" and by["gitleaks"]["start_line"] == 42
    assert by["npm-audit"]["uri"] is None and by["npm-audit"]["level"] == "warning"
    assert by["semgrep"]["message"] == "SQL injection\n\nRecommendation: Use params | binds"
    assert reports.sarif_rules(f).count() == 4
    js = [json.loads(r["json"]) for r in reports.sarif_result_json(f).collect()]
    assert any("locations" in j and j["locations"][0]["physicalLocation"]["region"]["startLine"] == 42 for j in js)
    assert any("locations" not in j for j in js)


def test_comment_header_rows_and_sections(spark):
    f = canon(spark)
    h = reports.pr_comment_summary(f).collect()[0]["header"]
    assert h.startswith("<!-- scanledger-scan-results -->\n## Security Scan Results\n\n**4 raw findings")
    assert "\U0001f534 **1** CRITICAL | \U0001f7e0 **2** HIGH | \U0001f7e1 **1** MEDIUM | \U0001f7e2 **0** LOW" in h
    rows = [r["row"] for r in reports.pr_comment_rows(f).collect()]
    assert "| **python.sql-injection**<br><sub>semgrep</sub> | Use params \\| binds |" in rows
    secs = {r["severity"]: r["section_head"] for r in reports.pr_comment_sections(f).collect()}
    assert set(secs) == {"CRITICAL", "HIGH", "MEDIUM"}
    empty = make_findings(spark, [dict(CANONICAL[0], severity="INFO")])
    assert reports.pr_comment_summary(empty).collect()[0]["header"].endswith("No security findings detected.\n")


def test_digest_subject_and_policy(spark):
    f = canon(spark)
    d = reports.digest(f, None, "2024-02-05", "critical_only").collect()[0]
    assert d["subject"] == "Security Scan: 1 Critical, 2 High — 2024-02-05 [r]" and d["send"]
    clean = make_findings(spark, [dict(CANONICAL[3])])
    d2 = reports.digest(clean, None, "2024-02-05", "critical_only").collect()[0]
    assert d2["subject"] == "Security Scan Clean — 2024-02-05 [r]" and not d2["send"]
    assert reports.digest(clean, None, "2024-02-05", "findings_only").collect()[0]["send"]


def test_issue_work_list_skips_open_and_dedups(spark):
    f = canon(spark)
    fp = [r["fingerprint"] for r in f.filter("scanner = 'gitleaks'").collect()][0]
    none_open = spark.createDataFrame([], "repo string, issue_title string")
    todo = reports.issue_work_list(f, none_open, threshold="HIGH").collect()
    assert len(todo) == 3
    t = [r for r in todo if r["fingerprint"] == fp][0]
    assert t["issue_title"] == f"[Security] CRITICAL: Secret detected: aws-access-key [{fp[:8]}]"
    assert "**Fingerprint:** `" + fp + "`" in t["body"] and t["labels"] == "security,automated"
    opened = spark.createDataFrame([("r", f"old title [{fp[:8]}] x")], "repo string, issue_title string")
    assert len(reports.issue_work_list(f, opened, threshold="HIGH").collect()) == 2


def test_page_work_list(spark):
    f = canon(spark)
    existing = f.filter("scanner = 'semgrep'").select("repo", "fingerprint")
    pages = reports.page_work_list(f, existing, "2024-02-05").collect()
    assert len(pages) == 3 and all(p["status"] == "Open" for p in pages)
    assert all(p["recommendation"].startswith("Recommendation: ") for p in pages)


def test_gate_and_totals(spark):
    f = canon(spark)
    g = agg.gate(f).collect()[0]
    assert g["has_critical"] and g["fail"] and g["total"] == 4
    t = agg.run_totals(f).collect()[0]
    assert (t["total_findings"], t["repos"], t["has_critical"]) == (4, 1, True)


def _assemble(parts):
    docs = {}
    for r in sorted(parts, key=lambda r: (r["repo"], r["k1"], r["k2"], r["k3"], r["k4"])):
        docs.setdefault(r["repo"], []).append(r["text"])
    return {k: json.loads("".join(v)) for k, v in docs.items()}


def test_sarif_document_parts_assemble(spark):
    f = make_findings(spark, CANONICAL + [dict(CANONICAL[1], ingest_seq=7, severity="INFO", title="python.other")])
    scans = spark.createDataFrame([("r",), ("clean",)], "repo string")
    docs = _assemble(reports.sarif_document_parts(f, scans).collect())
    d = docs["r"]
    assert d["version"] == "2.1.0" and [r["tool"]["driver"]["name"] for r in d["runs"]] == [
        "gitleaks", "npm-audit", "pip-audit", "semgrep"]
    assert sum(len(r["results"]) for r in d["runs"]) == 5
    sem = [r for r in d["runs"] if r["tool"]["driver"]["name"] == "semgrep"][0]
    assert len(sem["tool"]["driver"]["rules"]) == 2 and sem["results"][1]["level"] == "note"
    gl = [r for r in d["runs"] if r["tool"]["driver"]["name"] == "gitleaks"][0]
    assert gl["results"][0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 42
    assert docs["clean"]["runs"][0]["results"] == [] and docs["clean"]["runs"][0]["tool"]["driver"]["rules"] == []


def test_write_sarif_files_concatenate(spark, tmpdir_path):
    import glob
    import gzip

    f = make_findings(spark, CANONICAL)
    out = os.path.join(tmpdir_path, "sarif")
    reports.write_sarif(f, out, compress=True)
    files = sorted(glob.glob(os.path.join(out, "repo=r", "part-*")))
    text = "".join(gzip.open(p, "rt").read() for p in files)
    assert len(json.loads(text)["runs"]) == 4


def test_json_export_and_digest_links(spark, tmpdir_path):
    f = canon(spark)
    out = os.path.join(tmpdir_path, "json")
    reports.export_json(f, out)
    summ = spark.read.json(os.path.join(out, "summary")).collect()
    assert summ[0]["raw_count"] == 4 and summ[0]["summary"] == "4 raw findings (triage skipped)"
    rows = spark.read.json(os.path.join(out, "findings")).collect()
    assert sorted(r["section"] for r in rows) == ["critical", "high", "high", "medium"]
    fp = [r["fingerprint"] for r in f.filter("scanner = 'semgrep'").collect()][0]
    urls = spark.createDataFrame([("r", fp, "https://pages/1")], "repo string, fingerprint string, url string")
    d = {r["fingerprint"]: r["page_url"] for r in reports.digest_rows(f, urls).collect()}
    assert d[fp] == "https://pages/1" and sum(v is None for v in d.values()) == 3


def test_truncation_counts_code_points(spark):
    title = ("😀中é|" * 40)
    f = make_findings(spark, [dict(CANONICAL[0], title=title, description="ß" * 3000, recommendation="x|" * 150)])
    page = reports.page_work_list(f, spark.createDataFrame([], "repo string, fingerprint string"), "2024-02-05").collect()[0]
    assert page["page_title"] == title[:100] and page["description"] == ("ß" * 3000)[:2000]
    row = reports.pr_comment_rows(f).collect()[0]["row"]
    assert row.endswith(" | " + ("x|" * 150).replace("|", "\\|")[:200] + " |")
    issue = reports.issue_work_list(f, spark.createDataFrame([], "repo string, issue_title string")).collect()[0]
    assert issue["issue_title"].startswith("[Security] CRITICAL: " + title[:80] + " [")


def test_triage_batches_hold_every_finding_in_valid_json(spark):
    rows = [dict(repo="hot", run_date="2024-01-01", ingest_seq=i, scanner="semgrep", severity="LOW", title=f"t{i}",
                 description="d" * (i * 37 % 900 if i != 700 else 20000)) for i in range(1300)]
    rows += [dict(repo="one", run_date="2024-01-01", ingest_seq=0, scanner="semgrep", severity="LOW", title="t0")]
    out = triage.triage_batches(make_findings(spark, rows), 20, 12000).orderBy("repo", "batch").collect()
    hot = [r for r in out if r["repo"] == "hot"]
    assert [r["batch"] for r in hot] == list(range(1, len(hot) + 1)) and len(out) == len(hot) + 1
    items = [json.loads(r["payload"]) for r in hot]
    assert [x["title"] for b in items for x in b] == [f"t{i}" for i in range(1300)]
    assert all(r["n_findings"] == len(b) <= 20 for r, b in zip(hot, items))
    assert [len(b) for r, b in zip(hot, items) if len(r["payload"]) > 12000] == [1]


def test_export_tasks_follow_the_number_of_repos(spark, tmpdir_path, monkeypatch):
    """With many repos, tasks are dealt by repos; rows stay whole and in report order; few repos go by bytes as before."""
    rows = [dict(CANONICAL[i % 4], repo=f"r{i % 60:02d}", ingest_seq=i) for i in range(360)]
    f = make_findings(spark, rows)
    keyed = reports.csv_rows(f).withColumn("ingest_seq", F.lit(0))
    few = reports._in_report_order(keyed, f).rdd.getNumPartitions()
    monkeypatch.setattr(reports, "FILES_A_TASK", 1)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert few <= tasks < reports._in_report_order(keyed, f).rdd.getNumPartitions()
    out = os.path.join(tmpdir_path, "csv")
    reports.export_csv(f, out)
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    got = reports.read_csv_export(spark, out)
    assert spark.conf.get(key) == before and got.columns[-1] == "repo"
    assert sorted(got.collect()) == sorted(reports.csv_rows(f).select(got.columns).collect())
    for repo in ("r00", "r01", "r59"):
        lines = []
        for part in sorted(glob.glob(f"{out}/repo={repo}/*.csv")):
            with open(part, newline="") as fh:
                lines += [r["severity"] for r in csv.DictReader(fh)]
        want = [r["severity"] for r in sorted((r for r in rows if r["repo"] == repo), key=lambda r: (["CRITICAL", "HIGH", "MEDIUM", "LOW"].index(r["severity"]), r["ingest_seq"]))]
        assert lines == want
