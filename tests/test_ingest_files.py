"""Report files on storage -> raw_reports -> findings; invariants of the findings tables."""

import json
import os

from pyspark.sql import functions as F

from scanledger.operators import aggregates as agg
from scanledger.operators import lifecycle as lc
from scanledger.sources.reports import RAW_COLUMNS, normalize, read_reports, stage_reports


def test_read_report_files_and_stage(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "reports")
    os.makedirs(d)
    with open(os.path.join(d, "semgrep.json"), "w") as fh:
        json.dump({"results": [{"check_id": "r1", "path": "a.py", "start": {"line": 3}},
                               {"check_id": "r2", "path": "b.py", "start": {"line": 4}}]}, fh, indent=2)
    raw = read_reports(spark, d, repo="org/x", run_id="1", run_date="2024-01-01", scanner="semgrep", report_seq=7)
    f, s = normalize(raw, scanners=["semgrep"])
    rows = f.orderBy("ingest_seq").collect()
    assert [r["title"] for r in rows] == ["r1", "r2"]
    assert rows[0]["ingest_seq"] == 7 * (1 << 24) and s.collect()[0]["ok"]
    out = os.path.join(tmpdir_path, "staged")
    stage_reports(raw, out)
    back = spark.read.parquet(out)
    assert set(back.columns) == set(RAW_COLUMNS) and back.filter(F.col("scanner") == "semgrep").count() == 1


def test_invariants_on_events(spark):
    from scanledger.sources import fixtures as fx

    f = fx.events_findings(spark, "/root/testdata/sf0.001")
    scans = fx.events_scans(f)
    per_scanner = agg.scanner_counts(f).agg(F.sum("n_findings")).first()[0]
    assert per_scanner == f.count()  # union of per-scanner counts = total
    st = lc.replay(f, scans)
    assert st.count() == f.select("repo", "fingerprint").distinct().count()  # one state row per key
    d = lc.run_deltas(f, scans)
    total_new = d.agg(F.sum("new")).first()[0]
    assert total_new == st.count()  # every key is new exactly once
    resolved = d.agg(F.sum("resolved")).first()[0]
    assert resolved == st.filter(F.col("resolved_on").isNotNull()).count()


def test_fingerprint_never_empty_even_for_bare_items(spark):
    import datetime as dt

    rows = [("r", "1", dt.date(2024, 1, 1), "gitleaks", "g", 1, "[{}]"), ("r", "1", dt.date(2024, 1, 1), "semgrep", "s", 2,
            '{"results": [{}]}'), ("r", "1", dt.date(2024, 1, 1), "hadolint", "Dockerfile", 3, "[{}]")]
    raw = spark.createDataFrame(rows, "repo string, run_id string, run_date date, scanner string, source_path string, "
                                      "report_seq bigint, payload string")
    f, _ = normalize(raw, scanners=["gitleaks", "semgrep", "hadolint"])
    fps = [r["fingerprint"] for r in f.collect()]
    assert len(fps) == 3 and all(fp and len(fp) == 16 for fp in fps)


def test_store_query_pushes_filters_to_snapshot(spark, tmpdir_path):
    from scanledger.operators.store import SnapshotStore, query_findings
    from scanledger.sources import fixtures as fx

    f = fx.events_findings(spark, "/root/testdata/sf0.001")
    state = lc.replay(f, fx.events_scans(f)).drop("resolved_on")
    store = SnapshotStore(spark, os.path.join(tmpdir_path, "store"), partitions=4)
    v = store.commit(state)
    assert store.latest_version() == v == 1
    q = query_findings(store.read(), repo="org/repo-1", severity="critical", status="open")
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        q.explain("formatted")
    plan = [ln for ln in buf.getvalue().splitlines() if ln.startswith("PushedFilters")][0]
    for pred in ("EqualTo(repo,org/repo-1)", "EqualTo(severity,CRITICAL)", "EqualTo(status,open)"):
        assert pred in plan, pred
    expect = state.filter("repo = 'org/repo-1' AND severity = 'CRITICAL' AND status = 'open'").count()
    assert q.count() == expect
    v2 = store.commit(state.filter("status = 'open'"))
    assert v2 == 2 and store.read().count() == state.filter("status = 'open'").count()
