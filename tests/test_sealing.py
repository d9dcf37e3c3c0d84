"""Sealed runs: summaries merge in any grouping, and ingest holds a flat number of sightings."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from scanledger.operators.lifecycle import STATE_COLUMNS, fold_sightings, replay
from scanledger.operators.scan_log import ScanLog, scan_records
from scanledger.operators.sealing import merge_summaries, sealable, summarise, summary_state, unsealed
from scanledger.operators.store import BucketedStore
from scanledger.operators.trends import trend_deltas
from scanledger.sources.reports import normalize
from scanledger.streaming import ingest
from scanledger.streaming.ingest import RAW_DDL, process_batch
from tests.conftest import make_findings
from tests.test_streaming import report

DAY = dt.date(2024, 1, 1)


def history(runs=12, seed=5):
    """Findings and scans of two repos over ``runs`` runs, some without findings."""
    rng = random.Random(seed)
    rows, scans, seq = [], [], 0
    for repo, keys in (("a", 9), ("b", 3)):
        for i in range(runs):
            if repo == "b" and i % 3 == 1:
                continue
            day = DAY + dt.timedelta(days=i)
            scans.append((repo, day))
            for k in range(keys):
                if i % 5 != 4 and rng.random() < 0.6:
                    for _ in range(rng.choice([1, 1, 2])):
                        seq += 1
                        rows.append(dict(repo=repo, run_date=str(day), ingest_seq=seq, scanner="semgrep", severity=rng.choice(["LOW", "HIGH"]), title=f"t{k}", description=f"d{seq}"))
    return rows, scans


def lines(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("cuts", [[], [6], [3, 4, 9]])
def test_summaries_of_any_stretches_merge_to_the_replay(spark, cuts):
    rows, scans = history()
    f, s = make_findings(spark, rows), spark.createDataFrame(scans, "repo string, run_date date")
    seen = fold_sightings(None, f, s).persist()
    bounds = [DAY, *(DAY + dt.timedelta(days=c) for c in cuts), DAY + dt.timedelta(days=99)]
    parts = [summarise(seen.where((F.col("run_date") >= a) & (F.col("run_date") < b))) for a, b in zip(bounds, bounds[1:], strict=False)]
    want = lines(replay(f, s))

    def write(df, n=[0]):
        n[0] += 1
        path = os.path.join(spark.sparkContext.getCheckpointDir(), f"sum-{len(cuts)}-{n[0]}-{random.random()}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    left = write(parts[0])
    for p in parts[1:]:
        left = write(merge_summaries(left, p))
    assert lines(summary_state(left)) == want
    if len(cuts) == 3:  # the other grouping
        assert lines(summary_state(merge_summaries(merge_summaries(parts[0], parts[1]), write(merge_summaries(parts[2], parts[3]))))) == want


def test_ingest_holds_open_runs_only_and_equals_the_replay(spark, tmpdir_path):
    """100 runs in 3 batches, neighbouring batches out of order: flat sightings, state as if replayed."""
    rng = random.Random(1)
    rows = []
    for i in range(100):
        day = (DAY + dt.timedelta(days=i)).isoformat()
        rows.append(report("r1", day, i + 1, [x for x in "abcdef" if rng.random() < 0.7]))
        rows[-1]["run_date"] = dt.date.fromisoformat(day)
    batches = [rows[:40], rows[40:70], rows[70:]]
    batches[1][-3:], batches[2][:3] = batches[2][:3], batches[1][-3:]  # within the open runs: nothing is sealed too early
    frame = lambda part: spark.createDataFrame([tuple(r.values()) for r in part], RAW_DDL)
    root, held = os.path.join(tmpdir_path, "store"), []
    for epoch, part in enumerate(batches):
        process_batch(spark, frame(part), epoch, root, n_buckets=2, open_runs=12)
        seen, sealed = (BucketedStore(spark, f"{root}/{t}", 2).read() for t in ("sightings", "summaries"))
        held.append(unsealed(seen, sealed).where("fingerprint is null").count())
        assert sealed is None or sealed.count() <= 7  # a row a key, and one for the repo
        assert seen.where("fingerprint is null").count() <= 12 + 40
    assert held == [12] * 3
    f, _ = normalize(frame(rows))
    want = lines(replay(f, frame(rows)).select(*STATE_COLUMNS))
    assert lines(BucketedStore(spark, root, 2).read().select(*STATE_COLUMNS)) == want

    # a report of a sealed run is kept aside and changes nothing
    late = report("r1", DAY.isoformat(), 1000, ["z"])
    late["run_date"] = DAY
    process_batch(spark, frame([late]), 3, root, n_buckets=2, open_runs=12)
    assert lines(BucketedStore(spark, root, 2).read().select(*STATE_COLUMNS)) == want
    kept = spark.read.parquet(f"{root}/late")
    assert [(r["title"], r["epoch"]) for r in kept.collect()] == [("Secret detected: z", 3)]


def test_a_failure_between_the_commits_counts_nothing_twice(spark, tmpdir_path, monkeypatch):
    rows = []
    for i in range(6):
        day = DAY + dt.timedelta(days=i)
        rows.append(report("r1", day.isoformat(), i + 1, ["a"] if i % 2 else ["a", "b"]))
        rows[-1]["run_date"] = day
    frame = lambda part: spark.createDataFrame([tuple(r.values()) for r in part], RAW_DDL)
    root = os.path.join(tmpdir_path, "store")
    process_batch(spark, frame(rows[:2]), 0, root, n_buckets=2, open_runs=2)
    whole = BucketedStore.commit

    def breaks_at(where):
        def commit(self, *a, **k):
            if self.root.endswith(where):
                raise RuntimeError("lost")
            return whole(self, *a, **k)

        return commit

    for where in ("summaries", "store"):
        monkeypatch.setattr(BucketedStore, "commit", breaks_at(where))
        with pytest.raises(RuntimeError):
            process_batch(spark, frame(rows[2:]), 1, root, n_buckets=2, open_runs=2)
    monkeypatch.setattr(BucketedStore, "commit", whole)
    assert process_batch(spark, frame(rows[2:]), 1, root, n_buckets=2, open_runs=2) is not None
    assert process_batch(spark, frame(rows[2:]), 1, root, n_buckets=2, open_runs=2) is None
    f, _ = normalize(frame(rows))
    assert lines(BucketedStore(spark, root, 2).read().select(*STATE_COLUMNS)) == lines(replay(f, frame(rows)).select(*STATE_COLUMNS))
    assert not os.path.exists(f"{root}/late")
    log = ScanLog(spark, f"{root}/scan_log").read()  # the epoch ran four times
    assert sorted((str(r["run_date"]), r["finding_count"], r["scanners"], r["epoch"]) for r in log.collect()) == [
        ((DAY + dt.timedelta(days=i)).isoformat(), 1 if i % 2 else 2, "gitleaks", 0 if i < 2 else 1) for i in range(6)
    ]


def test_sealable_leaves_the_newest_runs(spark):
    rows, scans = history()
    seen = fold_sightings(None, make_findings(spark, rows), spark.createDataFrame(scans, "repo string, run_date date"))
    old = sealable(seen, 3).select("repo", "run_date").distinct()
    left = {(r["repo"], r["run_date"]) for r in seen.select("repo", "run_date").distinct().collect()} - {tuple(r) for r in old.collect()}
    newest = lambda repo: sorted(d for r, d in scans if r == repo)[-3:]
    assert left == {(r, d) for r in "ab" for d in newest(r)}
    assert sealable(seen, 50).isEmpty()


def test_scan_records_and_an_empty_log(spark, tmpdir_path):
    at = dt.datetime(2024, 1, 1, 10)
    rows = [("r", DAY, "trivy", at, at + dt.timedelta(seconds=90)), ("r", DAY, "checkov", at + dt.timedelta(seconds=5), at + dt.timedelta(seconds=7)), ("empty", DAY, "semgrep", None, None)]
    scans = spark.createDataFrame(rows, "repo string, run_date date, scanner string, started timestamp, finished timestamp")
    f = make_findings(spark, [dict(repo="r", run_date="2024-01-01", ingest_seq=i, scanner="trivy", severity="LOW", title="t") for i in range(2)])
    records = scan_records(scans, f)
    assert sorted((r["repo"], r["duration_seconds"], r["finding_count"], r["scanners"]) for r in records.collect()) == [("empty", None, 0, "semgrep"), ("r", 90.0, 2, "checkov,trivy")]
    log = ScanLog(spark, os.path.join(tmpdir_path, "log"))
    assert log.read().collect() == []
    for _ in range(2):
        log.append(records, 7, "q")
    log.append(records, 7, "other")
    assert log.read().count() == 4


def test_trend_of_runs_without_findings(spark):
    days = [f"2024-01-0{i}" for i in range(1, 6)]
    seen = {days[0]: "ab", days[2]: "a", days[4]: "ab"}
    rows = [dict(repo="r", run_date=d, ingest_seq=i * 9 + j, scanner="s", severity="LOW", title=t) for i, d in enumerate(days) for j, t in enumerate(seen.get(d, ""))]
    scans = spark.createDataFrame([("r", dt.date.fromisoformat(d)) for d in days], "repo string, run_date date")
    got = trend_deltas(make_findings(spark, rows), scans).orderBy("run_no").collect()
    assert [tuple(r)[2:] for r in got] == [(1, 2, 2, 0, None, None, None), (2, 0, 0, 2, -2, -2, 2), (3, 1, 1, 0, 1, 1, -2), (4, 0, 1, 0, -1, 0, 0), (5, 2, 2, 0, 2, 1, 0)]


def test_default_open_runs_are_a_parameter():
    assert ingest.OPEN_RUNS >= 2
