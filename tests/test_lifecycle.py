"""Lifecycle: replay (closed form) == fold of merge_batch == a brute-force per-run simulator."""

import datetime as dt
import random

from pyspark.sql import functions as F

from scanledger.operators import lifecycle as lc
from tests.conftest import make_findings

D0 = dt.date(2024, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=7 * i)


def simulate(runs, resolve_reopened=False):
    """runs: list of (repo, date, [(fp_title, severity, desc), ...]) -> {(repo, title): row}.

    Mirrors the original per-finding upsert + mark-resolved loop, one run at a time.
    """
    resolvable = ("open", "reopened") if resolve_reopened else ("open",)
    store = {}
    for repo, date, fs in sorted(runs, key=lambda r: (r[0], r[1])):
        active = set()
        for title, sev, desc in fs:
            key = (repo, title)
            active.add(title)
            if key in store:
                row = store[key]
                row.update(last_seen=date, severity=sev, description=desc)
                if row["status"] == "resolved":
                    row["status"] = "reopened"
            else:
                store[key] = dict(first_seen=date, last_seen=date, severity=sev, description=desc, status="open")
        for (r, t), row in store.items():
            if r == repo and row["status"] in resolvable and t not in active:
                row["status"] = "resolved"
    return store


def random_histories(n_hist=30, seed=7):
    rng = random.Random(seed)
    runs = []
    for h in range(n_hist):
        repo = f"repo-{h}"
        for i in range(rng.randint(1, 6)):
            k = rng.choice([0, 0, 1, 2, 3, 4])  # zero-finding runs happen
            fs = [(f"t{rng.randint(0, 5)}", rng.choice(["CRITICAL", "HIGH", "LOW"]), f"d{rng.randint(0, 99)}") for _ in range(k)]
            runs.append((repo, day(i), fs))
    return runs


def to_frames(spark, runs):
    rows, seq = [], 0
    for repo, date, fs in runs:
        for title, sev, desc in fs:
            seq += 1
            rows.append(dict(repo=repo, run_date=date, ingest_seq=seq, scanner="semgrep", severity=sev,
                             title=title, description=desc))
    findings = make_findings(spark, rows)
    scans = spark.createDataFrame([(r, d) for r, d, _ in runs], "repo string, run_date date")
    return findings, scans


def state_dict(df):
    out = {}
    for r in df.collect():
        out[(r["repo"], r["title"])] = dict(first_seen=r["first_seen"], last_seen=r["last_seen"],
                                             severity=r["severity"], description=r["description"], status=r["status"])
    return out


def test_replay_matches_simulator(spark):
    runs = random_histories()
    findings, scans = to_frames(spark, runs)
    assert state_dict(lc.replay(findings, scans)) == simulate(runs)


def test_fold_of_merges_matches_simulator(spark):
    runs = random_histories(n_hist=12, seed=11)
    findings, scans = to_frames(spark, runs)
    state = None
    for i in sorted({d for _, d, _ in runs}):
        batch = findings.filter(F.col("run_date") == F.lit(i))
        bscans = scans.filter(F.col("run_date") == F.lit(i))
        state, _ = lc.merge_batch(state, batch, bscans)
        state = state.checkpoint()  # reliable checkpoint on the shared checkpoint dir cuts lineage
    assert state_dict(state) == simulate(runs)


def test_reopened_is_absorbing_and_resolved_once(spark):
    runs = [("r", day(0), [("a", "HIGH", "x")]), ("r", day(1), []), ("r", day(2), [("a", "HIGH", "y")]),
            ("r", day(3), [])]
    findings, scans = to_frames(spark, runs)
    st = lc.replay(findings, scans).collect()[0]
    assert st["status"] == "reopened" and st["resolved_on"] == day(1) and st["description"] == "y"
    deltas = {r["run_date"]: (r["new"], r["resolved"]) for r in lc.run_deltas(findings, scans).collect()}
    assert deltas == {day(0): (1, 0), day(1): (0, 1), day(2): (0, 0), day(3): (0, 0)}


def test_empty_run_resolves_all_open(spark):
    runs = [("r", day(0), [("a", "LOW", ""), ("b", "LOW", "")]), ("r", day(1), [])]
    findings, scans = to_frames(spark, runs)
    assert {r["status"] for r in lc.replay(findings, scans).collect()} == {"resolved"}


# ----- the dedup scenarios of the original tests, with merge_batch


def _batch(spark, titles, seq0=0, date=day(0), repo="r"):
    rows = [dict(repo=repo, run_date=date, ingest_seq=seq0 + i, scanner="gitleaks", severity="CRITICAL", title=t)
            for i, t in enumerate(titles)]
    f = make_findings(spark, rows)
    scans = spark.createDataFrame([(repo, date)], "repo string, run_date date")
    return f, scans


def test_first_run_all_new(spark):
    f, s = _batch(spark, ["Secret A", "SQLi B"])
    state, new = lc.merge_batch(None, f, s)
    assert new.count() == 2 and {r["status"] for r in state.collect()} == {"open"}


def test_second_run_nothing_new_then_added_then_resolved(spark):
    f1, s1 = _batch(spark, ["Secret A", "SQLi B"])
    state, _ = lc.merge_batch(None, f1, s1)
    f2, s2 = _batch(spark, ["Secret A", "SQLi B"], 10, day(1))
    state, new = lc.merge_batch(state, f2, s2)
    assert new.count() == 0
    f3, s3 = _batch(spark, ["Secret A", "SQLi B", "CVE-2024-NEW"], 20, day(2))
    state, new = lc.merge_batch(state, f3, s3)
    assert [r["title"] for r in new.collect()] == ["CVE-2024-NEW"]
    f4, s4 = _batch(spark, ["Secret A"], 30, day(3))
    state, new = lc.merge_batch(state, f4, s4)
    st = {r["title"]: r["status"] for r in state.collect()}
    assert st == {"Secret A": "open", "SQLi B": "resolved", "CVE-2024-NEW": "resolved"}


def test_suppressed_skipped_and_never_resolved(spark):
    f1, s1 = _batch(spark, ["Secret A", "SQLi B"])
    state, _ = lc.merge_batch(None, f1, s1)
    sup = state.filter(F.col("title") == "Secret A").select("repo", "fingerprint")
    state = lc.apply_suppressions(state, sup)
    f2, s2 = _batch(spark, ["Secret A"], 10, day(1))
    state2, emitted = lc.merge_batch(state, f2, s2, notify_new_only=False)
    assert emitted.count() == 0
    st = {r["title"]: (r["status"], r["last_seen"]) for r in state2.collect()}
    assert st["Secret A"] == ("suppressed", day(0))
    assert st["SQLi B"] == ("resolved", day(0))


def test_duplicates_in_batch_first_new_last_wins(spark):
    rows = [dict(repo="r", run_date=day(0), ingest_seq=i, scanner="s", severity=sev, title="t", description=d)
            for i, (sev, d) in enumerate([("LOW", "first"), ("HIGH", "second"), ("MEDIUM", "third")])]
    f = make_findings(spark, rows)
    s = spark.createDataFrame([("r", day(0))], "repo string, run_date date")
    state, new = lc.merge_batch(None, f, s)
    assert [r["ingest_seq"] for r in new.collect()] == [0]
    row = state.collect()[0]
    assert (row["severity"], row["description"]) == ("MEDIUM", "third")
    _, all_rows = lc.merge_batch(None, f, s, notify_new_only=False)
    assert all_rows.count() == 3


def test_state_keys_unique_and_seen_before_last(spark):
    runs = random_histories(n_hist=20, seed=3)
    findings, scans = to_frames(spark, runs)
    st = lc.replay(findings, scans)
    assert st.count() == st.select("repo", "fingerprint").distinct().count()
    assert st.filter(F.col("first_seen") > F.col("last_seen")).count() == 0


def test_merge_runs_onto_prefix_equals_full_replay(spark):
    runs = random_histories(n_hist=25, seed=21)
    findings, scans = to_frames(spark, runs)
    full = state_dict(lc.replay(findings, scans))
    for cut in (1, 2, 4):
        c = F.lit(day(cut))
        pre = lc.replay(findings.filter(F.col("run_date") < c), scans.filter(F.col("run_date") < c)).drop("resolved_on")
        post = lc.merge_runs(pre, findings.filter(F.col("run_date") >= c), scans.filter(F.col("run_date") >= c))
        assert state_dict(post) == full, cut


def test_resolve_reopened_option(spark):
    runs = random_histories(n_hist=30, seed=5)
    findings, scans = to_frames(spark, runs)
    assert state_dict(lc.replay(findings, scans, resolve_reopened=True)) == simulate(runs, resolve_reopened=True)
    state = None
    for i in sorted({d for _, d, _ in runs}):
        state, _ = lc.merge_batch(state, findings.filter(F.col("run_date") == F.lit(i)),
                                  scans.filter(F.col("run_date") == F.lit(i)), resolve_reopened=True)
        state = state.checkpoint()
    assert state_dict(state) == simulate(runs, resolve_reopened=True)


def test_scanner_scope_only_resolves_scanners_that_ran(spark):
    # run 2 only ran semgrep: the gitleaks finding must stay open under scope="scanner"
    rows = [dict(repo="r", run_date=day(0), ingest_seq=1, scanner="gitleaks", severity="CRITICAL", title="k"),
            dict(repo="r", run_date=day(0), ingest_seq=2, scanner="semgrep", severity="LOW", title="s"),
            dict(repo="r", run_date=day(1), ingest_seq=3, scanner="semgrep", severity="LOW", title="s2")]
    f = make_findings(spark, rows)
    scans = spark.createDataFrame([("r", "gitleaks", day(0)), ("r", "semgrep", day(0)), ("r", "semgrep", day(1))],
                                  "repo string, scanner string, run_date date")
    per_scanner = {r["title"]: r["status"] for r in lc.replay(f, scans, scope="scanner").collect()}
    assert per_scanner == {"k": "open", "s": "resolved", "s2": "open"}
    per_repo = {r["title"]: r["status"] for r in lc.replay(f, scans.select("repo", "run_date")).collect()}
    assert per_repo == {"k": "resolved", "s": "resolved", "s2": "open"}
    s0, _ = lc.merge_batch(None, f.filter(F.col("run_date") == F.lit(day(0))), scans.filter(F.col("run_date") == F.lit(day(0))),
                           scope="scanner")
    s1, _ = lc.merge_batch(s0, f.filter(F.col("run_date") == F.lit(day(1))), scans.filter(F.col("run_date") == F.lit(day(1))),
                           scope="scanner")
    assert {r["title"]: r["status"] for r in s1.collect()} == per_scanner
