"""Greedy packing equals a sequential pass, whatever the cells; no batch but a group's last is half empty."""

import random

import pytest

from scanledger.operators import packing, triage
from tests.conftest import make_findings


def brute(sizes, max_items, max_size):
    out, begin, used = [], 0, 0
    for i, s in enumerate(sizes):
        if i > begin and (i - begin == max_items or used + s > max_size):
            out.append((begin + 1, i - begin))
            begin, used = i, 0
        used += s
    return [*out, (begin + 1, len(sizes) - begin)] if sizes else []


@pytest.mark.parametrize("cell", [8, 4096])
def test_greedy_batches_equal_a_sequential_pass(spark, monkeypatch, cell):
    monkeypatch.setattr(packing, "CELL", cell)
    rng = random.Random(4)
    groups = {"hot": [rng.choice([1, 2, 3, 30, 90, 150]) for _ in range(150)], "even": [10] * 33, "one": [500], "huge": [200] * 9, None: [1] * 17}
    rows = [(g, i + 1, s) for g, sizes in groups.items() for i, s in enumerate(sizes)]
    got = packing.greedy_batches(spark.createDataFrame(rows, "grp string, position bigint, size bigint"), 7, 100).collect()
    for g, sizes in groups.items():
        own = sorted((r["batch"], r["first_position"], r["n_items"]) for r in got if r["grp"] == g)
        assert own == [(n, *x) for n, x in enumerate(brute(sizes, 7, 100), 1)], g


def test_cells_of_many_groups_share_a_call(spark, monkeypatch):
    calls, plain = [], packing._batches
    monkeypatch.setattr(packing, "_batches", lambda rows, *limits: calls.append(rows["grp"].nunique()) or plain(rows, *limits))
    rng = random.Random(9)
    items = {g: [rng.choice([1, 40, 99, 300]) for _ in range(rng.randint(1, 7))] for g in [f"g{i}" for i in range(60)] + ["", None]}
    frame = packing.pd.DataFrame([(g, 0, i + 1, s, False, 0, 0) for g, sizes in items.items() for i, s in enumerate(sizes)], columns=["grp", "cell", "position", "size", "ahead", "entry", "before"])
    got = packing._batches(frame.sample(frac=1, random_state=1), 3, 100)
    assert calls == [61]  # a call for each group before
    for g, sizes in items.items():
        own = got[got["grp"].isna() if g is None else got["grp"] == g].sort_values("batch")
        assert [tuple(x) for x in own[["batch", "first_position", "n_items"]].to_numpy().tolist()] == [(n, *x) for n, x in enumerate(brute(sizes, 3, 100), 1)]


def test_prefix_sums_break_ties_and_keep_every_row(spark):
    rows = [("a", i // 4, i % 3 + 1) for i in range(40)] + [(None, 5, 2), ("b", None, 1)]
    placed = packing.prefix_sums(spark.createDataFrame(rows, "g string, o int, s int"), "g", "o", packing.F.col("s")).collect()
    a = sorted((r["position"], r["offset"], r["o"], r["s"]) for r in placed if r["g"] == "a")
    assert [p for p, *_ in a] == list(range(1, 41)) and [o for _, _, o, _ in a] == sorted(o for _, _, o, _ in a)
    assert [x[1] for x in a] == [sum(y[3] for y in a[:i]) for i in range(40)]
    assert sorted((r["position"], r["offset"]) for r in placed if r["g"] != "a") == [(1, 0), (1, 0)]


def test_payloads_are_full_and_hold_every_finding_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 64)
    rng = random.Random(7)
    rows = [dict(repo="hot" if i % 5 else f"r{i % 15}", run_date="2024-01-01", ingest_seq=i, scanner="semgrep", severity="LOW",
                 title="t" * rng.randint(1, 1500), description="d") for i in range(300)]
    rows.append(dict(repo="hot", run_date="2024-01-01", ingest_seq=900, scanner="semgrep", severity="LOW", title="x" * 20000))
    out = triage.triage_batches(make_findings(spark, rows), 500, 12000).orderBy("repo", "batch").collect()
    last = {r["repo"]: r["batch"] for r in out}
    assert sum(r["n_findings"] for r in out) == 301
    for r in out:
        assert len(r["payload"]) <= 12000 or r["n_findings"] == 1
        assert len(r["payload"]) > 6000 or r["batch"] == last[r["repo"]] or out[out.index(r) + 1]["n_findings"] == 1
