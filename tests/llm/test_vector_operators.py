"""Vector operators against brute force; edge cases of each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanledger.llm import impact_search, itq_dedup
from scanledger.llm import common as C

SCHEMA = "vec_id long, embedding array<double>, label int, code long, block string"


def vectors(spark, x, extra=()):
    rows = [(i, v if v is None else [y if y is None else float(y) for y in v], 0, 1, "b") for i, v in [*enumerate(x), *extra]]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] * 16), (1005, [float("inf")] + [0.0] * 15), (1006, [1.0, 2.0])]


def clouds(seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(400, 16))
    x[100:180] = x[0] + 0.05 * rng.normal(size=(80, 16))
    x[180:200] = x[180] + 0.12 * rng.normal(size=(20, 16))
    x[200:205] = x[200] * np.arange(1, 6)[:, None]
    return x


@pytest.mark.parametrize("block", [7, 1024])
def test_near_dedup_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(itq_dedup, "BLOCK", block)
    x = clouds()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    label = C.merge(np.arange(len(x)), *np.nonzero(links))
    got = {r["vec_id"]: r for r in itq_dedup.near_dedup(vectors(spark, x, ODD)).collect()}
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= links.sum(1)).all() and found.sum() >= 0.9 * links.sum() > 0
    assert np.mean([got[i]["component_id"] == label[i] for i in range(len(x))]) >= 0.97
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i, _ in ODD)
    assert itq_dedup.near_dedup(vectors(spark, [])).collect() == []


def test_copies_are_collapsed_and_cells_are_bounded(spark, monkeypatch):
    rng, whole = np.random.default_rng(4), itq_dedup._block

    def bounded(tab, home, looking, *rest):
        assert home.num_rows <= 4 * 7 and looking.num_rows <= 32 * 7, (home.num_rows, looking.num_rows)
        return whole(tab, home, looking, *rest)

    monkeypatch.setattr(itq_dedup, "BLOCK", 7)
    monkeypatch.setattr(itq_dedup, "_block", bounded)
    x = rng.normal(size=(900, 16))
    x[100:500] = x[100]  # equal
    x[500:900] = x[500] + 1e-6 * rng.normal(size=(400, 16))  # all but equal
    ids = np.arange(900)
    ids[101], ids[102] = 100, 0  # one id twice with one vector; one id with two vectors
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.95) & ~np.eye(900, dtype=bool)
    label = C.merge(np.arange(900), *np.nonzero(linked))
    want = sorted((int(ids[i]), int(linked[i].sum()), int(ids[label == label[i]].min())) for i in range(900))
    d = spark.createDataFrame([(int(i), [float(y) for y in v], 0, 1, "b") for i, v in zip(ids, x, strict=True)], SCHEMA)
    got = itq_dedup.near_dedup(d).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want


def test_components_by_vector_not_by_id(spark):
    """Null and repeated ids join no vectors at right angles; equal vectors of one id link."""
    rows = [(1, [1.0, 0.0]), (None, [1.0, 0.01]), (None, [0.01, 1.0]), (2, [0.0, 1.0]), (7, [-1.0, 0.0]), (7, [-1.0, 0.0]), (7, [0.0, -1.0])]
    d = spark.createDataFrame([(i, v, 0, 1, "b") for i, v in rows], SCHEMA)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in itq_dedup.near_dedup(d).collect()), key=repr)
    assert got == sorted([(1, 1, 1), (None, 1, 1), (None, 1, 2), (2, 1, 2), (7, 1, 7), (7, 1, 7), (7, 0, 7)], key=repr)


@pytest.mark.parametrize("rows", [10, 10**4, 10**6, 10**9])
def test_tables_cover_the_code_once_and_find_pairs_within_seven_bits(rows):
    cuts, radius = itq_dedup.tables(rows)
    assert [a for a, _ in cuts] == [0, *np.cumsum([n for _, n in cuts])[:-1]] and sum(n for _, n in cuts) == 64
    assert len(cuts) * (radius + 1) - 1 >= 7


@pytest.mark.parametrize("block,group", [(50, 3), (4096, 1024)])
def test_top_k_equals_brute_force(spark, monkeypatch, block, group):
    monkeypatch.setattr(impact_search, "BLOCK", block)
    monkeypatch.setattr(impact_search, "QUERIES", group)
    x = np.r_[clouds(), np.round(clouds(5)[:40], 0)]  # many ties
    q = np.floor(1024 * x).astype(np.int64)
    scores = q @ q.T
    d = vectors(spark, x, [*ODD, (2000, list(x[3])), (2000, list(x[3]))])
    got = {}
    for r in impact_search.top_k(d.where("vec_id < 1000"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for i in range(0, len(x), 20):
        best = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-scores[i, j], j))[:10]
        assert [got[i][k] for k in range(1, 11)] == [(j, scores[i, j]) for j in best]
    few = impact_search.top_k(d.where("vec_id >= 1000"), F.col("vec_id") == 2000).collect()
    assert few == [] or {r["vec_id"] for r in few} <= {1002}
    assert impact_search.top_k(vectors(spark, []), F.col("vec_id") == 0).collect() == []


def test_top_k_scores_of_large_components(spark):
    x = [[1.0, -2.0], [3e6, 5.0], [4e6, 2.5e6], [-7e9, 1e9], [2e12, 1.0]] + [[float(i), 0.5] for i in range(12)]
    q = [[int(1024 * v) for v in r] for r in x]
    got = {r["vec_id"]: r["score"] for r in impact_search.top_k(vectors(spark, x), F.col("vec_id") == 0, k=20).collect()}
    assert got == {i: sum(a * b for a, b in zip(q[0], v, strict=True)) for i, v in enumerate(q) if i}
