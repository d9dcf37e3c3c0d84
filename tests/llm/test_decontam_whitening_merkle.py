"""Decontamination, whitening and the Merkle manifest against brute force; edge cases of each."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanledger.llm import decontamination, merkle_manifest, queries, whitening
from scanledger.plans.verify import compare, duck_connection

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, token long, unit long, item string, x int"


def docs(spark, rows):
    """Rows (doc_id, text[, source[, lang]]) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", 5, 0, 0, 0, "i", 1) for r in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(i, t, 0, "d") for i, t in rows], "item_id long, text string, row long, phrase string")


@pytest.mark.parametrize("name", ["op11_prefix_decontamination", "op13_merkle_manifest"])
def test_equals_sql(spark, name):
    ok, said = compare(spark, duck_connection(SF), queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ok, said


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(documents, benchmark, size=10):
    windows = {}
    for item, text in benchmark:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in documents:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i : i + n]))
                if own:
                    found |= own
                    hit |= set(range(i, i + n))
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def contaminated_corpus(seed=1):
    rng = random.Random(seed)
    common, rare = ["the", "of", "a", "añb"], [f"r{i}" for i in range(300)]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(n)]
    benchmark = [(i, " ".join(prose(rng.choice([3, 9, 10, 11, 25])))) for i in range(30)]
    benchmark += [(2, "the"), (40, "The  of"), (41, ""), (42, None), (None, "a a a a a a a a a a a a"), (43, benchmark[0][1]), (43, "x-y_z!9"), (44, "the " * 14)]
    documents = []
    for i in range(60):
        w = prose(rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            own = words(rng.choice(benchmark)[1])
            cut = own[rng.randint(0, 3) :]
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() for x in cut]
        documents.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    documents += [(5, None), (None, "the of"), (None, "of the"), (7, " \t"), (8, documents[3][1]), (3, documents[3][1]), (9, "the " * 30), (10, "É" * 90 + " the " + "w" * 70)]
    return documents, benchmark


@pytest.mark.parametrize("broadcast", [True, False])
def test_contained_windows_equal_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontamination, "BROADCAST_PREFIXES", 0)
    documents, benchmark = contaminated_corpus()
    got = decontamination.contained(docs(spark, documents), items(spark, benchmark)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got), key=repr) == brute_hits(documents, benchmark)


def test_one_very_long_document_and_empty_tables(spark):
    text = "alpha beta gamma " * 120_000 + "one two three four five six seven eight nine ten eleven"
    bench = items(spark, [(1, "One two three four five six seven eight nine ten"), (2, "gamma alpha delta")])
    got = decontamination.contained(docs(spark, [(1, text), (2, "beta")]), bench).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 360_011, 10, ["1"]), (2, 1, 0, [])]
    assert decontamination.contained(docs(spark, []), bench).collect() == []
    none = decontamination.contained(docs(spark, [(1, "beta"), (1, None)]), items(spark, [])).collect()
    assert sorted(tuple(r) for r in none) == [(1, 0, 0, []), (1, 1, 0, [])]
    blank = decontamination.contained(docs(spark, [(1, "beta")]), items(spark, [(3, " - ")])).collect()
    assert [tuple(r) for r in blank] == [(1, 1, 0, [])]


VECTORS = "vec_id long, embedding array<double>, x long, id long, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [y if y is None else float(y) for y in v], 0, 0, "c") for i, v in rows], VECTORS)


def whitened_by_numpy(x, k):
    fit = np.unique(x, axis=0)
    z = fit - fit.mean(0)
    e, u = np.linalg.eigh(z.T @ z / len(fit))
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return len(fit), (x - fit.mean(0)) @ u / np.sqrt(e), e / np.trace(z.T @ z / len(fit))


@pytest.mark.parametrize("scale", [1.0, 3e5])
def test_whitening_equals_numpy(spark, scale):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 24)) * np.linspace(3, 0.5, 24) * scale
    v[250:] = v[3]
    rows = [*enumerate(v.tolist()), (7, v[9].tolist()), (None, v[10].tolist()), (900, None), (901, []), (902, [None] * 24), (903, [float("nan")] + [0.0] * 23), (904, [float("inf")] * 24), (905, [1.0, 2.0])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    used = rows[:302]
    x = np.floor(64 * np.array([r[1] for r in used])) + 1000000
    n, want, explained = whitened_by_numpy(x, 16)
    assert len(got) == 302 * 16 and {r["n"] for r in got} == {n} and {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-10
    sums = [int(s) for s in np.unique(x, axis=0).astype(object).sum(0)]
    deviations = sorted(sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x)
    assert sorted((r["deviation"] for r in got if r["component"] == 1), key=lambda d: d or 1 << 63) == [d if d < 1 << 63 else None for d in deviations]
    for c in range(16):
        own = [r for r in got if r["component"] == c + 1]
        assert abs(own[0]["explained"] / explained[c] - 1) < 1e-9
        for sign in (1, -1):
            a = sorted(zip([repr(r["id"]) for r in own], [round(r["whitened"], 6) for r in own], strict=True))
            b = sorted(zip([repr(r[0]) for r in used], np.round(sign * want[:, c], 6).tolist(), strict=True))
            if np.allclose([y for _, y in a], [y for _, y in b], atol=2e-6):
                break
        else:
            raise AssertionError(c)


def test_whitening_of_few_equal_or_no_vectors(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)])).collect()
    assert {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12
    assert sorted(round(r["whitened"] ** 2, 6) for r in line) == [0.085714] * 2 + [0.771429] * 2 + [2.142857] * 2
    one = whitening.whiten(vectors(spark, [(1, [1.0]), (2, [2.0])])).collect()
    assert sorted(r["whitened"] for r in one) == [-1.0, 1.0]


def test_eigenvectors_of_clusters_and_large_integers():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    for spectrum in (np.r_[[5.0] * 6, [4.999999999] * 3, np.linspace(3, 0.1, 31)], np.r_[1e9, np.linspace(1, 0.5, 39)], np.ones(40), 10.0 ** -np.arange(40.0)):
        a = (q * spectrum) @ q.T
        values, vectors_ = whitening.components((a + a.T) / 2, 16)
        want = np.sort(spectrum)[::-1][: len(values)]
        assert np.allclose(values, want, rtol=1e-6, atol=1e-13 * want[0])
        assert np.abs(vectors_ @ vectors_.T - np.eye(len(values))).max() < 1e-10
        assert np.abs(a @ vectors_.T - vectors_.T * values).max() < 1e-13 * 40 * want[0]
    z = rng.integers(-(1 << 61), 1 << 61, (50, 3))
    held = {}
    for part in np.split(z, 5):
        whitening.products(part, held)
    got = sum(m.astype(object) * (1 << (16 * p)) for p, m in held.items())
    assert (got == z.astype(object).T @ z.astype(object)).all()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, text, source, lang, n_chars)."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(part, (r[0], r[2], r[3], r[4], text))))

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
            for i, p in enumerate(at):
                run = runs[p // 3]
                paths[i].append((run[: p % 3], run[p % 3 + 1 :]))
                at[i] = p // 3
            nodes = [sha("".join(run)) for run in runs]
        return nodes[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in names}
    trees = {s: tree([leaf(r, r[1]) for r in below[s]]) for s in names}
    root, high = tree([trees[s][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for r, path in zip(below[s], trees[s][1], strict=True):
            path = path + high[i]
            text = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            folded = leaf(r, text)
            for left, right in path:
                folded = sha("".join(left) + folded + "".join(right))
            out.append((r[0], leaf(r, r[1]), trees[s][0], root, sha("".join("".join(a + b) for a, b in path)), folded, folded == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_equals_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    rng = random.Random(2)
    rows = []
    for source, n in (("hot", 83), (None, 28), ("é", 27), ("b", 1), ("", 2), ("z", 4), ("A", 10)):
        rows += [(rng.choice([i, i, -i]), rng.choice(["a\nb", "plain", "", None, "é\n" * 50]), source, rng.choice([None, "en"]), 5) for i in range(n)]
    rows += [(None, "x\ny", "hot", "en", 5), (None, "x", "hot", "en", 5), rows[0], rows[0]]
    d = docs(spark, [r[:4] for r in rows])
    got = merkle_manifest.manifest(d, picked=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_manifest(rows)


def test_manifest_of_one_row_and_none(spark):
    (one,) = merkle_manifest.manifest(docs(spark, [(3, "a\nb" * 200_000)]), picked=F.lit(True)).collect()
    assert one["leaf"] == one["subroot"] == one["root"] != one["folded_root"] and one["proof_sha256"] == sha("") and not one["verified"]
    assert merkle_manifest.manifest(docs(spark, [])).collect() == []
