"""The language model against a plain version: one token at a time, words as strings, no batches of numpy."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest

from scanledger.llm import maxent_lm as M
from tests.llm.test_text_operators import docs

MASK = (1 << 64) - 1


def mix(x):
    x &= MASK
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & MASK
    return x ^ (x >> 29)


class Plain:
    """The model's probability of one word after a list of words, read from its weights."""

    def __init__(self, model, train):
        self.model, self.counts = model, collections.Counter(w for t in train for w in t)
        best = sorted((w for w in self.counts if w), key=lambda w: (-self.counts[w], self.hash(w)))
        self.own = {w: r % 32 * 32 + r // 32 for r, w in enumerate(best[: 32 * 16 - 1], 1)} | {"": 0}
        self.members = collections.defaultdict(set)
        for w in self.counts:
            self.members[self.leaf(w)].add(w)
        self.total = [sum(self.counts[w] for w in self.members[k]) for k in range(1024)]

    @staticmethod
    def hash(word):
        return int(M.END) if not word else int(M.tokens([word.encode()])[0][0])

    def leaf(self, word):
        if word in self.own:
            return self.own[word]
        b = word.encode()
        two = lambda x: x[0] * 256 + (x[1] if len(x) > 1 else 0)
        part = lambda x: mix((two(x) + 1) * int(M._SEEDS[1])) >> 32
        return part(b[::-1]) % 32 * 32 + 16 + part(b) % 16

    def softmax(self, level, shares, raw):
        table = self.model.weights[level]
        sums = [math.log(x / sum(shares)) for x in shares]
        for x in raw:
            sums = [s + float(w) for s, w in zip(sums, table[(x >> 32) * len(table) >> 32], strict=True)]
        z = sum(math.exp(s) for s in sums)
        return [math.exp(s) / z for s in sums]

    def leaves(self, before):
        """Probability of each leaf after the words ``before``."""
        a, b, c = ([0, 0, 0] + [self.hash(w) for w in before])[:-4:-1]
        s = [int(x) for x in M._SEEDS]
        raw = [mix(a * s[0]), mix(a * s[0] + mix(b * s[1]) + s[3]), mix(b * s[2] + s[1]), mix(c * s[3] + s[2])]
        share = [t + 0.1 for t in self.total]
        classes = self.softmax(0, [sum(share[k * 32 : k * 32 + 32]) for k in range(32)], raw)
        return [p * q for k, p in enumerate(classes) for q in self.softmax(1, share[k * 32 : k * 32 + 32], [mix(x + k * s[2]) for x in raw])]

    def inside(self, word, leaf):
        return (self.counts[word] + 0.1) / (self.total[leaf] + 0.1 * (len(self.members[leaf]) + 1))

    def score(self, words):
        return sum(math.log10(self.leaves(words[:i])[k := self.leaf(w)] * self.inside(w, k)) for i, w in enumerate(words))


@pytest.fixture(scope="module")
def scored(spark):
    """Two languages of which each goes in pairs, held-out texts of both with unseen words; frequent words few."""
    rng = random.Random(11)
    tongues = [[f"{a}{b}{c}" for a in s for b in "aeiou" for c in s] for s in ("bdg", "ptk", "lmnéß")]
    rows = []
    for i in range(240):
        words, out = tongues[i % 3], []
        while len(out) < 30:
            w = rng.choice(words)
            out += [w, words[(words.index(w) * 7 + 1) % len(words)]]
        rows.append((i, " ".join(out) + (f" New{i}" if i % 10 == 0 else "")))
    rows += [(240, None), (241, " \t"), (250, "x"), (250, "x"), (None, "pap pap"), (260, "word " * 40)]
    kept = []
    plain_train = M.train

    def train(*args):
        kept.append(plain_train(*args))
        return kept[-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(M, "train", train)
        patch.setattr(M, "FREQUENT", 60)
        patch.setattr(M, "BATCH", 512)
        d = docs(spark, rows)
        got = M.score_texts(d, d["doc_id"] % 10 == 0).collect()
    texts = [(i, (t or "").lower().split() + [""]) for i, t in rows]
    # with FREQUENT words in the table only these can have leaves of their own
    model = kept[0]
    plain = Plain(model, [w for i, w in texts if i is None or i % 10])
    owned = {int(h): int(k) for h, k in zip(model.hashes, model.leaves, strict=True)}
    plain.own = {w: k for w, k in plain.own.items() if owned.get(plain.hash(w)) == k or not w}
    plain.members = collections.defaultdict(set)
    for w in plain.counts:
        plain.members[plain.leaf(w)].add(w)
    plain.total = [sum(plain.counts[w] for w in plain.members[k]) for k in range(1024)]
    return got, texts, plain


def test_scores_equal_a_plain_version(scored):
    got, texts, plain = scored
    seen = collections.defaultdict(list)
    for r in got:
        seen[r["doc_id"]].append(r["score"])
    assert len(got) == len(texts) and any(np.any(w) for w in plain.model.weights)
    for i, words in texts[::5] + texts[-6:]:
        assert all(math.isclose(x, plain.score(words), abs_tol=2e-4) for x in seen[i])


def test_probabilities_of_all_words_add_up(scored):
    _, texts, plain = scored
    for before in ([], texts[0][1][:1], texts[1][1][:2], texts[2][1][:9], ["unseen", "words", "here"]):
        leaves = plain.leaves(before)
        words = [(w, plain.leaf(w)) for w in plain.counts] + [("never seen", k) for k in range(1024)]
        assert math.isclose(sum(leaves[k] * plain.inside(w, k) for w, k in words), 1, abs_tol=1e-6)


def test_context_tells_held_out_words(scored):
    got, _, _ = scored
    held = [r for r in got if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert gain > 0.3


def test_sums_by_slot():
    rng = np.random.default_rng(2)
    for tokens, n in ((1, 1), (7, 2), (500, 3), (500, 4000)):
        slots, grad = rng.integers(0, n, (tokens, 4)).astype(np.int32), rng.standard_normal((tokens, 5)).astype(np.float32)
        want = np.zeros((n, 5))
        for k in range(4):
            np.add.at(want, slots[:, k], grad)
        at, seen, sums = M.sums_by_slot(slots, grad)
        assert np.allclose(sums, want[at], atol=1e-4) and sorted(at) == sorted(set(slots.ravel()))
        assert (seen == np.bincount(slots.ravel(), minlength=n)[at]).all()


def test_the_model_grows_with_the_training_tokens(spark):
    counts = lambda n: spark.createDataFrame([(5, 40, n)], "hash long, leaf int, n long")
    sizes = [len(M.Model(counts(n)).weights[0]) for n in (1, 1 << 25, 1 << 26, 1 << 40)]
    assert sizes == [1 << 14, 1 << 16, 1 << 17, 1 << 18]


def test_sums_of_runs_longer_than_pieces_of_pieces():
    rng = np.random.default_rng(3)
    lengths = [1, 2, M.PIECE, M.PIECE + 1, M.PIECE**2, M.PIECE**2 + 1, 2 * M.PIECE**3 + 5, *([1] * M.BLOCK), *([3] * M.BLOCK)]
    rows = rng.integers(0, 400, sum(lengths))
    source = rng.standard_normal((400, 6)).astype(np.float32)
    begin = np.cumsum([0, *lengths[:-1]])
    order, sums = M.run_sums(source, rows, begin, np.array(lengths))
    assert sorted(order) == list(range(len(lengths))) and sums.dtype == np.float32
    for i, got in zip(order, sums, strict=True):
        assert np.allclose(got, source[rows[begin[i] : begin[i] + lengths[i]]].astype(np.float64).sum(0), atol=2e-3)


def test_exponentials_need_room_for_one_block_only(monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 64)
    rng = np.random.default_rng(4)
    n = 300
    weights, base = rng.standard_normal((50, 8)).astype(np.float32) * 30, rng.standard_normal((5, 8)).astype(np.float32)
    row, slots, outcome = rng.integers(0, 5, n), rng.integers(0, 50, (4, n)), rng.integers(0, 8, n)
    logs = base[row].astype(np.float64) + sum(weights[s].astype(np.float64) for s in slots)
    want = logs[np.arange(n), outcome] - np.log(np.exp(logs - logs.max(1, keepdims=True)).sum(1)) - logs.max(1)
    for lines in (n, 64):
        total, own = M.exponentials(weights, base, row, slots, outcome, np.empty((lines, 8), np.float32))
        assert np.allclose(own - np.log(total), want, atol=1e-3)
