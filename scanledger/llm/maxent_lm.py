"""LM scoring with a hashed maximum-entropy model and class-factored softmax.

P(word | context) = P(class | context) * P(member | class, context) * P(word | member). There are ``CLASSES`` classes of
``MEMBERS`` members each. ``OWN`` members of a class are single words: the end token and the most frequent words, dealt
over the classes by rank. Every other word is told by its spelling: its last two bytes give its class, its first two
one of the class's other members. The first two factors are softmaxes. Each starts from the logarithm of
the training share of its classes or members and adds the weights of hashed features of the context: the word before,
the two words before (n-gram), and, skipping, the second and the third word before; for members each feature is joined
with the class. P(word | member) are the smoothed counts within the member (0.1 a word, one unseen word): 1 but for the
unseen word if the member is a word of its own. Over all words and one unseen word a member these probabilities sum to 1.

1. Tasks count the words of all training documents; Spark adds the counts up by word hash (64 bits).
2. Training goes through all training documents once, in ``ROUNDS`` parts. In each, tasks start from the same weights
   and take AdaGrad steps over batches of their tokens. Of the rows they touched, they send weights and number of
   tokens, dealt by level and slot to the tasks that average them; a slot's mean is over those that touched it.
   The number of slots follows the training tokens (one for ``TOKENS_A_SLOT`` in each of the two tables, a power of two)
   up to ``MOST_SLOTS``, as the model is broadcast (16 MB a table at most); a training task takes text in proportion to
   the slots, so that what is sent stays in proportion to the input.
3. Scoring, in numpy batches: of each token only the rows of its own features are looked up. Tokens of the ``FREQUENT``
   most frequent words at most are looked up in a broadcast table; the other words of each document are joined with
   the counts.

Tokens: words of the text with A-Z lower-cased, then one end. The base score is the unigram score
sum log10((c + 0.1) / (N + 0.1 * (V + 1))).

Defined cases: a null or blank text is the end token alone; a null id is not held out; equal rows each give a row;
with nothing to learn from all counts are 0; an empty table gives an empty one; only the two named columns are read.
Weights depend on how the input is split, so scores of another cluster can differ slightly; counts and base scores do not.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanledger.llm import common as C

CLASSES, MEMBERS = 32, 32
OWN = 16
LEAVES = CLASSES * MEMBERS
TOKENS_A_SLOT = 512
LEAST_SLOTS, MOST_SLOTS = 1 << 14, 1 << 18
FREQUENT = 1 << 18
ROUNDS = 2
BATCH = 16384
#: Tokens (and slots) of a batch that are worked on at a time: their rows of weights stay in a core's cache.
BLOCK = 2048
#: Rows of a slot that are added one after the other.
PIECE = 16
RATE = 0.7
SMOOTH = 0.1
#: Distinct words that a counting task holds before it sends them.
HELD = 400_000
#: Slots that one task averages.
PART = 1 << 12
#: Bytes of text of a training task for each slot.
BYTES_A_SLOT = 512
#: Hash of the end token; before the first word stands 0.
END = np.uint64(xxhash.xxh3_64_intdigest(b""))
#: Slots in which frequent words are looked for first.
SLOT_BITS = 21
_SEEDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: Of two bytes as a number: the leaf of words that end in them, and the member of those that begin with them.
_TWO = (C.mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * _SEEDS[1]) >> np.uint64(32)).astype(np.int64)
_BY_LAST, _BY_FIRST = (x.astype(np.int16) for x in (_TWO % CLASSES * MEMBERS + OWN, _TWO % (MEMBERS - OWN)))


def spelled(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Leaf (class * MEMBERS + member) of words by their first and last two bytes."""
    return _BY_LAST[last] + _BY_FIRST[first]


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, leaf by spelling, text and place in its text of each token, the end token (leaf 0) of each text included."""
    joined, begin, end, h, text = C.word_spans([t.lower() for t in texts])
    raw = np.frombuffer(joined, np.uint8)
    long = end - begin > 1
    first = raw[begin] * np.int64(256) + np.where(long, raw[np.minimum(begin + 1, len(raw) - 1)], 0)
    last = raw[end - 1] * np.int64(256) + np.where(long, raw[end - 2], 0)
    sizes = np.bincount(text, minlength=len(texts)) + 1
    n = len(h) + len(texts)
    hashes, leaves = np.full(n, END), np.zeros(n, np.int64)
    at = np.arange(len(h)) + text
    hashes[at], leaves[at] = h, spelled(first, last)
    of = np.repeat(np.arange(len(texts)), sizes)
    return hashes, leaves, of, np.arange(n) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes)


def _count(batches):
    """(hash, leaf, n): words of this task, sent in portions of bounded size."""
    schema = pa.schema([("hash", pa.int64()), ("leaf", pa.int32()), ("n", pa.int64())])
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged():
        h, e, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h)
        at, _ = C.runs(h[order])
        return h[order][at], e[order][at], np.add.reduceat(n[order], at) if len(at) else n

    for batch in batches:
        for _, _, texts in _groups(batch):
            h, e, _, _ = tokens(texts)
            parts.append((h, e, np.ones(len(h), np.int64)))
            if len(parts) == 4 or sum(len(x[0]) for x in parts) > 2 * HELD:
                parts[:] = [merged()]
                if len(parts[0][0]) > HELD:
                    h, e, n = parts.pop()
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(e.astype(np.int32)), pa.array(n)], schema=schema)
    if parts:
        h, e, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(e.astype(np.int32)), pa.array(n)], schema=schema)


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(C.task(_count), "hash long, leaf int, n long")
    return C.stash(rows.groupBy("hash", "leaf").agg(F.sum("n").alias("n")))


class Model:
    """What tasks need: frequent words with count and leaf, the leaves' totals, base measures and the weights."""

    def __init__(self, counts: DataFrame):
        by = counts.groupBy("leaf").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # LEAVES rows at most
        total, words = np.zeros(LEAVES), np.zeros(LEAVES)
        for r in by:
            total[r["leaf"]], words[r["leaf"]] = r["n"], r["v"]
        self.tokens, self.vocabulary = int(total.sum()), int(words.sum())
        # the lowest count, on a scale of eighths of powers of two, that at most FREQUENT words reach
        scale = F.floor(F.log2("n") * 8).cast("int")
        level, room, kept = 0, FREQUENT, False
        for r in sorted(counts.groupBy(scale.alias("level")).count().collect(), key=lambda r: -r["level"]):
            if r["count"] > room:
                break
            room, level, kept = room - r["count"], r["level"], True
        rows = counts.where(scale >= level).collect() if kept else []
        hashes = np.array([r["hash"] for r in rows], np.int64).view(np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.counts = np.array([r["n"] for r in rows], np.float64)[order]
        self.leaves = np.array([r["leaf"] for r in rows], np.int64)[order]
        best = np.lexsort((self.hashes, -self.counts))
        for rank, i in enumerate(best[self.hashes[best] != END][: CLASSES * OWN - 1].tolist(), 1):  # rank 0 is the end
            total[self.leaves[i]] -= self.counts[i]
            words[self.leaves[i]] -= 1
            self.leaves[i] = leaf = rank % CLASSES * MEMBERS + rank // CLASSES
            total[leaf], words[leaf] = self.counts[i], 1
        self.slots = np.full(1 << SLOT_BITS, len(self.hashes), np.int32)
        self.slots[(self.hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = np.arange(len(self.hashes))
        self.log_count = np.log10(self.counts + SMOOTH)
        self.log_leaf = np.log10(total + SMOOTH * (words + 1))
        share = (total + SMOOTH).reshape(CLASSES, MEMBERS)
        self.base = [np.log(share.sum(1, keepdims=True).T / share.sum()).astype(np.float32), np.log(share / share.sum(1, keepdims=True)).astype(np.float32)]
        n = 1 << max(0, math.ceil(math.log2(max(1, self.tokens / TOKENS_A_SLOT))))
        self.weights = [np.zeros((min(MOST_SLOTS, max(LEAST_SLOTS, n)), k), np.float16) for k in (CLASSES, MEMBERS)]


def tokens_of(texts: list[bytes], m: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts joined: hash, place among the frequent words (-1 for others), leaf, text and the three words before of each token."""
    h, spelt, text, offset = tokens(texts)
    frequent = np.r_[m["hashes"], np.uint64(0)]
    place = m["slots"][(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.int64)
    other = np.flatnonzero(frequent[place] != h)  # rare words, and the few frequent ones that share a slot
    found = np.searchsorted(m["hashes"], h[other])
    place[other] = np.where((found < len(m["hashes"])) & (frequent[found] == h[other]), found, -1)
    leaves = np.where(place >= 0, np.r_[m["leaves"], 0][place], spelt)
    before = []
    for k in (1, 2, 3):
        b = np.zeros(len(h), np.uint64)
        b[k:] = h[:-k]
        b[offset < k] = 0
        before.append(b)
    return h, place, leaves, np.stack(before), text


def levels(before: np.ndarray, leaves: np.ndarray, n: int):
    """For class and member: the row of the base measure, the ``n`` slots' numbers of each feature (a line each), and the outcome."""
    one, two, three = before
    first = one * _SEEDS[0]
    features = _mix(np.stack([first, first + C.mix(two * _SEEDS[1]) + _SEEDS[3], two * _SEEDS[2] + _SEEDS[1], three * _SEEDS[3] + _SEEDS[2]]))
    cls = leaves // MEMBERS
    joined = features + cls.astype(np.uint64) * _SEEDS[2]
    yield np.zeros(len(cls), np.int64), _slot(features, n), cls
    yield cls, _slot(_mix(joined), n), leaves % MEMBERS


def _mix(x: np.ndarray) -> np.ndarray:
    """``C.mix`` in place."""
    high = x >> np.uint64(31)
    x ^= high
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, np.uint64(29), out=high)
    return x


def _slot(x: np.ndarray, n: int) -> np.ndarray:
    """Slot of ``n`` of each hash, from its high bits; ``x`` is overwritten."""
    x >>= np.uint64(32)
    x *= np.uint64(n)
    x >>= np.uint64(32)
    return x.view(np.int64)


def exponentials(weights: np.ndarray, base: np.ndarray, row: np.ndarray, slots: np.ndarray, outcome: np.ndarray, out: np.ndarray):
    """The exponentials of the base measure's logarithms plus the features' weights, their sums, and the outcomes' logarithms.

    They are worked out ``BLOCK`` tokens at a time, which stay in the cache, in ``out``; if that has one block's lines
    only, each block overwrites the one before it.
    Rows of weights add up to 0, so no row can be small as a whole; great ones are lessened by their largest entry.
    """
    n = len(outcome)
    total, own = np.empty(n, np.float32), np.empty(n, np.float32)
    ones, held, lines = np.ones(out.shape[1], np.float32), np.empty((min(n, BLOCK), out.shape[1]), np.float32), np.arange(min(n, BLOCK))
    for i in range(0, n, BLOCK):
        s = slice(i, min(n, i + BLOCK))
        k = s.stop - i
        x, more = out[s] if len(out) >= n else out[:k], held[:k]
        base.take(row[s], 0, out=x, mode="clip")
        for slot in slots:
            x += weights.take(slot[s], 0, out=more, mode="clip")
        if x.max() > 60:
            x -= x.max(1, keepdims=True)
        own[s] = x[lines[:k], outcome[s]]
        np.exp(x, out=x)
        np.dot(x, ones, out=total[s])
    return total, own


def sums_by_slot(slots: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct slots, their number of tokens, and the sum of the gradients of their tokens.

    Slot and token are sorted as one number, so that tokens of a slot lie side by side.
    """
    bits = len(slots).bit_length()
    small = bits + int(slots.max(initial=0)).bit_length() <= 32  # sorted in half the time
    packed = (slots.T.astype(np.int64) << bits | np.arange(len(slots))).ravel()
    packed = np.sort(packed.astype(np.uint32) if small else packed)
    keys, rows = packed >> bits, (packed & ((1 << bits) - 1)).astype(np.int64)
    begin, length = C.runs(keys)
    order, sums = run_sums(grad, rows, begin, length)
    return keys[begin[order]].astype(np.int64), length[order], sums


def run_sums(source: np.ndarray, rows: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs, in an order of falling length, and the sum of each: ``length`` rows of ``source`` from ``rows[begin]`` on.

    In that order all runs of a block add their next rows at once. Runs of over ``PIECE`` rows are summed in pieces, and
    these like rows.
    """
    order = np.argsort(np.minimum(length, PIECE + 1).astype(np.uint8), kind="stable")[::-1]
    begin, length = begin[order], length[order]
    sums, held = np.empty((len(order), source.shape[1]), source.dtype), np.empty((BLOCK, source.shape[1]), source.dtype)
    n = np.count_nonzero(length > PIECE)
    if n:
        pieces = -(-length[:n] // PIECE)
        first = np.cumsum(pieces) - pieces
        skipped = PIECE * (np.arange(pieces.sum()) - np.repeat(first, pieces))
        of, parts = run_sums(source, rows, np.repeat(begin[:n], pieces) + skipped, np.minimum(PIECE, np.repeat(length[:n], pieces) - skipped))
        place = np.empty_like(of)
        place[of] = np.arange(len(of))
        of, parts = run_sums(parts, place, first, pieces)
        sums[of] = parts
    for i in range(n, len(order), BLOCK):
        at, left, out = begin[i : i + BLOCK], length[i : i + BLOCK], sums[i : i + BLOCK]
        source.take(rows[at], 0, out=out, mode="clip")
        for k in range(1, left[0]):
            m = np.count_nonzero(left > k)
            out[:m] += source.take(rows[at[:m] + k], 0, out=held[:m], mode="clip")
    return order, sums


def _groups(batch: pa.RecordBatch, n_bytes: int = 2 << 20):
    texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= n_bytes or i == len(texts) - 1:
            yield begin, i + 1, texts[begin : i + 1]
            begin, held = i + 1, 0


_ROWS = pa.schema([("part", pa.int32()), ("slots", pa.binary()), ("tokens", pa.binary()), ("weights", pa.binary())])
_ROWS_DDL = "part int, slots binary, tokens binary, weights binary"


class Learner:
    """One task's copy of a table of weights."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights.astype(np.float32)
        self.squares = np.full(len(weights), 1e-2, np.float32)
        self.seen = np.zeros(len(weights), np.int64)
        self.grad = np.empty((0, weights.shape[1]), np.float32)

    def step(self, base: np.ndarray, row: np.ndarray, slots: np.ndarray, outcome: np.ndarray) -> None:
        """An AdaGrad step, with one rate a slot, on one batch of tokens."""
        if len(self.grad) < len(outcome):
            self.grad = np.empty((len(outcome), self.weights.shape[1]), np.float32)
        grad = self.grad[: len(outcome)]
        total, _ = exponentials(self.weights, base, row, slots, outcome, grad)
        grad *= (1 / total)[:, None]
        grad[np.arange(len(outcome)), outcome] -= 1
        slots, n, sums = sums_by_slot(slots.T, grad)
        self.seen[slots] += n
        ones, held = np.ones(grad.shape[1], np.float32), np.empty((BLOCK, grad.shape[1]), np.float32)
        for i in range(0, len(slots), BLOCK):
            at, g = slots[i : i + BLOCK], sums[i : i + BLOCK]
            other = held[: len(at)]
            squares = self.squares[at] + np.multiply(g, g, out=other) @ ones
            self.squares[at] = squares
            g *= (-RATE / np.sqrt(squares))[:, None]
            g += self.weights.take(at, 0, out=other, mode="clip")
            self.weights[at] = g


def _train(batches, model):
    """The rows of this task's weights that its tokens touched, after AdaGrad steps, with their number of tokens."""
    m = model.value
    learners = [Learner(w) for w in m["weights"]]
    n = len(m["weights"][0])
    for batch in batches:
        for _, _, texts in _groups(batch):
            _, _, leaves, before, _ = tokens_of(texts, m)
            for i in range(0, len(leaves), BATCH):
                s = slice(i, i + BATCH)
                for learner, base, (row, slots, outcome) in zip(learners, m["base"], levels(before[:, s], leaves[s], n), strict=True):
                    learner.step(base, row, slots, outcome)
    for level, learner in enumerate(learners):
        for begin in range(0, n, PART):
            at = begin + np.flatnonzero(learner.seen[begin : begin + PART])
            if len(at):
                part = (level * n + begin) // PART
                yield C.arrow(_ROWS, [(part, at.astype(np.int32).tobytes(), learner.seen[at].tobytes(), learner.weights[at].astype(np.float16).tobytes())])


def _average(batches):
    """Means by tokens of the rows of each part, one part after the other as they come."""
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for i, part in enumerate(batch.column("part").to_pylist()):
            at, n = C.view(batch.column("slots"), i, np.int32) % PART, C.view(batch.column("tokens"), i, np.int64)
            rows = C.view(batch.column("weights"), i, np.float16).reshape(len(at), -1)
            total, seen = sums.setdefault(part, (np.zeros((PART, rows.shape[1])), np.zeros(PART)))
            total[at] += n[:, None] * rows.astype(np.float64)
            seen[at] += n
    for part, (total, seen) in sums.items():
        at = np.flatnonzero(seen)
        yield C.arrow(_ROWS, [(part, at.astype(np.int32).tobytes(), b"", (total[at] / seen[at][:, None]).astype(np.float16).tobytes())])


def train(docs: DataFrame, text_col: str, model: Model) -> Model:
    """One pass over ``docs`` in rounds."""
    rows = docs.select(F.col(text_col).alias("text"))
    spark = docs.sparkSession
    n = len(model.weights[0])
    tasks = C.parts_for(C.text_bytes(rows), BYTES_A_SLOT * n, least=6)
    for k in range(ROUNDS):
        told = spark.sparkContext.broadcast(vars(model))
        own = rows.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == k).coalesce(tasks)
        sent = own.mapInArrow(C.task(_train, model=told), _ROWS_DDL).repartitionById(2 * n // PART, "part")
        model.weights = [w.copy() for w in model.weights]
        means = sent.mapInArrow(C.task(_average), _ROWS_DDL).collect()  # 32 MB in all at most
        told.destroy()
        for r in means:
            level, begin = divmod(r["part"] * PART, n)
            at = begin + np.frombuffer(r["slots"], np.int32)
            model.weights[level][at] = np.frombuffer(r["weights"], np.float16).reshape(len(at), -1)
    return model


def log_context(m: dict, before: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """log10 P(class | context) + log10 P(member | class, context) of each token; ``weights`` in single precision."""
    out = np.zeros(len(leaves))
    rooms = [np.empty((min(len(leaves), BLOCK), w.shape[1]), np.float32) for w in m["weights"]]
    for i in range(0, len(leaves), BLOCK):
        s = slice(i, i + BLOCK)
        for weights, base, room, (row, slots, outcome) in zip(m["weights"], m["base"], rooms, levels(before[:, s], leaves[s], len(m["weights"][0])), strict=True):
            total, own = exponentials(weights, base, row, slots, outcome, room)
            out[s] += (own.astype(np.float64) - np.log(total)) / math.log(10)
    return out


_SCORED_DDL = "doc_id long, held_out boolean, n_tokens long, known long, log_counts double, context double, rare array<struct<hash:long,n:long>>"


def _score(batches, model):
    m = model.value | {"weights": [w.astype(np.float32) for w in model.value["weights"]]}
    rare_type = pa.list_(pa.struct([("hash", pa.int64()), ("n", pa.int64())]))
    for batch in batches:
        for begin, end, texts in _groups(batch):
            h, place, leaves, before, text = tokens_of(texts, m)
            context = log_context(m, before, leaves) - m["log_leaf"][leaves]
            n = len(texts)
            frequent = place >= 0
            sums = np.bincount(text[frequent], m["log_count"][place[frequent]], n)
            r_text, r_hash = text[~frequent], h[~frequent]
            order = np.lexsort((r_hash, r_text))
            r_text, r_hash = r_text[order], r_hash[order]
            at = np.flatnonzero(np.r_[True, (r_text[1:] != r_text[:-1]) | (r_hash[1:] != r_hash[:-1])]) if len(r_text) else np.zeros(0, np.int64)
            times = np.diff(np.r_[at, len(r_text)])
            offsets = np.searchsorted(r_text[at], np.arange(n + 1)).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(r_hash[at].view(np.int64)), pa.array(times)], fields=list(rare_type.value_type)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[begin:end], batch.column("held_out")[begin:end], pa.array(np.bincount(text, minlength=n)), pa.array(np.bincount(text[frequent], minlength=n)), pa.array(sums), pa.array(np.bincount(text, context, n)), rare], names=["doc_id", "held_out", "n_tokens", "known", "log_counts", "context", "rare"])


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); learns from rows that are not held out."""
    C.prepare(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    learn = d.where(~F.col("held_out")).select("text")
    counts = word_counts(learn, "text")
    model = train(learn, "text", Model(counts))
    told = d.sparkSession.sparkContext.broadcast(vars(model))
    scored = C.stash(d.mapInArrow(C.task(_score, model=told), _SCORED_DDL).withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode("rare").alias("w")).select("row", "w.hash", F.col("w.n").alias("times"))
    c = F.coalesce("n", F.lit(0))
    rare = rare.join(counts.select("hash", "n"), "hash", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(c + SMOOTH)).alias("rare_log"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    out = scored.drop("rare").join(rare, "row", "left")
    logs = F.col("log_counts") + F.coalesce("rare_log", F.lit(0.0))
    unit = math.log10(model.tokens + SMOOTH * (model.vocabulary + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * unit).alias("base_score"), (logs + F.col("context")).alias("score"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    return score_texts(C.table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
