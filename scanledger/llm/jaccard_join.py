"""N-gram Jaccard join, size-aware and heavy-light.

A document is the set of its distinct word 5-grams (lower-cased A-Z); two documents link when 100 * |intersection| >=
75 * |union|. Documents with equal sets form a class, and only classes are compared.

1. Repeats. Tasks hash every shingle; hashes are dealt to tasks that see which occur in two classes. A class can link
   only if 75 of 100 of its shingles occur elsewhere, which leaves few; two classes only if either has as many such
   shingles as a link between sets of their sizes needs. A shingle that many classes of one chunk share goes out once.
2. Small sets (up to a boundary): every subset of the fixed size that a link between sets of n and m shingles needs;
   sets that share one link by that alone.
3. Large sets scan inverted lists of the prefix (the first n - ceil(0.75 n) + 1 shingles, the heavy ones last), of
   all other sets. The boundary is the size up to which enumerating costs fewer rows than scanning the lists.
4. A list is compared with its most repeated member first (near copies of one text mostly meet in that member).
   Members that are then in one component need no further comparison; the others are compared with all members of
   other components in the lists with the same first member, block by block. Every pair is checked exactly with both
   sets. So no link between components is lost, and no list of near copies is expanded into all pairs.

Hashes have 64 bits (see substring_dedup). Defined cases: a null or blank text has an empty set and links with
nothing; fewer than 5 words are one shingle; a null id counts as the largest and comes back as null; rows are linked
by their sets alone, so rows that share an id, or have none, link no two texts; rows with equal texts or ids each give a row; an empty table gives an empty one; only the two named columns are read.
"""

from __future__ import annotations

import itertools
import math
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanledger.llm import common as C

#: Classes of one chunk that share a shingle before it goes out as a count.
HOT = 32
#: Sets in a block when those that are apart are compared with all members of their lists.
BLOCK = 128
#: Counters (a power of two) that tell heavy shingles from light ones; 8 MB are broadcast.
COUNTERS = 1 << 22
#: Parts in which the counters are added up.
COUNTER_PARTS = 16
#: Sizes for which enumerating subsets is considered.
MAX_SMALL = 10
#: Up to so many classes the ids of those that can link are broadcast (16 MB); above, they are joined.
BROADCAST_IDS = 1 << 20

_SENT = pa.schema([("pid", pa.int32()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("key", pa.int64()), ("key2", pa.int64()), ("n", pa.int64()), ("k", pa.int64()), ("keys", pa.binary()), ("lengths", pa.binary()), ("hashes", pa.binary()), ("hot", pa.binary())])
_SENT_DDL = "pid int, doc_id long, row_key long, key long, key2 long, n long, k long, keys binary, lengths binary, hashes binary, hot binary"
_TOLD = pa.schema([("pid", pa.int32()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("key", pa.int64()), ("key2", pa.int64()), ("n", pa.int64()), ("k", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_TOLD_DDL = "pid int, doc_id long, row_key long, key long, key2 long, n long, k long, keys binary, counts binary"


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; the whole sequence is one shingle if it is shorter."""
    h = C.word_hashes(C.find_words(text.lower()))
    return np.unique(C.windows(h, min(size, len(h)))) if len(h) else np.zeros(0, np.uint64)


def overlap(n: int, m: int, percent: int) -> int:
    """Shingles that sets of n and m must share to link."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def subsets(n: int, boundary: int, percent: int) -> list[tuple[int, int, int]]:
    """(n, m, c) with n <= m <= boundary for which a set of size n takes part: as the smaller or the larger one."""
    sizes = [(n, m) for m in range(n, boundary + 1) if 100 * n >= percent * m] + [(m, n) for m in range(1, n) if 100 * m >= percent * n]
    return [(a, b, overlap(a, b, percent)) for a, b in sizes]


def _send(batches, size: int, parts: int, chunk_bytes: int):
    for rows in C.chunks(batches, chunk_bytes):
        sets, stats = {}, []
        for r in rows:
            s = shingles(r["text"], size)
            raw = s.tobytes()
            key, key2 = (int(x) - (1 << 63) for x in (xxhash.xxh3_64_intdigest(raw), xxhash.xxh64_intdigest(raw, seed=1)))
            if len(s):
                sets[key] = s
            stats.append((r["doc_id"], r["row_key"], key, key2, len(s)))
        names = np.fromiter(sets, np.int64, len(sets))
        sizes = np.fromiter((len(s) for s in sets.values()), np.int64, len(sets))
        hashes = np.concatenate([*sets.values(), np.zeros(0, np.uint64)])
        keys = np.repeat(names, sizes)
        order = np.argsort(hashes, kind="stable")
        at, length = C.runs(hashes[order])
        hot = np.zeros(len(hashes), bool)
        hot[order] = np.repeat(length >= HOT, length)
        starts = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else np.zeros(0, np.int64)
        known = dict(zip(sets, np.add.reduceat(hot, starts, dtype=np.int64).tolist() if len(sets) else [], strict=True))
        out = [(doc % parts, doc, row, key, key2, n, known.get(key, 0), None, None, None, None) for doc, row, key, key2, n in stats]
        hot_hash = hashes[order][at[length >= HOT]]
        hashes, keys = hashes[~hot], keys[~hot]
        pid, hot_pid = C.deal(hashes, parts), C.deal(hot_hash, parts)
        order = np.lexsort((keys, pid))
        hashes, keys, pid = hashes[order], keys[order], pid[order]
        for p, begin, end in zip(range(parts), np.searchsorted(pid, np.arange(parts)), np.searchsorted(pid, np.arange(parts), "right"), strict=True):
            mine = hot_pid == p
            if begin == end and not mine.any():
                continue
            run_at, run_length = C.runs(keys[begin:end])
            out.append((p, None, None, None, None, None, None, keys[begin:end][run_at].tobytes(), run_length.astype(np.uint32).tobytes(), hashes[begin:end].tobytes(), hot_hash[mine].tobytes()))
        for i in range(0, len(out), 1024):
            yield C.arrow(_SENT, out[i : i + 1024])


def _settle(batches, parts: int):
    """How many hashes of each class occur in another."""
    keys, hashes, hot = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for batch in batches:
        stats = zip(*(batch.column(x).to_pylist() for x in ("doc_id", "row_key", "key", "key2", "n", "k")), strict=True)
        own = []
        for i, row in enumerate(stats):
            if row[0] is not None:
                own.append((0, *row, None, None))
            else:
                keys.append(np.repeat(C.view(batch.column("keys"), i, np.int64), C.view(batch.column("lengths"), i, np.uint32)))
                hashes.append(C.view(batch.column("hashes"), i, np.uint64))
                hot.append(C.view(batch.column("hot"), i, np.uint64))
        if own:
            yield C.arrow(_TOLD, own)
    keys, hashes, hot = (np.concatenate(x) for x in (keys, hashes, hot))
    order = np.lexsort((keys, hashes))
    keys, hashes = keys[order], hashes[order]
    if len(hashes):  # copies of one class in several chunks count once
        fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1])]
        keys, hashes = keys[fresh], hashes[fresh]
    at, length = C.runs(hashes)
    repeated = keys[np.repeat((length > 1) | np.isin(hashes[at], hot), length)]
    name, k = np.unique(repeated, return_counts=True)
    pid = name % parts
    yield C.arrow(_TOLD, [(p, None, None, None, None, None, None, name[pid == p].tobytes(), k[pid == p].astype(np.uint32).tobytes()) for p in range(parts) if (pid == p).any()])


def _tally(batches):
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for batch in batches:
        keys += [np.frombuffer(x, np.int64) for x in batch.column("keys").to_pylist()]
        counts += [np.frombuffer(x, np.uint32) for x in batch.column("counts").to_pylist()]
    name, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, np.concatenate(counts), len(name)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(total)], names=["key", "told"])


_SET = pa.schema([("rep", pa.int64()), ("n", pa.int32()), ("missing", pa.int32()), ("tokens", pa.binary())])


def _sets(batches, size: int):
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            texts = part.column("text").cast(pa.binary()).to_pylist()
            found = [shingles(t or b"", size) for t in texts]
            yield C.arrow(_SET, [(rep, len(s), missing, s.tobytes()) for rep, missing, s in zip(part.column("rep").to_pylist(), part.column("missing").to_pylist(), found, strict=True)])


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (COUNTERS.bit_length() - 1))).astype(np.int64)


def _count(batches):
    """How many shingles of this task's sets fall to each counter, those above 0, in parts."""
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            raw = b"".join(batch.column("tokens")[start : start + 512].to_pylist())
            total += np.bincount(_counter(np.frombuffer(raw, np.uint64)), minlength=COUNTERS)
    schema = pa.schema([("part", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])
    own = total.reshape(COUNTER_PARTS, -1)
    for part in range(COUNTER_PARTS):
        at = np.flatnonzero(own[part])
        if len(at):
            yield C.arrow(schema, [(part, at.astype(np.uint32).tobytes(), own[part][at].tobytes())])


def _add(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, part in enumerate(batch.column("part").to_pylist()):
            sums = total.setdefault(part, np.zeros(COUNTERS // COUNTER_PARTS, np.int64))
            sums[C.view(batch.column("at"), i, np.uint32)] += C.view(batch.column("n"), i, np.int64)
    yield C.arrow(pa.schema([("part", pa.int32()), ("n", pa.binary())]), [(part, np.minimum(x, 65535).astype(np.uint16).tobytes()) for part, x in total.items()])


def counters(sets: DataFrame) -> np.ndarray:
    """About how many sets hold a shingle, by hashed counter: one order of shingles that all tasks share."""
    sums = sets.mapInArrow(C.task(_count), "part int, at binary, n binary").repartitionById(COUNTER_PARTS, "part").mapInArrow(C.task(_add), "part int, n binary")
    out = np.zeros((COUNTER_PARTS, COUNTERS // COUNTER_PARTS), np.uint16)
    for r in sums.collect():
        out[r["part"]] = np.frombuffer(r["n"], np.uint16)
    return out.reshape(-1)


def _postings(batches, percent: int, weights):
    """Prefix of each set: its lightest shingles, those of a counter by hash."""
    weights = weights.value
    names = ["token", "rep", "n", "missing"]
    for batch in batches:
        tokens, sizes = [np.zeros(0, np.int64)], []
        for raw in batch.column("tokens").to_pylist():
            s = np.frombuffer(raw, np.uint64)
            tokens.append(s[np.lexsort((s, weights[_counter(s)]))[: prefix_length(len(s), percent)]].view(np.int64))
            sizes.append(len(tokens[-1]))
        spread = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(), sizes))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), spread("rep"), spread("n"), spread("missing")], names=names)


def _subsets(batches, boundary: int, percent: int):
    schema = pa.schema([("smaller", pa.int32()), ("larger", pa.int32()), ("subset", pa.int64()), ("rep", pa.int64()), ("n", pa.int32())])
    for batch in batches:
        out = []
        for rep, n, raw in zip(batch.column("rep").to_pylist(), batch.column("n").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
            for a, b, c in subsets(n, boundary, percent):
                for chosen in itertools.combinations(np.frombuffer(raw, np.uint64), c):
                    out.append((a, b, xxhash.xxh3_64_intdigest(np.array(chosen, np.uint64).tobytes()) - (1 << 63), rep, n))
        yield C.arrow(schema, out)


def _linked(batches, percent: int):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.sort(np.concatenate([x, y]))
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the similarity."""
    left = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("rep").alias("b"), F.col("tokens").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(C.task(_linked, percent=percent), "a long, b long")


def _common(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Number of shingles that each x has in common with each y, from the inverted lists of the shingles of both sides."""
    token = np.concatenate(xs + ys)
    owner = np.repeat(np.arange(len(xs) + len(ys)), [len(s) for s in xs + ys])
    order = np.argsort(token, kind="stable")
    at, length = C.runs(token[order])
    left = np.add.reduceat(owner[order] < len(xs), at, dtype=np.int64) if len(at) else at
    both = np.repeat((left > 0) & (left < length), length)
    lists = np.repeat(np.cumsum((left > 0) & (left < length)) - 1, length)[both]
    owner = owner[order][both]
    out = np.zeros((len(xs), len(ys)), np.float32)
    n = int(lists[-1]) + 1 if len(lists) else 0
    for begin in range(0, n, 8192):
        part = slice(*np.searchsorted(lists, [begin, begin + 8192]))
        held = np.zeros((len(xs) + len(ys), 8192), np.float32)
        held[owner[part], lists[part] - begin] = 1
        out += held[: len(xs)] @ held[len(xs) :].T
    return out.astype(np.int64)


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _cell(few: pa.Table, many: pa.Table, percent: int, boundary: int) -> pa.Table:
    """Links between sets of different labels: of each set that has one, an edge to a set of its component in the cell."""
    if not few.num_rows or not many.num_rows:
        return _EDGE.empty_table()
    load = lambda t: (t.column("rep").to_numpy(), t.column("label").to_numpy(), t.column("missing").to_numpy().astype(np.int64), [np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()])
    (a, la, ma, xs), (b, lb, mb, ys) = load(few), load(many)
    na, nb = (np.array([len(s) for s in x], np.int64) for x in (xs, ys))
    n = na[:, None] + nb[None, :]
    most = np.minimum((na - ma)[:, None], (nb - mb)[None, :])
    can = (la[:, None] != lb[None, :]) & ((100 + percent) * most >= percent * n) & (np.maximum(na[:, None], nb[None, :]) > boundary)
    i, j = np.flatnonzero(can.any(1)), np.flatnonzero(can.any(0))
    if not len(i):
        return _EDGE.empty_table()
    shared = _common([xs[k] for k in i], [ys[k] for k in j])
    u, v = np.nonzero(can[np.ix_(i, j)] & ((100 + percent) * shared >= percent * n[np.ix_(i, j)]))
    nodes, place = np.unique(np.r_[a[i], b[j]], return_inverse=True)
    label = C.merge(np.arange(len(nodes)), place[: len(i)][u], place[len(i) :][v])
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.table([pa.array(nodes[out]), pa.array(nodes[label[out]])], schema=_EDGE)


def _small_boundary(postings: DataFrame, sets: DataFrame, percent: int) -> int:
    """Largest size up to which enumerating subsets makes fewer rows than scanning the lists of those sets."""
    sizes = range(1, MAX_SMALL + 1)
    lists = postings.groupBy("token").agg(F.count("*").alias("df"), *(F.sum((F.col("n") == n).cast("long")).alias(f"n{n}") for n in sizes))
    scan = lists.agg(*(F.sum(F.col(f"n{n}") * F.col("df")) for n in sizes)).first()
    have = {r["n"]: r["count"] for r in sets.where(F.col("n") <= MAX_SMALL).groupBy("n").count().collect()}
    best = 0
    for x in sizes:
        rows = sum(have.get(n, 0) * sum(math.comb(n, c) for _, _, c in subsets(n, x, percent)) for n in range(1, x + 1))
        if rows <= sum(scan[n - 1] or 0 for n in range(1, x + 1)):
            best = x
    return best


def _small_links(sets: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Members of size n of a subset's group link with its first member of size m, and the other way round."""
    rows = sets.where(F.col("n") <= boundary).mapInArrow(C.task(_subsets, boundary=boundary, percent=percent), "smaller int, larger int, subset long, rep long, n int")
    group = ["smaller", "larger", "subset"]
    firsts = rows.groupBy(*group).agg(F.min(F.when(F.col("n") == F.col("smaller"), F.col("rep"))).alias("short"), F.min(F.when(F.col("n") == F.col("larger"), F.col("rep"))).alias("long")).where("short is not null and long is not null")
    return rows.join(firsts, group).select(F.col("rep").alias("a"), F.when(F.col("n") == F.col("smaller"), F.col("long")).otherwise(F.col("short")).alias("b")).where("a <> b").distinct()


def class_links(sets: DataFrame, percent: int = 75) -> DataFrame:
    """(rep, component) of every class of ``sets`` (rep, n, missing, tokens) that links with another.

    ``missing``: at least how many of the n shingles occur in no other set.
    """
    weights = sets.sparkSession.sparkContext.broadcast(counters(sets))
    postings = C.stash(sets.mapInArrow(C.task(_postings, percent=percent, weights=weights), "token long, rep long, n int, missing int"))
    boundary = _small_boundary(postings, sets, percent)
    # a list's first member: the one with the fewest shingles of its own
    lists = postings.groupBy("token").agg(F.count("*").alias("df"), F.min(F.struct("missing", "rep", "n")).alias("first")).where("df > 1")
    first = (F.col("first.rep").alias("first"), F.col("first.n").alias("first_n"), F.col("first.missing").alias("first_missing"))
    postings = C.stash(postings.join(lists, "token").select("token", "rep", "n", "missing", *first))

    def comparable(n: str, m: str, n_missing: str, m_missing: str):
        """Both can share as many shingles as a link needs, and not both are small."""
        most = F.least(F.col(n) - F.col(n_missing), F.col(m) - F.col(m_missing))
        return ((100 + percent) * most >= percent * (F.col(n) + F.col(m))) & (F.greatest(n, m) > boundary)

    pairs = postings.where("rep <> first").where(comparable("n", "first_n", "missing", "first_missing")).select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()
    links = _verified(pairs, sets, percent)
    if boundary:
        links = links.unionAll(_small_links(sets, boundary, percent))
    links = C.stash(links)
    label = C.stash(C.components(links)).select(F.col("id").alias("rep"), "component")
    mine = postings.join(label, "rep", "left").withColumn("label", F.coalesce("component", "rep")).select("token", "rep", "first", "label")
    mixed = mine.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    mine = C.stash(mine.join(mixed, "token").select("first", "rep", "label").distinct())  # all members of the lists that begin with ``first``
    head = mine.where("rep = first").select("first", F.col("label").alias("head"))
    mine = mine.where("rep <> first").join(head, "first").withColumn("apart", F.col("label") != F.col("head"))
    blocks = mine.groupBy("first").agg(*(F.ceil(n / BLOCK).cast("int").alias(b) for n, b in ((F.sum(F.col("apart").cast("long")), "few"), (F.count("*"), "many")))).where("few > 0")
    mine = C.stash(mine.join(blocks, "first"))
    cell, rest = ["first", "x", "y"], ["rep", "label", "missing", "tokens"]
    whole = mine.join(sets.select("rep", "missing", "tokens"), "rep")
    deal = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = whole.where("apart").withColumn("x", deal("few", 1)).withColumn("y", each("many")).select(*(F.col(c).alias(c) for c in cell + rest))
    many = whole.withColumn("y", deal("many", 2)).withColumn("x", each("few")).select(*(F.col(c).alias(c) for c in cell + rest))
    more = C.stash(few.groupBy(*cell).cogroup(many.groupBy(*cell)).applyInArrow(lambda x, y: _cell(x, y, percent, boundary), "a long, b long"))
    if more.isEmpty():
        return label
    star = label.select(F.col("rep").alias("a"), F.col("component").alias("b"))
    return C.components(star.unionAll(more)).select(F.col("id").alias("rep"), "component")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, part_bytes: int = 12 << 20) -> DataFrame:
    """(doc_id, row_key, n_shingles, class_id, component_id), a row for each document; null ids as common.NO_ID.

    ``row_key`` is xxhash64 of id and text. Documents with equal sets share ``class_id``, their smallest id.
    """
    C.prepare(docs.sparkSession)
    d = docs.select(C.internal_id(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    d = d.withColumn("row_key", F.xxhash64("doc_id", "text"))
    parts = C.parts_for(C.text_bytes(d), part_bytes)
    sent = d.mapInArrow(C.task(_send, size=size, parts=parts, chunk_bytes=8 << 20), _SENT_DDL)
    told = C.stash(sent.repartitionById(parts, "pid").mapInArrow(C.task(_settle, parts=parts), _TOLD_DDL))
    rows = told.where("doc_id is not null").select("doc_id", "row_key", "key", "key2", "n", "k")
    classes = rows.where("n > 0").groupBy("key", "key2", "n").agg(F.min(F.struct("doc_id", "row_key")).alias("first"), F.max("k").alias("known"))
    repeats = told.where("keys is not null").select("pid", "keys", "counts").repartitionById(parts, "pid").mapInArrow(C.task(_tally), "key long, told long")
    classes = C.stash(classes.join(repeats, "key", "left").select("key", "key2", "n", F.col("first.doc_id").alias("class_id"), F.col("first.row_key").alias("row_key"), F.least("n", F.col("known") + F.coalesce("told", F.lit(0))).alias("found"), F.monotonically_increasing_id().alias("rep")))
    can = classes.where(100 * F.col("found") >= percent * F.col("n")).select(F.col("class_id").alias("doc_id"), "row_key", "rep", (F.col("n") - F.col("found")).cast("int").alias("missing"))
    if can.count() <= BROADCAST_IDS:
        can = F.broadcast(can)
    sets = C.stash(d.join(can, ["doc_id", "row_key"]).dropDuplicates(["doc_id", "row_key"]).select("rep", "missing", "text").mapInArrow(C.task(_sets, size=size), "rep long, n int, missing int, tokens binary"))
    linked = class_links(sets, percent).join(classes.select("rep", "class_id"), "rep")
    least = linked.groupBy("component").agg(F.min("class_id").alias("component_id"))  # classes are nodes by number; ids come in here only
    links = C.spread_join(linked.select("rep", "component"), least, "component", "rep").select("rep", "component_id")
    named = classes.join(links, "rep", "left").select("key", "key2", "n", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    out = rows.join(named, ["key", "key2", "n"], "left")
    return out.select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op1(spark, sf_dir: str) -> DataFrame:
    found = jaccard_components(C.table(spark, sf_dir, "documents"))
    return found.select(C.external_id("doc_id").alias("doc_id"), "n_shingles", C.external_id("component_id").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
