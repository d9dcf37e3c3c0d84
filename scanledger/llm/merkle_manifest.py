"""Merkle manifest of a table: leaf digests, a tree for each source, a tree over the sources, and each leaf's proof.

A leaf is the digest of a row's fields; the leaves of a source ascend by id, and every three consecutive nodes become
their digest until one is left (the last run may be shorter, even a single node). The sources' roots, in the order of
the sources, likewise give the root. Digests are lower-case hexadecimal SHA-256 of concatenated text.

Time-forward processing. A node's label orders it behind its children. Nodes of up to LEVELS levels above FAN**LEVELS
consecutive ones form a block; Spark's sort, which spills to disk, delivers to each task its blocks in the order of
labels. Within a block a queue ordered by label holds the messages on their way: each node takes those addressed to it,
and sends its digest to its parent. Block roots are the nodes of the next tier, so a tree of n leaves takes
log(n) / log(FAN**LEVELS) tiers. The reversed sweep goes down tier by tier: a node's proof (the siblings of all levels
up to the root) is sorted in front of its block as a message, and the block's queue, by falling labels, passes each
node's proof on to its children, with their siblings before it. Every block is bounded, so no source is one task's.

Places: leaves are sorted into ranges by (source, id, digest, row); a leaf's place in its source is its place within its
range and the number of that source's leaves in the ranges before, summed from counts of (range, source).

Tampering removes newlines from texts of rows picked by their id; the root folded from the (tampered) leaf and the
original siblings shows it.

Defined cases: a null field is ``-`` in the leaf; a null source is the first source; null ids come before others in their
source, and are not tampered with; rows that share an id are ordered by digest, and equal rows each have their own leaf
and proof; an empty text is a leaf like another; a single leaf is its own root, with the digest of nothing as proof; an
empty table gives an empty one; only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanledger.llm import common as C

#: Nodes that become one, and levels of a block (3**7 = 2187 nodes below it).
FAN, LEVELS = 3, 7
#: Leaves in a range or a part.
PART_ROWS = 1 << 17

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels above n nodes until one is left."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def climb(digests: list[str], levels: int) -> tuple[list[str], list[int]]:
    """Digests of all nodes of a block by label, and the label at which each level begins."""
    widths = [len(digests)]
    for _ in range(levels):
        widths.append(-(-widths[-1] // FAN))
    begin = [0]
    for w in widths[:-1]:
        begin.append(begin[-1] + w)
    known, queue = list(digests), []
    level = 0
    for label in range(begin[-1] + widths[-1]):
        level += level < levels and label >= begin[level + 1]
        if level:  # the messages for this label are the first of the queue
            text = []
            while queue and queue[0][0] == label:
                text.append(heapq.heappop(queue)[2])
            known.append(digest("".join(text)))
        if level < levels:
            heapq.heappush(queue, (begin[level + 1] + (label - begin[level]) // FAN, label, known[label]))
    return known, begin


def descend(known: list[str], begin: list[int], proof: str) -> list[str]:
    """The proofs of a block's lowest nodes, from the proof of its root.

    A proof has a part for each level, closed by a comma: the node's place in its run, and its siblings' digests.
    """
    out = [""] * (begin[1] if len(begin) > 1 else len(known))
    top = len(begin) - 1
    queue = [(-label, proof) for label in range(len(known) - 1, begin[top] - 1, -1)]
    heapq.heapify(queue)
    level = top
    while queue:
        label, own = heapq.heappop(queue)
        label = -label
        while label < begin[level]:
            level -= 1
        if not level:
            out[label] = own
            continue
        first = begin[level - 1] + (label - begin[level]) * FAN
        run = known[first : min(first + FAN, begin[level])]
        for i in range(len(run)):
            heapq.heappush(queue, (-(first + i), f"{i}{''.join(run[:i] + run[i + 1 :])},{own}"))
    return out


def fold(leaf: str, proof: str) -> str:
    """The root that a leaf and its proof lead to."""
    for part in proof.split(",")[:-1]:
        at, siblings = int(part[0]) * 64, part[1:]
        leaf = digest(siblings[:at] + leaf + siblings[at:])
    return leaf


def _blocks(batches, names: tuple[str, ...]):
    """The rows (tuples of ``names``) of each block; rows come sorted by block."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
            if row[:2] != key:
                if rows:
                    yield rows
                key, rows = row[:2], []
            rows.append(row)
    if rows:
        yield rows


_NODE = pa.schema([("grp", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
_NODE_DDL = "grp long, pos long, n long, digest string"


def _up(batches):
    out = []
    for rows in _blocks(batches, ("grp", "block", "n", "digest")):
        grp, block, n, _ = rows[0]
        known, _ = climb([r[3] for r in rows], min(LEVELS, levels_of(n)))
        out.append((grp, block, -(-n // FAN**LEVELS), known[-1]))
        if len(out) >= 1024:
            yield C.arrow(_NODE, out)
            out = []
    yield C.arrow(_NODE, out)


_SENT = pa.schema([("grp", pa.int64()), ("block", pa.int64()), ("proof", pa.string()), ("subroot", pa.string())])
_SENT_DDL = "grp long, block long, proof string, subroot string"
_ANSWER = pa.schema([(x, t) for x, t in (("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()))])
_ANSWER_DDL = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(batches, extra: tuple[str, ...]):
    """(rows of a block, proof of each, subroot); the message for a block comes as a row without digest in front of it."""
    for message, *rows in _blocks(batches, ("grp", "block", "n", "digest", "proof", "subroot", *extra)):
        n = rows[0][2]
        known, begin = climb([r[3] for r in rows], min(LEVELS, levels_of(n)))
        yield rows, descend(known, begin, message[4]), message[5]


def _down(batches):
    """Messages for the blocks of the tier below: this tier's nodes are their roots."""
    out = []
    for rows, proofs, subroot in _proofs(batches, ("pos",)):
        for row, proof in zip(rows, proofs, strict=True):
            out.append((row[0], row[6], proof, subroot))
            if len(out) >= 1024:
                yield C.arrow(_SENT, out)
                out = []
    yield C.arrow(_SENT, out)


def _answers(batches, root: str):
    out = []
    for rows, proofs, subroot in _proofs(batches, ("doc_id", "tampered")):
        for row, proof in zip(rows, proofs, strict=True):
            folded = fold(row[7] or row[3], proof)
            siblings = "".join(part[1:] for part in proof.split(","))
            out.append((row[6], row[3], subroot, root, digest(siblings), folded, folded == root))
            if len(out) >= 1024:
                yield C.arrow(_ANSWER, out)
                out = []
    yield C.arrow(_ANSWER, out)


def _sorted(df: DataFrame, parts: int, *order) -> DataFrame:
    return df.repartition(parts, "grp", "block").sortWithinPartitions("grp", "block", *order)


def tiers(nodes: DataFrame, most: int, parts: int) -> list[DataFrame]:
    """The nodes (grp, pos, n, digest, ...) of each tier, the last with one node a group; ``most``: nodes of the largest group."""
    out = [nodes]
    while True:
        block = out[-1].withColumn("block", F.floor(F.col("pos") / FAN**LEVELS).cast("long"))
        out.append(C.stash(_sorted(block.select("grp", "block", "pos", "n", "digest"), parts, "pos").mapInArrow(C.task(_up), _NODE_DDL)))
        if most <= FAN**LEVELS:
            return out
        most = -(-most // FAN**LEVELS)


def delivered(nodes: DataFrame, messages: DataFrame, parts: int, *extra: str) -> DataFrame:
    """Nodes in blocks, each block behind the message for its root."""
    block = nodes.withColumn("block", F.floor(F.col("pos") / FAN**LEVELS).cast("long"))
    both = block.select("grp", "block", "pos", "n", "digest", *[x for x in extra if x != "pos"]).unionByName(messages, allowMissingColumns=True)
    return _sorted(both, parts, F.col("digest").isNotNull(), "pos")


def _enumerated(batches):
    """Adds ``pid``, this range, and ``at``, the place of a row among those of its source in the range; rows come sorted."""
    pid, source, at = None, None, 0
    for batch in batches:
        places = []
        for own, task in zip(batch.column("source").to_pylist(), batch.column("pid").to_pylist(), strict=True):
            at = at + 1 if (pid, source) == (task, own) else 0
            pid, source = task, own
            places.append(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, "at"])


def _placed(df: DataFrame, parts: int, *order: str) -> DataFrame:
    """Sorted into ranges by source and ``order``, written, with pid and at."""
    spread = df.repartitionByRange(parts, "source", *order).sortWithinPartitions("source", *order).withColumn("pid", F.spark_partition_id())
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spread.schema)
    return C.stash(spread.mapInArrow(C.task(_enumerated), f"{ddl}, at long"))


def field(c: Column) -> Column:
    """A field as it stands in a leaf."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(df: DataFrame, fields: tuple[str, ...], id_col: str, source_col: str, text_col: str, picked: Column) -> DataFrame:
    """(doc_id, source, digest, tampered, row): sources with a mark in front (null: empty); tampered is null where it changes nothing."""
    leaf = lambda text: F.sha2(F.concat(*(field(text if c == text_col else F.col(c)) for c in fields)), 256)
    cut = F.replace(F.col(text_col), F.lit("\n"), F.lit(""))
    source = F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    tampered = F.when(picked & F.col(text_col).contains("\n"), leaf(cut))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), leaf(F.col(text_col)).alias("digest"), tampered.alias("tampered"), F.monotonically_increasing_id().alias("row"))


def manifest(df: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", picked: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row; ``picked`` rows are tampered with."""
    spark = C.prepare(df.sparkSession)
    picked = F.lit(False) if picked is None else F.coalesce(picked, F.lit(False))
    found = C.stash(leaves(df, fields, id_col, source_col, text_col, picked))
    parts = max(8, found.count() // PART_ROWS)
    ranged = _placed(found, parts, "doc_id", "digest", "row")

    counts = C.stash(ranged.groupBy("pid", "source").agg(F.count("*").alias("own")))
    before = F.sum("own").over(Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    sources = _placed(counts.groupBy("source").agg(F.sum("own").alias("n")), max(8, counts.count() // PART_ROWS))
    per_range = {r["pid"]: r["n"] for r in sources.groupBy("pid").agg(F.count("*").alias("n")).collect()}
    starts, at = {}, 0
    for pid in sorted(per_range):
        starts[pid], at = at, at + per_range[pid]
    begin = F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in starts.items() for x in kv)), F.col("pid").cast("long")) if starts else F.lit(0).cast("long")
    within = F.row_number().over(Window.partitionBy("pid").orderBy("source")) - 1
    ranked = C.stash(sources.select("source", "n", (begin + within).alias("grp")))
    offsets = counts.withColumn("offset", F.coalesce(before, F.lit(0))).join(ranked, "source").select("pid", "source", "grp", "n", "offset")
    nodes = C.stash(ranged.join(offsets, ["pid", "source"]).select("grp", (F.col("offset") + F.col("at")).alias("pos"), "n", "digest", "doc_id", "tampered"))

    most = ranked.agg(F.max("n")).first()[0] or 0
    low = tiers(nodes, most, parts)
    top = low[-1].select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), F.lit(at).cast("long").alias("n"), "digest")
    high = tiers(top, at, 8)
    last = high[-1].first()
    root = last["digest"] if last else ""

    messages = high[-1].select("grp", F.col("pos").alias("block"), F.lit("").alias("proof"), F.lit("").alias("subroot"))
    for tier in reversed(high[:-1]):
        messages = C.stash(delivered(tier, messages, 8, "pos").mapInArrow(C.task(_down), _SENT_DDL))
    # a source's place in the upper tree is its group in the lower one
    named = messages.select(F.col("block").alias("grp"), F.lit(0).cast("long").alias("block"), "proof").join(low[-1].select("grp", F.col("digest").alias("subroot")), "grp")
    messages = named.select("grp", "block", "proof", "subroot")
    for tier in reversed(low[1:-1]):
        messages = C.stash(delivered(tier, messages, parts, "pos").mapInArrow(C.task(_down), _SENT_DDL))
    return delivered(nodes, messages, parts, "doc_id", "tampered").mapInArrow(C.task(_answers, root=root), _ANSWER_DDL)


def op13(spark, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(C.table(spark, sf_dir, "documents"), picked=even)


def _tree_sql(below: str, name: str, levels: int) -> str:
    """CTEs that climb ``levels`` levels from ``below`` (g, p, c, h) to ``name`` + level; a group of one node stays."""
    out = []
    for i in range(levels):
        under = below if i == 0 else f"{name}{i}"
        out.append(f"""{name}{i + 1} AS (
  SELECT g, p // 3 AS p, (c + 2) // 3 AS c, CASE WHEN c = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h, list(h ORDER BY p) AS run, c AS below FROM {under} GROUP BY g, p // 3, c
)""")
    return ", ".join(out)


def _path_sql(below: str, name: str, tree: str, levels: int) -> str:
    """CTEs that carry (r, g, p, folded, proof) of ``below`` up ``levels`` levels of ``tree``."""
    out = []
    for i in range(levels):
        under = below if i == 0 else f"{name}{i}"
        left, right = "array_to_string(run[1:a.p % 3], '')", "array_to_string(run[a.p % 3 + 2:], '')"
        out.append(f"""{name}{i + 1} AS (
  SELECT r, a.g, a.p // 3 AS p, CASE WHEN below = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded, CASE WHEN below = 1 THEN proof ELSE proof || {left} || {right} END AS proof
  FROM {under} a JOIN {tree}{i + 1} t ON t.g = a.g AND t.p = a.p // 3
)""")
    return ", ".join(out)


def _leaf_sql(text: str) -> str:
    part = lambda x, shown: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({shown})::VARCHAR || ':' || {shown} END"
    return "sha256(" + " || ".join(part(c, f"{text}::VARCHAR" if c == "text" else f"{c}::VARCHAR") for c in FIELDS) + ")"


#: Levels that the SQL climbs: up to 3**12 rows of a source, and 3**6 sources.
_LOW, _HIGH = 12, 6
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, {_leaf_sql("text")} AS leaf,
    CASE WHEN xor(list_reduce([4294967295] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda b: [ascii(b)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
      lambda c, v: CASE WHEN xor(c, v) % 2 = 1 THEN xor(xor(c, v) // 2, 3988292384) ELSE xor(c, v) // 2 END), 4294967295) % 2 = 0
    THEN {_leaf_sql("replace(text, chr(10), '')")} END AS tampered FROM documents
), n AS (
  SELECT r, doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS p, count(*) OVER (PARTITION BY g) AS c, leaf AS h, tampered FROM d
), {_tree_sql("n", "t", _LOW)}, s AS (
  SELECT g AS source, '' AS g, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS c, h FROM t{_LOW}
), {_tree_sql("s", "u", _HIGH)}, a AS (
  SELECT r, g, p, coalesce(tampered, h) AS folded, '' AS proof FROM n
), {_path_sql("a", "b", "t", _LOW)}, e AS (
  SELECT r, s.g, s.p, folded, proof, s.h AS subroot FROM b{_LOW} b JOIN s ON s.source = b.g
), {_path_sql("e", "f", "u", _HIGH)}
SELECT n.doc_id, n.h AS leaf, e.subroot, u.h AS root, sha256(f.proof) AS proof_sha256, f.folded AS folded_root, f.folded = u.h AS verified
FROM n JOIN e USING (r) JOIN f{_HIGH} f USING (r), u{_HIGH} u
"""
