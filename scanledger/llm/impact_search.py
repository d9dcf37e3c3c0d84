"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Components become integers floor(scale * x). Vectors are dealt in blocks; the index of a block holds its postings
(vector, dimension, impact) in segments of falling quantised impact: each segment has the components whose size has
one more leading zero bit than the segment before. A block answers a group of queries together: segment by segment it
adds query component times impact, for the vectors that have postings in it. What is left of a vector can add at most
the length of its unprocessed components times the length of the query's. A query is done with a block once those bounds
prove for all but FEW * k vectors that they cannot be among its k best; they are scored exactly from their whole vectors,
and the later segments are processed for the other queries only. If no proof comes, all segments are processed, which
is exact as well. The k best of each block and query meet in one ranking.

Blocks run in two waves. The k-th best score that the first wave (a block of every WAVE) finds is a floor for the
query in all others, where most vectors then fall out after the first segments.

Queries meet rows block by block: (query group, vector block) cells of bounded size.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; a component
is 64 bits (its integer is held within +-2**63) and a score that leaves this range wraps; a query meets only vectors of its own length; a query has fewer results if there are fewer rows; rows
with the query's id are not its candidates; null ids are candidates, last among ties; an empty table gives an empty
one; labels and other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanledger.llm import common as C

BLOCK = 4096
QUERIES = 1024
#: A query is done with a block when at most so many times k vectors are still possible.
FEW = 4
#: One block of so many is in the first wave.
WAVE = 16
#: The largest double below 2**63.
LARGEST = 2.0**63 - 1024


def _integers(batches, scale: float):
    for batch in batches:
        out = []
        for v in batch.column("vector").to_pylist():
            x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
            ok = len(x) and np.isfinite(x).all()
            out.append(np.clip(np.floor(x * scale), -LARGEST, LARGEST).astype(np.int64).tobytes() if ok else None)
        ids = batch.column("vec_id")
        yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], names=["vec_id", "vector"]).filter(pa.array([x is not None for x in out], pa.bool_()))


_INDEX = pa.schema([("block", pa.int32()), ("dims", pa.int32()), ("segment", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("rows", pa.binary()), ("columns", pa.binary()), ("impacts", pa.binary()), ("rest", pa.binary())])
_INDEX_DDL = "block int, dims int, segment int, ids binary, vectors binary, rows binary, columns binary, impacts binary, rest binary"


def _index(key, table):
    """Of one block: a row with its vectors, and a row for each segment with its postings and what is left after it."""
    block, dims = (k.as_py() for k in key)
    ids = table.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    x = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.int64).reshape(len(ids), dims)[order]
    out = [(block, dims, -1, ids[order].tobytes(), x.tobytes(), None, None, None, None)]
    size = np.abs(x)
    level = np.where(size > 0, np.frexp(size.astype(np.float64))[1], 0)
    left = (size.astype(np.float64) ** 2).sum(1)
    for segment in np.unique(level[level > 0])[::-1].tolist():
        rows, columns = np.nonzero(level == segment)
        impacts = x[rows, columns]
        left = np.maximum(0.0, left - np.bincount(rows, impacts.astype(np.float64) ** 2, len(ids)))
        out.append((block, dims, int(segment), None, None, rows.astype(np.int32).tobytes(), columns.astype(np.int32).tobytes(), impacts.tobytes(), np.sqrt(left).tobytes()))
    return pa.Table.from_batches([C.arrow(_INDEX, out)])


_BEST = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(index: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    if not index.num_rows or not queries.num_rows:
        return _BEST.empty_table()
    rows = sorted(index.to_pylist(), key=lambda r: (r["segment"] >= 0, -r["segment"]))
    ids = np.frombuffer(rows[0]["ids"], np.int64)
    dims = rows[0]["dims"]
    x = np.frombuffer(rows[0]["vectors"], np.int64).reshape(len(ids), dims)
    query_ids = queries.column("query_id").to_numpy()
    q = np.frombuffer(b"".join(queries.column("vector").to_pylist()), np.int64).reshape(len(query_ids), dims)
    own = query_ids[:, None] == ids[None, :]
    # sums of products are exact in doubles below 2**53; else every pair is scored in integers
    exact = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(x.astype(np.float64)).max()) * dims < 2.0**52
    possible = ~own
    if exact:
        qd, length = q.astype(np.float64), np.sqrt((q.astype(np.float64) ** 2).sum(1))
        floor = queries.column("floor").to_numpy().astype(np.float64)
        score, active = np.zeros(own.shape), np.arange(len(query_ids))
        for r in rows[1:]:
            having, place = np.unique(np.frombuffer(r["rows"], np.int32), return_inverse=True)
            tile = np.zeros((len(having), dims))
            tile[place, np.frombuffer(r["columns"], np.int32)] = np.frombuffer(r["impacts"], np.int64)
            score[np.ix_(active, having)] += qd[active] @ tile.T
            bound = length[active, None] * np.frombuffer(r["rest"], np.float64)[None, :] * (1 + 1e-9) + 1e-6
            kth = floor[active]
            if len(ids) >= k:
                least = np.where(own[active], -np.inf, score[active] - bound)
                kth = np.maximum(kth, np.partition(least, len(ids) - k, axis=1)[:, len(ids) - k])
            possible[active] = (score[active] + bound >= kth[:, None]) & ~own[active]
            active = active[possible[active].sum(1) > FEW * k]
            if not len(active):
                break
    at, who = np.nonzero(possible)
    scores = np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", q[at[i : i + 65536]], x[who[i : i + 65536]]) for i in range(0, len(at), 65536))])
    order = np.lexsort((ids[who], -scores, at))
    at, who, scores = at[order], who[order], scores[order]
    begin, n = C.runs(at)
    best = np.arange(len(at)) - np.repeat(begin, n) < k
    return pa.table([pa.array(query_ids[at[best]]), pa.array(ids[who[best]]), pa.array(scores[best])], schema=_BEST)


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of each row for which ``is_query`` holds."""
    C.prepare(vectors.sparkSession)
    d = vectors.where(F.col(vector_col).isNotNull()).select(C.internal_id(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    whole = C.stash(d.select("vec_id", "vector").mapInArrow(C.task(_integers, scale=scale), "vec_id long, vector binary").withColumn("dims", F.octet_length("vector").cast("int") / 8))
    whole = whole.withColumn("dims", F.col("dims").cast("int"))
    asked = d.where("asks").select("vec_id", "vector").mapInArrow(C.task(_integers, scale=scale), "query_id long, vector binary".replace("query_id", "vec_id"))
    asked = asked.select(F.col("vec_id").alias("query_id"), "vector", (F.octet_length("vector") / 8).cast("int").alias("dims"))
    blocks = C.parts_for(whole.count(), BLOCK, 1)
    groups = C.parts_for(asked.count(), QUERIES, 1)
    index = C.stash(whole.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("block", "dims").applyInArrow(_index, _INDEX_DDL))
    asked = C.stash(asked.withColumn("group", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(groups)).cast("int")))
    key = ["block", "dims", "group"]
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def wave(first: bool, queries: DataFrame) -> DataFrame:
        """The k best of the blocks of one wave and each query, by rank."""
        mine = (F.col("block") % WAVE == 0) == F.lit(first)
        cells = index.where(mine).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        sent = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where(mine)
        best = cells.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(lambda x, y: _search(x, y, k), "query_id long, vec_id long, score long")
        return best.withColumn("rank", rank).where(F.col("rank") <= k)

    best = wave(True, asked.withColumn("floor", F.lit(float("-inf"))))
    if blocks > 1:
        best = C.stash(best)
        floors = best.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
        rest = wave(False, asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))))
        best = best.unionByName(rest).drop("rank").withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", C.external_id("vec_id").alias("vec_id"), "score")


def op3(spark, sf_dir: str) -> DataFrame:
    return top_k(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""
