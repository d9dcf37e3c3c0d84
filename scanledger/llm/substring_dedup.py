"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A word goes if it lies in a window whose word sequence also starts in a document with a smaller id. Method: tasks hash
every window of their documents and keep, for each distinct hash of a chunk of text, the smallest document; all other
documents of the chunk that have the hash know at once that this window repeats. The distinct hashes go, dealt by
hash, to the tasks that compare them over the whole corpus and answer the documents that are not the first. A hash
that a third of all documents share is so sent once a chunk, not once a document. Per document the marked windows
then merge into maximal intervals, which are cut.

Windows are compared by a 64-bit hash of 64-bit word hashes: two different windows meet with a probability of about
(number of windows)**2 / 2**65, 5e-4 for 0.5 GB of text.

Defined cases: a null text has no words; a document with fewer words than a window loses none; a null id counts as
the largest id, and rows that share an id (null too) never remove each other's words; equal rows each give a row;
an empty table gives an empty one; only the two named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanledger.llm import common as C

_SENT = pa.schema([("pid", pa.int32()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("starts", pa.binary()), ("docs", pa.binary()), ("lengths", pa.binary()), ("hashes", pa.binary())])
_SENT_DDL = "pid int, doc_id long, row_key long, starts binary, docs binary, lengths binary, hashes binary"
_TOLD = pa.schema([(f.name, f.type) for f in _SENT])
_MARK = pa.schema([("doc_id", pa.int64()), ("local", pa.list_(pa.struct([("row_key", pa.int64()), ("starts", pa.binary())]))), ("hashes", pa.binary())])
_MARK_DDL = "doc_id long, local array<struct<row_key:long,starts:binary>>, hashes binary"


def _smallest(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by hash, then document: the order, where each hash begins, and the smallest document of each entry's hash."""
    order = np.lexsort((docs, hashes))
    at, length = C.runs(hashes[order])
    return order, at, np.repeat(docs[order][at], length)


def _send(batches, window: int, parts: int, chunk_bytes: int):
    for rows in C.chunks(batches, chunk_bytes):
        found = [C.windows(C.word_hashes(C.find_words(r["text"])), window) for r in rows]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        hashes = np.concatenate(found)
        docs = np.repeat(np.array([r["doc_id"] for r in rows], np.int64), sizes)
        order, at, least = _smallest(hashes, docs)
        repeated = np.zeros(len(hashes), bool)
        repeated[order] = docs[order] != least
        out, begin = [], 0
        for row, size in zip(rows, sizes.tolist(), strict=True):
            starts = np.flatnonzero(repeated[begin : begin + size])
            begin += size
            if len(starts):
                out.append((row["doc_id"] % parts, row["doc_id"], row["row_key"], _intervals(starts, 1).tobytes(), None, None, None))
        first = order[at]
        hashes, docs = hashes[first], docs[first]
        out += _blobs(hashes, docs, C.deal(hashes, parts))
        for i in range(0, len(out), 256):
            yield C.arrow(_SENT, out[i : i + 256])


def _blobs(hashes: np.ndarray, docs: np.ndarray, pid: np.ndarray) -> list[tuple]:
    """A row for each partition: its hashes by document, the documents as runs."""
    order = np.lexsort((docs, pid))
    hashes, docs, pid = hashes[order], docs[order], pid[order]
    out = []
    for begin, length in zip(*C.runs(pid), strict=True):
        own = slice(begin, begin + length)
        at, n = C.runs(docs[own])
        out.append((int(pid[begin]), None, None, None, docs[own][at].tobytes(), n.astype(np.uint32).tobytes(), hashes[own].tobytes()))
    return out


def _gather(batches, local):
    """Hashes and documents of all blobs; rows about one document go to ``local``."""
    docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for batch in batches:
        ids, row_keys, starts = (batch.column(x).to_pylist() for x in ("doc_id", "row_key", "starts"))
        for i, doc in enumerate(ids):
            if doc is not None:
                local(doc, row_keys[i], starts[i])
            else:
                hashes.append(C.view(batch.column("hashes"), i, np.uint64))
                docs.append(np.repeat(C.view(batch.column("docs"), i, np.int64), C.view(batch.column("lengths"), i, np.uint32)))
    return np.concatenate(hashes), np.concatenate(docs)


def _settle(batches, parts: int):
    """Compares all hashes dealt to this task; answers the documents that are not the first to have one."""
    local = []
    hashes, docs = _gather(batches, lambda doc, row_key, starts: local.append((doc % parts, doc, row_key, starts, None, None, None)))
    order, _, least = _smallest(hashes, docs)
    later = order[docs[order] != least]
    out = local + _blobs(hashes[later], docs[later], docs[later] % parts)
    for i in range(0, len(out), 256):
        yield C.arrow(_TOLD, out[i : i + 256])


def _by_document(batches):
    """All marks of each document of this partition in one row."""
    local: dict[int, list] = {}
    hashes, docs = _gather(batches, lambda doc, row_key, starts: local.setdefault(doc, []).append({"row_key": row_key, "starts": starts}))
    order = np.argsort(docs, kind="stable")
    hashes, docs = hashes[order], docs[order]
    at, length = C.runs(docs)
    out = [(int(docs[a]), local.pop(int(docs[a]), None), hashes[a : a + n].tobytes()) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
    out += [(doc, marks, None) for doc, marks in local.items()]
    for i in range(0, len(out), 1024):
        yield C.arrow(_MARK, out[i : i + 1024])


def _intervals(starts: np.ndarray, window: int) -> np.ndarray:
    """Maximal intervals (begin, end) of words that windows at the sorted ``starts`` cover, as uint32 pairs."""
    if not len(starts):
        return np.zeros((0, 2), np.uint32)
    gap = np.flatnonzero(starts[1:] > starts[:-1] + window)
    return np.stack([starts[np.r_[0, gap + 1]], starts[np.r_[gap, len(starts) - 1]] + window], 1).astype(np.uint32)


def cut(text: bytes, row_key: int, local: list[dict] | None, hashes: bytes | None, window: int) -> tuple[int, list[tuple[int, int]], list[bytes]]:
    """Number of words, removed intervals of words, and the words kept of one document."""
    words = C.find_words(text)
    if not local and not hashes:
        return len(words), [], words
    hit = np.zeros(max(0, len(words) - window + 1), bool)
    if hashes:
        hit |= np.isin(C.windows(C.word_hashes(words), window), np.frombuffer(hashes, np.uint64))
    for m in local or []:
        if m["row_key"] == row_key:
            for begin, end in np.frombuffer(m["starts"], np.uint32).reshape(-1, 2).tolist():
                hit[begin:end] = True
    gone = [tuple(x) for x in _intervals(np.flatnonzero(hit), window).tolist()]
    kept, at = [], 0
    for begin, end in gone:
        kept += words[at:begin]
        at = end
    return len(words), gone, kept + words[at:]


_CUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _cut(batches, window: int):
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            out = []
            for r in batch.slice(start, 512).to_pylist():
                n, gone, kept = cut(C.unpack_text(r["body"]), r["row_key"], r["local"], r["hashes"], window)
                out.append((r["doc_id"], n, n - len(kept), [{"begin": a, "end": b} for a, b in gone], b" ".join(kept)))
            yield C.arrow(_CUT, out)


def _digest(batches, window: int):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    for batch in _cut(batches, window):
        sums = [hashlib.sha256(x).hexdigest() for x in batch.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names[:3]), pa.array(sums, pa.string())], names=names)


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, part_bytes: int = 16 << 20) -> DataFrame:
    """Rows (doc_id, row_key, body, local, hashes): packed texts beside the marks of their repeated windows."""
    C.prepare(docs.sparkSession)
    d = docs.select(C.internal_id(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    d = d.withColumn("row_key", F.xxhash64("doc_id", "text"))
    parts = C.parts_for(C.text_bytes(d), part_bytes)
    sent = d.mapInArrow(C.task(_send, window=window, parts=parts, chunk_bytes=8 << 20), _SENT_DDL)
    told = sent.repartitionById(parts, "pid").mapInArrow(C.task(_settle, parts=parts), _SENT_DDL)
    per_doc = told.repartitionById(parts, "pid").mapInArrow(C.task(_by_document), _MARK_DDL)
    packed = d.mapInArrow(C.task(C.packed_texts), "doc_id long, row_key long, body binary")
    return packed.join(per_doc, "doc_id", "left")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept): intervals of removed words, and the kept words joined by spaces."""
    cut = marked(docs, id_col, text_col, window).mapInArrow(C.task(_cut, window=window), "doc_id long, n_words long, n_removed long, removed array<struct<begin:long,end:long>>, kept binary")
    return cut.select(C.external_id("doc_id").alias("doc_id"), "n_words", "n_removed", "removed", F.col("kept").cast("string").alias("kept"))


def op9(spark, sf_dir: str) -> DataFrame:
    cut = marked(C.table(spark, sf_dir, "documents")).mapInArrow(C.task(_digest, window=13), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return cut.select(C.external_id("doc_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT r, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s
  FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)
), m AS (
  SELECT s, min(doc_id) AS d FROM g GROUP BY s
), gone AS (
  SELECT DISTINCT r, i + j AS p FROM g JOIN m USING (s), range(0, 13) AS t(j) WHERE m.d < g.doc_id
), word AS (
  SELECT r, p, ws[p] AS word FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)
), kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""
