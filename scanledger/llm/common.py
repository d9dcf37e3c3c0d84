"""Helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes.util
import math
import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanledger.session import ensure_checkpoint_dir

#: Words are runs of bytes other than space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
find_words = re.compile(rb"[^\x20\x09-\x0D]+").findall

#: Stands for a null id inside the operators: larger than every id. Results give null again.
NO_ID = (1 << 63) - 1

#: Rows of numbers that may be broadcast (16 MB or so).
BROADCAST_ROWS = 1 << 20

_RADIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of this session by bytes, so that long texts do not fill the tasks' memory."""
    for key, value in (("maxRecordsPerBatch", "2048"), ("maxBytesPerBatch", "4m")):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", value)
    return spark


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table under ``spark.checkpoint.dir`` and read it back: cuts the lineage, survives lost executors.

    The files stay until whoever owns the checkpoint folder clears it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def internal_id(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def numbered(df: DataFrame) -> DataFrame:
    """Adds ``_row``, a number for each row, written with the other columns: every later scan reads the same numbers.

    A number that is worked out anew follows the file splits, and these follow the cores registered when a job is planned.
    """
    return stash(df.withColumn("_row", F.monotonically_increasing_id()))


def by_row(few: DataFrame) -> DataFrame:
    """A side of a join on ``_row`` with some numbers a row: broadcast if it has at most BROADCAST_ROWS, else shuffled."""
    few = stash(few)
    return F.broadcast(few) if few.count() <= BROADCAST_ROWS else few


def spread_join(many: DataFrame, few: DataFrame, key: str, dealt_by: str, rows: int = 1 << 18, salts: int = 16) -> DataFrame:
    """``many`` with the row of ``few`` (one a key) that has its key; a key may hold any share of ``many``.

    ``few`` is broadcast if it has at most ``rows`` rows (of some numbers or a digest each); else both sides are dealt
    by key and a salt, which in ``many`` follows the column ``dealt_by``.
    """
    few = stash(few)
    if few.count() <= rows:
        return many.join(F.broadcast(few), key)
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.withColumn("_salt", F.pmod(F.xxhash64(dealt_by), F.lit(salts)).cast("int")).join(salted, [key, "_salt"]).drop("_salt")


def boxed(df: DataFrame) -> DataFrame:
    """Each row as one struct ``doc``, so that no name of its columns can clash with a column that is put beside it."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc"))


def external_id(name: str) -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def parts_for(n_bytes: int, per_part: int, least: int = 8) -> int:
    """Partitions so that each holds about ``per_part`` bytes of text; grows with the input."""
    return max(least, math.ceil(n_bytes / per_part))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
_PIECE = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse modulo 2**64, ``n`` at least."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _RADIX), ("down", _INVERSE)):
            x = np.full(max(n, 1 << 20) * 5 // 4, base)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the texts: hash, last two bytes as a number, and text, worked out on the joined bytes.

    A word's hash is a polynomial in its bytes (random values of which each stands for one), by prefix sums modulo
    2**64; words over 64 bytes, for which that is weak, are hashed one by one.
    """
    joined = b"\n".join([*texts, b""])
    raw = np.frombuffer(joined, np.uint8)
    inside = np.r_[False, ~_IS_SPACE[raw]]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    up, down = _powers(len(raw))
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)]
    hashes = mix((sums[end] - sums[begin]) * down[begin])
    for i in np.flatnonzero(end - begin > 64).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(joined[begin[i] : end[i]])
    last = raw[end - 1].astype(np.int64) * 256 + np.where(end - begin > 1, raw[end - 2], 0)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, last, np.searchsorted(starts, begin, "right") - 1


def word_spans(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts; of each word its begin and end there, its hash (as in ``hashed_words``) and its text's number."""
    joined = b"\n".join([*texts, b""])
    raw = np.frombuffer(joined, np.uint8)
    inside = np.r_[False, ~_IS_SPACE[raw]]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    up, down = _powers(_PIECE)
    hashes, i = np.zeros(len(begin), np.uint64), 0
    while i < len(begin):  # pieces of the bytes, so that the sums of a long text stay small
        low = begin[i]
        j = max(i + 1, int(np.searchsorted(end, low + _PIECE, "right")))
        if end[j - 1] - low <= _PIECE:
            piece = raw[low : end[j - 1]]
            sums = np.r_[np.uint64(0), np.cumsum(_BYTE[piece] * up[: len(piece)], dtype=np.uint64)]
            hashes[i:j] = mix((sums[end[i:j] - low] - sums[begin[i:j] - low]) * down[begin[i:j] - low])
        i = j
    for i in np.flatnonzero(end - begin > 64).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(joined[begin[i] : end[i]])
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return joined, begin, end, hashes, np.searchsorted(starts, begin, "right") - 1


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of each run of ``size`` word hashes (mod 2**64, then mixed so that the high bits are even)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= _RADIX
        out += hashes[j : j + n]
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def deal(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Partition of each hash, from its high bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run-length code of an array: start of each run, and its length."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return at, np.diff(np.r_[at, len(values)])


def release() -> None:
    """Gives memory that a finished task has freed back to the system, as its worker process stays."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(libc), "malloc_trim", None) if libc else None
    if trim:
        trim(0)


def task(fn, **fixed):
    """A function for mapInArrow: ``fn`` with fixed arguments, which gives its memory back at the end."""

    def run(batches):
        try:
            yield from fn(batches, **fixed)
        finally:
            release()

    return run


def chunks(batches, n_bytes: int, column: str = "text"):
    """Lists of rows (dicts; text as bytes, null as empty) of about ``n_bytes`` of text, across Arrow batches."""
    rows, held = [], 0
    for batch in batches:
        names = batch.schema.names
        at = names.index(column)
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            columns = [c.cast(pa.binary()).to_pylist() if i == at else c.to_pylist() for i, c in enumerate(part.columns)]
            for values in zip(*columns, strict=True):
                row = dict(zip(names, values, strict=True))
                row[column] = row[column] or b""
                rows.append(row)
                held += len(row[column])
                if held >= n_bytes:
                    yield rows
                    rows, held = [], 0
    if rows:
        yield rows


def packed_texts(batches):
    """(doc_id, row_key, text) with the text as compressed bytes, so that it costs little to shuffle."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), pa.array([pack(t or b"") for t in texts], pa.binary())],
            names=["doc_id", "row_key", "body"],
        )


def unpack_text(body: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body)


def view(column, row: int, kind) -> np.ndarray:
    """The numbers of a binary cell, without a copy."""
    return np.frombuffer(column[row].as_buffer(), kind)


def arrow(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (smallest index of each component) after joining u with v."""
    while True:
        x, y = label[u], label[v]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b); component is the smallest id reachable.

    Each round hooks every vertex to its smallest neighbour, follows the pointers to their roots by doubling, and
    contracts the edges; rounds end when no edge joins two roots. Everything stays in tables; hubs are only ever
    aggregated with min.
    """
    ends = lambda e: e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e, levels = stash(ends(edges)), []
    while not levels or not e.isEmpty():
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stash(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")).select("id", F.least("id", "root").alias("root")))
        while True:
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("next"))
            jumped = stash(parent.join(up, "root").select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            parent = jumped.select("id", "root")
            if jumped.where("moved").isEmpty():
                break
        levels.append(parent)
        left = parent.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        right = parent.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        e = stash(ends(e.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))))
    out = levels[0].select("id", F.col("root").alias("component"))
    for level in levels[1:]:
        up = level.select(F.col("id").alias("component"), F.col("root").alias("higher"))
        out = out.join(up, "component", "left").select("id", F.coalesce("higher", "component").alias("component"))
    return out
