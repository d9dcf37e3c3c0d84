"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with whole documents.

A unit is a window of ``window`` consecutive words of an item, or the whole item if it is shorter; equal windows are one
unit. A unit is the set of its shingles (``shingle`` consecutive words, all of a shorter unit). A document can hold a
unit only if it holds all of them, so one shingle of each unit is its necessary prefix, and the rarest costs least.

1. Rarity. Tasks count the units' shingles in all documents; a bitmap of at most 128 MB, whatever the input, lets other
   shingles pass unread. Counts are added up in Spark and order the shingles.
2. Prefix join. The rarest shingle of each unit, with its place in it, meets the documents: tasks emit each place at
   which a prefix shingle (by bitmap) begins, with as many words around it as a unit can reach. Places and prefixes join
   on the shingle, in broadcast if the prefixes are few by count and bytes, else dealt by shingle and salt.
3. Bounds. A pair stays if as many words lie before and behind the place as the unit has (position and length).
4. Exact check. The unit's words equal the words of the document's window of that size, compared as strings.
5. Hits. Intervals of one document merge, so that a word covered by several windows counts once.

Words are runs of letters a-z (A-Z lower-cased), digits and all that is not ASCII. Hashes only pick pairs, so results
are exact.

Defined cases: a null or blank text has no words, so such an item has no unit and such a document no hit; a null item id
is an item whose id is the empty string; items that share an id are one; rows that share a document id, a null one too,
each give a row; repeated rows each give a row; long texts are read whole, and their places go out as rows; an empty
table on either side gives no hits; only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanledger.llm import common as C

#: Slices in which the bitmap is built, and its largest size as a power of two of bits (128 MB).
SLICES, MOST_BITS = 16, 30
#: Prefixes are broadcast up to so many rows and bytes of words.
BROADCAST_PREFIXES, BROADCAST_BYTES = 1 << 17, 16 << 20
#: Salts a prefix shingle is dealt by when prefixes are not broadcast.
SALTS = 16

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fold(text: bytes | None) -> bytes:
    """The text in lower case, with a space for each byte that no word has."""
    return (text or b"").translate(_FOLD)


def shingle_hashes(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of ``size`` words of one text."""
    if len(hashes) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(owner[size - 1 :] == owner[: len(owner) - size + 1])
    return at, C.windows(hashes, size)[at]


_UNIT = pa.schema([("item", pa.string()), ("phrase", pa.string())])
_SHINGLE = pa.schema([("unit", pa.int64()), ("size", pa.int32()), ("offset", pa.int32()), ("token", pa.int64())])


def _windows(batches, window: int):
    for batch in batches:
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            words = [w.decode() for w in fold(text).split()]
            starts = range(max(1, len(words) - window + 1)) if words else range(0)
            for begin in range(0, len(starts), 4096):
                phrases = dict.fromkeys(" ".join(words[i : i + window]) for i in starts[begin : begin + 4096])
                yield C.arrow(_UNIT, [(item, p) for p in phrases])


def _shingles(batches, shingle: int):
    for batch in batches:
        out = []
        for unit, phrase in zip(batch.column("unit").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
            words = phrase.encode().split(b" ")
            size = min(shingle, len(words))
            _, _, _, hashes, owner = C.word_spans([phrase.encode()])
            out += [(unit, size, i, h) for i, h in enumerate(shingle_hashes(hashes, owner, size)[1].view(np.int64).tolist())]
        for i in range(0, len(out), 8192):
            yield C.arrow(_SHINGLE, out[i : i + 8192])


def _bits(batches, power: int):
    """This task's slices of the bitmap."""
    width = (1 << power) // SLICES
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        slot = (batch.column("token").to_numpy().view(np.uint64) >> np.uint64(64 - power)).astype(np.int64)
        for part in np.unique(slot // width).tolist():
            own = slot[slot // width == part] % width
            np.bitwise_or.at(held.setdefault(part, np.zeros(width // 8, np.uint8)), own >> 3, np.uint8(1) << (own & 7).astype(np.uint8))
    yield C.arrow(pa.schema([("part", pa.int32()), ("bits", pa.binary())]), [(p, x.tobytes()) for p, x in held.items()])


def bitmap(tokens: DataFrame) -> np.ndarray:
    """A bit for each value of the high bits of the tokens; 512 bits a token, and never more than 128 MB."""
    n = tokens.count()
    power = min(MOST_BITS, max(16, (512 * n).bit_length()))
    width = (1 << power) // SLICES
    part = F.shiftrightunsigned("token", 64 - SLICES.bit_length() + 1).cast("int")
    dealt = tokens.select("token", part.alias("part")).repartitionById(SLICES, "part")
    out = np.zeros((SLICES, width // 8), np.uint8)
    for r in dealt.mapInArrow(C.task(_bits, power=power), "part int, bits binary").collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _among(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _texts(batches, chunk_bytes: int):
    for rows in C.chunks(batches, chunk_bytes):
        yield rows, C.word_spans([fold(r["text"]) for r in rows])


def _count(batches, bits, sizes: list[int], chunk_bytes: int):
    """How often each shingle that may be a unit's occurs in this task's documents."""
    for _, (_, _, _, hashes, owner) in _texts(batches, chunk_bytes):
        found = [h[_among(h, bits.value)] for h in (shingle_hashes(hashes, owner, s)[1] for s in sizes)]
        token, n = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])


_PLACE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("token", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("around", pa.list_(pa.string()))])
_PLACE_DDL = "row long, doc_id long, n_words long, token long, at long, before int, around array<string>"


def _places(batches, bits, reach: dict[int, int], chunk_bytes: int):
    """A row for each document, and one for each place in it at which a shingle of a prefix may begin.

    ``reach``: for each size of shingles, how many words a unit has besides its prefix.
    """
    for rows, (joined, begin, end, hashes, owner) in _texts(batches, chunk_bytes):
        first = np.searchsorted(owner, np.arange(len(rows) + 1))
        out = [(r["row"], r["doc_id"], n, None, None, None, None) for r, n in zip(rows, np.diff(first).tolist(), strict=True)]
        for size, more in reach.items():
            index, tokens = shingle_hashes(hashes, owner, size)
            hit = np.flatnonzero(_among(tokens, bits.value))
            for i, token in zip(index[hit].tolist(), tokens[hit].view(np.int64).tolist(), strict=True):
                own = owner[i]
                low, high = max(int(first[own]), i - more), min(int(first[own + 1]), i + size + more)
                around = [joined[begin[j] : end[j]].decode() for j in range(low, high)]
                out.append((rows[own]["row"], None, None, token, i - int(first[own]), i - low, around))
                if len(out) >= 8192:
                    yield C.arrow(_PLACE, out)
                    out = []
        for i in range(0, len(out), 8192):
            yield C.arrow(_PLACE, out[i : i + 8192])


def _joined(places: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Places and prefixes with the same shingle; the prefixes are broadcast only if few, else a shingle is salted."""
    n, n_bytes = prefixes.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("words", " "))), F.lit(0))).first()
    if n <= BROADCAST_PREFIXES and n_bytes <= BROADCAST_BYTES:
        return places.join(F.broadcast(prefixes), "token")
    salted = prefixes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return places.withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"])


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 3) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of each document: words, words inside a unit's occurrence, ids of items with one (sorted)."""
    spark = C.prepare(docs.sparkSession)
    asked = items.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    windows = C.stash(asked.mapInArrow(C.task(_windows, window=window), "item string, phrase string").distinct())
    units = C.numbered(windows.select("phrase").distinct()).withColumnRenamed("_row", "unit")
    sets = C.stash(units.mapInArrow(C.task(_shingles, shingle=shingle), "unit long, size int, offset int, token long"))

    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sizes = sorted(r["size"] for r in sets.select("size").distinct().collect())
    tokens = sets.select("token").distinct()
    if sizes:
        bits = spark.sparkContext.broadcast(bitmap(tokens))
        seen = d.select("text").mapInArrow(C.task(_count, bits=bits, sizes=sizes, chunk_bytes=4 << 20), "token long, n long")
        counts = seen.groupBy("token").agg(F.sum("n").alias("n"))
        weighed = sets.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    else:
        weighed = sets.withColumn("n", F.lit(0).cast("long"))
    rarest = weighed.groupBy("unit").agg(F.min(F.struct("n", "token", "offset")).alias("rarest"))
    words = F.split("phrase", " ")
    prefixes = C.stash(units.join(rarest, "unit").select("unit", F.col("rarest.token").alias("token"), F.col("rarest.offset").alias("offset"), words.alias("words")))

    bits = spark.sparkContext.broadcast(bitmap(prefixes.select("token").distinct()))
    reach = {s: window - s if s == shingle else 0 for s in sizes}
    places = C.stash(d.mapInArrow(C.task(_places, bits=bits, reach=reach, chunk_bytes=4 << 20), _PLACE_DDL))
    pairs = _joined(places.where("token is not null").select("row", "token", "at", "before", "around"), prefixes)
    size, start = F.size("words"), F.col("before") - F.col("offset")
    bounded = pairs.where((start >= 0) & (start + size <= F.size("around")))
    hits = bounded.where(F.slice("around", F.when(start >= 0, start).otherwise(0) + 1, size) == F.col("words"))
    hits = C.stash(hits.select("row", "unit", (F.col("at") - F.col("offset")).alias("begin"), (F.col("at") - F.col("offset") + size).alias("end")))

    spans = hits.groupBy("row", "begin").agg(F.max("end").alias("end"))
    before = F.max("end").over(Window.partitionBy("row").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("begin"), F.coalesce(before, F.lit(0))))
    n_hit = spans.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    owners = windows.join(units, "phrase").select("unit", "item")
    held = hits.select("row", "unit").distinct().join(owners, "unit").select("row", "item").distinct()
    held = held.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = n_hit.join(held, "row")
    every = places.where("n_words is not null").select("row", "doc_id", "n_words")
    none = F.array().cast("array<string>")
    return every.join(found, "row", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"))


def op11(spark, sf_dir: str) -> DataFrame:
    found = contained(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), u AS (
  SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, least(10, len(ws)) AS m, array_to_string(ws[i:i + 9], ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)
), g AS (
  SELECT r, i, m, array_to_string(ws[i:i + m - 1], ' ') AS s
  FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT DISTINCT m FROM u))
), h AS (
  SELECT r, i, m, item FROM g JOIN u USING (m, s)
), p AS (
  SELECT r, count(DISTINCT i + j) AS n FROM h, range(0, 10) AS t(j) WHERE j < m GROUP BY r
), a AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r
)
SELECT doc_id, len(ws) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM w LEFT JOIN p USING (r) LEFT JOIN a USING (r)
"""
