"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

A rotation is learnt on a bounded sample (the ``sample`` valid vectors with the smallest hashes of their ids): centre,
principal directions, then turns between sign codes and the rotation that fits them best. Every vector gets a binary
code of as many bits as it has dimensions (64 at most). Tables cut the code into parts of about log2(rows) - 8 bits,
so that a bucket of evenly spread codes holds some hundreds of classes, up to the 16 bits of four tables: from some 10
million classes on a bucket grows with the table (1,500 classes at 10**8; sooner with vectors of less than 64 dimensions,
whose codes are shorter). With eight tables or more, candidates agree in one part; with fewer, they may differ by one bit in it. Either way all pairs within 7 of 64 bits are candidates (cosine 0.95 is
6.5 bits apart on average). Every candidate is checked with the original vectors in double precision.

Equal vectors form a class with a number of rows, and only classes are compared; the rows of a class link with each
other by definition. Classes are nodes by number; ids come in at the end only, as the smallest of a component.

A bucket is dealt in cells of bounded size: blocks of rows at home meet blocks of the rows that look into the bucket. A
pair counts once: in the first table where it is a candidate. Cells send one row a class with its number of links and
its component within the cell, never all pairs; components then come from tables. As links are counted, unequal near
copies are still compared in pairs, cell by cell.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and give a
row of their own; vectors of different length never link; rows that share an id, or have none, are vectors like others:
they link if they are near, and join no components otherwise; a null id counts as the largest and comes back as null; an empty table gives an empty one; labels and other columns are not
read.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanledger.llm import common as C

SAMPLE = 20_000
TURNS = 30
#: Rows at home in a block, about.
BLOCK = 1024
#: Blocks' worth of looking rows in a cell, about.
LOOKING = 8


def _valid(batches, kind: str):
    """Vectors as bytes of their own type; null for those that take no part."""
    for batch in batches:
        out = []
        for v in batch.column("vector").to_pylist():
            x = np.array(v, kind) if v and None not in v else np.zeros(0)
            out.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "raw"])


def unit(raws: list[bytes], kind: str) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit(unit: np.ndarray, turns: int = TURNS, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of the sample: codes are the signs of (x - mean) @ projection."""
    mean = unit.mean(0)
    _, _, axes = np.linalg.svd(unit - mean, full_matrices=False)
    axes = axes[:bits].T
    reduced = (unit - mean) @ axes
    rotation = np.linalg.qr(np.random.default_rng(1).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(turns):
        codes = np.where(reduced @ rotation >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(reduced.T @ codes)
        rotation = u @ v
    return mean, axes @ rotation


def tables(rows: int, bits: int = 64) -> tuple[list[tuple[int, int]], int]:
    """(first bit, bits) of each table, and by how many bits candidates may differ in one."""
    count = min(bits, max(4, bits // max(1, round(math.log2(max(rows, 2))) - 8)))
    edges = [round(i * bits / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False) if b > a], int(count < 8)


def _codes(batches, model, plans: dict, kind: str):
    """A row for each table: at home in the bucket of the code's part, and one for each bit that may differ."""
    models = model.value
    names = ["tab", "bucket", "home", "cls", "n", "code", "raw"]
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            raw = part.column("raw").to_pylist()
            for size in sorted({len(r) for r in raw}):
                rows = np.array([i for i, r in enumerate(raw) if len(r) == size])
                mean, projection = models[size]
                cuts, radius = plans[size]
                signs = ((unit([raw[i] for i in rows], kind) - mean) @ projection >= 0).astype(np.uint64)
                code = (signs << np.arange(signs.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)
                tabs, buckets, homes, who = [], [], [], []
                for t, (begin, bits) in enumerate(cuts):
                    own = (code >> np.uint64(begin)) & np.uint64((1 << bits) - 1)
                    for flip in range(1 + radius * bits):
                        tabs.append(np.full(len(rows), t, np.int32))
                        buckets.append((own ^ np.uint64((1 << flip) >> 1)).astype(np.int64) + (size << 32))
                        homes.append(np.full(len(rows), not flip))
                        who.append(np.arange(len(rows)))
                who = np.concatenate(who)
                back = pa.array(rows[who])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tabs)), pa.array(np.concatenate(buckets)), pa.array(np.concatenate(homes)), *(part.column(c).take(back) for c in ("cls", "n")), pa.array(code.view(np.int64)[who]), part.column("raw").take(back)], names=names)


def _near(x: np.ndarray, y: np.ndarray, cut: tuple[int, int], radius: int) -> np.ndarray:
    """Whether codes differ by ``radius`` (0 or 1) bits at most in a table's part."""
    d = ((x ^ y) >> np.uint64(cut[0])) & np.uint64((1 << cut[1]) - 1)
    return (d & (d - np.uint64(1)) if radius else d) * (d > 0) == 0


_FOUND = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])


def _block(tab: int, home: pa.Table, looking: pa.Table, cuts: list[tuple[int, int]], radius: int, kind: str, cosine: float) -> pa.Table:
    """(cls, n, other): rows that each class at home links with, and a class of each one's component within the cell."""
    load = lambda t: (t.column("cls").to_numpy(), t.column("code").to_numpy().view(np.uint64))
    (a, ca), (b, cb) = load(home), load(looking)
    nb = looking.column("n").to_numpy()
    xa = unit(home.column("raw").to_pylist(), kind)
    nodes, place = np.unique(np.r_[a, b], return_inverse=True)
    at_a, at_b = place[: len(a)], place[len(a) :]
    links, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    for at in range(0, len(b), 1024):
        part = slice(at, at + 1024)
        i, j = np.nonzero(xa @ unit(looking.column("raw")[part].to_pylist(), kind).T >= cosine)
        j += at
        keep = (a[i] != b[j]) & _near(ca[i], cb[j], cuts[tab], radius)
        for cut in cuts[:tab]:
            keep &= ~_near(ca[i], cb[j], cut, radius)
        i, j = i[keep], j[keep]
        np.add.at(links, at_a[i], nb[j])
        label = C.merge(label, at_a[i], at_b[j])
    out = np.flatnonzero((links > 0) | (label != np.arange(len(nodes))))
    return pa.table([pa.array(nodes[out]), pa.array(links[out]), pa.array(nodes[label[out]])], schema=_FOUND)


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each vector."""
    spark = C.prepare(vectors.sparkSession)
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    d = vectors.select(C.internal_id(id_col).alias("vec_id"), F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("vector"))
    units = C.stash(d.mapInArrow(C.task(_valid, kind=kind), "vec_id long, raw binary"))
    valid = units.where("raw is not null")
    models = {}
    for row in valid.select(F.octet_length("raw").alias("size")).distinct().collect():  # a row for each number of dimensions
        taken = valid.where(F.octet_length("raw") == row["size"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("raw").collect()
        models[row["size"]] = fit(unit([bytes(r["raw"]) for r in taken], kind))
    classes = valid.groupBy("raw").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    classes = C.stash(classes.withColumn("cls", F.monotonically_increasing_id()))
    count = classes.count()
    plans = {size: tables(count, min(64, projection.shape[1])) for size, (_, projection) in models.items()}
    looks = classes.mapInArrow(C.task(_codes, model=spark.sparkContext.broadcast(models), plans=plans, kind=kind), "tab int, bucket long, home boolean, cls long, n long, code long, raw binary")
    blocks = lambda rows, size: F.ceil(rows / size).cast("int")
    held = looks.groupBy("tab", "bucket").agg(blocks(F.count_if("home"), BLOCK).alias("xs"), blocks(F.count("*"), LOOKING * BLOCK).alias("ys"))
    placed = looks.join(C.stash(held.where("xs > 0")), ["tab", "bucket"])
    cell, rest = ["tab", "bucket", "x", "y"], ["cls", "n", "code", "raw"]
    deal = lambda n, seed: F.pmod(F.xxhash64("cls", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    home = placed.where("home").withColumn("x", deal("xs", 1)).withColumn("y", each("ys")).select(*cell, *rest)
    looking = placed.withColumn("y", deal("ys", 2)).withColumn("x", each("xs")).select(*(F.col(c).alias(c) for c in cell + rest))

    def block(key, x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return _FOUND.empty_table()
        cuts, radius = plans[len(x.column("raw")[0].as_py())]
        return _block(key[0].as_py(), x, y, cuts, radius, kind, cosine)

    found = C.stash(home.groupBy(*cell).cogroup(looking.groupBy(*cell)).applyInArrow(block, "cls long, n long, other long"))
    links = found.groupBy("cls").agg(F.sum("n").alias("links"))
    comps = C.stash(C.components(found.select(F.col("cls").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "cls"))
    least = comps.join(classes.select("cls", "first"), "cls").groupBy("component").agg(F.min("first").alias("label"))
    label = C.spread_join(comps, least, "component", "cls").select("cls", "label")
    told = classes.join(links, "cls", "left").join(label, "cls", "left")
    told = told.select("raw", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("label", "first").alias("component"))
    out = units.join(told, "raw", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(C.external_id("vec_id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(component != C.NO_ID, component).alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def op6(spark, sf_dir: str) -> DataFrame:
    return near_dedup(C.table(spark, sf_dir, "embeddings"))
