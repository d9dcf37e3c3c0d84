"""Substring joins through an inverted index of character n-grams: which terms occur in which texts of their group.

Every term has n-grams of one size, the largest of GRAM_SIZES that fits it. The texts of a group are indexed by those
n-grams of the sizes that the group's terms have; a term with an n-gram that no text has is contained in none; any other
meets only the texts that hold its rarest n-gram, and ``contains`` decides. No pair is built but through a shared n-gram.
What is moved for each n-gram is its hash (64 bits, of group, size and n-gram) and a number, never a text; two n-grams of
one hash only make a pair more that ``contains`` refuses.

A table of n-grams has many more rows than Spark guesses from the small files of its texts, so these joins are hinted to
sort and merge: none but the sizes of the groups is ever sent through the driver, and those only if they measure few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanledger.session import stash

#: Sizes of n-grams, the largest first; a term shorter than the last is empty.
GRAM_SIZES = (12, 6, 3, 1)

#: The groups and their sizes are broadcast up to so many bytes, SIZES_BYTES a group and its name; above, they are shuffled.
BROADCAST_BYTES, SIZES_BYTES = 8 << 20, 64


def _grams(c: F.Column, size: F.Column) -> F.Column:
    """Distinct n-grams of a text that is at least ``size`` characters long."""
    n = F.length(c) - size + 1
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(c, i, size)))


def _hashes(c: F.Column, size: F.Column) -> F.Column:
    """A hash of group, size and n-gram for each distinct n-gram; none of a text that is too short."""
    hashed = F.transform(_grams(c, size), lambda gram: F.xxhash64("g", size, gram))
    return F.when(F.length(c) >= size, hashed).otherwise(F.array().cast("array<bigint>"))


def contained_terms(terms: DataFrame, texts: DataFrame, group: str, term: str, text: str) -> DataFrame:
    """The distinct (group, term) that occur in a text of the same group.

    An empty term occurs in every text. Null groups equal each other; null terms and texts take no part.
    """
    key = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group)))
    t = terms.where(F.col(term).isNotNull()).select(F.col(group).alias("_group"), key.alias("g"), F.col(term).alias("t")).distinct()
    x = texts.where(F.col(text).isNotNull()).select(key.alias("g"), F.col(text).alias("x")).distinct()
    size = F.coalesce(*[F.when(F.length("t") >= n, F.lit(n)) for n in GRAM_SIZES])
    t = stash(t.withColumn("size", size).withColumn("_t", F.monotonically_increasing_id()))
    x = stash(x.withColumn("_x", F.monotonically_increasing_id()))
    sizes = t.where("t <> ''").groupBy("g").agg(*[F.max(F.when(F.col("size") == n, F.col("size"))).alias(f"_{n}") for n in GRAM_SIZES])
    sizes = sizes.select("g", F.array_compact(F.array(*[f"_{n}" for n in GRAM_SIZES])).alias("sizes"))
    few = (sizes.agg(F.sum(F.octet_length("g") + SIZES_BYTES)).first()[0] or 0) <= BROADCAST_BYTES
    asked = t.where("t <> ''").select("_t", F.explode(_hashes(F.col("t"), F.col("size"))).alias("hash"))
    held = F.flatten(F.transform("sizes", lambda n: _hashes(F.col("x"), n)))
    index = x.join(sizes.hint("broadcast" if few else "merge"), "g").select("_x", F.explode(held).alias("hash"))
    counts = index.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    judged = asked.join(counts.hint("merge"), "hash", "left")
    rarest = judged.groupBy("_t").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash")).alias("r")).where("r.n > 0")
    pairs = rarest.select("_t", F.col("r.hash").alias("hash")).join(index.hint("merge"), "hash").select("_t", "_x")
    found = pairs.join(x.hint("merge"), "_x").withColumnRenamed("g", "_g").join(t.hint("merge"), "_t")
    found = found.where((F.col("_g") == F.col("g")) & F.contains("x", "t")).select("g", "t")
    found = found.unionByName(t.where("t = ''").join(x.select("g").distinct().hint("merge"), "g", "left_semi").select("g", "t")).distinct()
    return t.join(found.hint("merge"), ["g", "t"], "left_semi").select(F.col("_group").alias(group), F.col("t").alias(term))
