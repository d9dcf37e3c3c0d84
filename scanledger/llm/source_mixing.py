"""Mixing sources to target weights by entropy balancing.

Sources, in code-point order with null last, get weights that repeat a given list and share all words; no target
exceeds ``cap`` times its source's words, and what is over is shared again by weight until none is above.

A document of size s gets the rate min(cap, exp(l * s / mean size of its source)): the weights nearest to one copy
each, in entropy, that give the source its words. The multiplier l of each source solves the convex dual. Documents
are counted by (source, size) once; each Newton iteration is one job over these counts, kept within a bracket, until
every source is within 1e-9 of its target. Rates are then rounded into whole copies: within a source the
copies are rounded from the largest size down, what is left over passing on to the next, so that the words taken miss
the target by about the smallest documents; within a size the documents with the smallest hashes of their ids get the
extra copy, so reruns agree.

Defined cases: a null text has size 0 and is taken 0 words (its rate is 1 copy); a source without words has target 0;
null is a source of its own; equal rows each give a row; an empty table gives an empty one; only the named columns
are read. All documents count; a size that many documents share is ranked in bounded hashed cells.
"""

from __future__ import annotations

import math
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanledger.llm import common as C

#: Documents ranked in one cell, about.
CELL = 256
ITERATIONS = 60


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, key, size); key is never null and distinguishes null from the empty name."""
    source = F.col(source_col).cast("string")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(C.WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"), size.alias("size"))


def _ranked(names: DataFrame) -> DataFrame:
    """Adds ``place`` (from 0) in the order of the sources: sorted in ranges, so no task holds all of them."""
    order = names.orderBy(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id())
    order = C.stash(order.withColumn("part", F.shiftright("at", 33)))
    counts = order.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n"))  # a row for each sorted range
    return order.join(before, "part").withColumn("place", F.col("before") + F.col("at") - F.shiftleft(F.col("part"), 33)).drop("at", "part", "before", "n")


def targets(rows: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, key, docs, source_size, smallest, target) of each source."""
    by = rows.groupBy("source", "key").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("smallest"))
    by = _ranked(by).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int")))
    by = C.stash(by.drop("place").withColumn("full", F.lit(False)))
    while True:
        total, fixed, free = by.agg(F.sum("source_size"), F.sum(F.when(F.col("full"), cap * F.col("source_size"))), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
        share = (float(total or 0) - float(fixed or 0)) / free if free else 0.0
        over = ~F.col("full") & (F.col("weight") * share > cap * F.col("source_size"))
        if by.where(over).isEmpty():
            break
        by = C.stash(by.withColumn("full", F.col("full") | over))
    target = F.when(F.col("full"), cap * F.col("source_size")).otherwise(F.col("weight") * share)
    return C.stash(by.select("source", "key", "docs", "source_size", "smallest", target.cast("double").alias("target")))


def multipliers(counts: DataFrame, goal: DataFrame, cap: float) -> DataFrame:
    """(key, mean, l) of each source that has words: the dual's solution, by Newton steps on log F(l) = log target."""
    has = goal.where("source_size > 0 and target > 0").withColumn("mean", F.col("source_size") / F.col("docs"))
    z_min = F.col("smallest") / F.col("mean")
    state = C.stash(
        has.select(
            "key", "mean", "target", F.lit(0.0).alias("l"),
            F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")) / z_min).alias("low"),
            (F.log(F.lit(float(cap))) / z_min).alias("high"), F.lit(False).alias("done"),
        )
    )
    for _ in range(ITERATIONS):
        raw = F.exp(F.least(F.col("l") * F.col("size") / F.col("mean"), F.lit(700.0)))
        words = F.col("n") * F.col("size")
        sums = counts.join(state.where("not done").select("key", "l", "mean"), "key").groupBy("key").agg(
            F.sum(words * F.least(raw, F.lit(float(cap)))).alias("f"),
            F.sum(F.when(raw < cap, words * F.col("size") / F.col("mean") * raw).otherwise(0.0)).alias("slope"),
        )
        s = state.join(sums, "key", "left")
        f, slope, l, target = F.col("f"), F.col("slope"), F.col("l"), F.col("target")
        close = F.col("done") | (F.abs(f - target) <= 1e-9 * target) | (F.col("high") - F.col("low") <= 1e-15 * F.greatest(F.abs("low"), F.abs("high")))
        low, high = F.when(f < target, l).otherwise(F.col("low")), F.when(f > target, l).otherwise(F.col("high"))
        step = F.when(slope > 0, l - F.log(f / target) * f / slope)
        inside = step.isNotNull() & (step > low) & (step < high)
        moved = F.when(inside, step).otherwise((low + high) / 2)
        state = C.stash(s.select("key", "mean", "target", F.when(close, l).otherwise(moved).alias("l"), F.when(close, F.col("low")).otherwise(low).alias("low"), F.when(close, F.col("high")).otherwise(high).alias("high"), close.alias("done")))
        if state.where("not done").isEmpty():
            break
    return state.select("key", "mean", "l")


def _rounded(sizes: pd.DataFrame, cap: int) -> pd.DataFrame:
    """Extra copies of each size of one source (a row for each size, so at most as many as the longest document has words).

    From the largest size down, each size takes the number of extra copies that brings the words taken so far nearest
    to the words wanted so far.
    """
    sizes = sizes.sort_values("size", ascending=False)
    owed, extra = 0.0, []
    for size, n, rate in zip(sizes["size"].tolist(), sizes["n"].tolist(), sizes["rate"].tolist(), strict=True):
        owed += n * (rate - math.floor(rate)) * size
        take = min(n, max(0, round(owed / size))) if size and rate < cap else 0
        owed -= take * size
        extra.append(take)
    return sizes[["key", "size", "rate"]].assign(extra=extra)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies), a row for each document."""
    rows = C.stash(sizes(docs, id_col, text_col, source_col))
    goal = targets(rows, weights, cap)
    counts = C.stash(rows.groupBy("key", "size").agg(F.count("*").alias("n")))
    solved = multipliers(counts, goal, cap)
    rated = counts.join(solved, "key", "left").withColumn("rate", F.coalesce(F.least(F.lit(float(cap)), F.exp(F.least(F.col("l") * F.col("size") / F.col("mean"), F.lit(700.0)))), F.lit(1.0)))
    rated = rated.groupBy("key").applyInPandas(partial(_rounded, cap=cap), "key string, size long, rate double, extra long")
    cells = max(1, -(-(counts.agg(F.max("n")).first()[0] or 0) // CELL))
    draw = F.xxhash64("doc_id")
    rows = rows.withColumn("draw", draw).withColumn("cell", F.floor((F.shiftrightunsigned("draw", 32) * cells) / F.lit(float(1 << 32))).cast("long"))
    held = rows.groupBy("key", "size", "cell").agg(F.count("*").alias("held"))
    before = held.withColumn("before", F.sum("held").over(W.partitionBy("key", "size").orderBy("cell")) - F.col("held"))
    plan = C.stash(before.join(rated.select("key", "size", "rate", "extra"), ["key", "size"]).select("key", "size", "cell", "before", "rate", "extra"))
    rank = F.row_number().over(W.partitionBy("key", "size", "cell").orderBy(F.shiftrightunsigned("draw", 32), "draw", "doc_id"))
    out = rows.withColumn("rank", rank).join(plan, ["key", "size", "cell"]).withColumn("copies", F.floor("rate").cast("long") + (F.col("before") + F.col("rank") <= F.col("extra")).cast("long"))
    return out.join(goal.select("key", "source_size", "target"), "key").select("doc_id", "source", "size", "source_size", "target", "rate", "copies")


def op5(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(C.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")
