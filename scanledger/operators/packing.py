"""Greedy packing of ordered items into numbered batches of bounded size, without a task that holds a whole group.

A batch takes items in order while they fit. Where a batch ends depends on where it began, back to the group's first
item; so each *cell* (CELL consecutive items of a group) works out, for every place at which a batch may begin near its
front, where the first batch that begins behind the cell would start, and how many begin in between. These maps are
composed by pointer doubling over the cells (log2 of the largest group's cells rounds), which gives each cell its true
entry and batch number. A batch holds at most ``max_items``, so no entry lies further into a cell than that.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanledger.session import ensure_checkpoint_dir, stash

# the functions on cells travel to the executors by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Items of a cell; ``max_items`` is lowered to it.
CELL = 4096
#: Items of a bucket, about: the cells that one call works on, those of many small groups among them.
BUCKET = 1 << 18


def prefix_sums(df: DataFrame, group: str, order: str | list[str], size: F.Column) -> DataFrame:
    """Adds ``position`` (from 1) and ``offset`` (sizes before it) of each row within its group, in ``order``.

    Rows are dealt into ranges of (group, order) and written once. Sums run within a range's slice of a group; what is
    ordered by group alone is one row a slice. Ties of ``order`` are broken by a row number written with the rows.
    """
    keys = [order] if isinstance(order, str) else order
    rows = stash(df.withColumn("_size", size.cast("bigint")).withColumn("_tie", F.monotonically_increasing_id()))
    rows = stash(rows.repartitionByRange(group, *keys, "_tie").withColumn("_slice", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("size")).select(
        F.col(group).alias("_group"), F.col("_slice").alias("_of"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}_before") for c in ("n", "size")],
    )
    within = Window.partitionBy(group, "_slice").orderBy(*keys, "_tie")
    placed = rows.join(slices, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_slice") == F.col("_of")))
    position = F.col("_n_before") + F.row_number().over(within)
    offset = F.col("_size_before") + F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    placed = placed.withColumn("position", position).withColumn("offset", offset)
    return placed.drop("_group", "_of", "_n_before", "_size_before", "_slice", "_tie", "_size")


def _cells(rows: pd.DataFrame, max_items: int, max_size: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """The bucket's cells, one after the other: each one's columns and where it begins, the end of its own items, and for
    each item the first one that a batch beginning with it does not take (at least the next; at most the cell's end)."""
    null = rows["grp"].isna()
    code = pd.factorize(rows["grp"].where(~null, ""))[0] * 2 + null.to_numpy()
    order = np.lexsort((rows["position"], rows["ahead"], rows["cell"], code))
    rows, code = rows.iloc[order], code[order]
    cell = rows["cell"].to_numpy()
    begin = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (cell[1:] != cell[:-1])])
    end = np.r_[begin[1:], len(rows)]
    own = begin + np.add.reduceat((~rows["ahead"].to_numpy(bool)).astype(np.int64), begin)
    ends = np.cumsum(rows["size"].to_numpy())
    at = np.arange(len(rows))
    stop = np.minimum(np.searchsorted(ends, np.r_[0, ends[:-1]] + max_size, "right"), np.repeat(end, end - begin))
    return rows.iloc[begin], begin, own, np.maximum(at + 1, np.minimum(stop, at + max_items))


def _exits(rows: pd.DataFrame, max_items: int, max_size: int) -> pd.DataFrame:
    """(entry, exit, n): for each entry of each cell the place in the next cell at which a batch begins first, and the batches before."""
    cells, begin, own, after = _cells(rows, max_items, max_size)
    limit = np.append(np.repeat(own, np.diff(np.r_[begin, len(after)])), 0)  # a place behind the last item is behind any cell
    to, n = np.arange(len(limit)), np.zeros(len(limit), np.int64)
    inside = np.flatnonzero(to < limit)
    to[inside], n[inside] = after[inside], 1
    of = limit[inside]
    while len(inside):  # leaps of 1, 2, 4 ... batches; a leap that leaves the own items stays there
        go = to[inside] < of
        inside, of = inside[go], of[go]
        n[inside], to[inside] = n[inside] + n[to[inside]], to[to[inside]]
    size = np.minimum(own - begin, max_items) + 1
    which, entry = np.repeat(np.arange(len(begin)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    place = begin[which] + entry
    on = place < own[which]
    return pd.DataFrame({
        "grp": cells["grp"].to_numpy()[which], "cell": cells["cell"].to_numpy()[which], "entry": entry,
        "exit": np.where(on, to[place] - own[which], 0), "n": np.where(on, n[place], 0),
    })


def _batches(rows: pd.DataFrame, max_items: int, max_size: int) -> pd.DataFrame:
    """The batches that begin in each cell: number, position of the first item, items."""
    cells, begin, own, after = _cells(rows, max_items, max_size)
    which, number = np.arange(len(begin)), cells["before"].to_numpy().astype(np.int64)
    at = begin + cells["entry"].to_numpy().astype(np.int64)
    out = []
    while len(which):
        live = at < own[which]
        which, number, at = which[live], number[live] + 1, at[live]
        out.append((which, number, at - begin[which], after[at] - at))
        at = after[at]
    which, number, first, n = (np.concatenate(x) for x in zip(*out, strict=True))
    first = first + cells["cell"].to_numpy()[which] * CELL + 1
    return pd.DataFrame({"grp": cells["grp"].to_numpy()[which], "batch": number, "first_position": first, "n_items": n})


def greedy_batches(items: DataFrame, max_items: int, max_size: int) -> DataFrame:
    """(grp, batch, first_position, n_items) of items (grp, position, size); an item above ``max_size`` stands alone.

    Eager: the number of doubling rounds follows the largest group.
    """
    max_items = min(max_items, CELL)

    def exits(rows: pd.DataFrame) -> pd.DataFrame:
        return _exits(rows, max_items, max_size)

    def batches(rows: pd.DataFrame) -> pd.DataFrame:
        return _batches(rows, max_items, max_size)

    at = F.floor((F.col("position") - 1) / CELL)
    own = stash(items.select("grp", "position", "size", at.alias("cell"), F.lit(False).alias("ahead")))
    front = own.where((F.col("cell") > 0) & ((F.col("position") - 1) % CELL < max_items))
    cells = own.unionByName(front.withColumn("cell", F.col("cell") - 1).withColumn("ahead", F.lit(True)))
    last, total = own.agg(F.coalesce(F.max("cell"), F.lit(0)), F.count(F.lit(1))).first()
    bucket = F.pmod(F.xxhash64("grp", "cell"), F.lit(max(8, math.ceil(total / BUCKET)))).alias("bucket")
    ensure_checkpoint_dir(items.sparkSession)

    known = own.select("grp").distinct().select("grp", F.lit(0).cast("bigint").alias("cell"), F.lit(0).cast("bigint").alias("entry"), F.lit(0).cast("bigint").alias("before"))
    if last:
        jump = cells.groupBy(bucket).applyInPandas(exits, "grp string, cell bigint, entry bigint, exit bigint, n bigint").checkpoint()
        step = 1
        while step <= last:  # entries are known of the cells before ``step``; ``jump`` leaps over so many cells
            same = [known["grp"].eqNullSafe(jump["grp"]), known["cell"] == jump["cell"], known["entry"] == jump["entry"]]
            leapt = known.join(jump, same).select(known["grp"], (known["cell"] + step).alias("cell"), jump["exit"].alias("entry"), (known["before"] + jump["n"]).alias("before"))
            exists = own.where("(position - 1) % {} = 0".format(CELL)).select(F.col("grp").alias("g"), F.col("cell").alias("c"))
            leapt = leapt.join(exists, F.col("grp").eqNullSafe(F.col("g")) & (F.col("cell") == F.col("c")), "left_semi")
            known = known.unionByName(leapt).checkpoint()
            there = jump.select(F.col("grp").alias("g"), (F.col("cell") - step).alias("c"), F.col("entry").alias("e"), F.col("exit").alias("to"), F.col("n").alias("more"))
            both = jump.join(there, F.col("grp").eqNullSafe(F.col("g")) & (F.col("cell") == F.col("c")) & (F.col("exit") == F.col("e")))
            jump = both.select("grp", "cell", "entry", F.col("to").alias("exit"), (F.col("n") + F.col("more")).alias("n")).checkpoint()
            step *= 2
    begun = cells.join(known.withColumnsRenamed({"grp": "g", "cell": "c"}), F.col("grp").eqNullSafe(F.col("g")) & (F.col("cell") == F.col("c")))
    return begun.groupBy(bucket).applyInPandas(batches, "grp string, batch bigint, first_position bigint, n_items bigint")
