"""Directed reachability over dependency edges: which packages a repo's root packages need, directly or not."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanledger.session import stash

# the function on buckets travels to the executors by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE = ["repo", "package"]
#: Edges of a bucket, on average; a repo with more is dealt over several buckets by package.
BUCKET = 1 << 20
LEAST_BUCKETS = 8


def _reach(rows: pa.Table) -> pa.Table:
    """The distinct nodes of a bucket that are its roots (rows without a dependency) or reached from one along its edges."""
    repo, package, dependency = (rows.column(c).combine_chunks() for c in (*NODE, "dependency"))
    repos = repo.dictionary_encode()
    is_edge = dependency.is_valid().to_numpy(zero_copy_only=False)
    names = pa.concat_arrays([package, dependency.drop_null()]).dictionary_encode()
    name, of = names.indices.to_numpy().astype(np.int64), repos.indices.to_numpy().astype(np.int64)
    width = len(names.dictionary)
    here = of * width + name[: len(of)]
    nodes, at = np.unique(np.r_[here, of[is_edge] * width + name[len(of) :]], return_inverse=True)
    source, target, new = at[: len(of)][is_edge], at[len(of) :], np.unique(at[: len(of)][~is_edge])
    target = target[np.argsort(source, kind="stable")]
    count = np.bincount(source, minlength=len(nodes))
    begin = np.cumsum(count) - count
    known = np.zeros(len(nodes), bool)
    while len(new):
        known[new] = True
        n = count[new]
        edges = np.repeat(begin[new] - np.cumsum(n) + n, n) + np.arange(n.sum())
        new = np.unique(target[edges])
        new = new[~known[new]]
    found = nodes[known]
    out = [repos.dictionary.take(pa.array(found // width)), names.dictionary.take(pa.array(found % width))]
    return pa.table([pa.array(np.full(len(found), rows.column("bucket")[0].as_py())), *out], names=["bucket", *NODE])


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The distinct (repo, package) that are roots or reached from one along ``edges`` (repo, package, dependency).

    Edges are dealt by repo into buckets of bounded size, and a task follows a bucket's paths to their ends: what is
    moved does not grow with the length of paths. Only a repo of more than ``BUCKET`` edges lies in several buckets;
    packages of other buckets that a round finds there are the next round's roots, of their buckets alone, until none
    is new. Cycles end too.
    """
    edges = stash(edges.select(*NODE, "dependency").where("repo is not null and package is not null and dependency is not null"))
    roots = roots.select(*NODE).where("repo is not null and package is not null")
    sizes = edges.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    great = sizes.where(F.col("n") > BUCKET).select("repo", F.ceil(F.col("n") / BUCKET).alias("ways"))
    n, most = sizes.agg(F.sum("n"), F.max("n")).first()
    buckets, split = max(LEAST_BUCKETS, math.ceil((n or 0) / BUCKET)), (most or 0) > BUCKET

    def dealt(df: DataFrame) -> DataFrame:
        way = F.lit(0).cast("bigint")
        if split:  # at most a repo for each BUCKET edges
            df, way = df.join(F.broadcast(great), "repo", "left"), F.pmod(F.xxhash64("package"), F.coalesce("ways", F.lit(1).cast("bigint")))
        return df.withColumn("bucket", F.pmod(F.xxhash64("repo", way), F.lit(buckets))).drop("ways")

    def reach(new: DataFrame, among: DataFrame) -> DataFrame:
        rows = among.unionByName(new.select("bucket", *NODE, F.lit(None).cast("string").alias("dependency")))
        return stash(rows.groupBy("bucket").applyInArrow(_reach, "bucket bigint, repo string, package string"))

    edges = dealt(edges)
    found = reach(dealt(roots), edges)
    if not split:
        return found.select(*NODE)
    while True:
        home = dealt(found.withColumnRenamed("bucket", "_in"))
        known = home.where("bucket = _in").select(*NODE)
        new = stash(home.where("bucket <> _in").select("bucket", *NODE).distinct().join(known, NODE, "left_anti"))
        if new.isEmpty():
            return known
        found = found.unionByName(reach(new, edges.join(F.broadcast(new.select("bucket").distinct()), "bucket", "left_semi")))


def production_only(inventory: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of ``inventory`` (repo, package, ...) whose package a production root needs: development-only ones go."""
    return inventory.join(reachable(roots, edges), NODE, "left_semi")
