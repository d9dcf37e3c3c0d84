"""Trends over the scans of a repo: what each run changed against the run before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanledger.operators.lifecycle import KEY, run_numbers


def key_events(findings: DataFrame, scans: DataFrame, run_col: str = "run_date") -> DataFrame:
    """(repo, run, event): each key's new, resolved and reopened run (reopened is absorbing, as in ``replay``)."""
    runs = run_numbers(scans, run_col)
    seen = findings.select(*KEY, run_col).distinct().join(runs, ["repo", run_col])
    w = Window.partitionBy(*KEY).orderBy("seq")
    seen = seen.withColumn("rn", F.row_number().over(w)).withColumn("f0", F.min("seq").over(Window.partitionBy(*KEY)))
    first = F.col("seq") - F.col("rn") + 1 == F.col("f0")
    keys = seen.groupBy(*KEY).agg(
        F.min(run_col).alias("new"),
        F.max(F.when(first, F.struct("seq", "next_run")))["next_run"].alias("resolved"),
        F.min(F.when(~first, F.col(run_col))).alias("reopened"),
    )
    events = F.array(*[F.struct(F.col(e).alias("run"), F.lit(e).alias("event")) for e in ("new", "resolved", "reopened")])
    return keys.select("repo", F.explode(events).alias("e")).where("e.run is not null").select("repo", F.col("e.run").alias(run_col), "e.event")


def trend_deltas(findings: DataFrame, scans: DataFrame, run_col: str = "run_date") -> DataFrame:
    """Per repo and run: raw findings, keys open after it, keys it resolved, and their change since the run before.

    Every run of ``scans`` counts, those without findings too; a repo's first run has null changes. What is ordered
    within a repo is one row a run, never its findings.
    """
    totals = findings.groupBy("repo", run_col).agg(F.count(F.lit(1)).alias("total"))
    happened = key_events(findings, scans, run_col).groupBy("repo", run_col).agg(
        *[F.count_if(F.col("event") == e).alias(e) for e in ("new", "resolved", "reopened")]
    )
    runs = run_numbers(scans, run_col).select("repo", run_col, F.col("seq").cast("bigint").alias("run_no"))
    per_run = runs.join(totals, ["repo", run_col], "left").join(happened, ["repo", run_col], "left").fillna(0)
    w = Window.partitionBy("repo").orderBy("run_no")
    left = F.sum(F.col("new") - F.col("resolved") + F.col("reopened")).over(w)
    per_run = per_run.withColumn("open", left)
    return per_run.select(
        "repo", run_col, "run_no", "total", "open", "resolved",
        *[(F.col(c) - F.lag(c).over(w)).alias(f"{c}_delta") for c in ("total", "open", "resolved")],
    )
