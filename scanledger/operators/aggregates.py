"""Per-repo and global aggregates over findings.

All of them aggregate with partial (map-side) combine before the single
shuffle on the group key, so a repo holding a third of all rows ships one
partial row per map task, never its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanledger.functions.severity import REPORTED_SEVERITIES, SEVERITIES


def _count_of(sev: str) -> F.Column:
    return F.count_if(F.col("severity") == sev).cast("bigint")


def severity_counts(df: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Per repo: counts of the four reported levels, INFO, total (INFO included), has_critical.

    Repos of ``scans`` with no findings appear with zeros.
    """
    agg = df.groupBy("repo").agg(
        *[_count_of(s).alias(s.lower()) for s in SEVERITIES],
        F.count(F.lit(1)).cast("bigint").alias("total"),
    )
    if scans is not None:
        repos = scans.select("repo").distinct()
        agg = repos.join(agg, "repo", "left")
    cols = [s.lower() for s in SEVERITIES] + ["total"]
    return agg.select(
        "repo",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in cols],
    ).withColumn("has_critical", F.col("critical") > 0)


def passthrough_triage(df: DataFrame) -> DataFrame:
    """Triage without a model: findings grouped by severity, one row per (repo, severity).

    raw_count = triaged_count = the repo's number of findings; the summary text
    is "{n} raw findings (triage skipped)". Computed from one per-repo aggregate
    (one shuffle) and unpivoted.
    """
    counts = severity_counts(df)
    long = counts.select(
        "repo",
        "total",
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s.lower()).alias("n")) for s in SEVERITIES])
        ).alias("g"),
    ).filter(F.col("g.n") > 0)
    return long.select(
        "repo",
        F.col("g.severity").alias("severity"),
        F.col("g.n").alias("n"),
        F.col("total").alias("raw_count"),
        F.col("total").alias("triaged_count"),
        F.format_string("%d raw findings (triage skipped)", F.col("total")).alias("summary"),
    )


def gate(df: DataFrame, scans: DataFrame | None = None, ci_mode: bool = True) -> DataFrame:
    """CI gate per repo: fail iff any CRITICAL and the run is in PR / output mode."""
    c = severity_counts(df, scans)
    return c.select(
        "repo",
        "has_critical",
        "total",
        (F.col("has_critical") & F.lit(ci_mode)).alias("fail"),
    )


def run_totals(df: DataFrame) -> DataFrame:
    """Totals over all repos: findings, repos with findings, any critical (one global row)."""
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_findings"),
        F.count_distinct("repo").cast("bigint").alias("repos"),
        F.coalesce(F.bool_or(F.col("severity") == "CRITICAL"), F.lit(False)).alias("has_critical"),
    )


def scanner_counts(df: DataFrame, scan_status: DataFrame | None = None) -> DataFrame:
    """Findings per (repo, scanner), plus failed reports per (repo, scanner) when a status table is given."""
    counts = df.groupBy("repo", "scanner").agg(F.count(F.lit(1)).cast("bigint").alias("n_findings"))
    if scan_status is None:
        return counts
    errs = scan_status.groupBy("repo", "scanner").agg(
        F.count_if(~F.col("ok")).cast("bigint").alias("n_errors"),
        F.count(F.lit(1)).cast("bigint").alias("n_reports"),
    )
    out = counts.join(errs, ["repo", "scanner"], "full_outer")
    return out.select(
        "repo",
        "scanner",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_findings", "n_errors", "n_reports")],
    )


def reported_counts_columns() -> list[str]:
    return [s.lower() for s in REPORTED_SEVERITIES]
