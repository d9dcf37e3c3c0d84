"""Scan log: one record per scan (repo, run) with its duration, finding count and scanner list.

Appends are keyed by (query, epoch): each has a folder of its own, which a replayed epoch overwrites, so that replays
add nothing. The log is never rewritten.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanledger.sources.reports import NORMALIZERS

RECORD_DDL = "repo STRING, run_date DATE, duration_seconds DOUBLE, finding_count BIGINT, scanners STRING"


def scan_records(scans: DataFrame, findings: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(repo, run_date, duration_seconds, finding_count, scanners) of every scan, those without findings included.

    ``scans`` has a row per report or part of a scan: repo, run_date, scanner, and the times ``started`` and
    ``finished`` (either may be null: no duration). Scanner names are listed in alphabetical order.
    """
    names = sorted(NORMALIZERS if names is None else names)
    ran = F.concat_ws(",", *[F.when(F.bool_or(F.col("scanner") == n), F.lit(n)) for n in names])
    seconds = F.max("finished").cast("timestamp").cast("double") - F.min("started").cast("timestamp").cast("double")
    runs = scans.groupBy("repo", "run_date").agg(seconds.alias("duration_seconds"), ran.alias("scanners"))
    counts = findings.groupBy("repo", "run_date").agg(F.count(F.lit(1)).alias("finding_count"))
    return runs.join(counts, ["repo", "run_date"], "left").select(
        "repo", "run_date", "duration_seconds", F.coalesce("finding_count", F.lit(0)).alias("finding_count"), "scanners"
    )


class ScanLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, records: DataFrame, epoch: int, query: str = "") -> None:
        """Writes the records of one epoch; the same epoch of the same query again replaces them."""
        records.select(*[c.split()[0] for c in RECORD_DDL.split(", ")]).write.mode("overwrite").parquet(
            f"{self.root}/query={query or 'batch'}/epoch={epoch}"
        )

    def read(self) -> DataFrame:
        """All records, with query and epoch; empty before the first append."""
        try:
            return self.spark.read.schema(f"{RECORD_DDL}, query STRING, epoch BIGINT").parquet(self.root)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], f"{RECORD_DDL}, query STRING, epoch BIGINT")
            raise
