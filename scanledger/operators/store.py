"""The findings store as versioned Parquet snapshots, and queries over it.

A table format with MERGE is not assumed. Each commit writes a complete new
snapshot ``<root>/state/v=<n>`` and then appends ``n`` to the small
``<root>/_commits`` table; readers take the highest committed version. A
snapshot being read is never overwritten, so a lost executor or a failed job
leaves the previous version intact (an uncommitted directory is just ignored).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanledger.functions.severity import parse_severity_value, severity_rank


def query_findings(
    state: DataFrame,
    repo: str | None = None,
    severity: str | None = None,
    status: str | None = "open",
    since=None,
) -> DataFrame:
    """Store query: conjunctive filters (pushed to the Parquet scan), ordered by severity rank.

    ``status`` defaults to ``open``; an empty value means no status filter.
    ``since`` compares with first_seen. Ties are broken by repo, fingerprint.
    """
    df = state
    if repo:
        df = df.filter(F.col("repo") == repo)
    if severity:
        df = df.filter(F.col("severity") == severity.upper())
    if status:
        df = df.filter(F.col("status") == status)
    if since is not None:
        df = df.filter(F.col("first_seen") >= F.lit(since).cast(state.schema["first_seen"].dataType))
    return df.orderBy(severity_rank("severity"), "repo", "fingerprint")


def scan_history(scans: DataFrame, repo: str | None = None, limit: int | None = None, ts_col: str = "run_date") -> DataFrame:
    """Newest scans first; with ``limit`` only so many rows (a top-k, planned as TakeOrderedAndProject)."""
    df = scans if repo is None else scans.filter(F.col("repo") == repo)
    out = df.orderBy(F.col(ts_col).desc(), F.col("repo"))
    return out if limit is None else out.limit(limit)


def expire(state: DataFrame, before) -> DataFrame:
    """Optional retention: drop keys last seen before ``before`` (retention is read but never applied upstream)."""
    return state.filter(F.col("last_seen") >= F.lit(before).cast(state.schema["last_seen"].dataType))


def threshold_value(severity: str | None) -> str | None:
    return None if severity is None else parse_severity_value(severity)


class SnapshotStore:
    """Versioned snapshot directory on shared storage."""

    def __init__(self, spark: SparkSession, root: str, partitions: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.partitions = partitions

    @property
    def _commits(self) -> str:
        return f"{self.root}/_commits"

    def _commit_table(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self._commits)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":  # no commit yet; any other failure must not look like one
                return None
            raise

    def latest_version(self) -> int | None:
        c = self._commit_table()
        return None if c is None else c.agg(F.max("version")).first()[0]

    def committed_epoch(self, epoch: int, query: str = "") -> bool:
        """True when micro-batch ``epoch`` of streaming query ``query`` already committed (replays are skipped).

        A stream that starts from a fresh checkpoint is another query: its epochs count from 0 again.
        """
        c = self._commit_table()
        return c is not None and not c.filter((F.col("epoch") == epoch) & (F.col("query") == query)).isEmpty()

    def path(self, version: int) -> str:
        return f"{self.root}/state/v={version}"

    def read(self) -> DataFrame | None:
        v = self.latest_version()
        return None if v is None else self.spark.read.parquet(self.path(v))

    def commit(self, state: DataFrame, epoch: int | None = None, query: str = "") -> int:
        """Write a new snapshot, clustered by (repo, fingerprint) so repo filters prune row groups.

        The snapshot directory is written first; the version becomes visible
        only when its row is appended to ``_commits``. A retry after a failure
        in between rewrites the same (never visible) version directory.
        """
        v = (self.latest_version() or 0) + 1
        # range partitioning: each file holds a narrow (repo, fingerprint) range (tight row-group
        # statistics for repo filters) and a repo with a huge share of keys spans many tasks
        keys = ["repo", "fingerprint"]
        out = state.repartitionByRange(self.partitions, *keys) if self.partitions else state.repartitionByRange(*keys)
        out.sortWithinPartitions(*keys).write.mode("overwrite").parquet(self.path(v))
        self.spark.createDataFrame([(v, epoch, query)], "version INT, epoch BIGINT, query STRING").write.mode("append").parquet(self._commits)
        return v


def repo_bucket(n_buckets: int) -> F.Column:
    """Stable bucket of a repo (hash partition of the state)."""
    return F.pmod(F.xxhash64("repo"), F.lit(n_buckets)).cast("int")


class BucketedStore(SnapshotStore):
    """Snapshot store whose commits rewrite only the repo buckets a batch touches.

    Layout: ``state/v=<n>/bucket=<b>/``; ``_commits`` holds one row per
    (version, bucket) written. The current state of bucket ``b`` is its
    highest committed version, so an incremental batch costs the size of the
    buckets it touches, not of the whole state. The driver only ever handles
    the bucket list (at most ``n_buckets`` rows).
    """

    def __init__(self, spark: SparkSession, root: str, n_buckets: int = 256):
        super().__init__(spark, root)
        self.n_buckets = n_buckets

    def _bucket_versions(self, buckets: list[int] | None = None) -> list[tuple[int, int]]:
        c = self._commit_table()
        if c is None:
            return []
        if buckets is not None:
            c = c.filter(F.col("bucket").isin(*buckets))
        last = F.max(F.struct("version", "empty")).alias("last")
        rows = c.groupBy("bucket").agg(last).collect()  # <= n_buckets rows
        return sorted((r["bucket"], r["last"]["version"]) for r in rows if not r["last"]["empty"])

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        bv = self._bucket_versions(buckets)
        if not bv:
            return None
        paths = [f"{self.path(v)}/bucket={b}" for b, v in bv]
        return self.spark.read.parquet(*paths)

    def touched_buckets(self, repos: DataFrame) -> list[int]:
        return sorted(r[0] for r in repos.select(repo_bucket(self.n_buckets)).distinct().collect())

    def commit(
        self, state: DataFrame, epoch: int | None = None, buckets: list[int] | None = None, query: str = ""
    ) -> int:
        """Write the given buckets' complete new state as version n+1 (all buckets when ``buckets`` is None).

        A bucket without rows has no folder; its commit row says that it is empty.
        """
        v = (self.latest_version() or 0) + 1
        out = state.withColumn("bucket", repo_bucket(self.n_buckets))
        keys = ["bucket", "repo", "fingerprint"]
        out = out.repartitionByRange(*keys).sortWithinPartitions(*keys)  # hot repos span several tasks
        out.write.mode("overwrite").partitionBy("bucket").parquet(self.path(v))
        bl = list(range(self.n_buckets)) if buckets is None else buckets
        # the folders just written tell which buckets have rows, without working the state out again
        written = self.spark.read.schema(out.schema).parquet(self.path(v))
        held = {r["bucket"] for r in written.select("bucket").distinct().collect()}
        rows = [(v, epoch, query, b, b not in held) for b in bl]
        ddl = "version INT, epoch BIGINT, query STRING, bucket INT, empty BOOLEAN"
        self.spark.createDataFrame(rows, ddl).write.mode("append").parquet(
            self._commits
        )
        return v
