"""Continuous ingest: a stream of raw reports -> normalised findings -> lifecycle state.

Structured Streaming file source (JSON Lines, one raw report per line, explicit
schema) with ``foreachBatch``: each micro-batch is normalised, its sightings
(one row per repo, fingerprint and run) are folded into those held, the touched
repo buckets' states are made anew, and a new snapshot of them is committed. So
a run may arrive in any number of batches, and runs in any order, with the same
state. Runs older than a repo's newest ``open_runs`` are sealed: their sightings
go into a summary of one row a key (``operators.sealing``) and are dropped, so
what is held and rewritten is a row a key and the sightings of the open runs.
Reports of a sealed run come too late; they are kept in ``late``, not folded.

Sightings, summary and state commit one after the other. The summary names each
repo's last sealed run, and sightings up to it are ignored, so a failure in
between counts nothing twice. Commits carry the query id and the batch epoch: a
replayed epoch skips what is committed (exactly-once state), and the per-batch
scan-status, scan-log and late tables are folders of their epoch, overwritten.
State lives on shared storage, so each batch starts from Parquet: no lineage
grows across batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanledger.operators.lifecycle import KEY, STATE_COLUMNS, fold_sightings
from scanledger.operators.scan_log import ScanLog, scan_records
from scanledger.operators.sealing import merge_summaries, sealable, summarise, summary_state, unsealed
from scanledger.operators.store import BucketedStore
from scanledger.sources.reports import normalize

RAW_DDL = (
    "repo STRING, run_id STRING, run_date DATE, scanner STRING, source_path STRING, report_seq BIGINT, payload STRING"
)


#: Runs of a repo, the newest, that may still receive reports.
OPEN_RUNS = 8


def fold_batch(
    spark: SparkSession, findings: DataFrame, scans: DataFrame, touched: list[int], epoch: int, store_root: str,
    n_buckets: int, query: str, open_runs: int | None,
) -> None:
    """Adds a batch to the sightings of the touched buckets and seals the runs that it makes old enough."""
    seen, summaries = (BucketedStore(spark, f"{store_root}/{t}", n_buckets) for t in ("sightings", "summaries"))
    held, sealed = seen.read(touched), summaries.read(touched)
    late = findings if sealed is None else findings.join(unsealed(findings.select("repo", "run_date").distinct(), sealed), ["repo", "run_date"], "left_anti")
    if sealed is not None:
        late.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{store_root}/late/query={query or 'batch'}/epoch={epoch}")
    held = None if held is None else unsealed(held, sealed)
    seen.commit(fold_sightings(held, unsealed(findings, sealed), unsealed(scans, sealed)), epoch=epoch, buckets=touched, query=query)
    held = seen.read(touched)
    if open_runs is None or held is None:
        return
    old = sealable(held, open_runs)
    if not old.isEmpty():
        sealing = summarise(old)
        sealed = sealing if sealed is None else merge_summaries(sealed, sealing)
        summaries.commit(sealed, epoch=epoch, buckets=touched, query=query)


def ledger_summary(spark: SparkSession, store_root: str, n_buckets: int, buckets: list[int] | None = None) -> DataFrame | None:
    """Summary of all runs, sealed and open, of the buckets (all: None); null before the first commit."""
    seen, sealed = (BucketedStore(spark, f"{store_root}/{t}", n_buckets).read(buckets) for t in ("sightings", "summaries"))
    if seen is None:
        return sealed
    still = summarise(unsealed(seen, sealed))
    return still if sealed is None else merge_summaries(sealed, still)


def process_batch(
    spark: SparkSession, batch: DataFrame, epoch: int, store_root: str, n_buckets: int = 256, query: str = "",
    open_runs: int | None = OPEN_RUNS,
) -> int | None:
    """Normalise one batch of raw reports and fold it into the store. Returns the committed version.

    Only the buckets of the repos in the batch are read and rewritten. Suppressed keys of the stored state stay as
    they are. ``open_runs``: None seals nothing. Columns ``started`` and ``finished`` of the batch, if there, give the
    durations of the scan log. A state without sightings (of a former layout) is refused.
    """
    store = BucketedStore(spark, store_root, n_buckets)
    if store.committed_epoch(epoch, query):
        return None
    # several actions below: read and parse the micro-batch once; a lost
    # executor only means recomputing from the source files
    batch = batch.persist()
    findings, status = normalize(batch)
    findings = findings.drop("raw").persist()
    try:
        status.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(
            f"{store_root}/scan_status/epoch={epoch}"
        )
        times = {c: F.col(c) if c in batch.columns else F.lit(None).cast("timestamp") for c in ("started", "finished")}
        ScanLog(spark, f"{store_root}/scan_log").append(scan_records(batch.withColumns(times), findings), epoch, query)
        scans = batch.select("repo", "run_id", "run_date").distinct()
        touched = store.touched_buckets(scans.select("repo"))
        if not touched:
            return None
        old = store.read(touched)
        if old is not None and BucketedStore(spark, f"{store_root}/sightings", n_buckets).latest_version() is None:
            raise ValueError(f"{store_root} holds state without sightings; ingest its reports anew")
        if not BucketedStore(spark, f"{store_root}/summaries", n_buckets).committed_epoch(epoch, query):
            fold_batch(spark, findings, scans, touched, epoch, store_root, n_buckets, query, open_runs)
        new_state = summary_state(ledger_summary(spark, store_root, n_buckets, touched)).select(*STATE_COLUMNS)
        if old is not None:
            suppressed = old.where("status = 'suppressed'").select(*STATE_COLUMNS)
            new_state = new_state.join(suppressed, KEY, "left_anti").unionByName(suppressed)
        return store.commit(new_state, epoch=epoch, buckets=touched, query=query)
    finally:
        findings.unpersist()
        batch.unpersist()


def ingest_stream(
    spark: SparkSession,
    source_dir: str,
    store_root: str,
    checkpoint_location: str,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
    n_buckets: int = 256,
    open_runs: int | None = OPEN_RUNS,
):
    """Start the ingest query; with ``available_now`` it drains the backlog and stops.

    ``checkpoint_location`` (shared storage) names the stream: commits carry its query id and epoch.
    """
    reader = spark.readStream.schema(RAW_DDL)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.json(source_dir)

    def fold(df: DataFrame, epoch: int) -> None:
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        process_batch(spark, df, epoch, store_root, n_buckets, query, open_runs)

    writer = raw.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
