"""Registered queries of target lists, scanner selection, exports read back, stored snapshots and the sink registry."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scanledger.operators import filters, store
from scanledger.operators import lifecycle as lc
from scanledger.plans import reports, sinks
from scanledger.plans.catalog import REPLAY_SQL, STATE_COLS, _ev, register
from scanledger.session import ensure_checkpoint_dir, read_table
from scanledger.sources import fixtures as fx
from scanledger.sources import targets as tg
from scanledger.sources.fixtures import EXISTING_PAGES_SQL, with_events


def _folder(spark, name: str) -> str:
    """A new folder in the shared place, for what a query writes and reads again."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register(
    "repo_list_file",
    """
SELECT trim(line) AS spec FROM (
  SELECT CASE page_id % 5 WHEN 0 THEN concat('# ', url) WHEN 1 THEN concat('  ', url, ' ') WHEN 2 THEN '   ' ELSE url END AS line FROM pages)
WHERE NOT starts_with(line, '#') AND trim(line) <> ''""",
)
def q_repo_list(spark, sf_dir):
    """The pages' addresses written as a repo-list file, with comments, blank lines and blanks, and read."""
    n, url = F.col("page_id") % 5, F.col("url")
    line = F.when(n == 0, F.concat(F.lit("# "), url)).when(n == 1, F.concat(F.lit("  "), url, F.lit(" "))).when(n == 2, F.lit("   ")).otherwise(url)
    path = _folder(spark, "repo-list")
    read_table(spark, sf_dir, "pages").select(line.alias("value")).write.text(path)
    return tg.read_repo_list(spark, path)


@register(
    "org_listing",
    """
WITH l AS (
  SELECT concat('org/repo-', c_custkey) AS full_name, concat('repo-', c_custkey) AS name, concat('https://host/org/repo-', c_custkey) AS clone_url,
    c_custkey % 7 = 0 AS fork, c_custkey % 11 = 0 AS archived FROM customer),
x AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN concat('org/repo-', s_suppkey) ELSE concat('repo-', s_suppkey) END AS name FROM supplier)
SELECT full_name AS name, clone_url AS url, 'org' AS owner, name AS repo_name FROM l
WHERE NOT fork AND NOT archived AND full_name NOT IN (SELECT name FROM x) AND name NOT IN (SELECT name FROM x)""",
)
def q_org_listing(spark, sf_dir):
    """The customers as an exported listing of an organisation, read; forks, archived and excluded repos dropped."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("repo-"), k)
    path = _folder(spark, "org-listing")
    read_table(spark, sf_dir, "customer").select(
        F.concat(F.lit("org/"), name).alias("full_name"), name.alias("name"), F.concat(F.lit("https://host/org/"), name).alias("clone_url"),
        (k % 7 == 0).alias("fork"), (k % 11 == 0).alias("archived"),
    ).write.json(path)
    listing = spark.read.schema("full_name string, name string, clone_url string, fork boolean, archived boolean").json(path)
    s = F.col("s_suppkey")
    exclude = read_table(spark, sf_dir, "supplier").select(F.concat(F.when(s % 2 == 0, F.lit("org/repo-")).otherwise(F.lit("repo-")), s).alias("name"))
    return tg.filter_repos(listing, exclude, org="org")


@register("scanner_selection", with_events() + "SELECT repo, scanner, ingest_seq FROM findings WHERE scanner IN ('gitleaks', 'trivy')")
def q_scanner_selection(spark, sf_dir):
    return filters.select_scanners(_ev(spark, sf_dir), ["gitleaks", "trivy"]).select("repo", "scanner", "ingest_seq")


_CSV = "severity, title, description, scanner, recommendation, fingerprint"


@register(
    "csv_export_read_back",
    with_events()
    + f"SELECT repo, {_CSV}, coalesce(file_path, '') AS file_path FROM findings WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')",
)
def q_csv_read_back(spark, sf_dir):
    """The CSV export of all repos, written in report order and read again."""
    path = _folder(spark, "csv-export")
    reports.export_csv(_ev(spark, sf_dir), path)
    return reports.read_csv_export(spark, path)


@register("store_export_read_back", with_events(REPLAY_SQL) + f"SELECT {STATE_COLS} FROM state WHERE severity = 'HIGH' AND status = 'open'")
def q_store_export(spark, sf_dir):
    """A store report in JSON of a stored snapshot, read again."""
    f = _ev(spark, sf_dir)
    snapshots = store.SnapshotStore(spark, _folder(spark, "snapshots"))
    snapshots.commit(lc.replay(f, fx.events_scans(f)).drop("resolved_on"))
    rows = store.query_findings(snapshots.read(), severity="high")
    path = _folder(spark, "store-export")
    reports.export_store(rows, path)
    return spark.read.schema(rows.schema).json(path)


@register(
    "sink_rows",
    with_events(EXISTING_PAGES_SQL)
    + """
, c AS (SELECT DISTINCT repo FROM scans)
SELECT 'csv' AS sink, count(*) AS n FROM findings WHERE severity <> 'INFO'
UNION ALL SELECT 'console', count(*) FROM c
UNION ALL SELECT 'email', count(*) FROM c WHERE repo IN (SELECT repo FROM findings WHERE severity = 'CRITICAL')
UNION ALL SELECT 'notion', count(*) FROM (SELECT repo, fingerprint FROM findings EXCEPT SELECT repo, fingerprint FROM existing_pages)""",
)
def q_sink_rows(spark, sf_dir):
    """Rows of each of four sinks dispatched by name over one stored input."""
    f = _ev(spark, sf_dir)
    run = sinks.Run(f, fx.events_scans(f), existing_pages=fx.existing_pages_fixture(f), run_date="2024-02-05", options={"send_on": "critical_only"})
    out = None
    for name, rows in sinks.run_sinks(run, ["csv", "console", "email", "notion"]).items():
        n = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("sink"), "n")
        out = n if out is None else out.unionByName(n)
    return out
