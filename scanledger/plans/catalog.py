"""Registered queries (Spark) and their DuckDB oracle SQL.

Each query reads the driver tables under ``sf_dir`` (or data Spark derives from
them) and returns a DataFrame. ``ORACLES[name]`` is SQL text computing the same
rows on the same tables; column names match one to one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanledger.functions.severity import at_or_above
from scanledger.operators import aggregates as agg
from scanledger.operators import detect
from scanledger.operators import filters
from scanledger.operators import lifecycle as lc
from scanledger.operators import store
from scanledger.operators import triage
from scanledger.plans import reports
from scanledger.session import read_table
from scanledger.sources import fixtures as fx
from scanledger.sources.fixtures import (
    EXISTING_PAGES_SQL, INVENTORY_SQL, OPEN_ISSUES_SQL, SUPPRESSIONS_SQL, with_events,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Parameters of the registered queries (fixed per query, never tuned to pass).
DIGEST_DATE = "2024-02-05"
SINCE = "2024-01-15"
CAP = triage.MAX_FINDINGS


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return deco


def _ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.FINDINGS.get()(spark, sf_dir)


def _last_run(f: DataFrame):
    """Latest run date of the fixture, as a scalar subquery (no cross join, no collect)."""
    return f.select(F.max("run_date")).scalar()


# --------------------------------------------------------------------------- replay SQL (oracle)

def _replay_sql(scope: str = "repo", resolve_reopened: bool = False) -> str:
    part = "repo" if scope == "repo" else "repo, scanner"
    scans_src = "scans" if scope == "repo" else "(SELECT DISTINCT repo, scanner, run_date FROM findings)"
    sight_keys = "repo, fingerprint, run_date" + ("" if scope == "repo" else ", scanner")
    join_on = "s.repo = r.repo AND s.run_date = r.run_date" + ("" if scope == "repo" else " AND s.scanner = r.scanner")
    if resolve_reopened:
        status = "CASE WHEN f0 + isl - 1 = n THEN 'open' WHEN lastr.seq = n THEN 'reopened' ELSE 'resolved' END"
        resolved_on = "lastr.nr"
    else:
        status = "CASE WHEN f0 + isl - 1 = n THEN 'open' WHEN na > isl THEN 'reopened' ELSE 'resolved' END"
        resolved_on = "iend.nr"
    return f"""
runs AS (
  SELECT {part}, run_date,
         row_number() OVER (PARTITION BY {part} ORDER BY run_date) AS seq,
         lead(run_date) OVER (PARTITION BY {part} ORDER BY run_date) AS next_run,
         count(*) OVER (PARTITION BY {part}) AS n_runs
  FROM (SELECT DISTINCT {part}, run_date FROM {scans_src})
),
sight AS (
  SELECT {sight_keys},
         arg_min({{'scanner': scanner, 'file_path': file_path, 'line': line}}, ingest_seq) AS fst,
         arg_max({{'severity': severity, 'title': title, 'description': description,
                  'recommendation': recommendation}}, ingest_seq) AS lst
  FROM findings GROUP BY {sight_keys}
),
isl AS (
  SELECT s.repo, s.fingerprint, s.run_date, s.fst, s.lst, r.seq, r.next_run, r.n_runs,
         r.seq - row_number() OVER (PARTITION BY s.repo, s.fingerprint ORDER BY r.seq) + 1
           = min(r.seq) OVER (PARTITION BY s.repo, s.fingerprint) AS in_isl
  FROM sight s JOIN runs r ON {join_on}
),
keyagg AS (
  SELECT repo, fingerprint, min(seq) AS f0, count(*) FILTER (WHERE in_isl) AS isl, count(*) AS na,
         max(n_runs) AS n, min(run_date) AS first_seen, max(run_date) AS last_seen,
         arg_min(fst, seq) AS fst, arg_max(lst, seq) AS lst,
         arg_max({{'nr': next_run}}, seq) FILTER (WHERE in_isl) AS iend,
         arg_max({{'seq': seq, 'nr': next_run}}, seq) AS lastr
  FROM isl GROUP BY repo, fingerprint
),
state AS (
  SELECT repo, fingerprint, fst.scanner AS scanner, lst.severity AS severity, lst.title AS title,
         lst.description AS description, fst.file_path AS file_path, fst.line AS line,
         lst.recommendation AS recommendation, first_seen, last_seen,
         {status} AS status,
         {resolved_on} AS resolved_on
  FROM keyagg
)"""


REPLAY_SQL = _replay_sql()

STATE_COLS = (
    "repo, fingerprint, scanner, severity, title, description, file_path, line, recommendation, "
    "first_seen, last_seen, status"
)


# --------------------------------------------------------------------------- core findings


@register(
    "fingerprint_findings",
    with_events()
    + "SELECT repo, run_date, ingest_seq, scanner, severity, title, description, file_path, line, recommendation,"
    " rule_id, fingerprint FROM findings",
)
def q_fingerprint_findings(spark, sf_dir):
    return _ev(spark, sf_dir).select(*fx.FINDING_COLUMNS)


@register(
    "severity_counts_by_repo",
    with_events()
    + """
, a AS (
  SELECT repo,
    count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high,
    count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low,
    count(*) FILTER (WHERE severity = 'INFO') AS info, count(*) AS total
  FROM findings GROUP BY repo)
SELECT r.repo, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium,
  coalesce(low, 0) AS low, coalesce(info, 0) AS info, coalesce(total, 0) AS total,
  coalesce(critical, 0) > 0 AS has_critical
FROM (SELECT DISTINCT repo FROM scans) r LEFT JOIN a ON r.repo = a.repo""",
)
def q_severity_counts(spark, sf_dir):
    f = _ev(spark, sf_dir)
    return agg.severity_counts(f, fx.events_scans(f))


@register(
    "passthrough_triage",
    with_events()
    + """
, t AS (SELECT repo, count(*) AS total FROM findings GROUP BY repo)
SELECT f.repo, f.severity, count(*) AS n, t.total AS raw_count, t.total AS triaged_count,
  concat(t.total, ' raw findings (triage skipped)') AS summary
FROM findings f JOIN t ON f.repo = t.repo GROUP BY f.repo, f.severity, t.total""",
)
def q_passthrough(spark, sf_dir):
    return agg.passthrough_triage(_ev(spark, sf_dir))


_THRESH_SQL = (
    with_events()
    + "SELECT repo, ingest_seq, severity, fingerprint FROM findings WHERE severity IN ({})"
)


@register("severity_threshold_rank", _THRESH_SQL.format("'CRITICAL', 'HIGH', 'MEDIUM', 'LOW'"))
def q_threshold_rank(spark, sf_dir):
    f = filters.severity_at_least(_ev(spark, sf_dir), "LOW", order="rank")
    return f.select("repo", "ingest_seq", "severity", "fingerprint")


@register("severity_threshold_lexical", _THRESH_SQL.format("'CRITICAL', 'HIGH', 'LOW', 'INFO'"))
def q_threshold_lexical(spark, sf_dir):
    f = filters.severity_at_least(_ev(spark, sf_dir), "LOW", order="lexical")
    return f.select("repo", "ingest_seq", "severity", "fingerprint")


@register(
    "repo_gate",
    with_events()
    + """
SELECT repo, bool_or(severity = 'CRITICAL') AS has_critical, count(*) AS total,
  bool_or(severity = 'CRITICAL') AS fail
FROM findings GROUP BY repo""",
)
def q_gate(spark, sf_dir):
    f = _ev(spark, sf_dir)
    return agg.gate(f, fx.events_scans(f))


@register(
    "run_totals",
    with_events()
    + "SELECT count(*) AS total_findings, count(DISTINCT repo) AS repos,"
    " coalesce(bool_or(severity = 'CRITICAL'), false) AS has_critical FROM findings",
)
def q_run_totals(spark, sf_dir):
    return agg.run_totals(_ev(spark, sf_dir))


@register(
    "scanner_counts",
    with_events() + "SELECT repo, scanner, count(*) AS n_findings FROM findings GROUP BY repo, scanner",
)
def q_scanner_counts(spark, sf_dir):
    return agg.scanner_counts(_ev(spark, sf_dir))


# --------------------------------------------------------------------------- lifecycle


@register("lifecycle_replay", with_events(REPLAY_SQL) + f"SELECT {STATE_COLS}, resolved_on FROM state")
def q_replay(spark, sf_dir):
    f = _ev(spark, sf_dir)
    return lc.replay(f, fx.events_scans(f))


@register("lifecycle_merge_last_run", with_events(REPLAY_SQL) + f"SELECT {STATE_COLS} FROM state")
def q_merge_last_run(spark, sf_dir):
    """State of all runs but the last, merged with the last run -- must equal the one-shot replay."""
    f = _ev(spark, sf_dir)
    last = _last_run(f)
    prior = f.filter(F.col("run_date") < last)
    batch = f.filter(F.col("run_date") == last)
    state0 = lc.replay(prior, fx.events_scans(prior)).drop("resolved_on")
    new_state, _ = lc.merge_batch(state0, batch, fx.events_scans(batch))
    return new_state


@register(
    "run_delta_metrics",
    with_events(REPLAY_SQL)
    + """
, tot AS (SELECT repo, run_date, count(*) AS total,
            count(DISTINCT CASE WHEN fingerprint <> '' THEN fingerprint END) AS active
          FROM findings GROUP BY repo, run_date),
nw AS (SELECT repo, first_seen AS run_date, count(*) AS new FROM state GROUP BY repo, first_seen),
rs AS (SELECT repo, resolved_on AS run_date, count(*) AS resolved FROM state
       WHERE resolved_on IS NOT NULL GROUP BY repo, resolved_on)
SELECT s.repo, s.run_date, coalesce(tot.total, 0) AS total, coalesce(tot.active, 0) AS active,
  coalesce(nw.new, 0) AS new, coalesce(rs.resolved, 0) AS resolved
FROM (SELECT DISTINCT repo, run_date FROM scans) s
LEFT JOIN tot ON s.repo = tot.repo AND s.run_date = tot.run_date
LEFT JOIN nw ON s.repo = nw.repo AND s.run_date = nw.run_date
LEFT JOIN rs ON s.repo = rs.repo AND s.run_date = rs.run_date""",
)
def q_run_deltas(spark, sf_dir):
    f = _ev(spark, sf_dir)
    return lc.run_deltas(f, fx.events_scans(f))


_LAST_SQL = "lastrun AS (SELECT max(run_date) AS d FROM findings)"


@register(
    "new_findings_only",
    with_events(_LAST_SQL)
    + """
SELECT b.repo, b.ingest_seq, b.severity, b.fingerprint FROM findings b, lastrun
WHERE b.run_date = lastrun.d AND NOT EXISTS (
  SELECT 1 FROM findings p WHERE p.run_date < lastrun.d AND p.repo = b.repo AND p.fingerprint = b.fingerprint)""",
)
def q_new_only(spark, sf_dir):
    f = _ev(spark, sf_dir)
    last = _last_run(f)
    prior = f.filter(F.col("run_date") < last)
    state = lc.replay(prior, fx.events_scans(prior))
    batch = f.filter(F.col("run_date") == last)
    return filters.new_only(batch, state).select("repo", "ingest_seq", "severity", "fingerprint")


@register(
    "dedup_new_notifications",
    with_events(_LAST_SQL)
    + """
, b AS (SELECT f.* FROM findings f, lastrun WHERE f.run_date = lastrun.d),
firsts AS (SELECT repo, fingerprint, min(ingest_seq) AS s FROM b GROUP BY repo, fingerprint)
SELECT b.repo, b.ingest_seq, b.severity, b.fingerprint FROM b JOIN firsts
  ON b.repo = firsts.repo AND b.fingerprint = firsts.fingerprint AND b.ingest_seq = firsts.s
WHERE NOT EXISTS (SELECT 1 FROM findings p, lastrun
  WHERE p.run_date < lastrun.d AND p.repo = b.repo AND p.fingerprint = b.fingerprint)""",
)
def q_dedup_new(spark, sf_dir):
    """Batch rows emitted by dedup (first sighting of each key new to the store)."""
    f = _ev(spark, sf_dir)
    last = _last_run(f)
    prior = f.filter(F.col("run_date") < last)
    batch = f.filter(F.col("run_date") == last)
    state0 = lc.replay(prior, fx.events_scans(prior)).drop("resolved_on")
    _, emitted = lc.merge_batch(state0, batch, fx.events_scans(batch))
    return emitted.select("repo", "ingest_seq", "severity", "fingerprint")


@register(
    "suppressed_filtered",
    with_events(SUPPRESSIONS_SQL)
    + """
SELECT f.repo, f.ingest_seq, f.fingerprint FROM findings f
WHERE NOT EXISTS (SELECT 1 FROM suppressions s WHERE s.repo = f.repo AND s.fingerprint = f.fingerprint)""",
)
def q_suppressed(spark, sf_dir):
    f = _ev(spark, sf_dir)
    return filters.drop_suppressed(f, fx.suppressions_fixture(f)).select("repo", "ingest_seq", "fingerprint")


@register(
    "lifecycle_with_suppressions",
    with_events(REPLAY_SQL, SUPPRESSIONS_SQL)
    + """
SELECT st.repo, st.fingerprint, scanner, severity, title, description, file_path, line, recommendation,
  first_seen, last_seen,
  CASE WHEN s.fingerprint IS NOT NULL THEN 'suppressed' ELSE status END AS status, resolved_on
FROM state st LEFT JOIN suppressions s ON st.repo = s.repo AND st.fingerprint = s.fingerprint""",
)
def q_replay_suppressed(spark, sf_dir):
    f = _ev(spark, sf_dir)
    return lc.replay(f, fx.events_scans(f), suppressions=fx.suppressions_fixture(f))


@register(
    "store_query_open_critical",
    with_events(REPLAY_SQL) + f"SELECT {STATE_COLS} FROM state WHERE severity = 'CRITICAL' AND status = 'open'",
)
def q_store_open_critical(spark, sf_dir):
    f = _ev(spark, sf_dir)
    st = lc.replay(f, fx.events_scans(f)).drop("resolved_on")
    return store.query_findings(st, severity="critical", status="open")


@register(
    "store_query_since",
    with_events(REPLAY_SQL) + f"SELECT {STATE_COLS} FROM state WHERE first_seen >= DATE '{SINCE}'",
)
def q_store_since(spark, sf_dir):
    f = _ev(spark, sf_dir)
    st = lc.replay(f, fx.events_scans(f)).drop("resolved_on")
    return store.query_findings(st, status="", since=SINCE)


@register(
    "scan_history_top50",
    with_events()
    + """
SELECT repo, run_date, count(*) AS finding_count, 'all' AS scanners FROM findings
GROUP BY repo, run_date ORDER BY run_date DESC, repo LIMIT 50""",
)
def q_scan_history(spark, sf_dir):
    f = _ev(spark, sf_dir)
    scans = f.groupBy("repo", "run_date").agg(
        F.count(F.lit(1)).cast("bigint").alias("finding_count"), F.lit("all").alias("scanners")
    )
    return store.scan_history(scans, limit=50)


# --------------------------------------------------------------------------- reports


@register(
    "csv_export_rows",
    with_events()
    + "SELECT repo, severity, title, description, scanner, recommendation, coalesce(file_path, '') AS file_path,"
    " fingerprint FROM findings WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')",
)
def q_csv_rows(spark, sf_dir):
    return reports.csv_rows(_ev(spark, sf_dir))


@register(
    "json_export_rows",
    with_events()
    + "SELECT repo, lower(severity) AS section, scanner, severity, title, description, file_path, line,"
    " recommendation, fingerprint FROM findings WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')",
)
def q_json_rows(spark, sf_dir):
    return reports.json_rows(_ev(spark, sf_dir))


@register(
    "text_summary_rows",
    with_events()
    + "SELECT repo, severity, scanner, substr(title, 1, 60) AS title60 FROM findings"
    " WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')",
)
def q_text_rows(spark, sf_dir):
    return reports.text_summary_rows(_ev(spark, sf_dir))


@register(
    "sarif_results",
    with_events()
    + """
SELECT repo, scanner, CASE WHEN coalesce(fingerprint, '') <> '' THEN fingerprint ELSE title END AS rule_id,
  CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning'
    WHEN 'LOW' THEN 'note' WHEN 'INFO' THEN 'note' ELSE 'warning' END AS level,
  concat(coalesce(description, ''), chr(10), chr(10), 'Recommendation: ', coalesce(recommendation, '')) AS message,
  CASE WHEN coalesce(file_path, '') <> '' THEN file_path END AS uri,
  CASE WHEN coalesce(file_path, '') <> '' AND coalesce(line, 0) <> 0 THEN line END AS start_line,
  ingest_seq
FROM findings""",
)
def q_sarif_results(spark, sf_dir):
    return reports.sarif_results(_ev(spark, sf_dir))


@register(
    "sarif_rules",
    with_events()
    + """
, r AS (SELECT repo, scanner, CASE WHEN coalesce(fingerprint, '') <> '' THEN fingerprint ELSE title END
          AS rule_id, title, severity, ingest_seq FROM findings),
g AS (SELECT repo, scanner, rule_id, arg_min({'title': title, 'severity': severity}, ingest_seq) AS fst
      FROM r GROUP BY repo, scanner, rule_id)
SELECT repo, scanner, rule_id, substr(fst.title, 1, 80) AS name, substr(fst.title, 1, 200) AS short_description,
  CASE fst.severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning'
    WHEN 'LOW' THEN 'note' WHEN 'INFO' THEN 'note' ELSE 'warning' END AS level,
  '' AS help_uri
FROM g""",
)
def q_sarif_rules(spark, sf_dir):
    return reports.sarif_rules(_ev(spark, sf_dir))


_COUNTS_SQL = """
cnt AS (
  SELECT r.repo, coalesce(a.critical, 0) AS critical, coalesce(a.high, 0) AS high, coalesce(a.medium, 0) AS medium,
         coalesce(a.low, 0) AS low, coalesce(a.total, 0) AS total
  FROM (SELECT DISTINCT repo FROM scans) r LEFT JOIN (
    SELECT repo, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical,
           count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium,
           count(*) FILTER (WHERE severity = 'LOW') AS low, count(*) AS total
    FROM findings GROUP BY repo) a ON r.repo = a.repo
)"""


@register(
    "pr_comment_summary",
    with_events(_COUNTS_SQL)
    + """
, h AS (
  SELECT repo, critical + high + medium + low AS shown,
    concat('<!-- scanledger-scan-results -->', chr(10), '## Security Scan Results', chr(10), chr(10), '**',
      CASE WHEN total = 0 THEN 'No findings detected.' ELSE concat(total, ' raw findings (triage skipped)') END,
      '**', chr(10), chr(10),
      concat('\U0001f534 **', critical, '** CRITICAL | \U0001f7e0 **', high, '** HIGH | \U0001f7e1 **', medium,
             '** MEDIUM | \U0001f7e2 **', low, '** LOW'),
      chr(10), chr(10)) AS hdr
  FROM cnt)
SELECT repo, shown, CASE WHEN shown = 0 THEN concat(hdr, 'No security findings detected.', chr(10)) ELSE hdr END
  AS header FROM h""",
)
def q_pr_comment_summary(spark, sf_dir):
    f = _ev(spark, sf_dir)
    return reports.pr_comment_summary(f, fx.events_scans(f))


@register(
    "pr_comment_rows",
    with_events()
    + """
SELECT repo, severity, ingest_seq,
  concat('| **', replace(title, '|', '\\|'), '**<br><sub>', scanner, '</sub> | ',
         substr(replace(coalesce(recommendation, ''), '|', '\\|'), 1, 200), ' |') AS row
FROM findings WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')""",
)
def q_pr_comment_rows(spark, sf_dir):
    return reports.pr_comment_rows(_ev(spark, sf_dir))


@register(
    "pr_comment_sections",
    with_events()
    + """
SELECT repo, severity, count(*) AS n,
  concat('<details>', chr(10), '<summary>',
    CASE severity WHEN 'CRITICAL' THEN '\U0001f534' WHEN 'HIGH' THEN '\U0001f7e0' WHEN 'MEDIUM' THEN '\U0001f7e1'
      ELSE '\U0001f7e2' END,
    ' ', severity, ' (', count(*), ')</summary>', chr(10), chr(10), '| Finding | Recommendation |', chr(10),
    '|---|---|', chr(10)) AS section_head
FROM findings WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') GROUP BY repo, severity""",
)
def q_pr_comment_sections(spark, sf_dir):
    return reports.pr_comment_sections(_ev(spark, sf_dir))


_DIGEST_SQL = (
    with_events(_COUNTS_SQL)
    + """
SELECT repo, critical, high, medium, low, total, critical > 0 AS has_critical,
  CASE WHEN critical > 0 OR high > 0
       THEN concat('Security Scan: ', critical, ' Critical, ', high, ' High — {date} [', repo, ']')
       ELSE concat('Security Scan Clean — {date} [', repo, ']') END AS subject,
  {send} AS send
FROM cnt"""
)


@register("digest_subject", _DIGEST_SQL.format(date=DIGEST_DATE, send="true"))
def q_digest_subject(spark, sf_dir):
    f = _ev(spark, sf_dir)
    return reports.digest(f, fx.events_scans(f), DIGEST_DATE, send_on="all")


@register("digest_send_policy", _DIGEST_SQL.format(date=DIGEST_DATE, send="critical > 0"))
def q_digest_policy(spark, sf_dir):
    f = _ev(spark, sf_dir)
    return reports.digest(f, fx.events_scans(f), DIGEST_DATE, send_on="critical_only")


@register(
    "issue_work_list",
    with_events(OPEN_ISSUES_SQL)
    + """
, cand AS (
  SELECT repo, concat('[', substr(fingerprint, 1, 8), ']') AS tag,
    arg_min({'severity': severity, 'title': title, 'scanner': scanner, 'fingerprint': fingerprint,
             'description': description, 'recommendation': recommendation}, ingest_seq) AS f
  FROM findings WHERE severity = 'CRITICAL' AND coalesce(fingerprint, '') <> '' GROUP BY repo, fingerprint, tag),
existing AS (
  SELECT DISTINCT repo, unnest(regexp_extract_all(issue_title, '(\\[[0-9a-f]{8}\\])', 1)) AS tag FROM open_issues)
SELECT repo, f.fingerprint AS fingerprint,
  concat('[Security] ', f.severity, ': ', substr(f.title, 1, 80), ' ', tag) AS issue_title,
  concat('## Security Finding', chr(10), chr(10), '**Severity:** ', f.severity, chr(10), '**Scanner:** ', f.scanner,
    chr(10), '**Fingerprint:** `', f.fingerprint, '`', chr(10), chr(10), '### Description', chr(10),
    coalesce(f.description, ''), chr(10), chr(10), '### Recommendation', chr(10), coalesce(f.recommendation, ''),
    chr(10), chr(10), '---', chr(10), '<sub>Auto-created by scanledger</sub>') AS body,
  'security,automated' AS labels, '' AS assignees
FROM cand c WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.repo = c.repo AND e.tag = c.tag)""",
)
def q_issue_work_list(spark, sf_dir):
    f = _ev(spark, sf_dir)
    return reports.issue_work_list(f, fx.open_issues_fixture(f), threshold="CRITICAL")


@register(
    "page_work_list",
    with_events(EXISTING_PAGES_SQL)
    + f"""
, firsts AS (
  SELECT repo, fingerprint, arg_min({{'severity': severity, 'title': title, 'scanner': scanner,
    'description': description, 'recommendation': recommendation}}, ingest_seq) AS f
  FROM findings WHERE coalesce(fingerprint, '') <> '' GROUP BY repo, fingerprint)
SELECT repo, fingerprint, substr(f.title, 1, 100) AS page_title,
  CASE WHEN upper(f.severity) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN upper(f.severity) ELSE 'LOW' END AS severity,
  f.scanner AS scanner, 'Open' AS status, '{DIGEST_DATE}' AS date_found,
  substr(coalesce(f.description, ''), 1, 2000) AS description,
  concat('Recommendation: ', substr(coalesce(f.recommendation, ''), 1, 2000)) AS recommendation
FROM firsts x WHERE NOT EXISTS (
  SELECT 1 FROM existing_pages p WHERE p.repo = x.repo AND p.fingerprint = x.fingerprint)""",
)
def q_page_work_list(spark, sf_dir):
    f = _ev(spark, sf_dir)
    return reports.page_work_list(f, fx.existing_pages_fixture(f), DIGEST_DATE)


@register(
    "triage_cap",
    with_events()
    + f"""
SELECT repo, ingest_seq, fingerprint, position FROM (
  SELECT repo, ingest_seq, fingerprint, row_number() OVER (PARTITION BY repo ORDER BY ingest_seq) AS position
  FROM findings) WHERE position <= {CAP}""",
)
def q_triage_cap(spark, sf_dir):
    c = triage.triage_cap(_ev(spark, sf_dir), CAP)
    return c.select("repo", "ingest_seq", "fingerprint", F.col("position").cast("bigint").alias("position"))


@register(
    "rule_triage",
    with_events()
    + """
, k AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3
          ELSE 4 END AS rnk FROM findings
        WHERE NOT coalesce(regexp_matches(file_path, '(^|/)tests?/') OR regexp_matches(file_path, '(^|/)test_[^/]*$')
          OR regexp_matches(file_path, '_test\\.[a-z]+$') OR regexp_matches(file_path, '(^|/)fixtures?/'), false)),
g AS (SELECT repo, scanner, coalesce(rule_id, title) AS rule, min(rnk) AS rnk,
        arg_min({'title': title, 'description': description, 'recommendation': recommendation,
                 'fingerprint': fingerprint}, ingest_seq) AS f,
        count(*) AS occurrences, count(DISTINCT file_path) AS files, min(file_path) AS example_path
      FROM k GROUP BY repo, scanner, coalesce(rule_id, title))
SELECT repo, scanner, rule,
  CASE WHEN scanner = 'gitleaks' THEN 'CRITICAL' ELSE ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'][rnk + 1] END
    AS severity,
  f.title AS title, substr(f.description, 1, 200) AS detail, f.recommendation AS recommendation,
  f.fingerprint AS fingerprint, occurrences, files, example_path
FROM g""",
)
def q_rule_triage(spark, sf_dir):
    return triage.rule_triage(_ev(spark, sf_dir))


# --------------------------------------------------------------------------- detection over tables

_DENIED_CASE = (
    "CASE "
    + " ".join(f"WHEN contains(lower({{col}}), '{d.lower()}') THEN '{d}'" for d in detect.DENIED_LICENSES)
    + " END"
)


@register(
    "license_denied_inventory",
    "WITH "
    + INVENTORY_SQL.strip()
    + f"""
, d AS (SELECT *, {_DENIED_CASE.format(col='license')} AS denied_by FROM inventory)
SELECT repo, package, version, license, denied_by, 'licenses' AS scanner, 'HIGH' AS severity,
  concat('Restricted license: ', package, ' (', license, ')') AS title,
  concat('Package ', package, ' v', version, ' uses ', license) AS description,
  '{detect.LICENSE_RECOMMENDATION}' AS recommendation,
  substr(sha256(concat_ws('|', 'licenses', concat('Restricted license: ', package, ' (', license, ')'), '', '')), 1, 16)
    AS fingerprint
FROM d WHERE denied_by IS NOT NULL""",
)
def q_license_inventory(spark, sf_dir):
    return detect.license_findings(fx.dependency_inventory(spark, sf_dir))


@register(
    "advisory_join",
    "WITH "
    + INVENTORY_SQL.strip()
    + """
SELECT i.repo, i.package, i.version, a.vuln_id, 'pip-audit' AS scanner, 'HIGH' AS severity,
  concat(i.package, ' ', i.version, ': ', a.vuln_id) AS title,
  CASE WHEN coalesce(a.fixed_version, '') <> '' THEN concat('Upgrade to ', a.fixed_version)
       ELSE 'No fix available yet' END AS recommendation,
  substr(sha256(concat_ws('|', 'pip-audit', concat(i.package, ' ', i.version, ': ', a.vuln_id), '', '', a.vuln_id)),
    1, 16) AS fingerprint
FROM (SELECT DISTINCT repo, package, version FROM inventory) i
JOIN advisories a ON i.package = a.package AND i.version = a.version""",
)
def q_advisory_join(spark, sf_dir):
    return detect.match_advisories(fx.dependency_inventory(spark, sf_dir), fx.advisories(spark, sf_dir))


def _sql_str(s: str) -> str:
    return s.replace("'", "''")


def _secret_sql(table: str, id_col: str, text_col: str, rules, prefix: str) -> str:
    any_rule = _sql_str(detect._any_of(rules))
    per_rule = " UNION ALL ".join(
        f"SELECT {id_col}, line_no, '{rid}' AS rule_id FROM lines WHERE regexp_matches(line, '{_sql_str(rx)}')"
        for rid, rx, *_ in rules
    )
    title = "concat('Secret detected: ', rule_id)"
    path = f"concat('{prefix}', {id_col})"
    return f"""
WITH lines AS (
  SELECT {id_col}, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line
  FROM (SELECT {id_col}, str_split({text_col}, chr(10)) AS parts FROM {table}
        WHERE regexp_matches({text_col}, '{any_rule}'))
),
hits AS ({per_rule})
SELECT {id_col}, line_no, rule_id, 'gitleaks' AS scanner, 'CRITICAL' AS severity, {title} AS title,
  {path} AS file_path, cast(line_no AS integer) AS line, '{detect.SECRET_RECOMMENDATION}' AS recommendation,
  substr(sha256(concat_ws('|', 'gitleaks', {title}, {path}, cast(line_no AS varchar), rule_id)), 1, 16) AS fingerprint
FROM hits"""


@register("secret_scan_documents", _secret_sql("documents", "doc_id", "text", detect.SECRET_RULES, "documents/"))
def q_secret_docs(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return detect.scan_text(d, "doc_id", "text", detect.SECRET_RULES, path_prefix="documents/")


@register("secret_scan_pages", _secret_sql("pages", "page_id", "html", detect.HTML_SECRET_RULES, "pages/"))
def q_secret_pages(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return detect.scan_text(p, "page_id", "html", detect.HTML_SECRET_RULES, path_prefix="pages/")


def _license_scan_sql() -> str:
    spdx = "CASE " + " ".join(
        f"WHEN regexp_matches(line, '{_sql_str(rx)}') THEN '{sid}'" for sid, rx in detect.SPDX_RULES
    ) + " ELSE 'UNKNOWN' END"
    return f"""
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, str_split(text, chr(10)) AS parts FROM documents
        WHERE regexp_matches(text, '{detect.LICENSE_LINE}'))
),
l AS (SELECT doc_id, line_no, {spdx} AS spdx FROM lines WHERE regexp_matches(line, '{detect.LICENSE_LINE}'))
SELECT doc_id, line_no, spdx, {_DENIED_CASE.format(col='spdx')} IS NOT NULL AS denied,
  {_DENIED_CASE.format(col='spdx')} AS denied_by
FROM l"""


@register("license_scan_documents", _license_scan_sql())
def q_license_docs(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return detect.scan_licenses(d, "doc_id", "text")


def threshold_predicate(threshold: str, order: str):
    return at_or_above("severity", threshold, order)


# --------------------------------------------------------------------------- report ingestion (S1-S9)

from scanledger.sources import report_fixture as rf  # noqa: E402
from scanledger.sources import reports as ingest  # noqa: E402

_NORM_COLS = [c for c in ingest.FINDINGS_COLUMNS if c != "raw"]


def _normalized(spark, sf_dir):
    return ingest.normalize(rf.raw_reports_from_events(spark, sf_dir))


@register("normalize_reports", rf.NORMALIZED_SQL)
def q_normalize(spark, sf_dir):
    findings, _ = _normalized(spark, sf_dir)
    return findings.select(*_NORM_COLS)


@register("scan_status_reports", rf.STATUS_SQL)
def q_scan_status(spark, sf_dir):
    _, status = _normalized(spark, sf_dir)
    return status.select("repo", "run_id", "run_date", "scanner", "source_path", "report_seq", "ok", "n_items")


_CHANGED_SQL = """
changed AS (
  SELECT DISTINCT concat('org/repo-', user_id) AS repo,
    concat('app/mod', cast(json_extract_string(props, '$.k') AS int) % 9, '.py') AS file_path
  FROM events WHERE event_type = 'click' AND event_id % 3 = 0
)"""


def changed_files_fixture(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    return (
        e.filter((F.col("event_type") == "click") & (F.col("event_id") % 3 == 0))
        .select(
            F.concat(F.lit("org/repo-"), F.col("user_id")).alias("repo"),
            F.concat(F.lit("app/mod"), (k % 9).cast("string"), F.lit(".py")).alias("file_path"),
        )
        .distinct()
    )


@register(
    "pr_scope_semi_join",
    rf.NORMALIZED_SQL.replace("WITH ", "WITH " + _CHANGED_SQL.strip() + ",\n", 1).replace(
        "\nFROM nf", "\nFROM nf WHERE EXISTS (SELECT 1 FROM changed c WHERE c.repo = nf.repo AND c.file_path = nf.file_path)"
    ),
)
def q_pr_scope(spark, sf_dir):
    findings, _ = _normalized(spark, sf_dir)
    return filters.scope_to_changes(findings, changed_files_fixture(spark, sf_dir)).select(*_NORM_COLS)


# --------------------------------------------------------------------------- targets (P6, A1-A8)

from scanledger.sources import targets as tg  # noqa: E402

# Paths a repo listing is drawn from in the derived repo_files table.
REPO_PATHS = [
    ".git/config", "requirements.txt", "package.json", "Dockerfile", "Dockerfile.prod", "main.tf",
    "k8s/deploy.yaml", "helm/app/templates/svc.yaml", "src/app.py", "docs/readme.md", "setup.cfg",
    "docker-compose.yml", "cloudformation-stack.json", "sub/Dockerfile", "infra/main.tf", "Pipfile",
    "helm/templates/ing.yaml", "values.template", "kubernetes/x.yml", "pyproject.toml",
]


def repo_files_fixture(spark, sf_dir):
    """(repo, path) listing derived from events: each event adds one path chosen by its k."""
    e = read_table(spark, sf_dir, "events").select("user_id", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    arr = F.array(*[F.lit(p) for p in REPO_PATHS])
    return e.select(
        F.concat(F.lit("org/repo-"), F.col("user_id")).alias("repo"),
        F.element_at(arr, (k % len(REPO_PATHS)) + 1).alias("path"),
    )


def _applicable_sql() -> str:
    paths = ", ".join(f"'{p}'" for p in REPO_PATHS)
    iac = " OR ".join(f"regexp_matches(path, '{tg.glob_to_regex(g)}')" for g in tg.IAC_GLOBS)
    inl = lambda xs: ", ".join(f"'{x}'" for x in xs)
    return f"""
WITH rf AS (
  SELECT concat('org/repo-', user_id) AS repo,
    [{paths}][cast(json_extract_string(props, '$.k') AS int) % {len(REPO_PATHS)} + 1] AS path
  FROM events
),
g AS (
  SELECT repo,
    bool_or(path = '.git' OR starts_with(path, '.git/')) AS gitleaks, true AS semgrep,
    bool_or(path IN ({inl(tg.PIP_FILES)})) AS pip, bool_or(path = 'package.json') AS npm,
    bool_or(path IN ({inl(tg.TRIVY_FILES)}) OR regexp_matches(path, '{tg.DOCKERFILE_RX}')) AS trivy,
    bool_or({iac}) AS checkov, bool_or(regexp_matches(path, '{tg.DOCKERFILE_RX}')) AS hadolint,
    bool_or(path IN ({inl(tg.LICENSE_FILES)})) AS licenses
  FROM rf GROUP BY repo
)
SELECT repo, 'gitleaks' AS scanner FROM g WHERE gitleaks
UNION ALL SELECT repo, 'semgrep' FROM g WHERE semgrep
UNION ALL SELECT repo, 'pip-audit' FROM g WHERE pip
UNION ALL SELECT repo, 'npm-audit' FROM g WHERE npm
UNION ALL SELECT repo, 'trivy' FROM g WHERE trivy
UNION ALL SELECT repo, 'checkov' FROM g WHERE checkov
UNION ALL SELECT repo, 'hadolint' FROM g WHERE hadolint
UNION ALL SELECT repo, 'licenses' FROM g WHERE licenses"""


@register("applicable_scanners", _applicable_sql())
def q_applicable(spark, sf_dir):
    return tg.applicable_scanners(repo_files_fixture(spark, sf_dir))


@register(
    "parse_repo_specs",
    """
WITH s AS (SELECT url AS spec FROM pages),
k AS (SELECT spec, CASE WHEN starts_with(spec, 'http://') OR starts_with(spec, 'https://') OR starts_with(spec, 'git@')
    THEN 'url' WHEN starts_with(spec, '/') OR starts_with(spec, '.') THEN 'local'
    WHEN contains(spec, '/') THEN 'shorthand' ELSE 'local' END AS kind FROM s),
u AS (SELECT *, CASE WHEN kind = 'url' THEN spec WHEN kind = 'shorthand' THEN concat('https://github.com/', spec) END AS url
      FROM k),
v AS (SELECT *, regexp_replace(url, '/+$', '') AS u0 FROM u),
w AS (SELECT *, CASE WHEN ends_with(u0, '.git') THEN substr(u0, 1, length(u0) - 4) ELSE u0 END AS u1 FROM v),
x AS (SELECT *, string_split(CASE WHEN starts_with(u1, 'git@') THEN regexp_replace(u1, '^git@([^:/]+):', 'git@\\1/')
        ELSE u1 END, '/') AS parts FROM w),
y AS (SELECT *, CASE WHEN len(parts) >= 2 THEN parts[-2] ELSE '' END AS o, parts[-1] AS r,
        string_split(regexp_replace(spec, '/+$', ''), '/')[-1] AS l FROM x)
SELECT spec, kind,
  CASE WHEN kind <> 'local' THEN (CASE WHEN o <> '' THEN concat(o, '/', r) ELSE r END) ELSE l END AS name,
  url, CASE WHEN kind = 'local' THEN spec END AS path,
  CASE WHEN kind <> 'local' THEN o ELSE '' END AS owner, CASE WHEN kind <> 'local' THEN r ELSE '' END AS repo_name
FROM y""",
)
def q_parse_specs(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select(F.col("url").alias("spec"))
    return tg.parse_targets(pages)


# --------------------------------------------------------------------------- triage payload (T4, F9)

TRIAGE_MAX = triage.MAX_FINDINGS
TRIAGE_CHARS = triage.MAX_CHARS


@register(
    "triage_payload",
    with_events()
    + f"""
, capped AS (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ingest_seq) AS position FROM findings),
js AS (
  SELECT repo, position, to_json({{'scanner': scanner, 'severity': severity, 'title': title, 'description': description,
      'file_path': file_path, 'line': line, 'recommendation': recommendation, 'fingerprint': fingerprint}})::varchar AS js
  FROM capped WHERE position <= {TRIAGE_MAX}),
fit AS (SELECT *, sum(length(js) + 1) OVER (PARTITION BY repo ORDER BY position) + 1 AS upto FROM js),
p AS (
  SELECT repo, concat('[', string_agg(js, ',' ORDER BY position), ']') AS js, count(*) AS n_sent,
    (SELECT count(*) FROM findings f WHERE f.repo = fit.repo) - count(*) AS n_left
  FROM fit WHERE upto <= {TRIAGE_CHARS} OR position = 1 GROUP BY repo)
SELECT repo, CASE WHEN n_left > 0 THEN concat(js, chr(10), '... (truncated)') ELSE js END AS payload, n_sent, n_left
FROM p""",
)
def q_triage_payload(spark, sf_dir):
    return triage.triage_payload(_ev(spark, sf_dir), TRIAGE_MAX, TRIAGE_CHARS)


@register(
    "triage_batches",
    with_events().replace("WITH ", "WITH RECURSIVE ", 1)
    + f"""
, j AS (
  SELECT repo, row_number() OVER w AS position, to_json({{'scanner': scanner, 'severity': severity, 'title': title,
      'description': description, 'file_path': file_path, 'line': line, 'recommendation': recommendation,
      'fingerprint': fingerprint}})::varchar AS js
  FROM findings WINDOW w AS (PARTITION BY repo ORDER BY ingest_seq)),
r AS (
  SELECT repo, position, js, 1 AS batch, 1 AS n, length(js) + 2 AS chars FROM j WHERE position = 1
  UNION ALL
  SELECT j.repo, j.position, j.js,
    CASE WHEN r.n < {TRIAGE_MAX} AND r.chars + length(j.js) + 1 <= {TRIAGE_CHARS} THEN r.batch ELSE r.batch + 1 END,
    CASE WHEN r.n < {TRIAGE_MAX} AND r.chars + length(j.js) + 1 <= {TRIAGE_CHARS} THEN r.n + 1 ELSE 1 END,
    CASE WHEN r.n < {TRIAGE_MAX} AND r.chars + length(j.js) + 1 <= {TRIAGE_CHARS} THEN r.chars + length(j.js) + 1 ELSE length(j.js) + 2 END
  FROM r JOIN j ON j.repo = r.repo AND j.position = r.position + 1)
SELECT repo, batch::bigint AS batch, min(position) AS first_position, count(*) AS n_findings,
  concat('[', string_agg(js, ',' ORDER BY position), ']') AS payload
FROM r GROUP BY repo, batch""",
)
def q_triage_batches(spark, sf_dir):
    return triage.triage_batches(_ev(spark, sf_dir), TRIAGE_MAX, TRIAGE_CHARS)


# --------------------------------------------------------------------------- legacy records (S10, P9)

from scanledger.functions.severity import page_severity  # noqa: E402


@register(
    "legacy_records",
    "WITH "
    + rf._EVK.strip()
    + """
, l AS (
  SELECT repo, e AS report_seq, p.pos, 'gitleaks' AS scanner, 'CRITICAL' AS severity, cast(NULL AS varchar) AS package,
    cast(NULL AS varchar) AS vuln_id, concat('Leaked key ', e) AS description
  FROM ev, (SELECT 0 AS pos UNION ALL SELECT 1) p
  WHERE scanner = 'gitleaks' AND NOT corrupt AND (p.pos = 0 OR k % 5 = 0)
  UNION ALL
  SELECT repo, e, 0, 'semgrep', ['ERROR', 'WARNING', 'WARNING', 'INFO', 'info'][b + 1], NULL, NULL, concat('Finding ', e)
  FROM ev WHERE scanner = 'semgrep' AND NOT corrupt
  UNION ALL
  SELECT repo, e, 0, 'pip-audit', 'HIGH', concat('pkg-', k % 20), concat('PYSEC-2024-', k), concat('Advisory ', e)
  FROM ev WHERE scanner = 'pip-audit' AND NOT corrupt
  UNION ALL
  SELECT repo, e, 0, 'npm-audit', ['CRITICAL', 'HIGH', 'MODERATE', 'LOW', 'INFO'][b + 1], concat('lib-', k % 20), NULL,
    CASE WHEN k % 7 <> 0 THEN concat('Prototype pollution ', k % 7) ELSE '' END
  FROM ev WHERE scanner = 'npm-audit' AND NOT corrupt
)
SELECT repo, report_seq, pos, scanner, severity,
  CASE WHEN upper(severity) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN upper(severity) ELSE 'LOW' END AS page_severity,
  package, vuln_id, description
FROM l""",
)
def q_legacy_records(spark, sf_dir):
    recs = ingest.legacy_records(rf.raw_reports_from_events(spark, sf_dir))
    return recs.select(
        "repo", "report_seq", F.col("pos").cast("int").alias("pos"), "scanner", "severity",
        page_severity("severity").alias("page_severity"), "package", "vuln_id", "description",
    )


# --------------------------------------------------------------------------- SARIF document parts (K3)

_LEVEL_SQL = ("CASE {c} WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' "
              "WHEN 'LOW' THEN 'note' WHEN 'INFO' THEN 'note' ELSE 'warning' END")


@register(
    "sarif_document_parts",
    with_events()
    + f"""
, res AS (
  SELECT repo, scanner, ingest_seq,
    CASE WHEN coalesce(fingerprint, '') <> '' THEN fingerprint ELSE title END AS rule_id,
    {_LEVEL_SQL.format(c='severity')} AS level,
    concat(coalesce(description, ''), chr(10), chr(10), 'Recommendation: ', coalesce(recommendation, '')) AS message,
    CASE WHEN coalesce(file_path, '') <> '' THEN file_path END AS uri,
    CASE WHEN coalesce(file_path, '') <> '' AND coalesce(line, 0) <> 0 THEN line END AS start_line,
    title, severity
  FROM findings),
rj AS (
  SELECT repo, scanner, ingest_seq,
    CASE WHEN uri IS NULL THEN to_json({{'ruleId': rule_id, 'level': level, 'message': {{'text': message}}}})
         WHEN start_line IS NULL THEN to_json({{'ruleId': rule_id, 'level': level, 'message': {{'text': message}},
           'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': uri}}}}}}]}})
         ELSE to_json({{'ruleId': rule_id, 'level': level, 'message': {{'text': message}},
           'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': uri}}, 'region': {{'startLine': start_line}}}}}}]}})
    END::varchar AS js
  FROM res),
runs AS (SELECT repo, scanner, min(ingest_seq) AS first_result FROM res GROUP BY repo, scanner),
first_run AS (SELECT repo, min(scanner) AS first_scanner FROM runs GROUP BY repo),
rules AS (
  SELECT repo, scanner, rule_id, min(ingest_seq) AS ingest_seq,
    arg_min({{'title': title, 'severity': severity}}, ingest_seq) AS f
  FROM res GROUP BY repo, scanner, rule_id),
uj AS (
  SELECT repo, scanner, ingest_seq,
    to_json({{'id': rule_id, 'name': substr(f.title, 1, 80), 'shortDescription': {{'text': substr(f.title, 1, 200)}},
      'defaultConfiguration': {{'level': {_LEVEL_SQL.format(c='f.severity')}}}, 'helpUri': ''}})::varchar AS js
  FROM rules),
first_rule AS (SELECT repo, scanner, min(ingest_seq) AS fr FROM uj GROUP BY repo, scanner),
repos AS (SELECT DISTINCT repo FROM findings UNION SELECT DISTINCT repo FROM scans),
parts AS (
  SELECT r.repo, 0 AS k1, '' AS k2, 0 AS k3, 0::bigint AS k4,
    concat('{{"$schema":"{reports.SARIF_SCHEMA}","version":"{reports.SARIF_VERSION}","runs":[',
      CASE WHEN r.repo NOT IN (SELECT repo FROM runs)
        THEN '{{"tool":{{"driver":{{"name":"scanledger","informationUri":"{reports.SARIF_INFO_URI}","rules":[]}}}},"results":[]}}'
        ELSE '' END) AS text
  FROM repos r
  UNION ALL SELECT repo, 2, '', 0, 0, ']}}' FROM repos
  UNION ALL SELECT u.repo, 1, u.scanner, 0, 0,
    concat(CASE WHEN u.scanner = fr.first_scanner THEN '' ELSE ',' END, '{{"tool":{{"driver":{{"name":',
      to_json(u.scanner)::varchar, ',"informationUri":"{reports.SARIF_INFO_URI}","rules":[')
  FROM runs u JOIN first_run fr ON u.repo = fr.repo
  UNION ALL SELECT repo, 1, scanner, 2, 0, ']}}}},"results":[' FROM runs
  UNION ALL SELECT repo, 1, scanner, 4, 0, ']}}' FROM runs
  UNION ALL SELECT uj.repo, 1, uj.scanner, 1, uj.ingest_seq, concat(CASE WHEN uj.ingest_seq = f.fr THEN '' ELSE ',' END, uj.js)
  FROM uj JOIN first_rule f ON uj.repo = f.repo AND uj.scanner = f.scanner
  UNION ALL SELECT rj.repo, 1, rj.scanner, 3, rj.ingest_seq,
    concat(CASE WHEN rj.ingest_seq = runs.first_result THEN '' ELSE ',' END, rj.js)
  FROM rj JOIN runs ON rj.repo = runs.repo AND rj.scanner = runs.scanner
)
SELECT repo, k1, k2, k3, k4, text FROM parts""",
)
def q_sarif_parts(spark, sf_dir):
    f = _ev(spark, sf_dir)
    return reports.sarif_document_parts(f, fx.events_scans(f))


# --------------------------------------------------------------------------- lifecycle options (decisions 2, 3)


@register(
    "lifecycle_replay_resolve_reopened",
    with_events(_replay_sql(resolve_reopened=True)) + f"SELECT {STATE_COLS}, resolved_on FROM state",
)
def q_replay_resolve_reopened(spark, sf_dir):
    f = _ev(spark, sf_dir)
    return lc.replay(f, fx.events_scans(f), resolve_reopened=True)


@register(
    "lifecycle_replay_scanner_scope",
    with_events(_replay_sql(scope="scanner")) + f"SELECT {STATE_COLS}, resolved_on FROM state",
)
def q_replay_scanner_scope(spark, sf_dir):
    """A run resolves only findings of scanners that ran in it (here: scanners with findings in the run)."""
    f = _ev(spark, sf_dir)
    return lc.replay(f, f.select("repo", "scanner", "run_date").distinct(), scope="scanner")


@register("lifecycle_merge_runs_incremental", with_events(REPLAY_SQL) + f"SELECT {STATE_COLS} FROM state")
def q_merge_runs(spark, sf_dir):
    """Replay of the runs before the fixture's mid date, then the later runs merged onto it (= full replay)."""
    f = _ev(spark, sf_dir)
    mid = f.select(F.date_add(F.min("run_date"), 14)).scalar()
    pre = f.filter(F.col("run_date") < mid)
    post = f.filter(F.col("run_date") >= mid)
    state0 = lc.replay(pre, fx.events_scans(pre)).drop("resolved_on")
    return lc.merge_runs(state0, post, fx.events_scans(post))


# --------------------------------------------------------------------------- more report outputs (K1, K7, K9, G6)


@register(
    "json_export_summaries",
    with_events(_COUNTS_SQL)
    + """
SELECT repo, CASE WHEN total = 0 THEN 'No findings detected.' ELSE concat(total, ' raw findings (triage skipped)') END
  AS summary, total AS raw_count, total AS triaged_count FROM cnt""",
)
def q_json_summaries(spark, sf_dir):
    f = _ev(spark, sf_dir)
    return reports.json_summaries(f, fx.events_scans(f))


@register(
    "text_summary_lines",
    with_events(_COUNTS_SQL)
    + """
SELECT repo, concat('  CRITICAL: ', critical, '  HIGH: ', high, '  MEDIUM: ', medium, '  LOW: ', low, '  Total: ', total)
  AS line FROM cnt""",
)
def q_text_lines(spark, sf_dir):
    f = _ev(spark, sf_dir)
    return reports.text_summary_lines(f, fx.events_scans(f))


@register(
    "digest_rows",
    with_events(EXISTING_PAGES_SQL)
    + """
SELECT f.repo, f.severity, f.fingerprint, f.ingest_seq, f.title, substr(f.description, 1, 200) AS description,
  f.recommendation, CASE WHEN p.fingerprint IS NOT NULL THEN concat('https://pages.example/', f.fingerprint) END AS page_url
FROM findings f LEFT JOIN existing_pages p ON f.repo = p.repo AND f.fingerprint = p.fingerprint
WHERE f.severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')""",
)
def q_digest_rows(spark, sf_dir):
    """Digest body rows with the page link of each finding joined by fingerprint."""
    f = _ev(spark, sf_dir)
    pages = fx.existing_pages_fixture(f).withColumn("url", F.concat(F.lit("https://pages.example/"), F.col("fingerprint")))
    return reports.digest_rows(f, pages)


@register(
    "scanner_report_counts",
    "WITH "
    + rf._EVK.strip()
    + ",\n"
    + rf._PARTS.strip()
    + """
, fc AS (SELECT repo, scanner, count(*) AS n_findings FROM nf GROUP BY repo, scanner),
sc AS (SELECT repo, scanner, count(*) FILTER (WHERE corrupt) AS n_errors, count(*) AS n_reports FROM ev
       GROUP BY repo, scanner)
SELECT coalesce(fc.repo, sc.repo) AS repo, coalesce(fc.scanner, sc.scanner) AS scanner,
  coalesce(n_findings, 0) AS n_findings, coalesce(n_errors, 0) AS n_errors, coalesce(n_reports, 0) AS n_reports
FROM fc FULL OUTER JOIN sc ON fc.repo = sc.repo AND fc.scanner = sc.scanner""",
)
def q_scanner_report_counts(spark, sf_dir):
    findings, status = _normalized(spark, sf_dir)
    return agg.scanner_counts(findings, status)


# --------------------------------------------------------------------------- triage responses round trip (T2, T3, P12)


def triage_responses_fixture(findings: DataFrame) -> DataFrame:
    """Model-style responses derived from the rule-based triage: one JSON object per rule group.

    Every third group's response is wrapped in a code fence; all responses of repos whose number ends in 0 are
    not JSON (those repos must fall back to passthrough).
    """
    rt = triage.rule_triage(findings)
    item = F.array(F.struct(
        F.col("title"), F.col("detail"), F.col("recommendation"), F.col("scanner"),
    ))
    body = F.to_json(F.struct(
        F.concat(F.lit("Rule "), F.col("rule"), F.lit(" x"), F.col("occurrences")).alias("summary"),
        *[F.when(F.col("severity") == s, item).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
    ))
    fenced = F.when(F.length(F.col("rule")) % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    broken = F.col("repo").endswith("0")
    return rt.select("repo", F.when(broken, F.lit("not json")).otherwise(fenced).alias("response"))


@register(
    "triage_response_parse",
    with_events()
    + """
, k AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3
          ELSE 4 END AS rnk FROM findings),
g AS (SELECT repo, scanner, coalesce(rule_id, title) AS rule, min(rnk) AS rnk, count(*) AS occurrences,
        arg_min({'title': title, 'description': description, 'recommendation': recommendation}, ingest_seq) AS f
      FROM k GROUP BY repo, scanner, coalesce(rule_id, title)),
t AS (SELECT repo, scanner, rule, occurrences, f,
        CASE WHEN scanner = 'gitleaks' THEN 'CRITICAL' ELSE ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'][rnk + 1] END
          AS severity FROM g),
ok AS (
  SELECT repo, severity, scanner, f.title AS title, substr(f.description, 1, 200) AS description,
    f.recommendation AS recommendation, concat('Rule ', rule, ' x', occurrences) AS summary,
    substr(sha256(concat_ws('|', scanner, f.title, '', '')), 1, 16) AS fingerprint, true AS triaged
  FROM t WHERE NOT ends_with(repo, '0') AND severity <> 'INFO'),
tot AS (SELECT repo, count(*) AS n FROM findings GROUP BY repo),
fb AS (
  SELECT f.repo, f.severity, f.scanner, f.title, f.description, f.recommendation,
    concat(tot.n, ' raw findings (triage skipped)') AS summary, f.fingerprint, false AS triaged
  FROM findings f JOIN tot ON f.repo = tot.repo WHERE ends_with(f.repo, '0'))
SELECT * FROM ok UNION ALL SELECT * FROM fb""",
)
def q_triage_response_parse(spark, sf_dir):
    f = _ev(spark, sf_dir)
    return triage.parse_triage(triage_responses_fixture(f), f)


from scanledger.plans import catalog_inputs, catalog_ledger, catalog_reports, catalog_varied  # noqa: E402,F401
