"""Second forms of registered queries, over findings that reach every branch (``fixtures.varied_findings``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanledger.operators import store
from scanledger.plans import reports
from scanledger.plans.catalog import _COUNTS_SQL, DIGEST_DATE, ORACLES, QUERIES, _ev, register
from scanledger.sources import fixtures as fx

NAMES = [
    "fingerprint_findings", "severity_counts_by_repo", "passthrough_triage", "repo_gate", "run_totals", "lifecycle_replay",
    "run_delta_metrics", "csv_export_rows", "json_export_rows", "text_summary_rows", "text_summary_lines", "sarif_results",
    "sarif_rules", "sarif_document_parts", "pr_comment_summary", "pr_comment_rows", "pr_comment_sections", "digest_subject",
    "digest_send_policy", "digest_rows", "page_work_list", "issue_work_list", "rule_triage", "json_export_summaries", "triage_batches",
]


def _over_varied(query):
    def run(spark, sf_dir):
        token = fx.FINDINGS.set(fx.varied_findings)
        try:
            return query(spark, sf_dir)
        finally:
            fx.FINDINGS.reset(token)

    return run


def _varied_sql(sql: str) -> str:
    plain = fx.EVENTS_FINDINGS_SQL.strip()
    assert plain in sql
    return sql.replace(plain, fx.VARIED_FINDINGS_SQL)


#: What the plain form's SQL has no rows for: repos without findings, findings without a fingerprint.
MORE = {
    "repo_gate": """
UNION ALL SELECT DISTINCT repo, false, 0, false FROM scans WHERE repo NOT IN (SELECT repo FROM findings)""",
    "page_work_list": f"""
UNION ALL SELECT repo, fingerprint, substr(title, 1, 100), CASE WHEN severity = 'INFO' THEN 'LOW' ELSE severity END, scanner, 'Open',
  '{DIGEST_DATE}', substr(coalesce(description, ''), 1, 2000), concat('Recommendation: ', substr(coalesce(recommendation, ''), 1, 2000))
FROM findings WHERE fingerprint = ''""",
    "issue_work_list": """
UNION ALL
SELECT repo, '', concat('[Security] CRITICAL: ', substr(f.title, 1, 80), ' '),
  concat('## Security Finding', chr(10), chr(10), '**Severity:** CRITICAL', chr(10), '**Scanner:** ', f.scanner,
    chr(10), '**Fingerprint:** ``', chr(10), chr(10), '### Description', chr(10), coalesce(f.description, ''), chr(10), chr(10),
    '### Recommendation', chr(10), coalesce(f.recommendation, ''), chr(10), chr(10), '---', chr(10),
    '<sub>Auto-created by scanledger</sub>'), 'security,automated', ''
FROM (SELECT repo, substr(title, 1, 50) AS term, arg_min({'title': title, 'scanner': scanner, 'description': description,
        'recommendation': recommendation}, ingest_seq) AS f
      FROM findings WHERE severity = 'CRITICAL' AND fingerprint = '' GROUP BY ALL) g
WHERE NOT EXISTS (SELECT 1 FROM open_issues o WHERE o.repo = g.repo AND contains(o.issue_title, g.term))""",
}

for _name in NAMES:
    register(f"{_name}_varied", _varied_sql(ORACLES[_name] + MORE.get(_name, "")))(_over_varied(QUERIES[_name]))


@register(
    "digest_findings_only_varied",
    _varied_sql(fx.with_events(_COUNTS_SQL))
    + """
SELECT repo, critical, high, medium, low, total, critical > 0 AS has_critical,
  CASE WHEN critical > 0 OR high > 0 THEN concat('Security Scan: ', critical, ' Critical, ', high, ' High — 2024-02-05 [', repo, ']')
       ELSE concat('Security Scan Clean — 2024-02-05 [', repo, ']') END AS subject,
  total > 0 AS send
FROM cnt""",
)
@_over_varied
def q_digest_findings_only(spark, sf_dir):
    f = _ev(spark, sf_dir)
    return reports.digest(f, fx.events_scans(f), "2024-02-05", send_on="findings_only")


@register(
    "scan_history_repo_varied",
    _varied_sql(fx.with_events())
    + """
SELECT repo, run_date, count(*) AS finding_count, 'all' AS scanners FROM findings WHERE repo = 'org/repo-7' GROUP BY repo, run_date""",
)
@_over_varied
def q_scan_history_repo(spark, sf_dir):
    f = _ev(spark, sf_dir)
    scans = f.groupBy("repo", "run_date").agg(F.count(F.lit(1)).cast("bigint").alias("finding_count"), F.lit("all").alias("scanners"))
    return store.scan_history(scans, repo="org/repo-7")
