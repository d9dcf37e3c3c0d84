"""Registered queries of whole documents, containment joins, rule tables and dependency filters, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanledger.operators import detect, reachability, rule_index
from scanledger.plans import documents, reports
from scanledger.plans.catalog import _DENIED_CASE, _ev, _secret_sql, _sql_str, register
from scanledger.session import read_table, stash
from scanledger.sources import fixtures as fx
from scanledger.sources.fixtures import DEPENDENCIES_SQL, INVENTORY_SQL, with_events

#: Bytes of a part in the registered queries, so that the documents of the test tables have several.
COMMENT_CHUNK, JSON_CHUNK = 2048, 8192

_REPORTED = "severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')"
_LEVEL = "list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'], severity)"


def _parts_sql(chunk: int) -> str:
    """Parts of the documents whose fragments are in ``frag`` (repo, k1, k2, k3, text)."""
    return f"""
, o AS (SELECT *, sum(strlen(text)) OVER (PARTITION BY repo ORDER BY k1, k2, k3) - strlen(text) AS begins FROM frag)
SELECT repo, (begins // {chunk})::bigint AS part, min(begins)::bigint AS "offset", string_agg(text, '' ORDER BY k1, k2, k3) AS text
FROM o GROUP BY repo, begins // {chunk}"""


_CNT = f"""
cnt AS (
  SELECT r.repo, count(f.repo) AS total, count(*) FILTER (WHERE {_REPORTED}) AS shown,
    count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high,
    count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low
  FROM (SELECT DISTINCT repo FROM scans UNION SELECT 'org/quiet') r LEFT JOIN findings f ON f.repo = r.repo GROUP BY r.repo
)"""


def _scans(f):
    """The fixture's scans, and one of a repo without findings."""
    scans = fx.events_scans(f)
    return scans.unionByName(scans.select(F.lit("org/quiet").alias("repo"), F.max("run_date").alias("run_date")))


@register(
    "pr_comment_bodies",
    with_events(_CNT)
    + """
, sec AS (SELECT repo, severity, count(*) AS n FROM findings WHERE severity <> 'INFO' GROUP BY repo, severity),
frag AS (
  SELECT repo, 0 AS k1, 0 AS k2, 0 AS k3, concat('<!-- scanledger-scan-results -->', chr(10), '## Security Scan Results', chr(10), chr(10), '**',
    CASE WHEN total = 0 THEN 'No findings detected.' ELSE concat(total, ' raw findings (triage skipped)') END, '**', chr(10), chr(10),
    '\U0001f534 **', critical, '** CRITICAL | \U0001f7e0 **', high, '** HIGH | \U0001f7e1 **', medium, '** MEDIUM | \U0001f7e2 **', low, '** LOW',
    chr(10), chr(10), CASE WHEN shown = 0 THEN concat('No security findings detected.', chr(10)) ELSE '' END) AS text
  FROM cnt
  UNION ALL SELECT repo, """ + _LEVEL + """, 0, 0, concat('<details>', chr(10), '<summary>',
    CASE severity WHEN 'CRITICAL' THEN '\U0001f534' WHEN 'HIGH' THEN '\U0001f7e0' WHEN 'MEDIUM' THEN '\U0001f7e1' ELSE '\U0001f7e2' END, ' ', severity,
    ' (', n, ')</summary>', chr(10), chr(10), '| Finding | Recommendation |', chr(10), '|---|---|', chr(10)) FROM sec
  UNION ALL SELECT repo, """ + _LEVEL + """, 1, ingest_seq, concat('| **', replace(title, '|', '\\|'), '**<br><sub>', scanner, '</sub> | ',
    substr(replace(coalesce(recommendation, ''), '|', '\\|'), 1, 200), ' |', chr(10)) FROM findings WHERE severity <> 'INFO'
  UNION ALL SELECT repo, """ + _LEVEL + """, 2, 0, concat(chr(10), '</details>', chr(10), chr(10)) FROM sec
  UNION ALL SELECT repo, 5, 0, 0, concat(chr(10), '---', chr(10), '<sub>Generated by scanledger</sub>', chr(10)) FROM cnt WHERE shown > 0)"""
    + _parts_sql(COMMENT_CHUNK),
)
def q_comment_bodies(spark, sf_dir):
    """Whole comment bodies in parts: each repo's parts in order are its comment."""
    f = _ev(spark, sf_dir)
    return documents.parts(documents.comment_fragments(f, _scans(f)), COMMENT_CHUNK)


@register(
    "json_export_documents",
    with_events(_CNT)
    + """
, sec AS (SELECT repo, unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW']) AS severity, unnest([critical, high, medium, low]) AS n FROM cnt),
frag AS (
  SELECT repo, 0 AS k1, 0 AS k2, 0 AS k3, concat('{', chr(10), '  "summary": "',
    CASE WHEN total = 0 THEN 'No findings detected.' ELSE concat(total, ' raw findings (triage skipped)') END, '",', chr(10),
    '  "raw_count": ', total, ',', chr(10), '  "triaged_count": ', total) AS text FROM cnt
  UNION ALL SELECT repo, """ + _LEVEL + """, 0, 0, concat(',', chr(10), '  "', lower(severity), '": [') FROM sec
  UNION ALL SELECT repo, """ + _LEVEL + """, 1, ingest_seq, concat(
    CASE WHEN row_number() OVER (PARTITION BY repo, severity ORDER BY ingest_seq) > 1 THEN ',' ELSE '' END, chr(10), '    {', chr(10),
    '      "scanner": "', scanner, '",', chr(10), '      "severity": "', severity, '",', chr(10), '      "title": "', title, '",', chr(10),
    '      "description": "', description, '",', chr(10), '      "file_path": null,', chr(10), '      "line": null,', chr(10),
    '      "recommendation": "', recommendation, '",', chr(10), '      "fingerprint": "', fingerprint, '"', chr(10), '    }')
  FROM findings WHERE severity <> 'INFO'
  UNION ALL SELECT repo, """ + _LEVEL + """, 2, 0, CASE WHEN n > 0 THEN concat(chr(10), '  ]') ELSE ']' END FROM sec
  UNION ALL SELECT repo, 5, 0, 0, concat(chr(10), '}') FROM cnt)"""
    + _parts_sql(JSON_CHUNK),
)
def q_json_documents(spark, sf_dir):
    """Whole JSON exports in parts: each repo's parts in order are its document."""
    f = _ev(spark, sf_dir)
    return documents.parts(documents.json_fragments(f, _scans(f)), JSON_CHUNK)


@register("sarif_upload_bodies")
def q_upload_bodies(spark, sf_dir):
    """Base64 bodies of the gzipped SARIF documents, in parts (compressed bytes have no SQL form)."""
    f = _ev(spark, sf_dir)
    return documents.upload_bodies(f, fx.events_scans(f), JSON_CHUNK)


@register(
    "issue_work_list_titles",
    """
WITH f AS (
  SELECT source AS repo, doc_id AS ingest_seq, substr(text, 1, 90) AS title, substr(text, 1, 50) AS term
  FROM documents WHERE doc_id % 5 <> 0),
o AS (
  SELECT source AS repo, concat('[Security] ', CASE WHEN doc_id % 2 = 0 THEN concat('HIGH: ', substr(text, 1, 60)) ELSE substr(text, 4, 80) END) AS issue_title
  FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL),
g AS (SELECT repo, coalesce(term, '') AS term, arg_min({'title': coalesce(title, '')}, ingest_seq) AS f FROM f GROUP BY ALL)
SELECT repo, '' AS fingerprint, concat('[Security] CRITICAL: ', substr(f.title, 1, 80), ' ') AS issue_title
FROM g WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.repo IS NOT DISTINCT FROM g.repo AND contains(o.issue_title, g.term))""",
)
def q_issue_titles(spark, sf_dir):
    """Issues of findings without a fingerprint: those whose title's beginning no open issue of the repo contains."""
    todo = reports.issue_work_list(fx.untagged_findings(spark, sf_dir), fx.open_titles(spark, sf_dir))
    return todo.select("repo", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), "issue_title")


#: Rules of the table: one for each beginning of three hexadecimal digits, and the literal list's others.
PREFIXES = 16**3


def rule_table(spark):
    prefix = F.lower(F.lpad(F.hex("id"), 3, "0"))
    many = spark.range(PREFIXES).select(
        F.concat(F.lit("hex-token-"), prefix).alias("rule_id"),
        F.concat(F.lit('token = "'), prefix, F.lit('[0-9a-f]{37}"')).alias("regex"),
        F.concat(F.lit('token = "'), prefix).alias("anchor"),
    )
    rest = spark.createDataFrame(detect.SECRET_RULES[1:], "rule_id string, regex string, anchor string")
    return many.unionByName(rest)


def _rule_table_sql() -> str:
    sql = _secret_sql("documents", "doc_id", "text", detect.SECRET_RULES, "documents/")
    rest = " UNION ALL ".join(f"SELECT doc_id, line_no, '{rid}' AS rule_id FROM lines WHERE regexp_matches(line, '{_sql_str(rx)}')" for rid, rx, *_ in detect.SECRET_RULES[1:])
    each = f"""SELECT DISTINCT doc_id, line_no, concat('hex-token-', substr(m, 10, 3)) AS rule_id
  FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(line, 'token = "[0-9a-f]{{40}}"')) AS m FROM lines)"""
    head, tail = sql[: sql.index("hits AS (")], sql[sql.index("SELECT doc_id, line_no, rule_id, 'gitleaks'") :]
    return f"{head}hits AS ({each} UNION ALL {rest})\n{tail}"


@register("secret_scan_rule_table", _rule_table_sql())
def q_rule_table(spark, sf_dir):
    """Secret scan with a table of 4,100 rules: the rows of ``secret_scan_documents``, its token rule told apart by prefix."""
    d = read_table(spark, sf_dir, "documents")
    return rule_index.scan_rules(d, "doc_id", "text", rule_table(spark), path_prefix="documents/")


@register(
    "license_production_only",
    "WITH RECURSIVE "
    + INVENTORY_SQL.strip()
    + ",\n"
    + DEPENDENCIES_SQL.strip()
    + f"""
, needed AS (
  SELECT repo, package FROM beside WHERE p % 10 = 0
  UNION SELECT e.repo, e.dependency FROM needed n JOIN edges e ON e.repo = n.repo AND e.package = n.package),
d AS (SELECT *, {_DENIED_CASE.format(col='license')} AS denied_by FROM inventory SEMI JOIN needed USING (repo, package))
SELECT repo, package, version, license, denied_by, 'licenses' AS scanner, 'HIGH' AS severity,
  concat('Restricted license: ', package, ' (', license, ')') AS title,
  concat('Package ', package, ' v', version, ' uses ', license) AS description,
  '{detect.LICENSE_RECOMMENDATION}' AS recommendation,
  substr(sha256(concat_ws('|', 'licenses', concat('Restricted license: ', package, ' (', license, ')'), '', '')), 1, 16)
    AS fingerprint
FROM d WHERE denied_by IS NOT NULL""",
)
def q_license_production(spark, sf_dir):
    """Denied licenses among the packages that production roots need, directly or not."""
    inventory = stash(fx.dependency_inventory(spark, sf_dir))
    roots, edges = fx.dependency_edges(inventory)
    return detect.license_findings(reachability.production_only(inventory, roots, edges))
