"""Tool-shaped raw reports derived from ``events`` (one report per event).

Each event becomes one JSON report of one of the eight tools, with fields taken
from the event (id, k, value bucket), so the ingest path (parse, explode, map,
fingerprint) runs over data that grows with the tables. Every 97th event
yields an unparsable payload. ``NORMALIZED_SQL`` computes the expected
normalised findings straight from ``events`` (no JSON parsing) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanledger.functions import week_start
from scanledger.session import read_table


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.col("value")
    bucket = F.when(v >= 110, 0).when(v >= 60, 1).when(v >= 30, 2).when(v >= 10, 3).otherwise(4)
    et = F.col("event_type")
    scanner = (
        F.when(et == "error", "gitleaks")
        .when(et == "click", "semgrep")
        .when(et == "view", F.when(k % 2 == 0, "trivy").otherwise("checkov"))
        .when(et == "purchase", F.when(k % 2 == 0, "pip-audit").otherwise("npm-audit"))
        .otherwise(F.when(k % 2 == 0, "hadolint").otherwise("licenses"))
    )
    # The per-event fields are produced by a one-row generator: downstream filters and payload
    # builders reference its output columns, so the JSON field extraction runs once per event
    # instead of being inlined into every reference.
    row = F.struct(
        F.col("event_id").alias("e"),
        k.alias("k"),
        bucket.alias("b"),
        F.concat(F.lit("org/repo-"), F.col("user_id")).alias("repo"),
        week_start("ts").alias("run_date"),
        et.alias("event_type"),
        scanner.alias("scanner"),
    )
    return e.select(F.inline(F.array(row)))


def _pick(b: F.Column, *vals):
    out = F.lit(vals[-1])
    for i in reversed(range(len(vals) - 1)):
        out = F.when(b == i, F.lit(vals[i]) if vals[i] is not None else F.lit(None).cast("string")).otherwise(out)
    return out


def _s(c) -> F.Column:
    return c.cast("string")


def raw_reports_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k, b = F.col("e"), F.col("k"), F.col("b")

    gl_item = lambda line: F.struct(
        F.when(k % 10 != 9, F.concat(F.lit("rule-"), _s(k % 10))).alias("RuleID"),
        F.concat(F.lit("Leaked key "), _s(e)).alias("Description"),
        F.concat(F.lit("src/app"), _s(k % 7), F.lit(".py")).alias("File"),
        line.alias("StartLine"),
    )
    gitleaks = F.to_json(
        F.when(k % 5 == 0, F.array(gl_item(k % 50), gl_item(k % 50 + 1))).otherwise(F.array(gl_item(k % 50)))
    )
    semgrep = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.when(k % 10 != 8, F.concat(F.lit("py.rule-"), _s(k % 10))).alias("check_id"),
                    F.concat(F.lit("app/mod"), _s(k % 9), F.lit(".py")).alias("path"),
                    F.struct((k % 40 + 1).alias("line")).alias("start"),
                    F.struct(
                        _pick(b, "ERROR", "WARNING", None, "INFO", "info").alias("severity"),
                        F.concat(F.lit("Finding "), _s(e)).alias("message"),
                        F.when(k % 3 != 0, F.lit("Use a safe API")).alias("fix"),
                    ).alias("extra"),
                )
            ).alias("results")
        )
    )
    trivy = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.when(k % 4 == 0, F.lit("Dockerfile")).otherwise(F.lit("requirements.txt")).alias("Target"),
                    F.array(
                        F.struct(
                            F.concat(F.lit("CVE-2024-"), _s(k + 1000)).alias("VulnerabilityID"),
                            F.when(k % 20 != 19, F.concat(F.lit("pkg-"), _s(k % 20))).alias("PkgName"),
                            _pick(b, "CRITICAL", "high", "MEDIUM", "LOW", "UNKNOWN").alias("Severity"),
                            F.concat(F.lit("Vuln "), _s(e)).alias("Title"),
                            F.when(k % 6 != 0, F.concat(F.lit("2."), _s(k % 9), F.lit(".0"))).alias("FixedVersion"),
                        )
                    ).alias("Vulnerabilities"),
                )
            ).alias("Results")
        )
    )
    ck_obj = F.struct(
        F.struct(
            F.array(
                F.struct(
                    F.concat(F.lit("CKV_AWS_"), _s(k % 30)).alias("check_id"),
                    F.concat(F.lit("Ensure setting "), _s(k % 30)).alias("check_name"),
                    F.when(k % 5 != 0, _pick(b, "critical", "HIGH", "medium", "LOW", "SOMETHING")).alias("severity"),
                    F.lit("/main.tf").alias("file_path"),
                    F.array(k % 60 + 1, k % 60 + 5).alias("file_line_range"),
                    F.when(k % 2 != 0, F.concat(F.lit("https://docs.example.com/"), _s(k % 30))).alias("guideline"),
                )
            ).alias("failed_checks")
        ).alias("results")
    )
    checkov = F.when(e % 2 == 0, F.to_json(ck_obj)).otherwise(F.to_json(F.array(ck_obj)))
    pip = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.concat(F.lit("pkg-"), _s(k % 20)).alias("name"),
                    F.concat(F.lit("1."), _s(k % 5), F.lit(".0")).alias("version"),
                    F.array(
                        F.struct(
                            F.concat(F.lit("PYSEC-2024-"), _s(k)).alias("id"),
                            F.concat(F.lit("Advisory "), _s(e)).alias("description"),
                            F.when(k % 3 == 0, F.array().cast("array<string>"))
                            .otherwise(F.array(F.lit("2.0.0"), F.lit("2.1.0")))
                            .alias("fix_versions"),
                        )
                    ).alias("vulns"),
                )
            ).alias("dependencies")
        )
    )
    fix_json = F.when(k % 3 == 0, F.lit("false")).when(k % 3 == 1, F.lit("true")).otherwise(
        F.lit('{"name":"lib","version":"2.0.0"}')
    )
    npm_title = F.when(k % 7 != 0, F.concat(F.lit('"title":"Prototype pollution '), _s(k % 7), F.lit('",'))).otherwise(
        F.lit("")
    )
    npm = F.concat(
        F.lit('{"vulnerabilities":{"lib-'), _s(k % 20), F.lit('":{"severity":"'),
        _pick(b, "critical", "high", "moderate", "low", "info"), F.lit('",'), npm_title,
        F.lit('"via":[],"fixAvailable":'), fix_json, F.lit("}}}"),
    )
    hadolint = F.to_json(
        F.array(
            F.struct(
                F.concat(F.lit("DL"), _s(k % 30 + 3000)).alias("code"),
                F.concat(F.lit("Lint message "), _s(k % 30)).alias("message"),
                _pick(b, "error", "warning", "info", "style", "unknown-level").alias("level"),
                (k % 20 + 1).alias("line"),
            )
        )
    )
    py_lic = F.to_json(
        F.array(
            F.struct(
                F.concat(F.lit("pkg-"), _s(k % 20)).alias("Name"),
                F.concat(F.lit("1.0."), _s(k % 3)).alias("Version"),
                _pick(k % 4, "GPL-3.0", "MIT", "LGPL-3.0-or-later", "Apache-2.0").alias("License"),
            )
        )
    )
    node_lic_val = _pick(k % 4, '"AGPL-3.0"', '["MIT","GPL-2.0"]', '"ISC"', '["BSD-3-Clause"]')
    node_lic = F.concat(F.lit('{"lib-'), _s(k % 20), F.lit('@1.0.0":{"licenses":'), node_lic_val, F.lit("}}"))
    licenses = F.when(e % 2 == 0, py_lic).otherwise(node_lic)

    payloads = {
        "gitleaks": gitleaks, "semgrep": semgrep, "trivy": trivy, "checkov": checkov, "pip-audit": pip,
        "npm-audit": npm, "hadolint": hadolint, "licenses": licenses,
    }
    scanner = F.col("scanner")
    body = None
    for name, text in payloads.items():
        body = F.when(scanner == name, text) if body is None else body.when(scanner == name, text)
    dockerfile = F.when(k % 3 == 0, F.lit("Dockerfile")).otherwise(F.lit("docker/Dockerfile.dev"))
    return _base(spark, sf_dir).select(
        "repo",
        F.col("run_date").cast("string").alias("run_id"),
        "run_date",
        "scanner",
        F.when(scanner == "hadolint", dockerfile).otherwise(F.concat("scanner", F.lit(".json"))).alias("source_path"),
        F.col("e").alias("report_seq"),
        F.when(e % 97 == 0, F.lit("not json {")).otherwise(body).alias("payload"),
    )


# ----------------------------------------------------------------------------- oracle

_EVK = """
evk AS (
  SELECT event_id AS e, cast(json_extract_string(props, '$.k') AS int) AS k,
    CASE WHEN value >= 110 THEN 0 WHEN value >= 60 THEN 1 WHEN value >= 30 THEN 2 WHEN value >= 10 THEN 3 ELSE 4 END AS b,
    concat('org/repo-', user_id) AS repo, cast(date_trunc('week', ts) AS date) AS run_date, event_type
  FROM events
),
ev AS (
  SELECT *, CASE WHEN event_type = 'error' THEN 'gitleaks' WHEN event_type = 'click' THEN 'semgrep'
    WHEN event_type = 'view' THEN (CASE WHEN k % 2 = 0 THEN 'trivy' ELSE 'checkov' END)
    WHEN event_type = 'purchase' THEN (CASE WHEN k % 2 = 0 THEN 'pip-audit' ELSE 'npm-audit' END)
    ELSE (CASE WHEN k % 2 = 0 THEN 'hadolint' ELSE 'licenses' END) END AS scanner,
    e % 97 = 0 AS corrupt
  FROM evk
)"""

_PARTS = """
gl AS (
  SELECT repo, run_date, e, p.pos, 'gitleaks' AS scanner, 'CRITICAL' AS severity,
    concat('Secret detected: ', coalesce(CASE WHEN k % 10 <> 9 THEN concat('rule-', k % 10) END, 'unknown')) AS title,
    concat('Leaked key ', e) AS description, concat('src/app', k % 7, '.py') AS file_path,
    k % 50 + p.pos AS line, 'Rotate this credential and remove from git history' AS recommendation,
    CASE WHEN k % 10 <> 9 THEN concat('rule-', k % 10) END AS rule_id
  FROM ev, (SELECT 0 AS pos UNION ALL SELECT 1) p
  WHERE scanner = 'gitleaks' AND NOT corrupt AND (p.pos = 0 OR k % 5 = 0)
),
sg AS (
  SELECT repo, run_date, e, 0 AS pos, 'semgrep' AS scanner,
    CASE WHEN b = 3 OR b = 4 THEN 'INFO' ELSE 'LOW' END AS severity,
    coalesce(CASE WHEN k % 10 <> 8 THEN concat('py.rule-', k % 10) END, 'unknown') AS title,
    concat('Finding ', e) AS description, concat('app/mod', k % 9, '.py') AS file_path, k % 40 + 1 AS line,
    CASE WHEN k % 3 <> 0 THEN 'Use a safe API' ELSE 'Review and fix the flagged pattern' END AS recommendation,
    CASE WHEN k % 10 <> 8 THEN concat('py.rule-', k % 10) END AS rule_id
  FROM ev WHERE scanner = 'semgrep' AND NOT corrupt
),
tv AS (
  SELECT repo, run_date, e, 0 AS pos, 'trivy' AS scanner,
    ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'LOW'][b + 1] AS severity,
    concat(coalesce(CASE WHEN k % 20 <> 19 THEN concat('pkg-', k % 20) END, 'unknown'), ': CVE-2024-', k + 1000) AS title,
    concat('Vuln ', e) AS description,
    CASE WHEN k % 4 = 0 THEN 'Dockerfile' ELSE 'requirements.txt' END AS file_path, cast(NULL AS int) AS line,
    CASE WHEN k % 6 <> 0 THEN concat('Upgrade to 2.', k % 9, '.0') ELSE 'No fix available yet' END AS recommendation,
    concat('CVE-2024-', k + 1000) AS rule_id
  FROM ev WHERE scanner = 'trivy' AND NOT corrupt
),
ck AS (
  SELECT repo, run_date, e, 0 AS pos, 'checkov' AS scanner,
    CASE WHEN k % 5 = 0 THEN 'MEDIUM' ELSE ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'LOW'][b + 1] END AS severity,
    concat('CKV_AWS_', k % 30, ': Ensure setting ', k % 30) AS title,
    concat('Ensure setting ', k % 30) AS description, '/main.tf' AS file_path, k % 60 + 1 AS line,
    CASE WHEN k % 2 <> 0 THEN concat('https://docs.example.com/', k % 30) ELSE 'Review IaC configuration' END
      AS recommendation,
    concat('CKV_AWS_', k % 30) AS rule_id
  FROM ev WHERE scanner = 'checkov' AND NOT corrupt
),
pa AS (
  SELECT repo, run_date, e, 0 AS pos, 'pip-audit' AS scanner, 'HIGH' AS severity,
    concat('pkg-', k % 20, ' 1.', k % 5, '.0: PYSEC-2024-', k) AS title, concat('Advisory ', e) AS description,
    cast(NULL AS varchar) AS file_path, cast(NULL AS int) AS line,
    CASE WHEN k % 3 = 0 THEN 'No fix available yet' ELSE 'Upgrade to 2.0.0, 2.1.0' END AS recommendation,
    concat('PYSEC-2024-', k) AS rule_id
  FROM ev WHERE scanner = 'pip-audit' AND NOT corrupt
),
np AS (
  SELECT repo, run_date, e, 0 AS pos, 'npm-audit' AS scanner,
    ['CRITICAL', 'HIGH', 'LOW', 'LOW', 'INFO'][b + 1] AS severity,
    concat('lib-', k % 20, ': ', CASE WHEN k % 7 <> 0 THEN concat('Prototype pollution ', k % 7) ELSE 'vulnerability' END)
      AS title,
    CASE WHEN k % 7 <> 0 THEN concat('Prototype pollution ', k % 7) ELSE '' END AS description,
    cast(NULL AS varchar) AS file_path, cast(NULL AS int) AS line,
    CASE WHEN k % 3 = 0 THEN 'Manual review required' ELSE 'Run `npm audit fix`' END AS recommendation,
    cast(NULL AS varchar) AS rule_id
  FROM ev WHERE scanner = 'npm-audit' AND NOT corrupt
),
hl AS (
  SELECT repo, run_date, e, 0 AS pos, 'hadolint' AS scanner,
    ['HIGH', 'MEDIUM', 'LOW', 'INFO', 'MEDIUM'][b + 1] AS severity,
    concat('DL', k % 30 + 3000, ': Lint message ', k % 30) AS title, concat('Lint message ', k % 30) AS description,
    CASE WHEN k % 3 = 0 THEN 'Dockerfile' ELSE 'docker/Dockerfile.dev' END AS file_path, k % 20 + 1 AS line,
    concat('https://github.com/hadolint/hadolint/wiki/DL', k % 30 + 3000) AS recommendation,
    cast(NULL AS varchar) AS rule_id
  FROM ev WHERE scanner = 'hadolint' AND NOT corrupt
),
lp AS (
  SELECT repo, run_date, e, 0 AS pos, 'licenses' AS scanner, 'HIGH' AS severity,
    concat('Restricted license: pkg-', k % 20, ' (', CASE k % 4 WHEN 0 THEN 'GPL-3.0' ELSE 'LGPL-3.0-or-later' END, ')')
      AS title,
    concat('Package pkg-', k % 20, ' v1.0.', k % 3, ' uses ', CASE k % 4 WHEN 0 THEN 'GPL-3.0' ELSE 'LGPL-3.0-or-later' END)
      AS description,
    cast(NULL AS varchar) AS file_path, cast(NULL AS int) AS line,
    'Replace with a permissively-licensed alternative or obtain a commercial license' AS recommendation,
    cast(NULL AS varchar) AS rule_id
  FROM ev WHERE scanner = 'licenses' AND NOT corrupt AND e % 2 = 0 AND k % 4 IN (0, 2)
),
ln AS (
  SELECT repo, run_date, e, 0 AS pos, 'licenses' AS scanner, 'HIGH' AS severity,
    concat('Restricted license: lib-', k % 20, '@1.0.0 (', CASE k % 4 WHEN 0 THEN 'AGPL-3.0' ELSE 'MIT, GPL-2.0' END, ')')
      AS title,
    concat('Package lib-', k % 20, '@1.0.0 uses ', CASE k % 4 WHEN 0 THEN 'AGPL-3.0' ELSE 'MIT, GPL-2.0' END)
      AS description,
    cast(NULL AS varchar) AS file_path, cast(NULL AS int) AS line,
    'Replace with a permissively-licensed alternative or obtain a commercial license' AS recommendation,
    cast(NULL AS varchar) AS rule_id
  FROM ev WHERE scanner = 'licenses' AND NOT corrupt AND e % 2 = 1 AND k % 4 IN (0, 1)
),
nf AS (
  SELECT * FROM gl UNION ALL SELECT * FROM sg UNION ALL SELECT * FROM tv UNION ALL SELECT * FROM ck
  UNION ALL SELECT * FROM pa UNION ALL SELECT * FROM np UNION ALL SELECT * FROM hl UNION ALL SELECT * FROM lp
  UNION ALL SELECT * FROM ln
)"""

NORMALIZED_SQL = (
    "WITH "
    + _EVK.strip()
    + ",\n"
    + _PARTS.strip()
    + """
SELECT repo, cast(run_date AS varchar) AS run_id, run_date, e * 16777216 + pos AS ingest_seq, scanner, severity, title,
  description, file_path, line, recommendation, rule_id,
  substr(sha256(concat_ws('|', scanner, title, coalesce(file_path, ''),
    CASE WHEN coalesce(line, 0) = 0 THEN '' ELSE cast(line AS varchar) END, rule_id)), 1, 16) AS fingerprint
FROM nf"""
)

STATUS_SQL = (
    "WITH "
    + _EVK.strip()
    + """
SELECT repo, cast(run_date AS varchar) AS run_id, run_date, scanner,
  CASE WHEN scanner = 'hadolint' THEN (CASE WHEN k % 3 = 0 THEN 'Dockerfile' ELSE 'docker/Dockerfile.dev' END)
       ELSE concat(scanner, '.json') END AS source_path,
  e AS report_seq, NOT corrupt AS ok,
  cast(CASE WHEN corrupt THEN 0 WHEN scanner = 'gitleaks' AND k % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_items
FROM ev"""
)
