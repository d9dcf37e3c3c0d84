"""Findings-shaped inputs derived from the driver tables (see FIXTURES.md B-D).

Each builder has two forms: a DataFrame job (what the library runs) and the
equivalent DuckDB SQL text (used only as the correctness oracle).
"""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanledger.functions.fingerprint import fingerprint
from scanledger.functions import week_start
from scanledger.session import read_table

FINDING_COLUMNS = [
    "repo", "run_date", "ingest_seq", "scanner", "severity", "title", "description",
    "file_path", "line", "recommendation", "rule_id", "fingerprint",
]


def events_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event = one raw finding; one (repo, ISO week) = one scan run."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    scanner = (
        F.when(F.col("event_type") == "error", "gitleaks")
        .when(F.col("event_type") == "click", "semgrep")
        .when(F.col("event_type") == "view", "trivy")
        .when(F.col("event_type") == "purchase", "pip-audit")
        .otherwise("licenses")
    )
    v = F.col("value")
    severity = (
        F.when(v >= 110, "CRITICAL").when(v >= 60, "HIGH").when(v >= 30, "MEDIUM")
        .when(v >= 10, "LOW").otherwise("INFO")
    )
    base = e.select(
        F.concat(F.lit("org/repo-"), F.col("user_id")).alias("repo"),
        week_start("ts").alias("run_date"),
        F.col("event_id").alias("ingest_seq"),
        scanner.alias("scanner"),
        severity.alias("severity"),
        F.concat(F.lit("rule-"), k % 10).alias("rule_id"),
        F.col("event_type"),
    )
    out = base.select(
        "repo", "run_date", "ingest_seq", "scanner", "severity",
        F.concat(F.lit("Issue "), F.col("rule_id")).alias("title"),
        F.concat(F.col("event_type"), F.lit(" event "), F.col("ingest_seq")).alias("description"),
        F.lit(None).cast("string").alias("file_path"),
        F.lit(None).cast("int").alias("line"),
        F.concat(F.lit("Review "), F.col("rule_id")).alias("recommendation"),
        "rule_id",
    )
    return out.withColumn("fingerprint", fingerprint("scanner", "title", "file_path", "line", "rule_id"))


def varied_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' findings with what tools also send: long titles and texts, pipes, paths of code and of tests, lines
    (0 among them), absent recommendations, rules and fingerprints, repos with nothing above INFO or LOW."""
    f = events_findings(spark, sf_dir)
    e, low = F.col("ingest_seq"), F.substring("repo", -1, 1)
    quiet = F.when(low == "3", "INFO").when((low == "4") & (F.col("severity") != "INFO"), "LOW").otherwise(F.col("severity"))
    paths = F.array(F.lit(None), F.lit(""), F.lit("src/app.py"), F.lit("tests/unit/app.py"), F.lit("lib/x_test.go"), F.lit("fixtures/a.json"))
    changed = {
        "severity": quiet,
        "title": F.when(e % 7 == 0, F.concat(F.lit("Issue | "), F.repeat(F.lit("long "), (14 + e % 40).cast("int")), F.col("rule_id"))).otherwise(F.col("title")),
        "description": F.when(e % 11 == 0, F.lit("")).when(e % 5 == 0, F.repeat("description", 150)).otherwise(F.col("description")),
        "file_path": F.get(paths, (e % 6).cast("int")),
        "line": F.when(e % 4 == 1, 0).when(e % 4 > 1, (e % 500 + 1).cast("int")),
        "recommendation": F.when(e % 13 == 0, F.lit(None)).when(e % 3 == 0, F.concat(F.repeat(F.lit("Review | "), 30), F.col("rule_id"))).otherwise(F.col("recommendation")),
        "rule_id": F.when(e % 19 != 0, F.col("rule_id")),
    }
    f = f.withColumns(changed).withColumn("fingerprint", fingerprint("scanner", "title", "file_path", "line", "rule_id"))
    return f.withColumn("fingerprint", F.when(e % 17 == 0, F.lit("")).otherwise(F.col("fingerprint")))


#: The findings that registered queries are built on: ``events_findings``, or ``varied_findings`` in their second form.
FINDINGS = ContextVar("findings", default=events_findings)


def events_scans(findings: DataFrame) -> DataFrame:
    """Scan runs = distinct (repo, run_date) of the fixture (partial aggregation before the shuffle).

    The varied form has a repo that is scanned in every run and has no findings.
    """
    runs = findings.select("repo", "run_date").distinct()
    if FINDINGS.get() is varied_findings:
        runs = runs.unionByName(findings.select(F.lit("org/quiet").alias("repo"), "run_date").distinct())
    return runs


def weekly_scans(findings: DataFrame) -> DataFrame:
    """Every repo scanned each week from its first run to the fixture's last: runs without findings are among them."""
    first = findings.groupBy("repo").agg(F.min("run_date").alias("first"))
    last = findings.select(F.max("run_date")).scalar()
    return first.select("repo", F.explode(F.sequence("first", last, F.expr("interval 7 days"))).alias("run_date"))


def event_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, run_date, scanner, started, finished): each event is a part of a scan, at its time."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts")
    parts = events_findings(spark, sf_dir).join(e, F.col("ingest_seq") == F.col("event_id"))
    return parts.select("repo", "run_date", "scanner", F.col("ts").alias("started"), F.col("ts").alias("finished"))


def suppressions_fixture(findings: DataFrame) -> DataFrame:
    """Suppressed keys of the fixture: fingerprints starting with hex digit 0."""
    return findings.filter(F.col("fingerprint").startswith("0")).select("repo", "fingerprint").distinct()


def open_issues_fixture(findings: DataFrame) -> DataFrame:
    """Open issue titles carrying the fingerprint tag, for fingerprints starting with 1."""
    return (
        findings.filter(F.col("fingerprint").startswith("1"))
        .select(
            "repo",
            F.concat(
                F.lit("[Security] CRITICAL: "), F.col("title"), F.lit(" ["),
                F.substring("fingerprint", 1, 8), F.lit("]"),
            ).alias("issue_title"),
        )
        .distinct()
    )


def existing_pages_fixture(findings: DataFrame) -> DataFrame:
    """Pages already filed, for fingerprints starting with 2."""
    return findings.filter(F.col("fingerprint").startswith("2")).select("repo", "fingerprint").distinct()


def dependency_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, package, version, license) inventory from lineitem x part (FIXTURES C).

    (repo, package) is a function of (l_orderkey % 500, l_partkey), and version and
    license are functions of the part: de-duplicate the two numeric keys first
    (partial aggregation before a narrow shuffle), join part to the distinct pairs,
    and only then build strings. The join never sees lineitem's full row count.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("r"), F.col("l_partkey").alias("p_partkey")
    ).filter(F.col("p_partkey").isNotNull()).distinct()
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    lic = F.col("p_partkey") % 8
    license_ = (
        F.when(lic == 0, "MIT").when(lic == 1, "Apache-2.0").when(lic == 2, "BSD-3-Clause")
        .when(lic == 3, "GPL-3.0").when(lic == 4, "LGPL-3.0").when(lic == 5, "AGPL-3.0-only")
        .when(lic == 6, "MPL-2.0").otherwise("SSPL-1.0")
    )
    joined = li.join(part, "p_partkey")
    return joined.select(
        F.concat(F.lit("org/repo-"), F.col("r")).alias("repo"),
        F.concat(F.lit("pkg-"), F.col("p_partkey")).alias("package"),
        F.concat(1 + F.col("p_size") % 5, F.lit("."), F.col("p_size") % 10, F.lit(".0")).alias("version"),
        license_.alias("license"),
    )


def dependency_edges(inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, edges): production roots of each repo, and (repo, package, dependency) within it, with cycles.

    A package needs the one after it in the repo's numeric order unless its number divides by 4, and the one before it
    if it divides by 5; every tenth number is a production root, the others are there for development.
    """
    number = F.substring("package", 5, 20).cast("bigint")
    w = Window.partitionBy("repo").orderBy(number)
    beside = inventory.select("repo", "package", number.alias("p"), F.lead("package").over(w).alias("after"), F.lag("package").over(w).alias("before"))
    needs = F.array(F.when(F.col("p") % 4 != 0, F.col("after")), F.when(F.col("p") % 5 == 0, F.col("before")))
    edges = beside.select("repo", "package", F.explode(needs).alias("dependency")).where("dependency is not null")
    return beside.where("p % 10 = 0").select("repo", "package"), edges


def untagged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding without fingerprint for each document: its source is the repo, its text's beginning the title."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("repo"), F.col("doc_id").alias("ingest_seq"), F.lit("semgrep").alias("scanner"),
        F.when(F.col("doc_id") % 5 == 0, "HIGH").otherwise("CRITICAL").alias("severity"),
        F.substring("text", 1, 90).alias("title"), F.lit("").alias("description"), F.lit(None).cast("string").alias("recommendation"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("")).alias("fingerprint"),
    )


def open_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of open issues: beginnings of every third document's text, half of them without its first three characters."""
    d = read_table(spark, sf_dir, "documents").where("doc_id % 3 = 0")
    begin = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("HIGH: "), F.substring("text", 1, 60))).otherwise(F.substring("text", 4, 80))
    return d.select(F.col("source").alias("repo"), F.concat(F.lit("[Security] "), begin).alias("issue_title"))


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisory table (vuln_id, package, version, fixed_version) from part (FIXTURES C)."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size").filter(F.col("p_partkey") % 11 == 0)
    return part.select(
        F.concat(F.lit("CVE-2024-"), 10000 + F.col("p_partkey")).alias("vuln_id"),
        F.concat(F.lit("pkg-"), F.col("p_partkey")).alias("package"),
        F.concat(1 + F.col("p_size") % 5, F.lit("."), F.col("p_size") % 10, F.lit(".0")).alias("version"),
        F.when(F.col("p_partkey") % 22 == 0, F.lit("")).otherwise(
            F.concat(2 + F.col("p_size") % 5, F.lit(".0.0"))
        ).alias("fixed_version"),
    )


# ----------------------------------------------------------------------------
# DuckDB oracle texts (CTE bodies). Kept next to the builders they mirror.

EVENTS_FINDINGS_SQL = """
ev_base AS (
  SELECT concat('org/repo-', user_id) AS repo,
         cast(date_trunc('week', ts) AS date) AS run_date,
         event_id AS ingest_seq,
         CASE event_type WHEN 'error' THEN 'gitleaks' WHEN 'click' THEN 'semgrep' WHEN 'view' THEN 'trivy'
                         WHEN 'purchase' THEN 'pip-audit' ELSE 'licenses' END AS scanner,
         CASE WHEN value >= 110 THEN 'CRITICAL' WHEN value >= 60 THEN 'HIGH' WHEN value >= 30 THEN 'MEDIUM'
              WHEN value >= 10 THEN 'LOW' ELSE 'INFO' END AS severity,
         concat('rule-', cast(json_extract_string(props, '$.k') AS int) % 10) AS rule_id,
         event_type
  FROM events
),
findings AS (
  SELECT repo, run_date, ingest_seq, scanner, severity,
         concat('Issue ', rule_id) AS title,
         concat(event_type, ' event ', ingest_seq) AS description,
         cast(NULL AS varchar) AS file_path,
         cast(NULL AS integer) AS line,
         concat('Review ', rule_id) AS recommendation,
         rule_id,
         substr(sha256(concat_ws('|', scanner, concat('Issue ', rule_id), '', '', rule_id)), 1, 16) AS fingerprint
  FROM ev_base
),
scans AS (SELECT DISTINCT repo, run_date FROM findings)"""

WEEKLY_SCANS_SQL = """
weekly AS (
  SELECT repo, cast(unnest(generate_series(min(run_date), (SELECT max(run_date) FROM findings), INTERVAL 7 DAY)) AS date)
    AS run_date
  FROM findings GROUP BY repo
)"""

VARIED_FINDINGS_SQL = (
    EVENTS_FINDINGS_SQL.strip()
    .replace("\nfindings AS (", "\nplain AS (")
    .replace("scans AS (SELECT DISTINCT repo, run_date FROM findings)", """varied AS (
  SELECT repo, run_date, ingest_seq, scanner,
    CASE WHEN right(repo, 1) = '3' THEN 'INFO' WHEN right(repo, 1) = '4' AND severity <> 'INFO' THEN 'LOW' ELSE severity END AS severity,
    CASE WHEN ingest_seq % 7 = 0 THEN concat('Issue | ', repeat('long ', cast(14 + ingest_seq % 40 AS integer)), rule_id) ELSE title END AS title,
    CASE WHEN ingest_seq % 11 = 0 THEN '' WHEN ingest_seq % 5 = 0 THEN repeat(description, 150) ELSE description END AS description,
    [NULL, '', 'src/app.py', 'tests/unit/app.py', 'lib/x_test.go', 'fixtures/a.json'][ingest_seq % 6 + 1] AS file_path,
    CASE WHEN ingest_seq % 4 = 1 THEN 0 WHEN ingest_seq % 4 > 1 THEN cast(ingest_seq % 500 + 1 AS integer) END AS line,
    CASE WHEN ingest_seq % 13 = 0 THEN NULL WHEN ingest_seq % 3 = 0 THEN concat(repeat('Review | ', 30), rule_id) ELSE recommendation END
      AS recommendation,
    CASE WHEN ingest_seq % 19 <> 0 THEN rule_id END AS rule_id
  FROM plain
),
findings AS (
  SELECT *, CASE WHEN ingest_seq % 17 = 0 THEN '' ELSE substr(sha256(concat(scanner, '|', title, '|', coalesce(file_path, ''), '|',
    CASE WHEN coalesce(line, 0) <> 0 THEN line::varchar ELSE '' END, CASE WHEN coalesce(rule_id, '') <> '' THEN concat('|', rule_id) ELSE '' END)), 1, 16) END
    AS fingerprint
  FROM varied
),
scans AS (SELECT DISTINCT repo, run_date FROM findings UNION SELECT DISTINCT 'org/quiet', run_date FROM findings)""")
)

SUPPRESSIONS_SQL = "suppressions AS (SELECT DISTINCT repo, fingerprint FROM findings WHERE fingerprint LIKE '0%')"
OPEN_ISSUES_SQL = (
    "open_issues AS (SELECT DISTINCT repo, concat('[Security] CRITICAL: ', title, ' [', substr(fingerprint, 1, 8), ']')"
    " AS issue_title FROM findings WHERE fingerprint LIKE '1%')"
)
EXISTING_PAGES_SQL = "existing_pages AS (SELECT DISTINCT repo, fingerprint FROM findings WHERE fingerprint LIKE '2%')"

INVENTORY_SQL = """
inventory AS (
  SELECT DISTINCT concat('org/repo-', l_orderkey % 500) AS repo, concat('pkg-', p_partkey) AS package,
         concat(1 + p_size % 5, '.', p_size % 10, '.0') AS version,
         CASE p_partkey % 8 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Apache-2.0' WHEN 2 THEN 'BSD-3-Clause' WHEN 3 THEN 'GPL-3.0'
           WHEN 4 THEN 'LGPL-3.0' WHEN 5 THEN 'AGPL-3.0-only' WHEN 6 THEN 'MPL-2.0' ELSE 'SSPL-1.0' END AS license
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
advisories AS (
  SELECT concat('CVE-2024-', 10000 + p_partkey) AS vuln_id, concat('pkg-', p_partkey) AS package,
         concat(1 + p_size % 5, '.', p_size % 10, '.0') AS version,
         CASE WHEN p_partkey % 22 = 0 THEN '' ELSE concat(2 + p_size % 5, '.0.0') END AS fixed_version
  FROM part WHERE p_partkey % 11 = 0
)"""

DEPENDENCIES_SQL = """
beside AS (
  SELECT repo, package, cast(substr(package, 5) AS bigint) AS p, lead(package) OVER w AS after, lag(package) OVER w AS before
  FROM inventory WINDOW w AS (PARTITION BY repo ORDER BY cast(substr(package, 5) AS bigint))
),
edges AS (
  SELECT repo, package, after AS dependency FROM beside WHERE p % 4 <> 0 AND after IS NOT NULL
  UNION ALL SELECT repo, package, before FROM beside WHERE p % 5 = 0 AND before IS NOT NULL
)"""


def with_events(*ctes: str) -> str:
    """WITH prefix holding the events findings fixture plus extra CTE bodies."""
    parts = [EVENTS_FINDINGS_SQL.strip()] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n"
