"""Per-repo exports and notification work lists, as tables.

Every output is row- or aggregate-shaped: one row per finding (CSV, SARIF
results, comment rows, issue / page work lists) or one row per repo built from
counts (digest, comment header, gate). No repo's findings are ever collected
into one value, so a repo holding a third of all findings is still spread over
all tasks; writers stream those rows into per-repo files.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanledger import TOOL_NAME
from scanledger.operators.containment import contained_terms
from scanledger.functions.severity import REPORTED_SEVERITIES, at_or_above, page_severity, sarif_level, severity_rank
from scanledger.operators.aggregates import severity_counts

# Severity badges of comments; default labels of created issues;
# page status; SARIF version and schema location.
SEVERITY_EMOJI = {"CRITICAL": "\U0001f534", "HIGH": "\U0001f7e0", "MEDIUM": "\U0001f7e1", "LOW": "\U0001f7e2"}
ISSUE_LABELS = ["security", "automated"]
PAGE_STATUS = "Open"
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json"
# Repos' files that a task of an export writes; tasks a core that list an export's folders.
FILES_A_TASK = 256
LISTINGS_A_CORE = 4
COMMENT_MARKER = f"<!-- {TOOL_NAME}-scan-results -->"


def _reported(df: DataFrame) -> DataFrame:
    return df.filter(F.col("severity").isin(*REPORTED_SEVERITIES))


def _truthy_str(c: F.Column) -> F.Column:
    return c.isNotNull() & (c != "")


# --------------------------------------------------------------------------- CSV / JSON / text


def csv_rows(df: DataFrame) -> DataFrame:
    """The 7 CSV columns per finding (plus repo), four reported severities, null path as ''."""
    return _reported(df).select(
        "repo",
        "severity",
        "title",
        "description",
        "scanner",
        "recommendation",
        F.coalesce(F.col("file_path"), F.lit("")).alias("file_path"),
        "fingerprint",
    )


def json_rows(df: DataFrame, with_seq: bool = False) -> DataFrame:
    """Findings of the JSON export: section (lower-case severity) + the 8-field projection. INFO is omitted."""
    extra = ["ingest_seq"] if with_seq else []
    return _reported(df).select(
        "repo",
        F.lower("severity").alias("section"),
        "scanner",
        "severity",
        "title",
        "description",
        "file_path",
        "line",
        "recommendation",
        "fingerprint",
        *extra,
    )


def json_summaries(df: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Header of each repo's JSON export: summary, raw_count, triaged_count (INFO counted)."""
    c = severity_counts(df, scans)
    return c.select(
        "repo",
        F.when(F.col("total") == 0, F.lit("No findings detected."))
        .otherwise(F.format_string("%d raw findings (triage skipped)", F.col("total")))
        .alias("summary"),
        F.col("total").alias("raw_count"),
        F.col("total").alias("triaged_count"),
    )


def text_summary_rows(df: DataFrame) -> DataFrame:
    """Rows of the console summary: severity, scanner, title cut to 60."""
    return _reported(df).select("repo", "severity", "scanner", F.substring("title", 1, 60).alias("title60"))


def text_summary_lines(df: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """The per-repo counts line of the console summary."""
    c = severity_counts(df, scans)
    return c.select(
        "repo",
        F.format_string(
            "  CRITICAL: %d  HIGH: %d  MEDIUM: %d  LOW: %d  Total: %d",
            "critical", "high", "medium", "low", "total",
        ).alias("line"),
    )


def _in_report_order(rows: DataFrame, df: DataFrame) -> DataFrame:
    """Within each repo's files: CRITICAL, HIGH, MEDIUM, LOW in turn, arrival order inside a level.

    Range partitioning on (repo, rank, ingest_seq) keeps a large repo spread
    over many ordered part files instead of one task. Creating files costs more
    than their rows: with many repos the tasks follow the number of repos, as a
    number of tasks that follows bytes alone leaves one or two more than cores.
    """
    keyed = rows.withColumn("_rank", severity_rank("severity"))
    keys = ["repo", "_rank", "ingest_seq"]
    spark = df.sparkSession
    tasks = math.ceil(rows.agg(F.approx_count_distinct("repo")).first()[0] / FILES_A_TASK)
    if tasks > spark.sparkContext.defaultParallelism:
        ranged = keyed.repartitionByRange(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
    else:
        ranged = keyed.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys).drop("_rank", "ingest_seq")


# quotes doubled, blanks kept: any CSV reader gets the fields back as they were
CSV_OPTIONS = {
    "header": True,
    "nullValue": "",
    "emptyValue": "",
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def export_csv(df: DataFrame, path: str) -> None:
    """One CSV per repo directory, header row, null path written as an empty field, report order."""
    rows = _reported(df).select(*csv_rows(df).columns, "ingest_seq").withColumn(
        "file_path", F.coalesce(F.col("file_path"), F.lit(""))
    )
    (
        _in_report_order(rows, df)
        .write.mode("overwrite")
        .partitionBy("repo")
        .options(**CSV_OPTIONS)
        .csv(path)
    )


CSV_COLUMNS = "severity string, title string, description string, scanner string, recommendation string, file_path string, fingerprint string"


def read_csv_export(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``export_csv`` again. A listing task lists many repos' folders (by default one or two each)."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(LISTINGS_A_CORE * spark.sparkContext.defaultParallelism))
    try:
        rows = spark.read.schema(f"{CSV_COLUMNS}, repo string").option("header", True).option("escape", '"').option("basePath", path).csv(path)
    finally:
        spark.conf.set(key, before)
    return rows.withColumn("file_path", F.coalesce("file_path", F.lit("")))


def export_store(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """Store report (all state columns) as JSON Lines or CSV with header; an empty result writes no rows."""
    w = rows.write.mode("overwrite")
    if fmt == "json":
        w.json(path)
    elif fmt == "csv":
        w.options(**CSV_OPTIONS).csv(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def export_json(df: DataFrame, path: str, scans: DataFrame | None = None) -> None:
    """JSON Lines per repo: ``summary/`` (one record per repo) and ``findings/`` (one per finding)."""
    json_summaries(df, scans).write.mode("overwrite").partitionBy("repo").json(f"{path}/summary")
    rows = _in_report_order(json_rows(df, with_seq=True), df)
    rows.write.mode("overwrite").partitionBy("repo").json(f"{path}/findings")


# --------------------------------------------------------------------------- SARIF


def _sarif_rule_id() -> F.Column:
    return F.when(_truthy_str(F.col("fingerprint")), F.col("fingerprint")).otherwise(F.col("title"))


def sarif_results(df: DataFrame) -> DataFrame:
    """One SARIF result per finding (INFO included); location only with a path, region only with a line."""
    has_path = _truthy_str(F.col("file_path"))
    return df.select(
        "repo",
        "scanner",
        _sarif_rule_id().alias("rule_id"),
        sarif_level("severity").alias("level"),
        F.concat(
            F.coalesce(F.col("description"), F.lit("")),
            F.lit("\n\nRecommendation: "),
            F.coalesce(F.col("recommendation"), F.lit("")),
        ).alias("message"),
        F.when(has_path, F.col("file_path")).alias("uri"),
        F.when(has_path & (F.coalesce(F.col("line"), F.lit(0)) != 0), F.col("line")).alias("start_line"),
        "ingest_seq",
    )


def sarif_rules(df: DataFrame) -> DataFrame:
    """Distinct rules per (repo, scanner run); the first finding of a rule id defines it."""
    r = df.select(
        "repo", "scanner", _sarif_rule_id().alias("rule_id"), "title", "severity", "ingest_seq"
    )
    g = r.groupBy("repo", "scanner", "rule_id").agg(
        F.min_by(F.struct("title", "severity"), "ingest_seq").alias("first")
    )
    return g.select(
        "repo",
        "scanner",
        "rule_id",
        F.substring("first.title", 1, 80).alias("name"),
        F.substring("first.title", 1, 200).alias("short_description"),
        sarif_level("first.severity").alias("level"),
        F.lit("").alias("help_uri"),
    )


def sarif_result_json(df: DataFrame) -> DataFrame:
    """Each result as its SARIF JSON object text (nulls dropped, as in the document)."""
    res = sarif_results(df)
    loc = F.when(
        F.col("uri").isNotNull(),
        F.array(
            F.struct(
                F.struct(
                    F.struct(F.col("uri").alias("uri")).alias("artifactLocation"),
                    F.when(F.col("start_line").isNotNull(), F.struct(F.col("start_line").alias("startLine"))).alias(
                        "region"
                    ),
                ).alias("physicalLocation")
            )
        ),
    )
    obj = F.struct(
        F.col("rule_id").alias("ruleId"),
        F.col("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        loc.alias("locations"),
    )
    return res.select("repo", "scanner", "ingest_seq", F.to_json(obj, {"ignoreNullFields": "true"}).alias("json"))


# --------------------------------------------------------------------------- PR comment


def _escape_pipes(c: F.Column) -> F.Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def pr_comment_summary(df: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Comment header per repo: marker, summary line, the four badges; the whole body when clean."""
    c = severity_counts(df, scans)
    summary = F.when(F.col("total") == 0, F.lit("No findings detected.")).otherwise(
        F.format_string("%d raw findings (triage skipped)", F.col("total"))
    )
    badges = F.concat_ws(
        " | ",
        *[F.format_string(f"{SEVERITY_EMOJI[s]} **%d** {s}", F.col(s.lower())) for s in REPORTED_SEVERITIES],
    )
    shown = sum((F.col(s.lower()) for s in REPORTED_SEVERITIES), F.lit(0))
    header = F.concat(
        F.lit(f"{COMMENT_MARKER}\n## Security Scan Results\n\n**"), summary, F.lit("**\n\n"), badges, F.lit("\n\n")
    )
    return c.select(
        "repo",
        shown.cast("bigint").alias("shown"),
        F.when(shown == 0, F.concat(header, F.lit("No security findings detected.\n"))).otherwise(header).alias(
            "header"
        ),
    )


def pr_comment_sections(df: DataFrame) -> DataFrame:
    """Opening block of each non-empty severity section: summary line and table head."""
    c = _reported(df).groupBy("repo", "severity").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    emoji = F.create_map(*[x for s in REPORTED_SEVERITIES for x in (F.lit(s), F.lit(SEVERITY_EMOJI[s]))])
    return c.select(
        "repo",
        "severity",
        "n",
        F.format_string(
            "<details>\n<summary>%s %s (%d)</summary>\n\n| Finding | Recommendation |\n|---|---|\n",
            emoji[F.col("severity")],
            F.col("severity"),
            F.col("n"),
        ).alias("section_head"),
    )


def pr_comment_rows(df: DataFrame) -> DataFrame:
    """One markdown table row per reported finding: pipes escaped, recommendation cut to 200 after escaping."""
    return _reported(df).select(
        "repo",
        "severity",
        "ingest_seq",
        F.concat(
            F.lit("| **"),
            _escape_pipes(F.col("title")),
            F.lit("**<br><sub>"),
            F.col("scanner"),
            F.lit("</sub> | "),
            F.substring(_escape_pipes(F.coalesce(F.col("recommendation"), F.lit(""))), 1, 200),
            F.lit(" |"),
        ).alias("row"),
    )


# --------------------------------------------------------------------------- digest


def digest(df: DataFrame, scans: DataFrame | None, run_date: str, send_on: str = "all") -> DataFrame:
    """Digest header per repo: counts, subject line and the send decision of the policy.

    ``send_on``: all | findings_only (any finding, INFO included) | critical_only.
    """
    if send_on not in ("all", "findings_only", "critical_only"):
        raise ValueError(f"unknown send policy {send_on!r}")
    c = severity_counts(df, scans)
    label = F.concat(F.lit(f" — {run_date} ["), F.col("repo"), F.lit("]"))
    subject = F.when(
        (F.col("critical") > 0) | (F.col("high") > 0),
        F.concat(F.format_string("Security Scan: %d Critical, %d High", F.col("critical"), F.col("high")), label),
    ).otherwise(F.concat(F.lit("Security Scan Clean"), label))
    send = {
        "all": F.lit(True),
        "findings_only": F.col("total") > 0,
        "critical_only": F.col("has_critical"),
    }[send_on]
    return c.select(
        "repo", "critical", "high", "medium", "low", "total", "has_critical",
        subject.alias("subject"), send.alias("send"),
    )


def digest_rows(df: DataFrame, page_urls: DataFrame | None = None) -> DataFrame:
    """Finding rows of the digest body: severity, title, description cut to 200, recommendation.

    ``page_urls`` (repo, fingerprint, url) attaches the link of each finding's
    page by an equi join on the fingerprint -- a positional zip would shift
    every link after a page that was skipped or failed.
    """
    rows = _reported(df).select(
        "repo", "severity", "fingerprint", "ingest_seq", "title",
        F.substring("description", 1, 200).alias("description"),
        "recommendation",
    )
    if page_urls is None:
        return rows.withColumn("page_url", F.lit(None).cast("string"))
    urls = page_urls.select("repo", "fingerprint", F.col("url").alias("page_url")).dropDuplicates(["repo", "fingerprint"])
    return rows.join(urls, ["repo", "fingerprint"], "left")


# --------------------------------------------------------------------------- issue / page work lists


def issue_work_list(
    df: DataFrame,
    open_issues: DataFrame,
    threshold: str = "CRITICAL",
    order: str = "rank",
    labels: list[str] | None = None,
    assignees: list[str] | None = None,
) -> DataFrame:
    """Issues to open: at/above the threshold, not already open, one per fingerprint (whole, not its tag).

    An open issue matches when its title contains the finding's tag
    ``[<first 8 hex of fingerprint>]``. Tags are pulled out of the titles with
    one regex and matched by an equi anti join on (repo, tag) -- no pairwise
    containment test. A finding without a fingerprint has no tag: it is looked
    for by the first 50 characters of its title, which any open title of the
    repo may contain (an n-gram index, ``containment.contained_terms``), and
    findings that share them are one issue.
    """
    lab = ISSUE_LABELS if labels is None else labels
    every = df.filter(at_or_above("severity", threshold, order))
    fields = F.struct("severity", "title", "scanner", "fingerprint", "description", "recommendation")
    cand = every.filter(_truthy_str(F.col("fingerprint")))
    cand = cand.withColumn("tag", F.concat(F.lit("["), F.substring("fingerprint", 1, 8), F.lit("]")))
    first = cand.groupBy("repo", "fingerprint", "tag").agg(F.min_by(fields, "ingest_seq").alias("f")).drop("fingerprint")
    existing = open_issues.select(
        "repo", F.explode(F.regexp_extract_all("issue_title", F.lit(r"(\[[0-9a-f]{8}\])"), 1)).alias("tag")
    ).distinct()
    todo = first.join(existing, ["repo", "tag"], "left_anti")
    untagged = every.filter(~_truthy_str(F.col("fingerprint"))).withColumn("term", F.substring(F.coalesce("title", F.lit("")), 1, 50))
    untagged = untagged.groupBy("repo", "term").agg(F.min_by(fields, "ingest_seq").alias("f"))
    known = contained_terms(untagged, open_issues, "repo", "term", "issue_title").withColumnsRenamed({"repo": "_repo", "term": "_term"})
    known = known.hint("merge")  # guessed small from files of compressed terms, and as many as these
    untagged = untagged.join(known, F.col("repo").eqNullSafe(F.col("_repo")) & (F.col("term") == F.col("_term")), "left_anti")
    todo = todo.unionByName(untagged.select("repo", F.lit("").alias("tag"), "f"))
    f = lambda c: F.col(f"f.{c}")
    title = F.concat(F.lit("[Security] "), f("severity"), F.lit(": "), F.substring(F.coalesce(f("title"), F.lit("")), 1, 80), F.lit(" "), F.col("tag"))
    body = F.concat(
        F.lit("## Security Finding\n\n**Severity:** "), f("severity"),
        F.lit("\n**Scanner:** "), f("scanner"),
        F.lit("\n**Fingerprint:** `"), F.coalesce(f("fingerprint"), F.lit("")),
        F.lit("`\n\n### Description\n"), F.coalesce(f("description"), F.lit("")),
        F.lit("\n\n### Recommendation\n"), F.coalesce(f("recommendation"), F.lit("")),
        F.lit(f"\n\n---\n<sub>Auto-created by {TOOL_NAME}</sub>"),
    )
    return todo.select(
        "repo",
        f("fingerprint").alias("fingerprint"),
        title.alias("issue_title"),
        body.alias("body"),
        F.array_join(F.array(*[F.lit(x) for x in lab]), ",").alias("labels"),
        F.array_join(F.array(*[F.lit(x) for x in (assignees or [])]), ",").alias("assignees"),
    )


def page_work_list(df: DataFrame, existing_pages: DataFrame, run_date: str) -> DataFrame:
    """Pages to create: one per fingerprint not already filed, with the page fields cut to size.

    A finding without a fingerprint cannot be looked for, so each gets its page.
    """
    fields = F.struct("severity", "title", "scanner", "description", "recommendation").alias("f")
    first = df.filter(_truthy_str(F.col("fingerprint"))).groupBy("repo", "fingerprint").agg(F.min_by(fields, "ingest_seq").alias("f"))
    todo = first.join(existing_pages.select("repo", "fingerprint"), ["repo", "fingerprint"], "left_anti")
    todo = todo.unionByName(df.filter(~_truthy_str(F.col("fingerprint"))).select("repo", "fingerprint", fields))
    return todo.select(
        "repo",
        "fingerprint",
        F.substring("f.title", 1, 100).alias("page_title"),
        page_severity("f.severity").alias("severity"),
        F.col("f.scanner").alias("scanner"),
        F.lit(PAGE_STATUS).alias("status"),
        F.lit(run_date).alias("date_found"),
        F.substring(F.coalesce(F.col("f.description"), F.lit("")), 1, 2000).alias("description"),
        F.concat(F.lit("Recommendation: "), F.substring(F.coalesce(F.col("f.recommendation"), F.lit("")), 1, 2000)).alias(
            "recommendation"
        ),
    )


# --------------------------------------------------------------------------- SARIF documents (K3, K4)

SARIF_INFO_URI = "https://example.invalid/scanledger"


def sarif_document_parts(df: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Ordered text fragments whose concatenation per repo is that repo's SARIF 2.1.0 document.

    Rows: (repo, k1, k2, k3, k4, text); order by (k1, k2, k3, k4) inside a repo.
    One run per scanner (runs ordered by scanner name), its rules (first
    finding of a rule id defines it) and results (arrival order; INFO kept).
    Commas come from per-run minima (aggregates), so no repo is ever gathered
    into one row or one task; a repo with no findings gets the single empty run.
    """
    res = sarif_result_json(df)
    rules = sarif_rules(df).join(
        df.select("repo", "scanner", _sarif_rule_id().alias("rule_id"), "ingest_seq")
        .groupBy("repo", "scanner", "rule_id").agg(F.min("ingest_seq").alias("ingest_seq")),
        ["repo", "scanner", "rule_id"],
    )
    rule_json = rules.select(
        "repo", "scanner", "ingest_seq",
        F.to_json(
            F.struct(
                F.col("rule_id").alias("id"), F.col("name"),
                F.struct(F.col("short_description").alias("text")).alias("shortDescription"),
                F.struct(F.col("level")).alias("defaultConfiguration"),
                F.col("help_uri").alias("helpUri"),
            )
        ).alias("json"),
    )
    runs = df.groupBy("repo", "scanner").agg(
        F.min("ingest_seq").alias("first_result"),
    )
    first_rule = rule_json.groupBy("repo", "scanner").agg(F.min("ingest_seq").alias("first_rule"))
    first_run = runs.groupBy("repo").agg(F.min("scanner").alias("first_scanner"))

    def comma(is_first: F.Column) -> F.Column:
        return F.when(is_first, F.lit("")).otherwise(F.lit(","))

    r_parts = res.join(runs, ["repo", "scanner"]).select(
        "repo", F.lit(1).alias("k1"), "scanner", F.lit(3).alias("k3"), F.col("ingest_seq").alias("k4"),
        F.concat(comma(F.col("ingest_seq") == F.col("first_result")), F.col("json")).alias("text"),
    )
    u_parts = rule_json.join(first_rule, ["repo", "scanner"]).select(
        "repo", F.lit(1).alias("k1"), "scanner", F.lit(1).alias("k3"), F.col("ingest_seq").alias("k4"),
        F.concat(comma(F.col("ingest_seq") == F.col("first_rule")), F.col("json")).alias("text"),
    )
    run_rows = runs.join(first_run, "repo")
    opener = F.concat(
        comma(F.col("scanner") == F.col("first_scanner")),
        F.lit('{"tool":{"driver":{"name":'), F.to_json(F.array("scanner")).substr(F.lit(2), F.length(F.to_json(F.array("scanner"))) - 2),
        F.lit(f',"informationUri":"{SARIF_INFO_URI}","rules":['),
    )
    o_parts = run_rows.select("repo", F.lit(1).alias("k1"), "scanner", F.lit(0).alias("k3"), F.lit(0).cast("bigint").alias("k4"),
                              opener.alias("text"))
    m_parts = run_rows.select("repo", F.lit(1).alias("k1"), "scanner", F.lit(2).alias("k3"), F.lit(0).cast("bigint").alias("k4"),
                              F.lit(']}},"results":[').alias("text"))
    c_parts = run_rows.select("repo", F.lit(1).alias("k1"), "scanner", F.lit(4).alias("k3"), F.lit(0).cast("bigint").alias("k4"),
                              F.lit("]}").alias("text"))
    repos = df.select("repo").distinct()
    if scans is not None:
        repos = repos.unionByName(scans.select("repo")).distinct()
    has = runs.select("repo").distinct().withColumn("_has", F.lit(True))
    rr = repos.join(has, "repo", "left")
    empty_run = (
        f'{{"tool":{{"driver":{{"name":"{TOOL_NAME}","informationUri":"{SARIF_INFO_URI}","rules":[]}}}},"results":[]}}'
    )
    header = F.concat(
        F.lit(f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":['),
        F.when(F.col("_has").isNull(), F.lit(empty_run)).otherwise(F.lit("")),
    )
    h_parts = rr.select("repo", F.lit(0).alias("k1"), F.lit("").alias("scanner"), F.lit(0).alias("k3"),
                        F.lit(0).cast("bigint").alias("k4"), header.alias("text"))
    f_parts = rr.select("repo", F.lit(2).alias("k1"), F.lit("").alias("scanner"), F.lit(0).alias("k3"),
                        F.lit(0).cast("bigint").alias("k4"), F.lit("]}").alias("text"))
    out = h_parts
    for p in (o_parts, u_parts, m_parts, r_parts, c_parts, f_parts):
        out = out.unionByName(p)
    return out.withColumnRenamed("scanner", "k2")


def write_sarif(df: DataFrame, path: str, scans: DataFrame | None = None, compress: bool = False) -> None:
    """Write each repo's SARIF document as ordered text parts under ``path/repo=<repo>/``.

    Range partitioning on the sort key splits even a very large repo over
    many tasks; the part files of a repo, read in name order, concatenate to
    its document. ``compress`` writes gzip parts (the upload body is the
    gzip of the document; base64 is left to the uploader).
    """
    parts = sarif_document_parts(df, scans)
    keys = ["repo", "k1", "k2", "k3", "k4"]
    w = parts.repartitionByRange(*keys).sortWithinPartitions(*keys).select("repo", "text").write.mode("overwrite")
    if compress:
        w = w.option("compression", "gzip")
    w.partitionBy("repo").text(path)  # newline between fragments = JSON whitespace
