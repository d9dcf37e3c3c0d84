"""Triage: input caps and payloads for a model, response parsing, and rule-based triage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanledger.functions.fingerprint import fingerprint
from scanledger.functions.severity import REPORTED_SEVERITIES, severity_rank
from scanledger.operators.aggregates import passthrough_triage
from scanledger.operators.packing import greedy_batches, prefix_sums

# Fixed values (must equal the reference): default input cap, payload cap and
# the marker appended to a cut payload; summary of an empty run.
MAX_FINDINGS = 500
MAX_CHARS = 12000
TRUNCATION_MARKER = "\n... (truncated)"
EMPTY_SUMMARY = "No findings detected."

FINDING_FIELDS = ["scanner", "severity", "title", "description", "file_path", "line", "recommendation", "fingerprint"]


def triage_cap(df: DataFrame, max_findings: int = MAX_FINDINGS) -> DataFrame:
    """First ``max_findings`` findings of each repo in arrival order.

    ``row_number() <= n`` is planned with a partial WindowGroupLimit before the
    shuffle, so each map task ships at most n rows per repo even for a repo
    holding most of the data.
    """
    w = Window.partitionBy("repo").orderBy("ingest_seq")
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= max_findings)


def finding_struct() -> F.Column:
    """The 8-field finding projection (no raw)."""
    return F.struct(*[F.col(c) for c in FINDING_FIELDS])


def triage_payload(df: DataFrame, max_findings: int = MAX_FINDINGS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Per repo, the JSON array sent to a model: as many of the capped findings as fit ``max_chars`` whole, in order.

    ``n_sent`` counts the findings in the payload and ``n_left`` those of the repo that are not; a payload that leaves
    some out ends in the marker, behind the array. A first finding that does not fit stands alone. The collected
    group is bounded by ``max_findings`` rows per repo. ``triage_batches`` sends all findings.
    """
    capped = triage_cap(df, max_findings).withColumn("js", F.to_json(finding_struct(), {"ignoreNullFields": "false"}))
    so_far = Window.partitionBy("repo").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    capped = capped.withColumn("end", F.sum(F.length("js") + 1).over(so_far) + 1)
    sent = capped.where((F.col("end") <= max_chars) | (F.col("position") == 1))
    agg = sent.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("position", "js"))).alias("items"))
    total = df.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    whole = F.concat(F.lit("["), F.concat_ws(",", F.transform("items", lambda x: x["js"])), F.lit("]"))
    left = F.col("n") - F.size("items")
    return agg.join(total.withColumnRenamed("repo", "_repo"), F.col("repo").eqNullSafe(F.col("_repo"))).select(
        "repo",
        F.when(left > 0, F.concat(whole, F.lit(TRUNCATION_MARKER))).otherwise(whole).alias("payload"),
        F.size("items").cast("bigint").alias("n_sent"),
        left.cast("bigint").alias("n_left"),
    )


def triage_batches(df: DataFrame, max_findings: int = MAX_FINDINGS, max_chars: int = MAX_CHARS) -> DataFrame:
    """All findings of each repo as numbered payloads (repo, batch, first_position, n_findings, payload).

    Each payload is a whole JSON array with as many findings, in arrival order, as fit ``max_findings`` and
    ``max_chars``; only a finding that is longer by itself stands alone in a longer one. Batches in order flatten to
    all findings. Cuts come from ``packing.greedy_batches``, so a repo with most of the rows is many tasks' work; what
    is collected is one payload, whose bound is checked.
    """
    js = F.to_json(finding_struct(), {"ignoreNullFields": "false"})
    rows = df.select("repo", "ingest_seq", js.alias("js")).withColumn("size", (F.length("js") + 1).cast("bigint"))
    placed = prefix_sums(rows, "repo", "ingest_seq", F.col("size"))
    sizes = placed.select(F.col("repo").alias("grp"), "position", "size")  # reads no texts
    cuts = greedy_batches(sizes, max_findings, max_chars - 1)  # with the brackets and commas an array has one character more
    taken = cuts.select("grp", "batch", "first_position", F.explode(F.sequence("first_position", F.col("first_position") + F.col("n_items") - 1)).alias("_at"))
    items = placed.join(taken, F.col("repo").eqNullSafe(F.col("grp")) & (F.col("position") == F.col("_at")))
    batches = items.groupBy("repo", "batch", "first_position").agg(F.array_sort(F.collect_list(F.struct("position", "js"))).alias("items"))
    payload = F.concat(F.lit("["), F.concat_ws(",", F.transform("items", lambda x: x["js"])), F.lit("]"))
    bounded = (F.size("items") == 1) | ((F.size("items") <= max_findings) & (F.length(payload) <= max_chars))
    return batches.select(
        "repo", "batch", "first_position", F.size("items").cast("bigint").alias("n_findings"),
        F.when(bounded, payload).otherwise(F.raise_error(F.lit("a payload is longer than its bound"))).alias("payload"),
    )


RESPONSE_ITEM = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("detail", T.StringType()),
        T.StructField("recommendation", T.StringType()),
        T.StructField("scanner", T.StringType()),
    ]
)
RESPONSE_SCHEMA = T.StructType(
    [T.StructField("summary", T.StringType())]
    + [T.StructField(s.lower(), T.ArrayType(RESPONSE_ITEM)) for s in REPORTED_SEVERITIES]
)


def _strip_ws(c: F.Column) -> F.Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_fences(c: F.Column) -> F.Column:
    """Strip whitespace; drop a leading fence line (or just the 3 backticks when there is
    no newline) and a trailing 3-backtick fence; strip again."""
    t = _strip_ws(c)
    t = F.when(
        t.startswith("```"),
        F.when(F.instr(t, "\n") > 0, F.regexp_replace(t, r"^[^\n]*\n", "")).otherwise(
            F.substring(t, 4, 1 << 30)
        ),
    ).otherwise(t)
    t = F.when(t.endswith("```"), F.regexp_replace(t, r"```$", "")).otherwise(t)
    return _strip_ws(t)


def parse_triage(responses: DataFrame, fallback: DataFrame) -> DataFrame:
    """Turn model responses (repo, response) into findings; fall back to passthrough per repo.

    A repo without a response that is a JSON object (after removing code
    fences) falls back to the passthrough grouping of its ``fallback`` findings;
    so does a repo without any response. One good response is enough.
    Triaged findings carry only scanner/title/detail/recommendation, so their
    fingerprint is computed from (scanner, title) with no path, line or rule.
    Output: repo, severity, scanner, title, description, recommendation, fingerprint, summary, triaged.
    """
    schema = T.StructType(RESPONSE_SCHEMA.fields + [T.StructField("_corrupt", T.StringType())])
    doc = F.from_json(strip_fences(F.col("response")), schema, {"columnNameOfCorruptRecord": "_corrupt"})
    parsed = responses.select("repo", doc.alias("r")).withColumn(
        "r", F.when(F.col("r").isNotNull() & F.col("r._corrupt").isNull(), F.col("r"))
    )
    ok = parsed.filter(F.col("r").isNotNull())
    items = ok.select(
        "repo",
        F.col("r.summary").alias("summary"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(s).alias("severity"), F.coalesce(F.col(f"r.{s.lower()}"), F.array()).alias("items"))
                    for s in REPORTED_SEVERITIES
                ]
            )
        ).alias("g"),
    ).select("repo", "summary", F.col("g.severity").alias("severity"), F.explode("g.items").alias("i"))
    triaged = items.select(
        "repo",
        "severity",
        F.coalesce(F.col("i.scanner"), F.lit("unknown")).alias("scanner"),
        F.coalesce(F.col("i.title"), F.lit("")).alias("title"),
        F.coalesce(F.col("i.detail"), F.lit("")).alias("description"),
        F.coalesce(F.col("i.recommendation"), F.lit("")).alias("recommendation"),
        F.coalesce(F.col("summary"), F.lit("")).alias("summary"),
    ).withColumn("fingerprint", fingerprint("scanner", "title", F.lit(None), F.lit(None), F.lit(None)))
    triaged = triaged.withColumn("triaged", F.lit(True))

    fb = fallback.join(ok.select("repo").distinct(), "repo", "left_anti")
    fb_summary = passthrough_triage(fb).select("repo", "summary").distinct()
    fb_rows = fb.join(fb_summary, "repo").select(
        "repo", "severity", "scanner", "title", "description", "recommendation", "summary", "fingerprint",
        F.lit(False).alias("triaged"),
    )
    return triaged.select(*fb_rows.columns).unionByName(fb_rows)


# Paths treated as noise by rule-based triage (test code, fixtures).
NOISE_PATHS = [r"(^|/)tests?/", r"(^|/)test_[^/]*$", r"_test\.[a-z]+$", r"(^|/)fixtures?/"]


def rule_triage(df: DataFrame, noise_paths: list[str] | None = None, detail_chars: int = 200) -> DataFrame:
    """Rule-based triage of the stated policy, at scale.

    * drop findings in test / fixture paths;
    * merge the same issue across files: one row per (repo, scanner, rule) where
      rule = rule_id or title;
    * secrets (gitleaks) are always CRITICAL; otherwise the most severe sighting;
    * detail cut to 200 characters.
    Only aggregates with partial combine: counts and extremes, never lists.
    """
    pats = NOISE_PATHS if noise_paths is None else noise_paths
    noise = F.lit(False)
    for p in pats:
        noise = noise | F.coalesce(F.col("file_path").rlike(p), F.lit(False))
    kept = df.filter(~noise).withColumn("rank", severity_rank("severity"))
    g = kept.groupBy("repo", "scanner", F.coalesce(F.col("rule_id"), F.col("title")).alias("rule")).agg(
        F.min("rank").alias("rank"),
        F.min_by(F.struct("title", "description", "recommendation", "fingerprint"), "ingest_seq").alias("first"),
        F.count(F.lit(1)).cast("bigint").alias("occurrences"),
        F.count_distinct("file_path").cast("bigint").alias("files"),
        F.min("file_path").alias("example_path"),
    )
    sev = F.when(F.col("scanner") == "gitleaks", F.lit("CRITICAL")).otherwise(
        F.element_at(F.array(*[F.lit(s) for s in ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]]), F.col("rank") + 1)
    )
    return g.select(
        "repo",
        "scanner",
        "rule",
        sev.alias("severity"),
        F.col("first.title").alias("title"),
        F.substring(F.col("first.description"), 1, detail_chars).alias("detail"),
        F.col("first.recommendation").alias("recommendation"),
        F.col("first.fingerprint").alias("fingerprint"),
        "occurrences",
        "files",
        "example_path",
    )


def empty_run_summary() -> str:
    return EMPTY_SUMMARY
