"""Detection jobs that produce findings straight from tables.

The original tool shells out to scanners per repository; here the same finding
shapes come from distributed scans of text and inventory tables. Detection
rules are inputs (literal regexes evaluated JVM-side inside one projection),
not a rules engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanledger.functions.fingerprint import fingerprint

# Default secret rules (rule id, Java/RE2-compatible regex, literal every match contains).
SECRET_RULES = [
    ("hex-token", r'token = "[0-9a-f]{40}"', 'token = "'),
    ("aws-access-key", r"AKIA[0-9A-Z]{16}", "AKIA"),
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN "),
    ("github-pat", r"ghp_[A-Za-z0-9]{36}", "ghp_"),
    ("slack-token", r"xox[baprs]-[0-9A-Za-z-]{10,}", "xox"),
]
# The same rules as they appear inside HTML, where quotes are entity-encoded.
HTML_SECRET_RULES = [(rid, rx.replace('"', "&quot;"), lit.replace('"', "&quot;")) for rid, rx, lit in SECRET_RULES]

# License line detector and line -> SPDX id rules (first match wins).
LICENSE_LINE = r"(?i)licen[sc]e"
LICENSE_LITERAL = "licen"  # every match of LICENSE_LINE contains it once lower-cased
SPDX_RULES = [
    ("Apache-2.0", r"(?i)apache license,? version 2\.0|apache-2\.0"),
    ("MIT", r"(?i)\bmit license\b"),
    ("GPL-3.0", r"(?i)gnu general public license,? version 3|\bgpl-3\.0\b|\bgplv3\b"),
    ("CC-BY-NC-4.0", r"(?i)\bcc by-nc 4\.0\b"),
]
# Fixed values (must equal the reference): default denied license ids.
DENIED_LICENSES = [
    "GPL-2.0", "GPL-3.0", "AGPL-3.0", "AGPL-1.0", "SSPL-1.0", "EUPL-1.1", "EUPL-1.2", "CPAL-1.0", "OSL-3.0",
]
SECRET_RECOMMENDATION = "Rotate this credential and remove from git history"
LICENSE_RECOMMENDATION = "Replace with a permissively-licensed alternative or obtain a commercial license"


def _any_of(rules) -> str:
    return "|".join(f"(?:{r[1]})" for r in rules)


def _has_any_literal(c: F.Column, rules) -> F.Column:
    """Exact, cheap prefilter: every match of a rule contains its literal (plain substring search)."""
    if any(len(r) < 3 or not r[2] for r in rules):
        return F.lit(True)  # a rule without a literal: no prefilter possible
    out = F.lit(False)
    for r in rules:
        out = out | F.contains(c, F.lit(r[2]))
    return out


def text_lines(df: DataFrame, id_col: str, text_col: str, prefilter=None) -> DataFrame:
    """(id, line_no, line) for every line of every text (1-based, split on newline).

    With ``prefilter`` (a regex, or a boolean Column over the text) only texts
    passing it are split: one pass over the whole text replaces an explode of
    all lines for texts that cannot match.
    Whole texts are always processed, never prefixes.
    """
    src = df.select(id_col, text_col)
    if prefilter is not None:
        src = src.filter(F.col(text_col).rlike(prefilter) if isinstance(prefilter, str) else prefilter)
    return src.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).select(
        id_col, (F.col("pos") + 1).cast("bigint").alias("line_no"), "line"
    )


def denied_predicate(c: F.Column, denied: list[str]) -> F.Column:
    """Case-insensitive substring test of a license text against the deny list (a theta semi join as one HOF)."""
    arr = F.array(*[F.lit(d.lower()) for d in denied])
    low = F.lower(c)
    return F.exists(arr, lambda d: F.contains(low, d))


def first_denied(c: F.Column, denied: list[str]) -> F.Column:
    low = F.lower(c)
    out = F.lit(None).cast("string")
    for d in reversed(denied):
        out = F.when(F.contains(low, F.lit(d.lower())), F.lit(d)).otherwise(out)
    return out


def scan_text(
    df: DataFrame,
    id_col: str,
    text_col: str,
    rules=None,
    scanner: str = "gitleaks",
    path_prefix: str = "",
) -> DataFrame:
    """Secret findings per (text, line, rule), shaped like gitleaks output.

    severity CRITICAL; title "Secret detected: <rule>"; file_path = prefix + id;
    line = line number; fingerprint over (scanner, title, path, line, rule).
    """
    rules = SECRET_RULES if rules is None else rules
    # texts and lines without any rule literal cannot match: substring search before any regex
    lines = text_lines(df, id_col, text_col, prefilter=_has_any_literal(F.col(text_col), rules)).filter(
        _has_any_literal(F.col("line"), rules)
    )
    hits = lines.select(
        id_col,
        "line_no",
        F.explode(
            F.filter(F.array(*[F.when(F.col("line").rlike(r[1]), F.lit(r[0])) for r in rules]), lambda x: x.isNotNull())
        ).alias("rule_id"),
    )
    out = hits.select(
        F.col(id_col),
        "line_no",
        "rule_id",
        F.lit(scanner).alias("scanner"),
        F.lit("CRITICAL").alias("severity"),
        F.concat(F.lit("Secret detected: "), F.col("rule_id")).alias("title"),
        F.concat(F.lit(path_prefix), F.col(id_col).cast("string")).alias("file_path"),
        F.col("line_no").cast("int").alias("line"),
        F.lit(SECRET_RECOMMENDATION).alias("recommendation"),
    )
    return out.withColumn("fingerprint", fingerprint("scanner", "title", "file_path", "line", "rule_id"))


def scan_licenses(
    df: DataFrame,
    id_col: str,
    text_col: str,
    spdx_rules=None,
    denied: list[str] | None = None,
) -> DataFrame:
    """License lines of each text: (id, line_no, spdx, denied, denied_by).

    A line mentioning a licence is mapped to the first SPDX rule it matches
    (else UNKNOWN) and checked against the deny list by case-insensitive
    substring, as the package-license check does.
    """
    spdx_rules = SPDX_RULES if spdx_rules is None else spdx_rules
    denied = DENIED_LICENSES if denied is None else denied
    prefilter = F.contains(F.lower(F.col(text_col)), F.lit(LICENSE_LITERAL))  # substring test before the regex
    lines = text_lines(df, id_col, text_col, prefilter=prefilter).filter(F.col("line").rlike(LICENSE_LINE))
    spdx = F.lit("UNKNOWN")
    for sid, rx in reversed(spdx_rules):
        spdx = F.when(F.col("line").rlike(rx), F.lit(sid)).otherwise(spdx)
    out = lines.select(id_col, "line_no", spdx.alias("spdx"))
    return out.select(
        id_col,
        "line_no",
        "spdx",
        denied_predicate(F.col("spdx"), denied).alias("denied"),
        first_denied(F.col("spdx"), denied).alias("denied_by"),
    )


def license_findings(inventory: DataFrame, denied: list[str] | None = None) -> DataFrame:
    """Denied-license findings over a package inventory (repo, package, version, license).

    One finding per package (first deny-list hit); severity HIGH. The raw
    record has no rule key, so the fingerprint has no rule part.
    """
    denied = DENIED_LICENSES if denied is None else denied
    hit = inventory.filter(denied_predicate(F.col("license"), denied))
    out = hit.select(
        "repo",
        "package",
        "version",
        "license",
        first_denied(F.col("license"), denied).alias("denied_by"),
        F.lit("licenses").alias("scanner"),
        F.lit("HIGH").alias("severity"),
        F.format_string("Restricted license: %s (%s)", F.col("package"), F.col("license")).alias("title"),
        F.format_string("Package %s v%s uses %s", F.col("package"), F.col("version"), F.col("license")).alias(
            "description"
        ),
        F.lit(LICENSE_RECOMMENDATION).alias("recommendation"),
    )
    return out.withColumn("fingerprint", fingerprint("scanner", "title", F.lit(None), F.lit(None), F.lit(None)))


def match_advisories(inventory: DataFrame, advisories: DataFrame, scanner: str = "pip-audit") -> DataFrame:
    """Dependency inventory x advisories on (package, version) -> dependency findings.

    An equi join; Spark/AQE pick broadcast or sort-merge from measured sizes.
    Duplicates are removed after the join, over the (few) matching rows.
    """
    inv = inventory.select("repo", "package", "version")
    adv = advisories.select("vuln_id", "package", "version", "fixed_version")
    # join first (the advisory side is the small one), then de-duplicate only the matches
    j = inv.join(adv, ["package", "version"]).distinct()
    fixed = F.coalesce(F.col("fixed_version"), F.lit(""))
    out = j.select(
        "repo",
        "package",
        "version",
        "vuln_id",
        F.lit(scanner).alias("scanner"),
        F.lit("HIGH").alias("severity"),
        F.format_string("%s %s: %s", F.col("package"), F.col("version"), F.col("vuln_id")).alias("title"),
        F.when(fixed != "", F.concat(F.lit("Upgrade to "), fixed)).otherwise(F.lit("No fix available yet")).alias(
            "recommendation"
        ),
    )
    return out.withColumn("fingerprint", fingerprint("scanner", "title", F.lit(None), F.lit(None), "vuln_id"))
