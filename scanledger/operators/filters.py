"""Row filters over findings: severity threshold, suppression, novelty, scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanledger.functions.severity import at_or_above

KEY = ["repo", "fingerprint"]

# Fixed values (must equal the reference): scanner names of the registry, in order.
SCANNER_NAMES = ["gitleaks", "semgrep", "pip-audit", "npm-audit", "trivy", "checkov", "hadolint", "licenses"]


def severity_at_least(df: DataFrame, threshold: str, order: str = "rank") -> DataFrame:
    """Keep findings at or above ``threshold`` (``order`` = "rank" or "lexical", see severity.at_or_above)."""
    return df.filter(at_or_above("severity", threshold, order))


def drop_suppressed(df: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Anti join on (repo, fingerprint); no bound-variable limit, null-safe."""
    return df.join(suppressions.select(*KEY).distinct(), KEY, "left_anti")


def new_only(df: DataFrame, state: DataFrame) -> DataFrame:
    """Findings whose key is not in the store yet."""
    return df.join(state.select(*KEY), KEY, "left_anti")


def scope_to_changes(df: DataFrame, changed_files: DataFrame) -> DataFrame:
    """Findings in files changed by a pull request: semi join on (repo, file_path)."""
    return df.join(changed_files.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_semi")


def source_filter(
    df: DataFrame,
    severities: list[str] | None = None,
    exclude_paths: list[str] | None = None,
) -> DataFrame:
    """Filters the original tools applied at the source, as plain predicates.

    ``severities``: keep only these severities (trivy's --severity list).
    ``exclude_paths``: regexes; findings whose file_path matches any are dropped
    (semgrep's --exclude). Null paths are never excluded.
    """
    if severities:
        df = df.filter(F.col("severity").isin(*[s.upper() for s in severities]))
    if exclude_paths:
        hit = F.lit(False)
        for pat in exclude_paths:
            hit = hit | F.coalesce(F.col("file_path").rlike(pat), F.lit(False))
        df = df.filter(~hit)
    return df


def checkov_frameworks(raw: DataFrame, frameworks: list[str] | None = None) -> DataFrame:
    """Raw reports of which checkov's hold only the results of the listed frameworks (its ``check_type``).

    A payload is one object or an array of them; an object without a check_type cannot be of another framework and
    stays, and so does a payload that is not JSON. No list: all stay. Reports of other scanners are untouched.
    """
    if not frameworks:
        return raw
    doc = F.try_parse_json("payload")
    is_list = F.schema_of_variant(doc).startswith("ARRAY")
    blocks = F.when(is_list, F.try_variant_get(doc, "$", "array<variant>")).otherwise(F.array(doc))
    kind = lambda b: F.try_variant_get(b, "$.check_type", "string")
    kept = F.to_json(F.filter(blocks, lambda b: kind(b).isNull() | kind(b).isin(*frameworks)))
    return raw.withColumn("payload", F.when((F.col("scanner") == "checkov") & doc.isNotNull(), kept).otherwise(F.col("payload")))


def select_scanners(df: DataFrame, names: list[str] | None = None, column: str = "scanner") -> DataFrame:
    """Scanner selection: explicit names, else all. Unknown names are an error (raised on the driver)."""
    if not names:
        return df
    unknown = [n for n in names if n not in SCANNER_NAMES]
    if unknown:
        raise ValueError(f"unknown scanner(s): {', '.join(unknown)}; known: {', '.join(SCANNER_NAMES)}")
    return df.filter(F.col(column).isin(*names))
