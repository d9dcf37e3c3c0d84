"""Stable finding fingerprint and the rule id it includes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference): raw-report keys searched for a rule
# id, in precedence order; the part separator; hex digits kept.
RULE_KEYS = ["RuleID", "check_id", "vuln_id", "id"]
SEPARATOR = "|"
FINGERPRINT_HEX = 16


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def line_part(line) -> Column:
    """``str(line or '')``: null and 0 both give the empty string."""
    line = _c(line)
    return F.when(F.coalesce(line, F.lit(0)) == 0, F.lit("")).otherwise(line.cast("string"))


def fingerprint(scanner, title, file_path, line, rule_id) -> Column:
    """First 16 hex digits of sha256(scanner|title|file_path|line[|rule_id]).

    ``concat_ws`` skips a null rule id, which is exactly the four-part form used
    when no rule key exists in the raw report.
    """
    key = F.concat_ws(
        SEPARATOR,
        _c(scanner),
        _c(title),
        F.coalesce(_c(file_path), F.lit("")),
        line_part(line),
        _c(rule_id),
    )
    return F.substring(F.sha2(key, 256), 1, FINGERPRINT_HEX)


def rule_id_from_json(raw) -> Column:
    """First of RuleID / check_id / vuln_id / id present (non-null) in a JSON object string."""
    raw = _c(raw)
    return F.coalesce(*[F.get_json_object(raw, f"$.{k}") for k in RULE_KEYS])


def with_fingerprint(df, rule_col: str = "rule_id"):
    return df.withColumn(
        "fingerprint",
        fingerprint("scanner", "title", "file_path", "line", rule_col),
    )
