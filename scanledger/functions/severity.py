"""Severity parsing, ranking and the maps derived from it (all JVM-side Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference): severity names in declared order,
# most severe first; the SARIF level of each; the default for unknown input.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
REPORTED_SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
SARIF_LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}
UNKNOWN_SEVERITY = "LOW"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_severity_value(value: str | None) -> str:
    """Driver-side twin of :func:`severity_parse` for scalar arguments (thresholds)."""
    if value is None:
        return UNKNOWN_SEVERITY
    v = value.upper()
    return v if v in SEVERITIES else UNKNOWN_SEVERITY


def severity_parse(c) -> Column:
    """Upper-case; anything outside the five names (incl. null) becomes LOW."""
    u = F.upper(_c(c))
    return F.when(u.isin(*SEVERITIES), u).otherwise(F.lit(UNKNOWN_SEVERITY))


def severity_rank(c) -> Column:
    """0..3 for CRITICAL..LOW, 4 for everything else (the store's ORDER BY variant)."""
    c = _c(c)
    expr = F.when(c == "CRITICAL", 0).when(c == "HIGH", 1).when(c == "MEDIUM", 2).when(c == "LOW", 3)
    return expr.otherwise(4)


def rank_of(value: str) -> int:
    return SEVERITIES.index(parse_severity_value(value))


def at_or_above(c, threshold: str, order: str = "rank") -> Column:
    """Predicate "severity is at least as severe as threshold".

    ``order="rank"`` uses the declared order (the documented meaning);
    ``order="lexical"`` reproduces the as-shipped string comparison, where
    CRITICAL < HIGH < INFO < LOW < MEDIUM.
    """
    th = parse_severity_value(threshold)
    if order == "rank":
        return severity_rank(c) <= F.lit(rank_of(th))
    if order == "lexical":
        return _c(c) <= F.lit(th)
    raise ValueError(f"unknown severity order {order!r}")


def sarif_level(c) -> Column:
    c = _c(c)
    out = F.lit("warning")
    for sev, level in reversed(list(SARIF_LEVELS.items())):
        out = F.when(c == sev, F.lit(level)).otherwise(out)
    return out


def page_severity(c) -> Column:
    """Severity select for page work lists: the four reported names, else LOW (INFO -> LOW)."""
    u = F.upper(_c(c))
    return F.when(u.isin(*REPORTED_SEVERITIES), u).otherwise(F.lit(UNKNOWN_SEVERITY))
