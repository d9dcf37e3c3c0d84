import hashlib

import pytest
from pyspark.sql import functions as F

from scanledger.functions.fingerprint import fingerprint, rule_id_from_json
from scanledger.functions.severity import (
    at_or_above, page_severity, parse_severity_value, sarif_level, severity_parse, severity_rank,
)


def py_fingerprint(scanner, title, file_path, line, rule):
    parts = [scanner, title, file_path or "", str(line or "")]
    if rule is not None:
        parts.append(str(rule))
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]


CASES = [
    ("gitleaks", "key leak", "a.py", 10, "aws"),
    ("gitleaks", "key leak", "a.py", 10, None),
    ("semgrep", "x", None, None, None),
    ("trivy", "pkg: CVE-1", "", 0, "CVE-1"),
    ("semgrep", "ünïcødé — ✓", "dir/ñ.py", 7, "r|x"),
]


def test_fingerprint_matches_python_sha256(spark):
    df = spark.createDataFrame(CASES, "scanner string, title string, file_path string, line int, rule string")
    got = [r.fp for r in df.select(fingerprint("scanner", "title", "file_path", "line", "rule").alias("fp")).collect()]
    assert got == [py_fingerprint(*c) for c in CASES]


def test_fingerprint_ignores_severity_and_is_stable(spark):
    df = spark.createDataFrame([("a", "t", "f", 1, None)] * 2, "scanner string, title string, file_path string, line int, r string")
    fps = {r[0] for r in df.select(fingerprint("scanner", "title", "file_path", "line", "r")).collect()}
    assert len(fps) == 1 and len(next(iter(fps))) == 16


def test_rule_id_precedence(spark):
    df = spark.createDataFrame(
        [('{"id": "4", "vuln_id": "3", "check_id": "2", "RuleID": "1"}',), ('{"id": "4", "vuln_id": "3"}',),
         ('{"id": 7}',), ('{"code": "DL3006"}',)],
        "raw string",
    )
    assert [r[0] for r in df.select(rule_id_from_json("raw")).collect()] == ["1", "3", "7", None]


def test_severity_parse_and_rank(spark):
    vals = ["critical", "HIGH", "Medium", "low", "info", "ERROR", "WARNING", "moderate", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    parsed = [r[0] for r in df.select(severity_parse("s")).collect()]
    assert parsed == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "LOW", "LOW", "LOW", "LOW"]
    ranks = [r[0] for r in df.select(severity_rank(severity_parse("s"))).collect()]
    assert ranks == [0, 1, 2, 3, 4, 3, 3, 3, 3]
    assert parse_severity_value("bogus") == "LOW"


# Threshold table: rank order (documented) vs lexical order (as shipped).
THRESHOLDS = {
    "CRITICAL": ({"CRITICAL"}, {"CRITICAL"}),
    "HIGH": ({"CRITICAL", "HIGH"}, {"CRITICAL", "HIGH"}),
    "MEDIUM": ({"CRITICAL", "HIGH", "MEDIUM"}, {"CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"}),
    "LOW": ({"CRITICAL", "HIGH", "MEDIUM", "LOW"}, {"CRITICAL", "HIGH", "LOW", "INFO"}),
    "INFO": ({"CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"}, {"CRITICAL", "HIGH", "INFO"}),
}


@pytest.mark.parametrize("threshold", list(THRESHOLDS))
def test_threshold_both_orders(spark, threshold):
    df = spark.createDataFrame([(s,) for s in ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]], "severity string")
    by_rank = {r[0] for r in df.filter(at_or_above("severity", threshold, "rank")).collect()}
    by_lex = {r[0] for r in df.filter(at_or_above("severity", threshold, "lexical")).collect()}
    assert (by_rank, by_lex) == THRESHOLDS[threshold]


def test_sarif_level_and_page_severity(spark):
    df = spark.createDataFrame([(s,) for s in ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "X"]], "s string")
    assert [r[0] for r in df.select(sarif_level("s")).collect()] == ["error", "error", "warning", "note", "note", "warning"]
    assert [r[0] for r in df.select(page_severity("s")).collect()] == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "LOW", "LOW"]


def test_threshold_filter_high_keeps_two(spark):
    df = spark.createDataFrame([(s,) for s in ["CRITICAL", "HIGH", "MEDIUM", "LOW"]], "severity string")
    assert df.filter(at_or_above(F.col("severity"), "HIGH")).count() == 2


def test_fingerprint_random_tuples_match_python(spark):
    import random

    rng = random.Random(1234)
    alphabet = "abcXYZ09 |/._-éß中😀\t"

    def s(nullable=True):
        if nullable and rng.random() < 0.2:
            return None
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))

    cases = []
    for _ in range(500):
        line = rng.choice([None, 0, 1, rng.randint(2, 10**6)])
        cases.append((s(False), s(False), s(), line, s()))
    df = spark.createDataFrame(cases, "scanner string, title string, file_path string, line int, rule string")
    got = [r.fp for r in df.select(fingerprint("scanner", "title", "file_path", "line", "rule").alias("fp")).collect()]
    assert got == [py_fingerprint(*c) for c in cases]
