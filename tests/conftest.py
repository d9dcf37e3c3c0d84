import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[*]")
        .appName("scanledger-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from scanledger.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    yield spark


_BUILT: dict = {}


def built(spark, name, sf_dir="/root/testdata/sf0.001"):
    """The DataFrame of a registered query, built once for all tests (some run jobs while they are built)."""
    from scanledger.plans import catalog

    if name not in _BUILT:
        _BUILT[name] = catalog.QUERIES[name](spark, sf_dir)
    return _BUILT[name].select("*")  # what a run of it holds (broadcast tables, plans) goes with its test


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="scanledger-test-")


FINDING_SCHEMA = (
    "repo string, run_date date, ingest_seq bigint, scanner string, severity string, title string, "
    "description string, file_path string, line int, recommendation string, rule_id string"
)


def make_findings(spark, rows):
    """rows: dicts with at least repo, run_date, ingest_seq, scanner, severity, title."""
    import datetime as dt

    from scanledger.functions.fingerprint import with_fingerprint

    cols = [c.split()[0] for c in FINDING_SCHEMA.split(", ")]
    data = []
    for r in rows:
        r = dict(r)
        if isinstance(r.get("run_date"), str):
            r["run_date"] = dt.date.fromisoformat(r["run_date"])
        data.append(tuple(r.get(c, "" if c in ("description", "recommendation") else None) for c in cols))
    return with_fingerprint(spark.createDataFrame(data, FINDING_SCHEMA))


# The four canonical findings of the original tests, as rows.
CANONICAL = [
    dict(repo="r", run_date="2024-01-01", ingest_seq=1, scanner="gitleaks", severity="CRITICAL",
         title="Secret detected: aws-access-key", description="AWS key", file_path="config.py", line=42,
         recommendation="Rotate", rule_id="aws-access-key"),
    dict(repo="r", run_date="2024-01-01", ingest_seq=2, scanner="semgrep", severity="HIGH",
         title="python.sql-injection", description="SQL injection", file_path="db.py", line=15,
         recommendation="Use params | binds", rule_id="python.sql-injection"),
    dict(repo="r", run_date="2024-01-01", ingest_seq=3, scanner="pip-audit", severity="HIGH",
         title="requests 2.25.0: CVE-2023-32681", description="Leak", recommendation="Upgrade to 2.31.0",
         rule_id="CVE-2023-32681"),
    dict(repo="r", run_date="2024-01-01", ingest_seq=4, scanner="npm-audit", severity="MEDIUM",
         title="lodash: Prototype Pollution", description="pp", recommendation="Run `npm audit fix`"),
]
