"""Outputs by name: every sink of a run, dispatched over one stored input."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from scanledger.plans import documents, reports
from scanledger.session import ensure_checkpoint_dir


@dataclass
class Run:
    """What sinks need: findings, all scans (quiet repos too), and what was sent before."""

    findings: DataFrame
    scans: DataFrame | None = None
    open_issues: DataFrame | None = None
    existing_pages: DataFrame | None = None
    run_date: str = ""
    options: dict = field(default_factory=dict)

    def of(self, key: str, default):
        return self.options.get(key, default)


def _empty(run: Run, ddl: str) -> DataFrame:
    return run.findings.sparkSession.createDataFrame([], ddl)


def _issues(run: Run) -> DataFrame:
    known = run.open_issues if run.open_issues is not None else _empty(run, "repo string, issue_title string")
    return reports.issue_work_list(run.findings, known, threshold=run.of("issue_severity", "CRITICAL"), labels=run.of("labels", None), assignees=run.of("assignees", None))


def _pages(run: Run) -> DataFrame:
    known = run.existing_pages if run.existing_pages is not None else _empty(run, "repo string, fingerprint string")
    return reports.page_work_list(run.findings, known, run.run_date)


def _email(run: Run) -> DataFrame:
    """The digests that the policy sends."""
    return reports.digest(run.findings, run.scans, run.run_date, run.of("send_on", "all")).where("send")


#: Sink name -> its rows. Documents are rows of parts (repo, part, ...), in order within a repo.
SINKS: dict[str, Callable[[Run], DataFrame]] = {
    "notion": _pages,
    "email": _email,
    "github-issues": _issues,
    "github-comment": lambda run: documents.parts(documents.comment_fragments(run.findings, run.scans)),
    "sarif": lambda run: documents.parts(reports.sarif_document_parts(run.findings, run.scans)),
    "sarif-upload": lambda run: documents.upload_bodies(run.findings, run.scans),
    "json": lambda run: documents.parts(documents.json_fragments(run.findings, run.scans)),
    "csv": lambda run: reports.csv_rows(run.findings),
    "console": lambda run: reports.text_summary_lines(run.findings, run.scans),
}


def run_sinks(run: Run, names: list[str]) -> dict[str, DataFrame]:
    """The rows of each named sink, in the order given; unknown names are an error before anything runs.

    The findings are written to the checkpoint folder once, so that sinks do not parse the reports again.
    """
    unknown = [n for n in names if n not in SINKS]
    if unknown:
        raise ValueError(f"unknown sink(s): {', '.join(unknown)}; known: {', '.join(SINKS)}")
    ensure_checkpoint_dir(run.findings.sparkSession)
    run.findings = run.findings.checkpoint()
    return {n: SINKS[n](run) for n in names}


def write_sinks(run: Run, names: list[str], root: str) -> dict[str, str]:
    """Writes each named sink's rows as Parquet below ``root``; the folder of each."""
    paths = {}
    for name, rows in run_sinks(run, names).items():
        paths[name] = f"{root.rstrip('/')}/{name}"
        rows.write.mode("overwrite").parquet(paths[name])
    return paths
