"""Registered queries of sealed runs, trends and the scan log, with their DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanledger.operators import lifecycle as lc
from scanledger.operators import scan_log, sealing, trends
from scanledger.plans.catalog import REPLAY_SQL, STATE_COLS, _ev, register
from scanledger.sources import fixtures as fx
from scanledger.sources.fixtures import SUPPRESSIONS_SQL, WEEKLY_SCANS_SQL, with_events

#: Replay of the weekly scans: the runs of REPLAY_SQL are those of ``weekly``.
WEEKLY_REPLAY_SQL = f"{WEEKLY_SCANS_SQL.strip()},\n{REPLAY_SQL.strip().replace('FROM scans)', 'FROM weekly)')}"


@register("lifecycle_sealed_runs", with_events(WEEKLY_REPLAY_SQL) + f"SELECT {STATE_COLS}, resolved_on FROM state")
def q_sealed_runs(spark, sf_dir):
    """State from summaries of three stretches of runs (two sealed, one open) merged; runs without findings among them."""
    f = _ev(spark, sf_dir)
    seen = lc.fold_sightings(None, f, fx.weekly_scans(f))
    start = f.select(F.min("run_date")).scalar()
    one, two = F.date_add(start, 14), F.date_add(start, 28)
    cuts = [F.col("run_date") < one, (F.col("run_date") >= one) & (F.col("run_date") < two), F.col("run_date") >= two]
    sealed = sealing.summarise(seen.where(cuts[0]))
    for cut in cuts[1:]:
        sealed = sealing.merge_summaries(sealed, sealing.summarise(seen.where(cut)))
    return sealing.summary_state(sealed)


@register("lifecycle_weekly_scans", with_events(WEEKLY_REPLAY_SQL) + f"SELECT {STATE_COLS}, resolved_on FROM state")
def q_weekly_replay(spark, sf_dir):
    """Replay of weekly scans: a week without findings of a repo resolves its open keys."""
    f = _ev(spark, sf_dir)
    return lc.replay(f, fx.weekly_scans(f))


@register(
    "trend_deltas",
    with_events(WEEKLY_SCANS_SQL)
    + """
, k AS (SELECT repo, fingerprint, min(run_date) AS new FROM findings GROUP BY ALL),
e AS (
  SELECT *, (SELECT min(w.run_date) FROM weekly w WHERE w.repo = k.repo AND w.run_date > k.new AND NOT EXISTS (
      SELECT 1 FROM findings f WHERE f.repo = k.repo AND f.fingerprint = k.fingerprint AND f.run_date = w.run_date)) AS gone
  FROM k),
b AS (
  SELECT e.*, (SELECT min(f.run_date) FROM findings f WHERE f.repo = e.repo AND f.fingerprint = e.fingerprint AND f.run_date > e.gone) AS back
  FROM e),
t AS (
  SELECT w.repo, w.run_date, row_number() OVER (PARTITION BY w.repo ORDER BY w.run_date) AS run_no,
    (SELECT count(*) FROM findings f WHERE f.repo = w.repo AND f.run_date = w.run_date) AS total,
    (SELECT count(*) FROM b WHERE b.repo = w.repo AND b.new <= w.run_date
       AND (b.gone IS NULL OR b.gone > w.run_date OR b.back <= w.run_date)) AS open,
    (SELECT count(*) FROM b WHERE b.repo = w.repo AND b.gone = w.run_date) AS resolved
  FROM weekly w)
SELECT *, total - lag(total) OVER w AS total_delta, open - lag(open) OVER w AS open_delta,
  resolved - lag(resolved) OVER w AS resolved_delta
FROM t WINDOW w AS (PARTITION BY repo ORDER BY run_no)""",
)
def q_trend_deltas(spark, sf_dir):
    f = _ev(spark, sf_dir)
    return trends.trend_deltas(f, fx.weekly_scans(f))


@register(
    "scan_log_records",
    with_events()
    + """
SELECT f.repo, f.run_date, (epoch_us(max(e.ts)) - epoch_us(min(e.ts))) / 1e6 AS duration_seconds, count(*) AS finding_count,
  string_agg(DISTINCT f.scanner, ',' ORDER BY f.scanner) AS scanners
FROM findings f JOIN events e ON e.event_id = f.ingest_seq GROUP BY f.repo, f.run_date""",
)
def q_scan_log_records(spark, sf_dir):
    return scan_log.scan_records(fx.event_scans(spark, sf_dir), _ev(spark, sf_dir))


@register(
    "suppress_appended",
    with_events(SUPPRESSIONS_SQL)
    + """
SELECT repo, fingerprint FROM suppressions
UNION SELECT repo, fingerprint FROM findings WHERE severity = 'INFO'""",
)
def q_suppress(spark, sf_dir):
    """The suppression list with the keys of all INFO findings added by hand; keys on it already stay single."""
    f = _ev(spark, sf_dir)
    return lc.suppress(fx.suppressions_fixture(f), f.where("severity = 'INFO'"))
