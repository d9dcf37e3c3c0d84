"""Lifecycle of sealed runs: a mergeable summary of one row per key instead of one row per key and run.

The runs of a repo are numbered by date. A *stretch* is a set of consecutive runs of each repo; its summary holds, for
each key (repo, fingerprint), where its first island begins (``f0``, counted within the stretch), how long that is
(``isl``), in how many runs the key is seen (``na``), the last of them (``last_at``), the first and last dates and
fields, and the run that ended the first island (``ended_on``; null while it reaches the stretch's end). One more row a
repo, with a null fingerprint, holds the number of runs (``na``) and the first and last of them.

Two summaries of neighbouring stretches merge into that of both, in any grouping, so runs that can no longer change
are folded once and their sightings dropped. The state follows from the summary of all runs, as in ``replay``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanledger.operators.lifecycle import _FIRST, _LAST, KEY, STATE_COLUMNS, run_numbers

SUMMARY_COLUMNS = [*KEY, "f0", "isl", "na", "last_at", "first_seen", "last_seen", "first", "last", "ended_on"]


def summarise(seen: DataFrame, run_col: str = "run_date") -> DataFrame:
    """Summary of a stretch from its sightings, as ``fold_sightings`` holds them (a run's own row has a null fingerprint)."""
    runs = run_numbers(seen.where("fingerprint is null"), run_col)
    s = seen.where("fingerprint is not null").join(runs, ["repo", run_col])
    w = Window.partitionBy(*KEY).orderBy("seq")
    s = s.withColumn("rn", F.row_number().over(w)).withColumn("start", F.min("seq").over(Window.partitionBy(*KEY)))
    s = s.withColumn("in_first", F.col("seq") - F.col("rn") + 1 == F.col("start"))
    keys = s.groupBy(*KEY).agg(
        F.min("seq").cast("bigint").alias("f0"),
        F.count_if("in_first").alias("isl"),
        F.count(F.lit(1)).alias("na"),
        F.max("seq").cast("bigint").alias("last_at"),
        F.min(run_col).alias("first_seen"),
        F.max(run_col).alias("last_seen"),
        F.min_by("first", "seq").alias("first"),
        F.max_by("last", "seq").alias("last"),
        F.max(F.when(F.col("in_first"), F.struct("seq", "next_run")))["next_run"].alias("ended_on"),
    )
    repos = runs.groupBy("repo").agg(
        F.count(F.lit(1)).alias("na"), F.min(run_col).alias("first_seen"), F.max(run_col).alias("last_seen")
    ).withColumn("fingerprint", F.lit(None).cast("string"))
    return keys.unionByName(repos, allowMissingColumns=True).select(*SUMMARY_COLUMNS)


def merge_summaries(left: DataFrame, right: DataFrame) -> DataFrame:
    """Summary of two neighbouring stretches; every run of ``left`` is before those of ``right`` in its repo."""
    keyed = lambda df, p: df.where("fingerprint is not null").select(*KEY, *[F.col(c).alias(f"{p}_{c}") for c in SUMMARY_COLUMNS[2:]])
    before = left.where("fingerprint is null").select("repo", F.col("na").alias("n_left"))
    after = right.where("fingerprint is null").select("repo", F.col("first_seen").alias("next_run"))
    j = keyed(left, "l").join(keyed(right, "r"), KEY, "full_outer").join(before, "repo", "left").join(after, "repo", "left")
    n_left, new = F.coalesce("n_left", F.lit(0)), F.col("l_f0").isNull()
    reaches = F.col("l_f0") + F.col("l_isl") - 1 == n_left
    one = reaches & F.coalesce(F.col("r_f0") == 1, F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0))
    keys = j.select(
        *KEY,
        F.coalesce("l_f0", F.col("r_f0") + n_left).alias("f0"),
        F.when(new, F.col("r_isl")).when(one, F.col("l_isl") + F.col("r_isl")).otherwise(F.col("l_isl")).alias("isl"),
        (zero("l_na") + zero("r_na")).alias("na"),
        F.coalesce(F.col("r_last_at") + n_left, "l_last_at").alias("last_at"),
        *[F.coalesce(f"l_{c}", f"r_{c}").alias(c) for c in ("first_seen", "first")],
        *[F.coalesce(f"r_{c}", f"l_{c}").alias(c) for c in ("last_seen", "last")],
        F.when(new | one, F.col("r_ended_on")).when(reaches, F.col("next_run")).otherwise(F.col("l_ended_on")).alias("ended_on"),
    )
    runs = left.unionByName(right).where("fingerprint is null").groupBy(*KEY).agg(
        F.sum("na").alias("na"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
    return keys.unionByName(runs, allowMissingColumns=True).select(*SUMMARY_COLUMNS)


def summary_state(summary: DataFrame) -> DataFrame:
    """State of every key (STATE_COLUMNS + resolved_on) from the summary of all its repo's runs."""
    n = summary.where("fingerprint is null").select("repo", F.col("na").alias("n_runs"))
    s = summary.where("fingerprint is not null").join(n, "repo")
    still_open = F.col("f0") + F.col("isl") - 1 == F.col("n_runs")
    return s.select(
        *KEY,
        *[F.col(f"first.{c}").alias(c) for c in _FIRST],
        *[F.col(f"last.{c}").alias(c) for c in _LAST],
        "first_seen",
        "last_seen",
        F.when(still_open, "open").when(F.col("na") > F.col("isl"), "reopened").otherwise("resolved").alias("status"),
        F.col("ended_on").alias("resolved_on"),
    ).select(*STATE_COLUMNS, "resolved_on")


def sealed_until(summary: DataFrame) -> DataFrame:
    """(repo, sealed): the last run of each repo that the summary holds."""
    return summary.where("fingerprint is null").select("repo", F.col("last_seen").alias("sealed"))


def unsealed(rows: DataFrame, summary: DataFrame | None, run_col: str = "run_date") -> DataFrame:
    """Rows of runs that the summary does not hold."""
    if summary is None:
        return rows
    j = rows.join(sealed_until(summary), "repo", "left")
    return j.where(F.col("sealed").isNull() | (F.col(run_col) > F.col("sealed"))).drop("sealed")


def sealable(seen: DataFrame, open_runs: int, run_col: str = "run_date") -> DataFrame:
    """The sightings of all but the newest ``open_runs`` runs of each repo."""
    newest = Window.partitionBy("repo").orderBy(F.col(run_col).desc())
    runs = seen.where("fingerprint is null").withColumn("age", F.row_number().over(newest))
    old = runs.where(F.col("age") == open_runs + 1).select("repo", F.col(run_col).alias("until"))
    return seen.join(old, "repo").where(F.col(run_col) <= F.col("until")).drop("until")
