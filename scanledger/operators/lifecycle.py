"""Finding lifecycle across scan runs: open -> resolved -> reopened, plus suppression.

Two forms of the same state machine:

* :func:`merge_batch` folds one batch of runs into a state snapshot (the
  per-run upsert + mark-resolved of the original tool, as one full outer join).
* :func:`replay` computes the final state of a whole history at once with a
  closed form (gaps-and-islands over each key's run numbers): one shuffle on
  (repo, fingerprint) regardless of the number of runs.

State machine (per (repo, fingerprint)):

    (absent) --seen--> open --unseen--> resolved --seen--> reopened (absorbing)
    suppressed: absorbing; never resolved, never reported as new
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["repo", "fingerprint"]
STATE_COLUMNS = [
    "repo", "fingerprint", "scanner", "severity", "title", "description", "file_path", "line",
    "recommendation", "first_seen", "last_seen", "status",
]

_FIRST = ["scanner", "file_path", "line"]                          # kept from the first insert
_LAST = ["severity", "title", "description", "recommendation"]      # refreshed on every sighting


def _scope_cols(scope: str) -> list[str]:
    if scope == "repo":
        return ["repo"]
    if scope == "scanner":
        return ["repo", "scanner"]
    raise ValueError(f"unknown resolution scope {scope!r}")


def run_numbers(scans: DataFrame, run_col: str = "run_date", scope: str = "repo") -> DataFrame:
    """Dense run number per repo (or per repo and scanner), the next run, and the run count.

    ``scans`` holds every run, including runs with zero findings (those exist
    only there); with ``scope="scanner"`` it holds the (repo, scanner, run)
    triples of scanners that ran successfully. The window is over one row per
    run -- bounded by the number of runs, not by findings.
    """
    cols = _scope_cols(scope)
    runs = scans.select(*cols, run_col).distinct()
    w = Window.partitionBy(*cols).orderBy(run_col)
    return runs.select(
        *cols,
        run_col,
        F.row_number().over(w).alias("seq"),
        F.lead(run_col).over(w).alias("next_run"),
        F.count(F.lit(1)).over(Window.partitionBy(*cols)).alias("n_runs"),
    )


def sightings(findings: DataFrame, run_col: str = "run_date", scope: str = "repo") -> DataFrame:
    """One row per (repo, fingerprint, run): duplicates inside a run collapse map-side.

    First-in-run fields come from the smallest ingest_seq, mutable fields from
    the largest (last sighting wins). Partial aggregation runs before the
    shuffle, so a key repeated millions of times in one run ships one row per
    map task. (The fingerprint includes the scanner, so adding it to the
    grouping for ``scope="scanner"`` does not split keys.)
    """
    keys = ["repo", "fingerprint", run_col] + (["scanner"] if scope == "scanner" else [])
    return findings.groupBy(*keys).agg(
        F.min_by(F.struct(*_FIRST), "ingest_seq").alias("first"),
        F.max_by(F.struct(*_LAST), "ingest_seq").alias("last"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def fold_sightings(held: DataFrame | None, findings: DataFrame, scans: DataFrame, run_col: str = "run_date") -> DataFrame:
    """The sightings of ``findings`` added to those held: one row per (repo, fingerprint, run), and one per run.

    A run's own row has a null fingerprint, so runs without findings are kept. Fields come from the smallest and the
    largest ingest_seq of all batches; folding the same rows again, or in another order, gives the same table.
    """
    keys = [*KEY, run_col]
    fields = {"first": F.struct(*_FIRST), "last": F.struct(*_LAST), "first_seq": F.col("ingest_seq"), "last_seq": F.col("ingest_seq")}
    new = findings.select(*keys, *[c.alias(n) for n, c in fields.items()])
    runs = scans.select("repo", F.lit(None).cast("string").alias("fingerprint"), run_col).distinct()
    both = new.unionByName(runs, allowMissingColumns=True)
    if held is not None:
        both = held.unionByName(both)
    return both.groupBy(*keys).agg(
        F.min_by("first", "first_seq").alias("first"),
        F.max_by("last", "last_seq").alias("last"),
        F.min("first_seq").alias("first_seq"),
        F.max("last_seq").alias("last_seq"),
    )


def replay(
    findings: DataFrame,
    scans: DataFrame,
    suppressions: DataFrame | None = None,
    run_col: str = "run_date",
    scope: str = "repo",
    resolve_reopened: bool = False,
) -> DataFrame:
    """Final state of every (repo, fingerprint) after replaying all runs in order.

    With per-key run numbers ``seq`` (dense over the repo's runs), ``f0`` the
    first, ``isl`` the length of the unbroken island starting at ``f0``, ``na``
    the number of runs seen and ``n`` the repo's last run:

        open      if f0 + isl - 1 = n
        reopened  if na > isl
        resolved  otherwise

    The key was new in run f0 and resolved in run f0 + isl (when that exists).
    Output: STATE_COLUMNS + ``resolved_on`` (run that resolved it, or null).

    Options (both off = as shipped): ``scope="scanner"`` numbers runs per
    (repo, scanner), so a run resolves only findings of scanners that ran;
    ``resolve_reopened=True`` lets reopened keys resolve again (status is then
    open / reopened when seen in the last run, else resolved, and
    ``resolved_on`` is the latest resolving run).
    """
    return replay_sightings(sightings(findings, run_col, scope), scans, suppressions, run_col, scope, resolve_reopened)


def replay_sightings(
    seen: DataFrame,
    scans: DataFrame,
    suppressions: DataFrame | None = None,
    run_col: str = "run_date",
    scope: str = "repo",
    resolve_reopened: bool = False,
) -> DataFrame:
    """:func:`replay` from one row per (repo, fingerprint, run), as :func:`sightings` makes them."""
    cols = _scope_cols(scope)
    runs = run_numbers(scans, run_col, scope)
    s = seen.join(runs, [*cols, run_col])
    w = Window.partitionBy(*KEY).orderBy("seq")
    s = s.withColumn("rn", F.row_number().over(w)).withColumn(
        "f0", F.min("seq").over(Window.partitionBy(*KEY))
    )
    s = s.withColumn("in_first_island", F.col("seq") - F.col("rn") + 1 == F.col("f0"))
    agg = s.groupBy(*KEY).agg(
        F.min("seq").alias("f0"),
        F.count_if("in_first_island").alias("isl"),
        F.count(F.lit(1)).alias("na"),
        F.max("n_runs").alias("n"),
        F.min(run_col).alias("first_seen"),
        F.max(run_col).alias("last_seen"),
        F.min_by("first", "seq").alias("first"),
        F.max_by("last", "seq").alias("last"),
        F.max(F.when(F.col("in_first_island"), F.struct("seq", "next_run"))).alias("island_end"),
        F.max(F.struct("seq", "next_run")).alias("last_sighting"),
    )
    still_open = F.col("f0") + F.col("isl") - 1 == F.col("n")
    if resolve_reopened:
        seen_last = F.col("last_sighting.seq") == F.col("n")
        status = F.when(still_open, "open").when(seen_last, "reopened").otherwise("resolved")
        resolved_on = F.col("last_sighting.next_run")
    else:
        status = F.when(still_open, "open").when(F.col("na") > F.col("isl"), "reopened").otherwise("resolved")
        resolved_on = F.col("island_end.next_run")
    state = agg.select(
        *KEY,
        *[F.col(f"first.{c}").alias(c) for c in _FIRST],
        *[F.col(f"last.{c}").alias(c) for c in _LAST],
        "first_seen",
        "last_seen",
        status.alias("status"),
        resolved_on.alias("resolved_on"),
    )
    if suppressions is not None:
        state = apply_suppressions(state, suppressions)
    return state.select(*STATE_COLUMNS, "resolved_on")


def apply_suppressions(state: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Status 'suppressed' for suppressed keys (absorbing); other rows untouched.

    The state is already hash-partitioned on (repo, fingerprint) after the
    replay aggregate, so only the suppression list is shuffled (or broadcast
    when AQE measures it small).
    """
    sup = suppressions.select(*KEY).distinct().withColumn("_sup", F.lit(True))
    j = state.join(sup, KEY, "left")
    return j.withColumn(
        "status", F.when(F.col("_sup"), F.lit("suppressed")).otherwise(F.col("status"))
    ).drop("_sup")


def run_deltas(findings: DataFrame, scans: DataFrame, run_col: str = "run_date") -> DataFrame:
    """Per (repo, run): raw findings, distinct active fingerprints, new and resolved counts.

    Every run of ``scans`` appears, zero-finding runs included. All inputs are
    aggregated to (repo, run) grain before they are joined.
    """
    state = replay(findings, scans, run_col=run_col)
    runs = scans.select("repo", run_col).distinct()
    totals = findings.groupBy("repo", run_col).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct(F.when(F.col("fingerprint") != "", F.col("fingerprint"))).alias("active"),
    )
    # one pass over the state: each key contributes a "new" event at first_seen and a
    # "resolved" event at resolved_on; both counted in a single aggregation
    events = state.select(
        "repo",
        F.explode(
            F.array(
                F.struct(F.col("first_seen").alias("run"), F.lit(True).alias("is_new")),
                F.struct(F.col("resolved_on").alias("run"), F.lit(False).alias("is_new")),
            )
        ).alias("ev"),
    ).filter(F.col("ev.run").isNotNull())
    deltas = events.groupBy("repo", F.col("ev.run").alias(run_col)).agg(
        F.count_if(F.col("ev.is_new")).alias("new"),
        F.count_if(~F.col("ev.is_new")).alias("resolved"),
    )
    out = runs.join(totals, ["repo", run_col], "left").join(deltas, ["repo", run_col], "left")
    return out.select(
        "repo",
        run_col,
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("total", "active", "new", "resolved")],
    )


def merge_batch(
    state: DataFrame | None,
    batch: DataFrame,
    batch_scans: DataFrame,
    suppressions: DataFrame | None = None,
    run_col: str = "run_date",
    notify_new_only: bool = True,
    scope: str = "repo",
    resolve_reopened: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Fold one batch (at most one run per repo) into ``state``.

    Returns ``(new_state, emitted)``:

    * new_state -- missing keys inserted (open, first_seen = last_seen = run);
      present keys refreshed (last_seen, severity, title, description,
      recommendation) with resolved -> reopened; open keys of a repo scanned in
      this batch but not seen -> resolved; suppressed keys untouched.
    * emitted -- the batch rows to notify about: the first sighting of each new
      key (``notify_new_only``), or every non-suppressed row.

    The batch is aggregated to one row per key before the full outer join, so
    the join is key-unique on both sides. ``scope`` / ``resolve_reopened`` as in
    :func:`replay` (``batch_scans`` then carries the scanners that ran).
    """
    if state is None:
        state = batch.sparkSession.createDataFrame([], _state_schema(batch, run_col))
    state = state.select(*STATE_COLUMNS)
    cols = _scope_cols(scope)
    # one row per scope key, so the join below can never duplicate state rows (batches with several
    # runs per repo belong to merge_runs; here the latest run of the batch is used)
    runs = batch_scans.groupBy(*cols).agg(F.max(run_col).alias("batch_run"))
    if scope == "scanner":
        runs = runs.withColumnRenamed("scanner", "_sc")

    b = batch.groupBy(*KEY).agg(
        F.min_by(F.struct(*_FIRST), "ingest_seq").alias("first"),
        F.max_by(F.struct(*_LAST), "ingest_seq").alias("last"),
        F.min("ingest_seq").alias("first_seq"),
        F.max(run_col).alias("_b_run"),
        F.lit(True).alias("_in_batch"),
    )
    sup_keys = state.filter(F.col("status") == "suppressed").select(*KEY)
    if suppressions is not None:
        sup_keys = sup_keys.unionByName(suppressions.select(*KEY))
    sup_keys = sup_keys.distinct().withColumn("_sup", F.lit(True))

    j = (
        state.withColumn("_in_state", F.lit(True))
        .join(b, KEY, "full_outer")
        .join(sup_keys, KEY, "left")
        .withColumn("_sc", F.coalesce(F.col("scanner"), F.col("first.scanner")))
        .join(runs, ["repo", "_sc"] if scope == "scanner" else ["repo"], "left")
        .withColumn("batch_run", F.coalesce(F.col("_b_run"), F.col("batch_run")))
    )
    in_state = F.coalesce(F.col("_in_state"), F.lit(False))
    in_batch = F.coalesce(F.col("_in_batch"), F.lit(False))
    sup = F.coalesce(F.col("_sup"), F.lit(False))

    def pick(c: str, src: str) -> F.Column:
        # state value unless the batch refreshes it
        refresh = in_batch & ~(sup & in_state)
        return F.when(refresh & ~in_state, F.col(f"{src}.{c}")).when(
            refresh & F.lit(src == "last"), F.col(f"{src}.{c}")
        ).otherwise(F.col(c))

    status = (
        F.when(sup, F.lit("suppressed"))
        .when(in_batch & ~in_state, F.lit("open"))
        .when(in_batch & (F.col("status") == "resolved"), F.lit("reopened"))
        .when(in_batch, F.col("status"))
        .when(F.col("status").isin(*(["open", "reopened"] if resolve_reopened else ["open"]))
              & F.col("batch_run").isNotNull(), F.lit("resolved"))
        .otherwise(F.col("status"))
    )
    touched = in_batch & ~(sup & in_state)
    new_state = j.select(
        *KEY,
        *[pick(c, "first").alias(c) for c in _FIRST],
        *[pick(c, "last").alias(c) for c in _LAST],
        F.when(in_state, F.col("first_seen")).otherwise(F.col("batch_run")).alias("first_seen"),
        F.when(touched, F.col("batch_run")).otherwise(F.col("last_seen")).alias("last_seen"),
        status.alias("status"),
    )

    # batch rows to emit
    flags = j.filter(in_batch).select(
        *KEY, (~in_state & ~sup).alias("_is_new"), sup.alias("_is_sup"), "first_seq"
    )
    rows = batch.join(flags, KEY, "inner").filter(~F.col("_is_sup"))
    if notify_new_only:
        rows = rows.filter(F.col("_is_new") & (F.col("ingest_seq") == F.col("first_seq"))).dropDuplicates(KEY)
    emitted = rows.drop("_is_new", "_is_sup", "first_seq")
    return new_state, emitted


def _state_schema(batch: DataFrame, run_col: str):
    from pyspark.sql import types as T

    f = {x.name: x.dataType for x in batch.schema.fields}
    return T.StructType(
        [
            T.StructField("repo", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("scanner", T.StringType()),
            T.StructField("severity", T.StringType()),
            T.StructField("title", T.StringType()),
            T.StructField("description", T.StringType()),
            T.StructField("file_path", T.StringType()),
            T.StructField("line", T.IntegerType()),
            T.StructField("recommendation", T.StringType()),
            T.StructField("first_seen", f[run_col]),
            T.StructField("last_seen", f[run_col]),
            T.StructField("status", T.StringType()),
        ]
    )


def suppress(suppressions: DataFrame, keys: DataFrame) -> DataFrame:
    """Append keys to the suppression list (the manual status update, as data)."""
    return suppressions.select(*KEY).unionByName(keys.select(*KEY)).distinct()


def merge_runs(
    state: DataFrame | None,
    findings: DataFrame,
    scans: DataFrame,
    suppressions: DataFrame | None = None,
    run_col: str = "run_date",
) -> DataFrame:
    """Replay any number of new runs onto an existing state snapshot (closed form).

    The state acts as run 0 of every repo: an ``open`` key counts as seen at
    run 0, so its island starts there; ``resolved`` keys become ``reopened`` if
    seen at all; ``reopened`` and ``suppressed`` keys keep their status.
    first_seen / scanner / file_path / line come from the state when present.
    Repos without a run in ``scans`` keep their rows untouched. Equals
    ``replay`` over the whole history (tested), with one shuffle on the key.
    """
    if state is None:
        return replay(findings, scans, suppressions, run_col).select(*STATE_COLUMNS)
    state = state.select(*STATE_COLUMNS)
    runs = run_numbers(scans, run_col)
    s = sightings(findings, run_col).join(runs, ["repo", run_col]).select(
        *KEY, "seq", run_col, "first", "last", "n_runs"
    )
    repo_runs = runs.groupBy("repo").agg(F.max("n_runs").alias("n_runs"))
    # open keys: a pseudo sighting at run 0 (only for repos with new runs; others stay untouched)
    seed = (
        state.filter(F.col("status") == "open")
        .join(repo_runs, "repo")
        .select(
            *KEY,
            F.lit(0).alias("seq"),
            F.lit(None).cast(findings.schema[run_col].dataType).alias(run_col),
            F.lit(None).cast(s.schema["first"].dataType).alias("first"),
            F.lit(None).cast(s.schema["last"].dataType).alias("last"),
            "n_runs",
        )
    )
    allr = s.unionByName(seed)
    w = Window.partitionBy(*KEY).orderBy("seq")
    allr = allr.withColumn("rn", F.row_number().over(w)).withColumn("f0", F.min("seq").over(Window.partitionBy(*KEY)))
    allr = allr.withColumn("in_first_island", F.col("seq") - F.col("rn") + 1 == F.col("f0"))
    agg = allr.groupBy(*KEY).agg(
        F.min("seq").alias("f0"),
        F.count_if("in_first_island").alias("isl"),
        F.count_if(F.col("seq") > 0).alias("na"),
        F.count(F.lit(1)).alias("nrows"),
        F.max("n_runs").alias("n"),
        F.min(run_col).alias("b_first"),
        F.max(run_col).alias("b_last"),
        F.min_by("first", F.when(F.col("seq") > 0, F.col("seq"))).alias("first"),
        F.max_by("last", F.when(F.col("seq") > 0, F.col("seq"))).alias("last"),
    )
    closed = (
        F.when(F.col("f0") + F.col("isl") - 1 == F.col("n"), "open")
        .when(F.col("nrows") > F.col("isl"), "reopened")
        .otherwise("resolved")
    )
    j = state.withColumn("_in_state", F.lit(True)).join(agg, KEY, "full_outer")
    in_state = F.coalesce(F.col("_in_state"), F.lit(False))
    seen = F.coalesce(F.col("na"), F.lit(0)) > 0
    st = F.col("status")
    status = (
        F.when(~in_state, closed)
        .when(st == "suppressed", st)
        .when(st == "reopened", st)
        .when(st == "resolved", F.when(seen, F.lit("reopened")).otherwise(st))
        .when(F.col("f0").isNull(), st)  # open key of a repo without new runs
        .otherwise(closed)
    )
    touched = seen & ~(in_state & (st == "suppressed"))
    out = j.select(
        *KEY,
        *[F.when(in_state, F.col(c)).otherwise(F.col(f"first.{c}")).alias(c) for c in _FIRST],
        *[F.when(touched, F.col(f"last.{c}")).otherwise(F.col(c)).alias(c) for c in _LAST],
        F.when(in_state, F.col("first_seen")).otherwise(F.col("b_first")).alias("first_seen"),
        F.when(touched, F.col("b_last")).otherwise(F.col("last_seen")).alias("last_seen"),
        status.alias("status"),
    )
    if suppressions is not None:
        out = apply_suppressions(out, suppressions)
    return out
