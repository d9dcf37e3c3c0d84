"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Patterns give each document's base spans, and wide candidates: runs of 20 or more key characters with letters and
digits that no base span covers. The SHA-256 of every candidate's value is counted over the whole corpus by distinct
repositories and distinct owners. A value is a widely copied example if at least ``example_owners`` owners and
``example_repositories`` repositories hold it, or at least ``widely`` repositories whoever owns them (the copies of one
large source); every other value is a live-looking credential. Base spans always stay, with that judgement. A wide
candidate becomes a span of kind ``owned`` only if it is live-looking and at most ``max_owners`` owners hold it.

Matches are exploded with the text before them counted, so that their places are running sums; a wide candidate is
covered if the furthest end among the base spans that begin before its end lies behind its start. Both are windows over
one document's matches, linear in them. Values are joined with their counts in broadcast while these are few, else by
salted hash, as one value may be most documents'.

Base spans are leftmost and do not overlap within a kind:
  assign  a key word, ``:`` or ``=``, and a value of 6 characters or more (the value is hashed)
  access  ``AKIA`` and capitals or digits, 20 characters or more
  hex     lower-case hexadecimal digits, 24 or more
Positions count code points, the end is exclusive.

Defined cases: a null text is empty; a long text is read whole, its matches are rows; null owners count as one owner, null repositories as one repository; equal rows
each give a row and count once as a repository; an empty table gives an empty one; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanledger.llm import common as C


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEY_WORD = "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key")
ASSIGN = rf"""({KEY_WORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
WIDE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")


def _matches(kind: int, pattern: str, group: int, may: Column, fit) -> Column:
    """Array of (kind, pos, before, size, hash, fit) of all matches: characters since the match before, and its own.

    ``fit`` tells from (whole, value) whether a match counts; those that do not still take their place.
    """
    text = F.col("text")
    parts = F.split(text, pattern, -1)
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"), parts.alias("before"))
    told = F.transform(
        F.filter(found, lambda x: x["whole"].isNotNull()),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("pos"), F.length(x["before"]).alias("before"), F.length(x["whole"]).alias("size"),
            F.sha2(x["value"], 256).alias("hash"), fit(x["whole"], x["value"]).alias("fit"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,pos:int,before:int,size:int,hash:string,fit:boolean>>")
    return F.when(may, told).otherwise(none)


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of each document, and (row, owner, repo, kind, start, end, hash) of each base span and free wide candidate."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text, long = F.col("text"), lambda n: lambda whole, value: F.length(value) >= n
    found = F.concat(
        _matches(0, ASSIGN, 2, text.rlike(ASSIGN), long(6)),
        _matches(1, ACCESS, 0, text.contains("AKIA"), long(20)),
        _matches(2, HEX, 0, text.rlike("[0-9a-f]{24}"), long(24)),
        _matches(3, WIDE, 0, text.rlike(WIDE), lambda whole, value: whole.rlike("[0-9]") & whole.rlike("[A-Za-z]")),
    )
    rows = C.stash(d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repo", found.alias("matches")))
    m = rows.select("row", "owner", "repo", F.explode("matches").alias("m")).select("row", "owner", "repo", "m.*")
    so_far = W.partitionBy("row", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    spans = m.withColumn("end", F.sum(F.col("before") + F.col("size")).over(so_far).cast("int")).where("fit")
    spans = spans.withColumn("start", F.col("end") - F.col("size"))
    wide = F.col("kind") == 3
    ahead = W.partitionBy("row").orderBy(F.when(wide, F.col("end") - 1).otherwise(F.col("start")), wide).rowsBetween(W.unboundedPreceding, 0)
    spans = spans.withColumn("covered", F.coalesce(F.max(F.when(~wide, F.col("end"))).over(ahead), F.lit(0)))
    return rows.select("row", "doc_id"), spans.where(~wide | (F.col("covered") <= F.col("start"))).select("row", "owner", "repo", "kind", "start", "end", "hash")


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, n_repositories, n_owners) of every candidate value; each step aggregates within tasks first."""
    by_repo = spans.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


#: A value is a widely copied example from so many owners and repositories, or from so many repositories alone.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, WIDELY = 3, 10, 100


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = 1, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES, widely: int | None = WIDELY) -> DataFrame:
    """(doc_id, base, found) for each document: base spans, and all spans with how many repositories and owners hold each value.

    Spans are (start, kind, end, hash); those of ``found`` also carry n_repositories, n_owners and live. ``widely``:
    None never takes many repositories of few owners for an example. Kinds index KINDS.
    """
    rows, spans = candidates(docs, id_col, text_col, owner_col, repo_col)
    spans = C.stash(spans)
    copied = (F.col("n_owners") >= example_owners) & (F.col("n_repositories") >= example_repositories)
    copied = copied if widely is None else copied | (F.col("n_repositories") >= widely)
    judged = C.spread_join(spans, ownership(spans), "hash", "row").withColumn("live", ~copied).where((F.col("kind") < 3) | (F.col("live") & (F.col("n_owners") <= max_owners)))
    told = F.struct("start", "kind", "end", "hash", "n_repositories", "n_owners", "live")
    per_doc = judged.groupBy("row").agg(F.sort_array(F.collect_list(told)).alias("found"))  # one document's spans
    none = F.array().cast(per_doc.schema["found"].dataType)
    out = rows.join(per_doc, "row", "left").select("doc_id", F.coalesce("found", none).alias("found"))
    base = F.transform(F.filter("found", lambda s: s["kind"] < 3), lambda s: F.struct(*(s[c].alias(c) for c in ("start", "kind", "end", "hash"))))
    return out.select("doc_id", base.alias("base"), "found")


def joined_spans(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def op4(spark, sf_dir: str) -> DataFrame:
    found = secret_scan(C.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _kind_sql(kind: int, pattern: str, group: int, least: int) -> str:
    p = _sql(pattern)
    return f"""
  SELECT r, {kind} AS kind, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start, ms[i] AS m, vs[i] AS v
  FROM (SELECT r, parts, ms, vs, unnest(range(1, len(ms) + 1)) AS i
        FROM (SELECT r, string_split_regex(text, {p}) AS parts, regexp_extract_all(text, {p}) AS ms, regexp_extract_all(text, {p}, {group}) AS vs FROM d))
  WHERE length(vs[i]) >= {least}"""


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), base AS (
  SELECT r, kind, start, start + length(m) AS stop, sha256(v) AS h FROM ({_kind_sql(0, ASSIGN, 2, 6)} UNION ALL {_kind_sql(1, ACCESS, 0, 20)} UNION ALL {_kind_sql(2, HEX, 0, 24)})
), wide AS (
  SELECT r, kind, start, start + length(m) AS stop, sha256(v) AS h FROM ({_kind_sql(3, WIDE, 0, 20)}) w
  WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND b.start < w.start + length(w.m) AND w.start < b.stop)
), c AS (
  SELECT * FROM base UNION ALL SELECT * FROM wide
), o AS (
  SELECT h, count(DISTINCT coalesce('=' || source, '')) AS owners, count(DISTINCT (coalesce('=' || source, ''), coalesce(doc_id::VARCHAR, ''))) AS repositories
  FROM c JOIN d USING (r) GROUP BY h
), j AS (
  SELECT *, NOT (owners >= {EXAMPLE_OWNERS} AND repositories >= {EXAMPLE_REPOSITORIES} OR repositories >= {WIDELY}) AS live FROM o
), f AS (
  SELECT r, kind, start, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS s, live
  FROM c JOIN j USING (h) WHERE kind < 3 OR (live AND owners <= 1)
), a AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
  FROM f GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN a USING (r)
"""
