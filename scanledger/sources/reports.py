"""Scanner report ingestion: raw JSON payloads -> one normalised findings table.

Input ``raw_reports``: one row per report file
(repo, run_id, run_date, scanner, source_path, report_seq, payload).
One pass serves all tools: a payload is parsed once by its scanner's rule into
items that keep their JSON whole (VARIANT), one explode makes a row of each item,
and the scanner's mapping fills the findings columns; ``raw`` is the item as JSON
(keys in code-point order). A number written as text or as 12.0 is a line number too.
A report that cannot be parsed, or has something else where the tool writes an array
or an object, yields no findings and ``ok = false`` in the scan-status table; it
never fails the job. So does an object that repeats a key inside an item.

``ingest_seq`` = report_seq * 2^24 + item position: arrival order inside a run
(one report's item count is bounded well below 2^24 by Spark's 2 GB row limit).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanledger.functions.fingerprint import fingerprint
from scanledger.functions.severity import severity_parse
from scanledger.operators.detect import DENIED_LICENSES, LICENSE_RECOMMENDATION, first_denied

RAW_COLUMNS = ["repo", "run_id", "run_date", "scanner", "source_path", "report_seq", "payload"]
FINDINGS_COLUMNS = [
    "repo", "run_id", "run_date", "ingest_seq", "scanner", "severity", "title", "description",
    "file_path", "line", "recommendation", "rule_id", "fingerprint", "raw",
]
STATUS_COLUMNS = ["repo", "run_id", "run_date", "scanner", "source_path", "report_seq", "ok", "error", "n_items"]
POS_BITS = 24

S = T.StringType()
V = T.VariantType()  # keeps the JSON type of fields whose meaning depends on it
#: The items of a report: key and at (map key; package and version; target) and the JSON value.
ITEM = "array<struct<key:string,at:string,a:variant>>"

# Fixed values (must equal the reference): default texts of each tool mapping.
GITLEAKS_RECOMMENDATION = "Rotate this credential and remove from git history"
SEMGREP_DEFAULT_FIX = "Review and fix the flagged pattern"
CHECKOV_DEFAULT_GUIDELINE = "Review IaC configuration"
HADOLINT_WIKI = "https://github.com/hadolint/hadolint/wiki/"
HADOLINT_LEVELS = {"error": "HIGH", "warning": "MEDIUM", "info": "LOW", "style": "INFO"}
NO_FIX = "No fix available yet"
NPM_FIX = "Run `npm audit fix`"
NPM_MANUAL = "Manual review required"


def json_truthy(v: F.Column) -> F.Column:
    """Truthiness of a JSON value as the producing tool's language sees it.

    Falsy: absent, null, false, 0, "", {} and []. Anything else -- including the
    string "false" -- is truthy. The value is a VARIANT, so its JSON type is known.
    """
    t = F.schema_of_variant(v)
    as_text = F.to_json(v)
    return (
        F.when(v.isNull() | (t == "VOID"), F.lit(False))
        .when(t == "BOOLEAN", F.variant_get(v, "$", "boolean"))
        .when(t == "STRING", F.length(F.variant_get(v, "$", "string")) > 0)
        .when(t.startswith("OBJECT"), as_text != "{}")
        .when(t.startswith("ARRAY"), as_text != "[]")
        .otherwise(F.variant_get(v, "$", "double") != 0)
    )


def json_string(v: F.Column) -> F.Column:
    """The value when it is a JSON string, else null (numbers, booleans, objects are not strings)."""
    return F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string"))


# --------------------------------------------------------------------------- tools
#
# Each tool has two parts. ``*_items`` turns a payload into an array of ITEM (key, at, a), null when the report is
# malformed; ``a`` is a JSON value kept whole as VARIANT. ``*_fields`` maps one item (``it``) to the finding columns
# that the tool has. ``normalize`` picks both by the scanner column, so all tools share one scan and one explode.


def _let(value: F.Column, f) -> F.Column:
    """``f(value)`` with the value evaluated once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def _text(it: F.Column, path: str) -> F.Column:
    return F.try_variant_get(it["a"], path, "string")


def _int(it: F.Column, path: str) -> F.Column:
    return F.try_variant_get(it["a"], path, "int")


def _texts(it: F.Column, path: str) -> F.Column:
    return F.try_variant_get(it["a"], path, "array<string>")


def _any(it: F.Column, path: str) -> F.Column:
    return F.try_variant_get(it["a"], path, "variant")


def _rule(it: F.Column) -> F.Column:
    return F.coalesce(*[_text(it, f"$.{k}") for k in ("RuleID", "check_id", "vuln_id", "id")])


def _is_object(v: F.Column) -> F.Column:
    return F.coalesce(F.to_json(v).startswith("{"), F.lit(False))


def _item(a: F.Column, key=None, at=None) -> F.Column:
    none = F.lit(None).cast(S)
    return F.struct((none if key is None else key).alias("key"), (none if at is None else at).alias("at"), a.alias("a"))


def _items(values: F.Column) -> F.Column:
    """Items of an array of JSON values; null unless every value is an object."""
    return _let(values, lambda vs: F.when(F.forall(vs, _is_object), F.transform(vs, lambda v: _item(v))))


def _array(col: str) -> F.Column:
    """A JSON array; null for anything else (``from_json`` would take a lone object as an array of one)."""
    return F.when(F.col(col).rlike(r"^\s*\["), F.from_json(col, T.ArrayType(V)))


def _doc_field(name: str, t: T.DataType) -> F.Column:
    """The field of a JSON object, or an empty one when it is absent; null when the payload does not parse."""
    schema = T.StructType([T.StructField(name, t), T.StructField("_corrupt", S)])
    doc = F.from_json("payload", schema, {"columnNameOfCorruptRecord": "_corrupt"})
    empty = F.array().cast(t) if isinstance(t, T.ArrayType) else F.create_map().cast(t)
    return _let(doc, lambda d: F.when(d.isNotNull() & d["_corrupt"].isNull(), F.coalesce(d[name], empty)))


def _list_in(v: F.Column, path: str) -> F.Column:
    """The array at ``path``; empty when absent or JSON null, null when it is something else."""
    there = F.try_variant_get(v, path, "variant")
    empty = F.array().cast(T.ArrayType(V))
    return _let(there, lambda x: F.when(x.isNull() | F.is_variant_null(x), empty).otherwise(
        F.try_variant_get(x, "$", T.ArrayType(V).simpleString())
    ))


def _pairs(values: F.Column, path: str, item) -> F.Column:
    """``item(outer, inner)`` for every value of the array at ``path`` of every value, in report order.

    Null when a value is no object or its ``path`` is no array (a malformed report).
    """
    inner = F.transform(values, lambda d: F.when(_is_object(d), F.transform(_list_in(d, path), lambda v: item(d, v))))
    return F.flatten(inner)


def _last_by_key(m: F.Column) -> F.Column:
    """Items of a JSON map in key order; of a key that occurs more than once the last value counts."""
    at = F.transform(F.map_entries(m), lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("a")))
    before = lambda x, y: (x["key"] < y["key"]) | ((x["key"] == y["key"]) & (x["i"] < y["i"]))
    ordered = F.array_sort(at, lambda x, y: F.when(before(x, y), -1).when(before(y, x), 1).otherwise(0))
    last = _let(ordered, lambda s: F.filter(s, lambda e, i: F.coalesce(F.get(s, i + 1)["key"] != e["key"], F.lit(True))))
    return _let(last, lambda entries: F.when(
        F.forall(entries, lambda e: _is_object(e["a"])), F.transform(entries, lambda e: _item(e["a"], e["key"]))
    ))


def gitleaks_items() -> F.Column:
    """Top-level array (JSON null = no findings)."""
    return F.when(F.trim(F.col("payload")) == "null", F.array().cast(ITEM)).otherwise(_items(_array("payload")))


def gitleaks_fields(it: F.Column) -> dict:
    """Always CRITICAL; title carries the rule id."""
    return dict(
        severity=F.lit("CRITICAL"),
        title=F.concat(F.lit("Secret detected: "), F.coalesce(_text(it, "$.RuleID"), F.lit("unknown"))),
        description=_text(it, "$.Description"), file_path=_text(it, "$.File"), line=_int(it, "$.StartLine"),
        recommendation=F.lit(GITLEAKS_RECOMMENDATION), rule_id=_rule(it),
    )


def semgrep_items() -> F.Column:
    """``results[]``."""
    return _items(_doc_field("results", T.ArrayType(V)))


def semgrep_fields(it: F.Column) -> dict:
    """Severity from extra.severity (default WARNING), parsed (ERROR/WARNING -> LOW)."""
    return dict(
        severity=_let(F.coalesce(_text(it, "$.extra.severity"), F.lit("WARNING")), severity_parse),
        title=F.coalesce(_text(it, "$.check_id"), F.lit("unknown")),
        description=_text(it, "$.extra.message"), file_path=_text(it, "$.path"), line=_int(it, "$.start.line"),
        recommendation=F.coalesce(_text(it, "$.extra.fix"), F.lit(SEMGREP_DEFAULT_FIX)), rule_id=_rule(it),
    )


def pip_audit_items() -> F.Column:
    """``dependencies[] x vulns[]``; a vulnerable dependency without name or version, or a vulnerability
    without id, makes the whole report fail, as a missing key does in the tool."""
    get = lambda d, path: F.try_variant_get(d, path, "string")
    pairs = _pairs(
        _doc_field("dependencies", T.ArrayType(V)), "$.vulns", lambda d, v: _item(v, get(d, "$.name"), get(d, "$.version"))
    )
    named = lambda p: p["key"].isNotNull() & p["at"].isNotNull() & get(p["a"], "$.id").isNotNull()
    return _let(pairs, lambda ps: F.when(F.forall(ps, named), ps))


def pip_audit_fields(it: F.Column) -> dict:
    fixes = F.coalesce(_texts(it, "$.fix_versions"), F.array().cast(T.ArrayType(S)))
    name, version, vuln = it["key"], it["at"], _text(it, "$.id")
    return dict(
        severity=F.lit("HIGH"), title=F.format_string("%s %s: %s", name, version, vuln),
        description=_text(it, "$.description"),
        recommendation=F.when(F.size(fixes) > 0, F.concat(F.lit("Upgrade to "), F.array_join(fixes, ", "))).otherwise(
            F.lit(NO_FIX)
        ),
        rule_id=vuln,
        raw=F.to_json(F.struct(
            name.alias("package"), version.alias("installed_version"), vuln.alias("vuln_id"), fixes.alias("fix_versions"),
        )),
    )


def npm_audit_items() -> F.Column:
    """``vulnerabilities`` map name -> info. Map order is not kept, so items are numbered by name."""
    return _last_by_key(_doc_field("vulnerabilities", T.MapType(S, V)))


def npm_audit_fields(it: F.Column) -> dict:
    name, title, fix = it["key"], _text(it, "$.title"), _let(_any(it, "$.fixAvailable"), json_truthy)
    via = F.coalesce(_texts(it, "$.via"), F.array().cast(T.ArrayType(S)))
    return dict(
        severity=_let(F.upper(F.coalesce(_text(it, "$.severity"), F.lit("unknown"))), severity_parse),
        title=F.concat(name, F.lit(": "), F.coalesce(title, F.lit("vulnerability"))),
        description=title, recommendation=F.when(fix, F.lit(NPM_FIX)).otherwise(F.lit(NPM_MANUAL)),
        raw=F.to_json(F.struct(name.alias("package"), via.alias("via"), fix.alias("fix_available"))),
    )


def trivy_items() -> F.Column:
    """``Results[] x Vulnerabilities[]``; a null Vulnerabilities list yields no rows."""
    target = lambda r: F.coalesce(F.try_variant_get(r, "$.Target", "string"), F.lit(""))
    return _pairs(_doc_field("Results", T.ArrayType(V)), "$.Vulnerabilities", lambda r, v: _item(v, target(r)))


def trivy_fields(it: F.Column) -> dict:
    vuln, package = _text(it, "$.VulnerabilityID"), _text(it, "$.PkgName")
    fixed = F.coalesce(_text(it, "$.FixedVersion"), F.lit(""))
    return dict(
        severity=_let(F.upper(F.coalesce(_text(it, "$.Severity"), F.lit("UNKNOWN"))), severity_parse),
        title=F.concat(F.coalesce(package, F.lit("unknown")), F.lit(": "), F.coalesce(vuln, F.lit(""))),
        description=_text(it, "$.Title"), file_path=it["key"],
        recommendation=F.when(fixed != "", F.concat(F.lit("Upgrade to "), fixed)).otherwise(F.lit(NO_FIX)),
        rule_id=vuln,
        raw=F.to_json(F.struct(
            vuln.alias("vuln_id"), package.alias("package"), _text(it, "$.InstalledVersion").alias("installed_version"),
            fixed.alias("fixed_version"), F.coalesce(_text(it, "$.DataSource.Name"), F.lit("")).alias("data_source"),
        )),
    )


def checkov_items() -> F.Column:
    """An object or an array of objects; ``results.failed_checks[]`` of each."""
    checks = T.StructType([T.StructField("failed_checks", T.ArrayType(V))])
    docs = F.from_json("payload", T.ArrayType(T.StructType([T.StructField("results", checks)])))
    return _items(F.flatten(F.transform(
        docs, lambda d: F.coalesce(d["results"]["failed_checks"], F.array().cast(T.ArrayType(V)))
    )))


def checkov_fields(it: F.Column) -> dict:
    """Only a JSON string severity is upper-cased and parsed (unknown -> LOW); absent, null or other -> MEDIUM.
    Line = first of file_line_range."""
    sev, name = _let(_any(it, "$.severity"), json_string), _text(it, "$.check_name")
    return dict(
        severity=_let(F.upper(sev), lambda x: F.when(x.isNull(), F.lit("MEDIUM")).otherwise(severity_parse(x))),
        title=F.concat(F.coalesce(_text(it, "$.check_id"), F.lit("")), F.lit(": "), F.coalesce(name, F.lit("unknown"))),
        description=name, file_path=_text(it, "$.file_path"), line=_int(it, "$.file_line_range[0]"),
        recommendation=F.coalesce(_text(it, "$.guideline"), F.lit(CHECKOV_DEFAULT_GUIDELINE)), rule_id=_rule(it),
    )


def hadolint_items() -> F.Column:
    """One array per Dockerfile."""
    return _items(_array("payload"))


def hadolint_fields(it: F.Column) -> dict:
    """The file path is the report's source_path (not in the JSON)."""

    def parsed(level: F.Column) -> F.Column:
        sev = F.lit("MEDIUM")
        for k, v in reversed(list(HADOLINT_LEVELS.items())):
            sev = F.when(level == k, F.lit(v)).otherwise(sev)
        return sev

    code, message = _text(it, "$.code"), _text(it, "$.message")
    return dict(
        severity=_let(F.coalesce(_text(it, "$.level"), F.lit("warning")), parsed),
        title=F.concat(F.coalesce(code, F.lit("unknown")), F.lit(": "), F.coalesce(message, F.lit(""))),
        description=message, file_path=F.col("source_path"), line=_int(it, "$.line"),
        recommendation=F.concat(F.lit(HADOLINT_WIKI), F.coalesce(code, F.lit(""))), rule_id=_rule(it),
    )


def license_items() -> F.Column:
    """A Python package list (array) or a Node map "pkg@ver" -> {licenses}."""
    node = F.when(F.col("payload").rlike(r"^\s*\{"), _last_by_key(F.from_json("payload", T.MapType(S, V))))
    return F.when(F.col("payload").rlike(r"^\s*\["), _items(_array("payload"))).otherwise(node)


def license_text(it: F.Column) -> F.Column:
    """A Node license list is joined with ", "."""
    node = F.coalesce(
        F.array_join(_texts(it, "$.licenses"), ", "), _text(it, "$.licenses")
    )
    text = F.when(it["key"].isNull(), _text(it, "$.License")).otherwise(node)
    return F.coalesce(text, F.lit("UNKNOWN"))


def license_fields(it: F.Column) -> dict:
    """Flagged packages are HIGH, one finding per package."""
    key, lic, missing = it["key"], license_text(it), F.lit("None")
    name, version = _text(it, "$.Name"), _text(it, "$.Version")
    return dict(
        severity=F.lit("HIGH"),
        title=F.format_string("Restricted license: %s (%s)", F.coalesce(key, name, F.lit("unknown")), lic),
        description=F.when(
            key.isNull(),
            F.format_string("Package %s v%s uses %s", F.coalesce(name, missing), F.coalesce(version, missing), lic),
        ).otherwise(F.format_string("Package %s uses %s", key, lic)),
        recommendation=F.lit(LICENSE_RECOMMENDATION), rule_id=_rule(it),
    )


NORMALIZERS: dict[str, tuple[Callable[[], F.Column], Callable[[F.Column], dict]]] = {
    "gitleaks": (gitleaks_items, gitleaks_fields),
    "semgrep": (semgrep_items, semgrep_fields),
    "pip-audit": (pip_audit_items, pip_audit_fields),
    "npm-audit": (npm_audit_items, npm_audit_fields),
    "trivy": (trivy_items, trivy_fields),
    "checkov": (checkov_items, checkov_fields),
    "hadolint": (hadolint_items, hadolint_fields),
    "licenses": (license_items, license_fields),
}


def _by_scanner(values: dict[str, F.Column]) -> F.Column:
    """The value of the row's scanner."""
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(F.col("scanner") == name, value).otherwise(out)
    return out


def _of(raw: DataFrame, scanner: str) -> DataFrame:
    return raw.filter(F.col("scanner") == scanner)


def normalize(
    raw_reports: DataFrame, scanners: list[str] | None = None, denied: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """All reports -> (findings, scan_status), each from one scan of the reports.

    ``scanners`` limits the tools (unknown names raise). A license finding needs a denied id
    (``denied``) that is a case-insensitive substring of the package's license text.
    """
    names = list(NORMALIZERS) if not scanners else scanners
    unknown = [n for n in names if n not in NORMALIZERS]
    if unknown:
        raise ValueError(f"unknown scanner(s): {', '.join(unknown)}")
    raw = raw_reports.select(*RAW_COLUMNS).filter(F.col("scanner").isin(*names))
    about = [c for c in RAW_COLUMNS if c != "payload"]
    items = {n: NORMALIZERS[n][0]() for n in names}

    parsed = raw.select(*about, F.size(_by_scanner(items)).alias("_n"))
    ok = F.coalesce(F.col("_n") >= 0, F.lit(False))  # the size of null is null or -1
    status = parsed.select(
        *about, ok.alias("ok"), F.when(~ok, F.lit("unparsable or malformed report")).alias("error"),
        F.when(ok, F.col("_n")).otherwise(F.lit(0)).cast("bigint").alias("n_items"),
    )

    def finding(name: str, it: F.Column) -> F.Column:
        f = NORMALIZERS[name][1](it)
        deny = DENIED_LICENSES if denied is None else denied
        denied_by = _let(license_text(it), lambda text: first_denied(text, deny))
        return F.struct(
            (denied_by.isNotNull() if name == "licenses" else F.lit(True)).alias("found"),
            f["severity"].alias("severity"),
            f["title"].alias("title"),
            F.coalesce(f["description"], F.lit("")).alias("description"),
            f.get("file_path", F.lit(None)).cast("string").alias("file_path"),
            f.get("line", F.lit(None)).cast("int").alias("line"),
            f["recommendation"].alias("recommendation"),
            f.get("rule_id", F.lit(None)).cast("string").alias("rule_id"),
            f.get("raw", F.to_json(it["a"])).alias("raw"),
        )

    def _made(values: F.Column, name: str) -> F.Column:
        return F.transform(values, lambda it: finding(name, it))

    # findings are made inside the array: only the branch of the row's scanner is evaluated, once for each item
    made = _by_scanner({n: _made(items[n], n) for n in names})
    rows = raw.select(*about, F.posexplode(made).alias("pos", "f")).filter("f.found").select(
        "repo", "run_id", "run_date",
        (F.col("report_seq") * F.lit(1 << POS_BITS) + F.col("pos")).alias("ingest_seq"),
        "scanner", "f.*",
    )
    fp = fingerprint("scanner", "title", "file_path", "line", "rule_id").alias("fingerprint")
    return rows.select(*[fp if c == "fingerprint" else F.col(c) for c in FINDINGS_COLUMNS]), status


def run_status(scan_status: DataFrame) -> DataFrame:
    """Per (repo, run, scanner): ok only if every report parsed; finding counts summed."""
    return scan_status.groupBy("repo", "run_id", "run_date", "scanner").agg(
        F.bool_and("ok").alias("ok"),
        F.first(F.col("error"), ignorenulls=True).alias("error"),
        F.sum("n_items").cast("bigint").alias("n_items"),
    )


def read_reports(spark, path: str, repo: str, run_id: str, run_date, scanner: str, report_seq: int = 0) -> DataFrame:
    """One report file (or directory of files) as raw_reports rows: whole file = one payload."""
    df = spark.read.text(path, wholetext=True)  # whole file = one report
    return df.select(
        F.lit(repo).alias("repo"), F.lit(run_id).alias("run_id"), F.lit(run_date).cast("date").alias("run_date"),
        F.lit(scanner).alias("scanner"), F.input_file_name().alias("source_path"),
        F.lit(report_seq).cast("bigint").alias("report_seq"), F.col("value").alias("payload"),
    )


# --------------------------------------------------------------------------- legacy record shapes (S10)

LEGACY_COLUMNS = [
    "repo", "run_id", "run_date", "report_seq", "pos", "scanner", "severity", "package", "vuln_id", "description", "record",
]


LEGACY_TOOLS = ["gitleaks", "semgrep", "pip-audit", "npm-audit"]


def legacy_records(raw_reports: DataFrame) -> DataFrame:
    """The single-file agent's record dicts for its four tools (an alternate output shape), from one scan of the reports.

    Severities are kept as the tools wrote them (semgrep ERROR/WARNING, npm
    upper-cased with UNKNOWN default) -- only the page select maps them later.
    Any parse or key error empties that report, as the agent's catch-all does.
    ``record`` is the tool's item as it is (pip-audit: the agent's own four fields).
    """
    base = [c for c in RAW_COLUMNS if c not in ("payload", "scanner", "source_path")]
    items = _by_scanner({n: NORMALIZERS[n][0]() for n in LEGACY_TOOLS})
    rows = raw_reports.filter(F.col("scanner").isin(*LEGACY_TOOLS)).select(*base, F.col("scanner").alias("tool"), F.posexplode(items).alias("pos", "it"))
    it, tool = F.col("it"), F.col("tool")

    def of(values: dict[str, F.Column]) -> F.Column:
        out = F.lit(None).cast("string")
        for name, value in values.items():
            out = F.when(tool == name, value).otherwise(out)
        return out

    severity = _text(it, "$.severity")
    return rows.select(
        *base, "pos",
        F.when(tool.isin("gitleaks", "semgrep"), F.coalesce(_text(it, "$.scanner"), tool)).otherwise(tool).alias("scanner"),
        of({
            "gitleaks": F.coalesce(severity, F.lit("CRITICAL")),
            "semgrep": F.coalesce(severity, _text(it, "$.extra.severity"), F.lit("WARNING")),
            "pip-audit": F.lit("HIGH"),
            "npm-audit": F.upper(F.coalesce(severity, F.lit("UNKNOWN"))),
        }).alias("severity"),
        of({"pip-audit": it["key"], "npm-audit": it["key"]}).alias("package"),
        of({"pip-audit": _text(it, "$.id")}).alias("vuln_id"),
        of({
            "gitleaks": _text(it, "$.Description"),
            "semgrep": _text(it, "$.extra.message"),
            "pip-audit": F.coalesce(_text(it, "$.description"), F.lit("")),
            "npm-audit": F.coalesce(_text(it, "$.title"), F.lit("")),
        }).alias("description"),
        F.when(tool == "pip-audit", pip_audit_fields(it)["raw"]).otherwise(F.to_json(it["a"])).alias("record"),
    ).select(*LEGACY_COLUMNS)


def stage_reports(raw_reports: DataFrame, path: str) -> None:
    """Store raw reports partitioned by scanner and run date, so each normaliser reads only its partition."""
    raw_reports.select(*RAW_COLUMNS).write.mode("append").partitionBy("scanner", "run_date").parquet(path)
