"""Scan targets: repo specs, repo-list files, org listings, and scanner applicability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Hosting base used for owner/repo shorthand specs.
SHORTHAND_BASE = "https://github.com/"
URL_PREFIXES = ["http://", "https://", "git@"]

# Fixed values (must equal the reference): files / globs that make each scanner applicable
# (paths relative to the repo root; globs are root-anchored, ** spans directories).
PIP_FILES = ["requirements.txt", "pyproject.toml", "Pipfile", "setup.py", "setup.cfg"]
TRIVY_FILES = ["Dockerfile", "docker-compose.yml", "docker-compose.yaml", "Containerfile"]
IAC_GLOBS = [
    "*.tf", "*.tfvars", "cloudformation*.yml", "cloudformation*.yaml", "cloudformation*.json", "*.template",
    "k8s/*.yml", "k8s/*.yaml", "kubernetes/*.yml", "kubernetes/*.yaml", "helm/**/templates/*.yaml",
]
LICENSE_FILES = ["requirements.txt", "pyproject.toml", "package.json"]


def glob_to_regex(glob: str) -> str:
    """Root-anchored path glob -> regex: ``*`` stays inside one directory, ``**/`` spans zero or more."""
    out, i = "^", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out += "(.*/)?"
            i += 3
        elif glob[i] == "*":
            out += "[^/]*"
            i += 1
        elif glob[i] == "?":
            out += "[^/]"
            i += 1
        else:
            out += "\\" + glob[i] if glob[i] in ".+()[]{}^$|\\" else glob[i]
            i += 1
    return out + "$"


DOCKERFILE_RX = r"^Dockerfile[^/]*$"


def applicability_rules() -> dict[str, F.Column]:
    """Per-scanner predicate over one ``path`` row; aggregated with bool_or per repo."""
    p = F.col("path")
    iac = F.lit(False)
    for g in IAC_GLOBS:
        iac = iac | p.rlike(glob_to_regex(g))
    return {
        "gitleaks": (p == ".git") | p.startswith(".git/"),
        "semgrep": F.lit(True),
        "pip-audit": p.isin(*PIP_FILES),
        "npm-audit": p == "package.json",
        "trivy": p.isin(*TRIVY_FILES) | p.rlike(DOCKERFILE_RX),
        "checkov": iac,
        "hadolint": p.rlike(DOCKERFILE_RX),
        "licenses": p.isin(*LICENSE_FILES),
    }


def applicable_scanners(repo_files: DataFrame) -> DataFrame:
    """(repo, scanner) for every scanner applicable to a repo, from a (repo, path) listing.

    One partial aggregation per repo (bool_or is combined map-side), then unpivot.
    """
    rules = applicability_rules()
    g = repo_files.groupBy("repo").agg(*[F.bool_or(c).alias(n) for n, c in rules.items()])
    stacked = g.select(
        "repo",
        F.explode(F.array(*[F.struct(F.lit(n).alias("scanner"), F.col(f"`{n}`").alias("on")) for n in rules])).alias("s"),
    )
    return stacked.filter(F.col("s.on")).select("repo", F.col("s.scanner").alias("scanner"))


def _strip_suffix(c: F.Column, suffix: str) -> F.Column:
    return F.when(c.endswith(suffix), F.substring(c, F.lit(1), F.length(c) - len(suffix))).otherwise(c)


def parse_targets(specs: DataFrame, col: str = "spec") -> DataFrame:
    """Repo specs -> (spec, kind, name, url, path, owner, repo_name).

    kind: ``url`` (http(s):// or git@), ``local`` (starts with / or .), else
    ``shorthand`` owner/repo when it has a slash, else ``local``. URLs lose one
    trailing slash run and a ``.git`` suffix (the suffix, not a character set);
    ``git@host:owner/repo`` is read like ``host/owner/repo``.
    """
    s = F.col(col)
    is_url = F.lit(False)
    for pfx in URL_PREFIXES:
        is_url = is_url | s.startswith(pfx)
    is_local = s.startswith("/") | s.startswith(".")
    kind = F.when(is_url, "url").when(is_local, "local").when(F.instr(s, "/") > 0, "shorthand").otherwise("local")
    url = F.when(kind == "url", s).when(kind == "shorthand", F.concat(F.lit(SHORTHAND_BASE), s))
    u = F.regexp_replace(url, r"/+$", "")
    u = _strip_suffix(u, ".git")
    u = F.when(u.startswith("git@"), F.regexp_replace(u, r"^git@([^:/]+):", "git@$1/")).otherwise(u)
    parts = F.split(u, "/")
    n = F.size(parts)
    owner = F.when(n >= 2, F.element_at(parts, -2)).otherwise(F.lit(""))
    repo_name = F.element_at(parts, -1)
    local_name = F.element_at(F.split(F.regexp_replace(s, r"/+$", ""), "/"), -1)
    out = specs.select(F.col(col).alias("spec"), kind.alias("kind"), url.alias("url"), owner.alias("_o"), repo_name.alias("_r"), local_name.alias("_l"))
    is_remote = F.col("kind") != "local"
    return out.select(
        "spec",
        "kind",
        F.when(is_remote, F.when(F.col("_o") != "", F.concat_ws("/", "_o", "_r")).otherwise(F.col("_r")))
        .otherwise(F.col("_l"))
        .alias("name"),
        "url",
        F.when(~is_remote, F.col("spec")).alias("path"),
        F.when(is_remote, F.col("_o")).otherwise(F.lit("")).alias("owner"),
        F.when(is_remote, F.col("_r")).otherwise(F.lit("")).alias("repo_name"),
    )


def read_repo_list(spark: SparkSession, path: str) -> DataFrame:
    """Repo-list file: one spec per line; blank lines and lines starting with '#' dropped; trimmed."""
    t = spark.read.text(path)
    v = F.col("value")
    return t.filter(~v.startswith("#") & (F.trim(v) != "")).select(F.trim(v).alias("spec"))


def filter_repos(listing: DataFrame, exclude: DataFrame | None = None, include_forks: bool = False, org: str = "") -> DataFrame:
    """Org listing (full_name, name, clone_url, fork, archived) -> targets.

    Forks dropped unless ``include_forks``; archived dropped; a repo is excluded
    when the exclude list holds its full name or its short name (two anti joins).
    """
    df = listing
    if not include_forks:
        df = df.filter(~F.coalesce(F.col("fork"), F.lit(False)))
    df = df.filter(~F.coalesce(F.col("archived"), F.lit(False)))
    if exclude is not None:
        ex = exclude.select(F.col("name").alias("_x")).distinct()
        df = df.join(ex, F.coalesce(df["full_name"], F.lit("")) == ex["_x"], "left_anti")
        df = df.join(ex, df["name"] == ex["_x"], "left_anti")
    return df.select(
        F.coalesce(F.col("full_name"), F.lit("")).alias("name"),
        F.coalesce(F.col("clone_url"), F.lit("")).alias("url"),
        F.lit(org).alias("owner"),
        F.coalesce(F.col("name"), F.lit("")).alias("repo_name"),
    )


def read_org_listing(spark: SparkSession, path: str) -> DataFrame:
    """Exported org listing pages (JSON arrays or JSON Lines) with an explicit schema."""
    schema = "full_name string, name string, clone_url string, fork boolean, archived boolean"
    return spark.read.schema(schema).option("multiLine", True).json(path)
