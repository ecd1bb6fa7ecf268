"""Readers of line-oriented inputs: dependency manifests, LCOV, unified diffs, workspaces, configuration."""

from __future__ import annotations

import json
import re
import tomllib
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.scalars import version_in_range
from ..operators.line_rules import numbered_lines

#: Known vulnerable ranges (package, from, before, advisory, severity).
VULNERABLE = (
    ("django", "0", "3.2.25", "CVE-2024-27351", "warning"), ("flask", "0", "2.3.2", "CVE-2023-30861", "warning"), ("requests", "0", "2.31.0", "CVE-2023-32681", "warning"),
    ("urllib3", "0", "2.0.7", "CVE-2023-45803", "warning"), ("pyyaml", "0", "6.0.1", "CVE-2024-6156", "error"), ("pillow", "0", "10.2.0", "CVE-2024-28219", "error"),
    ("cryptography", "0", "42.0.0", "CVE-2024-26130", "warning"), ("golang.org/x/net", "0", "0.23.0", "CVE-2024-24790", "error"), ("golang.org/x/crypto", "0", "0.17.0", "CVE-2023-48795", "error"),
    ("google.golang.org/grpc", "0", "1.56.3", "CVE-2023-44487", "error"), ("github.com/gin-gonic/gin", "0", "1.9.1", "CVE-2023-29401", "warning"), ("express", "0", "4.19.2", "CVE-2024-29041", "warning"),
    ("jsonwebtoken", "0", "9.0.0", "CVE-2022-23529", "error"), ("axios", "0", "1.6.0", "CVE-2023-45857", "warning"), ("tokio", "0", "1.24.2", "RUSTSEC-2023-0001", "warning"),
    ("hyper", "0", "0.14.27", "RUSTSEC-2023-0034", "warning"),
)


def dependencies(files: DataFrame) -> DataFrame:
    """file, name, version, line from go.mod, requirements.txt, Cargo.lock and package-lock.json.

    Lock files name a package on one line and its version on a later one: the
    last name before a version, in line order, is its package.
    """
    base = F.element_at(F.split("file", "/"), -1)
    lines = numbered_lines(files.where(F.element_at(F.split("path", "/"), -1).isin("go.mod", "requirements.txt", "Cargo.lock", "package-lock.json"))).withColumnsRenamed({"path": "file", "line_no": "n"})
    get = lambda p, i: F.nullif(F.regexp_extract("line", p, i), F.lit(""))
    last = lambda c: F.last(c, True).over(W.partitionBy("file").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    go, req = r"^\s*(?:require\s+)?([\w.\-]+(?:\.[\w\-]+)?/\S+)\s+v(\S+)", r"^\s*([A-Za-z0-9_.\-]+)(?:\[[^\]]*\])?\s*==\s*([^\s;#,]+)"
    cargo, npm = r'^\s*name\s*=\s*"([^"]+)"', r'^\s*"(?:node_modules/)?([^"]+)"\s*:\s*\{'
    name = F.when(base == "go.mod", get(go, 1)).when(base == "requirements.txt", get(req, 1)).when(base == "Cargo.lock", last(get(cargo, 1))).otherwise(F.regexp_replace(last(get(npm, 1)), "^.*node_modules/", ""))
    version = F.when(base == "go.mod", get(go, 2)).when(base == "requirements.txt", get(req, 2)).when(base == "Cargo.lock", get(r'^\s*version\s*=\s*"([^"]+)"', 1)).otherwise(get(r'^\s*"version"\s*:\s*"([^"]+)"', 1))
    return lines.select("file", name.alias("name"), version.alias("version"), F.col("n").alias("line")).where("name is not null and version is not null and name <> ''")


def vulnerable_dependencies(deps: DataFrame) -> DataFrame:
    """Dependencies in a known vulnerable range; names meet lower-cased with ``-`` for ``_``."""
    vulns = deps.sparkSession.createDataFrame(list(VULNERABLE), "package string, low string, high string, advisory string, severity string")
    norm = F.lower(F.replace(F.col("name"), F.lit("_"), F.lit("-")))
    return deps.join(vulns, (norm == F.col("package")) & version_in_range("version", "low", "high")).select("file", F.col("line").alias("start_line"), "name", "version", "advisory", "severity", F.lit(0.95).cast("float").alias("confidence"))


def lcov(lines: DataFrame) -> DataFrame:
    """path, line, hits from numbered LCOV lines (file, n, line): each DA line belongs to the last SF before it."""
    order = W.partitionBy("file").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    path = F.last(F.when(F.col("line").startswith("SF:"), F.substring("line", 4, 1 << 20)), True).over(order)
    rows = lines.withColumn("path", path).where(F.col("line").rlike(r"^DA:\d+,-?\d+"))
    return rows.select("path", F.regexp_extract("line", r"^DA:(\d+),", 1).cast("int").alias("line"), F.regexp_extract("line", r"^DA:\d+,(-?\d+)", 1).cast("bigint").alias("hits"))


def lcov_problems(lines: DataFrame) -> DataFrame:
    """Blocks (file, path, problem) that break LCOV's rules: repeated lines, counts that don't fit, no path."""
    order = W.partitionBy("file").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    marked = lines.withColumn("block", F.count(F.when(F.col("line").startswith("SF:"), 1)).over(order))
    num = lambda p: F.regexp_extract("line", p, 1).try_cast("bigint")
    b = marked.groupBy("file", "block").agg(
        F.max(F.when(F.col("line").startswith("SF:"), F.substring("line", 4, 1 << 20))).alias("path"), F.max(num(r"^LF:(\d+)")).alias("lf"), F.max(num(r"^LH:(\d+)")).alias("lh"),
        F.count(num(r"^DA:(\d+),")).alias("da"), F.countDistinct(num(r"^DA:(\d+),")).alias("distinct"), F.count(num(r"^LF:(\d+)")).alias("n_lf"), F.count(num(r"^LH:(\d+)")).alias("n_lh"),
    )
    problem = F.when((F.col("block") == 0) & (F.col("da") > 0), "no path").when(F.col("da") > F.col("distinct"), "repeated line").when((F.col("n_lf") > 1) | (F.col("n_lh") > 1), "repeated count")
    problem = problem.when(F.col("lh") > F.col("lf"), "more hit than found").when(F.col("lf") != F.col("da"), "count of lines doesn't fit")
    return b.withColumn("problem", problem).where("problem is not null").select("file", "path", "problem")


def diff_lines(lines: DataFrame) -> DataFrame:
    """path, line on the new side that a unified diff (file, n, line) adds or changes; deleted files give none.

    Positions count from each hunk's start: a running sum over the lines that the new side has.
    """
    order = W.partitionBy("file").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    start = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).try_cast("int")
    d = lines.withColumns({"path": F.last(F.when(F.col("line").rlike(r"^\+\+\+ "), F.regexp_replace(F.regexp_replace("line", r"^\+\+\+ (b/)?", ""), r"\t.*$", "")), True).over(order), "start": F.last(start, True).over(order)})
    d = d.withColumn("hunk", F.last(F.when(start.isNotNull(), F.col("n")), True).over(order)).withColumn("head", F.last(F.when(F.col("line").rlike(r"^(diff |--- |\+\+\+ )"), F.col("n")), True).over(order))
    body = d.where("hunk is not null and n > hunk and (head is null or head < hunk)")
    new = F.when(F.col("line").rlike(r"^[ +]"), 1).when(F.col("line") == "", 1).otherwise(0)
    at = F.col("start") - 1 + F.sum(new).over(W.partitionBy("file", "hunk").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    return body.withColumn("at", at.cast("int")).where(F.col("line").startswith("+") & (F.col("path") != "/dev/null")).select("path", F.col("at").alias("line"))


# -- configuration (driver) --------------------------------------------------


def load_config(text: str | None) -> dict:
    """Settings from TOML; no text means the defaults. What can't be parsed is an error, never a default."""
    defaults = {"project": {"ignore": []}, "health": {"max_cyclomatic": 20, "max_cognitive": 15, "min_score": 70}, "audit": {"gate": "new-only", "warn": 1, "fail": 5}, "duplication": {"min_tokens": 50, "mode": "strict"}, "modules": {}}
    if text is None:
        return defaults
    found = tomllib.loads(text)
    out = {k: {**v, **{a.replace("-", "_"): b for a, b in found.get(k, {}).items()}} if isinstance(v, dict) else v for k, v in defaults.items()}
    if int(out["duplication"]["min_tokens"]) < 1:
        raise ValueError("duplication.min_tokens must be 1 or more")
    return out


def coverage_policy(text: str) -> dict:
    """Thresholds (0 to 100) and trust-boundary patterns from TOML; anything else is an error."""
    found = tomllib.loads(text)
    names = ("overall", "changed", "trust_boundary", "per_file")
    limits = {k.replace("-", "_"): v for k, v in found.get("thresholds", {}).items()}
    for k in limits:
        if not isinstance(limits[k], (int, float)) or not 0 <= limits[k] <= 100:
            raise ValueError(f"threshold {k} must be between 0 and 100")
    groups = found.get("trust-boundary", found.get("trust_boundary", {}))
    if not groups:
        raise ValueError("a policy needs a trust-boundary group")
    return {"thresholds": {k: limits.get(k) for k in names}, "trust_boundary": groups}


def workspaces(files: dict[str, str]) -> list[tuple[str, str]]:
    """(kind, member folder) of a tree, from its manifests by path; globs are expanded over its folders."""
    folders = sorted({"/".join(p.split("/")[:i]) for p in files for i in range(1, p.count("/") + 1)})
    out: list[tuple[str, str]] = []

    def add(kind: str, patterns: list[str]) -> None:
        for p in patterns:
            p = p.strip().removeprefix("./").rstrip("/")
            depth = p.count("/")
            out.extend((kind, f) for f in ([x for x in folders if fnmatch(x, p) and x.count("/") == depth] if "*" in p else [p] if p else []))

    if text := files.get("go.work"):
        block = re.search(r"use\s*\((.*?)\)", text, re.S)
        add("go", [*(x.split("//")[0] for x in (block[1].split("\n") if block else [])), *re.findall(r"^use\s+([^\s(]+)", text, re.M)])
    if text := files.get("Cargo.toml"):
        add("cargo", tomllib.loads(text).get("workspace", {}).get("members", []))
    if text := files.get("package.json"):
        w = json.loads(text).get("workspaces", [])
        add("npm", w.get("packages", []) if isinstance(w, dict) else w)
    if text := files.get("pnpm-workspace.yaml"):
        import yaml

        add("pnpm", (yaml.safe_load(text) or {}).get("packages", []))
    if text := files.get("pyproject.toml"):
        add("python", tomllib.loads(text).get("tool", {}).get("uv", {}).get("workspace", {}).get("members", []))
    for name in ("settings.gradle", "settings.gradle.kts"):
        if text := files.get(name):
            add("gradle", [x.lstrip(":").replace(":", "/") for args in re.findall(r"include\s*\(?([^)\n]*)", text) for x in re.findall(r"[\"']([^\"']+)[\"']", args)])
    return list(dict.fromkeys(out))


def changed_workspaces(members: DataFrame, changed: DataFrame) -> DataFrame:
    """Members (path) that hold a changed file (file); a path is a prefix of text here, so ``api`` holds ``api2/x`` too.

    Prefixes of changed files that could be a member make this an equi-join.
    """
    heads = changed.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("file")), lambda i: F.substring(F.col("file"), F.lit(1), i))).alias("path")).distinct()
    return members.join(heads, "path", "left_semi")


def read_json_findings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Findings from JSON arrays; files that don't parse are left out."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"array<struct<{_struct(schema)}>>")).alias("x")).select("x.*").where(F.col(schema.split()[0]).isNotNull())


def _struct(ddl: str) -> str:
    out = []
    for part in re.split(r"(,\s*)(?![^<]*>)", ddl):
        out.append(part if part.startswith(",") else re.sub(r"^(\w+)\s+", r"\1: ", part))
    return "".join(out)


def safe_relative(path: str) -> str:
    """A state file's path: absolute ones and ones that climb are refused."""
    if path.startswith(("/", "\\")) or re.match(r"[A-Za-z]:", path) or ".." in re.split(r"[/\\]", path):
        raise ValueError(f"not a relative path inside the project: {path}")
    return path
