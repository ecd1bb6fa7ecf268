"""Modules and their rules: what can be run, how it is explained, and one frame of findings from all of them."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import ai_quality, cicd, clones, deadcode, diffs, findings as fi, fixes, frameworks, health, line_rules, prompt_safety, taint, telemetry
from .operators.graph import kept
from .parse import tables as T
from .schema import ACTIONS, FINDINGS
from .sources import manifests

#: module -> rules as (id, severity, what it finds).
RULES = {
    "dead-code": (
        ("unused-function", "warning", "a function that no entry point reaches"), ("unused-type", "warning", "a type that no entry point reaches"), ("unused-import", "warning", "an import whose names aren't used in its file"),
        ("unused-file", "info", "a file in which every symbol is dead"), ("stale-suppression", "info", "a suppression comment that suppresses nothing"),
    ),
    "complexity": (("high-cyclomatic", "warning", "a function with many branches"), ("high-cognitive", "warning", "a function that is hard to follow"), ("low-health-score", "warning", "a file with a low health score")),
    "duplication": (("duplicate-function", "warning", "a repeated block from the first line of a file"), ("duplicate-block", "warning", "a block that is repeated elsewhere")),
    "security": tuple((r, "error", f"untrusted data reaches {what}") for r, what in (
        ("sql-injection", "a query"), ("command-injection", "a command"), ("xss", "a page"), ("ssrf", "a request"), ("path-traversal", "a file path"), ("unsafe-deserialization", "a deserialiser"),
    )) + (("hardcoded-secret", "error", "a credential in the source"), ("high-entropy-string", "warning", "a string that looks like a key"), ("vulnerable-dependency", "error", "a dependency in a vulnerable range")),
    "ai-quality": (
        ("phantom-api-call", "error", "a call of something that isn't defined anywhere"), ("phantom-security-call", "error", "a security check that isn't defined anywhere"), ("missing-decorator", "warning", "a promised check that isn't applied"),
        ("unfinished-stub", "warning", "a function with a placeholder body"), ("disabled-control", "error", "a security check that is commented out"), ("impossible-dependency-version", "warning", "a version that can't be had"),
        ("inconsistent-error-handling", "info", "mixed ways to handle errors in a file"),
    ),
    "llm-defense": (
        ("unsafe-tool-use", "error", "a tool that runs commands"), ("prompt-injection-exposure", "error", "user input in a prompt"), ("missing-output-validation", "error", "a model's answer that is used unchecked"),
        ("missing-rate-limit", "warning", "model calls without a limit"), ("excessive-tool-permissions", "warning", "a tool that may write where it reads"), ("unguarded-agent-loop", "error", "an agent loop without a bound"),
    ),
    "cicd": tuple((r, s, "a risky setting in CI/CD configuration") for r, s in (
        ("actions-dangerous-trigger", "error"), ("actions-unpinned-action", "warning"), ("actions-excessive-permissions", "warning"), ("actions-script-injection", "error"), ("gitlab-mutable-image", "warning"),
        ("gitlab-unpinned-include", "warning"), ("gitlab-literal-secret", "error"), ("gitlab-insecure-runner", "info"), ("dockerfile-run-as-root", "warning"), ("dockerfile-remote-add", "warning"),
        ("dockerfile-unpinned-base", "warning"), ("dockerfile-secrets-in-layer", "error"), ("compose-privileged", "error"), ("compose-host-network", "warning"), ("compose-host-mount", "error"),
        ("systemd-root-execution", "warning"), ("systemd-missing-hardening", "info"),
    )),
    "arch": (("boundary-violation", "error", "an import between zones that the rules deny"), ("circular-dependency", "warning", "files that import each other in a circle")),
    "hotspot": (("hotspot", "warning", "a complex file that changes often"), ("refactoring-target", "error", "a very complex file that changes often")),
    "audit": (("new-finding", "warning", "a finding that the baseline hasn't"), ("score-regression", "warning", "more findings than the baseline has"), ("threshold-exceeded", "error", "more findings than the gate allows")),
    "impact": (("metric-degraded", "warning", "a metric that got worse since the last snapshot"), ("metric-improved", "info", "a metric that got better since the last snapshot")),
    "autofix": (("fix-available", "info", "a finding that an edit removes"), ("fix-conflict", "warning", "edits that overlap")),
    "telemetry": (("backend-status", "info", "whether a backend takes metrics"), ("metric-summary", "info", "how many points a metric has"), ("finding-churn", "info", "how findings changed"), ("sampling-status", "info", "how runs are sampled")),
    "frameworks": (("framework-entry-point", "info", "a function that a framework calls"), ("framework-detected", "info", "a framework in use")),
}
#: What every module's findings have; :func:`to_schema` gives them the form of :data:`schema.FINDINGS`.
COLUMNS = f"module_id string, rule_id string, message string, severity string, file string, start_line int, end_line int, confidence float, actions {ACTIONS}, metadata map<string, string>"


@dataclass
class Inputs:
    """What modules read: files (path, content, language), and what some need beside them."""

    files: DataFrame
    config: dict[str, dict[str, str]] = field(default_factory=dict)
    #: Commits by file (file, commits).
    commits: DataFrame | None = None
    #: Findings of this run and of the one that it is held against (rule_id, file, start_line, message; actions).
    current: DataFrame | None = None
    baseline: DataFrame | None = None
    #: Snapshots (name, value) before and now, metric points and backends (name, enabled).
    before: DataFrame | None = None
    after: DataFrame | None = None
    points: DataFrame | None = None
    backends: DataFrame | None = None
    _parsed: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    @property
    def parsed(self) -> DataFrame:
        """The files parsed, once for all modules."""
        if self._parsed is None:
            self._parsed = kept(T.parse_files(self.files))
        return self._parsed

    def settings(self, module: str) -> dict[str, str]:
        return self.config.get(module, {})


@dataclass
class Registry:
    """Modules by id; ``Inputs -> findings`` each. One that has nothing to read returns None."""

    modules: dict[str, Callable[[Inputs], DataFrame | None]] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    counters: dict[str, dict[str, int]] = field(default_factory=dict)

    def register(self, module: str, run: Callable[[Inputs], DataFrame | None]) -> None:
        if module in self.modules:
            raise ValueError(f"module {module} is registered already")
        self.modules[module] = run

    def analyse(self, module: str, files: DataFrame | Inputs) -> DataFrame:
        """Findings of a module in the columns that all share, kept; the time it ran and its findings by severity are noted."""
        inputs = files if isinstance(files, Inputs) else Inputs(files)
        began = time.time()
        found = self.modules[module](inputs)
        out = inputs.spark.createDataFrame([], COLUMNS) if found is None else kept(shaped(found, module))
        self.seconds[module] = time.time() - began
        self.counters[module] = {r["severity"]: r["count"] for r in out.groupBy("severity").count().collect()}
        return out

    def analyse_all(self, files: DataFrame | Inputs) -> DataFrame:
        """The union of all modules' findings."""
        inputs = files if isinstance(files, Inputs) else Inputs(files)
        out = inputs.spark.createDataFrame([], COLUMNS)
        for module in self.modules:
            out = out.unionByName(self.analyse(module, inputs))
        return out


def shaped(found: DataFrame, module: str) -> DataFrame:
    """A module's findings in :data:`COLUMNS`: what it leaves out comes from its rules."""
    rules = RULES.get(module, ())
    of = lambda k: F.element_at(F.create_map(*(F.lit(x) for r in rules for x in (r[0], r[k]))), F.col("rule_id")) if rules else F.lit(None).cast("string")
    has = lambda c, other: F.coalesce(F.col(c), other) if c in found.columns else other
    details = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("detail", "name", "sink", "kind", "token", "value") if c in found.columns]
    said = F.concat_ws(": ", F.coalesce(of(2), F.col("rule_id")), F.coalesce(*details) if details else F.lit(None).cast("string"))
    start = F.col("start_line").cast("int")
    return found.select(
        F.lit(module).alias("module_id"), "rule_id", has("message", said).alias("message"), has("severity", F.coalesce(of(1), F.lit("warning"))).alias("severity"), "file", start.alias("start_line"),
        has("end_line", start).cast("int").alias("end_line"), has("confidence", F.lit(1.0)).cast("float").alias("confidence"), has("actions", F.array().cast(ACTIONS)).cast(ACTIONS).alias("actions"),
        has("metadata", F.create_map().cast("map<string, string>")).alias("metadata"),
    )


def to_schema(findings: DataFrame) -> DataFrame:
    """Findings of the registry in the form of :data:`schema.FINDINGS`."""
    zero = F.lit(0)
    place = F.struct("file", "start_line", "end_line", zero.alias("start_column"), zero.alias("end_column"))
    return findings.select("module_id", "rule_id", "message", "severity", place.alias("location"), "confidence", "actions", "metadata")


def encode(findings: DataFrame) -> DataFrame:
    """Findings as JSON, one each: column ``json``."""
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("json"))


def decode(lines: DataFrame, column: str = "json") -> DataFrame:
    """Findings from JSON; a line that isn't one fails the read."""
    return lines.select(F.from_json(column, FINDINGS, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def _complexity(inputs: Inputs) -> DataFrame:
    metrics = T.function_metrics(inputs.parsed.where(F.col("language").isin("go", "python")))
    limits = inputs.settings("complexity")
    return health.complexity_findings(
        metrics, health.file_health(metrics), int(limits.get("max-cyclomatic", 20)), int(limits.get("max-cognitive", 15)), int(limits.get("min-score", 70))
    )


def _duplication(inputs: Inputs) -> DataFrame:
    s = inputs.settings("duplication")
    return clones.duplication(inputs.files, int(s.get("min-tokens", clones.MIN_TOKENS)), s.get("mode", "strict"), int(s.get("max-families", clones.MAX_FAMILIES)))


def _arch(inputs: Inputs) -> DataFrame:
    return fi.architecture(inputs.files.where("language is not null").select("path"), T.imports(inputs.parsed), inputs.settings("arch"))


def _hotspot(inputs: Inputs) -> DataFrame | None:
    s = inputs.settings("hotspot")
    commits = inputs.commits
    if commits is None and any(k == "commit-counts" or k.startswith("commits:") for k in s):
        commits = health.commit_counts(inputs.spark, s)
    if commits is None:
        return None
    metrics = T.function_metrics(inputs.parsed)
    return health.hotspot_findings(health.hotspots(commits, metrics, float(s.get("hotspot-threshold", 20)), float(s.get("refactoring-threshold", 50))))


def _audit(inputs: Inputs) -> DataFrame | None:
    if inputs.current is None:
        return None
    s = inputs.settings("audit")
    base = inputs.current.limit(0) if inputs.baseline is None else inputs.baseline
    path = manifests.safe_relative(s.get("baseline", "baseline.json"))
    return diffs.audit_findings(inputs.current, base, diffs.gate_mode(s.get("gate-mode")), int(s.get("warn-threshold", 1)), int(s.get("fail-threshold", 5)), path)


def _impact(inputs: Inputs) -> DataFrame | None:
    if inputs.before is None or inputs.after is None:
        return None
    moved = diffs.compare_metrics(inputs.before, inputs.after).where("direction <> 'stable'")
    text = F.concat("name", F.lit(": "), F.format_string("%.1f", "baseline"), F.lit(" to "), F.format_string("%.1f", "current"))
    return moved.select(F.concat(F.lit("metric-"), "direction").alias("rule_id"), F.lit("").alias("file"), F.lit(0).alias("start_line"), text.alias("message"))


def _autofix(inputs: Inputs) -> DataFrame | None:
    if inputs.current is None or "actions" not in inputs.current.columns:
        return None
    found = kept(fixes.fixable(inputs.current).withColumn("finding", F.xxhash64("module_id", "rule_id", "file", "start_line", "message")))
    said = fixes.outcomes(found.dropDuplicates(["finding"]), dry_run=True).where("reason <> 'no auto-fix available'")
    rule = F.when(F.col("reason") == "conflicting edits", "fix-conflict").otherwise("fix-available")
    return found.join(said, "finding").select(rule.alias("rule_id"), "file", "start_line", F.concat("rule_id", F.lit(": "), "reason").alias("message"))


def _telemetry(inputs: Inputs) -> DataFrame | None:
    if inputs.points is None:
        return None
    none = inputs.spark.createDataFrame([], "name string, enabled boolean")
    return telemetry.telemetry_findings(inputs.spark, none if inputs.backends is None else inputs.backends, inputs.points, inputs.settings("telemetry").get("audience", "on"))


#: String literals that could be keys.
LITERAL = r"[\"'`]([^\"'`\s]{16,256})[\"'`]"


def _security(inputs: Inputs) -> DataFrame:
    """Taint, secrets and key-like strings outside test paths, and vulnerable dependencies, each with its own severity or the rule's."""
    files = inputs.files
    lines = line_rules.numbered_lines(files)
    at = lambda found, rule: found.select(F.lit(rule).alias("rule_id"), F.col("path").alias("file"), F.col("line_no").alias("start_line"), F.lit(None).cast("string").alias("severity"))
    literals = lines.where(~F.col("path").rlike(line_rules.TEST_PATHS) & line_rules.secret_kind("line").isNull())
    literals = literals.select("path", "line_no", F.explode(F.regexp_extract_all("line", F.lit(LITERAL), 1)).alias("token"))
    out = taint.taint(files).select("rule_id", "file", "start_line", F.lit(None).cast("string").alias("severity"))
    out = out.unionByName(at(line_rules.secrets(lines, "path"), "hardcoded-secret")).unionByName(at(line_rules.high_entropy(literals), "high-entropy-string"))
    vulnerable = manifests.vulnerable_dependencies(manifests.dependencies(files))
    return out.unionByName(vulnerable.select(F.lit("vulnerable-dependency").alias("rule_id"), "file", "start_line", "severity"))


def default_registry() -> Registry:
    out = Registry()
    for module, run in (
        ("dead-code", lambda i: deadcode.dead_code(i.files, parsed=i.parsed)), ("complexity", _complexity), ("duplication", _duplication), ("security", _security), ("arch", _arch),
        ("ai-quality", lambda i: ai_quality.ai_quality(i.files, i.parsed)), ("llm-defense", lambda i: prompt_safety.prompt_safety(i.files, i.parsed)), ("cicd", lambda i: cicd.cicd(i.files)),
        ("frameworks", lambda i: frameworks.framework_findings(frameworks.framework_entries(i.files))), ("hotspot", _hotspot), ("audit", _audit), ("impact", _impact), ("autofix", _autofix),
        ("telemetry", _telemetry),
    ):
        out.register(module, run)
    return out


def rules_table(spark: SparkSession) -> DataFrame:
    rows = [(m, i, r, s, d) for m, rs in RULES.items() for i, (r, s, d) in enumerate(rs)]
    return spark.createDataFrame(rows, "module_id string, ord int, rule_id string, severity string, description string")


def explain(rule: str) -> tuple[str, str, str, str]:
    """(module, rule, severity, description) of ``module:rule``, or of the first module that has a bare rule."""
    module, _, name = rule.rpartition(":")
    for m, rs in RULES.items():
        if not module or m == module:
            for r, s, d in rs:
                if r == name:
                    return m, r, s, d
    raise KeyError(rule)
