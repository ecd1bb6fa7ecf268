"""Filters, groupings and projections of the findings table, and architecture rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import glob_regex, severity_rank, strip_suffix_runs
from .graph import kept, strong_components

#: Pairs of an import path and a file that containment may compare.
MOST_COMPARED = 100_000_000


def module_of(rule: str | Column) -> Column:
    """The module of a rule id: what stands before its first colon."""
    return F.substring_index(F.col(rule) if isinstance(rule, str) else rule, ":", 1)


def visible(findings: DataFrame, severities: list[str], hidden_modules: list[str]) -> DataFrame:
    return findings.where(F.col("severity").isin(severities) & ~module_of("rule_id").isin(hidden_modules))


def by_rule(findings: DataFrame, rule: str) -> DataFrame:
    """Findings of one rule, by its bare name or as ``module:rule``."""
    module, _, name = rule.rpartition(":")
    bare = F.element_at(F.split("rule_id", ":"), -1)
    fits = bare == name
    if module:
        own = F.col("module_id") if "module_id" in findings.columns else module_of("rule_id")
        fits = fits & (own == module)
    return findings.where(fits)


def severity_counts(findings: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Errors, warnings and infos by key."""
    by = lambda s: F.count_if(F.col("severity") == s)
    return findings.groupBy(*keys).agg(by("error").alias("errors"), by("warning").alias("warnings"), by("info").alias("infos"))


#: Categories of security findings by rule.
CATEGORIES = {
    "sast": ("sql-injection", "command-injection", "xss", "ssrf", "path-traversal", "unsafe-deserialization"),
    "secret": ("hardcoded-secret", "high-entropy-string"), "dependency": ("vulnerable-dependency",),
}


def security_counters(findings: DataFrame) -> DataFrame:
    """One row: findings of each security category, and all."""
    return findings.agg(*(F.count_if(F.col("rule_id").isin(*rules)).alias(f"{c}_findings") for c, rules in CATEGORIES.items()), F.count("*").alias("total_findings"))


def rule_index(findings: DataFrame, order: str) -> DataFrame:
    """Distinct rules with their number of findings, the first ``order`` they have, and their index by it.

    A row per rule, so that a global order is small.
    """
    per = findings.groupBy("rule_id").agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return per.withColumn("rule_index", (F.dense_rank().over(W.orderBy("first_seen")) - 1).cast("bigint"))


def groupings(findings: DataFrame) -> DataFrame:
    """Counts by file, by rule and by severity in one pass: mode, key, n, errors."""
    sets = findings.groupingSets([["file"], ["rule_id"], ["severity"]], "file", "rule_id", "severity").agg(
        F.grouping_id("file", "rule_id", "severity").alias("g"), F.count("*").alias("n"), F.count_if(F.col("severity") == "error").alias("errors"),
        F.max(severity_rank("severity")).alias("worst"),
    )
    mode = F.when(F.col("g") == 3, "file").when(F.col("g") == 5, "rule").otherwise("severity")
    return sets.select(mode.alias("mode"), F.coalesce("file", "rule_id", "severity").alias("key"), "n", "errors", "worst")


def suppress(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Drop findings with a suppression on their line or the line above, for their rule or all rules.

    A band join over two lines: each suppression is spread to the two lines it covers, which makes it an equi-join.
    """
    spread = suppressions.select(F.col("file").alias("s_file"), F.explode(F.array("line", F.col("line") + 1)).alias("s_line"), "rules")
    on = (F.col("file") == F.col("s_file")) & (F.col("start_line") == F.col("s_line")) & ((F.size("rules") == 0) | F.array_contains("rules", F.col("rule_id")))
    return findings.join(spread, on, "left_anti")


def stale_suppressions(suppressions: DataFrame, findings: DataFrame) -> DataFrame:
    """Suppressions with no finding of any rule on their line or the next."""
    near = findings.select(F.col("file").alias("f_file"), F.explode(F.array("start_line", F.col("start_line") - 1)).alias("f_line")).distinct()
    return suppressions.join(near, (F.col("file") == F.col("f_file")) & (F.col("line") == F.col("f_line")), "left_anti")


# -- architecture ------------------------------------------------------------


def zones_of(paths: DataFrame, zones: list[tuple[str, str]]) -> DataFrame:
    """path, zone: the first zone whose glob matches, null if none. ``zones``: (name, pattern) in order."""
    zone = F.lit(None).cast("string")
    for name, pattern in reversed(zones):
        zone = F.when(F.col("path").rlike(glob_regex(pattern)), F.lit(name)).otherwise(zone)
    return paths.withColumn("zone", zone)


def allowed(from_zone: Column, to_zone: Column, rules: list[tuple[str, str, bool]]) -> Column:
    """The first rule (from, to or ``*``, allow) that fits decides; none: allowed."""
    out = F.lit(True)
    for source, target, allow in reversed(rules):
        out = F.when((from_zone == source) & (F.lit(target == "*") | (to_zone == target)), F.lit(allow)).otherwise(out)
    return out


def boundary_violations(edges: DataFrame, rules: list[tuple[str, str, bool]]) -> DataFrame:
    """Edges (from_zone, to_zone, ...) between different zones that the rules deny."""
    return edges.where((F.col("from_zone") != F.col("to_zone")) & ~allowed(F.col("from_zone"), F.col("to_zone"), rules))


#: Architecture presets. Zones are (name, folders), first match first; rules are (from, to) denied.
PRESETS = {
    "layered": {
        "zones": [
            ("presentation", ("presentation", "api", "handler", "handlers", "controller", "controllers", "cmd", "ui")),
            ("application", ("application", "service", "services", "usecase", "usecases")),
            ("domain", ("domain", "model", "models", "entity", "entities", "core")),
            ("infrastructure", ("infrastructure", "infra", "db", "repository", "repositories", "adapter", "adapters", "external")),
        ],
        "deny": [("domain", "infrastructure"), ("domain", "presentation"), ("domain", "application"), ("application", "presentation"), ("infrastructure", "presentation"), ("presentation", "infrastructure")],
    },
    "hexagonal": {
        "zones": [
            ("core", ("core", "domain", "model", "models")),
            ("ports", ("port", "ports", "interface", "interfaces")),
            ("adapters", ("adapter", "adapters", "infrastructure", "infra", "driven", "driving")),
        ],
        "deny": [("core", "adapters"), ("ports", "adapters")],
    },
    "feature-sliced": {
        "zones": [("app", ("app",)), ("features", ("features", "feature", "modules")), ("shared", ("shared", "common", "lib", "pkg"))],
        "deny": [("shared", "features"), ("shared", "app")],
    },
    "clean": {
        "zones": [
            ("entities", ("entity", "entities", "domain", "model", "models")),
            ("usecases", ("usecase", "usecases", "use_case", "application", "service", "services")),
            ("adapters", ("adapter", "adapters", "controller", "controllers", "presenter", "presenters", "gateway", "gateways")),
            ("frameworks", ("framework", "frameworks", "infrastructure", "infra", "db", "web", "external")),
        ],
        "deny": [("entities", "usecases"), ("entities", "adapters"), ("entities", "frameworks"), ("usecases", "adapters"), ("usecases", "frameworks"), ("adapters", "frameworks")],
    },
}
ALIASES = {"layers": "layered", "hex": "hexagonal", "ports-and-adapters": "hexagonal", "feature_sliced": "feature-sliced", "fsd": "feature-sliced", "clean-architecture": "clean"}


def preset(name: str) -> tuple[list[tuple[str, str]], list[tuple[str, str, bool]]]:
    """(zones, rules) of a preset, for :func:`zones_of` and :func:`allowed`."""
    found = PRESETS[ALIASES.get(name, name)]
    return [(zone, f"{folder}/**") for zone, folders in found["zones"] for folder in folders], [(a, b, False) for a, b in found["deny"]]


def arch_config(config: dict[str, str] | None) -> tuple[list[tuple[str, str]], list[tuple[str, str, bool]]]:
    """(zones, rules) of a module's settings: ``preset``, or ``zone.<name>`` (patterns by comma), ``deny.<from>.<to>`` and ``allow.<from>.<to>``.

    Without a zone, and for a preset that isn't known, the layered preset.
    Zones and rules come in the order of the settings.
    """
    config = config or {}
    if "preset" in config:
        name = config["preset"]
        return preset(name if ALIASES.get(name, name) in PRESETS else "layered")
    zones = [(k[5:], p.strip()) for k, v in config.items() if k.startswith("zone.") for p in v.split(",")]
    rules = [(*x, kind == "allow") for k in config for kind, _, spec in [k.partition(".")] if kind in ("deny", "allow") and len(x := tuple(spec.split(".", 1))) == 2]
    return (zones, rules) if zones else preset("layered")


def architecture(files: DataFrame, imports: DataFrame, config: dict[str, str] | None = None, fixed: bool = True) -> DataFrame:
    """boundary-violation and circular-dependency findings.

    A violation for each import of a file (file, import_path, line) and target
    whose zones differ and may not depend; a cycle for each strongly connected
    component of the files' imports, its members in order.
    """
    zones, rules = arch_config(config)
    edges = kept(import_edges(files, imports, fixed, each=True))
    zoned = zones_of(files.select("path").distinct(), zones).where("zone is not null")
    a = zoned.select(F.col("path").alias("file"), F.col("zone").alias("from_zone"))
    b = zoned.select(F.col("path").alias("target"), F.col("zone").alias("to_zone"))
    bad = boundary_violations(edges.join(a, "file").join(b, "target"), rules)
    text = F.concat(F.lit("zone `"), "from_zone", F.lit("` imports from zone `"), "to_zone", F.lit("` via `"), "import_path", F.lit("` (forbidden by architecture rules)"))
    out = bad.select(
        F.lit("boundary-violation").alias("rule_id"), "file", F.col("line").alias("start_line"), text.alias("message"), F.lit("error").alias("severity"),
        F.create_map(F.lit("from_zone"), "from_zone", F.lit("to_zone"), "to_zone", F.lit("import_path"), "import_path").alias("metadata"),
    )
    cycles = strong_components(edges.select(F.col("file").alias("a"), F.col("target").alias("b")))
    cycles = cycles.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("files")).withColumn("listed", F.array_join("files", " -> "))
    size = F.size("files").cast("string")
    return out.unionByName(cycles.select(
        F.lit("circular-dependency").alias("rule_id"), F.element_at("files", 1).alias("file"), F.lit(1).alias("start_line"),
        F.concat(F.lit("circular dependency detected ("), size, F.lit(" files): "), "listed").alias("message"), F.lit("warning").alias("severity"),
        F.create_map(F.lit("cycle_length"), size, F.lit("cycle_files"), F.col("listed")).alias("metadata"),
    ))


def import_edges(files: DataFrame, imports: DataFrame, fixed: bool = True, each: bool = False) -> DataFrame:
    """Edges file -> target from import paths; with ``each`` one for each import, with its path and line.

    ``files``: path; ``imports``: file, import_path. ``fixed`` resolves an
    import to files whose package folder or dotted module ends with it, by an
    equi-join on path suffixes. Otherwise a target is a file whose path holds
    the import path, or whose path without extension is held by it (a join
    over distinct paths with a contains condition, for parity on small trees).
    """
    columns = ["file", "target", *(["import_path", "line"] if each else [])]
    stem = strip_suffix_runs("path", ".go", ".py", ".ts", ".tsx", ".js", ".jsx", ".java", ".rs")
    if not fixed:
        # every import path is held against every file: for trees that are small enough
        if imports.select("import_path").distinct().count() * files.count() > MOST_COMPARED:
            raise ValueError("the tree is too large to resolve imports by containment; leave fixed on")
        targets = files.select(F.col("path").alias("target"), stem.alias("stem")).distinct()
        paths = imports.select("import_path").distinct()
        pairs = paths.join(targets, F.contains("target", "import_path") | F.contains("import_path", "stem"))
        return imports.join(pairs, "import_path").where("file <> target").select(*columns).distinct()
    parts = F.split(F.regexp_replace("import_path", r"[.:]{1,2}(?=\w)", "/"), "/")
    wanted = imports.select("file", *columns[2:], F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    targets = files.select(F.col("path").alias("target"), F.explode(F.array(folder, stem)).alias("suffix")).where("suffix <> ''").distinct()
    return wanted.join(targets, "suffix").where("file <> target").select(*columns).distinct()


# -- telemetry ---------------------------------------------------------------


def project_for_audience(points: DataFrame, audience: str, operator_names: list[str], user_names: list[str]) -> DataFrame:
    """Metric points that an audience may see.

    ``on`` sees all, ``off`` nothing. ``operator-only`` and ``user-only`` see
    trusted points of their own names; names of modules' own metrics
    (``module.<id>.<key>``) belong to users. A name with any untrusted point is
    seen under ``on`` only.
    """
    if audience == "on":
        return points
    if audience == "off":
        return points.limit(0)
    untrusted = points.where("provenance = 'untrusted'").select("name").distinct()
    own = F.col("name").isin(operator_names) if audience == "operator-only" else F.col("name").isin(user_names) | F.col("name").rlike(r"^module\.[^.]+\..+$")
    return points.where(own).join(untrusted, "name", "left_anti")


def last_values(points: DataFrame, keys: list[str], value: str = "value", seq: str = "seq") -> DataFrame:
    return points.groupBy(*keys).agg(F.max_by(value, seq).alias("last_value"), F.max(seq).alias("last_seq"))


def sampled(rows: DataFrame, id: str, rate: float) -> DataFrame:
    """A sampling decision that every run repeats: all at a rate of 1, none at 0."""
    if rate >= 1:
        return rows
    return rows.where(F.pmod(F.col(id) * 7919 + 104729, F.lit(10000)) < int(rate * 10000)) if rate > 0 else rows.limit(0)


# -- fixes -------------------------------------------------------------------


def edit_conflicts(edits: DataFrame) -> DataFrame:
    """Edits (id, file, start_line, end_line) that overlap another of their file: id.

    A sweep, not a self-join: an edit overlaps an earlier one if it starts by
    the largest end so far, and a later one if the smallest later start is by its end.
    """
    order = W.partitionBy("file").orderBy("start_line", "end_line", "id")
    before = F.max("end_line").over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.lead("start_line").over(order)
    return edits.withColumn("b", before).withColumn("a", after).where("start_line <= b or a <= end_line").select("id", "file")


def without_lines(lines: DataFrame, deletions: DataFrame) -> DataFrame:
    """Lines (file, line_no, line) that no deletion (file, start_line, end_line) covers."""
    gone = deletions.select("file", F.explode(F.sequence("start_line", "end_line")).alias("line_no")).distinct()
    return lines.join(gone, ["file", "line_no"], "left_anti")
