"""Snapshots of a run in long format, and gates on coverage of what must not break."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import glob_regex
from .diffs import compare_metrics


def snapshot(findings: DataFrame, label: str, files_analysed: int, health_score: float | None = None, counters: dict[str, float] | None = None) -> DataFrame:
    """snapshot, name, value: counts by rule, the total, files, health and counters, as rows that snapshots join on."""
    rules = findings.groupBy("rule_id").count().select(F.concat(F.lit("rule:"), "rule_id").alias("name"), F.col("count").cast("double").alias("value"))
    total = findings.agg(F.count("*").cast("double").alias("value")).select(F.lit("total_findings").alias("name"), "value")
    fixed = [("files_analyzed", float(files_analysed)), *((k, float(v)) for k, v in (counters or {}).items())] + ([("health_score", float(health_score))] if health_score is not None else [])
    more = findings.sparkSession.createDataFrame(fixed, "name string, value double")
    return rules.unionByName(total).unionByName(more).select(F.lit(label).alias("snapshot"), "name", "value")


def trust_boundary(files: DataFrame, patterns: list[tuple[str, str]]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(path, grp) of files that a group's pattern fits, and the patterns that fit nothing, which a policy must not have."""
    if not patterns:
        return files.select("path", F.lit("").alias("grp")).limit(0), []
    # all patterns in one pass
    fits = F.array(*(F.when(F.col("path").rlike(glob_regex(p)), F.struct(F.lit(g).alias("grp"), F.lit(k).alias("k"))) for k, (g, p) in enumerate(patterns)))
    held = files.select("path", F.explode(F.array_compact(fits)).alias("x"))
    used = {r["k"] for r in held.select("x.k").distinct().collect()}  # a number for each pattern at most
    return held.select("path", "x.grp").distinct(), [x for k, x in enumerate(patterns) if k not in used]


def eligible(lcov: DataFrame, tracked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """LCOV lines of tracked files (path), and the paths that aren't tracked."""
    return lcov.join(tracked.select("path").distinct(), "path", "left_semi"), lcov.select("path").distinct().join(tracked.select("path"), "path", "left_anti")


def trend(before: DataFrame, after: DataFrame, higher_better: tuple[str, ...] = ("health_score",)) -> DataFrame:
    """Two snapshots (name, value) as a table: metric, baseline, current, delta with its sign, direction."""
    out = compare_metrics(before, after, higher_better)
    return out.select(F.col("name").alias("metric"), "baseline", "current", F.format_string("%+.1f", "delta").alias("delta"), "direction")


def boundary_gate(per_path: DataFrame, members: DataFrame, least: float = 100.0) -> DataFrame:
    """Per group: covered and instrumented changed lines, and whether every file reaches the limit."""
    both = members.join(per_path, "path")
    out = both.groupBy("grp").agg(F.sum("instrumented").alias("instrumented"), F.sum("covered").alias("covered"), F.bool_and(F.col("percent") >= least).alias("passed"), F.min_by("path", F.struct("percent", "path")).alias("worst_path"))
    return out


def lines_out_of_range(lcov: DataFrame, line_counts: DataFrame) -> DataFrame:
    """LCOV lines (path, line) that their file (path, total_lines) hasn't; files that aren't known are left out."""
    return lcov.join(line_counts, "path").where((F.col("line") < 1) | (F.col("line") > F.col("total_lines"))).select("path", "line")
