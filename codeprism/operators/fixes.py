"""Fix plans: edits from findings, conflicts, outcomes, and files with edits applied."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .findings import by_rule, edit_conflicts

#: Modules whose findings can be fixed, refuse, or have nothing to fix.
POLICY = {
    "dead-code": "apply", "ai-quality": "apply", "llm-defense": "apply", "cicd": "apply", "arch": "refuse", "duplication": "refuse", "security": "refuse",
    "complexity": "none", "hotspot": "none", "audit": "none", "frameworks": "none", "telemetry": "none",
}


def fixable(findings: DataFrame, rule: str | None = None) -> DataFrame:
    """Findings (module_id, ...) of modules that apply fixes, of one rule if it is named."""
    out = findings.where(F.col("module_id").isin(*(m for m, p in POLICY.items() if p == "apply")))
    return out if rule is None else by_rule(out, rule)


def with_fixes(findings: DataFrame) -> DataFrame:
    """Findings of which an action can be applied by itself."""
    return findings.where(F.exists("actions", lambda a: a["auto_fixable"]))


def refused(findings: DataFrame) -> DataFrame:
    """module_id, n: findings of modules that refuse to fix theirs."""
    return findings.where(F.col("module_id").isin(*(m for m, p in POLICY.items() if p == "refuse"))).groupBy("module_id").agg(F.count("*").alias("n"))


def planned_edits(findings: DataFrame) -> DataFrame:
    """A row per edit of each auto-fixable action: id, finding, file, start_line, end_line, new_text.

    ``findings``: finding (id) and actions.
    """
    acts = findings.select("finding", F.posexplode("actions").alias("a", "act")).where("act.auto_fixable")
    edits = acts.select("finding", "a", F.posexplode("act.edits").alias("e", "edit"))
    return edits.select(F.xxhash64("finding", "a", "e").alias("id"), "finding", "edit.file", "edit.start_line", "edit.end_line", "edit.new_text")


def outcomes(findings: DataFrame, dry_run: bool = False) -> DataFrame:
    """finding, applied, reason: no action, conflict, dry run or applied. Both sides of a conflict are left."""
    edits = planned_edits(findings)
    clash = edit_conflicts(edits).select("id").join(edits.select("id", "finding"), "id").select("finding", F.lit(True).alias("clash")).distinct()
    some = edits.select("finding", F.lit(True).alias("some")).distinct()
    out = findings.select("finding").join(some, "finding", "left").join(clash, "finding", "left")
    reason = F.when(F.col("some").isNull(), "no auto-fix available").when(F.col("clash"), "conflicting edits").otherwise("dry run" if dry_run else "applied")
    return out.select("finding", (reason == "applied").alias("applied"), reason.alias("reason"))


def apply_to_text(content: str, edits: list[tuple[int, int, str]]) -> str:
    """Edits (start, end, text) from the bottom up; an empty text deletes; a final line break stays."""
    lines = content.split("\n")
    ends = lines and lines[-1] == ""
    if ends:
        lines.pop()
    for start, end, text in sorted(edits, reverse=True):
        if 1 <= start <= len(lines):
            new = text[:-1] if text.endswith("\n") else text
            lines[start - 1 : max(end, start)] = new.split("\n") if text else []
    return "\n".join(lines) + ("\n" if ends and lines else "")


def fixed_files(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path, content of files with their edits applied; edits of a file meet in one row, as its content does."""
    per = edits.groupBy(F.col("file").alias("path")).agg(F.collect_list(F.struct("start_line", "end_line", F.coalesce("new_text", F.lit("")).alias("new_text"))).alias("edits"))

    @F.pandas_udf("string")
    def run(content: pd.Series, edits: pd.Series) -> pd.Series:
        return pd.Series([apply_to_text(c or "", [(x["start_line"], x["end_line"], x["new_text"]) for x in e]) for c, e in zip(content, edits)])

    return files.join(per, "path").select("path", run("content", "edits").alias("content"))
