"""Findings as SARIF, CodeClimate, annotations, Markdown, text, JSON and badges.

Per-finding formats are columns, so that any number of findings can be written
as text files in parallel; documents are assembled from them at the end.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import html_escape


def fnv1a(text: str) -> str:
    """FNV-1a, 64 bits, as sixteen hex digits."""
    h = 0xCBF29CE484222325
    for byte in text.encode():
        h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def _level(error: str, warning: str, info: str) -> Column:
    s = F.col("severity")
    return F.when(s == "error", error).when(s == "warning", warning).otherwise(info)


def codeclimate(findings: DataFrame) -> DataFrame:
    """One JSON issue a finding (rule_id, file, start_line, end_line, message, severity): column ``issue``."""

    @F.pandas_udf("string")
    def mark(text: pd.Series) -> pd.Series:
        return text.map(fnv1a)

    print_ = mark(F.concat_ws(":", "file", "start_line", "rule_id", "message"))
    place = F.struct(F.col("file").alias("path"), F.struct(F.col("start_line").alias("begin"), F.col("end_line").alias("end")).alias("lines"))
    return findings.select(F.to_json(F.struct(
        F.lit("issue").alias("type"), F.col("rule_id").alias("check_name"), F.col("message").alias("description"), F.array(F.lit("Complexity")).alias("categories"),
        _level("critical", "major", "minor").alias("severity"), print_.alias("fingerprint"), place.alias("location"),
    )).alias("issue"))


def annotations(findings: DataFrame) -> DataFrame:
    """One workflow annotation line a finding: column ``line``."""
    message = F.regexp_replace(F.regexp_replace("message", "\n", " "), "\r|%0A|%0D", "")
    return findings.select(F.concat(
        F.lit("::"), _level("error", "warning", "notice"), F.lit(" file="), F.replace("file", F.lit(","), F.lit("_")), F.lit(",line="), "start_line", F.lit(",col="), F.coalesce("start_column", F.lit(0)) if "start_column" in findings.columns else F.lit(0),
        F.lit("::"), message, F.lit(" ("), "rule_id", F.lit(")"),
    ).alias("line"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result object a finding: column ``result``."""
    region = F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"))
    location = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), _level("error", "warning", "note").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(location).alias("locations"))).alias("result"))


def sarif(findings: DataFrame, tool: str = "codeprism", version: str = "0.1.0") -> str:
    """A SARIF document of a frame of findings that fits the driver; :func:`write_lines` writes any number of results."""
    results = [json.loads(r.result) for r in sarif_results(findings).collect()]
    rules = {r: k for k, r in enumerate(dict.fromkeys(r["ruleId"] for r in results))}
    for r in results:
        r["ruleIndex"] = rules[r["ruleId"]]
    run = {"tool": {"driver": {"name": tool, "version": version, "rules": [{"id": x} for x in rules]}}, "results": results}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2)


def terminal(findings: DataFrame) -> DataFrame:
    """One line a finding: column ``line``."""
    return findings.select(F.concat("file", F.lit(":"), "start_line", F.lit(":"), "severity", F.lit(" "), "rule_id", F.lit(" "), F.regexp_replace("message", "\n", " ")).alias("line"))


def json_lines(findings: DataFrame) -> DataFrame:
    """One JSON object a finding: column ``json``."""
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("json"))


def write_lines(rows: DataFrame, path: str) -> None:
    """A format's column as text files, written in parallel."""
    rows.write.mode("overwrite").text(path)


def health_lines(project: DataFrame, files: DataFrame, worst: int = 10) -> DataFrame:
    """form, text: the project's health (score, total_files, grade), and its worst files (file, score, grade), so many at most."""
    text = lambda *c: F.concat(*(F.lit(x[1:]) if x.startswith("=") else F.col(x).cast("string") for x in c))
    head = project.select(F.lit("health").alias("form"), text("=Health: ", "score", "= (", "grade", "=), ", "total_files", "= files").alias("text"))
    low = files.orderBy("score", "file").limit(worst)
    return head.unionByName(low.select(F.lit("worst").alias("form"), text("file", "= ", "score", "= ", "grade").alias("text")))


def markdown_rows(findings: DataFrame) -> DataFrame:
    """file, start_line, row: the table rows of a report, so that any number can be written in parallel."""
    return findings.select("file", "start_line", "rule_id", F.concat(F.lit("| "), "start_line", F.lit(" | "), "severity", F.lit(" | `"), "rule_id", F.lit("` | "), F.replace("message", F.lit("|"), F.lit("&#124;")), F.lit(" |")).alias("row"))


def markdown(findings: DataFrame) -> str:
    """A report grouped by file, in order, of a frame of findings that fits the driver."""
    rows = markdown_rows(findings).orderBy("file", "start_line", "rule_id").collect()
    if not rows:
        return "No issues found.\n"
    out, file = [f"## {len(rows)} findings\n"], None
    for r in rows:
        if r.file != file:
            file = r.file
            out.append(f"\n### `{file}`\n\n| Line | Severity | Rule | Message |\n|---|---|---|---|")
        out.append(r.row)
    return "\n".join(out) + "\n"


def pr_comment(findings: DataFrame) -> DataFrame:
    """One table row of a pull-request comment a finding, escaped: column ``row``."""
    icon = _level("[E]", "[W]", "[I]")
    return findings.select(F.concat(F.lit("| "), icon, F.lit(" | "), html_escape("file"), F.lit(":"), "start_line", F.lit(" | "), "rule_id", F.lit(" | "), html_escape("message"), F.lit(" |")).alias("row"))


def badge(score: int) -> dict:
    return {"schemaVersion": 1, "label": "health", "message": f"{score}/100", "color": "green" if score >= 80 else "yellow" if score >= 60 else "red"}


def short_list(c: str, limit: int = 3) -> Column:
    """The first few of an array, and how many more there are."""
    more = F.size(c) - limit
    return F.concat(F.array_join(F.slice(c, 1, limit), ", "), F.when(more > 0, F.concat(F.lit(" and "), more, F.lit(" more"))).otherwise(F.lit("")))
