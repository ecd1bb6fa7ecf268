"""Tables of a source tree: one Arrow pass parses each file, the rest are views on it."""

from __future__ import annotations

import re
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .brace_source import parse_go, parse_java, parse_script
from .lexer import lex, normalise
from .model import Parsed
from . import python_source

PARSED = (
    "symbols array<struct<name: string, kind: string, start_line: int, end_line: int, exported: boolean>>, "
    "imports array<struct<path: string, alias: string, names: array<string>, line: int>>, refs array<struct<name: string, line: int>>, "
    "functions array<struct<name: string, start_line: int, end_line: int, cyclomatic: int, cognitive: int, max_nesting: int>>, "
    "spans array<struct<start_line: int, end_line: int>>, error string"
)
#: Exported declarations of scripts are left out, as dead code must not judge them by names alone.
PARSERS = {
    "python": python_source.parse, "go": parse_go, "java": parse_java, "javascript": partial(parse_script, exported=False), "typescript": partial(parse_script, exported=False),
}
MARKER = "codeprism:ignore"


def parse_file(content: str | None, language: str | None) -> Parsed:
    """Never raises: what can't be parsed comes back with its error."""
    parser = PARSERS.get(language or "")
    if content is None or parser is None:
        return Parsed(error=None if parser is None else "no content")
    try:
        return parser(content)
    except Exception as e:  # a row for the quarantine, not the end of the job
        return Parsed(error=f"{type(e).__name__}: {e}")


def parse_files(files: DataFrame) -> DataFrame:
    """``files`` (path, content, language) with what the parsers find in each."""

    @F.pandas_udf(PARSED)
    def run(content: pd.Series, language: pd.Series) -> pd.DataFrame:
        rows = [parse_file(c, l) for c, l in zip(content, language)]
        named = lambda names, xs: [dict(zip(names, x)) for x in xs]
        return pd.DataFrame({
            "symbols": [named(("name", "kind", "start_line", "end_line", "exported"), p.symbols) for p in rows], "imports": [named(("path", "alias", "names", "line"), p.imports) for p in rows],
            "refs": [named(("name", "line"), p.refs) for p in rows], "functions": [named(("name", "start_line", "end_line", "cyclomatic", "cognitive", "max_nesting"), p.functions) for p in rows],
            "spans": [named(("start_line", "end_line"), p.spans) for p in rows], "error": [p.error for p in rows],
        })

    return files.withColumn("p", run.asNondeterministic()("content", "language")).select("path", "content", "language", "p.*")


def symbols(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("path").alias("file"), "language", F.explode("symbols").alias("x")).select("file", "language", "x.*")


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("path").alias("file"), "language", F.explode("imports").alias("x")).select("file", "language", F.col("x.path").alias("import_path"), "x.alias", "x.names", "x.line")


def refs(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("path").alias("file"), "language", F.explode("refs").alias("x")).select("file", "language", "x.*")


def function_metrics(parsed: DataFrame) -> DataFrame:
    out = parsed.select(F.col("path").alias("file"), F.explode("functions").alias("x")).select("file", "x.*")
    return out.withColumn("lines", F.col("end_line") - F.col("start_line") + 1)


def quarantine(parsed: DataFrame) -> DataFrame:
    """Files that didn't parse, and why."""
    return parsed.where("error is not null").select("path", "language", "error")


def token_table(files: DataFrame, mode: str = "strict") -> DataFrame:
    """file, toks and the line of each, for clone detection."""

    @F.pandas_udf("toks array<string>, lines array<int>")
    def run(content: pd.Series, language: pd.Series) -> pd.DataFrame:
        rows = [[(normalise(t, mode, l), t.line) for t in lex(c or "", l or "")] for c, l in zip(content, language)]
        return pd.DataFrame({"toks": [[t for t, _ in r] for r in rows], "lines": [[n for _, n in r] for r in rows]})

    return files.select(F.col("path").alias("file"), run("content", "language").alias("t")).select("file", "t.*")


def scan_suppressions(content: str, language: str, marker: str = MARKER) -> list[tuple[int, list[str], str]]:
    """(line, rules, text) of comments with the marker; no rules or ``*`` means all.

    Comments inside strings don't count, whether they end on their line or not
    (Go raw strings, Python triple quotes).
    """
    out, quote = [], None
    opening = re.compile(r"\"\"\"|'''|\"|'|\#" if language == "python" else r"`|\"|'|//")
    for n, line in enumerate(content.split("\n"), 1):
        at = 0
        while at < len(line):
            if quote:
                end = line.find(quote, at)
                if end < 0:
                    break
                at, quote = end + len(quote), None
                continue
            m = opening.search(line, at)
            if not m:
                break
            mark, at = m.group(), m.end()
            if mark in ("#", "//"):
                if (where := line.find(marker, at)) >= 0:
                    words = [w for w in re.split(r"[\s,]+", line[where + len(marker) :].strip(" []")) if w]
                    out.append((n, [] if "*" in words else words, line.strip()))
                break
            if mark in ('"""', "'''", "`"):
                quote = mark
                continue
            while at < len(line) and line[at] != mark:
                at += 2 if line[at] == "\\" else 1
            at += 1
    return out


def suppressions(files: DataFrame, marker: str = MARKER) -> DataFrame:
    """file, line, rules, text. Only files that hold the marker reach Python."""

    @F.pandas_udf("array<struct<line: int, rules: array<string>, text: string>>")
    def run(content: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("line", "rules", "text"), x)) for x in scan_suppressions(c, l or "", marker)] for c, l in zip(content, language)])

    held = files.where(F.contains("content", F.lit(marker)))
    return held.select(F.col("path").alias("file"), F.explode(run("content", "language")).alias("x")).select("file", "x.*")


def module_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
