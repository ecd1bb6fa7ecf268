"""Entry points that web and command frameworks call: routes, commands, views."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..parse.brace_source import _partners
from ..parse.lexer import lex

#: Registration methods and view base classes.
GO_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "Any", "Handle")
ROUTE_METHODS = ("route", "get", "post", "put", "delete", "patch", "head", "options")
VIEW_BASES = ("View", "TemplateView", "ListView", "DetailView", "CreateView", "UpdateView", "DeleteView", "FormView", "APIView", "ModelViewSet", "ViewSet", "GenericAPIView")
ENTRIES = "array<struct<framework: string, kind: string, name: string, line: int, confidence: float>>"


def go_entries(source: str) -> list[tuple[str, str, str, int, float]]:
    framework = "gin" if "gin-gonic/gin" in source else "echo" if "labstack/echo" in source else None
    cobra, tokens, out = "spf13/cobra" in source, lex(source, "go"), []
    pairs = _partners(tokens)
    for i, t in enumerate(tokens[:-3]):
        if framework and t.text in GO_METHODS and i and tokens[i - 1].text == "." and tokens[i + 1].text == "(" and tokens[i + 2].kind == "string":
            inside = tokens[i + 2 : pairs[i + 1]]
            names = [x.text for x in inside[1:] if x.kind == "name" and x.text != "func"]
            handler = "anonymous" if any(x.text == "func" for x in inside) else ".".join(names[-2:]) if len(names) > 1 and tokens[pairs[i + 1] - 2].text == "." else (names or ["anonymous"])[-1]
            out.append((framework, "route-handler", handler, t.line, 0.9))
        if cobra and t.text == "Command" and tokens[i + 1].text == "{":
            body = tokens[i + 2 : pairs[i + 1]]
            keys = {a.text: c for a, b, c in zip(body, body[1:], body[2:]) if a.kind == "name" and b.text == ":"}
            if ("Run" in keys or "RunE" in keys) and "Use" in keys:
                out.append(("cobra", "command", keys["Use"].text.strip("\"`").split(" ")[0], t.line, 0.85))
    return out


def python_entries(source: str) -> list[tuple[str, str, str, int, float]]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    modules = {a.name.split(".")[0] for x in ast.walk(tree) if isinstance(x, ast.Import) for a in x.names} | {(x.module or "").split(".")[0] for x in ast.walk(tree) if isinstance(x, ast.ImportFrom)}
    web = "fastapi" if "fastapi" in modules else "flask" if "flask" in modules else None
    out = []
    for x in ast.walk(tree):
        if web and isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
            if any(isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in ROUTE_METHODS for d in x.decorator_list):
                out.append((web, "route-handler", x.name, x.lineno, 0.9))
        if modules & {"django", "rest_framework"}:
            if isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and x.func.id in ("path", "re_path") and len(x.args) > 1 and not ast.unparse(x.args[1]).startswith("include("):
                out.append(("django", "url-pattern", ast.unparse(x.args[1]), x.lineno, 0.9))
            if isinstance(x, ast.ClassDef) and any(ast.unparse(b).split(".")[-1] in VIEW_BASES for b in x.bases):
                out.append(("django", "view", x.name, x.lineno, 0.85))
    return sorted(out, key=lambda e: e[3])


def framework_entries(files: DataFrame) -> DataFrame:
    """file, framework, kind, name, line, confidence of Go and Python files."""

    @F.pandas_udf(ENTRIES)
    def run(content: pd.Series, language: pd.Series) -> pd.Series:
        names = ("framework", "kind", "name", "line", "confidence")
        return pd.Series([[dict(zip(names, e)) for e in (go_entries if l == "go" else python_entries)(c)] for c, l in zip(content, language)])

    source = files.where(F.col("language").isin("go", "python") & F.col("content").isNotNull())
    return source.select(F.col("path").alias("file"), F.explode(run("content", "language")).alias("x")).select("file", "x.*")


def framework_findings(entries: DataFrame) -> DataFrame:
    """An entry-point finding each, and one ``framework-detected`` for each framework."""
    points = entries.select(F.lit("framework-entry-point").alias("rule_id"), "file", F.col("line").alias("start_line"), "framework", "name")
    seen = entries.select("framework").distinct().select(F.lit("framework-detected").alias("rule_id"), F.lit("").alias("file"), F.lit(0).alias("start_line"), "framework", F.lit("").alias("name"))
    return points.unionByName(seen)
