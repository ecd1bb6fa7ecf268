"""Unused functions, types, imports and files; suppressions that do nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..parse import tables as T
from ..schema import ACTIONS
from . import graph
from .findings import stale_suppressions, suppress


def entry_point() -> Column:
    """Symbols that are alive by themselves, by language."""
    name, file, lang = F.col("name"), F.col("file"), F.col("language")
    go = name.isin("main", "init") | name.startswith("Test") | name.startswith("Benchmark") | F.col("exported")
    python = file.endswith("__init__.py") | name.startswith("test_") | F.col("exported")
    return F.when(lang == "go", go).when(lang == "python", python).otherwise(F.lit(True))


def entry_file(file: Column) -> Column:
    return F.element_at(F.split(file, "/"), -1).isin("main.go", "__init__.py", "__main__.py")


def alive_symbols(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(file, name) that entry points reach.

    A file with an alive symbol makes every name alive that it refers to, so
    reachability runs over files: A leads to B if A refers to a name of B. Files
    and names are both nodes, so the edges are as many as references and
    definitions, however many files share a name.
    """
    uses = refs.select("file", "name").distinct()
    file, name = F.concat(F.lit("f:"), "file"), F.concat(F.lit("n:"), "name")
    edges = uses.select(file.alias("a"), name.alias("b")).union(symbols.select(name.alias("a"), file.alias("b")))
    seeds = symbols.where(entry_point())
    nodes = graph.reachable(edges, seeds.select(file.alias("node")))
    used = nodes.where(F.col("node").startswith("n:")).select(F.substring("node", 3, 2_000_000_000).alias("name"))
    return symbols.join(used, "name", "left_semi").select("file", "name").union(seeds.select("file", "name")).distinct()


def dead_symbols(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Symbols that aren't alive, with confidence 0.8 if another file refers to their name, else 1."""
    dead = symbols.join(alive_symbols(symbols, refs), ["file", "name"], "left_anti")
    users = refs.groupBy("name").agg(F.countDistinct("file").alias("users"), F.min("file").alias("one"))
    elsewhere = F.coalesce((F.col("users") > 1) | ((F.col("users") == 1) & (F.col("one") != F.col("file"))), F.lit(False))
    return dead.join(users, "name", "left").withColumn("confidence", F.when(elsewhere, 0.8).otherwise(1.0).cast("float")).drop("users", "one")


def unused_imports(imports: DataFrame, refs: DataFrame) -> DataFrame:
    """Go and Python imports of which no local name is referred to in their file."""
    go = F.coalesce("alias", F.element_at(F.split("import_path", "/"), -1))
    python = F.coalesce("alias", F.element_at(F.split("import_path", r"\."), -1))
    local = F.when(F.col("language") == "go", F.array(go)).when(F.size("names") == 0, F.array(python)).otherwise(F.col("names"))
    wanted = imports.where(F.col("language").isin("go", "python")).withColumn("id", F.struct("file", "line", "import_path"))
    used = wanted.select("id", "file", F.explode(local).alias("name")).join(refs.select("file", "name").distinct(), ["file", "name"], "left_semi").select("id").distinct()
    return wanted.join(used, "id", "left_anti").drop("id")


def unused_files(symbols: DataFrame, dead: DataFrame) -> DataFrame:
    """Files of which every symbol is dead, entry files aside."""
    marked = symbols.select("file", "name").distinct().join(dead.select("file", "name", F.lit(True).alias("dead")).distinct(), ["file", "name"], "left")
    return marked.groupBy("file").agg(F.bool_and(F.col("dead").isNotNull()).alias("all")).where(F.col("all") & ~entry_file(F.col("file"))).select("file")


def dead_code(files: DataFrame, marker: str = T.MARKER, strict_stale: bool = True, parsed: DataFrame | None = None) -> DataFrame:
    """Findings: rule_id, file, start_line, end_line, name, severity, confidence, actions.

    What is unused by itself can be removed: an action with one edit over its lines.

    ``strict_stale`` calls a suppression stale if nothing is found near it after
    suppression, so one that works is reported too; otherwise only one that
    fits nothing found before suppression.
    """
    parsed = graph.kept(T.parse_files(files)) if parsed is None else parsed
    symbols, refs, supp = T.symbols(parsed), T.refs(parsed), T.suppressions(files, marker)
    dead = graph.kept(dead_symbols(symbols, refs))
    row = lambda df, rule, start, end, name, severity, confidence: df.select(rule.alias("rule_id"), "file", start.alias("start_line"), end.alias("end_line"), name.alias("name"), F.lit(severity).alias("severity"), confidence.cast("float").alias("confidence"))
    one = F.lit(1)
    raw = row(dead, F.when(F.col("kind") == "type", "unused-type").otherwise("unused-function"), F.col("start_line"), F.col("end_line"), F.col("name"), "warning", F.col("confidence"))
    raw = raw.unionByName(row(unused_imports(T.imports(parsed), refs), F.lit("unused-import"), F.col("line"), F.col("line"), F.col("import_path"), "warning", F.lit(1.0)))
    raw = raw.unionByName(row(unused_files(symbols, dead), F.lit("unused-file"), one, one, F.col("file"), "info", F.lit(0.8)))
    kept = suppress(raw, supp)
    stale = stale_suppressions(supp, kept if strict_stale else raw)
    out = kept.unionByName(row(stale, F.lit("stale-suppression"), F.col("line"), F.col("line"), F.col("text"), "info", F.lit(1.0)))
    edit = F.array(F.struct("file", "start_line", "end_line", F.lit("").alias("new_text")))
    remove = F.array(F.struct(F.concat(F.lit("remove "), "name").alias("description"), F.lit(True).alias("auto_fixable"), edit.alias("edits")))
    return out.withColumn("actions", F.when(F.col("rule_id").isin("unused-function", "unused-type", "unused-import"), remove).otherwise(F.array().cast(ACTIONS)))
