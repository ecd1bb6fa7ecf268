"""Python files through the standard ``ast`` module.

Files that don't parse give an error row; symbols, imports and names are then
found by line patterns, so that one bad file never empties a scan.
"""

from __future__ import annotations

import ast
import re

from .model import Parsed

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith)


def _elif(parent: ast.If, source: list[str]) -> bool:
    """Whether an ``if`` node's else branch is an ``elif``."""
    rest = parent.orelse
    return len(rest) == 1 and isinstance(rest[0], ast.If) and source[rest[0].lineno - 1].lstrip().startswith("elif")


def cyclomatic(node: ast.AST) -> int:
    n = 1
    for x in ast.walk(node):
        if isinstance(x, (*_NESTING, ast.ExceptHandler)):
            n += 1
        elif isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
    return n


def cognitive(node: ast.AST, level: int, source: list[str]) -> int:
    """Each structure costs one more the deeper it stands; an elif costs one, but what is in it stands deeper."""
    total = 0
    for x in ast.iter_child_nodes(node):
        if isinstance(x, ast.If):
            total += 1 + level + _chain(x, level + 1, source)
        elif isinstance(x, (*_NESTING, ast.ExceptHandler)):
            total += 1 + level + cognitive(x, level + 1, source)
        elif isinstance(x, ast.BoolOp):
            total += len(x.values) - 1 + cognitive(x, level, source)
        else:
            total += cognitive(x, level, source)
    return total


def _chain(x: ast.If, level: int, source: list[str]) -> int:
    """What an ``if`` holds, its elif branches included (each inside the ``if``, one level down)."""
    total = 0
    if not _elif(x, source):
        return cognitive(x, level, source)
    head = ast.Module([ast.Expr(x.test), *x.body], [])
    total += cognitive(head, level, source)
    # an elif is a child of the whole statement: all of a chain stand at the same level
    return total + 1 + _branch(x.orelse[0], level, source)


def _branch(x: ast.If, level: int, source: list[str]) -> int:
    inner = cognitive(ast.Module([ast.Expr(x.test), *x.body], []), level + 1, source)
    if _elif(x, source):
        return inner + 1 + _branch(x.orelse[0], level, source)
    return inner + cognitive(ast.Module(x.orelse, []), level, source)


def max_nesting(node: ast.AST, level: int, source: list[str]) -> int:
    best = level
    for x in ast.iter_child_nodes(node):
        deeper = isinstance(x, (*_NESTING, ast.ExceptHandler)) and not (isinstance(node, ast.If) and _elif(node, source) and x is node.orelse[0])
        best = max(best, max_nesting(x, level + deeper, source))
    return best


def parse(source: str) -> Parsed:
    out, lines = Parsed(), source.split("\n")
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return _fallback(lines, str(e))
    for x in tree.body:
        if isinstance(x, (*_FUNCTIONS, ast.ClassDef)):
            out.symbols.append((x.name, "type" if isinstance(x, ast.ClassDef) else "function", x.lineno, x.end_lineno, not x.name.startswith("_")))
        if isinstance(x, _FUNCTIONS):
            out.functions.append((x.name, x.lineno, x.end_lineno, cyclomatic(x), cognitive(x, 0, lines), max_nesting(x, 0, lines)))
    for x in ast.walk(tree):
        if isinstance(x, ast.Import):
            out.imports += [(a.name, a.asname, [], x.lineno) for a in x.names]
        elif isinstance(x, ast.ImportFrom):
            out.imports.append(("." * x.level + (x.module or ""), None, [a.asname or a.name for a in x.names if a.name != "*"], x.lineno))
        elif isinstance(x, ast.Name):
            out.refs.append((x.id, x.lineno))
        elif isinstance(x, ast.Attribute):
            out.refs.append((x.attr, x.end_lineno))
        elif isinstance(x, ast.arg):
            out.refs.append((x.arg, x.lineno))
        elif isinstance(x, ast.keyword) and x.arg:
            out.refs.append((x.arg, x.value.lineno))
        if isinstance(x, (*_FUNCTIONS, ast.Lambda)):
            out.spans.append((x.lineno, x.end_lineno))
    out.refs.sort(key=lambda r: r[1])
    return out


def _fallback(lines: list[str], error: str) -> Parsed:
    out = Parsed(error=error)
    for n, line in enumerate(lines, 1):
        if m := re.match(r"(?:async\s+)?(def|class)\s+(\w+)", line):
            out.symbols.append((m[2], "function" if m[1] == "def" else "type", n, n, not m[2].startswith("_")))
        elif m := re.match(r"\s*import\s+([\w.]+)(?:\s+as\s+(\w+))?", line):
            out.imports.append((m[1], m[2], [], n))
        elif m := re.match(r"\s*from\s+([\w.]+)\s+import\s+(.+)", line):
            out.imports.append((m[1], None, [x.split()[-1] for x in m[2].strip("() ").split(",") if x.split() and x.strip() != "*"], n))
        else:
            out.refs += [(x, n) for x in re.findall(r"[A-Za-z_]\w*", line.split("#")[0])]
    return out
