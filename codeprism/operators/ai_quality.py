"""Rules for hastily generated code: phantom calls, stubs, disabled checks, impossible versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..parse import tables as T
from .findings import suppress
from .graph import kept
from .line_rules import near, numbered_lines
from .prompt_safety import any_of

#: Names that are known everywhere.
GO_PACKAGES = (
    "fmt", "os", "io", "net", "http", "json", "log", "sync", "context", "time", "strings", "strconv", "bytes", "errors", "path", "filepath", "bufio", "crypto", "encoding", "reflect",
    "testing", "regexp", "sort", "math", "database", "sql", "html", "template", "flag",
)
PYTHON_BUILTINS = (
    "print", "len", "range", "int", "str", "float", "list", "dict", "set", "tuple", "bool", "type", "isinstance", "issubclass", "hasattr", "getattr", "setattr", "delattr", "open", "input",
    "super", "map", "filter", "zip", "enumerate", "sorted", "reversed", "min", "max", "sum", "abs", "round", "any", "all", "next", "iter", "hash", "id", "repr", "format", "chr", "ord",
    "hex", "oct", "bin", "pow", "divmod", "complex", "bytes", "bytearray", "memoryview", "object", "staticmethod", "classmethod", "property", "Exception", "ValueError", "TypeError",
    "KeyError", "IndexError", "AttributeError", "RuntimeError", "OSError", "IOError", "FileNotFoundError", "NotImplementedError", "StopIteration", "True", "False", "None",
)
COMMON_METHODS = (
    "append", "extend", "insert", "remove", "pop", "clear", "copy", "get", "keys", "values", "items", "update", "join", "split", "strip", "lower", "upper", "replace", "find", "startswith",
    "endswith", "encode", "decode", "read", "write", "close", "flush", "Error", "String", "Len", "Close", "Read", "Write", "self", "cls",
)
SECURITY_NAMES = (
    "validate_token", "verify_auth", "check_permissions", "sanitize_input", "encrypt_data", "decrypt_data", "verify_signature", "check_csrf", "validate_session", "authenticate_user",
    "authorize_request", "verify_certificate", "validate_credentials",
)
SECURITY_PARTS = ("auth", "csrf", "sanitiz", "encrypt", "decrypt", "verify_sig")
DECORATORS = ("login_required", "permission_required", "requires_auth", "csrf_protect", "rate_limit", "require_http_methods", "requires_permission", "authenticated")
GO_COMMENTS = ("// requires authentication", "// requires authorization", "// must be authenticated", "// auth required", "// protected endpoint", "// requires permission")
CONTROL_WORDS = ("auth", "csrf", "token", "permission", "sanitiz", "validate", "verify")
GATE_WORDS = ("auth", "csrf", "token", "permission", "sanitize", "validate")


def _rows(df: DataFrame, rule: str, severity: str, confidence: float, line: Column | str = "n", detail: Column | None = None) -> DataFrame:
    at = F.col(line) if isinstance(line, str) else line
    return df.select(F.lit(rule).alias("rule_id"), "file", at.cast("int").alias("start_line"), (F.lit("") if detail is None else detail).alias("detail"), F.lit(severity).alias("severity"), F.lit(confidence).cast("float").alias("confidence"))


def phantom_calls(parsed: DataFrame, lines: DataFrame) -> DataFrame:
    """Names called in a file that nothing defines, imports or knows."""
    symbols, imports, refs = T.symbols(parsed), T.imports(parsed), T.refs(parsed)
    local = F.concat(F.array("alias"), F.array(F.element_at(F.split("import_path", r"[./]"), -1)), F.coalesce("names", F.array().cast("array<string>")))
    known = symbols.select("name").union(imports.select(F.explode(local).alias("name"))).where("name is not null").distinct()
    fixed = [*GO_PACKAGES, *COMMON_METHODS, *PYTHON_BUILTINS]
    names = refs.where((F.length("name") > 1) & ~F.col("name").isin(fixed)).select("file", "language", "name").distinct().join(known, "name", "left_anti")
    code = lines.where(~F.trim("line").rlike(r"^(#|//)"))
    # each place where a name stands before a bracket, outside of strings on its line
    calls = code.select("file", "n", "line", F.explode(F.regexp_extract_all("line", F.lit(r"(\w+)\("), F.lit(1))).alias("name")).distinct()
    before = F.expr("substring_index(line, concat(name, '('), 1)")
    quotes = lambda q: F.length(before) - F.length(F.replace(before, F.lit(q), F.lit("")))
    first = calls.where((quotes('"') % 2 == 0) & (quotes("'") % 2 == 0)).groupBy("file", "name").agg(F.min("n").alias("n"), F.max(F.contains("line", F.concat(F.lit("."), "name", F.lit("(")))).alias("dotted"))
    found = names.join(first, ["file", "name"])
    low = F.lower("name")
    secure = any_of(low, SECURITY_NAMES) | any_of(low, SECURITY_PARTS)
    plain = found.where(~secure & ~((F.col("language") == "go") & F.col("name").rlike("^[A-Z]") & F.col("dotted")))
    return _rows(plain, "phantom-api-call", "error", 0.7, detail=F.col("name")).unionByName(_rows(found.where(secure), "phantom-security-call", "error", 0.9, detail=F.col("name")))


def stubs(parsed: DataFrame, lines: DataFrame) -> DataFrame:
    """Functions whose body is nothing but placeholders."""
    functions = T.symbols(parsed).where("kind = 'function' and language in ('go', 'python')")
    inside = functions.select("file", "language", "name", "start_line", F.explode(F.when(F.col("end_line") > F.col("start_line"), F.sequence(F.col("start_line") + 1, F.col("end_line"))).otherwise(F.array().cast("array<int>"))).alias("n"))
    t = F.trim("line")
    python = t.isin("pass", "...", "raise NotImplementedError", "raise NotImplementedError()") | t.rlike(r"^# (TODO|todo)")
    go = t.isin("// TODO", "todo!()", 'panic("not implemented")', 'panic("TODO")', "return", "return nil") | t.rlike(r"^// (TODO|todo):")
    content = inside.join(lines, ["file", "n"]).where((t != "") & ~t.rlike(r"^(def |func |func\()") & ~t.isin("{", "}", ")", "})"))
    real = content.where(~F.when(F.col("language") == "python", python).otherwise(go)).select("file", "name", "start_line").distinct()
    return _rows(functions.join(real, ["file", "name", "start_line"], "left_anti"), "unfinished-stub", "warning", 0.9, "start_line", F.col("name"))


def ai_quality(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """All findings over Go and Python files (and manifests) that no comment suppresses: rule_id, file, start_line, detail, severity, confidence."""
    code = files.where(F.col("language").isin("go", "python"))
    parsed = kept(T.parse_files(code)) if parsed is None else parsed.where(F.col("language").isin("go", "python"))
    lines = numbered_lines(code).withColumnsRenamed({"path": "file", "line_no": "n"})
    lines = lines.join(code.select(F.col("path").alias("file"), "language"), "file")
    t, low = F.trim("line"), F.lower(F.trim("line"))
    python, go = F.col("language") == "python", F.col("language") == "go"
    out = phantom_calls(parsed, lines.select("file", "n", "line")).unionByName(stubs(parsed, lines.select("file", "n", "line")))

    # comments that promise a decorator: applied if it stands before the next def or class, within nine lines
    ahead = W.partitionBy("file").orderBy("n").rowsBetween(1, 9)
    first = F.first(F.when(t.rlike(r"^(def|class) "), F.col("n")), True).over(ahead)
    promises = F.filter(F.array(*map(F.lit, DECORATORS)), lambda d: F.contains(F.col("line"), d))
    applied = F.collect_list(F.when(t.startswith("@"), F.struct("n", t.alias("t")))).over(ahead)
    marked = lines.withColumns({"stop": first, "promises": promises, "applied": applied}).where(python & t.startswith("#") & (F.size("promises") > 0))
    lacking = marked.select("file", "n", "stop", "applied", F.explode("promises").alias("d")).where(
        ~F.exists("applied", lambda a: a["t"].startswith(F.concat(F.lit("@"), F.col("d"))) & (F.col("stop").isNull() | (a["n"] < F.col("stop"))))
    )
    out = out.unionByName(_rows(lacking, "missing-decorator", "warning", 0.8, detail=F.col("d")))
    window = W.partitionBy("file").orderBy("n").rowsBetween(1, 14)
    wrap = F.first(F.when(any_of(low, ("middleware", "auth", "wrap")), F.col("n")), True).over(window)
    func = F.first(F.when(t.startswith("func "), F.col("n")), True).over(W.partitionBy("file").orderBy("n").rowsBetween(2, 14))
    spoken = lines.withColumns({"wrap": wrap, "func": func}).where(go & any_of(low, GO_COMMENTS) & (F.col("wrap").isNull() | (F.col("func") < F.col("wrap"))))
    out = out.unionByName(_rows(spoken, "missing-decorator", "warning", 0.7))

    body = F.regexp_replace(t, r"^(#+|/+)\s*", "")
    disabled = ((python & t.startswith("#")) | (go & t.startswith("//"))) & F.contains(body, F.lit("(")) & any_of(F.lower(body), CONTROL_WORDS)
    out = out.unionByName(_rows(lines.where(disabled), "disabled-control", "error", 0.8))
    gate = (go & t.rlike(r"^if false ?\{")) | (python & t.startswith("if False:"))
    gated = lines.withColumn("secure", near(lines, ["file"], "n", any_of(low, GATE_WORDS), 0, 4)).where(gate & F.col("secure"))
    out = out.unionByName(_rows(gated, "disabled-control", "error", 0.9))

    base = F.element_at(F.split("path", "/"), -1)
    manifest = numbered_lines(files.where(base.isin("requirements.txt", "go.mod"))).withColumnsRenamed({"path": "file", "line_no": "n"})
    is_go = F.col("file").endswith("go.mod")
    number = lambda p, i=1: F.regexp_extract("line", p, i).try_cast("bigint")
    huge = F.when(is_go, number(r"\sv(\d+)\.") >= 90).otherwise(number(r"(?:>=|<=|==|~=|!=|>|<)\s*(\d+)") >= 90)
    crossed = ~is_go & (number(r"^[^,]*>=?\s*(\d+)[^,]*,") > number(r"^[^,]*,[^,]*<=?\s*(\d+)"))
    odd = manifest.where(~F.trim("line").startswith("#") & (F.coalesce(huge, F.lit(False)) | F.coalesce(crossed, F.lit(False))))
    out = out.unionByName(_rows(odd, "impossible-dependency-version", "warning", 0.8))

    c = F.col("content")
    mixed = (go & c.contains("if err != nil") & (c.contains("panic(") | c.contains("log.Fatal"))) | (python & c.contains("try:") & c.rlike(r"(?m)^\s*except:( |\s*$)") & c.rlike(r"(?m)^\s*except .*:\s*$"))
    out = out.unionByName(_rows(code.where(mixed).withColumn("file", F.col("path")), "inconsistent-error-handling", "info", 0.6, F.lit(1)))
    return suppress(out, T.suppressions(code))
