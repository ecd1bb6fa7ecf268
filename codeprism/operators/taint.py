"""Taint within a function: from request data and input to dangerous calls."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..parse.tables import parse_file

#: Where untrusted data comes from.
SOURCES = {
    "go": ("r.URL", "r.Body", "r.FormValue", "r.Header", "r.PostForm", "Request", "Query"),
    "python": ("request.args", "request.form", "request.data", "request.json", "request.headers", "request.GET", "request.POST", "input(", "sys.argv"),
}
#: Where it must not go, by rule.
SINKS = {
    "go": {
        "sql-injection": ("db.Query", "db.Exec", "db.QueryRow"), "command-injection": ("exec.Command",), "xss": ("fmt.Fprintf", "w.Write"),
        "ssrf": ("http.Get", "http.Post"), "path-traversal": ("os.Open", "os.ReadFile", "ioutil.ReadFile"), "unsafe-deserialization": ("json.Unmarshal", "yaml.Unmarshal"),
    },
    "python": {
        "sql-injection": ("cursor.execute", "execute(", "raw("), "command-injection": ("os.system", "subprocess.call", "subprocess.run", "subprocess.Popen"),
        "xss": ("render_template_string", "Markup("), "ssrf": ("requests.get", "requests.post", "urllib.request.urlopen"), "path-traversal": ("open(", "os.path.join"),
        "unsafe-deserialization": ("pickle.loads", "pickle.load", "yaml.load", "marshal.loads"),
    },
}
_NAME = re.compile(r"[A-Za-z_]\w*")
_CONCAT = re.compile(r"\+|fmt\.Sprintf|format\(|f[\"']")


def assigned(line: str, language: str) -> tuple[list[str], str]:
    """Names an assignment sets, and its right side; comparisons set nothing."""
    at = line.find(":=") if language == "go" else -1
    width = 2
    if at < 0:
        at, width = line.find("="), 1
        if at <= 0 or line[at - 1] in "!<>=" or language == "python" and line[at + 1 : at + 2] in ("=", ""):
            return [], ""
    names = [x.strip() for x in line[:at].split(",")]
    return [x for x in names if _NAME.fullmatch(x)], line[at + width :]


def mentions(line: str, name: str) -> bool:
    return re.search(rf"(?<!\w){re.escape(name)}(?!\w)", line) is not None


def taint_findings(content: str, language: str, spans: list[tuple[int, int]]) -> list[tuple[str, int, str, float]]:
    """(rule, line, sink, confidence), one for each sink pattern that a tainted name meets on its line.

    Names are tainted by assignments from a source and by assignments whose
    right side holds a tainted name, in line order; request parameters are
    tainted after that pass.
    """
    lines, out = content.split("\n"), []
    for start, end in spans:
        body = [x.strip() for x in lines[start - 1 : end]]
        tainted: set[str] = set()
        for line in body:
            names, right = assigned(line, language)
            if any(p in line for p in SOURCES[language]) or any(t in right for t in tainted):
                tainted.update(names)
        head = " ".join(body[:6] if language == "python" else body[:1])
        if language == "go" and "*http.Request" in head:
            tainted.update(x for x in ("r", "req", "request") if re.search(rf"\b{x}\s+\*http\.Request", head))
        if language == "python" and re.search(r"def\s+\w+\([^)]*\brequest\b", head):
            tainted.add("request")
        for n, line in enumerate(body):
            for rule, patterns in SINKS[language].items():
                for p in patterns:
                    if p in line and any(mentions(line, t) for t in tainted):
                        out.append((rule, start + n, p, 0.9 if _CONCAT.search(line) else 0.85))
    return out


def taint(files: DataFrame) -> DataFrame:
    """Findings over Go and Python files: rule_id, file, start_line, sink, confidence."""

    @F.pandas_udf("array<struct<rule_id: string, start_line: int, sink: string, confidence: float>>")
    def run(content: pd.Series, language: pd.Series) -> pd.Series:
        found = [taint_findings(c, l, parse_file(c, l).spans) for c, l in zip(content, language)]
        return pd.Series([[dict(zip(("rule_id", "start_line", "sink", "confidence"), x)) for x in f] for f in found])

    source = files.where(F.col("language").isin("go", "python") & F.col("content").isNotNull())
    return source.select(F.col("path").alias("file"), F.explode(run("content", "language")).alias("x")).select("file", "x.*")
