"""Queries over small source trees that are written out here, held against rows worked out by hand.

The test tables hold no source code, so operators that read it get trees of
their own. Each query is an operator of the library and nothing else; its SQL
lists the rows that the rules call for.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import registry, schema
from ..functions.scalars import language_of
from ..operators import ai_quality, cicd, clones, deadcode, diffs, findings as fi, fixes, frameworks, graph, health, line_rules, prompt_safety, snapshots, taint, telemetry
from ..parse import tables as T
from ..sinks import formats
from ..sources import discovery, foreign, manifests, state
from ..streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float):
        return f"{x!r}::DOUBLE"
    if isinstance(x, int):
        return f"{x}::BIGINT"
    return "'" + x.replace("'", "''") + "'"


def planted(columns: str, rows: list[tuple]):
    """Register a query under its function's name, with the rows that it gives in any order."""
    names = columns.split()

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark)
            # whole numbers and fractions in one width each, as the listed rows have them
            wide = {"int": "bigint", "float": "double", "smallint": "bigint"}
            types = {c.name: c.dataType.simpleString() for c in out.schema}
            return out.select(*(F.round(F.col(c).cast("double"), 4).alias(c) if types[c] in ("float", "double") else F.col(c).cast(wide.get(types[c], types[c])).alias(c) for c in names))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if not rows:
            ORACLES[f.__name__] = "SELECT " + ", ".join(f"NULL AS {c}" for c in names) + " WHERE false"
            return f
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
        ORACLES[f.__name__] = f"SELECT * FROM (VALUES {values}) AS t({', '.join(names)})"
        return f

    return wrap


def tree(spark: SparkSession, files: dict[str, str | None]) -> DataFrame:
    """path, content, language."""
    return spark.createDataFrame(list(files.items()), "path string, content string").withColumn("language", language_of("path"))


def numbered(spark: SparkSession, text: str) -> DataFrame:
    """file, n, line of one text file."""
    return line_rules.numbered_lines(tree(spark, {"f": text})).withColumnsRenamed({"path": "file", "line_no": "n"})


# -- parsing -----------------------------------------------------------------

GO = """package main

import (
	"fmt"
	"os"
	str "strings"
)

type Shape struct {
	side int
}

func main() {
	fmt.Println(helper(2))
}

func unused() {}

func Exported() {}
"""
GO_UTIL = """package main

// codeprism:ignore unused-function
func orphan() {}

func helper(x int) int { return x }
"""
PYTHON = """import os
import json as j
from pathlib import Path, PurePath

def run(x):
    return j.dumps(x)

def _unused():
    return Path

class _Old:
    pass
"""
SCRIPT = """import a, { b as c } from 'x';
function load() { return c(a); }
class Store { get() { return load(); } }
export function shown() {}
"""
JAVA = """import java.util.List;
public class Box {
    public Box() {}
    private int twice(int x) { return x + x; }
}
"""
SOURCES = {"main.go": GO, "util.go": GO_UTIL, "app.py": PYTHON, "s.js": SCRIPT, "Box.java": JAVA, "x.rs": "fn a() {}", "none.py": None}


@planted("file name kind start_line end_line exported", [
    ("main.go", "Shape", "type", 9, 11, True), ("main.go", "main", "function", 13, 15, False), ("main.go", "unused", "function", 17, 17, False), ("main.go", "Exported", "function", 19, 19, True),
    ("util.go", "orphan", "function", 4, 4, False), ("util.go", "helper", "function", 6, 6, False),
    ("app.py", "run", "function", 5, 6, True), ("app.py", "_unused", "function", 8, 9, False), ("app.py", "_Old", "type", 11, 12, False),
    ("s.js", "load", "function", 2, 2, False), ("s.js", "Store", "type", 3, 3, False),
    ("Box.java", "Box", "type", 2, 5, True), ("Box.java", "Box", "function", 3, 3, True), ("Box.java", "twice", "function", 4, 4, False),
])
def source_symbols(spark):
    """Functions and types of five languages."""
    return T.symbols(T.parse_files(tree(spark, SOURCES)))


@planted("file import_path alias line", [
    ("main.go", "fmt", None, 4), ("main.go", "os", None, 5), ("main.go", "strings", "str", 6), ("app.py", "os", None, 1), ("app.py", "json", "j", 2), ("app.py", "pathlib", None, 3),
    ("s.js", "x", None, 1), ("Box.java", "java.util.List", None, 1),
])
def source_imports(spark):
    """Imports of five languages."""
    return T.imports(T.parse_files(tree(spark, SOURCES)))


@planted("file name line", [("a.py", "f", 2), ("a.py", "x", 2), ("a.py", "g", 3), ("a.py", "y", 3), ("b.go", "x", 1), ("b.go", "int", 1), ("b.go", "g", 2), ("b.go", "x", 2)])
def source_references(spark):
    """Names that a file refers to."""
    return T.refs(T.parse_files(tree(spark, {"a.py": "import m\nf(x)\ng.y\n", "b.go": "func h(x int) {\n\tg(x)\n}\n"})))


@planted("path language", [("bad.py", "python")])
def source_quarantine(spark):
    """Files that don't parse are told, not dropped."""
    return T.quarantine(T.parse_files(tree(spark, {"bad.py": "def (", "good.py": "x = 1\n"})))


@planted("file line rules", [("a.go", 3, "r1,r2"), ("b.py", 2, ""), ("b.py", 6, "r3")])
def suppression_comments(spark):
    """suppressions in comments; those in strings are none."""
    go = 'package a\nvar s = "// codeprism:ignore"\nx() // codeprism:ignore r1, r2\n'
    py = 'x = "# codeprism:ignore"\ny # codeprism:ignore *\n"""\n# codeprism:ignore\n"""\nz() # codeprism:ignore r3\n'
    return T.suppressions(tree(spark, {"a.go": go, "b.py": py})).withColumn("rules", F.array_join("rules", ","))


HANDLER = """package h

func Complex(a int, b int) int {
	if a > 0 {
		if b > 0 {
			for i := 0; i < a; i++ {
				if i == b && a > 1 {
					use(i)
				}
			}
		} else if b < 0 || a == 3 {
			switch a {
			case 1:
				return 1
			default:
				return 2
			}
		}
	}
	return 0
}

func Simple() {}
"""
NESTED = "def f(x):\n    if x and x and x:\n        for i in x:\n            with i:\n                pass\n    elif x:\n        while 1:\n            pass\n    try:\n        pass\n    except E:\n        pass\n"


@planted("file name start_line end_line cyclomatic cognitive max_nesting lines", [
    ("h.go", "Complex", 3, 21, 10, 19, 4, 19), ("h.go", "Simple", 23, 23, 1, 0, 0, 1), ("n.py", "f", 1, 12, 9, 13, 3, 12),
])
def function_metrics(spark):
    """M1-M6: cyclomatic and cognitive complexity and nesting."""
    return T.function_metrics(T.parse_files(tree(spark, {"h.go": HANDLER, "n.py": NESTED})))


# -- dead code ---------------------------------------------------------------


@planted("rule_id file start_line end_line name severity confidence edits", [
    ("unused-function", "main.go", 17, 17, "unused", "warning", 1.0, 1), ("unused-import", "main.go", 5, 5, "os", "warning", 1.0, 1), ("unused-import", "main.go", 6, 6, "strings", "warning", 1.0, 1),
    ("unused-function", "app.py", 8, 9, "_unused", "warning", 1.0, 1), ("unused-type", "app.py", 11, 12, "_Old", "warning", 1.0, 1), ("unused-import", "app.py", 1, 1, "os", "warning", 1.0, 1),
    ("stale-suppression", "util.go", 3, 3, "// codeprism:ignore unused-function", "info", 1.0, 0),
])
def dead_code(spark):
    """What no entry point reaches, and the edits that remove it."""
    found = deadcode.dead_code(tree(spark, {k: SOURCES[k] for k in ("main.go", "util.go", "app.py")}))
    return found.withColumn("edits", F.aggregate("actions", F.lit(0), lambda n, a: n + F.size(a["edits"])))


@planted("rule_id file name confidence", [
    ("unused-function", "a.py", "_x", 0.8), ("unused-file", "a.py", "a.py", 0.8), ("unused-function", "b.py", "_y", 1.0), ("unused-file", "b.py", "b.py", 0.8), ("unused-function", "__main__.py", "_z", 1.0),
])
def dead_files(spark):
    """Files of dead symbols alone; a symbol that another file names is less sure."""
    return deadcode.dead_code(tree(spark, {"a.py": "def _x():\n    pass\n", "b.py": "def _y():\n    _x()\n", "__main__.py": "def _z():\n    pass\n"}))


@planted("file name", [("m.py", "main"), ("m.py", "test_it"), ("a.py", "_used"), ("b.py", "_deep")])
def alive_symbols(spark):
    """Symbols that entry points reach over names, file by file."""
    parsed = T.parse_files(tree(spark, {"m.py": "def main():\n    _used()\ndef test_it():\n    pass\n", "a.py": "def _used():\n    _deep()\n", "b.py": "def _deep():\n    pass\n", "c.py": "def _dead():\n    _used()\n"}))
    return deadcode.alive_symbols(T.symbols(parsed), T.refs(parsed))


# -- clones ------------------------------------------------------------------

_BLOCK = "".join(f"\tcall{i}(x{i})\n" for i in range(20))
CLONES = {"a.go": f"package a\n{_BLOCK}", "b.go": f"package b\nvar z = 1\n{_BLOCK}", "c.go": "package c\n", "t.txt": f"package a\n{_BLOCK}"}


@planted("rule_id file start_line end_line message severity confidence pairs locations most", [
    ("duplicate-block", "a.go", 2, 21, "clone family (30-80 tokens, 100% similar, 2 locations): b.go:3-22", "warning", 1.0, "51", '[{"file":"a.go","start":2,"end":21},{"file":"b.go","start":3,"end":22}]', "80"),
])
def clone_findings(spark):
    """A block of 80 tokens in two files is 51 pairs of windows of 30, one family, one finding."""
    m = F.col("metadata")
    found = clones.duplication(tree(spark, CLONES), 30)
    return found.select("*", m["raw_pair_count"].alias("pairs"), m["clone_locations"].alias("locations"), m["token_count_max"].alias("most"))


@planted("raw_clone_pairs clone_families reported_findings collapsed_matches truncated_families", [(51, 1, 0, 50, 1)])
def clone_counters(spark):
    """A10, O2: pairs, families, and what a report of no family leaves out."""
    return clones.clone_counters(clones.clone_families(T.token_table(tree(spark, CLONES).where("language is not null")), 30), 0)


@planted("file start end", [])
def clones_overlapping_themselves(spark):
    """Thirty equal tokens in one file are no clone of themselves at twenty tokens."""
    return clones.clone_blocks(T.token_table(tree(spark, {"a.go": "x " * 30})), 20)


@planted("mode tokens", [
    ("strict", 'if x { y := foo ( 1 , "a" ) }'), ("mild", "if x { y := foo ( $NUM , $STR ) }"), ("weak", "if $ID { $ID := $ID ( $NUM , $STR ) }"), ("semantic", "$CTRL $ID { $ID := $ID ( $NUM , $STR ) }"),
])
def token_modes(spark):
    """C1, C1n: tokens as each normalisation has them; comments are none."""
    out = None
    for mode in clones.SIMILARITY:
        part = T.token_table(tree(spark, {"a.go": 'if x { // note\n y := foo(1, "a") /* z */\n}'}), mode).select(F.lit(mode).alias("mode"), F.array_join("toks", " ").alias("tokens"))
        out = part if out is None else out.unionByName(part)
    return out


# -- security ----------------------------------------------------------------

GO_TAINT = 'package v\n\nfunc H(w http.ResponseWriter, r *http.Request) {\n\tid := r.FormValue("id")\n\tdb.Query("SELECT " + id)\n\tcmd := "x" + id\n\texec.Command(cmd)\n\tsafe := "x"\n\tos.Open(safe)\n}\n'
PY_TAINT = "def f(request):\n    q = request.args.get('q')\n    cursor.execute(f'x {q}')\n    open(q)\n\ndef clean():\n    open('a')\n"


@planted("rule_id file start_line sink confidence", [
    ("sql-injection", "v.go", 5, "db.Query", 0.9), ("command-injection", "v.go", 7, "exec.Command", 0.85), ("sql-injection", "v.py", 3, "cursor.execute", 0.9), ("sql-injection", "v.py", 3, "execute(", 0.9),
    ("path-traversal", "v.py", 4, "open(", 0.85),
])
def taint_flows(spark):
    """From request data to dangerous calls, within a function."""
    return taint.taint(tree(spark, {"v.go": GO_TAINT, "v.py": PY_TAINT, "e.py": ""}))


_KEY, _ODD = "AKIA" + "ABCDEFGHIJKLMNOP", "q7Xz9Lm2Vt4Rb8Kd1Wp6Hs3Yc5Nf0Gj"
SECURITY = {
    "a.py": f"import os\n\ndef f(request):\n    x = request.args\n    os.system(x)\nk = '{_KEY}'\nz = '{_ODD}'\n", "tests/b.py": f"k = '{_KEY}'\nz = '{_ODD}'\n", "requirements.txt": "pyyaml==5.4\nflask==3.0.0\n",
}


@planted("module_id rule_id file start_line severity", [
    ("security", "command-injection", "a.py", 5, "error"), ("security", "hardcoded-secret", "a.py", 6, "error"), ("security", "high-entropy-string", "a.py", 7, "warning"),
    ("security", "vulnerable-dependency", "requirements.txt", 1, "error"),
])
def security_findings(spark):
    """SE1-SE3, V1, U1: the security module unites its scans; test paths hold no secrets."""
    return registry.default_registry().analyse("security", tree(spark, SECURITY))


@planted("sast_findings secret_findings dependency_findings total_findings", [(1, 2, 1, 4)])
def security_counters(spark):
    """Findings of each security category."""
    return fi.security_counters(registry.default_registry().analyse("security", tree(spark, SECURITY)))


@planted("line_no kind", [
    (1, "aws-access-key"), (2, "github-token"), (3, "gcp-api-key"), (4, "slack-token"), (5, "stripe-key"), (6, "private-key"), (7, "jwt"), (8, "basic-auth-url"), (9, "npm-token"), (10, "generic-secret"),
    (11, "gitlab-token"), (12, "sendgrid-key"), (13, "twilio-key"), (14, "azure-storage-key"),
])
def secret_kinds(spark):
    """SE1: one line of each of many credential kinds, and one of none."""
    text = "\n".join([
        _KEY, "ghp_" + "a1" * 18, "AIza" + "b" * 35, "xoxb-" + "1" * 12, "sk_live_" + "c" * 16, "-----BEGIN RSA " + "PRIVATE KEY-----", "eyJ" + "d" * 10 + "." + "e" * 10 + "." + "f" * 5, "https://u:p@h/",
        "npm_" + "g" * 36, "password = 'hunter2hunter2'", "glpat-" + "h" * 20, "SG." + "i" * 16 + "." + "j" * 16, "SK" + "0" * 32, "AccountKey=" + "k" * 60, "nothing",
    ])
    return line_rules.secrets(line_rules.numbered_lines(tree(spark, {"a.txt": text})))


MANIFESTS = {
    "requirements.txt": "Flask==2.0.0\nrequests[x]==2.31.0 ; y\nPy_YAML==5.4\nz>=1\n", "go.mod": "module x\nrequire golang.org/x/net v0.20.0\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.1\n)\n",
    "Cargo.lock": '[[package]]\nname = "tokio"\nversion = "1.24.1"\n', "package-lock.json": '{"packages": {\n "node_modules/express": {\n  "version": "4.19.1"\n }}}', "other.txt": "flask==1.0",
}


@planted("file name version line", [
    ("requirements.txt", "Flask", "2.0.0", 1), ("requirements.txt", "requests", "2.31.0", 2), ("requirements.txt", "Py_YAML", "5.4", 3), ("go.mod", "golang.org/x/net", "0.20.0", 2),
    ("go.mod", "github.com/gin-gonic/gin", "1.9.1", 4), ("Cargo.lock", "tokio", "1.24.1", 3), ("package-lock.json", "express", "4.19.1", 3),
])
def manifest_dependencies(spark):
    """Dependencies of four kinds of manifests."""
    return manifests.dependencies(tree(spark, MANIFESTS))


@planted("file name advisory severity start_line confidence", [
    ("requirements.txt", "Flask", "CVE-2023-30861", "warning", 1, 0.95), ("go.mod", "golang.org/x/net", "CVE-2024-24790", "error", 2, 0.95), ("Cargo.lock", "tokio", "RUSTSEC-2023-0001", "warning", 3, 0.95),
    ("package-lock.json", "express", "CVE-2024-29041", "warning", 3, 0.95),
])
def manifest_vulnerabilities(spark):
    """Dependencies in vulnerable ranges."""
    return manifests.vulnerable_dependencies(manifests.dependencies(tree(spark, MANIFESTS)))


@planted("version low high inside", [
    ("1.2.3", "0", "1.10", True), ("1.10", "", "1.10.0", False), ("2-rc1", "2", "", True), ("abc", "0", "0.1", True), ("1.2.3.4.5.6.8", "0", "1.2.3.4.5.6.7", False), ("1.2.3.4.5.6.6", "0", "1.2.3.4.5.6.7", True),
])
def version_ranges(spark):
    """V2: versions of any number of parts compare as numbers."""
    from ..functions.scalars import version_in_range

    rows = [("1.2.3", "0", "1.10"), ("1.10", "", "1.10.0"), ("2-rc1", "2", ""), ("abc", "0", "0.1"), ("1.2.3.4.5.6.8", "0", "1.2.3.4.5.6.7"), ("1.2.3.4.5.6.6", "0", "1.2.3.4.5.6.7")]
    return spark.createDataFrame(rows, "version string, low string, high string").withColumn("inside", version_in_range("version", "low", "high"))


# -- quality of generated code, prompts --------------------------------------

HASTY = (
    "# login_required\ndef view():\n    phantom(1)\n    validate_token(2)\n    print('absent(')\n\ndef todo():\n    pass\n\n# check_auth(user)\nif False:\n    auth = 1\n"
    "try:\n    todo()\nexcept:\n    pass\nexcept KeyError:\n    pass\n\ndef later():  # codeprism:ignore unfinished-stub\n    pass\n"
)


@planted("rule_id file start_line severity confidence", [
    ("phantom-api-call", "a.py", 3, "error", 0.7), ("phantom-security-call", "a.py", 4, "error", 0.9), ("missing-decorator", "a.py", 1, "warning", 0.8), ("unfinished-stub", "a.py", 7, "warning", 0.9),
    ("disabled-control", "a.py", 10, "error", 0.8), ("disabled-control", "a.py", 11, "error", 0.9), ("impossible-dependency-version", "requirements.txt", 2, "warning", 0.8),
    ("impossible-dependency-version", "requirements.txt", 3, "warning", 0.8), ("inconsistent-error-handling", "a.py", 1, "info", 0.6),
])
def generated_code(spark):
    """AQ1-AQ7, F3, J13: signs of hastily generated code; a comment suppresses one."""
    return ai_quality.ai_quality(tree(spark, {"a.py": HASTY, "requirements.txt": "# x==99\nflask==99.1\nx>=5,<3\nok==1.0\n"}))


BOT = (
    "import openai\n\ndef tool_run(cmd):\n    subprocess.run(cmd)\n}\nos.system('x')\nprompt = f\"hi {user_name}\"\nresponse = client.messages.create(x)\n"
    "cursor.execute(response)\nwhile True:\n    agent.step()\ntool access: read and write\n"
)


@planted("rule_id start_line severity confidence", [
    ("unsafe-tool-use", 4, "error", 0.8), ("prompt-injection-exposure", 7, "error", 0.8), ("missing-rate-limit", 8, "warning", 0.7), ("missing-output-validation", 9, "error", 0.8),
    ("missing-output-validation", 9, "error", 0.8), ("unguarded-agent-loop", 10, "error", 0.8), ("excessive-tool-permissions", 12, "warning", 0.7),
])
def prompt_rules(spark):
    """LD1-LD6, J24, W4, W5: rules for code that calls language models."""
    return prompt_safety.prompt_safety(tree(spark, {"b.py": BOT, "plain.py": "while True:\n    agent()\n"}))


@planted("path", [("a.py",), ("b.py",), ("c.go",), ("d.py",)])
def prompt_gate(spark):
    """files that import a model library or hold a mark of one in any case; a word that only contains another's name is none."""
    files = tree(spark, {
        "a.py": "from transformers import pipeline\n", "b.py": "x = call_LLM(1)\n", "c.go": 'package c\nimport "github.com/tmc/langchaingo/llms"\n', "d.py": "client = OpenAI()\n",
        "e.py": "# a coherent text about transformers\n", "f.py": "def add(a, b):\n    return a + b\n", "g.md": "openai\n",
    })
    return prompt_safety.relevant(files, T.parse_files(files))


@planted("rule_id start_line", [("unguarded-agent-loop", 5)])
def prompt_suppressed(spark):
    """A comment on a line or the one above suppresses its rule there."""
    return prompt_safety.prompt_safety(tree(spark, {"a.py": "import openai\n# codeprism:ignore unguarded-agent-loop\nwhile True:\n    agent.step()\nwhile True:\n    agent.step()\n"}))


# -- CI/CD, frameworks, architecture -----------------------------------------

PIPELINES = {
    "Dockerfile": "FROM ubuntu:latest\nRUN apt \\\n  # note\n  update\nADD https://x.y/z /z\nENV API_KEY=abc\nARG TOKEN=$T\nENV PASSWORD hunter2\n", "ok.dockerfile": "FROM scratch\nUSER app:app\n",
    ".github/workflows/a.yml": "on: pull_request_target\npermissions: write-all\njobs:\n  a:\n    steps:\n      - uses: actions/checkout@v4\n      - run: echo ${{ github.head_ref }}\n",
    ".gitlab-ci.yml": "image: python\nvariables:\n  DB_PASSWORD: secretvalue\ninclude:\n  - https://x/y.yml\njob:\n  script: [a]\n",
    "docker-compose.yml": "services:\n  app:\n    privileged: true\n    network_mode: host\n    volumes: ['/etc:/x', './a:/b']\n",
    "a.service": "[Service]\nExecStart=/x\n", "b.service": "[Service]\nUser=app\nProtectSystem=full\nProtectHome=yes\nNoNewPrivileges=yes\nPrivateTmp=yes\n", "compose.bad.yml": "a: [", "readme.md": "FROM x",
}


@planted("rule_id file start_line", [
    ("dockerfile-unpinned-base", "Dockerfile", 1), ("dockerfile-run-as-root", "Dockerfile", 1), ("dockerfile-remote-add", "Dockerfile", 5), ("dockerfile-secrets-in-layer", "Dockerfile", 6),
    ("dockerfile-secrets-in-layer", "Dockerfile", 8), ("actions-dangerous-trigger", ".github/workflows/a.yml", 1), ("actions-excessive-permissions", ".github/workflows/a.yml", 2),
    ("actions-unpinned-action", ".github/workflows/a.yml", 6), ("actions-script-injection", ".github/workflows/a.yml", 7), ("gitlab-mutable-image", ".gitlab-ci.yml", 1), ("gitlab-literal-secret", ".gitlab-ci.yml", 3),
    ("gitlab-unpinned-include", ".gitlab-ci.yml", 5), ("gitlab-insecure-runner", ".gitlab-ci.yml", 6), ("compose-privileged", "docker-compose.yml", 3), ("compose-host-network", "docker-compose.yml", 4),
    ("compose-host-mount", "docker-compose.yml", 5), ("systemd-root-execution", "a.service", 1), ("systemd-missing-hardening", "a.service", 1), ("unreadable-config", "compose.bad.yml", 1),
])
def pipeline_configuration(spark):
    """CI1-CI12, S16: risky settings of five kinds of configuration."""
    return cicd.cicd(tree(spark, PIPELINES))


@planted("n instruction arguments", [(1, "FROM", "ubuntu:latest"), (2, "RUN", "apt update"), (5, "ADD", "https://x.y/z /z"), (6, "ENV", "API_KEY=abc"), (7, "ARG", "TOKEN=$T"), (8, "ENV", "PASSWORD hunter2")])
def container_directives(spark):
    """Directives with lines that go on; comments don't break them."""
    return cicd.directives(numbered(spark, PIPELINES["Dockerfile"]))


@planted("n key value", [(2, "User", "app"), (5, "A", "b=c")])
def ini_directives(spark):
    """Key and value of a service's lines."""
    return cicd.ini_directives(numbered(spark, "[Service]\nUser=app\n# x=y\n[Other]\nA = b=c\n"))


@planted("path kind", [("Dockerfile", "dockerfile"), ("a/.github/workflows/x.yaml", "actions"), (".gitlab-ci.yml", "gitlab"), ("compose.prod.yml", "compose"), ("x.service", "systemd"), ("a.py", None)])
def configuration_kinds(spark):
    """what kind of configuration a path is."""
    paths = ["Dockerfile", "a/.github/workflows/x.yaml", ".gitlab-ci.yml", "compose.prod.yml", "x.service", "a.py"]
    return spark.createDataFrame([(p,) for p in paths], "path string").withColumn("kind", cicd.file_type("path"))


WEB = {
    "main.go": 'package m\nimport "github.com/gin-gonic/gin"\nfunc main() {\n\tr := gin.Default()\n\tr.GET("/a", getA)\n\tr.POST("/b", h.CreateB)\n}\n',
    "root.go": 'package c\nimport "github.com/spf13/cobra"\nvar c = &cobra.Command{Use: "serve [x]", RunE: run}\nvar d = &cobra.Command{Use: "no"}\n',
    "app.py": "from fastapi import FastAPI\napp = FastAPI()\n@app.get('/x')\nasync def x():\n    pass\n@other\ndef y():\n    pass\n",
    "urls.py": "from django.urls import path, include\nurlpatterns = [path('a', views.a), path('b', include('b.urls'))]\nclass V(ListView):\n    pass\n",
}


@planted("framework kind name file line confidence", [
    ("gin", "route-handler", "getA", "main.go", 5, 0.9), ("gin", "route-handler", "h.CreateB", "main.go", 6, 0.9), ("cobra", "command", "serve", "root.go", 3, 0.85), ("fastapi", "route-handler", "x", "app.py", 4, 0.9),
    ("django", "url-pattern", "views.a", "urls.py", 2, 0.9), ("django", "view", "V", "urls.py", 3, 0.85),
])
def framework_entries(spark):
    """FW1-FW4, J26: functions that frameworks call."""
    return frameworks.framework_entries(tree(spark, WEB))


@planted("rule_id framework n", [
    ("framework-entry-point", "gin", 2), ("framework-entry-point", "cobra", 1), ("framework-entry-point", "fastapi", 1), ("framework-entry-point", "django", 2), ("framework-detected", "gin", 1),
    ("framework-detected", "cobra", 1), ("framework-detected", "fastapi", 1), ("framework-detected", "django", 1),
])
def framework_findings(spark):
    """FW5, A28: a finding each, and one for each framework."""
    return frameworks.framework_findings(frameworks.framework_entries(tree(spark, WEB))).groupBy("rule_id", "framework").agg(F.count("*").alias("n"))


LAYERS = {
    "api/h.go": 'package api\n\nimport "example.com/app/db"\n\nimport "example.com/app/service"\n', "db/repo.go": 'package db\n', "service/s.go": 'package service\nimport "example.com/app/domain"\n',
    "domain/d.go": 'package domain\nimport "example.com/app/service"\n', "other/x.go": 'package other\nimport "example.com/app/db"\n',
}


@planted("rule_id file start_line severity message", [
    ("boundary-violation", "api/h.go", 3, "error", "zone `presentation` imports from zone `infrastructure` via `example.com/app/db` (forbidden by architecture rules)"),
    ("boundary-violation", "domain/d.go", 2, "error", "zone `domain` imports from zone `application` via `example.com/app/service` (forbidden by architecture rules)"),
    ("circular-dependency", "domain/d.go", 1, "warning", "circular dependency detected (2 files): domain/d.go -> service/s.go"),
])
def architecture_findings(spark):
    """Imports between zones, and circles of files."""
    files = tree(spark, LAYERS)
    return fi.architecture(files.select("path"), T.imports(T.parse_files(files)))


@planted("from_zone to_zone file", [("a", "b", "api/h.go")])
def architecture_configured(spark):
    """Zones and rules from settings; the first rule that fits decides."""
    files = tree(spark, LAYERS)
    config = {"zone.a": "api/**, other/**", "zone.b": "db/**", "allow.b.a": "", "deny.a.b": "", "zone.c": "other/**"}
    found = fi.architecture(files.where("path <> 'other/x.go'").select("path"), T.imports(T.parse_files(files.where("path <> 'other/x.go'"))), config)
    return found.where("rule_id = 'boundary-violation'").select(F.col("metadata")["from_zone"].alias("from_zone"), F.col("metadata")["to_zone"].alias("to_zone"), "file")


@planted("name zones rules", [("layered", 27, 6), ("hexagonal", 14, 2), ("feature-sliced", 8, 2), ("clean", 26, 6)])
def architecture_presets(spark):
    """Presets with their folders and rules."""
    return spark.createDataFrame([(n, len(z), len(r)) for n in fi.PRESETS for z, r in [fi.preset(n)]], "name string, zones int, rules int")


# -- fixes -------------------------------------------------------------------

ACTIONS = f"finding int, module_id string, rule_id string, actions {schema.ACTIONS}"


def _planned(spark):
    edit = lambda a, b, t="": [("fix", True, [("f", a, b, t)])]
    return spark.createDataFrame([
        (1, "dead-code", "unused-function", edit(1, 2)), (2, "dead-code", "unused-function", edit(2, 3)), (3, "dead-code", "unused-import", edit(5, 5)), (4, "cicd", "x", [("no", False, [])]),
        (5, "security", "xss", edit(7, 7)), (6, "complexity", "high-cyclomatic", []),
    ], ACTIONS)


@planted("finding file start_line end_line", [(1, "f", 1, 2), (2, "f", 2, 3), (3, "f", 5, 5), (5, "f", 7, 7)])
def fix_edits(spark):
    """FX1: the edits of actions that can be applied."""
    return fixes.planned_edits(_planned(spark))


@planted("finding applied reason", [(1, False, "conflicting edits"), (2, False, "conflicting edits"), (3, True, "applied"), (4, False, "no auto-fix available")])
def fix_outcomes(spark):
    """FX2, FX3, FX5, J18: what applying the fixes of modules that have some comes to."""
    return fixes.outcomes(fixes.fixable(_planned(spark)))


@planted("finding reason", [(3, "dry run")])
def fix_one_rule(spark):
    """F6, FX5: the fixes of one rule, without applying them."""
    return fixes.outcomes(fixes.fixable(_planned(spark), "dead-code:unused-import"), dry_run=True)


@planted("module_id n", [("security", 1)])
def fix_refused(spark):
    """FX5: findings that their module refuses to fix."""
    return fixes.refused(_planned(spark))


@planted("finding", [(1,), (2,), (3,), (5,)])
def fix_candidates(spark):
    """findings with an action that can be applied."""
    return fixes.with_fixes(_planned(spark))


@planted("path content", [("f", "1\n2\n3\n4\nsix\n7\n")])
def fix_files(spark):
    """FX4, O5, K3: edits applied from the bottom up."""
    edits = spark.createDataFrame([("f", 5, 5, ""), ("f", 6, 6, "six\n")], "file string, start_line int, end_line int, new_text string")
    return fixes.fixed_files(tree(spark, {"f": "1\n2\n3\n4\n5\n6\n7\n", "g": "x\n"}), edits)


# -- coverage, workspaces, configuration -------------------------------------

LCOV = "SF:a.go\nDA:1,1\nDA:2,0\nDA:5,3\nLF:3\nLH:2\nend_of_record\nSF:b.go\nDA:1,1\nDA:1,2\nLF:1\nLH:4\nend_of_record\n"
DIFF = "diff --git a/a.go b/a.go\n--- a/a.go\n+++ b/a.go\n@@ -1,2 +1,3 @@\n x\n+y\n z\n@@ -9 +10,2 @@\n-o\n+p\n+q\ndiff --git a/d b/d\n--- a/d\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\n"


@planted("path line hits", [("a.go", 1, 1), ("a.go", 2, 0), ("a.go", 5, 3), ("b.go", 1, 1), ("b.go", 1, 2)])
def lcov_lines(spark):
    """Lines and hits of a coverage file."""
    return manifests.lcov(numbered(spark, LCOV))


@planted("path problem", [("b.go", "repeated line")])
def lcov_problems(spark):
    """Blocks that break the format's rules."""
    return manifests.lcov_problems(numbered(spark, LCOV))


@planted("path line", [("a.go", 2), ("a.go", 10), ("a.go", 11)])
def diff_lines(spark):
    """Lines that a diff adds."""
    return manifests.diff_lines(numbered(spark, DIFF))


@planted("path instrumented covered percent", [("a.go", 1, 0, 0.0)])
def diff_coverage(spark):
    """Coverage of the lines that a diff adds."""
    return diffs.changed_line_coverage(manifests.diff_lines(numbered(spark, DIFF)), manifests.lcov(numbered(spark, LCOV)))


@planted("kind path", [("kept", "a.go"), ("kept", "a.go"), ("kept", "a.go"), ("dropped", "b.go")])
def lcov_eligible(spark):
    """coverage of tracked files, and what isn't tracked."""
    kept, dropped = snapshots.eligible(manifests.lcov(numbered(spark, LCOV)), spark.createDataFrame([("a.go",), ("c.go",)], "path string"))
    return kept.select(F.lit("kept").alias("kind"), "path").unionByName(dropped.select(F.lit("dropped").alias("kind"), "path"))


@planted("path line", [("a.go", 5)])
def lcov_out_of_range(spark):
    """Lines that a file hasn't."""
    return snapshots.lines_out_of_range(manifests.lcov(numbered(spark, LCOV)), spark.createDataFrame([("a.go", 4)], "path string, total_lines int"))


@planted("grp instrumented covered passed worst_path", [("core", 12, 11, False, "core/b.go"), ("edge", 4, 4, True, "edge/c.go")])
def boundary_gate(spark):
    """PO2, A19: coverage of groups of files that must hold."""
    per = spark.createDataFrame([("core/a.go", 10, 10, 100.0), ("core/b.go", 2, 1, 50.0), ("edge/c.go", 4, 4, 100.0)], "path string, instrumented int, covered int, percent double")
    members, _ = snapshots.trust_boundary(per.select("path"), [("core", "core/*"), ("edge", "edge/*"), ("none", "gone/*")])
    return snapshots.boundary_gate(per, members)


@planted("kind path", [
    ("go", "api"), ("go", "web"), ("cargo", "crates/a"), ("cargo", "crates/b"), ("npm", "packages/x"), ("pnpm", "apps/web"), ("python", "py"), ("gradle", "lib/core"), ("gradle", "app"),
])
def workspace_members(spark):
    """Members of six kinds of workspaces."""
    found = manifests.workspaces({
        "go.work": "go 1.22\nuse (\n\t./api\n\t./web // x\n)\n", "Cargo.toml": '[workspace]\nmembers = ["crates/*"]', "crates/a/Cargo.toml": "", "crates/b/c/d": "", "package.json": '{"workspaces": ["packages/x"]}',
        "pnpm-workspace.yaml": "packages:\n  - 'apps/*'\n", "apps/web/i.ts": "", "settings.gradle": "include ':lib:core', ':app'", "pyproject.toml": '[tool.uv.workspace]\nmembers = ["py"]',
    })
    return spark.createDataFrame(found, "kind string, path string")


@planted("path", [("api",)])
def workspace_changed(spark):
    """members that hold a changed file, by prefix."""
    return manifests.changed_workspaces(spark.createDataFrame([("api",), ("web",)], "path string"), spark.createDataFrame([("api2/x.go",)], "file string"))


@planted("section key value", [
    ("health", "max_cyclomatic", "20"), ("health", "max_cognitive", "15"), ("health", "min_score", "5"), ("audit", "gate", "all"), ("audit", "warn", "1"), ("audit", "fail", "5"),
    ("duplication", "min_tokens", "50"), ("duplication", "mode", "weak"), ("project", "ignore", "[]"),
])
def configuration(spark):
    """Settings over their defaults."""
    found = manifests.load_config('[health]\nmin-score = 5\n[audit]\ngate = "all"\n[duplication]\nmode = "weak"\n')
    return spark.createDataFrame([(s, k, str(v)) for s, part in found.items() for k, v in part.items()], "section string, key string, value string")


@planted("tool section key value", [
    ("knip", "project", "entry", '["a.ts"]'), ("knip", "project", "ignore", '["gen/**", "left-pad"]'), ("knip", "rules", "unused-function", '"error"'), ("knip", "rules", "unused-import", '"error"'),
    ("knip", "rules", "unused-file", '"warn"'), ("jscpd", "duplication", "min-tokens", "70"), ("jscpd", "duplication", "mode", '"mild"'), ("golangci", "project", "ignore", '["vendor/**"]'),
    ("golangci", "rules", "high-cyclomatic", '"error"'), ("golangci", "health", "max-cyclomatic", "12"), ("golangci", "framework", "go", "[]"), ("RUFF", "rules", "unused-import", '"error"'),
    ("RUFF", "rules", "unused-function", '"warn"'), ("RUFF", "health", "max-cyclomatic", "9"), ("RUFF", "framework", "python", "[]"), ("importlinter", "arch", "zone.web", '"web/**"'),
    ("importlinter", "arch", "zone.core", '"core/**"'), ("importlinter", "arch", "allow.web.core", '""'), ("importlinter", "arch", "deny.core.web", '""'), ("importlinter", "framework", "python", "[]"),
])
def foreign_settings(spark):
    """Settings from the configuration of five other tools."""
    files = {
        "package.json": '{"knip": {"entry": ["a.ts"], "ignore": ["gen/**"], "ignoreDependencies": ["left-pad"], "vite": {}}}', ".jscpd.json": '{"minLines": 5, "minTokens": 70, "threshold": 1}',
        ".golangci.yml": "run:\n  skip-dirs:\n    - vendor\nlinters:\n  enable:\n    - gocyclo\n    - lll\nlinters-settings:\n  gocyclo:\n    min-complexity: 12\n",
        "pyproject.toml": '[tool.ruff]\nline-length = 99\n[tool.ruff.lint]\nselect = ["E", "F401"]\n[tool.ruff.lint.mccabe]\nmax-complexity = 9\n',
        ".importlinter": "[importlinter]\nroot_package = app\n[importlinter:contract:1]\ntype = layers\nlayers =\n    web\n    core\n[importlinter:contract:2]\ntype = forbidden\nsource_modules = core\nforbidden_modules = web\n",
    }
    out = None
    for tool in ("knip", "jscpd", "golangci", "RUFF", "importlinter"):
        part = foreign.settings_table(spark, foreign.import_settings(tool, files)[0]).withColumn("tool", F.lit(tool))
        out = part if out is None else out.unionByName(part)
    return out


@planted("path", [("src/a.go",), ("docs/x.md",)])
def ignore_files(spark):
    """Patterns of ignore files; comments and blank lines are none, a folder's pattern holds what is in it."""
    patterns = discovery.ignore_patterns({".gitignore": "# made\n\ngen/**\n*.tmp\n", ".codeprismignore": "  docs/private/**  \n"}, ["src/old/**"])
    paths = ["src/a.go", "gen/b.go", "gen", "x.tmp", "docs/private/y.md", "docs/x.md", "src/old/c.go"]
    return discovery.not_ignored(spark.createDataFrame([(p,) for p in paths], "path string"), patterns)


@planted("case_name ok", [("valid", True), ("too high", False), ("no group", False), ("not toml", False)])
def coverage_policies(spark):
    """PO1: a policy that can't be used is refused."""
    def ok(text: str) -> bool:
        try:
            return bool(manifests.coverage_policy(text))
        except ValueError:
            return False

    cases = {"valid": "[thresholds]\noverall = 85\n[trust-boundary]\ncore = ['a/*']", "too high": "[thresholds]\noverall = 185\n[trust-boundary]\nx = ['a']", "no group": "[thresholds]\noverall = 5", "not toml": "["}
    return spark.createDataFrame([(k, ok(v)) for k, v in cases.items()], "case_name string, ok boolean")


@planted("path ok", [("a/b.json", True), ("/a", False), ("../a", False), ("a/../b", False), ("C:\\a", False)])
def state_paths(spark):
    """State files stay inside the project."""
    def ok(path: str) -> bool:
        try:
            return manifests.safe_relative(path) == path
        except ValueError:
            return False

    return spark.createDataFrame([(p, ok(p)) for p in ("a/b.json", "/a", "../a", "a/../b", "C:\\a")], "path string, ok boolean")


# -- registry and output -----------------------------------------------------


@planted("module_id rule_id severity", [
    ("dead-code", "unused-import", "warning"), ("ai-quality", "unfinished-stub", "warning"), ("cicd", "dockerfile-unpinned-base", "warning"), ("cicd", "dockerfile-run-as-root", "warning"),
])
def all_modules(spark):
    """U1, RG1-RG3: the findings of all modules over one parse."""
    return registry.default_registry().analyse_all(tree(spark, {"a.py": "import os\n\ndef todo():\n    pass\n", "Dockerfile": "FROM x:latest\n"}))


@planted("module_id rules", [
    ("dead-code", 5), ("complexity", 3), ("duplication", 2), ("security", 9), ("arch", 2), ("ai-quality", 7), ("llm-defense", 6), ("cicd", 17), ("frameworks", 2), ("hotspot", 2), ("audit", 3), ("impact", 2),
    ("autofix", 2), ("telemetry", 4),
])
def module_rules(spark):
    """RG1, RG2: modules and how many rules each has."""
    return registry.rules_table(spark).groupBy("module_id").agg(F.count("*").alias("rules"))


@planted("rule_id file start_line severity message", [("unused-import", "a.py", 1, "warning", "an import whose names aren't used in its file: os")])
def finding_codec(spark):
    """RG4: findings to JSON and back in the engine's schema."""
    found = registry.default_registry().analyse("dead-code", tree(spark, {"a.py": "import os\n"}))
    back = registry.decode(registry.encode(registry.to_schema(found)))
    return back.select("rule_id", "location.file", "location.start_line", "severity", "message")


@planted("rule_id start_line message", [
    ("new-finding", 2, "new issue: r in f at line 2"), ("new-finding", 2, "new issue: r in f at line 2"), ("score-regression", 1, "finding count increased by 1 (baseline: 2, current: 3)"),
    ("threshold-exceeded", 1, "audit verdict: FAIL (2 relevant findings exceed threshold 2)"),
])
def audit_report(spark):
    """AU1, AU2, A17, A18, J14: findings of an audit."""
    columns = "rule_id string, file string, start_line int, message string"
    current = spark.createDataFrame([("r", "f", 1, "m"), ("r", "f", 2, "m"), ("r", "f", 2, "m")], columns)
    baseline = spark.createDataFrame([("r", "f", 1, "m"), ("q", "f", 1, "m")], columns)
    return diffs.audit_findings(current, baseline, diffs.gate_mode("New_Only"), fail=2)


@planted("rule_id file severity confidence message", [
    ("refactoring-target", "a", "error", 0.9, "file `a` is a refactoring target (score: 50.0, commits: 2, avg cyclomatic: 25.0)"), ("hotspot", "x", "warning", 0.8, "file `x` is a hotspot (score: 30.0, commits: 30, avg cyclomatic: 1.0)"),
])
def hotspot_report(spark):
    """HS1, A5: findings of files that are complex and change often."""
    metrics = spark.createDataFrame([("a", 30), ("a", 20), ("b", 1)], "file string, cyclomatic int")
    return health.hotspot_findings(health.hotspots(spark.createDataFrame([("a", 2), ("x", 30), ("b", 0), ("y", 3)], "file string, commits int"), metrics))


@planted("metric baseline current delta direction", [("rule:r", 2.0, 1.0, "-1.0", "improved"), ("total_findings", 2.0, 1.0, "-1.0", "improved"), ("files_analyzed", 3.0, 3.0, "+0.0", "stable"), ("health_score", 90.0, 80.0, "-10.0", "degraded")])
def impact_table(spark):
    """A11, A12, IM1, S9: two snapshots as a table."""
    found = lambda n: spark.createDataFrame([("r", k) for k in range(n)], "rule_id string, k int")
    return snapshots.trend(snapshots.snapshot(found(2), "a", 3, 90.0), snapshots.snapshot(found(1), "b", 3, 80.0))


def _found(spark):
    rows = [("r:x", "a,b.go", 3, 4, "m <1>\nx", "error"), ("q", "c.go", 1, 1, "n", "info")]
    return spark.createDataFrame(rows, "rule_id string, file string, start_line int, end_line int, message string, severity string")


@planted("line", [("::error file=a_b.go,line=3,col=0::m <1> x (r:x)",), ("::notice file=c.go,line=1,col=0::n (q)",)])
def output_annotations(spark):
    """K1, PJ2: workflow annotations."""
    return formats.annotations(_found(spark))


@planted("rule severity begin path", [("r:x", "critical", 3, "a,b.go"), ("q", "minor", 1, "c.go")])
def output_codeclimate(spark):
    """K1, PJ1: quality-report issues."""
    x = F.from_json("issue", "check_name string, severity string, location struct<path: string, lines: struct<begin: int>>")
    return formats.codeclimate(_found(spark)).select(x.alias("x")).select(F.col("x.check_name").alias("rule"), "x.severity", F.col("x.location.lines.begin").alias("begin"), "x.location.path")


@planted("result", [
    ('{"ruleId":"r:x","level":"error","message":{"text":"m <1>\\nx"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"a,b.go"},"region":{"startLine":3,"endLine":4}}}]}',),
    ('{"ruleId":"q","level":"note","message":{"text":"n"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"c.go"},"region":{"startLine":1,"endLine":1}}}]}',),
])
def output_sarif(spark):
    """Analysis results, an object each."""
    return formats.sarif_results(_found(spark))


@planted("row", [("| [E] | a,b.go:3 | r:x | m &lt;1&gt;\nx |",), ("| [I] | c.go:1 | q | n |",)])
def output_comment(spark):
    """Rows of a review comment."""
    return formats.pr_comment(_found(spark))


@planted("line", [("a,b.go:3:error r:x m <1> x",), ("c.go:1:info q n",)])
def output_terminal(spark):
    """K1, O3: lines for a terminal."""
    return formats.terminal(_found(spark))


@planted("form text", [
    ("health", "Health: 85 (B), 2 files"), ("worst", "b.py 70 C"), ("badge", '{"schemaVersion": 1, "label": "health", "message": "85/100", "color": "green"}'), ("markdown", "No issues found."),
])
def output_health(spark):
    """Health as text, badge and an empty report."""
    files = spark.createDataFrame([("a.py", 100, "A"), ("b.py", 70, "C")], "file string, score int, grade string")
    lines = formats.health_lines(health.project_health(files), files, 1)
    rest = spark.createDataFrame([("badge", json.dumps(formats.badge(85))), ("markdown", formats.markdown(_found(spark).limit(0)).split("\n")[0])], "form string, text string")
    return lines.unionByName(rest)


# -- telemetry ---------------------------------------------------------------

POINTS = "seq long, name string, value double, labels map<string,string>, timestamp_ms long, provenance string"


def _points(spark):
    return spark.createDataFrame([
        (1, "a.b", 1.0, {"m": "x"}, 10, "trusted"), (2, "a.b", 2.5, {"m": "x"}, 20, "trusted"), (3, "c", 3.0, {}, 30, "trusted"), (4, "module.arch.cycles", 7.0, {}, 40, "untrusted"), (5, "module.arch.cycles", 8.0, {}, 50, "trusted"),
    ], POINTS)


def _calls(spark):
    return spark.createDataFrame([("arch", 1, 10, False), ("arch", 2, 30, True), ("cicd", 3, 5, False)], "module_id string, seq long, duration_ms long, had_error boolean")


@planted("name label_key value timestamp_ms", [("a.b", "m=x", 2.5, 20), ("c", "", 3.0, 30), ("module.arch.cycles", "", 8.0, 50)])
def metric_snapshot(spark):
    """The last value of each metric and label set."""
    return telemetry.snapshot(_points(spark))


@planted("line", [('a_b{m="x"} 2.5',), ("c 3",), ("module_arch_cycles 8",)])
def metrics_prometheus(spark):
    """TE7, K2: exposition lines."""
    return telemetry.prometheus(telemetry.snapshot(_points(spark)))


@planted("line", [("a.b:2.5|c|#m:x",), ("c:3|g",), ("module.arch.cycles:8|g",)])
def metrics_statsd(spark):
    """TE7, K2: StatsD lines by kind of metric."""
    return telemetry.statsd(telemetry.snapshot(_points(spark)), spark.createDataFrame([("a.b", "counter")], "name string, kind string"))


@planted("payload", [
    ('{"Namespace":"ns","MetricName":"a.b","Value":2.5,"Dimensions":[{"Name":"m","Value":"x"}]}',), ('{"Namespace":"ns","MetricName":"c","Value":3.0,"Dimensions":[]}',),
    ('{"Namespace":"ns","MetricName":"module.arch.cycles","Value":8.0,"Dimensions":[]}',),
])
def metrics_cloudwatch(spark):
    """TE7, K2: metric payloads."""
    return telemetry.cloudwatch(telemetry.snapshot(_points(spark)), "ns")


@planted("name payload", [
    ("a.b", '{"name":"a.b","gauge":{"dataPoints":[{"asDouble":2.5,"timeUnixNano":"20000000","attributes":[{"key":"m","value":{"stringValue":"x"}}]}]}}'),
    ("c", '{"name":"c","gauge":{"dataPoints":[{"asDouble":3.0,"timeUnixNano":"30000000","attributes":[]}]}}'),
    ("module.arch.cycles", '{"name":"module.arch.cycles","gauge":{"dataPoints":[{"asDouble":8.0,"timeUnixNano":"50000000","attributes":[]}]}}'),
])
def metrics_otlp(spark):
    """TE7, K2: open-telemetry payloads."""
    return telemetry.otlp(telemetry.snapshot(_points(spark)))


@planted("kind unit n", [("counter", "count", 10), ("histogram", "ms", 3), ("gauge", "ratio", 1), ("gauge", "ms", 1)])
def metric_definitions(spark):
    """TE2: the core metrics by kind and unit."""
    return telemetry.definitions(spark).groupBy("kind", "unit").agg(F.count("*").alias("n"))


@planted("name labels value", [
    ("module.call_duration_ms", "module_id=arch", 10.0), ("module.call_duration_ms", "module_id=arch", 30.0), ("module.call_duration_ms", "module_id=cicd", 5.0), ("module.error_total", "module_id=arch", 1.0),
    ("module.startup_duration_ms", "module_id=arch", 4.0), ("module.load_error_total", "error_type=io,module_id=cicd", 1.0), ("startup.total_duration_ms", "", 6.0),
    ("analysis.findings_total", "module_id=arch", 2.0), ("analysis.findings_by_severity", "module_id=arch,severity=error", 1.0), ("analysis.findings_by_severity", "module_id=arch,severity=info", 1.0),
    ("findings.new", "", 1.0), ("findings.resolved", "", 2.0), ("findings.unchanged", "", 3.0), ("findings.churn_rate", "", 0.25),
])
def recorded_points(spark):
    """TE3: points of calls, loads, findings and churn."""
    loads = spark.createDataFrame([("arch", 4, None), ("cicd", 2, "io")], "module_id string, duration_ms long, error_type string")
    found = spark.createDataFrame([("arch", "error"), ("arch", "info")], "module_id string, severity string")
    churn = spark.createDataFrame([(1, 2, 3, 0.25)], "new long, resolved long, unchanged long, rate double")
    out = telemetry.call_points(_calls(spark)).unionByName(telemetry.load_points(loads)).unionByName(telemetry.finding_points(found)).unionByName(telemetry.churn_points(churn))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("name", listed.alias("labels"), "value")


@planted("module_id last_duration_ms calls errors findings", [("arch", 30, 2, 1, 1), ("cicd", 5, 1, 0, 0), ("audit", 0, 0, 0, 0)])
def module_summaries(spark):
    """Modules with their calls, errors and findings."""
    modules = spark.createDataFrame([("arch",), ("cicd",), ("audit",)], "module_id string")
    return telemetry.module_summary(modules, _calls(spark), spark.createDataFrame([("arch", "r")], "module_id string, rule_id string"))


@planted("module_id key value", [("arch", "cycles", 8.0)])
def module_metrics(spark):
    """Own metrics of modules, by the prefix of their names."""
    return telemetry.module_metrics(_points(spark))


@planted("average_health files_analyzed findings", [(85.0, 12, 7)])
def module_overview(spark):
    """Mean health, most files, all findings."""
    return telemetry.overview(spark.createDataFrame([("a", 90.0, 10, 3), ("b", 80.0, 12, 4), ("c", None, 2, 0)], "module_id string, health double, files_analyzed long, findings long"))


@planted("module_id last_duration_ms finding_count", [("b", 0, 1)])
def scrubbed_modules(spark):
    """what users see of modules."""
    return telemetry.scrub(spark.createDataFrame([("a", 5, 0, 0), ("b", 7, 1, 0)], "module_id string, last_duration_ms int, finding_count int, metric_count int"), False)


@planted("run_id new resolved unchanged", [(1, 1, 0, 0), (2, 1, 0, 1), (4, 1, 2, 0)])
def run_deltas(spark):
    """A15, ST6, TE9: what came and went at each run."""
    return telemetry.deltas(spark.createDataFrame([(1, "r", "f", 1), (2, "r", "f", 1), (2, "r", "f", 2), (4, "q", "f", 1)], "run_id int, rule_id string, file string, start_line int"))


@planted("strategy rate same emit", [("on-change", 0.0, True, False), ("on-change", 0.0, False, True), ("rate", 1.0, True, True), ("rate", 0.0, True, False)])
def sampling_decisions(spark):
    """TE4: whether a run is sent."""
    rows = [("on-change", 0.0, True), ("on-change", 0.0, False), ("rate", 1.0, True), ("rate", 0.0, True)]
    return spark.createDataFrame([(*r, telemetry.should_sample(r[0], r[1], 1, 1 if r[2] else 2)) for r in rows], "strategy string, rate double, same boolean, emit boolean")


@planted("case_name audience backend rate strategy", [
    ("none", "user-only", "json-file", 1.0, "rate"), ("file", "operator-only", "otlp", 0.25, "on-change"), ("flag", "off", "otlp", 0.25, "on-change"), ("clamped", "on", "prometheus", 1.0, "rate"),
    ("bare name", None, None, None, None), ("not a number", None, None, None, None), ("not finite", None, None, None, None), ("bad second spelling", None, None, None, None), ("unknown backend", None, None, None, None),
])
def telemetry_settings(spark):
    """TE5: flags before files before defaults; what can't be understood is refused."""
    file = {"audience": "Operator_Only", "backend": "otel", "sampling-rate": "0.25", "sampling_strategy": "on_change"}
    cases = {
        "none": ({}, None), "file": (file, None), "flag": (file, "off"), "clamped": ({"audience": "on", "backend": "prom", "sampling_rate": "7"}, None), "bare name": ({"audience": "operator"}, None),
        "not a number": ({"sampling-rate": "much"}, None), "not finite": ({"sampling-rate": "nan"}, None), "bad second spelling": ({"sampling_rate": "x", "sampling-rate": "1"}, None), "unknown backend": ({"backend": "otlpz"}, None),
    }

    def row(config: dict, flag: str | None) -> tuple:
        try:
            s = telemetry.settings(config, flag)
        except ValueError:
            return (None,) * 4
        return s["audience"], s["backend"], s["sampling_rate"], s["sampling_strategy"]

    return spark.createDataFrame([(k, *row(*v)) for k, v in cases.items()], "case_name string, audience string, backend string, rate double, strategy string")


@planted("name provenance value last", [("a.b", "trusted", 1.0, False), ("a.b", "trusted", 2.5, False), ("c", "trusted", 3.0, False), ("module.arch.cycles", "untrusted", 7.0, False), ("module.arch.cycles", "trusted", 8.0, False), ("x", "untrusted", 9.0, True)])
def recorded_untrusted(spark):
    """TE1: points of extensions come after the store's own, untrusted."""
    store = _points(spark).select("seq", "name", "value", "labels", "provenance")
    more = spark.createDataFrame([("x", 9.0, {})], "name string, value double, labels map<string,string>")
    return telemetry.record(store, more).withColumn("last", F.col("seq") > 5)


@planted("title n", [("fixed", 7), ("Findings of arch", 1), ("Findings of cicd", 1)])
def dashboard_panels(spark):
    """TE8: the fixed panels and one for each module."""
    panels = telemetry.dashboard(spark, spark.createDataFrame([("cicd",), ("arch",), ("arch",)], "module_id string"))
    return panels.groupBy(F.when(F.col("title").startswith("Findings of "), F.col("title")).otherwise("fixed").alias("title")).agg(F.count("*").alias("n"))


@planted("case_name file commits", [("json", "a", 3), ("json", "b", 4), ("entries", "c", 5), ("broken json", "d", 6)])
def commit_settings(spark):
    """Commits by file from settings."""
    cases = {"json": {"commit-counts": '{"a": 3, "b": 4}', "commits:z": "9"}, "entries": {"commits:c": "5", "commits:e": "x", "other": "1"}, "broken json": {"commit-counts": "{", "commits:d": "6"}}
    out = None
    for name, config in cases.items():
        part = health.commit_counts(spark, config).withColumn("case_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@planted("rule_id message", [("backend-status", "backend otlp: enabled"), ("metric-summary", "metric a.b: 2 points"), ("metric-summary", "metric c: 1 points"), ("metric-summary", "metric module.arch.cycles: 2 points")])
def telemetry_report(spark):
    """TE6, F15: findings of the telemetry module, as operators see them."""
    return telemetry.telemetry_findings(spark, spark.createDataFrame([("otlp", True)], "name string, enabled boolean"), _points(spark), "operator-only")


# -- files, state and streams in the shared folder ---------------------------


def folder(spark: SparkSession) -> str:
    return f"{graph.shared_dir(spark)}/planted-{uuid.uuid4().hex}"


def written(spark: SparkSession, files: dict[str, bytes]) -> str:
    """A folder with these files."""
    from pyarrow import fs

    root = folder(spark)
    store, base = fs.FileSystem.from_uri("file://" + root.removeprefix("file:").removeprefix("//") if root.startswith("file:") else root if "://" in root else f"file://{root}")
    for name, content in files.items():
        store.create_dir(f"{base}/{name}".rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(f"{base}/{name}", compression=None) as f:
            f.write(content)
    return root


SCANNED = {
    "a.go": b"package a", "sub/b.py": b"x = 1\xff\n", "node_modules/c.js": b"x", "d.txt": b"no", ".env": b"A=1", "requirements.txt": b"flask==1.0\n", "Dockerfile": b"FROM x", "gen/e.go": b"package e",
    "pkg/__init__.py": b"", ".github/workflows/a.yml": b"on: push", ".gitignore": b"# made\ngen/**\n",
}


@planted("path language content", [("a.go", "go", "package a"), ("pkg/__init__.py", "python", ""), ("sub/b.py", "python", "x = 1\ufffd\n")])
def scan_sources(spark):
    """Sources of a tree; skipped and ignored folders aside, what isn't UTF-8 replaced."""
    return discovery.source_files(spark, written(spark, SCANNED))


@planted("path", [(".env",), (".github/workflows/a.yml",), ("a.go",), ("gen/e.go",), ("pkg/__init__.py",), ("requirements.txt",), ("sub/b.py",)])
def scan_security(spark):
    """What the security scan reads, each path once."""
    return discovery.security_files(spark, written(spark, SCANNED))


@planted("path", [(".github/workflows/a.yml",)])
def scan_configuration(spark):
    """Pipeline configuration; ignored parts of paths aside."""
    return discovery.cicd_files(spark, written(spark, SCANNED), ["ocker"])


@planted("rule_id file start_line", [("r", "f", 3)])
def read_findings(spark):
    """Findings from JSON files; a file that doesn't parse is left out."""
    root = written(spark, {"a.json": b'[{"rule_id": "r", "file": "f", "start_line": 3}]', "b.json": b"[{"})
    return manifests.read_json_findings(spark, f"{root}/*.json", "rule_id string, file string, start_line int")


@planted("kind name value", [("baseline", "r:f:3", None), ("snapshot", "rule:r", 1.0), ("event", "export", None), ("event", "delete", None), ("mine", "export", None)])
def state_round_trip(spark):
    """Baseline, snapshot and event log, written and read back; a log by user."""
    root = folder(spark)
    found = spark.createDataFrame([("r", "f", 3, "m")], "rule_id string, file string, start_line int, message string")
    state.save_baseline(found, f"{root}/baseline")
    base = state.load_baseline(spark, f"{root}/baseline")
    assert state.load_baseline(spark, f"{root}/none").count() == 0
    state.save(snapshots.snapshot(found, "a", 1), f"{root}/snapshots")
    kept = state.load(spark, f"{root}/snapshots", state.SNAPSHOT).where("name = 'rule:r'")
    state.append_event(spark, f"{root}/log", event="export", timestamp_ms=1, user="ann")
    state.append_event(spark, f"{root}/log", event="delete", timestamp_ms=2, user="bob")
    none = F.lit(None).cast("double")
    out = base.select(F.lit("baseline").alias("kind"), F.concat_ws(":", "rule_id", "file", "start_line").alias("name"), none.alias("value"))
    out = out.unionByName(kept.select(F.lit("snapshot").alias("kind"), "name", "value"))
    for kind, log in (("event", state.read_events(spark, f"{root}/log")), ("mine", state.read_events(spark, f"{root}/log", "ann"))):
        out = out.unionByName(log.select(F.lit(kind).alias("kind"), F.col("event").alias("name"), none.alias("value")))
    return out


@planted("rule_id file", [("unused-import", "b.py")])
def watched_changes(spark):
    """ST1: findings of the latest content of files that a stream brings."""
    root = folder(spark)
    columns = "path string, content string, language string, changed_at long"
    spark.createDataFrame([("a.py", "import os\n", "python", 1), ("a.py", "x = 1\n", "python", 2), ("b.py", "import re\n", "python", 1)], columns).coalesce(1).write.parquet(f"{root}/changes")
    streams.watch(spark.readStream.schema(columns).parquet(f"{root}/changes"), deadcode.dead_code, f"{root}/found", f"{root}/log").awaitTermination()
    return spark.read.parquet(f"{root}/found")


@planted("batch_id change start_line", [(0, "new", 1), (0, "new", 2), (1, "new", 3), (1, "resolved", 1)])
def streamed_churn(spark):
    """ST3: what comes and goes from batch to batch."""
    root, columns = folder(spark), "rule_id string, file string, start_line int"
    for batch in ([("r", "f", 1), ("r", "f", 2)], [("r", "f", 2), ("r", "f", 3)]):
        spark.createDataFrame(batch, columns).coalesce(1).write.mode("append").parquet(f"{root}/prints")
        streams.churn_by_batch(spark.readStream.schema(columns).parquet(f"{root}/prints"), f"{root}/state", f"{root}/churn", f"{root}/log").awaitTermination()
    return spark.read.parquet(f"{root}/churn")
