"""Source rules on small trees written for the tests."""

import pytest

from codeprism.operators import ai_quality, cicd, deadcode, prompt_safety, taint
from codeprism.parse import tables as T
from codeprism.parse.brace_source import parse_go, parse_java, parse_script
from codeprism.parse.python_source import parse as parse_python

GO_MAIN = """package main

import (
\t"fmt"
\t"os"
)

func main() {
\tfmt.Println(helper())
}

func unused() {}

func Exported() {}
"""
GO_UTIL = """package main

// codeprism:ignore unused-function
func orphan() {}

func helper() int { return 1 }
"""
PY_APP = """import os
import json as j
from pathlib import Path, PurePath

def run(x):
    return j.dumps(x)

def _unused():
    return Path

class _Old:
    pass
"""
HANDLER = """package h

func Complex(a int, b int) int {
\tif a > 0 {
\t\tif b > 0 {
\t\t\tfor i := 0; i < a; i++ {
\t\t\t\tif i == b && a > 1 {
\t\t\t\t\tuse(i)
\t\t\t\t}
\t\t\t}
\t\t} else if b < 0 || a == 3 {
\t\t\tswitch a {
\t\t\tcase 1:
\t\t\t\treturn 1
\t\t\tdefault:
\t\t\t\treturn 2
\t\t\t}
\t\t}
\t}
\treturn 0
}

func Simple() {}
"""


def found(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_dead_code(files):
    tree = files({"main.go": GO_MAIN, "util.go": GO_UTIL, "app.py": PY_APP, "x.rs": "fn a() {}", "n.py": None})
    rows = found(deadcode.dead_code(tree), "rule_id", "file", "name")
    assert rows == [
        ("stale-suppression", "util.go", "// codeprism:ignore unused-function"), ("unused-function", "app.py", "_unused"), ("unused-function", "main.go", "unused"),
        ("unused-import", "app.py", "os"), ("unused-import", "main.go", "os"), ("unused-type", "app.py", "_Old"),
    ]
    loose = found(deadcode.dead_code(tree, strict_stale=False), "rule_id", "name")
    assert not [r for r in loose if r[0] == "stale-suppression"]


def test_dead_file_and_confidence(files):
    tree = files({"a.py": "def _x():\n    pass\n", "b.py": "def _y():\n    _x()\n", "__main__.py": "def _z():\n    pass\n"})
    rows = found(deadcode.dead_code(tree), "rule_id", "file", "name", "confidence")
    assert ("unused-file", "a.py", "a.py", pytest.approx(0.8)) in rows
    assert ("unused-function", "a.py", "_x", pytest.approx(0.8)) in rows and ("unused-function", "b.py", "_y", 1.0) in rows
    assert not [r for r in rows if r[:2] == ("unused-file", "__main__.py")]


def test_go_metrics():
    p = parse_go(HANDLER)
    assert p.functions == [("Complex", 3, 21, 10, 19, 4), ("Simple", 23, 23, 1, 0, 0)]
    assert parse_go("").symbols == [] and parse_go("func (").symbols == []


def test_python_metrics():
    source = "def f(x):\n    if x and x and x:\n        for i in x:\n            with i:\n                pass\n    elif x:\n        while 1:\n            pass\n    try:\n        pass\n    except E:\n        pass\n"
    (name, start, end, cyc, cog, deep), = parse_python(source).functions
    assert (name, start, end, cyc, deep) == ("f", 1, 12, 9, 3)
    assert cog == 1 + 2 + 2 + 3 + 1 + 3 + 1
    bad = parse_python("def ok(): pass\nclass (:\nimport os\n")
    assert bad.error and bad.symbols[0][0] == "ok" and bad.imports[0][0] == "os"


def test_script_and_java():
    js = parse_script("import a, {b as c} from 'x';\nexport function f() {}\nclass K { m() { g() } }")
    assert [s[:2] + s[4:] for s in js.symbols] == [("f", "function", True), ("K", "type", False)] and js.imports == [("x", None, ["a", "c"], 1)]
    assert [s[0] for s in parse_script("export function f() {} function g() {}", exported=False).symbols] == ["g"]
    java = parse_java("import static a.B.c; public class K { public K() {} private int m(int x) { return n(x); } }")
    assert [(s[0], s[1], s[4]) for s in java.symbols] == [("K", "type", True), ("K", "function", True), ("m", "function", False)]
    assert parse_java("import static a.B.c;", keep_static=True).imports[0][0] == "static a.B.c"


def test_suppression_scan():
    text = 'x = "# codeprism:ignore"\ny # codeprism:ignore unused-function, b\n"""\n# codeprism:ignore\n""" # codeprism:ignore *'
    assert [x[:2] for x in T.scan_suppressions(text, "python")] == [(2, ["unused-function", "b"]), (5, [])]
    assert [x[0] for x in T.scan_suppressions("a := `\n// codeprism:ignore\n` // codeprism:ignore", "go")] == [3]


def test_quarantine(files):
    assert found(T.quarantine(T.parse_files(files({"a.py": "def (", "b.py": "x = 1"}))), "path") == [("a.py",)]


def test_taint(files):
    go = 'package v\n\nfunc H(w http.ResponseWriter, r *http.Request) {\n\tid := r.FormValue("id")\n\tdb.Query("SELECT " + id)\n\tcmd := "x" + id\n\texec.Command(cmd)\n\tsafe := "x"\n\tos.Open(safe)\n}\n'
    py = "def f(request):\n    q = request.args.get('q')\n    cursor.execute(f'x {q}')\n    open(q)\n\ndef clean():\n    open('a')\n"
    rows = found(taint.taint(files({"v.go": go, "v.py": py, "e.py": ""})), "rule_id", "file", "start_line", "confidence")
    assert rows == [
        ("command-injection", "v.go", 7, pytest.approx(0.85)), ("path-traversal", "v.py", 4, pytest.approx(0.85)), ("sql-injection", "v.go", 5, pytest.approx(0.9)),
        ("sql-injection", "v.py", 3, pytest.approx(0.9)), ("sql-injection", "v.py", 3, pytest.approx(0.9)),
    ]


def test_prompt_safety(files):
    py = (
        "import openai\n\ndef tool_run(cmd):\n    subprocess.run(cmd)\n}\nos.system('x')\nprompt = f\"hi {user_name}\"\nresponse = client.messages.create(x)\n"
        "cursor.execute(response)\nwhile True:\n    agent.step()\ntool access: read and write\n"
    )
    rows = found(prompt_safety.prompt_safety(files({"b.py": py, "plain.py": "while True:\n    agent()\n"})), "rule_id", "start_line")
    assert rows == [
        ("excessive-tool-permissions", 12), ("missing-output-validation", 9), ("missing-output-validation", 9), ("missing-rate-limit", 8), ("prompt-injection-exposure", 7),
        ("unguarded-agent-loop", 10), ("unsafe-tool-use", 4),
    ]


def test_ai_quality(files):
    py = (
        "# login_required\ndef view():\n    phantom(1)\n    validate_token(2)\n    print('absent(')\n\ndef todo():\n    pass\n\n# check_auth(user)\nif False:\n    auth()\n"
        "try:\n    todo()\nexcept:\n    pass\nexcept KeyError:\n    pass\n"
    )
    rows = found(ai_quality.ai_quality(files({"a.py": py, "requirements.txt": "# x==99\nflask==99.1\nx>=5,<3\nok==1.0\n"})), "rule_id", "file", "start_line", "detail")
    assert ("phantom-api-call", "a.py", 3, "phantom") in rows and ("phantom-security-call", "a.py", 4, "validate_token") in rows
    assert ("missing-decorator", "a.py", 1, "login_required") in rows and ("unfinished-stub", "a.py", 7, "todo") in rows
    assert [r[2] for r in rows if r[0] == "disabled-control"] == [10, 11] and [r[2] for r in rows if r[0] == "impossible-dependency-version"] == [2, 3]
    assert len([r for r in rows if r[0] == "inconsistent-error-handling"]) == 1 and not [r for r in rows if r[3] == "absent"]


def test_cicd(files):
    tree = {
        "Dockerfile": "FROM ubuntu:latest\nRUN apt \\\n  # note\n  update\nADD https://x.y/z /z\nENV API_KEY=abc\nARG TOKEN=$T\nENV PASSWORD hunter2\n",
        "ok.dockerfile": "FROM scratch\nUSER app:app\n",
        ".github/workflows/a.yml": "on: pull_request_target\npermissions: write-all\njobs:\n  a:\n    steps:\n      - uses: actions/checkout@v4\n      - run: echo ${{ github.head_ref }}\n",
        ".gitlab-ci.yml": "image: python\nvariables:\n  DB_PASSWORD: secretvalue\ninclude:\n  - https://x/y.yml\njob:\n  script: [a]\n",
        "docker-compose.yml": "services:\n  app:\n    privileged: true\n    network_mode: host\n    volumes: ['/etc:/x', './a:/b']\n",
        "a.service": "[Service]\nExecStart=/x\n", "b.service": "[Service]\nUser=app\nProtectSystem=full\nProtectHome=yes\nNoNewPrivileges=yes\nPrivateTmp=yes\n",
        "compose.bad.yml": "a: [", "readme.md": "FROM x",
    }
    rows = found(cicd.cicd(files(tree)), "rule_id", "file", "start_line")
    assert rows == sorted([
        ("dockerfile-unpinned-base", "Dockerfile", 1), ("dockerfile-run-as-root", "Dockerfile", 1), ("dockerfile-remote-add", "Dockerfile", 5), ("dockerfile-secrets-in-layer", "Dockerfile", 6), ("dockerfile-secrets-in-layer", "Dockerfile", 8),
        ("actions-dangerous-trigger", ".github/workflows/a.yml", 1), ("actions-excessive-permissions", ".github/workflows/a.yml", 2), ("actions-unpinned-action", ".github/workflows/a.yml", 6), ("actions-script-injection", ".github/workflows/a.yml", 7),
        ("gitlab-mutable-image", ".gitlab-ci.yml", 1), ("gitlab-literal-secret", ".gitlab-ci.yml", 3), ("gitlab-unpinned-include", ".gitlab-ci.yml", 5), ("gitlab-insecure-runner", ".gitlab-ci.yml", 6),
        ("compose-privileged", "docker-compose.yml", 3), ("compose-host-network", "docker-compose.yml", 4), ("compose-host-mount", "docker-compose.yml", 5),
        ("systemd-root-execution", "a.service", 1), ("systemd-missing-hardening", "a.service", 1), ("unreadable-config", "compose.bad.yml", 1),
    ])
