"""Scans, manifests, coverage inputs, configuration and workspaces."""

import pytest

from codeprism.operators import diffs
from codeprism.operators.line_rules import numbered_lines
from codeprism.sources import discovery as D, foreign, manifests as M


@pytest.fixture
def root(tmp_path):
    for path, text in {
        "a.go": b"package a", "sub/b.py": b"x = 1\xff\n", "node_modules/c.js": b"x", "d.txt": b"no", ".env": b"A=1", "requirements.txt": b"Flask==2.0.0\nrequests[x]==2.31.0 ; y\nz>=1\n", "Dockerfile": b"FROM x",
        "gen/e.go": b"package e", "pkg/__init__.py": b"", ".github/workflows/a.yml": b"on: push",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(text)
    return str(tmp_path)


def paths(df):
    return sorted(r.path for r in df.collect())


def test_scans(spark, root):
    files = D.source_files(spark, root, ["gen"])
    assert paths(files) == ["a.go", "pkg/__init__.py", "sub/b.py"] and "\ufffd" in next(r.content for r in files.collect() if r.path == "sub/b.py")
    assert paths(D.security_files(spark, root)) == [".env", ".github/workflows/a.yml", "a.go", "gen/e.go", "pkg/__init__.py", "requirements.txt", "sub/b.py"]
    assert paths(D.cicd_files(spark, root)) == [".github/workflows/a.yml", "Dockerfile"] and paths(D.cicd_files(spark, root, ["ocker"])) == [".github/workflows/a.yml"]


def test_ignore_files(spark, root, tmp_path):
    (tmp_path / ".gitignore").write_text("# gone\n\nsub/**\n")
    (tmp_path / ".codeprismignore").write_text("a.go\n")
    assert paths(D.source_files(spark, root, ["gen"])) == ["pkg/__init__.py"]


def test_foreign_configuration():
    with pytest.raises(ValueError):
        foreign.tool_named("eslint")
    for tool, files in (("knip", {}), ("knip", {"knip.json": "{"}), ("ruff", {"ruff.toml": "["}), ("golangci-lint", {".golangci.yml": "a: ["}), ("import-linter", {".importlinter": "x"})):
        with pytest.raises(ValueError):
            foreign.import_settings(tool, files)
    assert foreign.import_settings("jscpd", {".jscpd.json": '{"minLines": 5, "reporters": []}'}) == ({"project": {}, "duplication": {"min-tokens": 50, "mode": "mild"}}, ["minLines: taken as 50 tokens", "reporters: no counterpart"])


def test_manifests(files):
    tree = files({
        "requirements.txt": "Flask==2.0.0\nrequests[x]==2.31.0 ; y\nPy_YAML==5.4\nz>=1\n", "go.mod": "module x\nrequire golang.org/x/net v0.20.0\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.1\n)\n",
        "Cargo.lock": '[[package]]\nname = "tokio"\nversion = "1.24.1"\n', "package-lock.json": '{"packages": {\n "node_modules/express": {\n  "version": "4.19.1"\n }}}', "other.txt": "flask==1.0",
    })
    deps = M.dependencies(tree)
    assert {(r.file, r.name, r.version) for r in deps.collect()} == {
        ("requirements.txt", "Flask", "2.0.0"), ("requirements.txt", "requests", "2.31.0"), ("requirements.txt", "Py_YAML", "5.4"), ("go.mod", "golang.org/x/net", "0.20.0"),
        ("go.mod", "github.com/gin-gonic/gin", "1.9.1"), ("Cargo.lock", "tokio", "1.24.1"), ("package-lock.json", "express", "4.19.1"),
    }
    assert {r.name for r in M.vulnerable_dependencies(deps).collect()} == {"Flask", "golang.org/x/net", "tokio", "express"}


def lines(files, text):
    return numbered_lines(files({"f": text})).withColumnsRenamed({"path": "file", "line_no": "n"})


def test_lcov_and_diff(files):
    lcov = lines(files, "SF:a.go\nDA:1,1\nDA:2,0\nDA:5,3\nLF:3\nLH:2\nend_of_record\nSF:b.go\nDA:1,1\nDA:1,2\nLF:1\nLH:4\nend_of_record\n")
    assert {(r.path, r.line, r.hits) for r in M.lcov(lcov).collect()} == {("a.go", 1, 1), ("a.go", 2, 0), ("a.go", 5, 3), ("b.go", 1, 1), ("b.go", 1, 2)}
    assert [(r.path, r.problem) for r in M.lcov_problems(lcov).collect()] == [("b.go", "repeated line")]
    diff = lines(files, "diff --git a/a.go b/a.go\n--- a/a.go\n+++ b/a.go\n@@ -1,2 +1,3 @@\n x\n+y\n z\n@@ -9 +10,2 @@\n-o\n+p\n+q\ndiff --git a/d b/d\n--- a/d\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\n")
    changed = M.diff_lines(diff)
    assert sorted((r.path, r.line) for r in changed.collect()) == [("a.go", 2), ("a.go", 10), ("a.go", 11)]
    per = diffs.changed_line_coverage(changed, M.lcov(lcov))
    assert [(r.path, r.instrumented, r.covered) for r in per.collect()] == [("a.go", 1, 0)]
    gate = diffs.coverage_gate(per, 85).collect()[0]
    assert (gate.percent, gate.passed, gate.worst_path) == (0.0, False, "a.go")


def test_config_and_policy():
    assert M.load_config(None)["health"]["min_score"] == 70 and M.load_config("[health]\nmin-score = 5")["health"]["min_score"] == 5
    for bad in ("[", "[duplication]\nmin-tokens = 0"):
        with pytest.raises(ValueError):
            M.load_config(bad)
    assert M.coverage_policy("[thresholds]\noverall = 85\n[trust-boundary]\ncore = ['a/*']")["thresholds"]["overall"] == 85
    for bad in ("[thresholds]\noverall = 185\n[trust-boundary]\nx = ['a']", "[thresholds]\noverall = 5"):
        with pytest.raises(ValueError):
            M.coverage_policy(bad)
    assert M.safe_relative("a/b.json") == "a/b.json"
    for bad in ("/a", "../a", "a/../b", "C:\\a"):
        with pytest.raises(ValueError):
            M.safe_relative(bad)


def test_workspaces(spark):
    tree = {
        "go.work": "go 1.22\nuse (\n\t./api\n\t./web // x\n)\n", "Cargo.toml": '[workspace]\nmembers = ["crates/*"]', "crates/a/Cargo.toml": "", "crates/b/c/d": "", "package.json": '{"workspaces": ["packages/x"]}',
        "pnpm-workspace.yaml": "packages:\n  - 'apps/*'\n", "apps/web/i.ts": "", "settings.gradle": "include ':lib:core', ':app'", "pyproject.toml": '[tool.uv.workspace]\nmembers = ["py"]',
    }
    assert M.workspaces(tree) == [
        ("go", "api"), ("go", "web"), ("cargo", "crates/a"), ("cargo", "crates/b"), ("npm", "packages/x"), ("pnpm", "apps/web"), ("python", "py"), ("gradle", "lib/core"), ("gradle", "app"),
    ]
    members = spark.createDataFrame([("api",), ("web",)], "path string")
    assert paths(M.changed_workspaces(members, spark.createDataFrame([("api2/x.go",)], "file string"))) == ["api"]


def test_json_findings(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"rule_id": "r", "file": "f", "start_line": 3}]')
    (tmp_path / "b.json").write_text("[{")
    rows = M.read_json_findings(spark, f"{tmp_path}/*.json", "rule_id string, file string, start_line int").collect()
    assert [tuple(r) for r in rows] == [("r", "f", 3)]
