import pytest

from codeprism import registry as R


def test_registry(files, spark):
    reg = R.default_registry()
    with pytest.raises(ValueError):
        reg.register("dead-code", lambda f: f)
    tree = files({"a.py": "import os\n\ndef todo():\n    pass\n", "Dockerfile": "FROM x:latest\n"})
    rows = {(r.module_id, r.rule_id, r.severity) for r in reg.analyse_all(tree).collect()}
    assert {("dead-code", "unused-import", "warning"), ("ai-quality", "unfinished-stub", "warning"), ("cicd", "dockerfile-unpinned-base", "warning")} <= rows
    assert [f.name for f in reg.analyse("dead-code", tree).schema] == [c.split()[0] for c in "module_id x,rule_id x,message x,severity x,file x,start_line x,end_line x,confidence x,actions x,metadata x".split(",")]
    assert set(reg.seconds) == set(reg.modules) and R.rules_table(spark).count() == sum(map(len, R.RULES.values()))


def test_security_unites_its_scans(files):
    """Secrets, key-like strings and vulnerable dependencies are found with taint; test paths hold no secrets."""
    key, odd = "AKIA" + "ABCDEFGHIJKLMNOP", "q7Xz9Lm2Vt4Rb8Kd1Wp6Hs3Yc5Nf0Gj"
    tree = files({
        "a.py": f"import os\n\ndef f(request):\n    x = request.args\n    os.system(x)\nk = '{key}'\nz = '{odd}'\n",
        "tests/b.py": f"k = '{key}'\nz = '{odd}'\n", "requirements.txt": "pyyaml==5.4\nflask==3.0.0\n",
    })
    rows = {tuple(r) for r in R.default_registry().analyse("security", tree).select("module_id", "rule_id", "file", "start_line", "severity").collect()}
    assert rows == {
        ("security", "command-injection", "a.py", 5, "error"), ("security", "hardcoded-secret", "a.py", 6, "error"), ("security", "high-entropy-string", "a.py", 7, "warning"),
        ("security", "vulnerable-dependency", "requirements.txt", 1, "error"),
    }


def test_explain():
    assert R.explain("security:xss")[0] == R.explain("xss")[0] == "security" and R.explain("unused-file")[2] == "info"
    with pytest.raises(KeyError):
        R.explain("cicd:xss")


def test_modules_that_need_more_than_files(files, spark):
    """Hotspot, audit, impact, autofix and telemetry read what a run gives them, and are empty without it."""
    reg = R.default_registry()
    tree = files({"a.py": "import os\n\ndef f(x):\n    if x and x:\n        return 1\n"})
    current = reg.analyse("dead-code", tree)
    columns = "name string, value double"
    inputs = R.Inputs(
        tree, commits=spark.createDataFrame([("a.py", 30)], "file string, commits int"), current=current, before=spark.createDataFrame([("total_findings", 1.0)], columns),
        after=spark.createDataFrame([("total_findings", 4.0)], columns), points=spark.createDataFrame([("m", 1.0)], columns),
    )
    got = {m: sorted(r.rule_id for r in reg.analyse(m, inputs).collect()) for m in ("hotspot", "audit", "impact", "autofix", "telemetry")}
    assert got == {"hotspot": ["refactoring-target"], "audit": ["new-finding", "score-regression"], "impact": ["metric-degraded"], "autofix": ["fix-available"], "telemetry": ["metric-summary"]}
    assert all(reg.analyse(m, tree).count() == 0 for m in got) and reg.counters["hotspot"] == {}
    with pytest.raises(ValueError):
        R.default_registry().analyse("audit", R.Inputs(tree, {"audit": {"baseline": "/etc/x"}}, current=current))
