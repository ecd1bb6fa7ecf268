"""Roll-ups, formats, fixes, frameworks, telemetry and streams."""

import json

import pytest
from pyspark.sql import functions as F

from codeprism.functions import scalars as S
from codeprism.operators import clones, diffs, findings as fi, fixes, frameworks, graph, health, telemetry
from codeprism.parse import tables as T
from codeprism.sinks import formats
from codeprism.streaming import streams


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_scalars(spark):
    df = spark.createDataFrame([("a\r\nb\n", "x/y.go.go"), ("", "z"), ("\n", "q.py")], "t string, p string")
    assert [r[0] for r in df.select(S.text_lines("t")).collect()] == [["a", "b"], [], [""]]
    assert [r[0] for r in df.select(S.strip_suffix_runs("p", ".go", ".py")).collect()] == ["x/y", "z", "q"]
    v = spark.createDataFrame([("1.2.3", "0", "1.10"), ("1.10", "", "1.10.0"), ("2-rc1", "2", ""), ("abc", "0", "0.1")], "v string, a string, b string")
    assert [r[0] for r in v.select(S.version_in_range("v", "a", "b")).collect()] == [True, False, True, True]
    e = spark.createDataFrame([("aaaa",), ("abcd",), ("",)], "s string")
    assert [round(r[0], 6) for r in e.select(S.shannon_entropy("s")).collect()] == [0, 2, 0]
    s = spark.createDataFrame([("ERR",), ("warn",), ("off",)], "s string")
    assert [r[0] for r in s.select(S.parse_severity("s")).collect()] == ["error", "warning", None]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (None, 1)], "a int, b int")
    assert rows(graph.reachable(e, spark.createDataFrame([(3,), (None,)], "node int")), "node") == [(1,), (2,), (3,), (4,), (5,)]
    assert rows(graph.strong_components(e)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert rows(graph.connected_components(e)) == [(i, 1) for i in range(1, 6)]
    none = e.limit(0)
    assert graph.strong_components(none).count() == graph.connected_components(none).count() == 0


@pytest.mark.parametrize("small", [graph.SMALL, 0])
def test_chained_cycles(spark, monkeypatch, small):
    """Cycles chained by one-way edges: all are found in few rounds, or an error says that rounds ran out."""
    monkeypatch.setattr(graph, "SMALL", small)
    n = 25 if small else 13
    e = spark.createDataFrame([x for i in range(1, n, 2) for x in ((i, i + 1), (i + 1, i), (i + 1, i + 2))], "a int, b int")
    assert rows(graph.strong_components(e, 9)) == sorted([(i, i - (i + 1) % 2) for i in range(1, n)], key=str)
    if not small:
        with pytest.raises(RuntimeError):
            graph.strong_components(e, 1)


def test_long_chain_and_cycle(spark):
    """5,000 nodes in a circle, and a chain of 5,000 behind it."""
    n = 5000
    e = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)] + [(i, i + 1) for i in range(n, 2 * n)] + [(0, n)], "a int, b int")
    assert rows(graph.strong_components(e).groupBy("component").count()) == [(0, n)]
    far = graph.reachable(e, spark.createDataFrame([(1,)], "node int"))
    assert far.count() == 2 * n + 1 and far.where(f"node = {2 * n}").first().depth == 2 * n


def test_walks_in_rounds_equal_walks_in_memory(spark, monkeypatch):
    import random

    rng = random.Random(1)
    e = spark.createDataFrame([(rng.randrange(60), rng.randrange(60)) for _ in range(90)], "a int, b int")
    seeds = spark.createDataFrame([(1,), (2,), (99,)], "node int")
    walks = lambda: (rows(graph.reachable(e, seeds)), rows(graph.strong_components(e)), rows(graph.connected_components(e)))
    memory = walks()
    monkeypatch.setattr(graph, "SMALL", 0)
    assert walks() == memory and all(memory)


def test_clones(spark, files):
    block = "\n".join(f"\tcall{i}(x{i})" for i in range(20))
    toks = T.token_table(files({"a.go": f"package a\n{block}\n", "b.go": f"package b\nvar z = 1\n{block}\n", "c.go": "package c\n"}))
    assert rows(clones.clone_families(toks, 30), "file", "start", "end", "pairs") == [("a.go", 2, 21, 51), ("b.go", 3, 22, 51)]
    assert rows(clones.clone_blocks(toks, 30), "file", "start", "end") == [("a.go", 2, 21), ("b.go", 3, 22)]
    again = clones.family_ids(clones.clone_families(toks.repartition(7), 30))  # the same for permuted input
    assert rows(again, "family_id", "occurrences") == rows(clones.family_ids(clones.clone_families(toks, 30)), "family_id", "occurrences")
    with pytest.raises(ValueError):
        clones.token_windows(toks, 0)
    renamed = files({"a.go": "package a\nx := foo(1, \"a\")\n", "b.go": "package b\ny := bar(2, \"b\")\n"})
    weak = [r.toks[2:] for r in T.token_table(renamed, "weak").collect()]
    assert weak[0] == weak[1] and T.token_table(renamed, "strict").select("toks").distinct().count() == 2


def test_clone_families_apart_and_capped(spark, files):
    """Two blocks that touch one file are two families; a report names so many, and says how many it leaves out."""
    block = lambda k: "".join(f"\tcall{k}_{i}(x{i})\n" for i in range(20))
    gap = "".join(f"var only{i} = {i}\n" for i in range(5))
    tree = files({"a.go": f"package a\n{block(1)}{gap}{block(2)}", "b.go": f"package b\n{block(1)}", "c.go": f"package c\nvar y = 2\n{block(2)}", "d.go": f"{block(2)}"})
    toks = T.token_table(tree)
    found = clones.clone_families(toks, 30)
    named = clones.family_ids(found)
    assert sorted([(o.file, o.start, o.end) for o in r.occurrences] for r in named.collect()) == [
        [("a.go", 2, 21), ("b.go", 2, 21)], [("a.go", 27, 46), ("c.go", 3, 22), ("d.go", 1, 20)],
    ]
    full = clones.duplication(tree, 30)
    assert sorted(r.rule_id for r in full.collect()) == ["duplicate-block", "duplicate-function"]
    assert clones.duplication(tree, 30, max_families=1).count() == 1 and clones.clone_counters(found, 1).first().truncated_families == 1
    longest = clones.longest_matches(toks, 30).groupBy("file").agg(F.max("length").alias("n"))
    assert rows(longest) == [("a.go", 80), ("b.go", 80), ("c.go", 80), ("d.go", 80)]


def test_clone_pairs_equal_brute_force(spark):
    """Pairs, families and longest matches of short random texts against all pairs of places."""
    import random

    rng = random.Random(7)
    n, texts = 4, {i: [rng.choice("abc") for _ in range(rng.randrange(0, 40))] for i in range(6)}
    toks = spark.createDataFrame(list(texts.items()), "file bigint, toks array<string>")
    places = [(f, p) for f, t in texts.items() for p in range(len(t) - n + 1)]
    pairs = [(x, y) for k, x in enumerate(places) for y in places[k + 1 :] if texts[x[0]][x[1] : x[1] + n] == texts[y[0]][y[1] : y[1] + n] and (x[0] != y[0] or abs(x[1] - y[1]) >= n)]

    def length(x, y):
        k = 0
        while x[1] + k < len(texts[x[0]]) and y[1] + k < len(texts[y[0]]) and texts[x[0]][x[1] + k] == texts[y[0]][y[1] + k]:
            k += 1
        return k

    assert clones.repeated_windows(toks, n).agg(F.sum("pairs")).first()[0] == len(pairs)
    covered = {(f, p + k) for x in pairs for f, p in x for k in range(n)}
    blocks = {(r.file, k) for r in clones.clone_blocks(toks, n).collect() for k in range(r.start, r.end + 1)}
    assert blocks == covered
    assert clones.longest_matches(toks, n).agg(F.max("length")).first()[0] == max(length(x, y) for x, y in pairs)
    assert clones.clone_families(toks, n).select("family", "pairs").distinct().agg(F.sum("pairs")).first()[0] == len(pairs)


def test_health(spark):
    m = spark.createDataFrame([("a", 30, 10, 50, 2, 1), ("a", 20, 40, 190, 6, 5), ("b", 1, 0, 3, 0, 1)], "file string, cyclomatic int, cognitive int, lines int, max_nesting int, start_line int")
    f = health.file_health(m)
    assert rows(f, "file", "cyclomatic_penalty", "cognitive_penalty", "size_penalty", "nesting_penalty", "score", "grade") == [("a", 15, 30, 4, 10, 41, "F"), ("b", 0, 0, 0, 0, 100, "A")]
    assert rows(health.project_health(f)) == [(70, 2, "C")] and rows(health.project_health(f.limit(0))) == [(100, 0, "A")]
    spots = health.hotspots(spark.createDataFrame([("a", 2), ("x", 30), ("b", 0)], "file string, commits int"), m)
    assert rows(spots, "file", "hotspot_score", "rule_id") == [("a", 50.0, "refactoring-target"), ("x", 30.0, "hotspot")]


def test_audit(spark):
    schema = "rule_id string, file string, start_line int, message string"
    cur = spark.createDataFrame([("r", "f", 1, "m"), ("r", "f", 2, "m"), ("r", "f", 2, "m"), (None, "f", 1, "m")], schema)
    base = spark.createDataFrame([("r", "f", 1, "m"), ("q", "f", 1, "m"), (None, "f", 1, "m")], schema)
    one = diffs.audit(cur, base).collect()[0]
    assert (one.new_count, one.resolved_count, one.total, one.score_delta, one.verdict) == (2, 1, 4, 1, "warn")
    assert diffs.audit(cur, base, new_only=False, fail=4).collect()[0].verdict == "fail" and diffs.audit(cur, cur, warn=0, fail=0).collect()[0].verdict == "pass"
    empty = cur.limit(0)
    assert tuple(diffs.churn(empty, empty, ("rule_id",)).collect()[0]) == (0, 0, 0, 0.0)
    assert diffs.fingerprint_set_hash(cur, diffs.KEY).collect() == diffs.fingerprint_set_hash(cur.orderBy(F.desc("start_line")).union(cur), diffs.KEY).collect()


def test_architecture(spark):
    zones, rules = fi.preset("layers")
    files = spark.createDataFrame([("api/h.go",), ("db/repo.go",), ("other/x.go",)], "path string")
    zoned = fi.zones_of(files, zones)
    assert rows(zoned) == [("api/h.go", "presentation"), ("db/repo.go", "infrastructure"), ("other/x.go", None)]
    imports = spark.createDataFrame([("api/h.go", "example.com/app/db"), ("api/h.go", "fmt")], "file string, import_path string")
    edges = fi.import_edges(files, imports)
    assert rows(edges) == [("api/h.go", "db/repo.go")] and fi.import_edges(files, imports, fixed=False).count() == 0
    a, b = zoned.select(F.col("path").alias("file"), F.col("zone").alias("from_zone")), zoned.select(F.col("path").alias("target"), F.col("zone").alias("to_zone"))
    assert fi.boundary_violations(edges.join(a, "file").join(b, "target"), rules).count() == 1
    assert set(fi.PRESETS) == {"layered", "hexagonal", "feature-sliced", "clean"}


def test_frameworks(files):
    tree = files({
        "main.go": 'package m\nimport "github.com/gin-gonic/gin"\nfunc main() {\n\tr := gin.Default()\n\tr.GET("/a", getA)\n\tr.POST("/b", h.CreateB)\n}\n',
        "root.go": 'package c\nimport "github.com/spf13/cobra"\nvar c = &cobra.Command{Use: "serve [x]", RunE: run}\nvar d = &cobra.Command{Use: "no"}\n',
        "app.py": "from fastapi import FastAPI\napp = FastAPI()\n@app.get('/x')\nasync def x():\n    pass\n@other\ndef y():\n    pass\n",
        "urls.py": "from django.urls import path, include\nurlpatterns = [path('a', views.a), path('b', include('b.urls'))]\nclass V(ListView):\n    pass\n",
    })
    e = frameworks.framework_entries(tree)
    assert rows(e, "framework", "kind", "name") == [
        ("cobra", "command", "serve"), ("django", "url-pattern", "views.a"), ("django", "view", "V"), ("fastapi", "route-handler", "x"), ("gin", "route-handler", "getA"), ("gin", "route-handler", "h.CreateB"),
    ]
    assert frameworks.framework_findings(e).where("rule_id = 'framework-detected'").count() == 4


def test_fixes(spark, files):
    assert fixes.apply_to_text("a\nb\nc\n", [(1, 1, ""), (3, 3, "x\ny\n")]) == "b\nx\ny\n" and fixes.apply_to_text("a", [(1, 1, "b")]) == "b"
    edit = lambda a, b, t="": (("fix", True, [("f", a, b, t)]),)
    schema = "finding int, actions array<struct<description: string, auto_fixable: boolean, edits: array<struct<file: string, start_line: int, end_line: int, new_text: string>>>>"
    found = spark.createDataFrame([(1, list(edit(1, 2))), (2, list(edit(2, 3))), (3, list(edit(5, 5))), (4, [("no", False, [])])], schema)
    assert rows(fixes.outcomes(found)) == [(1, False, "conflicting edits"), (2, False, "conflicting edits"), (3, True, "applied"), (4, False, "no auto-fix available")]
    assert rows(fixes.outcomes(found, dry_run=True))[2] == (3, False, "dry run")
    out = fixes.fixed_files(files({"f": "1\n2\n3\n4\n5\n"}), fixes.planned_edits(found.where("finding = 3")))
    assert rows(out) == [("f", "1\n2\n3\n4\n")]


def test_formats(spark):
    f = spark.createDataFrame([("r:x", "a,b.go", 3, 4, "m <1>\nx", "error"), ("q", "c.go", 1, 1, "n", "info")], "rule_id string, file string, start_line int, end_line int, message string, severity string")
    assert formats.fnv1a("") == "cbf29ce484222325" and formats.fnv1a("a") == "af63dc4c8601ec8c"
    assert rows(formats.annotations(f)) == [("::error file=a_b.go,line=3,col=0::m <1> x (r:x)",), ("::notice file=c.go,line=1,col=0::n (q)",)]
    issue = json.loads(formats.codeclimate(f).collect()[0].issue)
    assert issue["severity"] == "critical" and issue["fingerprint"] == formats.fnv1a("a,b.go:3:r:x:m <1>\nx")
    doc = json.loads(formats.sarif(f))
    assert [r["ruleIndex"] for r in doc["runs"][0]["results"]] == [0, 1] and doc["runs"][0]["results"][1]["level"] == "note"
    assert "&lt;1&gt;" in formats.pr_comment(f).collect()[0].row and "### `c.go`" in formats.markdown(f) and formats.markdown(f.limit(0)) == "No issues found.\n"
    assert [formats.badge(s)["color"] for s in (80, 60, 59)] == ["green", "yellow", "red"]


def test_telemetry(spark):
    p = spark.createDataFrame([(1, "a.b", 1.0, {"m": "x"}, 10, "trusted"), (2, "a.b", 2.5, {"m": "x"}, 20, "trusted"), (3, "c", 3.0, {}, 30, "trusted")], "seq long, name string, value double, labels map<string,string>, timestamp_ms long, provenance string")
    snap = telemetry.snapshot(p)
    assert rows(snap, "name", "value") == [("a.b", 2.5), ("c", 3.0)]
    assert rows(telemetry.prometheus(snap)) == [('a_b{m="x"} 2.5',), ("c 3",)]
    d = spark.createDataFrame([("a.b", "counter")], "name string, kind string")
    assert rows(telemetry.statsd(snap, d)) == [("a.b:2.5|c|#m:x",), ("c:3|g",)]
    assert json.loads(telemetry.cloudwatch(snap, "ns").orderBy("payload").collect()[0].payload)["Namespace"] == "ns" and telemetry.otlp(snap).count() == 2
    h = spark.createDataFrame([(1, "r", "f", 1), (2, "r", "f", 1), (2, "r", "f", 2), (4, "q", "f", 1)], "run_id int, rule_id string, file string, start_line int")
    assert rows(telemetry.deltas(h)) == [(1, 1, 0, 0), (2, 1, 0, 1), (4, 1, 2, 0)]
    assert telemetry.should_sample("on-change", 0, 1, 1) is False and telemetry.should_sample("rate", 1) and not telemetry.should_sample("rate", 0)
    m = spark.createDataFrame([("a", 5, 0, 0), ("b", 7, 1, 0)], "module_id string, last_duration_ms int, finding_count int, metric_count int")
    assert rows(telemetry.scrub(m, False)) == [("b", 0, 1, 0)]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "events")
    schema = "ts timestamp, k string"
    import datetime as dt

    t = lambda m: dt.datetime(2024, 1, 1, 0, 0, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=m)
    spark.createDataFrame([(t(0), "a"), (t(30), "a"), (t(70), "b"), (t(400), "z")], schema).coalesce(1).write.parquet(src)
    stream = streams.windowed_counts(spark.readStream.schema(schema).parquet(src), "ts", ["k"])
    stream.writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("counts"), "k", "n") == [("a", 2), ("b", 1)]  # only closed windows
    streams.sessions(spark.readStream.schema(schema).parquet(src), "ts", "k", "20 minutes").writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("sess"), "k", "n") == [("a", 1), ("a", 1), ("b", 1)]


def test_watch_and_churn(spark, tmp_path):
    from codeprism.operators.deadcode import dead_code

    src, schema = str(tmp_path / "changes"), "path string, content string, language string, changed_at long"
    spark.createDataFrame([("a.py", "import os\n", "python", 1), ("a.py", "x = 1\n", "python", 2), ("b.py", "import re\n", "python", 1)], schema).coalesce(1).write.parquet(src)
    out = str(tmp_path / "found")
    streams.watch(spark.readStream.schema(schema).parquet(src), dead_code, out, str(tmp_path / "c1")).awaitTermination()
    assert rows(spark.read.parquet(out), "rule_id", "file") == [("unused-import", "b.py")]
    prints, fs = str(tmp_path / "prints"), "rule_id string, file string, start_line int"
    for batch in ([("r", "f", 1), ("r", "f", 2)], [("r", "f", 2), ("r", "f", 3)]):
        spark.createDataFrame(batch, fs).coalesce(1).write.mode("append").parquet(prints)
        streams.churn_by_batch(spark.readStream.schema(fs).parquet(prints), str(tmp_path / "state"), str(tmp_path / "churn"), str(tmp_path / "c2")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "churn")), "batch_id", "change", "start_line") == [(0, "new", 1), (0, "new", 2), (1, "new", 3), (1, "resolved", 1)]
