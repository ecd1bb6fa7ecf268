import pytest

from codeprism.operators import diffs, snapshots
from codeprism.sources import state


def test_state_round_trip(spark, tmp_path):
    path = str(tmp_path / "baseline")
    assert state.load_baseline(spark, path).count() == 0
    found = spark.createDataFrame([("r", "f", 1, "m", "x")], "rule_id string, file string, start_line int, message string, more string")
    state.save_baseline(found, path)
    assert diffs.new_findings(found, state.load_baseline(spark, path)).count() == 0
    log = str(tmp_path / "log")
    for k, user in ((2, "a"), (1, "b")):
        state.append_event(spark, log, event="run", timestamp_ms=k, user=user)
    assert [r.user for r in state.read_events(spark, log).collect()] == ["b", "a"] and state.read_events(spark, log, "a").count() == 1
    with pytest.raises(ValueError):
        state.append_event(spark, log, nothing=1)


def test_snapshots(spark):
    f = spark.createDataFrame([("r",), ("r",), ("q",)], "rule_id string")
    a, b = snapshots.snapshot(f, "a", 3, 80.0), snapshots.snapshot(f.where("rule_id = 'r'"), "b", 3, 90.0, {"x": 1})
    t = {r.name: (r.delta, r.direction) for r in diffs.compare_metrics(a, b).collect()}
    assert t["health_score"] == (10.0, "improved") and t["total_findings"] == (-1.0, "improved") and t["files_analyzed"] == (0.0, "stable") and t["x"] == (1.0, "degraded")
    c = {r.rule_id: tuple(r)[1:] for r in diffs.catch_rate(spark.createDataFrame([("r", 3), ("q", 1)], "rule_id string, n long"), spark.createDataFrame([("r", 1), ("z", 2)], "rule_id string, n long")).collect()}
    assert c["r"] == (2, 0, 1, pytest.approx(200 / 3)) and c["q"] == (1, 0, 0, 100.0) and c["z"] == (0, 2, 0, 0.0)


def test_trust_boundary(spark):
    files = spark.createDataFrame([("core/a.go",), ("x/b.go",)], "path string")
    members, unused = snapshots.trust_boundary(files, [("core", "core/*"), ("none", "zzz*")])
    assert unused == [("none", "zzz*")] and [tuple(r) for r in members.collect()] == [("core/a.go", "core")]
    per = spark.createDataFrame([("core/a.go", 2, 1, 50.0)], "path string, instrumented long, covered long, percent double")
    assert [tuple(r) for r in snapshots.boundary_gate(per, members).collect()] == [("core", 2, 1, False, "core/a.go")]
    lcov = spark.createDataFrame([("core/a.go", 5), ("core/a.go", 1)], "path string, line int")
    assert [r.line for r in snapshots.lines_out_of_range(lcov, spark.createDataFrame([("core/a.go", 3)], "path string, total_lines long")).collect()] == [5]
