"""What changed between two runs: audits, churn, trends, catch rates, coverage gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KEY = ("rule_id", "file", "start_line", "message")


def new_findings(current: DataFrame, baseline: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Rows of ``current`` whose key the baseline hasn't; repeats stay. Nulls equal nulls."""
    base = baseline.select(*(F.col(c).alias(f"b_{c}") for c in key)).distinct()
    on = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in key]
    return current.join(base, on, "left_anti")


def resolved_findings(current: DataFrame, baseline: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    return new_findings(baseline, current, key)


def verdict(count: str | Column, warn: int = 1, fail: int = 5) -> Column:
    """fail / warn / pass by a count of findings; a threshold of 0 is off."""
    c = F.col(count) if isinstance(count, str) else count
    out = F.when(c >= fail, "fail") if fail else F.when(F.lit(False), "fail")
    return (out.when(c >= warn, "warn") if warn else out).otherwise("pass")


def audit(current: DataFrame, baseline: DataFrame, new_only: bool = True, warn: int = 1, fail: int = 5, key: tuple[str, ...] = KEY) -> DataFrame:
    """One row: new, resolved, total, score_delta, verdict. All counts in two passes over keys, none of it collected."""
    counts = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("__one", F.lit(1))
    one = counts(new_findings(current, baseline, key), "new_count").join(counts(resolved_findings(current, baseline, key), "resolved_count"), "__one")
    one = one.join(counts(current, "total"), "__one").join(counts(baseline, "before"), "__one").drop("__one")
    one = one.withColumn("score_delta", F.col("total") - F.col("before"))
    return one.withColumn("verdict", verdict("new_count" if new_only else "total", warn, fail)).drop("before")


def gate_mode(name: str | None) -> bool:
    """Whether a gate counts new findings only (``new-only`` and its short forms) or ``all``; another name is the former."""
    return (name or "").lower().replace("_", "-") != "all"


def audit_findings(current: DataFrame, baseline: DataFrame, new_only: bool = True, warn: int = 1, fail: int = 5, path: str = "baseline.json") -> DataFrame:
    """new-finding for each finding that the baseline hasn't, score-regression if there are more, threshold-exceeded if the gate fails.

    ``current`` and ``baseline``: rule_id, file, start_line, message. The last
    two stand at the baseline's ``path``.
    """
    text = lambda c: F.col(c).cast("string")
    new = new_findings(current, baseline)
    out = new.select(
        F.lit("new-finding").alias("rule_id"), "file", "start_line", F.concat(F.lit("new issue: "), "rule_id", F.lit(" in "), "file", F.lit(" at line "), text("start_line")).alias("message"),
        F.lit("warning").alias("severity"), F.create_map(F.lit("original_rule"), F.col("rule_id")).alias("metadata"),
    )
    one = audit(current, baseline, new_only, warn, fail).withColumn("before", F.col("total") - F.col("score_delta")).withColumn("relevant", F.col("new_count" if new_only else "total"))
    whole = lambda where, rule, message, severity, metadata: one.where(where).select(
        F.lit(rule).alias("rule_id"), F.lit(path).alias("file"), F.lit(1).alias("start_line"), message.alias("message"), F.lit(severity).alias("severity"), metadata.cast("map<string, string>").alias("metadata")
    )
    grown = F.concat(F.lit("finding count increased by "), text("score_delta"), F.lit(" (baseline: "), text("before"), F.lit(", current: "), text("total"), F.lit(")"))
    out = out.unionByName(whole("score_delta > 0", "score-regression", grown, "warning", F.create_map()))
    over = F.concat(F.lit("audit verdict: FAIL ("), text("relevant"), F.lit(f" relevant findings exceed threshold {fail})"))
    return out.unionByName(whole("verdict = 'fail'", "threshold-exceeded", over, "error", F.create_map(F.lit("verdict"), F.lit("FAIL"))))


def churn(current: DataFrame, previous: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """One row of set counts: new, resolved, unchanged, rate = new / (new + unchanged) or 0.

    One aggregation by key instead of three set operations.
    """
    both = current.select(*key, F.lit(1).alias("c"), F.lit(0).alias("p")).union(previous.select(*key, F.lit(0), F.lit(1)))
    per = both.groupBy(*key).agg(F.max("c").alias("c"), F.max("p").alias("p"))
    one = per.agg(*(F.coalesce(F.sum(F.when(F.expr(e), 1).otherwise(0)), F.lit(0)).alias(n) for n, e in (("new", "c = 1 and p = 0"), ("resolved", "c = 0 and p = 1"), ("unchanged", "c = 1 and p = 1"))))
    total = F.col("new") + F.col("unchanged")
    return one.withColumn("rate", F.when(total > 0, F.col("new") / total).otherwise(F.lit(0.0)))


def compare_metrics(before: DataFrame, after: DataFrame, higher_better: tuple[str, ...] = ("health_score",), eps: float = 0.001) -> DataFrame:
    """Full outer join of (name, value): baseline, current, delta and direction; missing is 0."""
    out = before.select("name", F.col("value").alias("baseline")).join(after.select("name", F.col("value").alias("current")), "name", "full_outer")
    out = out.select("name", F.coalesce("baseline", F.lit(0.0)).alias("baseline"), F.coalesce("current", F.lit(0.0)).alias("current")).withColumn("delta", F.col("current") - F.col("baseline"))
    gain = F.when(F.col("name").isin(*higher_better), F.col("delta")).otherwise(-F.col("delta"))
    return out.withColumn("direction", F.when(F.abs("delta") < eps, "stable").when(gain > 0, "improved").otherwise("degraded"))


def catch_rate(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per rule (rule_id, n): fixed, introduced, persisted and the percentage fixed."""
    out = before.select("rule_id", F.col("n").alias("b")).join(after.select("rule_id", F.col("n").alias("c")), "rule_id", "full_outer").na.fill(0, ["b", "c"])
    out = out.select("rule_id", F.greatest(F.col("b") - F.col("c"), F.lit(0)).alias("fixed"), F.greatest(F.col("c") - F.col("b"), F.lit(0)).alias("introduced"), F.least("b", "c").alias("persisted"))
    return out.withColumn("fix_rate", F.when(F.col("fixed") + F.col("persisted") > 0, F.col("fixed") * 100.0 / (F.col("fixed") + F.col("persisted"))).otherwise(F.lit(0.0)))


def changed_line_coverage(changed: DataFrame, lcov: DataFrame) -> DataFrame:
    """Per path: instrumented and covered changed lines and their percentage.

    ``changed``: path, line; ``lcov``: path, line, hits (repeats: the most hits count).
    """
    merged = lcov.groupBy("path", "line").agg(F.max("hits").alias("hits"))
    out = changed.select("path", "line").distinct().join(merged, ["path", "line"]).groupBy("path").agg(F.count("*").alias("instrumented"), F.count_if(F.col("hits") > 0).alias("covered"))
    return out.withColumn("percent", F.col("covered") * 100.0 / F.col("instrumented"))


def coverage_gate(per_path: DataFrame, least: float) -> DataFrame:
    """One row over paths: totals, worst path (first by name at equal percentage) and whether it passes."""
    out = per_path.agg(F.sum("instrumented").alias("instrumented"), F.sum("covered").alias("covered"), F.min_by("path", F.struct("percent", "path")).alias("worst_path"), F.min("percent").alias("worst_percent"))
    percent = F.when(F.col("instrumented") > 0, F.col("covered") * 100.0 / F.col("instrumented")).otherwise(F.lit(100.0))
    return out.withColumn("percent", percent).withColumn("passed", F.col("percent") >= least)


def fingerprint_set_hash(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """One row: a hash of a set of keys that doesn't depend on order or repeats, combined map-side."""
    one = df.select(*key).distinct().select(F.xxhash64(*key).alias("h"))
    return one.agg(F.coalesce(F.bit_xor("h"), F.lit(0)).alias("set_hash"), F.count("*").alias("n"))
