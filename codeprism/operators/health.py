"""Health scores, hotspots, complexity findings: roll-ups of function metrics."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import grade


def _over(value: Column, limit: float, rate: float, most: int) -> Column:
    """Truncated penalty for what is above a limit."""
    return F.when(value > limit, F.least(F.lit(float(most)), (value - limit) * rate).cast("int")).otherwise(0)


def file_health(metrics: DataFrame, max_cyclomatic: float = 20, max_cognitive: float = 15) -> DataFrame:
    """Score 0 to 100 of each file from its functions' metrics.

    ``metrics``: file, cyclomatic, cognitive, lines, max_nesting. Penalties: 3 a
    point above the average limits up to 30 each, a point for each 20 lines of
    the longest function above 100 up to 20, 5 a level of nesting above 4 up to 20.
    """
    per = metrics.groupBy("file").agg(F.avg("cyclomatic").alias("cyc"), F.avg("cognitive").alias("cog"), F.max("lines").cast("int").alias("longest"), F.max("max_nesting").cast("int").alias("deepest"))
    size = F.when(F.col("longest") > 100, F.least(F.lit(20), F.expr("(longest - 100) div 20").cast("int"))).otherwise(0)
    nesting = F.when(F.col("deepest") > 4, F.least(F.lit(20), (F.col("deepest") - 4) * 5)).otherwise(0)
    out = per.select("file", _over(F.col("cyc"), max_cyclomatic, 3, 30).alias("cyclomatic_penalty"), _over(F.col("cog"), max_cognitive, 3, 30).alias("cognitive_penalty"), size.cast("int").alias("size_penalty"), nesting.cast("int").alias("nesting_penalty"))
    score = F.greatest(F.lit(0), F.lit(100) - F.col("cyclomatic_penalty") - F.col("cognitive_penalty") - F.col("size_penalty") - F.col("nesting_penalty"))
    return out.withColumn("score", score.cast("int")).withColumn("grade", grade("score"))


def project_health(files: DataFrame) -> DataFrame:
    """One row: the floor of the mean score (100 without files), its grade and the number of files."""
    one = files.agg(F.coalesce(F.expr("cast(sum(score) div count(*) as int)"), F.lit(100)).alias("score"), F.count("*").alias("total_files"))
    return one.withColumn("grade", grade("score"))


def commit_counts(spark: SparkSession, config: dict[str, str]) -> DataFrame:
    """file, commits from settings: ``commit-counts``, an object of JSON, or else an entry ``commits:<file>`` each; what is no whole number is left out."""
    try:
        found = json.loads(config["commit-counts"])
        rows = [(k, v) for k, v in found.items() if isinstance(v, int) and v >= 0]
        if len(rows) < len(found):
            raise ValueError
    except (KeyError, ValueError, AttributeError):
        rows = [(k.removeprefix("commits:"), int(v)) for k, v in config.items() if k.startswith("commits:") and v.isdigit()]
    return spark.createDataFrame(rows, "file string, commits long")


def hotspots(commits: DataFrame, metrics: DataFrame, warn: float = 20, refactor: float = 50) -> DataFrame:
    """Average cyclomatic complexity (1 where unknown) times commits; files without commits are left out."""
    avg = metrics.groupBy("file").agg(F.avg("cyclomatic").alias("avg_cyclomatic"))
    out = commits.where("commits > 0").join(avg, "file", "left").withColumn("avg_cyclomatic", F.coalesce("avg_cyclomatic", F.lit(1.0)))
    out = out.withColumn("hotspot_score", F.col("avg_cyclomatic") * F.col("commits"))
    return out.withColumn("rule_id", F.when(F.col("hotspot_score") >= refactor, "refactoring-target").when(F.col("hotspot_score") >= warn, "hotspot"))


def hotspot_findings(spots: DataFrame) -> DataFrame:
    """Findings of the files that :func:`hotspots` gives a rule, highest score first in their message and metadata."""
    one = lambda c: F.format_string("%.1f", c)
    target = F.col("rule_id") == "refactoring-target"
    kind = F.when(target, "refactoring target").otherwise("hotspot")
    figures = (F.lit("hotspot_score"), one("hotspot_score"), F.lit("commit_count"), F.col("commits").cast("string"), F.lit("avg_cyclomatic"), one("avg_cyclomatic"))
    message = F.concat(F.lit("file `"), "file", F.lit("` is a "), kind, F.lit(" (score: "), figures[1], F.lit(", commits: "), figures[3], F.lit(", avg cyclomatic: "), figures[5], F.lit(")"))
    return spots.where("rule_id is not null").select(
        "rule_id", "file", F.lit(1).alias("start_line"), message.alias("message"), F.when(target, "error").otherwise("warning").alias("severity"),
        F.when(target, 0.9).otherwise(0.8).cast("float").alias("confidence"), F.create_map(*figures).alias("metadata"),
    )


def complexity_findings(metrics: DataFrame, files: DataFrame, max_cyclomatic: int = 20, max_cognitive: int = 15, min_score: int = 70) -> DataFrame:
    """high-cyclomatic, high-cognitive and low-health-score findings: rule_id, file, start_line, value."""
    functions = metrics.select(F.explode(F.array(
        F.struct(F.lit("high-cyclomatic").alias("rule_id"), "file", "start_line", F.col("cyclomatic").alias("value"), F.lit(max_cyclomatic).alias("most")),
        F.struct(F.lit("high-cognitive").alias("rule_id"), "file", "start_line", F.col("cognitive").alias("value"), F.lit(max_cognitive).alias("most")),
    )).alias("x")).select("x.*").where("value > most").drop("most")
    low = files.where(F.col("score") < min_score).select(F.lit("low-health-score").alias("rule_id"), "file", F.lit(1).alias("start_line"), F.col("score").alias("value"))
    return functions.unionByName(low)
