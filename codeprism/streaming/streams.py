"""Streams: event-time windows, ingestion of untrusted metrics, incremental analysis and churn by run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.diffs import new_findings, resolved_findings


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by window and keys; rows later than ``late`` are dropped. Times without zone are taken as UTC."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = timed.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = timed.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def ingest_points(points: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append metric points from outside to the store. Whatever they claim, they are untrusted."""
    return points.withColumn("provenance", F.lit("untrusted")).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(changes: DataFrame, analyse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, whole_tree: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Analyse changed files (path, content, language) batch by batch into ``out``.

    A path that changed more than once in a batch is analysed once, as it is
    last (by ``changed_at``). With ``whole_tree`` the analysis sees all files
    and only findings of changed ones are written; otherwise only the changed.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        fields = [c for c in batch.columns if c != "path"]
        last = batch.groupBy("path").agg(F.max_by(F.struct(*fields), "changed_at").alias("x")).select("path", "x.*")
        changed = last.select("path", "content", "language")
        found = analyse(changed) if whole_tree is None else analyse(whole_tree()).join(changed.select(F.col("path").alias("file")), "file", "left_semi")
        found.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def churn_by_batch(fingerprints: DataFrame, state: str, out: str, checkpoint: str, key: tuple[str, ...] = ("rule_id", "file", "start_line")) -> StreamingQuery:
    """Compare each batch of fingerprints with the one before, which is kept under ``state``: new and resolved, by batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        now = batch.select(*key).distinct()
        before = spark.read.schema(now.schema).parquet(f"{state}/{batch_id - 1}") if batch_id else now.limit(0)
        came, went = new_findings(now, before, key).withColumn("change", F.lit("new")), resolved_findings(now, before, key).withColumn("change", F.lit("resolved"))
        came.unionByName(went).withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)
        now.write.mode("overwrite").parquet(f"{state}/{batch_id}")

    return fingerprints.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
