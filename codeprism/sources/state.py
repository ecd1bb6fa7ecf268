"""State between runs: baselines, snapshots, churn fingerprints and an audit log, as JSON lines or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from ..schema import BASELINE

SNAPSHOT = "snapshot string, name string, value double"
FINGERPRINTS = "run_id bigint, rule_id string, file string, start_line int"
#: One wide row for all kinds of events; what a kind hasn't is null.
AUDIT_EVENT = "event string, timestamp_ms bigint, module_id string, rule_id string, user string, audience string, detail string"


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table; one that isn't there yet is empty, lines that don't parse are dropped."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def save(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, BASELINE)


def save_baseline(findings: DataFrame, path: str) -> None:
    save(findings.select("rule_id", "file", "start_line", "message"), path)


def append_event(spark: SparkSession, path: str, **fields: object) -> None:
    names = [c.split()[0] for c in AUDIT_EVENT.split(", ")]
    unknown = set(fields) - set(names)
    if unknown:
        raise ValueError(f"an audit event has no {', '.join(sorted(unknown))}")
    save(spark.createDataFrame([tuple(fields.get(n) for n in names)], AUDIT_EVENT), path, "append")


def read_events(spark: SparkSession, path: str, user: str | None = None) -> DataFrame:
    """The log in order of time; of one user only for an export of personal data."""
    log = load(spark, path, AUDIT_EVENT)
    return (log if user is None else log.where(F.col("user") == user)).orderBy("timestamp_ms", "event")
