"""A metrics and trace store: core definitions, snapshots, sampling and wire formats."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

DEFINITIONS = "name string, kind string, description string, unit string"
POINTS = "name string, value double, labels map<string, string>"
#: The metrics that the engine itself records (name, kind, description, unit).
CORE = (
    ("analysis.duration_ms", "histogram", "Total analysis duration", "ms"), ("analysis.files_total", "counter", "Total files analyzed", "count"),
    ("analysis.findings_total", "counter", "Total findings per module", "count"), ("analysis.findings_by_severity", "counter", "Findings per module and severity", "count"),
    ("module.call_duration_ms", "histogram", "Per-module call duration", "ms"), ("module.error_total", "counter", "Per-module error count", "count"),
    ("findings.new", "counter", "Findings not in previous run", "count"), ("findings.resolved", "counter", "Findings in previous run but not current", "count"),
    ("findings.unchanged", "counter", "Findings present in both runs", "count"), ("findings.churn_rate", "gauge", "Churn rate: new / (new + unchanged)", "ratio"),
    ("module.load_error_total", "counter", "Module load failures by module_id and error_type", "count"), ("config.parse_error_total", "counter", "Config parse failures", "count"),
    ("plugin.connect_error_total", "counter", "External module connection failures", "count"), ("module.startup_duration_ms", "histogram", "Per-module initialization time", "ms"),
    ("startup.total_duration_ms", "gauge", "Total time from process start to all modules ready", "ms"),
)


#: Audiences, and backends with the other names that they go by.
AUDIENCES = ("on", "off", "user-only", "operator-only")
BACKENDS = {
    "json-file": ("json", "file"), "stderr": ("log",), "prometheus": ("prom",), "otlp": ("otel", "opentelemetry"), "statsd": (), "cloudwatch": ("cw",),
}
STRATEGIES = ("rate", "on-change")


def _one_of(what: str, value: str, names: dict[str, tuple[str, ...]]) -> str:
    low = value.lower().replace("_", "-")
    for name, others in names.items():
        if low == name or low in others:
            return name
    raise ValueError(f"unknown {what} {value!r}: one of {', '.join(names)}")


def settings(config: dict[str, str], flag_audience: str | None = None) -> dict[str, object]:
    """audience, backend, sampling_rate and sampling_strategy of a run: a flag goes before the configuration, that before the defaults.

    What is there but can't be understood is an error, in either spelling of its
    key; of two spellings the one with a dash counts. Rates are brought into 0 to 1.
    """
    plain = {a: () for a in AUDIENCES}
    own = _one_of("audience", config["audience"], plain) if "audience" in config else None
    flag = _one_of("audience", flag_audience, plain) if flag_audience is not None else None
    rate, strategy = 1.0, "rate"
    for key in ("sampling_rate", "sampling-rate"):
        if key in config:
            rate = float(config[key])
            if not math.isfinite(rate):
                raise ValueError(f"{key} must be a number from 0 to 1")
            rate = min(max(rate, 0.0), 1.0)
    for key in ("sampling_strategy", "sampling-strategy"):
        if key in config:
            strategy = _one_of("sampling strategy", config[key], {x: () for x in STRATEGIES})
    backend = _one_of("backend", config["backend"], BACKENDS) if "backend" in config else "json-file"
    return {"audience": flag or own or "user-only", "backend": backend, "sampling_rate": rate, "sampling_strategy": strategy}


def record(store: DataFrame, points: DataFrame, trusted: bool = False) -> DataFrame:
    """A store of points (seq, name, value, labels, provenance) with more points after it; those of extensions are untrusted."""
    last = F.coalesce(store.agg(F.max("seq")).first()[0] + F.lit(0), F.lit(0)) if not store.isEmpty() else F.lit(0)
    more = points.withColumn("seq", last + F.monotonically_increasing_id() + 1).withColumn("provenance", F.lit("trusted" if trusted else "untrusted"))
    return store.unionByName(more.select(*store.columns))


#: Panels of a dashboard: title and query over exposed metrics, narrowed by the variables module and severity.
PANELS = (
    ("Health score", "health_score"), ("Findings by module", 'sum by (module_id) (analysis_findings_total{module_id=~"$module"})'),
    ("Findings by severity", 'sum by (severity) (analysis_findings_by_severity{module_id=~"$module",severity=~"$severity"})'), ("Call duration by module", 'avg by (module_id) (module_call_duration_ms{module_id=~"$module"})'),
    ("Errors by module", 'sum by (module_id) (module_error_total{module_id=~"$module"})'), ("Churn rate", "findings_churn_rate"), ("Startup", "startup_total_duration_ms"),
)


def dashboard(spark: SparkSession, modules: DataFrame) -> DataFrame:
    """ord, title, query of a dashboard's panels: the fixed ones, then one for the findings of each module (module_id)."""
    fixed = spark.createDataFrame([(k, *p) for k, p in enumerate(PANELS)], "ord int, title string, query string")
    each = modules.select("module_id").distinct()
    order = F.row_number().over(W.orderBy("module_id")) + len(PANELS) - 1  # a row a module
    query = F.concat(F.lit('analysis_findings_total{module_id="'), "module_id", F.lit('"}'))
    return fixed.unionByName(each.select(order.cast("int").alias("ord"), F.concat(F.lit("Findings of "), "module_id").alias("title"), query.alias("query")))


def definitions(spark: SparkSession) -> DataFrame:
    """The core metrics: name, kind, description, unit."""
    return spark.createDataFrame(list(CORE), DEFINITIONS)


def _points(df: DataFrame, name: str, value: Column | str, **labels: str) -> DataFrame:
    pairs = [x for k, c in labels.items() for x in (F.lit(k), F.col(c).cast("string"))]
    held = F.create_map(*pairs) if pairs else F.create_map().cast("map<string, string>")
    return df.select(F.lit(name).alias("name"), (F.col(value) if isinstance(value, str) else value).cast("double").alias("value"), held.alias("labels"))


def call_points(calls: DataFrame) -> DataFrame:
    """Points of module calls (module_id, duration_ms, had_error): each one's duration, and errors by module."""
    errors = calls.where("had_error").groupBy("module_id").agg(F.count("*").alias("n"))
    return _points(calls, "module.call_duration_ms", "duration_ms", module_id="module_id").unionByName(_points(errors, "module.error_total", "n", module_id="module_id"))


def finding_points(findings: DataFrame) -> DataFrame:
    """Points of findings (module_id, severity): totals by module, and by module and severity."""
    total = findings.groupBy("module_id").agg(F.count("*").alias("n"))
    each = findings.groupBy("module_id", "severity").agg(F.count("*").alias("n"))
    return _points(total, "analysis.findings_total", "n", module_id="module_id").unionByName(_points(each, "analysis.findings_by_severity", "n", module_id="module_id", severity="severity"))


def load_points(loads: DataFrame) -> DataFrame:
    """Points of module loads (module_id, duration_ms, error_type, null if it worked): startup times, errors, their sum."""
    errors = loads.where("error_type is not null").groupBy("module_id", "error_type").agg(F.count("*").alias("n"))
    out = _points(loads.where("error_type is null"), "module.startup_duration_ms", "duration_ms", module_id="module_id")
    out = out.unionByName(_points(errors, "module.load_error_total", "n", module_id="module_id", error_type="error_type"))
    return out.unionByName(_points(loads.agg(F.sum("duration_ms").alias("all")).where("all is not null"), "startup.total_duration_ms", "all"))


def churn_points(churn: DataFrame) -> DataFrame:
    """Points of a run's churn (new, resolved, unchanged, rate)."""
    out = None
    for name, column in (("findings.new", "new"), ("findings.resolved", "resolved"), ("findings.unchanged", "unchanged"), ("findings.churn_rate", "rate")):
        part = _points(churn, name, column)
        out = part if out is None else out.unionByName(part)
    return out


def module_metrics(points: DataFrame) -> DataFrame:
    """Own metrics of modules, ``module.<id>.<key>``: module_id, key and the last value by sequence number."""
    id, key = (F.regexp_extract("name", r"^module\.([^.]+)\.(.+)$", k) for k in (1, 2))
    return points.where(F.col("name").rlike(r"^module\.[^.]+\..+$")).groupBy(id.alias("module_id"), key.alias("key")).agg(F.max_by("value", "seq").alias("value"))


def module_summary(modules: DataFrame, calls: DataFrame, findings: DataFrame) -> DataFrame:
    """Each module (module_id) with its last duration, calls, errors and findings; 0 where it has none."""
    found = findings.groupBy("module_id").agg(F.count("*").alias("findings"))
    out = modules.select("module_id").join(module_durations(calls), "module_id", "left").join(found, "module_id", "left")
    return out.select("module_id", *(F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("last_duration_ms", "calls", "errors", "findings")))


def overview(modules: DataFrame) -> DataFrame:
    """One row over modules (health, files_analyzed, findings): mean health of those that have one, most files, all findings."""
    return modules.agg(F.avg("health").alias("average_health"), F.max("files_analyzed").alias("files_analyzed"), F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"))


def hit_rate(rows: DataFrame, hit: Column, miss: Column) -> DataFrame:
    """One row: hits, misses and hits over both, 0 without any."""
    one = rows.agg(F.count_if(hit).alias("hits"), F.count_if(miss).alias("misses"))
    total = F.col("hits") + F.col("misses")
    return one.withColumn("hit_rate", F.when(total > 0, F.col("hits") / total).otherwise(F.lit(0.0)))


def sum_by(points: DataFrame, label: str, selector: str, value: str = "value") -> DataFrame:
    """The sum of a metric by a label whose whole value fits the selector, and its points; sums are exact to a hundredth."""
    total = F.round(F.sum(F.col(value).cast("decimal(18,2)")).cast("double"), 2)
    return points.where(F.col(label).rlike(f"^(?:{selector})$")).groupBy(label).agg(total.alias("total"), F.count("*").alias("points"))


def telemetry_findings(spark: SparkSession, backends: DataFrame, points: DataFrame, audience: str = "on") -> DataFrame:
    """backend-status for each backend (name, enabled) that operators see, and a metric-summary for each metric."""
    out = points.groupBy("name").agg(F.count("*").alias("n")).select(
        F.lit("metric-summary").alias("rule_id"), F.lit("").alias("file"), F.lit(0).alias("start_line"),
        F.concat(F.lit("metric "), "name", F.lit(": "), F.col("n").cast("string"), F.lit(" points")).alias("message"), F.lit("info").alias("severity"),
    )
    if audience not in ("on", "operator-only"):
        return out
    status = F.when(F.col("enabled"), "enabled").otherwise("disabled")
    return out.unionByName(backends.select(
        F.lit("backend-status").alias("rule_id"), F.lit("").alias("file"), F.lit(0).alias("start_line"), F.concat(F.lit("backend "), "name", F.lit(": "), status).alias("message"), F.lit("info").alias("severity")
    ))


def snapshot(points: DataFrame) -> DataFrame:
    """The last value of each metric and label set, as of its sequence number."""
    key = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    out = points.withColumn("label_key", F.coalesce(key, F.lit("")))
    return out.groupBy("name", "label_key").agg(F.max_by("value", "seq").alias("value"), F.max_by("labels", "seq").alias("labels"), F.max("timestamp_ms").alias("timestamp_ms"))


def module_durations(calls: DataFrame) -> DataFrame:
    """Per module (module_id, seq, duration_ms, had_error): last duration, calls, errors."""
    return calls.groupBy("module_id").agg(F.max_by("duration_ms", "seq").alias("last_duration_ms"), F.count("*").alias("calls"), F.count_if("had_error").alias("errors"))


def scrub(modules: DataFrame, operator: bool) -> DataFrame:
    """What a user sees of modules: no durations, and none without findings and metrics."""
    if operator:
        return modules
    return modules.where("finding_count <> 0 or metric_count > 0").withColumn("last_duration_ms", F.lit(0).cast(modules.schema["last_duration_ms"].dataType))


def _labels(pair: str, join: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.format_string(pair, e["key"], e["value"])), join)


def _value() -> Column:
    whole = F.col("value") == F.floor("value")
    return F.when(whole, F.col("value").cast("bigint").cast("string")).otherwise(F.col("value").cast("string"))


def prometheus(points: DataFrame) -> DataFrame:
    """Exposition lines: column ``line``."""
    name = F.replace("name", F.lit("."), F.lit("_"))
    labels = F.when(F.coalesce(F.size("labels"), F.lit(0)) > 0, F.concat(F.lit("{"), _labels('%s="%s"', ","), F.lit("}"))).otherwise(F.lit(""))
    return points.select(F.concat(name, labels, F.lit(" "), _value()).alias("line"))


def statsd(points: DataFrame, definitions: DataFrame) -> DataFrame:
    """StatsD lines; a metric without a definition is a gauge: column ``line``."""
    kind = F.when(F.col("kind") == "counter", "c").when(F.col("kind") == "histogram", "ms").otherwise("g")
    tags = F.when(F.coalesce(F.size("labels"), F.lit(0)) > 0, F.concat(F.lit("|#"), _labels("%s:%s", ","))).otherwise(F.lit(""))
    return points.join(definitions.select("name", "kind"), "name", "left").select(F.concat("name", F.lit(":"), _value(), F.lit("|"), kind, tags).alias("line"))


def otlp(points: DataFrame) -> DataFrame:
    """A JSON data point each, grouped by metric: name, payload."""
    attributes = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    point = F.struct(F.col("value").alias("asDouble"), (F.col("timestamp_ms") * 1000000).cast("string").alias("timeUnixNano"), attributes.alias("attributes"))
    return points.select("name", F.to_json(F.struct("name", F.struct(F.array(point).alias("dataPoints")).alias("gauge"))).alias("payload"))


def cloudwatch(points: DataFrame, namespace: str) -> DataFrame:
    dims = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.struct(e["key"].alias("Name"), e["value"].alias("Value")))
    return points.select(F.to_json(F.struct(F.lit(namespace).alias("Namespace"), F.col("name").alias("MetricName"), F.col("value").alias("Value"), dims.alias("Dimensions"))).alias("payload"))


def should_sample(strategy: str, rate: float, current: int | None = None, previous: int | None = None, run_id: int = 0) -> bool:
    """``on-change``: only if the set of findings differs; else by rate, alike in every repeat of a run."""
    if strategy == "on-change":
        return previous is None or current != previous
    return rate >= 1 or rate > 0 and (run_id * 7919 + 104729) % 10000 < rate * 10000


def deltas(history: DataFrame) -> DataFrame:
    """Run over run: which findings (run_id, rule_id, file, start_line) came and went at each run.

    Each fingerprint's runs are compared with the run before by a count, not by loops over runs.
    """
    runs = history.select("run_id").distinct()
    order = F.row_number().over(W.orderBy("run_id"))
    numbered = runs.withColumn("k", order)  # a row a run
    h = history.select("run_id", "rule_id", "file", "start_line").distinct().join(numbered, "run_id").select("k", "rule_id", "file", "start_line")
    both = h.select("k", "rule_id", "file", "start_line", F.lit(1).alias("c"), F.lit(0).alias("p")).union(h.select(F.col("k") + 1, "rule_id", "file", "start_line", F.lit(0), F.lit(1)))
    per = both.groupBy("k", "rule_id", "file", "start_line").agg(F.max("c").alias("c"), F.max("p").alias("p"))
    out = per.groupBy("k").agg(F.count_if(F.expr("c = 1 and p = 0")).alias("new"), F.count_if(F.expr("c = 0 and p = 1")).alias("resolved"), F.count_if(F.expr("c = 1 and p = 1")).alias("unchanged"))
    return numbered.join(out, "k", "left").select("run_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("new", "resolved", "unchanged")))
