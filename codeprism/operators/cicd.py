"""Rules for CI/CD configuration: workflows, pipelines, container files, services."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .line_rules import numbered_lines
from .prompt_safety import any_of

#: Fixed values of the rules.
INJECTABLE = (
    "github.event.issue.title", "github.event.issue.body", "github.event.pull_request.title", "github.event.pull_request.body", "github.event.comment.body", "github.event.review.body",
    "github.event.head_commit.message", "github.event.commits", "github.head_ref",
)
SECRET_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey", "private_key", "access_key")
SENSITIVE_PATHS = ("/", "/etc", "/var/run/docker.sock", "/root", "/proc", "/sys", "/dev", "/boot")
HARDENING = ("ProtectSystem", "ProtectHome", "NoNewPrivileges", "PrivateTmp")
PIPELINE_KEYS = (
    "image", "services", "stages", "variables", "include", "default", "workflow", "before_script", "after_script", "cache", "pages", "trigger", "rules", "artifacts", "needs", "extends",
    "retry", "interruptible", "timeout", "resource_group", "environment", "release", "secrets", "id_tokens", "when", "allow_failure", "parallel", "dependencies",
)
FOUND = "array<struct<rule_id: string, start_line: int, detail: string, severity: string, confidence: float>>"


def file_type(path: str | Column) -> Column:
    """What kind of configuration a path is; decided before content is read."""
    p = F.lower(F.replace(F.col(path) if isinstance(path, str) else path, F.lit("\\"), F.lit("/")))
    name = F.element_at(F.split(p, "/"), -1)
    yaml = name.rlike(r"\.ya?ml$")
    out = F.when(p.contains(".github/workflows/") & yaml, "actions").when(name.isin(".gitlab-ci.yml", ".gitlab-ci.yaml"), "gitlab")
    out = out.when(name.rlike("^(docker-)?compose") & yaml, "compose").when(name.startswith("dockerfile") | name.endswith(".dockerfile"), "dockerfile")
    return out.when(name.endswith(".service"), "systemd")


def _unpinned(image: Column) -> Column:
    return image.endswith(":latest") | ~F.element_at(F.split(image, "/"), -1).contains(":")


def directives(lines: DataFrame) -> DataFrame:
    """Container file directives: file, n (first line), instruction, arguments.

    Lines that end in a backslash go on; comments and blank lines don't break
    that. Groups come from running sums over a file's lines.
    """
    order = W.partitionBy("file").orderBy("n")
    kept = lines.where((F.trim("line") != "") & ~F.trim("line").startswith("#")).withColumn("open", F.rtrim("line").endswith("\\"))
    starts = F.when(F.coalesce(F.lag("open").over(order), F.lit(False)), 0).otherwise(1)
    grouped = kept.withColumn("starts", starts).withColumn("g", F.sum("starts").over(order)).withColumn("part", F.trim(F.regexp_replace("line", r"\\\s*$", "")))
    whole = grouped.groupBy("file", "g").agg(F.min("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), " ").alias("text"))
    return whole.select("file", "n", F.upper(F.regexp_extract("text", r"^(\S+)", 1)).alias("instruction"), F.trim(F.regexp_replace("text", r"^\S+\s*", "")).alias("arguments"))


def ini_directives(lines: DataFrame) -> DataFrame:
    """key = value lines, whatever their section: file, n, key, value."""
    t = F.trim("line")
    kept = lines.where(~t.rlike(r"^([#;\[]|$)") & t.contains("="))
    return kept.select("file", "n", F.trim(F.substring_index(t, "=", 1)).alias("key"), F.trim(F.expr("substring(trim(line), instr(trim(line), '=') + 1)")).alias("value"))


def _rows(df: DataFrame, rule: str, severity: str, confidence: float, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule_id"), "file", F.col("n").cast("int").alias("start_line"), detail.alias("detail"), F.lit(severity).alias("severity"), F.lit(confidence).cast("float").alias("confidence"))


def dockerfile_findings(lines: DataFrame) -> DataFrame:
    d = directives(lines)
    image = F.regexp_extract("arguments", r"^(\S+)", 1)
    froms = d.where("instruction = 'FROM'").withColumn("image", image)
    out = _rows(froms.where((F.col("image") != "scratch") & _unpinned(F.col("image"))), "dockerfile-unpinned-base", "warning", 1.0, F.col("image"))
    last = froms.groupBy("file").agg(F.max("n").alias("n"))
    users = d.where("instruction = 'USER'").where(~F.trim(F.substring_index("arguments", ":", 1)).isin("root", "0")).select("file", F.col("n").alias("at"))
    safe = last.join(users, "file").where("at >= n").select("file").distinct()
    out = out.unionByName(_rows(last.join(safe, "file", "left_anti"), "dockerfile-run-as-root", "warning", 0.9, F.lit("")))
    out = out.unionByName(_rows(d.where("instruction = 'ADD'").where(F.col("arguments").rlike(r"(^|\s)https?://")), "dockerfile-remote-add", "warning", 1.0, F.regexp_extract("arguments", r"(https?://\S+)", 1)))
    pair = F.split("arguments", F.when(F.col("arguments").contains("="), "=").otherwise(r"\s"), 2)
    env = d.where("instruction in ('ENV', 'ARG')").withColumn("kv", pair).where(F.size("kv") == 2).withColumns({"key": F.trim(F.col("kv")[0]), "value": F.trim(F.col("kv")[1])})
    leaks = env.where(any_of(F.lower("key"), SECRET_NAMES) & (F.col("value") != "") & ~F.col("value").startswith("$"))
    return out.unionByName(_rows(leaks, "dockerfile-secrets-in-layer", "error", 0.85, F.col("key")))


def systemd_findings(lines: DataFrame) -> DataFrame:
    service = lines.where(F.contains("line", F.lit("[Service]"))).groupBy("file").agg(F.min("n").alias("service"))
    keys = ini_directives(lines).groupBy("file").agg(F.min_by("value", F.when(F.col("key") == "User", F.col("n"))).alias("user"), F.min(F.when(F.col("key") == "User", F.col("n"))).alias("user_line"), F.collect_set("key").alias("keys"))
    both = service.join(keys, "file", "left")
    none = both.where("user_line is null").withColumn("n", F.col("service"))
    root = both.where("user_line is not null and user in ('root', '0')").withColumn("n", F.col("user_line"))
    out = _rows(none, "systemd-root-execution", "warning", 0.95, F.lit("")).unionByName(_rows(root, "systemd-root-execution", "warning", 1.0, F.col("user")))
    missing = both.withColumn("n", F.col("service")).withColumn("missing", F.array_except(F.array(*map(F.lit, HARDENING)), F.coalesce("keys", F.array().cast("array<string>")))).where(F.size("missing") > 0)
    return out.unionByName(_rows(missing, "systemd-missing-hardening", "info", 0.8, F.array_join("missing", ", ")))


# -- YAML --------------------------------------------------------------------


def _line(content: str, needle: str, start: int = 1) -> int:
    for n, line in enumerate(content.split("\n"), 1):
        if n >= start and needle in line:
            return n
    return start


def yaml_findings(kind: str, content: str) -> list[tuple[str, int, str, str, float]]:
    """Findings of one YAML file; one that can't be read gives ``unreadable-config``, not an error."""
    import yaml

    try:
        doc = yaml.safe_load(content)
    except yaml.YAMLError as e:
        return [("unreadable-config", 1, str(e).split("\n")[0], "warning", 1.0)]
    if not isinstance(doc, dict):
        return []
    return list({"actions": _actions, "gitlab": _gitlab, "compose": _compose}[kind](doc, content))


def _actions(doc: dict, content: str):
    on = doc.get("on", doc.get(True))  # YAML 1.1 reads the key as a boolean
    names = [on] if isinstance(on, str) else list(on) if isinstance(on, (list, dict)) else []
    if "actions/checkout" in content:
        for trigger in ("pull_request_target", "workflow_run"):
            if trigger in names:
                yield "actions-dangerous-trigger", _line(content, trigger), trigger, "error", 0.9
    jobs = doc.get("jobs") if isinstance(doc.get("jobs"), dict) else {}
    for scope, perms in [("workflow", doc.get("permissions")), *((str(k), v.get("permissions")) for k, v in jobs.items() if isinstance(v, dict))]:
        if perms == "write-all":
            yield "actions-excessive-permissions", _line(content, "write-all"), scope, "warning", 1.0
        elif isinstance(perms, dict) and sum(v == "write" for v in perms.values()) >= 3:
            yield "actions-excessive-permissions", _line(content, "permissions"), scope, "warning", 0.8
    for job in jobs.values():
        for step in (job.get("steps") or []) if isinstance(job, dict) else []:
            if not isinstance(step, dict):
                continue
            uses, run = step.get("uses"), step.get("run")
            if isinstance(uses, str) and not uses.startswith(("docker://", "./")):
                ref = uses.partition("@")[2]
                if not (len(ref) == 40 and all(c in "0123456789abcdefABCDEF" for c in ref)):
                    yield "actions-unpinned-action", _line(content, uses), uses, "warning", 1.0
            if isinstance(run, str):
                for expression in (x.split("}}")[0] for x in run.split("${{")[1:]):
                    if hit := next((p for p in INJECTABLE if p in expression), None):
                        yield "actions-script-injection", _line(content, hit), hit, "error", 0.9


def _gitlab(doc: dict, content: str):
    includes = doc.get("include") or []
    for x in includes if isinstance(includes, list) else [includes]:
        url = x if isinstance(x, str) else x.get("remote") if isinstance(x, dict) else None
        if isinstance(url, str) and url.startswith(("http://", "https://")) and (isinstance(x, str) or not ("@sha256:" in url or "?ref=" in url)):
            yield "gitlab-unpinned-include", _line(content, url), url, "warning", 0.9
    jobs = [(k, v) for k, v in doc.items() if isinstance(k, str) and isinstance(v, dict) and not k.startswith(".") and k not in PIPELINE_KEYS]
    for scope, image, variables in [("default", doc.get("image"), doc.get("variables")), *((k, v.get("image"), v.get("variables")) for k, v in jobs)]:
        image = image.get("name") if isinstance(image, dict) else image
        if isinstance(image, str) and (image.endswith(":latest") or ":" not in image.rsplit("/", 1)[-1]):
            yield "gitlab-mutable-image", _line(content, image), f"{scope} {image}", "warning", 1.0
        for name, value in variables.items() if isinstance(variables, dict) else ():
            value = value.get("value") if isinstance(value, dict) else value
            if isinstance(value, str) and len(value) >= 8 and not value.startswith("$") and any(p in str(name).lower() for p in (*SECRET_NAMES, "auth")):
                yield "gitlab-literal-secret", _line(content, str(name)), str(name), "error", 0.85
    for name, job in jobs:
        if not job.get("tags"):
            yield "gitlab-insecure-runner", _line(content, f"{name}:"), name, "info", 0.7


def _compose(doc: dict, content: str):
    services = doc.get("services")
    for name, svc in services.items() if isinstance(services, dict) else ():
        if not isinstance(svc, dict):
            continue
        at = _line(content, f"{name}:")
        if svc.get("privileged") is True:
            yield "compose-privileged", _line(content, "privileged", at), str(name), "error", 1.0
        if svc.get("network_mode") == "host":
            yield "compose-host-network", _line(content, "network_mode", at), str(name), "warning", 1.0
        for vol in svc.get("volumes") or []:
            source = vol.split(":")[0] if isinstance(vol, str) else vol.get("source") if isinstance(vol, dict) and vol.get("type") == "bind" else None
            if isinstance(source, str) and (source.rstrip("/") or "/") in SENSITIVE_PATHS and source:
                yield "compose-host-mount", _line(content, source, at), source, "error", 1.0


def cicd(files: DataFrame) -> DataFrame:
    """All findings: rule_id, file, start_line, detail, severity, confidence."""
    typed = files.withColumn("kind", file_type("path")).where("kind is not null and content is not null")
    lines = lambda kind: numbered_lines(typed.where(F.col("kind") == kind)).withColumnsRenamed({"path": "file", "line_no": "n"})

    @F.pandas_udf(FOUND)
    def run(kind: pd.Series, content: pd.Series) -> pd.Series:
        names = ("rule_id", "start_line", "detail", "severity", "confidence")
        return pd.Series([[dict(zip(names, x)) for x in yaml_findings(k, c)] for k, c in zip(kind, content)])

    yaml = typed.where("kind in ('actions', 'gitlab', 'compose')").select(F.col("path").alias("file"), F.explode(run("kind", "content")).alias("x")).select("x.rule_id", "file", "x.start_line", "x.detail", "x.severity", "x.confidence")
    return yaml.unionByName(dockerfile_findings(lines("dockerfile"))).unionByName(systemd_findings(lines("systemd")))
