"""Registered queries over the test tables, with the SQL they are held against.

The test tables hold no source trees, so documents stand for files, events for
findings and metrics, and the order tables for metrics, ranges and edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import scalars as S
from ..operators import clones, diffs, findings as fi, graph, health, line_rules as rules, telemetry
from . import planted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Tokens in a window of the clone queries.
WINDOW = 20


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_arrays(spark: SparkSession, sf_dir: str, name: str = "documents", id: str = "doc_id") -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(id).alias("file"), F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[ \n\r\t]+"), "").alias("toks"))


_TOKENS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \n\r\t]+'), lambda x: x <> '')"
_WINDOWS = f"""
toks AS (SELECT doc_id AS file, {_TOKENS} AS t FROM documents),
cut AS (SELECT file, t, unnest(range(0, len(t) - {WINDOW - 1})) AS pos FROM toks WHERE len(t) >= {WINDOW}),
windows AS (SELECT file, pos, sha256(array_to_string(t[pos + 1 : pos + {WINDOW}], chr(0)) || chr(0)) AS f FROM cut),
hot AS (SELECT f, count(*) AS n FROM windows GROUP BY f HAVING count(*) > 1),
near AS (SELECT file, pos, f, n, count(*) OVER (PARTITION BY f, file ORDER BY pos RANGE BETWEEN {WINDOW - 1} PRECEDING AND 1 PRECEDING) AS close,
  count(*) OVER (PARTITION BY f, file ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND {WINDOW - 1} FOLLOWING) AS later FROM windows JOIN hot USING (f)),
paired AS (SELECT file, f, pos AS s, pos + {WINDOW - 1} AS e FROM near WHERE n - 1 - close - later > 0),
counted AS (SELECT f, any_value(n) AS n, count(DISTINCT file) AS files, any_value(n) * (any_value(n) - 1) // 2 - CAST(sum(close) AS BIGINT) AS pairs FROM near GROUP BY f)"""


# -- clone detection ---------------------------------------------------------


@query(f"""
WITH RECURSIVE {_WINDOWS},
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM paired),
blocks AS (SELECT file, f, s, e, file * 1000000 + sum(fresh) OVER (PARTITION BY file ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS block FROM marked),
edges AS (SELECT DISTINCT first AS a, block AS b FROM (SELECT block, min(block) OVER (PARTITION BY f) AS first FROM blocks) WHERE first <> block),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
walk(node, seen) AS (SELECT DISTINCT block, block FROM blocks UNION SELECT x.b, w.seen FROM walk w JOIN both_ways x ON x.a = w.node),
families AS (SELECT node AS block, min(seen) AS family FROM walk GROUP BY node),
spans AS (SELECT family, file, min(s) AS s, max(e) AS e FROM blocks JOIN families USING (block) GROUP BY family, file, block),
touching AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY family, file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM spans),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY family, file ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM touching),
places AS (SELECT family, file::VARCHAR AS file, min(s) AS s, max(e) AS e FROM numbered GROUP BY family, numbered.file, k),
bytes AS (SELECT *, encode(file || ':') || unhex(substr(printf('%08X', s), 7, 2) || substr(printf('%08X', s), 5, 2) || substr(printf('%08X', s), 3, 2) || substr(printf('%08X', s), 1, 2)) || encode('-')
  || unhex(substr(printf('%08X', e), 7, 2) || substr(printf('%08X', e), 5, 2) || substr(printf('%08X', e), 3, 2) || substr(printf('%08X', e), 1, 2)) || encode(chr(10)) AS raw FROM places),
whole AS (SELECT family, count(*) AS occurrences, count(DISTINCT file) AS files, list_reduce(list(raw ORDER BY file, s), lambda x, y: x || y) AS raw FROM bytes GROUP BY family),
pairs AS (SELECT family, CAST(sum(pairs) AS BIGINT) AS pairs FROM counted JOIN (SELECT DISTINCT f, family FROM blocks JOIN families USING (block)) USING (f) GROUP BY family)
SELECT 'dup:' || substr(sha256(raw), 1, 8) AS family_id, occurrences, files, pairs FROM whole JOIN pairs USING (family)
""")
def clone_families(spark, sf_dir):
    """Families of blocks that share windows, by id."""
    named = clones.family_ids(clones.clone_families(token_arrays(spark, sf_dir), WINDOW))
    files = F.size(F.array_distinct(F.transform("occurrences", lambda o: o["file"])))
    return named.select("family_id", F.size("occurrences").cast("bigint").alias("occurrences"), files.cast("bigint").alias("files"), "pairs")


@query(f"WITH {_WINDOWS} SELECT 'dup:' || substr(f, 1, 8) AS fingerprint, n, files, pairs FROM counted WHERE pairs > 0")
def clone_fingerprints(spark, sf_dir):
    """Repeated windows and their pairs."""
    return clones.repeated_windows(token_arrays(spark, sf_dir), WINDOW)


@query(f"""
WITH {_WINDOWS},
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM paired),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT file, CAST(min(s) AS BIGINT) AS "start", CAST(max(e) AS BIGINT) AS "end" FROM islands GROUP BY file, island
""")
def clone_blocks(spark, sf_dir):
    """Blocks of tokens that occur elsewhere, whole."""
    return clones.clone_blocks(token_arrays(spark, sf_dir), WINDOW)


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_dup_docs(spark, sf_dir):
    """C2 on whole files."""
    return table(spark, sf_dir, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(f"""
WITH toks AS (SELECT doc_id AS file, {_TOKENS} AS t FROM documents),
btoks AS (SELECT item_id, {_TOKENS} AS t FROM benchmark),
bplaces AS (SELECT item_id, t, unnest(range(0, len(t) - 9)) AS pos FROM btoks WHERE len(t) >= 10),
dplaces AS (SELECT file, t, unnest(range(0, len(t) - 9)) AS pos FROM toks WHERE len(t) >= 10),
b AS (SELECT DISTINCT item_id, sha256(array_to_string(t[pos + 1 : pos + 10], chr(0)) || chr(0)) AS f FROM bplaces),
d AS (SELECT file, sha256(array_to_string(t[pos + 1 : pos + 10], chr(0)) || chr(0)) AS f FROM dplaces)
SELECT file AS doc_id, item_id, count(*) AS windows FROM d JOIN b USING (f) GROUP BY 1, 2
""")
def benchmark_overlap(spark, sf_dir):
    """C2 across corpora: token windows of documents that occur in benchmark items."""
    items = token_arrays(spark, sf_dir, "benchmark", "item_id")
    return clones.shared_windows(token_arrays(spark, sf_dir), items, 10).withColumnsRenamed({"file": "doc_id", "other": "item_id"})


# -- lines -------------------------------------------------------------------

_LINES = """
lines AS (SELECT doc_id, CAST(unnest(range(1, len(p) + 1)) AS INTEGER) AS line_no, regexp_replace(unnest(p), chr(13) || '$', '') AS line FROM (
  SELECT doc_id, CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS p
  FROM documents WHERE text IS NOT NULL))"""


def doc_lines(spark, sf_dir):
    return rules.numbered_lines(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text")


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS total_lines, count(*) FILTER (trim(line) <> '' AND NOT regexp_matches(line, '^\\s*(//|#)')) AS code_lines FROM lines GROUP BY doc_id")
def line_counts(spark, sf_dir):
    """All lines, and those neither blank nor comments."""
    return rules.line_counts(doc_lines(spark, sf_dir), "doc_id")


@query("""
SELECT page_id, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'js' THEN 'javascript' WHEN 'java' THEN 'java' END AS language
FROM (SELECT page_id, 'src/f' || page_id || CASE page_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.GO' WHEN 2 THEN '.js' WHEN 3 THEN '.java' ELSE '.html' END AS path FROM pages)
""")
def language_detect(spark, sf_dir):
    """S3: language by extension."""
    ext = F.when(F.col("page_id") % 5 == 0, ".py").when(F.col("page_id") % 5 == 1, ".GO").when(F.col("page_id") % 5 == 2, ".js").when(F.col("page_id") % 5 == 3, ".java").otherwise(".html")
    return table(spark, sf_dir, "pages").select("page_id", S.language_of(F.concat(F.lit("src/f"), "page_id", ext)).alias("language"))


IGNORED = ("*spam-farm*", "*/es/*", "http://*.html")


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '(?s)^.*spam-farm.*$') AND NOT regexp_matches(url, '(?s)^.*/es/.*$') AND NOT regexp_matches(url, '(?s)^http://.*\\.html$')")
def ignore_filter(spark, sf_dir):
    """Paths that no ignore glob fits."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    for pattern in IGNORED:
        pages = pages.where(~F.col("url").rlike(S.glob_regex(pattern)))
    return pages


@query(f"""
WITH {_LINES} SELECT doc_id, line_no, 'generic-secret' AS kind FROM lines
WHERE regexp_matches(line, '(?i)(?:password|passwd|secret|token|api_?key)\\s*[:=]+\\s*["''][^"''\\s]{{8,}}["'']')
""")
def secret_lines(spark, sf_dir):
    """SE1: lines with a credential."""
    return rules.secrets(doc_lines(spark, sf_dir)).select("doc_id", "line_no", "kind")


@query(f"""
WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents),
d AS (SELECT DISTINCT doc_id, token FROM t WHERE length(token) BETWEEN 16 AND 256 AND NOT regexp_matches(token, '^[a-z]+://|^[./~]|/.*/|%[sdv]|\\{{\\}}|\\s')),
c AS (SELECT doc_id, token, unnest(string_split(token, '')) AS ch FROM d),
p AS (SELECT doc_id, token, ch, count(*) / length(token) AS p FROM c GROUP BY doc_id, token, ch)
SELECT doc_id, token, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY doc_id, token HAVING -sum(p * log2(p)) >= 3.9
""")
def high_entropy_tokens(spark, sf_dir):
    """SE2: tokens with many bits a character."""
    tokens = token_arrays(spark, sf_dir).select(F.col("file").alias("doc_id"), F.explode(F.array_distinct("toks")).alias("token"))
    return rules.high_entropy(tokens, least=3.9).withColumn("entropy", F.round("entropy", 6))


_FOUND = f"""
WITH {_LINES},
marks AS (SELECT doc_id, line_no FROM lines WHERE regexp_matches(line, '(?i)licen[sc]ed? under')),
dups AS (SELECT doc_id, line_no FROM (SELECT doc_id, line_no, line, count(*) OVER (PARTITION BY doc_id, line) AS n FROM lines) WHERE n > 1 AND length(line) > 0)"""


def _marks(spark, sf_dir):
    return doc_lines(spark, sf_dir).where(F.col("line").rlike(r"(?i)licen[sc]ed? under")).select(F.col("doc_id").alias("file"), F.col("line_no").alias("line"), F.array().cast("array<string>").alias("rules"))


def _dups(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    n = F.count("*").over(W.partitionBy("doc_id", "line"))
    return lines.withColumn("n", n).where("n > 1 and length(line) > 0").select(F.col("doc_id").alias("file"), F.col("line_no").alias("start_line"), F.lit("repeated-line").alias("rule_id"))


@query(_FOUND + " SELECT doc_id AS file, line_no AS start_line, 'repeated-line' AS rule_id FROM dups d WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.doc_id = d.doc_id AND d.line_no BETWEEN m.line_no AND m.line_no + 1)")
def suppressed_lines(spark, sf_dir):
    """Findings without a suppression on their line or the one above."""
    return fi.suppress(_dups(spark, sf_dir), _marks(spark, sf_dir))


@query(_FOUND + " SELECT doc_id AS file, line_no AS line FROM marks m WHERE NOT EXISTS (SELECT 1 FROM dups d WHERE m.doc_id = d.doc_id AND d.line_no BETWEEN m.line_no AND m.line_no + 1)")
def stale_suppressions(spark, sf_dir):
    """Suppressions that suppress nothing."""
    return fi.stale_suppressions(_marks(spark, sf_dir), _dups(spark, sf_dir)).select("file", "line")


@query(_FOUND + " SELECT doc_id AS file, line_no, line FROM lines l WHERE NOT EXISTS (SELECT 1 FROM dups d WHERE d.doc_id = l.doc_id AND d.line_no = l.line_no)")
def apply_deletes(spark, sf_dir):
    """FX4: lines that are left when edits delete repeated ones."""
    gone = _dups(spark, sf_dir).select("file", "start_line", F.col("start_line").alias("end_line"))
    return fi.without_lines(doc_lines(spark, sf_dir).withColumnRenamed("doc_id", "file"), gone).select("file", "line_no", "line")


@query("""
SELECT conv_id, turn, hit > 0 AS hit, max(hit) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) > 0 AS near_hit
FROM (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND length(text) > 120 THEN 1 ELSE 0 END AS hit FROM conversations)
""")
def context_window_rules(spark, sf_dir):
    """What stands within two rows of a row."""
    hit = (F.col("role") == "assistant") & (F.length("text") > 120)
    turns = table(spark, sf_dir, "conversations")
    return turns.withColumn("near_hit", rules.near(turns, ["conv_id"], "turn", hit, 2, 2)).select("conv_id", "turn", F.coalesce(hit, F.lit(False)).alias("hit"), "near_hit")


@query(f"""
WITH {_LINES}, marked AS (SELECT doc_id, line_no, regexp_matches(line, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') AS has_mail,
  regexp_matches(line, '\\b[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}\\b') AS has_ip, regexp_matches(line, '[0-9]{{13,19}}') AS has_digits FROM lines)
SELECT * FROM marked WHERE has_mail OR has_ip OR has_digits
""")
def pii_lines(spark, sf_dir):
    """SE1-like: lines with mail addresses, IPv4 addresses or long digit runs."""
    return rules.personal_data(doc_lines(spark, sf_dir))


@query("""SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) GROUP BY page_id, link""")
def page_links(spark, sf_dir):
    """CI4, P6: all matches of an expression in a text."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


# -- findings: events --------------------------------------------------------

_EVENTS = """
findings AS (SELECT event_id, 'm' || (event_id % 4) || ':' || event_type AS rule_id, 'f' || user_id AS file, CAST(event_id % 100 AS INTEGER) AS start_line, event_type AS message, ts, value, user_id, event_type,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'warning' ELSE 'info' END AS severity FROM events)"""


def event_findings(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type").isin("purchase", "signup"), "warning").otherwise("info")
    return e.select(
        "event_id", F.concat(F.lit("m"), F.col("event_id") % 4, F.lit(":"), "event_type").alias("rule_id"), F.concat(F.lit("f"), "user_id").alias("file"),
        (F.col("event_id") % 100).cast("int").alias("start_line"), F.col("event_type").alias("message"), "ts", "value", "user_id", "event_type", severity.alias("severity"),
    )


@query(f"""
WITH {_EVENTS} SELECT CASE WHEN g = 3 THEN 'file' WHEN g = 5 THEN 'rule' ELSE 'severity' END AS mode, coalesce(file, rule_id, severity) AS key, n, errors, worst FROM (
  SELECT file, rule_id, severity, grouping(file, rule_id, severity) AS g, count(*) AS n, count(*) FILTER (severity = 'error') AS errors,
    max(CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS worst FROM findings GROUP BY GROUPING SETS ((file), (rule_id), (severity)))
""")
def findings_groupings(spark, sf_dir):
    """Three groupings in one pass."""
    return fi.groupings(event_findings(spark, sf_dir))


@query(f"""
WITH {_EVENTS} SELECT split_part(rule_id, ':', 1) AS module_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos
FROM findings GROUP BY 1
""")
def severity_pivot(spark, sf_dir):
    """Counts by module and severity."""
    return fi.severity_counts(event_findings(spark, sf_dir), [fi.module_of("rule_id").alias("module_id")])


@query(f"WITH {_EVENTS} SELECT event_id, rule_id, severity FROM findings WHERE severity IN ('error', 'warning') AND split_part(rule_id, ':', 1) NOT IN ('m2')")
def finding_filter(spark, sf_dir):
    """severity and module filters."""
    return fi.visible(event_findings(spark, sf_dir), ["error", "warning"], ["m2"]).select("event_id", "rule_id", "severity")


@query(f"WITH {_EVENTS} SELECT event_id, rule_id FROM findings WHERE rule_id = 'm1:error' UNION ALL SELECT event_id, rule_id FROM findings WHERE split_part(rule_id, ':', 2) = 'signup'")
def rule_filter(spark, sf_dir):
    """findings of one rule, with and without its module."""
    e = event_findings(spark, sf_dir).select("event_id", "rule_id")
    return fi.by_rule(e, "m1:error").unionByName(fi.by_rule(e, "signup"))


_AUDIT = f"WITH {_EVENTS}, cur AS (SELECT * FROM findings WHERE ts >= TIMESTAMP '2024-01-15'), base AS (SELECT * FROM findings WHERE ts < TIMESTAMP '2024-01-15')"
_SAME = "c.rule_id = b.rule_id AND c.file = b.file AND c.start_line = b.start_line AND c.message = b.message"


def _halves(spark, sf_dir):
    e = event_findings(spark, sf_dir)
    return e.where("ts >= timestamp_ntz'2024-01-15'"), e.where("ts < timestamp_ntz'2024-01-15'")


@query(f"{_AUDIT} SELECT event_id, rule_id, file, start_line FROM cur c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE {_SAME})")
def audit_new(spark, sf_dir):
    """J14, AU1: findings that the baseline hasn't."""
    return diffs.new_findings(*_halves(spark, sf_dir)).select("event_id", "rule_id", "file", "start_line")


@query(f"{_AUDIT} SELECT event_id, rule_id, file, start_line FROM base b WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE {_SAME})")
def audit_resolved(spark, sf_dir):
    """Findings that are gone."""
    return diffs.resolved_findings(*_halves(spark, sf_dir)).select("event_id", "rule_id", "file", "start_line")


@query(f"""
{_AUDIT}, n AS (SELECT (SELECT count(*) FROM cur c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE {_SAME})) AS new_count,
  (SELECT count(*) FROM base b WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE {_SAME})) AS resolved_count, (SELECT count(*) FROM cur) AS total, (SELECT count(*) FROM base) AS old)
SELECT new_count, resolved_count, total, total - old AS score_delta, CASE WHEN new_count >= 5 THEN 'fail' WHEN new_count >= 1 THEN 'warn' ELSE 'pass' END AS verdict FROM n
""")
def audit_verdict(spark, sf_dir):
    """A17, A18, AU1: counts, delta and verdict."""
    return diffs.audit(*_halves(spark, sf_dir))


@query(f"""
{_AUDIT}, new AS (SELECT 'new-finding' AS rule_id, file, start_line, 'new issue: ' || rule_id || ' in ' || file || ' at line ' || start_line AS message FROM cur c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE {_SAME})),
n AS (SELECT (SELECT count(*) FROM cur) AS c, (SELECT count(*) FROM base) AS b, (SELECT count(*) FROM new) AS k)
SELECT * FROM new UNION ALL SELECT 'score-regression', 'baseline.json', 1, 'finding count increased by ' || (c - b) || ' (baseline: ' || b || ', current: ' || c || ')' FROM n WHERE c > b
UNION ALL SELECT 'threshold-exceeded', 'baseline.json', 1, 'audit verdict: FAIL (' || k || ' relevant findings exceed threshold 5)' FROM n WHERE k >= 5
""")
def audit_rows(spark, sf_dir):
    """AU1: the findings of an audit."""
    return diffs.audit_findings(*_halves(spark, sf_dir)).select("rule_id", "file", "start_line", "message")


@query("""
WITH a AS (SELECT DISTINCT event_type, user_id FROM events WHERE ts < TIMESTAMP '2024-01-15'), b AS (SELECT DISTINCT event_type, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'),
n AS (SELECT (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS new, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS resolved, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS unchanged)
SELECT new, resolved, unchanged, CASE WHEN new + unchanged > 0 THEN new / (new + unchanged) ELSE 0.0 END AS rate FROM n
""")
def churn_halves(spark, sf_dir):
    """Set churn between two halves of the events."""
    now, before = _halves(spark, sf_dir)
    return diffs.churn(now, before, ("event_type", "user_id"))


@query("""
WITH m AS (SELECT event_type AS name, ts < TIMESTAMP '2024-01-15' AS early, CAST(count(*) AS DOUBLE) AS value FROM events WHERE event_type <> 'view' OR ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2),
j AS (SELECT coalesce(a.name, b.name) AS name, coalesce(a.value, 0) AS baseline, coalesce(b.value, 0) AS current
  FROM (SELECT * FROM m WHERE early) a FULL JOIN (SELECT * FROM m WHERE NOT early) b ON a.name = b.name)
SELECT name, baseline, current, current - baseline AS delta,
  CASE WHEN abs(current - baseline) < 0.001 THEN 'stable' WHEN (CASE WHEN name = 'purchase' THEN current - baseline ELSE baseline - current END) > 0 THEN 'improved' ELSE 'degraded' END AS direction FROM j
""")
def impact_trend(spark, sf_dir):
    """Metrics of two snapshots."""
    e = table(spark, sf_dir, "events").where("event_type <> 'view' or ts >= timestamp_ntz'2024-01-15'")
    half = lambda c: e.where(c).groupBy(F.col("event_type").alias("name")).agg(F.count("*").cast("double").alias("value"))
    return diffs.compare_metrics(half("ts < timestamp_ntz'2024-01-15'"), half("ts >= timestamp_ntz'2024-01-15'"), ("purchase",))


@query("""
WITH b AS (SELECT l_returnflag || l_linenumber AS rule_id, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1),
c AS (SELECT l_returnflag || l_linenumber AS rule_id, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' GROUP BY 1),
j AS (SELECT coalesce(b.rule_id, c.rule_id) AS rule_id, coalesce(b.n, 0) AS b, coalesce(c.n, 0) AS c FROM b FULL JOIN c ON b.rule_id = c.rule_id)
SELECT rule_id, greatest(b - c, 0) AS fixed, greatest(c - b, 0) AS introduced, least(b, c) AS persisted,
  CASE WHEN greatest(b - c, 0) + least(b, c) > 0 THEN greatest(b - c, 0) * 100.0::DOUBLE / (greatest(b - c, 0) + least(b, c)) ELSE 0.0 END AS fix_rate FROM j
""")
def catch_rate(spark, sf_dir):
    """What was fixed between two snapshots, by rule."""
    li = table(spark, sf_dir, "lineitem")
    count = lambda c: li.where(c).groupBy(F.concat("l_returnflag", "l_linenumber").alias("rule_id")).agg(F.count("*").alias("n"))
    return diffs.catch_rate(count("l_shipdate < timestamp_ntz'1999-01-01'"), count("l_shipdate >= timestamp_ntz'1999-01-01'"))


@query(f"WITH {_EVENTS} SELECT user_id, event_type, arg_max(value, event_id) AS last_value, max(event_id) AS last_seq FROM findings GROUP BY user_id, event_type")
def metric_last_value(spark, sf_dir):
    """The last value of each metric and label."""
    return fi.last_values(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "event_id")


@query("SELECT event_type, round(sum(CAST(value AS DECIMAL(18, 2)))::DOUBLE, 2) AS total, count(*) AS points FROM events WHERE event_type IN ('error', 'purchase', 'signup') GROUP BY event_type")
def prom_sum_by(spark, sf_dir):
    """A sum by label with a label selector."""
    return telemetry.sum_by(table(spark, sf_dir, "events"), "event_type", "error|purchase|signup")


@query("SELECT count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'click') AS misses, count(*) FILTER (event_type = 'view') / count(*) FILTER (event_type IN ('view', 'click')) AS hit_rate FROM events")
def cache_hit_rate(spark, sf_dir):
    """A22, ST4: hits over hits and misses."""
    return telemetry.hit_rate(table(spark, sf_dir, "events"), F.col("event_type") == "view", F.col("event_type") == "click")


@query(f"WITH {_EVENTS} SELECT rule_id, count(*) AS n, min(event_id) AS first_seen, dense_rank() OVER (ORDER BY min(event_id)) - 1 AS rule_index FROM findings GROUP BY rule_id")
def sarif_rule_index(spark, sf_dir):
    """Distinct rules in the order they were first seen."""
    return fi.rule_index(event_findings(spark, sf_dir), "event_id")


_POINTS = "points AS (SELECT event_id AS seq, event_type || (user_id % 20) AS name, value, CASE WHEN event_id % 997 = 0 THEN 'untrusted' ELSE 'trusted' END AS provenance FROM events)"
OPERATOR_NAMES = [f"{t}{k}" for t in ("error", "view") for k in range(0, 20, 3)]
USER_NAMES = [f"{t}{k}" for t in ("click", "purchase") for k in range(0, 20, 2)]


def _audience_sql(names: list[str]) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"WITH {_POINTS} SELECT seq, name, value FROM points WHERE name IN ({listed}) AND name NOT IN (SELECT name FROM points WHERE provenance = 'untrusted')"


def _points(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.concat("event_type", F.col("user_id") % 20).alias("name"), "value", F.when(F.col("event_id") % 997 == 0, "untrusted").otherwise("trusted").alias("provenance"))


@query(_audience_sql(OPERATOR_NAMES))
def audience_operator_only(spark, sf_dir):
    """What operators may see."""
    return fi.project_for_audience(_points(spark, sf_dir), "operator-only", OPERATOR_NAMES, USER_NAMES).select("seq", "name", "value")


@query(_audience_sql(USER_NAMES))
def audience_user_only(spark, sf_dir):
    """What users may see."""
    return fi.project_for_audience(_points(spark, sf_dir), "user-only", OPERATOR_NAMES, USER_NAMES).select("seq", "name", "value")


@query("SELECT event_id, event_type FROM events WHERE (event_id * 7919 + 104729) % 10000 < 2500")
def sampling_rate(spark, sf_dir):
    """TE4: a repeatable sampling decision."""
    return fi.sampled(table(spark, sf_dir, "events"), "event_id", 0.25).select("event_id", "event_type")


# -- metrics, ranges and edges: order tables ---------------------------------

_METRICS = "metrics AS (SELECT l_orderkey AS file, CAST(l_quantity AS INTEGER) AS cyclomatic, CAST(l_quantity * l_discount * 10 AS INTEGER) AS cognitive, CAST(floor(l_extendedprice / 500) AS INTEGER) AS lines, l_linenumber AS max_nesting, l_linenumber AS start_line FROM lineitem)"
_HEALTH = f"""
{_METRICS},
per AS (SELECT file, avg(cyclomatic) AS cyc, avg(cognitive) AS cog, max(lines) AS longest, max(max_nesting) AS deepest FROM metrics GROUP BY file),
pen AS (SELECT file, CASE WHEN cyc > 20 THEN CAST(trunc(least(30.0, (cyc - 20) * 3)) AS INTEGER) ELSE 0 END AS cyclomatic_penalty,
  CASE WHEN cog > 15 THEN CAST(trunc(least(30.0, (cog - 15) * 3)) AS INTEGER) ELSE 0 END AS cognitive_penalty,
  CASE WHEN longest > 100 THEN least(20, (longest - 100) // 20) ELSE 0 END AS size_penalty, CASE WHEN deepest > 4 THEN least(20, (deepest - 4) * 5) ELSE 0 END AS nesting_penalty FROM per),
scored AS (SELECT *, greatest(0, 100 - cyclomatic_penalty - cognitive_penalty - size_penalty - nesting_penalty) AS score FROM pen),
health AS (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM scored)"""


def order_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("file"), F.round("l_quantity").cast("int").alias("cyclomatic"), F.rint(F.col("l_quantity") * F.col("l_discount") * 10).cast("int").alias("cognitive"),
        F.floor(F.col("l_extendedprice") / 500).cast("int").alias("lines"), F.col("l_linenumber").alias("max_nesting"), F.col("l_linenumber").alias("start_line"),
    )


@query(f"WITH {_HEALTH} SELECT file, cyclomatic_penalty, cognitive_penalty, size_penalty, nesting_penalty, score, grade FROM health")
def file_health(spark, sf_dir):
    """A1, A2, A4, M8: health of each file."""
    return health.file_health(order_metrics(spark, sf_dir))


@query(f"WITH {_HEALTH} SELECT CAST(score AS INTEGER) AS score, total_files, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM (SELECT sum(score) // count(*) AS score, count(*) AS total_files FROM health)")
def project_health(spark, sf_dir):
    """Health of the whole."""
    return health.project_health(health.file_health(order_metrics(spark, sf_dir)))


@query(f"""
WITH {_HEALTH} SELECT 'high-cyclomatic' AS rule_id, file, start_line, cyclomatic AS value FROM metrics WHERE cyclomatic > 48
UNION ALL SELECT 'high-cognitive', file, start_line, cognitive FROM metrics WHERE cognitive > 45 UNION ALL SELECT 'low-health-score', file, 1, score FROM health WHERE score < 25
""")
def complexity_findings(spark, sf_dir):
    """M7: functions and files over their limits."""
    m = order_metrics(spark, sf_dir)
    return health.complexity_findings(m, health.file_health(m), 48, 45, 25)


@query("""
WITH c AS (SELECT l_partkey AS file, count(DISTINCT l_orderkey) AS commits FROM lineitem GROUP BY 1), m AS (SELECT l_partkey AS file, avg(l_quantity) AS avg_cyclomatic FROM lineitem GROUP BY 1),
h AS (SELECT c.file, commits, avg_cyclomatic * commits AS s FROM c JOIN m USING (file))
SELECT file, commits, round(s, 6) AS hotspot_score, CASE WHEN s >= 50 THEN 'refactoring-target' WHEN s >= 20 THEN 'hotspot' END AS rule_id FROM h
""")
def hotspots(spark, sf_dir):
    """Complexity times commits."""
    li = table(spark, sf_dir, "lineitem")
    commits = li.groupBy(F.col("l_partkey").alias("file")).agg(F.countDistinct("l_orderkey").alias("commits"))
    metrics = li.select(F.col("l_partkey").alias("file"), F.col("l_quantity").alias("cyclomatic"))
    return health.hotspots(commits, metrics).select("file", "commits", F.round("hotspot_score", 6).alias("hotspot_score"), "rule_id")


_RANGES = "ranges AS (SELECT l_orderkey AS file, l_linenumber * 5 + CAST(l_suppkey % 4 AS INTEGER) AS s, l_linenumber * 5 + CAST(l_suppkey % 4 + l_partkey % 6 AS INTEGER) AS e, l_linenumber FROM lineitem)"


def _ranges(spark, sf_dir):
    start = F.col("l_linenumber") * 5 + (F.col("l_suppkey") % 4).cast("int")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), start.alias("start"), (start + (F.col("l_partkey") % 6).cast("int")).alias("end"), "l_linenumber")


@query(f"""
WITH {_RANGES}, m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM ranges),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT file, min(s) AS "start", max(e) AS "end" FROM i GROUP BY file, island
""")
def range_coalesce(spark, sf_dir):
    """Ranges that overlap or touch, merged."""
    return clones.coalesce_ranges(_ranges(spark, sf_dir).select("file", "start", "end"), ["file"])


@query(f"""
WITH {_RANGES}, n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY s, e, l_linenumber) AS id FROM ranges)
SELECT DISTINCT a.file, a.id FROM n a JOIN n b ON a.file = b.file AND a.id <> b.id AND a.s <= b.e AND b.s <= a.e
""")
def edit_conflicts(spark, sf_dir):
    """J18, FX2: edits of a file that overlap another."""
    edits = _ranges(spark, sf_dir).withColumn("id", F.row_number().over(W.partitionBy("file").orderBy("start", "end", "l_linenumber")).cast("bigint"))
    return fi.edit_conflicts(edits.withColumnsRenamed({"start": "start_line", "end": "end_line"}))


@query("""
WITH v(pkg, lo, hi, advisory) AS (VALUES ('ECONOMY', '0', '20.5', 'A-1'), ('STANDARD', '10', '30.0.1', 'A-2'), ('PROMO', '', '', 'A-3'), ('LARGE', '5.3', '40', 'A-4')),
d AS (SELECT p_partkey, p_type, p_size || '.' || (p_partkey % 10) || CASE WHEN p_partkey % 3 = 0 THEN '-rc1' ELSE '' END AS version, p_size AS a, p_partkey % 10 AS b FROM part),
p AS (SELECT *, [a::BIGINT, b::BIGINT, 0::BIGINT] AS k FROM d),
r AS (SELECT *, CASE WHEN lo IN ('', '0') THEN NULL ELSE list_resize(list_transform(string_split(lo, '.'), lambda x: x::BIGINT), 3, 0::BIGINT) END AS l,
  CASE WHEN hi = '' THEN NULL ELSE list_resize(list_transform(string_split(hi, '.'), lambda x: x::BIGINT), 3, 0::BIGINT) END AS h FROM v)
SELECT p_partkey, version, advisory FROM p JOIN r ON p_type = pkg AND (l IS NULL OR k >= l) AND (h IS NULL OR k < h)
""")
def vulnerable_deps(spark, sf_dir):
    """Packages in vulnerable version ranges."""
    vulns = spark.createDataFrame([("ECONOMY", "0", "20.5", "A-1"), ("STANDARD", "10", "30.0.1", "A-2"), ("PROMO", "", "", "A-3"), ("LARGE", "5.3", "40", "A-4")], "pkg string, lo string, hi string, advisory string")
    version = F.concat("p_size", F.lit("."), F.col("p_partkey") % 10, F.when(F.col("p_partkey") % 3 == 0, "-rc1").otherwise(""))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", version.alias("version"))
    return parts.join(vulns, (F.col("p_type") == F.col("pkg")) & S.version_in_range("version", "lo", "hi")).select("p_partkey", "version", "advisory")


ZONES = [("api", "Brand#1*"), ("core", "Brand#2*"), ("data", "*#3?"), ("data", "Brand#[45]*")]
ZONE_RULES = [("api", "data", False), ("core", "api", False), ("core", "*", True), ("data", "*", False)]


@query("""
WITH z AS (SELECT p_partkey, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'api' WHEN p_brand LIKE 'Brand#2%' THEN 'core' WHEN regexp_matches(p_brand, '#3.$') OR regexp_matches(p_brand, '^Brand#[45]') THEN 'data' END AS zone FROM part),
e AS (SELECT DISTINCT a.zone AS from_zone, b.zone AS to_zone, l_orderkey FROM lineitem JOIN z a ON l_partkey = a.p_partkey JOIN z b ON b.p_partkey = l_suppkey)
SELECT from_zone, to_zone, count(*) AS n FROM e WHERE from_zone <> to_zone AND NOT CASE WHEN from_zone = 'api' AND to_zone = 'data' THEN false WHEN from_zone = 'core' AND to_zone = 'api' THEN false
  WHEN from_zone = 'core' THEN true WHEN from_zone = 'data' THEN false ELSE true END GROUP BY 1, 2
""")
def zone_violations(spark, sf_dir):
    """Edges between zones that rules deny, first match first."""
    zoned = fi.zones_of(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("path")), ZONES)
    a = zoned.select(F.col("p_partkey").alias("l_partkey"), F.col("zone").alias("from_zone"))
    b = zoned.select(F.col("p_partkey").alias("l_suppkey"), F.col("zone").alias("to_zone"))
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(a, "l_partkey").join(b, "l_suppkey").select("from_zone", "to_zone", "l_orderkey").distinct()
    return fi.boundary_violations(edges, ZONE_RULES).groupBy("from_zone", "to_zone").agg(F.count("*").alias("n"))


_GRAPH = """
o AS (SELECT o_custkey AS a, lead(o_custkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS b, o_orderdate AS d, o_orderkey AS k, o_orderpriority AS p FROM orders),
e AS (SELECT DISTINCT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d DESC, k DESC) AS late, row_number() OVER (PARTITION BY a ORDER BY d, k) AS early FROM o)
  WHERE (late = 1 OR early = 1) AND b IS NOT NULL)"""


def _edges(spark, sf_dir):
    """An edge from each customer to whoever orders next on the day of the customer's first order, and of the last."""
    day = W.partitionBy("o_orderdate").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.lead("o_custkey").over(day).alias("b"), "o_orderdate", "o_orderkey")
    when = F.struct("o_orderdate", "o_orderkey")
    ends = o.groupBy("a").agg(F.array(F.min_by("b", when), F.max_by("b", when)).alias("b"))
    return ends.select("a", F.explode("b").alias("b")).where("b is not null").distinct()


@query(f"WITH RECURSIVE {_GRAPH}, w(node) AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT e.b FROM w JOIN e ON e.a = w.node) SELECT node FROM w")
def reachability(spark, sf_dir):
    """Nodes that entry points reach."""
    seeds = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("node"))
    return graph.reachable(_edges(spark, sf_dir), seeds).select("node")


@query(f"""
WITH RECURSIVE {_GRAPH}, w(src, node) AS (SELECT a, b FROM e UNION SELECT w.src, e.b FROM w JOIN e ON e.a = w.node),
m AS (SELECT x.src AS node, x.node AS other FROM w x JOIN w y ON x.src = y.node AND x.node = y.src)
SELECT node, min(least(node, other)) AS component FROM m GROUP BY node HAVING count(*) FILTER (other <> node) > 0
""")
def cycles_scc(spark, sf_dir):
    """Strongly connected components."""
    return graph.strong_components(_edges(spark, sf_dir))


_COVERAGE = """
lcov AS (SELECT l_partkey AS path, l_suppkey AS line, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS hits FROM lineitem GROUP BY 1, 2),
changed AS (SELECT DISTINCT l_partkey AS path, l_suppkey AS line FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01'),
per AS (SELECT path, count(*) AS instrumented, count(*) FILTER (hits > 0) AS covered FROM changed JOIN lcov USING (path, line) GROUP BY path)"""


def _coverage(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    lcov = li.select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("line"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("hits"))
    return diffs.changed_line_coverage(li.where("l_shipdate >= timestamp_ntz'2000-01-01'").select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("line")), lcov)


@query(f"WITH {_COVERAGE} SELECT path, instrumented, covered, round(covered * 100.0::DOUBLE / instrumented, 6) AS percent FROM per")
def changed_coverage(spark, sf_dir):
    """Coverage of changed lines by file."""
    return _coverage(spark, sf_dir).withColumn("percent", F.round("percent", 6))


@query(f"""
WITH {_COVERAGE}, p AS (SELECT *, covered * 100.0::DOUBLE / instrumented AS percent FROM per),
t AS (SELECT CAST(sum(instrumented) AS BIGINT) AS instrumented, CAST(sum(covered) AS BIGINT) AS covered, min(percent) AS worst_percent FROM p)
SELECT instrumented, covered, (SELECT path FROM p ORDER BY percent, path LIMIT 1) AS worst_path, worst_percent, round(covered * 100.0::DOUBLE / instrumented, 6) AS percent, covered * 100.0::DOUBLE / instrumented >= 85 AS passed FROM t
""")
def coverage_gate(spark, sf_dir):
    """A19, PO1: whether changed lines are covered enough."""
    return diffs.coverage_gate(_coverage(spark, sf_dir), 85).withColumn("percent", F.round("percent", 6))


# -- event time: windows that the history endpoint would need ----------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(CAST(value AS DECIMAL(18, 2)))::DOUBLE, 2) AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark, sf_dir):
    """ST2: tumbling windows."""
    total = F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2)
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), total.alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


@query("""
WITH s AS (SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 1 MINUTE * 15 * k AS window_start FROM events, range(0, 4) r(k))
SELECT window_start, count(*) AS n FROM s GROUP BY window_start
""")
def window_sliding(spark, sf_dir):
    """ST2: sliding windows of an hour each quarter."""
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "15 minutes")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "n")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k
""")
def window_session(spark, sf_dir):
    """ST2: session windows with a gap of two hours."""
    s = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


@query("""
SELECT window_start, event_type, n FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2)
WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
""")
def stream_tumbling(spark, sf_dir):
    """ST1, ST2: a stream's closed windows, read to its end and written in append mode."""
    import uuid

    from ..streaming.streams import windowed_counts

    out = f"{graph.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1000)
    # the source lists a folder; the one file of a table is a pattern of one
    stream = windowed_counts(events.parquet(f"{sf_dir}/[e]vents.parquet"), "ts", ["event_type"], "1 day")
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


# -- the SQL surface ---------------------------------------------------------


@query("""
SELECT n_name, o_orderstatus, grouping(n_name, o_orderstatus) AS g, count(*) AS orders, round(sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE, 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, o_orderstatus)
""")
def cube_orders(spark, sf_dir):
    """Cube over a star join."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    j = table(spark, sf_dir, "orders").join(c, "o_custkey").join(table(spark, sf_dir, "nation"), "n_nationkey")
    total = F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2)
    return j.cube("n_name", "o_orderstatus").agg(F.grouping_id().alias("g"), F.count("*").alias("orders"), total.alias("total"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18, 2)))::DOUBLE AS sum_qty, round(sum(CAST(l_extendedprice AS DECIMAL(18, 2)))::DOUBLE, 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY l_returnflag, l_linestatus
""")
def pricing_summary(spark, sf_dir):
    """Filter and aggregation with push-down."""
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'2000-09-02'")
    dec = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), dec("l_quantity").alias("sum_qty"), F.round(dec("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))


@query("""
SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w AS rn, lag(o_totalprice) OVER w AS previous, ntile(4) OVER w AS quartile
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) WHERE rn <= 3
""")
def ranked_orders(spark, sf_dir):
    """Ranking and offset windows."""
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("rn"), F.lag("o_totalprice").over(w).alias("previous"), F.ntile(4).over(w).alias("quartile"))
    return o.where("rn <= 3")


@query("""
SELECT e.event_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts
""")
def asof_last_purchase(spark, sf_dir):
    """As-of join: the last purchase before each error, by one window over the union."""
    e = table(spark, sf_dir, "events").where("event_type in ('error', 'purchase')").select("user_id", "ts", "event_id", "event_type")
    w = W.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "purchase", 0).otherwise(1)).rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("purchase_id", last).where("event_type = 'error'").select("event_id", "purchase_id")


QUERIES.update(planted.QUERIES)
ORACLES.update(planted.ORACLES)
