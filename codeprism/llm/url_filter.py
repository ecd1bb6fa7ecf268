"""Host-suffix / path-prefix URL rules found through short hash prefixes [native].

A URL is expanded into the expressions that a rule could be stored under:
the suffixes of its host with as many labels as rules have, crossed with its
path's prefixes of the lengths that rules have. Expressions meet rules in an equi-join
on the first 32 bits of their SHA-256, a full digest comparison confirms the
hit, and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

RULE_SCHEMA = "action string, host string, path string"
#: The rules of the contract query.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Rules up to this many rows are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only (``lower`` would also fold other letters)."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))



def _split_url(df: DataFrame, url: str) -> DataFrame:
    df = df.withColumn("__url", F.coalesce(F.col(url), F.lit("")))
    rest = F.expr("CASE WHEN instr(__url, '://') > 0 THEN substring(__url, instr(__url, '://') + 3) ELSE '' END")
    df = df.withColumn("__rest", rest)
    df = df.withColumn("__host", ascii_lower(F.regexp_extract("__rest", r"^([^/?#]*)", 1)))
    return df.withColumn("__path", F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1))


def url_filter(df: DataFrame, rules: DataFrame, url: str = "url", keep: Sequence[str] = (), default: str = "allow") -> DataFrame:
    """Judge ``df[url]`` by ``rules`` (action, host, path).

    Returns the columns ``keep`` of ``df`` and host, path, rule, verdict, a row
    per input row. The rule with the longest host plus path wins; at equal
    length the longer host, then ``block``. No rule: null and ``default``.

    Null URLs and URLs without ``://`` have an empty host and path; a rule with
    an empty host fits nothing. Rules with a null action or host are ignored, a
    null path is empty, repeated rules count once. Other columns of ``df`` are
    not looked at, whatever their names; repeated rows stay apart.
    """
    rules = rules.select(
        F.col("action").alias("r_action"), ascii_lower(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path")
    ).where("r_action is not null and r_host <> ''")
    rules = rules.distinct()
    # The distinct lengths of rule paths: bounded by the longest path, not by the number of rules.
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().collect())
    # Likewise for the labels of rule hosts, so that a URL's host is never expanded beyond the longest.
    depths = sorted(r[0] for r in rules.select(F.size(F.split("r_host", r"\."))).distinct().collect())
    n_rules = rules.limit(BROADCAST_RULES + 1).count()
    rules = rules.withColumn("r_digest", F.sha2(F.concat("r_host", F.lit("\n"), "r_path"), 256)).withColumn("r_short", F.substring("r_digest", 1, 8))
    if n_rules <= BROADCAST_RULES:
        rules = F.broadcast(rules)

    base = df.select(F.struct(*keep).alias("__keep") if keep else F.lit(None).cast("struct<x:int>").alias("__keep"), F.col(url))
    base = _split_url(base, url).withColumn("__uid", F.monotonically_increasing_id())
    base = base.select("__uid", "__keep", "__host", "__path")
    labels = F.length("__host") - F.length(F.replace("__host", F.lit("."), F.lit(""))) + 1
    suffixes = F.array_compact(F.array(*(F.when(labels >= d, F.substring_index("__host", ".", -d)) for d in depths))) if depths else F.array().cast("array<string>")
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("__path")), lambda n: F.substring(F.col("__path"), F.lit(1), n))
    expressions = F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\n"), p)))))
    probes = base.withColumn("__expr", F.explode_outer(expressions)).withColumn("__digest", F.sha2("__expr", 256)).withColumn("__short", F.substring("__digest", 1, 8))
    hits = probes.join(rules, F.col("__short") == F.col("r_short"), "left")
    good = F.col("r_digest") == F.col("__digest")
    rank = F.when(
        good,
        F.struct(
            (F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), (F.col("r_action") == "block").cast("int").alias("b"),
            F.concat("r_host", "r_path").alias("rule"), F.col("r_action").alias("action"),
        ),
    )
    best = hits.groupBy("__uid").agg(F.max(rank).alias("best"), F.first("__keep").alias("k"), F.first("__host").alias("host"), F.first("__path").alias("path"))
    return best.select(*([F.col("k")[c].alias(c) for c in keep]), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for every row of ``pages``."""
    return url_filter(table(spark, sf_dir, "pages"), spark.createDataFrame(list(RULES), RULE_SCHEMA), keep=["page_id"])


OP9_SQL = r"""
WITH rules(action, rhost, rpath) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
rest AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, row_number() OVER () AS u,
    translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hit AS (
  SELECT u, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY u ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC) AS k
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN hit ON parts.u = hit.u AND k = 1
"""
