"""Rules on single lines and on lines around them: secrets, entropy, personal data, context windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import shannon_entropy, text_lines

#: Credential kinds from public token formats: (kind, pattern).
SECRETS = (
    ("aws-access-key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("aws-secret-key", r"(?i)aws_secret_access_key\s*[:=]\s*[\"']?[A-Za-z0-9/+=]{40}"),
    ("gcp-api-key", r"\bAIza[0-9A-Za-z_\-]{35}\b"),
    ("gcp-service-account", r"\"type\"\s*:\s*\"service_account\""),
    ("azure-storage-key", r"AccountKey=[A-Za-z0-9+/=]{60,}"),
    ("github-token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("github-fine-grained", r"\bgithub_pat_[A-Za-z0-9_]{22,}\b"),
    ("gitlab-token", r"\bglpat-[A-Za-z0-9_\-]{20,}\b"),
    ("slack-token", r"\bxox[baprs]-[A-Za-z0-9\-]{10,}\b"),
    ("slack-webhook", r"hooks\.slack\.com/services/T[A-Z0-9]+/B[A-Z0-9]+/[A-Za-z0-9]+"),
    ("stripe-key", r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}\b"),
    ("sendgrid-key", r"\bSG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}"),
    ("twilio-key", r"\bSK[0-9a-f]{32}\b"),
    ("heroku-key", r"(?i)heroku.{0,20}[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
    ("npm-token", r"\bnpm_[A-Za-z0-9]{36}\b"),
    ("private-key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY"),
    ("jwt", r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{5,}"),
    ("basic-auth-url", r"[a-z][a-z0-9+.\-]*://[^/\s:@]+:[^/\s:@]+@"),
    ("generic-secret", r"(?i)(?:password|passwd|secret|token|api_?key)\s*[:=]+\s*[\"'][^\"'\s]{8,}[\"']"),
)
#: Each kind's pattern needs one of these (in any case), ``SK``, or an address with a name.
MARKS = (
    "akia", "asia", "aws_secret_access_key", "aiza", "service_account", "accountkey=", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xoxb", "xoxa", "xoxp", "xoxr", "xoxs",
    "hooks.slack.com", "sk_live_", "sk_test_", "rk_live_", "rk_test_", "sg.", "heroku", "npm_", "private key", "eyj", "password", "passwd", "secret", "token", "apikey", "api_key",
)
#: Paths whose secrets are test data.
TEST_PATHS = r"(_test\.go$)|(^|/)test_[^/]*$|(^|/)(tests|testdata|fixtures|examples)/"


def numbered_lines(files: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """key, line_no (from 1), line."""
    return files.select(F.col(key), F.posexplode(text_lines(text)).alias("at", "line")).select(key, (F.col("at") + 1).alias("line_no"), "line")


def line_counts(lines: DataFrame, key: str = "path") -> DataFrame:
    """key, total_lines, code_lines: all lines, and those neither blank nor comments."""
    code = (F.trim("line") != "") & ~F.col("line").rlike(r"^\s*(//|#)")
    return lines.groupBy(key).agg(F.count("*").alias("total_lines"), F.count_if(code).alias("code_lines"))


def secret_kind(line: str | Column) -> Column:
    """The first credential kind that a line holds, null if none."""
    c = F.col(line) if isinstance(line, str) else line
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(SECRETS):
        out = F.when(c.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def secrets(lines: DataFrame, path: str | None = None) -> DataFrame:
    """Lines with a credential and its kind; files under test paths are left out if ``path`` is given."""
    kept = lines.where(~F.col(path).rlike(TEST_PATHS)) if path else lines
    # patterns are tried on the few lines that hold what one of them can't do without
    low = F.lower("line")
    held = (F.contains("line", F.lit("SK"))) | (low.contains("://") & low.contains("@"))
    for mark in MARKS:
        held = held | low.contains(mark)
    kept = kept.where(held)
    return kept.withColumn("kind", secret_kind("line")).where("kind is not null")


#: Personal data: mail addresses, IPv4 addresses, long digit runs.
MAIL, ADDRESS, DIGITS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b", r"[0-9]{13,19}"


def personal_data(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no, has_mail, has_ip, has_digits of lines that hold any."""
    hit = F.col("line").rlike
    found = lines.where(hit(f"{MAIL}|{ADDRESS}|{DIGITS}"))
    return found.select(key, "line_no", hit(MAIL).alias("has_mail"), hit(ADDRESS).alias("has_ip"), hit(DIGITS).alias("has_digits"))


def high_entropy(tokens: DataFrame, token: str = "token", least: float = 4.5) -> DataFrame:
    """Tokens of 16 to 256 characters with that many bits a character or more; URLs, paths, format strings, statements of SQL and sentences left out."""
    c = F.col(token)
    odd = c.rlike(r"(?i)^(?:select|insert|update|delete|create|alter|drop)\b") | c.rlike(r"^[a-z]+://|^[./~]|/.*/|%[sdv]|\{\}|\s")
    return tokens.where(F.length(c).between(16, 256) & ~odd).withColumn("entropy", shannon_entropy(c)).where(F.col("entropy") >= least)


def near(lines: DataFrame, keys: list[str], order: str, flag: Column, back: int, ahead: int) -> Column:
    """Whether ``flag`` holds on a line from ``back`` before to ``ahead`` after, in a file's order."""
    return F.max(F.when(flag, 1).otherwise(0)).over(W.partitionBy(*keys).orderBy(order).rowsBetween(-back, ahead)) == 1
