"""Column functions that the rules share; all run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_lines(c: str | Column) -> Column:
    """Lines without their ends; what follows the last line break is a line only if it isn't empty."""
    text = col(c)
    parts = F.split(text, "\n")
    kept = F.when(F.endswith(text, F.lit("\n")), F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).when(text == "", F.array().cast("array<string>")).otherwise(parts)
    return F.transform(kept, lambda x: F.regexp_replace(x, "\r$", ""))


def last_segment(c: str | Column, sep: str = "/") -> Column:
    return F.element_at(F.split(col(c), re.escape(sep)), -1)


def strip_suffix_runs(c: str | Column, *suffixes: str) -> Column:
    """Remove each suffix as often as it stands at the end, in the order given."""
    out = col(c)
    for s in suffixes:
        out = F.regexp_replace(out, f"({re.escape(s)})+$", "")
    return out


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression. ``*`` and ``?`` also match ``/``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            while pattern[i : i + 1] == "*":
                i += 1
            out += ".*"
            continue
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner).replace("\\", "\\\\") + "]"
            i = end + 1
            continue
        out += "." if c == "?" else re.escape(c)
        i += 1
    return f"(?s)^{out}$"


#: What file extensions say about a language.
EXTENSIONS = {
    "go": "go", "py": "python", "php": "php", "dart": "dart", "cs": "csharp", "rs": "rust", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "java": "java",
}


def language_of(path: str | Column) -> Column:
    """Language by extension, null if unknown."""
    table = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return F.element_at(table, F.lower(F.regexp_extract(col(path), r"\.([^./]+)$", 1)))


def severity_rank(c: str | Column) -> Column:
    return F.when(col(c) == "error", 2).when(col(c) == "warning", 1).when(col(c) == "info", 0)


def parse_severity(c: str | Column) -> Column:
    """Severity names with their short forms; null for ``off`` and anything else."""
    low = F.lower(F.trim(col(c)))
    return F.when(low.isin("error", "err"), "error").when(low.isin("warning", "warn"), "warning").when(low == "info", "info")


def grade(score: str | Column) -> Column:
    s = col(score)
    return F.when(s >= 90, "A").when(s >= 80, "B").when(s >= 70, "C").when(s >= 60, "D").otherwise("F")


def version_parts(c: str | Column) -> Column:
    """A version as numbers: split at dots, leading digits only."""
    return F.transform(F.split(col(c), r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^\d+", 0).try_cast("bigint"), F.lit(0).cast("bigint")))


def _padded(a: Column, b: Column) -> Column:
    """``a`` with zeros up to the length of ``b``."""
    return F.concat(a, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.size(b) - F.size(a), F.lit(0))))


def version_in_range(version: str | Column, low: str | Column, high: str | Column) -> Column:
    """``low <= version < high``; a low of "" or "0" is open, so is a high of "". Missing parts are zeros."""
    v, lo, hi = version_parts(version), version_parts(low), version_parts(high)
    above = col(low).isin("", "0") | (_padded(v, lo) >= _padded(lo, v))
    return above & ((col(high) == "") | (_padded(v, hi) < _padded(hi, v)))


def window_digest(tokens: Column) -> Column:
    """Identity of a token window: SHA-256, in hex digits, over tokens that each end with a zero byte."""
    return F.sha2(F.concat(F.array_join(tokens, "\x00"), F.lit("\x00")), 256)


def window_fingerprint(tokens: Column) -> Column:
    """Label of a token window: eight hex digits of its digest, which unlike windows can share."""
    return F.concat(F.lit("dup:"), F.substring(window_digest(tokens), 1, 8))


def shannon_entropy(c: str | Column) -> Column:
    """Bits per character of a string, from the counts of its characters."""
    s = col(c)
    chars = F.split(s, "")
    n = F.length(s).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)).cast("double"))
    return F.when(n > 0, F.aggregate(counts, F.lit(0.0), lambda acc, k: acc - (k / n) * F.log2(k / n))).otherwise(F.lit(0.0))


def html_escape(c: str | Column) -> Column:
    out = F.replace(col(c), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
