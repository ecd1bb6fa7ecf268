"""Quality classifier: regularised quadratic discriminant analysis.

Each whole text becomes a short vector of statistics; counts go through log1p
and shares through a logit, so that the classes are near normal. Each class has
a mean and a covariance shrunk towards the pooled one and its diagonal. The
score is the logistic of the difference of Mahalanobis log densities (with
priors), computed against Cholesky factors that are inverted once.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

#: At most about this many labelled rows are fitted (a hash of the id picks them, alike for all sources).
FIT_ROWS = 20_000
#: How far a class covariance goes to the pooled one, and then to its own diagonal.
TO_POOLED, TO_DIAGONAL = 0.2, 0.1
RIDGE = 1e-3
FEATURES = (
    "log_chars", "log_words", "log_word_length", "upper", "digit", "space", "symbol", "sentence_mark", "bang", "bar",
    "unique_words", "repeated_neighbours", "unique_lines", "compression", "log_line_length", "long_words",
)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:'\"!?-()|"]] = True


def _logit(n: float, of: float, usual: float, weight: float) -> float:
    """Logit of the share ``n / of``, drawn to a ``usual`` share as if ``weight``
    more had been seen, so that short texts aren't judged by one character."""
    share = min(1.0, (n + usual * weight) / (of + weight))
    return float(np.log((share + 0.002) / (1.002 - share)))


def text_statistics(text: str | None) -> list[float]:
    """The vector of ``FEATURES`` of one whole text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    nw, nl = len(words), len(lines)
    letters = int(count[65:91].sum() + count[97:123].sum() + count[128:].sum())
    return [
        np.log1p(n + 200), np.log1p(nw + 40), np.log((n + 120) / (nw + 20)),
        _logit(count[65:91].sum(), letters, 0.03, 60), _logit(count[48:58].sum(), n, 0.004, 60), _logit(count[32] + count[10], n, 0.16, 60),
        _logit(count[_SYMBOLS].sum(), n, 0.001, 60), _logit(count[46] + count[44], n, 0.02, 60), _logit(count[33], n, 0.001, 60), _logit(count[124], n, 0.001, 60),
        _logit(len(set(words)), nw, 0.7, 20), _logit(sum(map(str.__eq__, words, words[1:])), nw, 0.005, 20), _logit(len(set(lines)), nl, 0.97, 8),
        _logit(min(n, len(zlib.compress(raw, 1))), n, 0.5, 200), np.log((n + 400) / (nl + 4)), _logit(sum(len(w) > 14 for w in words), nw, 0.05, 20),
    ]


@dataclass
class Discriminant:
    """Two classes over standardised statistics, with cached inverse Cholesky factors."""

    shift: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    inverse: list[np.ndarray]
    constant: list[float]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> "Discriminant":
        """``x`` rows of statistics, ``y`` 0 or 1. A class without rows takes the
        other's moments, so that every score is a half if only one is known."""
        x = x if len(x) else np.zeros((1, len(FEATURES)))
        y = y if len(y) else np.zeros(1, int)
        shift, scale = x.mean(0), x.std(0) + 1e-9
        z = (x - shift) / scale
        d = z.shape[1]
        groups = [z[y == k] if (y == k).any() else z for k in (0, 1)]
        own = [np.cov(g.T, bias=True).reshape(d, d) for g in groups]
        n = np.array([len(g) for g in groups], float)
        pooled = (own[0] * n[0] + own[1] * n[1]) / n.sum()
        means, inverse, constant = [], [], []
        for g, s, k in zip(groups, own, n):
            s = (1 - TO_POOLED) * s + TO_POOLED * pooled
            s = (1 - TO_DIAGONAL) * s + TO_DIAGONAL * np.diag(np.diag(s)) + RIDGE * np.eye(d)
            chol = np.linalg.cholesky(s)
            means.append(g.mean(0))
            inverse.append(np.linalg.inv(chol))
            constant.append(float(np.log(k / n.sum()) - np.log(np.diag(chol)).sum()))
        return cls(shift, scale, means, inverse, constant)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``x``."""
        z = (x - self.shift) / self.scale
        log = [c - 0.5 * (((z - m) @ l.T) ** 2).sum(1) for m, l, c in zip(self.means, self.inverse, self.constant)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def statistics_udf():
    @F.pandas_udf("array<double>")
    def statistics(texts: pd.Series) -> pd.Series:
        return pd.Series([text_statistics(t) for t in texts])

    return statistics


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", id: str = "doc_id", label: str = "quality", fit_rows: int = FIT_ROWS) -> Discriminant:
    """Fit on labelled rows for which ``learn`` (over the id) holds.

    Null ids and labels other than 0 and 1 are left out; ids labelled twice
    count with their largest label. More than ``fit_rows`` rows are thinned by
    a hash of the id to about that many: only their ids are broadcast and only
    their statistics (a few doubles each) reach the driver.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull() & learn).groupBy(F.col(id).alias("id")).agg(F.max(label).alias("y"))
    share = min(1.0, fit_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id").select("y", statistics_udf()("text").alias("x")).toPandas()
    return Discriminant.fit(np.array(rows.x.tolist(), float).reshape(-1, len(FEATURES)), rows.y.to_numpy(int))


def quality_score(text: Column, model: Discriminant) -> Column:
    """Score of each text, 0 to 1; empty and null texts have one too."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([text_statistics(t) for t in texts], float).reshape(-1, len(FEATURES))))

    return score.asNondeterministic()(text)  # so that the optimizer doesn't run it twice


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string")) % 3 == 1, F.lit(False))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text of ``documents``; a map over its scan, no shuffle.

    A null doc_id counts as not held out. Repeated rows are scored each.
    """
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
