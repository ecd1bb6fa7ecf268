"""Language identification, word first, with a backoff to character n-grams.

A word the model knows scores its smoothed log frequency in each language. An
unseen word is walked with character n-grams: at each place the longest gram
known there scores, and each step to a shorter one costs a constant.

The probability only compares the learned languages with each other, so a text
in none of them gets a high one too. Whether a text is in its language at all
is told by the share of its words that are at home there: learned, or spelt
like learned ones. :func:`fit_home` sets the bounds from learning documents.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import fresh_dir, open_fs, staged, table

#: At most about this many documents of a language are learned from (a hash of the id picks them).
FIT_DOCS = 2_000
ORDERS = (4, 3, 2, 1)
BACKOFF = np.log(0.4)
WORD = re.compile(r"[^\W\d_]+")
UND = "und"
#: A word that scores like the best but this share of a language's learned words is spelt like them; so many of these are looked at.
ODD_WORDS, SPELT_WORDS = 0.05, 5_000
#: A text needs HOME times the share of words at home that all but LOW_DOCS of its language's learning documents have.
HOME, LOW_DOCS = 0.7, 0.01


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased. ``WORD`` also takes numbers that are no digits (fractions, numerals): they part words."""
    words = WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    return [w for x in words for w in "".join(c if c.isalpha() else " " for c in x).split()]


@dataclass
class LanguageModel:
    """Log frequencies by language, a matrix row for each known word and gram.

    A gram's row already holds the cost of backing off to its length. Absent in
    a language but known in another: the floor of that order.
    """

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    matrix: np.ndarray
    #: How often the word of each row was counted, by language.
    seen: np.ndarray
    #: By language: what a word at home scores at least, and, as fit_home sets it, the share of such words.
    spelt: np.ndarray
    home: dict[str, float] | None = None

    @classmethod
    def build(cls, counts: pd.DataFrame) -> "LanguageModel":
        """``counts``: lang, n (0 for words, else the order), gram, c."""
        langs = sorted(counts.lang.unique())
        at = {x: i for i, x in enumerate(langs)}
        words, grams, blocks = {}, {}, [np.full((1, len(langs)), -25.0)]  # row 0: not even a letter of it is known
        seen = np.zeros((1, len(langs)))
        for n, part in counts.groupby("n"):
            total = np.zeros(len(langs))
            who, c = part.lang.map(at).to_numpy(), part.c.to_numpy(float)
            np.add.at(total, who, c)
            which, names = pd.factorize(part.gram)
            space = total + 0.5 * len(names) + 1
            block = np.tile(np.log(0.5 / space), (len(names), 1))
            block[which, who] = np.log((c + 0.5) / space[who])
            first = sum(map(len, blocks))
            if not n:
                seen = np.zeros((first + len(names), len(langs)))
                seen[first + which, who] = c
            (grams if n else words).update(zip(names, range(first, first + len(names))))
            blocks.append(block + (ORDERS.index(n) * BACKOFF if n else 0.0))
        model = cls(langs, words, grams, np.concatenate(blocks), seen, np.full(len(langs), -np.inf))
        names, rows = list(words), np.fromiter(words.values(), int, len(words))
        for k in range(len(langs)):
            own = np.flatnonzero(seen[rows, k])
            if len(own):
                own = own[:: max(1, len(own) // SPELT_WORDS)]
                model.spelt[k] = np.quantile([model.matrix[model.backoff(names[i]), k].mean() for i in own], ODD_WORDS)
        return model

    def backoff(self, word: str) -> list[int]:
        """Rows for an unseen word: at each place the longest gram known there."""
        marked, get, rows = f"<{word}>", self.grams.get, []
        for i in range(len(marked)):
            for order in ORDERS:
                if (row := get(marked[i : i + order])) is not None:
                    rows.append(row)
                    break
            else:
                rows.append(0)
        return rows

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability). ``und`` and 0 without any letter, or if nothing was learned."""
        return self._told(words_of(text))[:2]

    def judged(self, text: str | None, learned: bool = False) -> tuple[str, float, float]:
        """(language, probability, share of words at home).

        ``learned``: the text was learned from, so that its words count as
        known only where other texts have them too.
        """
        words = words_of(text)
        lang, score, places, fits = self._told(words)
        if lang == UND:
            return lang, score, 0.0
        best, places = self.langs.index(lang), np.array(places)
        fit = np.zeros(len(words))
        fit[places < 0] = fits[:, best] if fits is not None else 0.0
        known = places >= 0
        if learned:
            here = Counter(words)
            for j in np.flatnonzero(known):
                if self.seen[places[j]].sum() <= here[words[j]]:
                    known[j], fit[j] = False, self.matrix[self.backoff(words[j]), best].mean()
        return lang, score, float((known | (fit >= self.spelt[best])).mean())

    def at_home(self, text: str | None) -> bool:
        """Whether the text is in a learned language: told, likelier than not, and with enough words at home."""
        lang, score, share = self.judged(text)
        return lang != UND and score >= 0.5 and share >= self.home.get(lang, 0.0)

    def _told(self, words: list[str]) -> tuple[str, float, list[int], np.ndarray | None]:
        """Language, probability, each word's row (-1: unseen) and the unseen words' scores."""
        if not words or not self.langs:
            return UND, 0.0, [], None
        get = self.words.get
        places = [get(w, -1) for w in words]
        known = [i for i in places if i >= 0]
        total, fits = self.matrix[known].sum(0), None
        if len(known) < len(words):
            rows, sizes = [], []
            for w, i in zip(words, places):
                if i < 0:
                    own = self.backoff(w)
                    rows += own
                    sizes.append(len(own))
            fits = np.add.reduceat(self.matrix[rows], np.cumsum([0, *sizes[:-1]])) / np.array(sizes)[:, None]
            total = total + fits.sum(0)
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum()), places, fits


class Stored:
    """A model in the shared folder, loaded where it is first asked something and once in a worker's task.

    The driver holds its path and, once :func:`fit_home` set them, its bounds.
    """

    def __init__(self, path: str | None, home: dict[str, float] | None = None):
        self.path, self.home, self.held = path, home, None

    def __getstate__(self) -> dict:
        return {"path": self.path, "home": self.home, "held": None}

    def model(self) -> LanguageModel:
        if self.held is None and self.path is None:  # nothing was learned
            self.held = LanguageModel.build(pd.DataFrame({"lang": [], "n": [], "gram": [], "c": []}))
        if self.held is None:
            fs, path = open_fs(self.path)
            with fs.open_input_stream(path, compression=None) as f:
                self.held = LanguageModel(*pickle.loads(f.read()), home=self.home)
        return self.held

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.model().predict(text)


def _learning(docs: DataFrame, learn: Column, text: str, lang: str, id: str, fit_docs: int) -> DataFrame | None:
    """id, text, lang of the documents learned from; None if there is none."""
    rows = docs.where(F.col(lang).isNotNull() & learn).select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    shares = F.create_map(*(F.lit(x) for k, v in sizes.items() for x in (k, int(min(1.0, fit_docs / v) * (1 << 20)))))
    return rows.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < shares[F.col("lang")])


def fit_languages(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", id: str = "doc_id", fit_docs: int = FIT_DOCS) -> Stored:
    """Learn from rows with a language for which ``learn`` holds.

    A language with more than ``fit_docs`` documents is thinned by a hash of
    the id. Counts are made and summed on the workers; one task makes the model
    of all of them, bounded by the sample, and writes it into the shared folder.
    Rows whose language is null take no part; if there is none, every prediction
    is ``und``.
    """
    rows = _learning(docs, learn, text, lang, id, fit_docs)
    if rows is None:
        return Stored(None)
    folder = fresh_dir(docs.sparkSession, "languages")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for code, part in batch.groupby("lang"):
                words = Counter(w for t in part.text for w in words_of(t))
                grams: Counter = Counter()
                for w, c in words.items():
                    marked = f"<{w}>"
                    for n in ORDERS:
                        for i in range(len(marked) - n + 1):
                            grams[n, marked[i : i + n]] += c
                yield pd.DataFrame([(code, 0, w, c) for w, c in words.items()] + [(code, n, g, c) for (n, g), c in grams.items()], columns=["lang", "n", "gram", "c"])

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [x for x in batches if len(x)]
        if not held:
            return
        model = LanguageModel.build(pd.concat(held, ignore_index=True).sort_values(["lang", "n", "gram"]))
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.model"
        with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
            # plain data: the class itself may not be installed where it is read
            f.write(pickle.dumps((model.langs, model.words, model.grams, model.matrix, model.seen, model.spelt)))
        yield pd.DataFrame({"path": [f"{folder}/{name}"]})

    counts = rows.select("lang", "text").mapInPandas(count, "lang string, n int, gram string, c bigint").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    made = staged(counts.repartition(1).mapInPandas(build, "path string"), "language-model").first()
    return Stored(made and made["path"])


def fit_home(model: Stored, docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", id: str = "doc_id", fit_docs: int = FIT_DOCS) -> Stored:
    """The model with its bounds for texts at home, from the rows that :func:`fit_languages` learned from.

    A learning document is judged without its own counts, so that new texts
    of a language fare no worse. One number a document comes to the driver.
    """
    rows = _learning(docs, learn, text, lang, id, fit_docs)
    if rows is None:
        return model

    @F.pandas_udf("double")
    def share(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model.model()
        for texts in batches:
            yield pd.Series([own.judged(t, learned=True)[2] if words_of(t) else None for t in texts], dtype="float64")

    shares = rows.select("lang", share.asNondeterministic()("text").alias("share")).where("share is not null").toPandas().groupby("lang")["share"]
    lows = shares.quantile(LOW_DOCS)
    return Stored(model.path, {lang: HOME * low for lang, low in lows.items()})


def at_home(text: Column, model: Stored) -> Column:
    """Whether each text is in a language of the model; false for all if nothing was learned."""

    @F.pandas_udf("boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model.model()
        for texts in batches:
            yield pd.Series([own.at_home(t) for t in texts], dtype=bool)

    return judge.asNondeterministic()(text)


def language_of(text: Column, model: Stored) -> Column:
    """struct<lang_pred, score> of each text."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = model.model()
        for texts in batches:
            yield pd.DataFrame([own.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict.asNondeterministic()(text)


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string")) % 4 == 2, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every whole text of ``documents``; a map over its scan.

    A null doc_id counts as not held out. Repeated rows are predicted each.
    """
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs, ~held_out(F.col("doc_id")))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language_of(F.col("text"), model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
