"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared as sequences of lower-cased words. An item of
m words has an error budget e, a share of m; it is split into e + 1 pieces. A
passage within e edits (a word inserted, dropped or replaced) leaves one piece
untouched, so exact piece hits find every such passage. Each hit is verified by
Myers' bit-parallel distance of the whole item against the words around it.

Tasks build the index of pieces in blocks of items and write each block into
the shared folder. Documents are then read once: a task hashes the words of a
batch and holds them against one block after the other. The driver sees the
blocks' names alone, and memory is bounded by a batch and a block.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fresh_dir, open_fs, staged, table

#: Edits allowed for each word of an item.
ERROR_RATE = 0.2
#: Items of an index block (some hundred bytes each).
BLOCK_ITEMS = 100_000
#: Places of a text whose hits are held at once.
SLICE = 1 << 16
WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words of a text."""
    import xxhash

    words = WORD.findall(text.lower()) if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def myers(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Smallest edit distance of ``pattern`` to any stretch of ``text``, and the
    place in ``text`` after the first stretch that has it (Myers 1999, a bit a word)."""
    m = len(pattern)
    if not m:
        return 0, 0
    peq: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        peq[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text, 1):
        eq = peq[w] if w in peq else 0
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, end = score, j
    return best, end


@dataclass
class PieceIndex:
    """Items as word hashes, and by length the hashes of their pieces, sorted, with item and offset."""

    ids: list[int]
    items: list[np.ndarray]
    budgets: np.ndarray
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, items: list[tuple[int, str | None]], rate: float = ERROR_RATE) -> "PieceIndex":
        """Items without words can't be found and are left out."""
        ids, seqs, budgets, pieces = [], [], [], defaultdict(list)
        for item_id, text in items:
            if not len(seq := words_of(text)):
                continue
            m, e = len(seq), int(rate * len(seq))
            for p in range(e + 1):
                lo, hi = p * m // (e + 1), (p + 1) * m // (e + 1)
                pieces[hi - lo].append((int(cls.rolling(seq[lo:hi], hi - lo)[0]), len(ids), lo))
            ids.append(item_id)
            seqs.append(seq)
            budgets.append(e)
        sorted_ = {n: sorted(p) for n, p in pieces.items()}
        return cls(ids, seqs, np.array(budgets, int), {n: (np.array([x[0] for x in p], np.uint64), np.array([x[1] for x in p]), np.array([x[2] for x in p])) for n, p in sorted_.items()})

    @staticmethod
    def rolling(seq: np.ndarray, n: int) -> np.ndarray:
        """A hash of each run of ``n`` words; equal runs alone are verified."""
        out = np.zeros(len(seq) - n + 1, np.uint64)
        for i in range(n):
            out = (out ^ seq[i : len(seq) - n + 1 + i]) * _MIX
            out ^= out >> np.uint64(29)
        return out

    def hits(self, seq: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(starts, items) that pieces call for, each once in a slice of the text's places."""
        rolled = {n: self.rolling(seq, n) for n in self.pieces if len(seq) >= n}
        for at in range(0, len(seq), SLICE):
            found = []
            for n, h in rolled.items():
                hashes, item, offset = self.pieces[n]
                part = h[at : at + SLICE]
                lo = np.searchsorted(hashes, part)
                some = np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == part)
                if not len(some):
                    continue
                lo = lo[some]
                count = np.searchsorted(hashes, part[some], "right") - lo
                place = np.repeat(some, count)
                ref = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
                found.append(np.stack([place + at - offset[ref], item[ref]]))
            if found:
                yield tuple(np.unique(np.concatenate(found, 1), axis=1))

    def search(self, seq: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, first word, last word) of the best passage of each item found."""
        best: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, tuple[int, int]] = {}  # the starts of an item that its last window covers
        for starts, items in self.hits(seq):
            for start, item in zip(starts.tolist(), items.tolist()):
                pattern, e = self.items[item], int(self.budgets[item])
                lo, hi = tried.get(item, (0, -1))
                if lo <= start <= hi or item in best and best[item][0] == 0 and best[item][1] <= start:
                    continue
                tried[item] = (start, start + e)  # a start up to here has its passage within this window
                lo, hi = max(0, start - e), start + len(pattern) + 3 * e + 1
                window, words = seq[lo:hi].tolist(), pattern.tolist()
                distance, end = myers(words, window)
                if distance <= e:
                    _, length = myers(words[::-1], window[:end][::-1])
                    best[item] = min(best.get(item, (e + 1, 0, 0)), (distance, lo + end - length, lo + end - 1))
        return [(self.ids[i], *x) for i, x in sorted(best.items())]


def build_index(items: DataFrame, id: str = "item_id", text: str = "text", rate: float = ERROR_RATE, block: int | None = None) -> list[str]:
    """Write the blocks of the index into the shared folder; their names, one for each ``block`` items."""
    folder, n = fresh_dir(items.sparkSession, "pieces"), items.count()
    if not n:
        return []

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [x for b in batches for x in zip(b.id, b.text)]
        if held:
            fs, base = open_fs(folder)
            fs.create_dir(base, recursive=True)
            name = f"{uuid.uuid4().hex}.pieces"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
                # plain data: the class itself may not be installed where it is read
                index = PieceIndex.build([(None if i is None else int(i), t) for i, t in held], rate)
                f.write(pickle.dumps((index.ids, index.items, index.budgets, index.pieces)))
            yield pd.DataFrame({"name": [f"{folder}/{name}"]})

    # ids travel as strings: nullable integers would reach pandas as floats
    rows = items.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text")).repartition(-(-n // (block or BLOCK_ITEMS)))
    return sorted(r["name"] for r in staged(rows.mapInPandas(write, "name string"), "piece-blocks").collect())


def load_block(name: str) -> PieceIndex:
    """A block that :func:`build_index` wrote."""
    fs, path = open_fs(name)
    with fs.open_input_stream(path, compression=None) as f:
        return PieceIndex(*pickle.loads(f.read()))


def _blocks(names: list[str]):
    """A function that gives the blocks one after the other; a single one is loaded once."""
    held: dict[str, PieceIndex] = {}

    def each() -> Iterator[PieceIndex]:
        for name in names:
            if name not in held:
                held.clear()
                held[name] = load_block(name)
            yield held[name]

    return each


def find_leaks(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """A row for each document and test item that it holds within the budget.

    Columns: doc_id, item_id, edits, first, last (word places). One map over
    the documents' scan, no shuffle. Null and empty texts hold nothing; items
    without words are found nowhere; an empty benchmark gives no row; repeated
    documents and items are reported each. Of passages of one item in one text
    the one with the fewest edits counts, then the first.
    """
    names = build_index(items, item_id, item_text, rate)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = _blocks(names)
        for batch in batches:
            seqs = [words_of(t) for t in batch.text]
            out = [(doc, *x) for index in each() for doc, seq in zip(batch.id, seqs) for x in index.search(seq)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "edits", "first", "last"]).astype({"item_id": object})

    found = docs.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text")).mapInPandas(find, "doc_id string, item_id bigint, edits int, first int, last int")
    return found.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def remove_leaks(docs: DataFrame, items: DataFrame, text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item."""
    names = build_index(items, rate=rate)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        each = _blocks(names)
        for texts in batches:
            seqs = [words_of(t) for t in texts]
            left = set(range(len(seqs)))
            for index in each():
                left -= {k for k in left if index.search(seqs[k])}
            yield pd.Series([k in left for k in range(len(seqs))], dtype=bool)

    return docs.where(clean.asNondeterministic()(F.col(text)))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of ``benchmark`` in every whole text of ``documents``."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
