"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A piece goes into the
window that it fits best; when none has room, the fullest is topped up with the
piece's head and emitted, and the rest of the piece looks again. At the end the
open windows, a bounded number each partition, are merged: first within the
partition, then across partitions in groups.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import staged, table

WINDOW, OPEN = 1024, 64
#: Id appended to each document.
END = 0
#: Leftover windows of so many partitions are merged by one task.
FAN_IN = 64
PIECE = "doc string, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary, open boolean"


def tokenizer(name: str):
    """``encode_batch(texts) -> lists of ids`` of a byte-level BPE vocabulary file.

    A ``.json`` file of the tokenizers library whose ranks lie beside it as
    ``.tiktoken`` is run by tiktoken, which gives the same ids several times
    faster; without the ranks file tokenizers itself runs.
    """
    import os

    ranks_file = name.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranks_file):
        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {"<|endoftext|>": 50256}
        bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda texts: [bpe.encode(t, allowed_special="all") for t in texts]
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(name)
    return lambda texts: [x.ids for x in own.encode_batch(list(texts), add_special_tokens=False)]


class Packer:
    """The open windows of one partition. Pieces are (doc, start, ids, doc_tokens)."""

    def __init__(self, window: int, most_open: int, first_id: int):
        self.window, self.most_open, self.next_id = window, most_open, first_id
        self.room: list[tuple[int, int]] = []  # (room left, sequence), sorted
        self.held: dict[int, list[tuple]] = {}

    def put(self, doc, start: int, ids: np.ndarray, total: int) -> Iterator[tuple]:
        """Place a piece; yields the rows of windows that got full. Whole windows' worth goes out at once."""
        while len(ids) >= self.window:
            yield (doc, start, self.window, total, self.next_id, 0, ids[: self.window])
            self.next_id += 1
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            i = bisect_left(self.room, (len(ids), -1))
            if i < len(self.room):
                n = len(ids)
            elif len(self.room) < self.most_open:
                insort(self.room, (self.window, self.next_id))
                self.held[self.next_id] = []
                self.next_id += 1
                continue
            else:  # no window has room: the fullest takes the head
                i, n = 0, self.room[0][0]
            left, seq = self.room.pop(i)
            self.held[seq].append((doc, start, n, total, seq, self.window - left, ids[:n]))
            start, ids, left = start + n, ids[n:], left - n
            if left:
                insort(self.room, (left, seq))
            else:
                yield from self.held.pop(seq)

    def merge(self) -> Iterator[tuple]:
        """Fold the open windows into full ones; at most one stays open."""
        rest = [p for _, seq in sorted(self.room) for p in self.held[seq]]
        self.room, self.held, self.most_open = [], {}, 1
        for doc, start, _, total, _, _, ids in rest:
            yield from self.put(doc, start, ids, total)

    def open_rows(self) -> list[tuple]:
        return [p for rows in self.held.values() for p in rows]


def power_pieces(rows: list[tuple], window: int, next_id: int) -> list[tuple]:
    """Cut the last open window into sequences whose lengths are powers of two, which need no padding."""
    total, out = sum(r[2] for r in rows), []
    sizes = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
    at, seq = 0, next_id
    for doc, start, n, doc_tokens, _, _, ids in rows:
        while n:
            take = min(n, sizes[0] - at)
            out.append((doc, start, take, doc_tokens, seq, at, ids[:take]))
            start, ids, n, at = start + take, ids[take:], n - take, at + take
            if at == sizes[0]:
                sizes.pop(0)
                at, seq = 0, seq + 1
    return out


def pack(df: DataFrame, vocabulary: str, text: str = "text", id: str = "doc_id", window: int = WINDOW, most_open: int = OPEN, keep_ids: bool = True) -> DataFrame:
    """Pack ``df[text]`` into sequences of at most ``window`` ids.

    Returns a row per piece: doc_id, start, length, doc_tokens, sequence_id,
    offset, ids (little-endian unsigned 32-bit; without ``keep_ids`` null) and
    ids_crc32. A document is its ids and then ``END``, so null and empty texts
    have one id. Sequences count from 0 within each partition, with the
    partition in the high bits. Repeated rows, and rows with the same or no
    id, are packed each. An empty table gives no row.

    Documents are tokenized and packed where they are scanned, in one pass that
    is staged with crcs; only leftover windows, one each partition, move.
    """

    def code(rows: list[tuple], is_open: bool) -> list[tuple]:
        return [(doc, start, n, total, seq, at, ids.astype("<u4").tobytes(), is_open) for doc, start, n, total, seq, at, ids in rows]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["doc", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "open"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode = tokenizer(vocabulary)
        packer = Packer(window, most_open, (TaskContext.get().partitionId() + 1) << 36)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part, rows = batch.iloc[lo : lo + 256], []
                for doc, ids in zip(part.id, encode(["" if t is None else t for t in part.text])):
                    ids.append(END)
                    rows += packer.put(doc, 0, np.array(ids, np.uint32), len(ids))
                yield frame(code(rows, False))
        yield frame(code(list(packer.merge()), False) + code(packer.open_rows(), True))

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        packer, out = Packer(window, 1, (1 << 62) + (int(key[0]) << 36)), []
        for r in rows.sort_values(["sequence_id", "offset"]).itertuples():
            out += packer.put(r.doc, r.start, np.frombuffer(r.ids, "<u4"), r.doc_tokens)
        return frame(code(out + power_pieces(packer.open_rows(), window, packer.next_id), False))

    # ids travel as strings: nullable integers would reach pandas as floats
    source = df.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text"))
    placed = source.mapInPandas(place, PIECE).withColumn("ids_crc32", F.crc32("ids"))
    if not keep_ids:
        placed = placed.withColumn("ids", F.when(F.col("open"), F.col("ids")))
    placed = staged(placed, "packed")
    # (partition + 1) is in the sequence id: a group has one open window of each of FAN_IN partitions
    group = F.shiftright("sequence_id", 36) - 1
    left = placed.where("open").drop("ids_crc32").groupBy(F.floor(group / FAN_IN).alias("g")).applyInPandas(merge, PIECE).withColumn("ids_crc32", F.crc32("ids"))
    if not keep_ids:
        left = left.withColumn("ids", F.lit(None).cast("binary"))
    out = placed.where("not open").unionByName(left)
    return out.select(F.col("doc").cast("bigint").alias("doc_id"), "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "ids_crc32")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` packed into sequences of 1024."""
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
