"""N-gram Jaccard join through a MinHash LSH forest.

Texts are sets of five-word shingles. Equal sets are one class from the start.
Each class has a signature of min-hashes, cut into the labels of several tries.
In sorted order a prefix of a label is a run of neighbours, so a trie's node is
a run. The join walks the tries from the full depth: the runs of a depth are
verified, the links found tell by their similarities how many the depth misses
(a pair of similarity s shares a prefix of d hashes in one of T tries with the
probability 1 - (1 - s^d)^T), and prefixes are shortened, hash by hash, until
that estimate reaches the target recall, or down to the depth that reaches it
for pairs at the threshold whatever the data.

A pair belongs to the deepest level at which it shares a prefix, and there to
the first trie, so each is looked at once and no table of pairs arises. What
signatures can't rule out is verified on the whole shingle sets, in blocks of
bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Roots, by_block, by_id, linked_classes, needed_count, node_of, runs_of, staged, table

N_GRAM, THRESHOLD = 5, 0.8
#: Tries, hashes in a label, and the share of pairs at the threshold to find.
TREES, MAX_DEPTH, RECALL = 28, 7, 0.9999
#: Share of pairs at the threshold that the test on whole signatures may lose; RECALL counts it.
SCREEN_LOSS = 1e-9
#: Classes and shingles of a chunk; two chunks of a run meet in a block.
CHUNK, CHUNK_SHINGLES = 1024, 1_000_000
WORD = re.compile(r"\w+")
_RNG = np.random.default_rng(20240101)
_XOR = _RNG.integers(0, 1 << 32, (TREES * MAX_DEPTH, 1), dtype=np.uint64).astype(np.uint32)
_MUL = _RNG.integers(0, 1 << 32, (TREES * MAX_DEPTH, 1), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_PLACE = _RNG.integers(0, 1 << 63, MAX_DEPTH, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def found_share(similarity: float | np.ndarray, depth: int) -> float | np.ndarray:
    """The share of pairs of a similarity that share a prefix of ``depth`` hashes in some trie."""
    return 1 - (1 - similarity**depth) ** TREES


def least_depth(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The depth, below the full one where need be, that finds pairs at the threshold with the recall."""
    depth = MAX_DEPTH
    while depth > 1 and found_share(threshold, depth) - SCREEN_LOSS < recall:
        depth -= 1
    return depth


def estimated_recall(histogram: np.ndarray, depth: int) -> float:
    """Links found over links there, by the similarities (hundredths, rounded down) of those found at ``depth`` or deeper."""
    at = np.flatnonzero(histogram)
    return float(histogram[at].sum() / (histogram[at] / found_share(at / 100, depth)).sum()) if len(at) else 0.0


def shingle_set(text: str | None, n: int = N_GRAM) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``n`` lower-cased words.

    A text of fewer words has one shingle, all its words; one without words none.
    """
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * _MIX
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Sixteen bits of each min-hash."""
    x = shingles.astype(np.uint32)
    least = np.full(len(_MUL), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 2048):  # long texts in pieces
        np.minimum(least, ((x[None, lo : lo + 2048] ^ _XOR) * _MUL).min(1), out=least)
    least = (least ^ (least >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    return ((least ^ (least >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(16)).astype(np.uint16)


def class_key(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def prefixes(signatures: np.ndarray, depth: int) -> np.ndarray:
    """A hash of each label's first ``depth`` hashes: a row per signature, a column per trie."""
    labels = signatures.reshape(len(signatures), TREES, MAX_DEPTH)[:, :, :depth]
    return (labels.astype(np.uint64) * _PLACE[:depth]).sum(2)


def first_meetings(signatures: np.ndarray, side: np.ndarray, tree: int, depth: int, agree: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a block that belong to this depth and trie, and whose signatures agree in ``agree`` hashes.

    That is, pairs that share no prefix of this depth in an earlier trie and no
    deeper one in any. ``side``: the chunk of each row; in a block of two
    chunks only pairs across count.
    """
    here = prefixes(signatures, depth)
    deeper = prefixes(signatures, depth + 1) if depth < MAX_DEPTH else None
    two = side.min() != side.max()
    out_i, out_j = [], []
    for lo in range(0, len(signatures), 64):  # so that pairs of few rows are held at once
        rows = np.arange(lo, min(lo + 64, len(signatures)))
        i, j = np.nonzero(side[rows][:, None] < side[None]) if two else np.nonzero(rows[:, None] < np.arange(len(signatures))[None])
        i = rows[i]
        if deeper is not None:
            new = deeper[i, tree] != deeper[j, tree]
            i, j = i[new], j[new]
        for t in range(tree):
            if not len(i):
                break
            new = here[i, t] != here[j, t]
            i, j = i[new], j[new]
        if deeper is not None:
            for t in range(tree + 1, TREES):
                if not len(i):
                    break
                new = deeper[i, t] != deeper[j, t]
                i, j = i[new], j[new]
        for at in range(0, len(i), 4096):
            a, b = i[at : at + 4096], j[at : at + 4096]
            good = (signatures[a] == signatures[b]).sum(1) >= agree
            out_i.append(a[good])
            out_j.append(b[good])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int), np.zeros(0, int))


def similarities(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Jaccard similarity of the pairs on the whole sets; 0 where it is below the threshold."""
    sizes = np.array([len(s) for s in sets])
    fits = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j])
    out = np.zeros(len(i))
    at = np.flatnonzero(fits)
    if not len(at):
        return out
    used = np.unique(np.concatenate([i[at], j[at]]))
    vocabulary, inverse, counts = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    row = np.repeat(np.arange(len(used)), sizes[used])
    if len(shared) * len(used) ** 2 / 5e9 < 2e-8 * sizes[i[at]].sum() + 5e-6 * len(at):
        # many pairs over few shingles: the counts of common shingles are a matrix product
        column = np.full(len(vocabulary), -1)
        column[shared] = np.arange(len(shared))
        col = column[inverse]
        common = np.zeros((len(used), len(used)), np.float32)
        for lo in range(0, len(shared), 8192):
            part = (col >= lo) & (col < lo + 8192)
            x = np.zeros((len(used), min(8192, len(shared) - lo)), np.float32)
            x[row[part], col[part] - lo] = 1
            common += x @ x.T
        place = np.zeros(len(sets), int)
        place[used] = np.arange(len(used))
        both = common[place[i[at]], place[j[at]]]
    else:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i[at], j[at])])
    either = sizes[i[at]] + sizes[j[at]] - both
    out[at] = np.where(both >= threshold * either - 1e-9, both / either, 0.0)
    return out


def class_rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    """id, digest of the text, class key, signature and number of shingles of each row.

    The last three are null without an id or words, the digest is without a text.
    """

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, digest, t in zip(batch.id, batch.digest, batch.text):
                s = shingle_set(t if doc is not None else None)
                rows.append((doc, digest, class_key(s), signature(s).tobytes(), len(s)) if len(s) else (doc, digest, None, None, None))
            yield pd.DataFrame(rows, columns=["id", "digest", "key", "sig", "size"])

    rows = docs.select(F.col(id).cast("string").alias("id"), digest_of(F.col(text)).alias("digest"), F.col(text).alias("text"))
    return rows.mapInPandas(sign, "id string, digest binary, key binary, sig binary, size bigint").withColumn("id", F.col("id").cast("bigint"))


def digest_of(text: Column) -> Column:
    return F.unhex(F.md5(text))


def tries_of(classes: DataFrame, depth: int) -> DataFrame:
    """node, key, tree, label, size for each class and trie where another class shares the first ``depth`` hashes."""
    width = 2 * MAX_DEPTH
    labels = F.array(*(F.expr(f"substring(sig, {1 + width * t}, {width})") for t in range(TREES)))
    marks = classes.select("node", "size", F.posexplode(labels).alias("tree", "label")).withColumn("run", run_of(depth))
    shared = marks.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select("run")
    return marks.join(shared, "run", "left_semi").select("node", "size", "tree", "label")


def run_of(depth: int) -> Column:
    return F.xxhash64("tree", F.expr(f"substring(label, 1, {2 * depth})"))


def level_blocks(tries: DataFrame, depth: int) -> DataFrame:
    """block, tree, side, node: the runs of a depth that hold classes which part right below it.

    Runs that are large by classes or shingles are dealt into chunks by a hash,
    of which every two meet in one block.
    """
    marks = tries.withColumn("run", run_of(depth))
    parts = F.lit(True) if depth == MAX_DEPTH else F.min(F.expr(f"substring(label, 1, {2 * depth + 2})")) != F.max(F.expr(f"substring(label, 1, {2 * depth + 2})"))
    runs = marks.groupBy("run").agg(F.count("*").alias("n"), F.sum("size").alias("all"), parts.alias("parts")).where("n > 1 and parts")
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("all") / CHUNK_SHINGLES)).cast("int")
    marks = marks.join(runs.select("run", F.least(chunks, F.col("n")).cast("int").alias("chunks")), "run")
    marks = marks.withColumn("side", F.pmod(F.xxhash64("node", "run"), F.col("chunks")).cast("int"))
    marks = marks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return marks.select(F.xxhash64("run", F.least("side", "other"), F.greatest("side", "other")).alias("block"), "tree", "side", "node")


def near_copy_rows(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """As :func:`near_copy_classes`, with the digest of each row's text and its class key beside its id."""
    spark = docs.sparkSession
    lowest = least_depth(threshold)
    agree = needed_count(TREES * MAX_DEPTH, threshold, 1 - SCREEN_LOSS)
    everything = staged(class_rows(docs, id, text), "near-rows")
    classes = everything.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.min("sig").alias("sig"), F.min("size").alias("size"))
    classes = staged(classes.withColumn("node", node_of(F.col("key"))), "near-classes")
    tries = staged(tries_of(classes, lowest), "near-tries")

    # Shingle sets of the classes that share a prefix with another, made from the texts of their first rows.
    shared = staged(tries.select("node").distinct().join(classes.select("node", "key", F.col("rep").alias("id")), "node"), "near-shared")
    texts = by_id(docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")), shared.select("id").distinct(), "id", "left_semi")

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                sets = [shingle_set(t) for t in batch.text.iloc[lo : lo + 512]]
                yield pd.DataFrame({"key": [class_key(s) for s in sets], "shingles": [s.tobytes() for s in sets]})

    sets = texts.mapInPandas(shingled, "key binary, shingles binary")
    sets = staged(sets.join(shared.select("key", "node"), "key").groupBy("node").agg(F.min("shingles").alias("shingles")), "near-sets")

    links = "key binary, links bigint, a bigint, b bigint, histogram array<double>"
    found, histogram = spark.createDataFrame([], links), np.zeros(101)
    for depth in range(MAX_DEPTH, lowest - 1, -1):

        def screen(batches: Iterator[pd.DataFrame], depth: int = depth) -> Iterator[pd.DataFrame]:
            out = []
            for run in runs_of(batches, "block"):
                i, j = first_meetings(_signatures(run), run["side"], int(run["tree"][0]), depth, agree)
                if len(i):
                    out.append(pd.DataFrame({c: run[c][np.union1d(i, j)] for c in ("block", "tree", "side", "node")}))
                if len(out) >= 500:
                    yield pd.concat(out)
                    out = []
            if out:
                yield pd.concat(out)

        blocks = level_blocks(tries, depth).join(classes.select("node", "sig"), "node")
        wanted = staged(by_block(blocks).mapInPandas(screen, "block bigint, tree int, side int, node bigint"), f"near-blocks-{depth}")

        def verify(batches: Iterator[pd.DataFrame], depth: int = depth) -> Iterator[pd.DataFrame]:
            out = []
            for run in runs_of(batches, "block"):
                m, n = run["m"], len(run["m"])
                i, j = first_meetings(_signatures(run), run["side"], int(run["tree"][0]), depth, agree)
                sets = [np.frombuffer(s, np.uint64) for s in run["shingles"]]
                count, roots, bins = np.zeros(n, np.int64), Roots(n), np.zeros(101)
                for lo in range(0, len(i), 1 << 18):
                    a, b = i[lo : lo + (1 << 18)], j[lo : lo + (1 << 18)]
                    s = similarities(sets, a, b, threshold)
                    a, b, s = a[s > 0], b[s > 0], s[s > 0]
                    np.add.at(count, a, m[b])
                    np.add.at(count, b, m[a])
                    roots.join(a, b)
                    bins += np.bincount((s * 100 + 1e-9).astype(int), minlength=101)
                parent = roots.parents()
                hit = np.flatnonzero(count).tolist()
                out += [(run["key"][k], int(count[k]), int(run["node"][k]), int(run["node"][parent[k]]), bins.tolist() if k == hit[0] else None) for k in hit]
                if len(out) >= 5000:
                    yield pd.DataFrame(out, columns=["key", "links", "a", "b", "histogram"])
                    out = []
            yield pd.DataFrame(out, columns=["key", "links", "a", "b", "histogram"])

        full = wanted.join(classes.select("node", "key", "m", "sig"), "node").join(sets, "node")
        level = staged(by_block(full).mapInPandas(verify, links), f"near-links-{depth}")
        found = found.unionByName(level)
        for r in level.where("histogram is not null").select(F.posexplode("histogram").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
            histogram[r["at"]] += r["n"]
        if estimated_recall(histogram, depth) - SCREEN_LOSS >= RECALL:
            break
    return linked_classes(everything.drop("sig", "size"), classes, found.drop("histogram"))


def _signatures(run: dict[str, np.ndarray]) -> np.ndarray:
    return np.frombuffer(b"".join(run["sig"]), np.uint16).reshape(len(run["sig"]), -1)


def near_copy_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Classes of near copies: doc_id, class_id, n_links, kept; a row per row of ``docs``.

    Two documents are linked if the Jaccard similarity of their shingle sets is
    ``threshold`` or more; class_id is the smallest doc_id reachable by links,
    n_links the number of other rows linked directly, kept whether a row's id
    is its class_id. Texts without words (null, empty) and rows without an id
    link with nothing: class_id is the own id, which is kept. Rows that repeat
    an id are told apart by their texts: unlike ones link for themselves. Other
    columns are not looked at.
    """
    return near_copy_rows(docs, id, text, threshold).select(F.col("id").alias("doc_id"), "class_id", "n_links", "kept")


def drop_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns: one of each class of near copies.

    It is the one with the smallest id (of several the one with the smallest
    digest of its text). Rows without an id or words stay, and so do rows whose
    id is that of a dropped row but whose text is linked with nothing.
    """
    rows = staged(near_copy_rows(docs, id, text, threshold).where("n_links > 0"), "near-linked")
    first = rows.groupBy("class_id").agg(F.min(F.struct("id", "digest")).alias("first"))
    pairs = rows.groupBy("id", "digest").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n")).join(first, "class_id")
    pairs = staged(pairs.select("id", "digest", "n", (F.struct("id", "digest") == F.col("first")).alias("stays")), "near-pairs")
    mark = [F.col(id).cast("bigint").alias("_id"), digest_of(F.col(text)).alias("_digest")]
    out = docs.select("*", *mark)
    gone = pairs.where("not stays").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"))
    out = by_id(out, gone, ["_id", "_digest"], "left_anti")
    again = pairs.where("stays and n > 1").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"))
    if not again.isEmpty():
        once = by_id(out, again, ["_id", "_digest"], "left_semi").dropDuplicates(["_id", "_digest"])
        out = by_id(out, again, ["_id", "_digest"], "left_anti").unionByName(once)
    return out.select(*docs.columns)


def op8_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy classes of all ``documents``."""
    return near_copy_classes(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3] || ' ' || w[k + 4])) END AS s FROM w WHERE len(w) > 0),
sized AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sized a JOIN sized b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*))),
walk(node, seen) AS (SELECT DISTINCT a, a FROM links UNION SELECT l.b, k.seen FROM walk k JOIN links l ON l.a = k.node)
SELECT doc_id, coalesce(least(doc_id, c), doc_id) AS class_id, coalesce(n, 0) AS n_links, doc_id <= coalesce(c, doc_id) AS kept
FROM documents LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = doc_id LEFT JOIN (SELECT node, min(seen) AS c FROM walk GROUP BY node) k ON k.node = doc_id
"""
