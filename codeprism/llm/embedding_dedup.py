"""Near-duplicate vectors by collision-counting projections.

Unit vectors are projected on many fixed directions and sorted by each. Two
vectors collide in a projection if one lies in the window centred on the other;
at the threshold a collision has a known probability, so a count of collisions
that pairs at the threshold reach with the target recall separates candidates
from the rest, and candidates are verified by their cosine in double precision.

A sorted linear projection alone prunes by a constant at most (a window that
finds near pairs holds a constant share of all vectors), so that collisions of
whole projections grow with the square of the rows. Each sorted order is
therefore held inside cells: of a random rotation, the direction in which the
vector reaches furthest (:class:`Projections`). A pair at the threshold shares a
cell with a probability that the dimension alone fixes; the number of orders
follows from it and the recall, and the cells get finer as the rows grow, so
that a cell's mean size is bounded. Windows and counts then work within cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Roots, by_block, by_id, linked_classes, needed_count, node_of, runs_of, staged, table

THRESHOLD, RECALL = 0.95, 0.99999
#: Projections counted for each pair; of these so many are counted densely, the others for pairs still in the race.
PROJECTIONS, DENSE = 32, 16
#: Half a window, in deviations of a projected difference at the threshold, and its quantised steps.
WINDOW, STEPS = 2.5, 8
#: Directions of a rotation, and the mean size of a cell.
REACH, CELL = 64, 1024
#: Distinct vectors in a block of a cell that ties and near copies made larger.
BLOCK = 4096
TILE = 512


def same_cell(dim: int, directions: int, threshold: float) -> float:
    """The probability that a pair at the threshold reaches furthest in the same
    of ``directions`` random directions, on the same side; drawn with a fixed
    seed, two deviations below the mean."""
    rng = np.random.default_rng(dim)
    n = int(np.clip(2_000_000 // dim, 2_000, 20_000))
    x, z = rng.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    y = threshold * x + sqrt(max(0.0, 1 - threshold**2)) * z
    p = float((furthest(x[:, :directions]) == furthest(y[:, :directions])).mean())
    return max(p - 2 * sqrt(p * (1 - p) / n), 0.01)


def furthest(projected: np.ndarray) -> np.ndarray:
    """Twice the direction of the largest magnitude, and 1 more if it is positive."""
    at = np.abs(projected).argmax(1)
    return 2 * at + (projected[np.arange(len(at)), at] > 0)


class Projections:
    """Directions and calibration for one dimension, threshold and number of vectors.

    An order's cell joins ``rotations`` furthest directions and ``bits`` signs;
    there are as many orders as a pair at the threshold needs to share a cell
    in one of them with the recall.
    """

    def __init__(self, dim: int, n: int, threshold: float = THRESHOLD):
        rng = np.random.default_rng(20240229 + dim)
        self.m = min(PROJECTIONS, dim)
        self.directions = self._rotation(rng, dim, self.m)
        reach = sqrt(max(0.0, 2 - 2 * threshold))  # how far unit vectors at the threshold are apart
        self.step = max(reach / sqrt(dim) * WINDOW / STEPS, 1e-9)
        self.need = needed_count(self.m, erf(WINDOW / sqrt(2)), RECALL)
        r = min(REACH, dim)
        levels = sorted((((2 * r) ** k << b, k, b) for k in range(9) for b in range(4)))
        _, self.rotations, self.bits = next((x for x in levels if n <= CELL * x[0]), levels[-1])
        one = same_cell(dim, r, threshold) if self.rotations else 1.0
        side = 1 - np.arccos(min(1.0, threshold)) / np.pi
        # an order finds a pair that shares its cell and lies in the window of its projection
        p = one**self.rotations * side**self.bits * erf(WINDOW / sqrt(2))
        self.orders = ceil(log(1 - RECALL) / log(1 - p))
        self.cells = [[self._rotation(rng, dim, r) for _ in range(self.rotations)] for _ in range(self.orders)]
        self.sides = [rng.standard_normal((dim, self.bits)) for _ in range(self.orders)]

    @staticmethod
    def _rotation(rng: np.random.Generator, dim: int, width: int) -> np.ndarray:
        return np.linalg.qr(rng.standard_normal((dim, width)))[0]

    def project(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all projections in steps, the cell in each order). Clipping brings projections together at most."""
        q = np.clip(np.floor(unit @ self.directions / self.step), -127, 127).astype(np.int8)
        codes = np.zeros((len(unit), self.orders), np.uint64)
        for t in range(self.orders):
            for rotation in self.cells[t]:
                codes[:, t] = codes[:, t] * np.uint64(2 * rotation.shape[1]) + furthest(unit @ rotation).astype(np.uint64)
            for sign in (unit @ self.sides[t] > 0).T:
                codes[:, t] = codes[:, t] * np.uint64(2) + sign
        return q, codes.astype(self.code)

    @property
    def code(self) -> np.dtype:
        """The narrowest type of a cell."""
        most = (2 * min(REACH, len(self.directions))) ** self.rotations << self.bits
        return np.min_scalar_type(most - 1).newbyteorder("<")


def units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(float)
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def collisions(q: np.ndarray, codes: np.ndarray, side: np.ndarray, order: int, need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a block whose windows collide in this order, and in at least ``need`` projections.

    Pairs across the block's two sides, or within its only one. Rows are walked
    sorted by the order's projection, so that a tile meets what its windows
    reach. A pair that an earlier order finds is left to that one. A floor moves
    a difference by less than a step, so windows are a step wider.
    """
    m, half = q.shape[1], STEPS + 1
    wide = np.ascontiguousarray(q.T).astype(np.int16)
    low, high = np.clip(wide - half, -128, 127).astype(np.int8), np.clip(wide + half, -128, 127).astype(np.int8)
    narrow = wide.astype(np.int8)

    def met(t: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs share the cell of order ``t`` and collide in its projection."""
        return (codes[i, t] == codes[j, t]) & (np.abs(wide[t % m, i] - wide[t % m, j]) <= half)

    rank = np.argsort(q[:, order % m], kind="stable")
    one = side[rank] == side.min()
    a, b = rank[one], rank[~one]
    within = not len(b)
    b = a if within else b
    at_a, at_b, spare = wide[order % m, a], wide[order % m, b], m - need
    for lo in range(0, len(a), TILE):
        rows = a[lo : lo + TILE]
        start = lo if within else int(np.searchsorted(at_b, at_a[lo] - half))
        stop = int(np.searchsorted(at_b, at_a[lo + len(rows) - 1] + half, "right"))
        for at in range(start, stop, TILE):
            cols = b[at : min(at + TILE, stop)]
            both = np.concatenate([rows, cols])
            if any((codes[both, t] == codes[rows[0], t]).all() and np.ptp(wide[t % m, both]) <= half for t in range(order)):
                continue  # an earlier order has met all of the tile
            missed = np.zeros((len(rows), len(cols)), np.uint8)
            for k in range(min(DENSE, m)):
                other = narrow[k, cols]
                missed += (other < low[k, rows, None]) | (other > high[k, rows, None])
            i, j = np.nonzero(missed <= spare)
            if within and at == lo:
                i, j = i[i < j], j[i < j]
            seen = missed[i, j]
            i, j = rows[i], cols[j]
            now = met(order, i, j)
            i, j, seen = i[now], j[now], seen[now]
            for t in range(order):
                if not len(i):
                    break
                new = ~met(t, i, j)
                i, j, seen = i[new], j[new], seen[new]
            for k in range(DENSE, m):
                seen = seen + (np.abs(wide[k, i] - wide[k, j]) > half)
            good = seen <= spare
            if good.any():
                yield i[good], j[good]


def _rows(df: DataFrame, id: str, vector: str) -> DataFrame:
    """id, the vector and its length; the length null if it can't be compared."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)
    element = "float" if df.schema[vector].dataType.simpleString() == "array<float>" else "double"
    rows = df.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast(f"array<{element}>").alias("v"))
    return rows.withColumn("dim", F.when(F.coalesce(fine, F.lit(False)), F.size("v")))


def near_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Components of vectors linked by a cosine of ``threshold`` (over 0, at most 1) or more.

    Returns a row per row of ``df``: id, class_id (the smallest id reachable),
    n_links (other rows linked directly), kept (id = class_id). Vectors that
    are null, empty, zero, or hold null or non-finite components, and rows
    without an id, link with nothing; vectors of different lengths don't link.
    Equal vectors are one class from the start and count as many links; rows
    that repeat an id are one node. Other columns are not looked at.

    A row of the orders is a class's quantised projections and cells, some
    hundred bytes; vectors move for classes with a candidate alone. A cell of
    more than ``BLOCK`` classes is dealt into chunks of which every two meet,
    so that near copies, however many, are counted in bounded memory.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is over 0 and at most 1")
    spark = df.sparkSession
    rows = _rows(df, id, vector)
    element = "<f4" if "array<float>" in rows.schema["v"].dataType.simpleString() else "<f8"
    sizes = {r["dim"]: r["count"] for r in rows.where("dim is not null").groupBy("dim").count().collect()}

    def project(batches):
        import pyarrow as pa

        made: dict[int, Projections] = {}
        for batch in batches:
            dims = batch["dim"].to_numpy(zero_copy_only=False)
            vectors, bodies = [None] * len(dims), [None] * len(dims)
            for dim in np.unique(dims[~np.isnan(dims.astype(float))]).astype(int).tolist():
                at = np.flatnonzero(dims == dim)
                by = made.get(dim) or made.setdefault(dim, Projections(dim, sizes[dim], threshold))
                x = batch["v"].take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(element)
                x = x + np.zeros(1, x.dtype)  # no negative zeros, so that equal vectors have equal bytes
                q, codes = by.project(units(x))
                for k, v, a, b in zip(at.tolist(), x, q, codes):
                    vectors[k], bodies[k] = v.tobytes(), a.tobytes() + b.tobytes()
            yield pa.RecordBatch.from_arrays([batch["id"], batch["dim"], pa.array(vectors, pa.binary()), pa.array(bodies, pa.binary())], ["id", "dim", "vector", "body"])

    everything = rows.select("id", "dim", "v").mapInArrow(project, "id bigint, dim int, vector binary, body binary")
    everything = staged(everything.withColumn("key", F.unhex(F.md5("vector"))), "vectors")
    classes = everything.where("key is not null").groupBy("key", "dim").agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.min("body").alias("body"))
    classes = staged(classes.withColumn("node", node_of(F.col("key"))), "vector-classes")
    found = None
    for dim, n in sorted(sizes.items()):
        by = Projections(dim, n, threshold)
        m, orders, code = by.m, by.orders, by.code
        width = code.itemsize
        # A row per class and order; the cells that are large get chunks.
        cell = lambda t: F.xxhash64(t, F.expr(f"substring(body, 1 + {m} + {width} * t, {width})"))
        marks = classes.where(F.col("dim") == dim).select("key", "node", "m", "body", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("t"))
        marks = marks.withColumn("cell", cell(F.col("t")))
        large = staged(marks.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "large-cells")
        marks = marks.join(F.broadcast(large) if large.count() <= 200_000 else large, "cell", "left")
        chunks = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
        marks = marks.withColumn("chunks", chunks).withColumn("side", F.pmod(F.xxhash64("key", "cell"), F.col("chunks")).cast("int"))
        marks = marks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        block = F.when(F.col("chunks") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("side", "other"), F.greatest("side", "other")))
        blocks = by_block(marks.select(block.alias("block"), "t", "side", "node", "m", "body"))

        def opened(run: dict, m: int = m, orders: int = orders, code: np.dtype = code, need: int = by.need):
            raw = np.frombuffer(b"".join(run["body"]), np.uint8).reshape(len(run["node"]), -1)
            q, codes = raw[:, :m].view(np.int8), np.ascontiguousarray(raw[:, m:]).view(code)
            return collisions(q, codes, run["side"], int(run["t"][0]), need)

        def screen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = []
            for run in runs_of(batches, "block"):
                hit = np.zeros(len(run["node"]), bool)
                for i, j in opened(run):
                    hit[i] = hit[j] = True
                if hit.any():
                    out.append(pd.DataFrame({c: run[c][hit] for c in ("block", "t", "side", "node", "m", "body")}))
                if len(out) >= 500:
                    yield pd.concat(out)
                    out = []
            if out:
                yield pd.concat(out)

        wanted = staged(blocks.mapInPandas(screen, "block bigint, t int, side int, node bigint, m bigint, body binary"), "vector-blocks")
        need = staged(classes.select("key", "node", "rep").join(wanted.select("node").distinct(), "node"), "wanted-classes")
        vectors = by_id(everything.select("id", "key", "vector"), need.select("key", F.col("rep").alias("id")), ["key", "id"], "left_semi").dropDuplicates(["key"])
        vectors = staged(vectors.join(need, "key").select("key", "node", "vector"), "wanted-vectors")

        def match(batches: Iterator[pd.DataFrame], dim: int = dim) -> Iterator[pd.DataFrame]:
            out = []
            for run in runs_of(batches, "block"):
                ids, weight, size = run["node"], run["m"], len(run["node"])
                u = units(np.frombuffer(b"".join(run["vector"]), element).reshape(size, dim))
                links, roots = np.zeros(size, np.int64), Roots(size)
                for i, j in opened(run):
                    for lo in range(0, len(i), 1 << 15):
                        a, b = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
                        good = np.einsum("ij,ij->i", u[a], u[b]) >= threshold
                        a, b = a[good], b[good]
                        np.add.at(links, a, weight[b])
                        np.add.at(links, b, weight[a])
                        roots.join(a, b)
                hit = np.flatnonzero(links)
                out.append(pd.DataFrame({"key": run["key"][hit], "links": links[hit], "a": ids[hit], "b": ids[roots.parents()[hit]]}))
                if len(out) >= 500:
                    yield pd.concat(out)
                    out = []
            if out:
                yield pd.concat(out)

        part = by_block(wanted.join(vectors, "node")).mapInPandas(match, "key binary, links bigint, a bigint, b bigint")
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "key binary, links bigint, a bigint, b bigint")
    return linked_classes(everything.select("id", "key"), classes, staged(found, "vector-links")).select("id", "class_id", "n_links", "kept")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings`` against each other, whatever their labels."""
    return near_vectors(table(spark, sf_dir, "embeddings")).select(F.col("id").alias("vec_id"), "n_links", F.col("class_id").alias("component_id"), "kept")


OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND array_cosine_similarity(a.e, b.e) >= 0.95),
walk(node, seen) AS (SELECT DISTINCT a, a FROM links UNION SELECT l.b, w.seen FROM walk w JOIN links l ON l.a = w.node)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(vec_id, c), vec_id) AS component_id, vec_id <= coalesce(c, vec_id) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = vec_id LEFT JOIN (SELECT node, min(seen) AS c FROM walk GROUP BY node) w ON w.node = vec_id
"""
