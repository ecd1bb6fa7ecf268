"""Reachability, components and cycles over edge tables.

Loops keep each round as a checkpoint in the session's checkpoint folder, so
that plans stay short and lost executors cost a round at most. Walks that take
a round a hop end in one task as soon as what is left of the graph is counted
to have ``SMALL`` edges at most: long chains and cycles cost no rounds there.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Edges that one task walks in memory.
SMALL = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only under a local master that sets none."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="codeprism-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder, which goes with the application."""
    sc = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    dropped_at_exit(df.sparkSession, sc.getCheckpointDir())
    return df.checkpoint(eager=True)


def dropped_at_exit(spark: SparkSession, path: str) -> None:
    """Have the store delete a folder of this application's own when the driver ends."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def _numbered(edges: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, and for each the targets of its edges: (names, starts, targets, sources) with numbers for nodes."""
    codes, names = pd.factorize(pd.concat([edges.a, edges.b], ignore_index=True))
    source, target = codes[: len(edges)], codes[len(edges) :]
    order = np.argsort(source, kind="stable")
    starts = np.searchsorted(source[order], np.arange(len(names) + 1))
    return np.asarray(names), starts, target[order], source[order]


def _in_one_task(df: DataFrame, solve, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    return kept(df.coalesce(1).mapInPandas(run, schema))


def _walk(edges: DataFrame, seeds: DataFrame, type: str) -> DataFrame:
    """:func:`reachable` in memory, a breadth-first walk."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.a[rows.seed].unique()
        names, starts, target, _ = _numbered(rows[~rows.seed])
        at = {x: k for k, x in enumerate(names)}
        depth = dict.fromkeys(first, 0)
        frontier = [at[x] for x in first if x in at]
        seen = np.zeros(len(names), bool)
        seen[frontier] = True
        level = 0
        while frontier:
            level += 1
            fresh = []
            for k in frontier:
                for t in target[starts[k] : starts[k + 1]]:
                    if not seen[t]:
                        seen[t] = True
                        fresh.append(t)
                        depth.setdefault(names[t], level)
            frontier = fresh
        return pd.DataFrame({"node": pd.Series(list(depth), dtype=object), "depth": list(depth.values())})

    both = edges.withColumn("seed", F.lit(False)).unionByName(seeds.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(True).alias("seed")))
    return _in_one_task(both, solve, f"node {type}, depth int")


def _joined(edges: DataFrame, type: str) -> DataFrame:
    """:func:`connected_components` in memory: node and r, the smallest node of its component."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(pd.concat([rows.a, rows.b], ignore_index=True), sort=True)
        i, j, root = codes[: len(rows)], codes[len(rows) :], np.arange(len(names))
        while len(i):
            a, b = root[i], root[j]
            new = a != b
            i, j, a, b = i[new], j[new], a[new], b[new]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root = up
        names = np.asarray(names, dtype=object)
        return pd.DataFrame({"node": pd.Series(names, dtype=object), "r": pd.Series(names[root], dtype=object)})

    return _in_one_task(edges, solve, f"node {type}, r {type}")


def reachable(edges: DataFrame, seeds: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Nodes that ``seeds`` (column node) reach over ``edges`` (a -> b), themselves included; with their depth.

    Semi-naive: each round only expands the nodes that the last one found. A
    small graph is walked in one task, whatever its depth; a large one that is
    deeper than ``max_rounds`` is refused.
    """
    edges = kept(edges.select("a", "b").where("a is not null and b is not null").distinct())
    seen = kept(seeds.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
    if edges.count() + seen.count() <= SMALL:
        return _walk(edges, seen, edges.schema["a"].dataType.simpleString())
    frontier = seen
    for depth in range(1, max_rounds + 1):
        step = edges.join(frontier.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        frontier = kept(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = kept(seen.unionByName(frontier))
    raise RuntimeError(f"not done after {max_rounds} rounds")


#: Rounds of contraction that go by id before the order is drawn by a hash.
BY_ID = 4


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Undirected components: node, component (its smallest node).

    Each round every node takes the first of its closed neighbourhood, by id in
    the first rounds and in an order that a hash draws anew later, and the
    graph is contracted to these nodes: stars fold at once, and a third of the
    nodes goes each round in expectation, long chains included. What is left,
    once small, is joined in one task.
    """
    live = kept(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps = []
    for k in range(max_rounds):
        left = live.count()
        if left <= SMALL:
            if left:
                maps.append(_joined(live, live.schema["a"].dataType.simpleString()))
            break
        draw = lambda c: F.struct((F.lit(0) if k < BY_ID else F.xxhash64(F.lit(k), F.col(c))).alias("h"), F.col(c).alias("v"))
        both = live.union(live.select("b", "a"))
        to = kept(both.groupBy("a").agg(F.min(draw("b")).alias("f")).select(F.col("a").alias("node"), F.least("f", draw("a"))["v"].alias("r")))
        maps.append(to)
        renamed = live.join(to.select(F.col("node").alias("a"), F.col("r").alias("ra")), "a").join(to.select(F.col("node").alias("b"), F.col("r").alias("rb")), "b")
        live = kept(renamed.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    else:
        raise RuntimeError(f"components need more than {max_rounds} rounds")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    out = maps[-1].select("node", F.col("r").alias("root"))
    for to in reversed(maps[:-1]):
        out = kept(to.join(out.select(F.col("node").alias("r"), "root"), "r", "left").select("node", F.coalesce("root", "r").alias("root")))
    least = out.groupBy("root").agg(F.min("node").alias("component"))
    return out.join(least, "root").select("node", F.least("component", "root").alias("component"))


def _strong(edges: DataFrame, type: str) -> DataFrame:
    """:func:`strong_components` in memory: one walk that keeps its own stack."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        names, starts, target, _ = _numbered(rows)
        n = len(names)
        index, low, on = np.full(n, -1), np.zeros(n, int), np.zeros(n, bool)
        stack, out, count = [], [], 0
        for root in range(n):
            if index[root] >= 0:
                continue
            work = [(root, starts[root])]
            while work:
                v, k = work.pop()
                if k == starts[v] and index[v] < 0:
                    index[v] = low[v] = count
                    count += 1
                    stack.append(v)
                    on[v] = True
                deeper = False
                while k < starts[v + 1]:
                    t = target[k]
                    if index[t] < 0:
                        work += [(v, k), (t, starts[t])]
                        deeper = True
                        break
                    if on[t]:
                        low[v] = min(low[v], low[t])
                    k += 1
                if deeper:
                    continue
                if low[v] == index[v]:
                    part = []
                    while True:
                        t = stack.pop()
                        on[t] = False
                        part.append(t)
                        if t == v:
                            break
                    if len(part) > 1:
                        least = min(names[t] for t in part)
                        out += [(names[t], least) for t in part]
        return pd.DataFrame(out, columns=["node", "component"], dtype=object)

    return _in_one_task(edges, solve, f"node {type}, component {type}")


def strong_components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Strongly connected components of two nodes or more: node, component (smallest node).

    Forward-backward colouring: each round every live node takes the first
    node that reaches it, in an order that a hash draws anew; the nodes of a
    colour that reach its root backwards within the colour are the root's
    component and leave. An order by id would take one component a round from
    a chain of cycles with ascending ids. Edges that leave a component or lead
    to it go with it; what is left, once small, is solved in one task.
    """
    live = kept(edges.select("a", "b").where("a <> b").distinct())
    type = live.schema["a"].dataType.simpleString()
    found = None
    for k in range(max_rounds):
        if live.count() <= SMALL:
            rest = _strong(live, type)
            break
        # nodes without an edge in or out are in no cycle: trimmed until none is left to trim
        size = live.count()
        while size > SMALL:
            trimmed = kept(live.join(live.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(live.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            left = trimmed.count()
            live, done, size = trimmed, left == size, left
            if done:
                break
        if size <= SMALL:
            rest = _strong(live, type)
            break
        colour = kept(live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("c", F.struct(F.xxhash64(F.lit(k), "node").alias("h"), F.col("node").alias("v"))))
        while True:
            pushed = live.join(colour.select(F.col("node").alias("a"), "c"), "a").groupBy(F.col("b").alias("node")).agg(F.min("c").alias("p"))
            after = kept(colour.join(pushed, "node", "left").select("node", F.least("c", F.coalesce("p", "c")).alias("c"), (F.coalesce("p", "c") < F.col("c")).alias("moved")))
            colour = after.select("node", "c")
            if after.where("moved").isEmpty():
                break
        inside = live.join(colour.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
        inside = kept(inside.where("ca = cb").select(F.col("b").alias("a"), F.col("a").alias("b")))
        back = reachable(inside, colour.where("node = c.v").select("node")).select("node")
        part = kept(colour.join(back, "node").select("node", F.col("c.v").alias("root")))
        found = part if found is None else found.unionByName(part)
        live = kept(live.join(back.withColumnRenamed("node", "a"), "a", "left_anti").join(back.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"))
    else:
        raise RuntimeError(f"strong components need more than {max_rounds} rounds")
    if found is None:
        return rest
    big = found.groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("component")).where("n > 1").drop("n")
    return found.join(big, "root").select("node", "component").unionByName(rest)
