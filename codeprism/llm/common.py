"""Shared plumbing: the cluster's shared folder, staged tables, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only under a local master that leaves it unset (tests) a local folder takes
    its place; a cluster without it is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="codeprism-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the driver ends, or by :func:`purge`."""
    path = f"{shared_dir(spark)}/codeprism-{spark.sparkContext.applicationId}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged folder through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def open_fs(uri: str):
    """(file system, path) of a URI, for the store that holds the shared folder."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def purge(spark: SparkSession) -> None:
    """Drop everything this application staged (results must be written before)."""
    remove(spark, work_dir(spark))


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and makes sure that an
    expensive plan with several readers runs once.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def needed_count(m: int, p: float, recall: float) -> int:
    """The largest count that Binomial(m, p) reaches with the probability ``recall``."""
    tail, need = 0.0, 0
    for k in range(m + 1):
        tail += comb(m, k) * p**k * (1 - p) ** (m - k)
        if tail > 1 - recall:
            return k
        need = k
    return need


#: Narrow keys up to this many are broadcast (they are counted first); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def by_id(rows: DataFrame, ids: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Join with a side of distinct narrow ``ids``: broadcast within its bound, else shuffled."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids, on, how)


def by_block(rows: DataFrame) -> DataFrame:
    """Rows of a block together, one block after the other."""
    return rows.repartition("block").sortWithinPartitions("block")


def runs_of(batches: Iterator[pd.DataFrame], key: str) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each run of equal ``key`` in batches sorted by it.

    Far cheaper than a grouped map where most groups have a few rows. A run is
    held in memory whole, so the plan must bound it.
    """
    held = None
    for batch in batches:
        if held is not None and len(held):
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        columns = {c: batch[c].to_numpy() for c in batch}
        cuts = np.flatnonzero(columns[key][1:] != columns[key][:-1]) + 1
        for lo, hi in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
            yield {c: v[lo:hi] for c, v in columns.items()}
        held = batch.iloc[cuts[-1] if len(cuts) else 0 :]
    if held is not None and len(held):
        yield {c: held[c].to_numpy() for c in held}


#: Rounds of contraction that go by id before the order is drawn by a hash.
BY_ID = 6
#: Edges that one task joins in memory (sixteen bytes each).
SMALL_EDGES = 1_000_000


def _joined(edges: DataFrame) -> DataFrame:
    """node and r, the smallest node of its component, of a small graph in one task."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [x for x in batches if len(x)]
        if held:
            rows = pd.concat(held, ignore_index=True)
            nodes, at = np.unique(np.concatenate([rows.a, rows.b]), return_inverse=True)
            roots = Roots(len(nodes))
            roots.join(at[: len(rows)], at[len(rows) :])
            yield pd.DataFrame({"node": nodes, "r": nodes[roots.root]})

    return staged(edges.coalesce(1).mapInPandas(join, "node bigint, r bigint"), "hook")


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Components of an undirected graph by contraction.

    ``edges`` holds two bigint columns ``a`` and ``b``; nulls and loops are
    ignored, repeats are harmless. Returns ``node, component`` (the smallest
    node reachable), a row per node that has an edge.

    Each round every node takes the first node of its closed neighbourhood (a
    map-side combined minimum, so hubs don't skew it), edges are renamed to
    these nodes and what became a loop disappears. The first ``BY_ID`` rounds
    go by id, which folds shallow trees and stars at once; later ones by an
    order that a hash draws anew, so that a third of the nodes goes each round
    in expectation whatever the graph, long chains included. The rename joins
    are plain sort-merge joins that adaptive execution may split. What is left,
    once counted to have ``SMALL_EDGES`` edges at most, is joined in one task.
    """
    spark = edges.sparkSession
    live = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    live = staged(live.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    for k in range(max_rounds):
        left = live.count()
        if left <= SMALL_EDGES:
            if left:
                maps.append(_joined(live))
            break
        draw = lambda c: F.struct((F.lit(0) if k < BY_ID else F.xxhash64(F.lit(k), F.col(c))).alias("h"), F.col(c).alias("v"))
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(draw("b")).alias("f"))
        to = staged(first.select(F.col("a").alias("node"), F.least("f", draw("a"))["v"].alias("r")), "hook")
        maps.append(to)
        renamed = (
            live.join(to.select(F.col("node").alias("a"), F.col("r").alias("ra")), "a")
            .join(to.select(F.col("node").alias("b"), F.col("r").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        )
        live = staged(renamed.distinct(), "edges")
    else:
        raise RuntimeError(f"components need more than {max_rounds} rounds")
    if not maps:
        return spark.createDataFrame([], "node bigint, component bigint")
    # Fold from the last round back: what a node points to is renamed by all later rounds.
    out = maps[-1].select("node", F.col("r").alias("root"))
    for to in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("r"), "root")
        out = staged(to.join(later, "r", "left").select("node", F.coalesce("root", "r").alias("root")), "label")
    least = out.groupBy("root").agg(F.min("node").alias("component"))
    return staged(out.join(least, "root").select("node", F.least("component", "root").alias("component")), "components")


class Roots:
    """Connected rows of a block: ``root`` holds the first row that each is joined to."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join pairs of rows. Pairs that are joined already cost one look."""
        while len(i):
            a, b = self.root[i], self.root[j]
            new = a != b
            i, j, a, b = i[new], j[new], a[new], b[new]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up

    def parents(self, fan: int = 8) -> np.ndarray:
        """A parent for each row, the first of a group its own: trees that join
        the groups, with at most ``fan`` children a row, so that no hub arises."""
        order = np.argsort(self.root, kind="stable")
        starts = np.flatnonzero(np.r_[True, self.root[order][1:] != self.root[order][:-1]]) if len(order) else order
        first = np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        k = np.arange(len(order)) - first
        out = np.empty(len(order), np.int64)
        out[order] = order[first + np.maximum(k - 1, 0) // fan]
        return out


#: Classes of so many rows are hot; a join by key splits a class into as many parts as it has this many rows.
HOT_ROWS = 100_000


def node_of(key: Column) -> Column:
    """A class as a graph node: 63 bits of its key's hash."""
    return F.xxhash64(key).bitwiseAND(F.lit((1 << 63) - 1))


def linked_classes(everything: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """What links between classes say of each row.

    ``everything``: id, key (null: links with nothing), more; ``classes``: key,
    rep (smallest id), m (rows); ``found``: key, links (rows linked, of other
    classes) and edges a, b between nodes (:func:`node_of`). Returns id, class_id,
    n_links, kept and the further columns of ``everything``.

    Classes alone of their text and without a link need no join at all: what a
    row needs to know is joined for the others. The rows of a class with very many
    of them are dealt over as many keys as it has ``HOT_ROWS``.
    """
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    components = connected_components(found.select("a", "b"))
    known = classes.select("key", "rep", "m").join(links, "key", "left").where("m > 1 or links is not null")
    known = staged(known.withColumn("node", node_of(F.col("key"))).join(components, "node", "left"), "known")
    least = known.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    known = known.join(least, "component", "left")
    parts = F.ceil(F.col("m") / HOT_ROWS).cast("int")
    known = known.select("key", F.coalesce("least", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), parts.alias("parts"))
    known = staged(known, "classes-known")
    salted = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    most = known.agg(F.max("parts")).first()[0] or 1
    rows = everything.where("key is not null")
    if most > 1:
        # a row's part, below the parts of its class; only hot classes have several
        hot = known.where("parts > 1").select("key", "parts")
        rows = rows.join(F.broadcast(hot) if hot.count() <= 1_000_000 else hot, "key", "left")
        rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    else:
        rows = rows.withColumn("part", F.lit(0))
    out = rows.join(salted, ["key", "part"], "left").drop("part")
    # rows without a key, maybe many, would all meet in one task of the join
    bare = everything.where("key is null").withColumns({"class_id": F.lit(None).cast("bigint"), "n_links": F.lit(None).cast("bigint")})
    out = out.unionByName(bare)
    out = out.withColumns({"class_id": F.coalesce("class_id", "id"), "n_links": F.coalesce("n_links", F.lit(0).cast("bigint"))})
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)))
