"""Operator 12: centroid clustering with a vantage-point tree.

Vectors become integers once; everything after is exact. Each round builds a
vantage-point tree over the centroids and broadcasts it (``MAX_CENTROIDS`` centroids at most). Every
vector searches it best first: a queue holds the lower bound of each subtree still to be
seen, the subtree of the least bound is opened next, and the search ends when that bound exceeds the best
distance. Bounds are doubles, lowered by more than their rounding, and a subtree that may hold an equally
near centroid is opened (inclusive radius); distances to centroids are integers and ties go to the smaller number.
The queues of a batch's vectors are rows of one matrix, so numpy moves all searches of a batch one step at a time.

Only sums of each cluster leave the tasks: a row a cluster and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.llm.common import importable, in_arrow, map_batches, written

#: Centroids that the driver holds and broadcasts, at most.
MAX_CENTROIDS = 1 << 14
#: Centroids in a leaf of the tree.
LEAF = 4
#: Largest integer component: squared distances of vectors of 2^8 components stay below 2^63.
LIMIT = 1 << 26
#: Cells of the queues of the vectors that are searched side by side, at most.
_QUEUES = 1 << 20


@dataclass
class VantageTree:
    """Nodes by number; the root is 0. ``near``/``far``: children, -1 if none. ``low``/``high``: least and greatest
    distance from the node's vantage point to the centroids of each child."""

    points: np.ndarray  # centroids, by cluster number
    members: np.ndarray  # per node: its centroids (a vantage point, or a leaf's), -1 where there are fewer
    child: np.ndarray  # per node: near and far
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def build(points: np.ndarray) -> "VantageTree":
        members, child, low, high = [], [], [], []

        def node(own: list[int]) -> int:
            members.append(own + [-1] * (LEAF - len(own)))
            child.append([-1, -1])
            low.append([0.0, 0.0])
            high.append([0.0, 0.0])
            return len(members) - 1

        todo = [(np.arange(len(points)), None)]
        while todo:
            ids, above = todo.pop()
            leaf = len(ids) <= LEAF
            # the vantage point is the centroid furthest from the middle: its distances to the others differ most
            if not leaf:
                own = points[ids].astype(np.float64)
                v = int(ids[int(((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax())])
            me = node(ids.tolist() if leaf else [v])
            if above is not None:
                child[above[0]][above[1]] = me
            if leaf:
                continue
            rest = ids[ids != v]
            d = np.sqrt(squared(points[rest], points[v][None]).astype(np.float64))
            order = np.argsort(d, kind="stable")
            for side, part in enumerate(np.array_split(order, 2)):
                if len(part):
                    low[me][side], high[me][side] = float(d[part].min()), float(d[part].max())
                    todo.append((np.sort(rest[part]), (me, side)))
        return VantageTree(points, np.array(members), np.array(child), np.array(low), np.array(high))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row of ``x`` (the smallest number of equally near ones), and the squared distance."""
        rows, nodes = len(x), len(self.members)
        best = np.full(rows, np.iinfo(np.int64).max)
        who = np.full(rows, -1, np.int64)
        queue = np.full((rows, nodes), np.inf)
        queue[:, 0] = 0.0
        live = np.arange(rows)
        while len(live):
            at = queue[live].argmin(axis=1)
            bound = queue[live, at]
            going = np.isfinite(bound) & (bound <= np.sqrt(best[live].astype(np.float64)))
            live, at = live[going], at[going]
            if not len(live):
                break
            queue[live, at] = np.inf
            own = self.members[at]
            for k in range(LEAF):
                has = own[:, k] >= 0
                if not has.any():
                    break
                to, c = live[has], own[has, k]
                d = squared(x[to], self.points[c])
                if k == 0:
                    first = np.zeros(len(live))
                    first[has] = np.sqrt(d.astype(np.float64))
                nearer = (d < best[to]) | ((d == best[to]) & (c < who[to]))
                best[to[nearer]], who[to[nearer]] = d[nearer], c[nearer]
            for side in (0, 1):
                down = self.child[at, side]
                inner = down >= 0
                if not inner.any():
                    continue
                to, d, n = live[inner], first[inner], at[inner]
                gap = np.maximum(self.low[n, side] - d, d - self.high[n, side])
                gap -= 1e-9 * (d + self.high[n, side] + 1)  # more than the rounding of both distances
                queue[to, down[inner]] = np.maximum(gap, 0.0)
        return who, best


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), dims).astype(np.int64)


def _located(tree: VantageTree, b: pa.RecordBatch, dims: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    side = max(1, _QUEUES // len(tree.members))
    for first in range(0, b.num_rows, side):
        part = slice(first, min(first + side, b.num_rows))
        x = _matrix(b.column("v").slice(first, side), dims)
        yield part, x, *tree.nearest(x)


def _whole(vectors: DataFrame, key: str, embedding: str, dims: int, scale: int) -> DataFrame:
    """(id, v) of the usable vectors, v as integers; a component beyond ``LIMIT`` stops the job."""
    e = F.col(f"`{embedding}`").cast("array<double>")
    usable = (F.size(e) == dims) & F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))

    def whole(x):
        y = F.floor(x * scale)
        fits = F.abs(x * scale) <= LIMIT
        return F.when(fits, y.cast("int")).otherwise(F.raise_error(F.lit("a vector component is too large for exact distances")).cast("int"))

    rows = vectors.select(F.col(f"`{key}`").alias("id"), e.alias("e")).where(F.coalesce(e.isNotNull() & usable, F.lit(False)))
    return rows.select("id", F.transform("e", whole).alias("v"))


def _seeds(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """``k`` vectors of smallest sha256 of ``seed:id``, in that order (equal ids by vector)."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = rows.where(F.col("id").isNotNull()).select(h.alias("h"), "v").orderBy("h", "v").limit(k)
    return np.array([r["v"] for r in first.collect()], np.int64)


def _moved(spark: SparkSession, rows: DataFrame, points: np.ndarray) -> np.ndarray:
    """One round: the floors of the means of the vectors nearest to each centroid; without vectors it stays."""
    k, dims = points.shape
    tree = spark.sparkContext.broadcast(VantageTree.build(points))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for _, x, who, _ in _located(tree.value, b, dims):
                order = np.argsort(who, kind="stable")
                seen, start = np.unique(who[order], return_index=True)
                total[seen] += np.add.reduceat(x[order], start, axis=0)
                count += np.bincount(who, minlength=k)
        has = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(has, pa.int32()), pa.array(count[has]), pa.array(total[has].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    parts = map_batches(rows.select("v"), sums, "cluster int, n long, s array<long>")
    each = parts.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"),
                                        *(F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)))
    out = points.copy()
    for r in each.collect():  # a row a centroid
        out[r["cluster"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(dims)]
    tree.unpersist()
    return out


def clusters(vectors: DataFrame, k: int, rounds: int, dims: int, scale: int = 256, seed: int = 2, key: str = "vec_id",
             embedding: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid) of every usable row of ``vectors``.

    Usable: exactly ``dims`` components, none null, NaN or infinite; other rows are left out. A component x is taken as
    floor(``scale`` * x). Fewer than ``k`` usable rows with a key give as many centroids. Rows of null key are clustered but are
    no first centroid; repeated rows and equal vectors are rows of their own. Equally near: the smaller number. ``inertia`` is the sum
    of squared distances. No usable row, or none with a key: an empty result. A component beyond
    ``LIMIT`` / ``scale`` raises, since distances would not be exact. Other columns are not read.
    """
    if not 0 < k <= MAX_CENTROIDS:
        raise ValueError(f"1 to {MAX_CENTROIDS} centroids")
    if dims > 1 << 8:
        raise ValueError("distances of more than 256 components may not fit 64 bits")
    spark = importable(vectors.sparkSession)
    rows = written(_whole(vectors, key, embedding, dims, scale), "whole-vectors")
    kind = rows.schema["id"].dataType.simpleString()
    result = f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    points = _seeds(rows, k, seed)
    if not len(points):
        return spark.createDataFrame([], result)
    for _ in range(rounds):
        points = _moved(spark, rows, points)
    tree = spark.sparkContext.broadcast(VantageTree.build(points))

    def placed(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, _, who, d in _located(tree.value, b, dims):
            yield pa.RecordBatch.from_arrays([b.column("id").slice(part.start, part.stop - part.start), pa.array(who, pa.int32()),
                                              pa.array(d)], ["id", "cluster", "distance"])

    found = written(in_arrow(rows, placed, f"id {kind}, cluster int, distance long"), "clustered")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a centroid
    total = sum(sums.values())
    each = spark.createDataFrame([(c, s, total, points[c].tolist()) for c, s in sums.items()],
                                 "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(each), "cluster").select(
        F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: list[int]) -> str:
    """sha256 of the components as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
