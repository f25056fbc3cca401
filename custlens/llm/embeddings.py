"""Operator 4: embedding near-duplicates by an epsilon grid order join.

Unit vectors of equal label are sorted by the grid cells (side epsilon) of their
leading principal coordinates. The sequence is cut into blocks; blocks of neighbouring
cells whose bounding boxes are within epsilon meet in an equality join, and a
pair of blocks is joined by recursion over sequence intervals that skips
intervals provably further apart. The principal axes come from a bounded sample;
any orthonormal axes never lengthen a distance, so they only steer the speed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from custlens.llm.common import Forest, connected_components, in_arrow, map_batches, shuffle_partitions, written

#: Distinct vectors that the axes are fitted on, leading axes used, vectors in a block and in a leaf of the recursion.
SAMPLE, AXES, BLOCK, LEAF = 4096, 6, 2048, 128
#: Side of a cell at least: wider cells than epsilon are right too, and a block must not span too many.
MIN_CELL = 0.02
_SLACK = 1e-9


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of very large or small parts stay finite
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _axes(sample: list[list[float]]) -> dict[int, np.ndarray]:
    """Leading principal axes of the sample's unit vectors, by dimension."""
    out = {}
    for d in {len(v) for v in sample}:
        u = _unit(np.array([v for v in sample if len(v) == d], np.float64))
        u = u - u.mean(axis=0)
        _, axes = np.linalg.eigh(u.T @ u)
        out[d] = np.ascontiguousarray(axes[:, ::-1][:, :AXES])
    return out


def _coordinates(u: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    d = u.shape[1]
    p = u @ axes[d] if d in axes else u[:, :AXES]
    return np.pad(p, ((0, 0), (0, AXES - p.shape[1])))


class _Side:
    """One block: its unit vectors, copies of each, and bounding boxes of its leaves."""

    def __init__(self, row: dict) -> None:
        self.cid = np.frombuffer(row["cids"], np.int64)
        self.cnt = np.frombuffer(row["cnts"], np.int64)
        self.u = _unit(np.frombuffer(row["vecs"], np.float64).reshape(len(self.cid), -1))
        xs = np.frombuffer(row["coords"], np.float64).reshape(len(self.cid), -1)
        cuts = range(0, len(xs), LEAF)
        self.lo = np.array([xs[i:i + LEAF].min(axis=0) for i in cuts])
        self.hi = np.array([xs[i:i + LEAF].max(axis=0) for i in cuts])

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return self.lo[a:b].min(axis=0), self.hi[a:b].max(axis=0)


def _apart(p: tuple, q: tuple, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(p[0] - q[1], q[0] - p[1]))
    return float((gap * gap).sum()) > (eps + _SLACK) ** 2


def _join(a: _Side, b: _Side, same: bool, cosine: float, eps: float):
    """Links of each vector of both sides (copies counted), and a forest over their positions (b's after a's)."""
    base = 0 if same else len(a.cid)
    links = np.zeros(base + len(b.cid), np.int64)
    root, forest = np.arange(len(links)), Forest()
    todo = [(0, len(a.lo), 0, len(b.lo))]
    while todo:
        i, j, k, m = todo.pop()
        if _apart(a.box(i, j), b.box(k, m), eps):
            continue
        if j - i == 1 and m - k == 1:
            _leaf(a, b, same, cosine, i, k, base, links, root, forest)
            continue
        h = (i + j) // 2
        first = [(i, h), (h, j)] if j - i > 1 else [(i, j)]
        h = (k + m) // 2
        second = [(k, h), (h, m)] if m - k > 1 else [(k, m)]
        todo += [(*x, *y) for x in first for y in second if not same or x[0] < y[1]]
    return links, [forest.root(x) for x in range(len(links))]


def _leaf(a, b, same, cosine, i, k, base, links, root, forest) -> None:
    if same and i > k:
        return
    x = slice(i * LEAF, min((i + 1) * LEAF, len(a.cid)))
    y = slice(k * LEAF, min((k + 1) * LEAF, len(b.cid)))
    near = a.u[x] @ b.u[y].T >= cosine
    if same and i == k:
        near = np.triu(near, 1)
    if not near.any():
        return
    links[x] += near @ b.cnt[y]
    at = slice(base + y.start, base + y.stop)
    links[at] += a.cnt[x] @ near
    left, right = np.arange(len(links))[x], np.arange(len(links))[at]
    while True:  # each round joins some parts; linked pairs within one part are never walked through
        p, q = np.nonzero(near & (root[left][:, None] != root[right][None, :]))
        if not len(p):
            return
        one = np.unique(p, return_index=True)[1]  # one link of each row
        for r, c in zip(root[left[p[one]]].tolist(), root[right[q[one]]].tolist()):
            forest.join(r, c)
        seen = np.array(list(forest.parent))
        new = root.copy()
        new[seen] = [forest.root(s) for s in seen.tolist()]
        root[:] = new[root]


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, key: str = "vec_id", embedding: str = "embedding",
                    label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) of every row of ``vectors``.

    Only rows of equal label and dimension link, at ``cosine`` or more in
    double precision. A null label, a null or empty or zero vector, and one with null or
    non-finite parts link with nothing: n_links 0, its own component. Equal
    vectors of a label are collapsed to one with a count before anything is
    paired, so copies cost one row; repeated rows are vectors of their own. A null key
    names no component that has a key. Other columns are ignored.
    """
    spark = vectors.sparkSession
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"),
                          F.col(embedding).cast("array<double>").alias("v"))
    usable = (F.col("label").isNotNull() & F.col("v").isNotNull()
              & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    good = F.coalesce(usable, F.lit(False))
    classes = rows.where(good).groupBy("label", "v").agg(F.min("id").alias("low"), F.count("*").alias("cnt"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    sample = classes.orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").collect()
    axes = spark.sparkContext.broadcast(_axes([r[0] for r in sample]))  # at most AXES columns of SAMPLE's vectors
    names = [f"c{i}" for i in range(AXES)]

    def placed(b: pa.RecordBatch):
        for d, part in _by_size(b):
            x = _coordinates(_unit(_matrix(part, 1, d)), axes.value)
            cells = np.floor(x / max(eps, MIN_CELL)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([d] * part.num_rows, pa.int32()), pa.array([r.tobytes() for r in x], pa.binary()),
                 *(pa.array(cells[:, i]) for i in range(AXES))], ["cid", "v", "label", "cnt", "d", "x", *names])

    kind = classes.schema["label"].dataType.simpleString()
    columns = f"cid long, v array<double>, label {kind}, cnt long, d int, x binary, " + ", ".join(f"{c} long" for c in names)
    order = ["label", "d", *names, "cid"]
    points = in_arrow(classes.select("cid", "v", "label", "cnt"), placed, columns)
    points = points.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one label, dimension and first cell, ``BLOCK`` vectors at most."""
        n, held, mine = TaskContext.get().partitionId() << 32, [], None

        def block():
            nonlocal n
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            x = np.frombuffer(b"".join(t.column(5).to_pylist())).reshape(t.num_rows, AXES)
            c1 = t.column(7).to_numpy()
            n += 1
            return {"block": n, "label": mine[0], "d": mine[1], "c0": mine[2], "first": int(c1.min()), "last": int(c1.max()),
                    "lo": x.min(axis=0).tolist(), "hi": x.max(axis=0).tolist(), "cids": t.column(0).to_numpy().tobytes(),
                    "cnts": t.column(3).to_numpy().tobytes(), "vecs": _matrix(t, 1, mine[1]).tobytes(), "coords": x.tobytes()}

        for b in batches:
            keys = list(zip(b.column(2).to_pylist(), b.column(4).to_pylist(), b.column(6).to_pylist()))
            at = 0
            while at < len(keys):
                size = sum(h.num_rows for h in held)
                if held and (keys[at] != mine or size == BLOCK):
                    yield pa.RecordBatch.from_pylist([block()], schema=block_schema)
                    held, size = [], 0
                mine, end = keys[at], at + 1
                while end < len(keys) and keys[end] == mine and size + end - at < BLOCK:
                    end += 1
                held.append(b.slice(at, end - at))
                at = end
        if held:
            yield pa.RecordBatch.from_pylist([block()], schema=block_schema)

    block_schema = pa.schema(
        [("block", pa.int64()), ("label", to_arrow_type(classes.schema["label"].dataType)), ("d", pa.int32()), ("c0", pa.int64()),
         ("first", pa.int64()), ("last", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())),
         ("cids", pa.binary()), ("cnts", pa.binary()), ("vecs", pa.binary()), ("coords", pa.binary())])
    cut = written(map_batches(
        points,
        blocks, f"block long, label {kind}, d int, c0 long, first long, last long, lo array<double>, hi array<double>, "
                "cids binary, cnts binary, vecs binary, coords binary"), "blocks")

    meta = cut.select("block", "label", "d", "c0", "first", "last", "lo", "hi")
    left = meta.withColumn("c1", F.explode(F.sequence("first", "last")))
    right = meta.withColumn("c0", F.explode(F.array(*(F.col("c0") + i for i in (-1, 0, 1))))).withColumn(
        "c1", F.explode(F.expr("sequence(first - 1, last + 1)")))
    near = left.alias("l").join(right.alias("r"), ["label", "d", "c0", "c1"]).where("l.block <= r.block")
    gap = F.aggregate(
        F.zip_with(F.zip_with("l.lo", "r.hi", lambda p, q: p - q), F.zip_with("r.lo", "l.hi", lambda p, q: p - q), lambda p, q: F.greatest(p, q)),
        F.lit(0.0), lambda s, g: s + F.when(g > 0, g * g).otherwise(0.0))
    near = near.where(gap <= (eps + _SLACK) ** 2).select(F.col("l.block").alias("a"), F.col("r.block").alias("b")).distinct()
    body = F.struct("cids", "cnts", "vecs", "coords")
    pairs = near.join(cut.select(F.col("block").alias("a"), body.alias("left")), "a").join(
        cut.select(F.col("block").alias("b"), body.alias("right")), "b")

    def joined(b: pa.RecordBatch):
        for row in b.to_pylist():
            same = row["a"] == row["b"]
            x = _Side(row["left"])
            y = x if same else _Side(row["right"])
            links, root = _join(x, y, same, cosine, eps)
            cid = x.cid if same else np.concatenate([x.cid, y.cid])
            hit = links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(cid[hit]), pa.array(links[hit]), pa.array(cid[np.array(root)][hit])], ["cid", "links", "root"])

    found = written(in_arrow(pairs.select("a", "b", "left", "right"), joined, "cid long, links long, root long"), "links")
    parts = connected_components(found.select("cid", "root"))
    each = classes.select("cid", "label", "v", "low", "cnt")
    linked = each.join(parts, each["cid"] == parts["node"]).select("cid", "component", "low")
    lowest = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = linked.join(lowest, "component").select("cid", "component_id")
    n = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = each.join(n, "cid", "left").join(linked, "cid", "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("cnt") - 1).alias("links"),
        F.coalesce("component_id", "low").alias("component_id"))
    named = written(named, "named-vectors")
    rows = rows.withColumn("v", F.when(good, F.col("v")))
    out = rows.join(named, ["label", "v"], "left").select(
        F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def _by_size(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = np.diff(b.column(1).offsets.to_numpy())
    for d in np.unique(sizes).tolist():
        yield d, b if (sizes == d).all() else b.filter(pa.array(sizes == d))


def _matrix(b: pa.RecordBatch, column: int, d: int) -> np.ndarray:
    return b.column(column).flatten().to_numpy().reshape(b.num_rows, d)
