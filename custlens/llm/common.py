"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words of every operator here: runs of anything but blank, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in a batch that Spark hands to Python.
BATCH_ROWS = 1000
#: Internal id of a null doc_id; results give null back.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session may lack the setting; it then gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if d is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="custlens-llm-")
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_bytes(texts: list[str], budget: int) -> Iterator[slice]:
    """Slices of ``texts`` whose lengths add up to about ``budget``, at least one text each."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > budget:
            yield slice(first, i)
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield slice(first, len(texts))


def importable(spark: SparkSession) -> SparkSession:
    """The session, with this package on the path of its Python workers wherever it was started."""
    env = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in (paths := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [*paths, root]))
    return spark


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with this package on the workers' path, wherever the session was started.

    Rows hold whole texts, so batches are kept to ``BATCH_ROWS`` unless the session sets a smaller number.
    """
    spark = importable(df.sparkSession)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.mapInArrow(fn, schema)


def in_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]],
             schema: str | StructType) -> DataFrame:
    """``map_batches`` of a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return map_batches(df, run, schema)


def packed(df: DataFrame, text: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """(row struct of all columns but ``drop``, t): whatever the columns are called, ``row.*`` gives them back."""
    kept = [c for c in df.columns if c.lower() not in drop]
    return df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(text).alias("t"))


def with_row(rows: DataFrame, more: str) -> StructType:
    """Schema of the struct column ``row`` of ``rows`` and the columns of the DDL ``more``."""
    return StructType([rows.schema["row"], *StructType.fromDDL(more).fields])


def sorted_rows(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` sorted over all partitions, and ``at``: a number that ascends by 1 within a partition and goes on rising
    from partition to partition. Rows equal in ``order`` are split by their place in the input, so no key is one task."""
    keys = [*order, "__tie"]
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.drop("__tie").withColumn("at", F.monotonically_increasing_id())


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, gapless from 0 within the non-null ``group`` in ``order``, and ``n``, the group's rows.

    One range exchange of the rows; the counts that give each partition's offset are a row for each partition and group.
    """
    rows = written(sorted_rows(rows, group, *order).withColumn("part", F.shiftright("at", 33)), name)
    runs = rows.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(group, "part", F.sum("c").over(whole).alias("n"),
                       (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(runs, [group, "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


class Forest:
    """Union-find over integers; ``join`` tells whether it linked two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        r = x
        while (up := p.get(r, r)) != r:
            r = up
        while x != r:
            p[x], x = r, p.get(x, x)
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a < b:
            a, b = b, a
        self.parent[a] = b
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's edges as stars: each node with the smallest node of its tree."""
    f = Forest()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            f.join(x, y)
    nodes = list(f.parent)
    yield pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array([f.root(n) for n in nodes], pa.int64())], ["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node it reaches.

    ``edges`` has two long columns. Alternates the large-star and small-star
    steps (each is a partial aggregation and a join) until no edge changes; each
    round is written to the shared folder. Partitions are contracted to
    stars first, so chains inside one partition cost no round.
    """
    a, b = edges.columns
    e = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))
    e = written(map_batches(e, _contract, "u long, v long"), "edges")
    state = None
    while True:
        both = e.union(e.select("v", "u")).toDF("n", "x")
        # written, so that both sides of the join are plain exchanges and a node with very many links can be split
        low = written(both.groupBy("n").agg(F.least("n", F.min("x")).alias("m")), "lowest")
        large = both.join(low, "n").where("x > n").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = written(small, "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                e.select("v", "v").distinct())
        state = now


def whole_groups(batches: Iterator[pa.RecordBatch], key: int = 0, least: int = 500_000) -> Iterator[pa.Table]:
    """Tables of at least ``least`` rows (the last aside) of a stream sorted by column ``key``, never parting equal keys."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        last = b.column(key)[b.num_rows - 1].as_py()
        cut = b.column(key).to_numpy(zero_copy_only=False).searchsorted(last, "left")
        if cut or len(held) > 1 and held[-2].column(key)[held[-2].num_rows - 1].as_py() != last:
            t = pa.Table.from_batches([*held[:-1], b.slice(0, cut)])
            held, rows = [b.slice(cut)], b.num_rows - int(cut)
            if t.num_rows:
                yield t
        else:
            least = max(least, 2 * rows)
    if held:
        yield pa.Table.from_batches(held)
