"""Operator 11: sharding, and resharding by minimum-cost flow.

A layout is a folder of Parquet files by shard and a manifest that names the files of each shard in order with their rows,
bytes, first slot and first byte; rows of a file are consecutive in their shard. Files are the blocks that move. ``reshard`` takes the bytes of the old shards (one row a shard) and
the new capacities and solves a minimum-cost flow: keeping a byte costs nothing, moving it costs 1 or what the
caller sets for the two shards. The flow is laid out over each old shard's bytes: first what stays, then what goes to each
new shard. Files that lie within what stays are left alone, files within one transfer go as they are, and only files that a border
cuts are parted by rows. Files with rows that go are rewritten; the new manifest lists kept and new files.

The driver holds shards and transfers, never blocks or rows.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from custlens.llm.common import shared_dir, sorted_rows, written


@dataclass
class Layout:
    """``files``: (folder, file, shard, first_at, first_slot, first_byte, rows, bytes) of every file that belongs to the layout."""

    shards: int
    files: DataFrame
    row: StructField

    @property
    def stored(self) -> StructType:
        return StructType([self.row, StructField("at", LongType()), StructField("size", LongType()), StructField("shard", IntegerType())])


# ------------------------------------------------------------------------- minimum-cost flow

def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """Amounts by (source, sink) that carry every unit of ``supply`` within ``capacity`` at least total cost.

    Successive shortest paths with node potentials over the two-sided graph; costs are not negative. Among paths of
    equal cost the first source and sink win, so the result is the same every time.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are smaller than what is there")
    s, t = len(supply), len(capacity)
    flow: dict[tuple[int, int], int] = {}
    left, room = list(supply), list(capacity)
    high = [0] * (s + t)  # potentials: sources first, then sinks
    for source in range(s):
        while left[source]:
            far: list[float] = [float("inf")] * (s + t)
            came = [-1] * (s + t)
            far[source] = 0
            queue, done = [(0, source)], set()
            while queue:
                d, x = heapq.heappop(queue)
                if x in done:
                    continue
                done.add(x)
                if x < s:  # to every sink
                    steps = [(s + j, cost[x][j]) for j in range(t)]
                else:  # back along what flows
                    steps = [(i, -cost[i][x - s]) for i in range(s) if flow.get((i, x - s))]
                for y, c in steps:
                    if (new := d + c + high[x] - high[y]) < far[y]:
                        far[y], came[y] = new, x
                        heapq.heappush(queue, (new, y))
            sink = min((far[s + j] + high[s + j], j) for j in range(t) if room[j])[1]
            for x in range(s + t):  # nodes that were not reached lie at least as far as all that were
                high[x] += min(far[x], max(d for d in far if d < float("inf")))
            path, y = [], s + sink
            while y != source:
                path.append((came[y], y))
                y = came[y]
            amount = min([left[source], room[sink], *(flow[y, x - s] for x, y in path if x >= s)])
            for x, y in path:
                pair, sign = ((x, y - s), 1) if x < s else ((y, x - s), -1)
                flow[pair] = flow.get(pair, 0) + sign * amount
            left[source] -= amount
            room[sink] -= amount
    return {k: v for k, v in sorted(flow.items()) if v}


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def cut_points(flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(old shard, first byte, end byte, new shard): what stays comes first, then the transfers by new shard."""
    out = []
    for i in sorted({i for i, _ in flow}):
        at = 0
        for j in sorted((j for o, j in flow if o == i), key=lambda j: (j != i, j)):
            out.append((i, at, at + flow[i, j], j))
            at += flow[i, j]
    return out


# ------------------------------------------------------------------------- layouts on files

def _listed(spark: SparkSession, folder: str, row: StructField) -> DataFrame:
    """(folder, file, shard, first_at, rows, bytes) of the files of one folder; reads two columns."""
    stored = Layout(0, None, row).stored
    return (spark.read.schema(stored).parquet(folder).groupBy("shard", F.col("_metadata.file_name").alias("file"))
            .agg(F.min("at").alias("first_at"), F.count("*").alias("rows"), F.sum("size").alias("bytes"))
            .withColumn("folder", F.lit(folder)))


_FILE = ["folder", "file", "shard", "first_at", "first_slot", "first_byte", "rows", "bytes"]


def _before(column: str, window) -> Column:
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _manifest(listed: DataFrame, *order: str) -> DataFrame:
    within = Window.partitionBy("shard").orderBy(*order)  # a row a file
    files = listed.select("*", _before("rows", within).alias("first_slot"), _before("bytes", within).alias("first_byte"))
    return written(files.select(_FILE), "manifest")


def write_layout(docs: DataFrame, shard: Column, shards: int, order: str, text: str = "text") -> Layout:
    """``docs`` as files by ``shard`` (0 to ``shards`` - 1), in ascending ``order`` within each; size is the UTF-8 bytes of ``text`` plus 1."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + 1).cast("long").alias("size"),
                       shard.cast("int").alias("shard"))
    rows = rows.withColumn("by", F.col(f"row.`{order}`"))
    sorted_rows(rows, "shard", "by").select("row", "at", "size", "shard").write.partitionBy("shard").parquet(folder)
    return Layout(shards, _manifest(_listed(spark, folder, rows.schema["row"]), "first_at"), rows.schema["row"])


def _read(spark: SparkSession, layout: Layout, files: DataFrame) -> DataFrame:
    """(row, at, size, shard, file, folder, first_at, first_slot, first_byte) of the rows of ``files`` of the layout.

    Paths pass through the driver, as Spark's own listing of a folder does.
    """
    wanted = files.select("folder", "shard", "file").collect()
    out = None
    for folder in sorted({f["folder"] for f in wanted}):
        paths = [f"{folder}/shard={f['shard']}/{f['file']}" for f in wanted if f["folder"] == folder]
        rows = spark.read.schema(layout.stored).option("basePath", folder).parquet(*paths)
        rows = rows.select("row", "at", "size", "shard", F.col("_metadata.file_name").alias("file"), F.lit(folder).alias("folder"))
        out = rows if out is None else out.unionAll(rows)
    if out is None:
        none = spark.createDataFrame([], layout.stored)
        out = none.select("*", F.lit("").alias("file"), F.lit("").alias("folder"))
    return out.join(files.drop("rows", "bytes"), ["folder", "shard", "file"])


def read_layout(layout: Layout) -> DataFrame:
    """(row, size, shard, slot) of every row, read from the layout's files; ``slot`` counts from 0 within a shard."""
    rows = _read(layout.files.sparkSession, layout, layout.files)
    return rows.select("row", "size", "shard", (F.col("at") - F.col("first_at") + F.col("first_slot")).alias("slot"))


def reshard(layout: Layout, capacity: list[int] | None = None, shards: int | None = None,
            cost: list[list[int]] | None = None) -> tuple[Layout, DataFrame]:
    """The layout moved to new shards, and the transfers (old, new, bytes, rows).

    ``capacity``: bytes each new shard may hold (default: ``shards`` equal ones). New shard i is old shard i, what both have may
    stay. ``cost[i][j]``: of moving a byte from old shard i to new shard j, 0 for staying and 1 for others by default. A border
    between transfers that falls into a row gives the row to the side that holds its middle, so a shard's bytes differ
    from the flow by half a row at each border at most. An empty layout stays empty.
    """
    spark = layout.files.sparkSession
    sizes = {r["shard"]: r["b"] for r in layout.files.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}  # a row a shard
    supply = [sizes.get(i, 0) for i in range(layout.shards)]
    capacity = capacity or even_capacities(sum(supply), shards)
    cost = cost or [[int(i != j) for j in range(len(capacity))] for i in range(layout.shards)]
    cuts = cut_points(min_cost_flow(supply, capacity, cost))
    plan = F.broadcast(spark.createDataFrame(cuts, "old int, lo long, hi long, new int"))  # a row a transfer: shards, not data

    # a file is met by the transfers that its bytes overlap; one that only touches a single one needs no look at its rows
    files = layout.files
    end = F.col("first_byte") + F.col("bytes")
    meets = files.join(plan, (F.col("shard") == F.col("old")) & (F.col("first_byte") < F.col("hi")) & (end > F.col("lo")))
    fate = meets.groupBy("folder", "shard", "file").agg(F.count("*").alias("ways"), F.min("new").alias("new"))
    files = written(files.join(fate, ["folder", "shard", "file"]), "fates")
    stay = files.where((F.col("ways") == 1) & (F.col("new") == F.col("shard")))
    whole = files.where((F.col("ways") == 1) & (F.col("new") != F.col("shard")))
    cut = files.where(F.col("ways") > 1)

    within = Window.partitionBy("folder", "shard", "file").orderBy("at")  # as many files as borders
    parted = _read(spark, layout, cut.drop("ways", "new"))
    parted = parted.withColumn("middle", F.col("first_byte") + _before("size", within) + F.col("size") / 2)
    parted = parted.join(plan, (F.col("shard") == F.col("old")) & (F.col("middle") >= F.col("lo")) & (F.col("middle") < F.col("hi")))
    slot = (F.col("at") - F.col("first_at") + F.col("first_slot")).alias("slot")
    moved = _read(spark, layout, whole.drop("ways")).select("row", "size", "shard", "new", slot)
    moved = moved.unionAll(parted.select("row", "size", "shard", "new", slot))

    # rows of a transfer have consecutive slots in the old shard, so a number for each transfer gives the new slots
    parts = stay.unionAll(whole).select("shard", "new", "first_slot", "rows", "bytes").unionAll(
        parted.select("shard", "new", slot, F.lit(1).cast("long"), "size"))
    parts = parts.groupBy("shard", "new").agg(F.min("first_slot").alias("first_slot"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    transfers, base = [], {}
    for p in sorted(parts.collect(), key=lambda p: (p["shard"] != p["new"], p["shard"])):  # a row a transfer
        at = base.get(p["new"], 0)
        transfers.append((p["shard"], p["new"], p["bytes"], p["rows"], at - p["first_slot"]))
        base[p["new"]] = at + p["rows"]
    shift = spark.createDataFrame(transfers, "shard int, new int, bytes long, rows long, shift long")
    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    new = moved.join(F.broadcast(shift.select("shard", "new", "shift")), ["shard", "new"])
    new = new.select("row", (F.col("slot") + F.col("shift")).alias("slot"), "size", F.col("new").alias("shard"))
    sorted_rows(new, "shard", "slot").select("row", "at", "size", "shard").write.partitionBy("shard").parquet(folder)
    listed = stay.select(*_FILE[:4], "rows", "bytes", F.lit(0).alias("turn"), F.col("first_slot").alias("turn_at")).unionAll(
        _listed(spark, folder, layout.row).select(*_FILE[:4], "rows", "bytes", F.lit(1), "first_at"))
    return Layout(len(capacity), _manifest(listed, "turn", "turn_at"), layout.row), shift.drop("shift").withColumnRenamed("shard", "old")
