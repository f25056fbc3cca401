"""Materialising shared intermediates as Parquet tables.

Every report reads the profile, and every customer-level question reads
the per-customer summaries, so ``CustomerAnalytics`` computes them once and writes
them to the folder named by ``spark.checkpoint.dir``.  A written table
cuts the lineage (a lost executor costs a re-read, never the aggregation
again) and, being columnar, lets each later question read only its columns.
``localCheckpoint`` is never used: it keeps blocks on executors that may disappear.

Operators that must read a few columns of a costly frame several times write them once (``once``, ``sorted_once``); these
tables belong to the application and go with ``release`` or at its end.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .session import checkpoint_dir


def keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as a Parquet table of the shared folder, and the table's path."""
    path = f"{checkpoint_dir(df.sparkSession)}/custlens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table made by ``keep``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_released: list[tuple[SparkSession, str, str | None]] = []


def _own(spark: SparkSession, path: str, table: str | None = None) -> None:
    if not _released:
        atexit.register(release)
    _released.append((spark, path, table))


def release() -> None:
    """Delete the tables of ``once`` and ``sorted_once``; frames made from them can no longer be read."""
    while _released:
        spark, path, table = _released.pop()
        with contextlib.suppress(Exception):  # a session that has ended takes nothing back
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            forget(spark, path)


def local_rows(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """Few rows that the driver knows, as part of the plan: using or broadcasting them runs no job of their own."""
    fields = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields), schema)


def cheap(df: DataFrame) -> bool:
    """Whether reading ``df`` again costs a scan of its columns only: projections and filters of stored tables."""
    for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines():
        node = re.match(r"[ :+\-]*(\w+)", line)
        if node and node[1] in ("Relation", "InMemoryRelation"):  # below a cached frame stands how it was made
            return True
        if not node or node[1] not in ("Project", "Filter"):
            return False
    return False


def once(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as a table unless it is as good as one already."""
    if cheap(df):
        return df
    kept, path = keep(df, name)
    _own(df.sparkSession, path)
    return kept


def sorted_once(df: DataFrame, name: str, *order, partitions: int | None = None) -> DataFrame:
    """``df`` globally sorted and written once, with ``__part`` and ``__at`` (ascending over all rows, by 1 within a part).

    One range exchange of the rows.  The table is bucketed by ``__part``, so windows and
    aggregates within a part need no further exchange.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33).cast("int"))
    table = f"custlens_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark)}/custlens-{name}-{uuid.uuid4().hex}"
    rows.write.format("parquet").bucketBy(n, "__part").sortBy("__part", "__at").option("path", path).saveAsTable(table)
    _own(spark, path, table)
    return spark.table(table)
