"""Tables that grow by loads: bucketed files, a committed manifest, no rescans.

A ``LoadedTable`` is a folder.  Every load writes a folder of its own, bucketed and sorted by the
table's key into the same number of buckets, and becomes visible by one atomic step: the next version of
the manifest is created, which fails if somebody else created it first.  A version
names its loads with their rows and their smallest and largest key.

* A load that died half-way left files that no version names; it can be repeated.
* A load that is repeated after its commit finds its id in the manifest and adds nothing.
* ``insert_or_ignore`` joins a batch only with loads whose key range meets the batch's.  The target is read bucket by
  bucket, key column only, with the range pushed to the files, and is **not shuffled**; ids that
  keep growing never look at older loads at all.
* ``read`` has the key's partitioning, so a group-by on the key needs no shuffle either (``operators.state``).
* ``compact`` folds all loads to one, bucket by bucket, without a shuffle; ``vacuum`` deletes what no version names.

Spark reads bucketed files through a catalog table; one is made per version under a name of its own and dropped by
``close``.  The files are the truth, any session can open them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .manifest import CommitConflict, Manifest
from .schemas import PRIMARY_KEYS, TABLE_SCHEMAS
from .tables import insert_or_ignore

_LOAD = "__load"


@dataclass(frozen=True)
class Load:
    """One committed load; ``low`` and ``high``: its smallest and largest key as text (None: no key)."""

    id: str
    folder: str
    rows: int
    low: str | None
    high: str | None


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


class LoadedTable:
    """The table at ``path``; schema, key and buckets are fixed when it is first opened."""

    #: Times that a load starts again after another writer's commit.
    RETRIES = 10

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self._tables: list[str] = []
        self._manifest = Manifest(spark, path)
        first = self._manifest.read(0)
        if first is None:
            first = {"buckets": buckets, "key": key, "schema": schema.jsonValue(), "loads": []}
            try:
                self._manifest.create(0, first)
            except CommitConflict:
                first = self._manifest.read(0)
        if first["key"] != key or StructType.fromJson(first["schema"]).simpleString() != schema.simpleString():
            raise ValueError(f"{path} is a table of another key or schema")
        self.buckets = first["buckets"]

    # ------------------------------------------------------------------ manifest
    @property
    def version(self) -> int:
        return self._manifest.versions()[-1]

    def loads(self, version: int | None = None) -> list[Load]:
        return [Load(**x) for x in self._manifest.read(self.version if version is None else version)["loads"]]

    def commit(self, base: int, loads: list[Load]) -> None:
        """Make ``loads`` the table, if ``base`` is still its version."""
        first = self._manifest.read(0)
        self._manifest.create(base + 1, {**first, "loads": [asdict(x) for x in loads]})

    # --------------------------------------------------------------------- reading
    def _table(self, loads: list[Load]) -> DataFrame:
        name = f"custlens_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({_ddl(self.schema)}, `{_LOAD}` STRING) USING parquet PARTITIONED BY (`{_LOAD}`) "
                       f"CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        self._tables.append(name)
        parts = " ".join(f"PARTITION (`{_LOAD}` = '{x.folder}') LOCATION '{self.path}/{x.folder}'" for x in loads if x.rows)
        if parts:
            self.spark.sql(f"ALTER TABLE {name} ADD {parts}")
        return self.spark.table(name).drop(_LOAD)

    def read(self, version: int | None = None, only: Callable[[Load], bool] = lambda load: True) -> DataFrame:
        """The rows of a version (default: the last), of the loads that ``only`` wants."""
        return self._table([x for x in self.loads(version) if only(x)])

    def close(self) -> None:
        """Drop the catalog tables; frames read from them can no longer be run. Files stay."""
        while self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop()}")

    def __enter__(self) -> "LoadedTable":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # --------------------------------------------------------------------- writing
    def write(self, rows: DataFrame, load_id: str) -> Load:
        """``rows`` as files that no version names yet; one file a bucket.  Counts and key range come from the same pass."""
        folder = f"load={uuid.uuid4().hex}"
        seen = Observation()
        rows = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields))
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.min(self.key).cast("string").alias("low"),
                            F.max(self.key).cast("string").alias("high"))
        name = f"custlens_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, self.key).write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key)
         .option("path", f"{self.path}/{folder}").saveAsTable(name))
        self.spark.sql(f"DROP TABLE {name}")
        return Load(load_id, folder, **seen.get)

    def _add(self, load_id: str, rows_of: Callable[[list[Load]], DataFrame]) -> int | None:
        for _ in range(self.RETRIES):
            base = self.version
            loads = self.loads(base)
            if any(x.id == load_id for x in loads):
                return None
            new = self.write(rows_of(loads), load_id)
            try:
                self.commit(base, [*loads, new])
                return new.rows
            except CommitConflict:
                continue
        raise CommitConflict(f"{self.path}: {self.RETRIES} times another load was first")

    def append(self, rows: DataFrame, load_id: str) -> int | None:
        """Add ``rows`` as they are; None if the load is there already, else the number of rows."""
        return self._add(load_id, lambda loads: rows)

    def new_rows(self, batch: DataFrame, loads: list[Load], order_by=None) -> DataFrame:
        """The batch's first row per key whose key is in none of ``loads`` (L4).

        The batch is dealt into the table's buckets; of the loads, only those whose key range meets the
        batch's are read, and of them only the key."""
        kind = self.schema[self.key].dataType
        first = insert_or_ignore(None, batch, key=self.key, order_by=order_by)
        lo, hi = batch.agg(F.min(self.key).cast(kind), F.max(self.key).cast(kind)).first()
        if lo is None:
            return first
        ranges = [(i, x.low, x.high) for i, x in enumerate(loads) if x.low is not None]
        near: set[int] = set()
        if ranges:  # one row a load; Spark compares, so that keys of every type do
            r = self.spark.createDataFrame(ranges, "i int, low string, high string")
            meets = (F.col("low").cast(kind) <= F.lit(hi)) & (F.col("high").cast(kind) >= F.lit(lo))
            near = {x["i"] for x in r.where(meets).collect()}
        if not near:
            return first
        old = self._table([x for i, x in enumerate(loads) if i in near])
        old = old.where(F.col(self.key).between(F.lit(lo), F.lit(hi))).select(self.key)
        return first.repartition(self.buckets, self.key).join(old, self.key, "left_anti")

    def insert_or_ignore(self, batch: DataFrame, load_id: str, order_by=None) -> int | None:
        """L4 on this table: add the batch's rows of new keys; None if the load is there already, else how many."""
        return self._add(load_id, lambda loads: self.new_rows(batch, loads, order_by))

    def compact(self, fold: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
        """Replace all loads by one of ``fold`` of their rows; their ids are remembered.  ``fold`` may group by the key."""
        base = self.version
        loads = self.loads(base)
        whole = self.write(fold(self._table(loads)), f"compact-{base}")
        self.commit(base, [*(Load(x.id, x.folder, 0, None, None) for x in loads), whole])

    def vacuum(self) -> list[str]:
        """Delete the folders that the last version does not need; not while a load or a reader of an older version runs."""
        wanted = {x.folder for x in self.loads() if x.rows}
        gone = [n for n in self._manifest.folders("load=") if n not in wanted]
        for n in gone:
            self._manifest.delete(n)
        return gone


def open_table(spark: SparkSession, path: str, table: str, buckets: int = 64) -> LoadedTable:
    """The customers, transactions or engagement table at ``path``."""
    return LoadedTable(spark, path, TABLE_SCHEMAS[table], PRIMARY_KEYS[table], buckets)
