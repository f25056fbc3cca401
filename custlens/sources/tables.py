"""Loading the three tables (L2, L3) and keyed idempotent load (L4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import CSV_OPTIONS, DATE_COLUMNS, PRIMARY_KEYS, PROFILE_CSV, TABLE_SCHEMAS


def _as_text_schema(schema: T.StructType, date_cols: list[str]) -> T.StructType:
    """Same schema with date columns read as text (parsed afterwards)."""
    return T.StructType([T.StructField(f.name, T.StringType(), f.nullable) if f.name in date_cols else f
                         for f in schema.fields])


def parse_dates(df: DataFrame, date_cols: list[str], fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Text dates -> DateType; unparseable or impossible dates become null
    (``try_to_date``) instead of failing the job."""
    out = df
    for c in date_cols:
        if isinstance(df.schema[c].dataType, T.StringType):
            out = out.withColumn(c, F.try_to_date(F.col(c), fmt))
    return out


def read_table(spark: SparkSession, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    """One table of Parquet, ORC, CSV or JSON files with its fixed schema (never inferred).

    Parquet/ORC carry types, so the schema is applied by projection and
    cast; CSV columns are found by their names in the header; JSON is read with the
    declared schema. Dates in text go through ``try_to_date``."""
    schema, dates = TABLE_SCHEMAS[table], DATE_COLUMNS[table]
    if fmt not in ("parquet", "orc", "csv", "json"):
        raise ValueError(f"no reader for {fmt}")
    if fmt == "csv":
        df = parse_dates(_csv_by_name(spark, path, _as_text_schema(schema, dates)), dates)
    elif fmt == "json":
        df = parse_dates(spark.read.schema(_as_text_schema(schema, dates)).json(path), dates)
    else:
        df = spark.read.format(fmt).load(path)
        df = parse_dates(df, [c for c in dates if c in df.columns])
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _csv_by_name(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV files with a header as ``schema``, by column name: order and further columns do not matter, a missing
    column is an error, text that is not of its column's type is null."""
    text = spark.read.options(**CSV_OPTIONS, enforceSchema="false").csv(path)
    missing = [f.name for f in schema.fields if f.name not in text.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return text.select(*(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields))


def load_tables(spark: SparkSession, path: str, fmt: str = "parquet",
                register_views: bool = True, unique: bool = True) -> dict[str, DataFrame]:
    """L2: ``{path}/customers``, ``/transactions``, ``/engagement`` as frames;
    optionally registered as temp views for ``spark.sql``.

    ``unique`` enforces the primary keys as L4 does (the first row per key stays), which the counts of
    distinct ids rely on; pass False for files that are known to be unique, it saves a shuffle."""
    tables = {name: read_table(spark, f"{path}/{name}", name, fmt) for name in TABLE_SCHEMAS}
    if unique:
        tables = {name: insert_or_ignore(None, df, table=name) for name, df in tables.items()}
    if register_views:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables


def read_profile_csv(spark: SparkSession, path: str) -> DataFrame:
    """L3: the exported 15-column profile CSV (with header), fixed schema."""
    return _csv_by_name(spark, path, PROFILE_CSV)


def insert_or_ignore(existing: DataFrame | None, incoming: DataFrame, key: str | None = None,
                     order_by: list[Column] | list[str] | None = None, table: str | None = None) -> DataFrame:
    """L4: ``INSERT OR IGNORE`` semantics for a batch.

    Within the batch the first row per key wins (smallest ``order_by``;
    default: the remaining columns, so the choice is deterministic); rows
    whose key already exists are dropped.  Returns the rows to append.

    The winner per key is a ``min_by`` aggregate, which combines map-side:
    even a key duplicated across a third of the batch leaves each task with
    one candidate row, never a whole group.  A left-anti join does the
    existence test; re-running the same batch yields nothing.
    """
    key = key or PRIMARY_KEYS[table]
    others = [c for c in incoming.columns if c != key]
    order = [F.col(c) if isinstance(c, str) else c for c in (order_by or others)]
    rank = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    first = (incoming.where(F.col(key).isNotNull())
             .groupBy(key).agg(F.min_by(F.struct(*others), rank).alias("__row"))
             .select(key, *[F.col(f"__row.{c}").alias(c) for c in others])
             .select(*incoming.columns))
    if existing is None:
        return first
    return first.join(existing.select(key), key, "left_anti")
