"""Loading text with evidence: values that do not parse become null, and are kept aside with column, value and reason.

``checked_load`` reads files once and writes once.  The written table is parted into rows without and with
problems, so the quarantine is the smaller part and the rows are both; the counts are observed in the same
pass and add up: rows read = loaded + rejected, problems = the sum over the columns = rows of the quarantine.

A row is rejected only when its key does not parse or is missing, since nothing could tell it from others; every other
problem costs its value alone, as the plain load does silently.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import CSV_OPTIONS, PRIMARY_KEYS, TABLE_SCHEMAS

NOT_A_DATE, NO_SUCH_DATE = "not a date", "no such date"
NOT_A_NUMBER, OUT_OF_RANGE, FRACTION = "not a number", "out of range", "not a whole number"
NO_KEY = "no key"

_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
_WHOLE = r"^\s*[+-]?\d+\s*$"


def _parsed(raw: Column, field: T.StructField) -> Column:
    if isinstance(field.dataType, T.DateType):
        return F.try_to_date(raw, "yyyy-MM-dd")
    if isinstance(field.dataType, T.IntegralType):  # a cast would cut fractions off
        return F.when(raw.rlike(_WHOLE), raw.try_cast(field.dataType))
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        x = raw.try_cast(field.dataType)
        return F.when(raw.rlike(_NUMBER) & (F.abs(x) < float("inf")), x)
    return raw.try_cast(field.dataType)


def _reason(raw: Column, field: T.StructField) -> Column:
    if isinstance(field.dataType, T.DateType):
        return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), NO_SUCH_DATE).otherwise(NOT_A_DATE)
    number = F.when(~raw.rlike(_NUMBER), NOT_A_NUMBER)
    if isinstance(field.dataType, T.IntegralType):
        number = number.when(~raw.rlike(_WHOLE), FRACTION)
    return number.otherwise(OUT_OF_RANGE)


def checked(text: DataFrame, table: str) -> DataFrame:
    """``text`` (columns of any type, taken as text) as the columns of ``table``, and ``__problems``: an array of (column, value, reason)."""
    schema, key = TABLE_SCHEMAS[table], PRIMARY_KEYS[table]
    typed, problems = [], []
    for f in schema.fields:
        raw = F.col(f"`{f.name}`").cast("string")
        value = _parsed(raw, f)
        typed.append(value.alias(f.name))
        bad = raw.isNotNull() & value.isNull()
        problems.append(F.when(bad, F.struct(F.lit(f.name).alias("column"), raw.alias("value"), _reason(raw, f).alias("reason"))))
        if f.name == key:
            problems.append(F.when(raw.isNull(), F.struct(F.lit(key).alias("column"), raw.alias("value"), F.lit(NO_KEY).alias("reason"))))
    others = [F.col(c) for c in text.columns if c.startswith("__")]
    return text.select(*typed, F.array_compact(F.array(*problems)).alias("__problems"), *others)


def quarantine_of(rows: DataFrame, table: str) -> DataFrame:
    """(key, column, value, reason) and what ``__`` columns there are, a row a problem."""
    key, more = PRIMARY_KEYS[table], [c for c in rows.columns if c.startswith("__") and c not in ("__problems", "__bad")]
    bad = rows.where(F.size("__problems") > 0).select(key, F.explode("__problems").alias("p"), *more)
    return bad.select(key, "p.*", *(F.col(c).alias(c[2:]) for c in more))


@dataclass(frozen=True)
class CheckedLoad:
    """What was read: counts, the rows to load and the quarantine (file, key, column, value, reason)."""

    table: str
    read: int
    rejected: int
    with_problems: int
    by_column: dict[str, int]
    stored: DataFrame

    @property
    def rows(self) -> DataFrame:
        schema = TABLE_SCHEMAS[self.table]
        return self.stored.where(F.col(PRIMARY_KEYS[self.table]).isNotNull()).select(*schema.fieldNames())

    @property
    def quarantine(self) -> DataFrame:
        return quarantine_of(self.stored.where("__bad"), self.table)


def checked_load(spark: SparkSession, path: str, table: str, out: str, fmt: str = "csv") -> CheckedLoad:
    """Files of one table at ``path`` (csv by column name, json) into a checked table at ``out``, which must be free."""
    schema = TABLE_SCHEMAS[table]
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    if fmt == "csv":
        text = spark.read.options(**CSV_OPTIONS, enforceSchema="false").csv(path)
    elif fmt == "json":
        text = spark.read.schema(as_text).json(path)
    else:
        raise ValueError(f"no text in {fmt}")
    missing = [f.name for f in schema.fields if f.name not in text.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    text = text.select(*(F.col(f"`{c}`") for c in as_text.fieldNames()), F.col("_metadata.file_path").alias("__file"))
    rows = checked(text, table).withColumn("__bad", F.size("__problems") > 0)
    seen = Observation()
    has = lambda c: F.exists("__problems", lambda p: p["column"] == c)
    rows = rows.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(F.col(PRIMARY_KEYS[table]).isNull()).alias("rejected"),
                        F.count_if("__bad").alias("with_problems"), *(F.count_if(has(f.name)).alias(f"in {f.name}") for f in schema.fields))
    rows.write.partitionBy("__bad").parquet(out)
    n = seen.get
    stored = spark.read.schema(rows.schema).parquet(out)
    return CheckedLoad(table, n["read"], n["rejected"], n["with_problems"], {f.name: n[f"in {f.name}"] for f in schema.fields if n[f"in {f.name}"]}, stored)
