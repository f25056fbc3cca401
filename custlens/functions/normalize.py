"""Comparison normalisation of query outputs (used by the registry only).

Floating-point sums depend on summation order, which differs between
Spark tasks and any other engine; an exact value hash would then flag
last-bit differences.  ``sig`` rounds a double to 40 significant bits
(about 12 decimal digits): scale by an exact power of two, round half
away from zero, scale back — the SQL oracle repeats the same IEEE steps.
A binary grid is used because decimal money values (sums of cents,
averages over 2, 4, 8 ... amounts) sit exactly on decimal rounding ties,
never on binary ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


BITS = 40


def sig(c: Column) -> Column:
    scale = F.pow(F.lit(2.0), F.lit(BITS - 1) - F.floor(F.log2(F.abs(c))))
    return F.when(c.isNull() | (c == 0) | F.isnan(c), c).otherwise(F.round(c * scale) / scale)


def normalize(df: DataFrame) -> DataFrame:
    """Round every DOUBLE column to ``BITS`` significant bits, keep names and order."""
    cols = [sig(F.col(f.name)).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def double_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)]
