"""Plan inspection helpers, and the check of a small table's size before it is broadcast."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def physical_plan(df: DataFrame) -> str:
    """The executed-plan text (formatted explain) without running the query."""
    return df._jdf.queryExecution().executedPlan().toString()


def explain_text(df: DataFrame, mode: str = "formatted") -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def count_nodes(df: DataFrame, pattern: str) -> int:
    return len(re.findall(pattern, explain_text(df, "simple")))


def has_python_udf(df: DataFrame) -> bool:
    text = explain_text(df, "simple")
    return any(k in text for k in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                                    "MapInPandas", "PythonUDF"))


def single_partition_exchanges(df: DataFrame) -> int:
    return count_nodes(df, r"Exchange SinglePartition")


def bounded(df: DataFrame, most: int) -> DataFrame:
    """``df``, failing when it has more than ``most`` rows (counted when it is evaluated)."""
    rows = F.count(F.lit(1)).over(Window.partitionBy())
    ok = F.assert_true(rows <= most, F.lit(f"more than {most} rows in a table that is to be broadcast"))
    return df.withColumn("__rows", ok).where(F.col("__rows").isNull()).drop("__rows")
