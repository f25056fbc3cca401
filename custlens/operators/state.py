"""Per-customer summaries kept up to date load by load.

The state is a table of partial summaries that can be merged: sums, counts and extremes, and the exact
distinct days as bit sets that can be united.  A load aggregates its own rows only and appends its partial rows
(``sources.loads``, bucketed by customer, committed once per load id).  Reading merges the partial rows of a
customer where they lie, without a shuffle, and gives the columns of ``tx_by_customer``/``eng_by_customer``;
``compact`` folds the loads when they are many.  The facts that were loaded before are never read again.

Days: one row per customer and ``DAYS`` consecutive days holds a bit per day, so ten years of daily visits are 58 rows.
(Spark's ``bitmap_construct_agg`` would be 4 KB for a customer with one visit.)

Loads must not repeat rows (``LoadedTable.insert_or_ignore`` sees to that), because counts and sums add up.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.loads import LoadedTable

_CID = "customer_id"
#: Days in a bit set.
DAYS = 64
_EPOCH = date(1970, 1, 1)

_SUM, _MIN, _MAX = "sum", "min", "max"
_LONG, _DOUBLE, _DATE = T.LongType(), T.DoubleType(), T.DateType()
#: How each column of a partial row merges, and its type.
TX_STATE = {
    "tx_rows": (_SUM, _LONG), "id_count": (_SUM, _LONG), "amount_count": (_SUM, _LONG), "amount_sum": (_SUM, _DOUBLE),
    "amount_min": (_MIN, _DOUBLE), "amount_max": (_MAX, _DOUBLE), "quantity_sum": (_SUM, _LONG),
    "dated_rows": (_SUM, _LONG), "first_date": (_MIN, _DATE), "last_date": (_MAX, _DATE)}
ENG_STATE = {
    "eng_rows": (_SUM, _LONG), "days": ("bit_or", _LONG), "page_views_sum": (_SUM, _LONG), "page_views_count": (_SUM, _LONG),
    "session_sum": (_SUM, _LONG), "session_count": (_SUM, _LONG), "cart_sum": (_SUM, _LONG), "purchase_rows": (_SUM, _LONG)}


def _schema(keys: dict, state: dict) -> T.StructType:
    return T.StructType([T.StructField(c, kind) for c, kind in [*keys.items(), *((c, kind) for c, (_, kind) in state.items())]])


TX_SCHEMA = _schema({_CID: _LONG}, TX_STATE)
ENG_SCHEMA = _schema({_CID: _LONG, "word": T.IntegerType()}, ENG_STATE)


def tx_partial(transactions: DataFrame) -> DataFrame:
    """One row per customer of these transactions."""
    return transactions.groupBy(_CID).agg(
        F.count(F.lit(1)).alias("tx_rows"), F.count("transaction_id").alias("id_count"),
        F.count("amount").alias("amount_count"), F.sum("amount").alias("amount_sum"),
        F.min("amount").alias("amount_min"), F.max("amount").alias("amount_max"), F.sum("quantity").alias("quantity_sum"),
        F.count("transaction_date").alias("dated_rows"), F.min("transaction_date").alias("first_date"), F.max("transaction_date").alias("last_date"))


def eng_partial(engagement: DataFrame) -> DataFrame:
    """One row per customer and ``DAYS`` days (null for rows without a date) of this engagement."""
    day = F.datediff("engagement_date", F.lit(_EPOCH))
    word = F.floor(day / DAYS).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(day, F.lit(DAYS)))
    return engagement.select("*", word.alias("word"), bit.alias("__bit")).groupBy(_CID, "word").agg(
        F.count(F.lit(1)).alias("eng_rows"), F.bit_or("__bit").alias("days"),
        F.sum("page_views").alias("page_views_sum"), F.count("page_views").alias("page_views_count"),
        F.sum("session_duration_minutes").alias("session_sum"), F.count("session_duration_minutes").alias("session_count"),
        F.sum("items_added_to_cart").alias("cart_sum"), F.count_if(F.col("items_purchased") > 0).alias("purchase_rows"))


def merged(partial: DataFrame, state: dict) -> DataFrame:
    """Partial rows of equal keys as one; merging again, or in any grouping, gives the same."""
    keys = [c for c in partial.columns if c not in state]
    return partial.groupBy(*keys).agg(*(getattr(F, how)(c).alias(c) for c, (how, _) in state.items()))


def tx_summary(partial: DataFrame) -> DataFrame:
    """The columns of ``tx_by_customer`` from partial rows."""
    return merged(partial, TX_STATE).select(
        _CID, "tx_rows", "id_count", F.col("id_count").alias("distinct_ids"), "amount_count", "amount_sum",
        (F.col("amount_sum") / F.nullif("amount_count", F.lit(0))).alias("amount_avg"), "amount_min", "amount_max",
        "quantity_sum", "dated_rows", "first_date", "last_date")


def eng_summary(partial: DataFrame) -> DataFrame:
    """The columns of ``eng_by_customer`` from partial rows."""
    each = merged(partial, ENG_STATE)

    def mean(of: str):
        return (F.sum(f"{of}_sum") / F.nullif(F.sum(f"{of}_count"), F.lit(0))).cast("double")

    return each.groupBy(_CID).agg(
        F.sum("eng_rows").alias("eng_rows"), F.coalesce(F.sum(F.bit_count("days")), F.lit(0)).cast("long").alias("eng_days"),
        F.sum("page_views_sum").alias("page_views_sum"), mean("page_views").alias("page_views_avg"),
        mean("session").alias("session_avg"), F.sum("cart_sum").alias("cart_sum"), F.sum("purchase_rows").alias("purchase_rows"))


class SummaryState:
    """Both summaries at ``path``; ``CustomerAnalytics(..., tx=state.tx(), eng=state.eng())`` answers from them."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self._tx = LoadedTable(spark, f"{path.rstrip('/')}/transactions", TX_SCHEMA, _CID, buckets)
        self._eng = LoadedTable(spark, f"{path.rstrip('/')}/engagement", ENG_SCHEMA, _CID, buckets)

    def add(self, load_id: str, transactions: DataFrame | None = None, engagement: DataFrame | None = None) -> None:
        """Take in one load's rows. Repeating a load, also one that died between its two tables, adds what is missing."""
        if transactions is not None:
            self._tx.append(tx_partial(transactions), load_id)
        if engagement is not None:
            self._eng.append(eng_partial(engagement), load_id)

    def tx(self) -> DataFrame:
        return tx_summary(self._tx.read())

    def eng(self) -> DataFrame:
        return eng_summary(self._eng.read())

    def compact(self) -> None:
        self._tx.compact(lambda rows: merged(rows, TX_STATE))
        self._eng.compact(lambda rows: merged(rows, ENG_STATE))

    def close(self) -> None:
        self._tx.close()
        self._eng.close()

    def __enter__(self) -> "SummaryState":
        return self

    def __exit__(self, *_) -> None:
        self.close()
