"""Per-customer summaries: the shared building blocks.

Almost every customer-level question is ``customers ⟕ summary``.  The
fact tables are aggregated *by key first* (partial aggregation on the
map side, so even a customer holding a third of all rows contributes at
most one row per map partition to the shuffle) and only then joined
1:1 with customers.  This also replaces the reference's
customers × transactions × engagement join, whose row count grows with
T·E per customer, by exact multipliers (see ``profile.extract_profile``).

``transaction_id`` is the declared primary key of transactions, so the
count of distinct ids equals the count of non-null ids; relying on the
key avoids a shuffle of every (customer, id) pair.  Pass
``exact_distinct=True`` for inputs whose key was not enforced
(``sources.tables.insert_or_ignore`` enforces it at load).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tx_by_customer(transactions: DataFrame, exact_distinct: bool = False) -> DataFrame:
    """One row per customer_id (including a null-key group, as SQL GROUP BY does).

    tx_rows         rows (join fan-out weight)
    id_count        non-null transaction ids (COUNT(t.transaction_id))
    distinct_ids    COUNT(DISTINCT t.transaction_id)
    amount_count    non-null amounts (AVG weight)
    amount_sum, amount_avg
    amount_min/max, quantity_sum
    dated_rows      non-null transaction dates
    first_date, last_date
    """
    ids = F.count("transaction_id")
    distinct = F.count_distinct("transaction_id") if exact_distinct else ids
    return transactions.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("tx_rows"),
        ids.alias("id_count"),
        distinct.alias("distinct_ids"),
        F.count("amount").alias("amount_count"),
        F.sum("amount").alias("amount_sum"),
        F.avg("amount").alias("amount_avg"),
        F.min("amount").alias("amount_min"),
        F.max("amount").alias("amount_max"),
        F.sum("quantity").alias("quantity_sum"),
        F.count("transaction_date").alias("dated_rows"),
        F.min("transaction_date").alias("first_date"),
        F.max("transaction_date").alias("last_date"),
    )


def eng_by_customer(engagement: DataFrame) -> DataFrame:
    """One row per customer_id of engagement.

    eng_rows        rows (join fan-out weight)
    eng_days        COUNT(DISTINCT engagement_date)
    page_views_sum/avg, session_avg, cart_sum
    purchase_rows   rows with items_purchased > 0

    The single distinct aggregate is planned by Spark as a two-level
    aggregation keyed first on (customer_id, engagement_date), so a hot
    customer is spread over its dates before the final per-customer merge.
    """
    return engagement.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("eng_rows"),
        F.count_distinct("engagement_date").alias("eng_days"),
        F.sum("page_views").alias("page_views_sum"),
        F.avg("page_views").alias("page_views_avg"),
        F.avg("session_duration_minutes").alias("session_avg"),
        F.sum("items_added_to_cart").alias("cart_sum"),
        F.count_if(F.col("items_purchased") > 0).alias("purchase_rows"),
    )
