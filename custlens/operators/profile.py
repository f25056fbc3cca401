"""The customer profile: one row per customer.

``extract_profile`` (P01) answers the reference's wide query

    customers ⟕ transactions ⟕ engagement  GROUP BY customer

without building that join.  For a customer with T transaction rows and
E engagement rows the join holds max(T,1)·max(E,1) rows, so

* sums over transactions are multiplied by max(E,1),
* sums / counts over engagement are multiplied by max(T,1),
* AVG, MAX and COUNT(DISTINCT) are unchanged.

Both fact tables are aggregated by customer first and joined 1:1, which
gives the same numbers with shuffles proportional to the inputs instead
of Σ T·E.  ``fanout=False`` yields the deduplicated (per-table) values.
Money is summed in double precision, as given.

``process_metrics`` (P02-P14) is one projection over that frame plus
one struct-valued scalar subquery (the two global means used by
``value_segment``).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import (
    at_least_one, clip, first_match, whole_days_since, with_scalar,
)
from .summaries import eng_by_customer, tx_by_customer

_CID = "customer_id"

# Churn and value-segment labels of the reference.
CHURN_LEVELS = ["Low", "Medium", "High", "Critical"]
VALUE_SEGMENTS = ["Star Customer", "Big Spender", "Frequent Buyer", "Development"]
NO_PURCHASE_DAYS = 999

PROFILE_DIMENSIONS = ["customer_id", "customer_name", "signup_date", "country",
                      "customer_segment", "acquisition_channel"]
EXTRACTED_MEASURES = ["total_transactions", "total_spent", "avg_transaction_value", "total_items",
                      "last_purchase_date", "engagement_days", "avg_page_views", "total_cart_adds",
                      "days_with_purchase"]


def extract_profile(C: DataFrame, T: DataFrame, E: DataFrame, fanout: bool = True,
                    exact_distinct: bool = False, tx: DataFrame | None = None,
                    eng: DataFrame | None = None) -> DataFrame:
    """The 15 extracted columns, one row per customer (``tx``/``eng``:
    precomputed per-customer summaries, else aggregated here)."""
    if "tx_rows" in C.columns and "eng_rows" in C.columns:
        j = C  # pre-joined customers ⟕ summaries (CustomerAnalytics.wide)
    else:
        tx = tx if tx is not None else tx_by_customer(T, exact_distinct)
        eng = eng if eng is not None else eng_by_customer(E)
        j = C.select(*PROFILE_DIMENSIONS).join(tx, _CID, "left").join(eng, _CID, "left")
    if fanout:
        w_e = F.greatest(F.coalesce("eng_rows", F.lit(0)), F.lit(1))
        w_t = F.greatest(F.coalesce("tx_rows", F.lit(0)), F.lit(1))
    else:
        w_e = w_t = F.lit(1)
    return j.select(
        *PROFILE_DIMENSIONS,
        F.coalesce("distinct_ids", F.lit(0)).alias("total_transactions"),
        (F.col("amount_sum") * w_e).alias("total_spent"),
        F.col("amount_avg").alias("avg_transaction_value"),
        (F.col("quantity_sum") * w_e).alias("total_items"),
        F.col("last_date").alias("last_purchase_date"),
        F.coalesce("eng_days", F.lit(0)).alias("engagement_days"),
        F.col("page_views_avg").alias("avg_page_views"),
        (F.col("cart_sum") * w_t).alias("total_cart_adds"),
        (F.coalesce("purchase_rows", F.lit(0)) * w_t).alias("days_with_purchase"),
    )


def _fill(df: DataFrame) -> DataFrame:
    """Missing measures -> 0, missing text dimensions -> 'Unknown';
    dates stay dates (unparseable text was already null at load)."""
    numeric = ["total_spent", "avg_transaction_value", "total_items", "avg_page_views",
               "total_cart_adds", "total_transactions", "engagement_days", "days_with_purchase"]
    text = ["customer_name", "country", "customer_segment", "acquisition_channel"]
    return df.na.fill(0, subset=numeric).na.fill("Unknown", subset=text)


def churn_risk(days_col, freq_col):
    """First matching rule; 'Unknown' only if days is null."""
    d, f = F.col(days_col), F.col(freq_col)
    return first_match([
        ((d < 30) & (f > 2), "Low"),
        ((d < 90) & (f > 1), "Medium"),
        (d < 180, "High"),
        (d >= 180, "Critical"),
    ], "Unknown")


def process_metrics(profile: DataFrame, as_of: datetime) -> DataFrame:
    """P02-P14 over the extracted profile."""
    p = _fill(profile)
    tenure = F.col("days_since_signup") / 30.0
    m = p.select(
        "*",
        whole_days_since(as_of, "signup_date").alias("days_since_signup"),
        F.coalesce(whole_days_since(as_of, "last_purchase_date"), F.lit(NO_PURCHASE_DAYS))
        .alias("days_since_last_purchase"),
    ).select(
        "*",
        tenure.alias("tenure_months"),
        (F.col("total_transactions") / at_least_one(tenure)).alias("purchase_frequency"),
        (F.col("total_spent") / F.greatest("total_transactions", F.lit(1))).alias("avg_order_value"),
        F.coalesce(F.col("days_with_purchase") / F.greatest("engagement_days", F.lit(1)) * 100,
                   F.lit(0.0)).alias("conversion_rate"),
    ).select(
        "*",
        clip(F.col("avg_page_views") / 50 * (F.col("conversion_rate") / 100) * 100, 0.0, 100.0)
        .alias("engagement_score"),
        (F.col("avg_order_value") * F.col("purchase_frequency") * 12 * 3).alias("clv_estimate"),
        churn_risk("days_since_last_purchase", "purchase_frequency").alias("churn_risk"),
    )
    # Both global means from one scalar subquery (run once, inlined as literals).
    means = m.agg(F.avg("total_spent").alias("s"), F.avg("purchase_frequency").alias("f"))
    spent_hi = F.col("total_spent") > F.col("__means.s")
    freq_hi = F.col("purchase_frequency") > F.col("__means.f")
    value = first_match([
        (spent_hi & freq_hi, "Star Customer"),
        (spent_hi, "Big Spender"),
        (freq_hi, "Frequent Buyer"),
    ], "Development")
    return with_scalar(m, means, "__means").withColumn("value_segment", value).drop("__means")


def build_profile(C: DataFrame, T: DataFrame, E: DataFrame, as_of: datetime,
                  fanout: bool = True, tx: DataFrame | None = None, eng: DataFrame | None = None,
                  exact_distinct: bool = False) -> DataFrame:
    """P12 over P01: the full profile, as one lazy plan.

    A question that reads a few of its columns prunes the rest: without a measure of a fact
    table that table is not read at all.  Callers with many questions keep the
    profile themselves (``CustomerAnalytics``).
    """
    return process_metrics(extract_profile(C, T, E, fanout, exact_distinct, tx, eng), as_of)
