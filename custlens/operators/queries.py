"""The SQL query catalogue (S01-S25) as DataFrame operators.

``C``, ``T``, ``E`` are the customers, transactions and engagement
frames.  Customer-level queries aggregate the fact table by
``customer_id`` first and join the result 1:1 with customers (the
reference groups a customers ⟕ facts join by ``c.customer_id``).
Scalar subqueries of the reference stay scalar subqueries
(``DataFrame.scalar()``): Spark runs them once and inlines the value,
with no join at all.  ``as_of`` replaces ``julianday('now')``.

Sort orders follow the reference, with ``customer_id`` (or the group
key) appended so ties and limits are deterministic.

Customer-level operators accept ``tx`` / ``eng``: the per-customer
summaries of ``operators.summaries``, computed once and shared (see
``custlens.analytics.CustomerAnalytics``); by default each call
aggregates the fact table itself.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import (
    first_match, fractional_days_since, money_round, month, month_start, safe_div, sql_days_since, sql_round,
    within_last_days,
)
from .summaries import eng_by_customer, tx_by_customer

_CID = "customer_id"


def _tx(T: DataFrame, tx: DataFrame | None) -> DataFrame:
    """Per-customer transaction summary: the precomputed one if given."""
    return tx if tx is not None else tx_by_customer(T)


def _eng(E: DataFrame, eng: DataFrame | None) -> DataFrame:
    return eng if eng is not None else eng_by_customer(E)


def _customers_with_tx(C: DataFrame, T: DataFrame, how: str = "left", tx: DataFrame | None = None) -> DataFrame:
    """customers ⟕ transaction summary.  ``C`` may already be the pre-joined
    frame (``CustomerAnalytics.wide``); then no join is planned at all."""
    if "tx_rows" in C.columns:
        return C.where(F.col("tx_rows").isNotNull()) if how == "inner" else C
    return C.join(_tx(T, tx), _CID, how)


def _customers_with_eng(C: DataFrame, E: DataFrame, how: str = "left", eng: DataFrame | None = None) -> DataFrame:
    """customers ⟕ engagement summary (or the pre-joined frame as is)."""
    if "eng_rows" in C.columns:
        return C.where(F.col("eng_rows").isNotNull()) if how == "inner" else C
    return C.join(_eng(E, eng), _CID, how)


# ---------------------------------------------------------------- 1. customers

def customer_list(C: DataFrame) -> DataFrame:
    """Customers with segment and channel, by name."""
    return (C.select(_CID, "customer_name", "email", "customer_segment", "acquisition_channel")
            .orderBy("customer_name", _CID))


def customers_by_country(C: DataFrame) -> DataFrame:
    """Customers per country, count desc."""
    return (C.groupBy("country").agg(F.count(F.lit(1)).alias("customer_count"))
            .orderBy(F.desc("customer_count"), "country"))


def customers_by_channel(C: DataFrame) -> DataFrame:
    """Customers per channel with their percentage of all customers."""
    total = C.select(F.count(F.lit(1))).scalar()
    return (C.groupBy("acquisition_channel").agg(F.count(F.lit(1)).alias("count"))
            .withColumn("percentage", sql_round(safe_div(F.lit(100.0) * F.col("count"), total), 2))
            .orderBy(F.desc("count"), "acquisition_channel"))


# ------------------------------------------------------------- 2. transactions

def customer_transactions(C: DataFrame, T: DataFrame, tx: DataFrame | None = None) -> DataFrame:
    """Per customer count/sum/avg/min/max of amount; customers without any kept."""
    j = _customers_with_tx(C, T, tx=tx)
    return (j.select(
        _CID, "customer_name", "customer_segment",
        F.coalesce("id_count", F.lit(0)).alias("transaction_count"),
        F.col("amount_sum").alias("total_spent"),
        F.col("amount_avg").alias("avg_transaction"),
        F.col("amount_min").alias("min_transaction"),
        F.col("amount_max").alias("max_transaction"))
        .orderBy(F.desc("total_spent"), _CID))


def revenue_by_category(T: DataFrame) -> DataFrame:
    """Per product category count, revenue, avg, units."""
    return (T.groupBy("product_category").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("amount").alias("total_revenue"),
        F.avg("amount").alias("avg_transaction"),
        F.sum("quantity").alias("total_units"))
        .orderBy(F.desc("total_revenue"), "product_category"))


def revenue_by_payment_method(T: DataFrame) -> DataFrame:
    """Per payment method count, revenue, avg."""
    return (T.groupBy("payment_method").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum("amount").alias("revenue"),
        F.avg("amount").alias("avg_amount"))
        .orderBy(F.desc("revenue"), "payment_method"))


def monthly_revenue(T: DataFrame) -> DataFrame:
    """Monthly count, revenue, avg; newest first (null month kept as a group)."""
    return (T.groupBy(month_start("transaction_date").alias("m")).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("amount").alias("monthly_revenue"),
        F.avg("amount").alias("avg_transaction"))
        .select(month("m").alias("month"), "transaction_count", "monthly_revenue", "avg_transaction")
        .orderBy(F.desc("month")))


# --------------------------------------------------------------- 3. engagement

def customer_engagement(C: DataFrame, E: DataFrame, eng: DataFrame | None = None) -> DataFrame:
    """Per customer engagement; customers without engagement get 0 days / 0 purchases."""
    j = _customers_with_eng(C, E, "left", eng)
    return (j.select(
        _CID, "customer_name",
        F.coalesce("eng_days", F.lit(0)).alias("engagement_days"),
        F.col("page_views_sum").alias("total_page_views"),
        F.col("page_views_avg").alias("avg_page_views"),
        F.col("session_avg").alias("avg_session_duration"),
        F.col("cart_sum").alias("total_cart_adds"),
        F.coalesce("purchase_rows", F.lit(0)).alias("days_with_purchase"))
        .orderBy(F.desc("engagement_days"), _CID))


def device_usage(E: DataFrame) -> DataFrame:
    """Per device distinct customers, sessions, avg views, avg minutes."""
    return (E.groupBy("device_type").agg(
        F.count_distinct(_CID).alias("unique_customers"),
        F.count(F.lit(1)).alias("total_sessions"),
        F.avg("page_views").alias("avg_page_views"),
        F.avg("session_duration_minutes").alias("avg_session_duration"))
        .orderBy(F.desc("total_sessions"), "device_type"))


def customer_conversion(C: DataFrame, E: DataFrame, eng: DataFrame | None = None) -> DataFrame:
    """Purchase records per distinct engagement day (HAVING days > 0 -> inner join)."""
    engaged = _customers_with_eng(C, E, "inner", eng).where(F.col("eng_days") > 0)
    return (engaged.select(
        _CID, "customer_name",
        F.col("eng_days").alias("engagement_days"),
        F.col("purchase_rows").alias("conversion_days"),
        sql_round(safe_div(F.lit(100.0) * F.col("purchase_rows"), "eng_days"), 2).alias("conversion_rate"))
        .orderBy(F.desc("conversion_rate"), _CID))


# ---------------------------------------------------------------------- 4. RFM

def rfm_rules(C: DataFrame, T: DataFrame, as_of: datetime, tx: DataFrame | None = None) -> DataFrame:
    """Recency / frequency / monetary with the VIP-Gold-Silver-Bronze rule."""
    j = _customers_with_tx(C, T, tx=tx)
    freq = F.coalesce("distinct_ids", F.lit(0))
    money = F.col("amount_sum")
    seg = first_match([
        ((freq > 5) & (money > 50000), "VIP"),
        ((freq > 3) & (money > 25000), "Gold"),
        (freq > 1, "Silver"),
    ], "Bronze")
    return (j.select(
        _CID, "customer_name", "customer_segment",
        sql_days_since(as_of, "last_date").alias("recency_days"),
        freq.alias("frequency"),
        money.alias("monetary_value"),
        seg.alias("rfm_segment"))
        .orderBy(F.desc("monetary_value"), _CID))


def churn_by_inactivity(C: DataFrame, T: DataFrame, as_of: datetime, tx: DataFrame | None = None) -> DataFrame:
    """>180 days Critical, >90 High, >30 Medium, else (and never bought) Low."""
    j = _customers_with_tx(C, T, tx=tx)
    frac = fractional_days_since(as_of, "last_date")
    risk = first_match([(frac > 180, "Critical"), (frac > 90, "High"), (frac > 30, "Medium")], "Low")
    return (j.select(
        _CID, "customer_name", "customer_segment",
        sql_days_since(as_of, "last_date").alias("days_since_purchase"),
        F.coalesce("distinct_ids", F.lit(0)).alias("lifetime_purchases"),
        F.col("amount_sum").alias("lifetime_value"),
        risk.alias("churn_risk"))
        .orderBy(F.desc("days_since_purchase"), _CID))


# ---------------------------------------------------------------------- 5. CLV

def clv_three_year(C: DataFrame, T: DataFrame, as_of: datetime, tx: DataFrame | None = None) -> DataFrame:
    """Avg * (n / max(tenure months, 1)) * 12 * 3, rounded to 2."""
    j = _customers_with_tx(C, T, tx=tx)
    n = F.coalesce("distinct_ids", F.lit(0))
    avg = F.col("amount_avg")
    months = fractional_days_since(as_of, "signup_date") / 30.0
    # SQLite's multi-argument max is null when an argument is null.
    months_floor = F.when(months.isNull(), F.lit(None)).otherwise(F.greatest(months, F.lit(1.0)))
    clv = avg * (n / months_floor) * 12 * 3
    return (j.select(
        _CID, "customer_name", "customer_segment",
        n.alias("total_transactions"),
        F.col("amount_sum").alias("total_spent"),
        money_round("amount_avg").alias("avg_transaction_value"),
        sql_round(clv, 2).alias("clv_estimate_3year"))
        .orderBy(F.desc("clv_estimate_3year"), _CID))


# ------------------------------------------------------------------- 6. cohort

def cohort_retention(C: DataFrame, T: DataFrame, tx: DataFrame | None = None) -> DataFrame:
    """By signup month: customers, purchase rows, rate %, revenue.

    ``customers_with_purchase`` counts joined transaction rows with a date,
    as the reference does, so the rate may exceed 100.
    """
    j = _customers_with_tx(C, T, tx=tx)
    acquired = F.count(_CID)
    bought = F.sum(F.coalesce("dated_rows", F.lit(0)))
    return (j.groupBy(month_start("signup_date").alias("m")).agg(
        acquired.alias("customers_acquired"),
        bought.alias("customers_with_purchase"),
        sql_round(safe_div(F.lit(100.0) * bought, acquired), 2).alias("retention_rate"),
        F.sum(F.coalesce("amount_sum", F.lit(0.0))).alias("cohort_revenue"))
        .select(month("m").alias("signup_month"), "customers_acquired", "customers_with_purchase", "retention_rate",
                "cohort_revenue")
        .orderBy(F.desc("signup_month")))


# ---------------------------------------------------------- 7. segment/channel

def segment_performance(C: DataFrame, T: DataFrame, E: DataFrame, tx: DataFrame | None = None,
                        eng: DataFrame | None = None) -> DataFrame:
    """Per segment over customers ⟕ transactions ⟕ engagement.

    The reference joins both fact tables before grouping, so each
    transaction row appears once per engagement row of its customer.
    Revenue and the average are therefore weighted by max(E_c, 1); they
    are computed from per-customer pre-aggregates instead of the T·E join.
    Distinct engagement dates are per segment, a null segment included: they come
    from each customer's set of dates (a calendar's worth at most).
    """
    w = F.greatest(F.coalesce("eng_rows", F.lit(0)), F.lit(1))
    if "tx_rows" in C.columns and "eng_rows" in C.columns:
        j = C.select(_CID, "customer_segment", "tx_rows", "distinct_ids", "amount_sum", "amount_count", "eng_rows")
        days = E.select(_CID, "engagement_date").distinct()
        dates = days.join(j.select(_CID, "customer_segment"), _CID)
    else:
        # engagement is read once: rows per (customer, date) give both the weights and the dates
        daily = E.groupBy(_CID, "engagement_date").agg(F.count(F.lit(1)).alias("n"))
        per = daily.groupBy(_CID).agg(F.sum("n").alias("eng_rows"), F.collect_set("engagement_date").alias("dates"))
        j = (C.select(_CID, "customer_segment").join(_tx(T, tx), _CID, "left").join(per, _CID, "left"))
        dates = j.select("customer_segment", F.explode("dates").alias("engagement_date"))
    revenue = F.sum(F.col("amount_sum") * w)
    customers = F.count(_CID)
    seg = j.groupBy("customer_segment").agg(
        customers.alias("customer_count"),
        F.sum(F.coalesce("distinct_ids", F.lit(0))).alias("total_transactions"),
        revenue.alias("segment_revenue"),
        money_round(safe_div(revenue, F.sum(F.col("amount_count") * w))).alias("avg_transaction"),
        money_round(safe_div(revenue, customers)).alias("revenue_per_customer"))
    days = dates.groupBy(F.col("customer_segment").alias("__s")).agg(
        F.count_distinct("engagement_date").alias("total_engagement_days"))
    return (seg.join(days, seg["customer_segment"].eqNullSafe(days["__s"]), "left")
            .select("customer_segment", "customer_count", "total_transactions", "segment_revenue",
                    "avg_transaction", "revenue_per_customer",
                    F.coalesce("total_engagement_days", F.lit(0)).alias("total_engagement_days"))
            .orderBy(F.desc("segment_revenue"), "customer_segment"))


def channel_effectiveness(C: DataFrame, T: DataFrame, tx: DataFrame | None = None) -> DataFrame:
    """Per channel customers, transactions, revenue, per customer, % who bought."""
    j = _customers_with_tx(C, T, tx=tx)
    customers = F.count(_CID)
    revenue = F.sum("amount_sum")
    return (j.groupBy("acquisition_channel").agg(
        customers.alias("customers"),
        F.sum(F.coalesce("distinct_ids", F.lit(0))).alias("transactions"),
        revenue.alias("revenue"),
        money_round(safe_div(revenue, customers)).alias("revenue_per_customer"),
        sql_round(safe_div(F.lit(100.0) * F.count_if(F.col("id_count") > 0), customers), 2)
        .alias("conversion_rate"))
        .orderBy(F.desc("revenue"), "acquisition_channel"))


# ------------------------------------------------------------ 8. top customers

def top_customers(C: DataFrame, T: DataFrame, k: int = 20, tx: DataFrame | None = None) -> DataFrame:
    """Top k customers by revenue (inner join: buyers only).

    ``orderBy(..).limit(k)`` plans as TakeOrderedAndProject: each task keeps
    its own top k, only k rows per task reach the final merge.
    """
    j = _customers_with_tx(C, T, "inner", tx=tx)
    return (j.select(
        _CID, "customer_name", "country", "customer_segment",
        F.col("distinct_ids").alias("purchases"),
        F.col("amount_sum").alias("total_spent"),
        F.col("amount_avg").alias("avg_purchase"),
        F.col("first_date").alias("first_purchase"),
        F.col("last_date").alias("last_purchase"))
        .orderBy(F.desc("total_spent"), _CID).limit(k))


def top_products(T: DataFrame) -> DataFrame:
    """Product ranking by revenue."""
    return (T.groupBy("product_category").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("quantity").alias("total_units_sold"),
        F.sum("amount").alias("total_revenue"),
        money_round(F.avg("amount")).alias("avg_transaction"))
        .orderBy(F.desc("total_revenue"), "product_category"))


# ------------------------------------------------------------ 9. value / KPIs

def value_comparison(C: DataFrame, T: DataFrame, tx: DataFrame | None = None) -> DataFrame:
    """One row per customer: above or below the mean customer total.

    The mean is over per-customer_id sums of *all* transactions (the
    reference's subquery groups the raw table, orphans included).  The
    reference's window partitions hold one customer each, so its
    ``AVG(COUNT(..)) OVER`` is the customer's own count.
    """
    tx = _tx(T, tx)
    mean_total = tx.select(F.avg("amount_sum")).scalar()
    j = _customers_with_tx(C, T, "left", tx)
    category = F.when(mean_total >= F.col("amount_sum"), "Below Average").otherwise("Above Average")
    return j.select(
        category.alias("value_category"),
        F.lit(1).cast("long").alias("customer_count"),
        sql_round(F.coalesce("distinct_ids", F.lit(0)).cast("double"), 2).alias("avg_purchases"),
        money_round("amount_sum").alias("avg_customer_value"))


def recently_active(C: DataFrame, T: DataFrame, as_of: datetime, days: int = 30,
                    exact_distinct: bool = False) -> DataFrame:
    """Customers with a transaction in the last ``days`` days."""
    recent = T.where(within_last_days(as_of, "transaction_date", days))
    return (C.join(tx_by_customer(recent, exact_distinct), _CID, "inner").select(
        _CID, "customer_name", "customer_segment",
        F.col("distinct_ids").alias("recent_transactions"),
        F.col("amount_sum").alias("recent_spending"),
        F.col("last_date").alias("last_transaction_date"))
        .orderBy(F.desc("recent_spending"), _CID))


def business_kpis(C: DataFrame, T: DataFrame, as_of: datetime, days: int = 30,
                  tx: DataFrame | None = None) -> DataFrame:
    """One KPI row; all-time figures are scalar subqueries, the rest over the window."""
    total_customers = C.select(F.count(_CID)).scalar()
    buyers = _tx(T, tx).select(F.count(_CID)).scalar()
    recent = tx_by_customer(T.where(within_last_days(as_of, "transaction_date", days)))
    active = F.count(_CID)
    revenue = F.sum("amount_sum")
    return recent.agg(
        active.alias("active_customers"),
        F.coalesce(F.sum("tx_rows"), F.lit(0)).alias("total_transactions"),
        revenue.alias("total_revenue"),
        money_round(safe_div(revenue, F.sum("amount_count"))).alias("avg_transaction_value"),
        money_round(safe_div(revenue, active)).alias("revenue_per_customer"),
    ).select(
        total_customers.alias("total_customers"), buyers.alias("customers_with_purchases"),
        "active_customers", "total_transactions", "total_revenue",
        "avg_transaction_value", "revenue_per_customer")


def customer_growth(C: DataFrame) -> DataFrame:
    """New customers per signup month with running total.

    The window has no partition key, but its input is one row per month,
    so the single partition holds a calendar's worth of rows.
    """
    monthly = C.groupBy(month_start("signup_date").alias("m")).agg(F.count(F.lit(1)).alias("new_customers"))
    monthly = monthly.select(month("m").alias("month"), "new_customers")
    running = Window.orderBy("month").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (monthly.withColumn("cumulative_customers", F.sum("new_customers").over(running))
            .orderBy("month"))


def purchase_frequency_by_category(T: DataFrame) -> DataFrame:
    """Purchases, distinct customers and purchases per customer by category."""
    n = F.count(F.lit(1))
    buyers = F.count_distinct(_CID)
    return (T.groupBy("product_category").agg(
        n.alias("total_purchases"),
        buyers.alias("unique_customers"),
        sql_round(safe_div(n.cast("double"), buyers), 2).alias("purchases_per_customer"))
        .orderBy(F.desc("total_purchases"), "product_category"))


# ------------------------------------------------------------------ tutorial

def avg_spend_by_segment(C: DataFrame, T: DataFrame, tx: DataFrame | None = None) -> DataFrame:
    """Mean of customer totals per segment (customers without purchases skipped by avg)."""
    j = _customers_with_tx(C, T, "left", tx)
    return (j.groupBy("customer_segment").agg(
        F.count(F.lit(1)).alias("customer_count"),
        money_round(F.avg("amount_sum")).alias("avg_spending"))
        .orderBy(F.desc("avg_spending"), "customer_segment"))


def inactive_customers(C: DataFrame, T: DataFrame, as_of: datetime, days: int = 180,
                       k: int | None = 10, tx: DataFrame | None = None) -> DataFrame:
    """Customers inactive for more than ``days`` whole days (never-buyers excluded).

    The reference takes the first 10 rows without an order; here the
    first ``k`` by inactivity (desc) then id.  ``k=None`` returns all.
    """
    j = _customers_with_tx(C, T, tx=tx)
    inactive = sql_days_since(as_of, "last_date")
    out = (j.select(_CID, "customer_name", inactive.alias("days_inactive"))
           .where(F.col("days_inactive") > days)
           .orderBy(F.desc("days_inactive"), _CID))
    return out.limit(k) if k is not None else out
