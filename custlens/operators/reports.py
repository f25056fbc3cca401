"""Reports over the profile.

Grouped reports are hash aggregates with partial (map-side) aggregation;
their outputs hold one row per group.  Values are rounded the pandas way
(half to even, ``bround``), as the reference rounds its grouped frames
with ``.round(2)``.  pandas' two-level column labels are flattened to
``<column>_<agg>``; groups are ordered by key, as pandas sorts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import pd_round

_CID = "customer_id"

# Summary labels and the rupee sign of the reference's summary sheets.
CURRENCY = "₹"
EXECUTIVE_METRICS = ["Total Customers", "Total Revenue", "Avg Customer Value",
                     "Avg Engagement Score", "Critical Risk Count"]
CUSTOM_METRICS = ["Total Customers", "Total Revenue", "Avg Customer Value", "Critical Risk"]


def _count():
    return F.count(_CID).alias("customer_id_count")


def _sum(c):
    return pd_round(F.sum(c), 2).alias(f"{c}_sum")


def _mean(c):
    return pd_round(F.avg(c), 2).alias(f"{c}_mean")


def segment_analysis(P: DataFrame) -> DataFrame:
    """By customer segment."""
    return (P.groupBy("customer_segment").agg(
        _count(), _sum("total_spent"), _mean("total_spent"),
        _mean("purchase_frequency"), _mean("engagement_score"))
        .orderBy("customer_segment"))


def churn_risk_report(P: DataFrame) -> DataFrame:
    """R2: by churn risk."""
    return (P.groupBy("churn_risk").agg(_count(), _mean("total_spent"), _mean("engagement_score"))
            .orderBy("churn_risk"))


def value_segment_report(P: DataFrame) -> DataFrame:
    """By value segment."""
    return (P.groupBy("value_segment").agg(
        _count(), _sum("total_spent"), _mean("total_spent"), _mean("purchase_frequency"))
        .orderBy("value_segment"))


def channel_report(P: DataFrame) -> DataFrame:
    """By acquisition channel."""
    return (P.groupBy("acquisition_channel").agg(
        _count(), _sum("total_spent"), _mean("total_spent"), _mean("engagement_score"))
        .orderBy("acquisition_channel"))


def generate_reports(P: DataFrame) -> dict[str, DataFrame]:
    """The four named reports of the batch job (lazy frames)."""
    return {"segment_analysis": segment_analysis(P), "churn_risk": churn_risk_report(P),
            "value_segment": value_segment_report(P), "channel": channel_report(P)}


def _money(c):
    """f"₹{x:,.0f}": thousands separators, half-even on the binary value."""
    return F.concat(F.lit(CURRENCY), F.format_number(c, 0))


def _long_table(row: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """One-row frame -> (Metric, Value) rows in the given order (``stack``)."""
    args = ", ".join(f"'{label}', `{col}`" for label, col in pairs)
    return row.selectExpr(f"stack({len(pairs)}, {args}) AS (Metric, Value)")


def executive_summary(P: DataFrame) -> DataFrame:
    """Five metrics as strings (the 'Executive Summary' sheet)."""
    row = P.agg(
        F.count(F.lit(1)).cast("string").alias("n"),
        _money(F.sum("total_spent")).alias("rev"),
        _money(F.avg("total_spent")).alias("avg"),
        F.format_number(F.avg("engagement_score"), 1).alias("eng"),
        F.count_if(F.col("churn_risk") == "Critical").cast("string").alias("crit"))
    return _long_table(row, list(zip(EXECUTIVE_METRICS, ["n", "rev", "avg", "eng", "crit"])))


def custom_summary(P: DataFrame) -> DataFrame:
    """Four metrics as strings (the tutorial's 'Summary' sheet)."""
    row = P.agg(
        F.count(F.lit(1)).cast("string").alias("n"),
        _money(F.sum("total_spent")).alias("rev"),
        _money(F.avg("total_spent")).alias("avg"),
        F.count_if(F.col("churn_risk") == "Critical").cast("string").alias("crit"))
    return _long_table(row, list(zip(CUSTOM_METRICS, ["n", "rev", "avg", "crit"])))


def top_by_spend(P: DataFrame, k: int = 20) -> DataFrame:
    """The k biggest spenders (ties by customer id, as ``nlargest`` keeps
    the first row of the id-ordered profile)."""
    return (P.orderBy(F.desc("total_spent"), _CID).limit(k)
            .select("customer_name", "customer_segment", "total_spent", "clv_estimate", "churn_risk"))


def at_risk(P: DataFrame) -> DataFrame:
    """Customers with High or Critical churn risk (profile order)."""
    return (P.where(F.col("churn_risk").isin("High", "Critical"))
            .orderBy(_CID)
            .select("customer_name", "total_spent", "days_since_last_purchase", "engagement_score"))


def segment_engagement(P: DataFrame) -> DataFrame:
    """The tutorial's segment sheet."""
    return (P.groupBy("customer_segment").agg(
        _count(), _sum("total_spent"), _mean("total_spent"), _mean("engagement_score"))
        .orderBy("customer_segment"))


def key_statistics(P: DataFrame) -> DataFrame:
    """The batch job's printed key statistics as one numeric row."""
    return P.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.sum("total_spent").alias("total_revenue"),
        F.avg("total_spent").alias("avg_customer_value"),
        pd_round(F.avg("purchase_frequency"), 2).alias("avg_purchase_frequency"),
        pd_round(F.avg("engagement_score"), 1).alias("avg_engagement_score"),
        F.count_if(F.col("churn_risk") == "Critical").alias("critical_risk_customers"),
        F.count_if(F.col("value_segment") == "Star Customer").alias("star_customers"))
