"""Distinct counts and quantiles from mergeable sketches, as a named option beside the exact operators.

A sketch state is a small table: one row per key (a segment, a day, a month ...) with a few binary columns.  It is
built from a load's rows only, states of several loads are united row by row, and any coarser question is answered by merging
rows, without the facts.  All functions are Spark's own aggregates.

* distinct counts: HLL (``union`` only; error about 1.04 / sqrt(2^log2_k)) and theta sketches (also intersections and differences;
  exact up to 2^log2_k distinct values, beyond that an error of about 1 / sqrt(2^log2_k) of the union),
* quantiles: KLL; rank error about 1.3 % at k = 200 and 0.17 % at k = 2048, whatever the order of merging.

The exact paths stay the default everywhere: ``operators.queries`` for counts, ``functions.selection`` for quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import month_start, safe_div

#: Twice the logarithm of entries in HLL and theta sketches, and k of quantile sketches.
LOG2_HLL, LOG2_THETA, KLL_K = 14, 16, 2048


# ---------------------------------------------------------------- distinct counts

def distinct_state(df: DataFrame, of: str, by: dict[str, Column], log2_hll: int = LOG2_HLL, log2_theta: int = LOG2_THETA) -> DataFrame:
    """One row per ``by`` with the sketches of the distinct non-null ``of``: (by..., rows, hll, theta)."""
    seen = df.where(F.col(of).isNotNull())
    return seen.groupBy(*(c.alias(n) for n, c in by.items())).agg(
        F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(of, log2_hll).alias("hll"), F.theta_sketch_agg(of, log2_theta).alias("theta"))


def united_distinct(state: DataFrame, by: Sequence[str] = (), log2_theta: int = LOG2_THETA) -> DataFrame:
    """A state of coarser keys (or of several loads' states under one another)."""
    return state.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta", log2_theta).alias("theta"))


def distinct_counts(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., rows, distinct_hll, distinct_theta)."""
    return united_distinct(state, by).select(*by, "rows", F.hll_sketch_estimate("hll").alias("distinct_hll"),
                                             F.theta_sketch_estimate("theta").alias("distinct_theta"))


def device_users(E: DataFrame) -> DataFrame:
    """S09 by sketches: state per device and month; ``distinct_counts(state, ["device_type"])`` gives users per device."""
    return distinct_state(E, "customer_id", {"device_type": F.col("device_type"), "month": month_start("engagement_date")})


def category_buyers(T: DataFrame) -> DataFrame:
    """S23 by sketches: state per category and month of purchase."""
    return distinct_state(T, "customer_id", {"product_category": F.col("product_category"), "month": month_start("transaction_date")})


_KEPT = ["product_category", "month", "buyers", "kept_buyers", "kept_pct"]


def _kept(months: DataFrame) -> DataFrame:
    return months.select("product_category", "month", "buyers", "kept_buyers",
                         (F.lit(100.0) * safe_div(F.col("kept_buyers"), F.col("buyers"))).alias("kept_pct")).orderBy("product_category", "month")


def buyers_kept(state: DataFrame) -> DataFrame:
    """Per category and month the buyers, and how many of them bought in the category in the next month too.

    ``state`` is that of ``category_buyers``.  Each month meets the next one by a window over the state (one row per category and month);
    intersecting the two theta sketches counts the customers of both."""
    months = united_distinct(state.where(F.col("month").isNotNull()), ["product_category", "month"])
    following = Window.partitionBy("product_category").orderBy("month")
    months = months.withColumn("next_month", F.lead("month").over(following)).withColumn("next_theta", F.lead("theta").over(following))
    both = F.when(F.col("next_month") == F.add_months("month", 1), F.theta_sketch_estimate(F.theta_intersection("theta", "next_theta")))
    return _kept(months.withColumns({"buyers": F.theta_sketch_estimate("theta"), "kept_buyers": F.coalesce(both, F.lit(0).cast("long"))}))


def buyers_kept_exact(T: DataFrame) -> DataFrame:
    """``buyers_kept`` from the facts: distinct (category, customer, month), each with the customer's next month."""
    seen = T.where(F.col("customer_id").isNotNull() & F.col("transaction_date").isNotNull()).select(
        "product_category", "customer_id", month_start("transaction_date").alias("month")).distinct()
    # a customer's months of one category: one row a month, so a partition is small however hot the customer
    own = Window.partitionBy("product_category", "customer_id").orderBy("month")
    seen = seen.withColumn("kept", F.lead("month").over(own) == F.add_months("month", 1))
    return _kept(seen.groupBy("product_category", "month").agg(F.count(F.lit(1)).alias("buyers"), F.count_if("kept").alias("kept_buyers")))


# --------------------------------------------------------------------- quantiles

def quantile_state(df: DataFrame, value: str, by: dict[str, Column], k: int = KLL_K) -> DataFrame:
    """One row per ``by`` with the KLL sketch of the non-null ``value``: (by..., n, kll)."""
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x))
    return rows.groupBy(*(c.alias(n) for n, c in by.items())).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(x, F.lit(k)).alias("kll"))


def united_quantiles(state: DataFrame, by: Sequence[str] = (), k: int = KLL_K) -> DataFrame:
    return state.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("kll", F.lit(k)).alias("kll"))


def sketched_quantiles(state: DataFrame, probs: Sequence[float], names: Sequence[str], by: Sequence[str] = (), k: int = KLL_K) -> DataFrame:
    """(by..., n, names...): values whose rank is within the sketch's error of each of ``probs``."""
    q = F.kll_sketch_get_quantile_double("kll", F.array(*(F.lit(float(p)) for p in probs)))
    rows = united_quantiles(state, by, k).select(*by, "n", q.alias("__q"))
    return rows.select(*by, "n", *(F.col("__q")[i].alias(n) for i, n in enumerate(names)))


def spend_by_segment_and_day(T: DataFrame, C: DataFrame, k: int = KLL_K) -> DataFrame:
    """State of the amounts per segment and day of purchase: quantiles of any stretch of days by merging its rows."""
    seg = T.join(C.select("customer_id", "customer_segment"), "customer_id")
    return quantile_state(seg, "amount", {"customer_segment": F.col("customer_segment"), "day": F.col("transaction_date")}, k)


def profile_quantiles(P: DataFrame, value: str, k: int = KLL_K) -> DataFrame:
    """State of a profile measure per segment and signup day (A05, A08, C7): a segment's quartiles merge its days, the whole
    profile's merge everything."""
    return quantile_state(P, value, {"customer_segment": F.col("customer_segment"), "day": F.col("signup_date")}, k)
