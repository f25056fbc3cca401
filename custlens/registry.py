"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each entry runs one operator of the inventory over the *whole* mapped
test tables (``sources.testmap``) with the fixed ``AS_OF``.  Outputs are
passed through ``functions.normalize.normalize`` (doubles rounded
to 40 significant bits) so the driver's exact value hash is independent of
float summation order; the oracle applies the same rounding.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.normalize import normalize
from .operators import queries as Q
from .operators import sketches
from .operators.state import SummaryState
from .operators.summaries import tx_by_customer
from .plans.session import checkpoint_dir
from .sources import testmap
from .sources.checked import checked, quarantine_of
from .sources.loads import open_table
from .sources.tables import insert_or_ignore

AS_OF = testmap.AS_OF

QueryFn = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, QueryFn] = {}


def _reg(name: str, build: Callable[..., DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        C, T, E = testmap.load(spark, sf_dir)
        return normalize(build(C, T, E))
    run.__name__ = name
    _REGISTRY[name] = run


def _reg_uncut(name: str, build: Callable[..., DataFrame]) -> None:
    """Over transactions whose amounts are not whole cents."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        C, T, E = testmap.load(spark, sf_dir)
        return normalize(build(C, testmap.uncut(spark, sf_dir, T), E))
    run.__name__ = name
    _REGISTRY[name] = run


# ----------------------------------------------------------- S: SQL catalogue
_reg("s01_customer_list", lambda C, T, E: Q.customer_list(C))
_reg("s02_customers_by_country", lambda C, T, E: Q.customers_by_country(C))
_reg("s03_customers_by_channel", lambda C, T, E: Q.customers_by_channel(C))
_reg("s04_customer_transactions", lambda C, T, E: Q.customer_transactions(C, T))
_reg("s05_revenue_by_category", lambda C, T, E: Q.revenue_by_category(T))
_reg("s06_revenue_by_payment_method", lambda C, T, E: Q.revenue_by_payment_method(T))
_reg("s07_monthly_revenue", lambda C, T, E: Q.monthly_revenue(T))
_reg("s08_customer_engagement", lambda C, T, E: Q.customer_engagement(C, E))
_reg("s09_device_usage", lambda C, T, E: Q.device_usage(E))
_reg("s10_customer_conversion", lambda C, T, E: Q.customer_conversion(C, E))
_reg("s11_rfm_rules", lambda C, T, E: Q.rfm_rules(C, T, AS_OF))
_reg("s12_churn_by_inactivity", lambda C, T, E: Q.churn_by_inactivity(C, T, AS_OF))
_reg("s13_clv_three_year", lambda C, T, E: Q.clv_three_year(C, T, AS_OF))
_reg("s14_cohort_retention", lambda C, T, E: Q.cohort_retention(C, T))
_reg("s15_segment_performance", lambda C, T, E: Q.segment_performance(C, T, E))
_reg("s16_channel_effectiveness", lambda C, T, E: Q.channel_effectiveness(C, T))
_reg("s17_top_customers", lambda C, T, E: Q.top_customers(C, T, 20))
_reg("s18_top_products", lambda C, T, E: Q.top_products(T))
_reg("s19_value_comparison", lambda C, T, E: Q.value_comparison(C, T))
_reg("s20_recently_active", lambda C, T, E: Q.recently_active(C, T, AS_OF, 30))
_reg("s21_business_kpis", lambda C, T, E: Q.business_kpis(C, T, AS_OF, 30))
_reg("s22_customer_growth", lambda C, T, E: Q.customer_growth(C))
_reg("s23_purchase_frequency_by_category", lambda C, T, E: Q.purchase_frequency_by_category(T))
_reg("s24_avg_spend_by_segment", lambda C, T, E: Q.avg_spend_by_segment(C, T))
_reg("s25_inactive_customers", lambda C, T, E: Q.inactive_customers(C, T, AS_OF, 180, 10))


_reg("s11_rfm_rules_repeated_ids", lambda C, T, E: Q.rfm_rules(
    C, T, AS_OF, tx=tx_by_customer(T.unionAll(T), exact_distinct=True)))
_reg_uncut("s15_segment_performance_uncut", lambda C, T, E: Q.segment_performance(C, T, E))


def _second_load(C, T, E):
    """L4: a batch that repeats the loaded ids, and holds each new id twice."""
    new = T.withColumn("transaction_id", F.col("transaction_id") + 1_000_000_000)
    return insert_or_ignore(T, T.unionAll(new).unionAll(new.withColumn("amount", F.col("amount") + 5)), table="transactions")


_reg("l04_insert_or_ignore", _second_load)


def _scratch(df: DataFrame, name: str) -> str:
    return f"{checkpoint_dir(df.sparkSession)}/custlens-{name}-{uuid.uuid4().hex}"


def _second_keyed_load(C, T, E):
    """L4 into a loaded table: the second load of ``_second_load``, given twice; the rows it added."""
    new = T.withColumn("transaction_id", F.col("transaction_id") + 1_000_000_000)
    batch = T.unionAll(new).unionAll(new.withColumn("amount", F.col("amount") + 5))
    target = open_table(T.sparkSession, _scratch(T, "keyed"), "transactions", LOAD_BUCKETS)
    for load_id, rows in (("first", T), ("second", batch), ("second", batch)):
        target.insert_or_ignore(rows, load_id)
    return target.read(only=lambda load: load.id == "second")


_reg("l04_keyed_load", _second_keyed_load)

#: The two loads of the state queries: dates before this day, and the rest.
LOAD_DAY = date(1998, 1, 1)
ENG_LOAD_DAY = date(2024, 1, 15)
LOAD_BUCKETS = 8


def _state(C, T, E) -> SummaryState:
    state = SummaryState(T.sparkSession, _scratch(T, "state"), LOAD_BUCKETS)
    late_t, late_e = F.col("transaction_date") >= LOAD_DAY, F.col("engagement_date") >= ENG_LOAD_DAY
    state.add("first", T.where(~late_t), E.where(~late_e))
    state.add("second", T.where(late_t | late_t.isNull()), E.where(late_e | late_e.isNull()))
    return state


_reg("p01_transaction_state", lambda C, T, E: _state(C, T, E).tx())
_reg("p01_engagement_state", lambda C, T, E: _state(C, T, E).eng())



def _spoilt(T):
    """Transactions as text, with dates, amounts, quantities and keys that do not parse."""
    i = F.col("transaction_id")
    return T.select(*(F.col(c).cast("string").alias(c) for c in T.columns if c != "transaction_id"), i).withColumns({
        "transaction_date": F.when(i % 97 == 1, "2024-02-31").when(i % 97 == 2, "yesterday").otherwise(F.col("transaction_date")),
        "amount": F.when(i % 89 == 3, "n/a").when(i % 89 == 4, "1e999").otherwise(F.col("amount")),
        "quantity": F.when(i % 83 == 5, "2.5").when(i % 83 == 6, "3000000000").otherwise(F.col("quantity")),
        "transaction_id": F.when(i % 101 == 7, F.concat(F.lit("T"), i)).otherwise(i.cast("string"))})


_reg("l02_quarantine", lambda C, T, E: quarantine_of(checked(_spoilt(T), "transactions"), "transactions"))
_reg("l02_checked_rows", lambda C, T, E: checked(_spoilt(T), "transactions").where("transaction_id IS NOT NULL").drop("__problems"))
_reg("q23_buyers_kept", lambda C, T, E: sketches.buyers_kept_exact(T))
_reg("q23_buyers_kept_theta", lambda C, T, E: sketches.buyers_kept(sketches.category_buyers(T)))  # exact up to 65,536 buyers


def registry() -> dict[str, QueryFn]:
    from . import registry_profile  # noqa: F401  (registers P/R/A/C entries)
    return dict(_REGISTRY)
